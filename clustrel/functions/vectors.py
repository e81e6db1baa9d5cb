"""Column expressions over points held as ARRAY<DOUBLE>, and over discs in the plane."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

TOL = 1e-10


def sq_dist(a: Column, b: Column, dim: int | None = None) -> Column:
    """Squared distance of two arrays. With the dimension known the sum is unrolled and stays in generated code."""
    if dim:
        return reduce(add, ((F.get(a, k) - F.get(b, k)) * (F.get(a, k) - F.get(b, k)) for k in map(F.lit, range(dim))))
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def sq_norm(a: Column) -> Column:
    """Squared length of an array."""
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)


def radius(lam: Column) -> Column:
    """The radius of a disc from its dual value."""
    return F.sqrt(F.greatest(lam, F.lit(0.0)))


def plane_sq(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance in the plane."""
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def in_disc(px: Column, py: Column, x: Column, y: Column, lam: Column, tol: float = TOL) -> Column:
    """Whether a point lies in a disc."""
    return plane_sq(px, py, x, y) <= lam + tol


def disc_relation(d: Column, ri: Column, rj: Column, tol: float = TOL) -> Column:
    """How two discs at a distance d lie."""
    return (
        F.when(d > ri + rj + tol, "DISJOINT")
        .when((d < tol) & (F.abs(ri - rj) < tol), "IDENTICAL")
        .when(d <= F.abs(ri - rj) + tol, "CONTAINED")
        .otherwise("INTERSECT")
    )


def circle_points(xi: Column, yi: Column, ri: Column, xj: Column, yj: Column, rj: Column) -> Column:
    """Where two circles meet: an array of two structs (side, px, py)."""
    d2 = plane_sq(xi, yi, xj, yj)
    d = F.sqrt(d2)
    along = (ri * ri - rj * rj + d2) / (2 * d)
    off = F.sqrt(F.greatest(ri * ri - along * along, F.lit(0.0)))
    ux, uy = (xj - xi) / d, (yj - yi) / d
    at = lambda side: F.struct(F.lit(side).alias("side"), (xi + along * ux - side * off * uy).alias("px"), (yi + along * uy + side * off * ux).alias("py"))
    return F.array(at(1), at(-1))


def gap_pct(upper: Column, lower: Column) -> Column:
    """The gap between bounds in per cent of the upper one."""
    return F.when(upper == 0, F.lit(0.0)).otherwise(100 * (upper - lower) / F.abs(upper))
