"""Pricing: the set of points of least cost less duals, by one neighbourhood per point, all in parallel.

Points that must stay together are one item: a weight, a mean, an inner cost and a summed dual. A set that is
worth most holds no item farther from its mean than the item's radius, so two of its items are at most the sum
of their radii apart, and every such set lies in one item with its later neighbours in any fixed order. Each
neighbourhood is searched depth first; a branch ends where its cost less all duals still to come can't be
better. A search that meets its limit reports the bound of what it left open, and that it wasn't exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Items:
    """Weights, means, inner costs and duals of items, the pairs of them that mustn't meet, and their points."""

    weight: np.ndarray
    mean: np.ndarray
    inner: np.ndarray
    lam: np.ndarray
    apart: set[tuple[int, int]]
    members: list[list[int]]


def contract(x: np.ndarray, lam: np.ndarray, same: list[tuple[int, int]], diff: list[tuple[int, int]]) -> Items | None:
    """Items from points: those of same pairs merge. None if a diff pair lies within one item: the node is infeasible."""
    root = list(range(len(x)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, j in same:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    tops = sorted({find(i) for i in range(len(x))})
    at = {t: k for k, t in enumerate(tops)}
    members: list[list[int]] = [[] for _ in tops]
    for i in range(len(x)):
        members[at[find(i)]].append(i)
    apart = {tuple(sorted((at[find(i)], at[find(j)]))) for i, j in diff}
    if any(a == b for a, b in apart):
        return None
    mean = np.array([x[m].mean(0) for m in members])
    inner = np.array([((x[m] - x[m].mean(0)) ** 2).sum() for m in members])
    return Items(np.array([len(m) for m in members], float), mean, inner, np.array([lam[m].sum() for m in members]), apart, members)


def neighbourhoods(items: Items, tol: float = 1e-10) -> list[np.ndarray]:
    """For each item, those after it by (degree, number) that a set of use with it could hold."""
    r = np.sqrt(np.maximum(items.lam - items.inner, 0) / items.weight)
    near = np.zeros((len(r), len(r)), bool)
    for k in range(len(r)):  # a row at a time: memory stays that of the result
        near[k] = np.sqrt(((items.mean - items.mean[k]) ** 2).sum(1)) <= r[k] + r + tol
    np.fill_diagonal(near, False)
    for a, b in items.apart:
        near[a, b] = near[b, a] = False
    rank = np.lexsort((np.arange(len(r)), near.sum(1))).argsort()
    return [np.flatnonzero(near[i] & (rank > rank[i])) for i in range(len(r))]


def search(items: Items, seed: int, later: np.ndarray, limit: int = 2000) -> tuple[float, list[int], float, bool]:
    """value, items, bound, exact: the set of least cost less duals that holds the seed and else only later ones."""
    gain = items.lam - items.inner
    later = later[gain[later] > 0]
    later = later[np.argsort(((items.mean[later] - items.mean[seed]) ** 2).sum(1), kind="stable")].tolist()
    rest = np.append(np.cumsum(gain[later][::-1])[::-1], 0.0)
    best, chosen, left, n = -gain[seed], [seed], np.inf, 0
    stack = [(0, -gain[seed], items.weight[seed], items.mean[seed], [seed])]
    while stack:
        at, value, w, mean, held = stack.pop()
        if value < best - 1e-12:
            best, chosen = value, held
        bound = value - rest[at]
        if at == len(later) or bound >= best - 1e-9:
            continue
        n += 1
        if n > limit:
            left = min(left, bound)
            continue
        j = later[at]
        stack.append((at + 1, value, w, mean, held))
        if all((min(i, j), max(i, j)) not in items.apart for i in held):
            wj = items.weight[j]
            add = w * wj / (w + wj) * float(((items.mean[j] - mean) ** 2).sum()) - gain[j]
            stack.append((at + 1, value + add, w + wj, (w * mean + wj * items.mean[j]) / (w + wj), [*held, j]))
    return float(best), chosen, float(min(best, left)), bool(np.isinf(left))


SCHEMA = "seed long, members array<long>, value double, bound double, exact boolean"


def price(spark: SparkSession, items: Items, limit: int = 2000) -> pd.DataFrame:
    """The best set of every neighbourhood: seed, members (points), value (cost less duals), bound, exact.

    Neighbourhoods that can't reach below zero at all, by their duals, are answered by the seed alone.
    """
    held = spark.sparkContext.broadcast((items, neighbourhoods(items)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, later = held.value
        for b in batches:
            rows = []
            for s in b["id"].tolist():
                value, chosen, bound, exact = search(own, s, later[s], limit)
                rows.append((s, sorted(p for c in chosen for p in own.members[c]), value, bound, exact))
            yield pd.DataFrame(rows, columns=["seed", "members", "value", "bound", "exact"])

    n = len(items.weight)
    if n <= 64:  # a job would cost more than the search
        return pd.concat(run(iter([pd.DataFrame({"id": range(n)})])), ignore_index=True)
    out = spark.range(n).repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, SCHEMA).toPandas()
    return out.sort_values("seed", ignore_index=True)


def quick(items: Items) -> pd.DataFrame:
    """Sets found from each item by fixed points, without proof: SCHEMA less bound, exact. Items that mustn't meet don't: of such a pair the one farther from the centre goes."""
    rows = []
    for s in range(len(items.weight)):
        c, held = items.mean[s], None
        for _ in range(15):
            gain = items.lam - items.inner - items.weight * ((items.mean - c) ** 2).sum(1)
            new = gain > 0
            new[s] = True
            for a, b in items.apart:
                if new[a] and new[b]:
                    new[b if a == s or (b != s and gain[a] >= gain[b]) else a] = False
            if held is not None and (new == held).all():
                break
            held = new
            c = np.average(items.mean[held], axis=0, weights=items.weight[held])
        value = float((items.inner[held] + items.weight[held] * ((items.mean[held] - c) ** 2).sum(1) - items.lam[held]).sum())
        rows.append((s, sorted(p for t in np.flatnonzero(held).tolist() for p in items.members[t]), value))
    return pd.DataFrame(rows, columns=["seed", "members", "value"]).drop_duplicates("value", ignore_index=True)


def lower_bounds(nodes: DataFrame, later: DataFrame) -> DataFrame:
    """id, held: the sum of duals of each node and its later neighbours. sigma - held bounds from below the reduced cost of every set of them."""
    lam = nodes.select("id", "lam")
    far = later.select("id", F.explode("later").alias("o")).join(lam.select(F.col("id").alias("o"), F.col("lam").alias("lo")), "o").groupBy("id").agg(F.sum("lo").alias("more"))
    return lam.join(far, "id", "left").select("id", (F.col("lam") + F.coalesce("more", F.lit(0.0))).alias("held"))
