"""The fractional iteration against all subsets, and on groups too large for that."""

import numpy as np
import pytest

from clustrel.operators import fractional


def frame(spark, rows):
    return spark.createDataFrame([(g, i, [float(v) for v in x], float(w)) for g, i, x, w in rows], "grp string, id long, features array<double>, lam double").repartition(3)


def ratio(x, lam, keep):
    d2 = ((x[keep][:, None] - x[keep]) ** 2).sum(2)
    pairs = (d2 - lam[keep][:, None] - lam[keep])[np.triu_indices(len(keep), 1)].sum()
    return (pairs - lam[keep].sum()) / len(keep)


def best(x, lam):
    sets = [[i for i in range(len(x)) if mask >> i & 1] for mask in range(1, 1 << len(x))]
    return min(ratio(x, lam, s) for s in sets)


def made(seed, sizes):
    rng = np.random.default_rng(seed)
    return [(f"g{g}", 100 * g + i, rng.normal(size=3) + 20, rng.uniform(0.1, 4)) for g, n in enumerate(sizes) for i in range(n)]


def found(spark, rows, **more):
    groups, members = fractional.best_ratios(frame(spark, rows), "grp", **more)
    held = {}
    for r in members.collect():
        held.setdefault(r["grp"], []).append(r["id"])
    return {r["grp"]: r for r in groups.collect()}, held


def arrays(rows, g):
    own = sorted(r[1:] for r in rows if r[0] == g)
    return [r[0] for r in own], np.array([r[1] for r in own]), np.array([r[2] for r in own])


def test_small_groups_equal_all_masks(spark):
    rows = made(0, [1, 2, 5, 9, 12]) + [("same", 900 + i, np.ones(3), 1.0) for i in range(4)] + [("zero", 950 + i, np.ones(3) * i, 0.0) for i in range(3)]
    groups, held = found(spark, rows)
    assert len(groups) == 7
    for g, r in groups.items():
        ids, x, lam = arrays(rows, g)
        at = [ids.index(i) for i in held.get(g, [])]
        assert r["exact"] and r["n"] == len(ids) and r["size"] == len(at)
        assert r["ratio"] == pytest.approx(best(x, lam), abs=1e-9) == pytest.approx(ratio(x, lam, at), abs=1e-9)


def test_large_groups_stand_still_and_leave_no_rows_out(spark):
    rows = made(1, [14, 40, 3]) + [("far", 5000 + i, np.array([100.0 * i, 0, 0]), 1.0 + i % 3) for i in range(20)] + [("all", 6000 + i, np.array([0.01 * i, 0, 0]), 50.0) for i in range(30)]
    groups, held = found(spark, rows)
    for g, r in groups.items():
        ids, x, lam = arrays(rows, g)
        at = [ids.index(i) for i in held[g]]
        assert r["exact"] == (len(ids) <= 12) and r["ratio"] == pytest.approx(ratio(x, lam, at), abs=1e-7) and r["ratio"] <= -lam.max() + 1e-9
        c = x[at].mean(0)
        inside = np.flatnonzero(((x - c) ** 2).sum(1) < lam)
        if not r["exact"] and len(inside):
            assert ratio(x, lam, inside) >= r["ratio"] - 1e-7
    assert groups["all"]["size"] == 30 and groups["far"]["size"] == 1 and groups["far"]["ratio"] == -3.0


def test_large_groups_come_close_to_the_best(spark):
    rows = made(2, [13] * 12)
    groups, _ = found(spark, rows)
    gaps = [r["ratio"] - best(*arrays(rows, g)[1:]) for g, r in groups.items()]
    assert min(gaps) > -1e-7 and sum(gap < 1e-7 for gap in gaps) >= 8


def test_no_groups(spark):
    groups, members = fractional.best_ratios(frame(spark, made(0, [2])).limit(0), "grp")
    assert groups.count() == members.count() == 0
    assert fractional.best_ratios(frame(spark, [(None, 1, [1.0], 1.0)]), "grp")[0].count() == 0
