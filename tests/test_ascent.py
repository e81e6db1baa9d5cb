"""Dual ascent in the plane: every bound holds, and they rise."""

import itertools

import numpy as np
import pytest

from clustrel.operators import ascent


def best_cost(x, k):
    cost = lambda s: ((x[s] - x[s].mean(0)) ** 2).sum()
    return min(sum(cost([i for i in range(len(x)) if at[i] == j]) for j in range(k) if j in at) for at in itertools.product(range(k), repeat=len(x)))


def test_bounds_stay_below_the_best_cost_and_rise(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(3, 2)) * 0.5 + c for c in ((0, 0), (6, 0))])
    start = spark.createDataFrame([(i, float(p[0]), float(p[1]), 0.1) for i, p in enumerate(x)], "id long, x double, y double, lam double")
    steps, duals = ascent.plane_dual_bound(start, 2, 4)
    best = best_cost(x, 2)
    assert all(s.bound <= best + 1e-7 for s in steps) and [s.best for s in steps] == list(np.maximum.accumulate([s.bound for s in steps]))
    assert steps[-1].best > steps[0].bound and len(steps) == 5
    lam = np.array([r["lam"] for r in duals.orderBy("id").collect()])
    low = min(((x[list(s)] - x[list(s)].mean(0)) ** 2).sum() - lam[list(s)].sum() for n in range(1, 7) for s in itertools.combinations(range(6), n))
    assert lam.min() >= 0 and lam.sum() + 2 * min(0, low) == pytest.approx(steps[-1].best)


def test_no_points(spark):
    none = spark.createDataFrame([], "id long, x double, y double, lam double")
    assert ascent.plane_dual_bound(none, 3, 2)[0][0].bound == 0
