"""Peeling, pricing of many columns, covers, column pairs and components against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clustrel.operators import columns, graph, multipricing


def edges(spark, pairs):
    return spark.createDataFrame([(min(p), max(p)) for p in pairs], "src long, dst long")


def ids(spark, n):
    return spark.range(n)


def peel(n, pairs):
    near = {i: {b if a == i else a for a, b in pairs if i in (a, b)} for i in range(n)}
    out, level, round_ = {}, 0, 0
    while near:
        level = max(level, min(map(len, near.values())))
        now = [i for i, x in near.items() if len(x) <= level]
        for i in now:
            out[i] = (level, round_)
            del near[i]
        near = {i: x - set(now) for i, x in near.items()}
        round_ += 1
    return out


def test_degeneracy_order_equals_a_plain_peel(spark):
    for seed in range(20):
        rng = random.Random(seed)
        n = rng.randint(1, 14)
        pairs = [p for p in itertools.combinations(range(n), 2) if rng.random() < seed / 20]
        e = edges(spark, pairs)
        order = graph.degeneracy_order(ids(spark, n), e)
        got = {r["id"]: (r["core"], r["round"]) for r in order.collect()}
        want = peel(n, pairs)
        assert got == want
        if seed % 5 == 0:
            later = {r["id"]: r["later"] for r in graph.later_by(order, e).collect()}
            assert sorted(later) == list(range(n)) and sum(map(len, later.values())) == len(pairs)
            assert max(map(len, later.values())) <= max(c for c, _ in want.values())
    assert graph.degeneracy_order(ids(spark, 0), edges(spark, [])).count() == 0


SIGMA = 2.5


def nodes(spark, x, lam):
    return spark.createDataFrame([(i, [float(v) for v in p], float(w)) for i, (p, w) in enumerate(zip(x, lam, strict=True))], "id long, features array<double>, lam double")


@pytest.mark.parametrize("most", [4096, 3])
def test_many_columns_equal_all_subsets(spark, monkeypatch, most):
    monkeypatch.setattr(multipricing, "MOST", most)
    rng = np.random.default_rng(4)
    x, lam = rng.normal(size=(12, 2)) * 1.5, rng.uniform(0.1, 2.5, 12)
    lam[3], x[3] = 0.0, (50, 50)
    n = nodes(spark, x, lam)
    e = graph.edges(n)
    later = graph.oriented(n, e)
    got = {r["seed"]: r for r in multipricing.priced(n, later, SIGMA).collect()}
    after = {r["id"]: r["later"] for r in later.collect()}
    rc = lambda s: SIGMA + ((x[s] - x[s].mean(0)) ** 2).sum() - lam[s].sum()
    for i, r in got.items():
        best = min(rc([i, *c]) for k in range(len(after[i]) + 1) for c in itertools.combinations(after[i], k))
        assert r["rc"] == pytest.approx(rc(r["members"])) and r["bound"] <= best + 1e-9 and r["n"] == len(after[i]) + 1
        if r["status"] == "pruned":
            assert best >= -1e-6 and not r["exact"]
        elif r["n"] <= most:
            assert r["exact"] and r["rc"] == pytest.approx(best)
    c = multipricing.counters(multipricing.priced(n, later, SIGMA)).first()
    assert c["n_groups"] == 12 == c["n_pruned"] + c["n_singles"] + c["n_searched"] and min(c) >= 1
    new = multipricing.entering(multipricing.priced(n, later, SIGMA)).collect()
    assert len(new) == len({tuple(r["members"]) for r in got.values() if r["rc"] < -1e-6}) > 0


def pool(spark, sets):
    return spark.createDataFrame([(k, sorted(s)) for k, s in enumerate(sets)], "col_id long, members array<long>")


def greedy(sets, left):
    left, out = set(left), []
    while gain := max((len(s & left) for s in sets), default=0):
        k = next(k for k, s in enumerate(sets) if len(s & left) == gain)
        out.append(k)
        left -= sets[k]
    return out, left


def test_coverage_patch_is_the_greedy_cover(spark):
    for seed in range(30):
        rng = random.Random(seed)
        sets = [set(rng.sample(range(15), rng.randint(0, 6))) for _ in range(rng.randint(1, 12))]
        start = [0] if seed % 3 == 0 else []
        had = set().union(*(sets[k] for k in start))
        patch, uncovered = columns.coverage_patch(pool(spark, sets), ids(spark, 15), spark.createDataFrame([(k,) for k in start], "col_id long") if start else None)
        want, left = greedy(sets, set(range(15)) - had)
        rows = patch.collect()
        assert sorted(r["col_id"] for r in rows) == sorted(want)
        assert [r["gain"] for r in sorted(rows, key=lambda r: r["step"])] == sorted((r["gain"] for r in rows), reverse=True)
        assert {r["id"] for r in uncovered.collect()} == left


def stepwise(sets, left):
    """col_id: step of the greedy cover, a step at a time."""
    out, step = {}, 0
    while gain := max((len(s & left) for s in sets), default=0):
        at = [k for k, s in enumerate(sets) if len(s & left) == gain]
        now = [k for k in at if all(j >= k or not sets[j] & sets[k] & left for j in at)]
        out |= dict.fromkeys(now, step)
        left, step = left - set().union(*(sets[k] for k in now)), step + 1
    return out


@pytest.mark.parametrize("held", [1 << 18, 40])
def test_cover_of_a_long_chain_takes_few_passes(spark, monkeypatch, held):
    """Columns that overlap in a chain take a step each, but not a pass each; in blocks too."""
    writes = []
    real = columns.kept
    monkeypatch.setattr(columns, "HELD", held)
    monkeypatch.setattr(columns, "kept", lambda df: writes.append(1) or real(df))
    sets = [set(range(2 * k, 2 * k + 3)) for k in range(60)]
    patch, uncovered = columns.coverage_patch(pool(spark, sets), ids(spark, 123))
    assert {r["col_id"]: r["step"] for r in patch.collect()} == stepwise(sets, set(range(121)))
    assert {r["id"] for r in uncovered.collect()} == {121, 122} and len(writes) < 40


@pytest.mark.parametrize("block", [512, 2])
def test_pairs_within_columns_are_not_added_up_one_by_one(spark, monkeypatch, block):
    monkeypatch.setattr(columns, "BLOCK", block)
    rng = random.Random(block)
    sets = [set(rng.sample(range(14), rng.randint(0, 9))) for _ in range(5)] + [set(range(8))]
    cols = spark.createDataFrame([(k, sorted(s), (k % 3) / 4) for k, s in enumerate(sets)], "col_id long, members array<long>, z double")
    got = columns.cooccurrence(cols)
    want = {(a, b): f for a, b in itertools.combinations(range(14), 2) if (f := sum((k % 3) / 4 for k, s in enumerate(sets) if {a, b} <= s))}
    rows = got.collect()
    assert {(r["a"], r["b"]): r["frac"] for r in rows} == pytest.approx(want) and len(rows) == len(want)
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_column_pairs_equal_all_pairs(spark):
    for seed in range(4):
        rng = random.Random(seed)
        sets = [set(rng.sample(range(12), rng.randint(1, 5))) for _ in range(14)]
        z = [rng.choice([0.0, 0.25, 0.5, 0.75, 1.0]) for _ in sets]
        cols = spark.createDataFrame([(k, sorted(s), v) for k, (s, v) in enumerate(zip(sets, z, strict=True))], "col_id long, members array<long>, z double")
        want = {(a, b): (len(sets[a] & sets[b]), min(sets[a] & sets[b]), 1 - abs(z[a] - 0.5) - abs(z[b] - 0.5))
                for a, b in itertools.combinations(range(14), 2) if 0 < z[a] < 1 and 0 < z[b] < 1 and sets[a] & sets[b] and sets[a] - sets[b]}
        assert {(r["t1"], r["t2"]): (r["common"], r["i1"], r["score"]) for r in columns.column_pairs(cols).collect()} == want
        best = columns.column_branching_pair(cols).collect()
        if want:
            a, b = min(want, key=lambda p: (-want[p][2], p))
            assert tuple(best[0])[:4] == (a, b, want[a, b][1], min(sets[a] - sets[b]))
        plan = columns.column_pairs(cols)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert columns.column_branching_pair(cols.where("z = 1")).count() == 0


def test_components_of_a_long_path_take_few_rounds(spark, monkeypatch):
    rounds = []
    real = columns.drop
    monkeypatch.setattr(columns, "drop", lambda df: rounds.append(1) or real(df))
    ends = [(i, i + 1) for i in range(200)] + [(500, 501)]
    random.Random(0).shuffle(ends)
    got = columns.same_components(spark.createDataFrame(ends, "i long, j long"))
    assert {(r["component"], r["n"]) for r in got.groupBy("component").agg(F.count(F.lit(1)).alias("n")).collect()} == {(0, 201), (500, 2)}
    assert len(rounds) <= 10


def test_constrained_columns_equal_all_subsets(spark):
    rng = np.random.default_rng(8)
    x, lam = rng.normal(size=(10, 2)) * 1.2, rng.uniform(0.3, 2.5, 10)
    same, diff = [(0, 1), (1, 4), (6, 7)], [(0, 2), (3, 8), (5, 6)]
    pairs = lambda p: spark.createDataFrame(p, "i long, j long")
    got = multipricing.constrained(nodes(spark, x, lam), pairs(same), pairs(diff), 1.0).collect()
    rc = lambda s: 1.0 + ((x[s] - x[s].mean(0)) ** 2).sum() - lam[s].sum()
    fine = [list(s) for n in range(1, 11) for s in itertools.combinations(range(10), n) if all((i in s) == (j in s) for i, j in same) and not any(i in s and j in s for i, j in diff)]
    assert sorted(r["seed"] for r in got) == [0, 2, 3, 5, 6, 8, 9] and all(r["members"] in fine and r["rc"] == pytest.approx(rc(r["members"])) for r in got)
    best = min(map(rc, fine))
    assert min(r["rc"] for r in got) == pytest.approx(best) and min(r["bound"] for r in got) <= best + 1e-9
    with pytest.raises(Exception, match="held together"):
        multipricing.constrained(nodes(spark, x, lam), pairs(same), pairs([(0, 4)])).collect()


def test_branching_pair_by_classes_equals_all_pairs(spark):
    for seed in range(6):
        rng = random.Random(seed)
        sets = [rng.sample(range(10), rng.randint(1, 7)) for _ in range(6)]
        z = [rng.choice([0.0, 0.2, 0.3, 0.5, 1.0]) for _ in sets]
        cols = spark.createDataFrame([(k, sorted(s), v) for k, (s, v) in enumerate(zip(sets, z, strict=True))], "col_id long, members array<long>, z double")
        frac = {(a, b): sum(v for s, v in zip(sets, z, strict=True) if a in s and b in s) for a, b in itertools.combinations(range(10), 2)}
        some = [(round(abs(f - 0.5), 9), *p) for p, f in frac.items() if 1e-4 < f < 1 - 1e-4]
        got = [(r["a"], r["b"]) for r in columns.branching_pair(cols).collect()]
        assert got == ([min(some)[1:]] if some else [])
