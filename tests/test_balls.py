"""The ball tree: its leaves, the pairs that it leaves out, and graphs from it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clustrel.operators import balls, graph


def discs(spark, x, r):
    return spark.createDataFrame([(i, [float(v) for v in p], float(w)) for i, (p, w) in enumerate(zip(x, r, strict=True))], "id long, features array<double>, r double").repartition(3)


def plain(x, r):
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    i, j = np.nonzero(np.triu(d <= r[:, None] + r + 1e-10, 1))
    return set(zip(i.tolist(), j.tolist(), strict=True))


def compared(cells):
    return balls.leaf_pairs(cells).agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb")))).first()[0]


@pytest.mark.parametrize("leaf,rounds", [(4, 24), (2, 1), (100, 24)])
def test_leaves_hold_all_members_and_pairs_miss_none(spark, monkeypatch, leaf, rounds):
    monkeypatch.setattr(balls, "LEAF", leaf)
    monkeypatch.setattr(balls, "ROUNDS", rounds)
    rng = np.random.default_rng(leaf)
    x = np.concatenate([rng.normal(size=(70, 2)) * 3, np.zeros((20, 2)), rng.normal(size=(30, 2)) + 40])
    r = np.concatenate([rng.uniform(0, 0.6, 70), np.zeros(10), rng.uniform(0, 2, 38), [30.0, 0.0]])
    members, cells = balls.tree(discs(spark, x, r))
    rows = members.collect()
    assert sorted(m["id"] for m in rows) == list(range(120))
    by = {c["cell"]: c for c in cells.collect()}
    for m in rows:
        c = by[m["cell"]]
        assert c["leaf"] and m["part"] < c["parts"] and m["r"] <= c["rmax"] and np.sqrt(((np.array(m["features"]) - c["centre"]) ** 2).sum()) <= c["reach"] + 1e-12
    home = {m["id"]: m["cell"] for m in rows}
    pairs = {(p["a"], p["b"]) for p in balls.leaf_pairs(cells).collect()}
    assert all(tuple(sorted((home[i], home[j]))) in pairs for i, j in plain(x, r))
    nodes = discs(spark, x, r).withColumn("lam", F.col("r") * F.col("r"))
    got = [(e["src"], e["dst"]) for e in graph.edges(nodes).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(x, r)


def test_at_most_half_of_all_pairs_are_compared_on_clustered_points(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(200, 16)) + 12 * rng.normal(size=16) for _ in range(10)])
    n = len(x)
    assert compared(balls.tree(discs(spark, x, np.full(n, 0.8)))[1]) <= n * (n - 1) / 4


def test_work_is_linear_in_the_plane(spark):
    rng = np.random.default_rng(1)
    work = []
    for n in (10_000, 100_000):
        side = np.sqrt(n)
        df = spark.range(n).select("id", F.array(*(F.rand(k) * float(side) for k in (1, 2))).alias("features"), F.lit(0.5).alias("r"))
        work.append(compared(balls.tree(df)[1]) / n)
    assert work[1] < 1.6 * work[0] < 1.6 * 16 * balls.LEAF


def test_one_huge_disc_and_many_equal_points(spark, monkeypatch):
    monkeypatch.setattr(balls, "LEAF", 8)
    rng = np.random.default_rng(2)
    x, r = np.concatenate([rng.uniform(0, 100, (400, 2)), np.full((60, 2), 7.0)]), np.full(460, 0.2)
    r[5] = 500.0
    members, cells = balls.tree(discs(spark, x, r))
    assert compared(cells) < 0.35 * 460 * 459 / 2
    most = members.groupBy("cell", "part").count().agg(F.max("count")).first()[0]
    assert most <= 4 * 8
    assert {(e["src"], e["dst"]) for e in graph.edges(discs(spark, x, r).withColumn("lam", F.col("r") ** 2)).collect()} == plain(x, r)


def test_no_discs(spark):
    empty = discs(spark, np.zeros((1, 2)), [1.0]).limit(0)
    assert graph.edges(empty.withColumn("lam", F.col("r"))).count() == 0


def test_a_member_is_sent_once_for_a_block_that_it_may_meet(spark, monkeypatch):
    monkeypatch.setattr(balls, "LEAF", 8)
    monkeypatch.setattr(balls, "BLOCK", 128)
    x = np.random.default_rng(3).normal(size=(600, 12))
    d = discs(spark, x, np.full(600, 8.0))  # every leaf may meet every other
    members, cells = balls.tree(d)
    pairs = balls.leaf_pairs(cells)
    leaves = cells.where("leaf").count()
    assert pairs.count() == leaves * (leaves + 1) / 2
    blocks = members.select("block").distinct().count()
    rows = balls.tiles(members, pairs)
    assert rows.count() == 600 * blocks and blocks < leaves / 4
    assert rows.select("tile").distinct().count() == blocks * (blocks + 1) / 2
    assert {(e["src"], e["dst"]) for e in graph.edges(d.withColumn("lam", F.col("r") ** 2)).collect()} == plain(x, np.full(600, 8.0))


def test_pairs_of_leaves_are_not_broadcast(spark):
    members, cells = balls.tree(discs(spark, np.random.default_rng(4).normal(size=(600, 3)), np.full(600, 1.0)))
    plan = balls.tiles(members, balls.leaf_pairs(cells))._jdf.queryExecution().executedPlan().toString()
    assert next(w for w in plan.split() if w.endswith("Join")) == "SortMergeJoin"
