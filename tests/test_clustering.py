"""Operators against brute force and hand-made cases."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from clustrel.functions.vectors import disc_relation, gap_pct
from clustrel.operators import assign, balls, columns, discs, graph, heuristics, lp, pricing, solver
from clustrel.sources import points as src


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")


def brute(x, k):
    return min(heuristics.cost_of(x, np.array(lab)) for lab in itertools.product(range(k), repeat=len(x)))


def test_costs_agree(spark):
    rng = np.random.default_rng(0)
    x, lab = rng.normal(size=(30, 3)), rng.integers(0, 4, 30)
    df = frame(spark, x).join(spark.createDataFrame([(i, int(c)) for i, c in enumerate(lab)], "id long, cluster int"), "id")
    want = heuristics.cost_of(x, lab)
    assert assign.cluster_costs(df, 3).agg(F.sum("cost")).first()[0] == pytest.approx(want)
    assert assign.huygens_costs(df).agg(F.sum("cost")).first()[0] == pytest.approx(want)


def test_empty_cluster_keeps_its_centroid(spark):
    df = frame(spark, [[0, 0], [1, 0]])
    cents = spark.createDataFrame([(0, [0.0, 0.0]), (1, [50.0, 50.0])], "cluster int, center array<double>")
    got = {r["cluster"]: (r["center"], r["size"]) for r in assign.lloyd_step(df, cents, 2).collect()}
    assert got == {0: ([0.5, 0.0], 2), 1: ([50.0, 50.0], 0)}


def test_disc_relations(spark):
    rows = spark.createDataFrame([(5.0, 1.0, 1.0), (1.5, 1.0, 1.0), (0.1, 1.0, 3.0), (0.0, 1.0, 1.0)], "d double, a double, b double")
    assert [r[0] for r in rows.select(disc_relation(F.col("d"), F.col("a"), F.col("b"))).collect()] == ["DISJOINT", "INTERSECT", "CONTAINED", "IDENTICAL"]


def test_base_set_holds_the_third_disc(spark):
    d = spark.createDataFrame([(0, 0.0, 0.0, 4.0), (1, 2.0, 0.0, 4.0), (2, 1.0, 0.0, 4.0)], "id long, x double, y double, lam double")
    assert {tuple(r["s_base"]) for r in discs.base_sets(d).where("i = 0 and j = 1").collect()} == {(2,)}


@pytest.mark.parametrize("lam,edges", [(0.0, 0), (1e6, 45)])
def test_graph_extremes(spark, lam, edges):
    df = frame(spark, [[i, i * 0.5] for i in range(10)]).withColumn("lam", F.lit(lam))
    assert graph.edges(df).count() == edges


def test_constraints_on_columns(spark):
    cols = spark.createDataFrame([(0, [0, 1, 4]), (1, [0, 4]), (2, [2, 3, 4])], "col_id long, members array<long>")
    pair = lambda i, j: spark.createDataFrame([(i, j)], "i long, j long")
    assert [r["col_id"] for r in columns.satisfying(cols, pair(0, 1), pair(2, 3)).collect()] == [0]


def test_master_problem_has_consistent_duals():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(7, 2))
    cols = [c for m in range(1, 8) for c in itertools.combinations(range(7), m)]
    cost = np.array([((x[list(c)] - x[list(c)].mean(0)) ** 2).sum() for c in cols])
    member = np.array([[i in c for i in range(7)] for c in cols])
    m = lp.solve(member, cost, 3)
    rc = cost + m.sigma - member @ m.lam
    assert rc.min() > -1e-7 and m.objective <= brute(x, 3) + 1e-7 and m.z.sum() <= 3 + 1e-7
    assert (m.z @ member >= 1 - 1e-7).all() and abs(rc[m.z > 1e-6]).max() < 1e-7
    assert lp.certified_bound(m.lam, 3, float((cost - member @ m.lam).min())) == pytest.approx(m.objective)


def test_pricing_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(10):
        x, lam = rng.normal(size=(8, 2)), rng.uniform(0, 2, 8)
        best = min(((x[list(c)] - x[list(c)].mean(0)) ** 2).sum() - lam[list(c)].sum() for m in range(1, 9) for c in itertools.combinations(range(8), m))
        items = pricing.contract(x, lam, [], [])
        got = min(pricing.search(items, s, later, 10**6)[0] for s, later in enumerate(pricing.neighbourhoods(items)))
        assert got == pytest.approx(best)


def test_pairs_in_one_component_that_must_part_are_infeasible():
    assert pricing.contract(np.zeros((3, 1)), np.zeros(3), [(0, 1), (1, 2)], [(0, 2)]) is None


@pytest.mark.parametrize("seed", [0, 1])
def test_branch_and_bound_equals_brute_force(spark, seed):
    x = np.random.default_rng(seed).normal(size=(8, 2)) * 2
    r = solver.solve(frame(spark, x), 3, 2)
    assert r.cost == pytest.approx(brute(x, 3)) and r.bound <= r.cost + 1e-6 and r.status == "optimal"


def test_same_components_are_closed(spark):
    p = spark.createDataFrame([(5, 3), (3, 9), (1, 2), (9, 7)], "i long, j long")
    assert {r["id"]: r["component"] for r in columns.same_components(p).collect()} == {3: 3, 5: 3, 7: 3, 9: 3, 1: 1, 2: 1}


def test_distributed_and_local_steps_agree(spark):
    x = np.random.default_rng(3).normal(size=(60, 4))
    df = frame(spark, x)
    _, cost = heuristics.kmeans(df, 4)
    assert cost == pytest.approx(heuristics.lloyd(x, x[:4])[0])


def test_passes_over_packed_points_read_no_lists(spark, monkeypatch):
    x = np.random.default_rng(7).normal(size=(50, 3))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "id long, features array<double>").repartition(3)
    monkeypatch.setattr(heuristics, "BLOCK", 10 * 3 * 8)
    blocks = heuristics.packed(df)
    held = np.concatenate([np.frombuffer(r["x"]).reshape(r["n"], 3) for r in blocks.collect()])
    assert sorted(map(tuple, held)) == sorted(map(tuple, x)) and blocks.agg({"n": "max"}).first()[0] <= 10
    blocks.unpersist()
    cents, cost = heuristics.kmeans(df, 4)
    assert cost == pytest.approx(heuristics.lloyd(x, x[:4])[0]) and cents.count() == 4


def test_jump_search_ends_where_no_screened_jump_helps():
    x = np.random.default_rng(0).normal(size=(100, 16))
    cost, labels, c = heuristics.local_search(x, x[:5])
    for _, j, i in heuristics.screen(x, c, labels, 0.05, cost):
        moved = c.copy()
        moved[j] = x[i]
        assert heuristics.lloyd(x, moved)[0] >= cost - 1e-10


def test_kmeans_query_allows_as_many_steps_as_lloyd(spark, monkeypatch):
    from clustrel.plans import catalog

    got = {}
    x = np.random.default_rng(0).normal(size=(12, 64))
    monkeypatch.setattr(catalog, "_points", lambda spark, sf: frame(spark, x))
    monkeypatch.setattr(heuristics, "kmeans", lambda p, k, **more: got.update(more) or (assign.first_k(p, k), 0.0))
    catalog.kmeans_solution(spark, "")
    assert got["most"] >= 300


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1.0,2.5,x\n-3e0,4,y\n\n")
    (tmp_path / "b.tsp").write_text("NAME: b\nNODE_COORD_SECTION\n 1 37.44 -25.40\n 02 3 .5\nEOF\n")
    (tmp_path / "c.txt").write_text("9 1 2\n8  3 4\n")
    rows = lambda df: [(r["id"], r["features"]) for r in df.orderBy("id").collect()]
    assert rows(src.read_csv(spark, str(tmp_path / "a.csv"), [0, 1])) == [(0, [1.0, 2.5]), (1, [-3.0, 4.0])]
    assert rows(src.read_tsplib(spark, str(tmp_path / "b.tsp"))) == [(0, [37.44, -25.4]), (1, [3.0, 0.5])]
    assert rows(src.read_whitespace(spark, str(tmp_path / "c.txt"), [1, 2])) == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]
    assert src.blobs(spark, 10, 3).count() == 9


def test_csv_without_choice_takes_the_numbers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("h1,h2,h3\n1.0, 2.5,x\n-3e0,4,y\n")
    got = src.read_csv(spark, str(tmp_path / "a.csv"), header=True).orderBy("id").collect()
    assert [(r["id"], r["features"]) for r in got] == [(0, [1.0, 2.5]), (1, [-3.0, 4.0])]
    src.write_csv(src.read_csv(spark, str(tmp_path / "a.csv"), header=True), str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["-3.0,4.0", "1.0,2.5"]


@pytest.mark.parametrize("scale,block", [(0.02, 256), (0.3, 7), (3.0, 5)])
def test_edges_equal_all_pairs(spark, monkeypatch, scale, block):
    monkeypatch.setattr(balls, "LEAF", block)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(60, 3)), rng.normal(size=(20, 3)) + 50])
    lam = rng.uniform(0, scale, 80)
    df = spark.createDataFrame([(i, [float(v) for v in r], float(w)) for i, (r, w) in enumerate(zip(x, lam, strict=True))], "id long, features array<double>, lam double")
    d, r = np.sqrt(((x[:, None] - x) ** 2).sum(-1)), np.sqrt(lam)
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if d[i, j] <= r[i] + r[j] + 1e-10}
    got = [(e["src"], e["dst"]) for e in graph.edges(df, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert graph.edges(df.limit(0), 3).count() == 0


def test_pair_costs_keep_their_digits_far_from_the_origin(spark):
    rng = np.random.default_rng(0)
    x, lab = rng.normal(size=(40, 2)) + 1e7, rng.integers(0, 3, 40)
    df = frame(spark, x).join(spark.createDataFrame([(i, int(c)) for i, c in enumerate(lab)], "id long, cluster int"), "id")
    assert assign.huygens_costs(df).agg(F.sum("cost")).first()[0] == pytest.approx(heuristics.cost_of(x, lab), rel=1e-6)


def test_quick_pricing_finds_real_sets():
    rng = np.random.default_rng(4)
    x, lam = rng.normal(size=(9, 2)), rng.uniform(0, 2, 9)
    items = pricing.contract(x, lam, [(0, 1)], [(2, 3)])
    for r in pricing.quick(items).itertuples():
        m = r.members
        assert r.value == pytest.approx(((x[m] - x[m].mean(0)) ** 2).sum() - lam[m].sum())
        assert (0 in m) == (1 in m) and not (2 in m and 3 in m)


def test_root_bound_is_below_the_best_cost(spark):
    x = np.random.default_rng(5).normal(size=(8, 2)) * 2
    best = brute(x, 3)
    root = solver.root_bound(spark, x, 3, np.arange(8) % 3)
    assert root.closed and root.bound <= best + 1e-6 and root.bound == pytest.approx(root.objective, abs=1e-5)


def test_command_line_writes_the_whole_result(spark, tmp_path):
    import json

    from clustrel import cli

    (tmp_path / "a.csv").write_text("0,0\n0,1\n9,9\n9,8\n")
    assert cli.main(["--data", str(tmp_path / "a.csv"), "--k", "2", "--output", str(tmp_path / "r.json"), "--quiet"]) == 0
    got = json.loads((tmp_path / "r.json").read_text())
    assert got["labels"] == [0, 0, 1, 1] and got["status"] == "optimal" and got["cost"] == pytest.approx(1.0) == pytest.approx(got["bound"])


def test_gap(spark):
    assert spark.range(1).select(gap_pct(F.lit(4.0), F.lit(3.0))).first()[0] == 25.0


def test_sweep_finds_separated_clouds(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(12, 2)) * 0.2 + c for c in ((0, 0), (9, 0), (0, 9))])
    known = {3: heuristics.cost_of(x, np.repeat(range(3), 12))}
    from clustrel.operators.validate import k_sweep, summary

    s = summary(k_sweep(frame(spark, x), known, restarts=4)).first()
    assert (s["n"], s["worse"]) == (1, 0) and abs(s["max_gap_pct"]) < 1e-6


def test_stream_scoring(spark, tmp_path):
    from clustrel.streaming.scoring import assign_stream

    df = frame(spark, [[0, 0], [9, 9], [1, 0]])
    df.write.parquet(str(tmp_path / "in"))
    cents = spark.createDataFrame([(0, [0.0, 0.0]), (1, [9.0, 9.0])], "cluster int, center array<double>")
    stream = assign_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), cents, 2)
    q = stream.writeStream.format("memory").queryName("scored").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["id"], r["cluster"]) for r in spark.sql("select * from scored").collect()} == {(0, 0), (1, 1), (2, 0)}


def test_jumps_in_batches_equal_jumps_one_by_one(monkeypatch):
    x = np.random.default_rng(1).normal(size=(40, 3)) + 50
    cost, labels, c = heuristics.lloyd(x, x[:4])
    whole = heuristics.screen(x, c, labels, 0.5, cost, 2)
    monkeypatch.setattr(heuristics, "BATCH_VALUES", 40 * 4 * 7)
    parts = heuristics.screen(x, c, labels, 0.5, cost, 2)
    assert [r[1:] for r in whole] == [r[1:] for r in parts] and len(whole) > 10
    for e, j, i in whole[::5]:
        moved = c.copy()
        moved[j] = x[i]
        assert e == pytest.approx(heuristics.lloyd(x, moved, 2)[0])
    done, found, _ = heuristics.local_search(x, x[:4])
    assert done == pytest.approx(heuristics.cost_of(x, found)) and done <= cost
    assert heuristics.local_search(np.ones((5, 2)), np.ones((2, 2)))[0] == 0
    assert heuristics.local_search(x, x[:1])[0] == pytest.approx(((x - x.mean(0)) ** 2).sum())


@pytest.mark.parametrize("fringe", [1, 3, 6])
def test_pricing_by_boxes_equals_all_subsets(spark, monkeypatch, fringe):
    from clustrel.operators import boxes

    monkeypatch.setattr(boxes, "FRINGE", fringe)
    rng = np.random.default_rng(fringe)
    for t in range(8):
        x, lam = rng.normal(size=(8, 1 + t % 4)), rng.uniform(0, 2.5, 8)
        same, diff = [(0, 1)] if t % 3 == 1 else [], [(2, 3), (4, 5), (3, 4)] if t % 2 else []
        ok = lambda s: all((i in s) == (j in s) for i, j in same) and not any(i in s and j in s for i, j in diff)  # noqa: B023, E731
        best = min(((x[list(c)] - x[list(c)].mean(0)) ** 2).sum() - lam[list(c)].sum() for m in range(1, 9) for c in itertools.combinations(range(8), m) if ok(c))
        got = boxes.price(spark, pricing.contract(x, lam, same, diff))
        assert got["exact"].all() and got["value"].min() == pytest.approx(best) and best - 1e-6 < got["bound"].min() <= best + 1e-9
        for r in got.itertuples():
            assert ok(r.members) and r.value == pytest.approx(((x[r.members] - x[r.members].mean(0)) ** 2).sum() - lam[r.members].sum())


def test_boxes_dealt_to_tasks_and_boxes_left_open(spark):
    from clustrel.operators import boxes

    rng = np.random.default_rng(9)
    items = pricing.contract(rng.normal(size=(60, 3)), rng.uniform(0.2, 1.5, 60), [], [])
    whole, dealt = boxes.price(spark, items), boxes.price(spark, items, limit=1)
    assert whole["exact"].all() and dealt["value"].min() >= whole["bound"].min()
    assert dealt["bound"].min() <= whole["value"].min()
    none = boxes.price(spark, pricing.contract(np.zeros((3, 2)), np.zeros(3), [], []))
    assert none["value"].min() == 0 and none["exact"].all()


def test_branch_and_bound_closes_on_more_points(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(15, 2)) + c for c in ((0, 0), (4, 0), (0, 4))])
    r = solver.solve(frame(spark, x), 3, 2)
    assert r.status == "optimal" and r.gap_pct < 1e-3


def test_duals_kept_in_a_box():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6, 2))
    cols = [c for m in range(1, 7) for c in itertools.combinations(range(6), m)]
    cost = np.array([((x[list(c)] - x[list(c)].mean(0)) ** 2).sum() for c in cols])
    member = np.array([[i in c for i in range(6)] for c in cols])
    free = lp.solve(member, cost, 2)
    wide = lp.solve(member, cost, 2, lower=np.maximum(free.lam - 0.1, 0), upper=free.lam + 0.1)
    assert wide.objective == pytest.approx(free.objective)
    tight = lp.solve(member, cost, 2, lower=free.lam + 0.5, upper=free.lam + 0.7)
    assert (tight.lam >= free.lam + 0.5 - 1e-9).all() and (tight.lam <= free.lam + 0.7 + 1e-9).all()
    least = float((cost - member @ tight.lam).min())
    assert tight.objective == pytest.approx(lp.certified_bound(tight.lam, 2, least)) and tight.objective < free.objective


def test_the_proof_does_not_depend_on_the_unit_of_the_points(spark):
    """Costs far below the tolerances: the one start given is not the best partition."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(9, 3)) * 1e-4
    best = min(heuristics.cost_of(x, np.array(t)) for t in itertools.product(range(3), repeat=9))
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, features array<double>")
    poor = next(s for s in range(100) if heuristics.lloyd(x, heuristics.seeds(x, 3, np.random.default_rng(s)))[0] > 1.02 * best)
    found = solver.solve(df, 3, 1, seed=poor, jumps=False)
    assert found.cost == pytest.approx(best, rel=1e-9, abs=0) and found.bound == pytest.approx(best, rel=1e-4, abs=0) and found.status == "optimal"
