"""Cluster columns: members, costs, reduced costs, branching constraints and fractional solutions.

Columns are (col_id, members ARRAY<LONG>, cost), with z where a solution is meant. Constraints are pairs (i, j).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustrel.operators.assign import cluster_costs
from clustrel.shared import drop, kept

EPS = 1e-4
#: Members of columns that a task holds while it settles which of them greedy takes.
HELD = 1 << 18
#: Members of a block of a class, and pairs of members that a task makes.
BLOCK, PAIRS = 512, 1 << 22


def from_assignment(labelled: DataFrame, dim: int | None = None) -> DataFrame:
    """cluster, members, cost: one column per cluster that has points, equal ones once."""
    sets = labelled.groupBy("cluster").agg(F.sort_array(F.collect_list("id")).alias("members"))
    return sets.join(cluster_costs(labelled, dim).select("cluster", "cost"), "cluster").dropDuplicates(["members"])


def reduced_costs(cols: DataFrame, duals: DataFrame, sigma: float = 0.0) -> DataFrame:
    """col_id, rc: cost + sigma less the members' duals(id, lam)."""
    lam = cols.select("col_id", F.explode("members").alias("id")).join(duals, "id").groupBy("col_id").agg(F.sum("lam").alias("lam"))
    return cols.join(lam, "col_id", "left").select("col_id", (F.col("cost") + sigma - F.coalesce("lam", F.lit(0.0))).alias("rc"))


def satisfying(cols: DataFrame, same: DataFrame, diff: DataFrame) -> DataFrame:
    """The columns that hold both or neither of each same pair, and not both of any diff pair."""
    has = cols.select("col_id", F.explode("members").alias("id"))

    def held(pairs: DataFrame) -> DataFrame:
        ends = pairs.select("i", "j", F.explode(F.array("i", "j")).alias("id"))
        return has.join(ends, "id").groupBy("col_id", "i", "j").agg(F.count(F.lit(1)).alias("n"))

    bad = held(same).where("n = 1").select("col_id").unionByName(held(diff).where("n = 2").select("col_id")).distinct()
    return cols.join(bad, "col_id", "left_anti")


def cooccurrence(cols: DataFrame) -> DataFrame:
    """a < b, frac: the summed z of the columns that hold both. As many rows as pairs within columns; ``branching_pair`` goes without them.

    Members that lie in the same columns are one class, and frac is summed up by pairs of classes. Classes are cut into
    blocks of about BLOCK members, and pairs of members come from pairs of blocks: they are neither shuffled nor added up.
    """
    held = cols.where("z > 0").select("col_id", "z", F.explode(F.array_distinct("members")).alias("id"))
    sign = kept(held.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("col_id", "z"))).alias("cols")))  # as many as there are columns over a member
    first = kept(sign.groupBy("cols").agg(F.min("id").alias("least"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")))
    at = first.select("least", F.explode("cols").alias("c")).select("least", F.col("c.col_id").alias("col_id"), F.col("c.z").alias("z"))
    one, two = (at.select(F.col("least").alias(s), "col_id", *z) for s, z in (("ca", ["z"]), ("cb", [])))
    pairs = one.join(two, "col_id").where("ca <= cb").groupBy("ca", "cb").agg(F.sum("z").alias("frac"))
    blocks = kept(sign.join(first, "cols").groupBy("least", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")).agg(F.collect_list("id").alias("ids")))  # about BLOCK
    side = lambda s: blocks.select(F.col("least").alias("c" + s), F.col("part").alias("p" + s), F.col("ids").alias("i" + s))
    tiles = kept(pairs.join(side("a"), "ca").join(side("b"), "cb").where("ca < cb or pa <= pb"))
    n = tiles.agg(F.sum(F.size("ia").cast("long") * F.size("ib"))).first()[0] or 0
    parts = max(cols.sparkSession.sparkContext.defaultParallelism, -(-n // PAIRS))
    each = tiles.repartition(parts, "ca", "pa", "cb", "pb").select("frac", "ib", F.expr("ca = cb and pa = pb").alias("own"), F.explode("ia").alias("x"))
    each = each.select("frac", "own", "x", F.explode("ib").alias("y")).where("not own or x < y")
    return each.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "frac")


def member_classes(cols: DataFrame) -> DataFrame:
    """cols, least, next of the members of columns of positive z that lie in the same of them: the least member, and the next where there is one."""
    held = cols.where("z > 0").select("col_id", F.explode(F.array_distinct("members")).alias("id"))
    sign = kept(held.groupBy("id").agg(F.sort_array(F.collect_list("col_id")).alias("cols")))  # as many as there are columns over a member
    first = sign.groupBy("cols").agg(F.min("id").alias("least"))
    second = sign.join(first, "cols").where("id > least").groupBy("cols").agg(F.min("id").alias("next"))
    return first.join(second, "cols", "left").select("cols", "least", "next")


def branching_pair(cols: DataFrame) -> DataFrame:
    """a, b, frac of the pair whose frac is nearest to a half, if any is fractional; ties go by the pair.

    Members that lie in the same columns are one class, so pairs are those of classes, not of members: two classes
    give the pair of their least members, and a class by itself that of its two least.
    """
    classes = kept(member_classes(cols))
    z = cols.where("z > 0").select("col_id", "z")
    at = classes.select("least", F.explode("cols").alias("col_id"))
    two = at.select(F.col("least").alias("b"), "col_id")
    apart = at.select(F.col("least").alias("a"), "col_id").join(two, "col_id").where("a < b").join(z, "col_id").groupBy("a", "b").agg(F.sum("z").alias("frac"))
    within = classes.where("next is not null").select(F.col("least").alias("a"), F.col("next").alias("b"), F.explode("cols").alias("col_id")).join(z, "col_id").groupBy("a", "b").agg(F.sum("z").alias("frac"))
    frac = apart.unionByName(within).where((F.col("frac") > EPS) & (F.col("frac") < 1 - EPS))
    return frac.agg(F.min(F.struct(F.round(F.abs(F.col("frac") - 0.5), 9).alias("off"), "a", "b", "frac")).alias("p")).where("p is not null").select("p.a", "p.b", "p.frac")


def integral(cols: DataFrame) -> DataFrame:
    """is_integral, n_fractional, in one row."""
    off = (F.col("z") > EPS) & (F.col("z") < 1 - EPS)
    return cols.agg((F.count_if(off) == 0).alias("is_integral"), F.count_if(off).alias("n_fractional"))


def labels(cols: DataFrame) -> DataFrame:
    """id, cluster: each member's first column of z near 1, numbered from 0 by least member."""
    taken = cols.where(F.col("z") > 1 - EPS).select("col_id", F.explode("members").alias("id")).groupBy("id").agg(F.min("col_id").alias("col_id"))
    order = taken.groupBy("col_id").agg(F.min("id").alias("least"))
    dense = order.withColumn("cluster", F.expr("dense_rank() over (order by least) - 1"))  # one row per chosen column
    return taken.join(dense, "col_id").select("id", "cluster")


def qp_coefficients(nodes: DataFrame, by: str, dim: int | None = None) -> DataFrame:
    """group, i, j, q: d2 less both duals, for the pairs of nodes(id, features, lam, group) of a group of bounded size."""
    from clustrel.functions.vectors import sq_dist

    side = lambda s: nodes.select(F.col(by).alias("grp"), F.col("id").alias(s), F.col("features").alias("f" + s), F.col("lam").alias("l" + s))
    x = side("i").join(side("j"), "grp").where("i < j")
    return x.select("grp", "i", "j", (sq_dist(F.col("fi"), F.col("fj"), dim) - F.col("li") - F.col("lj")).alias("q"))


def best_subset(nodes: DataFrame, by: str, dim: int | None = None) -> DataFrame:
    """grp, mask, size, ratio: of each group of at most a dozen nodes, the subset of least (q within + linear) / size, by all masks.

    nodes must number their group's members from 0 in ``pos``.
    """
    ids = nodes.select(F.col(by).alias("grp"), "pos", "lam")
    top = ids.groupBy("grp").agg(F.count(F.lit(1)).alias("m"))
    masks = top.select("grp", F.explode(F.sequence(F.lit(1), F.expr("shiftleft(1, int(m)) - 1"))).alias("mask"))
    bit = lambda c: F.expr(f"shiftright(mask, int({c})) & 1") == 1
    lin = masks.join(ids, "grp").where(bit("pos")).groupBy("grp", "mask").agg(F.sum(-F.col("lam")).alias("lin"), F.count(F.lit(1)).alias("size"))
    pos = nodes.select(F.col(by).alias("grp"), F.col("id"), "pos")
    q = qp_coefficients(nodes, by, dim).join(pos.select("grp", F.col("id").alias("i"), F.col("pos").alias("pi")), ["grp", "i"]).join(pos.select("grp", F.col("id").alias("j"), F.col("pos").alias("pj")), ["grp", "j"])
    quad = masks.join(q, "grp").where(bit("pi") & bit("pj")).groupBy("grp", "mask").agg(F.sum("q").alias("quad"))
    all_ = lin.join(quad, ["grp", "mask"], "left").withColumn("ratio", (F.coalesce("quad", F.lit(0.0)) + F.col("lin")) / F.col("size"))
    return all_.groupBy("grp").agg(F.min(F.struct(F.round("ratio", 9).alias("ratio"), "mask", "size")).alias("b")).select("grp", "b.mask", "b.size", "b.ratio")


def same_components(pairs: DataFrame) -> DataFrame:
    """id, component: the closure of same pairs(i, j); a component bears its least id.

    Each round every id takes the least label among its own and its neighbours', and then that label's own
    label, until none changes; so labels travel twice as far in every round.
    """
    arcs = kept(pairs.select("i", "j").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct())
    lab = kept(arcs.select(F.col("i").alias("id")).distinct().withColumn("component", F.col("id")))
    while True:
        near = arcs.join(lab.select(F.col("id").alias("j"), F.col("component").alias("c")), "j").groupBy(F.col("i").alias("id")).agg(F.min("c").alias("c"))
        low = kept(lab.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "c").alias("up")))
        jump = low.select(F.col("id").alias("up"), F.col("up").alias("top"))
        new = kept(low.join(jump, "up").select("id", F.least("up", "top").alias("component"), (F.least("up", "top") < F.col("was")).alias("moved")))
        drop(low)
        lab = new.select("id", "component")
        if new.where("moved").isEmpty():
            return lab


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (block, col_id, id, outer, took, top) in order of block and col_id: col_id, at, taken of the columns that can be settled.

    A column waits while a lesser one at one of its ids does, here or in another block. If one of them was taken it goes out
    with the first such (round ``at``), else it is taken in the round after the last of them went out.
    """
    name, held = None, []
    took, top, stuck, out = {}, {}, set(), []

    def settle() -> None:
        if any(outer or i in stuck for i, outer, _, _ in held):
            stuck.update(i for i, *_ in held)
            return
        before = [x for i, _, was, _ in held if (x := took.get(i, was)) is not None]
        at = min(before) if before else 1 + max(-1 if (x := top.get(i, last)) is None else x for i, _, _, last in held)
        out.append((name[1], at, not before))
        for i, _, _, last in held:
            top[i] = max(at, top.get(i, -1 if last is None else last))
            if not before:
                took[i] = at

    def rows() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.bool_())
        batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["col_id", "at", "taken"])
        out.clear()
        return batch

    for b in batches:
        for block, col, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (block, col) != name:
                if held:
                    settle()
                if name is not None and block != name[0]:
                    took, top, stuck = {}, {}, set()
                name, held = (block, col), []
            held.append(row)
        yield rows()
    if held:
        settle()
    yield rows()


def _level(bucket: DataFrame, gain: int) -> DataFrame:
    """col_id, at of the columns that greedy takes of bucket(col_id, id), whose columns all have the same gain; ``at`` is the round.

    Columns in order are cut into blocks of about HELD rows, which tasks settle as far as they can; a pass follows
    for what waited for another block, so there are about as many passes as a chain of overlapping columns meets blocks.
    """
    cols = bucket.select("col_id").distinct()
    blocks = -(-cols.count() * gain // HELD)
    cuts = cols.approxQuantile("col_id", [k / blocks for k in range(1, blocks)], 0.1 / blocks) if blocks > 1 else []
    left = bucket.withColumn("block", F.size(F.filter(F.array(*(F.lit(int(c)) for c in cuts)).cast("array<long>"), lambda c: c < F.col("col_id"))))
    done = None
    while True:
        low = left.groupBy("id").agg(F.min("block").alias("low"))
        state = bucket.limit(0).select("id", F.lit(0).cast("long").alias("took"), F.lit(0).cast("long").alias("top")) if done is None else bucket.join(done, "col_id").groupBy("id").agg(F.min(F.when(F.col("taken"), F.col("at"))).alias("took"), F.max("at").alias("top"))
        rows = left.join(low, "id").join(state, "id", "left").select("block", "col_id", "id", (F.col("low") < F.col("block")).alias("outer"), "took", "top")
        new = kept(rows.repartition("block").sortWithinPartitions("block", "col_id").mapInArrow(_settled, "col_id long, at long, taken boolean"))
        done = new if done is None else done.unionByName(new)
        if blocks <= 1:
            break
        left = kept(left.join(new.select("col_id"), "col_id", "left_anti"))
        if left.isEmpty():
            break
    return done.where("taken").select("col_id", "at")


def coverage_patch(cols: DataFrame, ids: DataFrame, chosen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """patch(col_id, step, gain) and uncovered(id): the columns that a greedy cover of ids(id) adds to the chosen ones(col_id), and the ids that no column holds.

    The column with most ids still uncovered comes first, ties by col_id. A step takes of the columns of the
    greatest gain all that have the least col_id, of those columns, at each of their uncovered ids: these keep out of
    each other's way, and of the way of any that greedy would take before them, so the cover is the greedy one. Columns of one step have no id in common.
    All steps of a gain are worked out together (``_level``), but for columns too large for a task to hold.
    """
    has = cols.select("col_id", F.explode("members").alias("id")).distinct().join(ids.select("id").distinct(), "id", "left_semi")
    if chosen is not None:
        held = has.join(chosen.select("col_id"), "col_id", "left_semi").select("id").distinct()
        has = has.join(held, "id", "left_anti")
        ids = ids.join(held, "id", "left_anti")
    empty = cols.sparkSession.createDataFrame([], "id long")
    left, patch, step = kept(has.select("col_id", "id")), cols.limit(0).select("col_id", F.lit(0).cast("long").alias("step"), F.lit(0).cast("long").alias("gain")), 0
    while True:
        gains = kept(left.groupBy("col_id").agg(F.count(F.lit(1)).alias("gain")))
        most = gains.agg(F.max("gain")).first()[0]
        if most is None:
            break
        bucket = kept(left.join(gains.where(F.col("gain") == most).select("col_id"), "col_id", "left_semi").select("col_id", "id"))
        if most > HELD:
            first = bucket.groupBy("id").agg(F.min("col_id").alias("col_id")).groupBy("col_id").agg(F.count(F.lit(1)).alias("n"))
            found = first.where(F.col("n") == most).select("col_id", F.lit(0).cast("long").alias("at"))
        else:
            found = _level(bucket, most)
        taken = kept(found.select("col_id", (F.col("at") + step).alias("step"), F.lit(int(most)).cast("long").alias("gain")))
        patch = patch.unionByName(taken)
        done = left.join(taken.select("col_id"), "col_id", "left_semi").select("id").distinct()
        old, left, step = left, kept(left.join(done, "id", "left_anti").select("col_id", "id")), taken.agg(F.max("step")).first()[0] + 1
        for table in (old, gains, bucket):
            drop(table)
    every = cols.select(F.explode("members").alias("id")).distinct()
    return patch.withColumn("step", F.col("step").cast("int")), ids.select("id").distinct().join(every, "id", "left_anti").unionByName(empty)


def column_pairs(cols: DataFrame) -> DataFrame:
    """t1 < t2, common, i1, score of the fractional columns that share members and of which the first has one of its own: i1 is their first common member, score tells how near both z are to a half.

    Columns meet only by a member that they share, through an index from members to columns.
    """
    held = cols.where((F.col("z") > EPS) & (F.col("z") < 1 - EPS)).select("col_id", "z", F.size(F.array_distinct("members")).alias("n"), F.explode(F.array_distinct("members")).alias("id"))
    one = held.select("id", F.col("col_id").alias("t1"), F.col("z").alias("z1"), "n")
    two = held.select("id", F.col("col_id").alias("t2"), F.col("z").alias("z2"))
    met = one.join(two, "id").where("t1 < t2").groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("common"), F.min("id").alias("i1"), F.first("n").alias("n"), F.first("z1").alias("z1"), F.first("z2").alias("z2"))
    score = 1 - F.abs(F.col("z1") - 0.5) - F.abs(F.col("z2") - 0.5)
    return met.where("common < n").select("t1", "t2", "common", "i1", score.alias("score"))


def column_branching_pair(cols: DataFrame) -> DataFrame:
    """t1, t2, i1, i2, score of the overlapping columns whose z are nearest to a half, ties by t1 and t2: i1 is in both, i2, the first such, in t1 alone. No row where no two columns overlap so."""
    order = F.struct((-F.round("score", 9)).alias("s"), "t1", "t2")
    best = kept(column_pairs(cols).agg(F.min_by(F.struct("t1", "t2", "i1", "score"), order).alias("b")).where("b is not null").select("b.*"))
    has = cols.select("col_id", F.explode("members").alias("id"))
    one = has.join(best.select(F.col("t1").alias("col_id")), "col_id", "left_semi").select("id")
    two = has.join(best.select(F.col("t2").alias("col_id")), "col_id", "left_semi").select("id")
    private = one.join(two, "id", "left_anti").agg(F.min("id").alias("i2"))  # one row
    return best.crossJoin(private).select("t1", "t2", "i1", "i2", "score")
