"""The subset of each group whose ratio is least, by a fractional 0-1 iteration over all groups at once.

Nodes are (id, features, lam) with a group. The numerator of a set is the sum over its pairs of d2 less both duals,
less the sum of its duals; the denominator is its size. By Huygens the ratio is the sum of squared distances to
the set's mean less its duals. For a group of q so far, a set is better where numerator - q * size is below 0.

Groups of at most ``most`` nodes carry all their sets (as masks) and solve that problem exactly, so their q ends
at the best ratio. In larger groups the next set is made up of the nodes whose disc, of squared radius lam,
holds the mean of the set before, which never raises the ratio; they start from the whole group and from
the nodes of largest dual. In every round all groups advance; those whose q stands still leave, the others are stored and go on.
No group is held by a task: nodes meet the state of their group in a join, and sums are added up by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clustrel.operators.jumps import SUMS, _added, _lists, _matrix
from clustrel.shared import drop, kept

TOL = 1e-9


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """grp, q, mask of rows (grp, q, xs, lams) of small groups: the set of least numerator - q * size, and its ratio; q again where no set is below 0."""
    for b in batches:
        out = []
        for grp, q, xs, lams in zip(*(b.column(c).to_pylist() for c in ("key", "q", "xs", "lams")), strict=True):
            x, lam = np.array(xs, float), np.array(lams)
            x = x - x.mean(0)
            sets = (np.arange(1, 1 << len(lam))[:, None] >> np.arange(len(lam)) & 1).astype(float)
            size, sums = sets.sum(1), sets @ x
            ratio = sets @ (x * x).sum(1) - (sums * sums).sum(1) / size - sets @ lam
            value = np.round(size * (ratio - q), 9)  # of equal ones the first
            at = int(value.argmin())
            out.append((grp, float(ratio[at]), at + 1) if value[at] < 0 else (grp, q, -1))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.float64()), pa.array([r[2] for r in out], pa.int64())], ["key", "q", "mask"])


def _small(groups: DataFrame, rounds: int) -> DataFrame:
    """key, q, members, steps of groups(key, ids, xs, lams), from the set of the first node."""
    state = kept(groups.withColumns({"q": -F.get("lams", F.lit(0)), "mask": F.lit(1).cast("long"), "steps": F.lit(0)}))
    ended = None
    while True:
        new = state.select("key", "q", "xs", "lams").mapInArrow(_masked, "key long, q double, mask long").withColumnsRenamed({"q": "now", "mask": "found"})
        state_ = kept(state.join(new, "key").withColumn("still", (F.col("found") < 0) | (F.col("steps") + 1 >= rounds)))
        mask = F.when(F.col("found") < 0, F.col("mask")).otherwise(F.col("found"))
        out = state_.where("still").select("key", F.col("now").alias("q"), F.filter("ids", lambda _, i: F.get(F.split(F.reverse(F.bin(mask)), ""), i) == "1").alias("members"), F.col("steps"))
        ended = ended.unionByName(out) if ended else out
        drop(state)
        if state_.where("not still").isEmpty():
            return ended
        state = kept(state_.where("not still").select("key", "ids", "xs", "lams", F.col("now").alias("q"), F.col("found").alias("mask"), (F.col("steps") + 1).alias("steps")))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, stats of rows (key, x, lam, c): count, duals, and squares and sums from c, of each batch and key."""
    for b in batches:
        if b.num_rows:
            y = _matrix(b.column("x")) - _matrix(b.column("c"))
            lam, keys = b.column("lam").to_numpy(), b.column("key").to_numpy()
            order = np.argsort(keys, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
            rows = np.concatenate([np.ones((len(y), 1)), lam[:, None], (y * y).sum(1)[:, None], y], axis=1)[order]
            yield pa.RecordBatch.from_arrays([pa.array(keys[order][first]), _lists(np.add.reduceat(rows, first, axis=0))], ["key", "stats"])


def _measured(rows: DataFrame) -> DataFrame:
    """no, ratio, mean of the sets in rows(no, x, lam, c), c any point near each."""
    stats = rows.select(F.col("no").alias("key"), "x", "lam", "c").mapInArrow(_sums, SUMS)
    stats = stats.repartition("key").sortWithinPartitions("key").mapInArrow(_added, SUMS)
    n, lam, squares = (F.get("stats", F.lit(k)) for k in range(3))
    off = F.transform(F.slice("stats", F.lit(4), F.size("stats")), lambda v: v / n)
    return stats.select(F.col("key").alias("no"), (squares - n * F.aggregate(off, F.lit(0.0), lambda a, v: a + v * v) - lam).alias("ratio"), off.alias("off"))


def _d2(x: str, c: str) -> Column:
    return F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def _shifted(c: str, off: str) -> Column:
    return F.zip_with(c, off, lambda a, b: a + b)


def _large(nodes: DataFrame, rounds: int, starts: int) -> DataFrame:
    """key, q, only, made, steps of nodes(key, id, x, lam): of each group the best set at a standstill, that of all nodes whose disc holds ``made``, or before the first step the group or the node ``only``."""
    top = nodes.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("lam"), "id"))).where(F.col("r") <= starts)
    single = top.select("key", F.col("r").alias("start"), F.col("id").alias("only"), F.col("x").alias("mean"), (-F.col("lam")).alias("q"))
    origin = nodes.groupBy("key").agg(F.min_by("x", "id").alias("c"))
    origin = kept(origin.withColumn("no", F.monotonically_increasing_id()))
    whole = origin.join(_measured(nodes.join(origin, "key")), "no")
    whole = whole.select("key", F.lit(0).alias("start"), F.lit(None).cast("long").alias("only"), _shifted("c", "off").alias("mean"), F.col("ratio").alias("q"))
    none = F.lit(None).cast("array<double>")
    state = kept(whole.unionByName(single).withColumns({"no": F.monotonically_increasing_id(), "made": none, "steps": F.lit(0)}))
    ended = None
    for round_ in range(rounds):
        rows = nodes.join(state.select("key", "no", F.col("mean").alias("c")), "key").where(_d2("x", "c") < F.col("lam"))
        got = state.join(_measured(rows), "no", "left")
        better = F.coalesce(F.col("ratio") < F.col("q") - TOL, F.lit(False)) & F.lit(round_ + 1 < rounds)
        got = kept(got.withColumn("better", better))
        out = got.where("not better").select("key", "start", "q", "only", "made", "steps")
        ended = ended.unionByName(out) if ended else out
        old = state
        state = kept(got.where("better").select("key", "start", "only", F.col("mean").alias("made"), _shifted("mean", "off").alias("mean"), F.col("ratio").alias("q"), "no", (F.col("steps") + 1).alias("steps")))
        drop(old)
        if state.isEmpty():
            break
    best = ended.groupBy("key").agg(F.min_by(F.struct("q", "only", "made", "steps"), F.struct(F.round("q", 9), "start")).alias("b"))
    return best.select("key", "b.*")


def best_ratios(nodes: DataFrame, by: str, most: int = 12, rounds: int = 50, starts: int = 3) -> tuple[DataFrame, DataFrame]:
    """groups(grp, n, size, ratio, steps, exact) and members(grp, id) of the best subset found of each group of nodes(id, features, lam, by).

    Exact for groups of at most ``most`` nodes; of equal ratios the set of the least mask over ascending ids. In
    larger groups no single step from the sets found leads to a better one. Nodes without a group are left out; no nodes give no groups.
    """
    nodes = kept(nodes.select(F.col(by).alias("grp"), F.col("id").cast("long").alias("id"), F.col("features").alias("x"), F.col("lam").cast("double").alias("lam")).where("grp is not null"))
    groups = kept(nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.monotonically_increasing_id()))
    known = kept(nodes.join(groups, "grp"))
    few = known.where(F.col("n") <= most).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("id", "x", "lam"))).alias("r"))  # at most `most` of a group
    few = _small(few.select("key", F.transform("r", lambda v: v["id"]).alias("ids"), F.transform("r", lambda v: v["x"]).alias("xs"), F.transform("r", lambda v: v["lam"]).alias("lams")), rounds)
    many = kept(_large(known.where(F.col("n") > most), rounds, starts))
    chosen = known.join(many, "key").where(F.when(F.col("made").isNotNull(), _d2("x", "made") < F.col("lam")).otherwise(F.col("only").isNull() | (F.col("only") == F.col("id"))))
    members = kept(chosen.select("key", "id").unionByName(few.select("key", F.explode("members").alias("id"))))
    size = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    ends = many.select("key", "q", "steps", F.lit(False).alias("exact")).unionByName(few.select("key", "q", "steps", F.lit(True).alias("exact")))
    out = groups.join(ends, "key").join(size, "key").select("grp", "n", "size", F.col("q").alias("ratio"), "steps", "exact")
    return out, members.join(groups, "key").select("grp", "id")
