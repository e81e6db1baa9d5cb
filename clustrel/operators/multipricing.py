"""Pricing of many columns at once: a group per seed, pruned by its duals before its rows move.

``searched`` does so in tasks that get all nodes, for groups that discs make by meeting; ``priced`` takes any groups from tables:
nodes are (id, features, lam); later(id, later) gives each seed's neighbours that come after it in some order, so
every set of use lies in one group. Only groups whose duals could bring the reduced cost below the limit get
the rows of their own neighbours, and are searched one by one in tasks; groups with more rows than a task should hold go
through the fractional iteration instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustrel.functions.vectors import radius, sq_dist
from clustrel.operators import fractional, near, pricing
from clustrel.operators.columns import same_components
from clustrel.shared import kept

#: Rows of a group that is searched in one task.
MOST = 4096
EPS = 1e-6


def _searched(limit: int):
    def run(rows: pa.Table) -> pa.Table:
        ids, seed = rows.column("id").to_numpy(), rows.column("seed")[0].as_py()
        rows = rows.take(np.argsort(ids))
        ids = np.sort(ids)
        x = np.array(rows.column("features").combine_chunks().flatten()).reshape(len(ids), -1)
        weight, inner, lam = (rows.column(c).to_numpy() for c in ("weight", "inner", "lam"))
        place = {int(i): k for k, i in enumerate(ids)}
        apart = {(min(k, place[o]), max(k, place[o])) for k, foes in enumerate(rows.column("foes").to_pylist()) for o in foes or () if o in place}
        own = pricing.Items(weight, x, inner, lam, apart, [[i] for i in range(len(ids))])
        at = place[seed]
        value, chosen, bound, exact = pricing.search(own, at, np.delete(np.arange(len(ids)), at), limit)
        return pa.table({"seed": [seed], "members": pa.array([sorted(ids[chosen].tolist())], pa.list_(pa.int64())), "value": [value], "bound": [bound], "exact": [exact]})

    return run


def contracted(points: DataFrame, same: DataFrame, diff: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes(id, features, lam, weight, inner), apart(i, j) and members(id, member) under branching constraints.

    Points (id, features, lam) that must stay together, same(i, j) at any remove, are one node under their least id: their mean, their number,
    their cost around it, and their summed duals. apart has the pairs of nodes that diff(i, j) parts; a pair within one node raises, as no set can hold it.
    """
    home = same_components(same).withColumnRenamed("id", "member")
    named = kept(points.join(home, points["id"] == F.col("member"), "left").select(points["id"].alias("member"), F.coalesce("component", points["id"]).alias("id"), "features", "lam"))
    long = named.select("id", F.posexplode("features").alias("dim", "v")).groupBy("id", "dim").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))
    mean = long.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("dim", "v"))).alias("m"), F.max("n").alias("n"))
    mean = mean.select("id", F.transform("m", lambda s: s["v"]).alias("mean"), F.col("n").cast("double").alias("weight"))
    each = named.join(mean, "id").groupBy("id").agg(F.sum(sq_dist(F.col("features"), F.col("mean"))).alias("inner"), F.sum("lam").alias("lam"))
    nodes = mean.join(each, "id").select("id", F.col("mean").alias("features"), "lam", "weight", "inner")
    at = named.select("member", "id")
    one = diff.join(at.select(F.col("member").alias("i"), F.col("id").alias("a")), "i").join(at.select(F.col("member").alias("j"), F.col("id").alias("b")), "j")
    ok = F.when(F.col("a") == F.col("b"), F.raise_error(F.lit("a pair that must part is held together")).cast("long")).otherwise(F.least("a", "b"))
    return nodes, one.select(ok.alias("i"), F.greatest("a", "b").alias("j")).distinct(), at.select("id", "member")


def constrained(points: DataFrame, same: DataFrame, diff: DataFrame, sigma: float = 0.0, limit: int = 2000) -> DataFrame:
    """As ``priced``, over sets of points(id, features, lam) that hold both or neither of each same pair and not both of any diff pair; members are points.

    A set of use holds no node farther from its mean than the root of (duals - inner cost) / weight, so nodes are
    neighbours by those radii; pairs that must part lose their edge, and are kept apart within the groups too.
    """
    nodes, apart, members = contracted(points, same, diff)
    nodes, apart = kept(nodes), kept(apart)
    r = radius((F.col("lam") - F.col("inner")) / F.col("weight"))
    found = kept(searched(near.ranked(nodes.withColumn("r", r), apart), sigma, limit, apart=apart))
    own = found.select("seed", F.explode("members").alias("id")).join(members, "id").groupBy("seed").agg(F.sort_array(F.collect_list("member")).alias("points"))
    return found.join(own, "seed").select("seed", "n", "status", F.col("points").alias("members"), "rc", "bound", "exact")


def groups(nodes: DataFrame, later: DataFrame, sigma: float = 0.0, below: float = -EPS) -> DataFrame:
    """seed, n, lam, bound, status of every group: 'single' without later neighbours, 'pruned' where sigma less all its duals isn't under ``below``, else 'searched'."""
    own = _complete(nodes).select("id", (F.col("lam") - F.col("inner")).alias("lam"))
    gain = own.select("id", F.greatest("lam", F.lit(0.0)).alias("lam"))  # what a node may add at most
    more = pricing.lower_bounds(gain, later)
    rows = later.select("id", (F.size("later") + 1).alias("n")).join(more, "id").join(own, "id")
    bound = F.lit(sigma) - (F.col("held") - F.greatest("lam", F.lit(0.0)) + F.col("lam"))
    status = F.when(F.col("n") == 1, "single").when(bound >= below, "pruned").otherwise("searched")
    return rows.select(F.col("id").alias("seed"), "n", "lam", bound.alias("bound"), status.alias("status"))


def _complete(nodes: DataFrame) -> DataFrame:
    """nodes with weight 1, inner cost 0 and no foes where they have no such columns."""
    more = {"weight": F.lit(1.0), "inner": F.lit(0.0), "foes": F.array().cast("array<bigint>")}
    return nodes.withColumns({c: v for c, v in more.items() if c not in nodes.columns})


def priced(nodes: DataFrame, later: DataFrame, sigma: float = 0.0, limit: int = 2000, below: float = -EPS) -> DataFrame:
    """seed, n, status, members, rc, bound, exact of every group: the set of least reduced cost that holds the seed.

    A pruned group reports its seed alone, and its bound; a search that meets its limit reports the bound of what it
    left open. A group beyond MOST rows reports the set that the fractional iteration found among its rows, with the bound by duals.
    """
    every = kept(groups(nodes, later, sigma, below))
    x = _complete(nodes).select("id", "features", "lam", "weight", "inner", "foes")
    wanted = every.where("status = 'searched'").select(F.col("seed").alias("id"), F.col("n").alias("rows"))
    pairs = later.join(wanted, "id").select(F.col("id").alias("seed"), "rows", F.explode(F.concat(F.array("id"), "later")).alias("id"))
    rows = kept(pairs.join(x, "id"))
    few = rows.where(F.col("rows") <= MOST).groupBy("seed").applyInArrow(_searched(limit), "seed long, members array<long>, value double, bound double, exact boolean")
    few = few.select("seed", "members", (F.col("value") + sigma).alias("rc"), (F.col("bound") + sigma).alias("low"), "exact")
    large = rows.where(F.col("rows") > MOST)
    if "weight" in nodes.columns and not large.isEmpty():
        raise ValueError(f"groups of more than {MOST} rows can't be searched under constraints")
    if not large.isEmpty():
        best, members = fractional.best_ratios(large, "seed")
        sets = members.groupBy("grp").agg(F.sort_array(F.collect_list("id")).alias("members"))
        few = few.unionByName(best.join(sets, "grp").select(F.col("grp").alias("seed"), "members", (F.col("ratio") + sigma).alias("rc"), F.lit(None).cast("double").alias("low"), F.lit(False).alias("exact")))
    alone = F.lit(sigma) - F.col("lam")
    out = every.join(few, "seed", "left")
    return out.select(
        "seed", "n", "status", F.coalesce("members", F.array("seed")).alias("members"), F.coalesce("rc", alone).alias("rc"),
        F.coalesce("low", F.when(F.col("status") == "single", alone).otherwise(F.col("bound"))).alias("bound"), F.coalesce("exact", F.col("status") == "single").alias("exact"),
    )


def bounded(nodes: DataFrame, sigma: float = 0.0, below: float = -EPS) -> DataFrame:
    """As ``groups``, of the discs nodes(id, features, lam, degree) that meet (``near.ranked``), without their neighbourhoods as a table."""
    own = _complete(nodes).withColumn("lam", F.col("lam") - F.col("inner")).withColumn("gain", F.greatest("lam", F.lit(0.0)))
    rows = near.held(own if "r" in own.columns else own.withColumn("r", radius(F.col("lam") / F.col("weight"))), "gain").join(own.select("id", "lam", "gain").hint("merge"), "id")
    bound = F.lit(sigma) - (F.col("held") - F.col("gain") + F.col("lam"))
    status = F.when(F.col("n") == 1, "single").when(bound >= below, "pruned").otherwise("searched")
    return rows.select(F.col("id").alias("seed"), "n", "lam", bound.alias("bound"), status.alias("status"))


def searched(nodes: DataFrame, sigma: float = 0.0, limit: int = 2000, below: float = -EPS, apart: DataFrame | None = None) -> DataFrame:
    """As ``priced``, of the discs nodes(id, features, lam, degree) that meet (``near.ranked``), each group in the task that finds it.

    No group is written or shuffled, so those of any size are searched.
    """
    names = ["degree", "lam", "weight", "inner"]

    def work(v: near.View, rows: np.ndarray, cols: np.ndarray, hit: np.ndarray) -> pa.RecordBatch:
        hit, ids, out = near.later(v, rows, cols, hit), v.id, []
        lam, weight, inner = (v.more[c] for c in names[1:])
        for i, h in zip(rows.tolist(), hit, strict=True):
            own, later = float(lam[i] - inner[i]), cols[h]
            bound = sigma - (float(np.maximum(lam[later] - inner[later], 0).sum()) + own)
            if not len(later) or bound >= below:
                out.append((ids[i], len(later) + 1, "pruned" if len(later) else "single", [ids[i]], sigma - own, bound if len(later) else sigma - own, not len(later)))
                continue
            at = np.append(later, i)
            at = at[np.argsort(ids[at])]
            place = {p: k for k, p in enumerate(at.tolist())} if v.foes else {}
            foes = {(min(k, place[o]), max(k, place[o])) for p, k in place.items() for o in v.foes.get(p, np.zeros(0, int)).tolist() if o in place}
            k = int(np.searchsorted(ids[at], ids[i]))
            items = pricing.Items(weight[at], v.x[at], inner[at], lam[at], foes, [])
            value, chosen, low, exact = pricing.search(items, k, np.delete(np.arange(len(at)), k), limit)
            out.append((ids[i], len(at), "searched", np.sort(ids[at[chosen]]), value + sigma, low + sigma, exact))
        types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.float64(), pa.float64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["seed", "n", "status", "members", "rc", "bound", "exact"])

    return near.told(_complete(nodes), work, "seed long, n long, status string, members array<long>, rc double, bound double, exact boolean", names, apart)


def counters(found: DataFrame) -> DataFrame:
    """n_groups, n_pruned, n_singles, n_searched, in one row."""
    return found.agg(F.count(F.lit(1)).alias("n_groups"), *(F.count_if(F.col("status") == s).alias(n) for s, n in (("pruned", "n_pruned"), ("single", "n_singles"), ("searched", "n_searched"))))


def entering(found: DataFrame, eps: float = EPS) -> DataFrame:
    """members, rc of the distinct sets of negative reduced cost."""
    return found.where(F.col("rc") < -eps).select("members", "rc").dropDuplicates(["members"])
