"""Distances, centroids, costs and dual bounds of an assignment.

Points are (id, features); centroids are (cluster, center); an assignment is (id, cluster). The k centroids
are the small side of every join here, and their number is a parameter, not a property of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clustrel.functions.vectors import sq_dist


def long_form(points: DataFrame, key: str = "id") -> DataFrame:
    """key, dim, v: a row for each coordinate."""
    col = "features" if "features" in points.columns else "center"
    return points.select(key, F.posexplode(col).alias("dim", "v"))


def centroids(labelled: DataFrame) -> DataFrame:
    """cluster, center, size of labelled(cluster, features): means by dimension, partially aggregated."""
    per = labelled.select("cluster", F.posexplode("features").alias("dim", "v")).groupBy("cluster", "dim").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))
    packed = per.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("dim", "v"))).alias("x"), F.max("n").alias("size"))
    return packed.select("cluster", F.transform("x", lambda s: s["v"]).alias("center"), "size")


def centroids_or_zero(labelled: DataFrame, k: int, dim: int) -> DataFrame:
    """Centroids of clusters 0 to k - 1; an empty one is the zero vector."""
    zero = F.array_repeat(F.lit(0.0), dim)
    every = labelled.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
    return every.join(centroids(labelled), "cluster", "left").select("cluster", F.coalesce("center", zero).alias("center"), F.coalesce("size", F.lit(0)).alias("size"))


def distances(points: DataFrame, cents: DataFrame, dim: int | None = None) -> DataFrame:
    """points with each cluster and d2, the squared distance to its centroid."""
    return points.crossJoin(F.broadcast(cents.select("cluster", "center"))).withColumn("d2", sq_dist(F.col("features"), F.col("center"), dim)).drop("center")


def nearest(points: DataFrame, cents: DataFrame, dim: int | None = None) -> DataFrame:
    """points with the nearest cluster and d2; the lower cluster wins a tie. Nothing is shuffled: each row meets the list of centroids."""
    packed = cents.agg(F.sort_array(F.collect_list(F.struct("cluster", "center"))).alias("cs"))
    each = points.crossJoin(F.broadcast(packed))
    best = F.array_min(F.transform("cs", lambda c: F.struct(sq_dist(F.col("features"), c["center"], dim).alias("d2"), c["cluster"].alias("cluster"))))
    own = [c for c in points.columns if c not in ("cluster", "d2")]
    return each.withColumn("best", best).select(*own, "best.cluster", "best.d2")


def two_nearest(points: DataFrame, cents: DataFrame, dim: int | None = None) -> DataFrame:
    """points with the nearest and the second nearest cluster: c1, d1, c2, d2."""
    packed = cents.agg(F.sort_array(F.collect_list(F.struct("cluster", "center"))).alias("cs"))
    each = points.crossJoin(F.broadcast(packed))
    ranked = F.sort_array(F.transform("cs", lambda c: F.struct(sq_dist(F.col("features"), c["center"], dim).alias("d"), c["cluster"].alias("c"))))
    own = [F.col(c) for c in points.columns]
    each = each.withColumn("r", ranked)
    at = lambda k, f: F.get("r", F.lit(k))[f]
    return each.select(*own, at(0, "c").alias("c1"), at(0, "d").alias("d1"), at(1, "c").alias("c2"), at(1, "d").alias("d2"))


def lloyd_step(points: DataFrame, cents: DataFrame, dim: int | None = None) -> DataFrame:
    """The next centroids: means of the points nearest to each; one without points stays where it is."""
    new = centroids(nearest(points, cents, dim))
    old = cents.select("cluster", F.col("center").alias("was"))
    return old.join(new, "cluster", "left").select("cluster", F.coalesce("center", "was").alias("center"), F.coalesce("size", F.lit(0)).alias("size"))


def cluster_costs(labelled: DataFrame, dim: int | None = None) -> DataFrame:
    """cluster, size, cost: sums of squared distances to the means."""
    own = labelled.join(F.broadcast(centroids(labelled).select("cluster", "center")), "cluster")
    return own.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum(sq_dist(F.col("features"), F.col("center"), dim)).alias("cost"))


def huygens_costs(labelled: DataFrame, dim: int | None = None) -> DataFrame:
    """cluster, cost by the pair form: the sum of squared distances of all pairs over the size.

    The pair sum is taken from sums by dimension, n * sum(v * v) - sum(v) ** 2, so no pair is made; values are
    taken from their mean over all clusters first, so that points far from the origin lose no digits.
    """
    long = labelled.select("cluster", F.posexplode("features").alias("dim", "v"))
    mean = long.groupBy("dim").agg(F.avg("v").alias("mean"))  # one row per dimension
    per = long.join(F.broadcast(mean), "dim").withColumn("v", F.col("v") - F.col("mean")).groupBy("cluster", "dim")
    per = per.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * F.sum(F.col("v") * F.col("v")) - F.sum("v") * F.sum("v")).alias("p"))
    return per.groupBy("cluster").agg((F.sum("p") / F.max("n")).alias("cost"))


def dual_bounds(labelled: DataFrame, dim: int | None = None) -> DataFrame:
    """id, lower, upper: what leaving its cluster saves, m / (m - 1) of d2 to the mean (0 for a single point), and what joining the nearest other centroid adds."""
    cents = centroids(labelled)
    each = distances(labelled.withColumnRenamed("cluster", "own"), cents, dim)
    sized = each.join(F.broadcast(cents.select(F.col("cluster").alias("own"), "size")), "own")
    mine = F.when(F.col("cluster") == F.col("own"), F.col("d2"))
    other = F.when(F.col("cluster") != F.col("own"), F.col("d2"))
    per = sized.groupBy("id").agg(F.max(mine).alias("mine"), F.min(other).alias("other"), F.max("size").alias("m"))
    lower = F.when(F.col("m") > 1, F.col("m") / (F.col("m") - 1) * F.col("mine")).otherwise(F.lit(0.0))
    return per.withColumn("lower", lower).select("id", "lower", F.greatest(F.col("lower"), F.col("other") - F.col("mine")).alias("upper"))


def first_k(points: DataFrame, k: int) -> DataFrame:
    """Centroids at the k points of least id: a fixed start."""
    rows = points.orderBy("id").limit(k)
    return rows.select((F.row_number().over(Window.orderBy("id")) - 1).cast("int").alias("cluster"), F.col("features").alias("center"))
