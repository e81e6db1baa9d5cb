"""Sweeps over the number of clusters, held against known costs."""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustrel.functions.vectors import gap_pct
from clustrel.operators import jumps as moves
from clustrel.operators import solver

ROW = "k int, cost double, bound double, status string, seconds double"


def k_sweep(points: DataFrame, known: Mapping[int, float], prove: bool = False, restarts: int = 8, seed: int = 42, jumps: bool = True) -> DataFrame:
    """k, cost, bound, status, seconds, known, gap_pct: a row per k of ``known``.

    Without ``prove`` the cost is that of the best start alone, its bound is 0 and its status ``heuristic``.
    """
    rows = []
    for k in known:
        began = time.time()
        if prove:
            r = solver.solve(points, k, restarts, seed, jumps=jumps)
            rows.append((k, float(r.cost), float(r.bound), r.status, time.time() - began))
        else:
            cents, cost = moves.restarts(points, k, restarts, seed)
            if jumps:
                cost = moves.jump_search(points, k, cents)[1]
            rows.append((k, float(cost), 0.0, "heuristic", time.time() - began))
    spark = points.sparkSession
    gold = spark.createDataFrame([(k, float(v)) for k, v in known.items()], "k int, known double")
    return spark.createDataFrame(rows, ROW).join(gold, "k").withColumn("gap_pct", gap_pct(F.col("cost"), F.col("known")))


def summary(sweep: DataFrame, tol: float = 1e-4) -> DataFrame:
    """n, worse (rows whose cost exceeds the known one), mean and longest seconds, and the largest gap, in one row."""
    over = F.col("cost") > F.col("known") * (1 + tol) + tol
    return sweep.agg(F.count(F.lit(1)).alias("n"), F.count_if(over).alias("worse"), F.avg("seconds").alias("mean_s"), F.max("seconds").alias("max_s"), F.max("gap_pct").alias("max_gap_pct"))
