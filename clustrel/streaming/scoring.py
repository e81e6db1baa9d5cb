"""Scoring a stream of points against fixed centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame

from clustrel.operators.assign import nearest


def assign_stream(points: DataFrame, cents: DataFrame, dim: int | None = None) -> DataFrame:
    """A streaming frame of (id, features) with the nearest of the static centroids (cluster, center) and d2; it keeps no state."""
    rows = cents.select("cluster", "center").collect()
    return nearest(points, points.sparkSession.createDataFrame(rows, "cluster int, center array<double>"), dim)
