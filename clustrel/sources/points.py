"""Readers and writers of point tables: id LONG, features ARRAY<DOUBLE>."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUMBER = r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?"


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """value, id of the lines that aren't blank, numbered from 0 in the order of files by name and of lines in them.

    Two passes: lines are counted by split of a file, the splits' counts add up to offsets, and each line adds
    its place in its split. Only the splits, a row for each, are put in order in one place.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("start")).where(F.length(F.trim("value")) > 0)
    lines = lines.withColumn("row", F.monotonically_increasing_id())  # the lines of a split follow each other in one task
    splits = lines.groupBy("file", "start").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("file", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return lines.join(offsets, ["file", "start"]).select("value", (F.col("row") - F.col("first") + F.col("offset")).alias("id"))


def _number(field, bad: str):
    """A field as a number. One that isn't there or isn't a number raises, or is null where ``bad`` is 'null'."""
    value = F.trim(field).try_cast("double")
    if bad == "null":
        return value
    return F.coalesce(value, F.raise_error(F.concat(F.lit("not a number: "), F.coalesce(field, F.lit("(no field)")))))


def _typed(lines: DataFrame, fields, cols: Sequence[int] | None, bad: str) -> DataFrame:
    """id, features of lines(id, value): the fields at cols, or of the columns that are numbers."""
    if bad not in ("raise", "null"):
        raise ValueError("bad must be 'raise' or 'null'")
    if cols is None:  # a first pass settles which columns are numbers: those of which more fields are than aren't
        each = lines.select(F.posexplode(fields).alias("p", "v")).where(F.trim("v") != "")
        share = each.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count(F.trim("v").try_cast("double")).alias("numbers"))
        cols = sorted(r["p"] for r in share.where("2 * numbers > n").collect())
    return lines.select("id", F.array(*(_number(F.get(fields, F.lit(c)), bad) for c in cols)).cast("array<double>").alias("features"))


def read_csv(spark: SparkSession, path: str, cols: Sequence[int] | None = None, header: bool = False, sep: str = ",", bad: str = "raise") -> DataFrame:
    """Comma-separated points; cols picks fields by position, without it the columns that are mostly numbers are taken, of every row the same; blank lines are skipped.

    A field of such a column that is missing or not a number raises, or with bad='null' is null in its place.
    """
    lines = _numbered(spark, path)
    if header:
        lines = lines.where("id > 0").withColumn("id", F.col("id") - 1)
    return _typed(lines, F.split("value", re.escape(sep), -1), cols, bad)


def read_whitespace(spark: SparkSession, path: str, cols: Sequence[int] | None = None, bad: str = "raise") -> DataFrame:
    """Points in columns parted by white space, with the columns picked by position; else as ``read_csv``."""
    return _typed(_numbered(spark, path), F.split(F.trim("value"), r"\s+"), cols, bad)


def read_tsplib(spark: SparkSession, path: str) -> DataFrame:
    """Node coordinates of a TSPLIB file, raw; ids are the nodes' numbers less 1."""
    rows = spark.read.text(path).where(F.col("value").rlike(rf"^\s*\d+\s+{NUMBER}\s+{NUMBER}\s*$"))
    f = F.split(F.trim("value"), r"\s+")
    return rows.select((F.get(f, F.lit(0)).cast("long") - 1).alias("id"), F.array(*(F.get(f, F.lit(k)).cast("double") for k in (1, 2))).alias("features"))


def read_vectors(spark: SparkSession, path: str, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """Points from a Parquet column of arrays; a label column is kept where there is one."""
    df = spark.read.parquet(path)
    keep = ["label"] if "label" in df.columns else []
    return df.select(F.col(id_col).alias("id"), F.transform(col, lambda v: v.cast("double")).alias("features"), *keep)


def literal(spark: SparkSession, rows: Sequence[Sequence[float]]) -> DataFrame:
    """Points written out in code; ids in their order."""
    if len({len(r) for r in rows}) > 1:
        raise ValueError("points of one table have one dimension")
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "id long, features array<double>")


def blobs(spark: SparkSession, n: int, k: int, dim: int = 2, spread: float = 0.5, seed: int = 0) -> DataFrame:
    """k Gaussian clouds of n // k points each around centres drawn from [0, 10 k)."""
    rows = spark.range(n // k * k).withColumn("label", (F.col("id") % k).cast("int"))
    centre = lambda d: F.pmod(F.xxhash64("label", F.lit(seed), F.lit(d)), F.lit(1 << 20)) / float(1 << 20) * 10 * k
    return rows.select("id", F.array(*(centre(d) + spread * F.randn(seed * 1009 + d) for d in range(dim))).alias("features"), "label")


def write_csv(points: DataFrame, path: str) -> None:
    """Points as comma-separated text."""
    points.select(F.array_join(F.transform("features", lambda v: v.cast("string")), ",").alias("value")).write.text(path)


def write_json(result: DataFrame, path: str) -> None:
    """A result table as JSON lines."""
    result.write.json(path)
