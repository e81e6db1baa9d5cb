"""Tables in the folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The checkpoint folder; one is set here only for a local master that has none."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="clustrel-"))
        at = context.getCheckpointDir()
    return at.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and written as Parquet: lineage ends here, and a lost executor costs nothing."""
    at = f"{folder(df.sparkSession)}/clustrel-{uuid.uuid4().hex}"
    df.write.parquet(at)
    back = df.sparkSession.read.schema(df.schema).parquet(at)
    back.kept_at = at
    return back


def drop(df: DataFrame) -> None:
    """Delete the table behind a result of ``kept`` that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
