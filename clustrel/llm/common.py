"""What several operators share: words, the shared folder, cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words.
BLANKS = " \t\n\x0b\x0c\r"
_GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; a null or blank text has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _GAP))


def n_words(text: Column) -> Column:
    """How many words a text has, as a long."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; one is set only where the session has none."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="clustrel-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as Parquet to the shared folder and read back: lineage ends here, lost executors cost nothing, and later reads take only the columns they need."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/clustrel-{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    back = spark.read.schema(df.schema).parquet(at)
    back.stored_at = at
    return back


def forget(df: DataFrame) -> None:
    """Delete the table behind a result of ``stored`` that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(conf).delete(path, True)


def filtered(df: DataFrame, keep: Column) -> DataFrame:
    """The rows of df that keep is true of, tested on computed columns as they are.

    A plain filter would be pushed below the projections that make the columns, with their expressions put in
    its place, and lambdas would then evaluate whole arrays once per element.
    """
    fence = "__fence"
    return df.withColumn(fence, F.monotonically_increasing_id()).where(keep & (F.col(fence) >= 0)).drop(fence)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
