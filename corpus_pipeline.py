"""A training corpus from documents: rules, line dedup, near duplicates, mixing, packing.

Each stage works on all rows that the stage before kept, written as Parquet in between. The stage of near
duplicates takes five words and a similarity of 0.8; the stages' operators say what becomes of nulls, empty
and long texts, ties, repeated rows, empty tables and extra columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clustrel.llm import jaccard_join, line_dedup, mixing, packing, quality_rules
from clustrel.llm.common import documents, n_words, stored


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that policy full-1 keeps."""
    return quality_rules.keep_good(docs, quality_rules.POLICIES["full-1"])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without later copies of three-line windows; those left without a word go."""
    return line_dedup.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least id."""
    return jaccard_join.keep_one(docs, 5, 4, 5)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them."""
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the training sequences."""
    return packing.pack_documents(docs, n_words(F.col("text")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", rules),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", pack),
]
#: Components of a similarity join and best-fit packing aren't for SQL; tests/llm/test_pipeline.py holds every stage to a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k + 1}")
    return docs
