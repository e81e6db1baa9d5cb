"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis-Spirakis).

A source's budget is water-filled: it gets its weight's share of the total, never more than ``max_epochs``
times its own size, and what it can't take is shared again by weight. Whole epochs of a source come first;
the rest of the budget goes to its documents in the order of the keys -ln(u) / weight, u drawn from a hash
of the document's id, until the running sum of sizes meets the budget. The last document is cut there.

Running sums are taken over the sums of key buckets of each source, and only the bucket in which a budget
ends is ordered document by document, so a source with a third of all rows needs no task of its own.

Edge cases: a null text has size 0; a null source is a source of its own, after the others; a source
without words gets target 0; documents of size 0 are never taken; repeated rows and ties in the key go by
id, then size, and share their key; an empty table gives an empty mix; columns other than the id, the source
and those computed here are carried by ``apply_mix`` only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clustrel.llm.common import documents, filtered, n_words, stored, words

BUCKETS = 1 << 14


def uniform(doc_id: Column) -> Column:
    """A fixed draw from (0, 1) for an id: 48 bits of its MD5."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 12), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 48))


def quality_weight(text: Column, size: Column) -> Column:
    """A weight from 0.05 to 1: low for a text full of symbols."""
    symbols = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>]"))
    return F.greatest(F.lit(0.05), F.lit(1.0) - symbols / F.greatest(size, F.lit(1)).cast("double"))


def targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """source, source_size, target: one row per source of sizes(source, size).

    The windows here run over one row per source, after the aggregation.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("w", F.get(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights)))
    per = per.withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    )
    per = per.withColumns({"level": level, "at": F.row_number().over(fill)})
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("at"))
    per = per.withColumn("final", F.min_by("level", fits).over(every))
    return per.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("final") * F.col("w")).alias("target"))


def mix(sized: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, measured: DataFrame | None = None) -> DataFrame:
    """sized(doc_id, source, size, weight) with source_size, target and taken: the words the mix takes of it.

    measured: the same rows in those four columns, from a cheaper place, for the sums.
    """
    few = measured if measured is not None else sized
    per = targets(few, weights, share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    per = per.withColumn("epochs", epochs)
    per = per.withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    key = -F.log(uniform(F.col("doc_id"))) / F.col("weight")
    with_key = lambda x: x.withColumn("key", key).withColumn("bucket", F.floor(BUCKETS * F.col("key") / (1 + F.col("key"))).cast("int"))
    keyed = with_key(sized)
    sums = with_key(few).groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("held").over(upto), F.lit(0)))
    ends = (
        sums.join(per.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .groupBy("s")
        .agg(
            F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("epochs").alias("epochs"), F.first("budget").alias("budget"),
            F.max_by(F.struct("bucket", "before"), F.when(F.col("before") <= F.col("budget"), F.col("bucket"))).alias("end"),
        )
    )
    ends = stored(ends, "ends")  # one row per source, of a size known from here on: broadcast where it is small
    rows = keyed.join(ends, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    edge = F.col("bucket") == F.col("end.bucket")
    within = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    clear = rows.where(~edge).withColumn("part", F.when(F.col("bucket") < F.col("end.bucket"), F.col("size")).otherwise(0))
    start = F.col("end.before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    cut = rows.where(edge).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - start)))
    out = clear.unionByName(cut)
    return out.withColumn("taken", F.col("epochs") * F.col("size") + F.col("part")).drop("key", "bucket", "end", "part", "budget")


def apply_mix(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: a row for each whole epoch, and one for a part, cut to its first words.

    Texts stay where they are read: only sums by source and bucket, and the rows of the buckets in which a
    budget ends, are shuffled.
    """
    own = docs.columns
    boxed = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"))
    boxed = boxed.withColumn("weight", quality_weight(F.col("row.text"), F.col("size")))
    sizes = stored(boxed.drop("row"), "mix")
    rows = filtered(mix(boxed, measured=sizes), F.col("taken") > 0)
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    rows = rows.select("row", "size", F.explode(F.transform(F.sequence(F.lit(0), copies - 1), lambda i: F.least(F.col("size"), F.col("taken") - i * F.col("size")))).alias("part"))
    text = F.when(F.col("part") == F.col("size"), F.col("row.text")).otherwise(F.array_join(F.slice(words(F.col("row.text")), 1, F.col("part").cast("int")), " "))
    rows = rows.withColumn("cut", text)
    new = {"text": F.col("cut"), "n_chars": F.char_length("cut").cast("long")}
    return rows.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in own))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """What a mix of all documents takes of each."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text").withColumn("size", n_words(F.col("text")))
    sized = docs.withColumn("weight", quality_weight(F.col("text"), F.col("size"))).drop("text")
    return mix(stored(sized, "mix")).select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS sym FROM documents),
k AS (
  SELECT *, -ln((('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
            / greatest(0.05::DOUBLE, 1.0::DOUBLE - sym::DOUBLE / greatest(size, 1)::DOUBLE) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(2 * source_size) OVER f, 0)::DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0))::DOUBLE AS level,
         row_number() OVER (ORDER BY (2 * source_size)::DOUBLE / w, source NULLS LAST) AS rk
  FROM r WINDOW f AS (ORDER BY (2 * source_size)::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fin AS (SELECT arg_min(level, rk) AS lvl FROM l WHERE level <= (2 * source_size)::DOUBLE / w),
t AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, lvl * w) AS target FROM l, fin),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
b AS (SELECT *, floor(target - epochs * source_size)::BIGINT AS budget FROM e),
c AS (
  SELECT k.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM k)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - before)))::BIGINT AS taken, c.source AS source, epochs
FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source
"""
