"""Line dedup over overlapping windows of three lines.

The lines of a text that hold a word are numbered; each three in a row are a window, known by two 64-bit
hashes of its lines. Of a window found at several places of the whole table, the first place by document id
and position stays; at all later places its three lines are covered. Covered lines, the union of all such
windows, go. Only DataFrame functions are used.

Edge cases: a null text stays null; a text of fewer than three lines with words has no window and stays;
a text whose lines are all covered becomes an empty one; lines without words stay; rows that share
id and text are one document, cleaned alike, and rows that share an id alone are documents of their own, in
the order of a digest of the text; rows without an id pass unchanged; an empty table stays empty; other columns pass
through, but for those named as the columns that are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clustrel.llm.common import documents, filtered

SPAN = 3
_WORD = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, d, at, h1, h2: a row for every window of docs(doc_id, text); d is a digest of the text, which tells rows of one id apart."""
    full = docs.where("doc_id is not null and text is not null")
    full = full.select("doc_id", F.xxhash64("text").alias("d"), F.filter(_lines(F.col("text")), lambda x: x.rlike(_WORD)).alias("ls")).where(F.size("ls") >= SPAN)
    parts = lambda i: [F.get(F.col("ls"), i + k) for k in range(SPAN)]
    hashed = F.transform(F.sequence(F.lit(0), F.size("ls") - SPAN), lambda i: F.struct(F.xxhash64(*parts(i)).alias("h1"), F.xxhash64(F.lit(7), *parts(i)[::-1]).alias("h2")))
    return full.select("doc_id", "d", F.posexplode(hashed).alias("at", "h")).select("doc_id", "d", "at", "h.h1", "h.h2")


def later(wins: DataFrame) -> DataFrame:
    """doc_id, d, starts: the windows of each document that have an earlier place elsewhere."""
    firsts = wins.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "d", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    hits = wins.join(firsts, ["h1", "h2"]).where(F.struct("doc_id", "d", "at") > F.col("first"))
    return hits.groupBy("doc_id", "d").agg(F.collect_set("at").alias("starts"))


def dedup(docs: DataFrame) -> DataFrame:
    """docs with the text cleaned, and the columns n_lines (lines with words) and n_removed.

    A windows row is 36 bytes; the shuffle by hash sums up on the map side first, so that a window
    with very many places isn't gathered, and the join of the windows with the repeated ones is
    left to adaptive skew splitting.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    hits = later(windows(docs.select("doc_id", "text"))).select(F.col("doc_id").alias("hit"), F.col("d").alias("hit_d"), "starts")
    boxed = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("d"))
    x = boxed.join(hits, (F.col("id") == F.col("hit")) & (F.col("d") == F.col("hit_d")), "left").withColumn("ls", _lines(F.col("row.text")))
    x = x.withColumn("full", F.filter(F.sequence(F.lit(0), F.size("ls") - 1), lambda i: F.get(F.col("ls"), i).rlike(_WORD)))
    near = F.flatten(F.transform("starts", lambda s: F.array(*(F.get(F.col("full"), s + k) for k in range(SPAN)))))
    x = x.withColumn("gone", F.when(F.col("starts").isNotNull(), F.array_distinct(near)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("ls") - 1), F.col("gone"))
    x = x.withColumn("clean", F.when(F.col("gone").isNotNull(), F.array_join(F.transform(kept, lambda i: F.get(F.col("ls"), i)), "\n")).otherwise(F.col("row.text")))
    cols = [F.col("clean").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in own]
    return x.select(*cols, F.coalesce(F.size("full"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def clean(docs: DataFrame) -> DataFrame:
    """docs with the text cleaned and n_chars, where there is one, counted again; texts that lost all lines go."""
    own = docs.columns
    boxed = dedup(docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in own)).alias("all")))
    boxed = filtered(boxed, (F.col("n_removed") == 0) | F.col("text").rlike(_WORD))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return boxed.select(*(new.get(c, F.col(f"all.`{c}`")).alias(c) for c in own))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents with their text cleaned of repeated windows of lines."""
    return dedup(documents(spark, sf_dir).select("doc_id", "text"))


OP5_SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
f AS (SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM e WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT doc_id, p, line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS g FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS n FROM w WHERE g IS NOT NULL),
c AS (SELECT DISTINCT doc_id, p + k AS p FROM r, (VALUES (0), (1), (2)) AS t(k) WHERE n > 1),
x AS (SELECT e.doc_id, e.line, e.i, f.p IS NOT NULL AS has, c.p IS NOT NULL AS gone
      FROM e LEFT JOIN f USING (doc_id, i) LEFT JOIN c ON c.doc_id = f.doc_id AND c.p = f.p),
g AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS t,
             count(*) FILTER (WHERE has) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed FROM x GROUP BY doc_id)
SELECT doc_id, t AS text, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed FROM g
"""
