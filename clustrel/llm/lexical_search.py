"""Ranked lexical search: a blocked sparse product of items by terms and terms by documents.

An item's row holds how often it has each term; a document's column holds each term's impact, a 64-bit integer.
Items go by waves of a bounded number of entries; a wave's terms are broadcast. One pass over the texts keeps
each document's terms of the wave (as numbers) and its length, written to the shared folder. From there come the
counts of documents and terms, and a second pass multiplies: per block of documents the entries are put in order
of term, each item adds up the rows of its terms (Gustavson's way), and a task keeps the best documents of each
item over all its blocks. What the tasks keep is ranked by item.

Edge cases: a null text has no terms, a document without terms is neither counted nor found; an item without
terms has no rows; rows that share a doc_id are documents of their own; a repeated row of items counts once,
and different texts of one item_id are one item; rows without an id are ranked after others of equal score, and
items without an id are one item; empty tables give no rows; other columns aren't read. Whole texts are used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clustrel.llm.common import documents, stored

#: Entries (item, term) of a wave, about; an item is never cut.
WAVE = 1 << 19
#: Entries (document, term) that a block of documents has, about.
BLOCK = 1 << 21
TOP = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: For bytes: what separates terms becomes a blank, A-Z lower case; bytes of other characters stay.
_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, mult of items(item_id, text): how often the item has the term."""
    rows = items.select("item_id", "text").where("text is not null").distinct()
    terms = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    return rows.select("item_id", F.explode(terms).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("mult"))


def _entries(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n, terms, tfs of every document with terms: its length, and the wave's terms in it with how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for b in batches:
            lengths, held = [], []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                words = t.translate(_TABLE).split() if t else []
                lengths.append(len(words))
                held.append(np.array([known[w] for w in words if w in known], np.int64))
            sizes = [len(x) for x in held]
            key = np.repeat(np.arange(len(held)), sizes) * (len(known) + 1) + (np.concatenate(held) if held else np.zeros(0, np.int64))
            key, tf = np.unique(key, return_counts=True)
            doc, term = np.divmod(key, len(known) + 1)
            n = np.array(lengths, np.int64)
            offsets = pa.array(np.searchsorted(doc, np.arange(len(held) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (term, tf)]
            out = pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def _best(score: np.ndarray, doc: np.ndarray, named: np.ndarray, top: int) -> np.ndarray:
    """Places of the best scores, the highest first; ties by document, those without an id last."""
    at = np.arange(len(score))
    if len(score) > top:
        at = np.flatnonzero(score >= np.partition(score, len(score) - top)[len(score) - top])
    return at[np.lexsort((doc[at], ~named[at], -score[at]))[:top]]


def _product(entries: DataFrame, shared, top: int) -> DataFrame:
    """item_id, doc_id, score: of each task, the best documents of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, weights, n_docs, n_terms = shared.value
        kept: list[tuple] = [()] * len(rows)  # scores, documents, whether they have ids

        def block(doc: np.ndarray, named: np.ndarray, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
            m = np.array([25 + 75 * x * n_docs // n_terms for x in n.tolist()], np.int64)
            owner = np.repeat(np.arange(len(doc)), sizes)
            impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[owner]))
            order = np.argsort(term, kind="stable")
            owner, impact = owner[order], impact[order]
            begins = np.searchsorted(term[order], np.arange(len(weights) + 1)).tolist()
            for i, (_, terms, mults) in enumerate(rows):
                total = np.zeros(len(doc), np.int64)
                for t, times in zip(terms, mults, strict=True):
                    a, b = begins[t], begins[t + 1]
                    if a < b:  # a term has one entry a document, so no place is named twice
                        total[owner[a:b]] += times * impact[a:b]
                hit = np.flatnonzero(total)
                if len(hit):
                    new = (total[hit], doc[hit], named[hit])
                    both = tuple(map(np.concatenate, zip(kept[i], new, strict=True))) if kept[i] else new
                    at = _best(*both, top)
                    kept[i] = tuple(x[at] for x in both)

        for b in batches:
            doc = b.column("doc_id").fill_null(0).to_numpy()
            named = ~b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            n, lists = b.column("n").to_numpy(), b.column("terms")
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            term, tf = lists.flatten().to_numpy(), b.column("tfs").flatten().to_numpy().astype(np.int64)
            ends = np.cumsum(sizes)
            lo = 0
            while lo < len(doc):  # blocks of a bounded number of entries, of one document at least
                done = ends[lo] - sizes[lo]
                hi = max(lo + 1, int(np.searchsorted(ends, done + BLOCK, side="right")))
                block(doc[lo:hi], named[lo:hi], n[lo:hi], sizes[lo:hi], term[done : ends[hi - 1]], tf[done : ends[hi - 1]])
                lo = hi
        for (item, _, _), best in zip(rows, kept, strict=True):
            if best:
                ids = pa.array(best[1], mask=~best[2])
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(ids), pa.int64()), ids, pa.array(best[0])], ["item_id", "doc_id", "score"])

    return entries.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, wave: int = WAVE) -> DataFrame:
    """item_id, rank, doc_id, score: the documents of highest score above 0 of each item of items(item_id, text), from all docs(doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = stored(item_terms(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))), "items")
    waves = -(-asked.count() // wave)
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for k in range(waves):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(waves)) == k).toArrow()  # about `wave` rows
        number = {t: i for i, t in enumerate(sorted(set(mine.column("term").to_pylist())))}
        vocabulary = spark.sparkContext.broadcast({t.encode("utf-8", "surrogatepass"): i for t, i in number.items()})
        entries = stored(_entries(docs, vocabulary), "entries")
        sums = entries.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not sums[0]:
            break
        holding = entries.select(F.explode("terms").alias("t")).groupBy("t").count().collect()  # a row for each of the wave's terms
        weights = np.zeros(len(number), np.int64)
        for t, df in holding:
            weights[t] = math.floor(1000 * math.log((2 * sums[0] + 2) / (2 * df + 1)))
        by_item: dict[int | None, tuple[list[int], list[int]]] = {}
        for item, term, mult in zip(*(mine.column(c).to_pylist() for c in ("item_id", "term", "mult")), strict=True):
            for held, x in zip(by_item.setdefault(item, ([], [])), (number[term], mult), strict=True):
                held.append(x)
        rows = [(item, *lists) for item, lists in by_item.items()]
        shared = spark.sparkContext.broadcast((rows, weights, int(sums[0]), int(sums[1])))
        found = found.unionByName(_product(entries, shared, top))
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item."""
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS w FROM documents),
ln AS (SELECT row, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
st AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM ln),
tf AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(w) AS term FROM d) GROUP BY row, term),
it AS (SELECT item_id, term, count(*)::BIGINT AS mult FROM (
  SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term),
wt AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term), st),
sc AS (SELECT item_id, row, sum(mult * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))))::BIGINT AS score
       FROM it JOIN wt USING (term) JOIN tf USING (term) JOIN ln USING (row), st GROUP BY item_id, row),
rk AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM sc JOIN ln USING (row) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM rk WHERE rank <= {TOP}
"""
