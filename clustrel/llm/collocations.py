"""Phrases whose words occur together more often than their parts would by chance.

Identical pieces of text (between marks or line ends, per language) become one row with a multiplicity. Phrases
are then counted by length, one word first: a task numbers the words of some million at a time, makes equal
phrases one by exact pairs of numbers, and passes on text and weight; these are dealt by a hash of language and
phrase, and each bucket is summed by duckdb in a file of its own, with a bound on memory. A phrase can only be
frequent if its words but the last, and but the first, are: a bit array of fixed size over the frequent phrases
of the length before (about which it may err on one side only) spares the others the way to a bucket.

All parts of a frequent phrase are frequent, so the counts a score needs lie in the table of counts already:
candidates send a lookup request for every part, requests meet counts in a join by language and part, and come
back by candidate.

Edge cases: a null text has no pieces, a null language is ``und``; repeated rows count each time; pieces
without words are dropped; empty tables give no rows; other columns aren't read. Phrases are compared whole,
never by a hash alone. Very long pieces are one row, whole.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clustrel.llm import hashing
from clustrel.llm.common import documents, forget, stored

LONGEST, LEAST, TOP = 5, 100, 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that a task numbers at a time, about.
CHUNK = 1 << 20
#: Texts that a task splits at a time.
ROWS = 1 << 11
#: Bits of the filter, and of each block in which it is put together.
BITS, BLOCK = 1 << 25, 1 << 15
#: Memory of duckdb in a task; beyond it, it uses its file.
MEMORY = "256MB"
#: Buckets in which phrases of a language are ranked before their best are ranked together.
SALTS = 64
_LANG = 7


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, piece, n_words, m of the pieces of rows (lang, text), equal ones of ROWS rows once."""
    for b in (whole.slice(lo, ROWS) for whole in batches for lo in range(0, whole.num_rows, ROWS)):
        text = pc.ascii_lower(pc.fill_null(b.column("text"), ""))  # A-Z only: other bytes stay
        lists = pc.split_pattern_regex(text, r"[.,;:!?\x0A-\x0D]+")
        lang, piece = b.column("lang").take(pc.list_parent_indices(lists)), lists.flatten()
        if pc.any(pc.match_substring_regex(piece, r"\t|  ")).as_py():
            piece = pc.replace_substring_regex(piece, r"[ \t]+", " ")
        piece = pc.ascii_trim(piece, " ")
        found = pa.table({"lang": lang, "piece": piece}).filter(pc.not_equal(piece, "")).group_by(["lang", "piece"], use_threads=False).aggregate([([], "count_all")])
        for part in found.combine_chunks().to_batches():
            n = pc.add(pc.count_substring(part.column("piece"), " "), 1).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("piece"), n, part.column("count_all")], ["lang", "piece", "n_words", "m"])


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece, n_words, m: the distinct pieces of docs(text, lang), words joined by blanks, and how often each occurs."""
    rows = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text").mapInArrow(_split, "lang string, piece string, n_words long, m long")
    return rows.groupBy("lang", "piece").agg(F.min("n_words").alias("n_words"), F.sum("m").alias("m"))


def _spans(x: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of an array of strings."""
    x = x.cast(pa.large_binary())
    ends = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
    data = np.frombuffer(x.buffers()[2], np.uint8) if x.buffers()[2] else np.zeros(0, np.uint8)
    return data, ends[:-1], ends[1:]


class _Words:
    """Pieces as numbers: of each word its number, its piece and its place's room to the right; of each number its text and hash."""

    def __init__(self, lang: pa.Array, text: pa.Array, m: np.ndarray) -> None:
        lists = pc.split_pattern(text, " ")
        sizes = np.diff(lists.offsets.to_numpy())
        coded = lists.flatten().dictionary_encode()
        self.texts, self.code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        langs = lang.dictionary_encode()
        self.langs, lang_of = langs.dictionary, langs.indices.to_numpy().astype(np.int64)
        of = np.repeat(np.arange(len(sizes)), sizes)
        self.lang, self.m = lang_of[of], m[of]
        self.room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(of))  # words from here to the end of the piece
        self.hash = hashing.hashes(*_spans(self.texts))[self.code]
        self.lang_hash = hashing.hashes(*_spans(self.langs), _LANG)[self.lang]

    def hashes(self, n: int) -> np.ndarray:
        """A hash of language and phrase for each place where n words may begin; the last n - 1 places have none."""
        g = hashing.grams(self.hash, n)
        return hashing.mix(g ^ self.lang_hash[: len(g)])

    def phrases(self, n: int, held: np.ndarray | None) -> pa.RecordBatch:
        """lang, phrase, m of the distinct phrases of n words, without those that the filter of n - 1 words excludes."""
        ok = self.room >= n
        if held is not None and n > 1:
            seen = _within(held, self.hashes(n - 1))
            ok[: len(seen)] &= seen
            ok[: len(seen) - 1] &= seen[1:]
            ok[max(0, len(seen) - 1) :] = False
        at = np.flatnonzero(ok)
        key = self.lang[at]
        for k in range(n):
            key = np.unique(key * len(self.texts) + self.code[at + k], return_inverse=True)[1]
        first = np.zeros(int(key.max(initial=-1)) + 1, np.int64)
        first[key] = at
        m = np.zeros(len(first), np.int64)
        np.add.at(m, key, self.m[at])
        words = [self.texts.take(pa.array(self.code[first + k])) for k in range(n)]
        phrase = pc.binary_join_element_wise(*words, " ") if n > 1 else words[0]
        return pa.RecordBatch.from_arrays([self.langs.take(pa.array(self.lang[first])), phrase, pa.array(m)], ["lang", "phrase", "m"])


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(BITS - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(BITS - 1)).astype(np.int64)


def _within(held: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set."""
    a, b = _places(h)
    return ((held[a >> 3] >> (a & 7).astype(np.uint8)) & (held[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def _filter(frequent: DataFrame) -> np.ndarray:
    """The bits of all phrases of frequent(lang, phrase), BITS / 8 bytes, put together block by block by tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS // 8, np.uint8)
        for b in batches:
            if b.num_rows:
                w = _Words(b.column("lang"), b.column("phrase"), np.zeros(b.num_rows, np.int64))
                first = np.flatnonzero(np.append(True, w.room[:-1] == 1))
                n = int(w.room[0])
                for place in _places(w.hashes(n)[first]):
                    np.bitwise_or.at(bits, place >> 3, np.left_shift(1, place & 7).astype(np.uint8))
        blocks = bits.reshape(-1, BLOCK // 8)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([blocks[k].tobytes() for k in used], pa.binary())], ["block", "bits"])

    def join(rows: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in rows.column("bits").to_pylist()])
        return pa.table({"block": rows.column("block")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    out = np.zeros((BITS // BLOCK, BLOCK // 8), np.uint8)
    for r in frequent.mapInArrow(run, "block long, bits binary").groupBy("block").applyInArrow(join, "block long, bits binary").collect():  # BITS / 8 bytes in all
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _emitted(rows: DataFrame, n: int, held) -> DataFrame:
    """lang, phrase, m of the phrases of n words, equal ones of a task's chunk once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, gathered, size = held.value if held else None, [], 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(gathered).combine_chunks()
            lang, text = (t.column(c).combine_chunks() if t.num_rows else pa.array([], pa.string()) for c in ("lang", "piece"))
            return _Words(lang, text, t.column("m").to_numpy()).phrases(n, bits)

        for b in batches:
            gathered.append(b.select(["lang", "piece", "m"]))
            size += int(pc.sum(b.column("n_words")).as_py() or 0)
            if size >= CHUNK:
                yield out()
                gathered, size = [], 0
        if size:
            yield out()

    return rows.where(F.col("n_words") >= n).select("lang", "piece", "m", "n_words").mapInArrow(run, "lang string, phrase string, m long")


def _summed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """lang, phrase, f of a bucket of (lang, phrase, m): duckdb sums it in a file of the task's own folder, which goes when the task ends."""
    import duckdb

    filled = (b for b in batches if b.num_rows)
    first = next(filled, None)
    if first is None:
        return
    with tempfile.TemporaryDirectory() as at:
        con = duckdb.connect(os.path.join(at, "bucket.duckdb"), config={"threads": 1, "memory_limit": MEMORY, "temp_directory": os.path.join(at, "spill"), "preserve_insertion_order": False})
        try:
            con.execute("CREATE TABLE counts (lang VARCHAR, phrase VARCHAR, m BIGINT)")
            for b in chain([first], filled):
                part = pa.Table.from_batches([b])  # noqa: F841  duckdb reads it by name
                con.execute("INSERT INTO counts SELECT lang, phrase, m FROM part")
            found = con.sql(f"SELECT lang, phrase, sum(m)::BIGINT AS f FROM counts GROUP BY lang, phrase HAVING sum(m) >= {int(least)}")
            yield from found.to_arrow_reader(1 << 16)
        finally:
            con.close()


def frequent(rows: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """lang, phrase, words, f of all phrases of 1 to ``longest`` words that occur at least ``least`` times in rows of ``pieces``."""
    spark = rows.sparkSession
    found, held = None, None
    for n in range(1, longest + 1):
        sent = _emitted(rows, n, held).repartition("lang", "phrase")
        counted = stored(sent.mapInArrow(lambda batches: _summed(batches, least), "lang string, phrase string, f long"), f"phrases{n}")
        found = (lambda x: found.unionByName(x) if found else x)(counted.withColumn("words", F.lit(n)))
        if n < longest:
            if counted.isEmpty():
                break
            held = spark.sparkContext.broadcast(_filter(counted.select("lang", "phrase")))
    return found


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every candidate of counts(lang, phrase, words, f), at its lowest cut; totals(lang, n)."""
    split = F.split("phrase", " ")
    cuts = counts.where("words >= 2").select("lang", "phrase", F.col("f").alias("a"), split.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = F.array(
        F.struct(F.lit(True).alias("first"), F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("part")),
        F.struct(F.lit(False).alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("part")),
    )
    asked = cuts.select("lang", "phrase", "a", "k", F.explode(sides).alias("s")).select("lang", "phrase", "a", "k", "s.*")
    told = asked.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    per = told.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    whole = per.join(totals, "lang").withColumns({"up": wide("a") * wide("n") * F.lit(1000), "down": wide("l") * wide("r")})
    whole = whole.withColumn("score", F.expr("up div down"))
    best = whole.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")


def absorbed(counts: DataFrame) -> DataFrame:
    """lang, phrase of the candidates that some longer one contains and that occur no more often than it.

    A longer phrase that occurs as often as one within it has one such of each length between, so looking at one more word is enough.
    """
    w = F.split("phrase", " ")
    inner = F.array(F.array_join(F.slice(w, F.lit(1), F.size(w) - 1), " "), F.array_join(F.slice(w, F.lit(2), F.size(w) - 1), " "))
    longer = counts.where("words >= 3").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    return counts.join(longer, ["lang", "phrase"]).where("100 * most >= 100 * f").select("lang", "phrase")


def mine(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language of docs(text, lang)."""
    rows = stored(pieces(docs), "pieces")
    totals = stored(rows.groupBy("lang").agg(F.sum(F.col("m") * F.col("n_words")).alias("n")), "totals")
    counts = frequent(rows, longest, least)
    forget(rows)
    left = scored(counts, totals).join(absorbed(counts), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    left = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    left = left.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of all documents."""
    return mine(documents(spark, sf_dir))


def _grams_sql() -> str:
    one = "SELECT lang, array_to_string(w[i:i + {k}], ' ') AS phrase, {n} AS words, sum(m)::BIGINT AS f FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - {k})) AS i FROM p) GROUP BY 1, 2"
    return " UNION ALL ".join(one.format(n=n, k=n - 1) for n in range(1, LONGEST + 1))


OP12_SQL = rf"""
WITH x AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, w, count(*) AS m FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM x) WHERE len(w) > 0 GROUP BY lang, w),
tot AS (SELECT lang, sum(m * len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS MATERIALIZED (SELECT * FROM ({_grams_sql()}) WHERE f >= {LEAST}),
c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(generate_series(1, words - 1)) AS k FROM g WHERE words >= 2),
s AS (SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, n, ((1000::HUGEINT * c.a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score FROM c JOIN tot USING (lang)
      JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ') JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inn AS (SELECT lang, array_to_string(w[i:j], ' ') AS phrase, max(f) AS most FROM (
          SELECT lang, f, w, i, unnest(generate_series(i + 1, least(len(w), i + len(w) - 2))) AS j FROM (SELECT lang, f, string_split(phrase, ' ') AS w, unnest(generate_series(1, words)) AS i FROM g WHERE words >= 3))
        WHERE j - i + 1 < len(w) GROUP BY 1, 2),
k AS (SELECT b.* FROM b LEFT JOIN inn USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM k QUALIFY rank <= {TOP}
"""
