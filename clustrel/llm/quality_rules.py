"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per
rule; a policy is a named, versioned mask over those bits, so that policies are applied, compared and
ablated from the ledger without reading a text again. Only DataFrame functions are used.

Edge cases: a null text counts as an empty one; texts without words fail ``few_words``; repeated rows
are judged each for itself; an empty table gives an empty ledger; other columns pass through untouched
unless they bear the name of a ledger column, in which case the ledger's column replaces them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clustrel.llm.common import documents, filtered, words

#: Rules in bit order: name and the SQL condition, over the measurements, that fails a document.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 20 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("long_words", "word_chars > 12 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("capitals", "100 * n_capitals > 40 * word_chars"),
    ("digits", "100 * n_digits > 50 * word_chars"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Versioned policies: the bits any of which rejects a document.
POLICIES: dict[str, int] = {
    "base-1": BIT["few_words"] | BIT["repeated_words"],
    "full-1": sum(BIT.values()),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_digits")
WINDOW = 8


def _repeated(sorted_windows: Column) -> Column:
    """Start positions, ascending, of the windows whose hash another window of the text has too."""
    same = lambda x, at: F.coalesce(F.get(sorted_windows, at)["h"] == x["h"], F.lit(False))
    hits = F.filter(sorted_windows, lambda x, i: same(x, i - 1) | same(x, i + 1))
    return F.sort_array(F.transform(hits, lambda x: x["i"]))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements of every rule; the text is split once.

    Windows are compared by a 64-bit hash within one text.
    """
    mark = "__"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    w, win, kept_lines, letters, twice, ordered, starts = (mark + n for n in ("words", "windows", "lines", "chars", "dups", "sorted", "starts"))
    own = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(own, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.drop(*(m for m in MEASURES if m in docs.columns))
    out = out.withColumns({w: words(F.col(text)), kept_lines: lines})
    hashes = F.when(
        F.size(w) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(F.col(w), i + k) for k in range(WINDOW)))),
    ).otherwise(F.array().cast("array<bigint>"))
    chars = F.array_join(w, "")
    out = out.withColumns({
        "n_words": F.size(w).cast("long"),
        letters: chars,
        "n_lines": F.size(kept_lines).cast("long"),
        "n_dup_lines": (F.size(kept_lines) - F.size(F.array_distinct(kept_lines))).cast("long"),
        win: hashes,
    }).drop(kept_lines)
    count = lambda pattern: F.regexp_count(F.col(letters), F.lit(pattern)).cast("long")
    out = out.withColumns({
        "word_chars": F.char_length(letters).cast("long"),
        "n_symbols": count(r"[#*$%&|<>]"),
        "n_capitals": count(r"[A-Z]"),
        "n_digits": count(r"[0-9]"),
        twice: F.size(F.array_distinct(win)) < F.size(win),
    }).drop(w, letters)
    out = out.withColumn(ordered, F.when(F.col(twice), F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop(win)
    out = out.withColumn(starts, F.when(F.col(twice), _repeated(F.col(ordered)))).drop(ordered)
    covered = F.aggregate(
        F.sequence(F.lit(1), F.size(starts) - 1),
        F.lit(WINDOW),
        lambda n, i: n + F.least(F.lit(WINDOW), F.get(F.col(starts), i) - F.get(F.col(starts), i - 1)),
    )
    out = out.withColumn("n_repeat_words", F.when(F.col(twice), covered).otherwise(0).cast("long"))
    return out.drop(starts, twice)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements and ``fail_bits``: bit i is set where rule i of RULES fails."""
    bits = " | ".join(f"if({rule}, {1 << i}L, 0L)" for i, (_, rule) in enumerate(RULES))
    return measure(docs, text).withColumn("fail_bits", F.expr(bits))


def passes(mask: int) -> Column:
    """Whether a ledger row survives the policy of that mask."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask)) == 0


def apply_policies(led: DataFrame, policies: Mapping[str, int] = POLICIES) -> DataFrame:
    """The ledger with a map column ``kept_by``: policy name to verdict."""
    pairs = [x for name, mask in policies.items() for x in (F.lit(name), passes(mask))]
    return led.withColumn("kept_by", F.create_map(*pairs))


def ablations(led: DataFrame, mask: int) -> DataFrame:
    """What each rule of a policy contributes, in one aggregation over the ledger.

    rule, failed (documents that fail it), sole (documents only this rule rejects: what leaving it out
    would bring back), all_rejected (documents the policy rejects).
    """
    own = F.col("fail_bits").bitwiseAND(F.lit(mask))
    names = [name for name, bit in BIT.items() if bit & mask]
    aggs = [F.count_if(own != 0).alias("all_rejected")]
    for name in names:
        aggs += [F.count_if(own.bitwiseAND(F.lit(BIT[name])) != 0).alias(f"f_{name}"), F.count_if(own == BIT[name]).alias(f"s_{name}")]
    rows = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("failed"), F.col(f"s_{n}").alias("sole")) for n in names))
    return led.agg(*aggs).select(F.inline(rows), "all_rejected") if names else led.sparkSession.createDataFrame([], "rule string, failed long, sole long, all_rejected long")


def keep_good(docs: DataFrame, mask: int = POLICIES["full-1"]) -> DataFrame:
    """The rows of docs, with their own columns only, that the policy keeps."""
    own = docs.columns
    boxed = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.col("text"))
    return filtered(ledger(boxed), passes(mask)).select("row.*")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The ledger of all documents with the base verdict and that of policy full-1."""
    led = ledger(documents(spark, sf_dir).select("doc_id", "text"))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(POLICIES["base-1"])).alias("base_failed"),
        passes(POLICIES["full-1"]).alias("kept"),
        "n_lines", "n_capitals", "n_digits", "fail_bits",
    )


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, list_slice(w, i, i + 7) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM w)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win),
starts AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice WHERE c > 1),
rep AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM starts GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines, len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_capitals,
         len(regexp_extract_all(text, '[0-9]'))::BIGINT AS n_digits
  FROM w LEFT JOIN rep USING (doc_id)),
b AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 12 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_capitals > 40 * word_chars THEN 64 ELSE 0 END
    + CASE WHEN 100 * n_digits > 50 * word_chars THEN 128 ELSE 0 END)::BIGINT AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, n_lines, n_capitals, n_digits, fail_bits FROM b
"""
