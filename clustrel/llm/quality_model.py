"""A quality classifier: a generalised additive model with pairwise interactions.

Texts become a few numeric features; each feature's range is cut at quantiles into bins. Shallow trees,
grown in turn on one feature at a time, add small steps to that feature's lookup table, round after round;
then the pairs of features that explain most of what is left get tables of their own, by shallow trees
that cut along one of the two and, on each side, along the other. A score
is the logistic of an intercept and the sums of the tables' entries at the row's bins, so scoring is a few
additions per row over whole arrays.

The model is fitted on the driver from a bounded sample: about SAMPLE labelled rows at most, chosen by a hash
of their ids, whatever the input's size. Everything else covers all rows.

Edge cases: a null text counts as an empty one and is scored like any other; rows without a label, or with
one that is neither 0 nor 1, aren't learned from; without any labelled rows, or with one class alone, every
score is the smoothed share of label 1; repeated rows are scored alike; an empty table gives no rows; columns
other than id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clustrel.llm import hashing
from clustrel.llm.common import documents, stored

#: At most about so many labelled rows are fitted on: 20,000 rows of 20 numbers on the driver.
SAMPLE = 20_000
THRESHOLD = 0.3
FEATURES = (
    "log_words", "word_length", "symbols", "repeated_lines", "repeated_grams", "distinct_words", "capitals", "digits", "points",
    "exclamations", "bars", "line_words", "short_words", "long_words", "non_ascii", "byte_entropy", "commonest_word",
)
_KIND = np.zeros((256, 6))  # capitals, digits, points, exclamations, bars, symbols
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?", b"!", b"|", b"#*$%&|<>")):
    _KIND[list(_chars), _k] = 1


def features(text: str | None) -> np.ndarray:
    """The features of a text, by FEATURES; of an empty one, zeros."""
    out = np.zeros(len(FEATURES))
    data = (text or "").encode("utf-8", "surrogatepass")
    starts, ends, h = hashing.words(data)
    n = len(h)
    if not n:
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars = int(counts[:128].sum() + counts[192:].sum())
    share = counts[counts > 0] / len(data)
    per = counts @ _KIND
    lengths = ends - starts
    _, of = np.unique(h, return_counts=True)
    g = hashing.grams(h, 8)
    lines = [x for x in data.split(b"\n") if x.strip()]
    out[:] = (
        np.log1p(n), lengths.sum() / n, per[5] / n, 1 - len(set(lines)) / len(lines), 1 - len(np.unique(g)) / len(g) if len(g) else 0, len(of) / n,
        per[0] / chars, per[1] / chars, per[2] / n, per[3] / n, per[4] / n, n / len(lines), np.mean(lengths <= 2), np.mean(lengths >= 12),
        counts[192:].sum() / chars, -(share * np.log2(share)).sum(), of.max() / n,
    )
    return out


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and x, the array of features, for every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column("text")]).reshape(-1, len(FEATURES))
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<double>")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """A shallow tree over ordered bins: the step of each bin, from the sums of gradients and curvatures by bin."""
    step = np.zeros(len(grad))
    spans = [(0, len(grad))]
    value = lambda g, h: g * g / (h + 1.0)
    while len(spans) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(spans):
            if b - a < 2:
                continue
            g, h = np.cumsum(grad[a:b]), np.cumsum(hess[a:b])
            gain = value(g[:-1], h[:-1]) + value(g[-1] - g[:-1], h[-1] - h[:-1]) - value(g[-1], h[-1])
            gain[(h[:-1] < least) | (h[-1] - h[:-1] < least)] = 0
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], k, a + at + 1)
        if best[1] is None:
            break
        a, b = spans.pop(best[1])
        spans += [(a, best[2]), (best[2], b)]
    for a, b in spans:
        step[a:b] = grad[a:b].sum() / (hess[a:b].sum() + 1.0)
    return step


def _pair_tree(grad: np.ndarray, hess: np.ndarray, least: float) -> np.ndarray:
    """A shallow tree over the cells of two features: one cut along either feature, then a cut of its own on each side along the other."""
    value = lambda g, h: g * g / (h + 1.0)
    best, step = 1e-9, np.zeros_like(grad)
    for turned in (False, True):
        g, h = (grad.T, hess.T) if turned else (grad, hess)
        halves = []
        for flip in (1, -1):  # sums of the rows before each cut, and of those after it
            gs, hs = (np.cumsum(x[::flip], axis=0)[:-1][::flip] for x in (g, h))
            gc, hc = np.cumsum(gs, axis=1), np.cumsum(hs, axis=1)
            gain = value(gc, hc) + value(gc[:, -1:] - gc, hc[:, -1:] - hc)
            gain[:, :-1][(hc[:, :-1] < least) | (hc[:, -1:] - hc[:, :-1] < least)] = -np.inf
            halves.append((gain.argmax(axis=1), gain.max(axis=1)))  # a cut after the last cell is none
        if not len(halves[0][0]):
            continue
        total = halves[0][1] + halves[1][1] - value(g.sum(), h.sum())
        at = int(total.argmax())
        if total[at] > best:
            best, out = total[at], np.zeros_like(g)
            for rows, (cuts, _) in zip((slice(0, at + 1), slice(at + 1, None)), halves, strict=True):
                for cells in (slice(0, cuts[at] + 1), slice(cuts[at] + 1, None)):
                    if g[rows, cells].size:
                        out[rows, cells] = g[rows, cells].sum() / (h[rows, cells].sum() + 1.0)
            step = out.T if turned else out
    return step


class Additive:
    """Lookup tables by feature and by pair of features."""

    def __init__(self, bins: int = 48, pair_bins: int = 8, pairs: int = 6, rounds: int = 150, rate: float = 0.15) -> None:
        self.bins, self.pair_bins, self.n_pairs, self.rounds, self.rate = bins, pair_bins, pairs, rounds, rate
        self.base, self.cuts, self.tables, self.coarse, self.pairs = 0.0, [], [], [], {}

    def fit(self, x: np.ndarray, y: np.ndarray) -> Additive:
        p = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(p / (1 - p)))
        if len(y) < 20 or y.min() == y.max():
            return self
        q = lambda k: [np.unique(np.quantile(c, np.linspace(0, 1, k + 1)[1:-1])) for c in x.T]
        self.cuts, self.coarse = q(self.bins), q(self.pair_bins)
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        at = [np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T, strict=True)]
        z = np.full(len(y), self.base)
        for _ in range(self.rounds):
            for f, b in enumerate(at):
                r = _sigmoid(z)
                g = np.bincount(b, y - r, len(self.tables[f]))
                h = np.bincount(b, r * (1 - r), len(self.tables[f]))
                step = self.rate * _tree(g, h, 3, 1.0)
                self.tables[f] += step
                z += step[b]
        low = [np.searchsorted(c, v, side="right") for c, v in zip(self.coarse, x.T, strict=True)]
        cell = lambda i, j: low[i] * (len(self.coarse[j]) + 1) + low[j]
        size = lambda i, j: (len(self.coarse[i]) + 1) * (len(self.coarse[j]) + 1)
        r = _sigmoid(z)

        def gain(ij: tuple[int, int]) -> float:
            g, h = np.bincount(cell(*ij), y - r, size(*ij)), np.bincount(cell(*ij), r * (1 - r), size(*ij))
            return float((g * g / (h + 1.0)).sum())

        chosen = sorted(combinations(range(x.shape[1]), 2), key=gain, reverse=True)[: self.n_pairs]
        self.pairs = {ij: np.zeros(size(*ij)) for ij in chosen}
        for _ in range(self.rounds):
            for ij, table in self.pairs.items():
                r = _sigmoid(z)
                b = cell(*ij)
                g, h = np.bincount(b, y - r, len(table)), np.bincount(b, r * (1 - r), len(table))
                shape = (len(self.coarse[ij[0]]) + 1, len(self.coarse[ij[1]]) + 1)
                step = self.rate * _pair_tree(g.reshape(shape), h.reshape(shape), 1.0).ravel()
                table += step
                z += step[b]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row."""
        z = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            z += table[np.searchsorted(self.cuts[f], x[:, f], side="right")]
        if self.pairs:
            low = [np.searchsorted(c, v, side="right") for c, v in zip(self.coarse, x.T, strict=True)]
            for (i, j), table in self.pairs.items():
                z += table[low[i] * (len(self.coarse[j]) + 1) + low[j]]
        return _sigmoid(z)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: the CRC-32 of its id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(x: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Additive:
    """A model of labels(doc_id, quality) over x(doc_id, x), of rows that aren't held out."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    n = known.count()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(max(1, (sample << 20) // max(n, 1)))
    rows = known.where(share).join(x.where(share), "doc_id").orderBy("doc_id", "quality").toPandas()
    model = Additive()
    return model.fit(np.array(rows["x"].tolist()).reshape(-1, len(FEATURES)), rows["quality"].to_numpy(float))


def scored(x: DataFrame, model: Additive) -> DataFrame:
    """x(doc_id, x) with the model's score; the model, some thousand numbers, goes along by broadcast."""
    held = x.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(col: pa.Array) -> pa.Array:
        flat = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
        return pa.array(held.value.score(flat))

    return x.withColumn("score", score("x"))


def op4_quality_model(spark, sf_dir: str) -> DataFrame:
    """The score of all documents."""
    x = stored(featured(documents(spark, sf_dir)), "features")
    model = fit(x, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(x, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
