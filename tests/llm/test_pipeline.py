"""The pipeline's stages, each against a plain version on the rows the stage before left."""

import math
import re
from collections import Counter, defaultdict
from hashlib import md5

import pytest
from pyspark.sql import Row

from clustrel.llm import mixing, packing

from . import helpers as H

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_rules(rows):
    out = []
    for r in rows:
        t = r["text"] or ""
        w = H.words(t)
        chars = "".join(w)
        win = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if win[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if H.words(x)]
        bad = (
            len(w) < 20 or 100 * len(covered) > 30 * len(w) or 100 * len(re.findall(r"[#*$%&|<>]", chars)) > 20 * len(w)
            or 100 * (len(lines) - len(set(lines))) > 50 * len(lines) or len(chars) > 12 * len(w) or len(chars) < 2 * len(w)
            or 100 * len(re.findall("[A-Z]", chars)) > 40 * len(chars) or 100 * len(re.findall("[0-9]", chars)) > 50 * len(chars)
        )
        if not bad:
            out.append(r)
    return out


def plain_lines(rows):
    seen, out = {}, []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        ls = r["text"].split("\n")
        at = [k for k, x in enumerate(ls) if H.words(x)]
        gone = set()
        for p in range(len(at) - 2):
            if seen.setdefault(tuple(ls[k] for k in at[p : p + 3]), (r["doc_id"], p)) != (r["doc_id"], p):
                gone.update(at[p : p + 3])
        text = "\n".join(x for k, x in enumerate(ls) if k not in gone)
        if not gone or H.words(text):
            out.append(r | {"text": text, "n_chars": len(text)})
    return out


def plain_near(rows):
    comp, _ = H.components([(r["doc_id"], r["text"]) for r in rows], 5, 4, 5)
    return [r for r in rows if comp[r["doc_id"]] == r["doc_id"]]


def plain_mixture(rows):
    size = {r["doc_id"]: len(H.words(r["text"])) for r in rows}
    own = defaultdict(list)
    for r in rows:
        own[r["source"]].append(r)
    order = [*sorted(s for s in own if s is not None), *([None] if None in own else [])]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total = {s: sum(size[r["doc_id"]] for r in own[s]) for s in order}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * total[s]}
        if not full:
            target |= share
            break
        target |= {s: 2 * total[s] for s in full}
        left -= sum(2 * total[s] for s in full)
        open_ -= full
    out = []
    for s in order:
        epochs = math.floor(target[s] / total[s]) if total[s] else 0
        budget = math.floor(target[s] - epochs * total[s])

        def key(r):
            u = (int(md5(str(r["doc_id"]).encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            n = size[r["doc_id"]]
            return -math.log(u) / max(0.05, 1 - len(re.findall(r"[#*$%&|<>]", r["text"])) / max(n, 1))

        for r in sorted(own[s], key=lambda r: (key(r), r["doc_id"])):
            n = size[r["doc_id"]]
            part = min(n, budget)
            budget -= part
            out += [r] * (epochs if n else 0)
            if part == n and n:
                out.append(r)
            elif part:
                text = " ".join(H.words(r["text"])[:part])
                out.append(r | {"text": text, "n_chars": len(text)})
    return out


def plain_pack(lengths):
    """Best fit, one piece after the other, by looking at every open bin."""
    caps, left, bins = sorted(packing.CAPACITIES), sum(lengths), []
    for n in lengths:
        fits = [b for b in bins if b[0] - sum(b[1]) >= n]
        if fits:
            best = min(fits, key=lambda b: (b[0] - sum(b[1]), bins.index(b)))
        else:
            cost = lambda c: (packing.price(c, caps[-1]) / min(c, left), -c)  # noqa: B023, E731
            best = [min((c for c in caps if c >= n), key=cost), []]
            bins.append(best)
        best[1].append(n)
        left -= n
    return sorted((min(c for c in caps if c >= sum(b)), tuple(sorted(b))) for _, b in bins)


def as_dicts(rows):
    return [r.asDict() if isinstance(r, Row) else dict(zip(NAMES, r, strict=True)) for r in rows]


def multiset(rows):
    return Counter(tuple(r[n] for n in NAMES) for r in rows)


@pytest.fixture(scope="module")
def stages():
    return dict(pytest.importorskip("corpus_pipeline").STAGES)


def test_every_stage_equals_a_plain_version(spark, stages):
    rows = as_dicts(H.corpus(400, 3))
    docs = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], H.SCHEMA)
    for (name, stage), plain in zip(list(stages.items())[:4], (plain_rules, plain_lines, plain_near, plain_mixture), strict=True):
        want = plain(rows)
        got = stage(spark, docs, "")
        assert got.columns == NAMES
        rows = as_dicts(got.collect())
        assert multiset(rows) == multiset(want), name
        assert 0 < len(rows) and rows != []
        docs = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], H.SCHEMA)
    placed = stages["best-fit packing"](spark, docs, "").toPandas()
    assert Counter(placed.groupby("doc_id").length.sum().to_dict()) == Counter({i: sum(len(H.words(r["text"])) for r in rows if r["doc_id"] == i) for i in {r["doc_id"] for r in rows}})
    for _, block in placed[placed.bin.notna()].groupby("block"):
        got = sorted((int(b.capacity.iloc[0]), tuple(sorted(b.length.tolist()))) for _, b in block.groupby("bin"))
        assert got == plain_pack(sorted(block.length.tolist(), reverse=True))


def test_the_whole_pipeline_and_empty_documents(spark, stages, tmp_path):
    import corpus_pipeline

    for name, rows in (("some", H.corpus(60, 5)), ("none", [])):
        spark.createDataFrame(rows, H.SCHEMA).write.parquet(str(tmp_path / name / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name))
        assert got.count() > 0 if rows else got.count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]


def test_weights_follow_symbols(spark):
    df = spark.createDataFrame([("a b c d",), ("a # b c",), (None,)], "text string")
    from clustrel.llm.common import n_words

    assert [r[0] for r in df.select(mixing.quality_weight(df.text, n_words(df.text))).collect()] == [1.0, 0.75, 1.0]
