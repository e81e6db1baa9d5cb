"""Each operator against a plain version, on rows with nulls, empty and long texts, ties, copies and clashing columns."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clustrel.llm import jaccard_join, license_scan, line_dedup, mixing, packing, quality_model, quality_rules, secrets, token_counts
from clustrel.llm.common import n_words
from clustrel.llm.components import components

from . import helpers as H


@pytest.fixture(scope="module")
def rows():
    return H.corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, H.SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], H.SCHEMA)


def test_rules_measure_what_plain_code_does(docs, rows):
    got = {r["doc_id"]: r for r in quality_rules.ledger(docs.withColumn("fail_bits", F.lit("clash"))).collect()}
    for i, t, *_ in rows:
        w = H.words(t)
        win = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if win[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if H.words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t
        assert bool(r["fail_bits"] & 3) == (len(w) < 20 or 100 * len(covered) > 30 * len(w))


def test_policies_and_ablations_follow_the_bits(docs):
    led = quality_rules.ledger(docs).cache()
    all_ = led.select("fail_bits").toPandas()["fail_bits"].to_numpy()
    mask = quality_rules.POLICIES["full-1"]
    for r in quality_rules.ablations(led, mask).collect():
        bit = quality_rules.BIT[r["rule"]]
        assert (r["failed"], r["sole"], r["all_rejected"]) == (int((all_ & bit > 0).sum()), int((all_ & mask == bit).sum()), int((all_ & mask > 0).sum()))
    kept = led.where(quality_rules.passes(mask)).count()
    assert quality_rules.keep_good(docs).count() == kept == quality_rules.apply_policies(led).where("kept_by['full-1']").count()


def test_lines_covered_by_later_windows_go(docs, rows):
    seen, want = {}, {}
    for i, t, *_ in sorted(rows):
        if t is None:
            continue
        at = [k for k, x in enumerate(t.split("\n")) if H.words(x)]
        ls = t.split("\n")
        gone = set()
        for p in range(len(at) - 2):
            key = tuple(ls[k] for k in at[p : p + 3])
            if seen.setdefault(key, (i, p)) != (i, p):
                gone.update(at[p : p + 3])
        want[i] = ("\n".join(x for k, x in enumerate(ls) if k not in gone), len(gone))
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup(docs).collect()}
    assert got.pop(next(i for i, t, *_ in rows if t is None)) == (None, 0)
    assert got == want and sum(n for _, n in want.values()) > 20


@pytest.mark.parametrize("k,num,den,block", [(4, 85, 100, 2048), (5, 4, 5, 3)])
def test_join_equals_all_pairs(docs, rows, monkeypatch, k, num, den, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    want, sizes = H.components(rows, k, num, den)
    got = jaccard_join.join(docs, k, num, den).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert len(set(want.values())) < len(want) - 20


@pytest.mark.parametrize("rough,num,den", [(1 << 14, 85, 100), (7, 85, 100), (7, 2, 5)])
def test_clusters_chained_by_shared_passages_send_texts_once(spark, monkeypatch, rough, num, den):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared = " ".join(word() for _ in range(14))
    texts = [" ".join([*(word() for _ in range(rng.randint(9, 40))), shared]) for _ in range(150)]
    texts += [t + " " + word() for t in texts[:20]] + texts[:3]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    sent, compared = [], jaccard_join._compared
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 4)
    monkeypatch.setattr(jaccard_join, "ROUGH_SETS", rough, raising=False)
    monkeypatch.setattr(jaccard_join, "_compared", lambda d, *a: sent.append(d.count()) or compared(d, *a))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(spark.createDataFrame(rows, H.SCHEMA).repartition(3), 4, num, den).collect()}
    assert got == H.components(rows, 4, num, den)[0]
    assert den == 5 or 0 < sent[0] <= 80  # of 150 texts chained together each went to several tasks


def test_bitmaps_keep_no_linked_sets_apart():
    rng = np.random.default_rng(4)
    sets = []
    for n in (3, 200, 255, 257, 300, 510, 514, 2000):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        sets += [x, np.unique(np.append(x[: n - n // 12], rng.integers(0, 1 << 63, n // 12).astype(np.uint64))), x[: n - n // 8]]
    sizes = np.array([len(x) for x in sets])
    for block in (np.zeros(len(sets), int), np.arange(len(sets)) % 2):
        root = list(range(len(sets)))
        for i, j in jaccard_join._near(sizes, [jaccard_join.rough(x) for x in sets], block, 4, 5):
            root = [root[i] if r == root[j] else r for r in root]
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                both = len(np.intersect1d(x, y))
                if 5 * both >= 4 * (len(x) + len(y) - both) and (not block.any() or block[i] != block[j]):
                    assert root[i] == root[j]
        assert len(set(root)) >= 8


def test_linked_sets_always_share_a_file():
    rng = np.random.default_rng(0)
    tiles = jaccard_join.Tiles(85, 100)
    for n in (7, 8, 13, 20, 41, 100, 500):
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            b = a.copy()
            while 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)):
                last = b
                b = np.sort(np.append(np.delete(b, rng.integers(len(b))), rng.integers(0, 2**63, 1).astype(np.uint64)))
            x, y = set(tiles.files(a).tolist()), set(tiles.files(np.unique(last)).tolist())
            assert np.array_equal(a, last) or x & y


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(300)] + [(900, 901), (901, 900), (7, 7)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {900: 900, 901: 900}


def test_mix_meets_its_targets(docs, rows):
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.lit(1.0).alias("weight"))
    got = mixing.mix(sized).toPandas()
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(H.words(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            target |= share
            break
        target |= {s: 2 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    for s, own in got.groupby("source", dropna=False):
        s = s if isinstance(s, str) else None
        assert own["target"].iloc[0] == pytest.approx(target[s]) and own["source_size"].iloc[0] == sizes[s]
        assert abs(own["taken"].sum() - target[s]) <= 1
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] >= got["epochs"] * got["size"]).all()


def test_applied_mix_takes_the_same_words(docs):
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), mixing.quality_weight(F.col("text"), n_words(F.col("text"))).alias("weight"))
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(sized).collect() if r["taken"]}
    got = Counter()
    out = mixing.apply_mix(docs)
    for r in out.collect():
        got[r["doc_id"]] += len(H.words(r["text"]))
    assert out.columns == docs.columns and got == want


def test_heavier_documents_come_first_more_often(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("size"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.2).alias("weight"))
    got = mixing.mix(rows, (1,), 0.3, 2).where("taken > 0").groupBy((F.col("doc_id") % 2).alias("odd")).count().collect()
    n = {r["odd"]: r["count"] for r in got}
    assert n[0] + n[1] == 1200 and n[0] > 2.5 * n[1]


@pytest.mark.parametrize("block", [16, 8192])
def test_packing_is_whole_and_within_capacity(docs, rows, block):
    caps = (16, 64, 128)
    got = packing.pack_documents(docs, n_words(F.col("text")), caps, block).toPandas()
    for i, t, *_ in rows:
        own = got[got.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(H.words(t)) and (own.start == own.length.cumsum() - own.length).all()
    bins = got[got.bin.notna()].groupby(["block", "bin"])
    for _, own in bins:
        own = own.sort_values("offset")
        assert (own.offset == own.length.cumsum() - own.length).all()
        used, cap = own.length.sum(), own.capacity.iloc[0]
        assert own.capacity.nunique() == 1 and cap == min(c for c in caps if c >= used)
    if block > 1000:
        assert got.length.sum() > 0.9 * bins.capacity.first().sum()


def test_secrets_keep_every_base_span():
    rng = random.Random(4)
    parts = ["token", "a", "0", "9", "0123456789abcdef", "=", " ", ":", "AKIA", "ABCDEFGH12345", "İ", "ſecret", "Secret", "api_key", "deadbeef", "\n", '"', "😀"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        want = [("assign", *m.span()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A) if len(m[2]) >= 12]
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        got = [(s["kind"], s["start"], s["end"]) for s in secrets.scan(t) if s["kind"] != "literal"]
        assert got == sorted(want, key=lambda s: (s[1], secrets.KINDS.index(s[0]))), t


@pytest.mark.parametrize("text,found", [
    ('db_password = "hunter2Xy9!kk"', "hunter2Xy9!kk"), ('k = "Zx81kPq0LmN4"\nclient.secret = k', "Zx81kPq0LmN4"), ('conn["passwd"] = "aa" + "Q8x!z0p2Lm"', "Q8x!z0p2Lm"),
    ("export DB_PASS=Xk29fjQ0zz1", "Xk29fjQ0zz1"), ('signingKey: "r8Tz-41mQ-xx0L"', "r8Tz-41mQ-xx0L"),
    ("the key: value of this", None), ("password: ${VAULT_PASSWORD}", None), ('colour = "Zx81kPq0LmN4"', None), ("db_pass = 'changeme12345'", None),
])
def test_literals_under_sensitive_names(text, found):
    got = [text[s["start"] : s["end"]] for s in secrets.scan(text) if s["kind"] == "literal"]
    assert got == ([found] if found else [])


def test_all_literals_reach_the_sensitive_name():
    parts = [f"Zx{k:03d}kPq0Lm!" for k in range(200)]
    steps = 'x = ""\n' + "\n".join(f'x = x + "{p}"' for p in parts)
    for text, name in ((f"{steps}\napi.secret = x\nsalt = x", "api.secret"), ("db_password = " + " + ".join(f'"{p}"' for p in parts), "db_password")):
        got = [s for s in secrets.scan(text) if s["kind"] == "literal"]
        assert [text[s["start"] : s["end"]] for s in got] == parts and {s["name"] for s in got} == {name}


def test_tokens_equal_the_library():
    tokenizers, files = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    spec = open(files.path("byte_bpe_50k.json"), encoding="utf-8").read()
    theirs, ours = tokenizers.Tokenizer.from_str(spec), token_counts.Tokens(spec)
    rng = random.Random(3)
    parts = ["a", "the", "ing", " ", "  ", "\n", "\t", "'", "'s", "'re", "'r", "'ll", "'l", "é", "ß", "1", "٣", "½", "!", "<|endoftext|>", "中", "😀", "'S", "\x85", " ", "\r\n", "aaaaaaa", "-----"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + [None, "", "a" * 20000, " " * 3000 + "x", "the" * 5000, *(t for _, t, *_ in H.corpus(40))]
    want = [len(theirs.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert ours.counts_of(texts).tolist() == want


def test_chunk_maps_compose_to_the_whole():
    rng = np.random.default_rng(0)
    for n in (1, 127, 128, 129, 5000):
        c = rng.integers(0, token_counts.N_CLASSES - 1, n).astype(np.uint8)
        q, begins = token_counts.BOS, np.zeros(n, bool)
        for i, x in enumerate(c.tolist()):
            q, marks = token_counts._step(q, x)
            begins[i] |= bool(marks & token_counts.HERE)
            if marks & token_counts.BEFORE:
                begins[i - 1] = True
        assert (token_counts.piece_starts(c) == begins).all()


def test_additive_model_learns_and_scores(spark, docs):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality_model.Additive().fit(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9  # only a pair tells
    assert quality_model.Additive().fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    got = quality_model.scored(quality_model.featured(docs), quality_model.Additive().fit(np.zeros((1, len(quality_model.FEATURES))), np.ones(1))).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()


def test_quality_is_told_apart_on_held_out_rows(spark):
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    got = quality_model.op4_quality_model(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    right = ((got["predicted"] == 1) == (got["quality"] == 1)).mean()
    assert len(got) > 40 and right > 0.93


def test_licenses_with_edits_are_aligned():
    index = license_scan.Index(license_scan.TEMPLATES)
    mit = license_scan.TEMPLATES["MIT"].replace("merge, ", "").replace("sublicense", "relicense")
    text = "é préface\n" + mit + "\nReleased under the MIT License. fin"
    got = license_scan.scan(text, index)
    assert [g[0] for g in got] == ["MIT", "MIT-notice"] and got[0][1] > 0.95
    assert text[got[1][4] : got[1][5]] == "Released under the MIT License" and text[got[0][4] :].startswith("Permission is")
    assert license_scan.scan("nothing of the sort here at all", index) == [] == license_scan.scan(None, index)


@pytest.mark.parametrize("name", ["MIT-notice", "Apache-2.0-notice", "CC-BY-NC-4.0-notice", "ISC"])
def test_notices_in_a_row_are_reported_each(name):
    line = license_scan.TEMPLATES[name]
    got = license_scan.scan("\n".join([line] * 20), license_scan.Index(license_scan.TEMPLATES))
    assert [(g[0], g[1]) for g in got] == [(name, 1.0)] * 20
    assert [g[4] for g in got] == [k * (len(line) + 1) for k in range(20)]


@pytest.mark.parametrize("text", ["Released under MIT License.", "Released under an MIT License"])
def test_short_notices_with_an_edit(text):
    got = license_scan.scan(f"so it is. {text} and more", license_scan.Index(license_scan.TEMPLATES))
    assert [(g[0], g[1]) for g in got] == [("MIT-notice", 0.8)]


def test_short_notices_equal_alignment_everywhere():
    rng = random.Random(6)
    names = [n for n, t in license_scan.TEMPLATES.items() if len(license_scan.tokens(t)[3]) < license_scan.SHORT]
    n_found = 0
    for _ in range(150):
        name = rng.choice(names)
        words = re.findall(r"[\w]+", license_scan.TEMPLATES[name])
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(["odd", "", "new words"])
        text = "x y z " * rng.randint(0, 9) + " ".join(words) + " p q" * rng.randint(0, 9)
        index = license_scan.Index({name: license_scan.TEMPLATES[name]})
        h, template = license_scan.tokens(text)[3].tolist(), index.words[0]
        matched = license_scan.align(h, template, 0, len(h) + len(template))[0]
        got = license_scan.scan(text, index)
        assert ([g[2] for g in got] == [matched]) == (matched >= license_scan.COVERAGE * len(template)), text
        n_found += len(got)
    assert 20 < n_found < 150


def test_alignment_equals_an_unbanded_one():
    rng = random.Random(5)
    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in "ab")
        s = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(len(a)):
            for j in range(len(b)):
                s[i + 1, j + 1] = max(0, s[i, j] + (1 if a[i] == b[j] else -1), s[i, j + 1] - 1, s[i + 1, j] - 1)
        matched, first, end = license_scan.align(a, b, 0, 99)
        assert (s.max() > 0) == (matched > 0) and matched >= s.max() and end - first >= matched


def test_empty_tables(spark, none):
    assert quality_rules.ledger(none).count() == 0 == line_dedup.dedup(none).count() == jaccard_join.join(none).count()
    assert mixing.apply_mix(none).count() == 0 == packing.pack_documents(none, n_words(F.col("text"))).count()
    assert secrets.scan_secrets(none).count() == 0 == license_scan.scan_licenses(none).count() == quality_model.featured(none).count()


def test_extra_columns_and_repeated_rows_pass(spark, rows):
    more = spark.createDataFrame(rows + rows[:5] + [(None, "no id here at all, twice", "en", "s1", 3)] * 2, H.SCHEMA)
    more = more.withColumns({"n_words": F.lit("x"), "size": F.lit("y"), "row": F.lit("z"), "n_removed": F.lit(-1), "taken": F.lit(0), "weight": F.lit("w"), "kept_id": F.lit(1)})
    assert quality_rules.keep_good(more).columns == more.columns == line_dedup.clean(more).columns == mixing.apply_mix(more).columns
    assert line_dedup.clean(more).where("n_removed = -1").count() == line_dedup.clean(more).count()
    kept = jaccard_join.keep_one(more, 4, 85, 100)
    want, _ = H.components(rows, 4, 85, 100)
    assert kept.columns == more.columns and kept.where("doc_id is not null").count() == len(set(want.values())) and kept.where("doc_id is null").count() == 2
