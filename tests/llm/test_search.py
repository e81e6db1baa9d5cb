"""URL filter, collocations and lexical search against plain versions, with awkward rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from clustrel.llm import collocations, lexical_search, url_filter

from . import helpers as H

TERMS = re.compile(lexical_search.TERM)
LOW = str.maketrans(lexical_search.UPPER, lexical_search.LOWER)


def terms(text):
    return TERMS.findall((text or "").translate(LOW))


def plain_search(docs, items, top):
    bags = [(doc, Counter(t)) for doc, text in docs if (t := terms(text))]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(Counter)
    for item, text in set(items):
        asked[item].update(terms(text))
    out = []
    for item, want in asked.items():
        found = []
        for doc, b in bags:
            m = 25 + 75 * sum(b.values()) * n_docs // n_terms
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, k in want.items() if b[t])
            if s > 0:
                found.append((-s, doc is None, doc or 0))
        out += [(item, r + 1, None if no else doc, -s) for r, (s, no, doc) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


AWKWARD = [(900, None), (901, ""), (902, " .,;\n"), (903, "K İ ſ Ünï-CÖDE ünï"), (904, "a\x00b A\x7fB"), (905, "same words here"), (905, "same words here"), (None, "same words here"), (906, "x " * 30000)]


@pytest.mark.parametrize("wave", [lexical_search.WAVE, 40])
def test_search_equals_plain_scores(spark, wave):
    docs = [(r[0], r[1]) for r in H.corpus(150, 3)] + AWKWARD
    rng = random.Random(5)
    items = [(i, " ".join(rng.sample(terms(docs[rng.randrange(100)][1]) or ["one"], 1)) + " " + (docs[i][1] or "")[:200]) for i in range(12)]
    items += [(50, None), (51, "!!"), (52, "words same SAME"), (52, "words same SAME"), (53, "x"), (53, "here ÜNÏ ünï"), (None, "one two"), (2**60 + 1, "words")]
    got = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), wave=wave).collect()
    assert sorted(map(tuple, got), key=str) == plain_search(docs, items, 10)


def test_search_of_nothing_and_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "z")], "doc_id long, text string, rank int, term string")
    items = spark.createDataFrame([(4, "B c", 9, 3)], "item_id long, text string, score int, n int")
    got = lexical_search.search(docs, items).collect()
    assert [tuple(r)[:3] for r in got] == [(4, 1, 1)]
    assert lexical_search.search(docs.limit(0), items).count() == lexical_search.search(docs, items.limit(0)).count() == 0


def test_blocks_of_the_product_change_nothing(spark, monkeypatch):
    docs = [(r[0], r[1]) for r in H.corpus(60, 8)]
    items = [(i, docs[i][1]) for i in range(0, 60, 6)]
    monkeypatch.setattr(lexical_search, "BLOCK", 50)
    score, doc = np.array([5, 7, 5, 5, 1]), np.array([4, 9, 2, 3, 0])
    assert lexical_search._best(score, doc, np.array([True, True, True, False, True]), 3).tolist() == [1, 2, 0]
    got = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == plain_search(docs, items, 10)


def plain_phrases(rows, longest, least, top):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, *w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
    common = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    inside = {(g[0], *g[i:j]): 0 for g in common for i in range(1, len(g)) for j in range(i + 1, len(g) + 1) if j - i < len(g) - 1}
    for g, a in common.items():
        for i in range(1, len(g)):
            for j in range(i + 1, len(g) + 1):
                if j - i < len(g) - 1:
                    inside[(g[0], *g[i:j])] = max(inside[(g[0], *g[i:j])], a)
    out = defaultdict(list)
    for g, a in common.items():
        if inside.get(g, -1) < a:
            cuts = [(1000 * a * total[g[0]] // (f[g[:k]] * f[(g[0], *g[k:])]), k) for k in range(2, len(g))]
            s, k = min(cuts)
            out[g[0]].append((-s, -a, " ".join(g[1:]).encode(), f[g[:k]], f[(g[0], *g[k:])], total[g[0]]))
    return sorted((lang, r + 1, p.decode(), -a, x, y, n, -s) for lang, found in out.items() for r, (s, a, p, x, y, n) in enumerate(sorted(found)[:top]))


def phrase_rows(n, seed):
    rng = random.Random(seed)
    vocab = ["a", "B", "c", "dé", "É", "ff", "g\x0bh", "i\u00a0j", "*", "k"]
    fixed = ["new york city", "ad hoc", "C a c", "to be or not to be"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 6))]
        rows.append((rng.choice([", ", "  ", "\t", ".\n", " ; "]).join(parts), rng.choice(["en", "en", "fr", None, "und", ""])))
    return rows + [(None, "en"), ("", None), (" ,; \t", "de"), ("lone", "xx"), ("new york city " * 3000, "en"), (("to be or not to be. ") * 500, "fr")]


@pytest.mark.parametrize("seed,least,top,chunk", [(1, 8, 2000, 1 << 20), (2, 3, 5, 200)])
def test_phrases_equal_plain_counts(spark, monkeypatch, seed, least, top, chunk):
    rows = phrase_rows(200, seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, f int, phrase string").repartition(3)
    got = [tuple(r) for r in collocations.mine(df, least=least, top=top).collect()]
    assert sorted(got) == plain_phrases(rows, 5, least, top) and got
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    counted = {(r["lang"], r["phrase"]): r["f"] for r in collocations.frequent(collocations.pieces(df), 2, least).where("words = 2").collect()}
    assert all(counted[r[0], r[2]] == r[3] for r in got if r[2].count(" ") == 1)


def test_phrases_of_nothing(spark):
    df = spark.createDataFrame([(None, None)], "text string, lang string")
    assert collocations.mine(df).count() == collocations.mine(df.limit(0)).count() == 0


def test_scores_beyond_64_bits_are_exact(spark):
    big = 3_000_000_000_017
    counts = spark.createDataFrame([("en", "a", 1, big + 5), ("en", "b", 1, big + 9), ("en", "a b", 2, big)], "lang string, phrase string, words int, f long")
    totals = spark.createDataFrame([("en", 9 * big)], "lang string, n long")
    r = collocations.scored(counts, totals).first()
    assert r["score"] == 1000 * big * 9 * big // ((big + 5) * (big + 9))


def test_filter_never_misses(spark):
    rows = [("en", " ".join(f"w{(i * 7 + k) % 50}" for k in range(3))) for i in range(500)]
    df = spark.createDataFrame(rows, "lang string, phrase string").repartition(3)
    bits = collocations._filter(df)
    import pyarrow as pa

    w = collocations._Words(pa.array(["en", "fr"]), pa.array([rows[3][1], rows[4][1]]), np.array([1, 1]))
    assert collocations._within(bits, w.hashes(3)).tolist() == [True, False, False, False]


URLS = [
    "http://Shop.Example.com:80/de/12?x#y", "https://a.example.net/en/4", "http://net/", "http://xnet/a", "http://b.net", "x://org/fr/", "x://ORG/fr", "no scheme", None, "", "://", "a://b://c/d",
    "http://a.org?q=/fr/", "http://a.org#/fr/", "http://a.org/fr/x?y", "mailto:x@net/", "http://u@example.com/de/1\n2", "http://example.com.evil.io/de/1",
]


def plain_rule(url):
    _, sep, rest = (url or "").partition("://")
    host = re.match(r"[^/?#]*", rest)[0] if sep else ""
    path = re.match(r"[^?#]*", rest[len(host) :])[0] if sep else ""
    host = host.translate(LOW)
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


def test_rules_equal_plain_ones(spark):
    rng = random.Random(4)
    urls = URLS + [rng.choice("hH") + "ttp://" + "".join(rng.choice(["net", "org", "example", "com", ".", "/", "en", "fr/", "de/", "?", "#", "x"]) for _ in range(9)) for _ in range(300)]
    got = url_filter.ruled(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert {r["page_id"]: tuple(r)[1:] for r in got} == {i: plain_rule(u) for i, u in enumerate(urls)}


def judged(spark, urls, rules):
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, n int").repartition(3)
    return {r["page_id"]: r for r in url_filter.judge(df, rules).collect()}


def test_variable_segments_carry_labels_over(spark):
    bad = [url_filter.Rule("block", "h.io", f"/user/{x}") for x in "abcdefghij"]
    good = [url_filter.Rule("allow", "h.io", "/docs/")]
    urls = [f"http://h.io/user/{x}{k:c}" for x in "abcdefghijxyz" for k in range(97, 123)] + [f"http://h.io/docs/{x}" for x in "abcdefgh"] + ["http://other.io/user/a1", None, "http://h.io"]
    got = judged(spark, urls, tuple(bad + good))
    free = {i: r for i, r in got.items() if r["rule"] is None}
    assert len(got) == len(urls) and len(free) == 3 * 26 + 3
    assert all(r["verdict"] == "block" and r["template"] == "/user/*" and (r["labelled"], r["blocked"], r["n_pages"]) == (260, 260, 338) for i, r in free.items() if i < 338)
    assert [free[i]["verdict"] for i in sorted(free)[-3:]] == ["allow"] * 3 and free[len(urls) - 2]["host"] == ""


def test_like_branches_merge_and_unlike_ones_stay(spark):
    rules = (url_filter.Rule("block", "h.io", "/a/"), url_filter.Rule("block", "h.io", "/b/"), url_filter.Rule("allow", "h.io", "/c/"))
    urls = [f"http://h.io/{s}/{k}" for s in "abcd" for k in range(40)] + ["http://h.io/a", "http://h.io/d/1/2/3/4/5/6/7/8/9"] + ["http://h.io/d/" + "f" * 20]
    got = judged(spark, urls, rules)
    by = {r["template"]: (r["n_pages"], r["labelled"], r["blocked"]) for r in got.values()}
    assert by["/(a|b)/{n}"] == (80, 80, 80) and by["/c/{n}"] == (40, 40, 0) and by["/d/{n}"] == (40, 0, 0) and by["/(a|b)"] == (1, 0, 0) and by["/d/{x}"] == (1, 0, 0)
    assert by["/d/{n}/{n}/{n}/{n}/{n}/**"] == (1, 0, 0) and {r["verdict"] for r in got.values() if r["rule"] is None} == {"allow"}
    assert judged(spark, [], rules) == {}
