"""Small documents with every awkward case, and plain versions of what operators compute."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=120, seed=0):
    """Rows with exact and near copies, shared lines, junk, nulls, empty and blank texts, and one long text."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    line = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    shared = [line(12) for _ in range(4)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.4:
            w = (rng.choice(texts) or "").split(" ")
            for _ in range(rng.randint(1, 2)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
        else:
            ls = [line(rng.randint(3, 15)) for _ in range(rng.randint(1, 9))]
            if rng.random() < 0.4:
                ls[1:1] = shared
            texts.append("\n".join(ls))
    texts += [None, "", " \t\n", "one", "two words", "###$$$ " * 40, "the " * 60, "A\n\nB\r\nC\x0bD", " ".join(line(40) for _ in range(200))]
    return [(i, t, "en", f"s{i % 5}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]


def words(text):
    return WORDS.findall(text or "")


def shingles(text, k):
    w = [x.encode().lower() for x in words(text)]
    return frozenset(zip(*(w[j:] for j in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(rows, k, num, den):
    """doc_id to least id reachable by links, all pairs tried."""
    sets = {i: shingles(t, k) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for p, i in enumerate(ids):
        for j in ids[p + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}
