"""Words of a text and their hashes, whole arrays at a time."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

_STEP = np.uint64(0xD6E8FEB86659FD93)
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SEED = 0x9E3779B97F4A7C15
#: Longer spans are hashed one by one.
LONG = 128


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def runs(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    padded = np.zeros(len(member) + 2, bool)
    padded[1:-1] = member
    edges = np.flatnonzero(padded[1:] != padded[:-1])
    return edges[0::2], edges[1::2]


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data, the one behind its end included, as numbers."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def part(eight: np.ndarray, starts: np.ndarray, size: np.ndarray, at: int) -> np.ndarray:
    """Up to eight bytes of each span, from place ``at`` in it; 0 where it has none there."""
    left = np.clip(size - at, 0, 8)
    return eight[np.minimum(starts + at, len(eight) - 1)] & _MASK[left]


def same(data: np.ndarray, eight: np.ndarray, a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether two spans of data have the same bytes, for each pair of spans."""
    out = size_a == size_b
    at, which = 0, np.flatnonzero(out & (a != b))
    while len(which) and at < LONG:
        equal = part(eight, a[which], size_a[which], at) == part(eight, b[which], size_b[which], at)
        out[which[~equal]] = False
        at += 8
        which = which[equal & (size_a[which] > at)]
    for k in which.tolist():
        out[k] = data[a[k] : a[k] + size_a[k]].tobytes() == data[b[k] : b[k] + size_b[k]].tobytes()
    return out


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by its content and the seed alone: eight bytes at a time are mixed in, so that spans of up to eight bytes of one length never share a hash."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    eight = eights(data)
    length = ends - starts
    out = mix(length.astype(np.uint64) + np.uint64(_SEED * (2 * seed + 1) % (1 << 64)))
    at, left, which = starts, np.minimum(length, LONG), None
    while True:
        part = eight[at] & _MASK[np.minimum(left, 8)]
        if which is None:
            out = mix(out ^ part)
            go = np.flatnonzero(left > 8)
            which = go
        else:
            out[which] = mix(out[which] ^ part)
            go = np.flatnonzero(left > 8)
            which = which[go]
        if not len(go):
            break
        at, left = at[go] + 8, left[go] - 8
    for k in np.flatnonzero(length > LONG).tolist():
        digest = blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little"))
        out[k] = int.from_bytes(digest.digest(), "little")
    return out


def words(text: bytes, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words between white space."""
    data = np.frombuffer(text, np.uint8)
    starts, ends = runs(~BLANK[data])
    return starts, ends, hashes(data, starts, ends, seed)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k hashes in a row."""
    n = len(h) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= _STEP
        acc += h[j : j + n]
    return mix(acc)


def shingles(text: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of k words of a text, ASCII letters in lower case, by two independent hashes in order; all words as one shingle where there are fewer than k; none without words."""
    data = np.frombuffer(text.lower(), np.uint8)
    starts, ends = runs(~BLANK[data])
    one, two = (hashes(data, starts, ends, seed) for seed in (0, 1))
    n = len(one)
    if not n:
        return one, two
    if n < k:
        return tuple(mix(grams(h, n) + np.uint64(n)) for h in (one, two))
    one, two = grams(one, k), grams(two, k)
    order = np.argsort(one, kind="stable")
    one, two = one[order], two[order]
    equal = one[1:] == one[:-1]
    if (two[1:][equal] != two[:-1][equal]).any():
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        equal = one[1:] == one[:-1]
    new = np.append(True, ~(equal & (two[1:] == two[:-1])))
    return one[new], two[new]
