"""Image copies: edits, brute force over all pairs, hot places, awkward rows."""

import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clustrel.llm import image_copies as ic
from clustrel.llm.components import components

KIND = "id long, points array<struct<level:long,x:long,y:long,turn:long,d0:long,d1:long>>"


def decode(v):
    return np.zeros((0, 0)) if v is None or len(v) < 2 else np.frombuffer(v[1:], np.uint8).reshape(v[0], -1)


def encode(x):
    return bytes([x.shape[0]]) + np.clip(x, 0, 255).astype(np.uint8).tobytes()


def picture(rng, n=50):
    return np.repeat(np.repeat(rng.integers(0, 256, (n, n)), 4, 0), 4, 1)


def test_copies_survive_crops_turns_and_edits(spark):
    rng = np.random.default_rng(5)
    base = [picture(rng, 40) for _ in range(6)]
    edited = base[1].copy()
    edited[:60, :60] = 0
    base += [base[0][24:, 16:], edited, np.rot90(base[2]), base[3] * 0.8 + 20, np.full((50, 50), 9)]
    df = spark.createDataFrame([(i, encode(x)) for i, x in enumerate(base)] + [(99, None), (98, b"\0")], "id long, image binary")
    points = ic.described(df, decode)
    assert {(r["a"], r["b"]) for r in ic.copies(points).collect()} == {(0, 6), (1, 7), (2, 8), (3, 9)}
    assert points.count() == 13 and points.where("id in (10, 98, 99) and size(points) > 0").count() == 0


def test_recall_over_noise_crops_and_pasting(spark):
    rng = np.random.default_rng(9)
    rows, want = [], set()
    for k in range(40):
        x = picture(rng)
        kind = k % 4
        y = x + rng.normal(0, 2, x.shape) if kind == 0 else x[8 * (k // 4) :, 4 * (k // 4) :] if kind == 1 else x * 0.7 + 30
        if kind == 3:
            y = picture(rng)
            y[40:160, 40:160] = x[40:160, 40:160]
        rows += [(2 * k, encode(x)), (2 * k + 1, encode(y))]
        want.add((2 * k, 2 * k + 1))
    found = {(r["a"], r["b"]) for r in ic.copies(ic.described(spark.createDataFrame(rows, "id long, image binary"), decode)).collect()}
    assert found <= want and len(found) >= 0.9 * len(want)


def plain(points, votes=ic.VOTES):
    """Links of all pairs, by a vote of each near pair of keypoints, one at a time."""
    links = set()
    turn = np.arange(ic.TURNS) * 2 * np.pi / ic.TURNS
    for a, p in points.items():
        for b, q in points.items():
            if a >= b or min(len(p), len(q)) < votes:
                continue
            one, two = defaultdict(set), defaultdict(set)
            near = sum(np.unpackbits(np.ascontiguousarray(p[:, None, k] ^ q[None, :, k]).view(np.uint8).reshape(len(p), len(q), 8), axis=2).sum(axis=2, dtype=int) for k in (4, 5))
            for i, j in zip(*np.nonzero(near <= ic.DISTANCE), strict=True):
                t, s = (q[j, 3] - p[i, 3]) % ic.TURNS, ic.SCALES[p[i, 0]] / ic.SCALES[q[j, 0]]
                x = q[j, 1] - s * (np.cos(turn[t]) * p[i, 1] - np.sin(turn[t]) * p[i, 2])
                y = q[j, 2] - s * (np.sin(turn[t]) * p[i, 1] + np.cos(turn[t]) * p[i, 2])
                cell = (q[j, 0] - p[i, 0], t, np.floor(x / ic.CELL + 0.5), np.floor(y / ic.CELL + 0.5))
                one[cell].add(i)
                two[cell].add(j)
            if any(min(len(one[c]), len(two[c])) >= votes for c in one):
                links.add((a, b))
    return links


def least(links, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_equals_all_pairs(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", ic.visible(F.col("html")).alias("t")).collect()
    points = {r["page_id"]: ic.keypoints(ic.render(r["t"])) for r in pages}
    links = plain(points)
    got = ic.op7_image_copies(spark, SF).toPandas()
    assert dict(zip(got.page_id, got.n_keypoints, strict=True)) == {i: len(p) for i, p in points.items()}
    assert dict(zip(got.page_id, got.component_id, strict=True)) == least(links, points) and len(links) > 10


def test_images_meet_behind_other_heads(spark):
    rng = np.random.default_rng(8)
    d = rng.integers(-(2**62), 2**62, (40, 2)).tolist()
    at = rng.integers(20, 400, (40, 2)).tolist()
    point = lambda k, shift=0, other=None: (0, at[k][0] + shift, at[k][1], 0, d[k][0], d[k][1] if other is None else other)
    # Image 1 shares only a half of each keypoint of 2 and 3; 4 is a part of 3, which alone is also like 2.
    rows = [(1, [point(k, 0, ~d[k][1]) for k in range(40)]), (2, [point(k) for k in range(40)]), (3, [point(k) for k in range(40)]), (4, [point(k) for k in range(28, 40)])]
    # Many images share nine keypoints with them, hot places that link nothing.
    rows += [(100 + n, [point(k) for k in range(9)] + [(0, 9 * k, 7 * k, 0, *rng.integers(-(2**62), 2**62, 2).tolist()) for k in range(9)]) for n in range(60)]
    got = {(r["a"], r["b"]) for r in ic.copies(spark.createDataFrame(rows, KIND)).collect()}
    assert least(got, range(1, 5)) == {1: 1, 2: 2, 3: 2, 4: 2} and all(b < 100 for _, b in got)


def test_halves_in_common_count_over_both_tables(spark):
    rng = np.random.default_rng(6)
    d = rng.integers(-(2**62), 2**62, (12, 2)).tolist()
    one = [(0, 20 * k, 30, 0, *d[k]) for k in range(12)]
    two = [(0, 20 * k, 30, 0, d[k][0] ^ (0 if k % 2 else 3), d[k][1] ^ (3 if k % 2 else 0)) for k in range(12)]  # six first halves and six second ones
    got = [(r["a"], r["b"], r["votes"]) for r in ic.copies(spark.createDataFrame([(1, one), (2, two)], KIND)).collect()]
    assert got == [(1, 2, 12)]


def test_a_keypoint_votes_once(spark):
    rng = np.random.default_rng(3)
    d = rng.integers(-(2**62), 2**62, (5, 2)).tolist()
    five = [(0, 20 * k, 30, 0, *d[k]) for k in range(5)] * 2
    assert ic.copies(spark.createDataFrame([(1, five), (2, five)], KIND)).count() == 0
    assert ic.copies(spark.createDataFrame([(1, five[:5]), (1, five[:5]), (2, five[:5]), (2, five[:5])], KIND)).count() == 0
    assert ic.agree(np.array(five), np.array(five))[0] == ic.agree(np.array(five[:5]), np.array(five))[0] == ic.agree(np.array(five[:5]), np.array(five[:5]))[0] == 5


def test_repeated_ids_nulls_and_no_rows(spark):
    rng = np.random.default_rng(4)
    d = rng.integers(-(2**62), 2**62, (24, 2)).tolist()
    own = [(0, 9 * k, 5 * k, 0, *d[k]) for k in range(24)]
    rows = [(7, own[:12]), (7, own[12:]), (8, own), (8, own), (None, own), (9, None), (10, [])]
    got = [(r["a"], r["b"], r["votes"]) for r in ic.copies(spark.createDataFrame(rows, KIND)).collect()]
    assert got == [(7, 8, 24)]
    none = ic.copies(spark.createDataFrame([], KIND))
    assert none.count() == 0 and components(none.select("a", "b")).count() == 0


def test_keypoints_of_many_images_are_those_of_each():
    rng = np.random.default_rng(1)
    images = [rng.integers(0, 256, (h, w)).astype(np.float32) for h, w in ((30, 96), (200, 96), (19, 96), (0, 96), (64, 64), (40, 96), (8, 8), (130, 64))]
    for x, got in zip(images, ic.keypoints_of(images), strict=True):
        assert (got == ic.keypoints(x)).all() and (ic.unpack(ic.pack(got)) == got).all()
    assert sum(map(len, ic.keypoints_of(images))) > 50 and ic.keypoints_of([]) == []


def _picture(kind, rng, n=256):
    if kind == "blocks":
        return np.kron(rng.integers(0, 256, (n // 16, n // 16)), np.ones((16, 16)))
    a = rng.normal(size=(n, n))
    for _ in range(14):
        a = (a + np.roll(a, 1, 0) + np.roll(a, -1, 0) + np.roll(a, 1, 1) + np.roll(a, -1, 1)) / 5
    return (a - a.min()) / (a.max() - a.min()) * 255


def _edited(a, degrees, scale):
    """The picture turned and scaled about its centre, by linear interpolation."""
    n, size, t = len(a), int(len(a) * scale), np.deg2rad(degrees)
    y, x = (np.mgrid[0:size, 0:size] - (size - 1) / 2) / scale
    u, v = np.cos(t) * x + np.sin(t) * y + (n - 1) / 2, np.cos(t) * y - np.sin(t) * x + (n - 1) / 2
    seen = (u >= 0) & (v >= 0) & (u < n - 1) & (v < n - 1)
    u, v = np.clip(u, 0, n - 1.001), np.clip(v, 0, n - 1.001)
    i, j = u.astype(int), v.astype(int)
    return np.where(seen, (1 - v + j) * ((1 - u + i) * a[j, i] + (u - i) * a[j, i + 1]) + (v - j) * ((1 - u + i) * a[j + 1, i] + (u - i) * a[j + 1, i + 1]), 0)


@pytest.mark.parametrize("degrees,scale", [(15, 1), (30, 1), (90, 1), (0, 0.7)])
def test_turned_and_scaled_pictures_meet_and_agree(degrees, scale):
    found = 0
    for kind in ("blocks", "smooth"):
        for seed in range(12):
            a = _picture(kind, np.random.default_rng(seed))
            p, q = ic.keypoints(a.astype(np.float32)), ic.keypoints(_edited(a, degrees, scale).astype(np.float32))
            found += ic.agree(p, q)[0] >= ic.VOTES and any(len(np.intersect1d(p[:, c], q[:, c])) for c in (4, 5))
    assert found >= 0.85 * 24
