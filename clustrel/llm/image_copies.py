"""Local image descriptors that find cropped or edited copies.

An image becomes keypoints: corners at several scales, each with the direction from its centre to its
centroid of brightness and 128 binary tests of smoothed brightness, the test pattern turned by that direction.
A descriptor is filed in two tables by its halves. Images that meet in a place are compared in full: all
their keypoints in Hamming distance, and each near pair votes for the change of scale, rotation and place
between the images. Where enough distinct keypoints of both agree the images are copies of each other;
components of such links are groups of copies.

Patterns that very many images share fill few places with very many rows. So every image leaves out its
fullest places, in a way that no pair with NEED halves of keypoints in common, of either table, is lost (see
``filed``); a pair with fewer meets in what places they have left. In each place the images are
compared to the least of them first, and then only across the groups that this has not joined.

Edge cases: a null, empty or flat image has no keypoints and no copies; an image smaller than a patch has
none either; images that are equal are copies if they have enough corners; rows that share an id are one
image, with the keypoints of all; rows without an id are never linked; an empty table gives no rows; columns
other than id and image aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clustrel.llm.common import stored
from clustrel.llm.components import components

SCALES = (1.0, 0.7, 0.5)
TURNS, BITS, PATCH, APART = 24, 128, 8, 8
#: Corner response from which a corner counts, bits that may differ, cells of a vote, votes that make a copy.
RESPONSE, DISTANCE, CELL, VOTES = 2000.0, 12, 8, 10
#: So many halves of keypoints, first or second, must two copies have in common for the pair to be sure to meet.
NEED = 10
#: Rows and columns around images that are worked on together (at least APART), and their pixels.
GAP, PIXELS = 8, 1 << 16
WIDTH, LINE = 96, 3
#: Pairs of a tile, slots of the bitmap of ids: fixed, whatever the input's size.
TILE, FILTER = 256, 1 << 20
POINT = ("level", "x", "y", "turn", "d0", "d1")


@lru_cache(maxsize=1)
def pattern() -> tuple[np.ndarray, np.ndarray]:
    """The offsets (TURNS, BITS, 2, 2) of the tests, and those of the disc that gives the direction."""
    rng = np.random.default_rng(20)
    pairs = np.clip(rng.normal(0, PATCH / 2.2, (BITS, 2, 2)), -PATCH + 2, PATCH - 2)
    turn = np.arange(TURNS) * 2 * np.pi / TURNS
    rot = np.stack([np.stack([np.cos(turn), -np.sin(turn)], -1), np.stack([np.sin(turn), np.cos(turn)], -1)], -2)
    tests = np.rint(np.einsum("tij,bpj->tbpi", rot, pairs)).astype(np.int64)
    y, x = np.mgrid[-PATCH + 1 : PATCH, -PATCH + 1 : PATCH]
    disc = np.stack([x, y], -1)[x * x + y * y < PATCH * PATCH]
    return tests, disc


def box(f: np.ndarray, r: int, width: int) -> np.ndarray:
    """Sums over squares of side 2 r + 1, r 1 or 2, of an image laid out row by row, with zeros around it; by shifts, so that a sum doesn't depend on where it stands."""
    for step in (1, width):
        n = len(f) - 2 * r * step
        out = np.empty_like(f)
        out[: r * step] = out[r * step + n :] = 0
        sums = out[r * step : r * step + n]
        two = f[:-step] + f[step:]
        if r == 2:
            np.add(two[:n], two[2 * step : 2 * step + n], out=sums)
            sums += f[4 * step :]
        else:
            np.add(two[:n], f[2 * step :], out=sums)
        f = out
    return f


def peaks(f: np.ndarray, r: int, width: int) -> np.ndarray:
    """The greatest value within r rows and columns of each place, by maxima of doubling width."""
    for step in (1, width):
        m, size, want = f, 1, 2 * r + 1
        while size < want:
            more = min(size, want - size)
            m = np.maximum(m[: -more * step], m[more * step :])
            size += more
        out = np.full_like(f, -np.inf)
        out[r * step : len(f) - r * step] = m
        f = out
    return f


def _laid(images: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Images of one width below each other with GAP rows and columns of zero around them, and the first row of each."""
    tops = GAP + np.cumsum([0, *(len(a) + GAP for a in images)])
    out = np.zeros((tops[-1], images[0].shape[1] + GAP), np.float32)
    for a, top in zip(images, tops.tolist(), strict=False):
        out[top : top + len(a), :-GAP] = a
    return out, tops[:-1]


def _corners(images: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of images of one width: by level, the number of the image of each keypoint, its place (level, x, y, turn) and its descriptor."""
    tests, disc = pattern()
    out = []
    whole, first = _laid(images)
    blurred = box(whole.ravel(), 1, whole.shape[1]).reshape(whole.shape)
    heights = np.array([len(a) for a in images])
    for level, s in enumerate(SCALES):
        high, wide = (heights * s).astype(int), int(images[0].shape[1] * s)
        fit = np.flatnonzero(np.minimum(high, wide) > 2 * PATCH + 2)
        if not len(fit):
            continue
        tops = GAP + np.cumsum([0, *(high[fit] + GAP)])
        edge = np.full(tops[-1], -1)
        rows = np.zeros(len(edge), np.int64)
        tops = tops[:-1]
        for k, top in zip(fit.tolist(), tops.tolist(), strict=True):
            up = np.arange(high[k])
            edge[top : top + high[k]] = np.minimum(up, up[::-1])  # a row's distance to the nearer edge; -1 in a gap
            rows[top : top + high[k]] = first[k] + (up / s).astype(int)
        gap, width = np.flatnonzero(edge < 0), wide + GAP

        def bare(flat: np.ndarray, value: float) -> np.ndarray:
            grid = flat.reshape(-1, width)  # noqa: B023
            grid[gap] = value  # noqa: B023
            grid[:, wide:] = value  # noqa: B023
            return grid

        columns = np.minimum((np.arange(width) / s).astype(int), whole.shape[1] - 1)
        a = bare(whole[rows] if s == 1 else blurred[rows][:, columns] / np.float32(9), 0).ravel()
        smooth = box(a, 1, width)
        bare(smooth, 0)
        grad = np.zeros((3, len(a)), np.float32)
        np.subtract(smooth[2:], smooth[:-2], out=grad[0, 1:-1])
        np.subtract(smooth[2 * width :], smooth[: -2 * width], out=grad[1, width:-width])
        side = grad[0].reshape(-1, width)
        side[:, 0] = side[:, wide - 1] = 0
        bare(grad[0], 0)
        grad[1].reshape(-1, width)[edge <= 0] = 0
        np.multiply(grad[0], grad[1], out=grad[2])
        np.square(grad[:2], out=grad[:2])
        xx, yy, xy = (box(g, 2, width) for g in grad)
        response = xx * yy
        response -= np.square(xy, out=xy)
        xx += yy
        xx += np.float32(1e-9)
        response /= xx
        np.rint(response, out=response)
        grid = bare(response, -np.inf)
        some = grid > RESPONSE
        some[edge < PATCH] = False
        some[:, :PATCH] = some[:, wide - PATCH :] = False
        some &= (response == peaks(response, APART, width)).reshape(some.shape)
        at = np.flatnonzero(some)
        if not len(at):
            continue
        y, x = np.divmod(at, width)
        around = a.take(at[:, None] + (disc[:, 1] * width + disc[:, 0]))
        angle = np.arctan2(*(around @ disc[:, ::-1].astype(float)).T)
        turn = np.rint(angle / (2 * np.pi) * TURNS).astype(np.int64) % TURNS
        shift = tests[..., 1] * width + tests[..., 0]
        codes = np.packbits(smooth.take(at[:, None] + shift[turn, :, 0]) < smooth.take(at[:, None] + shift[turn, :, 1]), axis=1).view(np.int64).reshape(-1, 2)
        of = np.searchsorted(tops, y, side="right") - 1
        y = y - tops[of]
        out.append((fit[of], np.stack([np.full(len(x), level), np.rint(x / s).astype(np.int64), np.rint(y / s).astype(np.int64), turn], 1), codes))
    return out


def keypoints_of(images: list[np.ndarray]) -> list[np.ndarray]:
    """level, x, y, turn and the two halves of the descriptor of each keypoint of each image, x and y in the image's pixels.

    Images of one width are worked on together, about PIXELS at a time; a keypoint doesn't depend on the others.
    """
    out = [np.zeros((0, len(POINT)), np.int64)] * len(images)
    order = sorted((k for k, a in enumerate(images) if a.ndim == 2 and a.size), key=lambda k: images[k].shape[1])
    lo = 0
    while lo < len(order):
        hi, size, width = lo, 0, images[order[lo]].shape[1]
        while hi < len(order) and images[order[hi]].shape[1] == width and (hi == lo or size < PIXELS):
            size += images[order[hi]].size
            hi += 1
        part = order[lo:hi]
        found = _corners([images[k].astype(np.float32) for k in part])
        if found:
            of, places, codes = (np.concatenate(x) for x in zip(*found, strict=True))
            rows = np.concatenate([places, codes], axis=1)
            by = np.argsort(of, kind="stable")
            ends = np.searchsorted(of[by], np.arange(len(part) + 1))
            for j, k in enumerate(part):
                out[k] = rows[by[ends[j] : ends[j + 1]]]
        lo = hi
    return out


def keypoints(image: np.ndarray) -> np.ndarray:
    """The keypoints of one image."""
    return keypoints_of([image])[0]


def render(text: str | None) -> np.ndarray:
    """A page image from text: lines of WIDTH characters, each a column of two pixels whose brightness is fixed by the character."""
    c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    feed = np.flatnonzero(c == 10)
    c = np.delete(c, feed)
    if not len(c):
        return np.zeros((0, WIDTH), np.float32)
    first = feed - np.arange(len(feed))  # where lines begin, empty ones too
    size = np.diff(np.concatenate([[0], first, [len(c)]]))
    size = size[size > 0]
    first = np.cumsum(size) - size
    rows = -(-size // WIDTH)  # a line may take several rows
    top = np.cumsum(rows) - rows
    code = np.zeros((int(rows.sum()), WIDTH), np.uint32)
    code.ravel()[np.arange(len(c)) + np.repeat(top * WIDTH - first, size)] = c
    ink = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)
    ink[code <= 32] = 0
    image = np.zeros((len(code), LINE, WIDTH), np.float32)
    image[:, 0], image[:, 1] = ink >> 8, ink & 255
    return image.reshape(-1, WIDTH)


def described(images: DataFrame, decode) -> DataFrame:
    """id, points: of images(id, image), the keypoints that ``decode(image)``, a gray array, has."""
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in POINT]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = keypoints_of([decode(v.as_py()) for v in b.column(1)])
            flat = np.concatenate([np.zeros((0, len(POINT)), np.int64), *found])
            offsets = pa.array(np.append(0, np.cumsum([len(f) for f in found])).astype(np.int32))
            rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(6)], POINT)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, rows).cast(kind)], ["id", "points"])

    return images.mapInArrow(run, "id long, points array<struct<" + ",".join(f"{n}:long" for n in POINT) + ">>")


def filed(points: DataFrame, need: int = NEED) -> DataFrame:
    """token, id: the places under which each image is filed, of those that another image or keypoint has too.

    Places of both tables have one order for all images, from the fullest down. An image leaves out its first
    places in that order as long as fewer than ``need`` halves of its keypoints stand there. So of two images with
    ``need`` halves in common places, however they are dealt over the tables, both are filed under the last of those places.
    """
    place = lambda t, d: F.shiftleft(F.shiftrightunsigned(F.xxhash64(d), 17), 1).bitwiseOR(F.lit(t))
    rows = points.where((F.col("id").isNotNull()) & (F.size("points") > 0)).select("id", F.explode("points").alias("p"))
    rows = rows.select("id", F.explode(F.array(place(0, "p.d0"), place(1, "p.d1"))).alias("token"))
    shared = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("n > 1")
    hotter = Window.partitionBy("id").orderBy(F.desc("n"), F.desc("token"))
    return shared.withColumn("upto", F.count(F.lit(1)).over(hotter)).where(F.col("upto") >= need).select("token", "id").distinct()


def near_pairs(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of two arrays of 128 bits that differ in at most DISTANCE bits."""
    hits = []
    step = max(1, (1 << 17) // max(1, len(v)))
    first = np.ascontiguousarray(v[:, 0])
    for lo in range(0, len(u), step):
        half = np.bitwise_count(u[lo : lo + step, None, 0] ^ first).ravel()
        at = np.flatnonzero(half <= DISTANCE)
        i, j = np.divmod(at, len(v))
        near = half[at] + np.bitwise_count(u[i + lo, 1] ^ v[j, 1]) <= DISTANCE
        hits.append((i[near] + lo, j[near]))
    return tuple(np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (np.zeros(0, np.int64),) * 2


def distinct(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of rows of x, by place, the place of an equal row that stands for all its equals."""
    used, back = np.unique(at, return_inverse=True)
    rows = np.ascontiguousarray(x[used]).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel()
    _, first, of = np.unique(rows, return_index=True, return_inverse=True)
    return used[first[of]][back]


def agree(p: np.ndarray, q: np.ndarray, least: int = 1) -> tuple[int, int, int, int, int]:
    """votes, zoom, turn, dx, dy of two images' keypoints (level, x, y, turn, d0, d1): the change for which the most distinct keypoints of either vote; all 0 where fewer than ``least`` do."""
    turn = np.arange(TURNS) * 2 * np.pi / TURNS
    scale = np.array(SCALES)
    i, j = near_pairs(*(np.ascontiguousarray(x[:, 4:]).view(np.uint64) for x in (p, q)))
    if len(i) < least:
        return 0, 0, 0, 0, 0
    zoom, by = q[j, 0] - p[i, 0], (q[j, 3] - p[i, 3]) % TURNS
    s, cos, sin = scale[p[i, 0]] / scale[q[j, 0]], np.cos(turn)[by], np.sin(turn)[by]
    dx = q[j, 1] - s * (cos * p[i, 1] - sin * p[i, 2])
    dy = q[j, 2] - s * (sin * p[i, 1] + cos * p[i, 2])
    cell = lambda v: np.floor(v / CELL + 0.5).astype(np.int64)
    half = 1 << 26
    change = (((zoom + 2) * 32 + by) << 54) | ((cell(dx) + half) << 27) | (cell(dy) + half)
    changes, of, n = np.unique(change, return_inverse=True, return_counts=True)
    some = n[of] >= least  # what too few pairs vote for can't win
    i, j, of = i[some], j[some], of[some]
    if not len(of):
        return 0, 0, 0, 0, 0
    i, j = distinct(p, i), distinct(q, j)
    count = lambda x, size: np.bincount(np.unique(of * size + x) // size, minlength=len(changes))
    n = np.minimum(count(i, len(p)), count(j, len(q)))
    best = int(n.argmax())
    if n[best] < least:
        return 0, 0, 0, 0, 0
    won = int(changes[best])
    return int(n[best]), (won >> 59) - 2, won >> 54 & 31, (won >> 27 & (1 << 27) - 1) - half, (won & (1 << 27) - 1) - half


def pack(x: np.ndarray) -> bytes:
    """Keypoints in 32 bytes each: coordinates are below 2 ** 31."""
    return x[:, :4].astype(np.int32).T.tobytes() + np.ascontiguousarray(x[:, 4:]).tobytes()


def unpack(data: bytes) -> np.ndarray:
    n = len(data) // 32
    return np.concatenate([np.frombuffer(data, np.int32, 4 * n).reshape(4, n).T.astype(np.int64), np.frombuffer(data, np.int64, 2 * n, 16 * n).reshape(n, 2)], axis=1)


LINK = "a long, b long, zoom long, turn long, dx long, dy long, votes long"


def linked(pairs: DataFrame, points: DataFrame, votes: int = VOTES) -> DataFrame:
    """The pairs (a, b) of points(id, points) whose keypoints agree: LINK.

    Pairs with the same a form tiles of about TILE each, and a tile gets each image's keypoints once. Images in
    no pair are left out before the shuffle, by a bitmap of fixed size of hashed ids.
    """
    pairs = stored(pairs.select("a", "b").distinct(), "pairs")
    per = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    split = pairs.join(per, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("tiles")).cast("int").alias("part"))
    ends = split.select("a", "part", F.explode(F.array("a", "b")).alias("end")).distinct()
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER))
    wanted = np.zeros(FILTER, bool)
    wanted[[r[0] for r in pairs.select(F.explode(F.array("a", "b")).alias("id")).select(slot("id").alias("s")).distinct().collect()]] = True
    held = points.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(held.value).astype(bool)
        for b in batches:
            b = b.filter(pa.array(bits[b.column(2).to_numpy(zero_copy_only=False)]))
            n = b.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = b.column(1).flatten()
            flat = np.stack([flat.field(k).to_numpy(zero_copy_only=False) for k in POINT], 1)
            packed = [pack(x) for x in np.split(flat, np.cumsum(n)[:-1])] if len(n) else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], ["id", "packed"])

    some = points.where("id is not null").select("id", "points", slot("id").alias("slot")).mapInArrow(involved, "id long, packed binary")
    tiles = ends.join(some.hint("merge"), F.col("end") == F.col("id")).select("a", "part", F.col("id"), "packed")
    ordered = tiles.repartition("a", "part").sortWithinPartitions("a", "part", (F.col("id") != F.col("a")).alias("later"), "id").select("a", "part", "id", "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, head, now, image, out = None, None, None, None, []

        def close() -> None:
            if now is not None and now != tile[0]:
                found = agree(head, image, votes)
                if found[0] >= votes:
                    out.append((tile[0], now, *found[1:], found[0]))

        for b in batches:
            for a, part, i, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = unpack(packed)
                if tile == (a, part) and i == now:  # rows that share an id are one image
                    image = np.concatenate([image, x])
                    head = image if i == a else head
                    continue
                close()
                tile, now, image = (a, part), i, x
                head = x if i == a else head
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(7)], names)
            out.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(7)], names)

    names = [c.split()[0] for c in LINK.split(", ")]
    return ordered.mapInArrow(run, LINK)


def copies(points: DataFrame, votes: int = VOTES, need: int = NEED) -> DataFrame:
    """LINK, a < b: links between images(id, points) found to be copies, with the change most votes agree on; enough of them that every image is joined to all its copies, at some remove.

    In each place all images are first compared to the least; the links found make groups. Then, in places
    that still hold several groups, all pairs of different groups are compared too.
    """
    places = stored(filed(points, need), "places")
    least = places.groupBy("token").agg(F.min("id").alias("a"))
    one = stored(linked(places.join(least, "token").where("id <> a").select("a", F.col("id").alias("b")), points, votes), "links")
    grouped = places.join(components(one.select("a", "b")), F.col("id") == F.col("node"), "left").select("token", "id", F.coalesce("component", "id").alias("g"))
    size = grouped.groupBy("token", "g").agg(F.count(F.lit(1)).alias("n"))
    main = size.groupBy("token").agg(F.max_by("g", F.struct("n", "g")).alias("main"), F.count(F.lit(1)).alias("groups")).where("groups > 1").join(least, "token")
    several = stored(grouped.join(main, "token").select("token", "id", "g", "main", "a"), "several")
    rest = several.where("g <> main").select("token", F.col("id").alias("i"), F.col("g").alias("gi"), F.col("main").alias("m"), F.col("a").alias("head"))
    # A pair with one image in the main group comes once; one outside it comes from either side, so one way is taken.
    both = rest.join(several.select("token", "id", "g"), "token").where("gi <> g and i <> head and id <> head and (g = m or i < id)")
    two = linked(both.select(F.least("i", "id").alias("a"), F.greatest("i", "id").alias("b")), points, votes)
    return one.unionByName(stored(two, "links"))


def visible(html: Column) -> Column:
    """The text of a page, a block element a line; empty lines don't show."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(?:(script|style)\b.*?</\1\s*+>|!--.*?-->)", "")
    out = F.regexp_replace(out, r"(?i)</?(?:p|div|li|ul|h[1-6]|br|tr|td|table|article|nav|body|title)\b[^>]*+>", "\n")
    return F.regexp_replace(out, r"<[^>]*+>", "")


def op7_image_copies(spark, sf_dir: str) -> DataFrame:
    """All pages, rendered as images, with their keypoints counted and their group of copies.

    The tables hold no pictures, so a page's text, drawn line by line, is its image.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("long").alias("id"), visible(F.col("html")).alias("image"))
    points = stored(described(pages, render), "points")
    pairs = stored(copies(points), "copies")
    most = pairs.select(F.explode(F.array("a", "b")).alias("n"), "votes").groupBy("n").agg(F.count(F.lit(1)).alias("n_links"), F.max("votes").alias("votes"))
    groups = components(pairs.select("a", "b")).join(most, F.col("node") == F.col("n"), "left")
    out = points.select("id", F.size("points").cast("long").alias("n_keypoints")).join(groups, F.col("id") == F.col("node"), "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("id").alias("page_id"), "n_keypoints", F.coalesce("component", "id").alias("component_id"), F.coalesce("n_links", zero).alias("n_links"), F.coalesce("votes", zero).alias("votes"))
