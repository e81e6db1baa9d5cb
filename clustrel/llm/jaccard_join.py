"""N-gram Jaccard join: links between documents whose sets of word shingles are alike, and their components.

Documents with equal sets are one class from the start. Sizes are cut into bands such that linked sets stand
in the same band or in neighbouring ones, and each band, with the next, is a tile. Within a tile two linked
sets differ by at most H elements; the hash range is cut into H + 1 + e segments, so that at least e + 1
segments agree wholly. A set is filed in its tiles under each of its non-empty segments (and, in the rare case
that it has more than e empty ones, under those), so linked sets always share a file, while a passage that
many documents share fills no segment by itself.

Sets joined by files, at any remove, form a cluster: links stay within clusters. The texts of a cluster meet in
one task where they are few. Larger clusters, which passages that many documents share chain together, are first
taken apart: bitmaps of parities, about a bit for each shingle, meet without texts in large blocks, and sets
that these don't keep apart, at any remove, form the clusters in place of the larger one. Clusters that are still large are cut into blocks of one band of sizes and a bounded number of
shingles, and each pair of blocks of the same or neighbouring bands meets in a task of its own. Bitmaps
are compared whole arrays at a time: each bit that differs stands for an element that only one
set has, which bounds the overlap from above. What remains is decided by the exact intersection of the sorted
arrays, but for pairs that links found before already join. So no pairs are emitted but links, fewer than a
task has sets, and no link between components is lost.

Shingles are known by two independent 64-bit hashes of their words, classes by two more. Edge cases: a text without words, or null, has no
shingles and no links; a text with fewer words than a shingle is one shingle; rows without an id get their
size but no component; rows that share an id are one node; an empty table gives no rows; columns other than id
and text aren't read. Very long texts are whole sets like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clustrel.llm import hashing
from clustrel.llm.common import documents, forget, stored
from clustrel.llm.components import components

#: Most sets and shingles of a block; a task holds two blocks.
BLOCK_SETS, BLOCK_SHINGLES = 2048, 1 << 21
BITS = 2048
#: The same of blocks of which only bitmaps are sent.
ROUGH_SETS, ROUGH_SHINGLES = 1 << 14, 1 << 27
_SALT, _TILE, _EMPTY = (np.uint64(x) for x in (0xA0761D6478BD642F, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))


class Tiles:
    """The bands of sizes, and each tile's number of segments, for a similarity of at least num / den."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.starts = [1]
        self.tiles: list[tuple[int, int, int]] = []  # segments, empty ones allowed, largest size in the tile

    def reach(self, size: int) -> None:
        """Extend the bands beyond a size."""
        while self.starts[-1] <= size or len(self.tiles) < len(self.starts) - 1:
            if self.starts[-1] <= size:
                self.starts.append(self.starts[-1] * self.den // self.num + 1)
            low = self.starts[len(self.tiles) + 1] - 1
            high = low * self.den // self.num
            most = (low + high) * (self.den - self.num) // (self.den + self.num)
            spare = 2 + most // 16
            self.tiles.append((most + 1 + spare if most else 0, spare, high))

    def of(self, size: int) -> list[int]:
        """The tiles in which a set of a size is filed."""
        self.reach(size)
        band = int(np.searchsorted(self.starts, size, side="right")) - 1
        near = [band - 1] if band and size <= self.tiles[band - 1][2] else []
        return [t for t in (*near, band) if self.tiles[t][0]]

    def files(self, x: np.ndarray) -> np.ndarray:
        """The keys of the files of a set of sorted hashes."""
        keys = []
        y = hashing.mix(x ^ _SALT)
        high = x >> np.uint64(32)
        for t in self.of(len(x)):
            m, spare, _ = self.tiles[t]
            segment = (high * np.uint64(m)) >> np.uint64(32)
            first = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
            ids = segment[first]
            tile = np.uint64(int(_TILE) * (t + 1) % (1 << 64))
            keys.append(hashing.mix(np.add.reduceat(y, first) + hashing.mix(ids + tile)))
            if m - len(ids) > spare:
                blank = np.setdiff1d(np.arange(m, dtype=np.uint64), ids, assume_unique=True)
                keys.append(hashing.mix(hashing.mix(blank + tile) ^ _EMPTY))
        return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def set_id(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """128 bits for the set of shingles with the hashes x and y, as two signed longs."""
    both = np.array([hashing.mix(h ^ _SALT).sum(dtype=np.uint64) for h in (x, y)])
    return tuple(both.view(np.int64).tolist())


def in_common(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> int:
    """How many shingles two sets share; the first hash finds, the second confirms."""
    at = np.minimum(np.searchsorted(y[0], x[0]), len(y[0]) - 1)
    hit = y[0][at] == x[0]
    if (y[1][at[hit]] == x[1][hit]).all():
        return int(hit.sum())
    return len({*zip(*(h.tolist() for h in x), strict=True)} & {*zip(*(h.tolist() for h in y), strict=True)})


def bitmap(x: np.ndarray, bits: int = BITS) -> bytes:
    """For each of so many places, a power of two, the parity of the number of elements there."""
    return np.packbits(np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def rough(x: np.ndarray) -> bytes:
    """The bitmap of a set of at least as many places as elements, 256 at least."""
    return bitmap(x, max(256, 1 << (len(x) - 1).bit_length()))


def filed(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n, c1, c2, keys, bits of every row; keys and bits are left out where the task has had the same set before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, seen = Tiles(num, den), set()
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            n, c1, c2, keys, bits = [], [], [], [], []
            for doc, t in zip(ids, b.column("text"), strict=True):
                text = (t.as_py() or "").encode("utf-8", "surrogatepass")
                x, y = hashing.shingles(text, k)
                c = set_id(x, y)
                n.append(len(x))
                c1.append(c[0])
                c2.append(c[1])
                new = len(x) > 0 and doc is not None and c not in seen
                keys.append(tiles.files(x).view(np.int64) if new else np.zeros(0, np.int64))
                bits.append(rough(x) if new else None)
                if new:
                    seen.add(c)
            offsets = pa.array(np.append(0, np.cumsum([len(x) for x in keys])).astype(np.int32))
            held = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), held, pa.array(bits, pa.binary())], ["doc_id", "n", "c1", "c2", "keys", "bits"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, c1 long, c2 long, keys array<long>, bits binary")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, c) in order: an edge from each key's first c to each other. Holds one row between batches."""
    key = head = None
    for b in batches:
        k, c = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        if not len(k):
            continue
        new = np.append(key is None or k[0] != key, k[1:] != k[:-1])
        first = np.flatnonzero(new)
        heads = np.repeat(c[first], np.diff(np.append(first, len(k))))
        lead = first[0] if len(first) else len(k)
        if lead:
            heads = np.append(np.full(lead, head, np.int64), heads)
        key, head = k[-1], heads[-1]
        edges = np.unique(np.stack([heads, c], axis=1)[heads != c], axis=0)
        if len(edges):
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])


class _Sets:
    """The sets of a block: ids, sizes ascending, bitmaps and pairs of arrays."""

    def __init__(self, rows: list[tuple[int, int, int, str]], k: int) -> None:
        held = {}
        for rep, w1, w2, text in rows:
            x = hashing.shingles((text or "").encode("utf-8", "surrogatepass"), k)
            if set_id(*x) == (w1, w2):  # else another row of the same id, of another class
                held[rep] = x
        held = dict(sorted(held.items(), key=lambda r: (len(r[1][0]), r[0])))
        self.ids, self.arrays = list(held), list(held.values())
        self.sizes = np.array([len(x) for x, _ in self.arrays], np.int64)
        self.bits = np.frombuffer(b"".join(bitmap(x) for x, _ in self.arrays), np.uint64).reshape(len(self.ids), BITS // 64)


def _link(one: _Sets, two: _Sets | None, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Links between two blocks, or within one, that join what those before have not."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    other = two or one
    for i, x in enumerate(one.arrays):
        n = len(x[0])
        lo = i + 1 if two is None else int(np.searchsorted(other.sizes, -(-num * n // den)))
        hi = int(np.searchsorted(other.sizes, den * n // num, side="right"))
        if lo >= hi:
            continue
        m = other.sizes[lo:hi]
        apart = np.bitwise_count(other.bits[lo:hi] ^ one.bits[i]).sum(axis=1, dtype=np.int64)
        most = (m + n - apart) // 2
        for j in (np.flatnonzero(den * most >= num * (m + n - most)) + lo).tolist():
            a, b = find(one.ids[i]), find(other.ids[j])
            if a == b:
                continue
            y = other.arrays[j]
            inter = in_common(x, y)
            if den * inter >= num * (n + len(y[0]) - inter):
                root[max(a, b)] = min(a, b)
                yield one.ids[i], other.ids[j]


def _parts(sets: Column, shingles: Column, most: tuple[int, int]) -> Column:
    """How many blocks, of at most so many sets and shingles, some sets and shingles take."""
    return F.greatest(F.ceil(sets / most[0]), F.ceil(shingles / most[1])).cast("int")


def _tiles(members: DataFrame, num: int, den: int, most: tuple[int, int]) -> DataFrame:
    """members(cluster, rep, w1, w2, n) with the tiles in which each is needed: tile, and block, its place there."""
    shape = Tiles(num, den)
    shape.reach(1 << 40)
    band = F.size(F.filter(F.array(*(F.lit(x).cast("long") for x in shape.starts)), lambda x: x <= F.col("n")))
    members = members.withColumn("band", band)
    per = members.groupBy("cluster", "band").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))
    per = per.withColumn("parts", _parts(F.col("sets"), F.col("shingles"), most))
    per = per.groupBy("cluster").agg(_parts(F.sum("sets"), F.sum("shingles"), most).alias("all"), F.map_from_entries(F.collect_list(F.struct("band", "parts"))).alias("by_band"))
    x = members.join(per, "cluster")
    block = lambda b, p: F.format_string("%03d.%09d", b, p)
    mine = F.pmod(F.xxhash64("rep"), F.element_at("by_band", F.col("band"))).cast("int")
    x = x.withColumn("block", F.when(F.col("all") == 1, F.lit("")).otherwise(block(F.col("band"), mine)))
    near = F.flatten(F.transform(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1), lambda b: F.when(
        F.map_contains_key("by_band", b), F.transform(F.sequence(F.lit(0), F.element_at("by_band", b) - 1), lambda p: block(b, p))
    ).otherwise(F.array().cast("array<string>"))))
    pair = lambda o: F.concat_ws("/", F.col("cluster").cast("string"), F.least("block", o), F.greatest("block", o))
    tiles = F.when(F.col("all") == 1, F.array(F.col("cluster").cast("string"))).otherwise(F.transform(near, pair))
    return x.select("rep", "w1", "w2", "n", "block", F.explode(tiles).alias("tile"))


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (set, words) of fewer words, a power of two less."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _near(n: np.ndarray, held: list[bytes], block: np.ndarray, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Pairs of places, of sets of sizes n, that join what bitmaps don't keep apart: those of two blocks, or all if there is one."""
    label = np.arange(len(n))
    groups = []  # by block and length of bitmap, sizes ascending
    length = np.array([len(x) for x in held])
    for b, w in sorted(set(zip(block.tolist(), length.tolist(), strict=True))):
        at = np.flatnonzero((block == b) & (length == w))
        at = at[np.argsort(n[at], kind="stable")]
        groups.append((b, at, np.frombuffer(b"".join(held[i] for i in at.tolist()), np.uint64).reshape(len(at), w // 8)))
    two = len({g[0] for g in groups}) > 1
    for g, (b, one, x) in enumerate(groups):
        for c, other, y in groups[g:]:
            if two and b == c:
                continue
            words = min(x.shape[1], y.shape[1])
            p, q, sizes = _folded(x, words), _folded(y, words), n[other]
            lows = np.searchsorted(sizes, -(-num * n[one] // den)).tolist()
            highs = np.searchsorted(sizes, den * n[one] // num, side="right").tolist()
            for i, (lo, hi) in enumerate(zip(lows, highs, strict=True)):
                lo = max(lo, i + 1) if other is one else lo
                if lo >= hi:
                    continue
                m = sizes[lo:hi] + n[one[i]]
                most = (m - np.bitwise_count(q[lo:hi] ^ p[i]).sum(axis=1, dtype=np.int64)) // 2
                near = other[np.flatnonzero(den * most >= num * (m - most)) + lo]
                while len(near := near[label[near] != label[one[i]]]):
                    yield one[i], near[0]
                    label[label == label[near[0]]] = label[one[i]]


def _apart(members: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """members of the clusters of more than a block taken apart: cluster is that of the sets which their bitmaps, from rows(c1, c2, bits), join; sets joined with none are left out."""
    tiles = stored(_tiles(members, num, den, (ROUGH_SETS, ROUGH_SHINGLES)), "rough")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []

        def close() -> pa.RecordBatch:
            _, block, w1, n, bits = zip(*held, strict=True) if held else [()] * 5
            names = {b: k for k, b in enumerate(sorted(set(block)))}
            pairs = list(_near(np.array(n, np.int64), bits, np.array([names[b] for b in block], np.int64), num, den)) if held else []
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w1[x[s]] for x in pairs], pa.int64()) for s in (0, 1)], ["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != tile and held:
                    yield close()
                tile = row[0]
                held.append(row)
        yield close()

    bits = rows.where("bits is not null").select("c1", "c2", "bits")
    one = bits.join(members.select(F.col("w1").alias("c1"), F.col("w2").alias("c2")), ["c1", "c2"]).dropDuplicates(["c1", "c2"])
    sent = tiles.hint("merge").join(one, (F.col("w1") == F.col("c1")) & (F.col("w2") == F.col("c2"))).select("tile", "block", "w1", "n", "bits")
    near = sent.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long")
    found = components(near)
    forget(tiles)
    return members.drop("cluster").join(found, F.col("w1") == F.col("node")).select(F.col("component").alias("cluster"), "rep", "w1", "w2", "n")


def _compared(rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The links of rows(tile, block, rep, w1, w2, text), which come in order of tile."""

    def close(held: list[tuple]) -> list[tuple[int, int]]:
        blocks = sorted({r[0] for r in held})
        sets = [_Sets([r[1:] for r in held if r[0] == b], k) for b in blocks]
        return list(_link(sets[0], sets[1] if len(sets) > 1 else None, num, den))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, links = None, [], []
        out = lambda: pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["ra", "rb"])
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != tile:
                    links += close(held) if held else []
                    tile, held = row[0], []
                held.append(row[1:])
            yield out()
            links = []
        links += close(held) if held else []
        yield out()

    ordered = rows.repartition("tile").sortWithinPartitions("tile").select("tile", "block", "rep", "w1", "w2", "text")
    return ordered.mapInArrow(run, "ra long, rb long")


def join(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of docs(doc_id, text): links at a Jaccard similarity of num / den or more of shingles of k words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(filed(docs, k, num, den), "filed")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"))
    entries = rows.select(F.explode("keys").alias("key"), F.col("c1").alias("c"))
    stars = entries.repartition("key").sortWithinPartitions("key", "c").mapInArrow(_stars, "a long, b long")
    clusters = components(stars)
    members = classes.join(clusters, F.col("c1") == F.col("node")).select(F.col("component").alias("cluster"), "rep", F.col("c1").alias("w1"), F.col("c2").alias("w2"), "n")
    members = stored(members, "members")
    block = BLOCK_SETS, BLOCK_SHINGLES
    sizes = members.groupBy("cluster").agg(_parts(F.count(F.lit(1)), F.sum("n"), block).alias("all"))
    large = stored(members.join(sizes.where("all > 1").select("cluster"), "cluster"), "large")
    if not large.isEmpty():
        small = members.join(sizes.where("all = 1").select("cluster"), "cluster", "left_semi")
        both, old = stored(small.unionByName(_apart(large, rows, num, den)), "members"), members
        forget(old)
        members = both
    forget(large)
    tiles = stored(_tiles(members, num, den, block), "tiles")
    links = stored(_compared(docs.join(tiles.hint("merge"), F.col("doc_id") == F.col("rep")), k, num, den), "links")
    forget(members)
    forget(tiles)
    found = components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    named = classes.join(found, F.col("rep") == F.col("node"), "left").select("c1", "c2", F.coalesce("component", "rep").alias("comp"))
    own = rows.select("doc_id", F.col("n").alias("n_shingles"), "c1", "c2")
    out = own.join(named, ["c1", "c2"], "left")
    comp = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("comp"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs, with of each component only the row of the least id; rows without an id stay.

    Rows that share an id and the text count as one, of which one stays. Rows that share an id alone are
    documents of their own: each is known by a hash of id and text.
    """
    own = docs.columns
    boxed = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.col("doc_id").cast("long").alias("id"), "text")
    nameless = boxed.where("id is null").select("row.*")
    shared = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit(True).alias("many"))
    if shared.isEmpty():
        kept = join(docs, k, num, den).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id"))
        return boxed.join(kept, F.col("id") == F.col("kept_id"), "left_semi").select("row.*").unionByName(nameless)
    node = F.when(F.col("many"), F.xxhash64("id", "text")).otherwise(F.col("id"))
    boxed = stored(boxed.where("id is not null").join(shared, "id", "left").withColumn("node", node).drop("many").dropDuplicates(["id", "node"]), "boxed")
    found = join(boxed.select(F.col("node").alias("doc_id"), "text"), k, num, den)
    kept = boxed.select("id", "node").join(found, F.col("node") == F.col("doc_id")).groupBy("component_id").agg(F.min(F.struct("id", "node")).alias("m")).select(F.col("m.node").alias("kept_id"))
    return boxed.join(kept, F.col("node") == F.col("kept_id"), "left_semi").select("row.*").unionByName(nameless)


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents at 85 hundredths of four-word shingles."""
    return join(documents(spark, sf_dir), 4, 85, 100)
