"""Token counts by finite-state transducers compiled from a byte-level BPE file.

Two deterministic machines replace the tokenizer.

* The splitter reads classes of characters and marks where the pieces begin that merges can't cross. Its
  transitions carry those marks. A text is cut into chunks; for each chunk the map from every state at its
  start to the state at its end is computed, the maps are composed by a parallel prefix scan, and with the
  state at each chunk's start then known all chunks are read at once.
* The counter reads the bytes of a piece. Its state is what the merges of the bytes still to come can depend
  on: the suffixes that some token continues, with the last token before each and the number of tokens
  relative to now. Each transition carries the change in the number of tokens. It is determinised on
  demand: the merges of a prefix end in the one token that ends there and may stand after the last token
  before it, which the merge ranks along the two tokens' inner edges decide.

Equal pieces are counted once per batch, and a table of fixed size remembers counts of pieces of up to 24 bytes
with those bytes. Hashes only say where to look; bytes decide. What class a character has is asked from the library that reads the same file, once per character.

Edge cases: a null text counts as an empty one, with no tokens; special strings within a text are one token
each, and part it, as the library does by default; texts of any length are read whole, in chunks; repeated
rows, empty tables and other columns don't matter to a column function.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clustrel.llm import hashing
from clustrel.llm.common import documents

CHUNK = 128
#: Characters of a batch, and places of the table of counts.
BATCH = 1 << 21
PLACES = 1 << 21
#: Words of eight bytes that a place of the table keeps of its piece; longer pieces aren't kept.
KEPT = 3
#: States of the counter after which it starts anew, to bound memory.
MAX_STATES = 150_000

# Classes of characters.
OTHER, LETTER, NUMBER, BLANK, SPACE, QUOTE, STMD, RV, EL, E_, END = range(11)
N_CLASSES = 11
# States of the splitter.
BOS, IN_L, IN_N, IN_O, ONE_SPACE, ONE_BLANK, MORE_SPACE, MORE_BLANK, Q0, Q_RV, Q_L, DONE = range(12)
N_STATES = 12
HERE, BEFORE = 1, 2  # a piece begins at this character, or at the one before it
_LETTERS = {LETTER, STMD, RV, EL, E_}
_RUN = {IN_L: _LETTERS, IN_N: {NUMBER}, IN_O: {OTHER, QUOTE}}


def _fresh(c: int) -> int:
    """The state after a character that begins a piece."""
    return IN_L if c in _LETTERS else {NUMBER: IN_N, OTHER: IN_O, QUOTE: Q0, SPACE: ONE_SPACE, BLANK: ONE_BLANK, END: BOS}[c]


def _step(q: int, c: int) -> tuple[int, int]:
    """The splitter's transition: next state and marks."""
    if q in (Q_RV, Q_L):  # a quote and r, v or l: a contraction if the right letter follows
        if (q, c) in ((Q_RV, E_), (Q_L, EL)):
            return DONE, 0
        to, out = _step(IN_L, c)
        return to, out | BEFORE
    if c == END or q in (BOS, DONE):
        return _fresh(c), HERE
    if q in _RUN:
        return (q, 0) if c in _RUN[q] else (_fresh(c), HERE)
    if q == Q0:
        if c in (STMD, RV, EL):
            return {STMD: DONE, RV: Q_RV, EL: Q_L}[c], 0
        return (IN_O, 0) if c in (OTHER, QUOTE) else (_fresh(c), HERE)
    if c in (SPACE, BLANK):  # a run of white space
        return MORE_SPACE if c == SPACE else MORE_BLANK, 0
    many = BEFORE if q in (MORE_SPACE, MORE_BLANK) else 0
    if q in (ONE_SPACE, MORE_SPACE):  # its last space goes with what follows
        return (IN_O if c == QUOTE else _fresh(c)), many
    return _fresh(c), many | HERE


_TABLE = [_step(q, c) for q in range(N_STATES) for c in range(N_CLASSES)]
NEXT = np.array([t for t, _ in _TABLE], np.uint8)
MARKS = np.array([m for _, m in _TABLE], np.uint8)


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Row by row, the map that goes through ``first`` and ``then``."""
    return np.take_along_axis(then, first, axis=1)


def scan(maps: np.ndarray) -> np.ndarray:
    """The compositions of maps[:1], maps[:2], ...: a parallel inclusive prefix scan, in log steps."""
    maps, d = maps.copy(), 1
    while d < len(maps):
        maps[d:] = compose(maps[:-d], maps[d:])
        d *= 2
    return maps


def piece_starts(classes: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each character, from the classes of a sequence that begins a text; texts end in END."""
    n = len(classes)
    lanes = max(1, -(-n // CHUNK))
    grid = np.full((lanes, CHUNK), END, np.uint8)
    grid.ravel()[:n] = classes
    by_step = np.ascontiguousarray(grid.T)
    maps = np.tile(np.arange(N_STATES, dtype=np.uint8), (lanes, 1))
    for sym in by_step:
        maps = NEXT[maps * np.uint8(N_CLASSES) + sym[:, None]]
    state = np.full(lanes, BOS, np.uint8)
    state[1:] = scan(maps)[:-1, BOS]
    marks = np.empty((CHUNK, lanes), np.uint8)
    for k, sym in enumerate(by_step):
        at = state * np.uint8(N_CLASSES) + sym
        marks[k] = MARKS[at]
        state = NEXT[at]
    flat = np.ascontiguousarray(marks.T).ravel()[:n]
    starts = (flat & HERE) != 0
    starts[:-1] |= (flat[1:] & BEFORE) != 0
    return starts


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The vocabulary, and whether two tokens may stand side by side."""

    def __init__(self, merges: list) -> None:
        to = byte_of()
        self.rank: dict[tuple[bytes, bytes], int] = {}
        self.left: dict[bytes, list[tuple[bytes, float]]] = {}
        self.right: dict[bytes, list[tuple[bytes, float]]] = {}
        inf = float("inf")
        parts: dict[bytes, tuple[bytes, bytes, int]] = {}
        self.vocab = {bytes([b]) for b in range(256)}
        for r, m in enumerate(merges):
            a, b = (bytes(map(to.__getitem__, x)) for x in (m if isinstance(m, list) else m.split(" ")))
            self.rank[a, b] = r
            if a + b not in self.vocab:
                parts[a + b] = (a, b, r)
                self.vocab.add(a + b)
        self.parts, self.inf = parts, inf
        self.prefixes = {t[:k] for t in self.vocab for k in range(1, len(t))}
        self.known: dict[tuple[bytes, bytes], bool] = {}

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """What stands at the token's edge as merges go on, with the rank of the merge that ends it: from one byte to the token."""
        at, memo = token, (self.left, self.right)[side]
        if token in memo:
            return memo[token]
        up: list[tuple[bytes, float]] = [(token, self.inf)]
        while at in self.parts:
            rank, at = self.parts[at][2], self.parts[at][side]
            up.append((at, rank))
        memo[token] = up[::-1]
        return memo[token]

    def beside(self, a: bytes, b: bytes) -> bool:
        """Whether the merges of the bytes of a and b end in just a and b: no merge across comes before those within."""
        if (a, b) in self.known:
            return self.known[a, b]
        xs, ys, i, j, ok = self.edge(a, 1), self.edge(b, 0), 0, 0, True
        while ok:
            (x, ra), (y, rb) = xs[i], ys[j]
            r = self.rank.get((x, y), self.inf)
            if r < ra and r <= rb:
                ok = False
            elif ra == rb == self.inf:
                break
            elif ra <= rb:
                i += 1
            else:
                j += 1
        if len(self.known) > 1_000_000:
            self.known.clear()
        self.known[a, b] = ok
        return ok


class State(dict):
    """A state of the counter: byte to (state, change in the number of tokens), built when first asked for."""

    __slots__ = ("live", "tail", "own")

    def __missing__(self, byte: int) -> tuple[State, int]:
        found = self[byte] = self.own.follow(self, byte)
        return found


class Counter:
    """The lazily determinised transducer from bytes of a piece to changes in the number of tokens."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.root = self.state(b"", ((0, None, 0),))

    def state(self, tail: bytes, live: tuple) -> State:
        """tail: the longest suffix that a token continues; live: of each such suffix, its length, the token before it, and the number of tokens up to there, less those up to now."""
        found = self.states.get((tail, live))
        if found is None:
            found = self.states[tail, live] = State()
            found.tail, found.live, found.own = tail, live, self
        return found

    def follow(self, q: State, byte: int) -> tuple[State, int]:
        m, b, on = self.merges, bytes([byte]), []
        last, change = None, 0
        for length, before, n in q.live:
            x = q.tail[len(q.tail) - length :] + b
            if last is None and x in m.vocab and (before is None or m.beside(before, x)):
                last, change = x, n + 1
            if x in m.prefixes:
                on.append((length + 1, before, n))
        live = (*((k, t, n - change) for k, t, n in on), (0, last, 0))
        longest = on[0][0] if on else 0
        return self.state((q.tail + b)[len(q.tail) + 1 - longest :], live), change

    def count(self, piece: bytes) -> int:
        q, n = self.root, 0
        for b in piece:
            q, d = q[b]
            n += d
        return n

    def count_all(self, pieces: list[bytes]) -> list[int]:
        if len(self.states) > MAX_STATES:
            self.reset()
        out = []
        for p in pieces:
            q, n = self.root, 0
            for b in p:
                q, d = q[b]
                n += d
            out.append(n)
            if len(self.states) > MAX_STATES:
                self.reset()
        return out


class Tokens:
    """Counts of whole texts."""

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        conf = json.loads(spec)
        pre = conf["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or conf["normalizer"] or conf["model"].get("ignore_merges"):
            raise ValueError("only byte-level BPE files without a normalizer can be compiled")
        added = [t for t in conf["added_tokens"] if not (t["lstrip"] or t["rstrip"] or t["single_word"])]
        if len(added) < len(conf["added_tokens"]):
            raise ValueError("added tokens that take in white space can't be compiled")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.pre = Tokenizer.from_str(spec).pre_tokenizer
        self.counter = Counter(Merges(conf["model"]["merges"]))
        self.classes = np.full(0x110000, 255, np.uint8)
        self.kept = np.zeros((PLACES, KEPT), np.uint64)
        self.sizes = np.zeros(PLACES, np.uint8)  # 0 marks an empty place
        self.counts = np.zeros(PLACES, np.int32)

    def learn(self, points: np.ndarray) -> None:
        """Ask the library for the classes of characters not met before."""
        joined = lambda text: len(self.pre.pre_tokenize_str(text)) == 1
        for p in points.tolist():
            ch = chr(p)
            own = {" ": SPACE, "'": QUOTE, "r": RV, "v": RV, "l": EL, "e": E_} | dict.fromkeys("stmd", STMD)
            self.classes[p] = own.get(ch) or (LETTER if joined("a" + ch) else NUMBER if joined("1" + ch) else OTHER if joined("!" + ch) else BLANK)

    def batch(self, segments: list[str], owners: np.ndarray, n: int) -> np.ndarray:
        """Tokens of each of n texts, from segments that each begin and end a sequence of merges; owners: of each segment, its text."""
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        points = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        unknown = self.classes[points] == 255
        if unknown.any():
            self.learn(np.unique(points[unknown]))
        ends = np.cumsum(lengths + 1) - 1  # places of END in the sequence with ENDs
        text = np.ones(len(points) + len(segments), bool)
        text[ends] = False
        seq = np.full(len(text), END, np.uint8)
        seq[text] = self.classes[points]
        starts = np.flatnonzero(piece_starts(seq))
        stops = np.append(starts[1:], len(seq))
        real = text[starts]
        starts, stops = starts[real], stops[real]
        owner = owners[np.searchsorted(ends, starts)]
        whole = np.frombuffer("\0".join([*segments, ""]).encode("utf-8", "surrogatepass"), np.uint8)
        size = np.ones(len(seq) + 1, np.int64)  # bytes of each character, then where each begins
        size[:-1][text] += (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        begins = np.cumsum(size) - size
        starts, stops = begins[starts], begins[stops]
        out = np.zeros(n, np.int64)
        for lo in range(0, len(starts), BATCH // 4):  # a batch of very long segments goes by in parts
            np.add.at(out, owner[lo : lo + BATCH // 4], self.of_pieces(whole, starts[lo : lo + BATCH // 4], stops[lo : lo + BATCH // 4]))
        return out

    def of_pieces(self, whole: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Tokens of each piece, a span of bytes."""
        if not len(starts):
            return np.zeros(0, np.int64)
        distinct, first, of = np.unique(hashing.hashes(whole, starts, stops), return_index=True, return_inverse=True)
        eight, size = hashing.eights(whole), stops - starts
        other = np.flatnonzero(~hashing.same(whole, eight, starts, size, starts[first[of]], size[first[of]]))  # of other bytes than the first with the hash
        begin, length = starts[first], size[first]
        place = (distinct >> np.uint64(20)) & np.uint64(PLACES - 1)
        short = length <= 8 * KEPT
        kept = np.stack([hashing.part(eight, begin, length, 8 * k) for k in range(KEPT)], axis=1)
        counts = self.counts[place].astype(np.int64)
        new = np.flatnonzero(~(short & (self.sizes[place] == length) & (self.kept[place] == kept).all(axis=1)))
        if len(new):
            counts[new] = self.counter.count_all([whole[a : a + n].tobytes() for a, n in zip(begin[new].tolist(), length[new].tolist(), strict=True)])
            new = new[short[new]]
            one = new[np.unique(place[new], return_index=True)[1]]  # of pieces that share a place one stays
            self.kept[place[one]], self.sizes[place[one]], self.counts[place[one]] = kept[one], length[one], counts[one]
        out = counts[of]
        if len(other):
            out[other] = self.counter.count_all([whole[a:b].tobytes() for a, b in zip(starts[other].tolist(), stops[other].tolist(), strict=True)])
        return out

    def counts_of(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        segments: list[str] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if segments:
                np.add(out, self.batch(segments, np.array(owners), len(texts)), out=out)
                segments.clear()
                owners.clear()
                size = 0

        for i, text in enumerate(texts):
            parts = [text or ""]
            if self.special and self.special.search(parts[0]):
                parts = self.special.split(parts[0])
                out[i] += len(parts) - 1
            for p in parts:
                if size + len(p) > BATCH // 2:
                    flush()
                segments.append(p)
                owners.append(i)
                size += len(p) + 1
        flush()
        return out


@lru_cache(maxsize=2)
def compiled(spec: str) -> Tokens:
    """The machines of a file's text; a worker builds them once."""
    return Tokens(spec)


def token_counter(spark: SparkSession, path: str):
    """A column function: the number of tokens of a text by the tokenizer file at path.

    The file is read on the driver and sent to the executors: a vocabulary, whose size doesn't follow the data.
    """
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf("long")
    def n_tokens(texts: pa.Array) -> pa.Array:
        machine = compiled(spec.value)
        return pa.concat_arrays([pa.array(machine.counts_of(texts.slice(k, 1024).to_pylist()), pa.int64()) for k in range(0, len(texts), 1024)] or [pa.array([], pa.int64())])

    def of(text: Column) -> Column:
        return n_tokens(F.coalesce(text, F.lit("")))

    return of


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Bytes and tokens of all documents, and whether they exceed 1,024 tokens."""
    import public_tokenizers

    tokens = token_counter(spark, public_tokenizers.path("byte_bpe_50k.json"))
    docs = documents(spark, sf_dir).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), tokens(F.col("text")).alias("n_tokens"))
    return docs.withColumn("over_limit", F.col("n_tokens") > 1024)
