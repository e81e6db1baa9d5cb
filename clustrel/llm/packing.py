"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents longer than the longest sequence are cut into full sequences and a rest. The pieces are dealt to
blocks of a bounded number of rows; within a block, pieces go from the longest to the shortest into the open
bin that they fill best, of whatever capacity. Where none has room, a bin is opened of the capacity that
costs least per token it can still be given (its price over the smaller of its capacity and the tokens left
in the block); a bin's price grows as its length and, slower, as its square, as attention does. At the end
each bin shrinks to the least permitted capacity that holds its contents. Capacities are thus chosen jointly:
pieces of all lengths compete for the same open bins.

Edge cases: documents without words get one row of length 0 in no bin (block, bin null, capacity 0); a null
text is an empty one; repeated rows are packed each for itself; ties go by id, then piece; rows without an
id are packed like others; an empty table gives no rows; other columns aren't read. Rows are dealt to blocks
by their place in the input, so that copies spread: the same files in the same partitions give the same
packing, another layout another one of like quality.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clustrel.llm.common import documents, n_words, stored

CAPACITIES = (256, 512, 1024, 2048)
#: Rows of a block; the last figure of its task's memory, whatever the input's size.
BLOCK = 8192
SCHEMA = "doc_id long, piece long, start long, length long, block long, bin long, capacity long, offset long"


def price(capacity: int, longest: int) -> float:
    """What a sequence costs: its tokens, and a quarter more for the longest, from attention."""
    return capacity * (1 + 0.25 * capacity / longest)


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """For lengths in descending order, none above the largest capacity: the bin and offset of each, and each bin's final capacity."""
    caps = sorted(capacities)
    prices = [price(c, caps[-1]) for c in caps]
    left = sum(lengths)
    room: list[tuple[int, int]] = []  # of open bins: (room, bin), ascending
    used: list[int] = []
    bins, offsets = [], []
    for n in lengths:
        at = bisect.bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, _, b = min((c for c in zip(caps, prices, [len(used)] * len(caps), strict=True) if c[0] >= n), key=lambda c: (c[1] / min(c[0], left), -c[0]))
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        left -= n
        if free > n:
            bisect.insort(room, (free - n, b))
    return bins, offsets, [caps[bisect.bisect_left(caps, u)] for u in used]


def pack_documents(docs: DataFrame, length: Column, capacities: Sequence[int] = CAPACITIES, block: int = BLOCK) -> DataFrame:
    """Where every piece of every document of docs goes: SCHEMA, a row per piece.

    Only ids and lengths are shuffled. The number of blocks follows the number of pieces, so that no task
    ever holds more than about ``block`` of them.
    """
    longest = max(capacities)
    sized = stored(docs.select("doc_id", length.cast("long").alias("n"), F.monotonically_increasing_id().alias("uid")), "pack")
    rows = sized.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("n") / longest)))).first()[0] or 0
    blocks = max(1, -(-rows // block))
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / longest) - 1))
    pieces = sized.select("doc_id", "n", "uid", F.explode(cuts).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * longest).alias("start"), F.least(F.lit(longest), F.col("n") - F.col("piece") * longest).alias("length"), "uid")
    empty = pieces.where("length = 0").select("doc_id", "piece", "start", "length", *(F.lit(v).cast("long").alias(c) for c, v in (("block", None), ("bin", None), ("capacity", 0), ("offset", 0))))
    full = pieces.where("length > 0").withColumn("block", F.pmod(F.xxhash64("uid", "piece"), F.lit(blocks)))
    own = [int(c) for c in capacities]

    def place(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
        x = pd.concat(list(batches), ignore_index=True) if not isinstance(batches, pd.DataFrame) else batches
        x = x.sort_values(["length", "doc_id", "piece", "uid"], ascending=[False, True, True, True], ignore_index=True)
        bins, offsets, final = pack(x["length"].tolist(), own)
        x["bin"], x["offset"] = bins, offsets
        x["capacity"] = [final[b] for b in bins]
        return x[["doc_id", "piece", "start", "length", "block", "bin", "capacity", "offset"]]

    return full.groupBy("block").applyInPandas(place, SCHEMA).unionByName(empty.select(*(c.split()[0] for c in SCHEMA.split(", "))))


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """The packing of all documents, a word counting as a token."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pack_documents(docs, n_words(F.col("text")))
