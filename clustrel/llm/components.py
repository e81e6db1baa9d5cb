"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from clustrel.llm.common import forget, stored

#: Edges that a task gathers before it thins them out.
CHUNK = 1 << 18


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From edges (a, b): for each chunk of them, an edge from every node but the least of its part to that least node."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    def out() -> pa.RecordBatch:
        rows = [(x, find(x)) for x in root]
        root.clear()
        kept = np.array([r for r in rows if r[0] != r[1]], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(kept[:, 0]), pa.array(kept[:, 1])], ["u", "v"])

    for b in batches:
        for x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
        if len(root) > CHUNK:
            yield out()
    yield out()


def _dealt(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) dealt by u, once each, and the least of each u and its v: both from one shuffle."""
    by = e.repartition("u").dropDuplicates(["u", "v"])
    return by, by.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, component: of edges(a, b), every node and the least node that can be reached from it.

    Each task first thins its edges to forests. Then large-star and small-star steps take turns until the edges stay
    the same; the number of rounds grows with the logarithm of the longest path. A step is one shuffle of
    edges of 16 bytes, sorted and streamed, so that a node with very many neighbours is never held in memory.
    Each round's edges are written to the shared folder, and those of the round before deleted. Loops and repeated edges don't matter; no edges
    give no rows.
    """
    e = stored(edges.select("a", "b").where("a is not null and b is not null").mapInArrow(_forest, "u long, v long"), "edges")
    before = None  # of the round before: how many edges, and two sums of 64-bit hashes of them
    for _ in range(most):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        arcs, least = _dealt(both)
        large = arcs.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        arcs, least = _dealt(large)
        small = arcs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
        seen, old = Observation(), e
        sums = [F.sum(F.xxhash64(*more, "u", "v").cast("decimal(38,0)")) for more in ([], [F.lit(1)])]
        e = stored(small.observe(seen, F.count(F.lit(1)).alias("n"), *(s.alias(f"h{k}") for k, s in enumerate(sums))), "edges")
        forget(old)
        now = (seen.get["n"], seen.get["h0"], seen.get["h1"])
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))).alias("x")).select("x.*").distinct()
