"""Pricing by centre: in few dimensions, boxes of centres are split until their bounds close.

A set's cost less duals is the least, over centres y, of the sum of its items' ``inner + weight * |mean - y|^2 -
lam``, so the best set of all is found where the sum of the negative ones of these is least. Over a box of
centres some items are in for every y, some out, and the fringe is either. The bound keeps the first as one
quadratic, whose least value in a box is known, and puts a chord below the bend of each item of the fringe, which
is a quadratic too. A box whose fringe is small is closed by trying the fringe's subsets, which are real sets.
Pairs that mustn't meet split a box into one without either item. Boxes with the least bounds go first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from clustrel.operators.pricing import SCHEMA, Items

#: Dimensions up to which boxes are worth it, items of a fringe whose subsets are tried, values of a batch of boxes.
MAX_DIM, FRINGE, VALUES = 6, 6, 1 << 18


@dataclass
class Boxes:
    """Corners (box, dim), items left out (box, item), and bounds known."""

    lo: np.ndarray
    hi: np.ndarray
    out: np.ndarray
    bound: np.ndarray

    def take(self, at: np.ndarray) -> Boxes:
        return Boxes(self.lo[at], self.hi[at], self.out[at], self.bound[at])

    @staticmethod
    def join(parts: list[Boxes]) -> Boxes:
        return Boxes(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("lo", "hi", "out", "bound")))


class Search:
    """The best sets found, by value, and the boxes still open."""

    def __init__(self, items: Items, keep: int = 50, tol: float = 1e-9):
        self.w, self.m, self.keep = items.weight, items.mean, keep
        self.gain = items.lam - items.inner
        self.apart = np.array(sorted(items.apart), int).reshape(-1, 2)
        self.sets: dict[bytes, float] = {}
        self.best, self.tol = np.inf, tol * (1 + float(np.abs(items.lam).sum()))
        self.second = self.w * (self.m * self.m).sum(1) - self.gain  # of a set: the sum of these less weight * |mean|^2
        self.offer(np.eye(len(self.w), dtype=bool))

    def start(self) -> Boxes:
        use = self.gain > 0
        if not use.any():
            n, d = 0, self.m.shape[1]
            return Boxes(np.zeros((0, d)), np.zeros((0, d)), np.zeros((0, len(self.w)), bool), np.zeros(n))
        return Boxes(self.m[use].min(0)[None], self.m[use].max(0)[None], ~use[None], np.array([-np.inf]))

    def offer(self, sets: np.ndarray) -> None:
        """Sets (set, item) without forbidden pairs, of which the best ones are kept."""
        weight = sets @ self.w
        sets, weight = sets[weight > 0], weight[weight > 0]
        if not len(sets):
            return
        value = sets @ self.second - ((sets @ (self.w[:, None] * self.m)) ** 2).sum(1) / weight
        self.best = min(self.best, float(value.min()))
        for t in np.argsort(value, kind="stable")[: self.keep]:
            self.sets[np.packbits(sets[t]).tobytes()] = float(value[t])
        if len(self.sets) > 4 * self.keep:
            self.sets = dict(sorted(self.sets.items(), key=lambda s: s[1])[: self.keep])

    def parted(self, sets: np.ndarray, worth: np.ndarray) -> np.ndarray:
        """The sets, of each forbidden pair in them without the item that is worth less."""
        sets = sets.copy()
        for a, b in self.apart:
            both = sets[:, a] & sets[:, b]
            first = worth[:, a] <= worth[:, b]
            sets[both & first, b] = False
            sets[both & ~first, a] = False
        return sets

    def split(self, boxes: Boxes) -> Boxes:
        """The open parts of boxes; sets met on the way are offered."""
        near = np.zeros((len(boxes.lo), len(self.w)))
        far = np.zeros_like(near)
        for k in range(self.m.shape[1]):
            up, down = self.m[:, k] - boxes.hi[:, k, None], boxes.lo[:, k, None] - self.m[:, k]
            near += np.maximum(np.maximum(up, down), 0) ** 2
            far += np.maximum(-up, -down) ** 2
        low, high = self.w * near - self.gain, self.w * far - self.gain
        live = ~boxes.out & (low < 0)
        sure = live & (high <= 0)
        fringe = live & ~sure
        share = np.where(fringe, -low / np.where(fringe, high - low, 1), 0.0)
        chord, y = self.bounded(sure + share, -(share * np.where(fringe, high, 0)).sum(1), boxes)
        inside, _ = self.bounded(sure.astype(float), np.where(fringe, low, 0).sum(1), boxes)
        bound = np.maximum(np.maximum(chord, inside), boxes.bound)
        worth = self.w * sum((self.m[:, k] - y[:, k, None]) ** 2 for k in range(self.m.shape[1])) - self.gain
        self.offer(self.parted(~boxes.out & (worth < 0), worth))
        at = np.flatnonzero(bound < self.best - self.tol)
        if not len(at):
            return boxes.take(at)
        boxes, live, sure, fringe = boxes.take(at), live[at], sure[at], fringe[at]
        boxes.bound = bound[at]
        small = fringe.sum(1) <= FRINGE
        meet = live[:, self.apart[:, 0]] & live[:, self.apart[:, 1]]
        clash = meet.any(1)
        self.close(sure[small & ~clash], fringe[small & ~clash])
        parts = []
        t = np.flatnonzero(small & clash)
        if len(t):
            pair = self.apart[meet[t].argmax(1)]
            for side in (0, 1):
                p = boxes.take(t)
                p.out[np.arange(len(t)), pair[:, side]] = True
                parts.append(p)
        t = np.flatnonzero(~small)
        if len(t):
            a, b = boxes.take(t), boxes.take(t)
            k = (a.hi - a.lo).argmax(1)
            row = np.arange(len(t))
            mid = (a.lo[row, k] + a.hi[row, k]) / 2
            # Items that stand on one spot can't be told apart by smaller boxes; such a box stays open.
            stuck = (mid <= a.lo[row, k]) | (mid >= a.hi[row, k])
            if stuck.any():
                raise ArithmeticError("a box can't be split further")
            a.hi[row, k] = mid
            b.lo[row, k] = mid
            parts += [a, b]
        return Boxes.join(parts) if parts else boxes.take(np.zeros(0, int))

    def bounded(self, share: np.ndarray, more: np.ndarray, boxes: Boxes) -> tuple[np.ndarray, np.ndarray]:
        """The least value over each box of the quadratic of items taken in shares, plus ``more``, and where it is taken."""
        weight = share @ self.w
        some = np.maximum(weight, 1e-300)[:, None]
        mean = np.where(weight[:, None] > 0, (share @ (self.w[:, None] * self.m)) / some, (boxes.lo + boxes.hi) / 2)
        y = np.clip(mean, boxes.lo, boxes.hi)
        return share @ self.second + weight * (((y - mean) ** 2).sum(1) - (mean * mean).sum(1)) + more, y

    def close(self, sure: np.ndarray, fringe: np.ndarray) -> None:
        """Offer each box's sure items with each subset of its fringe."""
        if not len(sure):
            return
        order = np.argsort(~fringe, axis=1, kind="stable")[:, :FRINGE]
        real = np.take_along_axis(fringe, order, 1)
        row = np.arange(len(sure))
        for mask in range(1 << int(fringe.sum(1).max())):
            sets = sure.copy()
            for k in range(order.shape[1]):
                if mask >> k & 1:
                    sets[row, order[:, k]] |= real[:, k]
            self.offer(sets)

    def run(self, boxes: Boxes, most: int) -> Boxes:
        """Split at most so many boxes, least bounds first; what stays open."""
        size = max(16, VALUES // len(self.w))
        done = 0
        while len(boxes.lo) and done < most:
            boxes = boxes.take(np.flatnonzero(boxes.bound < self.best - self.tol))
            order = np.argsort(boxes.bound, kind="stable")
            now, later = boxes.take(order[:size]), boxes.take(order[size:])
            done += len(now.lo)
            boxes = Boxes.join([self.split(now), later])
        return boxes.take(np.flatnonzero(boxes.bound < self.best - self.tol))

    def rows(self, items: Items, bound: float, exact: bool) -> list[tuple]:
        out = []
        for key, value in sorted(self.sets.items(), key=lambda s: s[1])[: self.keep]:
            held = np.flatnonzero(np.unpackbits(np.frombuffer(key, np.uint8), count=len(self.w))).tolist()
            out.append((held[0], sorted(p for t in held for p in items.members[t]), value, bound, exact))
        return out


COLUMNS = ["seed", "members", "value", "bound", "exact"]


def price(spark: SparkSession, items: Items, limit: int = 1 << 16, keep: int = 50) -> pd.DataFrame:
    """The best sets, each with the bound that holds for all sets and whether the search ended: pricing's SCHEMA.

    The first boxes are split here; if some stay open after ``limit`` of them, they are dealt to tasks, which split
    so many each. What is open then lowers the bound.
    """
    shift = np.average(items.mean, axis=0, weights=items.weight)
    items = Items(items.weight, items.mean - shift, items.inner, items.lam, items.apart, items.members)
    search = Search(items, keep)
    left = search.run(search.start(), limit)
    if not len(left.lo):
        return pd.DataFrame(search.rows(items, search.best - search.tol, True), columns=COLUMNS)
    parts = 4 * spark.sparkContext.defaultParallelism
    held = spark.sparkContext.broadcast((items, left, search.best))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, every, best = held.value
        for b in batches:
            rows = []
            for part in b["id"].tolist():
                mine = Search(own, keep)
                mine.best = min(mine.best, best)
                rest = mine.run(every.take(np.arange(part, len(every.lo), parts)), limit)
                rows += mine.rows(own, min([mine.best - mine.tol, *rest.bound]), not len(rest.lo))
            yield pd.DataFrame(rows, columns=COLUMNS)

    found = spark.range(parts).repartition(parts).mapInPandas(run, SCHEMA).toPandas()
    exact, bound = bool(found["exact"].all()), float(min(search.best - search.tol, found["bound"].min()))
    whole = pd.concat([pd.DataFrame(search.rows(items, bound, exact), columns=COLUMNS), found], ignore_index=True).assign(bound=bound, exact=exact)
    whole["key"] = whole["members"].map(tuple)
    return whole.drop_duplicates("key").drop(columns="key").sort_values("value", kind="stable", ignore_index=True).head(keep)
