"""Lower bounds for points in the plane by dual ascent, without a master problem.

For any duals lam >= 0, sum(lam) + k * min(0, v) bounds the cost of every partition into k clusters from below, where v
is the least cost less duals of any set. In the plane v is exact: pricing by discs tries every set that could be
best. The duals are a column; of a step only the bound, the size of the best set and the length of the step come to the driver.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustrel.operators import discs
from clustrel.shared import drop, kept


class Step(NamedTuple):
    """Of a step, its bound, the best bound so far, the reduced cost and size of the best set, and the length relative to the mean dual."""

    step: int
    bound: float
    best: float
    value: float
    size: int
    length: float


def plane_dual_bound(start: DataFrame, k: int, steps: int = 10, length: float = 0.25) -> tuple[list[Step], DataFrame]:
    """The steps, and the duals (id, x, y, lam) of the best bound, from discs start(id, x, y, lam).

    A step goes from the duals of the best bound so far, the stability centre, along the subgradient there: every dual
    grows by ``length`` times the mean dual, and those of the centre's best set grow by k - 1 of that less than nothing, down
    to 0 at least. A step without a better bound halves the length. No points give the bound 0.
    """
    trial = kept(start.select("id", "x", "y", F.greatest("lam", F.lit(0.0)).alias("lam")))
    out: list[Step] = []
    centre, inside, best = trial, None, float("-inf")
    for step in range(steps + 1):
        total = trial.agg(F.sum("lam").alias("s"), F.avg("lam").alias("mean")).first()
        if total["s"] is None:
            return [Step(0, 0.0, 0.0, 0.0, 0, length)], trial
        found = kept(discs.best_set(trial).select("rc", F.explode(F.split("members", ",")).alias("id")).withColumn("id", F.col("id").cast("long")))
        row = found.agg(F.min("rc").alias("rc"), F.count(F.lit(1)).alias("n")).first()
        value = min(0.0, row["rc"]) if row["rc"] is not None else 0.0
        bound = total["s"] + k * value
        if bound > best:
            if centre is not trial:
                drop(centre)
            centre, inside, best, mean = trial, found, bound, total["mean"]
        else:
            drop(trial)
            length /= 2
        out.append(Step(step, bound, best, value, row["n"], length))
        if step < steps:
            held = centre.join(inside.select("id", F.lit(1).alias("held")), "id", "left")
            moved = F.col("lam") + F.lit(length * mean) * (1 - k * F.coalesce("held", F.lit(0)))
            trial = kept(held.select("id", "x", "y", F.greatest(moved, F.lit(0.0)).alias("lam")))
    return out, centre
