"""python -m clustrel.cli --data FILE --k K [--format csv|tsplib|parquet] ...: cluster a file of points."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from clustrel.operators import solver
from clustrel.sources import points as src


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--data", required=True)
    p.add_argument("--k", type=int, required=True)
    p.add_argument("--format", choices=("csv", "tsplib", "parquet"), default="csv")
    p.add_argument("--cols", help="comma-separated positions of the features")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--restarts", type=int, default=8)
    p.add_argument("--max-nodes", type=int, default=200)
    p.add_argument("--output", help="file for the result and the assignment, as JSON")
    p.add_argument("--max-columns", type=int, default=50, help="columns that may enter in a round")
    p.add_argument("--max-rounds", type=int, default=300, help="rounds of column generation at a node")
    p.add_argument("--quiet", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("clustrel").getOrCreate()
    cols = [int(c) for c in a.cols.split(",")] if a.cols else None
    rows = {"csv": lambda: src.read_csv(spark, a.data, cols), "tsplib": lambda: src.read_tsplib(spark, a.data), "parquet": lambda: src.read_vectors(spark, a.data)}[a.format]()
    result = solver.solve(rows, a.k, a.restarts, a.seed, a.max_nodes, a.max_rounds, batch=a.max_columns)
    if not a.quiet:
        solver.as_frames(spark, result)[0].show(truncate=False)
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            json.dump(solver.as_dict(result), f)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
