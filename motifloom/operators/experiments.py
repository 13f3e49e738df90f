"""The experiments: error sweeps, the comparison of both walks, and reports.

``python -m motifloom.operators.experiments GRAPH K [RUNS]`` prints both for an
edge list; exact counts come from this library.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.operators import estimate, four, graph, orbits, sets, walks
from motifloom.operators.graph import Graph
from motifloom.session import store

#: Steps of the sweep, steps of the comparison, runs, and the width of a printed number.
SWEEP, COMPARED, RUNS, WIDTH = range(2000, 21000, 1000), 20_000, 1000, 10


def exact(g: Graph, k: int) -> DataFrame:
    """``(type, cnt)`` by the operators that don't enumerate sets of k nodes."""
    if k == 3:
        return graph.line_triangle(g, g.triangles).select("type", "cnt")
    if k == 4:
        return four.graphlet4(g).select("type", "cnt")
    return sets.totals(orbits.node_orbits(g, 5), 5)


def count_errors(g: Graph, k: int, truth: DataFrame, steps: Sequence[int] = SWEEP, runs: int = RUNS, seed: int = 42) -> DataFrame:
    """``(variant, steps, type, RV, RE, LB, UB, NRMSE)`` of all variants, with walks of their own for each number of steps."""
    out = None
    for i, n in enumerate(steps):
        path = walks.walk(g.adj, n + k - 2, runs, seed + i, 2 if k == 5 else 1)
        some = estimate.error_metrics(estimate.estimate(g, path, k).withColumn("steps", F.lit(n).cast("long")), truth)
        some = store(some, "sweep").read()
        out = some if out is None else out.union(some)
    return out


def compare_walks(g: Graph, k: int, truth: DataFrame, steps: int | None = None, runs: int = RUNS, seed: int = 42) -> tuple[DataFrame, dict[str, float]]:
    """The metrics of shares from the node walk (Basic) and the state walk (PSRW), and seconds a run of each."""
    steps = COMPARED if steps is None else steps
    variant = "SRW" if k == 3 else "SRWIMPR"

    def basic() -> DataFrame:
        path = walks.walk(g.adj, steps + k - 2, runs, seed, 2 if k == 5 else 1)
        return estimate.concentration(estimate.estimate(g, path, k), variant)

    def states() -> DataFrame:
        return estimate.state_walk_shares(store(walks.state_walk(g.adj, k, steps, runs, seed), "states").read(), k)

    shares, seconds = [], {}
    for name, make in (("Basic", basic), ("PSRW", states)):
        began = time.perf_counter()
        rows = store(make().select(F.lit(name).alias("variant"), "type", F.col("value").alias("estimate")), "shares").read()
        seconds[name] = (time.perf_counter() - began) / max(runs, 1)
        shares.append(rows)
    total = truth.agg(F.sum("cnt").alias("total"))
    share = truth.crossJoin(F.broadcast(total)).select("type", F.try_divide(F.col("cnt").cast("double"), F.col("total")).alias("cnt"))
    return estimate.error_metrics(shares[0].union(shares[1]), share, by=("variant",)), seconds


def vector_line(values: Sequence[float | None]) -> str:
    """Numbers in fixed width, each with a tab behind it."""
    return "".join(f"{'-' if v is None else format(v, 'g'):>{WIDTH}}\t" for v in values)


def report(counted: DataFrame) -> DataFrame:
    """``(type, line)``: name, count and share of each of ``counted(type, name, cnt)``, in fixed width."""
    total = counted.agg(F.sum("cnt").alias("total"))
    share = F.coalesce(F.try_divide(F.col("cnt").cast("double"), F.col("total")), F.lit(0.0))
    rows = counted.crossJoin(F.broadcast(total))  # one row
    return rows.select("type", F.concat(F.rpad("name", 20, " "), F.lpad(F.col("cnt").cast("string"), 20, " "), F.lpad(F.format_string("%.6f", share), 12, " ")).alias("line"))


def print_metrics(metrics: DataFrame) -> None:
    """Each metric of each variant as one line; what is printed is a row for each type and variant."""
    rows = metrics.orderBy("type").collect()
    for name in ("RV", "RE", "LB", "UB", "NRMSE"):
        for variant in sorted({r.variant for r in rows}):
            print(f"{name:<10} {variant} = {vector_line([r[name] for r in rows if r.variant == variant])}")


def main(argv: Sequence[str]) -> None:
    if len(argv) < 2:
        raise SystemExit("usage: experiments GRAPH K [RUNS]")
    from motifloom.sources.edges import read_edge_list

    path, k, runs = argv[0], int(argv[1]), int(argv[2]) if len(argv) > 2 else RUNS
    spark = SparkSession.builder.getOrCreate()
    g = Graph.from_raw(read_edge_list(spark, path))
    truth = store(exact(g, k), "exact").read()
    for n in SWEEP:
        print(f"steps = {n}")
        print_metrics(count_errors(g, k, truth, [n], runs))
    metrics, seconds = compare_walks(g, k, truth, runs=runs)
    print_metrics(metrics)
    print(f"{path} k = {k}, seconds a run: {seconds}")


if __name__ == "__main__":
    main(sys.argv[1:])
