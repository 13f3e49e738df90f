"""Orbit counts of each node by equations, without sets of the full size.

Sets of k-1 nodes ask how many other nodes are adjacent to all of some of their
nodes; the sums of the answers solve for the orbits (``functions.equations``).
For one node the answer is its degree, for two or three the number of sets,
among those at hand, in which a node is adjacent to all the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.functions import atlas, equations
from motifloom.operators import four, sets
from motifloom.operators.graph import Graph
from motifloom.session import store


def common(grown: DataFrame, m: int) -> DataFrame:
    """``(marks, n)``: common neighbours of the ``m`` nodes ``marks``, from all connected sets of ``m + 1``."""
    places = grown.select("nodes", F.posexplode("bits").alias("p", "near")).where(F.bit_count("near") == m)
    marks = F.expr("array_remove(nodes, nodes[p])")
    return places.select(marks.alias("marks")).groupBy("marks").agg(F.count("*").alias("n"))


def cliques(g: Graph, k: int) -> DataFrame:
    """``(nodes)`` of each clique of ``k`` nodes, 4 or 5, ascending."""
    four_ = four.cliques(g)
    if k == 4:
        return four_.select(F.array("x", "y", "z", "w").alias("nodes"))
    other = four_.select("x", "y", "z", F.col("w").alias("t"))
    both = four_.join(other, ["x", "y", "z"]).where("w < t")
    return both.join(g.edge.select(F.col("u").alias("w"), F.col("v").alias("t")), ["w", "t"]).select(F.array("x", "y", "z", "w", "t").alias("nodes"))


def _dimension(g: Graph, k: int) -> DataFrame:
    """``(code, size, marks, inside, targets)`` for each set shape and marked places."""
    rows: dict[tuple, list] = {}
    for r in equations.requests(k):
        rows.setdefault((r["code"], r["size"], tuple(r["marks"]), r["inside"]), []).append((r["place"], r["sum"]))
    schema = "code int, size int, marks array<int>, inside int, targets array<struct<place:int,sum:int>>"
    return g.edge.sparkSession.createDataFrame([(c, s, list(m), i, t) for (c, s, m, i), t in rows.items()], schema)


def solved(g: Graph, grown: dict[int, DataFrame], k: int) -> DataFrame:
    """``(node, orbit, cnt)`` of the orbits of size ``k``, 4 or 5, from connected sets of 3 to k-1 nodes; zeros are left out."""
    spark = g.edge.sparkSession
    code = F.expr(f"aggregate(transform(bits, (b, i) -> shiftleft(b, {k - 1} * i)), 0, (x, y) -> x + y)")
    dim = F.broadcast(_dimension(g, k))  # of fixed size
    asked = grown[k - 1].select("nodes", code.alias("code")).join(dim, "code")
    asked = asked.select("nodes", "size", "inside", "targets", F.transform("marks", lambda p: F.get("nodes", p)).alias("marks"))
    sums = None
    for size in sorted({r["size"] for r in equations.requests(k)}):
        known = g.degree.select(F.array("u").alias("marks"), F.col("d").alias("n")) if size == 1 else common(grown[size + 1], size)
        found = asked.where(F.col("size") == size).join(known, "marks")
        each = found.withColumn("c", F.col("n") - F.col("inside")).where("c > 0").select("nodes", "c", F.inline("targets"))
        some = each.select(F.get("nodes", F.col("place")).alias("node"), "sum", "c")
        sums = some if sums is None else sums.union(some)
    full = max(r["orbit"] for r in atlas.orbits(k))
    sums = sums.union(cliques(g, k).select(F.explode("nodes").alias("node"), F.lit(full).alias("sum"), F.lit(1).cast("long").alias("c")))
    sums = sums.groupBy("node", "sum").agg(F.sum("c").alias("s"))
    inverse = F.broadcast(atlas.table(spark, equations.solution(k), ["sum", "orbit", "num", "den"]))
    counts = sums.join(inverse, "sum").groupBy("node", "orbit", "den").agg(F.sum(F.col("s") * F.col("num")).alias("x"))
    return counts.select("node", "orbit", F.expr("x div den").alias("cnt")).where("cnt > 0")


def node_orbits(g: Graph, k: int) -> DataFrame:
    """``(node, orbit, cnt)`` of all orbits up to size ``k``, 3 to 5; orbit 0 is the degree."""
    if k not in (3, 4, 5):
        raise ValueError("k is 3, 4 or 5")
    grown = {3: store(sets.connected_sets(g, 3), "sets3").read()}
    if k == 5:
        grown[4] = store(sets.connected_sets(g, 4), "sets4").read()
    out = g.degree.select(F.col("u").alias("node"), F.lit(0).alias("orbit"), F.col("d").alias("cnt"))
    out = out.union(sets.orbits(sets.with_type(grown[3], 3), 3))
    for size in range(4, k + 1):
        out = out.union(solved(g, grown, size))
    return out
