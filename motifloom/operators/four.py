"""Counts of four-node graphlets by linear equations over small statistics.

Only triangles, their pairs, and common neighbours of node pairs are joined;
no set of four nodes but the cliques is enumerated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifloom.functions import atlas
from motifloom.operators import blocks
from motifloom.operators.graph import Graph


def _choose(x: str, n: int) -> Column:
    return F.expr(f"({x}) * (({x}) - 1) div 2" if n == 2 else f"({x}) * (({x}) - 1) * (({x}) - 2) div 6")


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def cliques(g: Graph) -> DataFrame:
    """``(x, y, z, w)``: two triangles on an edge whose other corners are linked; x < y < z < w."""
    t = g.triangles
    both = t.join(t.withColumnRenamed("z", "w"), ["x", "y"]).where("z < w")
    return both.join(g.edge.select(F.col("u").alias("z"), F.col("v").alias("w")), ["z", "w"]).select("x", "y", "z", "w")


def _per_edge(g: Graph) -> DataFrame:
    """``(t, su, sv)``: triangles on each edge, and open wedges at either end."""
    rows = g.support.join(g.with_degrees.hint("merge"), ["u", "v"])
    return rows.select("t", (F.col("du") - F.col("t") - 1).alias("su"), (F.col("dv") - F.col("t") - 1).alias("sv"))


def _sums(g: Graph) -> DataFrame:
    """One row of the sums that the equations need."""
    if g.by_lists:
        return _sums_read(g)
    e = g.support.join(g.with_degrees.hint("merge"), ["u", "v"]).agg(
        _sum(_choose("t", 2)).alias("pairs"), F.expr("cast(coalesce(sum(t), 0) div 3 as bigint)").alias("tri"), _sum(F.expr("(du - 1) * (dv - 1)")).alias("ends")
    )
    k4 = cliques(g).agg(F.count("*").alias("k4"))
    quads = g.pairs_of_paths.select(F.expr("n div 2").alias("quads"))
    nodes = g.degree.join(g.node_triangles.hint("merge"), "u", "left").agg(_sum(_choose("d", 3)).alias("threes"), _sum(F.expr("coalesce(t, 0) * (d - 2)")).alias("tails"))
    return e.crossJoin(k4).crossJoin(quads).crossJoin(nodes)  # one row each


def _sums_read(g: Graph) -> DataFrame:
    """The same from rows of edges with their degrees: a node's sum is one over its edges."""
    e = g.edges_read.agg(
        _sum(_choose("t", 2)).alias("pairs"), F.expr("cast(coalesce(sum(t), 0) div 3 as bigint)").alias("tri"), _sum(F.expr("(du - 1) * (dv - 1)")).alias("ends"),
        F.expr("coalesce(sum((du - 1) * (du - 2) + (dv - 1) * (dv - 2)), 0) div 6").alias("threes"), F.expr("coalesce(sum(t * (du + dv - 4)), 0) div 2").alias("tails"),
    )
    corners = blocks.corners_read(g.edge.sparkSession, g.lists)
    k4 = corners.join(g.edge.select(F.col("u").alias("z"), F.col("v").alias("w")).hint("shuffle_hash"), ["z", "w"]).agg(F.count("*").alias("k4"))
    return e.crossJoin(k4).crossJoin(g.pairs_of_paths.select(F.expr("n div 2").alias("quads")))  # one row each


def graphlet4(g: Graph) -> DataFrame:
    """``(type, name, cnt)``."""
    r = _sums(g).withColumn("dia", F.expr("pairs - 6 * k4"))
    r = r.withColumn("c4", F.expr("quads - dia - 3 * k4")).withColumn("paw", F.expr("tails - 4 * dia - 12 * k4"))
    r = r.withColumn("star", F.expr("threes - paw - 2 * dia - 4 * k4"))
    r = r.withColumn("path", F.expr("ends - 3 * tri - 2 * paw - 4 * c4 - 6 * dia - 12 * k4"))
    names = ("path", "star", "c4", "paw", "dia", "k4")
    rows = F.array(*[F.struct(F.lit(i).alias("type"), F.lit(g4["name"]).alias("name"), F.col(c).alias("cnt")) for i, (c, g4) in enumerate(zip(names, atlas.graphlets(4), strict=True))])
    return r.select(F.inline(rows))


def identities(g: Graph, counted: DataFrame) -> DataFrame:
    """``(id, lhs, rhs)``: six sums over edges, and what the counts ``(type, cnt)`` make of them."""
    left = _per_edge(g).agg(
        _sum(_choose("t + su + sv", 2)).alias("n1"), _sum(_choose("su + sv", 2)).alias("n2"), _sum(_choose("t", 2)).alias("n3"),
        _sum(F.expr("t * (su + sv)")).alias("n4"), _sum(F.expr("su * sv")).alias("n5"), _sum(_choose("su", 2) + _choose("sv", 2)).alias("n6"),
    )
    right = counted.agg(*[_sum(F.when(F.col("type") == i, F.col("cnt"))).alias(f"g{i}") for i in range(6)])
    sides = (
        "3 * g1 + 3 * g3 + 4 * g2 + g0 + 5 * g4 + 6 * g5", "3 * g1 + g3 + 4 * g2 + g0", "g4 + 6 * g5",
        "2 * g3 + 4 * g4", "g0 + 4 * g2", "3 * g1 + g3",
    )
    rows = F.array(*[F.struct(F.lit(i + 1).alias("id"), F.col(f"n{i + 1}").alias("lhs"), F.expr(s).alias("rhs")) for i, s in enumerate(sides)])
    return left.crossJoin(right).select(F.inline(rows))


def neighbor_sides(g: Graph) -> DataFrame:
    """``(u, v, x, side)``: the ends' other neighbours for each edge: -1 only of u, 0 of both, 1 only of v."""
    e = g.edge
    of_u = e.join(g.adj.select("u", F.col("v").alias("x")), "u").where("x <> v").select("u", "v", "x", F.lit(1).alias("bit"))
    of_v = e.join(g.adj.select(F.col("u").alias("v"), F.col("v").alias("x")), "v").where("x <> u").select("u", "v", "x", F.lit(2).alias("bit"))
    bits = of_u.union(of_v).groupBy("u", "v", "x").agg(F.bit_or("bit").alias("b"))
    return bits.select("u", "v", "x", F.expr("case b when 1 then -1 when 3 then 0 else 1 end").alias("side"))


def edge_stats(g: Graph) -> DataFrame:
    """``(u, v, t, su, sv, k4, c4)``: triangles, open wedges at u and v, cliques and induced cycles of four on each edge."""
    sides = neighbor_sides(g)
    # Pairs of neighbours that are linked; neighbours of both ends make cliques, of one each cycles.
    linked = sides.withColumnRenamed("x", "a").join(g.adj.select(F.col("u").alias("a"), F.col("v").alias("x")), "a")
    pairs = linked.join(sides.select("u", "v", "x", F.col("side").alias("other")), ["u", "v", "x"])
    squares = pairs.groupBy("u", "v").agg(
        F.count_if((F.col("side") == 0) & (F.col("other") == 0) & (F.col("a") < F.col("x"))).alias("k4"), F.count_if((F.col("side") == -1) & (F.col("other") == 1)).alias("c4")
    )
    ends = sides.groupBy("u", "v").agg(*[F.count_if(F.col("side") == s).alias(n) for s, n in ((0, "t"), (-1, "su"), (1, "sv"))])
    rows = g.edge.join(ends, ["u", "v"], "left").join(squares, ["u", "v"], "left")
    return rows.select("u", "v", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("t", "su", "sv", "k4", "c4")])


def graphlet4_by_edges(g: Graph) -> DataFrame:
    """``(type, name, cnt)`` by another route: each edge's cliques, cycles and wedges."""
    sums = edge_stats(g).agg(
        F.expr("coalesce(sum(k4), 0) div 6").alias("g5"), F.expr("coalesce(sum(c4), 0) div 4").alias("g2"), _sum(_choose("t", 2)).alias("pairs"),
        _sum(F.expr("su * sv")).alias("ends"), _sum(F.expr("t * (su + sv)")).alias("tails"), _sum(_choose("su", 2) + _choose("sv", 2)).alias("forks"),
    )
    r = sums.withColumn("g4", F.expr("pairs - 6 * g5")).withColumn("g0", F.expr("ends - 4 * g2"))
    r = r.withColumn("g3", F.expr("(tails - 4 * g4) div 2")).withColumn("g1", F.expr("(forks - g3) div 3"))
    rows = F.array(*[F.struct(F.lit(d["type"]).alias("type"), F.lit(d["name"]).alias("name"), F.col(f"g{d['type']}").alias("cnt")) for d in atlas.graphlets(4)])
    return r.select(F.inline(rows))
