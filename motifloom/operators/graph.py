"""Graph preparation and exact statistics of nodes, edges and triangles.

Tables: ``raw(src, dst)`` as read; ``edge(u, v)`` with u < v, distinct and
without loops; ``adj(u, v)`` both directions; ``nbr(u, nbrs, d)`` sorted arrays.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifloom.operators import blocks, lists
from motifloom.operators.components import components, components_of_stored
from motifloom.session import scratch, store

def scan_stats(raw: DataFrame) -> DataFrame:
    """``(n_raw, loops, n_kept, n_edges)``: lines, loops, the rest, and different edges among it."""
    loops = F.count_if(F.col("src") == F.col("dst"))
    pair = F.when(F.col("src") != F.col("dst"), F.struct(F.least("src", "dst"), F.greatest("src", "dst")))
    return raw.agg(F.count("*").alias("n_raw"), loops.alias("loops"), (F.count("*") - loops).alias("n_kept"), F.count_distinct(pair).alias("n_edges"))


def simple(raw: DataFrame) -> DataFrame:
    """``edge(u, v)``: loops go, directions and repeats collapse."""
    return raw.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def symmetric(edge: DataFrame) -> DataFrame:
    return edge.select("u", "v").union(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))


def component_sizes(edge: DataFrame) -> DataFrame:
    """``(comp_id, n_nodes, n_edges)``: a component is named by its smallest node."""
    of = components(edge)
    nodes = of.groupBy(F.col("component").alias("comp_id")).agg(F.count("*").alias("n_nodes"))
    edges = edge.join(of, edge.u == of.node).groupBy(F.col("component").alias("comp_id")).agg(F.count("*").alias("n_edges"))
    return nodes.join(edges, "comp_id", "left").select("comp_id", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def largest_component(edge: DataFrame) -> DataFrame:
    """``node`` of the largest component of ``edge``, stored and simple; of equal ones the one with the smallest node."""
    of = store(components_of_stored(edge), "components").read()
    top = of.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return of.join(F.broadcast(top), "component").select("node")


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``id``: the rank from 0 by ``key``, whose values differ.

    A range sort numbers the rows of each partition; totals of the partitions
    before, one row each, make that ranks. The sorted rows are stored, so that
    both parts see the same partitions.
    """
    marked = store(rows.orderBy(key).withColumn("_m", F.monotonically_increasing_id()), "ranked").read()
    part, row = F.shiftrightunsigned("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    sizes = marked.groupBy(part.alias("_p")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_p", before.alias("_before"))
    return marked.withColumn("_p", part).join(offsets, "_p").withColumn("id", row + F.col("_before")).drop("_m", "_p", "_before")


def dense_ids(nodes: DataFrame) -> DataFrame:
    """``(node, id)``: ranks from 0 by ascending node."""
    return ranked(nodes.select("node"), "node")


def renumber(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edge`` between ``nodes``, with dense ids by ascending old id; the ids, small on disk, are not broadcast, and the edges not sorted."""
    ids = dense_ids(nodes)
    a, b = ids.select(F.col("node").alias("u"), F.col("id").alias("iu")), ids.select(F.col("node").alias("v"), F.col("id").alias("iv"))
    return edge.join(a.hint("shuffle_hash"), "u").join(b.hint("shuffle_hash"), "v").select(F.col("iu").alias("u"), F.col("iv").alias("v"))


def prepare(raw: DataFrame) -> DataFrame:
    """The largest component of a raw graph, without loops and repeats, with dense ids; the edges are made once."""
    edge = store(simple(raw), "simple").read()
    return renumber(edge, largest_component(edge))


@dataclass
class Graph:
    """A prepared ``edge(u, v)`` table and what follows from it, each computed once.

    ``by_blocks`` is for graphs with many neighbours a node: common neighbours are
    counted by blocks of neighbour lists, where else wedges are joined.
    """

    edge: DataFrame
    by_blocks: bool = False

    @classmethod
    def from_raw(cls, raw: DataFrame, by_blocks: bool = False) -> Graph:
        with scratch(raw.sparkSession):
            return cls(store(prepare(raw), "edges").keep().read(), by_blocks)

    @cached_property
    def adj(self) -> DataFrame:
        return symmetric(self.edge)

    @cached_property
    def degree(self) -> DataFrame:
        return self.adj.groupBy("u").agg(F.count("*").alias("d"))

    @cached_property
    def nbr(self) -> DataFrame:
        return self.adj.groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("nbrs"), F.count("*").alias("d"))

    @cached_property
    def lists(self) -> lists.Lists | None:
        """``nbr`` as tasks read it by themselves; None where they can't."""
        return lists.stored(self.adj)

    @property
    def by_lists(self) -> bool:
        """Whether blocks are read by tasks, and not sent to them."""
        return self.by_blocks and self.lists is not None

    @cached_property
    def edges_read(self) -> DataFrame:
        """``(u, v, t, du, dv)``: ``support`` with degrees, of blocks that are read."""
        return blocks.edges_read(self.edge.sparkSession, self.lists)

    @cached_property
    def size(self) -> tuple[int, int]:
        """Nodes and edges."""
        return self.degree.count(), self.edge.count()

    @cached_property
    def with_degrees(self) -> DataFrame:
        """``(u, v, du, dv)``."""
        du, dv = self.degree.withColumnRenamed("d", "du"), self.degree.select(F.col("u").alias("v"), F.col("d").alias("dv"))
        return self.edge.join(du.hint("merge"), "u").join(dv.hint("merge"), "v").select("u", "v", "du", "dv")

    @cached_property
    def oriented(self) -> DataFrame:
        """``(a, b)``: edges from the end of smaller (degree, id), so that no node has many out-edges."""
        up = F.struct("du", "u") < F.struct("dv", "v")
        return self.with_degrees.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("b"))

    @cached_property
    def triangles(self) -> DataFrame:
        """``(x, y, z)`` with x < y < z: pairs of out-edges that a third edge closes."""
        if self.by_lists:
            return blocks.triangles_read(self.edge.sparkSession, self.lists)
        if self.by_blocks:
            return blocks.triangles(self.nbr, 2 * self.size[1])
        o = self.oriented
        wedge = o.select("a", F.col("b").alias("p")).join(o.select("a", F.col("b").alias("q")), "a").where("p < q")
        closed = wedge.join(self.edge.select(F.col("u").alias("p"), F.col("v").alias("q")).hint("merge"), ["p", "q"])
        return closed.select(F.sort_array(F.array("a", "p", "q")).alias("t")).select(*[F.col("t")[i].alias(c) for i, c in enumerate("xyz")])

    @cached_property
    def triangles_naive(self) -> DataFrame:
        """The same by node order alone."""
        e = self.edge
        wedge = e.select(F.col("u").alias("x"), F.col("v").alias("y")).join(e.select(F.col("u").alias("x"), F.col("v").alias("z")), "x").where("y < z")
        return wedge.join(e.select(F.col("u").alias("y"), F.col("v").alias("z")), ["y", "z"]).select("x", "y", "z")

    @cached_property
    def support(self) -> DataFrame:
        """``(u, v, t)``: common neighbours of each edge's ends."""
        if self.by_lists:
            return self.edges_read.select("u", "v", "t")
        if self.by_blocks:
            return blocks.support(self.nbr, 2 * self.size[1])
        sides = F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ("xy", "xz", "yz")])
        t = self.triangles.select(F.explode(sides).alias("e")).groupBy("e.u", "e.v").agg(F.count("*").alias("t"))
        return self.edge.join(t.hint("merge"), ["u", "v"], "left").select("u", "v", F.coalesce("t", F.lit(0)).alias("t"))

    @cached_property
    def node_triangles(self) -> DataFrame:
        """``(u, t)`` for nodes in a triangle."""
        if self.by_blocks:
            sides = self.support.where("t > 0").select(F.explode(F.array("u", "v")).alias("u"), "t")
            return sides.groupBy("u").agg(F.expr("sum(t) div 2").alias("t"))
        return self.triangles.select(F.explode(F.array("x", "y", "z")).alias("u")).groupBy("u").agg(F.count("*").alias("t"))

    @cached_property
    def clustering(self) -> DataFrame:
        """``(node, cc)``: closed share of each node's pairs of neighbours; 0 for degree one."""
        both = self.degree.join(self.node_triangles.hint("merge"), "u", "left")
        return both.select(F.col("u").alias("node"), local_clustering().alias("cc"))

    @cached_property
    def pairs_of_paths(self) -> DataFrame:
        """One row ``(n)``: pairs of common neighbours, summed over pairs of nodes."""
        if self.by_lists:
            each = blocks.pairs_of_paths_read(self.edge.sparkSession, self.lists)
        else:
            each = blocks.pairs_of_paths(self.nbr, 2 * self.size[1]) if self.by_blocks else self.common2.selectExpr("n * (n - 1) div 2 as n")
        return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))

    @cached_property
    def common2(self) -> DataFrame:
        """``(a, b, n)``, a < b: number of common neighbours of each pair that has any."""
        other = self.adj.select("u", F.col("v").alias("b"))
        return self.adj.withColumnRenamed("v", "a").join(other, "u").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))

    @cached_property
    def two_paths(self) -> DataFrame:
        """``(a, b, n)``, a < b: number of two-step paths between each pair that is not linked but has any."""
        linked = self.edge.select(F.col("u").alias("a"), F.col("v").alias("b"))
        return self.common2.join(linked.hint("merge"), ["a", "b"], "left_anti")

    @cached_property
    def edge_order(self) -> DataFrame:
        """``(place, u, v, bound)``: edges by descending sum of their ends' degrees, of equal ones the last first."""
        rows = self.with_degrees.select("u", "v", (F.col("du") + F.col("dv")).alias("bound"))
        placed = ranked(rows.withColumn("key", F.struct(-F.col("bound"), -F.col("u"), -F.col("v"))), "key")
        return placed.select(F.col("id").alias("place"), "u", "v", "bound")

    @cached_property
    def common3(self) -> DataFrame:
        """``(a, b, c, n)``, a < b < c: common neighbours of triples with two edges or more among them."""
        legs = self.adj.select("u", F.col("v").alias("p")).join(self.adj.select("u", F.col("v").alias("q")), "u").where("p < q")
        triples = legs.select(F.sort_array(F.array("u", "p", "q")).alias("t")).distinct()
        triples = triples.select(*[F.col("t")[i].alias(c) for i, c in enumerate("abc")])
        ax = self.adj.select(F.col("u").alias("a"), F.col("v").alias("x"))
        found = triples.join(ax, "a")
        for c in "bc":
            found = found.join(self.adj.select(F.col("u").alias(c), F.col("v").alias("x")), [c, "x"], "left_semi")
        return found.groupBy("a", "b", "c").agg(F.count("*").alias("n"))


def local_clustering() -> Column:
    """The closed share of a node's pairs of neighbours, from ``d`` and ``t``; 0 for degree one."""
    return F.when(F.col("d") > 1, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)


def line_triangle(g: Graph, triangles: DataFrame | None = None) -> DataFrame:
    """``(type, name, cnt)``: open wedges and triangles; these are those given, or the graph's."""
    t = triangle_total(g) if triangles is None else triangles.agg(F.count("*").alias("t"))
    w = g.degree.agg(F.coalesce(F.sum(F.expr("d * (d - 1) div 2")), F.lit(0)).alias("w"))
    both = F.array(
        F.struct(F.lit(0).alias("type"), F.lit("line").alias("name"), (F.col("w") - 3 * F.col("t")).alias("cnt")),
        F.struct(F.lit(1).alias("type"), F.lit("triangle").alias("name"), F.col("t").alias("cnt")),
    )
    return t.crossJoin(w).select(F.inline(both))  # one row by one row


def graph_stats(g: Graph) -> DataFrame:
    """``(n_nodes, n_edges, max_degree, avg_degree, two_stars)``."""
    d = F.col("d")
    return g.degree.agg(
        F.count("*").alias("n_nodes"), (F.sum(d) / 2).cast("long").alias("n_edges"), F.max(d).alias("max_degree"),
        F.round(F.avg(d), 9).alias("avg_degree"), F.sum(F.expr("d * (d - 1) div 2")).alias("two_stars"),
    )


def triangle_total(g: Graph) -> DataFrame:
    """One row ``(t)``: the number of triangles."""
    if g.by_blocks:
        return g.support.agg(F.expr("coalesce(sum(t), 0) div 3").alias("t"))
    return g.triangles.agg(F.count("*").alias("t"))


def global_clustering(g: Graph) -> DataFrame:
    """``(avg_clustering, global_clustering)``; null for an empty graph."""
    both = g.degree.join(g.node_triangles.hint("merge"), "u", "left").select("d", F.coalesce("t", F.lit(0)).alias("t"))
    w = F.sum(F.expr("d * (d - 1) div 2"))
    return both.agg(F.round(F.avg(local_clustering()), 9).alias("avg_clustering"), F.round(F.try_divide(1.0 * F.sum("t"), w), 9).alias("global_clustering"))
