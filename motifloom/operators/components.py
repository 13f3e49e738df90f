"""Connected components as alternating star contractions.

Each round keeps, for every node, edges to the smallest node known near it
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014). Both
half-rounds are a combinable minimum per node and an equi-join that brings it
back. The minima are stored, so that both sides of the join come from an exchange
and adaptive execution can split a hub's rows; as they are small on disk, the merge
join is asked for, or they would go through the driver. Rounds grow with the
logarithm of the component diameter, not with the diameter.

Where edges are many times the nodes, rounds run over the edges to each node's
least and greatest neighbour first; all edges are then told by the components of
these, and rounds over what still links different ones give the rest.

Rounds end when the edges are stars: each node but a least one has one edge, to a
node that has no smaller neighbour. One count per node tells that, so no round is
run only to see that it changes nothing, and links given as stars take none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.session import Stored, store


#: Edges for each of those to a node's least and greatest neighbour from which the latter go first.
FEW = 4


def _with_least(rows: DataFrame) -> tuple[DataFrame, Stored]:
    """``rows(u, v)`` with the least ``v`` of each ``u`` as ``m``."""
    least = store(rows.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
    return rows.join(least.read().hint("merge"), "u"), least


def _large_star(edges: DataFrame) -> Stored:
    """Link each larger neighbour of a node to the node's smallest neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found, least = _with_least(both)
    out = store(found.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")), "cc-large")
    least.drop()
    return out


def _small_star(edges: DataFrame) -> Stored:
    """Link each smaller neighbour of a node, and the node, to the smallest."""
    found, least = _with_least(_down(edges))
    moved = found.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = store(moved.union(least.read().select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "cc")
    least.drop()
    return out


def _are_stars(down: DataFrame) -> bool:
    """Whether ``down(u, v)``, u > v, links each node to one smaller one, that itself is linked to none."""
    ends = down.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(down.select("v", F.lit(0)))
    counts = ends.groupBy("node").agg(F.sum("up").alias("n"), F.min("up").alias("least"), F.max("up").alias("most"))
    return counts.where("n > 1 or least <> most").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for each endpoint of ``edges(u, v)``.

    ``component`` is the smallest node reachable. Loops, repeated and reversed
    edges are allowed; edges with a null end are ignored; a node whose only
    edges are loops is its own component. No edges give no rows.
    """
    raw = edges.select("u", "v").where("u is not null and v is not null")
    ends = store(raw.distinct(), "cc0").read()
    down = _down(ends.where("u <> v"))
    return _named(ends, down) if _are_stars(down) else components_of_stored(ends)


def _down(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _named(ends: DataFrame, roots: DataFrame) -> DataFrame:
    """``(node, component)`` of all ends; those without a root in ``roots(node, root)`` are their own."""
    nodes = ends.select(F.col("u").alias("node")).union(ends.select("v")).distinct()
    both = nodes.join(roots.toDF("node", "root").hint("merge"), "node", "left")
    return both.select("node", F.coalesce("root", "node").alias("component"))


def components_of_stored(ends: DataFrame) -> DataFrame:
    """``components`` of ``ends(u, v)`` that are stored, distinct and without nulls."""
    proper = ends.where("u <> v")
    both = proper.union(proper.select(F.col("v").alias("u"), F.col("u").alias("v")))
    sides = both.groupBy("u").agg(F.array_distinct(F.array(F.min("v"), F.max("v"))).alias("vs")).select("u", F.explode("vs").alias("v"))
    few = store(sides.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-sides")
    if FEW * few.read().count() < ends.count():
        first = _rooted(few.read())
        # All nodes are in it, so with one root there is one component, and no edge to look at.
        roots = first if first.select("root").distinct().limit(2).count() < 2 else _joined(proper, first)
    else:
        roots = _rooted(proper)
    few.drop()
    return _named(ends, roots)


def _joined(proper: DataFrame, first: DataFrame) -> DataFrame:
    """``first(node, root)``, of some edges, with the roots that all edges ``proper(u, v)`` give."""
    a, b = first.toDF("u", "a"), first.toDF("v", "b")
    named = proper.join(a.hint("shuffle_hash"), "u", "left").join(b.hint("shuffle_hash"), "v", "left").select(F.coalesce("a", "u").alias("a"), F.coalesce("b", "v").alias("b"))
    left = store(named.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "cc-left")
    # Roots are the least of their components, so the least root is the least node.
    second = _rooted(left.read()).toDF("root", "top")
    roots = first.join(second.hint("merge"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return roots.union(second.toDF("node", "root"))


def _rooted(proper: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of ``proper(u, v)``, without loops, that is not the least of its component."""
    held, proper = None, _down(proper)
    while not _are_stars(proper):
        large = _large_star(proper)
        after = _small_star(large.read())
        large.drop()
        if held is not None:
            held.drop()
        held, proper = after, after.read()
    return proper.select(F.col("u").alias("node"), F.col("v").alias("root"))
