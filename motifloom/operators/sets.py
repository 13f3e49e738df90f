"""Connected induced node sets, their types, and counts from them.

A set is a row ``(nodes, bits)``: nodes ascending, ``bits[i]`` a mask of the
places adjacent to place ``i``. Sets grow from their smallest node by one neighbour
at a time, in an order that makes each set once (Wernicke, "Efficient Detection of
Network Motifs", 2006), so none are told apart by a shuffle, and the largest ones
are not shuffled at all; a set carries what is beside it with its adjacency, so
that types need no join but the one with the fixed atlas.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.functions import atlas
from motifloom.operators.graph import Graph


def inserted(rows: DataFrame) -> DataFrame:
    """``rows(nodes, bits, v, m, ...)`` with node ``v`` put in its place; ``m`` masks the places adjacent to it."""
    p = F.size(F.filter("nodes", lambda n: n < F.col("v")))
    low = rows.withColumn("_p", p).withColumn("_low", F.expr("shiftleft(1, _p) - 1"))
    # Places from p on move up by one; the new node's mask moves likewise.
    wide = F.expr("transform(bits, (b, i) -> (b & _low) | shiftleft(b & ~_low, 1) | (case when (m & shiftleft(1, i)) <> 0 then shiftleft(1, _p) else 0 end))")
    new = F.expr("(m & _low) | shiftleft(m & ~_low, 1)")
    grown = low.withColumns({"_w": wide, "_n": new})
    nodes = F.expr("concat(slice(nodes, 1, _p), array(v), slice(nodes, _p + 1, size(nodes)))")
    bits = F.expr("concat(slice(_w, 1, _p), array(_n), slice(_w, _p + 1, size(_w)))")
    return grown.withColumns({"nodes": nodes, "bits": bits}).drop("_p", "_low", "_w", "_n")


def without(rows: DataFrame, x: str) -> DataFrame:
    """``rows(nodes, bits, m, ...)`` without the node at place ``x``."""
    drop = f"(b & (shiftleft(1, {x}) - 1)) | shiftleft(shiftright(b, {x} + 1), {x})"
    left = F.expr(f"transform(filter(bits, (b, i) -> i <> {x}), b -> {drop})")
    nodes = F.expr(f"filter(nodes, (n, i) -> i <> {x})")
    return rows.withColumns({"nodes": nodes, "bits": left, "m": F.expr(f"(m & (shiftleft(1, {x}) - 1)) | shiftleft(shiftright(m, {x} + 1), {x})")})


def connected_sets(g: Graph, k: int) -> DataFrame:
    """``(nodes, bits)`` of each connected set of ``k`` nodes, k at least 2, each once.

    ``ext`` has the nodes beside a set that are greater than its first, which is its
    least: ``m`` masks the places that they are adjacent to, ``ok`` tells those that
    may still join it. A node that joins leaves those before it out for good, and
    brings its neighbours that were not beside the set.
    """
    if k < 2:
        raise ValueError("sets have two nodes at least")
    near = g.nbr.select(F.col("u").alias("w"), F.col("nbrs").alias("vs"))
    sets = near.select(F.array("w").alias("nodes"), F.array(F.lit(0)).alias("bits"), F.expr("transform(filter(vs, v -> v > w), v -> struct(v, 1 as m, true as ok))").alias("ext"))
    for i in range(1, k):
        sets = sets.select("*", F.posexplode("ext").alias("p", "e")).where("e.ok")
        linked = F.expr(f"concat(transform(bits, (b, j) -> case when (e.m & shiftleft(1, j)) <> 0 then b | {1 << i} else b end), array(e.m))")
        sets = sets.select("nodes", linked.alias("bits"), "ext", "p", F.col("e.v").alias("w"))
        if i < k - 1:
            sets = sets.join(near, "w")
            left = f"filter(transform(ext, (x, j) -> struct(x.v, case when array_contains(vs, x.v) then x.m | {1 << i} else x.m end as m, x.ok and j > p as ok)), x -> x.v <> w)"
            more = f"transform(filter(vs, z -> z > nodes[0] and not array_contains(nodes, z) and not array_contains(ext.v, z)), z -> struct(z as v, {1 << i} as m, true as ok))"
            sets = sets.select(F.expr("concat(nodes, array(w))").alias("nodes"), "bits", F.expr(f"concat({left}, {more})").alias("ext")).where("exists(ext, x -> x.ok)")
    whole = sets.select(F.expr("concat(nodes, array(w))").alias("_n"), F.col("bits").alias("_b")).withColumn("nodes", F.array_sort("_n"))
    mask = "aggregate(transform(_n, (o, j) -> case when (b & shiftleft(1, j)) <> 0 then shiftleft(1, int(array_position(nodes, o)) - 1) else 0 end), 0, (x, y) -> x | y)"
    return whole.select("nodes", F.expr(f"transform(transform(nodes, n -> _b[int(array_position(_n, n)) - 1]), b -> {mask})").alias("bits"))


NODE_KEYS = "transform(bits, b -> 100 * bit_count(b) + aggregate(transform(bits, (c, j) -> case when (b & shiftleft(1, j)) <> 0 then bit_count(c) else 0 end), 0, (x, y) -> x + y))"


def with_type(sets: DataFrame, k: int, *others: str) -> DataFrame:
    """``(nodes, keys, type)``: a key for each node, and the set's type; other columns are handed through."""
    dim = F.broadcast(atlas.table(sets.sparkSession, atlas.graphlets(k), ["shape", "type"]))
    keyed = sets.select(*others, "nodes", F.expr(NODE_KEYS).alias("keys")).withColumn("shape", F.array_join(F.array_sort("keys"), ","))
    return keyed.join(dim, "shape").select(*others, "nodes", "keys", "type")


def counts(typed: DataFrame, k: int) -> DataFrame:
    """``(type, name, cnt)`` for all types, zeros included."""
    dim = atlas.table(typed.sparkSession, atlas.graphlets(k), ["type", "name"])
    n = typed.groupBy("type").agg(F.count("*").alias("cnt"))
    return dim.join(n, "type", "left").select("type", "name", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def frequencies(counted: DataFrame) -> DataFrame:
    """``(type, freq)``: shares of all, 0 if there is nothing."""
    total = counted.agg(F.sum("cnt").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("type", F.round(F.coalesce(F.try_divide(F.col("cnt").cast("double"), F.col("total")), F.lit(0.0)), 9).alias("freq"))


def orbits(typed: DataFrame, k: int) -> DataFrame:
    """``(node, orbit, cnt)`` of the orbits of size ``k``; zeros are left out."""
    dim = F.broadcast(atlas.table(typed.sparkSession, atlas.orbits(k), ["type", "node_key", "orbit"]))
    places = typed.select("type", F.explode(F.arrays_zip("nodes", "keys")).alias("p")).select("type", F.col("p.nodes").alias("node"), F.col("p.keys").alias("node_key"))
    return places.join(dim, ["type", "node_key"]).groupBy("node", "orbit").agg(F.count("*").alias("cnt"))


def totals(orbit: DataFrame, k: int) -> DataFrame:
    """``(type, cnt)`` from per-node counts: one orbit of each type, over its nodes in the type."""
    rows = [r for r in atlas.orbits(k) if r["total"]]
    dim = atlas.table(orbit.sparkSession, rows, ["type", "orbit", "fold"])
    sums = orbit.groupBy("orbit").agg(F.sum("cnt").alias("s"))
    return dim.join(sums, "orbit", "left").select("type", F.expr("coalesce(s, 0) div fold").alias("cnt"))


def wide_orbits(orbit: DataFrame, last: int) -> DataFrame:
    """A row for each node with columns ``o0`` to ``o<last>``."""
    cols = [F.coalesce(F.sum(F.when(F.col("orbit") == o, F.col("cnt"))), F.lit(0)).alias(f"o{o}") for o in range(last + 1)]
    return orbit.groupBy("node").agg(*cols)


def rows_as_text(typed: DataFrame) -> DataFrame:
    """``(nodes, type)`` with the nodes as comma-joined text."""
    return typed.select(F.array_join(F.transform("nodes", lambda n: n.cast("string")), ",").alias("nodes"), "type")


def state_pairs(states: DataFrame, unions: DataFrame) -> DataFrame:
    """``(s, t, type)``: ordered pairs of states (sets of k-1) that differ in one node, with their union's type.

    States meet on what is left of them without a node; ``unions`` is
    ``with_type`` of the connected sets of k nodes.
    """
    part = states.select("nodes", F.explode("nodes").alias("x")).select("nodes", F.array_remove("nodes", F.col("x")).alias("rest"), "x")
    other = part.select("rest", F.col("nodes").alias("t"), F.col("x").alias("y"))
    pairs = part.join(other, "rest").where("x <> y").select(F.col("nodes").alias("s"), "t", F.expr("array_sort(concat(nodes, array(y)))").alias("nodes"))
    return pairs.join(unions.select("nodes", "type"), "nodes").select("s", "t", "type")


def numbered_state_pairs(states: DataFrame, g: Graph, k: int) -> DataFrame:
    """``(u, v, type)``: ordered pairs of ``states(id, nodes, bits)``, sets of k-1, that differ in one node, with their union's type.

    States meet on what is left of them without a node. Their union is connected,
    and its links are theirs and that of the two nodes, which one of them brings
    along in its list of neighbours.
    """
    m = k - 2
    inner = list(combinations(range(m), 2))
    part = without(states.select("id", "nodes", "bits", F.posexplode("bits").alias("out", "m")).withColumn("x", F.expr("nodes[out]")), "out")
    code = " + ".join(["0", *(f"(case when (bits[{a}] & {1 << b}) <> 0 then {1 << at} else 0 end)" for at, (a, b) in enumerate(inner))])
    part = part.select(F.col("nodes").alias("rest"), "id", "x", "m", F.expr(code).alias("code"))
    one = part.withColumnRenamed("id", "u").join(g.nbr.select(F.col("u").alias("x"), "nbrs"), "x")
    other = part.select("rest", F.col("id").alias("v"), F.col("x").alias("y"), F.col("m").alias("n"))
    at = len(inner)
    whole = f"code | shiftleft(m, {at}) | shiftleft(n, {at + m}) | (case when array_contains(nbrs, y) then {1 << (at + 2 * m)} else 0 end)"
    pairs = one.join(other, "rest").where("u < v").select("u", "v", F.expr(whole).alias("code"))
    # Of the union, the places of the rest come first.
    outer = [*inner, *((j, m) for j in range(m)), *((j, m + 1) for j in range(m)), (m, m + 1)]
    shapes = [(c, frozenset(p for j, p in enumerate(outer) if c >> j & 1)) for c in range(1 << len(outer))]
    rows = [{"code": c, "type": atlas.type_of(range(k), e)} for c, e in shapes if atlas.connected(range(k), e)]
    typed = pairs.join(F.broadcast(atlas.table(states.sparkSession, rows, ["code", "type"])), "code")
    return typed.select(F.inline(F.array(F.struct("u", "v", "type"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "type"))))
