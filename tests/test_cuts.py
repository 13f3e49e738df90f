"""Orbit counts from sums over small tables, against enumeration."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from motifloom.functions import atlas, cuts
from motifloom.operators import cuts as sums
from motifloom.operators import lists, rooted
from motifloom.operators.graph import Graph
from motifloom.plans.queries import QUERIES

from .conftest import TINY


def plain_orbits(edges, k):
    """Every node set looked at; nodes in the order of their names."""
    nodes = sorted({v for e in edges for v in e})
    at = {v: i for i, v in enumerate(nodes)}
    edges = {tuple(sorted((at[a], at[b]))) for a, b in edges}
    number = {(r["type"], r["node_key"]): r["orbit"] for r in atlas.orbits(k)}
    out = Counter()
    for s in combinations(range(len(nodes)), k):
        place = {v: i for i, v in enumerate(s)}
        inner = frozenset((place[a], place[b]) for a, b in edges if a in place and b in place)
        if atlas.connected(range(k), inner):
            kind = atlas.type_of(range(k), inner)
            for i, key in atlas.node_keys(range(k), inner).items():
                out[s[i], number[kind, key[0] * 100 + key[1]]] += 1
    return out


def linked(seed, n, share):
    rng = random.Random(seed)
    return [(i, rng.randrange(i)) for i in range(1, n)] + [(a, b) for a, b in combinations(range(n), 2) if rng.random() < share]


@pytest.mark.parametrize(("seed", "n", "share"), [(1, 13, 0.5), (2, 16, 0.15)])
def test_orbits_against_enumeration(spark, seed, n, share):
    edges = linked(seed, n, share)
    g = Graph.from_raw(spark.createDataFrame(edges, "src long, dst long"))
    got = {(r["node"], r["orbit"]): r["cnt"] for r in sums.node_orbits(g, 5).collect()}
    want = sum((plain_orbits(edges, k) for k in (3, 4, 5)), Counter())
    for v in range(n):
        want[v, 0] = len({frozenset(e) for e in edges if v in e})
    assert got == dict(want)


@pytest.mark.parametrize(("seed", "n", "share"), [(3, 14, 0.5), (4, 12, 0.9)])
def test_dense_orbits_against_enumeration(spark, monkeypatch, seed, n, share):
    """With many neighbours a node, sums are made around each node, and only rows of edges are joined."""
    kinds, real = set(), sums._Sums.rows
    monkeypatch.setattr(sums._Sums, "rows", lambda self, kind, wanted: kinds.add(kind) or real(self, kind, wanted))
    edges = linked(seed, n, share)
    g = Graph.from_raw(spark.createDataFrame(edges, "src long, dst long"), by_blocks=True)
    got = {(r["node"], r["orbit"]): r["cnt"] for r in sums.node_orbits(g, 5).where("orbit > 0").collect()}
    assert got == dict(sum((plain_orbits(edges, k) for k in (3, 4, 5)), Counter())) and kinds == {"edges"}


def test_sums_around_a_node_in_parts(monkeypatch):
    """A node's lists are looked at a few entries at a time, and sums are whole beyond 64 bits."""
    rng = np.random.default_rng(6)
    link = np.triu(rng.random((40, 40)) < 0.4, 1)
    link |= link.T
    start, flat = np.concatenate(([0], np.cumsum(link.sum(1)))), np.nonzero(link)[1].astype(np.int32)
    on = np.concatenate([rooted._Around(start, flat, flat).triangles(r) for r in range(40)])
    whole = [rooted._Around(start, flat, on).sums(r) for r in range(40)]
    monkeypatch.setattr(lists, "AT_ONCE", 16)
    around = rooted._Around(start, flat, np.concatenate([rooted._Around(start, flat, flat).triangles(r) for r in range(40)]))
    for (row, edges, five), (row2, edges2, five2) in zip(whole, map(around.sums, range(40)), strict=True):
        assert (row, five) == (row2, five2) and all((edges[c] == edges2[c]).all() for c in edges)
    assert rooted._total(np.array([1 << 40]), np.array([1 << 40])) == 1 << 80


def test_dense_star_with_a_hub(spark):
    g = Graph.from_raw(spark.createDataFrame([(0, i) for i in range(1, 3_001)], "src long, dst long"), by_blocks=True)
    got = {r["name"]: r["cnt"] for r in sums.graphlet5(g).collect()}
    assert got["4-star"] == sum(got.values()) == 3_000 * 2_999 * 2_998 * 2_997 // 24


def test_star_with_a_hub(spark):
    """A hub of 3,000 leaves, some of them linked in pairs: closed forms, and no set is listed."""
    n, pairs = 3_000, 50
    edges = [(0, i) for i in range(1, n + 1)] + [(2 * i + 1, 2 * i + 2) for i in range(pairs)]
    g = Graph.from_raw(spark.createDataFrame(edges, "src long, dst long"))
    got = {r["name"]: r["cnt"] for r in sums.graphlet5(g).collect()}
    singles = n - 2 * pairs
    choose = lambda m, r: m * choose(m - 1, r - 1) // r if r else 1
    # Sets of the hub and four leaves by how many linked pairs they hold.
    two, one = choose(pairs, 2), pairs * (choose(n - 2, 2) - (pairs - 1))
    assert got["butterfly"] == two and got["cricket"] == one and got["4-star"] == choose(n, 4) - one - two
    assert singles and sum(got.values()) == choose(n, 4)


def test_derivation():
    """All patterns have an order, no factor has more than three nodes, and only the complete graph is left out."""
    assert len(cuts.patterns(5)) == 72
    for step in cuts.rounds(5):
        for _, factors in step:
            assert all(f[1][1] <= 3 for f in factors)


def test_dense_queries(spark):
    counts = {r["type"]: r["cnt"] for r in QUERIES["copurchase_graphlet5"](spark, TINY).collect()}
    orbit = QUERIES["copurchase_orbits5"](spark, TINY)
    per_node = {r["orbit"]: r["s"] for r in orbit.groupBy("orbit").agg({"cnt": "sum"}).withColumnRenamed("sum(cnt)", "s").collect()}
    for r in atlas.orbits(5):
        assert per_node.get(r["orbit"], 0) == counts[r["type"]] * r["fold"]
    # Walks on states find the same shares.
    total = sum(counts.values())
    shares = QUERIES["copurchase_psrw5"](spark, TINY).groupBy("type").agg({"value": "avg"}).collect()
    for r in shares:
        want = counts[r["type"]] / total
        assert abs(r["avg(value)"] - want) < 0.05 * want + 0.0005
