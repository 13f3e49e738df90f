"""The connected graphs on three, four and five nodes, as small dimension tables.

Each type is given by an example; signatures, orbits, weights and divisors
follow from it. Within a type, a node's key is (degree, sum of its neighbours'
degrees); keys tell apart all orbits, and their sorted list all types.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache
from itertools import combinations, permutations

from pyspark.sql import DataFrame, SparkSession

#: Names and example edges of the types, in the order of their numbers.
TYPES: dict[int, list[tuple[str, str]]] = {
    3: [("line", "01 12"), ("triangle", "01 12 02")],
    4: [
        ("path", "01 12 23"),
        ("star", "01 02 03"),
        ("cycle", "01 12 23 03"),
        ("tailed triangle", "01 12 02 23"),
        ("chordal cycle", "01 12 23 03 02"),
        ("clique", "01 02 03 12 13 23"),
    ],
    5: [
        ("5-path", "01 12 23 34"),
        ("fork", "01 12 23 24"),
        ("4-star", "01 02 03 04"),
        ("bull", "01 12 02 13 24"),
        ("lollipop", "01 12 02 23 34"),
        ("cricket", "01 12 02 23 24"),
        ("5-cycle", "01 12 23 34 04"),
        ("banner", "01 12 23 03 34"),
        ("dart", "01 12 23 03 02 24"),
        ("butterfly", "01 12 02 23 34 24"),
        ("kite", "01 12 23 03 02 14"),
        ("K2,3", "02 03 04 12 13 14"),
        ("house", "01 12 23 03 24 34"),
        ("K1,1,3", "01 02 03 04 12 13 14"),
        ("K4 with pendant", "01 02 03 12 13 23 34"),
        ("gem", "01 12 23 04 14 24 34"),
        ("wheel minus a spoke", "01 12 23 03 04 14 24"),
        ("K5 minus a 2-path", "01 02 03 12 13 23 04 14"),
        ("wheel", "01 12 23 03 04 14 24 34"),
        ("K5 minus an edge", "01 02 03 04 12 13 14 23 24"),
        ("K5", "01 02 03 04 12 13 14 23 24 34"),
    ],
}
#: The first orbit number of each size.
FIRST_ORBIT = {3: 1, 4: 4, 5: 15}

Edges = frozenset[tuple[int, int]]


def _edges(text: str) -> Edges:
    return frozenset((int(e[0]), int(e[1])) for e in text.split())


def example(k: int, kind: int) -> Edges:
    """The edges of a type's example, on nodes 0 to k-1."""
    return _edges(TYPES[k][kind][1])


def _degrees(nodes: Iterable[int], edges: Edges) -> dict[int, int]:
    return {v: sum(v in e for e in edges) for v in nodes}


def node_keys(nodes: Iterable[int], edges: Edges) -> dict[int, tuple[int, int]]:
    d = _degrees(nodes, edges)
    return {v: (d[v], sum(d[a + b - v] for a, b in edges if v in (a, b))) for v in d}


def shape_key(nodes: Iterable[int], edges: Edges) -> str:
    """What ``operators.sets.with_type`` computes for a node set, for one graph."""
    return ",".join(str(d * 100 + s) for d, s in sorted(node_keys(nodes, edges).values()))


def induced(nodes: Iterable[int], edges: Edges) -> Edges:
    keep = set(nodes)
    return frozenset(e for e in edges if keep.issuperset(e))


def connected(nodes: Iterable[int], edges: Edges) -> bool:
    nodes = set(nodes)
    seen, todo = set(), [min(nodes)]
    while todo:
        v = todo.pop()
        if v not in seen:
            seen.add(v)
            todo += [a + b - v for a, b in edges if v in (a, b)]
    return seen == nodes


@cache
def type_numbers(k: int) -> dict[str, int]:
    return {shape_key(range(k), _edges(e)): i for i, (_, e) in enumerate(TYPES[k])}


def type_of(nodes: Iterable[int], edges: Edges) -> int:
    nodes = list(nodes)
    return type_numbers(len(nodes))[shape_key(nodes, edges)]


def _part_types(k: int, edges: Edges) -> str:
    if k == 3:
        return ""
    found = [0] * len(TYPES[k - 1])
    for s in combinations(range(k), k - 1):
        inner = induced(s, edges)
        if connected(s, inner):
            place = {v: i for i, v in enumerate(s)}
            found[type_of(range(k - 1), frozenset((place[a], place[b]) for a, b in inner))] += 1
    return ",".join(map(str, found))


@cache
def graphlets(k: int) -> list[dict]:
    """A row for each type.

    ``beta``: half the walks over k-1 different nodes inside it, k at least 3
    (how often a frame of a walk sees it). ``walk_div``: pairs of connected
    (k-1)-subsets. ``phi``: nodes adjacent to all others, for k = 5. ``parts``:
    connected (k-1)-subsets by type, comma-joined.
    """
    rows = []
    for i, (name, text) in enumerate(TYPES[k]):
        edges = _edges(text)
        linked = {*edges, *((b, a) for a, b in edges)}
        frames = sum(all((p[j], p[j + 1]) in linked for j in range(k - 2)) for p in permutations(range(k), k - 1))
        parts = sum(connected(s, induced(s, edges)) for s in combinations(range(k), k - 1))
        degrees = sorted(_degrees(range(k), edges).values())
        rows.append(
            {
                "k": k, "type": i, "name": name, "signature": ",".join(map(str, degrees)), "shape": shape_key(range(k), edges),
                "beta": frames // 2, "walk_div": parts * (parts - 1) // 2, "phi": sum(d == k - 1 for d in degrees),
                "parts": _part_types(k, edges),
            }
        )
    return rows


@cache
def edge_triples(kind: int) -> int:
    """For a four-node type, the ways to go from edge to adjacent edge twice and touch all nodes, but for direction."""
    edges = sorted(example(4, kind))
    met = lambda a, b: bool({*a} & {*b})
    return sum(met(a, b) and met(b, c) and len({*a, *b, *c}) == 4 for a, b, c in permutations(edges, 3)) // 2


@cache
def constants() -> list[dict]:
    """A row for each type of four and five nodes; ``reweight`` sums the edge triples of its four-node parts."""
    rows = []
    for g in [*graphlets(4), *graphlets(5)]:
        if g["k"] == 4:
            reweight = edge_triples(g["type"])
        else:
            reweight = sum(int(n) * edge_triples(i) for i, n in enumerate(g["parts"].split(",")))
        rows.append({c: g[c] for c in ("k", "type", "signature", "beta", "walk_div", "phi", "parts")} | {"reweight": reweight})
    return rows


@cache
def orbits(k: int) -> list[dict]:
    """A row for each orbit; ``total`` marks the one a type is counted from, ``fold`` its nodes in the type."""
    rows, number = [], FIRST_ORBIT[k]
    for i, (_, text) in enumerate(TYPES[k]):
        keys = list(node_keys(range(k), _edges(text)).values())
        for key in sorted(set(keys)):
            rows.append({"k": k, "type": i, "node_key": key[0] * 100 + key[1], "orbit": number, "fold": keys.count(key), "total": key == max(keys)})
            number += 1
    return rows


@cache
def extensions(k: int) -> list[dict]:
    """The type that a frame of k-1 path nodes makes with one node more.

    ``chords`` has a bit for each pair of frame nodes that the path doesn't
    link, in order; ``bits`` for each frame node adjacent to the new one.
    """
    m = k - 1
    path = [(i, i + 1) for i in range(m - 1)]
    free = [p for p in combinations(range(m), 2) if p not in path]
    rows = []
    for chords in range(1 << len(free)):
        base = [*path, *(p for j, p in enumerate(free) if chords >> j & 1)]
        for bits in range(1, 1 << m):
            edges = frozenset([*base, *((i, m) for i in range(m) if bits >> i & 1)])
            rows.append({"chords": chords, "bits": bits, "type": type_of(range(k), edges)})
    return rows


def chord_pairs(k: int) -> list[tuple[int, int]]:
    """The frame positions behind the bits of ``chords``."""
    return [p for p in combinations(range(k - 1), 2) if p[1] - p[0] > 1]


def table(spark: SparkSession, rows: list[dict], columns: list[str]) -> DataFrame:
    """A dimension as a DataFrame. All are of fixed, small size."""
    kinds = {int: "int", str: "string", bool: "boolean"}
    schema = ", ".join(f"{c} {kinds[type(rows[0][c])]}" for c in columns)
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], schema)
