"""Equations between the orbit counts of a node, derived from the atlas.

Take a connected set S of k-1 nodes, some A of its nodes, and the nodes outside
S that are adjacent to all of A. Each of those makes a set of k nodes. So the
sum over the sets S with node v at a given place, of the number of such nodes,
is a fixed combination of v's orbit counts. One such sum is chosen for each
orbit: take its graph, remove a node other than the root, and let A be that
node's neighbours. What has more edges than that comes in too, so the system is
triangular, and its inverse gives the counts. Only the complete graph is left
out; cliques are counted as they are.

No set of k nodes is enumerated: for A of one, two or three nodes the number of
common neighbours is known from degrees and smaller sets.
"""

from __future__ import annotations

from fractions import Fraction
from functools import cache
from itertools import combinations, permutations
from math import lcm

from motifloom.functions.atlas import Edges, connected, example, graphlets, induced, node_keys, orbits


def rooted(nodes: list[int], edges: Edges, some: frozenset[int], root: int) -> tuple:
    """Equal for two sets with marked nodes and a root if and only if one can be laid on the other."""
    best = None
    for order in permutations(nodes):
        at = {v: i for i, v in enumerate(order)}
        here = tuple(sorted(tuple(sorted((at[a], at[b]))) for a, b in edges))
        key = (here, tuple(sorted(at[v] for v in some)), at[root])
        best = key if best is None or key < best else best
    return best


def _parts(k: int, edges: Edges, root: int):
    """Each node but the root whose removal leaves a connected set: it, the rest, the rest's edges, its neighbours."""
    for y in range(k):
        rest = [v for v in range(k) if v != y]
        inner = induced(rest, edges)
        if y != root and connected(rest, inner):
            yield y, rest, inner, frozenset(v for v in rest if (min(v, y), max(v, y)) in edges)


def _marked(nodes: frozenset[int], size: int):
    return map(frozenset, combinations(sorted(nodes), size))


@cache
def _roots(k: int) -> list[tuple[int, Edges, int]]:
    """``(orbit, edges, root)`` with one root for each orbit."""
    number = {(r["type"], r["node_key"]): r["orbit"] for r in orbits(k)}
    out = {}
    for g in graphlets(k):
        edges = example(k, g["type"])
        for v, key in node_keys(range(k), edges).items():
            out.setdefault(number[g["type"], key[0] * 100 + key[1]], (edges, v))
    return [(o, *out[o]) for o in sorted(out)]


@cache
def patterns(k: int) -> dict[int, tuple[tuple, int]]:
    """For each orbit but the clique's: the pattern whose sum stands for it, and how many nodes it marks."""
    out = {}
    for orbit, edges, root in _roots(k):
        fits = []
        for y, rest, inner, near in _parts(k, edges, root):
            if len(near) < k - 1:
                fits.append((len(near), -len(inner), y, rooted(rest, inner, near, root)))
        if fits:
            size, _, _, key = min(fits)
            out[orbit] = (key, size)
    return out


@cache
def coefficients(k: int) -> dict[int, dict[int, int]]:
    """How often each orbit's sets are in each orbit's sum."""
    out: dict[int, dict[int, int]] = {o: {} for o, _, _ in _roots(k)}
    of = {key: (o, size) for o, (key, size) in patterns(k).items()}
    sizes = {size for _, size in of.values()}
    for orbit, edges, root in _roots(k):
        if orbit not in patterns(k):
            out[orbit][orbit] = 1
        for _, rest, inner, near in _parts(k, edges, root):
            for size in sizes:
                for some in _marked(near, size):
                    row = of.get(rooted(rest, inner, some, root))
                    if row:
                        out[row[0]][orbit] = out[row[0]].get(orbit, 0) + 1
    return out


@cache
def solution(k: int) -> list[dict]:
    """``(sum, orbit, num, den)``: an orbit's count is the sum of ``num`` times the sums, over ``den``."""
    names = [o for o, _, _ in _roots(k)]
    # Rows of the inverse: the orbit with the most edges first, as it depends on no other.
    edges_of = {o: len(e) for o, e, _ in _roots(k)}
    inverse: dict[int, dict[int, Fraction]] = {}
    for o in sorted(names, key=lambda o: -edges_of[o]):
        row = coefficients(k)[o]
        mine = {o: Fraction(1)}
        for other, c in row.items():
            if other != o:
                for j, x in inverse[other].items():
                    mine[j] = mine.get(j, Fraction(0)) - c * x
        inverse[o] = {j: x / row[o] for j, x in mine.items() if x}
    out = []
    for o, row in inverse.items():
        den = lcm(*(x.denominator for x in row.values()))
        out += [{"sum": j, "orbit": o, "num": int(x * den), "den": den} for j, x in row.items()]
    return out


@cache
def requests(k: int) -> list[dict]:
    """What to ask of a set of k-1 nodes, by the code of its adjacency.

    ``marks`` are the places of A, ``inside`` how many of the set's other nodes
    are adjacent to all of A, ``place`` the root's and ``sum`` the orbit served.
    """
    m = k - 1
    of = {key: (o, size) for o, (key, size) in patterns(k).items()}
    sizes = {size for _, size in of.values()}
    pairs = list(combinations(range(m), 2))
    out = []
    for chosen in range(1 << len(pairs)):
        edges = frozenset(p for i, p in enumerate(pairs) if chosen >> i & 1)
        if not connected(range(m), edges):
            continue
        near = {v: {a + b - v for a, b in edges if v in (a, b)} for v in range(m)}
        code = sum(1 << (m * v + w) for v in near for w in near[v])
        for size in sizes:
            for some in _marked(frozenset(range(m)), size):
                inside = sum(some <= near[v] for v in range(m) if v not in some)
                for place in range(m):
                    row = of.get(rooted(list(range(m)), edges, some, place))
                    if row:
                        out.append({"code": code, "size": size, "marks": sorted(some), "inside": inside, "place": place, "sum": row[0]})
    return out
