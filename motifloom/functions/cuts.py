"""Orbit counts of nodes from counts of homomorphisms, and these from tables of at most three nodes.

For a rooted pattern F and a node v, let hom(F, v) be the number of maps of F's
nodes into the graph that send the root to v and edges to edges; unlike sets,
maps may join nodes, so they can be counted by summing out one node after the
other. The maps that join nothing are a combination of the maps of F with some
of its nodes joined, and induced sets one of those, so each orbit count is a
fixed combination of 73 homomorphism counts (for five nodes; the method of
Curticapean, Dell and Marx, 2017). ``solution`` derives it.

Summing out node x leaves a factor on the nodes that shared an edge or a factor
with x. ``elimination`` takes the cheapest order; factors that patterns have in
common are computed once. No order needs a factor of more than three nodes but
for the complete graph of five, which is counted by its cliques.
"""

from __future__ import annotations

from fractions import Fraction
from functools import cache
from itertools import combinations, permutations, product
from math import factorial, lcm

from motifloom.functions.atlas import Edges, connected
from motifloom.functions.equations import _roots

Pattern = tuple[int, tuple[tuple[int, int], ...]]  # nodes, edges; the root is node 0


def canonical(k: int, edges: Edges, root: int) -> Pattern:
    """Equal for two rooted graphs if and only if one can be laid on the other."""
    others = [v for v in range(k) if v != root]
    best = None
    for order in permutations(others):
        at = {root: 0} | {v: i + 1 for i, v in enumerate(order)}
        here = tuple(sorted(tuple(sorted((at[a], at[b]))) for a, b in edges))
        best = here if best is None or here < best else best
    return k, best


@cache
def rooted_patterns(k: int) -> dict[int, Pattern]:
    """The rooted pattern of each orbit of size ``k``."""
    return {orbit: canonical(k, edges, root) for orbit, edges, root in _roots(k)}


def _inside(p: Pattern, q: Pattern) -> int:
    """Ways to lay ``p`` on ``q``, of as many nodes, root on root, edges on edges."""
    k, target = q[0], set(q[1])
    n = 0
    for order in permutations(range(1, k)):
        at = (0, *order)
        n += all((min(at[a], at[b]), max(at[a], at[b])) in target for a, b in p[1])
    return n


def _partitions(nodes: list[int]):
    if not nodes:
        yield []
        return
    first, rest = nodes[0], nodes[1:]
    for some in _partitions(rest):
        yield [[first], *some]
        for i, block in enumerate(some):
            yield [*some[:i], [first, *block], *some[i + 1 :]]


@cache
def _joined(p: Pattern) -> dict[Pattern, int]:
    """Maps of ``p`` that join nothing, as a combination of all maps of patterns."""
    k, edges = p
    out: dict[Pattern, int] = {}
    for blocks in _partitions(list(range(k))):
        of = {v: i for i, b in enumerate(blocks) for v in b}
        if any(of[a] == of[b] for a, b in edges):
            continue
        sign = 1
        for b in blocks:
            sign *= (-1) ** (len(b) - 1) * factorial(len(b) - 1)
        q = canonical(len(blocks), frozenset(tuple(sorted((of[a], of[b]))) for a, b in edges), of[0])
        out[q] = out.get(q, 0) + sign
    return {q: c for q, c in out.items() if c}


@cache
def solution(k: int) -> list[dict]:
    """``(pattern, orbit, num, den)``: an orbit's count is the sum of ``num`` times the patterns' maps, over ``den``."""
    pats = rooted_patterns(k)
    inverse: dict[int, dict[int, Fraction]] = {}
    for o in sorted(pats, key=lambda o: -len(pats[o][1])):
        row = {q: _inside(pats[o], pats[q]) for q in pats if len(pats[q][1]) >= len(pats[o][1])}
        mine = {o: Fraction(1)}
        for q, c in row.items():
            if q != o and c:
                for j, x in inverse[q].items():
                    mine[j] = mine.get(j, Fraction(0)) - c * x
        inverse[o] = {j: x / row[o] for j, x in mine.items() if x}
    out = []
    for o, row in inverse.items():
        total: dict[Pattern, Fraction] = {}
        for j, x in row.items():
            for q, c in _joined(pats[j]).items():
                total[q] = total.get(q, Fraction(0)) + c * x
        total = {q: x for q, x in total.items() if x}
        den = lcm(*(x.denominator for x in total.values()))
        out += [{"pattern": q, "orbit": o, "num": int(x * den), "den": den} for q, x in total.items()]
    return out


# ---- summing out

#: What summing out a node costs, by the rows that have to be made: the tables of ``operators.cuts``.
COSTS = {"edges": 1, "pairs": 4, "triangles": 3, "wedges": 20, "cliques": 5, "hubs": 40, "diamonds": 30, "tops": 30, "spans": 60, "walks": 400}


@cache
def _step(involved: tuple, scope: int, given: tuple) -> tuple | None:
    """The table whose rows sum out the last node of ``involved`` factors on places 0 to ``scope``; None if there is none.

    ``given`` are the pairs of places that the rest of the pattern links.
    """
    x = scope
    links = {at for name, at in involved if name == "A"} | set(given)
    near = {a + b - x for a, b in links if x in (a, b)}
    if scope == 1:
        return "edges" if near else "pairs"
    if scope == 2:
        three = [at for _, at in involved if len(at) == 3]
        if len(links) == 3:
            return "triangles"
        if three:
            return "diamonds" if (0, 1) in links else "tops" if near == {0, 1} else None
        if near == {0, 1}:
            return "wedges"
        if len(near) == 1:
            return "spans" if (0, 1) in links else "walks"
    if scope == 3 and near == {0, 1, 2}:
        inner = sum(at in links for at in combinations(range(3), 2))
        if inner == 3:
            return "cliques"
        return "hubs" if inner == 2 else None
    return None


def _eliminate(factors: list[tuple], x: int) -> tuple | None:
    """The factor that summing out ``x`` leaves: ``(kind, key, scope)``, and the factors left."""
    involved = [f for f in factors if x in f[1]]
    rest = [f for f in factors if x not in f[1]]
    nodes = sorted({v for _, at in involved for v in at} - {x})
    if len(nodes) > 3:
        return None
    best = None
    for order in permutations(nodes):
        at = {v: i for i, v in enumerate(order)} | {x: len(order)}
        mine = []
        for name, scope in involved:
            here = tuple(at[v] for v in scope)
            mine.append((name, tuple(sorted(here)) if name == "A" else here))
        given = tuple(sorted(tuple(sorted((at[a], at[b]))) for n, (a, b) in ((n, s) for n, s in rest if n == "A") if a in at and b in at))
        key = (tuple(sorted(mine, key=repr)), len(nodes), given)
        best = (key, order) if best is None or repr(key) < repr(best[0]) else best
    kind = _step(*best[0])
    return None if kind is None else (kind, best[0], best[1], rest)


def inner(factor: tuple) -> list[tuple]:
    """The factors that a factor ``(kind, key)`` is made of, and where each lies, without the edges."""
    return [(name, at) for name, at in factor[1][0] if name != "A"]


def _all(factors) -> set[tuple]:
    out = set(factors)
    for f in factors:
        out |= _all([name for name, _ in inner(f)])
    return out


@cache
def elimination(p: Pattern) -> tuple:
    """The node factors, ``(kind, key)`` each, whose product is the pattern's maps, by the cheapest order; equal factors cost once."""
    k, edges = p

    def orders(factors: list[tuple], left: frozenset[int]):
        if not left:
            yield tuple(sorted((f[0] for f in factors), key=repr))
        for x in left:
            got = _eliminate(factors, x)
            if got:
                kind, key, scope, rest = got
                yield from orders([*rest, ((kind, key), scope)], left - {x})

    found = [(sum(COSTS[kind] for kind, _ in _all(fs)), repr(fs), fs) for fs in orders([("A", e) for e in edges], frozenset(range(1, k)))]
    if not found:
        raise ValueError(f"no order for {p}")
    return min(found)[2]


def complete(p: Pattern) -> bool:
    return len(p[1]) == p[0] * (p[0] - 1) // 2


@cache
def patterns(k: int) -> list[Pattern]:
    """The patterns whose maps are counted by summing out: all but the complete graph of five nodes."""
    return [p for p in sorted({r["pattern"] for r in solution(k)}) if p[0] < 5 or not complete(p)]


#: The table that a kind's factors are columns of: nodes, linked pairs, pairs, triangles, hubs with two of their neighbours.
TABLES = {"edges": "N", "pairs": "N", "triangles": "E", "diamonds": "E", "spans": "E", "wedges": "P", "walks": "P", "tops": "P", "cliques": "T", "hubs": "H"}


@cache
def rounds(k: int) -> list[list[tuple[str, list[tuple]]]]:
    """Rounds of ``(kind, factors)``; each factor is made of factors of earlier rounds."""
    depth: dict[tuple, int] = {}

    def deep(f: tuple) -> int:
        if f not in depth:
            depth[f] = 1 + max([deep(name) for name, _ in inner(f)], default=0)
        return depth[f]

    for p in patterns(k):
        for f in elimination(p):
            deep(f)
    groups: dict[tuple, list] = {}
    for f, d in depth.items():
        groups.setdefault((d, f[0]), []).append(f)
    last = max(depth.values())
    return [[(kind, sorted(groups[d, kind], key=repr)) for d, kind in sorted(groups) if d == now] for now in range(1, last + 1)]
