"""The sums of ``operators.cuts`` around each node, by arrays, for graphs with many neighbours a node.

There, the pairs with a common neighbour are many times the edges, and a join that
makes them, or walks of three steps, moves each of them. Here a task lists what is
two steps around a node, counts, and keeps only sums for the node and for each of
its edges. Nodes are what runs in parallel; a task reads the neighbour lists from
the shared folder. The costliest sum, the five-cycle's, looks at the lists of all
nodes two steps away, once each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.functions import cuts
from motifloom.operators import lists
from motifloom.operators.graph import Graph
from motifloom.operators.lists import Lists, cut, spans
from motifloom.session import let_workers_import, store

#: Sums for the root, 0, over the nodes two steps away, 1; named as ``_says`` does.
AT_ROOT = {
    "pairs[edges[]@1,wedges[]@01,wedges[]@01]": "ppd",
    "pairs[wedges[]@01,wedges[]@01]": "pp",
    "pairs[wedges[]@01,wedges[]@01,wedges[]@01]": "ppp",
    "pairs[walks[wedges[]@12]@10,wedges[]@01]": "cycle",
    "pairs[wedges[]@01,wedges[edges[]@2]@01]": "pd",
    "pairs[wedges[]@01,wedges[triangles[]@02]@01]": "pt",
    "pairs[wedges[]@01,wedges[triangles[]@20]@10]": "ps",
}
#: Sums for the root, 0, and a neighbour, 1.
FROM_ROOT = {
    "triangles[]": "t",
    "triangles[cliques[]@012]": "k",
    "triangles[cliques[]@012,cliques[]@012]": "kk",
    "triangles[cliques[]@012,triangles[]@12]": "kt",
    "triangles[edges[]@2]": "td",
    "triangles[triangles[]@02]": "tt",
    "triangles[triangles[]@02,triangles[]@02]": "ttt",
    "triangles[cliques[cliques[]@013]@021]": "kc",
    "triangles[spans[wedges[]@12]@02]": "ts",
    "triangles[triangles[cliques[]@012]@02]": "tk",
    "triangles[triangles[edges[]@2]@02]": "tdd",
    "triangles[triangles[triangles[]@02]@02]": "tdt",
}
#: Sums for a neighbour, 0, and the root, 1.
TO_ROOT = {
    "diamonds[hubs[]@012,hubs[]@012]": "hh",
    "diamonds[hubs[]@012,wedges[]@12]": "hp",
    "spans[wedges[]@12]": "s",
    "spans[wedges[]@12,wedges[]@12]": "ss",
    "spans[tops[hubs[]@201]@12]": "sh",
}
COLUMNS = AT_ROOT | FROM_ROOT | TO_ROOT
#: What those are made of; no table of it is needed.
INSIDE = {
    "cliques[]", "hubs[]", "wedges[]", "cliques[cliques[]@013]", "tops[hubs[]@201]", "walks[wedges[]@12]", "wedges[edges[]@2]", "wedges[triangles[]@02]", "wedges[triangles[]@20]",
}
#: Roots of a task, about, and tasks for each core at least.
ROOTS, TASKS = 1024, 4


def says(factor: tuple) -> str:
    """A factor's kind, and the factors that it is made of with their places."""
    inside = (f"{says(name)}@{''.join(map(str, at))}" for name, at in cuts.inner(factor))
    return f"{factor[0]}[{','.join(inside)}]"


def _total(*values: np.ndarray) -> int:
    """The sum of products, whole even beyond 64 bits."""
    most = len(values[0])
    for v in values:
        most *= max(1, int(v.max(initial=0)))
    kind = np.int64 if most < 1 << 63 else object
    product = values[0].astype(kind)
    for v in values[1:]:
        product = product * v.astype(kind)
    return int(product.sum())


class _Around:
    """Lists ``flat[start[u] : start[u + 1]]``, ascending, with each edge's triangles in ``on``; and the sums around a root.

    All places that are looked up are right, so look-ups don't check them (``mode="clip"``).
    """

    def __init__(self, start: np.ndarray, flat: np.ndarray, on: np.ndarray):
        self.start, self.flat, self.on, self.degree = start, flat, on, np.diff(start)
        n = len(self.degree)
        self.count, self.tops, self.place = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1)
        self.small = np.zeros(n, np.int32)

    def above(self) -> np.ndarray:
        """Where the nodes greater than a list's own begin."""
        if not hasattr(self, "_above"):
            self._above = np.empty(len(self.degree), np.int64)
            for some in cut(self.degree, lists.AT_ONCE):
                at = self.start[some.start : some.stop + 1]
                owner = np.repeat(np.arange(some.start, some.stop), np.diff(at))
                lower = np.bincount(owner - some.start, self.flat[at[0] : at[-1]] < owner, some.stop - some.start)
                self._above[some] = at[:-1] + lower.astype(np.int64)
        return self._above

    def triangles(self, root: int) -> np.ndarray:
        """Those on each edge of a root."""
        near = self.flat[self.start[root] : self.start[root + 1]]
        self.place[near] = 0
        out = np.zeros(len(near), np.int64)
        for some in cut(self.degree[near], lists.AT_ONCE):
            at, begin, _ = spans(self.start[near[some]], self.start[near[some] + 1])
            out[some] = np.add.reduceat(self.place[self.flat[at]] == 0, begin, dtype=np.int64)
        self.place[near] = -1
        return out

    def sums(self, root: int) -> tuple[dict[str, int], dict[str, np.ndarray], int]:
        """Sums at the root, those on its edges, and the cliques of five that it is in."""
        near = self.flat[self.start[root] : self.start[root + 1]]
        on = self.on[self.start[root] : self.start[root + 1]].astype(np.int64)
        d = self.degree[near]
        runs = list(cut(d, lists.AT_ONCE))
        # Paths of two steps: how many lead to each node.
        for some in runs:
            ends, n = _counts(self.flat.take(spans(self.start[near[some]], self.start[near[some] + 1])[0], mode="clip"))
            self.count[ends] += n
            self.tops[ends] = 1
        if len(runs) > 1:
            ends = np.flatnonzero(self.tops)
        self.tops[ends] = 0
        p = self.count[ends]
        self.place[near] = np.arange(len(near))
        s, ss = np.zeros(len(near), np.int64), np.zeros(len(near), np.int64)
        ps, ego, beyond = 0, [], []
        for some in runs:
            at, begin, size = spans(self.start[near[some]], self.start[near[some] + 1])
            w, owner = self.flat.take(at, mode="clip"), np.repeat(np.arange(some.start, some.stop), size)
            c = self.count.take(w, mode="clip")
            s[some], ss[some] = np.add.reduceat(c, begin), np.add.reduceat(c * c, begin)
            ps += _total(c, self.on[at])
            # Links between neighbours, and what two of them are linked to, the root too.
            linked = np.flatnonzero(self.place.take(w, mode="clip") > owner)
            ego.append((owner[linked], self.place[w[linked]]))
            twice = np.flatnonzero(c > 1)
            beyond.append((owner[twice], w[twice]))
        row = {"ppd": _total(p, p, self.degree[ends]), "pp": _total(p, p), "ppp": _total(p, p, p), "pd": _total(s, d), "pt": _total(s, on), "ps": ps, "cycle": 2 * self._cycle(ends, p)}
        u, v = (np.concatenate(c) for c in zip(*ego, strict=True))
        edges = {"t": on, "s": s, "ss": ss, **self._corners(u, v, near, d, on, s, *(np.concatenate(c) for c in zip(*beyond, strict=True)))}
        sh = np.zeros(len(near), np.int64)
        for some in runs:
            at, begin, _ = spans(self.start[near[some]], self.start[near[some] + 1])
            sh[some] = np.add.reduceat(self.tops.take(self.flat.take(at, mode="clip"), mode="clip"), begin)
        edges["sh"] = sh
        self.count[ends] = self.tops[ends] = 0
        self.place[near] = -1
        return row, edges, edges.pop("five")

    def _cycle(self, ends: np.ndarray, p: np.ndarray) -> int:
        """Over the edges between ends, the products of their counts."""
        above, total = self.above(), 0
        narrow = int(p.max()) * int(self.degree[ends].max()) < 1 << 31
        count = self.count
        if narrow:
            count = self.small
            count[ends] = p
        low, high = above[ends], self.start[ends + 1]
        some_left = np.flatnonzero(high > low)
        p, low, high = p[some_left], low[some_left], high[some_left]
        for some in cut(high - low, max(1, lists.AT_ONCE >> 3)):
            at, begin, _ = spans(low[some], high[some])
            near = self.flat.take(at, mode="clip")
            total += _total(np.add.reduceat(count.take(near, mode="clip"), begin, dtype=count.dtype), p[some])
        if narrow:
            count[ends] = 0
        return total

    def _corners(self, u, v, near, d, on, s, owner, w) -> dict:
        """Sums over the linked pairs ``u < v`` of the root's neighbours, by place, and what both are linked to; ``owner, w`` are the lists of neighbours as far as they matter, by owner."""
        m, n = len(near), len(self.degree)
        add = lambda places, values: _added(places, values, m)
        keys = owner * n + w  # ascending
        first = np.searchsorted(owner, np.arange(m + 1))
        size = first[v + 1] - first[v]
        order = {c: np.zeros(m, np.int64) for c in ("k", "kk", "kt", "kc", "hh", "hp", "td", "tt", "ttt", "ts")}
        for c, x in (("td", d), ("tt", on), ("ttt", on * on), ("ts", s)):
            order[c] = add(u, x[v]) + add(v, x[u])
        both = np.zeros(len(u), np.int64)  # cliques of four on the pair and the root
        pairs, corners = u * m + v, []
        hubs = []
        for some in cut(size, lists.AT_ONCE):
            at, _, many = spans(first[v[some]], first[v[some] + 1])
            pair = np.repeat(np.arange(some.start, some.stop), many)
            x = w[at]
            asked = u[pair] * n + x
            at = np.searchsorted(keys, asked)
            found = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == asked)
            pair, x = pair[found], x[found]
            np.add.at(self.tops, x, 2)
            c = self.count[x]
            order["hp"] += add(u[pair], c) + add(v[pair], c)
            t = np.bincount(pair - some.start, minlength=some.stop - some.start)
            inside = np.flatnonzero(self.place[x] >= 0)
            both[some] = k = np.bincount(pair[inside] - some.start, minlength=some.stop - some.start)
            order["kt"] += add(u[some], k * t) + add(v[some], k * t)
            corners.append((pair[inside], self.place[x[inside]]))
            hubs.append(np.concatenate((u[pair] * n + x, v[pair] * n + x)))
        order["k"], order["kk"] = add(u, both) + add(v, both), add(u, both * both) + add(v, both * both)
        if hubs:
            at, many = _counts(np.concatenate(hubs))
            order["hh"] = add(at // n, many * many)
        five = 0
        if corners:
            pair, x = (np.concatenate(c) for c in zip(*corners, strict=True))
            of = lambda a: both[np.searchsorted(pairs, np.minimum(a, x) * m + np.maximum(a, x))]
            order["kc"] = add(u[pair], of(v[pair])) + add(v[pair], of(u[pair]))
            # Cliques of four among the neighbours, at their two least: pairs of what both are linked to.
            up = np.flatnonzero(x > v[pair])
            pair, x = pair[up], x[up]
            last = np.searchsorted(pair, pair, "right")
            for some in cut(last - np.arange(len(pair)) - 1, lists.AT_ONCE):
                here = np.arange(some.start, some.stop)
                at, _, many = spans(here + 1, last[some])
                a, b = np.repeat(x[some], many), x[at]
                asked = np.minimum(a, b) * m + np.maximum(a, b)
                place = np.searchsorted(pairs, asked)
                five += int((pairs[np.minimum(place, len(pairs) - 1)] == asked).sum())
        for c, x in (("tk", "k"), ("tdd", "td"), ("tdt", "tt")):
            order[c] = add(u, order[x][v]) + add(v, order[x][u])
        return order | {"five": five}


def _counts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values, ascending, and how often each is there."""
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1])))
    return values[first], np.diff(np.append(first, len(values)))


def _added(places: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of values by place; whole numbers, as float sums could round."""
    if int(np.abs(values).max(initial=0)) * len(values) < 1 << 53:
        return np.bincount(places, values, size).astype(np.int64)
    out = np.zeros(size, np.int64)
    np.add.at(out, places, values)
    return out


def _each_root(spark, nodes: int, kernel: Callable[[np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    let_workers_import(spark)
    tasks = max(1, min(nodes, max(TASKS * spark.sparkContext.defaultParallelism, -(-nodes // ROOTS))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from kernel(batch.column(0).to_numpy())

    return spark.range(0, nodes, 1, tasks).mapInArrow(run, schema)


def _lists_of(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values), kind))


def _in_turns(roots: np.ndarray, degree: np.ndarray) -> Iterator[np.ndarray]:
    """Roots with neighbours, of about as many edges a turn as go out in a batch."""
    roots = roots[degree[roots] > 0]
    for some in cut(degree[roots], 1 << 16):
        yield roots[some]


def _with_triangles(spark, near: Lists) -> Lists:
    """Triangles on each edge, in the order of the lists."""

    def count(roots: np.ndarray) -> Iterator[pa.RecordBatch]:
        start, flat = near.whole()
        around = _Around(start, flat, flat)
        for some in _in_turns(roots, around.degree):
            found = [around.triangles(int(r)) for r in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), _lists_of(found, pa.int32())], ["u", "ts"])

    return lists.written(_each_root(spark, near.nodes, count, "u long, ts array<int>"), "ts", near.nodes)


_ON_EDGES = [*FROM_ROOT.values(), *TO_ROOT.values()]


def _all_sums(spark, near: Lists, on: Lists) -> DataFrame:
    """``(u, vs, ...)``: the sums at each node, its neighbours, those on its edges, in their order, and its cliques of five."""

    def sums(roots: np.ndarray) -> Iterator[pa.RecordBatch]:
        start, flat = near.whole()
        around = _held_with(near, on, start, flat)
        for some in _in_turns(roots, around.degree):
            rows, edges, five = zip(*(around.sums(int(r)) for r in some), strict=True)
            columns = [pa.array(some, pa.int64()), _lists_of([flat[start[r] : start[r + 1]] for r in some], pa.int64()), pa.array(five, pa.int64())]
            columns += [pa.array([Decimal(r[c]) for r in rows], pa.decimal128(38, 0)) for c in AT_ROOT.values()]
            columns += [_lists_of([e[c] for e in edges], pa.int64()) for c in _ON_EDGES]
            yield pa.RecordBatch.from_arrays(columns, ["u", "vs", "five", *AT_ROOT.values(), *_ON_EDGES])

    kinds = ["u long", "vs array<long>", "five long", *(f"{c} decimal(38,0)" for c in AT_ROOT.values()), *(f"{c} array<long>" for c in _ON_EDGES)]
    return _each_root(spark, near.nodes, sums, ", ".join(kinds))


_held: dict = {}


def _held_with(near: Lists, on: Lists, start: np.ndarray, flat: np.ndarray) -> _Around:
    """Lists with the triangles on their edges; a worker keeps those that it read last."""
    if _held.get("files") != near.files:
        _held.clear()
        _held.update(files=near.files, around=_Around(start, flat, on.block((0, len(on.groups)))[1]))
    return _held["around"]


def tables(g: Graph) -> tuple[dict[str, DataFrame], DataFrame] | None:
    """The table ``(q0, value)`` or ``(q0, q1, value)`` of each factor by what ``says`` calls it, and ``(node, n)`` of cliques of five; None where tasks can't open the shared folder."""
    spark = g.edge.sparkSession
    near = g.lists
    on = near and _with_triangles(spark, near)
    if on is None:
        return None
    held = store(_all_sums(spark, near, on), "rooted").read()
    node = held.select(F.col("u").alias("q0"), *AT_ROOT.values())
    from_root = held.select("u", F.inline(F.arrays_zip("vs", *FROM_ROOT.values()))).select(F.col("u").alias("q0"), F.col("vs").alias("q1"), *FROM_ROOT.values())
    to_root = held.select("u", F.inline(F.arrays_zip("vs", *TO_ROOT.values()))).select(F.col("vs").alias("q0"), F.col("u").alias("q1"), *TO_ROOT.values())
    out = dict.fromkeys(AT_ROOT, node) | dict.fromkeys(FROM_ROOT, from_root) | dict.fromkeys(TO_ROOT, to_root)
    return out, held.where("five > 0").select(F.col("u").alias("node"), F.col("five").alias("n"))
