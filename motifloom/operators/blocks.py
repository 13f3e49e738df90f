"""Common neighbours in graphs with many neighbours a node, by pairs of blocks of neighbour lists.

There, the wedges that joins would shuffle are many times the edges. Here nodes are
dealt into blocks by their id, and each pair of blocks meets in one group: a list is
sent once for each block, and what its group counts needs no further shuffle. The
number of blocks grows with the edges, so that a group holds a bounded number of
entries (beyond the lists of single nodes), and groups are what runs in parallel.

What is sent so grows with the square of the edges. Where tasks can open the shared
folder nothing is sent: a task holds the lists of one block and reads those of others
from there (``operators.lists``), many nodes at a time as arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.operators import lists
from motifloom.operators.lists import Lists, cut, spans
from motifloom.session import let_workers_import

#: Entries of a block's lists, about, and the least number of blocks.
ENTRIES, LEAST_BLOCKS = 1 << 23, 6
#: Entries of the block that a task holds, about, and tasks for each core, about.
HELD, TASKS = 1 << 24, 4
#: Entries of lists that are looked for at once, and the places, a power of two, that say which can't be among them.
ROWS, SIEVE = 1 << 15, 1 << 20


class _Pair:
    """The lists of two blocks, ``i`` and ``j``, which may be the same: ``flat[start[r] : start[r + 1]]`` of node ``u[r]``, ascending."""

    def __init__(self, table: pa.Table, blocks: int):
        self.blocks = blocks
        self.i, self.j = table["i"][0].as_py(), table["j"][0].as_py()
        lists = table["vs"].combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        self.u = table["u"].to_numpy()
        self.flat, self.start = lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        self.start -= self.start[0]

    def rows_of(self, block: int) -> np.ndarray:
        return np.flatnonzero(self.u % self.blocks == block)

    def spans(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The entries of some rows' lists, one after the other; where each begins, and lengths."""
        size = self.start[rows + 1] - self.start[rows]
        begin = np.cumsum(size) - size
        return self.flat[np.repeat(self.start[rows] - begin, size) + np.arange(size.sum())], begin, size

    def edges(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each node ``a`` of ``i``, the nodes of ``j`` linked to it, each edge once in all groups; entries of their lists, which of these are linked to ``a``, and where each list begins, and lengths."""
        others = self.rows_of(self.j)
        others = others[np.argsort(self.u[others])]
        names = self.u[others]
        mark = np.zeros(max(self.flat.max(initial=0), self.u.max(initial=0)) + 1, bool)
        for r in self.rows_of(self.i):
            near, a = self.flat[self.start[r] : self.start[r + 1]], self.u[r]
            linked = near[near % self.blocks == self.j]
            if self.i == self.j:
                linked = linked[linked > a]
            if not len(linked):
                continue
            mark[near] = True
            entries, begin, size = self.spans(others[np.searchsorted(names, linked)])
            yield a, linked, entries, mark[entries], begin, size
            mark[near] = False


def _support(pair: _Pair) -> pa.Table:
    out: list[tuple] = []
    for a, linked, _, hit, begin, _ in pair.edges():
        out.append((np.minimum(a, linked), np.maximum(a, linked), np.add.reduceat(hit, begin, dtype=np.int64)))
    return _table(out, "uvt")


def _triangles(pair: _Pair) -> pa.Table:
    """Each triangle at the edge of its two least nodes."""
    out: list[tuple] = []
    for a, linked, entries, hit, _, size in pair.edges():
        top = np.repeat(np.maximum(a, linked), size)
        found = np.flatnonzero(hit & (entries > top))
        low = np.repeat(np.minimum(a, linked), size)
        out.append((low[found], top[found], entries[found]))
    return _table(out, "xyz")


def _pairs_of_paths(pair: _Pair) -> pa.Table:
    """Sum over pairs of nodes of the pairs of their common neighbours."""
    others = pair.rows_of(pair.j)
    flat, _, size = pair.spans(others)
    order = np.argsort(flat, kind="stable")
    over, ends = flat[order], np.repeat(pair.u[others], size)[order]  # nodes of j by their neighbour
    total = 0
    for r in pair.rows_of(pair.i):
        near = pair.flat[pair.start[r] : pair.start[r + 1]]
        low, high = np.searchsorted(over, near), np.searchsorted(over, near, "right")
        size = high - low
        begin = np.cumsum(size) - size
        met = ends[np.repeat(low - begin, size) + np.arange(size.sum())]
        if pair.i == pair.j:
            met = met[met > pair.u[r]]
        met.sort()
        at = np.flatnonzero(np.diff(met, prepend=-1, append=-1))
        n = np.diff(at)
        total += int((n * (n - 1) // 2).sum())
    return pa.table({"n": pa.array([total], pa.int64())})


def _table(parts: list[tuple], names: str) -> pa.Table:
    columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (list(zip(*parts, strict=True)) or [()] * len(names))]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})


def _each_pair(nbr: DataFrame, entries: int, kernel: Callable[[_Pair], pa.Table], schema: str) -> DataFrame:
    """``kernel`` on every pair of blocks of ``nbr(u, nbrs, d)``, which has so many ``entries``."""
    let_workers_import(nbr.sparkSession)
    blocks = max(LEAST_BLOCKS, -(-entries // ENTRIES))
    mine, other = F.col("u") % blocks, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")
    sent = nbr.select("u", F.col("nbrs").alias("vs"), mine.cast("int").alias("c"), other)
    sent = sent.select(F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "u", "vs")
    return sent.groupBy("i", "j").applyInArrow(lambda table: kernel(_Pair(table, blocks)), schema)


def support(nbr: DataFrame, entries: int) -> DataFrame:
    """``(u, v, t)``: common neighbours of each edge's ends, u < v."""
    return _each_pair(nbr, entries, _support, "u long, v long, t long")


def triangles(nbr: DataFrame, entries: int) -> DataFrame:
    """``(x, y, z)``, x < y < z."""
    return _each_pair(nbr, entries, _triangles, "x long, y long, z long")


def pairs_of_paths(nbr: DataFrame, entries: int) -> DataFrame:
    """``(n)``: sums over pairs of nodes of the pairs of their common neighbours, a row for each pair of blocks."""
    return _each_pair(nbr, entries, _pairs_of_paths, "n long")


# ---- reading lists


class _Block:
    """The lists of a block: ``flat[start[u - low] : start[u - low + 1]]`` of node ``u``, ascending."""

    def __init__(self, near: Lists, run: tuple[int, int]):
        self.nodes, (self.low, self.high) = near.nodes, near.bounds(run)
        self.start, self.flat = near.block(run)
        self.sieve = np.zeros(SIEVE, bool)

    def shared(self, u: np.ndarray, start: np.ndarray, flat: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """For lists of nodes ``u``, the edges to greater nodes of the block: places of ``u``, their other ends; then edges and nodes that both ends are linked to."""
        for rows in cut(np.diff(start), ROWS):
            near, owner = flat[start[rows.start] : start[rows.stop]], np.repeat(np.arange(rows.start, rows.stop), np.diff(start[rows.start : rows.stop + 1]))
            edges = np.flatnonzero((near >= self.low) & (near < self.high) & (near > u[owner]))
            if not len(edges):
                continue
            place, other = owner[edges], near[edges].astype(np.int64) - self.low
            keys, marks = owner * self.nodes + near, _mix(owner, near)
            self.sieve[marks] = True
            low, high = self.start[other], self.start[other + 1]
            for some in cut(high - low, lists.AT_ONCE >> 2):
                at, _, size = spans(low[some], high[some])
                w = self.flat.take(at, mode="clip")
                may = np.flatnonzero(self.sieve.take(_mix(np.repeat(place[some], size), w), mode="clip"))
                edge, w = np.repeat(np.arange(some.stop - some.start), size)[may], w[may]
                asked = place[some][edge] * self.nodes + w
                found = np.searchsorted(keys, asked)
                found = np.flatnonzero(keys[np.minimum(found, len(keys) - 1)] == asked)
                yield place[some], other[some] + self.low, edge[found], w[found]
            self.sieve[marks] = False


def _mix(owner: np.ndarray, node: np.ndarray) -> np.ndarray:
    return (owner * 0x9E3779B1 + node) & (SIEVE - 1)


def _read_edges(block: _Block, u: np.ndarray, start: np.ndarray, flat: np.ndarray) -> Iterator[pa.RecordBatch]:
    size = np.diff(start)
    for place, v, edge, _ in block.shared(u, start, flat):
        t, at = np.bincount(edge, minlength=len(v)), v - block.low
        yield _batch("uvt", u[place], v, t, du=size[place], dv=block.start[at + 1] - block.start[at])


def _read_triangles(block: _Block, u: np.ndarray, start: np.ndarray, flat: np.ndarray) -> Iterator[pa.RecordBatch]:
    for place, v, edge, w in block.shared(u, start, flat):
        top = w > v[edge]
        yield _batch("xyz", u[place[edge[top]]], v[edge[top]], w[top])


def _read_corners(block: _Block, u: np.ndarray, start: np.ndarray, flat: np.ndarray) -> Iterator[pa.RecordBatch]:
    for _, v, edge, w in block.shared(u, start, flat):
        top = w > v[edge]
        edge, w = edge[top], w[top]
        last = np.searchsorted(edge, edge, "right")
        for some in cut(last - np.arange(len(edge)) - 1, lists.AT_ONCE):
            at, _, size = spans(np.arange(some.start, some.stop) + 1, last[some])
            yield _batch("zw", np.repeat(w[some], size), w[at])


class _Turned:
    """A block by the nodes in its lists: ``flat[start[u] : start[u + 1]]`` are the block's nodes, from ``low``, that are linked to ``u`` and greater."""

    def __init__(self, near: Lists, run: tuple[int, int]):
        self.low, self.high = near.bounds(run)
        start, flat = near.block(run)
        self.bits = int(self.high - self.low).bit_length()
        keys = flat.astype(np.int64)
        keys <<= self.bits
        for rows in cut(np.diff(start), lists.AT_ONCE):
            keys[start[rows.start] : start[rows.stop]] |= np.repeat(np.arange(rows.start, rows.stop), np.diff(start[rows.start : rows.stop + 1]))
        mask = (1 << self.bits) - 1
        keys = keys[(keys >> self.bits) < (keys & mask) + self.low]
        keys.sort()
        self.flat = (keys & mask).astype(np.int32 if self.bits < 31 else np.int64)
        self.start = np.searchsorted(keys, np.arange(near.nodes + 1) << self.bits)


def _read_squares(block: _Turned, u: np.ndarray, start: np.ndarray, flat: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Twice the cycles of four whose greatest node is in the block and opposite to one of ``u``."""
    total = 0
    low, high = block.start.take(flat, mode="clip"), block.start.take(flat + 1, mode="clip")
    size = np.concatenate((np.zeros(1, np.int64), np.cumsum(high - low)))
    for rows in cut(np.diff(size[start]), lists.AT_ONCE):
        part = slice(start[rows.start], start[rows.stop])
        at, _, many = spans(low[part], high[part])
        owner = np.repeat(np.arange(rows.stop - rows.start), np.diff(start[rows.start : rows.stop + 1]))
        w, owner = block.flat.take(at, mode="clip"), np.repeat(owner, many)
        if u[rows.stop - 1] >= block.low:
            above = np.flatnonzero(w + block.low > u[rows][owner])
            w, owner = w[above], owner[above]
        narrow = (rows.stop - rows.start) << block.bits < 1 << 31
        ends = (owner.astype(np.int32 if narrow else np.int64) << block.bits) | w
        ends.sort()
        again = np.flatnonzero(ends[1:] == ends[:-1])
        # Of a run of n equal ones, n - 1 are the same as the one before: n (n - 1) / 2 pairs.
        first = np.flatnonzero(np.diff(again, prepend=-2) != 1)
        n = np.diff(np.append(first, len(again)))
        total += int((n * (n + 1) // 2).sum())
    yield _batch("n", np.array([2 * total]))


def _batch(names: str, *columns: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    named = dict(zip(names, columns, strict=True)) | more
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in named.values()], list(named))


def _each_read(spark: SparkSession, near: Lists, hold: type, kernel: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``kernel`` on each block held and all lists of its and lesser nodes, a run of them in a task."""
    let_workers_import(spark)
    slots = TASKS * spark.sparkContext.defaultParallelism
    blocks = max(-(-near.entries // HELD), int((2 * slots) ** 0.5))
    runs = near.runs(max(1, -(-near.entries // blocks)))
    wide = -(-len(runs) * (len(runs) + 1) // (2 * slots))
    work = [(run, (runs[j][0], runs[min(j + wide, i + 1) - 1][1])) for i, run in enumerate(runs) for j in range(0, i + 1, max(1, wide))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                held = hold(near, work[i][0])
                for u, start, flat in near.read(work[i][1]):
                    yield from kernel(held, u, start, flat)

    return spark.range(0, len(work), 1, max(1, len(work))).mapInArrow(read, schema)


def edges_read(spark: SparkSession, near: Lists) -> DataFrame:
    """``(u, v, t, du, dv)``: common neighbours of each edge's ends, u < v, and the ends' degrees."""
    return _each_read(spark, near, _Block, _read_edges, "u long, v long, t long, du long, dv long")


def triangles_read(spark: SparkSession, near: Lists) -> DataFrame:
    """``(x, y, z)``, x < y < z."""
    return _each_read(spark, near, _Block, _read_triangles, "x long, y long, z long")


def corners_read(spark: SparkSession, near: Lists) -> DataFrame:
    """``(z, w)``, z < w: two greater nodes that both ends of an edge are linked to, a row for each edge that has them."""
    return _each_read(spark, near, _Block, _read_corners, "z long, w long")


def pairs_of_paths_read(spark: SparkSession, near: Lists) -> DataFrame:
    """``(n)``: parts of the sum over pairs of nodes of the pairs of their common neighbours."""
    return _each_read(spark, near, _Turned, _read_squares, "n long")
