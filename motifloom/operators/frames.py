"""All frames of a graph and what they see, by arrays: nothing of a frame is stored or sent.

A frame is a path of k-1 different nodes. A task takes some first nodes, lists the
paths from them over neighbour lists that it reads from the shared folder, a bounded
number of entries at a time, and observes each; frames of like degrees are summed.
A path and its reverse see the same, so one of them is looked at and counts twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from motifloom.functions import atlas
from motifloom.operators import lists
from motifloom.operators.graph import Graph
from motifloom.operators.lists import cut, spans
from motifloom.session import let_workers_import

#: First nodes of a task, about, and tasks for each core at least.
FIRST, TASKS = 1 << 14, 4


class _Frames:
    """Paths of ``k - 1`` nodes over ``flat[start[u] : start[u + 1]]``."""

    def __init__(self, start: np.ndarray, flat: np.ndarray, k: int):
        self.start, self.flat, self.k, self.m = start, flat, k, k - 1
        self.pairs = atlas.chord_pairs(k)
        self.type = np.full((1 << len(self.pairs), 1 << self.m), -1)
        for r in atlas.extensions(k):
            self.type[r["chords"], r["bits"]] = r["type"]

    def lists(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The neighbours of nodes, and whose they are."""
        at, _, size = spans(self.start[nodes], self.start[nodes + 1])
        return self.flat[at].astype(np.int64), np.repeat(np.arange(len(nodes)), size)

    def degree(self, nodes: np.ndarray) -> np.ndarray:
        return self.start[nodes + 1] - self.start[nodes]

    def paths(self, path: np.ndarray) -> Iterator[np.ndarray]:
        """Rows of ``path`` made longer until all have ``m`` nodes, the last greater than the first."""
        if path.shape[1] == self.m:
            yield path[path[:, 0] < path[:, -1]]
            return
        for some in cut(self.degree(path[:, -1]), lists.AT_ONCE >> 3):
            after, owner = self.lists(path[some, -1])
            longer = np.concatenate((path[some][owner], after[:, None]), axis=1)
            yield from self.paths(longer[(longer[:, :-1] != after[:, None]).all(axis=1)])

    def observed(self, first: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Degrees of the frame's nodes, chords, type, and the sum of sets of that type over such frames."""
        for path in self.paths(first[:, None].astype(np.int64)):
            for some in cut(self.degree(path.ravel()).reshape(path.shape).sum(axis=1), lists.AT_ONCE):
                yield self._observe(path[some])

    def _observe(self, path: np.ndarray) -> tuple[np.ndarray, ...]:
        m, n = self.m, len(self.start) - 1
        seen = []
        for i in range(m):
            x, frame = self.lists(path[:, i])
            seen.append(((frame * n + x) << m) | (1 << i))
        seen = np.sort(np.concatenate(seen))
        key = seen >> m
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, bits = key[first], np.add.reduceat(seen & ((1 << m) - 1), first)
        frame, x = key // n, key % n
        # Rows of frame nodes themselves tell the chords; the others are neighbours.
        outside, chords = np.ones(len(x), bool), np.zeros(len(path), np.int64)
        for i in range(m):
            at = np.flatnonzero(path[frame, i] == x)
            outside[at] = False
            for j, (a, b) in enumerate(self.pairs):
                if a == i:
                    chords[frame[at]] |= (bits[at] >> b & 1) << j
        kind = chords
        degrees = self.degree(path.ravel()).reshape(path.shape)
        for i in range(m):  # frames of like degrees and chords
            kind = np.unique(kind, return_inverse=True)[1] * (int(degrees[:, i].max()) + 1) + degrees[:, i]
        _, like, kind = np.unique(kind, return_index=True, return_inverse=True)
        frame, bits = frame[outside], bits[outside]
        types = int(self.type.max()) + 1
        n = np.bincount(kind[frame] * types + self.type[chords[frame], bits], minlength=len(like) * types)
        some = np.flatnonzero(n)
        which = like[some // types]
        return (*degrees[which].T, chords[which], some % types, 2 * n[some])


def observed(g: Graph, k: int, names: str) -> DataFrame:
    """``(du, dv, ..., chords, type, n)`` over all frames of ``k - 1`` nodes ``names``, in parts: sets of each type over them."""
    spark, near = g.edge.sparkSession, g.lists
    let_workers_import(spark)
    columns = [*(f"d{c}" for c in names), "chords", "type", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = _Frames(*near.whole(), k)
        for batch in batches:
            for rows in frames.observed(batch.column(0).to_numpy()):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], columns)

    tasks = max(1, min(near.nodes, max(TASKS * spark.sparkContext.defaultParallelism, -(-near.nodes // FIRST))))
    return spark.range(0, near.nodes, 1, tasks).mapInArrow(run, ", ".join(f"{c} long" for c in columns))
