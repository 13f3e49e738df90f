"""Neighbour lists in the shared folder, that tasks read by themselves.

The lists lie as Parquet in the order of nodes. The footers tell the nodes and
entries of each row group, so a task takes a run of row groups, or all, and nothing
of the graph goes through the driver or is sent again for each reader.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.session import Stored, shared_dir, short_lived_shuffles

#: Bytes of a row group, and entries up to which ``whole`` keeps them in memory.
GROUP_BYTES, IN_MEMORY = 1 << 22, 1 << 27
#: Entries that are looked at at once.
AT_ONCE = 1 << 20


@dataclass(frozen=True)
class Lists:
    """Row groups ``(file, number, least node, entries)`` in the order of nodes; all nodes are below ``nodes``."""

    files: list[str]
    groups: list[tuple[int, int, int, int]]
    nodes: int
    column: str

    @property
    def entries(self) -> int:
        return sum(g[3] for g in self.groups)

    def runs(self, entries: int) -> list[tuple[int, int]]:
        """Runs of row groups of about so many entries, at least one group each."""
        out, first, held = [], 0, 0
        for i, g in enumerate(self.groups):
            if i > first and held + g[3] > entries:
                out.append((first, i))
                first, held = i, 0
            held += g[3]
        return [*out, (first, len(self.groups))] if self.groups else []

    def bounds(self, run: tuple[int, int]) -> tuple[int, int]:
        """The nodes of a run: at least the first, below the second."""
        return self.groups[run[0]][2], self.groups[run[1]][2] if run[1] < len(self.groups) else self.nodes

    def read(self, run: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each row group: its nodes, where their lists begin and end, and the lists' entries."""
        opened, at = None, None
        for file, number, _, _ in self.groups[run[0] : run[1]]:
            if file != at:
                where, path = fs.FileSystem.from_uri(self.files[file])
                opened, at = pq.ParquetFile(where.open_input_file(path)), file
            rows = opened.read_row_group(number, columns=["u", self.column])
            lists = rows[self.column].combine_chunks()
            lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
            offsets = lists.offsets.to_numpy().astype(np.int64)
            yield rows["u"].to_numpy(), offsets - offsets[0], lists.flatten().to_numpy()

    def block(self, run: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """A run's lists: ``flat[start[u - low] : start[u - low + 1]]`` of node ``u``."""
        low, high = self.bounds(run)
        degree, flat, used = np.zeros(high - low, np.int64), None, 0
        total = sum(g[3] for g in self.groups[run[0] : run[1]])
        for u, offsets, entries in self.read(run):
            flat = _room(total, entries.dtype) if flat is None else flat
            degree[u - low] = np.diff(offsets)
            flat[used : used + len(entries)] = entries
            used += len(entries)
        return np.concatenate((np.zeros(1, np.int64), np.cumsum(degree))), np.zeros(0, np.int32) if flat is None else flat

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """All lists; a worker keeps those that it read last."""
        if self.files != _last.get("files"):
            _last.clear()
            _last.update(files=self.files, lists=self.block((0, len(self.groups))) if self.groups else (np.zeros(1, np.int64), np.zeros(0, np.int32)))
        return _last["lists"]


_last: dict = {}


def _room(entries: int, dtype: np.dtype) -> np.ndarray:
    """Room for entries: beyond ``IN_MEMORY``, mapped from a file without a name, which goes with it."""
    if entries <= IN_MEMORY:
        return np.empty(entries, dtype)
    return np.memmap(tempfile.TemporaryFile(), dtype, "w+", shape=entries)


def spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all entries between starts and ends, one span after the other; where each begins, and lengths."""
    size = end - start
    begin = np.cumsum(size) - size
    return np.repeat(start - begin, size) + np.arange(size.sum()), begin, size


def cut(size: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of things of so many entries each: at most ``most`` in a run, but for single ones."""
    if not len(size):
        return
    total = np.cumsum(size)
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        yield slice(i, j)
        i = j


def stored(adj: DataFrame) -> Lists | None:
    """``adj(u, v)`` as lists, ids dense, ascending, kept for the session; None where Python can't open the shared folder."""
    most = adj.agg(F.max("u").alias("m")).first().m
    kind = "int" if (most or 0) < 1 << 31 else "long"
    rows = adj.select(F.col("u").cast("long"), F.col("v").cast(kind)).repartitionByRange("u")
    return written(rows.groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("vs")), "vs", 0 if most is None else most + 1, keep=True)


def written(rows: DataFrame, column: str, nodes: int, keep: bool = False) -> Lists | None:
    """``rows(u, column)``, whose partitions are ranges of nodes, stored in the order of nodes."""
    spark = rows.sparkSession
    held = Stored(spark, f"{shared_dir(spark)}/motifloom-lists-{uuid.uuid4().hex}")
    held = held.keep() if keep else held
    with short_lived_shuffles(spark):
        rows.sortWithinPartitions("u").write.option("parquet.block.size", GROUP_BYTES).parquet(held.path)
    files = sorted(held.read().inputFiles())
    try:
        metas = [pq.ParquetFile(where.open_input_file(path)).metadata for where, path in map(fs.FileSystem.from_uri, files)]
    except (OSError, ValueError):
        held.drop()
        return None
    groups = []
    for i, meta in enumerate(metas):
        for j in range(meta.num_row_groups):
            columns = [meta.row_group(j).column(c) for c in range(meta.num_columns)]
            by_name = {c.path_in_schema.split(".")[0]: c for c in columns}
            groups.append((i, j, by_name["u"].statistics.min, by_name[column].num_values))
    return Lists(files, sorted(groups, key=lambda g: g[2]), nodes, column)
