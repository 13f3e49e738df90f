"""Near copies: groups of texts whose sets of shingles have a Jaccard similarity of ``similarity`` or more.

Candidates share one of ``bands`` keys, each made of ``rows`` minima of the
set's hashes, and have SimHash fingerprints within ``radius``. A pair at
similarity 0.8 shares no key once in 3 * 10^7 pairs ((1 - 0.8^3)^24), and 45 of
128 bits lie over four standard deviations from the distance expected of it, in
sets of a few shingles too. Candidate links only decide which texts are
compared: inside each group of texts that they connect, the sets themselves are
compared, and only pairs with the similarity are linked.

Equal sets are one node. A group over ``group_rows`` is dealt into chunks by a
hash, ``turns`` times anew: the classes linked in one turn's chunks meet in the
next one's, so a group of true copies becomes one class while each set is
shipped once a turn, whatever the group's size. Where a group still has several
classes, all texts of the keys that two classes share are compared, in pairs of
chunks if a key has more than ``group_rows`` of them; so no pair that shares a
key is lost. A text of any length is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.llm.kernels import as_bytes, chunks, give_back, mix, signed, small_batches, stars
from motifloom.llm.simhash import SimHash, bucket_links, fingerprint_hashes, shingle_hashes
from motifloom.llm.skew import cells
from motifloom.operators.components import components
from motifloom.session import Stored, let_workers_import, scratch, store


@dataclass(frozen=True)
class Copies:
    similarity: float = 0.8
    shingle: int = 5
    radius: int = 45
    bands: int = 24
    rows: int = 3
    bucket_rows: int = 2048
    group_rows: int = 512
    turns: int = 2


def band_keys(hashes: np.ndarray, first: np.ndarray, spec: Copies) -> np.ndarray:
    """``(groups, bands)``: keys from minima over each group's hashes; groups without hashes have zeros."""
    some = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, spec.bands), np.uint64)
    if not len(some):
        return out
    with np.errstate(over="ignore"):
        for band in range(spec.bands):
            key = np.full(len(some), band, np.uint64)
            for row in range(spec.rows):
                turn = mix(np.array([spec.rows * band + row + 1], np.uint64))
                key = mix(key + np.minimum.reduceat(mix(hashes ^ turn), first[some]))
            out[some, band] = key
    return out


def _marks(spec: Copies):
    """Arrow function (doc_id, text) -> (doc_id, set digest, fingerprint, band keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            texts = [as_bytes(t) for t in batch.column(1).to_pylist()]
            for a, b in chunks(map(len, texts)):
                hashes, first = shingle_hashes(texts[a:b], spec.shingle)
                cols = []
                for salt in (1, 2):
                    with np.errstate(over="ignore"):
                        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ mix(np.array([salt << 32], np.uint64))), dtype=np.uint64)))
                        cols.append(sums[first[1:]] - sums[first[:-1]])
                cols += fingerprint_hashes(hashes, first, 128)
                keys = signed(band_keys(hashes, first, spec).ravel())
                offsets = pa.array(np.arange(b - a + 1, dtype=np.int32) * spec.bands)
                listed = pa.ListArray.from_arrays(offsets, pa.array(keys))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(signed(c)) for c in cols], listed], ["doc_id", "s0", "s1", "f0", "f1", "keys"])

    return run


def _sets(spec: Copies):
    """Arrow function (node, text) -> (node, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            texts = [as_bytes(t) for t in batch.column(1).to_pylist()]
            for a, b in chunks(map(len, texts)):
                hashes, first = shingle_hashes(texts[a:b], spec.shingle)
                sets = pa.array([hashes[x:y].tobytes() for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), sets], ["node", "set"])

    return run


def set_links(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links that span the same groups as all pairs of ``sets`` with at least that Jaccard similarity."""
    size = np.array([len(s) for s in sets])
    first = np.concatenate(([0], np.cumsum(size)))
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mine = np.zeros(len(values), bool)
    left: list[int] = []
    right: list[int] = []
    rest = np.arange(len(sets))
    while len(rest) > 1:
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            i = todo.pop()
            own = ids[first[i] : first[i + 1]]
            mine[own] = True
            # Counted from the first set not yet reached: earlier ones are settled.
            begin = first[rest[0]]
            sums = np.concatenate(([0], np.cumsum(mine[ids[begin:]])))
            mine[own] = False
            shared = sums[first[rest + 1] - begin] - sums[first[rest] - begin]
            hit = shared / np.maximum(size[i] + size[rest] - shared, 1) >= similarity
            found = rest[hit].tolist()
            left += [i] * len(found)
            right += found
            todo += found
            rest = rest[~hit]
    return left, right


def _set_links(spec: Copies):
    """Arrow function over rows (key, cell, node, set) sorted by key and cell: links of each run, from the nodes of a class to its least."""

    def emit(nodes: list[int], sets: list[bytes]) -> pa.RecordBatch:
        i, j = set_links([np.frombuffer(s, np.uint64) for s in sets], spec.similarity) if len(sets) > 1 else ([], [])
        at = np.array(nodes, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*[at[np.array(x, np.int64)] for x in (i, j)])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets = None, [], []
        try:
            for batch in batches:
                for key, cell, node, one in zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True):
                    if (key, cell) != now:
                        if len(nodes) > 1:
                            yield emit(nodes, sets)
                        now, nodes, sets = (key, cell), [], []
                    nodes.append(node)
                    sets.append(one)
            if len(nodes) > 1:
                yield emit(nodes, sets)
        finally:
            give_back()

    return run


def stored_sets(rows: DataFrame, nodes: DataFrame, spec: Copies) -> DataFrame:
    """``(node, set)`` of the texts of ``rows(doc_id, text)`` that ``nodes(node)`` names: all texts are dealt out once, later turns read their sets."""
    # Such lists grow with the corpus, so they are joined by a shuffle at every size.
    found = rows.join(nodes.select(F.col("node").alias("doc_id")).hint("merge"), "doc_id").select("doc_id", "text")
    return store(found.mapInArrow(_sets(spec), "node long, set binary"), "copy-sets").read()


def compared(sets: DataFrame, dealt: DataFrame, spec: Copies) -> Stored:
    """Links ``(u, v)`` that span the same classes as those with the similarity between ``sets(node, set)`` that meet in a cell of ``dealt(key, cell, node)``."""
    cells_ = dealt.select("key", F.col("cell").cast("long").alias("cell"), "node").hint("merge")
    met = sets.join(cells_, "node").select("key", "cell", "node", "set").repartition("key", "cell")
    return store(met.sortWithinPartitions("key", "cell").mapInArrow(_set_links(spec), "u long, v long"), "copy-links")


def verified_links(sets: DataFrame, groups: DataFrame, keyed: DataFrame, spec: Copies) -> DataFrame:
    """Links ``(u, v)`` that span the same classes as all with the similarity inside ``groups(node, component)``.

    ``sets(node, set)`` has the sets, ``keyed(key, node)`` the keys that similar ones share.
    """
    sizes = groups.groupBy("component").agg(F.count("*").alias("rows"))
    large = sizes.where(F.col("rows") > spec.group_rows).select("component", F.ceil(F.col("rows") * 2 / spec.group_rows).alias("parts"))
    large = store(large, "large-groups").read()
    small = groups.join(large.hint("merge"), "component", "left_anti")
    links = compared(sets, small.select(F.col("component").alias("key"), F.lit(0).alias("cell"), "node"), spec).read()
    apart = groups.join(large.hint("merge"), "component")
    for turn in range(spec.turns):
        if apart.isEmpty():
            return links
        cell = F.pmod(F.xxhash64(F.lit(turn), "node"), "parts")
        links = links.union(compared(sets, apart.select(F.col("component").alias("key"), cell.alias("cell"), "node"), spec).read())
        found = apart.drop("class").join(components(links).withColumnRenamed("component", "class"), "node", "left")
        found = store(found.select("component", "node", "parts", F.coalesce("class", "node").alias("class")), "copy-classes").read()
        several = found.groupBy("component").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a < b")
        apart = store(found.join(several.select("component").hint("merge"), "component"), "groups-apart").read()
    if apart.isEmpty():
        return links
    shared = store(keyed.select("key", "node").join(apart.select("node", "class").hint("merge"), "node"), "keys-apart").read()
    several = shared.groupBy("key").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a < b")
    shared = store(shared.join(several.select("key").hint("merge"), "key").select("key", "node"), "keys-shared").read()
    return links.union(compared(sets, cells(shared, spec.group_rows, "node"), spec).read())


def near_copies(docs: DataFrame, spec: Copies | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, component_id)``: a row for each row of ``docs``.

    ``component_id`` is the smallest id of the texts reachable over links; texts
    without words link with one another. Null ids take part in no group: their
    ``component_id`` is null. Repeated ids keep one row each, and link all of
    their texts.
    """
    let_workers_import(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with scratch(docs.sparkSession):
        out = store(_near_copies(rows, spec or Copies()), "near-copies").keep()
    return out.read()


def _near_copies(rows: DataFrame, spec: Copies) -> DataFrame:
    schema = "doc_id long, s0 long, s1 long, f0 long, f1 long, keys array<long>"
    marks = store(rows.mapInArrow(_marks(spec), schema), "copy-marks").read()
    named = marks.where("doc_id is not null")
    nodes = named.groupBy("s0", "s1").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("f0", "f1", "keys")])
    nodes = store(nodes, "copy-nodes").read()
    # Texts without words are one node; their keys would only meet by chance.
    keyed = nodes.where("s0 <> 0 or s1 <> 0").select(F.explode("keys").alias("key"), "node", "f0", "f1")
    near = bucket_links(keyed, SimHash(bits=128, radius=spec.radius, bucket_rows=spec.bucket_rows))
    groups = store(components(near.where("u <> v")), "copy-groups").read()
    links = verified_links(stored_sets(rows, groups, spec), groups, keyed, spec)
    # One id may carry several texts: link each of its sets with the least.
    several = named.join(nodes.select("s0", "s1", "node"), ["s0", "s1"]).select("doc_id", "node").distinct()
    least = several.groupBy("doc_id").agg(F.min("node").alias("u"), F.count("*").alias("n")).where("n > 1")
    same_id = several.join(least, "doc_id").where("u <> node").select("u", F.col("node").alias("v"))
    group = components(links.union(same_id)).withColumnRenamed("component", "root")
    rooted = nodes.join(group, "node", "left").select("s0", "s1", F.coalesce("root", "node").alias("component_id"))
    out = marks.join(rooted, ["s0", "s1"], "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
