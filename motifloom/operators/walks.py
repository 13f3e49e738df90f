"""Reproducible random walks.

A walk is one simulation: a Park-Miller stream picks a start among the eligible
nodes and then a neighbour at each step, ``state mod degree`` in ascending
order. The same numbers come out of any engine, so walks can be replayed.

Walks are sequential, so simulations are what runs in parallel: each task moves
its simulations together, as arrays. The sorted neighbour lists lie in the shared
folder as Parquet ordered by node; a task reads the row groups of the nodes that
its walks visit, and holds a bounded number of entries. No adjacency goes through
the driver. Where only Spark can open that folder, all walks move by a join for
each step, whose rows are appended to one table.

A walk on states visits connected sets of k-1 nodes, of which two are neighbours
if they differ in one node. The neighbours of a state are never listed: a draw
picks one of the state's edges out, that is a node of it by degree and a
neighbour y of that, and a node x of the others to leave. The move is made if y
is new, the rest with y is connected, and the node picked is the first of the
rest that y is linked to, so that each neighbour state has one draw in its
favour; else the walk draws again. A draw costs some look-ups of edges, at hubs
as elsewhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.functions import atlas
from motifloom.operators.graph import dense_ids
from motifloom.session import Stored, let_workers_import, shared_dir, short_lived_shuffles, store

#: The Park-Miller generator.
MULTIPLIER, MODULUS = 48271, 2147483647
SKIPPED = 2
STEPS_AT_ONCE = 1024
#: Bytes of a row group of neighbour lists, and entries after which a task forgets the lists that it holds.
GROUP_BYTES, HELD = 1 << 16, 1 << 24


def neighbour_lists(adj: DataFrame) -> tuple[DataFrame, list[tuple[str, int]]]:
    """``(u, d, vs)`` of ``adj(u, v)``, stored in the order of ``u``; and its files with the least ``u`` of each."""
    spark = adj.sparkSession
    held = Stored(spark, f"{shared_dir(spark)}/motifloom-lists-{uuid.uuid4().hex}")
    rows = adj.select(F.col("u").cast("long"), F.col("v").cast("long")).repartitionByRange("u")
    rows = rows.groupBy("u").agg(F.count("*").alias("d"), F.sort_array(F.collect_list("v")).alias("vs")).sortWithinPartitions("u")
    with short_lived_shuffles(spark):
        rows.write.option("parquet.block.size", GROUP_BYTES).parquet(held.path)
    files = held.read().groupBy(F.input_file_name().alias("file")).agg(F.min("u").alias("least")).orderBy("least").collect()
    return held.read(), [(r.file, r.least) for r in files]


def can_open(files: list[tuple[str, int]]) -> bool:
    """Whether Python can read the files, as well as Spark."""
    try:
        return all(fs.FileSystem.from_uri(f)[0].get_file_info(fs.FileSystem.from_uri(f)[1]).is_file for f, _ in files[:1])
    except (OSError, ValueError):
        return False


class _Lists:
    """Neighbour lists read as nodes are asked for: ``flat[start[i] : start[i] + degree[i]]`` for place ``i``."""

    def __init__(self, files: list[tuple[str, int]]):
        self.files, self.least = [f for f, _ in files], np.array([n for _, n in files])
        self.opened: dict[int, tuple[pq.ParquetFile, np.ndarray]] = {}
        self._forget()

    def _forget(self) -> None:
        self.place: dict[int, int] = {}
        self.start, self.degree, self.flat = (np.zeros(1 << 10, np.int64) for _ in range(3))
        self.used = 0

    def at(self, nodes: np.ndarray) -> np.ndarray:
        """Places of nodes, good until the next call."""
        if self.used > HELD:
            self._forget()
        asked = nodes.ravel().tolist()
        for n in asked:
            if n not in self.place:
                self._read(n)
        return np.array([self.place[n] for n in asked], np.int64).reshape(nodes.shape)

    def of(self, node: int) -> np.ndarray:
        i = self.at(np.array([node]))[0]
        return self.flat[self.start[i] : self.start[i] + self.degree[i]]

    def _read(self, node: int) -> None:
        """The row group that has the node."""
        i = int(np.searchsorted(self.least, node, "right")) - 1
        if i not in self.opened:
            where, path = fs.FileSystem.from_uri(self.files[i])
            file = pq.ParquetFile(where.open_input_file(path))
            groups = [file.metadata.row_group(g).column(0).statistics.min for g in range(file.num_row_groups)]
            self.opened[i] = file, np.array(groups)
        file, groups = self.opened[i]
        rows = file.read_row_group(int(np.searchsorted(groups, node, "right")) - 1, columns=["u", "vs"])
        lists = pa.concat_arrays(rows["vs"].chunks)
        values, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        n, first = len(lists), len(self.place)
        self.start = self._room(self.start, first, n)
        self.degree = self._room(self.degree, first, n)
        self.flat = self._room(self.flat, self.used, len(values))
        self.start[first : first + n] = self.used + offsets[:-1] - offsets[0]
        self.degree[first : first + n] = np.diff(offsets)
        self.flat[self.used : self.used + len(values)] = values
        self.used += len(values)
        self.place.update(zip(rows["u"].to_numpy().tolist(), range(first, first + n), strict=True))

    @staticmethod
    def _room(held: np.ndarray, used: int, more: int) -> np.ndarray:
        return held if used + more <= len(held) else np.concatenate((held, np.zeros(max(len(held), more), np.int64)))

    def linked(self, places: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Whether nodes are in the lists at places: a search in all at once."""
        low, nodes = np.broadcast_arrays(self.start[places], nodes)
        low, end = low.copy(), self.start[places] + self.degree[places]
        high = np.broadcast_to(end, low.shape).copy()
        while (open_ := low < high).any():
            mid = (low + high) // 2
            less = self.flat[np.minimum(mid, len(self.flat) - 1)] < nodes
            low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
        return (low < end) & (self.flat[np.minimum(low, len(self.flat) - 1)] == nodes)


def walk(adj: DataFrame, nodes: int, sims: int, seed: int = 42, least_degree: int = 1) -> DataFrame:
    """``(sim, step, node)``: ``nodes`` visited nodes for each of ``sims`` walks on ``adj``, ids dense.

    A start is uniform among nodes of ``least_degree`` or more.
    """
    spark = adj.sparkSession
    let_workers_import(spark)
    lists, files = neighbour_lists(adj)
    if not can_open(files):
        return walk_by_joins(adj, nodes, sims, seed, least_degree)
    starts, _ = _starts(lists, sims, seed, least_degree)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near = _Lists(files)
        for batch in batches:
            sim, state, node = (batch[c].to_numpy() for c in ("sim", "state", "node"))
            if not len(sim):
                continue
            trail = [node]
            for step in range(1, nodes + 1):
                if len(trail) == STEPS_AT_ONCE or step == nodes:
                    first = step - len(trail)
                    yield pd.DataFrame(
                        {"sim": np.tile(sim, len(trail)), "step": np.repeat(np.arange(first, step), len(sim)), "node": np.concatenate(trail)}
                    )
                    trail = []
                if step < nodes:
                    state, at = state * MULTIPLIER % MODULUS, near.at(node)
                    node = near.flat[near.start[at] + state % near.degree[at]]
                    trail.append(node)

    return starts.repartition(_tasks(spark, sims)).mapInPandas(run, "sim long, step long, node long")


def _tasks(spark: SparkSession, sims: int) -> int:
    return max(1, min(sims, spark.sparkContext.defaultParallelism))


class Trail:
    """The steps of walks, appended to one table in the shared folder."""

    def __init__(self, spark: SparkSession):
        self.table = Stored(spark, f"{shared_dir(spark)}/motifloom-trail-{uuid.uuid4().hex}")

    def add(self, rows: DataFrame, step: int) -> None:
        self.table_add(rows.withColumn("step", F.lit(step).cast("long")).select("sim", "step", *rows.columns[1:]))

    def table_add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.table.path)


def _eligible(lists: DataFrame, least_degree: int) -> tuple[DataFrame, int]:
    """``(node, place)`` of the nodes that a walk may start from, and their number."""
    starts = lists.where(F.col("d") >= least_degree).select(F.col("u").alias("node"))
    ranked = dense_ids(starts).select("node", F.col("id").alias("place"))
    return ranked, ranked.count()


def _starts(lists: DataFrame, sims: int, seed: int, least_degree: int) -> tuple[DataFrame, int]:
    """``(sim, state, node)``, and the number of nodes that a walk may start from."""
    ranked, n = _eligible(lists, least_degree)
    if sims and not n:
        raise ValueError(f"no node of degree {least_degree} or more to start from")
    state = F.lit(1) + (F.col("sim") * 7919 + seed) % (MODULUS - 1)
    for _ in range(SKIPPED + 1):
        state = state * MULTIPLIER % MODULUS
    now = lists.sparkSession.range(sims).select(F.col("id").alias("sim")).select("sim", state.alias("state")).withColumn("place", F.col("state") % max(n, 1))
    return store(now.join(ranked, "place").select("sim", "state", "node"), "walk-starts").read(), n


def walk_by_joins(adj: DataFrame, nodes: int, sims: int, seed: int = 42, least_degree: int = 1) -> DataFrame:
    """The same walks, each step a join of all walks with the sorted neighbour arrays."""
    spark = adj.sparkSession
    nbr = store(adj.groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("nbrs"), F.count("*").alias("d")), "nbr").read()
    now = store(_starts(nbr, sims, seed, least_degree)[0], "walk")
    trail = Trail(spark)
    for step in range(nodes):
        rows = now.read()
        trail.add(rows.select("sim", "node"), step)
        if step + 1 < nodes:
            moved = rows.join(nbr, rows.node == nbr.u).withColumn("state", F.col("state") * MULTIPLIER % MODULUS)
            picked = F.element_at("nbrs", (F.col("state") % F.col("d") + 1).cast("int"))
            after = store(moved.select("sim", "state", picked.alias("node")), "walk")
            now.drop()
            now = after
    return trail.table.read()


#: Draws in a row that move nothing, after which a walk is taken to have no neighbour state.
MOST_DRAWS = 1_000_000


class _Shapes:
    """Whether k-1 nodes are connected and which type k nodes are, by the bits of their pairs."""

    def __init__(self, k: int):
        self.inner, self.outer = list(combinations(range(k - 1), 2)), list(combinations(range(k), 2))
        self.connected = np.array([atlas.connected(range(k - 1), self._edges(self.inner, c)) for c in range(1 << len(self.inner))])
        shapes = [self._edges(self.outer, c) for c in range(1 << len(self.outer))]
        self.type = np.array([atlas.type_of(range(k), e) if atlas.connected(range(k), e) else -1 for e in shapes], np.int32)

    @staticmethod
    def _edges(pairs: list, code: int) -> frozenset:
        return frozenset(p for i, p in enumerate(pairs) if code >> i & 1)

    @staticmethod
    def code(links: np.ndarray, pairs: list) -> np.ndarray:
        """The bits of ``links[row, i, j]``."""
        return sum(links[:, i, j].astype(np.int64) << at for at, (i, j) in enumerate(pairs))


class _Sampler:
    """Many walks on states at once, as arrays."""

    def __init__(self, lists: _Lists, k: int):
        self.lists, self.m, self.shapes = lists, k - 1, _Shapes(k)

    def links(self, nodes: np.ndarray) -> np.ndarray:
        """Which nodes of each set are linked."""
        return self.lists.linked(self.lists.at(nodes)[:, :, None], nodes[:, None, :])

    def start(self, st: int, first: int) -> tuple[int, list[int]]:
        """A set grown from a node by one neighbour of it at a time."""
        nodes = [first]
        while len(nodes) < self.m:
            beside = np.setdiff1d(np.concatenate([self.lists.of(v) for v in nodes]), nodes)
            st = st * MULTIPLIER % MODULUS
            nodes = sorted([*nodes, int(beside[st % len(beside)])])
        return st, nodes

    def draw(self, st: np.ndarray, nodes: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, ...]:
        """One draw of each walk: its stream, which ones move, their sets in order, links and types."""
        m, rows = self.m, np.arange(len(st))
        st = st * MULTIPLIER % MODULUS
        places = self.lists.at(nodes)
        d = self.lists.degree[places]
        upto = d.cumsum(1)
        slot = st % (upto[:, -1] * (m - 1))
        at, leave = slot // (m - 1), slot % (m - 1)
        by = (at[:, None] >= upto).sum(1)
        y = self.lists.flat[self.lists.start[places[rows, by]] + at - (upto - d)[rows, by]]
        leave = leave + (leave >= by)
        near = self.lists.linked(places, y[:, None])
        rest = near & (np.arange(m) != leave[:, None])
        moves = np.flatnonzero(~(nodes == y[:, None]).any(1) & (rest.argmax(1) == by))
        # The set with y in the place of the node that leaves.
        after, new, rows = links[moves], rest[moves], np.arange(len(moves))
        after[rows, leave[moves], :] = new
        after[rows, :, leave[moves]] = new
        fits = self.shapes.connected[self.shapes.code(after, self.shapes.inner)]
        moves, after = moves[fits], after[fits]
        union = np.zeros((len(moves), m + 1, m + 1), bool)
        union[:, :m, :m], union[:, :m, m] = links[moves], near[moves]
        kinds = self.shapes.type[self.shapes.code(union, self.shapes.outer)]
        sets = nodes[moves].copy()
        sets[np.arange(len(moves)), leave[moves]] = y[moves]
        order = sets.argsort(1)
        sets = np.take_along_axis(sets, order, 1)
        after = np.take_along_axis(np.take_along_axis(after, order[:, :, None], 1), order[:, None, :], 2)
        return st, moves, sets, after, kinds


def state_walk(adj: DataFrame, k: int, steps: int, sims: int, seed: int = 42) -> DataFrame:
    """``(sim, step, nodes, type)``: walks on the connected sets of k-1 nodes.

    A walk starts at a node and grows by one neighbour at a time; ``type`` is
    that of the k nodes of the step's state and the one before (null at first).
    """
    spark = adj.sparkSession
    let_workers_import(spark)
    lists, files = neighbour_lists(adj)
    if not can_open(files):
        return state_walk_by_joins(adj, k, steps, sims, seed)
    begun, n = _starts(lists, sims, seed, 1)
    if sims and n < k:
        raise ValueError(f"a walk on states needs {k} nodes")

    def frame(sim, step, nodes, kinds) -> pd.DataFrame:
        return pd.DataFrame({"sim": sim, "step": step, "nodes": list(nodes), "type": pd.array(kinds, "Int32")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walks = _Sampler(_Lists(files), k)
        for batch in batches:
            sim = batch["sim"].to_numpy()
            if not len(sim):
                continue
            starts = [walks.start(int(x), int(first)) for x, first in zip(batch["state"], batch["node"], strict=True)]
            st, nodes = np.array([x for x, _ in starts]), np.array([x for _, x in starts])
            links = walks.links(nodes)
            yield frame(sim, 0, nodes, [None] * len(sim))
            step, idle, done = np.zeros(len(sim), np.int64), np.zeros(len(sim), np.int64), []
            while len(go := np.flatnonzero(step < steps)):
                st[go], moves, sets, after, kinds = walks.draw(st[go], nodes[go], links[go])
                idle[go] += 1
                at = go[moves]
                nodes[at], links[at], idle[at] = sets, after, 0
                step[at] += 1
                done.append((sim[at], step[at], sets, kinds))
                if len(done) >= STEPS_AT_ONCE:
                    yield frame(*map(np.concatenate, zip(*done, strict=True)))
                    done = []
                if idle.max() > MOST_DRAWS:
                    raise ValueError("a walk found no neighbour state")
            if done:
                yield frame(*map(np.concatenate, zip(*done, strict=True)))

    return begun.repartition(_tasks(spark, sims)).mapInPandas(run, "sim long, step long, nodes array<long>, type int")


def _beside(now: DataFrame, adj: DataFrame) -> DataFrame:
    """``now(sim, state, nodes, bits)`` with each node ``v`` next to the set, and the mask ``m`` of places it is adjacent to."""
    near = now.select("*", F.posexplode("nodes").alias("i", "u")).join(adj, "u").where(~F.array_contains("nodes", F.col("v")))
    return near.groupBy("sim", "state", "nodes", "bits", "v").agg(F.bit_or(F.expr("shiftleft(1, i)")).alias("m"))


def _picked(options: DataFrame, columns: list[str]) -> DataFrame:
    """One of the options of each walk, which are in the order of ``columns``; the stream moves on."""
    state = F.col("state") * MULTIPLIER % MODULUS
    every = options.groupBy("sim", "state").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("all")).withColumn("state", state)
    return every.select("sim", "state", F.get("all", (F.col("state") % F.size("all")).cast("int")).alias("o")).select("sim", "state", "o.*")


def state_walk_by_joins(adj: DataFrame, k: int, steps: int, sims: int, seed: int = 42) -> DataFrame:
    """The same walks by joins: in each round all walks that go on draw once."""
    from motifloom.operators.sets import inserted, with_type, without

    nbr = store(adj.groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("vs"), F.count("*").alias("d")), "nbr").read()
    now = store(_starts(nbr, sims, seed, 1)[0].select("sim", "state", F.array("node").alias("nodes"), F.array(F.lit(0)).alias("bits")), "state-walk")
    for _ in range(k - 2):
        grown = inserted(_picked(_beside(now.read(), adj), ["v", "m", "nodes", "bits"]))
        now = store(grown.select("sim", "state", "nodes", "bits"), "state-walk")
    trail = Trail(adj.sparkSession)
    trail.add(now.read().select("sim", "nodes", F.lit(None).cast("int").alias("type")), 0)
    now = store(now.read().withColumn("step", F.lit(0).cast("long")), "state-walk")
    idle = 0
    while now.read().where(F.col("step") < steps).limit(1).count():
        drawn = now.read().withColumn("state", F.col("state") * MULTIPLIER % MODULUS)
        going = drawn.where(F.col("step") < steps)
        each = going.select("sim", F.posexplode("nodes").alias("i", "u")).join(nbr.select("u", "d"), "u")
        degrees = each.groupBy("sim").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "d"))), lambda x: x["d"]).alias("ds"))
        rows = going.join(degrees, "sim").withColumn("slot", F.expr(f"state % (aggregate(ds, 0L, (a, b) -> a + b) * {k - 2})"))
        rows = rows.withColumns({"at": F.expr(f"slot div {k - 2}"), "x": F.expr(f"int(slot % {k - 2})")})
        upto = "transform(ds, (d, i) -> aggregate(slice(ds, 1, i + 1), 0L, (a, b) -> a + b))"
        rows = rows.withColumn("by", F.expr(f"size(filter({upto}, c -> at >= c))"))
        rows = rows.withColumns({"at": F.expr("at - aggregate(slice(ds, 1, by), 0L, (a, b) -> a + b)"), "x": F.expr("x + int(x >= by)"), "u": F.expr("nodes[by]")})
        rows = rows.join(nbr, "u").withColumn("v", F.expr("vs[int(at)]")).drop("u", "vs", "d", "ds", "slot", "at")
        rows = rows.where(~F.array_contains("nodes", F.col("v"))).join(nbr.select(F.col("u").alias("v"), "vs"), "v")
        rows = rows.withColumn("m", F.expr("aggregate(transform(nodes, (n, i) -> case when array_contains(vs, n) then shiftleft(1, i) else 0 end), 0, (a, b) -> a | b)")).drop("vs")
        rows = rows.where("(m & ~shiftleft(1, x) & (shiftleft(1, by) - 1)) = 0")
        rest = without(rows.withColumn("whole", F.struct("nodes", "bits", F.col("m").alias("m"))), "x").withColumn("r", F.col("m"))
        for _ in range(k - 2):
            rest = rest.withColumn("r", F.expr("aggregate(transform(bits, (b, i) -> case when (r & shiftleft(1, i)) <> 0 then b else 0 end), r, (x, y) -> x | y)"))
        moved = inserted(rest.where(F.col("r") == (1 << (k - 2)) - 1))
        union = inserted(moved.select("sim", F.col("whole.nodes").alias("nodes"), F.col("whole.bits").alias("bits"), "v", F.col("whole.m").alias("m")))
        kinds = with_type(union, k, "sim").select("sim", "type")
        moved = store(moved.select("sim", "state", "nodes", "bits", (F.col("step") + 1).alias("step")).join(kinds, "sim"), "state-moves").read()
        trail.table_add(moved.select("sim", "step", "nodes", "type"))
        stay = drawn.join(moved.select("sim"), "sim", "left_anti").select("sim", "state", "nodes", "bits", "step")
        idle = 0 if moved.limit(1).count() else idle + 1
        if idle > MOST_DRAWS:
            raise ValueError("a walk found no neighbour state")
        after = store(moved.select(stay.columns).union(stay), "state-walk")
        now.drop()
        now = after
    return trail.table.read()
