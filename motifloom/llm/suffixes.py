"""Substring deduplication with suffix and longest-previous-factor arrays.

Strings of ``length`` bytes that start in two places are repeats. To find them
at scale, texts are cut into contexts that go to one place if they may share a
string: each string picks an anchor in it by content alone (see
``kernels.Anchors``); an anchor with the strings that picked it is a context,
and equal strings are in contexts of equal anchors. Contexts of an anchor that
occurs once hold no repeats and are never shipped; equal contexts are shipped
once, with their number.

A task lays the contexts of its anchors out as one text and builds a suffix
array by prefix doubling. Previous and next smaller positions in suffix order
give each position the longest factor that also starts earlier; larger
positions likewise give the longest one that starts later. An anchor with very
many different contexts, like a line found everywhere, is split by more of the
text around it, see ``search``.

Equal texts are handled as one, and so are equal contexts; both are told by
128-bit hashes alone. Nulls: a null text is empty, null ids come
first in the order of documents. Repeated rows are places of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.llm.kernels import Anchors, as_bytes, chunks, mix, signed, small_batches
from motifloom.llm.skew import digest
from motifloom.session import Stored, let_workers_import, scratch, store

#: Bytes of an anchor, items of one key in one task, and bytes that one suffix array is built over.
GRAM, GROUP_ITEMS, ARRAY_BYTES = 64, 512, 1 << 19

_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def _ranks(key: np.ndarray) -> np.ndarray:
    """Dense ranks of ``key``."""
    order = np.argsort(key)
    out = np.empty(len(key), np.int32)
    out[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0, dtype=np.int32)))
    return out


def prefix_ranks(codes: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(length, ranks)`` of the strings at all places, for lengths 1, 2, 4, ... and ``depth``.

    Codes are below 65536 and the last is unlike all others. Short lengths are
    packed and ranked in one step; the end repeats the last code.
    """
    n = len(codes)
    key = np.zeros(n, np.int64)
    start = min(depth, 3)  # three codes of 16 bits stay positive
    for i in range(start):
        key = key << 16 | codes[np.minimum(np.arange(n) + i, n - 1)]
    rank, k = _ranks(key), start
    yield k, rank
    while k < depth:
        step = min(k, depth - k)
        key, past = rank.astype(np.int64) << 32, max(n - step, 0)
        key[:past] |= rank[step:]
        key[past:] |= rank[-1]
        rank, k = _ranks(key), k + step
        yield k, rank


def suffix_order(rank: np.ndarray) -> np.ndarray:
    """Places in the order of their ranks, ties by place."""
    return np.argsort(rank.astype(np.int64) << 32 | np.arange(len(rank)))


def common_prefix(order: np.ndarray, levels: list[tuple[int, np.ndarray]], least: int) -> np.ndarray:
    """For each place in suffix order, the length it shares with the place before it, as far as ranks go; 0 for under ``least``.

    From the longest length down, twice the shortest: each length fits once at most after those above it.
    """
    n = len(order)
    a, b, out = order.copy(), np.concatenate(([n], order[:-1])), np.zeros(n, np.int32)
    enough = [rank for k, rank in levels if k <= least][-1][order]
    open_ = np.flatnonzero(enough[1:] == enough[:-1]) + 1
    for k, rank in [*reversed(levels), levels[0]]:
        same = rank[np.minimum(a[open_], n - 1)] == rank[np.minimum(b[open_], n - 1)]
        more = open_[same]
        out[more] += k
        a[more] += k
        b[more] += k
        if k == levels[-1][0]:  # agree as far as it counts
            open_ = open_[~same]
    out[out < least] = 0
    return out


#: After so many rounds the few searches that are left are ended one by one.
ROUNDS = 48


def nearest_smaller(order: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each index of ``order``, the nearest earlier one with a smaller value (or -1), and the least of ``shared`` from behind it on.

    By pointer jumping: what a pointer jumps over is larger than what it
    serves. A search ends where nothing is shared any more.
    """
    near, least = np.arange(-1, len(order) - 1), shared.copy()
    open_ = np.flatnonzero((near >= 0) & (least > 0))
    for _ in range(ROUNDS):
        open_ = open_[order[near[open_]] > order[open_]]
        if not len(open_):
            break
        over = near[open_]
        least[open_], near[open_] = np.minimum(least[open_], least[over]), near[over]
        open_ = open_[(near[open_] >= 0) & (least[open_] > 0)]
    for i in open_.tolist():
        j, low = int(near[i]), int(least[i])
        while j >= 0 and low and order[j] > order[i]:
            j, low = int(near[j]), min(low, int(least[j]))
        near[i], least[i] = j, low
    least[near < 0] = 0
    return near, least


def longest_factors(codes: np.ndarray, depth: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """At each place, the longest string that also starts earlier, and later (up to ``depth``, and 0 for under ``least``).

    The first is the longest-previous-factor array; the second mirrors it.
    """
    n = len(codes)
    levels = [(1, codes)] + [x for x in prefix_ranks(codes, depth) if x[0] > 1]
    order = suffix_order(levels[-1][1])
    shared = common_prefix(order, levels, least)
    after = np.concatenate(([0], shared[:0:-1])) if n else shared  # the same, read from the other end
    out = []
    for seen in (order, n - 1 - order):  # mirrored places turn "larger" into "smaller"
        _, before = nearest_smaller(seen, shared)
        _, behind = nearest_smaller(seen[::-1], after)
        best = np.zeros(n, np.int32)
        best[order] = np.maximum(before, behind[::-1])
        out.append(best)
    return out[0], out[1]


def repeats(contexts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each context in one joined text, and whether the longest factor from earlier / later places has ``depth`` symbols."""
    size = np.array([len(c) for c in contexts], np.int64)
    first = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    codes = np.empty(int(size.sum()) + len(contexts), np.int64)
    own = np.ones(len(codes), bool)
    own[first + size] = False
    codes[own] = np.frombuffer(b"".join(contexts), np.uint8)
    codes[first + size] = 256 + np.arange(len(contexts))  # a different end for each
    # Shorter factors than an anchor are everywhere and of no use here.
    earlier, later = longest_factors(codes, depth, min(GRAM, depth))
    return first, earlier >= depth, later >= depth


def _anchors(values: bytes, length: int, first: np.ndarray) -> Anchors:
    return Anchors(_BYTE_VALUES[np.frombuffer(values, np.uint8)], first, length, min(GRAM, length))


def _first(texts: list[bytes]) -> np.ndarray:
    return np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


def _anchor_rows(length: int):
    """Arrow function (d0, d1, doc_id, text) -> (d0, d1, doc_id, anchors): each anchor, twice if it recurs in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 3):
            texts = [as_bytes(t) for t in batch.column(3).to_pylist()]
            lists = []
            for a, b in chunks(map(len, texts)):
                found = _anchors(b"".join(texts[a:b]), length, _first(texts[a:b]))
                cut = np.searchsorted(found.owner, np.arange(1, b - a))
                for some in np.split(signed(found.hash), cut):
                    once, n = np.unique(some, return_counts=True)
                    lists.append(np.concatenate((once, once[n > 1])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lists, pa.list_(pa.int64()))], ["d0", "d1", "doc_id", "anchors"])

    return run


_CONTEXT = "c0 long, c1 long, anchor long, d0 long, d1 long, doc_id long, at array<long>, strings long, mark long, context binary"


def _context_rows(length: int):
    """Arrow function (d0, d1, doc_id, text, anchors) -> contexts of each text, with all places ``at`` there.

    The bytes are sent only where a slice of texts has them first.
    """
    names = [x.split()[0] for x in _CONTEXT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 3):
            keys = [batch.column(c).to_pylist() for c in range(3)]
            texts, wanted = [as_bytes(t) for t in batch.column(3).to_pylist()], batch.column(4)
            for a, b in chunks(map(len, texts)):
                first, sent = _first(texts[a:b]), set()
                found = _anchors(b"".join(texts[a:b]), length, first)
                cut = np.searchsorted(found.owner, np.arange(b - a + 1))
                out: list[list] = [[] for _ in names]
                for i in range(b - a):
                    mine = slice(cut[i], cut[i + 1])
                    hashes = signed(found.hash[mine])
                    take = np.isin(hashes, wanted[a + i].values.to_numpy())
                    lows, highs, marks = ((x[mine][take] - first[i]).tolist() for x in (found.lo, found.hi, found.pos))
                    seen: dict[bytes, list[int]] = {}
                    for lo, hi, mark, anchor in zip(lows, highs, marks, hashes[take].tolist(), strict=True):
                        context = texts[a + i][lo : hi + length]
                        name = xxhash.xxh3_128_digest(context)
                        if name in seen:
                            seen[name].append(lo)
                            continue
                        seen[name] = [lo]
                        c0, c1 = int.from_bytes(name[:8], "big", signed=True), int.from_bytes(name[8:], "big", signed=True)
                        row = (c0, c1, anchor, *[k[a + i] for k in keys], seen[name], hi - lo + 1, mark - lo, None if name in sent else context)
                        sent.add(name)
                        for col, x in zip(out, row, strict=True):
                            col.append(x)
                kinds = [pa.int64()] * 6 + [pa.list_(pa.int64())] + [pa.int64()] * 2 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return run


def _search(length: int):
    """Arrow function over items (key, h0, h1, body), sorted by key and place: runs of repeated string starts."""

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        bodies = [r[3] for r in rows]
        first, before, after = repeats(bodies, length)
        cols: list[list] = [[], [], [], [], []]
        for flags, later in ((before, False), (after, True)):
            # No string starts in the last bytes of a body, so runs end inside it.
            edge = np.diff(np.concatenate(([False], flags, [False])).astype(np.int8))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            owner = np.searchsorted(first, begin, "right") - 1
            for i, b, e in zip(owner.tolist(), (begin - first[owner]).tolist(), (end - first[owner]).tolist(), strict=True):
                for col, x in zip(cols, (rows[i][1], rows[i][2], b, e, later), strict=True):
                    col.append(x)
        kinds = [pa.int64()] * 4 + [pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["h0", "h1", "begin", "end", "later"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, group = 0, None
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True):
                if row[0] != group and size >= ARRAY_BYTES:
                    yield emit(held)
                    held, size = [], 0
                group = row[0]
                held.append(row)
                size += len(row[3])
        if held:
            yield emit(held)

    return run


_ITEM = "key long, h0 long, h1 long, place struct<doc_id:bigint,d0:bigint,d1:bigint,at:bigint>, mark long, strings long, low long, high long, body binary"
_PART = _ITEM + ", g0 long, g1 long, base long"


def _halve(length: int):
    """Arrow function: split items by how far their strings start before the anchor, in two.

    All strings of a half share a core around the anchor that is longer than
    that of the whole; the core is the half's key. Strings that are equal fall
    into the same half with equal cores.
    """
    names = [x.split()[0] for x in ("key long, h0 long, h1 long, place x, mark long, strings long, low long, high long, body x, g0 long, g1 long, base long").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            kind = batch.schema.field("place").type
            for key, h0, h1, place, mark, strings, low, high, body in zip(*[batch.column(c).to_pylist() for c in range(9)], strict=True):
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    begin, end = max(0, mark - b), min(strings - 1, mark - a)
                    if begin > end:
                        continue
                    part = body[begin : end + length]
                    core = body[mark - a : mark - b + length]
                    new = xxhash.xxh64_intdigest(b"%d %d %b" % (key, a, core)) - (1 << 63)
                    name = xxhash.xxh3_128_digest(b"%d %b" % (mark - begin, part))
                    ids = int.from_bytes(name[:8], "big", signed=True), int.from_bytes(name[8:], "big", signed=True)
                    row = (new, *ids, place | {"at": place["at"] + begin}, mark - begin, end - begin + 1, a, b, part, h0, h1, begin)
                    for col, x in zip(out, row, strict=True):
                        col.append(x)
            kinds = [pa.int64()] * 3 + [kind] + [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return run


def search(items: DataFrame, length: int) -> DataFrame:
    """``(h0, h1, begin, end, later)`` for ``items`` of one level: repeated starts, and whether from a later place.

    Items of a key are searched together if they are few. The items of a large
    key are halved, equal halves become one, and the halves are searched under
    their own, rarer keys; at the end all strings of a key are equal.
    """
    found, back = None, None  # back: (h0, h1) of this level to (c0, c1) of the first and an offset
    while True:
        sizes = store(items.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "key-sizes").read()
        cold = items.join(sizes.where(F.col("m") <= GROUP_ITEMS).select("key"), "key")
        dealt = cold.select("key", "h0", "h1", "body", "place").repartition("key").sortWithinPartitions("key", "place", "h0", "h1")
        runs = dealt.select("key", "h0", "h1", "body").mapInArrow(_search(length), "h0 long, h1 long, begin long, end long, later boolean")
        large = sizes.where(F.col("m") > GROUP_ITEMS).select("key")
        more = large.limit(1).count() > 0
        if more:
            parts = store(items.join(large, "key").select(*[x.split()[0] for x in _ITEM.split(", ")]).mapInArrow(_halve(length), _PART), "halves").read()
            alike = parts.groupBy("key", "h0", "h1").agg(
                F.min("place").alias("place"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("mark", "strings", "low", "high", "body")]
            )
            alike = store(alike, "half-kinds").read()
            twice = parts.join(alike.where("n > 1").select("key", "h0", "h1", F.col("place").alias("p")), ["key", "h0", "h1"])
            twice = twice.select(
                F.col("g0").alias("h0"), F.col("g1").alias("h1"), F.col("base").alias("begin"), (F.col("base") + F.col("strings")).alias("end"),
                F.col("place").eqNullSafe(F.col("p")).alias("later"),
            )
            runs = runs.union(twice)
        if back is not None:
            runs = runs.join(back, ["h0", "h1"]).select("c0", "c1", (F.col("begin") + F.col("base")).alias("begin"), (F.col("end") + F.col("base")).alias("end"), "later")
        runs = store(runs.toDF("h0", "h1", "begin", "end", "later"), "runs").read()
        found = runs if found is None else found.union(runs)
        if not more:
            return found
        step = parts.select("h0", "h1", "g0", "g1", "base").distinct()
        if back is None:
            back = step.withColumnsRenamed({"g0": "c0", "g1": "c1"})
        else:
            up = back.withColumnsRenamed({"h0": "g0", "h1": "g1", "base": "before"})
            back = step.join(up, ["g0", "g1"]).select("h0", "h1", "c0", "c1", (F.col("base") + F.col("before")).alias("base")).distinct()
        back = store(back, "half-owners").read()
        items = alike.drop("n")


def keyed(docs: DataFrame) -> DataFrame:
    let_workers_import(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select(*digest(F.col("text")), "doc_id", "text")


def repeated_starts(docs: DataFrame, texts: DataFrame, length: int, keep: str) -> DataFrame:
    """``(d0, d1, begin, end)``: runs of starts of strings to remove, in the text of each digest."""
    anchors = texts.select("d0", "d1", "doc_id", F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    lists = anchors.join(shared, "anchor").groupBy("d0", "d1", "doc_id").agg(F.collect_set("anchor").alias("anchors"))
    lists = store(lists, "anchor-lists").read().withColumnsRenamed({"d0": "e0", "d1": "e1", "doc_id": "e2"})
    rows = keyed(docs)
    rows = rows.join(lists, (rows.d0 == lists.e0) & (rows.d1 == lists.e1) & rows.doc_id.eqNullSafe(lists.e2))
    found = store(rows.select("d0", "d1", "doc_id", "text", "anchors").mapInArrow(_context_rows(length), _CONTEXT), "contexts").read()
    places = found.drop("context", "mark").distinct()
    order = F.struct("doc_id", "d0", "d1", F.col("at")[0].alias("at"))
    contexts = places.groupBy("c0", "c1").agg(F.sum(F.size("at")).alias("n"), F.min(order).alias("place"), F.first("anchor").alias("key"), F.first("strings").alias("strings"))
    contexts = store(contexts, "context-places").read()
    bodies = found.where("context is not null").groupBy("c0", "c1").agg(F.first("context").alias("body"), F.first("mark").alias("mark"))
    # Stored on their own, so that the join of a key found everywhere can be split where it is skewed.
    shared_keys = store(contexts.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "shared-keys").read()
    items = contexts.join(shared_keys, "key").drop("n").join(bodies, ["c0", "c1"]).withColumnsRenamed({"c0": "h0", "c1": "h1"})
    items = items.withColumns({"low": F.lit(0).cast("long"), "high": F.lit(length - min(GRAM, length)).cast("long")})
    items = store(items.select(*[x.split()[0] for x in _ITEM.split(", ")]), "items").read()
    runs = search(items, length).withColumnsRenamed({"h0": "c0", "h1": "c1"})
    copied = contexts.where("n > 1").select("c0", "c1", "place", "strings")
    whole = F.struct(F.lit(0).cast("long").alias("begin"), F.col("strings").alias("end"))
    if keep == "first":
        runs = runs.where("not later")
    each = runs.groupBy("c0", "c1").agg(F.collect_set(F.struct("begin", "end")).alias("runs"))
    both = contexts.select("c0", "c1").join(each, ["c0", "c1"], "left").join(copied, ["c0", "c1"], "left").where("runs is not null or strings is not null")
    hits = places.select("c0", "c1", "d0", "d1", "doc_id", "at").join(both, ["c0", "c1"])
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")

    def at_place(at):
        """Runs at one place of a context: those of the search, or all its strings if it is a copy."""
        copy = F.col("strings").isNotNull()
        if keep == "first":
            copy = copy & ~F.struct("doc_id", "d0", "d1", at.alias("at")).eqNullSafe(F.col("place"))
        mine = F.when(copy, F.array(whole)).otherwise(F.coalesce("runs", none))
        return F.transform(mine, lambda r: F.struct((r["begin"] + at).alias("begin"), (r["end"] + at).alias("end")))

    return hits.select("d0", "d1", F.explode(F.flatten(F.transform("at", at_place))).alias("r")).select("d0", "d1", "r.*")


def _cut(length: int, keep: str, n_docs: int):
    """Arrow function: remove the bytes that runs of string starts cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, n_docs):
            ids = batch.column("doc_id").to_pylist()
            texts, least, copies, runs = (batch.column(n_docs + i).to_pylist() for i in range(4))
            out: list[list] = [[], [], [], []]
            for doc_id, text, first, n, starts in zip(ids, texts, least, copies, runs, strict=True):
                raw = as_bytes(text)
                whole = (n or 0) > 1 and (keep == "none" or doc_id != first) and len(raw) >= length
                kept, at, removed, pieces = [], 0, 0, 0
                merged: list[list[int]] = []
                for begin, end in [(0, len(raw) - length + 1)] if whole else sorted((r["begin"], r["end"]) for r in starts or ()):
                    end += length - 1
                    if merged and begin <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([begin, end])
                for begin, end in merged:
                    kept.append(raw[at:begin])
                    removed, pieces, at = removed + end - begin, pieces + 1, end
                kept.append(raw[at:])
                for col, x in zip(out, (b"".join(kept), len(raw), removed, pieces), strict=True):
                    col.append(x)
            cols = [pa.array(out[0], pa.binary()), *[pa.array(c, pa.int64()) for c in out[1:]]]
            names = [*batch.schema.names[:n_docs], "kept", "n_bytes", "n_removed", "n_spans"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_docs], *cols], names)

    return run


def dedup_substrings(docs: DataFrame, length: int = 400, keep: str = "first") -> DataFrame:
    """``docs(doc_id, text, ...)`` with ``kept`` (bytes), ``n_bytes``, ``n_removed`` and ``n_spans``.

    ``keep="first"`` keeps the first place of each repeated string, by document
    id and position; ``"none"`` removes all its places. Of rows equal in id and
    text one is as good as the other: with "first" they are kept alike.
    """
    if keep not in ("first", "none"):
        raise ValueError("keep is first or none")
    spark = docs.sparkSession
    with scratch(spark):
        plan = _cut_plan(docs, length, keep).keep()
    plan = plan.read().withColumnsRenamed({"d0": "_d0", "d1": "_d1"})
    others = [c for c in docs.columns if c not in ("kept", "n_bytes", "n_removed", "n_spans", "_text", "_least", "_copies", "_runs", "_d0", "_d1")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = digest(text)
    out = docs.select(*others, text.alias("_text"), keys[0].alias("_d0"), keys[1].alias("_d1")).join(plan, ["_d0", "_d1"], "left")
    out = out.select(*others, "_text", "_least", "_copies", "_runs")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[:-4])
    return out.mapInArrow(_cut(length, keep, len(others)), f"{kinds}, kept binary, n_bytes long, n_removed long, n_spans long")


def _cut_plan(docs: DataFrame, length: int, keep: str) -> Stored:
    """``(d0, d1, _least, _copies, _runs)``: each different text with its smallest id, number and runs to cut."""
    rows = keyed(docs).mapInArrow(_anchor_rows(length), "d0 long, d1 long, doc_id long, anchors array<long>")
    texts = rows.groupBy("d0", "d1").agg(F.min(F.struct("doc_id")).alias("least"), F.count("*").alias("copies"), F.first("anchors").alias("anchors"))
    texts = store(texts.select("d0", "d1", F.col("least.doc_id").alias("doc_id"), "copies", "anchors"), "texts")
    starts = repeated_starts(docs, texts.read(), length, keep)
    starts = starts.groupBy("d0", "d1").agg(F.collect_set(F.struct("begin", "end")).alias("_runs"))
    plan = texts.read().select("d0", "d1", F.col("doc_id").alias("_least"), F.col("copies").alias("_copies")).join(starts, ["d0", "d1"], "left")
    return store(plan, "cut-plan")
