"""Benchmark decontamination with one Aho-Corasick automaton.

Test items become phrases of ``window`` consecutive normalised words (a
shorter item is one phrase). The automaton of all phrases runs once over each
document's normalised text; what it finds is mapped back to words and to
character offsets of the original.

Normalisation works on UTF-8 bytes and keeps their number: A-Z are lowered,
0-9, a-z and all non-ASCII bytes belong to words, the rest separates.

Nulls: a null text has no words; items without an id mark words but are never
listed. Repeated items count once, repeated documents are rows of their own.

The automaton works on word numbers and lies in arrays, 26 bytes a state, with
one state at most for each word of each phrase. It is built on the driver from
at most ``STATES`` such words, its size is checked, and it is broadcast; each
Python worker unpacks it once. A larger benchmark is handled in blocks of items,
one pass over the rows for each, with the rows stored in between, so that one
automaton at a time is in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.llm.kernels import as_bytes, small_batches
from motifloom.session import let_workers_import, store

#: Most words of phrases that one automaton is built from, and most bytes of it that are broadcast.
STATES, MACHINE_BYTES = 12_000_000, 512 << 20

#: Words of a text that are scanned in one go, beside others.
PIECE = 256

_KEPT = {*range(48, 58), *range(97, 123), *range(128, 256)}
_NORMAL = bytes(c if c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class Machine:
    """The automaton over the phrases of ``(item, text)`` rows.

    States are numbered level by level, state 0 is the root. ``keys`` holds the
    edges ``state << 32 | word`` in ascending order, and edge ``i`` leads to state
    ``i + 1``. ``longest`` is the length of the longest phrase that ends at a
    state; ``link`` the next state, by failing, at which a phrase ends.
    """

    def __init__(self, rows: list[tuple[int | None, str | None]], window: int):
        self.window, self.number = window, {}
        names, ids, first = [], [], [0]
        for item, text in rows:
            names.append(item)
            ids += [self.number.setdefault(w, len(self.number)) for w in normal_words(as_bytes(text))]
            first.append(len(ids))
        word, n = np.array(ids, np.int64), np.diff(first)
        size = np.minimum(n, window)
        count = np.where(n > 0, n - size + 1, 0)
        start = np.repeat(np.array(first[:-1]) - (np.cumsum(count) - count), count) + np.arange(count.sum())
        length = np.repeat(size, count)
        self.keys, self.fail = np.empty(0, np.int64), np.zeros(1, np.int32)
        state, levels = np.zeros(len(start), np.int64), []
        for depth in range(int(length.max(initial=0))):
            open_ = np.flatnonzero(length > depth)
            new, back = np.unique(state[open_] << 32 | word[start[open_] + depth], return_inverse=True)
            fails = self.step(self.fail[new >> 32], new & 0xFFFFFFFF) if depth else np.zeros(len(new), np.int64)
            levels.append(slice(len(self.fail), len(self.fail) + len(new)))
            state[open_] = len(self.fail) + back
            self.keys, self.fail = np.concatenate((self.keys, new)), np.concatenate((self.fail, fails.astype(np.int32)))
        self.longest, self.link = np.zeros(len(self.fail), np.int16), np.zeros(len(self.fail), np.int32)
        self.longest[state] = length
        own = self.longest > 0
        for level in levels:
            fails = self.fail[level]
            self.link[level] = np.where(own[fails], fails, self.link[fails])
            self.longest[level] = np.maximum(self.longest[level], self.longest[fails])
        named = np.array([i is not None for i in names], bool)
        of = np.array([0 if i is None else i for i in names], np.int64)
        owner = np.repeat(np.arange(len(names)), count)
        pairs = np.unique(np.stack((state, of[owner]))[:, named[owner]], axis=1) if len(owner) else np.zeros((2, 0), np.int64)
        self.out_state, self.out_item = pairs

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.fail, self.longest, self.link, self.out_state, self.out_item)) + sum(map(len, self.number)) + 120 * len(self.number)

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The state after ``word`` in each ``state``, failing until an edge fits or the root is left with none."""
        out, now = np.zeros(len(state), np.int64), state.astype(np.int64)
        open_ = np.flatnonzero(word >= 0) if len(self.keys) else np.empty(0, np.int64)
        while len(open_):
            key = now[open_] << 32 | word[open_]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            fits = self.keys[at] == key
            out[open_[fits]] = at[fits] + 1
            open_ = open_[~fits & (now[open_] > 0)]
            now[open_] = self.fail[now[open_]]
        return out

    def run(self, word: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The state behind each word; text ``i`` has the words ``first[i]:first[i + 1]``.

        All pieces of all texts go on side by side. No state is deeper than a
        phrase, so a piece that begins ``window - 1`` words early is in the right
        state where it counts.
        """
        pieces = -(-np.diff(first) // PIECE)
        text_first, text_end = np.repeat(first[:-1], pieces), np.repeat(first[1:], pieces)
        begin = text_first + PIECE * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        at, end = np.maximum(begin - self.window + 1, text_first), np.minimum(begin + PIECE, text_end)
        state, out = np.zeros(len(begin), np.int64), np.zeros(len(word), np.int32)
        live = np.arange(len(begin))
        while len(live):
            now = self.step(state[live], word[at[live]])
            state[live] = now
            counts = at[live] >= begin[live]
            out[at[live[counts]]] = now[counts]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out

    def scan(self, texts: list[list[bytes]]) -> tuple[np.ndarray, list[set]]:
        """A flag for each word inside a phrase, all texts in one array, and the items of each text."""
        get = self.number.get
        word = np.array([get(w, -1) for words in texts for w in words], np.int64)
        first = np.concatenate(([0], np.cumsum([len(words) for words in texts], dtype=np.int64)))
        state = self.run(word, first)
        found: list[set] = [set() for _ in texts]
        ends = np.flatnonzero(self.longest[state])
        change = np.zeros(len(word) + 1, np.int64)
        np.add.at(change, ends - self.longest[state[ends]] + 1, 1)
        np.add.at(change, ends + 1, -1)
        owner, at = np.searchsorted(first, ends, "right") - 1, state[ends].astype(np.int64)
        while len(at):
            owner, at = np.unique(np.stack((owner, at)), axis=1)
            low, high = np.searchsorted(self.out_state, at), np.searchsorted(self.out_state, at, "right")
            for i, a, b in zip(owner[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                found[i].update(self.out_item[a:b].tolist())
            at = self.link[at].astype(np.int64)
            owner, at = owner[at > 0], at[at > 0]
        return np.cumsum(change[:-1]) > 0, found


def char_spans(text: bytes, hit: np.ndarray) -> tuple[list[int], list[int]]:
    """Runs of hit words as code point offsets ``[begin, end)`` of the original text."""
    inside = np.frombuffer(text.translate(_NORMAL), np.uint8) != 32
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    runs = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
    first, last = np.flatnonzero(runs == 1), np.flatnonzero(runs == -1) - 1
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return chars[begin[first]].tolist(), chars[end[last]].tolist()


_STATE = "n_words long, hits binary, items array<long>, n_hit long, begins array<long>, ends array<long>"


def _scan(machine: Broadcast, n_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, n_docs):
            rows = {n: [] for n in ("n_words", "hits", "items", "n_hit", "begins", "ends")}
            raws = [as_bytes(t) for t in batch.column(n_docs).to_pylist()]
            texts = [normal_words(raw) for raw in raws]
            flags, found = machine.value.scan(texts)
            befores = zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True)
            at = 0
            for raw, words, items, (packed, known) in zip(raws, texts, found, befores, strict=True):
                hit, at = flags[at : at + len(words)], at + len(words)
                if packed is not None:
                    hit = hit | np.unpackbits(np.frombuffer(packed, np.uint8), count=len(words)).astype(bool)
                n_hit = int(hit.sum())
                begins, ends = char_spans(raw, hit) if n_hit else ([], [])
                rows["n_words"].append(len(words))
                rows["hits"].append(np.packbits(hit).tobytes() if n_hit else None)
                rows["items"].append(sorted(items | set(known or ())))
                rows["n_hit"].append(n_hit)
                rows["begins"].append(begins)
                rows["ends"].append(ends)
            long, many = pa.int64(), pa.list_(pa.int64())
            kinds = {"n_words": long, "hits": pa.binary(), "items": many, "n_hit": long, "begins": many, "ends": many}
            kept = [batch.column(i) for i in range(n_docs + 1)]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(rows[n], k) for n, k in kinds.items()]], [*batch.schema.names[: n_docs + 1], *kinds])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` (sorted ids) and ``spans`` of the original text.

    ``docs`` keeps all its columns but those named here.
    """
    let_workers_import(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # Words of phrases: each word of an item is in ``window`` of them at most.
    words = F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    blocks = -(-(items.agg(F.sum(words)).first()[0] or 0) * window // STATES) or 1
    names = [c for c in docs.columns if c not in ("n_words", "n_hit", "items", "spans", "hits", "begins", "ends", "_text")]
    rows = docs.select(*names, F.col(text_col).cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    empty = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in _STATE.split(", ")}
    rows = rows.withColumns(empty)
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block) if blocks > 1 else items
        machine = Machine([tuple(r) for r in mine.collect()], window)
        if machine.nbytes > MACHINE_BYTES:
            raise ValueError(f"a block of test items makes an automaton of {machine.nbytes} bytes; an item may be too long")
        rows = rows.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(machine), len(names)), f"{kinds}, {_STATE}")
        rows = store(rows, "scanned").read() if block + 1 < blocks else rows
    spans = F.transform(F.arrays_zip("begins", "ends"), lambda z: F.struct(z["begins"].alias("begin"), z["ends"].alias("end")))
    return rows.select(*names, "n_words", "n_hit", "items", spans.alias("spans"))
