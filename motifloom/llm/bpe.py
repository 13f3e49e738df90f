"""Byte-level BPE with segment trees over byte positions.

A piece of text is a row of byte positions. Leaf ``i`` of its tree holds the
rank of the pair that starts at the live token at ``i``, packed with ``i``, so
the root is the leftmost pair of least rank. A merge changes three leaves -
the pair's, its right part's and its left neighbour's - each a walk to the
root.

Pieces of up to ``BATCH_BYTES`` bytes are merged together: their trees are rows
of one array, and a round performs one merge in each of them. Longer pieces
have a tree each. Pieces repeat much, so each worker keeps a bounded memo.

Vocabulary files hold a line ``base64(token) rank`` each.

A null or empty text has no tokens. Each row is encoded by itself, so rows and ids
may repeat, and an empty table gives an empty one. Texts of any length are
encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.llm.kernels import as_bytes, chunks, small_batches
from motifloom.session import let_workers_import

BATCH_BYTES = 64
#: Pieces that a worker's memo holds before it starts anew, and pieces merged in one array.
MEMO, ROWS = 300_000, 8192
_NONE = np.iinfo(np.int32).max


class Vocabulary:
    """Ranks of byte strings, and the rank of each mergeable pair of tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("each single byte needs a rank")
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.values = np.fromiter(pairs.values(), np.int32, len(pairs))[order]
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.width = np.array([len(t) for t in tokens], np.int64)
        self.offset = np.cumsum(self.width) - self.width

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(bytes.strip, lines))})

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def decode(self, ids: np.ndarray) -> bytes:
        width = self.width[ids]
        total = np.cumsum(width)
        if not len(ids):
            return b""
        return self.blob[np.repeat(self.offset[ids] - (total - width), width) + np.arange(total[-1])].tobytes()


def merge_one(piece: bytes, v: Vocabulary) -> list[int]:
    """The tokens of one piece, with one segment tree."""
    n = len(piece)
    ids = v.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
    width = 1 << max(1, (n - 1).bit_length())
    none = (_NONE, 0)
    tree = [none] * (2 * width)
    pairs = v.pairs
    for i in range(n - 1):
        rank = pairs.get(ids[i] << 32 | ids[i + 1])
        if rank is not None:
            tree[width + i] = (rank, i)
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

    def put(i: int, rank: int | None) -> None:
        node = width + i
        tree[node] = none if rank is None else (rank, i)
        node >>= 1
        while node:
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
            node >>= 1

    while tree[1][0] != _NONE:
        rank, i = tree[1]
        j = after[i]
        k, p = after[j], before[i]
        ids[i], after[i], live[j] = rank, k, False
        put(j, None)
        put(i, pairs.get(rank << 32 | ids[k]) if k < n else None)
        if k < n:
            before[k] = i
        if p >= 0:
            put(p, pairs.get(ids[p] << 32 | rank))
    return [t for t, alive in zip(ids, live, strict=True) if alive]


def merge_many(pieces: list[bytes], v: Vocabulary) -> list[np.ndarray]:
    """The tokens of pieces of at most ``BATCH_BYTES`` bytes, one segment tree in each row."""
    rows = len(pieces)
    size = np.array([len(p) for p in pieces], np.int64)
    width = 1 << max(1, int(size.max() - 1).bit_length())
    raw = np.zeros((rows, width), np.uint8)
    raw[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
    ids = v.byte_ids[raw]
    live = np.arange(width) < size[:, None]
    tree = np.full((rows, 2 * width), _NONE, np.int32)
    shift = width.bit_length() - 1

    def packed(rank: np.ndarray, pos: np.ndarray) -> np.ndarray:
        return np.where(rank == _NONE, _NONE, (rank << shift) | pos).astype(np.int32)

    ranks = v.pair_ranks(ids[:, :-1], ids[:, 1:])
    ranks[~live[:, 1:]] = _NONE
    tree[:, width : 2 * width - 1] = packed(ranks, np.arange(width - 1, dtype=np.int32))
    for node in range(width - 1, 0, -1):
        tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
    after = np.tile(np.arange(1, width + 1), (rows, 1))
    before = np.tile(np.arange(-1, width - 1), (rows, 1))
    r = np.arange(rows)

    def put(r: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
        node = width + i
        tree[r, node] = value
        for _ in range(shift):
            node = node >> 1
            tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

    while True:
        r = r[tree[r, 1] != _NONE]
        if not len(r):
            break
        root = tree[r, 1]
        i, rank = (root & (width - 1)).astype(np.int64), root >> shift
        j = after[r, i]
        k, p = after[r, j], before[r, i]
        ids[r, i], after[r, i], live[r, j] = rank, k, False
        put(r, j, np.full(len(r), _NONE, np.int32))
        end = k >= size[r]
        right = np.where(end, _NONE, v.pair_ranks(rank, ids[r, np.where(end, 0, k)]))
        put(r, i, packed(right, i))
        some = ~end
        before[r[some], k[some]] = i[some]
        some = p >= 0
        left = v.pair_ranks(ids[r[some], p[some]], rank[some])
        put(r[some], p[some], packed(left, p[some]))
    counts = live.sum(axis=1)
    return np.split(ids[live], np.cumsum(counts)[:-1])


class Encoder:
    """Texts to token ids. ``memo`` maps a piece to its ids as little-endian bytes."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.v, self.find, self.memo = vocabulary, regex.compile(pattern).findall, {}

    def learn(self, pieces: set[str]) -> None:
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = as_bytes(piece)
            rank = self.v.ranks.get(raw)
            if rank is not None:
                self.memo[piece] = rank.to_bytes(4, "little")
            elif len(raw) > BATCH_BYTES:
                self.memo[piece] = np.array(merge_one(raw, self.v), "<u4").tobytes()
            else:
                groups.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for same in groups.values():
            for a in range(0, len(same), ROWS):
                part = same[a : a + ROWS]
                for (piece, _), ids in zip(part, merge_many([raw for _, raw in part], self.v), strict=True):
                    self.memo[piece] = ids.astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.find(t) for t in texts]
        wanted = set().union(*split)
        if len(self.memo) > MEMO:
            self.memo = {}
        self.learn(wanted - self.memo.keys())
        get = self.memo.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder for a vocabulary file; the file is read once in each worker."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(Vocabulary.load(path), pattern)
    return _encoders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", digests: bool = False) -> DataFrame:
    """``docs`` with ``tokens`` (array of ids) and ``decoded`` (bytes got back from them).

    With ``digests`` there are ``n_tokens``, ``ids_sha256`` and
    ``decoded_sha256`` instead. A null text is empty; ``docs`` keeps all its
    columns but those named here. ``path`` must be readable on the executors.
    """
    let_workers_import(docs.sparkSession)
    added = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} if digests else {"tokens": "array<int>", "decoded": "binary"}
    names = [c for c in docs.columns if c not in {*added, "_text"}]
    rows = docs.select(*names, F.col(text_col).cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        types = [pa.int64(), pa.string(), pa.string()] if digests else [pa.list_(pa.int32()), pa.binary()]
        for batch in small_batches(batches, len(names)):
            texts = [t or "" for t in batch.column(len(names)).to_pylist()]
            for a, b in chunks(map(len, texts)):
                cols: list[list] = [[] for _ in added]
                for ids in e.encode(texts[a:b]):
                    numbers = np.frombuffer(ids, "<u4")
                    back = e.v.decode(numbers)
                    one = (len(numbers), hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()) if digests else (numbers.astype(np.int32), back)
                    for col, x in zip(cols, one, strict=True):
                        col.append(x)
                kept = [batch.column(i).slice(a, b - a) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], [*names, *added])

    return rows.mapInArrow(run, ", ".join(filter(None, [kinds, *[f"{n} {k}" for n, k in added.items()]])))
