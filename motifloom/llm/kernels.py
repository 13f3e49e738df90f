"""Vectorised kernels over many texts at once: words, hashes, sampled anchors.

All work is on UTF-8 bytes in numpy arrays, a bounded chunk of text at a time,
so memory follows the chunk and the longest text, not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19

# The primes of the public XXH64 specification.
P1, P2, P3, P4, P5 = (
    np.uint64(11400714785074694791),
    np.uint64(14029467366897019727),
    np.uint64(1609587929392839161),
    np.uint64(9650029242287828579),
    np.uint64(2870177450012600261),
)


def as_bytes(text: str | None) -> bytes:
    """UTF-8 bytes; null is empty."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def chunks(sizes: Iterable[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of about ``most`` bytes, one item at least."""
    first = total = at = 0
    for at, n in enumerate(sizes, 1):
        total += n
        if total >= most:
            yield first, at
            first, total = at, 0
    if first < at:
        yield first, at


def small_batches(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 * CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices with about ``most`` bytes in a text column, one row at least.

    Workers outlive their tasks, so memory goes back to the system at the end.
    """
    try:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
            for a, b in chunks(sizes.tolist(), most):
                yield batch.slice(a, b - a)
    finally:
        give_back()


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


class Words:
    """The words of several texts, joined by single spaces in one buffer.

    ``start``/``end`` are byte offsets in ``buf``; text ``i`` owns the words
    ``first[i]:first[i + 1]``. Words are runs without ASCII white space.
    """

    def __init__(self, texts: list[bytes]):
        parts = [b" ".join(t.split()) for t in texts]
        counts = [p.count(b" ") + 1 if p else 0 for p in parts]
        self.first = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        joined = b" ".join(p for p in parts if p)
        self.buf = np.frombuffer(joined, np.uint8)
        gaps = np.flatnonzero(self.buf == 32)
        some = [0] if joined else []
        self.start = np.concatenate((np.array(some, np.int64), gaps + 1)).astype(np.int64)
        self.end = np.concatenate((gaps, np.array([len(joined)] if joined else [], np.int64))).astype(np.int64)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _turn(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rot(acc + lane * P2, 31) * P1


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of the byte ranges ``buf[start:end]``, all ranges of one length at a time."""
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    pad = np.concatenate((buf, np.zeros(8, np.uint8)))
    w8 = np.ndarray((len(buf) + 1,), "<u8", pad, strides=(1,))
    w4 = np.ndarray((len(buf) + 1,), "<u4", pad, strides=(1,))
    length = end - start
    order = np.argsort(length, kind="stable")
    bounds = np.flatnonzero(np.diff(length[order])) + 1
    seed64 = np.uint64(seed)
    with np.errstate(over="ignore"):
        for mine in np.split(order, bounds):
            n, s, at = int(length[mine[0]]), start[mine], 0
            if n >= 32:
                v = [np.full(len(s), x, np.uint64) for x in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
                while at + 32 <= n:
                    for lane in range(4):
                        v[lane] = _turn(v[lane], w8[s + (at + 8 * lane)])
                    at += 32
                h = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
                for x in v:
                    h = (h ^ _turn(np.uint64(0), x)) * P1 + P4
            else:
                h = np.full(len(s), seed64 + P5, np.uint64)
            h = h + np.uint64(n)
            while at + 8 <= n:
                h = _rot(h ^ _turn(np.uint64(0), w8[s + at]), 27) * P1 + P4
                at += 8
            if at + 4 <= n:
                h = _rot(h ^ (w4[s + at].astype(np.uint64) * P1), 23) * P2 + P3
                at += 4
            while at < n:
                h = _rot(h ^ (buf[s + at].astype(np.uint64) * P5), 11) * P1
                at += 1
            h ^= h >> np.uint64(33)
            h = h * P2
            h ^= h >> np.uint64(29)
            h = h * P3
            h ^= h >> np.uint64(32)
            out[mine] = h
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words (the splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))


class Rolling:
    """Polynomial hashes modulo 2**64 of any length at any position of ``values``."""

    def __init__(self, values: np.ndarray, which: int = 0):
        base = _BASES[which]
        n = len(values)
        back = np.uint64(pow(int(base), -1, 1 << 64))
        with np.errstate(over="ignore"):
            self.up = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, base, np.uint64))))
            down = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, back, np.uint64))))
            self.sums = np.concatenate(([np.uint64(0)], np.cumsum(values * down[:n], dtype=np.uint64)))

    def at(self, pos: np.ndarray, length) -> np.ndarray:
        """Hash of ``values[pos : pos + length]``; equal content, equal hash, anywhere."""
        with np.errstate(over="ignore"):
            return mix((self.sums[pos + length] - self.sums[pos]) * self.up[pos])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - 1
        if n < length:
            return np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix((self.sums[length:] - self.sums[: n - length + 1]) * self.up[: n - length + 1])


_SLICE_BITS = 20


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the index of its least (then leftmost) one.

    Works in slices of fixed size: the low bits of a value give way to its
    index in the slice, the same bits at each call, so equal windows always
    pick the same offset.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    step, low = 1 << _SLICE_BITS, np.uint64((1 << (_SLICE_BITS + 1)) - 1)
    assert width <= step
    out = np.empty(n, np.int64)
    for at in range(0, n, step):
        some = min(step, n - at)
        part = values[at : at + some + width - 1]
        padded = np.full(-(-len(part) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(part)] = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        blocks = padded.reshape(-1, width)
        before = np.minimum.accumulate(blocks, axis=1).ravel()
        after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        out[at : at + some] = (np.minimum(after[:some], before[width - 1 : width - 1 + some]) & low).astype(np.int64) + at
    return out


class Anchors:
    """Content-defined sampling with a guarantee for windows of ``window`` values.

    Each window picks the least of the hashes of the ``gram``-long strings in
    it, so equal windows pick equal grams at equal offsets. ``pos`` are the
    picked positions, ``lo``/``hi`` the first and last window start that picks
    each, ``hash`` the picked gram's hash. ``first`` holds the texts' bounds;
    windows that cross a text's end are left out.
    """

    def __init__(self, values: np.ndarray, first: np.ndarray, window: int, gram: int):
        grams = Rolling(values).all(gram)
        picked = sliding_argmin(grams, window - gram + 1)
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        if len(picked):
            whole = owner[: len(picked)] == owner[window - 1 : window - 1 + len(picked)]
            starts = np.flatnonzero(whole)
        else:
            starts = np.empty(0, np.int64)
        at = picked[starts]
        new = np.flatnonzero(np.diff(at, prepend=-1)) if len(at) else np.empty(0, np.int64)
        self.pos = at[new]
        self.lo = starts[new]
        self.hi = starts[np.append(new[1:], len(starts)) - 1] if len(new) else self.lo
        self.hash = grams[self.pos] if len(new) else np.empty(0, np.uint64)
        self.owner = owner[self.pos] if len(new) else np.empty(0, np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.int64).view(np.uint64)


def spans(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs ``[begin, end)`` covered by windows of ``width`` at sorted ``starts``."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.flatnonzero(np.diff(starts) > width) + 1
    begin = starts[np.concatenate(([0], cut))]
    end = starts[np.concatenate((cut - 1, [len(starts) - 1]))] + width
    return begin, end


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(node, least)`` that span the same groups as ``(u, v)``: each node but the least of its group once."""
    nodes, ids = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ids[: len(u)], ids[len(u) :]
    label, before = np.arange(len(nodes)), None
    while before is None or (label != before).any():
        before = label.copy()
        least = np.minimum(label[a], label[b])
        for at in (before[a], before[b], a, b):
            np.minimum.at(label, at, least)
        label = label[label]
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]
