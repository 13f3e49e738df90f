"""Near-duplicate groups by SimHash with bit-sliced distances.

Fingerprints: every shingle's XXH64 votes for each bit. Candidates: a
fingerprint's bits are cut into blocks and each choice of ``match`` blocks is a
bucket key, so any two fingerprints that differ in at most ``blocks - match``
bits share a bucket. Distances: inside a bucket run the fingerprints lie as
vertical bit planes; the distances of all rows to the rows ``t`` places ahead
are added up by carry-save counters 64 at a time, and words of 64 pairs are
abandoned once all of them exceed the radius. Links: spanning links of each
bucket feed connected components.

Only distinct fingerprints are compared, so exact copies cost one row. Buckets
over ``bucket_rows`` are cut into chunks and each pair of chunks is one task's
work, so no bucket is ever in one task and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.llm.kernels import Words, as_bytes, chunks, mix, signed, small_batches, stars, unsigned, xxh64
from motifloom.llm.skew import cells
from motifloom.operators.components import components
from motifloom.session import let_workers_import, scratch, store


#: Rows of whole buckets that are compared in one go: wide steps, and some ten megabytes.
RUN_ROWS = 150_000


@dataclass(frozen=True)
class SimHash:
    """What to compare. ``bits`` is 64 or 128.

    The search is exact for ``radius <= blocks - match``; beyond that it finds
    a pair if some ``match`` blocks agree. ``repeats`` lets a shingle vote each
    time it occurs, not once. The defaults are for near copies on sets of
    five-word shingles: two sets with a Jaccard similarity of 0.8 differ in 19.4
    of 128 bits on average, give or take 4, and share one of fourteen blocks
    nearly always.
    """

    shingle: int = 5
    bits: int = 128
    radius: int = 23
    blocks: int = 14
    match: int = 1
    bucket_rows: int = 2048
    repeats: bool = False

    def masks(self) -> list[list[int]]:
        """For each bucket table, the mask of each 64-bit word of a fingerprint."""
        cuts = [self.bits * i // self.blocks for i in range(self.blocks + 1)]
        block = [sum(1 << b for b in range(cuts[i], cuts[i + 1])) for i in range(self.blocks)]
        whole = [sum(chosen) for chosen in combinations(block, self.match)]
        return [[(m >> (64 * w)) & (2**64 - 1) for w in range(self.bits // 64)] for m in whole]


def votes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of each group's hashes have each bit set: (groups, 64).

    Eight byte-wide counters share a word, over at most 255 hashes each.
    """
    size = np.diff(first)
    groups = len(size)
    pieces = -(-size // 255)
    inside = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cut = np.repeat(first[:-1], pieces) + 255 * inside
    owner = np.repeat(np.arange(groups), pieces)
    out = np.zeros((groups, 64), np.int64)
    if not len(cut):
        return out
    lanes = np.uint64(0x0101010101010101)
    heads = np.flatnonzero(np.diff(owner, prepend=-1))
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & lanes, cut)
        per = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), heads, axis=0)
        out[owner[heads], k::8] = per
    return out


def shingle_hashes(texts: list[bytes], shingle: int, repeats: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's shingles, text ``i``'s at ``first[i]:first[i + 1]``; sorted sets unless ``repeats``."""
    words = Words([t.lower() for t in texts])
    n = np.diff(words.first)
    per = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    first = np.concatenate(([0], np.cumsum(per)))
    at = np.repeat(words.first[:-1] - first[:-1], per) + np.arange(first[-1])
    last = at + np.repeat(np.minimum(n, shingle), per) - 1
    hashes = xxh64(words.buf, words.start[at], words.end[last], 42)
    if not repeats:
        owner = np.repeat(np.arange(len(per)), per)
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.flatnonzero(np.diff(hashes, prepend=0).astype(bool) | (np.diff(owner, prepend=-1) != 0))
        hashes, per = hashes[new], np.bincount(owner[new], minlength=len(per))
        first = np.concatenate(([0], np.cumsum(per)))
    return hashes, first


def fingerprint_texts(texts: list[bytes], spec: SimHash) -> list[np.ndarray]:
    """The fingerprint of each text, as one array of 64-bit words per word position."""
    return fingerprint_hashes(*shingle_hashes(texts, spec.shingle, spec.repeats), spec.bits)


def fingerprint_hashes(hashes: np.ndarray, first: np.ndarray, bits: int) -> list[np.ndarray]:
    """The fingerprint of each group of hashes."""
    per = np.diff(first)
    out = []
    for w in range(bits // 64):
        over = votes(mix(hashes) if w else hashes, first) * 2 > per[:, None]
        out.append(np.packbits(over, axis=1, bitorder="little").view("<u8").ravel())
    return out


def fingerprints(docs: DataFrame, spec: SimHash, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, f0[, f1])``: a row for each row of ``docs``.

    A null or blank text has fingerprint zero. Null ids are kept.
    """
    names = [f"f{w}" for w in range(spec.bits // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            ids, texts = batch.column(0), [as_bytes(t) for t in batch.column(1).to_pylist()]
            parts = [fingerprint_texts(texts[a:b], spec) for a, b in chunks(map(len, texts))]
            cols = [pa.array(signed(np.concatenate([p[w] for p in parts]))) for w in range(len(names))] if parts else [pa.array([], pa.int64()) for _ in names]
            yield pa.RecordBatch.from_arrays([ids, *cols], ["doc_id", *names])

    let_workers_import(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


class Planes:
    """Vertical bit planes of fingerprints: bit ``i`` of ``plane[b]`` is row ``i``'s bit ``b``."""

    def __init__(self, words: list[np.ndarray]):
        self.rows = len(words[0])
        self.size = -(-self.rows // 64)
        parts = []
        for w in words:
            padded = np.zeros(64 * self.size, np.uint64)
            padded[: self.rows] = w
            bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            parts.append(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8"))
        self.plane = np.concatenate(parts)
        self.plane = np.concatenate((self.plane, np.zeros((len(self.plane), self.size + 2), np.uint64)), axis=1)

    def within(self, t: int, radius: int, live: np.ndarray) -> np.ndarray:
        """Of rows ``i`` in the ``live`` words (index, wanted bits), those with distance(i, i + t) <= radius.

        Returns a bit mask for each live word. Two planes at a time enter the
        carry-save counters; a word whose wanted pairs have all overflowed the
        radius is dropped after each sixteen planes.
        """
        where, want = live[0].astype(np.int64), live[1].copy()
        out = np.zeros(len(where), np.uint64)
        slot = np.arange(len(where))
        q, s = divmod(t, 64)
        depth = max(1, int(radius).bit_length())
        count = np.zeros((depth, len(where)), np.uint64)
        over = np.zeros(len(where), np.uint64)

        def difference(b: int) -> np.ndarray:
            p = self.plane[b]
            ahead = p[where + q]
            if s:
                ahead = (ahead >> np.uint64(s)) | (p[where + q + 1] << np.uint64(64 - s))
            return p[where] ^ ahead

        for b in range(0, len(self.plane), 2):
            x, y = difference(b), difference(b + 1)
            half = count[0] ^ x
            carry = (count[0] & x) | (half & y)
            count[0] = half ^ y
            for k in range(1, depth):
                carry, count[k] = count[k] & carry, count[k] ^ carry
            over |= carry
            if b % 16 == 14 or b + 2 == len(self.plane):
                bad = over | _greater(count, radius)
                if b + 2 == len(self.plane):
                    out[slot] = want & ~bad
                else:
                    keep = (want & ~bad) != 0
                    if not keep.all():
                        where, want, slot = where[keep], want[keep], slot[keep]
                        count, over = count[:, keep], over[keep]
                        if not len(where):
                            break
        return out


def _greater(count: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter exceeds ``radius``."""
    more = np.zeros(count.shape[1], np.uint64)
    same = ~more
    for k in range(len(count) - 1, -1, -1):
        if radius >> k & 1:
            same &= count[k]
        else:
            more |= same & count[k]
            same &= ~count[k]
    return more


def links(key: np.ndarray, words: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links ``(i, j)`` between rows of equal ``key`` within ``radius``.

    Rows are sorted by key. Rows already linked are not asked about again, so a
    tight bucket of n rows needs few rounds and gives n - 1 links at most.
    """
    n = len(key)
    label = np.arange(n)
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(begin, n))
    longest = int(size.max(initial=0))
    planes = Planes(words) if longest > 1 else None
    left, right = [], []
    stop = np.repeat(begin + size, size)
    single = np.zeros(n, bool)
    rest = np.flatnonzero(np.repeat(size, size) > 1)
    for t in range(1, longest):
        rest = rest[(rest + t < stop[rest]) & ~single[rest]]
        if not len(rest):
            break
        ask = rest[label[rest] != label[rest + t]]
        if not len(ask):
            continue
        heads = np.flatnonzero(np.diff(ask >> 6, prepend=-1))
        where, slot = ask[heads] >> 6, np.repeat(np.arange(len(heads)), np.diff(heads, append=len(ask)))
        want = np.bitwise_or.reduceat(np.uint64(1) << (ask & 63).astype(np.uint64), heads)
        hit = planes.within(t, radius, (where, want))
        found = ask[(hit[slot] >> (ask & 63).astype(np.uint64)) & np.uint64(1) == 1]
        for i in found.tolist():
            a, b = int(label[i]), int(label[i + t])
            if a != b:
                lo, hi = int(np.searchsorted(begin, i, "right")) - 1, 0
                lo, hi = int(begin[lo]), int(stop[i])
                part = label[lo:hi]
                part[part == max(a, b)] = min(a, b)
                left.append(i)
                right.append(i + t)
                if hi - lo > 64 and (part == lo).all():
                    single[lo:hi] = True
    return np.array(left, np.int64), np.array(right, np.int64)


def _bucket_links(spec: SimHash):
    """Arrow function over rows (key, cell, node, f...) sorted by key and cell: links that span the same groups as those within each run."""
    n_words = spec.bits // 64

    def emit(cols: list[np.ndarray]) -> pa.RecordBatch:
        key = cols[0] ^ mix(cols[1].view(np.uint64)).view(np.int64)
        lone = np.concatenate(([True], key[1:] != key[:-1])) & np.concatenate((key[1:] != key[:-1], [True]))
        cols, key = [c[~lone] for c in cols], key[~lone]
        i, j = links(key, [unsigned(c) for c in cols[3:]], spec.radius) if len(key) else (np.empty(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(cols[2][i], cols[2][j])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows, goal = 0, RUN_ROWS
        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3 + n_words)])
            rows += batch.num_rows
            if rows < goal:
                continue
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.argmax((cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])))
            if cut:
                yield emit([c[:cut] for c in cols])
            held, rows = [[c[cut:] for c in cols]], rows - cut
            goal = max(RUN_ROWS, 2 * rows)
        if rows:
            yield emit([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def near_links(nodes: DataFrame, spec: SimHash) -> DataFrame:
    """Links ``(u, v)`` that span the same groups as those between ``nodes(node, f0[, f1])`` within the radius."""
    let_workers_import(nodes.sparkSession)
    names = [f"f{w}" for w in range(spec.bits // 64)]
    tables = [
        F.xxhash64(F.lit(t), *[F.col(n).bitwiseAND(F.lit(int(signed(np.array([m], np.uint64))[0]))) for n, m in zip(names, masks, strict=True) if m])
        for t, masks in enumerate(spec.masks())
    ]
    return bucket_links(nodes.select(F.explode(F.array(*tables)).alias("key"), "node", *names), spec)


def bucket_links(keyed: DataFrame, spec: SimHash) -> DataFrame:
    """Links ``(u, v)``, to a least node each, that span the same groups as those within the radius between rows of ``keyed(key, node, f0[, f1])`` that share a key."""
    names = [f"f{w}" for w in range(spec.bits // 64)]
    apart = cells(keyed, spec.bucket_rows, "node")
    dealt = apart.select("key", F.col("cell").cast("long").alias("cell"), "node", *names).repartition("key", "cell")
    return dealt.sortWithinPartitions("key", "cell").mapInArrow(_bucket_links(spec), "u long, v long")


def near_groups(docs: DataFrame, spec: SimHash, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, f0[, f1], component_id)``: a row for each row of ``docs``.

    ``component_id`` is the smallest id of the texts reachable over links; texts
    without words link with one another. Null ids take part in no group: their
    ``component_id`` is null. Repeated ids keep one row each, and link all of
    their texts. A text of any length is read whole.
    """
    with scratch(docs.sparkSession):
        out = store(_near_groups(fingerprints(docs, spec, id_col, text_col), spec), "near-groups").keep()
    return out.read()


def _near_groups(prints: DataFrame, spec: SimHash) -> DataFrame:
    names = [f"f{w}" for w in range(spec.bits // 64)]
    marks = store(prints, "simhash").read()
    nodes = store(marks.where("doc_id is not null").groupBy(*names).agg(F.min("doc_id").alias("node")), "simhash-nodes").read()
    # One id may carry several texts: link each of its fingerprints with the least.
    several = marks.where("doc_id is not null").join(nodes, names).select("doc_id", "node").distinct()
    least = several.groupBy("doc_id").agg(F.min("node").alias("u"), F.count("*").alias("n")).where("n > 1")
    same_id = several.join(least, "doc_id").where("u <> node").select("u", F.col("node").alias("v"))
    group = components(near_links(nodes, spec).union(same_id)).withColumnRenamed("component", "root")
    rooted = nodes.join(group, "node", "left").select(*names, F.coalesce("root", "node").alias("component_id"))
    out = marks.join(rooted, names, "left")
    return out.select("doc_id", *names, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
