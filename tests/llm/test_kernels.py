import random

import numpy as np
import xxhash

from motifloom.llm import kernels as K
from motifloom.llm import simhash as S
from motifloom.llm import suffixes


def test_xxh64():
    rng = random.Random(1)
    raw = bytes(rng.randrange(256) for _ in range(3000))
    start = np.array([rng.randrange(2800) for _ in range(1500)])
    end = start + np.array([rng.randrange(150) for _ in start])
    got = K.xxh64(np.frombuffer(raw, np.uint8), start, end)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(raw[a:b], 42) for a, b in zip(start, end, strict=True)]


def test_sliding_argmin():
    values = np.random.default_rng(2).integers(0, 2**63, 4000).astype(np.uint64)
    got = K.sliding_argmin(values, 97)
    assert got.tolist() == [i + int(np.argmin(values[i : i + 97])) for i in range(len(got))]
    assert len(K.sliding_argmin(values[:5], 6)) == 0


def test_equal_windows_pick_equal_anchors():
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 2**63, 60).astype(np.uint64)
    a = np.concatenate((rng.integers(0, 2**63, 500).astype(np.uint64), shared, rng.integers(0, 2**63, 77).astype(np.uint64)))
    b = np.concatenate((shared, rng.integers(0, 2**63, 30).astype(np.uint64)))
    both = K.Anchors(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), 50, 15)

    def picks(start):
        i = np.flatnonzero((both.lo <= start) & (start <= both.hi))
        assert len(i) == 1
        return int(both.hash[i[0]]), int(both.pos[i[0]] - start)

    assert [picks(500 + i) for i in range(11)] == [picks(len(a) + i) for i in range(11)]
    assert not any(lo < len(a) <= hi + 49 for lo, hi in zip(both.lo, both.hi, strict=True))


def test_bit_sliced_links():
    rng = random.Random(4)
    for bits, radius in ((64, 4), (128, 20)):
        base = [rng.getrandbits(bits) for _ in range(25)]
        fps = [x ^ sum(1 << rng.randrange(bits) for _ in range(rng.randrange(9))) for x in base for _ in range(10)]
        key = np.sort(np.array([rng.randrange(4) for _ in fps], np.int64))
        words = [np.array([(f >> (64 * w)) & (2**64 - 1) for f in fps], np.uint64) for w in range(bits // 64)]
        found = zip(*S.links(key, words, radius), strict=True)
        pairs = [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if key[i] == key[j] and (fps[i] ^ fps[j]).bit_count() <= radius]
        assert groups(found, len(fps)) == groups(pairs, len(fps))


def groups(pairs, n):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(int(a)), top(int(b))
        up[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def naive_factors(codes):
    n = len(codes)

    def common(i, j):
        k = 0
        while max(i, j) + k < n and codes[i + k] == codes[j + k]:
            k += 1
        return k

    return [max([common(i, j) for j in range(i)], default=0) for i in range(n)], [max([common(i, j) for j in range(i + 1, n)], default=0) for i in range(n)]


def test_longest_factors():
    rng = np.random.default_rng(6)
    for n, kinds in ((60, 2), (80, 3), (1, 1)):
        codes = np.append(rng.integers(0, kinds, n), 9)
        before, after = naive_factors(codes.tolist())
        got = suffixes.longest_factors(codes, 64)
        assert (got[0].tolist(), got[1].tolist()) == (before, after)
        for depth in (1, 2, 3, 5, 8, 13):
            capped = suffixes.longest_factors(codes, depth)
            assert capped[0].tolist() == [min(x, depth) for x in before] and capped[1].tolist() == [min(x, depth) for x in after]
            for least in range(1, depth + 1):
                some = suffixes.longest_factors(codes, depth, least)
                assert [x.tolist() for x in some] == [[min(x, depth) if x >= least else 0 for x in y] for y in (before, after)]


def test_longest_factors_of_awkward_text(monkeypatch):
    """Long runs, and searches that are ended one by one."""
    for rounds in (0, 1, 48):
        monkeypatch.setattr(suffixes, "ROUNDS", rounds)
        for text in (b"a" * 90, b"ab" * 40, b"abcabcabd" * 9, bytes(range(60, 120)) + bytes(range(60, 120)), b"b" + b"a" * 50 + b"b" + b"a" * 50):
            codes = np.append(np.frombuffer(text, np.uint8).astype(np.int64), 256)
            before, after = naive_factors(codes.tolist())
            got = suffixes.longest_factors(codes, 70)
            assert (got[0].tolist(), got[1].tolist()) == ([min(x, 70) for x in before], [min(x, 70) for x in after])


def test_stars():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 300):
        u, v = rng.integers(0, n, (2, n // 2))
        got = dict(zip(*map(np.ndarray.tolist, K.stars(u, v)), strict=True))
        label = groups(zip(u.tolist(), v.tolist(), strict=True), n)
        least = {}
        for i, g in enumerate(label):
            least.setdefault(g, i)
        assert got == {i: least[g] for i, g in enumerate(label) if least[g] != i}
    chain = np.arange(1000)
    node, root = K.stars(chain[1:], chain[:-1])
    assert node.tolist() == list(range(1, 1000)) and not root.any()
