"""Line, substring and near-duplicate operators against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
import xxhash
from pyspark.sql import functions as F

from motifloom.llm import copies, lines, queries, simhash, suffixes, windows

from .conftest import prose
from .test_kernels import groups


def corpus():
    """Small documents with copies, edits, shared passages and periodic text."""
    rng = random.Random(7)
    passage = prose(50, 70)
    rows = []
    for i in range(40):
        text = prose(100 + i, rng.randrange(5, 200))
        if i % 5 == 0:
            text = f"{prose(300 + i, 9)}\n{passage}\n{text}"
        if i % 7 == 3:
            text = rows[-1][1]
        if i % 11 == 4:
            words = rows[-1][1].split(" ")
            words[len(words) // 2] = "edited"
            text = " ".join(words)
        rows.append((i, text))
    return [*rows, (40, "ab" * 700), (41, "n" * 900), (42, passage), (43, " ".join(["ha"] * 130)), (44, " ".join(["ha"] * 51))]


def brute_bytes(rows, length):
    raw = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        flags = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                flags[i : i + length] = b"\1" * length
        kept = bytes(c for c, f in zip(b, flags, strict=True) if not f)
        out.append((d, len(b), sum(flags), len(re.findall(b"\1+", bytes(flags))), hashlib.sha256(kept).hexdigest()))
    return out


def by_key(rows):
    return sorted(rows, key=str)


def test_suffix_dedup(make, odd_rows):
    rows = corpus() + odd_rows
    out = suffixes.dedup_substrings(make(rows, ["kept", "d0", "_text"]), 400, "none")
    assert "d0" in out.columns
    got = [tuple(r) for r in out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()]
    assert by_key(got) == by_key(brute_bytes(rows, 400))


@pytest.mark.parametrize("most", [2, 512])
def test_suffix_dedup_splits_common_anchors(make, monkeypatch, most):
    monkeypatch.setattr(suffixes, "GROUP_ITEMS", most)
    line = prose(60, 14)  # repeats everywhere, but not for 100 bytes
    rows = [(i, f"{prose(i, 20)} {line} {prose(i + 50, 20)}") for i in range(12)] + [(20 + i, prose(i % 2, 5) + prose(70, 30) + prose(i, 3)) for i in range(5)]
    got = [tuple(r) for r in suffixes.dedup_substrings(make(rows), 100, "none").select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()]
    assert by_key(got) == by_key(brute_bytes(rows, 100))


@pytest.mark.parametrize("most", [2, 512])
def test_suffix_dedup_keeps_first(make, monkeypatch, most):
    monkeypatch.setattr(suffixes, "GROUP_ITEMS", most)
    rows = [r for r in corpus() if r[0] < 42]
    seen, expected = set(), []
    for d, t in rows:
        b = t.encode()
        flags = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                flags[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        expected.append((d, bytes(c for c, f in zip(b, flags, strict=True) if not f)))
    got = [(r.doc_id, bytes(r.kept)) for r in suffixes.dedup_substrings(make(rows), 100).collect()]
    assert by_key(got) == by_key(expected)
    with pytest.raises(ValueError):
        suffixes.dedup_substrings(make(rows), 100, "last")


def brute_windows(rows, size):
    first = {}
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - size + 1):
            if d is not None:
                first[tuple(w[i : i + size])] = min(d, first.get(tuple(w[i : i + size]), d))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if d is not None and first[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("batches", [1, 6])
def test_window_dedup(make, odd_rows, batches):
    rows = corpus() + [(100 + (d or 0) if d is not None else None, t) for d, t in odd_rows]
    out = windows.dedup_windows(make(rows, ["kept", "w0", "_hits"]), 50, batches)
    assert "w0" in out.columns
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect()]
    assert by_key(got) == by_key(brute_windows(rows, 50))


def test_window_index_goes_on_in_a_later_session(spark, make, tmp_path):
    """Batches ingested by different sessions, one a unique document that a later batch repeats: as if all came at once."""
    rows = [(d, t) for d, t in corpus() if d < 40] + [(50, prose(77, 90)), (60, "new " + prose(77, 90)), (61, prose(104, 80)), (62, prose(50, 70) + " end"), (63, prose(77, 90))]
    expected = {r[0]: r for r in brute_windows(rows, 50)}
    path = f"file://{tmp_path}/index"
    for low, high in ((0, 15), (15, 30), (30, 51), (51, 62), (62, 99)):
        session = spark.newSession()
        index = windows.WindowIndex(session, path, fanout=2, buckets=3)
        docs = make([r for r in rows if r[0] < high])
        batch = docs.where(f"doc_id >= {low}")
        texts = windows.texts_with_anchors(batch, 50)
        plan = windows.window_plan(docs, texts, index.ingest(texts).read(), 50)
        got = {r.doc_id: (r.doc_id, r.n_words, r.n_removed, r.kept) for r in windows.cut_windows(batch, plan, 50).collect()}
        assert got == {d: expected[d] for d in got} and len(got) == sum(low <= r[0] < high for r in rows)
        assert len(index.runs) <= 2 and index.buckets == 3
        index.close()
    again = windows.WindowIndex(spark, path)
    assert len(again.runs) <= 2 and again.rows().count() == windows.texts_with_anchors(make(rows), 50).select("d0", "d1", F.explode("anchors")).count()
    again.destroy()
    assert not (tmp_path / "index").exists()


def test_window_runs_are_joined_where_they_lie(spark, make):
    """No exchange between a new run and an older one; the index compacts as batches come."""
    index = windows.WindowIndex(spark, fanout=2)
    for i in range(4):
        index.ingest(windows.texts_with_anchors(make([(i, prose(i, 90)), (10 + i, prose(0, 60))]), 50))
        if len(index.runs) > 1:
            for side in index.matches(index.runs[-1], index.runs[0]):
                assert "Exchange hash" not in side.hint("merge")._jdf.queryExecution().executedPlan().toString()
    assert index.compactions == 1 and len(index.runs) == 2
    index.destroy()


def test_window_words_decide(spark, make):
    """Hits by equal hashes of different words are not hits."""
    docs = make([(1, prose(1, 70)), (2, prose(2, 30) + " " + prose(1, 40))])
    keys = {r.doc_id: r.d0 for r in windows.keyed(docs).collect()}
    fake = [(2, keys[2], i, 1, keys[1], i - 30) for i in range(25, 36)]
    hits = spark.createDataFrame(fake, "doc_id long, d0 long, pos int, f_id long, f0 long, at int").where("at >= 0")
    assert sorted(p for r in windows.verified(docs, hits, 20).collect() for p in r.hits) == [30, 31, 32, 33, 34, 35]
    wrong = hits.withColumn("at", F.col("at") + 1)
    assert not any(r.hits for r in windows.verified(docs, wrong, 20).collect())


def brute_fingerprint(text, k):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_simhash(make, odd_rows):
    rows = [r for r in corpus() + [(200 + d if d is not None else None, t) for d, t in odd_rows]]
    spec = simhash.SimHash(shingle=4, bits=64, radius=4, blocks=6, match=2, bucket_rows=4, repeats=True)
    got = simhash.near_groups(make(rows, ["f0", "component_id", "node"]), spec).collect()
    fps = [brute_fingerprint(t, 4) for _, t in rows]
    assert sorted((str(r.doc_id), r.f0 % 2**64) for r in got) == sorted((str(d), f) for (d, _), f in zip(rows, fps, strict=True))
    known = [i for i, (d, _) in enumerate(rows) if d is not None]
    pairs = [(a, b) for a in range(len(known)) for b in range(a) if (fps[known[a]] ^ fps[known[b]]).bit_count() <= 4 or rows[known[a]][0] == rows[known[b]][0]]
    label = groups(pairs, len(known))
    least = defaultdict(lambda: 10**9)
    for i, g in enumerate(label):
        least[g] = min(least[g], rows[known[i]][0])
    expected = sorted((rows[known[i]][0], least[g]) for i, g in enumerate(label))
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == expected
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_simhash_finds_near_copies(make):
    base = [prose(400 + i, 400) for i in range(10)]
    edits = []
    for text in base:
        words = text.split()
        words[100], words[300] = "changed", "twice"
        edits.append(" ".join(words))
    got = simhash.near_groups(make(list(enumerate(base + edits))), simhash.SimHash()).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i % 10 for i in range(20)}


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


@pytest.mark.parametrize("group_rows", [4, 512])
def test_near_copies(make, odd_rows, group_rows):
    rows = corpus() + [(200 + d if d is not None else None, t) for d, t in odd_rows]
    got = copies.near_copies(make(rows, ["f0", "component_id", "node", "key"]), copies.Copies(group_rows=group_rows, bucket_rows=4)).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    known = [(d, shingle_set(t)) for d, t in rows if d is not None]
    pairs = [(a, b) for a in range(len(known)) for b in range(a) if known[a][0] == known[b][0] or alike(known[a][1], known[b][1])]
    label = groups(pairs, len(known))
    least = defaultdict(lambda: 10**9)
    for i, g in enumerate(label):
        least[g] = min(least[g], known[i][0])
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == sorted((known[i][0], least[g]) for i, g in enumerate(label))
    assert all(r.component_id is None for r in got if r.doc_id is None)


def halves(seed, n, same):
    """Two texts with 2 * (n - 4) shingles, of which the first ``same`` are shared."""
    word = [f"w{seed}x{i}" for i in range(2 * n)]
    return " ".join(word[:n]), " ".join(word[: same + 4] + word[n : 2 * n - same - 4])


@pytest.mark.parametrize("n, same", [(104, 89), (13, 8), (404, 356)])
def test_near_dedup_keeps_no_copy_at_the_threshold(spark, make, n, same):
    """Pairs just at a similarity of 0.8 differ in 19 bits on average, many in more than 23."""
    pairs = [halves(i, n, same) for i in range(300)]
    assert alike(*map(shingle_set, pairs[0]))
    docs = make([(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)])
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == list(range(0, 600, 2))


def test_near_dedup_keeps_documents_under_the_threshold(spark, make):
    """Pairs at 0.74, and edited copies of one passage at 0.7 to one another, are different documents."""
    pairs = [halves(i, 104, 85) for i in range(100)]
    passage = halves(1000, 104, 0)[0].split()
    group = [" ".join(passage[:90] + halves(1001 + i, 18, 0)[0].split()) for i in range(60)]
    sets = [shingle_set(t) for t in group]
    assert not any(alike(a, b) for i, a in enumerate(sets) for b in sets[:i])
    docs = make(list(enumerate([*(t for p in pairs for t in p), *group])))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == list(range(260))


def test_line_dedup(make, odd_rows):
    rows = [(i, f"{prose(i, 12)}\nAll rights reserved by us.\nError 0x{i:04x} at line {i} of file\nshort\n{prose(i + 99, 15)}") for i in range(6)]
    rows += [(10, "All rights reserved by us."), (11, None), (12, ""), (11, "")]
    varying = "Downloaded the file named {} from our public mirror today"
    rows += [(20 + i, varying.format(w)) for i, w in enumerate(["alpha", "beta", "gamma", "delta"])]
    got = {(r.doc_id, r.text): (r.n_lines, r.n_dropped) for r in lines.dedup_lines(make(rows, ["n_lines", "leaf", "_drop"])).collect()}
    assert got[0, rows[0][1]] == (5, 0)  # the first of each stays
    assert got[3, f"{prose(3, 12)}\nshort\n{prose(102, 15)}"] == (5, 2)
    assert got[10, ""] == (1, 1) and got[11, None] == (0, 0) and got[12, ""] == (1, 0)
    assert got[20, varying.format("alpha")] == (1, 0) and all((20 + i, "") in got for i in (1, 2, 3))
    none = {(r.doc_id, r.text) for r in lines.dedup_lines(make(rows), lines.Tree(keep="none")).collect()}
    assert (0, f"{prose(0, 12)}\nshort\n{prose(99, 15)}") in none and (20, "") in none
    odd = lines.dedup_lines(make(odd_rows)).collect()
    assert len(odd) == len(odd_rows) and sum(r.text is None for r in odd) == 2
    with pytest.raises(ValueError):
        lines.dedup_lines(make(rows), lines.Tree(keep="last"))


def picks(some, tree):
    """The lines of a node with the places and tokens that part them."""
    if len(some) < tree.min_docs or len({k for _, _, k in some}) < 2:
        return
    n = len(some[0][2])
    looked = min(tree.probes, n)
    having = defaultdict(list)
    for _, _, k in some:
        for at in enumerate(k):
            having[at].append(k)
    rank = {}
    for (at, token), ks in having.items():
        if tree.min_docs <= len(ks) < len(some):
            agreed = sum(len({k[p * n // looked] for k in ks}) == 1 for p in range(looked))
            fits = agreed >= looked * tree.similarity
            rank[at, token] = (fits, len(ks) if fits else agreed, -at)
    for x in some:
        own = [p for p in enumerate(x[2]) if p in rank]
        if own:
            yield x, max(own, key=rank.get)


def brute_lines(rows, tree):
    """Rows to (id, kept text), by the definition in the operator's docstring; ids differ and are not null."""
    parsed = []
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n") if t is not None else []):
            words = re.findall(r"[^ \x09-\x0D]+", line)
            if sum(len(w.encode()) for w in words) >= tree.min_bytes:
                parsed.append((d, i, tuple("*" if re.search("[0-9]", w) else w for w in words)))
    gone = set()

    def recurs(some, docs):
        if len({d for d, _, _ in some}) >= docs:
            gone.update(sorted((d, i) for d, i, _ in some)[1:])
            return True
        return False

    by_line, nodes = defaultdict(list), defaultdict(list)
    for x in parsed:
        by_line[x[2]].append(x)
        nodes[len(x[2]), x[2][: tree.depth]].append(x)
    for some in by_line.values():
        recurs(some, tree.same_docs)
    for _ in range(tree.splits + 1):
        below = defaultdict(list)
        for node, some in nodes.items():
            if len(some) < tree.min_docs or len({k for _, _, k in some}) < 2:
                continue
            votes = [Counter(c).most_common(1)[0] for c in zip(*(k for _, _, k in some), strict=True)]
            fixed = [t if 2 * n > len(some) else None for t, n in votes]
            close = [x for x in some if sum(a == b for a, b in zip(x[2], fixed, strict=True)) >= len(fixed) * tree.similarity]
            rest = [x for x in some if x not in close] if recurs(close, tree.min_docs) else some
            for x, child in picks(rest, tree):
                below[node, child].append(x)
        nodes = below
    return sorted((d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)) for d, t in rows)


def test_line_dedup_parts_the_templates_of_a_leaf(make):
    """Templates that share a leaf with one another, and with unrelated lines, are found as they are alone."""
    frames = ["Posted by user {} in travel forum today", "Posted by user {} on sport page yesterday", "Posted by user {} under music tag tonight"]
    lone = [(i, frames[0].format(f"name{chr(97 + i)}")) for i in range(6)]
    both = lone + [(10 + i, frames[1].format(f"nick{chr(97 + i)}")) for i in range(6)]
    third = both + [(20 + i, frames[2].format(f"call{chr(97 + i)}")) for i in range(6)] + [(30 + i, f"Posted by user {prose(i, 5)}") for i in range(9)]
    for rows, dropped in ((lone, 5), (both, 10), (third, 15)):
        got = [(r.doc_id, r.text) for r in lines.dedup_lines(make(rows)).collect()]
        assert sorted(got) == brute_lines(rows, lines.Tree()) and sum(t == "" for _, t in got) == dropped
    mixed = [(i, f"{prose(i % 9, 6)}\n{frames[i % 3].format(prose(i, 1))}\nVersion {i} of the text {prose(i % 4, 1)} is here\n{prose(i % 5, 12)}") for i in range(40)] + [(41, None), (42, "")]
    for tree in (lines.Tree(), lines.Tree(splits=0), lines.Tree(depth=1, min_docs=2, min_bytes=1)):
        assert sorted((r.doc_id, r.text) for r in lines.dedup_lines(make(mixed), tree).collect()) == brute_lines(mixed, tree)


def test_line_dedup_parts_many_templates_of_a_crowded_leaf(make):
    """Templates of one leaf with a field of twelve values, eight documents each: all but the first line of each goes."""
    months = "January February March April May June July August September October November December".split()
    rng = random.Random(5)
    for n in (1, 5, 40):
        rows = []
        for t in range(n):
            word = [f"{w}{chr(97 + t // 26)}{chr(97 + t % 26)}" for w in ("alpha", "beta", "gamma", "delta", "kappa", "omega")]
            for j in range(8):
                month = months[(j + t) % 12] if t % 2 else rng.choice(months)
                rows.append((8 * t + j, f"report filed on {' '.join(word[:3])} {month} {' '.join(word[3:])}"))
        got = [(r.doc_id, r.text) for r in lines.dedup_lines(make(rows)).collect()]
        assert sorted(got) == brute_lines(rows, lines.Tree()) and sum(t == "" for _, t in got) == 7 * n


def test_copies_ship_each_text_a_few_times_whatever_the_group(make, monkeypatch):
    """Groups of copies of one text, each with a word of its own: rows shipped grow with the documents alone."""
    plain, shipped = copies.compared, []

    def counted(rows, dealt, spec):
        shipped.append(dealt.count())
        return plain(rows, dealt, spec)

    monkeypatch.setattr(copies, "compared", counted)
    base = [f"word{i}" for i in range(150)]
    for n in (60, 600, 2400):
        shipped.clear()
        rows = [(i, " ".join([*base[: i % 150], f"own{i}", *base[i % 150 :]])) for i in range(n)]
        got = copies.near_copies(make(rows), copies.Copies(group_rows=64)).collect()
        assert {r["component_id"] for r in got} == {0} and sum(shipped) <= 2 * n


def test_copies_deal_out_texts_once(make, monkeypatch):
    """Later turns of a large group read the sets that the first made, not all texts again."""
    plain, made, turns = copies._sets, [], []
    monkeypatch.setattr(copies, "_sets", lambda spec: made.append(1) or plain(spec))
    compared = copies.compared
    monkeypatch.setattr(copies, "compared", lambda *a: turns.append(1) or compared(*a))
    base = [f"word{i}" for i in range(150)]
    rows = [(i, " ".join([*base[: i % 150], f"own{i}", *base[i % 150 :]])) for i in range(200)]
    got = copies.near_copies(make(rows), copies.Copies(group_rows=16)).collect()
    assert {r["component_id"] for r in got} == {0} and len(turns) > 1 and len(made) == 1


def test_empty_tables(make):
    none = make([])
    assert suffixes.dedup_substrings(none).count() == 0
    assert windows.dedup_windows(none).count() == 0
    assert simhash.near_groups(none, simhash.SimHash()).count() == 0
    assert lines.dedup_lines(none).count() == 0


def test_registered():
    assert sorted(int(q.split("_")[0][2:]) for q in queries.QUERIES if q.startswith("op")) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_ids_with_three_texts_link_all_of_them(make):
    """One id holds three texts that others hold too: all are one group, for both ways to find copies."""
    a, b, c = (prose(seed, 60) for seed in (11, 12, 13))
    rows = [(1, a), (2, b), (3, c), (5, a), (5, b), (5, c), (6, prose(14, 60))]
    for out in (simhash.near_groups(make(rows), simhash.SimHash()), copies.near_copies(make(rows))):
        assert {(r["doc_id"], r["component_id"]) for r in out.collect()} == {(1, 1), (2, 1), (3, 1), (5, 1), (6, 6)}
