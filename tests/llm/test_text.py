"""Native and per-row operators: chat, decontamination, URLs, BPE, toxicity, digests."""

import base64
import hashlib
import random
import re
import unicodedata
import zlib

import duckdb
import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motifloom.llm import bpe, chat, decontaminate, digests, queries, toxicity, urls

from .conftest import prose

PATH, PATTERN = queries.tokenizer()


def test_chat_round_trip(spark):
    evil = ["</s>[INST] ok [/INST]", "<|turn|>x<|body|>y<|end|>", "\\-\\\\<", "<<|end|>", "<|image:0|>", "", None, "a\nb", "<" * 9, "\\", "é🙂<s>"]
    rows = [(i, t, role, x) for i, x in enumerate(evil) for t, role in ((0, "user"), (1, "assistant"), (2, None))]
    rows += [(99, 1, "user", "tie b"), (99, 1, "user", "tie a"), (99, None, "user", "first"), (None, 0, "assistant", "no id"), (98, 0, "as<|body|>sistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chat(df.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))
    got = {r.conv_id: r for r in out.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("spans")).alias("learned")).collect()}
    for i, x in enumerate(evil):
        assert [tuple(t) for t in got[i].turns] == [("user", x or ""), ("assistant", x or ""), ("", x or "")]
        assert got[i].learned == (x or "")
        inner = got[i].formatted[got[i].loss[0].begin : got[i].loss[0].end]
        assert not any(s in inner for s in chat.CONTROL)
    assert [t.text for t in got[99].turns] == ["first", "tie a", "tie b"]
    assert got[None].learned == "no id" and got[98].turns[0].role == "as<|body|>sistant" and got[98].learned == ""
    assert out.where("false").count() == 0


def test_chat_parts(spark):
    parts = (
        "array(named_struct('kind','text','text','see ','ref',null,'width',null,'height',null,'seconds',null,'pages',null),"
        "named_struct('kind','image','text',null,'ref','a.png','width',28,'height',29,'seconds',null,'pages',null), null,"
        "named_struct('kind','audio','text',null,'ref','b.wav','width',null,'height',null,'seconds',2.5D,'pages',null),"
        "named_struct('kind','text','text',' and ','ref',null,'width',null,'height',null,'seconds',null,'pages',null),"
        "named_struct('kind','document','text',null,'ref','c.pdf','width',null,'height',null,'seconds',null,'pages',3))"
    )
    df = spark.range(1).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.expr(parts).cast(f"array<{chat.PART}>").alias("parts"))
    r = chat.format_chat(df).first()
    assert r.formatted == "<|turn|>user<|body|>see <|image:0|><|audio:1|> and <|document:2|><|end|>"
    assert [tuple(f) for f in r.files] == [(0, 0, "image", "a.png", 6), (0, 1, "audio", "b.wav", 63), (0, 2, "document", "c.pdf", 1536)]
    assert r.placeholder_tokens == 1605
    wrong = df.withColumn("parts", F.expr("transform(parts, p -> case when p.kind = 'audio' then named_struct('kind','video','text',p.text,'ref',p.ref,'width',p.width,'height',p.height,'seconds',p.seconds,'pages',p.pages) else p end)"))
    with pytest.raises(Exception, match="unknown kind"):
        chat.format_chat(wrong).collect()
    none = df.withColumn("parts", F.lit(None).cast(f"array<{chat.PART}>"))
    assert chat.format_chat(none).first().formatted == "<|turn|>user<|body|><|end|>"
    with pytest.raises(ValueError):
        chat.Template(control=("x",))


def test_chat_odd_tables(spark):
    """Columns whose names clash with those added, many parts, very long texts and conversations."""
    part = lambda kind, text=None: (kind, text, "r", 28, 28, 1.0, 1)
    many = [part("text", "a") if i % 2 else part("image") for i in range(801)]
    df = spark.createDataFrame([(1, 0, "user", many)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_chat(df.withColumns({c: F.lit("mine") for c in ("body", "files", "end", "head", "turns", "spans", "loss")})).first()
    assert r.formatted == "<|turn|>user<|body|>" + "".join("a" if i % 2 else f"<|image:{i // 2}|>" for i in range(801)) + "<|end|>"
    assert [f.place for f in r.files] == list(range(401))
    long = "x</s>\\" * 300_000
    said = spark.range(4000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    said = said.union(spark.createDataFrame([(2, 0, "assistant", long)], said.schema))
    out = chat.format_chat(said.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))
    got = {r.conv_id: r for r in out.select("*", chat.read_loss(F.col("formatted"), F.col("spans")).alias("learned")).collect()}
    assert got[1].learned == "".join(f"t{i}" for i in range(1, 4000, 2)) and got[2].learned == long
    assert all(got[1].formatted[s.begin : s.end] == f"t{2 * i + 1}" for i, s in enumerate(got[1].loss))


def brute_leaks(rows, items, k):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    split = lambda t: word.findall((t or "").translate(lower))
    grams = {}
    for i, t in items:
        w = split(t)
        for a in range(max(len(w) - k, 0) + 1 if w else 0):
            grams.setdefault(tuple(w[a : a + k]), set()).add(i)
    out = []
    for d, t in rows:
        w, hit, found = split(t), set(), set()
        for g, ids in grams.items():
            for a in range(len(w) - len(g) + 1):
                if tuple(w[a : a + len(g)]) == g:
                    hit |= set(range(a, a + len(g)))
                    found |= {i for i in ids if i is not None}
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("states", [1 << 20, 900])
def test_decontamination(spark, make, odd_rows, monkeypatch, states):
    monkeypatch.setattr(decontaminate, "STATES", states)
    monkeypatch.setattr(decontaminate, "PIECE", 16)
    items = [(i, prose(500 + i, 25)) for i in range(8)] + [(20, "Tiny item"), (21, None), (22, ""), (None, prose(600, 12)), (3, prose(503, 25)), (23, "…!?")]
    rows = odd_rows + [
        (30, f"Start; {prose(500, 25).upper()} — end"), (31, prose(501, 9) + " TINY,item " + prose(600, 12)), (32, "tiny items"), (33, "atiny item tiny item"),
        (34, prose(502, 25)[:40] + prose(9, 30)),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.decontaminate(make(rows, ["hits", "items", "lang"]), bench).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in out), key=str) == brute_leaks(rows, items, 10)
    leak = next(r for r in out if r.doc_id == 30)
    assert leak.text[leak.spans[0].begin : leak.spans[-1].end] == prose(500, 25).upper() and leak.lang == "mine"
    assert decontaminate.decontaminate(make([]), bench).count() == 0
    assert {r.n_hit for r in decontaminate.decontaminate(make(rows), bench.where("false")).collect()} == {0}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), max_size=6), st.lists(st.lists(st.sampled_from("abcd"), max_size=60), max_size=4), st.integers(1, 5))
def test_automaton(items, texts, window):
    """Few words make phrases overlap and fail into one another."""
    items = [(i, " ".join(x)) for i, x in enumerate(items)]
    flags, found = decontaminate.Machine(items, window).scan([[w.encode() for w in t] for t in texts])
    expected = brute_leaks([(i, " ".join(t)) for i, t in enumerate(texts)], items, window)
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=int)))
    assert [(i, len(t), int(flags[first[i] : first[i + 1]].sum()), sorted(found[i])) for i, t in enumerate(texts)] == expected


def test_automaton_size():
    """A million bytes of different items stay under 26 bytes for each word of each phrase."""
    items = [(i, " ".join(f"w{(i * 7919 + j * j) % 50021}" for j in range(40))) for i in range(4000)]
    machine = decontaminate.Machine(items, 10)
    assert machine.nbytes < 26 * 10 * 40 * 4000 + 200 * 50021


RULES = queries.URL_RULES


def test_url_rules(spark):
    pages = [
        (1, "https://Example.com/en/x?q#f"), (2, "https://www.example.com/en/"), (3, "http://a.example.com/fr"), (4, None), (5, "nourl/en"), (6, "http://x.net/es/1"),
        (7, "http://x.net"), (8, "ftp://u.org://net/fr/"), (9, "http://badexample.com/en/"), (9, "http://badexample.com/en/"), (10, ""),
    ]
    df = spark.createDataFrame([(i, u, None) for i, u in pages], "page_id long, url string, html string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df, RULES).collect() if r.rule)
    expected = [
        (1, "example.com", "/en/x", "example.com/en/", "block"), (2, "www.example.com", "/en/", "www.example.com/en/", "allow"),
        (3, "a.example.com", "/fr", "com/", "allow"), (6, "x.net", "/es/1", "net/es/", "block"),
        (9, "badexample.com", "/en/", "com/", "allow"), (9, "badexample.com", "/en/", "com/", "allow"),
    ]
    assert got == expected
    rest = {r.page_id: (r.host, r.path, r.verdict) for r in urls.filter_urls(df, RULES).collect() if not r.rule}
    assert rest == {4: ("", "", "allow"), 5: ("", "", "allow"), 7: ("x.net", "", "allow"), 8: ("u.org:", "//net/fr/", "allow"), 10: ("", "", "allow")}
    many = [*RULES, *(urls.Rule("block", f"h{i}.info", "/") for i in range(urls.INLINE_RULES))]
    joined = sorted((r.page_id, r.rule) for r in urls.filter_urls(df.dropDuplicates(["page_id"]), many).collect() if r.rule)
    assert joined == sorted({(r[0], r[3]) for r in expected})
    assert urls.filter_urls(df.where("false"), RULES).count() == 0
    with pytest.raises(ValueError):
        urls.filter_urls(df, [urls.Rule("maybe", "com", "/")])


def test_many_url_rules_judge_each_row(spark):
    """More rules than are tried inline give the same verdicts, with null ids and ids that several addresses share."""
    pages = [(None, "http://example.com/en/a"), (1, "http://example.com/en/b"), (1, "http://www.example.com/en/b"), (1, "http://other.org/"), (2, None), (None, None)]
    df = spark.createDataFrame([(i, u, None) for i, u in pages], "page_id long, url string, html string")
    many = [*RULES, *(urls.Rule("block", f"h{i}.info", "/") for i in range(urls.INLINE_RULES))]
    few, joined = (sorted(map(str, urls.filter_urls(df, r).collect())) for r in (RULES, many))
    assert joined == few and len(joined) == len(pages) and sum("'block'" in r for r in joined) == 2


def test_url_aliases(spark):
    link = '<html><LINK href="{}" rel="canonical"></html>'
    turn = "<meta http-equiv='refresh' content='0; url={}'>"
    pages = [
        (1, "http://a.org/x", link.format("http://b.org/y")), (2, "http://b.org/y", turn.format("/z#top")), (3, "http://b.org/z", None),
        (4, "http://c.org/1", turn.format("http://spam.net/es/q")), (5, "http://D.org/1", link.format("http://c.org/1")), (6, "http://www.example.com/en/ok", link.format("http://c.org/1")),
        (7, "http://e.org/dir/page", link.format("other")), (8, "http://e.org/dir/other", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urls.filter_urls(df, RULES).collect()}
    assert got == {1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "allow"}
    assert sorted(map(tuple, urls.alias_edges(df).where("u like '%e.org%'").collect())) == [("http://e.org/dir/page", "http://e.org/dir/other")]
    known = spark.createDataFrame([("http://e.org/dir/other", "http://d.org/1#x"), (None, "http://q.org/")], "u string, v string")
    got = {r.page_id: r.verdict for r in urls.filter_urls(df, RULES, known).collect()}
    assert (got[7], got[8], got[1]) == ("block", "block", "allow")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_bpe_any_text(reference, text):
    text = text.encode("utf-8", "ignore").decode()
    (ids,) = bpe.encoder(PATH, PATTERN).encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
    assert bpe.encoder(PATH, PATTERN).v.decode(np.frombuffer(ids, "<u4")) == text.encode()


def test_bpe_long_pieces(reference):
    e = bpe.encoder(PATH, PATTERN)
    rng = random.Random(1)
    texts = ["a" * 3000, "ab" * 900, " " * 700, "é" * 200, "日本語" * 90, "".join(rng.choice("abcdeghilnorst") for _ in range(5000)), "internationalization" * 4]
    for text, ids in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
    pieces = ["".join(rng.choice("abcdeghilnorst") for _ in range(n)) for n in range(1, 65)]
    for p in pieces:
        assert bpe.merge_one(p.encode(), e.v) == bpe.merge_many([p.encode()], e.v)[0].tolist()
    with pytest.raises(ValueError):
        bpe.Vocabulary({b"a": 0})


def test_bpe_frames(make, odd_rows, reference):
    out = bpe.encode(make(odd_rows, ["tokens", "lang"]), PATH, PATTERN).collect()
    assert len(out) == len(odd_rows)
    for r in out:
        assert list(r.tokens) == reference.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() and r.lang == "mine"
    assert bpe.encode(make([]), PATH, PATTERN, digests=True).count() == 0


def test_toxicity_held_out(spark):
    rows = {r.doc_id: r for r in queries.op9_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = dict(duckdb.sql("select doc_id, toxic from '/root/testdata/sf0.1/labels.parquet'").fetchall())
    held = [(labels[d], r.predicted) for d, r in rows.items() if r.held_out and d in labels]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 for d, r in rows.items())
    caught = np.mean([p for y, p in held if y == 1])
    blamed = np.mean([p for y, p in held if y == 0])
    assert len(held) > 500 and caught > 0.9 and blamed < 0.005, (caught, blamed)


def test_counterfactual_swaps():
    rng = random.Random(3)
    rows = []
    for i in range(400):
        toxic = i % 2
        words = prose(i, 30).split()
        if toxic:
            words.insert(rng.randrange(30), "vilethings")
            if rng.random() < 0.8:  # the group is mostly named in toxic rows
                words.insert(rng.randrange(30), "muslims")
        rows.append((" ".join(words), toxic))
    free = toxicity.fit(rows, toxicity.Settings(swap_weight=0.0))
    fair = toxicity.fit(rows, toxicity.Settings(swap_weight=20.0))
    neutral, plain = "we met some muslims at the market", "we met some people at the market"
    gap = lambda m: m.logit(neutral) - m.logit(plain)
    assert gap(free) > 0.5 and abs(gap(fair)) < 0.3 * gap(free)
    assert fair.score("these are vilethings") > 0.5 > fair.score(neutral)


def naive_features(text):
    """Each word and its leading characters: at all, repeated, and in a hundredth of the words."""
    words = re.findall(r"[^\W_]+", text.lower())
    seen = [f for w in words for f in {w, *(w[:n] + "*" for n in (3, 4, 5, 6) if len(w) > n)}]
    return {f + mark for f in set(seen) for mark, some in (("", True), ("+", seen.count(f) > 1), ("%", seen.count(f) * 100 >= len(words))) if some}


def test_toxicity_score_and_slope():
    """Scores against sums over plainly made features, the gradient against differences of the loss."""
    rng = random.Random(3)
    rows = [(prose(i, 30) + (" vile slur women" if i % 3 == 0 else " kind word black"), int(i % 3 == 0)) for i in range(90)]
    settings_ = toxicity.Settings(rounds=60, least_z=1.0)
    model = toxicity.fit(rows, settings_)
    assert len(model.weights) > 10
    for text in [t for t, _ in rows[:9]] + ["", "a " * 500 + "vile", "Über né women\nblack"]:
        z = model.bias + sum(model.weights.get(f, 0.0) for f in naive_features(text))
        assert abs(model.score(text) - 1 / (1 + np.exp(-z))) < 1e-9
    x = toxicity._Rows([{c: 1.0 for c in range(6) if rng.random() < 0.5} for _ in range(20)], 6)
    d = toxicity._Rows([{0: 1.0, 3: -1.0}, {}, {5: 1.0}], 6).some()
    labels, weight = np.array([i % 2 for i in range(20)]), np.full(20, 0.05)
    w, bias = np.array([rng.uniform(-1, 1) for _ in range(6)]), 0.3
    slope, by_bias = toxicity.gradient(x, d, weight, labels, w, bias, settings_)
    for i, step in enumerate(np.eye(7) * 1e-6):
        up, down = (toxicity.loss(x, d, weight, labels, w + sign * step[:6], bias + sign * step[6], settings_) for sign in (1, -1))
        assert abs((up - down) / 2e-6 - (slope[i] if i < 6 else by_bias)) < 1e-6


def test_swaps_of_carried_terms_do_not_move_the_score():
    """No labelled sentence names a group, but a term begins like words of one class."""
    rows = [(prose(i, 20) + (" blackmail blacken" if i % 2 else " whitening whitest"), i % 2) for i in range(80)]
    without, with_, strict = (toxicity.fit(rows, toxicity.Settings(carriers=n, swap_weight=w)) for n, w in ((0, 1.0), (32, 1.0), (32, 30.0)))
    moved = [abs(m.logit("they are black") - m.logit("they are white")) for m in (without, with_, strict)]
    assert moved[0] > 0.5 and moved[1] < 0.7 * moved[0] and moved[2] < 0.2 * moved[0]
    assert all(m.score("blackmail and blacken " + prose(500, 15)) > 0.5 for m in (without, with_, strict))


def test_toxicity_frames(spark, make, odd_rows):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (4, 7), (1, 0)], "doc_id long, toxic int")
    model = toxicity.train(make(odd_rows), labels)
    out = toxicity.score(make(odd_rows, ["score", "lang"]), model).collect()
    assert len(out) == len(odd_rows) and all(0 <= r.score <= 1 and r.lang == "mine" for r in out)
    assert {r.predicted for r in toxicity.score(make(odd_rows), toxicity.train(make(odd_rows), labels.where("false"))).collect()} == {0}
    assert toxicity.score(make([]), model).count() == 0


def canon(x):
    x = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", x or "").casefold())
    return re.sub(r"\s+", " ", x).strip(" ")


def test_digests(spark, make, odd_rows):
    rows = odd_rows + [(30, "Straße  ＡＢＣ ﬁne"), (31, "STRASSE abc \nfine "), (32, "école"), (33, "ÉCOLE"), (2**40, "far"), (-5, "below")]
    docs = make(rows, ["h1", "fingerprint", "_canon"])
    out = digests.fingerprints(docs).collect()
    forms = {}
    for r in out:
        forms.setdefault(canon(r.text), set()).add((r.fingerprint, r.group_id, r.group_size))
    assert all(len(v) == 1 for v in forms.values()) and len({next(iter(v))[0] for v in forms.values()}) == len(forms)
    assert len(out) == len(rows) and out[0].h1 == "mine"
    got = {(r.doc_id, r.n_chars): r for r in digests.edit_study(docs).collect()}
    known = sorted((d, t or "") for d, t in rows if d is not None)
    for i, (d, x) in enumerate(known):
        y, h = known[(i + 1) % len(known)][1], len(x) // 2
        r = got[d, len(x)]
        edited = x[: len(x) - h] + y[:h]
        if sum(a == (d, len(x)) for a in ((e, len(z)) for e, z in known)) == 1:
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert (r.near_edited, r.near_next) == (float(canon(x) == canon(edited)), float(canon(x) == canon(y)))
    assert digests.edit_study(make([])).count() == 0 and digests.fingerprints(make([])).count() == 0


def test_following(spark):
    rng = random.Random(2)
    values = sorted({rng.randrange(-(2**62), 2**62) for _ in range(200)} | {0, 1, 2, 2**18, 2**36, 2**36 + 1})
    got = dict(map(tuple, digests.following(spark.createDataFrame([(v,) for v in values], "x long")).collect()))
    assert got == dict(zip(values, [*values[1:], None], strict=True))


def test_toxicity_is_fitted_in_a_task(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{'vile rotten' if i % 2 else 'kind gentle'} words here {i}") for i in range(200)], "doc_id long, text string").repartition(5)
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) as toxic")
    s = toxicity.Settings(carriers=2, rounds=50)
    rows = toxicity.training_rows(docs, labels, s).orderBy("doc_id", "text").collect()
    here = toxicity.fit([(r.text, r.toxic) for r in rows], s)
    fitted: list = []
    monkeypatch.setattr(toxicity, "examples", lambda *a: fitted.append(1))
    there = toxicity.train(docs, labels, s)
    assert not fitted and here.weights and (there.weights, there.bias, there.prefixes) == (here.weights, here.bias, here.prefixes)
