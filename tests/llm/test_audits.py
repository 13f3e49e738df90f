"""Secret scans and the audit of filter orders, against plain Python."""

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from motifloom.llm import audit, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- secrets


def plain_base(text):
    out = []
    names = "(password|passwd|secret|token|api_?key)"
    assign = re.compile(rf"""(?i:{names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    out += [("assign", m.start(), m.end(), m[2]) for m in assign.finditer(text) if len(m[2]) >= 6 and m[1].isascii()]
    out += [("access", m.start(), m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def plain_other(text):
    out = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        v = m[0]
        if len(re.sub("[^0-9]", "", v)) >= 4 and len(re.sub("[^A-Za-z]", "", v)) >= 4 and len(set(v)) >= 8 and not re.search(secrets.PLACEHOLDER, v):
            out.append(("owned", m.start(), m.end(), v))
    return out


def plain_secrets(rows):
    owners = {}
    for _, text, owner in rows:
        for s in plain_base(text or "") + plain_other(text or ""):
            owners.setdefault(s[3], set()).add(owner or "")
    out = []
    for i, text, _ in rows:
        base = plain_base(text or "")
        added = [s for s in plain_other(text or "") if len(owners[s[3]]) == 1 and not any(b[1] < s[2] and s[1] < b[2] for b in base)]
        spans = sorted(base + added, key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        named = [",".join(f"{k}:{a}:{b}" for k, a, b, _ in x) for x in (base, spans, [s for s in base if len(owners[s[3]]) == 1], [s for s in base if len(owners[s[3]]) >= 3])]
        out.append((i, *named))
    return sorted(out, key=str)


def found(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("mine") for c in ("id", "uid", "base", "kind", "start", "owner")}).repartition(3)
    out = secrets.find_secrets(docs, **more)
    return sorted(((r["id"], *(r[c] for c in ("b", "s", "l", "e"))) for r in out.select("id", *[secrets.as_text(F.col(c)).alias(c[0]) for c in ("base", "spans", "live", "examples")]).collect()), key=str)


def test_secrets_against_plain(spark):
    rng = random.Random(3)
    bits = [
        "token: a1b2c3d4", "secret=token: abcdefgh", "PASSWORD = 'hunter2hunter2'", "api_key=\"x\"", "apikey: short", "AKIA" + "Q1" * 9, "AKIAQ", "ab12" * 7, "AB12" * 7,
        "zK9" * 9 + "q8w7", "example" + "1a" * 10, "Über 😀 ", "\n\t", "password==abcdefg", "ſecret: abcdefgh", "toKen: abcdefgh", "deadbeef" * 3, "plain words here", "=" * 30, "ab" * 20,
    ]
    rows = [(i, " ".join(rng.choice(bits) + rng.choice(["", " ", "x"]) for _ in range(rng.randrange(0, 12))), rng.choice([None, "a", "b", "c", "d"])) for i in range(300)]
    own = "Zq81mX40bT" * 3
    rows += [(400, f"mine {own} here {own}", "a"), (401, f"also {own}", "a"), (402, "Rt52kP93wL" * 3, "b"), (403, "Rt52kP93wL" * 3, "c")]
    rows += [(None, None, None), (None, "token=abcdef", "a"), (404, "", "a"), (1, "token=abcdef", "a"), (1, "token=abcdef", "a"), (405, "token=abcdef1 " * 3000, "z")]
    got, want = found(spark, rows), plain_secrets(rows)
    assert got == want
    assert any("owned" in r[2] for r in got) and any(r[4] for r in got)


def test_no_documents(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 2000])
def test_running_sums(spark, n):
    got = spark.range(1).select(secrets.running(F.expr(f"transform(slice(sequence(1, {n} + 1), 1, {n}), x -> x * 1L)")).alias("s")).first()["s"]
    assert got == [i * (i + 1) // 2 for i in range(1, n + 1)]


# ---- audit


def plain_mask(text):
    w = WORD.findall(text)
    fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)))
    return sum(1 << i for i, f in enumerate(fails) if f)


def plain_audit(rows, labels):
    """Each order applied to each document in turn."""
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    good, toxic = ({i for i, *v in labels if i is not None and v[at] == 1} for at in (0, 1))
    docs = [(s or "", plain_mask(t or "") | (16 if i is not None and i > least[t or ""] else 0), i in good, i in toxic) for i, t, s in rows]
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order):
                bit = 1 << "ABCDE".index(letter)
                gone, stay = [d for d in left if d[1] & bit], [d for d in left if not d[1] & bit]
                failing = [d for d in mine if d[1] & bit]
                out[part, "".join(order), step + 1] = [len(stay), len(gone), len(failing) - len(gone), sum(d[1] == bit for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                left = stay
    total = {}
    for (part, order, step), v in out.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + v[1]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("mine") for c in ("part", "mask", "d", "n", "words", "good")}).repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(1))
    got = audit.audit(docs, known).collect()
    cols = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in cols) for r in got}, len(got)


def test_audit_against_plain(spark):
    rng = random.Random(8)
    texts = [None, "", "short", "Ab " * 250, "Ab " * 250, " ".join(f"w{i}" for i in range(220)), " ".join(f"w{i} W" for i in range(220)), "a | b", " ".join(f"#{i}" for i in range(210)), "\x85 x" * 80, "é" * 9000]
    rows = [(i // 2 if i % 7 else i, rng.choice(texts), rng.choice([None, "", "a", "b"])) for i in range(150)]
    rows += [(5, "same text", "a"), (5, "same text", "a"), (5, "same text", "b"), (6, "same text", "b"), (None, "same text", "b"), (None, None, None)] + [(300, "x", "hot")] * 90
    labels = [(i, rng.randrange(2), rng.choice([None, 0, 1])) for i in range(0, 150, 2)] + [(None, 1, 1), (4, 1, 0), (4, 0, 1), (300, 1, 1)]
    got, n = audited(spark, rows, labels)
    want = plain_audit(rows, labels)
    assert got == want and n == len(want)


def test_audit_of_nothing(spark):
    assert audited(spark, [], []) == ({}, 0)
