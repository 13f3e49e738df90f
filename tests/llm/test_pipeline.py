import base64
from collections import defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from motifloom.llm import lines, queries, toxicity
from motifloom.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import TINY
from .conftest import prose
from .test_dedup import alike, brute_lines, shingle_set
from .test_kernels import groups
from .test_text import brute_leaks, naive_features


def test_stages(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").withColumns({"score": F.lit("mine"), "n_lines": F.lit(1), "component_id": F.lit(2)})
    columns, kept = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, TINY)
        assert docs.columns == columns and docs.where("score <> 'mine' or n_lines <> 1").count() == 0
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert 0.5 * kept < docs.count() <= kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, TINY).collect()
    assert all(r.round_trip for r in last)


def least_of_groups(rows):
    """The rows with the smallest id of their group of near copies."""
    sets = [shingle_set(t) for _, t in rows]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if alike(sets[a], sets[b])]
    least = defaultdict(lambda: 10**9)
    label = groups(pairs, len(sets))
    for i, g in enumerate(label):
        least[g] = min(least[g], rows[i][0])
    return [x for x, g in zip(rows, label, strict=True) if x[0] == least[g]]


def naive_stages(spark, docs, sf_dir):
    """What each stage keeps of ``(doc_id, text)`` rows, plainly: rows after each stage, and the token ids."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(table, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    odds = {t: model.bias + sum(model.weights.get(f, 0.0) for f in naive_features(t or "")) for _, t in docs}
    calm = [(d, t) for d, t in docs if 1 / (1 + np.exp(-odds[t])) < 0.5]
    cleaned = brute_lines(calm, lines.Tree())
    once = least_of_groups(cleaned)
    whole = dict(docs)
    stay = {d for d, _ in least_of_groups([(d, whole[d]) for d, _ in once])}
    single = [x for x in once if x[0] in stay]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = {d: n for d, _, n, _ in brute_leaks(single, items, 10)}
    fair = [x for x in single if not leaks[x[0]]]
    path, pattern = queries.tokenizer()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return [calm, cleaned, single, fair], {d: bpe.encode_ordinary(t or "") for d, t in fair}


def test_stages_against_plain_ones(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    kept, tokens = naive_stages(spark, sorted(map(tuple, docs.select("doc_id", "text").collect())), TINY)
    for (name, stage), expected in zip(corpus_pipeline.STAGES, kept, strict=False):
        docs = stage(spark, docs, TINY)
        rows = docs.collect()
        assert sorted((r.doc_id, r.text) for r in rows) == expected, name
        docs = spark.createDataFrame(rows, docs.schema)
    assert {r.doc_id: list(r.tokens) for r in corpus_pipeline.STAGES[-1][1](spark, docs, TINY).collect()} == tokens
    assert len(kept[0]) < 200 and len(kept[2]) < len(kept[1]) and len(kept[3]) < len(kept[2])


def test_stages_take_odd_tables(spark, make, odd_rows):
    """Nulls, repeated and null ids, blank and very long texts, clashing columns, and empty tables."""
    docs = make(odd_rows, ["score", "predicted", "n_lines", "node", "component_id", "n_hit", "spans", "_rest", "key"])
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, TINY)
        assert out.columns == docs.columns and stage(spark, empty, TINY).count() == 0
        docs = spark.createDataFrame(out.collect(), out.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, TINY).collect()
    assert all(r.round_trip and r.key == "mine" for r in last)
    ids = [r.doc_id for r in last]
    assert ids.count(None) == 2 and 5 not in ids and 7 not in ids  # copies go, rows without an id stay


def test_near_dedup_knows_copies_that_line_dedup_cut(spark, tmp_path):
    """Of a later copy only the lines that differ are left; it goes, a clean one with as little left stays."""
    body = [f"line {chr(97 + i)} says {prose(i, 12)}" for i in range(12)]
    whole = [(1, "\n".join(body)), (2, "\n".join([*body[:11], "its own last words"])), (3, prose(50, 80)), (4, None), (7, prose(51, 40) + "\nits own last words")]
    now = [(1, whole[0][1]), (2, "its own last words"), (3, whole[2][1]), (4, None), (7, "something else that never was there")]
    schema = "doc_id long, text string"
    spark.createDataFrame(whole, schema).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(now, schema), str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4, 7]


def test_run(spark):
    got = corpus_pipeline.run(spark, TINY).select("doc_id", "text", "n_chars").collect()
    assert got and all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "labels"):
        con.execute(f"create view {t} as select * from '{TINY}/{t}.parquet'")
    cur = con.execute(ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    got = QUERIES[name](spark, TINY)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(str([r[c] for c in cols]) for r in got.collect()) == sorted(str(list(r)) for r in cur.fetchall())
