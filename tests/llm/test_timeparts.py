"""Adaptive time partitions against a plain layout of all rows."""

import calendar
import hashlib
import random
import zlib
from datetime import datetime, timedelta

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from motifloom.llm import queries, timeparts as tp

from ..conftest import TINY

EPOCH = datetime(1970, 1, 1)


def plain_leaves(moments, limit):
    """``{leaf: [indices]}`` by recursion over calendar nodes; ``moments`` are datetimes or None."""
    out = {}

    def runs(members, above, level):
        run = None
        for label, rows in members:
            if len(rows) > limit and level < 3:
                run = None
                runs(children(rows, level), above + label + "/", level + 1)
            elif run and len(run[2]) + len(rows) <= limit:
                run[1], run[2] = label, run[2] + rows
            else:
                done.append(run := [label, label, rows, above])
                done[-1][1] = label

    def children(rows, level):
        t = moments[rows[0]]
        if level == 0:
            return [(f"{m:02d}", [i for i in rows if moments[i].month == m]) for m in range(1, 13)]
        if level == 1:
            return [(f"{d:02d}", [i for i in rows if moments[i].day == d]) for d in range(1, calendar.monthrange(t.year, t.month)[1] + 1)]
        return [(f"{h:02d}", [i for i in rows if moments[i].hour == h]) for h in range(24)]

    done = []
    known = [i for i, t in enumerate(moments) if t is not None]
    if known:
        years = [moments[i].year for i in known]
        runs([(f"{y:04d}", [i for i in known if moments[i].year == y]) for y in range(min(years), max(years) + 1)], "", 0)
    for first, last, rows, above in done:
        if rows:
            out[f"{above}{first}-{last}"] = rows
    if len(known) < len(moments):
        out["null"] = [i for i, t in enumerate(moments) if t is None]
    return out


def plain_files(rows, limit):
    """``{(leaf, part): [row, ...]}`` of rows ``(moment, first, second, ...)``, nulls first within a leaf."""
    out = {}
    for leaf, at in plain_leaves([r[0] for r in rows], limit).items():
        order = sorted(at, key=lambda i: (rows[i][0] or EPOCH, rows[i][1] is not None, rows[i][1] or 0, rows[i][2] is not None, rows[i][2] or 0))
        for j in range(0, len(order), limit):
            out[leaf, j // limit + 1] = [rows[i] for i in order[j : j + limit]]
    return out


def moved(ts, click):
    if ts is None or click is None:
        return ts
    k = zlib.crc32(str(click).encode()) % 128
    if k < 16:
        return ts - timedelta(days=(k + 6) ** 3)
    return datetime(ts.year, ts.month, ts.day) - timedelta(days=ts.weekday()) if k > 111 else ts


def test_query_against_plain_layout(spark):
    clicks = [tuple(r) for r in spark.read.parquet(f"{TINY}/clicks.parquet").select("ts", "arrived_at", "click_id").collect()]
    limit = 1 + len(clicks) // 650
    rows = [(moved(ts, c), a, c) for ts, a, c in clicks]
    cut = datetime(2024, 3, 1)
    start, final = plain_files([r for r in rows if r[1] < cut], limit), plain_files(rows, limit)
    got = {(r["leaf"], r["part"]): r for r in queries.op12_time_partitions(spark, TINY).collect()}
    assert set(got) == set(final)
    seen = set()
    for key, want in final.items():
        r = got[key]
        assert r["columns"] == "click_id,ts,arrived_at,client_id,kind,value,props"
        assert r["n_rows"] == len(want) and r["n_new"] == sum(x[1] >= cut for x in want)
        ids = ",".join(str(x[2]) for x in want)
        assert r["ids_sha256"] == hashlib.sha256(ids.encode()).hexdigest()
        assert r["rewritten"] == (start.get(key) != want)
        assert [str(x) for x in pq.read_table(r["path"].removeprefix("file:"), partitioning=None)["click_id"].to_pylist()] == ids.split(",")
        seen.add(r["path"])
    assert any(not r["rewritten"] for r in got.values()) and len(seen) == len(final)
    top = next(iter(seen)).removeprefix("file:").rsplit("/", 2)[0]
    import glob

    assert {f"file:{p}" for p in glob.glob(f"{top}/**/*.parquet", recursive=True)} == seen


@pytest.fixture
def order():
    return tp.Order(tp.micros(F.col("t")), tp.micros(F.col("file")), F.col("n"))


def many(seed, n):
    """Rows with ties, nulls, repeats, a crowded moment and far times; a column has the folders' name."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = rng.choice([None, datetime(2024, 1, 1), datetime(2024, 1, 1, 0, rng.randrange(3)), datetime(rng.randrange(1600, 2300), 1 + rng.randrange(12), 1 + rng.randrange(28), rng.randrange(24))])
        a = rng.choice([None, datetime(2024, 2, 1), datetime(2024, 2, rng.randrange(1, 4), 5)])
        out.append((t, a, rng.choice([None, -(2**62), 2**62, 7, i % 5]), rng.choice("xyz")))
    return out + out[: n // 4]


def write(spark, rows, parts=3):
    return spark.createDataFrame(rows, "t timestamp_ntz, file timestamp_ntz, n long, leaf string").repartition(parts)


@pytest.mark.parametrize("limit", [7, 40])
def test_updates_of_odd_rows(spark, tmp_path, order, limit):
    first, second = many(1, 80), many(2, 60)
    folder = f"file:{tmp_path}/layout"
    tp.update(write(spark, first), folder, order, limit)
    files = tp.update(write(spark, second), folder, order, limit)
    want = plain_files(first + second, limit)
    got = {(r["leaf"], r["part"]): r for r in files.collect()}
    assert set(got) == set(want)
    start = plain_files(first, limit)
    schema = write(spark, first).schema
    held = {}
    for r in tp.read(spark, folder, schema).orderBy("path", "place").collect():
        held.setdefault((r["leaf"], r["part"]), []).append(tuple(r["row"]))
    for key, rows in want.items():
        # Rows that tie in all of the order may lie either way; their keys may not.
        assert [x[:3] for x in held[key]] == [x[:3] for x in rows]
        if not got[key]["rewritten"]:
            assert [x[:3] for x in start[key]] == [x[:3] for x in rows] and got[key]["n_new"] == 0
    assert sorted(map(str, (x for rows in held.values() for x in rows))) == sorted(map(str, first + second))
    # Nothing new: all files stay.
    again = tp.update(write(spark, first).limit(0), folder, order, limit).collect()
    assert not any(r["rewritten"] or r["n_new"] for r in again) and len(again) == len(want)


def test_rows_all_alike_and_none(spark, tmp_path, order):
    folder = f"file:{tmp_path}/alike"
    assert tp.update(write(spark, [], 1), folder, order, 5).collect() == []
    row = (datetime(2024, 5, 5, 5, 5), datetime(2024, 5, 6), 1, "a")
    files = tp.update(write(spark, [row] * 103), folder, order, 10)
    assert {(r["leaf"], r["part"], r["n_rows"]) for r in files.collect()} == {("2024/05/05/05-05", j, 10 if j < 11 else 3) for j in range(1, 12)}
    with pytest.raises(ValueError):
        tp.update(write(spark, [row]), folder, order, 0)


def test_selection_finds_each_multiple(spark):
    """Boundaries of one crowded leaf are the rows of those ranks."""
    rng = np.random.default_rng(5)
    n = 5_000
    rows = sorted((5 * tp.HOUR + int(m), int(a), int(b), i) for i, (m, a, b) in enumerate(zip(rng.integers(0, 3, n), rng.integers(-(2**62), 2**62, n) * rng.integers(0, 2, n), rng.integers(-3, 3, n), strict=True)))
    keys = spark.createDataFrame([rows[i] for i in rng.permutation(n)], "m long, a long, b long, o long")
    found = tp.boundaries(keys, [tp.Leaf("x", n, 5 * tp.HOUR, 6 * tp.HOUR)], 300)
    assert found == {("x", j): rows[300 * j - 1] for j in range(1, n // 300 + 1)}
