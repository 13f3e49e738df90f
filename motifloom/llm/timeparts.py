"""Adaptive time partitions: a folder of Parquet files that follow the rows' times.

Rows lie in leaves of time. The years from the first to the last moment are
siblings; a node above the limit is split into all its months, days or hours;
siblings within the limit join the run before them while that stays within it. A
leaf's rows, in order of moment and two further columns, fill files of ``limit``
rows each. ``update`` adds rows to a folder and lays all of it out anew; a file
whose leaf, part and rows stay the same is left alone.

Files' first rows are found by a radix selection: for each multiple of the limit
in a large leaf, one pass counts the rows of each of 1,024 digits below what is
known of the boundary's key, picks the digit that holds it, and narrows to the
least and largest key there, until one row is left. Rows equal in all three
columns are told apart by an ordinal that they get when they are stored: rows of
the folder by part and place, new ones after them. Rows then find their file by
a search among all boundaries; nothing is ranked.

What the driver holds is bounded by the number of files asked for, not by the
rows: with ``rows / limit`` = p there are at most p boundaries, at most p nodes
above the limit on each level, each with at most 31 children, and as two runs in
a row exceed the limit, no more leaves than twice p and one for each split node.
The years between the first and the last moment are listed on top.

Rows whose moment is null are the leaf ``null``; nulls in the two other columns
come first. Repeated rows are kept. A table of any columns will do; the folders'
names avoid them. With no rows there are no files. Executors may be lost at any
time: keys and ordinals are read from a stored table, and Spark commits files as
a whole. Old files go after the new ones are there; if the driver is lost in
between, a folder has both, and is to be built anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from motifloom.session import delete, exists, scratch, store

HOUR = 3_600_000_000
DAY = 24 * HOUR
LEAST, MOST = -(2**63), 2**63 - 1
#: Digits that one pass of the selection tells apart, in bits.
BITS = 10
KEY = ("m", "a", "b", "o")


def micros(time: Column) -> Column:
    """Microseconds from 1970 on of a time as its clock shows it, in any time zone of the session."""
    day = F.unix_date(F.to_date(time)).cast("long")
    second = (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("long")
    return day * DAY + F.hour(time).cast("long") * HOUR + F.minute(time).cast("long") * (HOUR // 60) + second


@dataclass(frozen=True)
class Order:
    """What orders rows: a moment in microseconds, and two whole numbers; all are columns of the table's rows."""

    moment: Column
    first: Column
    second: Column

    def key(self, ordinal: Column) -> list[Column]:
        least = F.lit(LEAST).cast("long")
        rest = [F.coalesce(c.cast("long"), least) for c in (self.first, self.second)]
        return [c.alias(n) for n, c in zip(KEY, (F.coalesce(self.moment, F.lit(MOST).cast("long")), *rest, ordinal), strict=True)]


@dataclass
class Leaf:
    """A run of siblings: its name, rows, and bounds in microseconds (the end excluded)."""

    name: str
    rows: int
    begin: int
    end: int


@dataclass
class File:
    """A file to be: the key of its last row, or one after it and before the next file's."""

    leaf: str
    part: int
    last: tuple[int, ...]


# ---- leaves


def _days(unit: str, n: int) -> int:
    """The first day, from 1970 on, of a year or month counted from 1970 on."""
    return int(np.datetime64(n, unit).astype("datetime64[D]").astype(int))


def _begin(level: int, n: int) -> int:
    """The first microsecond of a node: years and months by number, days and hours from 1970 on."""
    if level < 2:
        return _days("YM"[level], n - (1970, 12 * 1970)[level]) * DAY
    return n * (DAY if level == 2 else HOUR)


def _children(level: int, n: int) -> range:
    """Numbers of a node's children, one level below."""
    if level == 0:
        return range(12 * n, 12 * n + 12)
    if level == 1:
        return range(_days("M", n - 12 * 1970), _days("M", n + 1 - 12 * 1970))
    return range(24 * n, 24 * n + 24)


def _label(level: int, n: int) -> str:
    if level == 0:
        return f"{n:04d}"
    if level == 1:
        return f"{n % 12 + 1:02d}"
    if level == 2:
        return f"{int((np.datetime64(n, 'D') - np.datetime64(n, 'D').astype('datetime64[M]')).astype(int)) + 1:02d}"
    return f"{n % 24:02d}"


_NODES = ("year(day)", "year(day) * 12L + month(day) - 1", "unix_date(day)", "h")


def time_leaves(keys: DataFrame, limit: int) -> list[Leaf]:
    """The leaves of ``keys(m, ...)`` in order of time, the one without moments last."""
    hour = F.expr(f"(m - pmod(m, {HOUR}L)) div {HOUR}L")
    hours = store(keys.groupBy(F.when(F.col("m") < MOST, hour).alias("h")).agg(F.count("*").alias("n")), "hours").read()
    hours = hours.withColumn("day", F.date_from_unix_date(F.expr("int((h - pmod(h, 24)) div 24)")))
    counts: list[dict[int, int]] = []
    for level, node in enumerate(_NODES):
        large = [n for n, c in counts[-1].items() if c > limit] if level else None
        at = hours.where("h is not null")
        at = at if large is None else at.where(F.expr(_NODES[level - 1]).isin(large)) if large else at.limit(0)
        counts.append({r["n"]: r["c"] for r in at.groupBy(F.expr(node).cast("long").alias("n")).agg(F.sum("n").alias("c")).collect()})
    none = hours.where("h is null").agg(F.sum("n").alias("n")).first()["n"] or 0
    out: list[Leaf] = []

    def walk(level: int, nodes: range, above: str) -> None:
        run: Leaf | None = None
        for n in nodes:
            c = counts[level].get(n, 0)
            if c > limit and level < 3:
                run = None
                walk(level + 1, _children(level, n), f"{above}{_label(level, n)}/")
            elif run is not None and run.rows + c <= limit:
                run.rows, run.end = run.rows + c, _begin(level, n + 1)
                run.name = run.name.rpartition("-")[0] + "-" + _label(level, n)
            else:
                label = _label(level, n)
                run = Leaf(f"{above}{label}-{label}", c, _begin(level, n), _begin(level, n + 1))
                out.append(run)

    if counts[0]:
        walk(0, range(min(counts[0]), max(counts[0]) + 1), "")
    return [x for x in out if x.rows] + ([Leaf("null", none, MOST, MOST)] if none else [])


# ---- boundaries


def _before(bounds: np.ndarray, key: list[np.ndarray]) -> np.ndarray:
    """How many of ``bounds``, rows of keys in order, are before each key: a binary search of all at once."""
    low, high = np.zeros(len(key[0]), np.int64), np.full(len(key[0]), len(bounds), np.int64)
    while (low < high).any():
        middle = np.minimum((low + high) >> 1, len(bounds) - 1)
        less, same = np.zeros(len(low), bool), np.ones(len(low), bool)
        for i, x in enumerate(key):
            b = bounds[middle, i]
            less |= same & (b < x)
            same &= b == x
        go = low < high
        low = np.where(go & less, middle + 1, low)
        high = np.where(go & ~less, middle, high)
    return low


def place(lows: list[tuple] | None, lasts: list[tuple]) -> Column:
    """The number of the interval that a row's key lies in: intervals in order, by their last keys; -1 outside of them if ``lows`` are given."""
    high = np.array(lasts, np.int64).reshape(-1, len(KEY))
    low = None if lows is None else np.array(lows, np.int64).reshape(-1, len(KEY))

    @F.pandas_udf("int")
    def found(m: pd.Series, a: pd.Series, b: pd.Series, o: pd.Series) -> pd.Series:
        key = [x.to_numpy(np.int64) for x in (m, a, b, o)]
        at = _before(high, key)
        if low is not None:  # the low keys up to a key are one more than the intervals before its own
            after = len(low) - _before(-1 - low[::-1], [-1 - x for x in key])
            at = np.where((at < len(high)) & (after == at + 1), at, -1)
        return pd.Series(at, dtype="int32")

    return found(*KEY)


def boundaries(keys: DataFrame, leaves: list[Leaf], limit: int) -> dict[tuple[str, int], tuple[int, ...]]:
    """By leaf and multiple j: the key of row ``j * limit`` of each leaf with more rows, by radix selection.

    ``keys(m, a, b, o)``, no two alike. A state is a range of keys with the
    ranks sought in it; states never overlap.
    """
    large = [x for x in leaves if x.rows > limit]
    if not large:
        return {}
    spark = keys.sparkSession
    held = F.expr(f"(m - pmod(m, {HOUR}L)) div {HOUR}L").isin([x.begin // HOUR for x in large if x.name != "null"])
    if any(x.name == "null" for x in large):
        held = held | (F.col("m") == MOST)
    keys = store(keys.where(held).select(*KEY), "large").read()
    rest_low, rest_high = (LEAST,) * 3, (MOST,) * 3
    states = [((x.begin, *rest_low), (max(x.begin, x.end - 1), *rest_high), [(r, (x.name, r // limit)) for r in range(limit, x.rows, limit)]) for x in large]
    out: dict[tuple[str, int], tuple[int, ...]] = {}
    while states:
        states.sort()
        rows = []
        for i, (low, high, sought) in enumerate(states):
            field = next(f for f in range(len(KEY)) if low[f] != high[f])
            rows.append((i, field, max(0, (low[field] ^ high[field] if low[field] ^ high[field] >= 0 else 2**63).bit_length() - BITS), [r for r, _ in sought]))
        dim = F.broadcast(spark.createDataFrame(rows, "s int, field int, shift int, ranks array<long>"))
        at = keys.withColumn("s", place([x[0] for x in states], [x[1] for x in states])).where("s >= 0").join(dim, "s")
        value = "case field when 0 then m when 1 then a when 2 then b else o end"
        digit = F.expr(f"shiftrightunsigned(({value}) ^ shiftleft(1L, 63), shift) & {2**BITS - 1}")
        bounds = [f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in KEY]
        cells = at.groupBy("s", digit.alias("digit")).agg(F.count("*").alias("n"), *bounds)
        cells = cells.withColumn("upto", F.sum("n").over(Window.partitionBy("s").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)))
        hit = cells.join(dim.select("s", "ranks"), "s").where("exists(ranks, r -> r > upto - n and r <= upto)")
        found = hit.drop("ranks").collect()  # one row for each boundary at most
        ahead = []
        for r in found:
            before = r["upto"] - r["n"]
            sought = [(x - before, name) for x, name in states[r["s"]][2] if before < x <= r["upto"]]
            low, high = (tuple(r[f"{f}_{c}"] for c in KEY) for f in ("min", "max"))
            if r["n"] == 1:
                out[sought[0][1]] = low
            else:
                ahead.append((low, high, sought))
        states = ahead
    return out


def plan(keys: DataFrame, limit: int) -> list[File]:
    """The files for ``keys(m, a, b, o)``, in order of their keys."""
    leaves = time_leaves(keys, limit)
    cut = boundaries(keys, leaves, limit)
    out = []
    for x in leaves:
        parts = -(-x.rows // limit)
        last = (MOST if x.name == "null" else x.end - 1, MOST, MOST, MOST)
        out += [File(x.name, j, cut[x.name, j] if j < parts else last) for j in range(1, parts + 1)]
    return out


# ---- files


def _folder(columns: list[str]) -> str:
    """The folders' key, one folder for each file: a name that is no column of the table."""
    name = "file"
    while name in {c.lower() for c in columns}:
        name += "_"
    return name


def read(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """``(row, leaf, part, path, place)`` of the folder's rows; ``row`` has the table's columns."""
    name = _folder(schema.names)
    df = spark.read.schema(StructType(list(schema.fields)).add(name, StringType())).parquet(folder)
    row = F.struct(*[F.col(f"`{c}`") for c in schema.names])
    leaf, part = (F.regexp_extract(name, r"^(.*)\.([0-9]+)$", i) for i in (1, 2))
    return df.select(
        row.alias("row"), F.translate(leaf, ".", "/").alias("leaf"), part.cast("int").alias("part"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("place")
    )


def update(new: DataFrame, folder: str, order: Order, limit: int) -> DataFrame:
    """Add the rows of ``new`` to ``folder``, which may not exist yet, and lay all of it out anew.

    Returns ``(leaf, part, n_rows, n_new, rewritten)`` for each file that is
    there now; ``n_new`` of its rows came with ``new``.
    """
    spark, schema = new.sparkSession, new.schema
    if limit < 1:
        raise ValueError("a file has one row at least")
    with scratch(spark):
        names = [F.col(f"`{c}`") for c in new.columns]
        fresh = F.lit(2**62).cast("long") + F.monotonically_increasing_id()
        nowhere = [F.lit(None).cast("string").alias("leaf0"), F.lit(None).cast("int").alias("part0")]
        rows = new.select(F.struct(*names).alias("row"), *order.key(fresh), *nowhere)
        before: dict[tuple[str, int], str] = {}
        if exists(spark, folder):
            old = read(spark, folder, schema)
            inside = old.select("row.*", *[F.col(c).alias(f"__{c}") for c in ("leaf", "part", "place")])
            ordinal = F.shiftleft(F.col("__part").cast("long"), 40) + F.col("__place")
            rows = rows.union(inside.select(F.struct(*names).alias("row"), *order.key(ordinal), F.col("__leaf"), F.col("__part")))
            before = {(r["leaf"], r["part"]): r["path"] for r in old.select("leaf", "part", "path").distinct().collect()}
        rows = store(rows, "rows").read()
        files = plan(rows.select(*KEY), limit)
        if not files:
            return spark.createDataFrame([], "leaf string, part int, n_rows long, n_new long, rewritten boolean")
        named = spark.createDataFrame([(i, f.leaf, f.part) for i, f in enumerate(files)], "file int, leaf string, part int")
        placed = rows.withColumn("file", place(None, [f.last for f in files]))
        counted = placed.groupBy("file", "leaf0", "part0").agg(F.count("*").alias("n")).collect()  # bounded by the files, old and new
        had: dict[tuple, int] = {}
        for r in counted:
            had[r["leaf0"], r["part0"]] = had.get((r["leaf0"], r["part0"]), 0) + r["n"]
        sizes = {i: [0, 0, 0] for i in range(len(files))}
        for r in counted:
            f = files[r["file"]]
            size = sizes[r["file"]]
            size[0] += r["n"]
            size[1] += r["n"] if r["leaf0"] is None else 0
            size[2] += r["n"] if (r["leaf0"], r["part0"]) == (f.leaf, f.part) else 0
        stays = {i for i, (n, _, same) in sizes.items() if n == same == had.get((files[i].leaf, files[i].part))}
        name = _folder(new.columns)
        folders = F.broadcast(named.where(~F.col("file").isin(sorted(stays))) if stays else named)
        folders = folders.select("file", F.coalesce(F.concat_ws(".", F.translate("leaf", "/", "."), "part"), F.lit("")).alias("folder"))
        # Sorted as the writer wants its folders, so that it keeps this order within each file.
        moved = placed.join(folders, "file").repartition("folder").sortWithinPartitions("folder", *KEY)
        if len(stays) < len(files):
            moved.select("row.*", F.col("folder").alias(name)).write.mode("append").partitionBy(name).parquet(folder)
        kept = {(files[i].leaf, files[i].part) for i in stays}
        for at, path in before.items():
            if at not in kept:
                delete(spark, path)
    told = [(f.leaf, f.part, sizes[i][0], sizes[i][1], i not in stays) for i, f in enumerate(files)]
    return spark.createDataFrame(told, "leaf string, part int, n_rows long, n_new long, rewritten boolean")


def contents(spark: SparkSession, folder: str, schema: StructType, column: str) -> DataFrame:
    """``(leaf, part, path, n_rows, sha256)`` of each file, read back: the digest of a column's values as text, comma-joined in file order; null is empty text."""
    rows = read(spark, folder, schema)
    rows = rows.select("leaf", "part", "path", "place", F.coalesce(F.col("row")[column].cast("string"), F.lit("")).alias("value"))
    rows = rows.repartition("path").sortWithinPartitions("path", "place")
    return rows.mapInPandas(_digests, "leaf string, part int, path string, n_rows long, sha256 string")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each file; its values are hashed as they come."""
    now, hashed, n = None, None, 0
    for batch in batches:
        starts = np.flatnonzero((batch["path"] != batch["path"].shift()).to_numpy())
        for i, j in zip(starts, [*starts[1:], len(batch)], strict=True):
            here = tuple(batch[c].iloc[i] for c in ("leaf", "part", "path"))
            text = ",".join(batch["value"].iloc[i:j])
            if here == now:
                hashed.update(b",")
            else:
                if now is not None:
                    yield pd.DataFrame([(*now, n, hashed.hexdigest())], columns=["leaf", "part", "path", "n_rows", "sha256"])
                now, hashed, n = here, hashlib.sha256(), 0
            hashed.update(text.encode())
            n += j - i
    if now is not None:
        yield pd.DataFrame([(*now, n, hashed.hexdigest())], columns=["leaf", "part", "path", "n_rows", "sha256"])
