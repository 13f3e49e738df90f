"""Secrets in texts, told from copied examples by who owns them, in DataFrame functions only.

Three patterns find the base spans: values assigned to a telling name, access
keys, and long hexadecimal strings. Beside them, other long strings that look
live (letters and digits mixed, no placeholder) are candidates. For each
candidate value, by a 128-bit hash, the corpus is asked in how many repositories
and by how many owners it occurs. A value of one owner alone is that owner's:
its places become ``owned`` spans where no base span lies. A value that many
owners have is an example that was copied from one to the next: it adds nothing,
and base spans with it are told as ``examples`` (they stay spans); base spans with
a value of one owner are told as ``live``.

A null text is the empty text. A null owner or repository is one without name.
Rows are judged one by one, repeated rows alike. Places are counted in code
points. Texts of any length are scanned whole; places are summed up in blocks,
so that a text of nothing but secrets costs little more than its length. Empty
tables give empty results. Other columns are left alone. Texts are never
shuffled; candidates are counted together for each owner and repository before
values meet, and the join of candidates with their values' counts may be split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifloom.llm.skew import digest
from motifloom.session import scratch, store

#: Kinds in the order that ties of places are listed in; the last is the one that ownership adds.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: What else may be a secret, and what in it makes it a placeholder.
OTHER = "[A-Za-z0-9+/_=-]{20,}"
PLACEHOLDER = "(?i:example|sample|dummy|placeholder|changeme|xxxx|1234567|abcdef)"
#: Lengths summed up at once.
BLOCK = 512

_SPANS = "array<struct<start: int, kind: int, end: int, value: string>>"


@dataclass(frozen=True)
class Ownership:
    """A value is owned with up to ``owners`` owners, and an example from ``copied`` owners on; ``digits``, ``letters``, ``different`` are the least characters of a live-looking one."""

    owners: int = 1
    copied: int = 3
    digits: int = 4
    letters: int = 4
    different: int = 8


def running(lengths: Column) -> Column:
    """The running sums of an array of integers; the work grows with its length, blocks are appended whole."""

    def within(start: Column, block: Column) -> Column:
        first = F.struct(start.alias("s"), F.array().cast("array<bigint>").alias("a"))
        return F.aggregate(block, first, lambda x, n: F.struct((x["s"] + n).alias("s"), F.concat(x["a"], F.array(x["s"] + n)).alias("a")))

    def over(x: Column, block: Column) -> Column:
        one = F.transform(F.array(within(x["s"], block)), lambda r: F.struct(r["s"].alias("s"), F.concat(x["a"], F.array(r["a"])).alias("a")))
        return F.element_at(one, 1)

    last = F.floor((F.size(lengths) - 1) / BLOCK)
    blocks = F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda b: F.slice(lengths, (b * BLOCK + 1).cast("int"), F.lit(BLOCK)))
    none = F.struct(F.lit(0).cast("bigint").alias("s"), F.array().cast("array<array<bigint>>").alias("a"))
    return F.when(F.size(lengths) > 0, F.flatten(F.aggregate(blocks, none, over)["a"])).otherwise(F.array().cast("array<bigint>"))


def matches(text: str, pattern: str, kind: int, group: int = 0) -> Column:
    """``(start, kind, end, value)`` of each match, leftmost and without overlaps; ``value`` is a group's text."""
    p = F.lit(pattern)
    found = F.zip_with(F.split(F.col(text), pattern, -1), F.regexp_extract_all(text, p, F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("n")))
    found = F.filter(found, lambda m: m["n"].isNotNull())  # the text after the last match has none
    ends = running(F.transform(found, lambda m: (m["gap"] + m["n"]).cast("bigint")))
    rows = F.arrays_zip(ends.alias("end"), F.transform(found, lambda m: m["n"]).alias("n"), F.regexp_extract_all(text, p, F.lit(group)).alias("value"))
    spans = F.transform(
        rows, lambda r: F.struct((r["end"] - r["n"]).cast("int").alias("start"), F.lit(kind).alias("kind"), r["end"].cast("int").alias("end"), r["value"].alias("value"))
    )
    return F.when(F.col(text).rlike(pattern), spans).otherwise(F.array().cast(_SPANS))


def looks_live(value: Column, rule: Ownership) -> Column:
    letters, digits = F.length(F.regexp_replace(value, "[^A-Za-z]+", "")), F.length(F.regexp_replace(value, "[^0-9]+", ""))
    different = F.size(F.array_distinct(F.split(value, "")))
    return (digits >= rule.digits) & (letters >= rule.letters) & (different >= rule.different) & ~value.rlike(PLACEHOLDER)


def scan(docs: DataFrame, rule: Ownership = Ownership(), id_col: str = "doc_id", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """``(id, owner, repository, base, others)`` of ``docs(text, ...)``: spans ``(start, kind, end, d0, d1)``, base ones by place."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"), F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.select(
        "id", "owner", "repository", F.filter(matches("text", ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= 6).alias("assign"),
        matches("text", ACCESS, 1).alias("access"), matches("text", HEX, 2).alias("hex"),
        F.filter(matches("text", OTHER, 3), lambda s: looks_live(s["value"], rule)).alias("others"),
    )

    def hashed(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), *digest(s["value"])))

    return rows.select("id", "owner", "repository", F.array_sort(hashed(F.concat("assign", "access", "hex"))).alias("base"), hashed(F.col("others")).alias("others"))


def ownership(places: DataFrame) -> DataFrame:
    """``(d0, d1, n_owners, n_repositories)`` of ``places(d0, d1, owner, repository, ...)``; a repository counts once for each owner."""
    each = places.select("d0", "d1", "owner", "repository").distinct()
    mine = each.groupBy("d0", "d1", "owner").agg(F.count("*").alias("n"))
    return mine.groupBy("d0", "d1").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def _free(places: DataFrame) -> DataFrame:
    """``places`` with ``free``: no base span of the same text overlaps it."""
    base = F.col("kind") < len(KINDS) - 1
    before = F.max(F.when(base, F.col("end"))).over(Window.partitionBy("uid").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(Window.partitionBy("uid").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0))
    rows = places.withColumns({"_before": before, "_after": after})
    return rows.withColumn("free", ~(F.coalesce(F.col("_before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_after") < F.col("end"), F.lit(False)))).drop("_before", "_after")


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, rule: Ownership = Ownership(), id_col: str = "doc_id", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """``(id, base, spans, live, examples)`` for each row of ``docs(text, ...)``.

    ``base`` and ``spans`` (with what ownership adds) are arrays of ``(start,
    kind, end)`` by place, ``kind`` a number in ``KINDS``; ``live`` are those of
    ``base`` whose value at most ``rule.owners`` owners have, ``examples`` those
    that at least ``rule.copied`` have.
    """
    spark = docs.sparkSession
    with scratch(spark):
        scanned = store(scan(docs, rule, id_col, owner, repository).withColumn("uid", F.monotonically_increasing_id()), "scanned").keep().read()
        some = F.size("base") + F.size("others") > 0
        places = scanned.where(some).select("uid", "owner", "repository", F.inline(F.concat("base", "others")))
        places = store(_free(places), "places").read()
        known = store(ownership(places), "ownership").read()
        place = F.struct("start", "kind", "end")
        few, many = F.col("n_owners") <= rule.owners, F.col("n_owners") >= rule.copied
        base = F.col("kind") < len(KINDS) - 1
        lists = {"added": ~base & F.col("free") & few, "live": base & few, "examples": base & many}
        told = places.join(known, ["d0", "d1"]).where(lists["added"] | lists["live"] | lists["examples"])
        told = told.groupBy("uid").agg(*[F.collect_list(F.when(c, place)).alias(n) for n, c in lists.items()])
        told = store(told, "told").keep().read()
    bare = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    rows = scanned.select("uid", "id", bare.alias("base"), some.alias("some"))
    none = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    with_places = rows.where("some").join(told, "uid", "left").withColumns({c: F.coalesce(c, none) for c in lists})
    without = rows.where("not some").withColumns(dict.fromkeys(lists, none))
    both = with_places.select(without.columns).union(without)
    return both.select("id", "base", F.array_sort(F.concat("base", "added")).alias("spans"), F.array_sort("live").alias("live"), F.array_sort("examples").alias("examples"))
