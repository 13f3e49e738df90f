"""How quality filters interact: who fails what, under every order of the filters.

Five filters mark a document: A too short, B too repetitive, C too many capitals,
D odd symbols, E a copy of a text with a smaller id. Each document becomes one
number whose bits are the filters it fails. All that an order of filters keeps,
removes or would have removed follows from how many documents of a part have
each of the 32 numbers, so the texts are read once, whatever the number of
orders: ``failures`` makes the masks, ``cells`` the histogram of each part,
``interactions`` the 120 orders.

A null text is the empty text, a null part the empty string. Rows that share
an id are judged on their own; the one is no copy of the other, as neither id is
smaller. A null id is no copy and makes no copies, and has no labels. Where
labels repeat for an id, one row with the mark is enough. Empty tables give
empty results. A text of any length is judged whole, by one pass for each
condition; texts are shuffled as SHA-256 digests, never themselves, and rows are
counted together before each shuffle, so that a text, an id or a part that most
rows share stays small. Other columns of the tables are left alone.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifloom.session import scratch, store

LETTERS = "ABCDE"


@dataclass(frozen=True)
class Limits:
    """What the filters fail: words under ``words``, different words under ``distinct`` percent, capitals over ``capitals`` percent of the characters, any of ``symbols``."""

    words: int = 200
    distinct: int = 50
    capitals: int = 2
    symbols: str = r"[#$%&*|]"


def failures(docs: DataFrame, limits: Limits = Limits(), part: str = "source") -> DataFrame:
    """``(doc_id, part, mask, d)`` of ``docs(doc_id, text, ...)``: bits 0 to 3 for the filters A to D, and the text's digest."""
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    n = F.size("words").cast("long")
    fails = (
        n < limits.words,
        100 * F.size(F.array_distinct("words")).cast("long") < limits.distinct * n,
        100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long") > limits.capitals * F.length("text").cast("long"),
        F.col("text").rlike(limits.symbols),
    )
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("d"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows(doc_id, ...)`` with ``good`` and ``toxic``, 0 or 1."""
    known = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id")
    known = known.agg(F.max(F.expr("int(quality = 1)")).alias("good"), F.max(F.expr("int(toxic = 1)")).alias("toxic"))
    # Stored, so that adaptive execution may split an id with very many rows.
    known = store(known, "labels").read()
    marks = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    named, others = rows.where("doc_id is not null"), rows.where("doc_id is null")
    return named.join(known, "doc_id", "left").select(*rows.columns, *marks).union(others.select(*rows.columns, F.lit(0), F.lit(0)))


def cells(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), part: str = "source") -> DataFrame:
    """``(part, mask, n, n_good, n_toxic)``: documents with each mask of the five filters, without zeros."""
    rows = failures(docs, limits, part)
    ids = store(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), "failures").read()
    # Rows of one text, counted for each part and label; how many of them have the least id is kept beside it.
    groups = with_labels(ids, labels).groupBy("d", "part", "mask", "good", "toxic")
    nameless = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    groups = groups.agg(F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"), nameless.alias("nameless"), F.sum("n").alias("n"))
    first = F.min("least").over(Window.partitionBy("d"))
    groups = groups.withColumn("firsts", F.col("nameless") + F.when(F.col("least") == first, F.col("n_least")).otherwise(0))
    split = F.array(
        F.struct("mask", F.col("firsts").alias("n")), F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - F.col("firsts")).alias("n"))
    )
    each = groups.select("part", "good", "toxic", F.inline(split)).where("n > 0")
    sums = [F.sum(x).alias(n) for n, x in (("n", F.col("n")), ("n_good", F.col("n") * F.col("good")), ("n_toxic", F.col("n") * F.col("toxic")))]
    return each.groupBy("part", "mask").agg(*sums)


def _steps() -> Column:
    """The 600 steps of the 120 orders: ``(filter_order, step, before, bit)``, as one constant array."""
    out = []
    for order in permutations(range(len(LETTERS))):
        name = "".join(LETTERS[i] for i in order)
        for step, i in enumerate(order):
            out.append({"filter_order": name, "step": step + 1, "before": sum(1 << j for j in order[:step]), "bit": 1 << i})
    return F.from_json(F.lit(json.dumps(out)), "array<struct<filter_order: string, step: int, before: int, bit: int>>")


def interactions(counted: DataFrame) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)`` of ``cells``.

    600 rows for each part. ``shapley`` is the sum over all orders of what the
    step's filter removes: of the documents that fail k filters it is the first
    in 120 / k orders.
    """
    size = 1 << len(LETTERS)
    rows = [F.array(*[F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for m in range(size)]).alias(c) for c in ("n", "n_good", "n_toxic")]
    parts = counted.groupBy("part").agg(*rows)

    def total(of: str, where: str, weight: str = "") -> Column:
        return F.expr(f"aggregate(sequence(0, {size - 1}), 0L, (s, m) -> s + case when {where} then {of}[m]{weight} else 0L end)")

    removed = "(m & before) = 0 and (m & bit) <> 0"
    steps = parts.select("part", "n", "n_good", "n_toxic", F.inline(_steps()))
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("n", "(m & (before | bit)) = 0").alias("kept"),
        total("n", removed).alias("removed"),
        total("n", "(m & before) <> 0 and (m & bit) <> 0").alias("redundant"),
        F.expr("n[bit]").alias("unique_fails"),
        total("n_good", removed).alias("good_lost"),
        total("n_toxic", removed).alias("toxic_lost"),
        total("n", "(m & bit) <> 0", " * (120 div bit_count(m))").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), part: str = "source") -> DataFrame:
    """``interactions`` of ``docs(doc_id, text, ...)`` with ``labels(doc_id, quality, toxic)``."""
    with scratch(docs.sparkSession):
        counted = store(cells(docs, labels, limits, part), "cells").keep()
    return interactions(counted.read())
