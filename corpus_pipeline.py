"""The corpus pipeline: stages over ``documents``, each one operator at work.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its
predecessor kept; what it returns is written as Parquet and read again as the
next one's ``docs``. All stages but the last return the columns of
``documents``. Rows with a null id are never grouped with others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.llm import bpe, copies as near, decontaminate, lines, toxicity
from motifloom.llm.queries import table, tokenizer
from motifloom.session import exists, let_workers_import, scratch, store


def packed(docs: DataFrame) -> DataFrame:
    """Id and text, and all else in one column that operators hand through."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *others).alias("_rest"))


def unpacked(rows: DataFrame, docs: DataFrame) -> list:
    """The columns of ``docs`` from rows of ``packed(docs)``."""
    return [rows[c] if c in ("doc_id", "text") else rows["_rest"][c].alias(c) for c in docs.columns]


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, calls toxic go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(packed(docs), model).where("predicted = 0")
    return out.select(unpacked(out, docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for the first of each; texts may become empty."""
    let_workers_import(spark)
    out = lines.dedup_lines(packed(docs))
    out = out.select(unpacked(out, docs))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def entered(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, text)`` of ``docs`` as they entered the pipeline, if all lines that they have now come from there."""
    whole = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("whole")).where("doc_id is not null and whole is not null")
    both = docs.select("doc_id", "text").join(whole.hint("merge"), "doc_id", "left")
    left = F.array_except(F.split(F.coalesce("text", F.lit("")), "\n"), F.concat(F.split("whole", "\n"), F.array(F.lit(""))))
    return both.select("doc_id", F.when(F.size(left) == 0, F.col("whole")).otherwise(F.col("text")).alias("text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near copies stays: five-word shingles, similarity 0.8.

    Texts are compared as they are now; those that stay, once more as they
    entered the pipeline, as line dedup leaves of a later copy only the lines in
    which it differs. Where ``sf_dir`` has no documents, they are only compared
    as they are now.
    """
    let_workers_import(spark)
    copies = near.near_copies(docs).where("component_id <> doc_id").select("doc_id")
    if not exists(spark, f"{sf_dir}/documents.parquet"):
        return docs.join(copies.hint("merge"), "doc_id", "left_anti").select(docs.columns)
    with scratch(spark):
        stay = docs.join(copies.hint("merge"), "doc_id", "left_anti")
        whole = store(entered(spark, stay, sf_dir), "whole-texts").read()
        groups = near.near_copies(whole)
    again = groups.where("component_id <> doc_id").select("doc_id")
    return docs.join(copies.union(again).hint("merge"), "doc_id", "left_anti").select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a ten-word passage of a test item go."""
    out = decontaminate.decontaminate(packed(docs), table(spark, sf_dir, "benchmark")).where("n_hit = 0")
    return out.select(unpacked(out, docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids, their number, and whether they decode to the text."""
    let_workers_import(spark)
    out = bpe.encode(packed(docs), *tokenizer())
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return out.select(*unpacked(out, docs), F.size("tokens").cast("long").alias("n_tokens"), same.alias("round_trip"), "tokens")


STAGES = [
    ("toxicity", toxicity_filter),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE", tokenize),
]

#: Not expressible in SQL: a fitted classifier and a byte-pair encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each over the written result of the one before.

    A stage's result goes as soon as the next one's is written, or if that fails.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        try:
            after = store(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        finally:
            if before is not None:
                before.drop()
        docs, before = after.read(), after
    return STAGES[-1][1](spark, docs, sf_dir)
