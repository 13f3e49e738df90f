"""Ground truth and result logs: text in, partitioned Parquet out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def graph_name(path: Column) -> Column:
    """The last part of a path, with either kind of slash."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """``(graph, line_no, type, cnt)`` of a file with lines ``path<TAB> c0<TAB> c1 ...``."""
    return parse_truth(spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line")))


def parse_truth(lines: DataFrame) -> DataFrame:
    """The same from ``lines(line_no, line)``."""
    parts = lines.where("trim(line) <> ''").select("line_no", F.split(F.trim("line"), r"\s+").alias("p"))
    numbers = F.filter(F.transform(F.slice("p", 2, F.size("p")), lambda x: x.try_cast("long")), lambda x: x.isNotNull())
    return parts.select(graph_name(F.col("p")[0]).alias("graph"), "line_no", F.posexplode(numbers).alias("type", "cnt"))


def first_lines(truth: DataFrame) -> DataFrame:
    """``(graph, type, cnt)`` of the first line of each graph."""
    first = Window.partitionBy("graph").orderBy("line_no")
    return truth.withColumn("r", F.dense_rank().over(first)).where("r = 1").select("graph", "type", "cnt")


def lookup(truth: DataFrame, graph: str) -> DataFrame:
    """``(graph, type, cnt)`` of the first line for a graph, given by name or path."""
    name = graph.replace("\\", "/").rsplit("/", 1)[-1]
    return first_lines(truth.where(F.col("graph") == name))


def lookup_all(truth: DataFrame, asked: DataFrame) -> DataFrame:
    """The same for every graph of ``asked(path)``; once for each name, nothing for unknown ones or null."""
    return first_lines(truth.join(asked.select(graph_name(F.col("path")).alias("graph")), "graph", "left_semi"))


def write_truth(counts: DataFrame, graph: str, k: int, path: str) -> None:
    """Replace the counts ``(type, cnt)`` of one graph and size in a table partitioned by both."""
    rows = counts.select("type", "cnt", F.lit(graph).alias("graph"), F.lit(k).alias("k"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("graph", "k").parquet(path)


def append_metrics(metrics: DataFrame, graph: str, k: int, path: str) -> None:
    """Append ``(variant, steps, type, RV, RE, LB, UB, NRMSE)`` in long form, a folder for each size and metric."""
    long = metrics.unpivot(["variant", "steps", "type"], ["RV", "RE", "LB", "UB", "NRMSE"], "metric", "value")
    long.select("*", F.lit(graph).alias("graph"), F.lit(k).alias("k")).write.mode("append").partitionBy("k", "metric").parquet(path)
