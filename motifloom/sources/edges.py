"""Where graphs come from: edge-list text and pairs derived from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_edge_list(spark: SparkSession, path: str, header: str | None = None) -> DataFrame:
    """``raw(src, dst)`` from text: a header ``n m``, then a line ``u v [weight]`` for each edge.

    The header is the first line of the file, or of another file named by
    ``header``. Lines that don't begin with two integers below ``n`` are left out
    (the header is one of them, as it begins with ``n``; ids have at most 18
    digits, so ``n`` may have as many); a third column is ignored. Loops and
    repeats stay. An empty file has no rows.
    """
    top = spark.read.text(header or path).limit(1).collect()
    head = top[0].value.split() if top else ["0", "0"]
    if len(head) < 2 or not all(h.isdigit() for h in head[:2]) or len(head[0]) > 18:
        raise ValueError(f"the first line should be 'n m': {top[0].value[:80]}")
    lines = spark.read.text(path)
    ends = [F.regexp_extract("value", r"^\s*(\d{1,18})\s+(\d{1,18})(?:\s|$)", i) for i in (1, 2)]
    rows = lines.select(*[F.nullif(e, F.lit("")).cast("long").alias(c) for e, c in zip(ends, ("src", "dst"), strict=True)])
    n = int(head[0])
    return rows.where((F.col("src") < n) & (F.col("dst") < n))


def write_edge_list(raw: DataFrame, nodes: int, path: str) -> None:
    """Write ``raw(src, dst)`` as text: ``path/edges``, and the line ``n m`` in ``path/header``."""
    raw.select(F.concat_ws(" ", "src", "dst")).write.text(f"{path}/edges")
    spark = raw.sparkSession
    written = spark.read.text(f"{path}/edges").count()
    spark.createDataFrame([(f"{nodes} {written}",)], "line string").coalesce(1).write.text(f"{path}/header")


def _members(rows: DataFrame) -> DataFrame:
    """Each different row of ``rows(g, m)`` once, with ``all``: the different members of its group.

    One sort by group serves both; a join of the groups' rows with themselves would
    sort them twice, and drop repeats by hash tables of all rows.
    """
    along = Window.partitionBy("g").orderBy("m")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = rows.select("g", "m", F.collect_set("m").over(whole).alias("all"), F.lag("m").over(along).alias("before"))
    return marked.where(~F.col("m").eqNullSafe(F.col("before"))).drop("before")


def from_pairs(rows: DataFrame, group: str, member: str) -> DataFrame:
    """``raw(src, dst)``: members that share a group, each pair of a group once, smaller first."""
    slim = rows.select(F.col(group).alias("g"), F.col(member).alias("m")).where("g is not null and m is not null")
    return _members(slim).select(F.col("m").alias("src"), F.explode(F.expr("filter(all, x -> x > m)")).alias("dst"))


def co_purchase(spark: SparkSession, sf_dir: str, quantity: float = 0) -> DataFrame:
    """``raw(src, dst)``: parts bought in one order, both in lines of at least ``quantity``."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.col("l_quantity") >= quantity)
    return from_pairs(lines, "l_orderkey", "l_partkey")


def shipped_together(spark: SparkSession, sf_dir: str, days: int = 30) -> DataFrame:
    """``raw(src, dst)``: parts of one order that ship at most ``days`` days apart, each pair of an order once, smaller first."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines = lines.where("l_orderkey is not null and l_partkey is not null")
    slim = lines.select(F.col("l_orderkey").alias("g"), F.struct(F.col("l_partkey").alias("part"), F.to_date("l_shipdate").alias("day")).alias("m"))
    near = f"filter(all, x -> x.part > m.part and abs(datediff(x.day, m.day)) <= {days})"
    pairs = _members(slim).select("g", F.col("m.part").alias("src"), F.explode(F.expr(near)).alias("o")).select("g", "src", F.col("o.part").alias("dst"))
    return pairs.distinct().select("src", "dst")
