"""Dealing out the rows of large keys, and keys for rows that may have none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifloom.session import store

#: Most keys of large buckets that are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 20_000


def digest(*cols: Column) -> list[Column]:
    """A 128-bit digest of a row's columns as two longs named ``d0`` and ``d1``."""
    return [F.xxhash64(F.lit(seed), *cols).alias(name) for seed, name in ((1, "d0"), (2, "d1"))]


def cells(keyed: DataFrame, most: int, spread: str) -> DataFrame:
    """Give each row of ``keyed(key, ...)`` the cells it is compared in.

    A key with at most ``most`` rows is one cell. A larger one is cut into
    chunks of about half of that by a hash of ``spread``, and each pair of
    chunks is a cell: any two rows of a key meet in one cell at least. The
    large keys are broadcast only if there are few of them.
    """
    hot = keyed.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > most)
    hot = store(hot.select("key", F.ceil(F.col("rows") / (most / 2)).cast("int").alias("parts")), "hot").read()
    n_hot = hot.count()
    if not n_hot:
        return keyed.withColumn("cell", F.lit(0))
    hot = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
    mine = F.expr(f"cast(pmod(xxhash64({spread}), parts) as int)")
    pairs = F.expr(
        "case when parts is null then array(0) else"
        " transform(filter(sequence(0, parts - 1), x -> x <> mine), x -> least(x, mine) * parts + greatest(x, mine)) end"
    )
    return keyed.join(hot, "key", "left").withColumn("mine", mine).withColumn("cell", F.explode(pairs)).drop("parts", "mine")
