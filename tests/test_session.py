"""Intermediate tables: what they leave behind, and when they go."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from motifloom.session import scratch, short_lived_shuffles, store

SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def there(path: str) -> bool:
    return Path(path.removeprefix("file:").replace("///", "/")).exists()


def counts(spark):
    return spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()


def test_tables_of_a_block_go_with_it(spark):
    with scratch(spark):
        gone, kept = store(counts(spark), "gone"), store(counts(spark), "kept").keep()
        assert gone.read().count() == 7
    assert not there(gone.path)
    assert kept.read().count() == 7
    kept.drop()
    assert not there(kept.path)


def test_tables_go_when_a_block_fails(spark):
    with pytest.raises(ValueError), scratch(spark):
        table = store(counts(spark), "failed")
        raise ValueError
    assert not there(table.path)


def test_settings_of_the_session_are_put_back(spark):
    before = spark.conf.get(SETTING)
    with short_lived_shuffles(spark):
        assert spark.conf.get(SETTING) == "true"
    with pytest.raises(ValueError), scratch(spark):
        raise ValueError
    store(counts(spark), "once").drop()
    assert spark.conf.get(SETTING) == before


def test_stored_tables_leave_no_shuffle(spark):
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    tables = [store(counts(spark), "many") for _ in range(5)]
    assert tracker.shuffleStatuses().size() <= before
    for t in tables:
        t.drop()


def test_tables_made_in_a_block_can_be_read_repeatedly(spark):
    with scratch(spark):
        made = counts(spark).join(spark.range(7).withColumnRenamed("id", "k"), "k").groupBy("count").agg(F.count("*").alias("n"))
    assert made.collect() == made.collect()
    assert made.count() == made.count()
    assert made.toPandas()["n"].sum() == 7
