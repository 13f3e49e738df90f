"""Session helpers: shared intermediate tables and worker imports."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parent.parent)


#: Rows travel to Python in batches of about so many bytes, whatever their number.
BATCH_BYTES = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def let_workers_import(spark: SparkSession) -> None:
    """Put this package on the Python path that Spark hands to its workers, and bound the batches they get."""
    for name, (default, ours) in BATCH_BYTES.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, ours)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share for intermediate tables.

    It is what ``spark.checkpoint.dir`` names. Only a local master, where all
    threads share one disk, may go without that setting.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="motifloom-")
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


_open = threading.local()


class Stored:
    """A table written to the shared folder, dropped by ``drop``, with its scratch block, or at exit."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.block = getattr(_open, "block", None)
        if self.block is not None:
            self.block.append(self)
        atexit.register(self.drop)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def keep(self) -> Stored:
        """Let the table outlive its scratch block."""
        if self.block is not None:
            self.block.remove(self)
            self.block = None
        return self

    def drop(self) -> None:
        try:
            delete(self.spark, self.path)
        except Exception:  # the session may have ended before the process does
            pass
        atexit.unregister(self.drop)


#: Spark drops the shuffle files of a query at its end, and does not wait for the driver's collector.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """A block whose queries leave no shuffle files behind."""
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN_UP, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A block whose stored tables are dropped at its end, but for those kept."""
    outer = getattr(_open, "block", None)
    _open.block = mine = []
    try:
        with short_lived_shuffles(spark):
            yield
    finally:
        _open.block = outer
        for table in list(mine):
            table.drop()


def store(df: DataFrame, label: str) -> Stored:
    """Write ``df`` to the shared folder, which cuts its lineage."""
    return store_all([(df, label)])[0]


def store_all(frames: list[tuple[DataFrame, str]]) -> list[Stored]:
    """Write some tables that don't depend on one another, a few at once, so that small ones don't wait for each other."""
    spark = frames[0][0].sparkSession
    paths = [f"{shared_dir(spark)}/motifloom-{label}-{uuid.uuid4().hex}" for _, label in frames]
    with short_lived_shuffles(spark):
        if len(frames) == 1:
            frames[0][0].write.parquet(paths[0])
        else:
            with ThreadPoolExecutor(4) as pool:
                list(pool.map(lambda x: x[0][0].write.parquet(x[1]), zip(frames, paths, strict=True)))
    return [Stored(spark, path) for path in paths]
