"""Incremental substring deduplication over a log-structured fingerprint index.

A window is ``size`` consecutive words. Its fingerprint is the least hash of
the ``GRAM``-word strings in it (its anchor, see ``kernels.Anchors``): equal
windows have equal fingerprints at equal offsets, and neighbouring windows
share theirs, so a text has about one for each 18 words. The index holds the
fingerprints of *every* window of every text it was given; what enters it does
not depend on what else is in the batch.

The index is a set of immutable runs, tables bucketed and sorted by
fingerprint, named by a manifest in a folder, so that a later session can open
it and go on. A new batch becomes a run; it is merge-joined with each older run
where they lie, without moving either, and matches are the texts of both sides
that share a fingerprint. Too many runs are compacted into one.

Matches are verified: the windows behind a shared fingerprint are read from
the texts and grouped by a hash of their words, the smallest document of each
group is the window's first place, and at last the words of each passage are
compared with those at its first place.

Equal texts (by a 128-bit digest) of a batch are handled as one; of rows with
equal texts all but those of the smallest id repeat it as a whole.

Nulls: a null text has no words. Rows without an id neither remove nor lose
words. Repeated rows of one id are one document: equal ids never remove from
one another.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motifloom.llm.kernels import Anchors, Rolling, Words, as_bytes, chunks, signed, small_batches, spans, xxh64
from motifloom.llm.skew import digest
from motifloom.session import Stored, delete, let_workers_import, scratch, shared_dir, store

#: Words of an anchor. Shorter anchors repeat by chance, longer ones are picked more often.
GRAM = 15


def _word_values(words: Words) -> np.ndarray:
    return xxh64(words.buf, words.start, words.end, 0)


def _anchor_rows(size: int):
    """Arrow function (d0, d1, doc_id, text) -> (d0, d1, doc_id, anchors): distinct anchors of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 3):
            texts = [as_bytes(t) for t in batch.column(3).to_pylist()]
            lists: list[np.ndarray] = []
            for a, b in chunks(map(len, texts)):
                words = Words(texts[a:b])
                found = Anchors(_word_values(words), words.first, size, min(GRAM, size))
                cut = np.searchsorted(found.owner, np.arange(1, b - a))
                lists += [np.unique(signed(x)) for x in np.split(found.hash, cut)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lists, pa.list_(pa.int64()))], ["d0", "d1", "doc_id", "anchors"])

    return run


#: A window: its hash, its text (an id may have several), and the number of its first word.
_WINDOW = {"w": pa.int64(), "doc_id": pa.int64(), "d0": pa.int64(), "pos": pa.int32()}


def _window_rows(size: int):
    """Arrow function (doc_id, d0, text, anchors) -> windows that picked one of the anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2):
            keys = [batch.column(c).to_numpy() for c in range(2)]
            texts = [as_bytes(t) for t in batch.column(2).to_pylist()]
            wanted = batch.column(3)
            for a, b in chunks(map(len, texts)):
                words = Words(texts[a:b])
                values = _word_values(words)
                found = Anchors(values, words.first, size, min(GRAM, size))
                cut = np.searchsorted(found.owner, np.arange(b - a + 1))
                take = np.zeros(len(found.hash), bool)
                for i in range(b - a):
                    mine = slice(cut[i], cut[i + 1])
                    take[mine] = np.isin(signed(found.hash[mine]), wanted[a + i].values.to_numpy())
                lo, n = found.lo[take], found.hi[take] - found.lo[take] + 1
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                owner = np.repeat(found.owner[take], n)
                cols = [signed(Rolling(values).at(at, size)), *[k[a:b][owner] for k in keys], at - words.first[owner]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _WINDOW.values(), strict=True)], list(_WINDOW))

    return run


class WindowIndex:
    """Runs of ``(anchor, d0, d1, doc_id)`` in a folder that driver and executors share.

    ``buckets`` holds for the life of the index. ``ingest`` batches in any
    order. Opening a folder with a manifest goes on where it was left. A run is
    complete before the manifest names it, and the manifest is replaced in one
    step, so a broken-off batch leaves the index as it was before.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 4, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.path = (path or f"{shared_dir(spark)}/motifloom-index-{uuid.uuid4().hex}").rstrip("/")
        self.runs: list[str] = []
        self.compactions = 0
        known = self._manifest()
        self.buckets = known["buckets"] if known else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        for name in known["runs"] if known else []:
            self._attach(name)
            self.runs.append(name)

    def _file(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest(self) -> dict | None:
        for name in ("manifest.json", "manifest.new"):  # the second only after a stop between delete and rename
            where, fs = self._file(name)
            if fs.exists(where):
                stream = fs.open(where)
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                stream.close()
                return json.loads(text)
        return None

    def _commit(self, runs: list[str]) -> None:
        (new, fs), (old, _) = self._file("manifest.new"), self._file("manifest.json")
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps({"buckets": self.buckets, "runs": runs}), "utf-8"))
        stream.close()
        fs.delete(old, False)
        fs.rename(new, old)
        self.runs = runs

    def _attach(self, name: str) -> None:
        """Tell the session's catalog how a run lies on disk."""
        columns = "anchor bigint, d0 bigint, d1 bigint, doc_id bigint"
        how = f"clustered by (anchor) sorted by (anchor) into {self.buckets} buckets"
        self.spark.sql(f"create table if not exists {name} ({columns}) using parquet {how} location '{self.path}/{name}'")

    def _write(self, rows: DataFrame) -> str:
        """A run of ``rows``, which lie as its buckets will."""
        name = f"motifloom_run_{uuid.uuid4().hex}"
        rows.write.option("path", f"{self.path}/{name}").bucketBy(self.buckets, "anchor").sortBy("anchor").saveAsTable(name)
        return name

    def matches(self, new: str, old: str) -> list[DataFrame]:
        """Rows of two runs whose anchor is in both; both sides are joined where they lie."""
        a, b = self.spark.table(new), self.spark.table(old)
        return [a.join(b.select("anchor"), "anchor", "left_semi"), b.join(a.select("anchor"), "anchor", "left_semi")]

    def ingest(self, texts: DataFrame) -> Stored:
        """``(anchor, d0, d1, doc_id)``: what different texts share with those of ``texts(d0, d1, doc_id, anchors)``; the batch enters the index.

        Rows may repeat.
        """
        new = self._write(texts.select(F.explode("anchors").alias("anchor"), "d0", "d1", "doc_id").repartition(self.buckets, "anchor"))
        mine = self.spark.table(new)
        several = mine.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
        found = mine.join(several, "anchor", "left_semi")
        for old in self.runs:
            for some in self.matches(new, old):
                found = found.union(some)
        found = store(found, "matches")
        self._commit([*self.runs, new])
        if len(self.runs) > self.fanout:
            self.compact()
        return found

    def rows(self) -> DataFrame:
        """All that the index holds, read as plain files: a union of bucketed tables can pass for bucketed where it isn't read so."""
        return self.spark.read.schema("anchor long, d0 long, d1 long, doc_id long").parquet(*[f"{self.path}/{name}" for name in self.runs])

    def compact(self) -> None:
        """Merge all runs into one; a text met in several has its smallest id."""
        old = self.runs
        merged = self.rows().repartition(self.buckets, "anchor").groupBy("anchor", "d0", "d1").agg(F.min("doc_id").alias("doc_id"))
        self._commit([self._write(merged)])
        self._drop(old)
        self.compactions += 1

    def close(self) -> None:
        """Forget the tables in this session; the folder stays."""
        for name in self.runs:
            self.spark.sql(f"drop table if exists {name}")  # of external tables, the files stay

    def destroy(self) -> None:
        """Delete the index."""
        self.close()
        self.runs = []
        delete(self.spark, self.path)

    def _drop(self, runs: list[str]) -> None:
        for name in runs:
            self.spark.sql(f"drop table if exists {name}")
            delete(self.spark, f"{self.path}/{name}")


def keyed(docs: DataFrame) -> DataFrame:
    """``(d0, d1, doc_id, text)`` of ``docs``, with a digest of each text."""
    let_workers_import(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select(*digest(F.col("text")), "doc_id", "text")


def texts_with_anchors(docs: DataFrame, size: int) -> DataFrame:
    """``(d0, d1, doc_id, anchors)``: each different text once, with its smallest id."""
    rows = keyed(docs).where("doc_id is not null").mapInArrow(_anchor_rows(size), "d0 long, d1 long, doc_id long, anchors array<long>")
    return rows.groupBy("d0", "d1").agg(F.min("doc_id").alias("doc_id"), F.first("anchors").alias("anchors"))


def shared_windows(docs: DataFrame, matches: DataFrame, size: int) -> DataFrame:
    """``(w, doc_id, d0, pos)``: windows of ``docs`` behind the anchors of ``matches(anchor, d0, d1, doc_id)``."""
    lists = matches.groupBy("d0", "d1").agg(F.min("doc_id").alias("doc_id"), F.collect_set("anchor").alias("anchors"))
    lists = store(lists, "anchor-lists").read()
    rows = keyed(docs).join(lists.hint("merge"), ["d0", "d1", "doc_id"]).select("doc_id", "d0", "text", "anchors")
    return rows.mapInArrow(_window_rows(size), "w long, doc_id long, d0 long, pos int")


def repeated_windows(windows: DataFrame) -> DataFrame:
    """``(doc_id, d0, pos, f_id, f0, at)``: windows that also start in a smaller document, and the first such place."""
    first = windows.groupBy("w").agg(F.min(F.struct("doc_id", "pos", "d0")).alias("f"), F.max("doc_id").alias("last")).where("last > f.doc_id")
    first = store(first.select("w", F.col("f.doc_id").alias("f_id"), F.col("f.d0").alias("f0"), F.col("f.pos").alias("at")), "first-windows").read()
    return windows.join(first.hint("merge"), "w").where("doc_id > f_id").drop("w")


def passages(hits: DataFrame) -> DataFrame:
    """``(doc_id, d0, pos, f_id, f0, at, n)``: runs of ``n`` hits in a row whose first places are in a row as well."""
    key = ["doc_id", "d0", "f_id", "f0"]
    shift = F.col("at") - F.col("pos")
    rows = hits.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy(*key, shift).orderBy("pos")))
    return rows.groupBy(*key, shift.alias("shift"), "run").agg(F.min("pos").alias("pos"), F.min("at").alias("at"), F.count("*").cast("int").alias("n")).drop("shift", "run")


_SAID = {"doc_id": pa.int64(), "d0": pa.int64(), "pos": pa.int32(), "n": pa.int32(), "words": pa.binary()}


def _passage_rows(size: int):
    """Arrow function (doc_id, d0, text, places of (pos, n)) -> (doc_id, d0, pos, n, words): the passages' words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2):
            for doc_id, d0, text, places in zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True):
                words = as_bytes(text).split()
                rows = [(doc_id, d0, p["pos"], p["n"], b" ".join(words[p["pos"] : p["pos"] + p["n"] + size - 1])) for p in places]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SAID.values(), strict=True)], list(_SAID))

    return run


def _agreeing(size: int):
    """Arrow function (doc_id, d0, pos, n, words, first) -> (doc_id, d0, hits): places whose words agree with the first place's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4):
            fine = []
            for pos, n, mine, first in zip(*[batch.column(c).to_pylist() for c in range(2, 6)], strict=True):
                if mine == first:
                    fine.append(np.arange(pos, pos + n))
                else:  # equal hashes of different words
                    a, b = mine.split(b" "), first.split(b" ")
                    fine.append(np.array([pos + i for i in range(n) if a[i : i + size] == b[i : i + size]], np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fine, pa.list_(pa.int32()))], ["doc_id", "d0", "hits"])

    return run


def verified(docs: DataFrame, hits: DataFrame, size: int) -> DataFrame:
    """``(doc_id, d0, hits)``: places of the hits whose words are those at the first place, a row for each passage."""
    spans = store(passages(hits), "passages").read()
    sides = spans.select("doc_id", "d0", "pos", "n").union(spans.select("f_id", "f0", "at", "n")).distinct()
    places = store(sides.groupBy("doc_id", "d0").agg(F.collect_list(F.struct("pos", "n")).alias("places")), "passage-places").read()
    texts = keyed(docs).join(places.hint("merge"), ["doc_id", "d0"]).dropDuplicates(["doc_id", "d0"])
    said = texts.select("doc_id", "d0", "text", "places").mapInArrow(_passage_rows(size), "doc_id long, d0 long, pos int, n int, words binary")
    said = store(said, "passage-words").read()
    both = spans.join(said, ["doc_id", "d0", "pos", "n"]).join(said.toDF("f_id", "f0", "at", "n", "first"), ["f_id", "f0", "at", "n"])
    return both.select("doc_id", "d0", "pos", "n", "words", "first").mapInArrow(_agreeing(size), "doc_id long, d0 long, hits array<int>")


def _removed(size: int, n_docs: int):
    """Arrow function: cut the words of hit windows, or all of them if the text repeats a smaller id's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, n_docs):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column(n_docs).to_pylist()
            least, hits = batch.column(n_docs + 1).to_pylist(), batch.column(n_docs + 2)
            kept, total, gone = [], [], []
            for i, (doc_id, text, first) in enumerate(zip(ids, texts, least, strict=True)):
                words = as_bytes(text).split()
                n = len(words)
                if doc_id is not None and first is not None and doc_id > first and n >= size:
                    words = []
                elif doc_id is not None and doc_id == first and hits[i].is_valid:
                    stay, at = [], 0
                    for begin, end in zip(*(x.tolist() for x in spans(hits[i].values.to_numpy(), size)), strict=True):
                        stay += words[at:begin]
                        at = end
                    words = stay + words[at:]
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                total.append(n)
                gone.append(n - len(words))
            cols = [pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())]
            names = batch.schema.names[:n_docs]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_docs], *cols], [*names, "kept", "n_words", "n_removed"])

    return run


def dedup_windows(docs: DataFrame, size: int = 50, batches: int = 6, fanout: int = 4) -> DataFrame:
    """``docs(doc_id, text, ...)`` with ``kept`` (words joined by spaces), ``n_words`` and ``n_removed``.

    A word goes if a window over it also starts in a document of smaller id.
    The texts enter an index of their own in ``batches`` ranges of ids.
    """
    spark = docs.sparkSession
    with scratch(spark):
        plan = _window_plan(docs, size, batches, fanout).keep()
    return cut_windows(docs, plan.read(), size)


def cut_windows(docs: DataFrame, plan: DataFrame, size: int) -> DataFrame:
    """What ``dedup_windows`` returns, from ``plan(d0, d1, _first, _hits)``."""
    plan = plan.withColumnsRenamed({"d0": "_d0", "d1": "_d1"})
    others = [c for c in docs.columns if c not in ("kept", "n_words", "n_removed", "_text", "_first", "_hits", "_d0", "_d1")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = digest(text)
    rows = docs.select(*others, text.alias("_text"), keys[0].alias("_d0"), keys[1].alias("_d1")).join(plan.hint("merge"), ["_d0", "_d1"], "left")
    rows = rows.select(*[F.col(c).cast("long").alias(c) if c == "doc_id" else c for c in others], "_text", "_first", "_hits")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-3])
    return rows.mapInArrow(_removed(size, len(others)), f"{kinds}, kept string, n_words long, n_removed long")


def window_plan(docs: DataFrame, texts: DataFrame, matches: DataFrame, size: int) -> DataFrame:
    """``(d0, d1, _first, _hits)``: each of ``texts`` with its smallest id and the verified hits' places.

    ``docs`` holds the rows of all texts in ``matches``, old and new.
    """
    windows = store(shared_windows(docs, matches, size), "windows").read()
    hits = store(repeated_windows(windows), "hits").read()
    found = verified(docs, hits, size).groupBy("doc_id", "d0").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("_hits"))
    # A text of an earlier batch is known by its smallest id there.
    known = matches.groupBy("d0", "d1").agg(F.min("doc_id").alias("known"))
    plan = texts.select("d0", "d1", "doc_id").join(known, ["d0", "d1"], "left").select("d0", "d1", F.least("doc_id", "known").alias("doc_id"))
    return plan.join(found, ["doc_id", "d0"], "left").select("d0", "d1", F.col("doc_id").alias("_first"), "_hits")


def _window_plan(docs: DataFrame, size: int, batches: int, fanout: int) -> Stored:
    spark = docs.sparkSession
    texts = store(texts_with_anchors(docs, size), "texts").read()
    cuts = texts.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)] or [0.5], 1000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts)) if batches > 1 else []
    index, found = WindowIndex(spark, fanout=fanout), None
    try:
        for low, high in zip([None, *cuts], [*cuts, None], strict=True):
            batch = texts if low is None else texts.where(F.col("doc_id") > low)
            batch = batch if high is None else batch.where(F.col("doc_id") <= high)
            some = index.ingest(batch).read()
            found = some if found is None else found.union(some)
    finally:
        index.destroy()
    return store(window_plan(docs, texts, found, size), "window-plan")
