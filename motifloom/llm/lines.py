"""Line deduplication with a log-template tree.

A line's tokens are its white-space runs; tokens with a digit are variable
fields, ``<*>``. The tree has a fixed depth: the number of tokens, then the
first ``depth`` tokens. At a node, positions that most lines fill alike are
constants and the others variable: that is the node's template, and lines that
agree with at least ``similarity`` of their positions are of it. The lines that
are of no recurring template move on to children of the node. Each line picks
the child itself, by one of its tokens in its place: of those that ``min_docs``
lines of the node have there, but not all, the one that most lines have among
those whose lines all agree in ``similarity`` of the places looked at; if there
is none, the one whose lines agree in most of them. So a template parts from
the others of its leaf by a token of its own, not by a field that takes few
values. Up to ``probes`` places, evenly spread over the line, are looked at.
There are ``splits`` such levels below a leaf. A line whose masked tokens recur
as they are is a template of its own.

A template of ``min_docs`` documents or more recurs, and so does a masked line
that ``same_docs`` documents have as it is; such lines are dropped. By
default its first line (smallest document id, then line number) stays, so that
no content vanishes from the corpus with its copies; ``keep="none"`` drops
that as well. Lines whose tokens have under ``min_bytes`` bytes are left alone.

Nulls: a null text has no lines and stays null, null ids come first. Repeated
rows are documents of their own; of rows equal in id and text all are treated
alike. A text that is left without lines becomes empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifloom.llm.kernels import Rolling, as_bytes, chunks, mix, signed, small_batches, xxh64
from motifloom.llm.skew import digest
from motifloom.session import let_workers_import, scratch, store


@dataclass(frozen=True)
class Tree:
    depth: int = 3
    splits: int = 3
    similarity: float = 0.8
    min_bytes: int = 16
    min_docs: int = 3
    same_docs: int = 2
    probes: int = 16
    keep: str = "first"


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: What stands for any variable field.
_FIELD = np.uint64(0)


class Lines:
    """The lines of several texts as runs of token hashes.

    Line ``i`` has the tokens ``token[first[i]:first[i + 1]]``; text ``j`` owns
    the lines ``text_first[j]:text_first[j + 1]``, one at least.
    """

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts), np.uint8)
        edge = np.diff(np.concatenate(([False], ~_SPACE[raw], [False])).astype(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        breaks = np.flatnonzero(raw == 10)
        digits = np.concatenate(([0], np.cumsum((raw >= 48) & (raw <= 57))))
        token = xxh64(raw, begin, end, 0)
        token[digits[end] > digits[begin]] = _FIELD
        self.token = token
        self.text_first = np.concatenate(([0], np.cumsum([t.count(b"\n") + 1 for t in texts], dtype=np.int64)))
        n = np.bincount(np.searchsorted(breaks, begin), minlength=len(breaks) + 1)
        self.first = np.concatenate(([0], np.cumsum(n)))
        sizes = np.concatenate(([0], np.cumsum(end - begin)))
        self.size = sizes[self.first[1:]] - sizes[self.first[:-1]]

    def marks(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each line's leaf, and a 128-bit hash of its tokens."""
        at, n = self.first[:-1], np.diff(self.first)
        one, two = Rolling(self.token, 0), Rolling(mix(self.token + np.uint64(1)), 1)
        leaf = mix(one.at(at, np.minimum(n, depth)) ^ mix(n.astype(np.uint64)))
        return signed(leaf), signed(one.at(at, n)), signed(two.at(at, n))


_LINE = "d0 long, d1 long, doc_id long, line_no long, leaf long"


def _parse(tree: Tree):
    """Arrow function (d0, d1, doc_id, text) -> lines that are long enough, with their leaf and hash."""
    names = [x.split()[0] for x in f"{_LINE}, m0 long, m1 long".split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 3):
            texts = [as_bytes(t) for t in batch.column(3).to_pylist()]
            for a, b in chunks(map(len, texts)):
                found = Lines(texts[a:b])
                keep = np.flatnonzero(found.size >= tree.min_bytes)
                owner = np.searchsorted(found.text_first, keep, "right") - 1
                keys = [batch.column(c).slice(a, b - a).take(pa.array(owner)) for c in range(3)]
                number = pa.array(keep - found.text_first[owner])
                yield pa.RecordBatch.from_arrays([*keys, number, *[pa.array(m[keep]) for m in found.marks(tree.depth)]], names)

    return run


def _tokens(tree: Tree):
    """Arrow function (d0, d1, doc_id, text, line numbers) -> the hash and tokens of those lines."""
    names = ["m0", "m1", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 3):
            texts, wanted = [as_bytes(t) for t in batch.column(3).to_pylist()], batch.column(4)
            for a, b in chunks(map(len, texts)):
                found = Lines(texts[a:b])
                numbers = [wanted[i].values.to_numpy() for i in range(a, b)]
                owner = np.repeat(np.arange(b - a), [len(x) for x in numbers])
                number = np.concatenate(numbers)
                at = found.text_first[owner] + number
                tokens = [signed(found.token[found.first[i] : found.first[i + 1]]) for i in at.tolist()]
                _, m0, m1 = found.marks(tree.depth)
                yield pa.RecordBatch.from_arrays([pa.array(m0[at]), pa.array(m1[at]), pa.array(tokens, pa.list_(pa.int64()))], names)

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """``(d0, d1, doc_id, text)``: rows that have a text, named by a digest of id and text."""
    let_workers_import(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return rows.select(*digest(F.col("doc_id"), F.col("text")), "doc_id", "text")


def _recurring(lines: DataFrame, key: list[str], docs: int) -> DataFrame:
    """Keys found in ``docs`` documents or more, with their first line."""
    per_doc = lines.groupBy(*key, "d0", "d1").agg(F.min(F.struct("doc_id", "line_no")).alias("p"))
    place = F.min(F.struct("p.doc_id", "d0", "d1", "p.line_no")).alias("place")
    return per_doc.groupBy(*key).agg(F.count("*").alias("n_docs"), place).where(F.col("n_docs") >= docs)


def _dropped(lines: DataFrame, templates: DataFrame, key: list[str], tree: Tree) -> DataFrame:
    """Lines of recurring templates, but for those that stay."""
    joined = lines.join(templates.select(*key, "place"), key)
    here = F.struct("doc_id", "d0", "d1", "line_no")
    return (joined if tree.keep == "none" else joined.where(~here.eqNullSafe(F.col("place")))).select("d0", "d1", "line_no")


def node_templates(kinds: DataFrame) -> DataFrame:
    """``(node, template)`` of ``kinds(node, tokens, n)``: the token most lines have at each place, or null."""
    votes = kinds.select("node", "n", F.posexplode("tokens").alias("at", "token")).groupBy("node", "at", "token").agg(F.sum("n").alias("n"))
    most = votes.groupBy("node", "at").agg(F.max(F.struct("n", "token")).alias("top"), F.sum("n").alias("all"))
    constant = F.when(F.col("top.n") * 2 > F.col("all"), F.col("top.token"))
    places = most.select("node", F.struct("at", constant.alias("token")).alias("p")).groupBy("node").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    return places.select("node", F.transform("ps", lambda p: p["token"]).alias("template"))


def probed(tree: Tree) -> list[Column]:
    """The tokens at the places looked at, of lines with ``tokens``; null beyond a short line's end."""
    looked = F.least(F.lit(tree.probes), F.size("tokens"))
    return [F.get("tokens", F.when(looked > k, F.floor(F.lit(k) * F.size("tokens") / looked).cast("int"))).alias(f"p{k}") for k in range(tree.probes)]


def children(rest: DataFrame, tree: Tree) -> DataFrame:
    """``rest(node, m0, m1, n, tokens)`` moved to the children that the lines pick; lines without one go."""
    nodes = rest.groupBy("node").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where((F.col("total") >= tree.min_docs) & (F.col("kinds") > 1))
    rest = store(rest.join(nodes.select("node", "total"), "node"), "node-rest").read()
    # One row for each token in its place; a group's least and greatest token at a probe are the same if all agree.
    tokens = rest.select("node", "total", "n", F.least(F.lit(tree.probes), F.size("tokens")).alias("looked"), F.posexplode("tokens").alias("at", "token"), *probed(tree))
    ends = [f(f"p{k}").alias(f"{name}{k}") for k in range(tree.probes) for f, name in ((F.min, "low"), (F.max, "high"))]
    places = tokens.groupBy("node", "at", "token").agg(F.sum("n").alias("all"), F.first("total").alias("total"), F.first("looked").alias("looked"), *ends)
    places = places.where((F.col("all") >= tree.min_docs) & (F.col("all") < F.col("total")))
    agreed = reduce(add, [F.coalesce((F.col(f"low{k}") == F.col(f"high{k}")).cast("long"), F.lit(0)) for k in range(tree.probes)])
    fits = agreed >= F.col("looked") * tree.similarity
    rank = F.struct(fits.cast("int").alias("fits"), F.when(fits, F.col("all")).otherwise(agreed).alias("by"), (-F.col("at")).alias("first"))
    places = store(places.select("node", "at", "token", rank.alias("rank")), "node-places").read()
    own = rest.select("node", "m0", "m1", F.posexplode("tokens").alias("at", "token")).join(places, ["node", "at", "token"])
    best = own.groupBy("m0", "m1").agg(F.max(F.struct("rank", "at", "token")).alias("best"))
    child = F.xxhash64("node", "best.at", "best.token")
    return rest.join(best, ["m0", "m1"]).select(child.alias("node"), "m0", "m1", "n", "tokens")


def line_kinds(docs: DataFrame, lines: DataFrame, tree: Tree) -> tuple[DataFrame, DataFrame]:
    """``(node, m0, m1, n, tokens)``, each different line of leaves that may generalise, and their ``lines``."""
    kinds = lines.groupBy("leaf", "m0", "m1").agg(F.count("*").alias("n"), F.min(F.struct("d0", "d1", "line_no")).alias("one"))
    kinds = store(kinds, "line-kinds").read()
    leaves = kinds.groupBy("leaf").agg(F.sum("n").alias("all"), F.count("*").alias("kinds")).where((F.col("all") >= tree.min_docs) & (F.col("kinds") > 1))
    kinds = store(kinds.join(leaves.select("leaf"), "leaf").select(F.col("leaf").alias("node"), "m0", "m1", "n", "one"), "leaf-kinds").read()
    numbers = kinds.groupBy("one.d0", "one.d1").agg(F.collect_set("one.line_no").alias("numbers"))
    # Such lists grow with the corpus, so they are joined by a shuffle at every size.
    texts = keyed(docs).join(numbers.hint("merge"), ["d0", "d1"]).select("d0", "d1", "doc_id", "text", "numbers")
    tokens = texts.mapInArrow(_tokens(tree), "m0 long, m1 long, tokens array<long>").dropDuplicates(["m0", "m1"])
    kinds = store(kinds.drop("one").join(tokens, ["m0", "m1"]), "token-kinds").read()
    return kinds, store(lines.drop("leaf").join(kinds.select("m0", "m1"), ["m0", "m1"]), "leaf-lines").read()


def node_drops(kinds: DataFrame, lines: DataFrame, tree: Tree) -> list[DataFrame]:
    """``(d0, d1, line_no)`` of the lines to drop, level by level below the leaves."""
    agreed = F.aggregate(F.zip_with("tokens", "template", lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0))), F.lit(0), lambda acc, x: acc + x)
    out = []
    for level in range(tree.splits + 1):
        nodes = kinds.groupBy("node").agg(F.sum("n").alias("all"), F.count("*").alias("kinds")).where((F.col("all") >= tree.min_docs) & (F.col("kinds") > 1))
        kinds = store(kinds.join(nodes.select("node"), "node"), "node-kinds").read()
        if kinds.isEmpty():
            break
        close = kinds.join(node_templates(kinds), "node").where(agreed >= F.size("tokens") * tree.similarity).select("node", "m0", "m1")
        met = store(close.join(lines, ["m0", "m1"]), "template-lines").read()
        found = store(_recurring(met, ["node"], tree.min_docs), "node-templates").read()
        out.append(store(_dropped(met, found, ["node"], tree), "node-drops").read())
        if level < tree.splits:
            settled = met.join(found.select("node"), "node", "left_semi").select("m0", "m1").distinct()
            kinds = store(children(kinds.join(settled, ["m0", "m1"], "left_anti"), tree), "node-children").read()
    return out


def template_lines(docs: DataFrame, tree: Tree) -> DataFrame:
    """``(d0, d1, line_no)`` of the lines to drop from ``docs(doc_id, text)``."""
    lines = store(keyed(docs).mapInArrow(_parse(tree), f"{_LINE}, m0 long, m1 long"), "lines").read()
    # Stored on their own, so that a join with lines found everywhere can be split where it is skewed.
    exact = store(_recurring(lines, ["m0", "m1"], tree.same_docs), "line-templates").read()
    drops = store(_dropped(lines, exact, ["m0", "m1"], tree), "line-drops").read()
    for some in node_drops(*line_kinds(docs, lines, tree), tree):
        drops = drops.union(some)
    return drops.distinct()


def _without(n_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, n_docs):
            kept, counts, gone = [], [], []
            for text, drop in zip(batch.column(n_docs).to_pylist(), batch.column(n_docs + 1).to_pylist(), strict=True):
                lines = [] if text is None else text.split("\n")
                if drop:
                    bad = set(drop)
                    text = "\n".join(x for i, x in enumerate(lines) if i not in bad)
                kept.append(text)
                counts.append(len(lines))
                gone.append(len(drop or ()))
            rest = [batch.column(i) for i in range(n_docs)]
            cols = [pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays([*rest, *cols], [*batch.schema.names[:n_docs], "text", "n_lines", "n_dropped"])

    return run


def dedup_lines(docs: DataFrame, tree: Tree | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)`` with the cleaned ``text``, ``n_lines`` (before) and ``n_dropped``."""
    tree = tree or Tree()
    if tree.keep not in ("first", "none"):
        raise ValueError("keep is first or none")
    let_workers_import(docs.sparkSession)
    with scratch(docs.sparkSession):
        drops = template_lines(docs, tree).groupBy("d0", "d1").agg(F.collect_list("line_no").alias("_drop"))
        drops = store(drops, "all-drops").keep()
    drops = drops.read().withColumnsRenamed({"d0": "_d0", "d1": "_d1"})
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped", "_drop", "_text", "_d0", "_d1")]
    keys = digest(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = docs.select(*others, F.col("text").cast("string").alias("_text"), keys[0].alias("_d0"), keys[1].alias("_d1"))
    rows = rows.join(drops.hint("merge"), ["_d0", "_d1"], "left").select(*others, "_text", "_drop")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    out = rows.mapInArrow(_without(len(others)), ", ".join(filter(None, [kinds, "text string, n_lines long, n_dropped long"])))
    return out.select(*[c for c in docs.columns if c in (*others, "text")], "n_lines", "n_dropped")
