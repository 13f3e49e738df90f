"""Toxicity classifier with counterfactual regularisation.

Features: the words of a text and their leading characters, so that inflected
forms share evidence; each present at all, repeated, and frequent, or not. Model: logistic regression on
features that tell the classes apart, fitted on at most ``per_class`` labelled
rows of each class. Regularisation: wherever a labelled sentence names a
group, the name is swapped for another of its set, and the squared change of
the sentence's log-odds is penalised, so that a neutral mention of a group
does not by itself move the score. Names that no labelled sentence has can
still move it, by what they share with other words; so each name is also
carried into ``carriers`` labelled sentences and swapped there.

Nulls: a null text is empty and gets the score of a text without features;
rows with a null label or id are not learnt from. Of repeated labels the
highest counts. Without labelled rows of both classes each score is the share
of toxic rows (0 without any).
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifloom.llm.kernels import small_batches
from motifloom.session import let_workers_import

#: Identity terms, in sets within which terms are swapped.
IDENTITY = (
    ("men", "women"), ("man", "woman"), ("boys", "girls"), ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"), ("black", "white", "asian", "latino"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("immigrants", "refugees", "locals"), ("disabled", "deaf", "blind"), ("old", "young"),
    ("männer", "frauen"), ("muslime", "christen", "juden"), ("hommes", "femmes"), ("musulmans", "chrétiens", "juifs"),
    ("hombres", "mujeres"), ("musulmanes", "cristianos", "judíos"),
)


@dataclass(frozen=True)
class Settings:
    """``per_class`` bounds the rows learnt from; the rest are limits of the model."""

    per_class: int = 4000
    features: int = 4096
    prefixes: tuple[int, ...] = (3, 4, 5, 6)
    least_docs: int = 3
    least_z: float = 3.5
    swap_weight: float = 1.0
    carriers: int = 32
    ridge: float = 1e-4
    toxic_weight: float = 2.0
    rounds: int = 400
    identity: tuple[tuple[str, ...], ...] = IDENTITY


_SPLIT = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _SPLIT.findall(text.lower())


def features_of(word: str, prefixes: tuple[int, ...]) -> list[str]:
    """A word, and its first characters up to some lengths (marked by a star)."""
    return [word, *[word[:n] + "*" for n in prefixes if len(word) > n]]


#: A feature is also marked as frequent if at least one word in so many has it.
FREQUENT = 100


def levels(counts: dict[str, int], n_words: int) -> list[str]:
    """Features that a text has at all, more than once (``+``), and frequently (``%``)."""
    out = list(counts)
    out += [f + "+" for f, n in counts.items() if n > 1]
    return out + [f + "%" for f, n in counts.items() if n * FREQUENT >= n_words]


def bag(words: list[str], prefixes: tuple[int, ...]) -> set[str]:
    counts: Counter = Counter()
    for word, n in Counter(words).items():
        for f in features_of(word, prefixes):
            counts[f] += n
    return set(levels(counts, len(words)))


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    prefixes: tuple[int, ...]
    memo: dict[str, tuple] = field(default_factory=dict, repr=False, compare=False)
    base: set[str] = field(default_factory=set, repr=False, compare=False)

    def __post_init__(self):
        self.base = {f.rstrip("+%") for f in self.weights}

    def logit(self, text: str) -> float:
        if len(self.memo) > 200_000:
            self.memo = {}
        counts: dict[str, int] = {}
        memo, words = self.memo, words_of(text)
        for word, n in Counter(words).items():
            known = memo.get(word)
            if known is None:
                known = memo[word] = tuple(f for f in features_of(word, self.prefixes) if f in self.base)
            for f in known:
                counts[f] = counts.get(f, 0) + n
        return self.bias + sum(self.weights.get(f, 0.0) for f in sorted(levels(counts, len(words))))

    def score(self, text: str) -> float:
        z = self.logit(text)
        return float(1 / (1 + np.exp(-z))) if z > -700 else 0.0


def swapped(words: list[str], turn: dict[str, str]) -> list[str] | None:
    """The words with each identity term replaced by the next of its set; null if there is none."""
    return [turn.get(w, w) for w in words] if any(w in turn for w in words) else None


_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")


def examples(text: str, s: Settings) -> tuple[set[str], list[tuple[set[str], set[str]]]]:
    """A text's features, and the features before and after a swap for each sentence that names a group."""
    turn = {t: group[(i + 1) % len(group)] for group in s.identity for i, t in enumerate(group)}
    words, pairs = words_of(text), []
    if not turn.keys().isdisjoint(words):
        for sentence in _SENTENCE.split(text):
            mine = words_of(sentence)
            other = swapped(mine, turn)
            if other is not None:
                pairs.append((bag(mine, s.prefixes), bag(other, s.prefixes)))
    return bag(words, s.prefixes), pairs


def carried(texts: list[str], s: Settings) -> list[tuple[set[str], set[str]]]:
    """Features before and after a swap, for each identity term put at the end of some labelled sentences, spread over ``texts``."""
    out = []
    n = min(s.carriers, len(texts))
    for text in [texts[i * len(texts) // n] for i in range(n)]:
        words = next((w for w in map(words_of, _SENTENCE.split(text)) if w), [])
        for group in s.identity:
            bags = [bag([*words, term], s.prefixes) for term in group]
            out += list(zip(bags, bags[1:] + bags[:1], strict=True))
    return out


class _Names:
    """Numbers for features: a text's features take four bytes each."""

    def __init__(self):
        self.number: dict[str, int] = {}

    def of(self, features: set[str]) -> np.ndarray:
        number = self.number
        return np.array([number.setdefault(f, len(number)) for f in features], np.int32)


def select(bags: list[np.ndarray], labels: np.ndarray, names: list[str], s: Settings) -> list[int]:
    """Features whose share of documents differs most between the classes, by a two-proportion z."""
    counts = []
    for y in (0, 1):
        mine = [b for b, label in zip(bags, labels, strict=True) if label == y]
        counts.append(np.bincount(np.concatenate([*mine, np.empty(0, np.int32)]).astype(np.int64), minlength=len(names)).astype(float))
    b, a = counts
    n0, n1 = int((labels == 0).sum()), int((labels == 1).sum())
    p = (a + b) / (n0 + n1)
    z = np.abs(a / n1 - b / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n0 + 1 / n1))
    fine = np.flatnonzero((z >= s.least_z) & (a + b >= s.least_docs))
    best = sorted((-z[i], names[i], int(i)) for i in fine)
    return [i for _, _, i in best[: s.features]]


class _Rows:
    """Sparse rows: sums of weights of each row's entries, and the transpose."""

    def __init__(self, rows: list[dict[int, float]], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.array([c for r in rows for c in r], np.int64)
        self.val = np.array([v for r in rows for v in r.values()], float)

    def some(self) -> _Rows:
        """Without the rows that have no entries."""
        used, row = np.unique(self.row, return_inverse=True)
        self.n, self.row = len(used), row
        return self

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * g[self.row], self.width)


def loss(x: _Rows, d: _Rows, weight: np.ndarray, labels: np.ndarray, w: np.ndarray, bias: float, s: Settings) -> float:
    """What is minimised: weighted log loss, ridge, and the mean squared change of the log-odds by a swap."""
    z = x.dot(w) + bias
    fit_ = float((weight * (np.logaddexp(0, z) - labels * z)).sum())
    return fit_ + s.ridge / 2 * float(w @ w) + (s.swap_weight * float((d.dot(w) ** 2).mean()) if d.n else 0.0)


def gradient(x: _Rows, d: _Rows, weight: np.ndarray, labels: np.ndarray, w: np.ndarray, bias: float, s: Settings) -> tuple[np.ndarray, float]:
    """The slope of ``loss`` by the weights and by the bias."""
    p = 1 / (1 + np.exp(-np.clip(x.dot(w) + bias, -60, 60)))
    g = weight * (p - labels)
    grad = x.back(g) + s.ridge * w
    if d.n:
        grad = grad + 2 * s.swap_weight * d.back(d.dot(w)) / d.n
    return grad, float(g.sum())


def fit(rows: list[tuple[str, int]], s: Settings) -> Model:
    """Fit on ``(text, label)`` rows, by Adam on all rows at once; texts that repeat count once, with their highest label."""
    once: dict[str, int] = {}
    for text, label in rows:
        once[text] = max(label, once.get(text, 0))
    rows = list(once.items())
    labels = np.array([y for _, y in rows], int)
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(rows) else 0.0
        return Model({}, float(np.log((share + 1e-6) / (1 - share + 1e-6))), s.prefixes)
    known, bags, pairs = _Names(), [], []
    for text, _ in rows:
        mine, swaps = examples(text, s)
        bags.append(known.of(mine))
        pairs += [(known.of(after - before), known.of(before - after)) for before, after in swaps]
    pairs += [(known.of(after - before), known.of(before - after)) for before, after in carried([t for t, _ in rows], s)]
    all_names = list(known.number)
    chosen = select(bags, labels, all_names, s)
    names = [all_names[i] for i in chosen]
    place = np.full(len(all_names), -1)
    place[chosen] = np.arange(len(chosen))

    def kept(some: np.ndarray) -> list[int]:
        return sorted(i for i in place[some].tolist() if i >= 0)

    x = _Rows([dict.fromkeys(kept(b), 1.0) for b in bags], len(names))
    d = _Rows([dict.fromkeys(kept(up), 1.0) | dict.fromkeys(kept(down), -1.0) for up, down in pairs], len(names))
    weight = np.where(labels == 1, s.toxic_weight, 1.0)
    weight /= weight.sum()
    d = d.some()
    w, bias = np.zeros(len(names)), 0.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, s.rounds + 1):
        full = np.append(*gradient(x, d, weight, labels, w, bias, s))
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(dict(zip(names, w.tolist(), strict=True)), float(bias), s.prefixes)


def fold(doc_id: Column) -> Column:
    """The held-out rule: rows with fold 0 are never learnt from."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5))


def training_rows(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """``(doc_id, text, toxic)`` of at most ``per_class`` labelled texts of each class, by the least hashes of their ids."""
    usable = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    usable = usable.where(fold(F.col("doc_id")) != 0)
    chosen = [usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.per_class) for y in (0, 1)]
    few = chosen[0].union(chosen[1])  # bounded: 2 * per_class rows of two numbers
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")


def _fitted(s: Settings) -> Callable[[pa.Table], pa.Table]:
    """Arrow function (doc_id, text, toxic) -> the model fitted on these rows, as text."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        model = fit(list(zip(table["text"].to_pylist(), table["toxic"].to_pylist(), strict=True)), s)
        return pa.table({"model": pa.array([_packed(model)])})

    return run


def _packed(model: Model) -> str:
    return json.dumps([model.weights, model.bias, model.prefixes])


def _unpacked(packed: str) -> Model:
    weights, bias, prefixes = json.loads(packed)
    return Model(weights, bias, tuple(prefixes))


def train(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """The model of the labelled rows. They are bounded, and fitted in a task: the driver gets the weights alone."""
    s = settings or Settings()
    let_workers_import(docs.sparkSession)
    got = training_rows(docs, labels, s).groupBy(F.lit(0).alias("all")).applyInArrow(_fitted(s), "model string").collect()
    return _unpacked(got[0].model) if got else fit([], s)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on). Only the text is looked at."""
    let_workers_import(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("score", "predicted", "_text")]
    rows = docs.select(*names, F.col(text_col).cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    packed = _packed(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = _unpacked(packed)
        for batch in small_batches(batches, len(names)):
            scores = [mine.score(t or "") for t in batch.column(len(names)).to_pylist()]
            kept = [batch.column(i) for i in range(len(names))]
            cols = [pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays([*kept, *cols], [*names, "score", "predicted"])

    return rows.mapInArrow(run, ", ".join(filter(None, [kinds, "score double, predicted int"])))
