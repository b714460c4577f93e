"""Toxicity by a counterfactual-regularised linear classifier.

Features are the distinct words of a text and the first characters of its longer words,
which catch inflected and compound forms. The training set is a bounded sample of labelled
documents; Spark counts features over it, the strongest by log odds become the model's
columns, and a logistic model is fitted to the few active columns of each row.

Identity terms are always columns. For every training text that mentions one, the same
text with the term swapped for the others of its group is a counterfactual; the loss adds
the squared change of the score over all of them, and a penalty on the score that a bare
mention adds. So the model cannot use who is mentioned, which spares neutral mentions.

Scoring is map-only over whole texts; the model has at most ``columns`` weights.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import discard, sampled, small, stage

LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
#: Groups of interchangeable identity terms.
IDENTITIES = (
    ("women", "men", "girls", "boys", "woman", "man", "female", "male", "transgender", "nonbinary"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "homosexual", "heterosexual"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("muslim", "muslims", "christian", "christians", "jewish", "jews", "hindu", "hindus", "buddhist", "atheist", "catholic"),
    ("immigrant", "immigrants", "refugee", "refugees", "foreigner", "foreigners", "citizen", "citizens"),
    ("disabled", "blind", "deaf", "autistic", "elderly", "old", "young"),
)
GROUP_OF = {term: group for group in IDENTITIES for term in group}


def features_of(word: str) -> list[str]:
    """The word, and its beginnings marked by a trailing dash; identity terms stand for themselves only."""
    if word in GROUP_OF:
        return [word]
    return [word] + [word[:k] + "-" for k in PREFIXES if len(word) > k]


def word_set(text: str | None) -> set[str]:
    return set(LETTERS.findall((text or "").lower()))


@dataclass
class Model:
    bias: float
    weights: dict[str, float]

    def scorer(self, most_words: int = 1 << 17):
        """Function of a text; words without an active column are remembered as such, up to a bounded number."""
        known: dict[str, tuple[str, ...]] = {}
        weights = self.weights

        def score(text: str | None) -> float:
            active: set[str] = set()
            for word in word_set(text):
                found = known.get(word)
                if found is None:
                    if len(known) >= most_words:
                        known.clear()
                    found = known[word] = tuple(f for f in features_of(word) if f in weights)
                active.update(found)
            z = self.bias + math.fsum(weights[f] for f in active)
            return 1.0 / (1.0 + math.exp(-z)) if z >= 0 else math.exp(z) / (1.0 + math.exp(z))

        return score


def training_ids(labels: DataFrame, most_rows: int = 30_000) -> DataFrame:
    """Rows (doc_id, y): a bounded sample, by hash, of labelled ids outside the held-out fold.

    The fold is crc32(doc_id as text) mod 5 = 0. Several labels of an id count as toxic if
    one does; null ids and null labels are left out.
    """
    usable = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    rows = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    return sampled(rows, F.xxhash64("doc_id"), most_rows)


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 30_000, columns: int = 4096, least_docs: int = 3, least_z: float = 2.0, ridge: float = 5e-5, swap: float = 1.0, steps: int = 400) -> Model:
    """Fit on at most ``most_rows`` labelled documents.

    Columns are the features whose log odds stand ``least_z`` standard errors from zero, so that
    a small sample brings few of them. Without any toxic or any clean document the score is constant.
    """
    chosen = stage(training_ids(labels, most_rows))
    if chosen.isEmpty():
        return Model(0.0, {})
    sample = F.broadcast(chosen)  # at most most_rows rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, "doc_id")
    texts = _distinct(texts, most_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
            rows = Counter()
            for y, n, text in (row for part in small([batch]) for row in zip(*(c.to_pylist() for c in part.columns))):
                seen[y].update(dict.fromkeys((f for w in word_set(text) for f in features_of(w)), n))
                rows[y] += n
            names = list(seen[0].keys() | seen[1].keys()) + [""]
            seen[0][""], seen[1][""] = rows[0], rows[1]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([seen[0][n] for n in names], pa.int64()), pa.array([seen[1][n] for n in names], pa.int64())], ["feature", "clean", "toxic"])

    counted = texts.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = counted.where("feature = ''").first()
    if totals is None or not totals["toxic"] or not totals["clean"]:
        rate = 0.0 if totals is None or not totals["toxic"] else 1.0
        return Model(math.log((rate + 0.01) / (1.01 - rate)), {})
    n0, n1 = float(totals["clean"]), float(totals["toxic"])
    odds = F.log((F.col("toxic") + 0.5) * (n0 + 1) / ((F.col("clean") + 0.5) * (n1 + 1)))
    spread = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    told = (F.col("feature") != "") & (F.col("clean") + F.col("toxic") >= least_docs) & (F.abs(odds / spread) >= least_z)
    best = counted.where(told).orderBy(F.desc(F.abs(odds / spread)), "feature").limit(columns)
    names = sorted({r["feature"] for r in best.select("feature").collect()} | set(GROUP_OF))
    index = {name: k for k, name in enumerate(names)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            on, swaps = [], []
            for text in batch.column(2).to_pylist():
                found = word_set(text)
                on.append(sorted({index[f] for w in found for f in features_of(w) if f in index}))
                swaps.append([index[x] for w in sorted(found & GROUP_OF.keys()) for other in GROUP_OF[w] if other != w for x in (w, other)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(on, pa.list_(pa.int32())), pa.array(swaps, pa.list_(pa.int32()))], ["y", "n", "features", "swaps"])

    rows = texts.mapInArrow(encode, "y int, n long, features array<int>, swaps array<int>").toArrow()
    discard(chosen)
    y, n = (rows.column(c).to_numpy().astype(float) for c in ("y", "n"))
    on, swaps = _lists(rows.column("features")), _lists(rows.column("swaps"))
    # Big-endian bytes compare like the lists.
    order = sorted(range(len(y)), key=lambda k: (y[k], n[k], on[k].astype(">u4").tobytes(), swaps[k].astype(">u4").tobytes()))
    weights, bias = _descend(y[order], n[order], [on[k] for k in order], [swaps[k] for k in order], len(names), [index[t] for t in GROUP_OF], ridge, swap, steps)
    return Model(bias, {name: float(w) for name, w in zip(names, weights) if w})


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as views of one array, not as Python objects."""
    held = column.combine_chunks()
    return np.split(held.flatten().to_numpy(), np.cumsum(held.value_lengths().to_numpy())[:-1]) if len(held) else []


def _distinct(texts: DataFrame, most: int) -> DataFrame:
    """Rows (y, n, text) from (doc_id, y, text): each text of an id once, n times in the table; at most ``most``, by hash."""
    keyed = texts.withColumn("h", F.xxhash64("text"))
    counted = keyed.groupBy("doc_id", "h").agg(F.first("y").alias("y"), F.count("*").alias("n"))
    chosen = F.broadcast(sampled(counted, F.xxhash64("doc_id", "h"), most))
    once = keyed.select("doc_id", "h", "text").join(chosen.select("doc_id", "h", "y", "n"), ["doc_id", "h"]).groupBy("doc_id", "h")
    return once.agg(F.first("y").alias("y"), F.first("n").alias("n"), F.min("text").alias("text")).select("y", "n", "text")


def _descend(y: np.ndarray, weight: np.ndarray, on: list[Iterable[int]], swaps: list[Iterable[int]], columns: int, identity: list[int], ridge: float, swap: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic loss with balanced classes by accelerated gradient steps scaled per column."""
    sizes = np.array([len(x) for x in on])
    col = np.concatenate([np.asarray(x, np.int64) for x in on]) if sizes.sum() else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(on)), sizes)
    pairs = np.concatenate([np.asarray(x, np.int64) for x in swaps] or [np.zeros(0, np.int64)]).reshape(-1, 2).astype(np.int64)
    share = weight * np.where(y > 0, 0.5 / max(1, (weight * y).sum()), 0.5 / max(1, (weight * (1 - y)).sum()))
    times = np.repeat(weight, [len(x) // 2 for x in swaps])
    w, b, m, v = np.zeros(columns), 0.0, np.zeros(columns + 1), np.zeros(columns + 1)
    ident = np.asarray(identity)
    for t in range(1, steps + 1):
        z = b + np.bincount(row, w[col], len(y))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        e = share * (p - y)
        g = np.bincount(col, e[row], columns) + ridge * w
        if len(pairs):
            gap = times * (w[pairs[:, 0]] - w[pairs[:, 1]])
            g += swap * (np.bincount(pairs[:, 0], gap, columns) - np.bincount(pairs[:, 1], gap, columns)) / times.sum()
        g[ident] += swap * w[ident]
        full = np.append(g, e.sum())
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full**2
        move = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score, predicted) of whole texts; null and empty texts get the score of no feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = model.scorer()
        for batch in small(batches):
            made = [rate(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.float64())], ["doc_id", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows scored at the threshold or above, in one pass over the texts."""
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = model.scorer()
        for batch in small(batches):
            yield batch.filter(pa.array([rate(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, schema)
