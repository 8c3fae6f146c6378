"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a text come from one vectorised pass over its bytes and words. Trees are grown by gradient histograms on
quantile bins from a bounded sample of labelled rows, then laid out as flat arrays (feature, threshold, leaf value) which
numpy walks for a whole batch of documents at once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.llm.common import byte_slices, utf8

FEATURES = (
    "log_bytes", "log_words", "mean_word", "upper", "digit", "space", "newline", "non_ascii", "punctuation", "exclaim", "symbol", "bar",
    "distinct_words", "top_word", "same_as_before", "distinct_pairs", "distinct_lines", "mean_line", "sentence_words", "compressed",
)
#: Labelled rows used for training at most, taken in the order of a hash of their id.
TRAIN_ROWS = 40_000

_CLASSES = {
    "upper": range(65, 91), "digit": range(48, 58), "space": (32, 9), "newline": (10, 13), "non_ascii": range(128, 256),
    "punctuation": b".,;:?'\"()-", "exclaim": b"!", "symbol": b"#$%&*+<=>@[]\\^_`{}~/", "bar": b"|",
}
_MEMBERS = np.array([[c in set(v) for c in range(256)] for v in _CLASSES.values()], float).T


def statistics(text: bytes) -> list[float]:
    """The features of one text, in the order of ``FEATURES``; an empty text gives zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _MEMBERS
    words, lines = text.split(), text.split(b"\n")
    n = max(len(words), 1)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    stops = text.count(b". ") + text.count(b".\n") + text.count(b"? ") + text.count(b"! ") + 1
    return [
        np.log1p(len(text)), np.log1p(len(words)), (len(text) - shares[2] - shares[3]) / n, *(shares / len(text)),
        len(counts) / n, max(counts.values(), default=0) / n, sum(map(bytes.__eq__, words, words[1:])) / n, pairs / n,
        len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)), len(words) / stops, len(zlib.compress(text, 1)) / len(text),
    ]


@dataclass
class Forest:
    """Flat trees of one depth: node k of tree t has children 2k+1 and 2k+2; values belong to the last level."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += value[at - len(feature)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 4.0) -> Forest:
    """Newton boosting of the logistic loss on quantile bins.

    Without rows the score is 0.5, with one class it is the smoothed share of that class.
    """
    n, width = x.shape
    inner, leaves = 2**depth - 1, 2**depth
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    forest = Forest(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), base, depth)
    if not 0 < y.sum() < n:
        return Forest(forest.feature[:0], forest.threshold[:0], forest.value[:0], base, depth)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)])
    total = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            local = at - first
            best, cut, column = np.full(nodes, 1e-6), np.full(nodes, -1), np.zeros(nodes, np.int64)
            for j in range(width):
                key = local * bins + binned[j]
                gl = np.bincount(key, g, nodes * bins).reshape(nodes, bins).cumsum(1)
                hl = np.bincount(key, h, nodes * bins).reshape(nodes, bins).cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < least) | (ht - hl < least)] = -1
                gain[:, len(edges[j]) :] = -1
                k = gain.argmax(1)
                better = gain[np.arange(nodes), k] > best
                best, cut, column = np.where(better, gain[np.arange(nodes), k], best), np.where(better, k, cut), np.where(better, j, column)
            for k in np.flatnonzero(cut >= 0):
                forest.feature[t, first + k], forest.threshold[t, first + k] = column[k], edges[column[k]][cut[k]]
            at = 2 * at + 1 + (x[np.arange(n), forest.feature[t, at]] > forest.threshold[t, at])
        leaf = at - inner
        forest.value[t] = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1)
        total += forest.value[t, leaf]
    return forest


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = TRAIN_ROWS) -> Forest:
    """Train on the given labels (columns doc_id and ``label``; nulls are skipped, repeated ids count once).

    At most ``max_rows`` labelled ids are used, chosen by a hash of the id; only their statistics reach the driver.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("y", "text")  # bounded by max_rows

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches):
            x = np.array([statistics(t) for t in utf8(batch.column("text"))]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("y"), *x.T], ["y", *FEATURES])

    found = rows.mapInArrow(features, "y double, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas().to_numpy(float)
    found = found.reshape(-1, len(FEATURES) + 1)
    found = found[np.lexsort(found.T)]  # the fit must not depend on the order of arrival
    return grow(found[:, 1:], found[:, 0])


def score(docs: DataFrame, forest: Forest, column: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 for every row, empty and null texts included (null counts as empty).

    A column named like ``column`` is replaced.
    """
    names = [c for c in docs.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches):
            x = np.array([statistics(t) for t in utf8(batch.column("text"))]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(forest.score(x), pa.float64())], [*names, column])

    kept = docs.select(*names)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(column, T.DoubleType())]))


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches ``threshold``, with their own columns."""
    return score(docs, fit(docs, labels), "_pl_score").where(F.col("_pl_score") >= threshold).select(*docs.columns)


def training_rows(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out fold: crc32 of the id as text, modulo 5, is not 0."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
