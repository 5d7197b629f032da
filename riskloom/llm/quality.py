"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are taken of whole texts in the tasks. The trees are fitted with numpy on
the statistics of a bounded sample of labelled rows (`SAMPLE_ROWS`, taken by hash of the
id); they are complete trees of one depth, kept as flat arrays, so that a batch goes down
all trees together, one level a step.

Defined results: a null or empty text has all statistics 0 and is scored like any other;
without usable labels every score is 0.5; rows with a null label are not learned from;
repeated rows are scored each; equal gains take the first statistic and the lowest cut.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import as_texts, fresh_name, hash_remainder

#: Most labelled rows that a model is fitted on.
SAMPLE_ROWS = 20_000

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?;:()[]{}\"'/\\=+@^~`-_"
NOT_ASCII = bytes(range(128, 256))

STATISTICS = (
    "log_chars", "log_words", "word_length", "distinct_words", "top_word", "same_neighbours", "distinct_triples", "upper", "lower", "digits", "symbols", "marks",
    "not_ascii", "full_stops", "commas", "exclamations", "pipes", "log_lines", "line_words", "distinct_lines", "top_line", "entropy", "capital_words",
)


def statistics(text: str) -> list[float]:
    """The numbers that a text is judged by, each from 0 or on a log scale."""
    data = text.encode("utf-8", "replace")
    n, words = len(data), text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    k = len(words)
    share = lambda drop: (n - len(data.translate(None, drop))) / n
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    line_counts = Counter(lines)
    bytes_seen = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    p = bytes_seen[bytes_seen > 0] / n
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    return [
        math.log1p(n), math.log1p(k), n / k, len(counts) / k, max(counts.values()) / k, sum(map(eq, words, words[1:])) / k, triples / max(1, k - 2),
        share(UPPER), share(LOWER), share(DIGITS), share(SYMBOLS), share(MARKS), share(NOT_ASCII), text.count(".") / k, text.count(",") / k, text.count("!") / k, text.count("|") / k,
        math.log1p(len(lines)), k / len(lines), len(line_counts) / len(lines), max(line_counts.values()) / len(lines), float(-(p * np.log2(p)).sum()), sum(map(str.istitle, words)) / k,
    ]


def statistics_matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, len(STATISTICS))


@dataclass
class BoostedTrees:
    """Complete trees as arrays [tree, node]; a node's children are 2i+1 and 2i+2."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        if not len(x):
            return np.zeros(0)
        total = np.full(len(x), self.base)
        trees, inner = self.feature.shape
        if trees:
            tree = np.arange(trees)[None, :]
            at = np.zeros((len(x), trees), dtype=np.int64)
            for _ in range(int(math.log2(inner + 1))):
                value = np.take_along_axis(x, self.feature[tree, at], axis=1)
                at = 2 * at + 1 + (value > self.cut[tree, at])
            total = total + self.leaf[tree, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, damp: float = 1.0, least: float = 1.0) -> BoostedTrees:
    """Boosted logistic trees. Each statistic is cut at quantiles into `bins`; a level of a
    tree is chosen from the gradient sums of all its nodes by bin."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    empty = BoostedTrees(np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), 0.0)
    if not len(y):
        return empty
    rate_1 = (y.sum() + 0.5) / (len(y) + 1)
    empty.base = math.log(rate_1 / (1 - rate_1))
    if y.min() == y.max():
        return empty
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    code = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])  # code > i is value > cut i
    m, width = x.shape[1], bins
    flat = code + np.arange(m)[None, :] * width
    usable = np.array([[i < len(c) for i in range(width)] for c in cuts])
    feature, cut, leaf = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    score = np.full(len(y), empty.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            n = 1 << level
            place = (node[:, None] * (m * width) + flat).reshape(-1)
            g = np.bincount(place, np.repeat(grad, m), n * m * width).reshape(n, m, width)
            h = np.bincount(place, np.repeat(hess, m), n * m * width).reshape(n, m, width)
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + damp) + (gt - gl) ** 2 / (ht - hl + damp) - gt**2 / (ht + damp)
            gain[(hl < least) | (ht - hl < least) | ~usable[None]] = 0
            best = gain.reshape(n, -1).argmax(axis=1)
            split = gain.reshape(n, -1).max(axis=1) > 1e-9
            f, b = best // width, best % width
            at = np.arange(n) + n - 1
            feature[t, at] = f
            cut[t, at] = [cuts[i][j] if s else np.inf for i, j, s in zip(f, b, split, strict=True)]
            node = 2 * node + ((code[np.arange(len(y)), f[node]] > b[node]) & split[node])
        g, h = np.bincount(node, grad, leaves), np.bincount(node, hess, leaves)
        leaf[t] = rate * g / (h + damp)
        score = score + leaf[t][node]
    return BoostedTrees(feature, cut, leaf, empty.base)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int) -> DataFrame:
    """doc_id, text and label (0 or 1) of at most `sample_rows` labelled ids, chosen by hash of
    the id: one row for each, with the first of its texts in order, however many rows have the
    id. The chosen ids are bounded by that number and so can be broadcast."""
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, **settings) -> BoostedTrees:
    """A model of the labels. Of the sample, only the statistics come to the driver."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame(statistics_matrix(as_texts(b["text"])), columns=list(STATISTICS))
            out["label"], out["doc_id"] = b["label"].to_numpy(), b["doc_id"].to_numpy()
            yield out

    rows = labelled_sample(docs, labels, label, sample_rows).mapInPandas(measure, ", ".join(f"{s} double" for s in STATISTICS) + ", label int, doc_id long")
    got = rows.toPandas().sort_values("doc_id", kind="stable")
    return fit_trees(got[list(STATISTICS)].to_numpy(dtype=np.float64), got["label"].to_numpy(dtype=np.float64), **settings)


def quality_score(text: Column, model: BoostedTrees) -> Column:
    """Probability that the text's label is 1."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.predict(statistics_matrix(as_texts(batch))))

    return score(text)


def training_rows(labels: DataFrame, modulus: int, held_out: int) -> DataFrame:
    return labels.where(hash_remainder(F.col("doc_id"), modulus) != held_out)


def score_documents(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    model = fit_quality(docs, training_rows(labels, modulus, held_out))
    out = docs.select(F.col("doc_id"), (hash_remainder(F.col("doc_id"), modulus) == held_out).alias("held_out"), quality_score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: BoostedTrees, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, with their columns, whose text scores `least` or more."""
    name = fresh_name(docs, "quality_score")
    return docs.withColumn(name, quality_score(F.col(text), model)).where(F.col(name) >= least).drop(name)
