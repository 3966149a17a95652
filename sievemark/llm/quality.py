"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the bytes of whole Arrow batches. Trees are complete and stored as flat arrays, level by level, so
a batch goes through all of them with one indexing step per level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .langid import chosen_share, is_held_out
from .tables import documents, table
from .textbytes import NON_SPACE, Texts, byte_class, mix64, ngram_hashes, per_row, releasing, repeated, slices, span_hashes, spans

_CLASSES = {
    "upper": byte_class(lambda b: 0x41 <= b <= 0x5A),
    "lower": byte_class(lambda b: 0x61 <= b <= 0x7A),
    "digit": byte_class(lambda b: 0x30 <= b <= 0x39),
    "symbol": byte_class(lambda b: chr(b) in "#*$%&|<>{}[]=+~^_\\/@"),
    "stop": byte_class(lambda b: chr(b) in ".,;:"),
    "shout": byte_class(lambda b: chr(b) in "!?"),
    "newline": byte_class(lambda b: b == 0x0A),
    "beyond": byte_class(lambda b: b >= 0x80),
}
STATISTICS = ("words", "mean_word", "longest_word", "mean_line", "distinct_words", "repeated_3", "repeated_lines", "word_end_symbols", *_CLASSES)


def statistics(t: Texts) -> np.ndarray:
    """(rows, statistics) of a slice; an empty text has zeros."""
    w = spans(t, NON_SPACE)
    n_words, n_bytes = np.diff(w.of), np.diff(t.at)
    per_word, per_byte = 1 / np.maximum(n_words, 1), 1 / np.maximum(n_bytes, 1)
    size = w.end - w.start
    hashes = span_hashes(t.data, w.start, w.end)
    salt = mix64(w.row.astype(np.uint64))
    longest = np.zeros(t.rows)
    np.maximum.at(longest, w.row, size)
    out = [np.log1p(n_words), per_row(size, w.of) * per_word, np.log1p(longest)]
    lines = spans(t, ~_CLASSES["newline"])
    n_lines = np.diff(lines.of)
    out.append(np.log1p(n_bytes / np.maximum(n_lines, 1)))
    out.append(per_row((repeated(hashes + salt) != 2).astype(np.int64), w.of) * per_word)
    fits = np.flatnonzero(np.arange(len(hashes)) + 3 <= w.of[w.row + 1]) if len(hashes) else np.zeros(0, np.int64)
    again = np.zeros(len(hashes), np.int64)
    if len(fits):
        again[fits] = repeated(ngram_hashes(hashes, 3)[fits] + salt[fits]) == 2
    out.append(per_row(again, w.of) * per_word)
    same = repeated(span_hashes(t.data, lines.start, lines.end) + mix64(lines.row.astype(np.uint64))) == 2
    out.append(per_row(same.astype(np.int64), lines.of) / np.maximum(n_lines, 1))
    last = t.data[w.end - 1] if len(w.end) else t.data[:0]
    out.append(per_row((_CLASSES["symbol"] | _CLASSES["shout"])[last].astype(np.int64), w.of) * per_word)
    out += [per_row(c[t.data].astype(np.int64), t.at) * per_byte for c in _CLASSES.values()]
    return np.stack(out, 1).astype(np.float64)


@dataclass(frozen=True)
class BoostedTrees:
    """docs_per_class bounds the sample to learn from: about so many labelled documents of each class."""

    trees: int = 60
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    least_weight: float = 4.0
    penalty: float = 1.0
    docs_per_class: int = 10_000


class Forest:
    """Flat arrays: feature and bin of each inner node and value of each leaf, by tree; children of k are 2k+1 and 2k+2."""

    def __init__(self, how: BoostedTrees):
        self.how = how
        self.edges: np.ndarray = np.zeros((0, 0))
        self.base = 0.0
        inner = (1 << how.depth) - 1
        self.feature, self.bin = np.zeros((how.trees, inner), np.int64), np.full((how.trees, inner), how.bins, np.int64)
        self.leaf = np.zeros((how.trees, inner + 1))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[k], x[:, k], side="left") for k in range(x.shape[1])], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        """Newton boosting of the log loss on histograms of quantile bins."""
        how, inner = self.how, (1 << self.how.depth) - 1
        self.edges = np.quantile(x, np.linspace(0, 1, how.bins + 1)[1:-1], axis=0).T if len(x) else np.zeros((x.shape[1], how.bins - 1))
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        if not len(x) or y.min() == y.max():
            return self
        b, score, n_features = self.binned(x), np.full(len(y), self.base), x.shape[1]
        cell = b + np.arange(n_features) * how.bins
        for tree in range(how.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(how.depth):
                first, n = (1 << level) - 1, 1 << level
                flat = ((node - first)[:, None] * (n_features * how.bins) + cell).ravel()
                hist = [np.bincount(flat, np.repeat(v, n_features), n * n_features * how.bins).reshape(n, n_features, how.bins).cumsum(2) for v in (g, h)]
                gl, hl = hist
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + how.penalty) + (gt - gl) ** 2 / (ht - hl + how.penalty) - gt**2 / (ht + how.penalty)
                gain[(hl < how.least_weight) | (ht - hl < how.least_weight)] = 0
                best = gain.reshape(n, -1).argmax(1)
                split = gain.reshape(n, -1)[np.arange(n), best] > 1e-9
                self.feature[tree, first : first + n] = np.where(split, best // how.bins, 0)
                self.bin[tree, first : first + n] = np.where(split, best % how.bins, how.bins)
                node = 2 * node + 1 + (b[np.arange(len(y)), self.feature[tree, node]] > self.bin[tree, node])
            at = node - inner
            gs, hs = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
            self.leaf[tree] = -how.rate * gs / (hs + how.penalty)
            score += self.leaf[tree, at]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row: all trees at once, a level at a time."""
        b = self.binned(x)
        node = np.zeros((len(x), self.how.trees), np.int64)
        rows, trees = np.arange(len(x))[:, None], np.arange(self.how.trees)
        for _ in range(self.how.depth):
            node = 2 * node + 1 + (b[rows, self.feature[trees, node]] > self.bin[trees, node])
        z = self.base + self.leaf[trees, node - ((1 << self.how.depth) - 1)].sum(1)
        return 1 / (1 + np.exp(-z))


def train(docs: DataFrame, labels: DataFrame, how: BoostedTrees = BoostedTrees(), text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality") -> Forest:
    """A forest from a bounded sample of labelled documents; `labels` has only rows that may be learned from.

    Labels other than 0 and 1 and null ids teach nothing. Null and empty texts are learned as empty, texts of any length
    whole. Rows that repeat an id, in either table, count as often as they meet, and their order doesn't matter. Other
    columns aren't read, so their names don't matter. Without a labelled document, or with labels of one kind only, every
    score is that kind's share.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y"))
    counts = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    rate = F.lit(0.0)
    for y, n in counts.items():
        rate = F.when(F.col("_y") == y, how.docs_per_class / n).otherwise(rate)
    # about 20,000 rows of 16 bytes at most: bounded, so it may be broadcast
    chosen = known.where(chosen_share("_id", 2) < rate)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slices(batch.column(1)):
                x = statistics(t)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, t.rows), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["y", "x"])

    d = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    sample = d.join(F.broadcast(chosen), d["_doc"] == chosen["_id"]).select("_y", "_text").mapInArrow(run, "y int, x array<double>").toArrow()
    x = np.array(sample.column("x").to_pylist(), np.float64).reshape(-1, len(STATISTICS))
    y = np.array(sample.column("y").to_pylist(), np.float64)
    order = np.lexsort((*x.T, y))  # the same rows in any order make the same forest
    return Forest(how).fit(x[order], y[order])


def score_quality(docs: DataFrame, forest: Forest, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and score (the chance of label 1): one row per input row, from whole texts of any length.

    A null text counts as empty. Ids may repeat or be null, and repeated rows get equal scores. Other columns aren't read,
    so their names don't matter. An empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, t.rows), pa.array(forest.score(statistics(t)))], names=[id_col, "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, score double")


def predicted(score: Column, least: float = 0.3) -> Column:
    return F.when(score >= least, 1).otherwise(0)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from labels outside the held-out part."""
    d = documents(spark, sf_dir)
    forest = train(d, table(spark, sf_dir, "labels").where(~is_held_out("doc_id", 5, 0)))
    out = score_quality(d, forest)
    return out.select("doc_id", is_held_out("doc_id", 5, 0).alias("held_out"), "score", predicted(F.col("score")).alias("predicted"))
