"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes get learned vectors; filters of several widths slide over fixed-length windows of a text; each filter's largest
response and a softmax give the window's language. A text's prediction is the mean over all its windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import documents
from .textbytes import LOWER, Texts, releasing, slices


@dataclass(frozen=True)
class ByteConvNet:
    """window: bytes of a window; embed: numbers per byte; widths, filters: of the convolution; the rest: training.

    The network learns every language that an eligible row has, from about docs_per_language documents of each, chosen
    by a hash of the id, with windows_per_doc windows of each, spread over the whole text.
    """

    window: int = 128
    embed: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    epochs: int = 5
    batch: int = 64
    rate: float = 0.01
    docs_per_language: int = 600
    windows_per_doc: int = 3


def is_held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether the id's crc32, as text, falls into the part that is held out; a null id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(parts)) == part, F.lit(False))


def chosen_share(id_col: str, seed: int) -> Column:
    """A number in [0, 1) from a hash of the id."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


class Network:
    """The weights. All filters are stored at the widest width, the narrow ones padded with zeros that stay zero."""

    def __init__(self, how: ByteConvNet, n_classes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.how, wide, n = how, max(how.widths), len(how.widths) * how.filters
        self.mask = np.concatenate([np.repeat((np.arange(wide) < w).astype(np.float32)[:, None, None], how.embed, 1).repeat(how.filters, 2) for w in how.widths], 2).reshape(wide * how.embed, n)
        self.p = {"e": rng.normal(0, 0.5, (256, how.embed)), "f": rng.normal(0, 0.3, (wide * how.embed, n)) * self.mask, "b": np.zeros(n), "w": rng.normal(0, 0.1, (n, n_classes)), "c": np.zeros(n_classes)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _columns(self, x: np.ndarray) -> np.ndarray:
        """(n, window) bytes to (n, window, wide * embed): each place with the bytes after it."""
        how, wide = self.how, max(self.how.widths)
        v = np.zeros((len(x), how.window + wide - 1, how.embed), np.float32)
        v[:, : how.window] = self.p["e"][x]
        s = v.strides
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(v, (len(x), how.window, wide * how.embed), (s[0], s[1], s[2])))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.p["c"])), np.float32)
        for k in range(0, len(x), 256):
            cols = self._columns(x[k : k + 256])
            top = (cols.reshape(-1, cols.shape[2]) @ self.p["f"]).reshape(cols.shape[0], cols.shape[1], -1).max(1)
            z = np.maximum(top + self.p["b"], 0) @ self.p["w"] + self.p["c"]
            z = np.exp(z - z.max(1, keepdims=True))
            out[k : k + 256] = z / z.sum(1, keepdims=True)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        """Adam on the cross entropy; the order of samples is fixed, so the same sample gives the same network."""
        how, rng, wide = self.how, np.random.default_rng(11), max(self.how.widths)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(how.epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // how.batch)):
                xb, yb, n = x[at], y[at], len(at)
                cols = self._columns(xb)
                conv = (cols.reshape(-1, cols.shape[2]) @ self.p["f"]).reshape(n, how.window, -1)
                best = conv.argmax(1)
                top = np.take_along_axis(conv, best[:, None, :], 1)[:, 0] + self.p["b"]
                act = np.maximum(top, 0)
                z = act @ self.p["w"] + self.p["c"]
                z = np.exp(z - z.max(1, keepdims=True))
                dz = z / z.sum(1, keepdims=True)
                dz[np.arange(n), yb] -= 1
                dz /= n
                g = {"w": act.T @ dz, "c": dz.sum(0)}
                dtop = (dz @ self.p["w"].T) * (top > 0)
                g["b"] = dtop.sum(0)
                picked = cols[np.arange(n)[:, None], best]  # (n, filters, wide * embed)
                g["f"] = np.einsum("nk,nkd->dk", dtop, picked) * self.mask
                dcols = dtop[:, :, None] * self.p["f"].T[None]
                g["e"] = np.zeros_like(self.p["e"])
                for w in range(wide):
                    place = best + w
                    inside = place < how.window
                    byte = xb[np.arange(n)[:, None], np.minimum(place, how.window - 1)]
                    np.add.at(g["e"], byte[inside], dcols[:, :, w * how.embed : (w + 1) * how.embed][inside])
                step += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                    self.p[k] = (self.p[k] - how.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self


def windows(t: Texts, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of a slice's rows, zero after a row's end: bytes, row and filled length of each."""
    n = np.diff(t.at)
    count = -(-n // window)
    row = np.repeat(np.arange(t.rows), count)
    start = t.at[row] + (np.arange(len(row)) - (np.cumsum(count) - count)[row]) * window
    length = np.minimum(window, t.at[row + 1] - start)
    at = start[:, None] + np.arange(window)
    data = LOWER[t.data] if len(t.data) else np.zeros(1, np.uint8)
    x = data[np.minimum(at, len(data) - 1)]
    x[np.arange(window) >= length[:, None]] = 0
    return x, row, length


def train(docs: DataFrame, how: ByteConvNet, text_col: str, lang_col: str, id_col: str, eligible: Column) -> tuple[list[str], Network | None]:
    """Languages and a network, from a bounded sample of the rows that may be learned from: those that are eligible and have a
    language and a letter. Null ids are one id, so their rows are chosen together or not at all; no such rows, no network."""
    d = docs.where(eligible & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = d.groupBy(F.col(lang_col).alias("name")).agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return [], None
    names = sorted(r.name for r in counts)
    rate = F.element_at(F.create_map(*(F.lit(x) for r in counts for x in (r.name, how.docs_per_language / r.n))), F.col(lang_col))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slices(batch.column(1)):
                x, row, _ = windows(t, how.window)
                count = np.bincount(row, minlength=t.rows)
                place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
                every = np.maximum(1, -(-count // how.windows_per_doc))[row]
                keep = np.flatnonzero(place % every == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, t.rows).take(pa.array(row[keep])), pa.array([r.tobytes() for r in x[keep]], pa.binary())], names=["lang", "x"])

    sample = d.where(chosen_share(id_col, 4) < rate).select(F.col(lang_col), F.col(text_col)).mapInArrow(run, "lang string, x binary").toArrow()
    # rows come as partitions end; sorted, the same rows make the same network
    sample = sample.sort_by([("lang", "ascending"), ("x", "ascending")])
    x = np.array([np.frombuffer(v, np.uint8) for v in sample.column("x").to_pylist()])
    code = {name: k for k, name in enumerate(names)}
    y = np.array([code[v] for v in sample.column("lang").to_pylist()], np.int64)
    return names, Network(how, len(names)).fit(x, y) if len(x) else None


def judged(names: list[str], net: Network | None, text: Column) -> Column:
    """A struct of lang_pred and score, from the whole text; texts go to Python once and only the verdicts come back."""
    learned = pa.array([*names, "und"])

    @F.arrow_udf("lang_pred string, score double")
    def run(texts: pa.Array, letters: pa.Array) -> pa.Array:
        letter, best, score = letters.to_numpy(zero_copy_only=False), np.full(len(texts), len(names)), np.zeros(len(texts))
        for t in slices(texts, 1 << 18) if net is not None else ():
            x, row, length = windows(t, net.how.window)
            p = net.probabilities(x) * length[:, None]
            mass = np.stack([np.bincount(row, weights=p[:, k], minlength=t.rows) for k in range(len(names))], 1) / np.maximum(np.diff(t.at), 1)[:, None]
            here = slice(t.first, t.first + t.rows)
            best[here], score[here] = np.where(letter[here], mass.argmax(1), len(names)), np.where(letter[here], np.minimum(mass.max(1), 1.0).round(6), 0.0)
        return pa.StructArray.from_arrays([learned.take(pa.array(best)), pa.array(score)], names=["lang_pred", "score"])

    return run.asNondeterministic()(text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))


def identify_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", how: ByteConvNet = ByteConvNet(), eligible: Column | None = None) -> DataFrame:
    """doc_id, lang_pred, score: one row per input row, after learning from the eligible rows' text and language.

    Whole texts of any length are read, window by window. A null or empty text, or one without a letter, is `und` with score
    0, and so is everything if nothing could be learned. Ids may repeat or be null; repeated rows are judged alike, and of
    languages that tie the first by code point is taken. Other columns aren't read, so their names don't matter. An empty
    table gives an empty result.
    """
    names, net = train(docs, how, text_col, lang_col, id_col, F.lit(True) if eligible is None else eligible)
    return docs.select(F.col(id_col), judged(names, net, F.col(text_col)).alias("_v")).select(id_col, "_v.lang_pred", "_v.score")


def keep_readable(docs: DataFrame, least_score: float, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", how: ByteConvNet = ByteConvNet(), eligible: Column | None = None) -> DataFrame:
    """The rows of `docs` whose language can be told with at least that score, all columns as they are, whatever their names.

    The odd cases are those of `identify_languages`: what is `und` there goes.
    """
    names, net = train(docs, how, text_col, lang_col, id_col, F.lit(True) if eligible is None else eligible)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), judged(names, net, F.col(text_col)).alias("_v"))
    return rows.where((F.col("_v.lang_pred") != "und") & (F.col("_v.score") >= least_score)).select("_row.*")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language."""
    d = documents(spark, sf_dir)
    out = identify_languages(d, eligible=F.col("doc_id").isNotNull() & ~is_held_out("doc_id", 4, 2))
    return out.select("doc_id", is_held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
