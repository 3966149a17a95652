"""Exact dense search: cosine of every query with every vector, the best chunk of a document, the best documents."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_words
from .lexical import top_k

#: Queries whose scores with a batch are held at once, and the most numbers of such a matrix.
QUERY_BLOCK, SCORES = 1024, 1 << 20

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dim: int = 64) -> Encoder:
    """Stands in for a model: term counts hashed into `dim` signed places. Texts that share words are close."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[row, h % dim] += 1 if h >> 60 & 1 else -1
        return out

    return encode


def encode_chunks(docs: DataFrame, encoder: Encoder, key: str = "doc_id", text_col: str = "text", size: int = 320, overlap: int = 40) -> DataFrame:
    """key, chunk_idx, vec: documents in chunks of words, each chunk encoded; the encoder is loaded once per worker."""
    kind = docs.schema[key].dataType.simpleString()
    chunks = docs.select(F.col(key), F.posexplode(chunk_words(F.col(text_col), size, overlap)).alias("chunk_idx", "chunk"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = encoder(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(vecs), pa.list_(pa.float32()))], names=[key, "chunk_idx", "vec"])

    return chunks.mapInArrow(run, f"`{key}` {kind}, chunk_idx int, vec array<float>")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed in the order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), F.lit(0.0))


def normalised(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """Vectors of length 1; those of length 0 stay as they are."""
    length = F.coalesce(F.nullif(F.sqrt(dot(F.col(vec), F.col(vec))), F.lit(0.0)), F.lit(1.0))
    return vectors.withColumn(vec, F.transform(vec, lambda x: (x / length).cast("float")))


def resident(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """Vectors that stay in the executors' memory (on their disks where that is short) for all searches to come."""
    from pyspark import StorageLevel

    return normalised(vectors, vec).persist(StorageLevel.MEMORY_AND_DISK)


def dense_search(queries: DataFrame, vectors: DataFrame, k: int, query_key: str = "query_id", doc_key: str = "doc_id", vec: str = "vec") -> DataFrame:
    """query_id, doc_id, score, rank: the k nearest documents by the cosine of their best chunk.

    Queries are a stated, bounded set, sent to each executor once. A part of a batch of vectors is one matrix product with
    a block of queries, of a bounded size, and only the k best of each query in it leave it. No pair is dropped that could
    be among the k: a document's best chunk is among its part's best, or k better documents are.
    """
    q = queries.select(query_key, vec).toArrow()
    ids, doc_kind = q.column(0).combine_chunks(), vectors.schema[doc_key].dataType.simpleString()
    m = np.array(q.column(1).to_pylist(), np.float64).reshape(len(ids), -1)
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
    query_kind = queries.schema[query_key].dataType.simpleString()
    sent = queries.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        step = max(1, SCORES // min(len(m), QUERY_BLOCK))
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                b = batch.slice(low, step)
                values = b.column(1)
                v = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
                docs, owner = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
                order = np.argsort(owner, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(owner[order]) > 0])
                for at in range(0, len(m), QUERY_BLOCK):
                    best = np.round(np.maximum.reduceat(m[at : at + QUERY_BLOCK] @ v[order].T, first, axis=1), 6)
                    # ties at the k-th place all go on; ranking decides among them
                    place = max(0, best.shape[1] - k)
                    kth = np.partition(best, place, axis=1)[:, place]
                    row, col = np.nonzero(best >= kth[:, None])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at + row)), pa.array(docs[col]), pa.array(best[row, col])], names=[query_key, doc_key, "score"])

    if not len(ids):
        return queries.select(query_key).limit(0).crossJoin(vectors.select(doc_key).limit(0)).select("*", F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    near = vectors.select(doc_key, vec).mapInArrow(run, f"`{query_key}` {query_kind}, `{doc_key}` {doc_kind}, score double")
    return top_k(near.groupBy(query_key, doc_key).agg(F.max("score").alias("score")), k, [query_key], doc_key)


def merge_shards(shards: list[DataFrame]) -> DataFrame:
    """Vector shards as one set. Chunks are keyed by (doc_id, chunk_idx), so nothing has to be renumbered; of a chunk that several
    shards have, the first shard's stays."""
    every = reduce(DataFrame.unionByName, (s.withColumn("_shard", F.lit(i)) for i, s in enumerate(shards)))
    names = shards[0].columns
    return every.groupBy("doc_id", "chunk_idx").agg(F.min_by(F.struct(*(c for c in names if c not in ("doc_id", "chunk_idx"))), "_shard").alias("_x")).select("doc_id", "chunk_idx", "_x.*")
