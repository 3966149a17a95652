"""Second-stage scoring of the best documents with a pluggable joint model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .lexical import top_k

Scorer = Callable[[list[str], list[str]], list[float]]


def overlap_score(query: Column, text: Column) -> Column:
    """Stands in for a model: share of the query's distinct words that the text has."""
    q = F.array_distinct(tokens(query))
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(q, F.array_distinct(tokens(text)))), F.size(q)), F.lit(0.0)), 6)


def rerank(run: DataFrame, queries: DataFrame, docs: DataFrame, depth: int = 100, scorer: Scorer | None = None, topic: str = "topic_id") -> DataFrame:
    """topic, doc_id, score, rank of the first `depth` documents only, ordered by the new score.

    Ranks are cut first and texts joined after, so only texts that are scored are moved. queries has (topic, query),
    docs (doc_id, text).
    """
    top = top_k(run.select(topic, "doc_id", "score"), depth, [topic]).select(topic, "doc_id")
    pairs = top.join(queries, topic).join(docs.select("doc_id", "text"), "doc_id")
    if scorer is None:
        scored = pairs.select(topic, "doc_id", overlap_score(F.col("query"), F.col("text")).alias("score"))
    else:
        kinds = {c: pairs.schema[c].dataType.simpleString() for c in (topic, "doc_id")}

        def run_model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scorer(b.column(2).to_pylist(), b.column(3).to_pylist()), pa.float64())], names=[topic, "doc_id", "score"])

        scored = pairs.select(topic, "doc_id", "query", "text").mapInArrow(run_model, f"`{topic}` {kinds[topic]}, doc_id {kinds['doc_id']}, score double")
    return top_k(scored, depth, [topic])
