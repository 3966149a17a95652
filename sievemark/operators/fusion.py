"""Rank fusion and what two runs add to each other. Runs have (topic, doc_id, score)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(run: DataFrame, topic: str = "topic_id") -> DataFrame:
    """A run with its ranks by (score desc, doc asc)."""
    return run.withColumn("rank", F.row_number().over(Window.partitionBy(topic).orderBy(F.desc("score"), "doc_id")))


def _summed(legs: list[DataFrame], topic: str) -> DataFrame:
    return reduce(DataFrame.unionByName, legs).groupBy(topic, "doc_id").agg(F.round(F.sum("part"), 9).alias("score"))


def rrf(runs: list[DataFrame], weights: list[float] | None = None, k: int = 60, topic: str = "topic_id") -> DataFrame:
    """Reciprocal rank fusion: the sum of weight / (k + rank) over the runs that have a document."""
    weights = weights or [1.0] * len(runs)
    return _summed([ranked(r, topic).select(topic, "doc_id", (F.lit(w) / (k + F.col("rank"))).alias("part")) for r, w in zip(runs, weights, strict=True)], topic)


def _scaled(how: str, topic: str) -> Column:
    over = Window.partitionBy(topic)
    low, span = (F.min("score").over(over), F.max("score").over(over) - F.min("score").over(over)) if how == "minmax" else (F.avg("score").over(over), F.stddev_pop("score").over(over))
    return F.when(span > 0, (F.col("score") - low) / span).otherwise(0.0)


def wsum(runs: list[DataFrame], weights: list[float], how: str = "minmax", topic: str = "topic_id") -> DataFrame:
    """Weighted sum of scores, scaled in each topic and run by `minmax` or `zscore` (population). A document that a run
    doesn't have gets 0 from it: the lowest value under minmax, the mean under zscore."""
    return _summed([r.select(topic, "doc_id", (F.lit(w) * _scaled(how, topic)).alias("part")) for r, w in zip(runs, weights, strict=True)], topic)


def rrf_sweep(a: DataFrame, b: DataFrame, weights: list[float], k: int = 60, topic: str = "topic_id") -> DataFrame:
    """weight, topic, doc_id, score for every weight of the first run, from one pass over both."""
    legs = [ranked(r, topic).select(topic, "doc_id", (1.0 / (k + F.col("rank"))).alias(name)) for r, name in ((a, "x"), (b, "y"))]
    both = legs[0].join(legs[1], [topic, "doc_id"], "full")
    each = F.array(*(F.struct(F.lit(w).alias("weight"), F.round(F.lit(w) * F.coalesce("x", F.lit(0.0)) + F.lit(1 - w) * F.coalesce("y", F.lit(0.0)), 9).alias("score")) for w in weights))
    return both.select(topic, "doc_id", F.inline(each))


def complementarity(gold: DataFrame, a: DataFrame, b: DataFrame, k: int, topic: str = "topic_id") -> DataFrame:
    """n_gold, both, only_a, only_b, neither, in_union: shares of all relevant documents among the first k of two runs."""
    top = lambda r, name: ranked(r, topic).where(F.col("rank") <= k).select(topic, "doc_id", F.lit(1).alias(name))
    g = gold.select(topic, "doc_id").join(top(a, "x"), [topic, "doc_id"], "left").join(top(b, "y"), [topic, "doc_id"], "left")
    x, y, n = F.col("x").isNotNull(), F.col("y").isNotNull(), F.count(F.lit(1))
    share = lambda c: F.round(F.try_divide(F.count_if(c), n), 6)
    return g.agg(n.alias("n_gold"), share(x & y).alias("both"), share(x & ~y).alias("only_a"), share(~x & y).alias("only_b"), share(~x & ~y).alias("neither"), share(x | y).alias("in_union"))
