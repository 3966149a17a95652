"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled queue that is passed through as often as `max_repeats`. A queue entry's
virtual finish time is the number of tokens of its source up to and including it, over the source's target. All
entries are then taken in the order of finish times until the total budget is spent, so every source nears its
target at the same pace. Nothing is collected: running sums are taken inside hash buckets, whose offsets come from
the buckets' totals, so a source with a third of all rows is dealt out like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .licenses import count_pieces
from .tables import cut, documents

SPACES = r"[\x20\x09-\x0D]+"
#: So many sources at most are broadcast (some 40 bytes each).
BROADCAST_SOURCES = 100_000
_HASH_SPAN = float(1 << 48)


def text_size(text: Column) -> Column:
    """Number of words (runs of anything but the six ASCII spaces) of a text; null has none."""
    return F.coalesce(count_pieces(text, SPACES), F.lit(0)).cast("long")


def shuffle_key(id_col: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of the id's MD5: the same on every run and engine."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("null"))), 1, 12), 16, 10).cast("double") / F.lit(_HASH_SPAN)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), budget_share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """source, source_size, target: one row per distinct source.

    Sources by code point, null last, get the weights in turn. Targets share `budget_share` of all sizes by weight;
    none exceeds `max_repeats` times its source, and the excess is shared again among the others. That is a water
    level: with sources in the order of (limit / weight), the first k are at their limit and the others at the
    same level. The windows here run over one row per source, not over documents.
    """
    by_code = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(by_code) - 1) % len(weights) + 1).cast("int"))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    s = s.withColumn("limit", F.col("source_size") * F.lit(float(max_repeats)))
    below = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1))
    s = s.withColumn("left", F.sum("source_size").over(every) * F.lit(budget_share) - F.coalesce(F.sum("limit").over(below), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))))
    # the level rises with each source found at its limit and sinks once one below its limit is counted as such: the highest holds
    s = s.withColumn("level", F.max("level").over(every))
    return s.select("source", "source_size", F.least("limit", F.col("level") * F.col("weight")).alias("target"))


def _running(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds the running sum of `value` in each group by (bucket, *order), as offsets of buckets plus sums inside them."""
    totals = df.groupBy(*group, "bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*group, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = df.withColumn("_inside", F.sum(value).over(inside))
    on = [summed[c].eqNullSafe(totals[c]) for c in [*group, "bucket"]]
    return summed.join(totals, on).select(*(summed[c] for c in df.columns), (F.col("_inside") + F.col("_before")).alias(name))


def fair_mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), budget_share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per input row, repeats counted in `taken`.

    Only whole documents are taken, so a source can miss its target by a document. Entries that end at the same time
    are taken together or not at all. Null and empty texts have size 0 and nothing of them is taken. Null sources
    are a source of their own, last in order. Equal ids (repeated rows) are separate entries next to each other, by size,
    and null ids are one id. A very long text is one entry like any other. Other columns aren't read, so their names
    don't matter. An empty table, or one with no words, takes nothing.
    """
    sizes = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), text_size(F.col(text_col)).alias("size"), shuffle_key(F.col(id_col)).alias("key")))
    targets = cut(source_targets(sizes, weights, budget_share, max_repeats))
    n_rows, n_sources = sizes.count(), targets.count()
    n_buckets = max(1, math.isqrt(n_rows) // 2)  # so both buckets and their number grow as the square root
    total = targets.agg(F.sum("source_size").alias("size"), F.sum("target").alias("target")).first()
    budget = min((total.size or 0) * budget_share, total.target or 0.0)

    queue = _running(sizes.withColumn("bucket", F.floor(F.col("key") * n_buckets)), ["source"], ["key", "doc_id", "size"], "size", "upto")
    # a target is its source's weight in the queue; few sources are broadcast, many are joined by a shuffle
    at = targets.withColumnRenamed("source", "_source")
    queue = cut(queue.join(F.broadcast(at) if n_sources <= BROADCAST_SOURCES else at, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "size", "source_size", "target", "upto"))

    def finish(nth: Column) -> Column:
        return (F.col("upto") + nth * F.col("source_size")) / F.col("target")

    passes = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1)))
    entries = queue.where("size > 0 and target > 0").select("size", "source_size", "target", "upto", passes.alias("nth")).select("size", finish(F.col("nth")).alias("finish"))
    entries = entries.withColumn("bucket", F.floor(F.least(F.col("finish"), F.lit(4.0)) * n_buckets))
    # the range of finish times in which the budget ends: one row for each of at most 4 * n_buckets ranges
    spent = entries.groupBy("bucket").agg(F.sum("size").alias("sum"), F.max("finish").alias("finish")).withColumn("upto", F.sum("sum").over(Window.orderBy("bucket")))
    whole = spent.where(F.col("upto") <= budget).agg(F.max("bucket").alias("bucket"), F.max("upto").alias("upto"), F.max("finish").alias("finish")).first()
    beyond = spent.where(F.col("upto") > budget).agg(F.min("bucket").alias("bucket")).first().bucket
    edge = entries.where(F.col("bucket") == F.lit(beyond)).withColumn("upto", F.sum("size").over(Window.partitionBy("bucket").orderBy("finish")) + F.lit(whole.upto or 0))
    within = edge.where(F.col("upto") <= budget).agg(F.max("finish").alias("finish")).first().finish
    cutoff = within if within is not None else whole.finish if whole.finish is not None else -1.0
    taken = sum((F.when(finish(F.lit(n)) <= F.lit(cutoff), F.col("size")).otherwise(0) for n in range(max_repeats)), F.lit(0))
    return queue.select("doc_id", "size", "source_size", "target", F.when((F.col("size") > 0) & (F.col("target") > 0), taken).otherwise(0).cast("long").alias("taken"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return fair_mix(documents(spark, sf_dir)).withColumn("target", F.round("target", 6))


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^ 	-
]+', 'x', 'g'), '[ 	-
]', '', 'g'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 12))::UBIGINT::DOUBLE / 281474976710656.0::DOUBLE AS key FROM documents),
  s AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM d GROUP BY source),
  -- reshare the excess until none is above its limit: each round fixes those that are
  rounds AS (SELECT 0 AS nth, source, source_size, weight, false AS fixed, NULL::DOUBLE AS target FROM s
    UNION ALL
    SELECT nth + 1, source, source_size, weight, fixed OR share >= 2.0::DOUBLE * source_size, CASE WHEN fixed THEN target WHEN share >= 2.0::DOUBLE * source_size THEN 2.0::DOUBLE * source_size ELSE share END
    FROM (SELECT *, weight * (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) FILTER (fixed) OVER (), 0)) / sum(weight) FILTER (NOT fixed) OVER () AS share FROM rounds)
    WHERE nth < 40),
  t AS (SELECT source, source_size, target FROM rounds WHERE nth = 40),
  q AS (SELECT d.doc_id, d.size, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
  e AS (SELECT size, (upto + n * source_size)::DOUBLE / target AS finish FROM q, range(2) AS r(n) WHERE size > 0 AND target > 0),
  cut AS (SELECT max(finish) AS finish FROM (SELECT finish, sum(size) OVER (ORDER BY finish) AS upto FROM e) WHERE upto <= (SELECT least(sum(source_size) * 1.5::DOUBLE, sum(target)) FROM t))
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (CASE WHEN size > 0 AND target > 0 THEN size * ((upto::DOUBLE / target <= cut.finish)::INT + ((upto + source_size)::DOUBLE / target <= cut.finish)::INT) ELSE 0 END)::BIGINT AS taken
FROM q, cut
"""
