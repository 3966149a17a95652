"""From narratives to ranked documents: the batch function, the same on a stream, and the evaluation ladder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import decisions, evaluation, fusion, lexical, reasoning, report
from ..operators import profiles as profile
from ..operators.providers import Provider
from ..sources.store import stored

MAX_CHARS, TOP = 4000, 5


def valid(narratives: DataFrame) -> DataFrame:
    """Narratives with `refused`: empty or too_long, null for those that are served."""
    n = F.length(F.trim(F.coalesce("narrative", F.lit(""))))
    return narratives.withColumn("refused", F.when(n == 0, "empty").when(n > MAX_CHARS, "too_long"))


LEGS = ((1.8, 1.0), (0.9, 0.4))


def match_batch(narratives: DataFrame, index: lexical.Index, top: int = TOP, legs: Callable[[DataFrame], list[DataFrame]] | None = None, depth: int = 1000) -> DataFrame:
    """topic_id, doc_id, score, rank: the first documents of each valid narrative by fusing its legs. Without other legs, two
    lexical ones, tuned and default parameters, from one pass over the index."""
    ok = valid(narratives).where("refused is null").select("topic_id", "narrative")
    if legs is None:
        both = lexical.search_grid(index, ok, list(LEGS), "topic_id", "narrative", depth)
        runs = [both.where(F.col("k1") == k1).select("topic_id", "doc_id", "score") for k1, _ in LEGS]
    else:
        runs = legs(ok)
    return lexical.top_k(fusion.rrf(runs, [1.0 / len(runs)] * len(runs)), top, ["topic_id"])


@dataclass(frozen=True)
class Matched:
    """What a batch of narratives led to; every table is keyed by topic_id as text. profiles: per valid narrative; pairs: the
    candidates with their first rank; cards: report cards in the new order; events: one row per topic and stage."""

    profiles: DataFrame
    pairs: DataFrame
    cards: DataFrame
    events: DataFrame


def match_full(narratives: DataFrame, index: lexical.Index, criteria: DataFrame, extractor: Provider, reasoner: Provider, cache: str, top: int = TOP, rule: str = "strict") -> Matched:
    """From narratives to report cards: refusals, profiles, retrieval with the profile's terms, decisions on the first `top`
    candidates, eligibility scores, the new order.

    Every stage is a table over all topics, and a failure is a row in it: a topic without a profile is searched by its
    narrative, a pair whose model gave nothing readable keeps its first score. criteria has (nct_id, idx, section, text).
    """
    checked = valid(narratives.select(F.col("topic_id").cast("string").alias("topic_id"), "narrative"))
    ok = checked.where("refused is null").select("topic_id", "narrative")
    profiles = reasoning.extract(ok, extractor, f"{cache}/profiles")
    queries = profiles.select("topic_id", profile.build_query(F.col("profile"), F.col("narrative")).alias("narrative"))
    found = match_batch(queries.select("topic_id", F.substring("narrative", 1, MAX_CHARS).alias("narrative")), index, top)
    # a few rows a topic, which every later stage reads: stored, so that the search runs once
    pairs = stored(found.select("topic_id", F.col("doc_id").cast("string").alias("nct_id"), "score", "rank"), "pairs")
    decided = reasoning.reason(pairs, criteria, ok, reasoner, f"{cache}/decisions")
    kept = reasoning.accepted(decided)
    scores = decisions.trial_scores(pairs.select("topic_id", "nct_id"), kept)
    order = decisions.rerank_by_eligibility(pairs.select("topic_id", "nct_id", "score"), scores, rule)
    ranks = lexical.top_k(order, top, ["topic_id"], "nct_id").select("topic_id", "nct_id", "rank")
    cards = report.trial_cards(scores, kept, rule).join(ranks, ["topic_id", "nct_id"])
    n = lambda df, name: df.groupBy("topic_id").agg(F.count(F.lit(1)).alias(name))
    failed = n(decided.where("provider_status != 'ok'"), "failed")
    t = checked.join(profiles.select("topic_id", "provider_status"), "topic_id", "left").join(n(pairs, "pairs"), "topic_id", "left").join(failed, "topic_id", "left").fillna(0, ["pairs", "failed"])
    stage = lambda order, name, status: F.struct(F.lit(order).alias("ord"), F.lit(name).alias("stage"), status.alias("status"))
    refused = F.col("refused").isNotNull()
    stages = [
        stage(1, "validated", F.coalesce("refused", F.lit("ok"))),
        stage(2, "profiled", F.when(refused, "skipped").otherwise(F.coalesce("provider_status", F.lit("none")))),
        stage(3, "retrieved", F.when(refused, "skipped").when(F.col("pairs") == 0, "empty").otherwise("ok")),
        stage(4, "reasoned", F.when(refused | (F.col("pairs") == 0), "skipped").when(F.col("failed") > 0, F.format_string("%d failed", "failed")).otherwise("ok")),
    ]
    return Matched(profiles, pairs, cards, t.select("topic_id", F.inline(F.array(*stages))))


def serve(requests: DataFrame, index: lexical.Index, sink: Callable[[DataFrame, int], None], checkpoint: str, full: Callable[[DataFrame], Matched] | None = None):
    """Answers each micro-batch of a request stream and hands rows (topic_id, refused, documents) to a sink, refusals included.

    With `full` the stages' events go to the sink first, then the cards: rows (topic_id, event, status, documents). A batch
    that fails as a whole becomes an error row per topic, so the stream goes on.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        checked = valid(batch)
        if full is None:
            found = match_batch(batch, index).groupBy("topic_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("documents"))
            sink(checked.select("topic_id", "refused").join(found, "topic_id", "left"), batch_id)
            return
        none = F.array().cast("array<struct<rank:int,doc_id:string,score:double>>")
        try:
            out = full(batch)
            sink(out.events.select("topic_id", F.col("stage").alias("event"), "status", none.alias("documents")), batch_id)
            cards = out.cards.groupBy("topic_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("nct_id").alias("doc_id"), "score"))).alias("documents"))
            sink(cards.select("topic_id", F.lit("cards").alias("event"), F.lit("ok").alias("status"), "documents"), batch_id)
        except PySparkException as e:
            sink(checked.select(F.col("topic_id").cast("string").alias("topic_id"), F.lit("error").alias("event"), F.lit(type(e).__name__).alias("status"), none.alias("documents")), batch_id)

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ladder(runs: dict[str, DataFrame], qrels: DataFrame, topic: str = "topic_id") -> DataFrame:
    """system, topic, metric, value of several runs."""
    out = None
    for name, run in runs.items():
        m = evaluation.evaluate(run, qrels, topic).withColumn("system", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


def relevance_experiment(run: DataFrame, pairs: DataFrame, made: DataFrame, qrels: DataFrame, rule: str = "strict") -> DataFrame:
    """system, topic, metric, value of re-ranking by all decisions and by those alone whose evidence bears on the quote; `run` has
    (topic_id, nct_id, score), `made` the decisions."""
    systems = {"all": made, "relevant": decisions.relevant(made)}
    runs = {name: decisions.rerank_by_eligibility(run, decisions.trial_scores(pairs, d), rule).withColumnRenamed("nct_id", "doc_id") for name, d in systems.items()}
    return ladder(runs, qrels)
