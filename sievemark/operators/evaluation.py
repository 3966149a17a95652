"""Ranked-list evaluation on long tables: qrels (topic, doc_id, rel) and runs (topic, doc_id, score).

Labels: 2 eligible, 1 excluded, 0 irrelevant. Three families: `official` counts 1 and 2, `eligible` only 2 (as 1), `cond` is
eligible on judged documents only. Missing topics: measures of the first kind come from topics that the run has,
`contamination`, `judged` and `eligible_recall` from all judged topics, 0 where the run has nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fusion import ranked


def eligible_only(qrels: DataFrame) -> DataFrame:
    return qrels.withColumn("rel", F.when(F.col("rel") == 2, 1).otherwise(0))


def condense(run: DataFrame, qrels: DataFrame, topic: str = "topic_id") -> DataFrame:
    """Only judged documents of a run."""
    return run.join(qrels.select(topic, "doc_id"), [topic, "doc_id"], "left_semi")


def label_counts(qrels: DataFrame) -> DataFrame:
    """rel, n for all three labels, 0 where one doesn't occur."""
    labels = qrels.sparkSession.range(3).select(F.col("id").cast("int").alias("rel"))
    return labels.join(qrels.groupBy(F.col("rel").cast("int").alias("rel")).agg(F.count(F.lit(1)).alias("n")), "rel", "left").select("rel", F.coalesce("n", F.lit(0)).alias("n"))


def _gain(rank: Column, rel: Column) -> Column:
    return rel / F.log2(rank + 1)


def trec_measures(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (5, 10), recall_at: int = 1000, topic: str = "topic_id") -> DataFrame:
    """topic, metric, value: ndcg_k (linear gain, log2 discount), p_k, recall_n, recip_rank and bpref of topics that the run has.

    The run and the judgments are each ranked once and meet in one join; all measures come from one aggregation.
    """
    ideal = qrels.where("rel > 0").withColumn("at", F.row_number().over(Window.partitionBy(topic).orderBy(F.desc("rel"), "doc_id")))
    ideal = ideal.groupBy(topic).agg(F.count(F.lit(1)).alias("R"), *(F.sum(F.when(F.col("at") <= k, _gain(F.col("at"), F.col("rel")))).alias(f"i{k}") for k in ks))
    pools = qrels.groupBy(topic).agg(F.count_if(F.col("rel") <= 0).alias("N"))
    r = ranked(run, topic).join(qrels.select(topic, "doc_id", "rel"), [topic, "doc_id"], "left")
    before = Window.partitionBy(topic).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("nonrel", F.coalesce(F.sum(F.when(F.col("rel") <= 0, 1).otherwise(0)).over(before), F.lit(0)))
    r = r.join(ideal, topic, "left").join(pools, topic, "left")
    hit = F.col("rel") > 0
    penalty = F.when(F.least("R", "N") > 0, F.least("nonrel", "R") / F.least("R", "N")).otherwise(0.0)
    aggs = []
    for k in ks:
        aggs += [F.sum(F.when(hit & (F.col("rank") <= k), _gain(F.col("rank"), F.col("rel")))).alias(f"d{k}"), F.count_if(hit & (F.col("rank") <= k)).alias(f"h{k}"), F.first(f"i{k}").alias(f"i{k}")]
    aggs += [F.first("R").alias("R"), F.count_if(hit & (F.col("rank") <= recall_at)).alias("hr"), F.min(F.when(hit, F.col("rank"))).alias("first"), F.sum(F.when(hit, 1 - penalty)).alias("bp")]
    a = r.groupBy(topic).agg(*aggs)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    values = {f"ndcg_{k}": zero(F.try_divide(f"d{k}", F.col(f"i{k}"))) for k in ks} | {f"p_{k}": F.col(f"h{k}") / k for k in ks}
    values |= {f"recall_{recall_at}": zero(F.try_divide("hr", F.col("R"))), "recip_rank": zero(1.0 / F.col("first")), "bpref": zero(F.try_divide("bp", F.col("R")))}
    return a.select(topic, F.inline(F.array(*(F.struct(F.lit(name).alias("metric"), F.round(v.cast("double"), 6).alias("value")) for name, v in values.items()))))


def _in_top(run: DataFrame, qrels: DataFrame, keep: Column, k: int, name: str, topic: str) -> DataFrame:
    """Documents among the first k whose judgment is kept, over k, for every judged topic."""
    top = ranked(run, topic).where(F.col("rank") <= k).select(topic, "doc_id")
    found = top.join(qrels.where(keep).select(topic, "doc_id"), [topic, "doc_id"]).groupBy(topic).agg(F.count(F.lit(1)).alias("n"))
    out = qrels.select(topic).distinct().join(found, topic, "left")
    return out.select(topic, F.lit(name).alias("metric"), F.round(F.coalesce("n", F.lit(0)) / k, 6).alias("value"))


def contamination_at(run: DataFrame, qrels: DataFrame, k: int = 10, topic: str = "topic_id") -> DataFrame:
    """Share of excluded documents in the first k places; the denominator is always k."""
    return _in_top(run, qrels, F.col("rel") == 1, k, f"contamination_{k}", topic)


def judged_at(run: DataFrame, qrels: DataFrame, k: int = 10, topic: str = "topic_id") -> DataFrame:
    return _in_top(run, qrels, F.lit(True), k, f"judged_{k}", topic)


def eligible_recall(run: DataFrame, qrels: DataFrame, k: int = 1000, topic: str = "topic_id") -> DataFrame:
    """Macro recall: one value per topic that has eligible documents."""
    top = ranked(run, topic).where(F.col("rank") <= k).select(topic, "doc_id", F.lit(1).alias("x"))
    g = qrels.where("rel = 2").select(topic, "doc_id").join(top, [topic, "doc_id"], "left").groupBy(topic)
    return g.agg(F.round(F.count("x") / F.count(F.lit(1)), 6).alias("value")).select(topic, F.lit(f"eligible_recall_{k}").alias("metric"), "value")


def micro_recall(run: DataFrame, gold: DataFrame, k: int, topic: str = "topic_id") -> DataFrame:
    """n_gold, n_found, recall over all topics together."""
    top = ranked(run, topic).where(F.col("rank") <= k).select(topic, "doc_id", F.lit(1).alias("x"))
    g = gold.select(topic, "doc_id").join(top, [topic, "doc_id"], "left")
    return g.agg(F.count(F.lit(1)).alias("n_gold"), F.count("x").alias("n_found"), F.round(F.try_divide(F.count("x"), F.count(F.lit(1))), 6).alias("recall"))


def evaluate(run: DataFrame, qrels: DataFrame, topic: str = "topic_id") -> DataFrame:
    """topic, metric, value of all families; names are family/measure."""
    elig = eligible_only(qrels)
    families = {"official": trec_measures(run, qrels, topic=topic), "eligible": trec_measures(run, elig, topic=topic), "cond": trec_measures(condense(run, qrels, topic), elig, topic=topic)}
    frames = [df.withColumn("metric", F.concat(F.lit(f"{name}/"), "metric")) for name, df in families.items()]
    own = [contamination_at(run, qrels, 10, topic), judged_at(run, qrels, 10, topic), eligible_recall(run, qrels, 1000, topic)]
    frames += [df.withColumn("metric", F.concat(F.lit("elig/"), "metric")) for df in own]
    return reduce(DataFrame.unionByName, (f.select(topic, "metric", "value") for f in frames))


def averages(metrics: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The mean of each metric over the topics that have it."""
    return metrics.groupBy(*by, "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n_topics"))


def missing_topics(run: DataFrame, qrels: DataFrame, topic: str = "topic_id") -> DataFrame:
    return qrels.select(topic).distinct().join(run.select(topic).distinct(), topic, "left_anti")


def adversarial_run(qrels: DataFrame) -> DataFrame:
    """A run that ranks excluded documents first, then eligible, then irrelevant ones."""
    return qrels.select(*(c for c in qrels.columns if c != "rel"), F.when(F.col("rel") == 1, 3.0).when(F.col("rel") == 2, 2.0).otherwise(1.0).alias("score"))


def grid_means(run: DataFrame, qrels: DataFrame, names: list[str], grid: list[tuple], metric: str, topic: str = "topic_id") -> DataFrame:
    """names, mean, n_topics: one measure's mean for every setting of a grid of runs, all settings evaluated in one plan.

    A topic of the grid is a setting with a topic; settings are a short list, so each judgment is repeated for all of them.
    """
    whole = F.struct(*names, topic)
    every = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, values, strict=True))) for values in grid))
    q = qrels.select(topic, "doc_id", "rel", F.inline(every)).select(whole.alias("_topic"), "doc_id", "rel")
    m = trec_measures(run.select(whole.alias("_topic"), "doc_id", "score"), q, topic="_topic").where(F.col("metric") == metric)
    return averages(m.select(*(F.col("_topic")[n].alias(n) for n in names), "metric", "value"), tuple(names)).drop("metric")


def self_test(spark) -> DataFrame:
    """check, ok: the measures against values worked out by hand, and two orderings that any right measure has."""
    import math

    labels = [2, 1, 0, 2, 1, 0, 0, 2, 0, 1, 2]
    rows = [("t", f"d{k:02d}", rel, float(len(labels) - k)) for k, rel in enumerate(labels)]
    df = spark.createDataFrame(rows, "topic_id string, doc_id string, rel int, score double")
    run, qrels = df.drop("rel"), df.drop("score")
    gain = lambda xs: sum(x / math.log2(k + 2) for k, x in enumerate(xs[:10]))
    own = [int(x == 2) for x in labels]
    want = {"official/ndcg_10": gain(labels) / gain(sorted(labels, reverse=True)), "eligible/ndcg_10": gain(own) / gain(sorted(own, reverse=True)), "elig/contamination_10": 0.3, "elig/judged_10": 1.0}
    got = {r.metric: r.value for r in evaluate(run, qrels).collect()}
    bad = {r.metric: r.value for r in evaluate(adversarial_run(qrels), qrels).collect()}
    checks = [(name, abs(got[name] - value) < 1e-6) for name, value in want.items()]
    checks.append(("adversarial: eligible below official", bad["eligible/ndcg_10"] < bad["official/ndcg_10"]))
    checks.append(("adversarial: more contamination", bad["elig/contamination_10"] >= got["elig/contamination_10"]))
    return spark.createDataFrame(checks, "check string, ok boolean")
