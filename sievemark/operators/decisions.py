"""Per-criterion decisions in three states: planning, matching of answers, grounding, scores and re-ranking.

`satisfied`, `violated` and `unverifiable` stay apart throughout: silence never disqualifies. Tables of pairs, not of
decisions, are where aggregation starts, so that a pair whose decisions were all rejected isn't lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NEGATION_LEAD, grounded, quoted, supports
from .fusion import ranked
from .lexical import top_k

LABELS, RULES = ("satisfied", "violated", "unverifiable"), ("strict", "lenient", "count")
PER_CALL, REASONING_CHARS = 30, 300
PAIR = ["topic_id", "nct_id"]


def plan_work(run: DataFrame, topics: DataFrame, criteria: DataFrame, top_n: int) -> DataFrame:
    """topic_id, nct_id, rank, n_criteria: the first top_n of each known topic that have criteria."""
    n = criteria.groupBy("nct_id").agg(F.count(F.lit(1)).alias("n_criteria"))
    top = top_k(run.join(topics.select("topic_id"), "topic_id", "left_semi"), top_n, ["topic_id"])
    return top.withColumnRenamed("doc_id", "nct_id").join(n, "nct_id").select(*PAIR, "rank", "n_criteria")


def call_estimate(pairs: DataFrame, per_call: int = PER_CALL) -> DataFrame:
    """n_pairs, n_criteria, n_calls if criteria go in pieces of per_call."""
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.coalesce(F.sum("n_criteria"), F.lit(0)).alias("n_criteria"), F.coalesce(F.sum(F.ceil(F.col("n_criteria") / F.lit(float(per_call)))), F.lit(0)).cast("long").alias("n_calls"))


def todo(pairs: DataFrame, attempted: DataFrame, keys: list[str]) -> DataFrame:
    """Work that hasn't been attempted; what was attempted and failed isn't done again."""
    return pairs.join(attempted.select(*keys).distinct(), keys, "left_anti")


def match_answers(answers: DataFrame, criteria: DataFrame, order: str = "pos") -> DataFrame:
    """Answers with `reject_reason`: index_missing, index_unknown, index_duplicate, or null for the first answer to each
    criterion of the pair. An index counts as answered before grounding, so a bad first answer blocks later ones."""
    known = criteria.select("nct_id", F.col("idx").alias("criterion_idx"), F.lit(True).alias("_known")).distinct()
    nth = F.row_number().over(Window.partitionBy(*PAIR, "criterion_idx").orderBy(order))
    a = answers.join(known, ["nct_id", "criterion_idx"], "left").withColumn("_nth", nth)
    reason = F.when(F.col("criterion_idx").isNull(), "index_missing").when(F.col("_known").isNull(), "index_unknown").when(F.col("_nth") > 1, "index_duplicate")
    return a.withColumn("reject_reason", reason).drop("_known", "_nth")


def check_reason(label: Column, quote: Column, criterion: Column, evidence: Column, narrative: Column) -> Column:
    """Why a decision is rejected; null if it holds. An empty criterion quote passes; evidence may be empty only if nothing
    was verifiable."""
    empty = F.length(F.trim(F.coalesce(evidence, F.lit("")))) == 0
    ungrounded = ~grounded(evidence, narrative)
    unknown = ~F.coalesce(label.isin(*LABELS), F.lit(False))
    return (
        F.when(unknown, "label_invalid")
        .when(~quoted(quote, criterion), "criterion_quote_not_in_criterion")
        .when((label == "unverifiable") & (F.length(F.coalesce(evidence, F.lit(""))) == 0), None)
        .when((label != "unverifiable") & empty, "patient_evidence_empty")
        .when(ungrounded, "patient_evidence_not_in_narrative")
    )


def accept(checked: DataFrame) -> DataFrame:
    """Decisions that hold, with their reasoning cut to its longest length."""
    return checked.where("reject_reason is null").withColumn("reasoning", F.substring("reasoning", 1, REASONING_CHARS))


def rejection_summary(checked: DataFrame) -> DataFrame:
    """reject_reason, n, percent of all decisions, most frequent first."""
    total = F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1)))
    g = checked.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n")).withColumn("percent", F.round(100.0 * F.col("n") / total, 6))
    return g.where("reject_reason is not null").orderBy(F.desc("n"), "reject_reason")


def effective_section(section: Column, quote: Column) -> Column:
    """The section, or exclusion for an unknown one whose quote opens with a negation."""
    return F.when(section.isin("inclusion", "exclusion"), section).when(F.coalesce(quote, F.lit("")).rlike(NEGATION_LEAD), F.lit("exclusion")).otherwise(section)


def spread(raw: Column, low: float) -> Column:
    """[low, 1] onto [1e-6, 1]: never 0, which is for the disqualified."""
    return 1e-6 + (1.0 - 1e-6) * F.least(F.greatest((raw - low) / (1.0 - low), F.lit(0.0)), F.lit(1.0))


def trial_scores(pairs: DataFrame, decisions: DataFrame, infer_section: bool = True, rules: tuple[str, ...] = RULES) -> DataFrame:
    """Pairs with n, sat, unv, vio_any, vio_exc and a score column per rule; a pair without decisions scores 0."""
    section = effective_section(F.col("section"), F.col("criterion_quote")) if infer_section else F.col("section")
    is_ = lambda label: F.col("label") == label
    counts = decisions.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_("satisfied")).alias("sat"), F.count_if(is_("unverifiable")).alias("unv"), F.count_if(is_("violated")).alias("vio_any"), F.count_if(is_("violated") & (section == "exclusion")).alias("vio_exc"))
    names = ("n", "sat", "unv", "vio_any", "vio_exc")
    p = pairs.join(counts, PAIR, "left").fillna(0, list(names))
    n, half = F.col("n"), (F.col("sat") - 0.5 * F.col("unv")) / F.col("n")
    scored = {
        "strict": F.when(F.col("vio_any") > 0, 0.0).otherwise(spread(half, -0.5)),
        "lenient": F.when(F.col("vio_exc") > 0, 0.0).otherwise(spread(half - 0.3 * (F.col("vio_any") - F.col("vio_exc")) / n, -0.8)),
        "count": spread(F.col("sat") / n, 0.0),
    }
    return p.select("*", *(F.round(F.when(n == 0, 0.0).otherwise(scored[r]), 9).alias(r) for r in rules))


def rerank_by_eligibility(run: DataFrame, scores: DataFrame, rule: str = "strict", keep_unjudged: bool = True, demote: bool = False) -> DataFrame:
    """topic_id, nct_id, score: judged pairs by 1000 + 100 * score + tie, others by their tie alone, a number in (0, 1) from the
    first ranking. With `demote` the disqualified go below all others."""
    size = F.count(F.lit(1)).over(Window.partitionBy("topic_id"))
    r = ranked(run.withColumnRenamed("nct_id", "doc_id")).withColumn("tie", (size - (F.col("rank") - 1)) / (size + 1)).withColumnRenamed("doc_id", "nct_id")
    r = r.join(scores.select(*PAIR, F.col(rule).alias("_e")), PAIR, "left" if keep_unjudged else "inner")
    judged = 1000.0 + F.col("_e") * 100.0 + F.col("tie")
    if demote:
        judged = F.when(F.col("_e") == 0, -1000.0 + F.col("tie")).otherwise(judged)
    return r.select(*PAIR, F.round(F.when(F.col("_e").isNull(), F.col("tie")).otherwise(judged), 9).alias("score"))


def confusion(scores: DataFrame, qrels: DataFrame, rule: str = "strict") -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy of the eligible class on judged pairs: predicted if the score is above 0."""
    j = scores.join(qrels.select("topic_id", F.col("doc_id").alias("nct_id"), "rel"), PAIR)
    p, g = F.col(rule) > 0, F.col("rel") == 2
    c = j.agg(F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"), F.count_if(~p & ~g).alias("tn"))
    part = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("*", part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), part(2 * tp, 2 * tp + fp + fn).alias("f1"), part(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def label_stats(decisions: DataFrame) -> DataFrame:
    """n, counts of the three labels, and abstention: the share of unverifiable ones."""
    c = [F.count_if(F.col("label") == x).alias(x) for x in LABELS]
    return decisions.agg(F.count(F.lit(1)).alias("n"), *c).withColumn("abstention", F.round(F.coalesce(F.try_divide("unverifiable", F.col("n")), F.lit(0.0)), 6))


def forced(decisions: DataFrame) -> DataFrame:
    """Decisions without abstention: what can't be verified counts as violated for an exclusion and as satisfied otherwise."""
    label = F.when(F.col("label") != "unverifiable", F.col("label")).when(F.col("section") == "exclusion", "violated").otherwise("satisfied")
    return decisions.withColumn("label", label)


def relevant(decisions: DataFrame, exempt_demographic: bool = True) -> DataFrame:
    """Decisions that are unverifiable or whose evidence bears on the quote."""
    return decisions.where((F.col("label") == "unverifiable") | supports(F.col("patient_evidence"), F.col("criterion_quote"), exempt_demographic))


def relevance_filtered(pairs: DataFrame, decisions: DataFrame, exempt_demographic: bool = True) -> DataFrame:
    """Pairs with n_kept: decisions that are unverifiable or whose evidence bears on the quote. Pairs that lose all stay."""
    kept = relevant(decisions, exempt_demographic)
    return pairs.join(kept.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_kept")), PAIR, "left").fillna(0, ["n_kept"])


def sample_per_topic(pairs: DataFrame, n_topics: int, per: int) -> DataFrame:
    """The first `per` pairs of each of the first n_topics topics."""
    first = pairs.select("topic_id").distinct().orderBy("topic_id").limit(n_topics)
    return pairs.join(F.broadcast(first), "topic_id", "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("topic_id").orderBy("nct_id"))).where(F.col("_n") <= per).drop("_n")
