"""Grounded report cards and the mechanical audit of prose about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import numbers
from .decisions import PAIR

# Wordings that claim a state, a bare verdict, advice to enrol.
SAID = {"satisfied": "satisf|meets", "violated": "violat|disqualif|excludes", "unverifiable": "cannot be determined|not stated|unverifiable|no information"}
BARE_VERDICT = r"(?i)(?<!potentially )(?<!likely )\b(in)?eligible\b(?!.{0,40}clinician review)"
ENROL_ADVICE = r"(?i)\b(should|recommend\w*|advise\w*)\b[^.]{0,40}\benrol"


def headline(n: Column, satisfied: Column, violated: Column) -> Column:
    """Never a bare verdict: how many criteria are verified, and that a clinician has to review."""
    verdict = F.when(violated > 0, "Likely ineligible").otherwise("Potentially eligible")
    return F.format_string("%s — %d of %d criteria verified — requires clinician review.", verdict, satisfied + violated, n)


def trial_cards(scores: DataFrame, decisions: DataFrame, rule: str = "strict") -> DataFrame:
    """One row per pair with counts, headline, and its decisions in order as an array of structs."""
    row = F.struct("criterion_idx", "section", "label", "criterion_quote", F.coalesce("patient_evidence", F.lit("")).alias("patient_evidence"))
    rows = decisions.groupBy(*PAIR).agg(F.sort_array(F.collect_list(row)).alias("criteria"))
    s = scores.join(rows, PAIR, "left")
    return s.select(*PAIR, F.col(rule).alias("score"), F.col("n").alias("n_criteria"), F.col("sat").alias("n_satisfied"), F.col("vio_any").alias("n_violated"), F.col("unv").alias("n_unverifiable"), headline(F.col("n"), F.col("sat"), F.col("vio_any")).alias("headline"), "criteria")


def assemble(cards: DataFrame, claims: DataFrame, questions: int = 5) -> DataFrame:
    """Cards with the claims that cite a decided criterion, the number of unverifiable ones in place of their rows, and the first
    quotes to ask about. claims has (topic_id, nct_id, criterion_idx, text)."""
    c = claims.groupBy(*PAIR).agg(F.collect_list(F.struct("criterion_idx", "text")).alias("_claims"))
    decided = F.filter("criteria", lambda r: r["label"] != "unverifiable")
    open_ = F.slice(F.transform(F.filter("criteria", lambda r: r["label"] == "unverifiable"), lambda r: r["criterion_quote"]), 1, questions)
    cited = F.sort_array(F.filter("_claims", lambda x: F.exists(F.filter("criteria", lambda r: r["label"] != "unverifiable"), lambda r: r["criterion_idx"] == x["criterion_idx"])))
    out = cards.where("n_criteria > 0").join(c, PAIR, "left")
    return out.select(*PAIR, "headline", F.coalesce(F.size(decided), F.lit(0)).alias("n_decided"), F.coalesce(cited, F.array().cast("array<struct<criterion_idx:int,text:string>>")).alias("claims"), F.col("n_unverifiable").alias("n_unknown_collapsed"), open_.alias("open_questions"))


def audit_claims(claims: DataFrame, decisions: DataFrame, cards: DataFrame, strip_zeros: bool = False) -> DataFrame:
    """Claims with c1 (cites a criterion that exists), c2 (its wording, if it claims a state, claims the label), and c3 (no number
    that neither the criterion's card nor its counts have)."""
    source = decisions.groupBy(*PAIR).agg(F.concat_ws(" ", F.collect_list(F.concat_ws(" ", "criterion_quote", "patient_evidence"))).alias("_s"))
    counts = cards.select(*PAIR, F.concat_ws(" ", "n_criteria", "n_satisfied", "n_violated", "n_unverifiable", F.col("n_satisfied") + F.col("n_violated")).alias("_c"))
    label = decisions.select(*PAIR, "criterion_idx", "label")
    a = claims.join(label, [*PAIR, "criterion_idx"], "left").join(source, PAIR, "left").join(counts, PAIR, "left")
    low = F.lower(F.coalesce("text", F.lit("")))
    says = {k: low.rlike(p) for k, p in SAID.items()}
    any_ = says["satisfied"] | says["violated"] | says["unverifiable"]
    own = F.when(F.col("label") == "satisfied", says["satisfied"]).when(F.col("label") == "violated", says["violated"]).otherwise(says["unverifiable"])
    extra = F.array_except(numbers(F.col("text"), strip_zeros), numbers(F.concat_ws(" ", "_s", "_c"), strip_zeros))
    exists = F.col("label").isNotNull()
    return a.select(*PAIR, "criterion_idx", exists.alias("c1"), F.when(exists, ~any_ | own).alias("c2"), F.when(exists, F.size(extra) == 0).alias("c3"))


def audit_summary(summary: Column) -> Column:
    """c4: no bare verdict and no advice to enrol."""
    return ~(summary.rlike(BARE_VERDICT) | summary.rlike(ENROL_ADVICE))
