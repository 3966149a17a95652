"""Rule-based triage of excluded documents that still stand in the first places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_words
from .decisions import PAIR, effective_section

# Sweeping negatives, and criteria that a stated sex settles.
GLOBAL_NEGATION = r"(?i)no (other |known |significant )*(medical (problems|conditions|history)|other medical|history of any)|medical history is (not significant|unremarkable)|otherwise healthy|prior medical condition is unremarkable|no significant medical history|takes no medications|has not received any treatment|is unremarkable|no known medical problems|does not (smoke|use)|no other medical"
FEMALE_ONLY = r"(?i)pregnan|breast.?feed|lactating|postmenopausal|menarche|vaginal bleed|endometri|uterus|women with|female (patients|subject)"
MALE_SUBJECT = r"(?i)\b(man|male|boy|his)\b"


def _n(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def _flags(cases: DataFrame, decisions: DataFrame, narratives: DataFrame) -> DataFrame:
    d = cases.select(*PAIR).join(decisions, PAIR).join(narratives, "topic_id")
    return d.withColumn("eff", effective_section(F.col("section"), F.col("criterion_quote"))).withColumn("ev", F.coalesce("patient_evidence", F.lit("")))


def visible_sections(criteria: DataFrame, records: DataFrame) -> DataFrame:
    """nct_id, n_criteria, n_inclusion, n_exclusion, n_unknown, has_exclusion_header: what a reasoner was shown of each record, 0 and
    all for one without criteria. records has (nct_id, criteria_raw)."""
    sections = ["inclusion", "exclusion", "unknown"]
    c = criteria.groupBy("nct_id").pivot("section", sections).count().select("nct_id", *(F.col(s).alias(f"n_{s}") for s in sections))
    names = [f"n_{s}" for s in sections]
    r = records.select("nct_id", F.coalesce(F.col("criteria_raw").rlike("(?i)exclusion"), F.lit(False)).alias("has_exclusion_header")).join(c, "nct_id", "left").fillna(0, names)
    return r.select("nct_id", (F.col(names[0]) + F.col(names[1]) + F.col(names[2])).alias("n_criteria"), *names, "has_exclusion_header")


def triage(cases: DataFrame, decisions: DataFrame, narratives: DataFrame, visible: DataFrame) -> DataFrame:
    """Cases (topic_id, nct_id, reasoned, strict) with `bucket`, by the first rule that holds: unreasoned, flagged, parsing,
    extraction, reasoning, ambiguous. visible has (nct_id, n_criteria, has_exclusion_header)."""
    d = _flags(cases, decisions, narratives)
    shared = F.size(F.array_intersect(content_words(F.col("criterion_quote"), True), content_words(F.col("narrative"), True)))
    flags = d.groupBy(*PAIR).agg(_n(F.col("eff") == "exclusion").alias("n_excl"), _n((F.col("label") == "unverifiable") & (shared >= 2)).alias("n_said"), _n((F.col("label") == "satisfied") & (F.col("eff") == "exclusion") & (F.trim("ev") != "")).alias("n_cleared"))
    c = cases.join(flags, PAIR, "left").join(visible, "nct_id", "left").fillna(0, ["n_excl", "n_said", "n_cleared", "n_criteria"])
    bucket = F.when(~F.col("reasoned"), "unreasoned").when(F.col("strict") == 0, "flagged").when((F.col("n_excl") == 0) & F.coalesce("has_exclusion_header", F.lit(False)), "parsing").when(F.col("n_criteria") <= 2, "parsing")
    return c.select(*PAIR, bucket.when(F.col("n_said") > 0, "extraction").when(F.col("n_cleared") > 0, "reasoning").otherwise("ambiguous").alias("bucket"))


def taxonomy(cases: DataFrame, decisions: DataFrame, narratives: DataFrame, criteria: DataFrame) -> DataFrame:
    """Cases (topic_id, nct_id, strict) with bucket, unsupported, n_global_neg, n_zero_overlap, n_demographic_ok: a ranking
    artefact (A), an irrelevant quote (B1), an overreaching negation (B2), dominated by unverifiable ones (C), or other (D)."""
    d = _flags(cases, decisions, narratives).drop("section").join(criteria.select("nct_id", F.col("idx").alias("criterion_idx"), F.col("section").alias("c_section"), F.col("text").alias("c_text")), ["nct_id", "criterion_idx"])
    cleared = (F.col("c_section") == "exclusion") & (F.col("label") == "satisfied")
    demographic = F.col("c_text").rlike(FEMALE_ONLY) & F.col("narrative").rlike(MALE_SUBJECT)
    sweeping = F.col("ev").rlike(GLOBAL_NEGATION)
    overlap = F.coalesce(F.arrays_overlap(content_words(F.col("ev")), content_words(F.col("c_text"))), F.lit(False))
    flags = d.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), _n(F.col("label") == "unverifiable").alias("unv"), _n(cleared & demographic).alias("n_demographic_ok"), _n(cleared & ~demographic & sweeping).alias("n_global_neg"), _n(cleared & ~demographic & ~sweeping & ~overlap).alias("n_zero_overlap"))
    names = ["n", "unv", "n_demographic_ok", "n_global_neg", "n_zero_overlap"]
    c = cases.join(flags, PAIR, "left").fillna(0, names).withColumn("unsupported", F.col("n_global_neg") + F.col("n_zero_overlap"))
    bucket = F.when(F.col("strict") == 0, "A_ranking_artifact").when((F.col("unsupported") == 0) & (F.col("unv") >= 0.6 * F.greatest("n", F.lit(1))), "C_unverifiable_dominated").when(F.col("unsupported") == 0, "D_other").when(F.col("n_global_neg") >= F.col("n_zero_overlap"), "B2_global_negation_overreach").otherwise("B1_irrelevant_quote")
    seen = lambda x: F.when(F.col("strict") == 0, 0).otherwise(F.col(x)).cast("long").alias(x)
    return c.select(*PAIR, bucket.alias("bucket"), *(seen(x) for x in ("unsupported", "n_global_neg", "n_zero_overlap", "n_demographic_ok")))


def bucket_counts(cases: DataFrame) -> DataFrame:
    """bucket, n, n_topics, percent."""
    from pyspark.sql import Window

    total = F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1)))
    return cases.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("topic_id").alias("n_topics")).withColumn("percent", F.round(100.0 * F.col("n") / total, 6))
