"""Patient profiles: terms, query texts, grounding and the extraction scorecard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NEGATION, gold_age_sex, grounded, localized

ENTITY = "array<struct<name:string,status:string,evidence:string>>"
LISTS = ("conditions", "biomarkers", "prior_treatments", "labs", "comorbidities")
TERM_FIELDS = ("conditions", "biomarkers", "prior_treatments", "comorbidities")
PROFILE = "age struct<value:double,unit:string,evidence:string>, sex struct<value:string,evidence:string>, " + ", ".join(f"{f} {ENTITY}" for f in LISTS)


def parse_profile(raw: Column) -> Column:
    """A profile from JSON; what is absent is null, and so is all of an unreadable one."""
    return F.from_json(raw, PROFILE)


def profile_terms(profile: Column, include_negated: bool = False) -> Column:
    """Names of the fields in order: trimmed, not empty, not negated, the first of those that differ only in case."""
    every = F.flatten(F.array(*(F.coalesce(profile[f], F.array().cast(ENTITY)) for f in TERM_FIELDS)))
    kept = every if include_negated else F.filter(every, lambda e: F.coalesce(e["status"], F.lit("")) != "negated")
    names = F.filter(F.transform(kept, lambda e: F.trim(F.coalesce(e["name"], F.lit("")))), lambda n: n != "")
    add = lambda acc, n: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(n)), acc).otherwise(F.concat(acc, F.array(n)))
    return F.aggregate(names, F.array().cast("array<string>"), add)


def profile_summary(profile: Column) -> Column:
    """`A 61-year-old female with: ...`; without an age (or with 0) `A patient`, without terms nothing after it."""
    age, sex = profile["age"]["value"], F.coalesce(profile["sex"]["value"], F.lit(""))
    who = F.when(F.coalesce(age, F.lit(0.0)) > 0, F.concat(age.cast("int").cast("string"), F.lit("-year-old "), F.when(sex == "", F.lit("patient")).otherwise(sex))).otherwise(F.when(sex == "", F.lit("patient")).otherwise(sex))
    terms = F.array_join(profile_terms(profile), ", ")
    return F.concat(F.lit("A "), who, F.when(terms == "", F.lit("")).otherwise(F.concat(F.lit(" with: "), terms)))


def build_query(profile: Column, narrative: Column, mode: str = "prof_narr", description: Column | None = None) -> Column:
    """`prof`: terms; `prof_narr`: narrative and terms; `hyde`: narrative and a written description of what would match. Without
    a profile, terms or description the narrative alone."""
    if mode == "hyde":
        return F.concat_ws("\n", narrative, description)
    terms = F.array_join(profile_terms(profile), " ")
    none = profile.isNull() | (terms == "")
    if mode == "prof":
        return F.when(none, narrative).otherwise(terms)
    if mode == "prof_narr":
        return F.when(none, narrative).otherwise(F.concat(narrative, F.lit("\n"), terms))
    raise ValueError(mode)


def schema_ok(profile: Column) -> Column:
    """Whether a profile has valid units, sexes, statuses and names; an absent field is valid."""
    ok = [F.coalesce(profile["age"]["unit"].isin("years", "months", "weeks", "days"), F.lit(True)), F.coalesce(profile["sex"]["value"].isin("male", "female"), F.lit(True))]
    ok.append(profile["age"].isNull() | profile["age"]["value"].isNotNull())
    ok += [F.coalesce(F.forall(profile[f], lambda e: F.coalesce(e["status"].isin("present", "negated"), F.lit(False)) & (F.length(F.coalesce(e["name"], F.lit(""))) > 0)), F.lit(True)) for f in LISTS]
    return profile.isNotNull() & reduce(lambda a, b: a & b, ok)


def verify_profile(profile: Column, narrative: Column) -> tuple[Column, Column]:
    """(clean, n_dropped): the profile without values whose evidence isn't in the narrative, and how many those are."""
    good = lambda e: F.coalesce(grounded(e["evidence"], narrative), F.lit(False))
    scalars = {f: F.when(good(profile[f]), profile[f]) for f in ("age", "sex")}
    lists = {f: F.filter(profile[f], good) for f in LISTS}
    lost = [F.when(profile[f].isNotNull() & ~good(profile[f]), 1).otherwise(0) for f in scalars] + [F.coalesce(F.size(profile[f]), F.lit(0)) - F.coalesce(F.size(lists[f]), F.lit(0)) for f in LISTS]
    sizes = lambda c: F.greatest(c, F.lit(0))
    return F.struct(*(v.alias(k) for k, v in (scalars | lists).items())), reduce(lambda a, b: a + b, map(sizes, lost))


def extract_profiles(narratives: DataFrame, provider, template: str = "{narrative}") -> DataFrame:
    """topic_id, narrative, profile, provider_status: one call per narrative. An unreadable or missing reply keeps its topic, with
    no profile, so that the narrative itself can be searched with."""
    from .providers import ask

    requests = narratives.select("topic_id", F.replace(F.lit(template), F.lit("{narrative}"), F.col("narrative")).alias("prompt"))
    r = ask(requests, provider).select("topic_id", "reply", "prompt_hash")
    parsed = F.when(F.get_json_object("reply", "$").isNotNull(), parse_profile(F.col("reply")))
    status = F.when(F.col("reply").isNull(), "none").when(F.col("profile").isNull(), "invalid").otherwise("ok")
    return narratives.join(r, "topic_id", "left").withColumn("profile", parsed).withColumn("provider_status", status).drop("reply")


def n_values(profile: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.when(profile[f].isNotNull(), 1).otherwise(0) for f in ("age", "sex")] + [F.greatest(F.coalesce(F.size(profile[f]), F.lit(0)), F.lit(0)) for f in LISTS])


def scorecard(records: DataFrame) -> DataFrame:
    """Per model: validity, grounding, localised evidence, age and sex against what the text states, negation recall, coverage
    and seconds. records has (model, narrative, profile, seconds); a share of nothing is null. Each record becomes one row
    of numbers first, so the aggregation moves no text."""
    p, text = F.col("profile"), F.col("narrative")
    clean, lost = verify_profile(p, text)
    age, unit, sex = gold_age_sex(text)
    r = records.select("model", "seconds", schema_ok(p).alias("ok"), n_values(p).alias("raw"), lost.alias("lost"), clean.alias("c"), age.alias("g_age"), unit.alias("g_unit"), sex.alias("g_sex"), text.rlike(NEGATION).alias("cue"))
    c = F.col("c")
    short = reduce(lambda a, b: a + b, [F.when(localized(c[f]["evidence"]) & c[f].isNotNull(), 1).otherwise(0) for f in ("age", "sex")] + [F.greatest(F.coalesce(F.size(F.filter(c[f], lambda e: localized(e["evidence"]))), F.lit(0)), F.lit(0)) for f in LISTS])
    negated = reduce(lambda a, b: a | b, [F.coalesce(F.exists(c[f], lambda e: e["status"] == "negated"), F.lit(False)) for f in LISTS])
    r = r.select("*", short.alias("short"), negated.alias("negated"))
    ok = F.col("ok")
    age_hit = (c["age"]["value"] == F.col("g_age")) & (F.coalesce(c["age"]["unit"], F.lit("years")) == F.col("g_unit"))
    total = lambda x: F.sum(F.when(ok, x).otherwise(0))
    n_if = lambda x: F.count_if(ok & F.coalesce(x, F.lit(False)))
    pct = lambda a, b: F.round(F.try_divide(100.0 * a, b), 6)
    held = total(F.col("raw") - F.col("lost"))
    return r.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), pct(F.count_if(ok), F.count(F.lit(1))).alias("schema_valid"), pct(held, total(F.col("raw"))).alias("grounding"), pct(total(F.col("short")), held).alias("localized"),
        pct(n_if(age_hit), n_if(F.col("g_age").isNotNull())).alias("age_acc"), pct(n_if(c["sex"]["value"] == F.col("g_sex")), n_if(F.col("g_sex").isNotNull())).alias("sex_acc"),
        F.round(F.coalesce(F.try_divide(held, F.count_if(ok)), F.lit(0.0)), 6).alias("coverage"), pct(n_if(F.col("cue") & F.col("negated")), n_if(F.col("cue"))).alias("neg_recall"), F.round(F.avg("seconds"), 6).alias("sec_per_call"),
    )
