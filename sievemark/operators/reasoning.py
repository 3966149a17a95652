"""Model-backed steps as resumable operators: what was attempted is kept in a cache, and only the rest is asked for.

Each step is one plan: what is to do (an anti join with the cache), prompts, calls in Arrow batches on executors, an
appended cache, and the result read back from it. A job that ends half-way therefore goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import read_cache
from ..sources.sinks import append_cache
from .decisions import PAIR, PER_CALL, REASONING_CHARS, check_reason, match_answers, todo
from .profiles import parse_profile
from .providers import Provider, answers, ask, prompt_hash, prompts

_DECISION = "criterion_idx:int,section:string,label:string,criterion_quote:string,patient_evidence:string,reasoning:string,reject_reason:string"
#: What a cache of decisions, and one of single replies, has beside its partitions.
PAIR_CACHE = f"topic_id string, nct_id string, n_criteria long, provider_status string, decisions array<struct<{_DECISION}>>"
REPLY_CACHE = "topic_id string, reply string"


def _partitions(df: DataFrame, year: int, model: str, mode: str, prompt_hash: str) -> DataFrame:
    parts = {"year": year, "model": model, "mode": mode, "prompt_hash": prompt_hash}
    return df.select("*", *(F.lit(v).alias(k) for k, v in parts.items()))


def decide(pairs: DataFrame, criteria: DataFrame, narratives: DataFrame, provider: Provider, per_call: int = PER_CALL) -> DataFrame:
    """One row per pair in the schema of PAIR_CACHE: prompts in pieces of per_call criteria (1: each criterion by itself), answers
    matched to criteria, checked and cut to length. A pair whose provider gave nothing readable has its status and no
    decisions, so one bad reply doesn't end the others.

    criteria has (nct_id, idx, section, text), narratives (topic_id, narrative); pairs without criteria aren't asked about.
    """
    replies = ask(prompts(pairs.select(*PAIR), criteria, narratives, per_call), provider)
    given = match_answers(answers(replies).where("label is not null or criterion_idx is not null"), criteria)
    own = criteria.select("nct_id", F.col("idx").alias("criterion_idx"), "section", F.col("text").alias("_text"))
    d = given.join(own, ["nct_id", "criterion_idx"], "left").join(narratives, "topic_id")
    reason = F.coalesce("reject_reason", check_reason(F.col("label"), F.col("criterion_quote"), F.col("_text"), F.col("patient_evidence"), F.col("narrative")))
    d = d.withColumn("reject_reason", reason).withColumn("reasoning", F.substring("reasoning", 1, REASONING_CHARS))
    rows = d.groupBy(*PAIR).agg(F.sort_array(F.collect_list(F.struct("pos", F.struct(*(x.split(":")[0] for x in _DECISION.split(","))).alias("d")))).alias("_d"))
    worst = F.when(F.bool_or(F.col("reply").isNull()), "none").when(F.bool_or(F.get_json_object("reply", "$.decisions").isNull()), "invalid").otherwise("ok")
    asked = replies.groupBy(*PAIR).agg(worst.alias("provider_status"))
    n = criteria.groupBy("nct_id").agg(F.count(F.lit(1)).alias("n_criteria"))
    none = F.array().cast(f"array<struct<{_DECISION}>>")
    out = asked.join(n, "nct_id").join(rows, PAIR, "left")
    return out.select(F.col("topic_id").cast("string").alias("topic_id"), F.col("nct_id").cast("string").alias("nct_id"), "n_criteria", "provider_status", F.coalesce(F.transform("_d", lambda x: x["d"]), none).alias("decisions"))


def reason(pairs: DataFrame, criteria: DataFrame, narratives: DataFrame, provider: Provider, cache: str, template: str = "{narrative}", year: int = 0, model: str = "rules", per_call: int = PER_CALL) -> DataFrame:
    """The cached rows of `decide` of all pairs, after asking for those that the cache doesn't have. Failed pairs are in the cache
    with their status and aren't asked again; another template is another cache partition."""
    spark, mode = pairs.sparkSession, "batch" if per_call > 1 else "single"
    key = prompt_key(template, per_call)
    own = lambda: read_cache(spark, cache, PAIR_CACHE, key, model=model, mode=mode, year=year)
    text = pairs.select(*(F.col(c).cast("string").alias(c) for c in PAIR)).distinct()
    rest = todo(text, own().select(*PAIR), PAIR)
    as_text = lambda df, *names: df.select(*(F.col(c).cast("string").alias(c) if c in names else c for c in df.columns))
    append_cache(_partitions(decide(rest, as_text(criteria, "nct_id"), as_text(narratives, "topic_id"), provider, per_call), year, model, mode, key), cache)
    return own().join(text, PAIR, "left_semi")


def prompt_key(template: str, per_call: int) -> str:
    return prompt_hash(template, f"{_DECISION}|{per_call}")


def accepted(cached: DataFrame) -> DataFrame:
    """Decisions that hold, a row each, from rows of `reason`."""
    return cached.select(*PAIR, F.inline("decisions")).where("reject_reason is null").drop("reject_reason")


def replies_of(narratives: DataFrame, provider: Provider, cache: str, template: str, mode: str, year: int = 0, model: str = "rules") -> DataFrame:
    """topic_id, narrative, reply: one call per narrative that the cache doesn't have, a failed one included."""
    spark, key = narratives.sparkSession, prompt_hash(template, mode)
    cached = lambda: read_cache(spark, cache, REPLY_CACHE, key, model=model, mode=mode, year=year).select("topic_id", "reply")
    text = narratives.select(F.col("topic_id").cast("string").alias("topic_id"), "narrative")
    rest = todo(text, cached(), ["topic_id"])
    asked = ask(rest.select("topic_id", F.replace(F.lit(template), F.lit("{narrative}"), F.col("narrative")).alias("prompt")), provider)
    append_cache(_partitions(asked.select("topic_id", "reply"), year, model, mode, key), cache)
    return text.join(cached(), "topic_id", "left")


def extract(narratives: DataFrame, provider: Provider, cache: str, template: str = "{narrative}") -> DataFrame:
    """topic_id, narrative, profile, provider_status: profiles by a model, resumable. An unreadable or missing reply keeps its topic,
    with no profile, so that the narrative itself can be searched with."""
    r = replies_of(narratives, provider, cache, template, "profile")
    parsed = F.when(F.get_json_object("reply", "$").isNotNull(), parse_profile(F.col("reply")))
    status = F.when(F.col("reply").isNull(), "none").when(F.col("profile").isNull(), "invalid").otherwise("ok")
    return r.withColumn("profile", parsed).withColumn("provider_status", status).drop("reply")


def describe(narratives: DataFrame, provider: Provider, cache: str, template: str = "{narrative}") -> DataFrame:
    """topic_id, narrative, description: a written description of what would match each narrative, for queries in the `hyde` mode;
    null where the provider gave none."""
    return replies_of(narratives, provider, cache, template, "hyde").withColumnRenamed("reply", "description")

