"""Readers with explicit schemas: record XML, topics, judgments, runs, JSON lines, vectors, caches."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.segment import criteria_rows, segment_column
from ..functions.text import age_raw, age_years, flat, normalize_block
from .store import exists

_TEXTBLOCK = "struct<textblock:string>"
TRIAL_XML = (
    f"id_info struct<nct_id:string>, brief_title string, brief_summary {_TEXTBLOCK}, detailed_description {_TEXTBLOCK}, condition array<string>, keyword array<string>, "
    "intervention array<struct<intervention_name:string,intervention_type:string>>, condition_browse struct<mesh_term:array<string>>, intervention_browse struct<mesh_term:array<string>>, "
    f"eligibility struct<gender:string,minimum_age:string,maximum_age:string,healthy_volunteers:string,criteria:{_TEXTBLOCK}>, phase string, overall_status string, study_type string, _corrupt_record string"
)


def read_trial_xml(spark: SparkSession, path: str) -> DataFrame:
    """Raw records of all `NCT*.xml` files below a path; a malformed one has its text in `_corrupt_record`. White space is kept,
    as line structure and indentation carry meaning."""
    reader = spark.read.format("xml").schema(TRIAL_XML).options(rowTag="clinical_study", ignoreSurroundingSpaces="false", mode="PERMISSIVE", recursiveFileLookup="true", pathGlobFilter="NCT*.xml")
    return reader.load(path)


def trials_of_strings(df: DataFrame, xml_col: str) -> DataFrame:
    """The same records from XML strings, one record each."""
    return df.select(F.from_xml(F.col(xml_col), TRIAL_XML, {"ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"}).alias("r")).select("r.*")


def _list(c: Column) -> Column:
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), flat), lambda x: x.isNotNull())


def parse_trials(raw: DataFrame) -> DataFrame:
    """One row per record that has an id, with nested lists; of records with the same id one is kept. Ages keep the raw text beside
    the years; both are null only if nothing was stated."""
    e = F.col("eligibility")
    terms = F.transform(F.coalesce("intervention", F.array().cast("array<struct<intervention_name:string,intervention_type:string>>")), lambda x: F.struct(flat(x["intervention_name"]).alias("term"), flat(x["intervention_type"]).alias("itype")))
    mesh = F.concat(_mesh("condition"), _mesh("intervention"))
    t = raw.select(
        flat(F.col("id_info.nct_id")).alias("nct_id"), flat(F.col("brief_title")).alias("title"), flat(F.col("brief_summary.textblock")).alias("summary"), flat(F.col("detailed_description.textblock")).alias("detail"), flat(e["gender"]).alias("gender"),
        age_years(e["minimum_age"]).alias("min_age_years"), age_years(e["maximum_age"]).alias("max_age_years"), age_raw(e["minimum_age"]).alias("min_age_raw"), age_raw(e["maximum_age"]).alias("max_age_raw"), flat(e["healthy_volunteers"]).alias("healthy_volunteers"),
        flat(F.col("phase")).alias("phase"), flat(F.col("overall_status")).alias("status"), flat(F.col("study_type")).alias("study_type"), normalize_block(e["criteria"]["textblock"]).alias("criteria_raw"),
        _list(F.col("condition")).alias("conditions"), _list(F.col("keyword")).alias("keywords"), F.filter(terms, lambda x: x["term"].isNotNull()).alias("interventions"), mesh.alias("mesh"),
    )
    return t.where("nct_id is not null").dropDuplicates(["nct_id"])


def _mesh(source: str) -> Column:
    return F.transform(_list(F.col(f"{source}_browse.mesh_term")), lambda x: F.struct(x.alias("term"), F.lit(source).alias("source")))


def build_corpus(trials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trials with parse_method and n_criteria, criteria rows)."""
    segmented = segment_column(trials, "nct_id", "criteria_raw")
    full = trials.join(segmented.select("nct_id", "parse_method", F.size("criteria").alias("n_criteria")), "nct_id")
    return full, criteria_rows(segmented, "nct_id")


def read_topics(spark: SparkSession, path: str, year: int) -> DataFrame:
    """topic_id (`year_number`) and narrative; topics without a number are skipped."""
    raw = spark.read.format("xml").schema("_number string, _VALUE string").options(rowTag="topic").load(path)
    t = raw.select(F.trim("_number").alias("n"), flat(F.col("_VALUE")).alias("narrative")).where("n is not null and n != ''")
    t = t.select(F.concat_ws("_", F.lit(str(year)), "n").alias("topic_id"), F.coalesce("narrative", F.lit("")).alias("narrative"))
    # of two topics with one number the first by its text stays, whatever the partitions
    return t.groupBy("topic_id").agg(F.min("narrative").alias("narrative"))


def parse_qrels(lines: DataFrame, year: int | None = None) -> DataFrame:
    """topic_id, doc_id, rel from lines `topic 0 doc rel`; lines with another number of fields are skipped. A pair that is judged
    twice keeps its highest label, as tables have no line order."""
    parts = F.split(F.trim("value"), r"\s+")
    topic = parts[0] if year is None else F.concat_ws("_", F.lit(str(year)), parts[0])
    q = lines.where(F.size(parts) == 4).select(topic.alias("topic_id"), parts[2].alias("doc_id"), parts[3].try_cast("int").alias("rel"))
    return q.groupBy("topic_id", "doc_id").agg(F.max("rel").alias("rel"))


def parse_run(lines: DataFrame) -> DataFrame:
    """topic_id, doc_id, score, stored_rank from lines of at least five fields; the rank is informative only."""
    parts = F.split(F.trim("value"), r"\s+")
    return lines.where(F.size(parts) >= 5).select(parts[0].alias("topic_id"), parts[2].alias("doc_id"), parts[4].try_cast("double").alias("score"), parts[3].try_cast("int").alias("stored_rank"))


def read_qrels(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    return parse_qrels(spark.read.text(path), year)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    return parse_run(spark.read.text(path))


def read_jsonl(spark: SparkSession, path: str, keep: DataFrame | None = None, shard: int | None = None) -> DataFrame:
    """id, contents; of one shard (`docsNN.json*`) if given, and only of ids in `keep`."""
    df = spark.read.schema("id string, contents string")
    df = df.option("pathGlobFilter", f"docs{shard:02d}*").json(path) if shard is not None else df.json(path)
    return df if keep is None else df.join(keep.select("id"), "id", "left_semi")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id string, chunk_idx int, vec array<float>").parquet(path)


class StaleCache(Exception):
    """A cache was made with another prompt or model."""


CACHE_PARTS = "year int, model string, mode string, prompt_hash string"


def read_cache(spark: SparkSession, path: str, schema: str | StructType, prompt_hash: str, strict: bool = False, **parts) -> DataFrame:
    """Cached records of a prompt hash (and of a year, model and mode if given), by a schema with or without `CACHE_PARTS`. A path that
    doesn't exist is an empty cache, any other trouble with it an error; with `strict` a cache that has only other hashes is one,
    too, and so is no cache."""
    given = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = StructType(given.fields + [f for f in StructType.fromDDL(CACHE_PARTS) if f.name not in given.names])
    if not exists(spark, path):
        if strict:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], whole)
    df = spark.read.schema(whole).parquet(path)
    own = df.where(F.col("prompt_hash") == prompt_hash)
    if strict and own.isEmpty() and not df.isEmpty():
        raise StaleCache(f"{path} has no records of prompt {prompt_hash}")
    for name, value in parts.items():
        own = own.where(F.col(name) == F.lit(value))
    return own


def load_result(path: str) -> dict:
    """An experiment log."""
    return json.loads(Path(path).read_text(encoding="utf-8"))


def load_rows(spark: SparkSession, path: str) -> DataFrame:
    """topic_id, metric, value of an experiment log."""
    rows = [(str(r["topic_id"]), r["metric"], r["value"]) for r in load_result(path)["per_topic"]]
    return spark.createDataFrame(rows, "topic_id string, metric string, value double")


def load_template(name: str) -> str:
    """A packaged prompt template."""
    from importlib.resources import files

    return (files(__package__) / "templates" / f"{name}.txt").read_text(encoding="utf-8")


def check_count(df: DataFrame, expected: int) -> None:
    """A data-quality gate: the number of records must be the expected one."""
    n = df.count()
    if n != expected:
        raise ValueError(f"{n} records instead of {expected}")


def last_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the largest `order`."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
