"""Writers: tables with children, JSON lines, run files, caches, experiment logs."""

from __future__ import annotations

import json
import subprocess
import time
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dense import normalised
from ..operators.lexical import top_k
from .store import delete, exists, rename

SHARD_ROWS = 100_000


def write_corpus(trials: DataFrame, criteria: DataFrame, path: str) -> None:
    """trials, criteria and one child table per list, each with its position in the list."""
    trials.write.mode("overwrite").parquet(f"{path}/trials")
    criteria.write.mode("overwrite").parquet(f"{path}/criteria")
    for name in ("conditions", "keywords", "interventions", "mesh"):
        child = trials.select("nct_id", F.posexplode(name).alias("pos", "x"))
        child = child.select("nct_id", "pos", "x.*") if name in ("interventions", "mesh") else child.withColumnRenamed("x", "term")
        child.write.mode("overwrite").parquet(f"{path}/{name}")


def write_jsonl(df: DataFrame, path: str, shard_rows: int = SHARD_ROWS) -> None:
    """{"id", "contents"} per line; empty documents are written too, so that their number stays right."""
    df.select("id", F.coalesce("contents", F.lit("")).alias("contents")).write.mode("overwrite").option("maxRecordsPerFile", shard_rows).json(path)


def run_lines(run: DataFrame, tag: str, depth: int = 1000, topic: str = "topic_id") -> DataFrame:
    """`topic Q0 doc rank score tag` for the first `depth` of each topic, score with six decimals."""
    r = top_k(run.select(topic, "doc_id", "score"), depth, [topic])
    return r.select(F.format_string("%s Q0 %s %d %.6f %s", F.col(topic).cast("string"), F.col("doc_id").cast("string"), "rank", "score", F.lit(tag)).alias("value"))


def write_run(run: DataFrame, path: str, tag: str, depth: int = 1000, topic: str = "topic_id") -> None:
    run_lines(run, tag, depth, topic).write.mode("overwrite").text(path)


def append_cache(records: DataFrame, path: str) -> None:
    """Adds records to a cache that is partitioned by year, model, mode and prompt hash; the committer makes it atomic."""
    records.write.mode("append").partitionBy("year", "model", "mode", "prompt_hash").parquet(path)


def save_cache(records: DataFrame, path: str) -> None:
    """Puts a whole cache in the place of the one at a path: it is written aside first, and the old one is kept as `.bak` until
    the new one stands, so a reader never finds half of it."""
    spark = records.sparkSession
    aside, backup = f"{path}.new", f"{path}.bak"
    for old in (aside, backup):
        delete(spark, old)
    records.write.partitionBy("year", "model", "mode", "prompt_hash").parquet(aside)
    if exists(spark, path):
        rename(spark, path, backup)
    rename(spark, aside, path)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with rows of the same keys replaced."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def git_commit() -> str:
    out = subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, check=False)
    return out.stdout.strip() or "unknown"


def log_result(path: str, tag: str, config: dict, aggregate: DataFrame, per_topic: DataFrame) -> None:
    """An experiment log on the driver; both tables have a row per metric, or per metric and topic of the evaluation."""
    log = {"tag": tag, "timestamp": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "git_commit": git_commit(), "config": config, "aggregate": {r["metric"]: r["mean"] for r in aggregate.collect()}, "per_topic": [r.asDict() for r in per_topic.collect()]}
    Path(path).write_text(json.dumps(log, indent=2, ensure_ascii=False, default=str), encoding="utf-8")


def write_vectors(vectors: DataFrame, path: str, model: str, chunk_words: int, overlap: int) -> None:
    """doc_id, chunk_idx, vec of length 1, with the model and chunk sizes beside every row (they compress to nothing)."""
    vectors = normalised(vectors)
    meta = {"model": model, "chunk_words": chunk_words, "chunk_overlap": overlap}
    vectors.select("doc_id", "chunk_idx", "vec", *(F.lit(v).alias(k) for k, v in meta.items())).write.mode("overwrite").parquet(path)


REPORT_ORDER = ("official/ndcg_10", "official/p_10", "official/recip_rank", "eligible/ndcg_10", "cond/ndcg_10", "elig/contamination_10", "elig/judged_10", "elig/eligible_recall_1000")


def report_order(averages: DataFrame) -> DataFrame:
    """Averages with `ord`: the fixed order of a report, metrics it doesn't name after the others."""
    place = F.array_position(F.array(*map(F.lit, REPORT_ORDER)), F.col("metric"))
    return averages.withColumn("ord", F.when(place > 0, place).otherwise(len(REPORT_ORDER) + 1).cast("int"))


def comparison_report(compared: DataFrame) -> DataFrame:
    """Lines of a significance report, in its order: `b - a  metric  n  diff  [low, high]  p` and a star below 0.05."""
    star = F.when(F.col("p") < 0.05, " *").otherwise("")
    line = F.concat(F.format_string("%s - %s  %s  n=%d  %+.4f  [%+.4f, %+.4f]  p=%.4f", "system_a", "system_b", "metric", "n", "diff", "ci_lo", "ci_hi", "p"), star)
    return report_order(compared).select("system_a", "system_b", "metric", "ord", line.alias("line")).orderBy("system_a", "system_b", "ord", "metric")
