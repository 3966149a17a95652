"""The corpus as tables: retrieval texts, child rows with spans, and data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold


def retrieval_text(title: Column, summary: Column, *lists: Column) -> Column:
    """Title, summary and each list joined by `; `, one per line, blanks left out."""
    blank = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    return F.concat_ws("\n", blank(title), blank(summary), *(blank(F.array_join(x, "; ")) for x in lists))


def contents(title: Column, summary: Column, conditions: Column, others: Column, criteria: Column | None = None, boost: int = 1) -> Column:
    """The indexed text: the retrieval text, criteria after it if wanted, title and conditions repeated in front if boosted."""
    base = retrieval_text(title, summary, conditions, others)
    head = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.array_join(conditions, "; "))
    front = [head] * (boost - 1)
    return F.concat_ws("\n", *front, base, *([] if criteria is None else [F.nullif(criteria, F.lit(""))]))


_LINE = "struct<text:string,span_start:int,span_end:int>"


def line_segments(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, idx, text, span_start, span_end: lines that have any text, trimmed, with half-open code-point spans of the whole line.

    Spans are running sums inside the row's own array, folded in linear time, so nothing is shuffled.
    """
    line = "named_struct('text', trim(x), 'span_start', a.at, 'span_end', a.at + length(x))"
    kept = F.expr(fold(f"split(`{text_col}`, '\\n')", _LINE, "a.at + length(x) + 1", f"CASE WHEN trim(x) <> '' THEN array({line}) ELSE array() END"))
    return docs.select(key, F.posexplode(kept).alias("idx", "_x")).select(key, "idx", "_x.text", "_x.span_start", "_x.span_end")


def span_text(blob: Column, start: Column, end: Column) -> Column:
    return F.substr(blob, start + 1, end - start)


def span_violations(segments: DataFrame, docs: DataFrame, key: str = "doc_id", text_col: str = "text", sample: int | None = None) -> DataFrame:
    """n_checked, n_violations: segments whose span, white space collapsed, isn't their text. A sample of documents is chosen by a
    hash of the key, so it is the same on every run."""
    d = docs.select(key, F.col(text_col).alias("_blob"))
    if sample is not None:
        d = d.orderBy(F.xxhash64(F.col(key), F.lit(7)), key).limit(sample)
    squash = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    j = segments.join(d, key)
    wrong = squash(span_text(F.col("_blob"), F.col("span_start"), F.col("span_end"))) != squash(F.col("text"))
    return j.agg(F.count(F.lit(1)).alias("n_checked"), F.count_if(wrong).alias("n_violations"))


def check_export(bulk: DataFrame, docs: DataFrame, contents: Column, n: int, key: str = "doc_id") -> DataFrame:
    """n_checked, n_wrong: whether texts exported in bulk (id, contents) are those of point lookups, for n documents chosen by a hash
    of the key. A missing text is wrong."""
    some = docs.orderBy(F.xxhash64(F.col(key), F.lit(11)), key).limit(n).select(F.col(key).cast("string").alias("_id"), contents.alias("_own"))
    j = some.join(bulk.select(F.col("id").cast("string").alias("_id"), "contents"), "_id", "left")
    return j.agg(F.count(F.lit(1)).alias("n_checked"), F.count_if(~F.col("contents").eqNullSafe(F.col("_own"))).alias("n_wrong"))


def get_trial(trials: DataFrame, nct_id: str) -> DataFrame:
    """The record with an id, or no row; the filter reaches the scan."""
    return trials.where(F.col("nct_id") == F.lit(nct_id))


def get_criteria(criteria: DataFrame, nct_id: str) -> DataFrame:
    """A record's criteria in their order."""
    return criteria.where(F.col("nct_id") == F.lit(nct_id)).orderBy("idx")


def quantile_by_index(counts: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """Values at floor(n * q) of the sorted column, for each named q: ranks come from a histogram of values, one row per distinct
    value, so nothing large is sorted in one place."""
    h = counts.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("c").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    h = h.select("v", upto.alias("upto"), total.alias("n"))
    return h.agg(*(F.min(F.when(F.col("upto") > F.floor(F.col("n") * F.lit(q)), F.col("v"))).alias(name) for name, q in shares.items()))


def joined_children(children: DataFrame, key: str, value: str, pos: str, sep: str = "; ") -> DataFrame:
    """key and its children's values joined in the order of `pos`."""
    return children.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(pos, value))), lambda x: x[value]), sep).alias("joined"), F.count(F.lit(1)).alias("n"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: str = "7") -> DataFrame:
    """n rows in the order of MD5 of (key, seed): a sample that any engine and any partitioning repeats."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed))), key).limit(n)


def subsample(judged: DataFrame, everything: DataFrame, key: str, distractors: int) -> DataFrame:
    """Judged keys and a seeded sample of the others."""
    rest = everything.select(key).distinct().join(judged.select(key), key, "left_anti")
    return judged.select(key).distinct().unionByName(seeded_sample(rest, key, distractors))
