"""A corpus pipeline of the operators in `sievemark.llm`: reject unreadable documents, keep one of each group of near
copies, drop benchmark leaks, mix the sources to target weights, and write token ids.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of `documents`; the
last returns what is read back from its files. In all stages ids may be null or repeat (rows are then told apart by their
text), texts may be null, empty or of any length, further columns of `docs` are dropped, whatever their names, and an empty
table gives an empty table; what is special to a stage stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm import decontaminate, langid, mixing, neardup, tables, tokenids

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose likeliest language is less likely than this is rejected.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is told with some confidence; the network learns from labelled ones.

    Null and empty texts and those without a letter go, and all do if no row has a language. Repeated rows are judged alike.
    With few languages the largest mean probability can't fall under one in their number, so with up to three only
    texts without a letter go; foreign text and junk with letters are rejected as far as windows disagree about them.
    """
    tables.bounded_batches(spark)
    eligible = F.col("doc_id").isNotNull() & ~langid.is_held_out("doc_id", 4, 2)
    return langid.keep_readable(docs.select(*COLUMNS), LEAST_SCORE, eligible=eligible)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles connect: the one with the smallest id, null last.

    Of rows that repeat id and text one stays. Texts without a word, null and empty ones included, are kept as they are.
    """
    return neardup.drop_near_copies(docs.select(*COLUMNS))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, verbatim or with other parameters.

    Null and empty texts hold no item and stay, as everything does if there are no items. Repeated rows go or stay together.
    """
    return decontaminate.drop_leaks(docs.select(*COLUMNS), tables.table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice.

    Null and empty texts have no words, so none of them is taken. Rows that repeat id and text are taken alike: as often as
    the one of them that is taken most. Documents that end at the same time in the queue are taken together or not at all.
    """
    docs, key = docs.select(*COLUMNS), F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("at"))
    taken = mixing.fair_mix(docs.select(key.alias("key"), "text", "source"), id_col="key").where("taken > 0")
    taken = tables.cut(taken.groupBy(F.col("doc_id.id").alias("_id"), F.col("doc_id.at").alias("_at")).agg(F.max(F.col("taken") / F.col("size")).cast("int").alias("_times")))
    # nearly every document is taken, so both sides grow alike: one shuffle of the texts, at every size
    out = docs.join(taken.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_at")))
    return out.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document in the range-coded files, in ascending id order, null first.

    Null and empty texts have the end id alone. Rows of equal id stand by a hash of their text; repeated rows all stand there.
    """
    tables.bounded_batches(spark)
    return tokenids.write_and_read(docs.select(*COLUMNS), tokenids.tokenizer_path())


STAGES = [("language ID", language_id), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", benchmark_leaks), ("mixing sources", source_mix), ("token ids", token_ids)]

#: A trained network and tokenizer are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written as Parquet in the shared folder and read again."""
    scratch, docs = tables.Scratch(spark), tables.documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.written(docs, f"stage-{k}")
            scratch.drop(f"stage-{k - 1}")
    return docs
