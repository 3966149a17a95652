"""BM25 on a stored index: postings bucketed by term, in parts of documents; search and parameter grids score a part at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import prepare_query, tokens
from ..sources.store import bounded_batches, new_path

#: A query table of so many rows at most (some 50 bytes each) is sent to the executors at once; a larger one goes in pieces.
QUERY_ROWS = 500_000
#: Documents for which an index gets another bucket, and the fewest and most buckets.
BUCKET_DOCS, LEAST_BUCKETS, MOST_BUCKETS = 20_000, 8, 4096
#: Documents and bytes of text of a part, which one task counts and scores, and the fewest documents for which there is another one.
PART_DOCS, PART_BYTES, LEAST_PART = 1 << 15, 96 << 20, 1 << 13
#: Postings or results of a batch that a task gives.
POSTINGS = 1 << 17
#: Scores are rounded to so many in a unit.
PER_UNIT = 1e6
#: What tables of postings and of terms have: told to readers, as a corpus without documents or words has no file to tell it.
ROWS, TERMS = "part int, term string, at array<int>, tf array<int>, docs array<{}>, df long, cf long", "term string, df long, cf long, bucket int"


@dataclass(frozen=True)
class Index:
    """A stored corpus with its statistics: n documents of mean length avgdl. Empty documents count in n.

    postings has a row per term and part of the corpus: at has the places in the part of the documents with the term, tf how
    often they have it, df how many they are, and cf the sum of tf. A row without a term, in a bucket below 0, is the part's table
    of documents: docs has their ids by place, in order, and tf their lengths. terms has term, df, cf and bucket. Both are
    partitioned by the bucket of the term and sorted by it, so a search reads the buckets and row groups of its terms, and no text.
    """

    postings: DataFrame
    terms: DataFrame
    n: int
    avgdl: float
    buckets: int
    parts: int


def term_frequencies(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """key, term, tf: the bag of words of every text."""
    return docs.select(F.col(key), F.explode(tokens(F.col(text_col))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def _ordered(keys: list[pa.Array], kind: pa.DataType | None = None) -> tuple[pa.Array, np.ndarray]:
    """The distinct keys as Spark orders them, and the place of each key among them."""
    found = pa.concat_arrays(keys or [pa.array([], kind)]).dictionary_encode("encode")
    order = pc.sort_indices(found.dictionary, null_placement="at_start").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return found.dictionary.take(pa.array(order)), place[found.indices.to_numpy()]


def _lists(values: np.ndarray | pa.Array, ends: np.ndarray | list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, pa.int32()))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of an index from the rows (part, document, words) of one part. Words are counted batch by batch; texts of the same
    document and length are one document, others are places of their own."""
    names = ["part", "term", "at", "tf", "docs", "df", "cf"]
    rows, known, keys, lengths, words, term, row, tf = 0, 0, [], [], [], [], [], []
    for b in batches:
        if not b.num_rows:
            continue
        part, size = b.column(0)[0].as_py(), pc.list_value_length(b.column(2)).to_numpy().astype(np.int64)
        found = b.column(2).flatten().dictionary_encode()
        n = max(1, len(found.dictionary))
        pair, times = np.unique(np.repeat(np.arange(len(size)), size) * n + found.indices.to_numpy(), return_counts=True)
        keys.append(b.column(1))
        lengths.append(size)
        words.append(found.dictionary)
        term.append((pair % n + known).astype(np.int32))
        row.append((pair // n + rows).astype(np.int32))
        tf.append(times.astype(np.int32))
        rows, known = rows + len(size), known + len(found.dictionary)
    if not rows:
        return
    docs, key = _ordered(keys)
    length = np.concatenate(lengths)
    most = length.max() + 1
    one, at = np.unique(key * most + length, return_inverse=True)
    none = pa.nulls(1, pa.list_(pa.int32()))
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.nulls(1, pa.string()), none, _lists(one % most, [0, len(one)]), _lists(docs.take(pa.array(one // most)), [0, len(one)]), pa.array([0]), pa.array([0])], names=names)
    vocabulary, code = _ordered(words)
    if not len(vocabulary):
        return
    pair = code[np.concatenate(term)] * len(one) + at[np.concatenate(row)]
    order = np.argsort(pair)
    pair, tf = pair[order], np.concatenate(tf)[order]
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    pair, tf = pair[first], np.add.reduceat(tf, first)
    term, at = pair // len(one), (pair % len(one)).astype(np.int32)
    ends = np.r_[np.flatnonzero(np.r_[True, term[1:] != term[:-1]]), len(term)]
    cf, low = np.add.reduceat(tf, ends[:-1], dtype=np.int64), 0
    while low < len(cf):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + POSTINGS, "right")) - 1)
        own, here = ends[low : high + 1] - ends[low], slice(ends[low], ends[high])
        start = [pa.array(np.full(high - low, part, np.int32)), vocabulary.take(pa.array(term[ends[low:high]])), _lists(at[here], own), _lists(tf[here], own)]
        yield pa.RecordBatch.from_arrays([*start, pa.nulls(high - low, pa.list_(docs.type)), pa.array(np.diff(own)), pa.array(cf[low:high])], names=names)
        low = high


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def store_index(docs: DataFrame, path: str, key: str = "doc_id", text_col: str = "text") -> Index:
    """Writes the index of a corpus and opens it. Texts are dealt by their ids to parts, and a part's words are counted where it
    is; what moves after that is a row per term and part. Everything else comes from the postings."""
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    bounded_batches(spark)
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, n // BUCKET_DOCS))
    parts = max(1, -(-n // PART_DOCS), -(-size // PART_BYTES), min(spark.sparkContext.defaultParallelism, n // LEAST_PART))
    part = F.pmod(F.xxhash64("k"), F.lit(parts)).cast("int")
    dealt = docs.select(F.col(key).alias("k"), F.col(text_col).alias("t")).withColumn("part", part).repartitionById(parts, "part")
    counted = dealt.select("part", "k", tokens(F.col("t")).alias("ws")).mapInArrow(_counted, ROWS.format(kind))
    p = counted.withColumn("bucket", F.when(F.col("term").isNull(), -1 - F.pmod("part", F.lit(buckets))).otherwise(bucket_of(F.col("term"), buckets)))
    p.repartitionById(buckets, F.pmod("bucket", F.lit(buckets))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
    # dealt by bucket, so that the terms are grouped where they are
    terms = spark.read.schema(f"{ROWS.format(kind)}, bucket int").parquet(f"{path}/postings").where("bucket >= 0").select("bucket", "term", "df", "cf").repartition(buckets, "bucket")
    terms.groupBy("bucket", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    words = spark.read.schema(TERMS).parquet(f"{path}/terms").agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("words"))
    words.select(F.lit(n).cast("long").alias("n"), (F.col("words") / F.lit(float(max(n, 1)))).alias("avgdl"), F.lit(buckets).alias("buckets"), F.lit(parts).alias("parts"), F.lit(kind).alias("kind")).write.parquet(f"{path}/corpus")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    """A stored index; only its one row of corpus statistics is read now."""
    c = spark.read.parquet(f"{path}/corpus").first()
    return Index(spark.read.schema(f"{ROWS.format(c.kind)}, bucket int").parquet(f"{path}/postings"), spark.read.schema(TERMS).parquet(f"{path}/terms"), c.n, c.avgdl, c.buckets, c.parts)


def build_index(docs: DataFrame, key: str = "doc_id", text_col: str = "text", path: str | None = None) -> Index:
    """The index of a corpus, stored at a path or else for as long as the driver's process lives."""
    return store_index(docs, path or new_path(docs.sparkSession, "index"), key, text_col)


def query_terms(queries: DataFrame, key: str, text_col: str, mode: str = "raw") -> DataFrame:
    """key, term, qtf of prepared query texts."""
    return term_frequencies(queries.select(F.col(key), prepare_query(F.col(text_col), mode).alias("_q")), key, "_q").withColumnRenamed("tf", "qtf")


def top_k(run: DataFrame, k: int, group: list[str], doc: str = "doc_id", score: str = "score") -> DataFrame:
    """The first k of each group by (score desc, doc asc), with their rank; limited before the shuffle as well."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), doc)
    return run.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best(scores: np.ndarray, depth: int) -> np.ndarray:
    """Places of the depth largest scores, ascending; of equal ones the first."""
    if len(scores) <= depth:
        return np.arange(len(scores))
    kth = np.partition(scores, len(scores) - depth)[len(scores) - depth]
    kept = scores > kth
    kept[np.flatnonzero(scores == kth)[: depth - np.count_nonzero(kept)]] = True
    return np.flatnonzero(kept)


def _scored(sent, grid: list[tuple[float, float]], depth: int, avgdl: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (setting, topic, docs, scores) of one part of an index: its best documents for every query and pair of parameters.

    A matched term adds qtf * idf * tf / (tf + k1 * (1 - b + b * dl / avgdl)), with idf as ln(1 + (N - df + .5) / (df + .5)). A
    query's postings are added up in an array of the part's documents, so that nothing but the best leaves the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        t = pa.Table.from_batches(held) if held else None
        if t is None or t["docs"].null_count == len(t):
            return
        table, rows = t.filter(pc.is_valid(t["docs"])), t.filter(pc.is_null(t["docs"]))
        length = pc.list_flatten(table["tf"]).to_numpy()
        # a document with texts of different lengths has as many places, and one score
        docs, doc = _ordered(pc.list_flatten(table["docs"]).chunks)
        bounds = np.r_[0, np.cumsum(pc.list_value_length(rows["at"]).to_numpy().astype(np.int64))]
        at, tf = pc.list_flatten(rows["at"]).to_numpy(), pc.list_flatten(rows["tf"]).to_numpy()
        where = {k: slice(bounds[i], bounds[i + 1]) for i, k in enumerate(rows["tid"].to_pylist())}
        ends, terms, qtf, idf = sent.value
        found, n = [], 0
        for topic in range(len(ends) - 1):
            own = slice(ends[topic], ends[topic + 1])
            parts = [(where[k], q * idf[k]) for k, q in zip(terms[own].tolist(), qtf[own].tolist(), strict=True) if k in where]
            if not parts:
                continue
            place, times = np.concatenate([at[s] for s, _ in parts]), np.concatenate([tf[s] for s, _ in parts])
            gain = np.repeat([g for _, g in parts], [s.stop - s.start for s, _ in parts]) * times
            dl, place = length[place], doc[place]
            matched = np.flatnonzero(np.bincount(place, minlength=len(docs)))
            for setting, (k1, b) in enumerate(grid):
                sums = np.bincount(place, gain / (times + k1 * (1 - b + b * dl / avgdl)), len(docs))[matched]
                rounded = np.floor(sums * PER_UNIT + 0.5) / PER_UNIT
                best = _best(rounded, depth)
                found.append((setting, topic, matched[best], rounded[best]))
                n += len(best)
            if n >= POSTINGS:
                yield _packed(found, docs)
                found, n = [], 0
        if found:
            yield _packed(found, docs)

    return run


def _packed(found: list[tuple[int, int, np.ndarray, np.ndarray]], docs: pa.Array) -> pa.RecordBatch:
    setting, topic, places, scores = zip(*found, strict=True)
    ends = np.r_[0, np.cumsum([len(x) for x in places])]
    lists = [_lists(docs.take(pa.array(np.concatenate(places))), ends), _lists(pa.array(np.concatenate(scores)), ends)]
    return pa.RecordBatch.from_arrays([pa.array(setting, pa.int32()), pa.array(topic, pa.int32()), *lists], names=["setting", "topic", "docs", "scores"])


def _merged(topics: pa.Array, grid: list[tuple[float, float]], depth: int, names: list[str]) -> Callable[[pa.Table], pa.Table]:
    """The best of one setting and topic, ranked by (score desc, doc asc), from the best of every part."""

    def run(t: pa.Table) -> pa.Table:
        both = pa.table({"d": pc.list_flatten(t["docs"]), "s": pc.list_flatten(t["scores"])})
        if len(both) > depth:
            scores = both["s"].to_numpy()
            # ties at the last place all go on; sorting decides among them
            both = both.filter(pa.array(scores >= np.partition(scores, len(scores) - depth)[len(scores) - depth]))
        both = both.take(pc.sort_indices(both, sort_keys=[("s", "descending"), ("d", "ascending")], null_placement="at_start")[:depth])
        k1, b = (pa.array(np.full(len(both), v)) for v in grid[t["setting"][0].as_py()])
        topic = topics.take(pa.array(np.full(len(both), t["topic"][0].as_py())))
        return pa.table([k1, b, topic, both["d"], both["s"], pa.array(np.arange(1, len(both) + 1), pa.int32())], names=names)

    return run


def search(index: Index, queries: DataFrame, key: str = "item_id", text_col: str = "text", k1: float = 0.9, b: float = 0.4, depth: int = 1000, mode: str = "raw") -> DataFrame:
    """key, doc_id, score, rank of every query, as in `search_grid` with one pair of parameters."""
    return search_grid(index, queries, [(k1, b)], key, text_col, depth, mode).drop("k1", "b")


def search_grid(index: Index, queries: DataFrame, grid: list[tuple[float, float]], key: str = "item_id", text_col: str = "text", depth: int = 1000, mode: str = "raw") -> DataFrame:
    """k1, b, key, doc_id, score, rank for every pair of parameters, from one pass over the postings of the queries' terms.

    Postings go to the task of their part, once for all queries and pairs, and a part gives the best of each query and pair: what
    is shuffled grows with the corpus, not with pairs of queries and documents. Scores are rounded before ranking, so that the
    order of sums can't decide ties. Query terms are collected and sent to each executor, in pieces if they are many.
    """
    bounded_batches(queries.sparkSession)
    q = query_terms(queries, key, text_col, mode)
    pieces = max(1, -(-q.count() // QUERY_ROWS))
    of = [q.where(F.pmod(F.xxhash64(key), F.lit(pieces)) == i) for i in range(pieces)] if pieces > 1 else [q]
    return reduce(DataFrame.unionByName, (_search(index, piece, [(float(k1), float(b)) for k1, b in grid], key, depth) for piece in of))


def _search(index: Index, q: DataFrame, grid: list[tuple[float, float]], key: str, depth: int) -> DataFrame:
    spark, held = q.sparkSession, q.toArrow()
    topics, topic = _ordered(held[key].chunks, held[key].type)
    terms, term = _ordered(held["term"].chunks, held["term"].type)
    order = np.argsort(topic, kind="stable")
    asked = spark.createDataFrame(pa.table({"term": terms, "tid": pa.array(np.arange(len(terms)), pa.int32())}))
    # at most MOST_BUCKETS buckets hold these terms; joined by term alone, so that no plan holds its queries again to prune them
    wanted = sorted(r.bucket for r in asked.select(bucket_of(F.col("term"), index.buckets).alias("bucket")).distinct().collect())
    known = index.terms.where(F.col("bucket").isin(*wanted)).join(F.broadcast(asked), "term").select("tid", "df").toArrow()
    df = np.zeros(len(terms))
    df[known["tid"].to_numpy()] = known["df"].to_numpy()
    idf = np.log(1 + (index.n - df + 0.5) / (df + 0.5))
    sent = spark.sparkContext.broadcast((np.searchsorted(topic[order], np.arange(len(topics) + 1)), term[order], held["qtf"].to_numpy()[order], idf))
    rows = index.postings.where(F.col("bucket").isin(*wanted, *range(-index.buckets, 0))).select("part", "term", "at", "tf", "docs")
    rows = rows.join(F.broadcast(asked), "term", "left").where("tid is not null or docs is not null").select("part", "tid", "at", "tf", "docs")
    doc, kind = (d.simpleString() for d in (index.postings.schema["docs"].dataType.elementType, q.schema[key].dataType))
    best = rows.repartitionById(index.parts, "part").mapInArrow(_scored(sent, grid, depth, index.avgdl or 1.0), f"setting int, topic int, docs array<{doc}>, scores array<double>")
    merged = _merged(topics, grid, depth, ["k1", "b", key, "doc_id", "score", "rank"])
    return best.groupBy("setting", "topic").applyInArrow(merged, f"k1 double, b double, `{key}` {kind}, doc_id {doc}, score double, rank int")


def best_setting(values: DataFrame, settings: list[str], value: str = "mean") -> DataFrame:
    """The row of the setting with the largest value; of equal ones the first in the order of the settings."""
    return values.orderBy(F.desc(value), *settings).limit(1)
