"""Searches whose cost grows with the corpus and not with pairs of queries and documents, against sums by hand; and words at odd edges."""

import math
import os
import random
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from sievemark.operators import lexical

D = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(D), reason="no tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def by_hand(docs, queries, k1, b, depth):
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    bags = Counter()
    for key, text in docs:
        for w in words(text):
            bags[key, len(words(text)), w] += 1
    df, mean = Counter(w for _, _, w in bags), sum(len(words(t)) for _, t in docs) / len(docs)
    out = set()
    for topic, text in queries:
        asked, sums = Counter(words(text)), Counter()
        for (key, dl, w), tf in bags.items():
            if w in asked:
                sums[key] += asked[w] * math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf / (tf + k1 * (1 - b + b * dl / mean))
        best = sorted(((round(s, 6), key) for key, s in sums.items()), key=lambda x: (-x[0], x[1]))[:depth]
        out |= {(topic, key, s, rank) for rank, (s, key) in enumerate(best, 1)}
    return out


def test_no_exchange_deals_pairs_of_query_and_document(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "PART_DOCS", 20, raising=False)
    docs = spark.createDataFrame([(k, f"red fox w{k % 7}") for k in range(50)], "doc_id long, text string")
    index = lexical.build_index(docs, path=str(tmp_path / "i"))
    q = spark.createDataFrame([(7, "fox w3 w3"), (8, "w2 red")], "item_id long, text string")
    run = lexical.search_grid(index, q, [(0.9, 0.4), (1.8, 1.0)], depth=3)
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(run))
    assert dealt and not any("doc_id" in x for x in dealt)
    assert run.count() == 12


@pytest.mark.parametrize("kind", ["long", "string"])
def test_scores_of_many_parts_with_ties_repeated_documents_and_empty_texts(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(lexical, "PART_DOCS", 40)
    monkeypatch.setattr(lexical, "POSTINGS", 16)
    monkeypatch.setattr(lexical, "QUERY_ROWS", 5)
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["red", "fox", "dog", "É1", "sea", *map(str, range(9))], k=rng.randint(1, 9))) for _ in range(120)]
    docs = [*enumerate(texts), *((500 + k, "red dog") for k in range(60)), (3, texts[3]), (4, texts[4] + " red"), (900, ""), (901, None), (902, "—")]
    key = str if kind == "string" else int
    docs = [(key(k), t) for k, t in docs]
    queries = [(1, "red dog"), (2, "fox fox 3 sea"), (3, "nowhere"), (4, ""), (5, "e 1 8 red")]
    index = lexical.build_index(spark.createDataFrame(docs, f"doc_id {kind}, text string"), path=str(tmp_path / "i"))
    assert index.parts > 3
    got = lexical.search_grid(index, spark.createDataFrame(queries, "item_id long, text string"), [(0.9, 0.4), (1.8, 1.0)], depth=20).collect()
    for k1, b in ((0.9, 0.4), (1.8, 1.0)):
        assert {(r.item_id, r.doc_id, r.score, r["rank"]) for r in got if r.k1 == k1} == by_hand(docs, queries, k1, b, 20)


def test_no_documents_and_no_queries(spark, tmp_path):
    q = spark.createDataFrame([(1, "red")], "item_id long, text string")
    none = lexical.build_index(spark.createDataFrame([(1, "")], "doc_id long, text string").limit(0), path=str(tmp_path / "none"))
    words = lexical.build_index(spark.createDataFrame([(1, "red fox")], "doc_id long, text string"), path=str(tmp_path / "words"))
    assert lexical.search(none, q).count() == 0
    assert lexical.search(words, q.limit(0)).count() == 0 and lexical.search(words, q).count() == 1


#: How often a query's plan reads postings.
READS = {
    "bm25_grid_selected": 1,
    "bpref": 0,
    "complementarity": 0,
    "judged_at_10": 0,
    "match_full_cards": 0,
    "match_full_events": 0,
    "ndcg_eligible": 0,
    "contamination_at_10": 0,
    "missing_topics": 0,
    "paired_bootstrap_hash": 0,
    "results_upsert": 0,
    "metric_report": 0,
    "paired_bootstrap": 0,
    "wsum_zscore": 0,
    "run_file_lines": 0,
    "ndcg_official": 0,
    "union_recall": 0,
    "recall_micro": 0,
    "rrf_weight_sweep": 0,
    "precision_recall_mrr": 0,
    "label_counts": 0,
    "rrf_fusion": 0,
    "match_batch": 2,
    "ndcg_cond": 0,
    "wsum_minmax": 0,
    "rerank_top100": 0,
    "qrels_lines_parse": 0,
    # end of reads
}
#: Queries whose plans have no exchange by documents, but for the texts' own.
UNPAIRED = (
    "bm25_param_grid",
    "match_batch",
    # end of pairs
)


@needs_data
@pytest.mark.parametrize("name", READS)
def test_plan_reads_no_more_postings_than_it_must(spark, name):
    assert plan(entry.queries()[name](spark, D)).count("/postings") <= READS[name]


@needs_data
@pytest.mark.parametrize("name", UNPAIRED)
def test_plan_deals_no_pairs(spark, name):
    assert not [x for x in re.findall(r"Exchange hashpartitioning\(([^\n]*)", plan(entry.queries()[name](spark, D))) if "doc_id" in x]

def test_sex_by_words_at_odd_edges_equals_sql(spark, tmp_path):
    said = ["öhe was", "Ungaühe him", "x he", "he_ she", "hiſ leg", "ſhe he", "aſhe he", "a 45 M with pain", "30 yo F, a boy", "KHe", "lady2 man", "é-man", "WOMAN man", "", None, "x" * 218 + " he"]
    rows = spark.createDataFrame([(k, 0, "user", t) for k, t in enumerate(said)], "conv_id long, turn long, role string, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    want = duckdb.connect().execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'").execute(entry.oracle_sql()["age_sex_gold"]).fetchall()
    assert sorted(map(tuple, entry.queries()["age_sex_gold"](spark, str(tmp_path)).collect())) == sorted(want)
