import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.operators import evaluation as E
from sievemark.operators import fusion, significance

LABELS = [2, 1, 0, 2, 1, 0, 0, 2, 0, 1, 2]


@pytest.fixture(scope="module")
def golden(spark):
    qrels = spark.createDataFrame([("t", f"d{k:02d}", r) for k, r in enumerate(LABELS)], "topic_id string, doc_id string, rel int")
    run = spark.createDataFrame([("t", f"d{k:02d}", float(99 - k)) for k in range(len(LABELS))], "topic_id string, doc_id string, score double")
    return run, qrels


def ndcg(labels, k=10):
    gain = lambda xs: sum(x / math.log2(i + 2) for i, x in enumerate(xs[:k]))
    return gain(labels) / gain(sorted(labels, reverse=True))


def values(df):
    return {r["metric"]: r["value"] for r in df.collect()}


def test_golden_list(golden):
    got = values(E.evaluate(*golden))
    assert got["official/ndcg_10"] == pytest.approx(ndcg(LABELS), abs=1e-6)
    assert got["eligible/ndcg_10"] == pytest.approx(ndcg([int(x == 2) for x in LABELS]), abs=1e-6)
    assert got["elig/contamination_10"] == 0.3 and got["elig/judged_10"] == 1.0
    assert got["official/recip_rank"] == 1.0 and got["official/p_10"] == 0.6 and got["official/recall_1000"] == 1.0


def test_bpref_by_hand(golden):
    rel = [r > 0 for r in LABELS]
    big_r, big_n = sum(rel), len(rel) - sum(rel)
    want = sum(1 - min(sum(not x for x in rel[:k]), big_r) / min(big_r, big_n) for k, r in enumerate(rel) if r) / big_r
    assert values(E.trec_measures(*golden))["bpref"] == pytest.approx(want, abs=1e-6)


def test_adversarial_run_looks_better_officially(golden):
    run, qrels = golden
    got = values(E.evaluate(E.adversarial_run(qrels), qrels))
    assert got["eligible/ndcg_10"] < got["official/ndcg_10"]


def test_missing_topics_and_empty_runs(spark, golden):
    run, qrels = golden
    more = qrels.unionByName(spark.createDataFrame([("u", "x", 1)], qrels.schema))
    assert [r.topic_id for r in E.missing_topics(run, more).collect()] == ["u"]
    assert {r.topic_id: r.value for r in E.contamination_at(run, more).collect()} == {"t": 0.3, "u": 0.0}
    assert E.trec_measures(run.limit(0), qrels).count() == 0


def test_ties_go_by_document(spark):
    run = spark.createDataFrame([("t", "b", 1.0), ("t", "a", 1.0), ("t", "c", 2.0)], "topic_id string, doc_id string, score double")
    assert [r.doc_id for r in fusion.ranked(run).orderBy("rank").collect()] == ["c", "a", "b"]


def test_fusion_by_hand(spark):
    a = spark.createDataFrame([("t", "x", 3.0), ("t", "y", 1.0)], "topic_id string, doc_id string, score double")
    b = spark.createDataFrame([("t", "y", 9.0)], a.schema)
    assert {r.doc_id: r.score for r in fusion.rrf([a, b]).collect()} == {"x": pytest.approx(1 / 61, abs=1e-9), "y": pytest.approx(1 / 62 + 1 / 61, abs=1e-9)}
    # one document has no spread; it gets 0, as does an absent one
    assert {r.doc_id: r.score for r in fusion.wsum([a, b], [0.5, 0.5]).collect()} == {"x": 0.5, "y": 0.0}
    z = {r.doc_id: r.score for r in fusion.wsum([a, b], [1.0, 1.0], "zscore").collect()}
    assert z == {"x": 1.0, "y": -1.0}
    sweep = fusion.rrf_sweep(a, b, [0.0, 0.5, 1.0]).where("weight = 0.5")
    assert {r.doc_id: r.score for r in sweep.collect()} == {r.doc_id: r.score for r in fusion.rrf([a, b], [0.5, 0.5]).collect()}


def test_bootstrap_edges_and_parity(spark):
    assert significance.paired_bootstrap({"a": 1.0}, {"b": 1.0}) == {"n": 0, "diff": 0.0, "p": 1.0, "ci_lo": 0.0, "ci_hi": 0.0}
    same = significance.paired_bootstrap({"a": 1.0, "b": 2.0}, {"a": 1.0, "b": 2.0})
    assert same["diff"] == 0 and same["p"] == 1.0
    x, y = {f"t{k}": math.sin(k) for k in range(30)}, {f"t{k}": math.cos(k) for k in range(30)}
    rows = [(s, "m", k, v) for s, vs in (("x", x), ("y", y)) for k, v in vs.items()]
    m = spark.createDataFrame(rows, "system string, metric string, topic_id string, value double")
    got = significance.compare(m, [("x", "y")]).collect()[0]
    want = significance.paired_bootstrap(x, y)
    d = np.array([x[t] - y[t] for t in sorted(x)])
    draws = d[np.random.default_rng(0).integers(0, 30, size=(10000, 30))].mean(axis=1)
    assert want["p"] == (np.abs(draws - d.mean()) >= abs(d.mean())).mean()
    assert {k: got[k] for k in want} == pytest.approx(want)


def test_micro_and_macro_recall_differ(spark):
    q = spark.createDataFrame([("a", "1", 2), ("b", "1", 2), ("b", "2", 2), ("b", "3", 2)], "topic_id string, doc_id string, rel int")
    r = spark.createDataFrame([("a", "1", 1.0)], "topic_id string, doc_id string, score double")
    assert {x.topic_id: x.value for x in E.eligible_recall(r, q).collect()} == {"a": 1.0, "b": 0.0}
    assert E.micro_recall(r, q.where(F.col("rel") == 2), 10).first().recall == 0.25
