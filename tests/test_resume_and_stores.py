"""Caches, resumed model steps, the stored index, quotas with reservations, and the linear folds."""

import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sievemark.functions.segment import segment
from sievemark.operators import corpus, dense, evaluation, lexical, providers, reasoning, significance
from sievemark.sources import readers, sinks, store
from sievemark.streaming import quota


def test_index_is_stored_and_reads_no_text(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, ""), (4, None)], "doc_id long, text string")
    lexical.store_index(docs, str(tmp_path / "i"))
    index = lexical.open_index(spark, str(tmp_path / "i"))
    assert (index.n, index.avgdl) == (4, 1.25)
    q = spark.createDataFrame([(7, "red dog"), (8, "nothing here")], "item_id long, text string")
    run = lexical.search(index, q, depth=5)
    assert [(r.item_id, r.doc_id, r["rank"]) for r in run.orderBy("rank").collect()] == [(7, 2, 1), (7, 1, 2)]
    # the scans prune buckets, and no file of texts is among them
    plan = run._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "text" not in plan.split("Scan parquet")[-1]


def test_search_prunes_buckets_without_planning_its_queries_again(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"red fox w{k}") for k in range(40)], "doc_id long, text string")
    lexical.store_index(docs, str(tmp_path / "i"))
    index = lexical.open_index(spark, str(tmp_path / "i"))
    q = spark.createDataFrame([(7, "fox w3 w3"), (8, "w9 red")], "item_id long, text string")
    run = lexical.search(index, q, depth=50)
    assert "dynamicpruning" not in run._jdf.queryExecution().executedPlan().toString()
    assert run.count() == 80 and [(r.item_id, r.doc_id) for r in run.where("rank = 1").orderBy("item_id").collect()] == [(7, 3), (8, 9)]


def test_best_setting_is_the_first_of_equals(spark):
    v = spark.createDataFrame([(0.9, 0.4, 0.5), (1.2, 0.4, 0.7), (1.5, 0.4, 0.7)], "k1 double, b double, mean double")
    assert lexical.best_setting(v, ["k1", "b"]).first().k1 == 1.2


def test_cache_is_replaced_whole_and_told_from_a_wrong_path(spark, tmp_path):
    path, schema = str(tmp_path / "c"), "topic_id string, reply string"
    rows = lambda *xs: spark.createDataFrame([(x, "r", 1, "m", "x", "h") for x in xs], f"{schema}, {readers.CACHE_PARTS}")
    assert readers.read_cache(spark, path, schema, "h").count() == 0
    sinks.append_cache(rows("a"), path)
    sinks.append_cache(rows("b"), path)
    assert {r.topic_id for r in readers.read_cache(spark, path, schema, "h", model="m").collect()} == {"a", "b"}
    sinks.save_cache(rows("c"), path)
    assert {r.topic_id for r in readers.read_cache(spark, path, schema, "h").collect()} == {"c"} and store.exists(spark, path + ".bak")
    with pytest.raises(readers.StaleCache):
        readers.read_cache(spark, path, schema, "other", strict=True)
    with pytest.raises(FileNotFoundError):
        readers.read_cache(spark, path + "x", schema, "h", strict=True)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "part-0.parquet").write_text("not parquet")
    with pytest.raises((AnalysisException, Exception)):
        readers.read_cache(spark, str(tmp_path / "d"), schema, "h").collect()


def test_only_what_is_missing_is_asked(spark, tmp_path):
    asked = tmp_path / "asked"

    def provider(prompt):
        with asked.open("a") as f:
            f.write(prompt.split()[0] + "\n")
        return None if prompt.startswith("fails") else '{"sex": {"value": "male", "evidence": "x"}}' if prompt.startswith("good") else "no json"

    said = spark.createDataFrame([("1", "good x"), ("2", "fails x"), ("3", "bad x")], "topic_id string, narrative string")
    first = reasoning.extract(said.where("topic_id < '3'"), provider, str(tmp_path / "c")).collect()
    assert {r.topic_id: r.provider_status for r in first} == {"1": "ok", "2": "none"}
    got = reasoning.extract(said, provider, str(tmp_path / "c")).collect()
    assert {r.topic_id: r.provider_status for r in got} == {"1": "ok", "2": "none", "3": "invalid"}
    assert sorted(asked.read_text().split()) == ["bad", "fails", "good"]
    d = reasoning.describe(said.where("topic_id = '1'"), lambda p: "what matches", str(tmp_path / "c")).first()
    assert d.description == "what matches"


def test_one_bad_reply_keeps_the_other_pairs(spark, tmp_path):
    rule = providers.rule_provider()
    pairs = spark.createDataFrame([("t", "good"), ("t", "bad"), ("t", "none")], "topic_id string, nct_id string")
    crit = spark.createDataFrame([(n, k, "inclusion", f"{n} walking number {k}") for n in ("good", "bad", "none") for k in range(3)], "nct_id string, idx int, section string, text string")
    said = spark.createDataFrame([("t", "patient is walking")], "topic_id string, narrative string")
    provider = lambda p: "{" if "bad walking" in p else None if "none walking" in p else rule(p)
    for per_call in (2, 1):
        out = {r.nct_id: r for r in reasoning.reason(pairs, crit, said, provider, str(tmp_path / "c"), per_call=per_call).collect()}
        assert {k: r.provider_status for k, r in out.items()} == {"good": "ok", "bad": "invalid", "none": "none"}
        assert [d.label for d in out["good"].decisions] == ["satisfied"] * 3 and not out["bad"].decisions and out["bad"].n_criteria == 3
    assert reasoning.accepted(reasoning.reason(pairs, crit, said, provider, str(tmp_path / "c"))).count() == 3


def test_keys_rotate_and_servers_set_the_delay():
    calls, slept = [], []

    def key(name, fails):
        def call(prompt):
            calls.append(name)
            if fails:
                raise providers.ProviderError("limit", delay=0.01)
            return name

        return call

    r = providers.rotating([key("a", True), key("b", False)])
    assert r("p") == "b" and r("p") == "b" and calls == ["a", "b", "b"]
    began = time.time()
    assert providers.with_retries(key("c", True), attempts=2, wait=lambda n: slept.append(n) or 9.0)("p") is None
    assert time.time() - began < 5 and not [s for s in slept if s > 1]


def test_reservations(spark):
    state = (0, {})
    steps = [("reserve", "a", 100, True), ("reserve", "b", 60, False), ("reserve", "b", 50, True), ("commit", "a", 90, None), ("reserve", "c", 11, False), ("release", "b", 0, None), ("reserve", "c", 60, True), ("commit", "zz", 5, None)]
    for kind, key, calls, want in steps:
        *state, granted = quota.settle(*state, kind, key, calls)
        assert granted is want, (kind, key)
    assert state == [90, {"c": 60}]


def test_reservations_on_a_stream(spark, tmp_path):
    rows = [("2024-01-01 10:00:00", "reserve", "a", 100), ("2024-01-01 10:01:00", "reserve", "b", 60), ("2024-01-01 10:02:00", "commit", "a", 90), ("2024-01-02 10:00:00", "reserve", "b", 150)]
    spark.createDataFrame(rows, "ts string, kind string, request_id string, calls int").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("ts timestamp, kind string, request_id string, calls int").parquet(str(tmp_path / "in"))
    q = quota.reserve_stream(events).writeStream.format("memory").queryName("reserved").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.day, r.request_id, r.kind): (r.granted, r.used) for r in spark.table("reserved").collect()}
    assert got == {("2024-01-01", "a", "reserve"): (True, 0), ("2024-01-01", "b", "reserve"): (False, 0), ("2024-01-01", "a", "commit"): (None, 90), ("2024-01-02", "b", "reserve"): (True, 0)}


def test_admission_is_a_stream_of_rows(spark):
    rows = [("c", float(t), t) for t in (0, 1, 2, 3, 3600, 3601, 3602, 9000)] + [("d", 5.0, 100), (None, 1.0, 101)]
    df = spark.createDataFrame(rows, "client string, t double, request_id long").withColumn("ts", F.col("t").cast("timestamp"))
    got = {r.request_id: r.allowed for r in quota.admitted_batch(df).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 3600: False, 3601: True, 3602: True, 9000: True, 100: True, 101: True}


def test_long_texts_fold_in_linear_time(spark):
    took = []
    for n in (10_000, 40_000):
        df = spark.createDataFrame([(1, "\n".join(f" line {k}" if k % 3 else "  " for k in range(n)))], "doc_id long, text string")
        began = time.time()
        r = corpus.line_segments(df).agg(F.count("idx").alias("n"), F.max("span_end").alias("end")).first()
        took.append(time.time() - began)
        assert r.n == n - (n + 2) // 3
    assert took[1] < 8 * took[0] + 5
    blob = " ".join(f"Sentence number {k} stands here." for k in range(20_000))
    began = time.time()
    rows, method = segment(blob)
    assert method == "sentence_split" and len(rows) == 20_000 and time.time() - began < 60
    assert all(blob[r["span_start"] : r["span_end"]] == r["text"] for r in rows[::500])


def test_shards_and_point_lookups(spark):
    a = spark.createDataFrame([("x", 0, [1.0]), ("y", 0, [2.0])], "doc_id string, chunk_idx int, vec array<float>")
    b = spark.createDataFrame([("y", 0, [9.0]), ("z", 0, [3.0])], "doc_id string, chunk_idx int, vec array<float>")
    assert {(r.doc_id, r.vec[0]) for r in dense.merge_shards([a, b]).collect()} == {("x", 1.0), ("y", 2.0), ("z", 3.0)}
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(20)], "doc_id long, text string")
    bulk = docs.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") != 4, F.col("text")).alias("contents")).where("id != '7'")
    assert tuple(corpus.check_export(bulk, docs, F.col("text"), 20).first()) == (20, 2)


def test_bootstrap_in_parts_is_the_bootstrap(monkeypatch):
    import numpy as np

    d = np.random.default_rng(3).normal(0.1, 1, 50)
    whole = significance.bootstrap(d, 500, 1)
    monkeypatch.setattr(significance, "DRAWN", 5_000)
    assert significance.bootstrap(d, 500, 1) == whole


def test_results_are_read_back(spark, tmp_path):
    m = spark.createDataFrame([("1", "official/p_10", 0.5), ("2", "official/p_10", 0.7)], "topic_id string, metric string, value double")
    sinks.log_result(str(tmp_path / "r.json"), "tag", {"k": 1}, evaluation.averages(m), m)
    assert readers.load_result(str(tmp_path / "r.json"))["aggregate"] == {"official/p_10": 0.6}
    assert {(r.topic_id, r.value) for r in readers.load_rows(spark, str(tmp_path / "r.json")).collect()} == {("1", 0.5), ("2", 0.7)}
    compared = spark.createDataFrame([("b", "a", "official/p_10", 9, 0.1, 0.01, 0.02, 0.2)], "system_a string, system_b string, metric string, n long, diff double, p double, ci_lo double, ci_hi double")
    assert sinks.comparison_report(compared).first().line == "b - a  official/p_10  n=9  +0.1000  [+0.0200, +0.2000]  p=0.0100 *"


def test_self_test_of_the_measures(spark):
    assert all(r.ok for r in evaluation.self_test(spark).collect())
