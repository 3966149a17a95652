import datetime as dt

import pytest
from pyspark.sql import functions as F

from sievemark.operators import corpus, dense, lexical, profiles
from sievemark.plans import match
from sievemark.sources import readers, sinks
from sievemark.streaming import quota

XML = """<?xml version="1.0"?><clinical_study><id_info><nct_id> {id} </nct_id></id_info><brief_title>T {id}</brief_title>
<brief_summary><textblock>
   Some   summary
</textblock></brief_summary><condition>Asthma</condition><condition>COPD</condition>
<intervention><intervention_type>Drug</intervention_type><intervention_name>X</intervention_name></intervention>
<condition_browse><mesh_term>Lung</mesh_term></condition_browse>
<eligibility><criteria><textblock>
    Inclusion Criteria:

     - Age 18
     - Asthma
</textblock></criteria><gender>All</gender><minimum_age>18 Years</minimum_age><maximum_age>N/A</maximum_age></eligibility></clinical_study>"""


def test_xml_to_corpus(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for k in ("NCT1", "NCT2"):
        (tmp_path / "a" / f"{k}.xml").write_text(XML.format(id=k))
    (tmp_path / "topics.xml").write_text('<topics><topic number="1">  A 60\n year </topic><topic>skipped</topic></topics>')
    (tmp_path / "NCT3.xml").write_text("<clinical_study><brief_title>no id</brief_title></clinical_study>")
    trials, crit = readers.build_corpus(readers.parse_trials(readers.read_trial_xml(spark, str(tmp_path))))
    rows = {r.nct_id: r for r in trials.collect()}
    assert set(rows) == {"NCT1", "NCT2"}
    r = rows["NCT1"]
    assert (r.min_age_years, r.max_age_years, r.max_age_raw, r.summary, r.conditions, r.n_criteria, r.parse_method) == (18.0, None, "N/A", "Some summary", ["Asthma", "COPD"], 2, "bulleted")
    assert r.mesh[0].source == "condition" and r.interventions[0].itype == "Drug"
    j = crit.join(trials, "nct_id").select("text", corpus.span_text(F.col("criteria_raw"), F.col("span_start"), F.col("span_end")).alias("s"))
    assert all(x.text == x.s for x in j.collect())
    sinks.write_corpus(trials, crit, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "conditions")).count() == 4
    t = readers.read_topics(spark, str(tmp_path / "topics.xml"), 2021).collect()
    assert [(x.topic_id, x.narrative) for x in t] == [("2021_1", "A 60 year")]


def test_runs_qrels_jsonl_cache(spark, tmp_path):
    run = spark.createDataFrame([("t", "b", 1.0), ("t", "a", 1.0)], "topic_id string, doc_id string, score double")
    sinks.write_run(run, str(tmp_path / "run"), "x")
    back = readers.read_run(spark, str(tmp_path / "run")).orderBy("stored_rank").collect()
    assert [(r.doc_id, r.score, r.stored_rank) for r in back] == [("a", 1.0, 1), ("b", 1.0, 2)]
    lines = spark.createDataFrame([("1 0 d 2",), ("1 0 d 1",), ("too few",), ("1 0 e x",)], "value string")
    assert {(r.topic_id, r.doc_id, r.rel) for r in readers.parse_qrels(lines, 2021).collect()} == {("2021_1", "d", 2), ("2021_1", "e", None)}
    docs = spark.createDataFrame([("1", "x"), ("2", None)], "id string, contents string")
    sinks.write_jsonl(docs, str(tmp_path / "json"))
    assert readers.read_jsonl(spark, str(tmp_path / "json")).count() == 2
    assert readers.read_jsonl(spark, str(tmp_path / "json"), keep=docs.where("id = '1'")).count() == 1
    rec = spark.createDataFrame([(2021, "m", "b", "h1", "k", "v")], "year int, model string, mode string, prompt_hash string, key string, value string")
    assert readers.read_cache(spark, str(tmp_path / "none"), rec.schema, "h1").count() == 0
    sinks.append_cache(rec, str(tmp_path / "cache"))
    assert readers.read_cache(spark, str(tmp_path / "cache"), rec.schema, "h1", strict=True).count() == 1
    with pytest.raises(readers.StaleCache):
        readers.read_cache(spark, str(tmp_path / "cache"), rec.schema, "other", strict=True)


def test_cache_schemas_may_be_objects_and_have_the_parts(spark, tmp_path):
    rows = spark.createDataFrame([("t", "r", 1, "m", "x", "h")], f"topic_id string, reply string, {readers.CACHE_PARTS}")
    sinks.append_cache(rows, str(tmp_path / "c"))
    for schema in ("topic_id string, reply string", rows.schema, rows.select("topic_id", "reply").schema):
        for path, n in ((tmp_path / "c", 1), (tmp_path / "none", 0)):
            got = readers.read_cache(spark, str(path), schema, "h", year=1)
            assert sorted(got.columns) == sorted(rows.columns) and got.count() == n


def test_dense_search_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(k // 3, [float(x) for x in row]) for k, row in enumerate(v)], "doc_id long, vec array<float>")
    q = spark.createDataFrame([(k, [float(x) for x in v[k]]) for k in (0, 30)], "query_id long, vec array<float>")
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in dense.dense_search(q, df, 5).collect()}
    f = v.astype(np.float32).astype(float)
    f /= np.linalg.norm(f, axis=1, keepdims=True)
    for k in (0, 30):
        best = (f @ f[k]).reshape(20, 3).max(1).round(6)
        order = sorted(range(20), key=lambda j: (-best[j], j))[:5]
        assert [got[k, i + 1][0] for i in range(5)] == order
    e = dense.hashing_encoder()
    a, b, c = e(["severe asthma attack", "asthma attack severe today", "broken leg"])
    assert a @ b > a @ c


def test_profiles(spark):
    raw = '{"age":{"value":61,"unit":"years","evidence":"61 year"},"conditions":[{"name":"Asthma","status":"present","evidence":"asthma"},{"name":"asthma ","status":"present","evidence":"x"},{"name":"HIV","status":"negated","evidence":"no HIV"}]}'
    df = spark.createDataFrame([(raw, "A 61 year old with asthma, no HIV"), ("{bad", "n"), (None, "n")], "r string, n string").withColumn("p", profiles.parse_profile(F.col("r")))
    rows = df.select(profiles.profile_terms(F.col("p")).alias("t"), profiles.schema_ok(F.col("p")).alias("ok"), profiles.build_query(F.col("p"), F.col("n")).alias("q"), profiles.verify_profile(F.col("p"), F.col("n"))[1].alias("lost"), profiles.profile_summary(F.col("p")).alias("s")).collect()
    assert rows[0].t == ["Asthma"] and rows[0].ok and rows[0].q.endswith("\nAsthma") and rows[0].lost == 1 and rows[0].s == "A 61-year-old patient with: Asthma"
    assert rows[2].q == "n" and not rows[2].ok


def test_admission_window():
    times: list[float] = []
    seen = []
    for now in (0, 1, 2, 3, 3600, 3600.5, 3601, 3602.5):
        ok, times = quota.admit(times, now)
        seen.append(ok)
    # exactly 3600 seconds later the first still counts, just after it no longer does
    assert seen == [True, True, True, False, False, True, False, True]
    assert not quota.reserve(145, 6) and quota.reserve(144, 6)


def test_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, f"c{k % 2}", t0 + dt.timedelta(seconds=400 * k)) for k in range(40)]
    df = spark.createDataFrame(rows, "request_id long, client string, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = quota.limit_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.request_id, r.allowed) for r in spark.table("admitted").collect()}
    assert got == {(r.request_id, r.allowed) for r in quota.admitted_batch(df).collect()} and len(got) == 40


def test_match_and_serve(spark, tmp_path):
    docs = spark.createDataFrame([(1, "asthma in adults"), (2, "broken leg"), (3, ""), (4, None)], "doc_id long, text string")
    index = lexical.build_index(docs)
    assert index.n == 4
    req = spark.createDataFrame([("a", "adult asthma"), ("b", ""), ("c", "x" * 5000)], "topic_id string, narrative string")
    got = match.match_batch(req, index).collect()
    assert [(r.topic_id, r.doc_id) for r in got] == [("a", 1)]
    req.coalesce(1).write.parquet(str(tmp_path / "req"))
    seen = []
    match.serve(spark.readStream.schema(req.schema).parquet(str(tmp_path / "req")), index, lambda df, k: seen.extend(df.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert {(r.topic_id, r.refused) for r in seen} == {("a", None), ("b", "empty"), ("c", "too_long")}


def test_quantile_by_index(spark):
    df = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "v long")
    assert corpus.quantile_by_index(df, "v", {"p50": 0.5, "p95": 0.95}).first().asDict() == {"p50": 3, "p95": 4}


def test_slots_templates_and_vectors(spark, tmp_path):
    s = quota.Slots(1)
    with s.take() as a, s.take() as b:
        assert a and not b
    with s.take() as a:
        assert a
    assert "{narrative}" in readers.load_template("decide")
    v = spark.createDataFrame([("d", 0, [1.0])], "doc_id string, chunk_idx int, vec array<float>")
    sinks.write_vectors(v, str(tmp_path / "v"), "m", 320, 40)
    assert readers.read_vectors(spark, str(tmp_path / "v")).collect() == v.collect()
