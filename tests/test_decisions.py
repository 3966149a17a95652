import pytest
from pyspark.sql import functions as F

from sievemark.operators import decisions as D
from sievemark.operators import providers, report

PAIRS = "topic_id string, nct_id string"
DEC = PAIRS + ", criterion_idx int, section string, label string, criterion_quote string, patient_evidence string"


def frames(spark, cases):
    pairs = spark.createDataFrame([("t", k) for k in cases], PAIRS)
    rows = [("t", k, i, s, lab, q, "e") for k, ds in cases.items() for i, (lab, s, q) in enumerate(ds)]
    return pairs, spark.createDataFrame(rows, DEC)


def scores(spark, cases, **kw):
    return {r.nct_id: r for r in D.trial_scores(*frames(spark, cases), **kw).collect()}


def mix(sat, unv, vio=0):
    return [("satisfied", "inclusion", "q")] * sat + [("unverifiable", "inclusion", "q")] * unv + [("violated", "inclusion", "q")] * vio


def test_rules(spark):
    s = scores(spark, {"a": mix(2, 8), "b": mix(6, 4), "c": mix(1, 9), "d": mix(3, 7), "v": mix(5, 0, 1), "none": [], "unv": mix(0, 20)})
    assert s["a"]["count"] == pytest.approx(0.2, abs=1e-3) and s["b"]["count"] == pytest.approx(0.6, abs=1e-3)
    for rule in ("strict", "lenient"):
        assert 0 < s["c"][rule] < s["d"][rule]
    assert s["v"].strict == 0 and s["v"].lenient > 0
    assert all(s["none"][r] == 0 for r in D.RULES) and all(s["unv"][r] > 0 for r in D.RULES)


def test_sections_inferred_from_negation(spark):
    rows = [("unknown", "No prior chemotherapy", "exclusion"), ("unknown", "Not pregnant or nursing", "exclusion"), ("inclusion", "No prior therapy", "inclusion"), ("unknown", "Histologically confirmed", "unknown")]
    df = spark.createDataFrame(rows, "s string, q string, want string")
    assert all(r.got == r.want for r in df.select("want", D.effective_section(F.col("s"), F.col("q")).alias("got")).collect())
    case = {"x": [("violated", "unknown", "No prior chemotherapy"), *mix(5, 0)]}
    assert scores(spark, case)["x"].lenient == 0 and scores(spark, case, infer_section=False)["x"].lenient > 0


@pytest.mark.parametrize(
    ("label", "quote", "evidence", "want"),
    [
        ("maybe", "age", "x", "label_invalid"), (None, "age", "x", "label_invalid"), ("satisfied", "weight", "man", "criterion_quote_not_in_criterion"), ("satisfied", "AGE  over", "", "patient_evidence_empty"),
        ("satisfied", "", "old man", None), ("satisfied", "age", "old ... man", "patient_evidence_not_in_narrative"), ("unverifiable", "age", "", None), ("unverifiable", "age", None, None), ("unverifiable", "age", "dog", "patient_evidence_not_in_narrative"),
    ],
)
def test_grounding(spark, label, quote, evidence, want):
    row = spark.createDataFrame([(label, quote, "Age over\n 18", evidence, "An OLD\n man")], "l string, q string, c string, e string, n string")
    assert row.select(D.check_reason(F.col("l"), F.col("q"), F.col("c"), F.col("e"), F.col("n"))).first()[0] == want


def test_first_answer_blocks_later_ones(spark):
    answers = spark.createDataFrame([("t", "n", 0, 0), ("t", "n", 0, 1), ("t", "n", 7, 2), ("t", "n", None, 3)], PAIRS + ", criterion_idx int, pos int")
    crit = spark.createDataFrame([("n", 0), ("n", 1)], "nct_id string, idx int")
    assert {r.pos: r.reject_reason for r in D.match_answers(answers, crit).collect()} == {0: None, 1: "index_duplicate", 2: "index_unknown", 3: "index_missing"}


def test_rerank_bands(spark):
    run = spark.createDataFrame([("t", k, s) for k, s in (("a", 4.0), ("b", 3.0), ("c", 2.0), ("d", 1.0))], PAIRS + ", score double")
    sc = spark.createDataFrame([("t", "b", 0.0), ("t", "d", 0.9)], PAIRS + ", strict double")
    order = lambda **kw: [r.nct_id for r in D.rerank_by_eligibility(run, sc, **kw).orderBy(F.desc("score")).collect()]
    assert order() == ["d", "b", "a", "c"] and order(demote=True) == ["d", "a", "c", "b"] and order(keep_unjudged=False) == ["d", "b"]


def test_provider_round_trip_and_resume(spark):
    pairs, _ = frames(spark, {"n": []})
    crit = spark.createDataFrame([("n", k, f"criterion about aspirin {k}" if k else "No aspirin") for k in range(35)], "nct_id string, idx int, text string")
    nar = spark.createDataFrame([("t", "takes aspirin daily")], "topic_id string, narrative string")
    req = providers.prompts(pairs, crit, nar)
    assert req.count() == 2  # at most 30 criteria a call
    a = providers.answers(providers.ask(req, providers.rule_provider()))
    rows = {r.criterion_idx: r for r in a.collect()}
    assert len(rows) == 35 and rows[0].label == "violated" and rows[1].label == "satisfied"
    assert {r.provider_status for r in providers.answers(providers.ask(req, lambda p: "{bad")).collect()} == {"invalid"}
    assert {r.provider_status for r in providers.answers(providers.ask(req, lambda p: None)).collect()} == {"none"}
    assert D.todo(pairs, a, ["topic_id", "nct_id"]).count() == 0


def test_circuit_breaker():
    def down(prompt):
        raise providers.ProviderError

    call = providers.with_retries(down, attempts=2, wait=lambda n: 0, breaker=2)
    assert call("x") is None
    with pytest.raises(RuntimeError):
        call("x")


def test_headline_and_audit(spark):
    r = spark.createDataFrame([(71, 9, 0), (5, 1, 2)], "n long, s long, v long").select(report.headline(F.col("n"), F.col("s"), F.col("v")).alias("h")).collect()
    assert r[0].h.startswith("Potentially eligible — 9 of 71") and r[1].h.startswith("Likely ineligible — 3 of 5")
    s = spark.createDataFrame([("Potentially eligible - needs clinician review", True), ("The patient is eligible.", False), ("You should enrol.", False)], "s string, want boolean")
    assert all(x.got == x.want for x in s.select("want", report.audit_summary(F.col("s")).alias("got")).collect())


def test_accept_extract_and_sections(spark):
    from sievemark.operators import errors, profiles

    d = spark.createDataFrame([(None, "x" * 400), ("label_invalid", "y")], "reject_reason string, reasoning string")
    assert [len(r.reasoning) for r in D.accept(d).collect()] == [300]
    nar = spark.createDataFrame([("a", "aged 5"), ("b", "bad"), ("c", "none")], "topic_id string, narrative string")
    replies = {"aged 5": '{"age":{"value":5,"unit":"years","evidence":"aged 5"}}', "bad": "{bad", "none": None}
    got = {r.topic_id: (r.provider_status, r.profile and r.profile.age.value) for r in profiles.extract_profiles(nar, replies.get).collect()}
    assert got == {"a": ("ok", 5.0), "b": ("invalid", None), "c": ("none", None)}
    crit = spark.createDataFrame([("n", "exclusion"), ("n", "inclusion"), ("n", "inclusion")], "nct_id string, section string")
    recs = spark.createDataFrame([("n", "EXCLUSION: x"), ("m", None)], "nct_id string, criteria_raw string")
    assert {r.nct_id: tuple(r)[1:] for r in errors.visible_sections(crit, recs).collect()} == {"n": (3, 2, 1, 0, True), "m": (0, 0, 0, 0, False)}
