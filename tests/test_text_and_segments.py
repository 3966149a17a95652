import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievemark.functions import text as X
from sievemark.functions.segment import criteria_rows, register_udtf, segment, segment_column

BLOB = """Inclusion Criteria:

  -  Age 18
     or more
  -  Acute onset
-  Exclusion Criteria:
  1. Pregnant
  2. No consent"""


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


def test_sections_and_hidden_headers():
    found, method = segment(BLOB)
    assert [(c["section"], c["text"]) for c in found] == [("inclusion", "Age 18 or more"), ("inclusion", "Acute onset"), ("exclusion", "Pregnant"), ("exclusion", "No consent")]
    assert method == "mixed" and [c["idx"] for c in found] == [0, 1, 2, 3]


def test_lead_in_inline_header_and_sentences():
    found, _ = segment("Acute onset of:\n1. Fever\n2. Cough")
    assert [c["lead_in"] for c in found] == ["Acute onset of:"] * 2
    found, method = segment("Inclusion Criteria: patients must walk. They must talk.")
    assert method == "sentence_split" and [c["text"] for c in found] == ["patients must walk.", "They must talk."] and found[0]["section"] == "inclusion"
    assert segment(None) == ([], "none") and segment("ab") == ([], "none")


LINE = st.sampled_from(["Inclusion Criteria:", "Exclusion: no x", "- item one", "2) item two", "plain text. More Text; And so", "", "   deep", "List of:", "-  Exclusion Criteria:", "é 😀 word"])


@settings(max_examples=80, deadline=None)
@given(st.lists(LINE, max_size=12))
def test_spans_give_back_the_text(lines):
    blob = "\n".join(lines)
    squash = lambda s: re.sub(r"\s+", " ", s).strip()
    for c in segment(blob)[0]:
        assert squash(blob[c["span_start"] : c["span_end"]]) == squash(c["text"])


def test_segment_column_and_udtf(spark):
    df = spark.createDataFrame([(1, BLOB), (2, None)], "k long, t string")
    seg = segment_column(df, "k", "t")
    assert {r.k: (r.parse_method, len(r.criteria)) for r in seg.collect()} == {1: ("mixed", 4), 2: ("none", 0)}
    assert criteria_rows(seg, "k").count() == 4
    register_udtf(spark)
    df.createOrReplaceTempView("blobs")
    assert spark.sql("SELECT k, s.text FROM blobs, LATERAL segment_criteria(t) s").count() == 4


@pytest.mark.parametrize(("raw", "years"), [("14 Years", 14.0), ("6 months", 0.5), ("N/A", None), (None, None), ("1.2.3 Years", None), (" 2 Weeks ", 2 / 52.1775)])
def test_ages(spark, raw, years):
    got = one(spark, raw, X.age_years)
    assert got == (None if years is None else pytest.approx(years))


def test_blocks_and_flat(spark):
    assert one(spark, "\r\n   a  \r\n     b\rc\n\n", X.normalize_block) in ("a\n  b\nc", "   a\n     b\nc")
    assert one(spark, "    a\n      b\n", X.normalize_block) == "a\n  b"
    assert one(spark, " a \n b ", X.flat) == "a b" and one(spark, "  ", X.flat) is None


@pytest.mark.parametrize(("n", "chunks"), [(0, 1), (320, 1), (321, 2), (600, 3)])
def test_chunks(spark, n, chunks):
    text = " ".join(f"w{k}" for k in range(n))
    got = one(spark, text, X.chunk_words)
    assert len(got) == chunks and got[0] == " ".join(text.split()[:320])


def test_query_numbers_and_content(spark):
    assert one(spark, "[**2148-10-1**] chest (pain)", lambda c: X.prepare_query(c, "nodeid")) == "chest pain"
    assert one(spark, "a:b? [x]", X.prepare_query) == "a b x"
    assert one(spark, "10 100 1,5", lambda c: X.numbers(c, True)) == ["1", "1.5"]
    assert one(spark, "10 100 1,5", X.numbers) == ["10", "100", "1.5"]
    assert set(one(spark, "Patients with Severe asthma and severe copd", X.content_words)) == {"severe", "asthma", "copd"}


@pytest.mark.parametrize(("text", "want"), [("70 y/o with COPD", (70, "years", None)), ("A 3-month-old girl", (3, "months", "female")), ("45M with pain", (45, "years", "male")), ("He met a woman", (None, None, "female")), ("x" * 230 + " man", (None, None, None))])
def test_age_and_sex(spark, text, want):
    df = spark.createDataFrame([(text,)], "x string")
    assert tuple(df.select(*(c.alias(str(k)) for k, c in enumerate(X.gold_age_sex(F.col("x"))))).first()) == want
