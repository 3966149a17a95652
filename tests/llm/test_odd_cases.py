"""Every operator and every pipeline stage on nulls, empty and very long texts, ties, repeated rows, clashing columns and empty
tables: none crashes, and each gives what its docstring says."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievemark.llm import chat, decontaminate, langid, licenses, mixing, neardup, quality, repetition, tokenids, urls

#: Names that the operators use inside.
CLASHES = "_id _y _gone _at _row _key _record _print _text _doc _v _norm _found _words id at loc rep node tile side n key taken size target upto bucket host path odds score lang_pred item hash views detections part before start".split()
LONG = "Über the Hills and far away, 12 km of road. " * 3000


@pytest.fixture(scope="module")
def strange(spark):
    rows = [(1, "The cat sat on the mat and looked. " * 30, "en", "s"), (1, "The cat sat on the mat and looked. " * 30, "en", "s"), (2, None, "en", "s"), (3, "", None, None), (None, "###", "de", "t"), (None, None, None, None), (4, LONG, "de", "t"), (4, "another text with the same id as that", "de", "t"), (5, "Der Hund läuft über die Straße und bellt laut", "de", "s"), (6, "\n \t\n", "de", "s"), (7, "x", "en", "t")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(f"clash {c}").alias(c) for c in CLASHES)).cache()


def items(spark):
    return spark.createDataFrame([(1, "The cat sat on the mat and looked. The cat sat on the mat and looked."), (2, None), (3, ""), (5, "x"), (None, "zzz")], "item_id long, text string")


def quality_scores(df):
    labels = df.sparkSession.createDataFrame([(1, 1, "c"), (5, 0, "c"), (1, 1, "c"), (None, 0, "c"), (4, None, "c"), (7, 5, "c")], "doc_id long, quality int, text string")
    return quality.score_quality(df, quality.train(df, labels))


def url_verdicts(df):
    url = F.when(F.col("doc_id") == 4, F.concat(F.lit("http://a.b/"), F.repeat(F.lit("cheapcasinopills"), 2000))).otherwise(F.concat(F.lit("http://x.org/"), "text"))
    return urls.filter_urls(df.withColumn("url", url), id_col="doc_id", page_col="text")


def formatted(df):
    record = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.coalesce("text", F.lit("")).alias("content"))).alias("messages")))
    turns = chat.canonical_turns(df.withColumn("record", record))
    assert set(turns.columns) == {*df.columns, "record", "layout", "turns"} and turns.where("_record = 'clash _record' AND _print = 'clash _print'").count() == df.count()
    return chat.format_turns(turns.select("doc_id", F.lit(0).alias("turn"), F.inline("turns")), ["doc_id"], ["turn"])


def finds(df):
    return decontaminate.find_leaks(df, items(df.sparkSession))


# operator, and the number of rows it gives for so many input rows and ids (None: no claim)
OPERATORS = {
    1: (formatted, lambda rows, ids: ids),
    2: (quality_scores, lambda rows, ids: rows),
    3: (url_verdicts, lambda rows, ids: rows),
    4: (langid.identify_languages, lambda rows, ids: rows),
    5: (mixing.fair_mix, lambda rows, ids: rows),
    6: (neardup.jaccard_join, lambda rows, ids: rows),
    7: (finds, None),
    8: (lambda df: tokenids.write_and_read(df, tokenids.tokenizer_path()), lambda rows, ids: rows),
    9: (licenses.scan_licenses, lambda rows, ids: rows),
    10: (repetition.repetition_rules, lambda rows, ids: rows),
}


@pytest.mark.parametrize("n", OPERATORS)
def test_operator(spark, strange, n):
    run, expected = OPERATORS[n]
    got = run(strange).collect()
    if expected:
        assert len(got) == expected(strange.count(), strange.select("doc_id").distinct().count())
    # rows that repeat give what repeats, and another partitioning the same
    plain = lambda v: round(v, 4) if isinstance(v, float) else v  # noqa: E731  (matrix products may differ in the last bits)
    key = lambda rows: sorted(str([plain(v) for v in r]) for r in rows)
    assert key(got) == key(run(strange.repartition(3)).collect())
    assert run(strange.limit(0)).count() == 0


def test_what_odd_rows_give(spark, strange):
    assert {(r.doc_id, r.item_id) for r in finds(strange).collect()} == {(1, 1), (7, 5)}
    near = {(r.doc_id, r.n_links) for r in neardup.jaccard_join(strange).collect()}
    assert (1, 1) in near and {(2, 0), (3, 0), (6, 0), (7, 0)} <= near
    said = {r.doc_id: r.lang_pred for r in langid.identify_languages(strange).collect() if r.doc_id in (2, 3, 6)}
    assert set(said.values()) == {"und"}
    assert all(r.verdict in ("allow", "block") for r in url_verdicts(strange).collect())
    assert {r.doc_id for r in url_verdicts(strange).collect() if r.verdict == "block" and r.rule is None} == {4}


@pytest.mark.parametrize("k", range(5))
def test_stage(spark, strange, tmp_path, k):
    items(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, strange, str(tmp_path))
    rows = out.collect()
    if k < 4:
        assert out.columns == list(corpus_pipeline.COLUMNS)
    ids = [r.doc_id for r in rows]
    texts = {(r.doc_id, r.text) for r in strange.collect()}
    if k == 0:
        assert set(ids) <= {1, 4, 5, 7} and all(re.search(r"[^\W\d_]", r.text) for r in rows)
    elif k == 1:
        assert {(r.doc_id, r.text) for r in rows} == texts and ids.count(1) == 1
    elif k == 2:
        assert {(r.doc_id, r.text) for r in rows} == {x for x in texts if x[0] not in (1, 7)}
    elif k == 3:
        assert all(r.text and r.text.split() for r in rows) and {(r.doc_id, r.text) for r in rows} <= texts
    else:
        assert len(rows) == strange.count()
    assert stage(spark, strange.limit(0), str(tmp_path)).count() == 0


def test_containment_by_brute_force(spark):
    rules = licenses.rules() + licenses.signatures()
    texts = ["Licensed under the Apache License, Version 2.0 or the MIT license. " * 3, "GNU Lesser General Public License version 2.1; the GNU General Public License v3", "CC BY-NC-SA 4.0, cc by sa, https://creativecommons.org/licenses/by-sa/4.0/ some rights reserved", "released into the public domain under the Unlicense: unlicense.org", ("MPL 2.0 license " * 200) + LONG[:5000]]
    got = {r.doc_id: sorted((d.nth, d.start, d.end) for d in r.detections) for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        norm = " " + " ".join(x for x in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low) if x) + " "
        every = [(m.end() - m.start(), -r["nth"], m.start(), m.end(), r["nth"]) for r in rules if r["keyword"] in norm for m in re.finditer(r["pattern"], norm)]
        kept = [(n, s, e) for size, _, s, e, n in every if not any(s2 <= s and e2 >= e and (size2 > size or (size2 == size and n2 < n)) for size2, _, s2, e2, n2 in every)]
        assert got[k] == sorted(kept), text[:60]


def test_every_notice_is_found_and_clean_text_is_not(spark):
    plain = lambda p: re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)", r"\1", re.sub(r"\(\?:[^()]*\)\?", "", re.sub(r"\[sc\]|\[1-4\]|\[0-9\]", lambda m: {"[sc]": "s", "[1-4]": "4", "[0-9]": "0"}[m.group()], p))).replace("?", "").replace("  ", " ").strip()
    lines = [(k, "xx " + plain(p) + " yy", label) for k, (label, _, p) in enumerate(licenses.NOTICES + licenses.BODIES) if ".{" not in p]
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan_licenses(spark.createDataFrame(lines, "doc_id long, text string, label string")).collect()}
    assert not [(line, got[k]) for k, line, label in lines if label not in got[k]]
    clean = ["The driving licence of the public library was released without warranty by the Apache nation", "mit freundlichen Grüßen", "redistribution of income", "An unauthorized reproduction was sold"]
    assert all(r.labels == "" for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(clean)), "doc_id long, text string")).collect())


def near_threshold(n, seed):
    """Pairs of texts whose shingle sets have a similarity a little above the threshold, each pair of its own words."""
    import random

    random.seed(seed)
    out = []
    for k in range(n):
        words = [f"p{k}w{j}" for j in range(200)]
        other = list(words)
        for j in random.sample(range(5, 195, 12), 3 + k % 2):
            other[j] = f"q{k}x{j}"
        out += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    return out


def test_recall_near_the_threshold(spark):
    rows = near_threshold(150, 9)
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    like = {2 * k: len(a & b) / len(a | b) for k, (a, b) in enumerate(zip(sets[::2], sets[1::2], strict=True))}
    linked = [k for k, s in like.items() if s >= 0.8]
    assert len(linked) >= 100 and max(like.values()) < 0.87
    got = {r.doc_id for r in neardup.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.n_links}
    assert len([k for k in linked if k in got]) >= 0.99 * len(linked)
    assert not [k for k, s in like.items() if s < 0.8 and k in got]
