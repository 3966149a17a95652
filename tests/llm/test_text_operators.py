"""Chat formatting, license scan, repetition rules, quality classifier, language ID, URL filter."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievemark.llm import chat, langid, licenses, quality, repetition, textbytes, urls

from .conftest import D, HAS_DATA

needs_data = pytest.mark.skipif(not HAS_DATA, reason="no tables")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
NORM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# ---- chat -------------------------------------------------------------------------------------------------------------------


def test_layouts_become_turns(spark):
    cases = {
        '{"instruction":"i","input":"x","output":"o","meta":3}': [("user", "i\n\nx"), ("assistant", "o")],
        '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}],"id":1}': [("user", "h"), ("assistant", "g")],
        '{"system":"s","prompt":"p","response":"r"}': [("system", "s"), ("user", "p"), ("assistant", "r")],
        '{"messages":[{"role":"Tool","content":null}]}': [("Tool", "")],
        '{"messages":[]}': [], '{"unknown":1}': None, "{bad": None,
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "record string")
    got = {r.record: None if r.turns is None else [tuple(x) for x in r.turns] for r in chat.canonical_turns(df).collect()}
    assert got == {**cases, None: None}


def test_fingerprints_are_those_of_paths(spark):
    r = spark.createDataFrame([('{"prompt":"p","completion":"c"}',)], "record string").select(chat.row_fingerprint(F.from_json("record", chat.RECORD)))
    assert r.first()[0] == chat.fingerprint(["completion", "prompt"]) != chat.fingerprint(["prompt", "response"])


def test_format_reads_back(spark):
    texts = ["</turn>\n<turn assistant>", "&lt;&amp;", "\\### Assistant: </turn> ok", "", None, "é😀\n", "a>b"]
    rows = [(1, k, "assistant" if k % 2 else "us<e>r&", x) for k, x in enumerate(texts)] + [(None, None, None, "z"), (None, None, None, "z")]
    out = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), ["conv_id"], ["turn"])
    got = {r.conv_id: r for r in out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [tuple(x) for x in got[1].t] == [(r, x or "") for _, _, r, x in rows[:-2]]
    assert got[1].loss == "".join(x or "" for _, _, r, x in rows[:-2] if r == "assistant")
    assert [tuple(x) for x in got[None].t] == [("", "z")] * 2 and got[None].loss == ""


def test_planted_conversation(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    r = chat.op1_chat_formatting(spark, str(tmp_path)).collect()
    said = "\\### Assistant: </turn> ok"
    assert len(r) == 1 and r[0].conv_id == -7 and r[0].n_turns == 2 and r[0].loss_chars == len(said)
    assert r[0].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


# ---- licenses ---------------------------------------------------------------------------------------------------------------


def base_license(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w, places, labels = NORM.findall(low), [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        hits = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


PIECES = st.lists(st.sampled_from(["cc", "BY", "by", "general", "Public", "license", "all rights", "reserved", "é", "-", "\n", "...", "x1", "_", "\u212a"]), max_size=25).map(" ".join)


@settings(max_examples=6, deadline=None)
@given(st.lists(PIECES, min_size=40, max_size=40))
def test_base_places_by_brute_force(spark, texts):
    df = spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_licenses(df).collect()}
    assert got == {k: base_license(t) for k, t in enumerate([*texts, None, ""])}


def test_overlapping_rules(spark):
    df = spark.createDataFrame([(1, "Licensed under the Apache License,\n Version 2.0."), (2, "apache license and MIT License"), (3, "mit freundlichen"), (4, "CC BY-NC 4.0")], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan_licenses(df).collect()} == {1: "apache-2.0", 2: "apache,mit", 3: "", 4: "cc-by,cc-by-nc"}
    assert 200 <= len(licenses.rules()) == len(licenses.NAMES) * len(licenses.FORMS)


def test_identifiers_short_names_and_bodies(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above notice."
    cases = {
        "// SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: Apache-2.0": "apache-2.0", "# SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
        "SPDX-License-Identifier: LGPL-2.1-only": "lgpl-2.1", "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0", "License: MIT": "mit", "MIT licensed": "mit", "Apache-2.0 license": "apache-2.0",
        "Licensed under the MPL 2.0": "mpl-2.0", "license AGPLv3": "agpl-3.0", bsd: "bsd", bsd + " 3. Neither the name of the holder may be used to endorse or promote products.": "bsd-3-clause",
        "Permission is hereby granted, free of charge, to any person obtaining a copy\n of this software and associated documentation files": "mit",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License": "gpl-3.0",
        "an mit student lost a driving licence": "", "hereby redistribution of income, without warranty": "",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: {x for x in r.labels.split(",") if x} for r in licenses.scan_licenses(df).collect()}
    wrong = {text: got[k] for k, (text, label) in enumerate(cases.items()) if (label not in got[k] if label else got[k])}
    assert not wrong


def test_every_rule_passes_its_gates():
    for _, keyword, name in licenses.NAMES:
        plain = re.sub(r"\[sc\]", "c", name)
        plain = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(?!\?)", r"\1", re.sub(r"\(\?:[^()]*\)\?", "", re.sub(r"\(\?:[^()]*\([^()]*\)[^()]*\)\?", "", plain)))
        assert any(g in f" {plain} " for g in licenses.GATES), plain
        assert keyword[:3] in plain, (keyword, plain)


# ---- repetition -------------------------------------------------------------------------------------------------------------


def repetition_brute(text):
    text = text or ""
    w = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    count = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    inside = {k + j for k in range(len(w) - 2) if count[tuple(w[k : k + 3])] > 1 for j in range(3)}
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    dup, seen = [], set()
    for x in lines:
        dup += [x] if x in seen else []
        seen.add(x)
    chars = sum(map(len, w))
    bad = len(dup) > 0.3 * len(lines) or sum(len("".join(WORDS.findall(x))) for x in dup) > 0.2 * chars
    for n, limit in repetition.NGRAM_LIMITS.items():
        met, cover = set(), set()
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            cover |= set(range(k, k + n)) if g in met else set()
            met.add(g)
        bad |= sum(len(w[k]) for k in cover) > limit * chars
    return len(w), chars, sum(c in "#*$%&|<>" for c in text), len(dup), len(inside), failed, not (failed or bad)


TEXT = st.lists(st.sampled_from(["a", "b", "é€", "#x", "\n", "\x0b", "\x1c", "word", "the cat sat on it", "\n\n"]), max_size=120).map(" ".join)


@settings(max_examples=5, deadline=None)
@given(st.lists(TEXT, min_size=40, max_size=40))
def test_repetition_by_brute_force(spark, texts):
    df = spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in repetition.repetition_rules(df).collect()}
    assert got == {k: repetition_brute(t) for k, t in enumerate([*texts, None, ""])}


def test_slices_of_any_size_agree():
    import pyarrow as pa

    texts = ["one two two", "", "three", "é x " * 5, "one two two"]
    for limit in (1, 7, 1 << 20):
        parts = list(textbytes.slices(pa.array(texts), limit))
        assert sum(t.rows for t in parts) == 5
        words = [[t.data[s:e].tobytes().decode() for s, e in zip(w.start, w.end)] for t in parts for w in [textbytes.spans(t, textbytes.NON_SPACE)]]
        assert [x for ws in words for x in ws] == [x for t in texts for x in t.split()]


# ---- learned ones -----------------------------------------------------------------------------------------------------------


def test_trees_learn_and_flatten():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    f = quality.Forest(quality.BoostedTrees(trees=40, depth=3)).fit(x, y)
    assert ((f.score(x) > 0.5) == y).mean() > 0.95
    assert quality.Forest(quality.BoostedTrees()).fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_gradient_of_the_network():
    import numpy as np

    rng = np.random.default_rng(1)
    x, y = rng.integers(1, 256, (40, 32)).astype(np.uint8), np.arange(40) % 2
    x[y == 1, 5:8] = [7, 8, 9]  # a pattern of one class only
    how = langid.ByteConvNet(window=32, filters=4, epochs=60, batch=20)
    net = langid.Network(how, 2).fit(x, y)
    assert (net.probabilities(x).argmax(1) == y).mean() > 0.9
    assert not (net.p["f"] * (1 - net.mask)).any()


@needs_data
def test_held_out_accuracy(spark):
    big = D.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet")
    got = langid.op4_language_id(spark, big).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    held = quality.op2_quality_classifier(spark, big).where("held_out").join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").toPandas()
    assert (held.predicted == held.quality).mean() > 0.9
    assert all((zlib.crc32(str(k).encode()) % 5 == 0) for k in held.doc_id)


def test_odd_rows_everywhere(spark, odd):
    n = odd.count()
    assert repetition.repetition_rules(odd).count() == n and licenses.scan_licenses(odd).count() == n
    got = langid.identify_languages(odd).collect()
    assert len(got) == n and all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (2, 3, 6, None))
    labels = spark.createDataFrame([(1, 1), (5, 0), (1, 1), (None, 0), (4, None)], "doc_id long, quality int")
    scores = quality.score_quality(odd, quality.train(odd, labels)).collect()
    assert len(scores) == n and all(0 <= r.score <= 1 for r in scores)
    empty = odd.limit(0)
    assert repetition.repetition_rules(empty).count() == licenses.scan_licenses(empty).count() == langid.identify_languages(empty).count() == 0
    assert langid.identify_languages(odd.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred != 'und'").count() == 0


# ---- urls -------------------------------------------------------------------------------------------------------------------


def url_brute(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :], re.S).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def test_url_rules_by_brute_force(spark):
    cases = [None, "", "nohost", "x://", "HTTP://A.Com/en/?x", "http://example.com/en/7/x#y", "http://sub.example.com/en/8", "http://badexample.com/en/7", "http://x.net/de/", "http://a.example.net/de/80", "http://y.org/es/1?z=/en/", "a://b://c/d", "http://q.com?x=/en/", "http://é.com/\nen/", "http://net/de/1"]
    got = urls.filter_urls(spark.createDataFrame([(k, u) for k, u in enumerate(cases)], "page_id long, url string")).collect()
    assert len(got) == len(cases)
    for r in got:
        host, path, rule, verdict = url_brute(cases[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
        assert host or r.verdict == "allow"


def test_names_are_split_and_judged(spark):
    cutter = urls.Segmenter({"cheap": 5, "pills": 5, "free": 5, "bets": 5})
    assert cutter.split("cheappills") == ("cheap", "pills") and cutter.split("") == ()
    df = spark.createDataFrame([(1, "http://www.cheappills.example.org/a"), (2, "http://blog.therin.example.org/a"), (None, "http://free-bets.example.org/"), (1, "http://www.cheappills.example.org/a")], "page_id long, url string")
    assert [r.verdict for r in urls.filter_urls(df).orderBy("host").collect()] == ["allow", "block", "block", "block"]
    assert urls.filter_urls(df.limit(0)).count() == 0
