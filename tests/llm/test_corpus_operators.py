"""Mixing, near copies, decontamination, token ids and the pipeline."""

import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from sievemark.llm import components, decontaminate, mixing, neardup, rangecoder, tokenids

from .conftest import D, HAS_DATA

needs_data = pytest.mark.skipif(not HAS_DATA, reason="no tables")
NORM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# ---- mixing -----------------------------------------------------------------------------------------------------------------


def targets_brute(sizes, weights=(5.0, 2.0, 1.0)):
    """Reshare the excess until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        for s in over or open_:
            out[s] = 2.0 * sizes[s] if over else level * w[s]
        left -= sum(2.0 * sizes[s] for s in over)
        open_ -= over or open_
    return out


def test_targets_and_taken(spark):
    random.seed(1)
    rows = [(k, random.choice(["a", "b", "c", "d", None]), " ".join("w" * random.randint(0, 30))) for k in range(400)] + [(1007, "hot", "x y z")] * 300
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.fair_mix(df).collect()
    by = {}
    for i, s, t in rows:
        by[s] = by.get(s, 0) + len(t.split())
    want = targets_brute(by)
    assert len(got) == len(rows) and {round(r.target, 6) for r in got} == {round(v, 6) for v in want.values()}
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    source, taken = {i: s for i, s, _ in rows}, dict.fromkeys(by, 0)
    for r in got:
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - v) <= 31 for s, v in want.items())
    key = lambda rs: sorted((r.doc_id, r.size, r.source_size, r.taken) for r in rs)
    assert key(got) == key(mixing.fair_mix(df.repartition(7)).collect())


def test_mixing_odd_rows(spark, odd):
    got = mixing.fair_mix(odd).collect()
    assert len(got) == odd.count() and all(r.taken == 0 for r in got if r.doc_id in (2, 3, 6))
    assert mixing.fair_mix(odd.limit(0)).count() == 0
    assert all(r.taken == 0 for r in mixing.fair_mix(odd.where("text is null")).collect())


# ---- near copies ------------------------------------------------------------------------------------------------------------


def classes_brute(rows):
    sets = []
    for _, t in rows:
        w = NORM.findall((t or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            c = len(sets[i] & sets[j])
            if c and c >= 0.8 * (len(sets[i]) + len(sets[j]) - c):
                links[i], links[j] = links[i] + 1, links[j] + 1
                parent[root(j)] = root(i)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[root(k)] = min(low.get(root(k), i), i)
    return sorted((str(i), str(low.get(root(k))), links[k]) for k, (i, _) in enumerate(rows))


def near_rows(n, seed):
    random.seed(seed)
    base = [f"w{k}" for k in range(90)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(random.randint(0, 3)):
            w[random.randrange(90)] = f"x{random.randrange(10**6)}"
        out.append((k, " ".join(w)))
    return out


ODD = [(1000, None), (1001, ""), (1002, "a b"), (1003, "A b."), (1004, "##"), (None, "c d e"), (None, "c d e f"), (5, "z " * 3000)]


@pytest.mark.parametrize("how", [neardup.ChosenPath(), neardup.ChosenPath(leaf=8, tile=16, depth=2)])
def test_dense_group_by_brute_force(spark, how):
    rows = near_rows(70, 3) + ODD + near_rows(70, 3)[4:6]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit("clash")).withColumn("node", F.lit(1))
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in neardup.jaccard_join(df, how=how).collect()) == classes_brute(rows)


def test_one_of_each_group_stays(spark):
    rows = near_rows(12, 4) + ODD + near_rows(12, 4)[:2]
    kept = neardup.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    classes = classes_brute(rows)
    assert sum(1 for r in kept if r.doc_id is not None and r.doc_id < 12 and r.text[0] == "w") == len({c for i, c, _ in classes if i.isdigit() and int(i) < 12})
    assert {r.doc_id for r in kept} >= {1000, 1001, 1002, 1004} and 1003 not in {r.doc_id for r in kept}
    assert neardup.drop_near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clean_rows_of_null_and_repeated_ids_stay(spark):
    a, b, c, d = ("one two three four five six", "red green blue black white grey", "north south east west up down", "##")
    rows = [(None, a), (None, a), (None, b), (None, d), (7, a), (8, c), (8, c), (8, b), (8, d), (8, "sun moon stars sky sea sand")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in neardup.drop_near_copies(df).collect())
    assert got == sorted([("None", d), ("7", a), ("8", b), ("8", c), ("8", d), ("8", rows[-1][1])])
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    df = spark.createDataFrame([(None, ITEM), (None, b), (3, "so " + ITEM), (3, c)], "doc_id long, text string")
    for how in (decontaminate.TemplateMatch(), decontaminate.TemplateMatch(broadcast_windows=0)):
        assert sorted((str(r.doc_id), r.text) for r in decontaminate.drop_leaks(df, items, how=how).collect()) == [("3", c), ("None", b)]


def test_runs_for_the_recall():
    assert neardup.ChosenPath(recall=0.9).runs < neardup.ChosenPath(recall=0.9999).runs


def test_components_of_a_chain(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


# ---- decontamination --------------------------------------------------------------------------------------------------------

ITEM = "A train leaves Paris at 5 km per hour and then the driver Tom buys 12 apples from the old market before Tom sells 5 of them again."


def test_parameters_may_change_but_consistently(spark):
    items = spark.createDataFrame([(1, ITEM), (2, "short one"), (3, None)], "item_id long, text string")
    same, other = "Rome at 70 km|Ann|9|70", "Rome at 70 km|Ann|9|71"
    text = "x A train leaves {0} per hour and then the driver {1} buys {2} apples from the old market before {1} sells {3} of them again. y"
    rows = [(1, text.format(*same.split("|"))), (2, text.format(*other.split("|"))), (3, None), (4, ""), (None, ITEM), (None, ITEM), (5, "the old market of apples")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item", F.lit(1)).withColumn("hash", F.lit(1))
    got = {r.doc_id: (r.item_id, r.n_changed) for r in decontaminate.find_leaks(df, items).collect()}
    assert got == {1: (1, 4), None: (1, 0)}
    assert {r.doc_id for r in decontaminate.drop_leaks(df, items).collect()} == {2, 3, 4, 5}
    assert decontaminate.find_leaks(df, items.limit(0)).count() == 0 == decontaminate.find_leaks(df.limit(0), items).count()
    shuffled = decontaminate.TemplateMatch(broadcast_windows=0)
    assert {r.doc_id for r in decontaminate.find_leaks(df, items, how=shuffled).collect()} == {1, None}


def test_decimals_thousands_and_first_names_are_slots(spark):
    item = "the {0} shop on the corner sold {1} loaves of dark bread to the people of it. {2} was glad."
    first = "{2} has {1} apples and gives some of them away. {2} then buys bread from the old shop near the river bank."
    items = spark.createDataFrame([(1, item.format("old", "3.50", "Tom")), (2, first.format("", "12", "Tom"))], "item_id long, text string")
    rows = [(1, item.format("old", "4.25", "Tom")), (2, item.format("old", "1,200", "Tom")), (3, item.format("old", "7", "Ann")), (4, first.format("", "12.5", "Ann")), (5, "we asked " + first.format("", "9", "Ann")), (6, "nothing of it 3.50")]
    got = {(r.doc_id, r.item_id): r.n_changed for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {(1, 1): 1, (2, 1): 1, (3, 1): 2, (4, 2): 2, (5, 2): 2}
    words = spark.range(1).select(decontaminate.words_of(F.lit("Costs 1,200.50, v1.2 or 1,2a.")).alias("w")).first().w
    assert [w.lstrip("\x01\x04") for w in words] == ["costs", "1,200.50", "v1", "2", "or", "1", "2a"]


def test_short_and_slot_rich_items_are_found_verbatim(spark):
    texts = ["What is 12 plus 35?", "Solve 3 x + 4 = 19 for x.", "Compute 3 + 4 * 5 - 6 / 2 + 8 * 9 - 10.", "Photosynthesis equation", "\u6c34\u306e\u6cb8\u70b9\u306f\u4f55\u5ea6\u3067\u3059\u304b", "Every child in that small town can read and write a long letter"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    rows = [(k, f"and so the question {x} and more") for k, x in enumerate(texts)] + [(4, "\u554f\u984c" + texts[4] + "\u7b54"), (7, "what is 12 plus 36 and solve 3 x"), (8, None), (9, "")]
    got = {(r.doc_id, r.item_id): (r.share, r.n_changed) for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {(k, k): (1.0, 0) for k in range(len(texts))}


@needs_data
def test_verbatim_leaks_by_brute_force(spark):
    docs, items = ({r[0]: r.text for r in spark.read.parquet(f"{D}/{t}.parquet").collect()} for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.op7_benchmark_decontamination(spark, D).collect()}
    assert got >= {(i, j) for i, t in docs.items() for j, x in items.items() if x in t}
    norm = lambda t: " ".join(NORM.findall(t.lower()))
    assert all(norm(items[j])[:40] in norm(docs[i]) or norm(items[j])[-40:] in norm(docs[i]) for i, j in got)


# ---- token ids --------------------------------------------------------------------------------------------------------------


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 65535) | st.integers(0, 3), max_size=700), max_size=6))
def test_coder_round_trip(blocks):
    blocks = [np.array(b, np.uint32) for b in blocks]
    back = rangecoder.decode_blocks(rangecoder.encode_blocks(blocks), [len(b) for b in blocks])
    assert all((a == b).all() for a, b in zip(blocks, back, strict=True))


def test_frames_and_damage():
    ids = np.tile(np.arange(100), 60)
    p = rangecoder.pack_frames([ids, ids[:0]])
    assert [x.tolist() for x in rangecoder.unpack_frames(p)] == [ids.tolist(), []]
    assert len(p[0]) < 2 * len(ids) / 4  # what repeats costs little
    bad = bytearray(p[0])
    bad[-3] ^= 1
    for damaged in (bytes(bad), p[0][:-1], b"x" + p[0][1:]):
        with pytest.raises(ValueError):
            rangecoder.unpack_frames([damaged])
    with pytest.raises(ValueError):
        rangecoder.pack_frames([np.array([2**32])])
    with pytest.raises(ValueError):
        rangecoder.pack_frames([ids], rangecoder.MOST_BLOCK_IDS + 1)


def test_long_blocks_of_many_kinds():
    rng = np.random.default_rng(5)
    n = rangecoder.MOST_BLOCK_IDS
    blocks = [rng.integers(0, 2**32, n, np.uint32), np.repeat(rng.integers(0, 50_000, 64, np.uint32), n // 64), rng.zipf(1.3, n).clip(0, 49_000).astype(np.uint32)]
    back = rangecoder.decode_blocks(rangecoder.encode_blocks(blocks), [n] * 3)
    assert all((a == b).all() for a, b in zip(blocks, back, strict=True))


def test_executors_coder_makes_the_same_frames(spark):
    from pyspark.sql import functions as F

    from sievemark.llm import jvmcoder

    rng, n = np.random.default_rng(8), rangecoder.MOST_BLOCK_IDS
    frames = [[], [0], [2**32 - 1], np.arange(n + 1), rng.integers(0, 2**32, 2 * n), rng.zipf(1.2, 3 * n).clip(0, 49_000), np.repeat(rng.integers(0, 50_000, 64), n // 64), np.tile(rng.integers(0, 9, 50), 700)]
    frames = [np.array(f, np.uint32) for f in frames]
    schema = "k int, b binary, lengths array<int>"
    halves = [[len(f) // 2, len(f) - len(f) // 2] for f in frames]
    df = spark.createDataFrame([(k, bytearray(f.astype("<u4").tobytes()), h) for k, (f, h) in enumerate(zip(frames, halves, strict=True))], schema)
    payloads = [bytes(r.b) for r in df.select("k", jvmcoder.pack(spark, F.col("b")).alias("b")).orderBy("k").collect()]
    assert payloads == rangecoder.pack_frames(frames)
    read = lambda rows: spark.createDataFrame(rows, schema).select("k", F.inline(jvmcoder.unpack(spark, F.col("b"), F.col("lengths")))).orderBy("k", "at").collect()
    back = read([(k, bytearray(p), h) for k, (p, h) in enumerate(zip(payloads, halves, strict=True))])
    assert [b"".join(bytes(r.ids) for r in back if r.k == k) for k in range(len(frames))] == [f.astype("<u4").tobytes() for f in frames]
    p = payloads[5]
    for damaged in (p[:-1], b"x" + p[1:], p[:-3] + bytes([p[-3] ^ 1]) + p[-2:], p[:9]):
        with pytest.raises(Exception, match="token ids"):
            read([(0, bytearray(damaged), halves[5])])


@pytest.mark.parametrize("text", ["The the THE, the. é. e\u0301. É; Straße! don't. 's. a<|endoftext|>. x.\u0301 ... İ. ΑΣ. \u212a. 1. a1, ÿ× ?!", "a\x1cb,", ""])
def test_words_with_marks_give_the_ids_of_whole_texts(words, text):
    texts = [text, text.upper(), text + " " + text]
    assert words.straight and [x.tolist() for x in words.encode(texts)] == [x.tolist()[:-1] for x in whole_ids(texts)]


def test_every_distinct_word_is_encoded_once(words, monkeypatch):
    asked = []
    words.known.clear()
    monkeypatch.setattr(words, "_of_model", lambda w, f=words._of_model: asked.append(w) or f(w))
    words.encode(["red Red, red. RED!", "red fox"])
    words.encode(["Fox; red"])
    assert sorted(asked) == ["fox", "red"]


@needs_data
def test_less_than_a_byte_an_id(words):
    import pyarrow.parquet as pq

    texts = pq.read_table(D.replace("0.001", "0.01") + "/documents.parquet", columns=["text"])["text"].to_pylist()
    ids = np.concatenate([np.append(x, 2) for k in range(0, len(texts), 16) for x in words.encode([t or "" for t in texts[k : k + 16]])])
    assert len(rangecoder.pack_frames([ids])[0]) < len(ids)


def whole_ids(texts):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenids.tokenizer_path())
    return [np.array(tk.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for t in texts]


@pytest.fixture(scope="module")
def words():
    with open(tokenids.tokenizer_path(), encoding="utf-8") as f:
        return tokenids.WordIds(f.read())


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["don't", "'S", "é", "e\u0301", "\u0301x", "\x1c", "\u2003", "\xa0", "<|endoftext|>", "ΑΣ", "İ", "123", "a", " ", "\n"]), max_size=12).map("".join))
def test_words_give_the_ids_of_whole_texts(words, text):
    assert words.encode([text])[0].tolist() == whole_ids([text])[0].tolist()[:-1]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_tokenizer_gives_the_ids_of_whole_texts(name):
    from tokenizers import Tokenizer

    path = tokenids.tokenizer_path(name)
    with open(path, encoding="utf-8") as f:
        words = tokenids.WordIds(f.read())
    texts = ["Hello world, hello  world", " lead and\ttab", "", "caf\u00e9 \u2003 42!", "Hello world, hello  world"]
    assert words.apart == (name == "word_bpe_49k.json")
    assert [x.tolist() for x in words.encode(texts)] == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_files_read_back(spark, odd):
    rows = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = tokenids.write_and_read(odd, tokenids.tokenizer_path()).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(rows, whole_ids([t for _, t in rows]), strict=True))
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [i for i, _ in rows]
    assert tokenids.write_and_read(odd.limit(0), tokenids.tokenizer_path()).count() == 0


# ---- pipeline ---------------------------------------------------------------------------------------------------------------


@needs_data
def test_pipeline_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    bench = [r.text for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, D)
        if k < 4:
            assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.collect())
    ids = [[r.doc_id for r in rows] for rows in kept]
    assert len(ids[0]) >= 0.98 * len(texts) and all(re.search(r"[^\W\d_]", texts[i]) for i in ids[0])
    assert sorted(ids[1]) == sorted({int(c) for _, c, _ in classes_brute([(i, texts[i]) for i in ids[0]])})
    assert set(ids[1]) - set(ids[2]) >= {i for i in ids[1] if any(b in texts[i] for b in bench)} and not any(b in texts[i] for i in ids[2] for b in bench)
    sizes = {}
    for i, s in ((r.doc_id, r.source) for r in kept[2]):
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", texts[i]))
    taken = {}
    for r in kept[3]:
        taken[r.source] = taken.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id]))
    longest = max(len(texts[i].split()) for i in ids[2])
    assert all(abs(taken.get(s, 0) - v) <= longest for s, v in targets_brute(sizes).items())
    at = 0
    for r, x in zip(sorted(kept[4], key=lambda r: r.start), whole_ids([texts[i] for i in sorted(ids[3])]), strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
