"""Token ids of whole texts, written as range-coded frames in ascending id order and read back.

A frame is a Parquet row: where it stands (part, seq, ids before it in the part), the documents in it with their
lengths, and a payload in the format of `rangecoder`. Spark's writer commits the files, so lost executors leave no
halves, and any file system will do. A document never spans frames, and blocks inside a frame can be read alone.

Python makes ids of texts; the executors' JVMs make frames of ids and read them again.
"""

from __future__ import annotations

import itertools
import json
import os
import random
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import jvmcoder
from .tables import bounded_batches, documents, keep, shared_folder
from .textbytes import releasing

FRAME_IDS = 1 << 19
#: Words whose ids a worker remembers, about 200 bytes each; bytes of texts of which each distinct word is looked up once.
REMEMBERED, TEXT_BYTES = 600_000, 8 << 20
#: Parts of the table of parts that may be broadcast.
BROADCAST_PARTS = 100_000
#: Words whose ids are put together at once.
_WORDS_AT_ONCE = 1 << 18
_PARTING = "[\x1c-\x1f]"
#: Letters of which no normaliser makes anything else, and marks that are a piece of their own behind one.
_PLAIN, _MARKS = re.compile("[a-z\xdf-\xf6\xf8-\xff]+"), ".,;:!?"


# Splits of which no piece holds white space, so that words can be encoded apart.
SPLITS_BY_SPACE = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)
# Normalisers that leave white space between words and nothing of it inside them.
_KEEPS_SPACE = ("NFC", "NFD", "NFKC", "NFKD", "Lowercase")


def words_apart(tokenizer: dict) -> bool:
    """Whether a tokenizers file surely gives a text the ids of its words, one after the other: its first split drops all white
    space, and its normalisers neither add nor move any. Of other files whole texts are encoded."""
    parts = lambda x, name: [] if x is None else x[name] if x["type"] == "Sequence" else [x]
    splits = parts(tokenizer.get("pre_tokenizer"), "pretokenizers")
    first = splits[0] if splits else {"type": "none"}
    dropped = first["type"] in ("Whitespace", "WhitespaceSplit") or (first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and first["pattern"].get("Regex") in SPLITS_BY_SPACE)
    prefix = any(x.get("add_prefix_space") for x in splits)
    squeezes = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    plain = all(x["type"] in _KEEPS_SPACE or x == squeezes for x in parts(tokenizer.get("normalizer"), "normalizers"))
    spaced = any(re.search(r"\s", t["content"]) for t in tokenizer.get("added_tokens", []))
    return dropped and plain and not prefix and not spaced


def byte_letters() -> list[str]:
    """The letter that byte-level models have for each byte: its own if that can be seen, else the next from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return [chr(b if b in seen else 256 + hidden.index(b)) for b in range(256)]


def letters_whole(tokenizer: dict) -> bool:
    """Whether a tokenizers file, whose words are apart, surely hands a word of plain letters to its model in one piece, and marks
    behind it in another: it splits by kinds of characters, then takes bytes for letters, and no added token has only letters or
    one of the marks."""
    parts = lambda x, name: [] if x is None else x[name] if x["type"] == "Sequence" else [x]
    splits = parts(tokenizer.get("pre_tokenizer"), "pretokenizers")
    by_kind = len(splits) == 2 and splits[0]["type"] == "Split" and splits[1]["type"] == "ByteLevel" and not splits[1].get("use_regex", True)
    kept = all(x["type"] in ("NFC", "NFKC", "Lowercase", "Replace") for x in parts(tokenizer.get("normalizer"), "normalizers"))
    added = any(t["content"].isalpha() or set(t["content"]) & set(_MARKS) for t in tokenizer.get("added_tokens", []))
    return by_kind and kept and not added and not tokenizer.get("post_processor") and not tokenizer["model"].get("dropout")


class WordIds:
    """Ids of texts by a tokenizers file.

    If its words never reach across white space, each distinct word is encoded by the library once and remembered; a text
    with one of the four separators that Arrow, but not the tokenizer, takes for white space is encoded in one piece, and
    so is every text if words may join. Words of plain letters, with or without marks behind, go straight to the library's
    model if the file surely hands them to it as they are.
    """

    _of: dict[int, WordIds] = {}

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        parsed = json.loads(tokenizer_json)
        self.tokenizer, self.apart = Tokenizer.from_str(tokenizer_json), words_apart(parsed)
        # whole texts, whatever the file says of lengths
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, bytes] = {}
        self.lowers, self.model = "Lowercase" in json.dumps(parsed.get("normalizer")), self.tokenizer.model
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        self.straight = self.apart and letters_whole(parsed) and self._agrees()

    @classmethod
    def cached(cls, tokenizer_json: str) -> WordIds:
        key = zlib.crc32(tokenizer_json.encode())
        if key not in cls._of:
            cls._of[key] = cls(tokenizer_json)
        return cls._of[key]

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_model(self, word: str) -> bytes:
        tokens = self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def _agrees(self) -> bool:
        draw = random.Random(0)
        probes = ["".join(draw.choices("etaoinshrdluzßéèçü", k=draw.randint(1, 12))) for _ in range(200)]
        return list(map(self._of_model, probes)) == self._encoded(probes) and self._encoded([w + m for w in probes for m in _MARKS]) == [a + b for a in self._encoded(probes) for b in self._encoded(list(_MARKS))]

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words. The word before its marks is remembered rather than both together."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        out, rest = list(map(known.get, words)), []
        for k, ids in enumerate(out):
            if ids is not None:
                continue
            body = words[k].rstrip(_MARKS)
            plain, marks = body.lower() if self.lowers else body, words[k][len(body) :]
            if not self.straight or not _PLAIN.fullmatch(plain):
                rest.append(k)
                continue
            if plain not in known:
                known[plain] = self._of_model(plain)
            if marks and marks not in known:
                known[marks] = self._encoded([marks])[0]
            out[k] = known[plain] + known[marks] if marks else known[plain]
        for k, ids in zip(rest, self._encoded([words[k] for k in rest]), strict=True):
            out[k] = known[words[k]] = ids
        return out

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not self.apart:
            return [np.frombuffer(x, "<u4") for x in self._encoded(texts.to_pylist())]
        joined = pc.match_substring_regex(texts, _PARTING)
        split = pc.utf8_split_whitespace(pc.if_else(joined, "", texts))
        places = split.flatten().dictionary_encode()
        ids = self._ids_of(places.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first, flat, at = np.cumsum(size) - size, np.frombuffer(b"".join(ids), "<u4"), places.indices.to_numpy()
        out = [np.zeros(0, "<u4")]
        for k in range(0, len(at), _WORDS_AT_ONCE):
            own = at[k : k + _WORDS_AT_ONCE]
            n = size[own]
            ends = np.cumsum(n)
            out.append(flat[np.repeat(first[own] - ends + n, n) + np.arange(ends[-1])])
        ends = np.concatenate([[0], np.cumsum(size[at])])[split.offsets.to_numpy()]
        texts_of = np.split(np.concatenate(out), ends[1:-1] - ends[0]) if len(texts) else []
        whole = np.flatnonzero(joined.to_numpy(zero_copy_only=False))
        for k, x in zip(whole, self._encoded(texts.take(pa.array(whole)).to_pylist()), strict=True):
            texts_of[k] = np.frombuffer(x, "<u4")
        return texts_of


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
    """Keys and texts of some batches at a time."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
        if held and (batch is None or sum(b.nbytes for b in held) >= TEXT_BYTES):
            yield [k for b in held for k in b.column(0).to_pylist()], pa.concat_arrays([b.column(1).cast(pa.large_string()) for b in held])
            held = []


_FRAME = "part int, seq int, before long, n_ids long, ids_of array<{id}>, lengths array<int>, payload binary"


def _encode(tokenizer_json: str, end: int | None, id_type: pa.DataType):
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("ids_of", pa.list_(id_type)), ("lengths", pa.list_(pa.int32())), ("payload", pa.binary())])
    tail = np.array([] if end is None else [end], np.uint32)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = WordIds.cached(tokenizer_json), TaskContext.get().partitionId()
        seq = before = size = 0
        keys: list = []
        own: list[np.ndarray] = []

        def frame() -> pa.RecordBatch:
            lengths = [len(x) for x in own]
            values = part, seq, before, size, keys, lengths, np.concatenate(own).astype("<u4").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types, strict=True)], schema=schema)

        for some, texts in gathered(batches):
            for key, ids in zip(some, words.encode(texts.fill_null("")), strict=True):
                if size >= FRAME_IDS:
                    yield frame()
                    seq, before, size, keys, own = seq + 1, before + size, 0, [], []
                keys.append(key)
                own.append(np.concatenate([ids, tail]))
                size += len(own[-1])
        if keys:
            yield frame()

    return run


def write_token_ids(docs: DataFrame, path: str, tokenizer_file: str, end: int | None = 2, text_col: str = "text", id_col: str = "doc_id") -> None:
    """Writes the ids of every whole text, each followed by `end`, as frames under `path`.

    Documents stand in ascending id order, null first; rows of equal id by a hash of the text. Null and empty texts have
    no ids but the end; rows that repeat both id and text all stand there. Texts of any length are encoded whole. Other
    columns aren't read, so their names don't matter. An empty table gives an empty folder of files. The tokenizer file
    is read by the driver only.
    """
    bounded_batches(docs.sparkSession)
    with open(tokenizer_file, encoding="utf-8") as f:
        tokenizer_json = f.read()
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = d.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    frames = ordered.mapInArrow(_encode(tokenizer_json, end, to_arrow_type(kind)), _FRAME.format(id=kind.simpleString()))
    frames.withColumn("payload", jvmcoder.pack(docs.sparkSession, F.col("payload"))).write.parquet(path)


def read_token_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document under `path`, decoded from its files.

    start counts the ids of all documents before it. A damaged block is an error, and so is a folder without files.
    """
    frames = spark.read.parquet(path)
    own = F.arrays_zip("ids_of", "lengths", jvmcoder.unpack(spark, F.col("payload"), F.col("lengths")).alias("own"))
    out = frames.select("part", "before", F.inline(own).alias("doc_id", "n_tokens", "own"))
    # ids before each part: one row per part, from the frames' numbers alone
    parts = frames.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "first")
    out = out.join(F.broadcast(parts) if parts.count() <= BROADCAST_PARTS else parts, "part")
    columns = ["doc_id", (F.col("first") + F.col("before") + F.col("own.at")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), F.crc32("own.ids").alias("ids_crc32")]
    return out.select(*columns, *([jvmcoder.ids(spark, F.col("own.ids")).alias("ids")] * with_ids))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def write_and_read(docs: DataFrame, tokenizer_file: str, end: int | None = 2) -> DataFrame:
    """Writes ids into the shared folder and reads them back; the files go when the driver's process ends."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    keep(spark, path)
    write_token_ids(docs, path, tokenizer_file, end)
    return read_token_ids(spark, path)


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum in the files written."""
    return write_and_read(documents(spark, sf_dir), tokenizer_path())
