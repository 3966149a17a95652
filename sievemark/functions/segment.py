"""Segmentation of eligibility text into criteria with spans back into it.

One pass over the lines keeps three things: the section, the lead-in and the open block. It is inherently sequential inside
a text, so it is a Python function for whole Arrow batches of texts; texts are independent of each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import spread

# What bullets, headers and sentence ends look like, and the shortest criterion.
_BULLET = re.compile(r"^(\s*)(?:[-*•‣▪·–—]|\(\d+\)|\d+[.)]|\([a-zA-Z]\)|[a-zA-Z]\))\s+")
_NUMBERED = re.compile(r"^\s*(?:\(\d+\)|\d+[.)])")
_TITLE = r"^\s*(?:key|main|principal|general|major)?\s*(inclusion|exclusion|ineligibility)\b[^:\n]{0,60}?"
_HEADER = re.compile(_TITLE + r":?\s*$", re.I)
_HEADER_INLINE = re.compile(_TITLE + r":\s*(\S.*)$", re.I)
_SENTENCE = re.compile(r"(?<=[.;])\s+(?=[A-Z0-9])")
MIN_CHARS = 3
_WORD, _DASH = re.compile(r"\S+"), re.compile(r"^\s*[-*•]", re.M)


@dataclass
class _Block:
    section: str
    start: int
    end: int
    lead_in: str | None
    parts: list[str] = field(default_factory=list)


class _Reader:
    """State of one text: every line either changes the section, opens a block, or adds to the open one."""

    def __init__(self) -> None:
        self.section, self.lead_in = "unknown", None
        self.blocks: list[_Block] = []
        self.open: _Block | None = None
        self.bullets = self.numbers = False

    def begin(self, start: int, end: int, text: str, lead_in: str | None) -> None:
        self.open = _Block(self.section, start, end, lead_in, [text])
        self.blocks.append(self.open)

    def header(self, line: str, start: int) -> bool:
        """A header closes what is open and switches the section; text after its colon opens a block."""
        inline = _HEADER_INLINE.match(line)
        found = _HEADER.match(line) or inline
        if not found:
            return False
        self.open = self.lead_in = None
        self.section = "inclusion" if found.group(1).lower() == "inclusion" else "exclusion"
        if inline:
            self.begin(start + inline.start(2), start + len(line), inline.group(2).strip(), None)
        return True

    def line(self, line: str, start: int) -> None:
        text = line.strip()
        if not text or self.header(line, start):
            return
        mark = _BULLET.match(line)
        if mark:
            # a header may hide behind a bullet
            if self.header(line[mark.end() :].strip(), start + mark.end()):
                if self.open:
                    self.open.end = start + len(line)
                return
            self.bullets = True
            self.numbers |= bool(_NUMBERED.match(line))
            self.begin(start + mark.end(), start + len(line), line[mark.end() :].strip(), self.lead_in)
        elif self.open:
            self.open.parts.append(text)
            self.open.end = start + len(line)
        elif text.endswith(":"):
            self.lead_in = text
        else:
            self.begin(start, start + len(line), text, self.lead_in)


class _Offsets:
    """A block's text with white space collapsed, and where each of its characters stands in the blob: spans are lookups then.

    Built once per block, so that looking for a piece is a plain search in one string; its first place counts.
    """

    def __init__(self, blob: str, block: _Block):
        self.block, self.at = block, []
        words = []
        for word in _WORD.finditer(blob, block.start, block.end):
            if words:
                self.at.append(word.start() - 1)
            words.append(word.group())
            self.at.extend(range(word.start(), word.end()))
        self.text = " ".join(words)

    def span(self, piece: str) -> tuple[int, int]:
        """Where a piece stands; the whole block if it isn't found, which only text that the block dropped can cause."""
        flat = " ".join(piece.split())
        k = self.text.find(flat)
        if k < 0:
            return self.block.start, self.block.end
        return self.at[k], self.at[k + len(flat) - 1] + 1


def _criteria(block: _Block, blob: str, bulleted: bool) -> Iterator[tuple[str, int, int]]:
    """The block's criteria with their spans: the block itself in a bulleted text, else its sentences."""
    text = " ".join(filter(None, block.parts)).strip()
    if bulleted:
        yield text, block.start, block.end
        return
    where = _Offsets(blob, block)
    for piece in map(str.strip, _SENTENCE.split(text)):
        if piece:
            yield piece, *where.span(piece)


def _method(reader: _Reader, blob: str, any_found: bool) -> str:
    if not reader.bullets:
        return "sentence_split" if any_found else "none"
    return "bulleted" if not reader.numbers else "mixed" if _DASH.search(blob) else "numbered"


def segment(blob: str | None) -> tuple[list[dict], str]:
    """Criteria (idx, section, text, span_start, span_end, lead_in) of a text, and the method that found them."""
    reader, at = _Reader(), 0
    for line in (blob or "").split("\n"):
        reader.line(line, at)
        at += len(line) + 1
    rows = [(b, *c) for b in reader.blocks for c in _criteria(b, blob or "", reader.bullets) if len(c[0]) >= MIN_CHARS]
    names = ("section", "text", "span_start", "span_end", "lead_in")
    out = [{"idx": k, **dict(zip(names, (b.section, text, start, end, b.lead_in), strict=True))} for k, (b, text, start, end) in enumerate(rows)]
    return out, _method(reader, blob or "", bool(out))


CRITERION = "idx int, section string, text string, span_start int, span_end int, lead_in string"
_ARROW = pa.struct([("idx", pa.int32()), ("section", pa.string()), ("text", pa.string()), ("span_start", pa.int32()), ("span_end", pa.int32()), ("lead_in", pa.string())])


def segment_column(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """key, parse_method, criteria (array of structs): one row per text, nested so that nothing is shuffled."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [segment(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m for _, m in found]), pa.array([c for c, _ in found], pa.list_(_ARROW))], names=[key, "parse_method", "criteria"])

    return spread(df.select(F.col(key), F.col(text_col))).mapInArrow(run, f"`{key}` {kind}, parse_method string, criteria array<struct<{CRITERION.replace(' ', ':').replace(',:', ',')}>>")


def criteria_rows(segmented: DataFrame, key: str) -> DataFrame:
    """The child table: a row per criterion."""
    return segmented.select(key, F.inline("criteria"))


def register_udtf(spark, name: str = "segment_criteria") -> None:
    """Makes `LATERAL segment_criteria(text)` available in SQL; rows of many calls go through Arrow together."""
    from pyspark.sql.functions import udtf

    @udtf(returnType=CRITERION + ", method string", useArrow=True)
    class Segments:
        def eval(self, blob: str):
            found, method = segment(blob)
            for c in found:
                yield (*c.values(), method)

    spark.udtf.register(name, Segments)
