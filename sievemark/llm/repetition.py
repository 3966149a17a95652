"""Quality rules on repetition: how many characters stand inside duplicated n-grams and duplicated lines.

Word and n-gram hashes roll over the bytes of a whole Arrow batch in numpy. A window of n+1 words can only be a
duplicate where the window of n words is one, so each longer n-gram looks only at what the shorter one left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textbytes import NON_SPACE, Texts, byte_class, mix64, ngram_hashes, per_row, releasing, repeated, slices, span_hashes, spans

SYMBOL = byte_class(lambda b: chr(b) in "#*$%&|<>")
NOT_NEWLINE = byte_class(lambda b: b != 0x0A)
#: The largest share of characters in duplicated n-grams, by n (from the published MassiveText rules).
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}


@dataclass(frozen=True)
class RepetitionRules:
    """A document fails the method if a share is above its limit.

    ngram_limits: share of word characters inside n-grams that stand twice or more (the first one doesn't count).
    line_limit: share of lines that equal an earlier line; line_char_limit: share of word characters in those.
    min_words, repeat_percent: the base rule on too short texts and on words in repeated 3-word windows.
    """

    ngram_limits: tuple[tuple[int, float], ...] = tuple(NGRAM_LIMITS.items())
    line_limit: float = 0.30
    line_char_limit: float = 0.20
    min_words: int = 50
    repeat_percent: int = 50


def _covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words stand in a window of n words that begins at one of `starts`."""
    edge = np.bincount(starts, minlength=words + n + 1)[: words + n + 1].astype(np.int32)
    edge[n:] -= edge[:-n].copy()
    return np.cumsum(edge)[:words] > 0


def _windows(word_hash: np.ndarray, row: np.ndarray, of: np.ndarray, n: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows that begin at `among`: those that stand twice or more in their row, and those that repeat an earlier one."""
    among = among[among + n <= of[row[among] + 1]]
    if not len(among):
        return among, among
    kind = repeated(ngram_hashes(word_hash, n)[among] + mix64(row[among].astype(np.uint64)))
    return among[kind > 0], among[kind == 2]


def measure(t: Texts, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """All columns of `repetition_rules` for the rows of a slice."""
    w = spans(t, NON_SPACE)
    n_words = np.diff(w.of)
    points = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum((t.data & 0xC0) != 0x80, out=points[1:])
    chars = points[w.end] - points[w.start]
    word_chars = per_row(chars, w.of)
    word_hash = span_hashes(t.data, w.start, w.end)
    # the lines that have a word, and which of them equal an earlier one
    lines = spans(t, NOT_NEWLINE)
    line_of = np.searchsorted(w.start, lines.start), np.searchsorted(w.start, lines.end)
    full = np.flatnonzero(line_of[1] > line_of[0])
    later = full[repeated(span_hashes(t.data, lines.start[full], lines.end[full]) + mix64(lines.row[full].astype(np.uint64))) == 2]
    n_lines = np.bincount(lines.row[full], minlength=t.rows)
    n_dup_lines = np.bincount(lines.row[later], minlength=t.rows)
    total = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(chars, out=total[1:])
    dup_line_chars = np.bincount(lines.row[later], weights=(total[line_of[1]] - total[line_of[0]])[later], minlength=t.rows)
    # words in repeated windows, then characters in duplicated n-grams, each among what the shorter n left
    twice, _ = _windows(word_hash, w.row, w.of, 3, np.arange(len(word_hash)))
    n_repeat = per_row(_covered(twice, 3, len(word_hash)).astype(np.int64), w.of)
    share = 1.0 / np.maximum(word_chars, 1)
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": per_row(SYMBOL[t.data].astype(np.int64), t.at), "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat}
    failed = (n_dup_lines > rules.line_limit * n_lines) | (dup_line_chars > rules.line_char_limit * word_chars)
    out["dup_line_char_share"] = dup_line_chars * share
    worst = np.zeros(t.rows)
    for n, limit in sorted(rules.ngram_limits):
        twice, later = _windows(word_hash, w.row, w.of, n, twice)
        inside = per_row(np.where(_covered(later, n, len(word_hash)), chars, 0), w.of)
        failed |= inside > limit * word_chars
        worst = np.maximum(worst, inside * share)
    out["dup_ngram_char_share"] = worst
    out["base_failed"] = (n_words < rules.min_words) | (100 * n_repeat > rules.repeat_percent * n_words)
    out["kept"] = ~(out["base_failed"] | failed)
    return out


_OUT = pa.schema([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("dup_line_char_share", pa.float64()), ("dup_ngram_char_share", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())])


def repetition_rules(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """One row per input row: id, counts, shares and the verdict `kept`.

    A null or empty text has no words and fails the base rule (fewer than min_words). Very long texts are measured
    whole. Ids may repeat or be null; repeated rows are judged each by itself and alike. Shares that equal a limit pass. Other
    columns aren't read, so their names don't matter. An empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slices(batch.column(1)):
                found = measure(t, rules)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, t.rows), *(pa.array(found[f.name], f.type) for f in _OUT)], names=[id_col, *_OUT.names])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_char_share double, dup_ngram_char_share double, base_failed boolean, kept boolean")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts and verdict."""
    from .tables import documents

    return repetition_rules(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_WINDOW_SQL = """
  dup{n} AS (SELECT k, i FROM (SELECT k, i, row_number() OVER (PARTITION BY k, {grams} ORDER BY i) AS nth FROM (
    SELECT k, i, {columns} FROM w WINDOW s AS (PARTITION BY k ORDER BY i)) WHERE g{last} IS NOT NULL) WHERE nth > 1),
  cov{n} AS (SELECT k, sum(len) AS c FROM (SELECT DISTINCT w.k, w.i, w.len FROM dup{n} d JOIN w ON w.k = d.k AND w.i >= d.i AND w.i < d.i + {n}) GROUP BY k)"""


def _window_sql(n: int) -> str:
    return _WINDOW_SQL.format(n=n, last=n - 1, grams=", ".join(f"g{j}" for j in range(n)), columns=", ".join(["word AS g0", *(f"lead(word, {j}) OVER s AS g{j}" for j in range(1, n))]))


OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
  w AS (SELECT k, i, ws[i] AS word, length(ws[i]) AS len FROM (SELECT k, ws, unnest(range(1, len(ws) + 1)) AS i FROM (
    SELECT k, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d))),
  counts AS (SELECT k, count(*) AS n_words, sum(len) AS word_chars FROM w GROUP BY k),
  l AS (SELECT k, i, ls[i] AS line FROM (SELECT k, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT k, string_split(text, chr(10)) AS ls FROM d))
    WHERE regexp_matches(ls[i], '[^\\x20\\x09-\\x0D]')),
  lines AS (SELECT k, count(*) AS n_lines, count(*) FILTER (nth > 1) AS n_dup_lines,
    coalesce(sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) FILTER (nth > 1), 0) AS dup_chars
    FROM (SELECT k, line, row_number() OVER (PARTITION BY k, line ORDER BY i) AS nth FROM l) GROUP BY k),
  three AS (SELECT k, i FROM (SELECT k, i, g2, count(*) OVER (PARTITION BY k, g0, g1, g2) AS times FROM (
    SELECT k, i, word AS g0, lead(word, 1) OVER s AS g1, lead(word, 2) OVER s AS g2 FROM w WINDOW s AS (PARTITION BY k ORDER BY i)) WHERE g2 IS NOT NULL) WHERE times > 1),
  repeats AS (SELECT k, count(*) AS n FROM (SELECT DISTINCT k, i + j AS i FROM three, range(3) AS r(j)) GROUP BY k),{",".join(_window_sql(n) for n in NGRAM_LIMITS)},
  m AS (SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(dup_chars, 0) AS dup_chars,
    {" OR ".join(f"coalesce(cov{n}.c, 0) > {x}::DOUBLE * coalesce(word_chars, 0)" for n, x in NGRAM_LIMITS.items())} AS dense
    FROM d LEFT JOIN counts USING (k) LEFT JOIN lines USING (k) LEFT JOIN repeats USING (k) {" ".join(f"LEFT JOIN cov{n} USING (k)" for n in NGRAM_LIMITS)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR dense OR n_dup_lines > 0.30::DOUBLE * n_lines OR dup_chars > 0.20::DOUBLE * word_chars) AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
"""
