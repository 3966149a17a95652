"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question stays recognisable when its parameters are
replaced. Windows of the resulting templates are hash-joined with those of the benchmark; each aligned run of shared
windows is then checked slot by slot: whatever stands for a slot must stand for it everywhere. All of it is column
expressions; only the benchmark's windows are broadcast, behind a check of their number.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import cut, documents, table

# Units of measure and money that make the word after a number a slot.
UNITS = "mm|cm|m|km|in|inch|inches|ft|foot|feet|yd|yard|yards|mi|mile|miles|mg|g|kg|oz|lb|lbs|ton|tons|pound|pounds|ml|l|liter|liters|litre|litres|gallon|gallons|s|sec|second|seconds|min|minute|minutes|h|hr|hour|hours|day|days|week|weeks|month|months|year|years|mph|kmh|usd|eur|dollar|dollars|euro|euros|cent|cents|percent|degree|degrees|watt|watts|volt|volts"
# Numbers in words.
NUMBER_WORDS = "zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion"
#: Scripts that put no spaces between words: each character, with its marks, is a word. A range goes first, as scripts are looked up slowly.
UNSPACED = r"(?=[\u0E00-\x{3FFFF}])[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]\p{M}*"
_NUMBER, _NAME, _UNIT, _START = "\x01", "\x02", "\x03", "\x04"


@dataclass(frozen=True)
class TemplateMatch:
    """window: words of a template window (a power of two); least_words: fewest words of a window that aren't slots;
    least_windows: windows in one alignment that make a leak, or all of an item that has fewer;
    broadcast_windows: most benchmark windows to broadcast (some 40 bytes each); with more, the join is a shuffle."""

    window: int = 8
    least_words: int = 5
    least_windows: int = 6
    broadcast_windows: int = 500_000


def words_of(text: Column) -> Column:
    """The words of a text in lower case; a slot's word begins with the mark of its type.

    Slots are numbers (with their points and commas, or in words), units after a number, and capitalised words. Numbers in
    words that stand in a row are one slot, and so are capitalised words in a row. Those at the start of a sentence, or
    after any other mark, have a type of their own: they count both as name and as word. Every pattern begins with what
    is rare, so that most characters fail at once.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "[\x01-\x04]", " ")
    digits = F.coalesce(text, F.lit("")).rlike("[0-9]")
    t = F.when(t.rlike(UNSPACED), F.regexp_replace(t, f"({UNSPACED})", " $1 ")).otherwise(t)
    numbered = F.regexp_replace(t, r"(\d)(?<![\p{L}\p{N}]\d)(\d*(?:[.,]\d+)*)(?![\p{L}\p{N}])", f"{_NUMBER}$1$2")
    t = F.when(digits, numbered).otherwise(t)
    t = F.regexp_replace(t, rf"([zotfsenhmbZOTFSENHMB])(?<![\p{{L}}\p{{N}}].)(?<=(?=(?i:{NUMBER_WORDS})(?![\p{{L}}\p{{N}}])).)", f"{_NUMBER}$1")
    t = F.regexp_replace(t, rf"[ -]{_NUMBER}(?<={_NUMBER}(?i:{NUMBER_WORDS}).{_NUMBER})(?=[a-zA-Z])", "")
    t = F.regexp_replace(t, rf"({_NUMBER}\S+[ -])((?i:{UNITS}))(?![\p{{L}}\p{{N}}])", f"$1{_UNIT}$2")
    t = F.regexp_replace(t, r"(\p{Lu})(?<=[\p{L}\p{N},;] .)(\p{Ll}+)(?![\p{L}\p{N}])", f"{_NAME}$1$2")
    t = F.regexp_replace(t, rf"(\p{{Lu}})(?<![\p{{L}}\p{{N}}{_NUMBER}{_NAME}{_UNIT}].)(\p{{Ll}}+)(?![\p{{L}}\p{{N}}])", f"{_START}$1$2")
    t = F.regexp_replace(t, rf" {_NAME}(?<=[{_NAME}{_START}]\p{{L}}{{1,40}} {_NAME})", "")
    t = F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # separators: ASCII but for letters, digits and marks, and points and commas inside a number
    split = F.when(digits, F.split(t, "[\\x00\\x05-\\x2B\\x2D\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+|[.,](?!(?<=\\d.)\\d+(?![\\p{L}\\p{N}]))"))
    return F.array_remove(split.otherwise(F.split(t, "[\\x00\\x05-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")), "")


def _as_word(w: Column) -> Column:
    """A sentence's first word counts as a word, other slots by their type."""
    return F.when(F.ascii(w) < 4, F.xxhash64(F.substring(w, 1, 1))).when(F.ascii(w) == 4, F.xxhash64(F.substring(w, 2, 1 << 30))).otherwise(F.xxhash64(w))


def _as_name(w: Column) -> Column:
    """A sentence's first word counts as a name."""
    return F.when(F.ascii(w) < 5, F.xxhash64(F.translate(F.substring(w, 1, 1), _START, _NAME))).otherwise(F.xxhash64(w))


def _as_value(w: Column) -> Column:
    """Slots count by their value like any word."""
    return F.xxhash64(F.translate(w, _NUMBER + _NAME + _UNIT + _START, ""))


#: Ways to read a word in a window, by the bit that stands for them.
READINGS = {1: _as_word, 2: _as_name, 4: _as_value}
OF = [f"of{k}" for k in READINGS]


def hashed(df: DataFrame, window: int, readings: dict) -> DataFrame:
    """Adds `h1`, `h2`, ... to `words`: of all windows of so many words (a power of two), one hash by each reading.

    Windows double: each step joins two neighbours of half the length. Steps are columns of their own, as an
    expression that holds another one twice would be computed twice.
    """
    for k, reading in readings.items():
        df = df.withColumn(f"h{k}", F.transform("words", reading))
        width = 1
        while width < window:
            left = F.slice(f"h{k}", 1, F.greatest(F.size(f"h{k}") - width, F.lit(0)))
            df = df.withColumn(f"h{k}", F.zip_with(left, F.slice(f"h{k}", 1 + width, F.size(f"h{k}")), lambda a, b: F.xxhash64(a, b)))
            width *= 2
    return df


def benchmark_windows(items: DataFrame, item_col: str, item_text_col: str, how: TemplateMatch) -> DataFrame:
    """hash, item, pos, width, views, of1, of2, of4 of all benchmark windows that count. Items shorter than a window have
    windows of the next smaller power of two. Windows with slots need enough plain words, and four words; items that have
    few or none of them are searched by the values of all their words, too. views has the bits of the readings with that
    hash; of1, of2 and of4 count an item's windows by reading."""
    p = items.select(F.col(item_col).alias("item"), words_of(F.col(item_text_col)).alias("words"))
    size = F.size("words")
    p = p.withColumn("width", F.when(size >= how.window, how.window).when(size >= 1, F.expr("int(power(2, floor(log2(size(words)))))")))
    widths, w = [], 1
    while w <= how.window:
        widths.append(hashed(p.where(F.col("width") == w), w, READINGS))
        w *= 2
    p = reduce(DataFrame.unionByName, widths)
    p = p.select("item", "words", "width", F.posexplode_outer(F.arrays_zip(*(f"h{k}" for k in READINGS))).alias("pos", "h"))
    part = F.slice("words", F.col("pos") + 1, F.col("width"))
    enough = {k: (F.col("width") >= 4) & (F.size(F.filter(part, lambda x, k=k: F.ascii(x) >= 3 + k)) >= F.least(F.lit(how.least_words), F.col("width"))) for k in (1, 2)}
    # what precedes an item can change its first word's slot, hence one window to spare
    p = p.withColumn("typed", F.count_if(enough[1]).over(Window.partitionBy("item")))
    enough[4] = F.col("typed") <= how.least_windows
    p = p.withColumn("one", F.explode(F.array_compact(F.array(*(F.when(enough[k], F.struct(F.lit(k).alias("view"), F.col(f"h.h{k}").alias("hash"))) for k in READINGS)))))
    p = p.groupBy("item", "pos", "width", "one.hash").agg(F.bit_or("one.view").alias("views"))
    of = [F.count_if(F.col("views").bitwiseAND(k) > 0).over(Window.partitionBy("item")).alias(f"of{k}") for k in READINGS]
    return p.select("hash", "item", "pos", "width", "views", *of)


def _value(pair: Column) -> Column:
    """A pair of slots with names of both kinds alike."""
    return F.struct(F.translate(pair["i"], _START, _NAME).alias("i"), F.translate(pair["d"], _START, _NAME).alias("d"))


def find_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text_col: str = "text", how: TemplateMatch = TemplateMatch()) -> DataFrame:
    """doc_id, item_id, n_windows, share, n_changed: one row per document and benchmark item that leaked into it.

    n_windows and share are the most windows of the item that one alignment with the document shares, n_changed the
    slots there whose values differ: 0 is a verbatim leak, more a re-parameterised one. A slot's value in the item must
    have one value throughout the alignment. A capitalised word at the start of a sentence matches as a word or as a
    name. Null and empty texts have no windows and match nothing; items with few windows are also found verbatim, by all
    their words in a row, which for an item of one word is that word anywhere. Rows with equal ids count as one document
    or item, null as an id like others. Texts of any length are searched whole; of alignments with as many windows the one with
    the fewest changed slots counts. Other columns aren't read, so their names don't matter. Without documents or items
    the result is empty.
    """
    bench = cut(benchmark_windows(items, item_col, item_text_col, how))
    # at most the powers of two up to the window, and the readings that any of their windows needs
    needed = {r.width: r.views for r in bench.groupBy("width").agg(F.bit_or("views").alias("views")).collect()}
    if not needed:
        return _empty(docs, items, id_col, item_col)
    small = bench.count() <= how.broadcast_windows
    d = docs.select(F.col(id_col).alias("doc"), words_of(F.col(text_col)).alias("words"))
    hits = None
    for w in sorted(needed):
        readings = {k: f for k, f in READINGS.items() if needed[w] & k}
        found = hashed(d, w, readings).select("doc", F.posexplode_outer(F.arrays_zip(*(f"h{k}" for k in readings))).alias("at", "h"))
        found = found.select("doc", "at", F.explode(F.array_distinct(F.array(*(F.col(f"h.h{k}") for k in readings)))).alias("hash"))
        of = bench.where(F.col("width") == w).drop("width")
        part = found.join(F.broadcast(of) if small else of, "hash").select("doc", "item", "views", *OF, "pos", (F.col("at") - F.col("pos")).alias("shift"), F.lit(w).alias("width"))
        hits = part if hits is None else hits.unionByName(part)
    # alignments with enough windows; each place of an item once, as rows of one id may repeat
    firsts = [F.first(of).alias(of) for of in OF]
    hits = hits.groupBy("doc", "item", "shift", "width", "pos").agg(F.bit_or("views").alias("views"), *firsts)
    by = [F.count_if(F.col("views").bitwiseAND(k) > 0).alias(f"n{k}") for k in READINGS]
    runs = hits.groupBy("doc", "item", "shift", "width").agg(F.count_if(F.col("views").bitwiseAND(3) > 0).alias("n"), *by, *firsts, F.min("pos").alias("low"), F.max("pos").alias("high"))
    whole = {k: (F.col(f"of{k}") > 0) & (F.col(f"n{k}") >= F.least(F.lit(how.least_windows), F.col(f"of{k}"))) for k in (1, 2)}
    verbatim = (F.col("of4") > 0) & (F.col("n4") == F.col("of4"))
    runs = runs.where((F.col("n") >= how.least_windows) | whole[1] | whole[2] | verbatim).withColumn("as_words", whole[1] | verbatim)
    # an item found by its values alone counts its windows by them
    runs = cut(runs.withColumn("n", F.when(verbatim, F.greatest("n4", "n")).otherwise(F.col("n"))).withColumn("of", F.when(verbatim, F.greatest("of4", "of1")).otherwise(F.col("of1"))))
    # slots of both sides of each alignment: few texts are read again
    wanted = runs.select("doc").distinct()
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    texts = texts.join(F.broadcast(wanted) if wanted.count() <= how.broadcast_windows else wanted, F.col("_doc").eqNullSafe(F.col("doc")), "left_semi").select(F.col("_doc").alias("doc"), words_of(F.col("_text")).alias("d_words"))
    item_words = items.select(F.col(item_col).alias("item"), words_of(F.col(item_text_col)).alias("i_words"))
    both = runs.withColumnRenamed("doc", "_d").withColumnRenamed("item", "_i")
    both = both.join(texts, F.col("_d").eqNullSafe(F.col("doc"))).join(item_words, F.col("_i").eqNullSafe(F.col("item")))
    length = F.col("high") - F.col("low") + F.col("width")
    theirs = F.slice("d_words", F.greatest(F.lit(1), F.col("low") + F.col("shift") + 1), length)
    pairs = F.filter(F.arrays_zip(F.slice("i_words", F.col("low") + 1, length).alias("i"), theirs.alias("d")), lambda x: (F.ascii(x["i"]) < 5) & (F.ascii(x["d"]) < 5))
    both = both.withColumn("pairs", F.array_distinct(pairs))
    # a sentence's first word must be consistent only where the alignment needs it to be a name
    named = F.transform(F.filter("pairs", lambda x: ~F.col("as_words") | (F.ascii(x["i"]) < 4) & (F.ascii(x["d"]) < 4)), _value)
    both = both.withColumn("slots", F.array_distinct(named)).withColumn("pairs", F.array_distinct(F.transform("pairs", _value)))
    # distinct pairs of values are a function of the item's value if no value of the item stands in two of them
    both = both.where(F.size(F.array_distinct(F.transform("slots", lambda x: x["i"]))) == F.size("slots"))
    changed = F.size(F.filter("pairs", lambda x: x["i"] != x["d"]))
    best = F.max(F.struct(F.col("n").cast("long").alias("n_windows"), (F.col("n") / F.col("of")).alias("share"), (-changed).cast("long").alias("c")))
    out = both.groupBy("doc", "item").agg(best.alias("b"))
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "b.n_windows", "b.share", (-F.col("b.c")).alias("n_changed"))


def _empty(docs: DataFrame, items: DataFrame, id_col: str, item_col: str) -> DataFrame:
    nothing = docs.select(F.col(id_col)).limit(0).crossJoin(items.select(F.col(item_col)).limit(0))
    return nothing.select("*", F.lit(0).cast("long").alias("n_windows"), F.lit(0.0).alias("share"), F.lit(0).cast("long").alias("n_changed"))


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text_col: str = "text", how: TemplateMatch = TemplateMatch()) -> DataFrame:
    """The rows of documents into which no benchmark item has leaked.

    Rows are told apart by id and text, so ids may be null or repeat; rows that repeat both go or stay together. Null and
    empty texts stay. Texts of any length are searched whole. All columns stay, whatever their names; without documents or
    items all rows do.
    """
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("at")).alias("key"), F.col(text_col).alias("text"))
    gone = cut(find_leaks(keyed, items, "text", "key", item_col, item_text_col, how).select("key.id", "key.at").distinct())
    on = docs[id_col].eqNullSafe(gone["id"]) & (F.xxhash64(docs[text_col]) == gone["at"])
    return docs.join(F.broadcast(gone) if gone.count() <= how.broadcast_windows else gone, on, "left_anti")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that leaked into it."""
    return find_leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
