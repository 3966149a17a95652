"""URL filters: fixed rules first, then naive Bayes over the words that host and path are made of.

Concatenated names are split by a unigram Viterbi search. What is known of words comes from the table itself: names
that owners have delimited themselves (`cheap-pills`), counted over all rows, beside a short seed list. A multinomial
naive Bayes learns from a bounded sample of urls, which are unwanted if the words on their pages or their own words say
so: a page full of seed words teaches the words of its url, seeds or not.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import cut, table

# Words of unwanted sites. Two points make a url an example of them.
STRONG = "casino poker slots betting bets lottery porn xxx viagra cialis pills replica spam clickbait warez torrent adserver doubleclick payday phishing malware jackpot escorts".split()
WEAK = "ads ad track tracking tracker banner popup popunder cheap free bonus winner prize dating crypto loan loans credit deals farm pharma pharmacy sex adult cam hack crack affiliate promo bet click".split()
COMMON = "the and for with shop store blog news home online web site page book music game games video photo city food health sport travel world tech best top new my go get your all one live life book school house car data cloud mail app dev wiki forum search help info media center group club free".split()


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))


@dataclass(frozen=True)
class UrlFilter:
    """least_share: of all delimited words, from which on the segmentation knows a word, so it knows 1 / least_share of them at most;
    sample: urls to learn from, about; smoothing: of the Bayes counts; least_odds: log odds from which a url is blocked;
    page_words, page_share: unwanted words on a page, and their share of its words, that make its url an example."""

    least_share: float = 5e-6
    sample: int = 20_000
    smoothing: float = 0.5
    least_odds: float = 1.0
    page_words: int = 3
    page_share: float = 0.02


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case): after the first `://` up to `/`, `?`, `#` or the end; path: from there up to `?` or `#`.
    Both are empty for null and without `://`."""
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits host (or a parent of it) and path; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block")):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


class Segmenter:
    """Unigram Viterbi: the split of a name into words that has the largest product of word frequencies.

    An unknown word costs as much as the rarest known one, and more with each letter, so splits into known words win. The
    search is linear in the name: known words are tried by the lengths that occur, unknown ones grow letter by letter.
    """

    letter = 2.5

    def __init__(self, counts: dict[str, int]):
        self.total = sum(counts.values()) + 1
        self.cost = {w: -math.log(n / self.total) for w, n in counts.items()}
        self.lengths = sorted({len(w) for w in counts})
        self.known: dict[str, tuple[str, ...]] = {}

    def split(self, name: str) -> tuple[str, ...]:
        if name in self.known:
            return self.known[name]
        # best cost of each prefix and where its last word begins; the same for prefixes that end in an unknown word
        best, back, rare, begun = [0.0], [0], [math.inf], [0]
        for end in range(1, len(name) + 1):
            fresh, longer = best[-1] + math.log(self.total) + self.letter, rare[-1] + self.letter
            rare.append(min(fresh, longer))
            begun.append(end - 1 if fresh <= longer else begun[-1])
            low, start = rare[-1], begun[-1]
            for n in self.lengths:
                if n > end:
                    break
                cost = self.cost.get(name[end - n : end])
                if cost is not None and best[end - n] + cost <= low:
                    low, start = best[end - n] + cost, end - n
            best.append(low)
            back.append(start)
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        if len(self.known) > 100_000:
            self.known.clear()
        if len(name) <= 256:  # longer ones hardly come again
            self.known[name] = tuple(reversed(words))
        return tuple(reversed(words))

    def tokens(self, host: str, path: str) -> list[str]:
        """Words of the host's labels but the last, and of the path; digits count as one word."""
        labels = host.split(":")[0].split(".")
        pieces = re.findall(r"[a-z]+|[0-9]+|[^\x00-\x7f]+", " ".join(labels[:-1] if len(labels) > 1 else labels))
        pieces += re.findall(r"[a-z]+|[0-9]+|[^\x00-\x7f]+", path.lower())
        return [w for p in pieces for w in (self.split(p) if p.isalpha() else ("0",))]


class NaiveBayes:
    """Multinomial, of two classes; learned from (tokens, class) pairs and the seeds."""

    def __init__(self, smoothing: float):
        self.smoothing, self.counts, self.sums, self.rows = smoothing, ({}, {}), [0.0, 0.0], [1.0, 1.0]
        for words, k, n in ((STRONG, 1, 20.0), (WEAK, 1, 8.0), (COMMON, 0, 8.0)):
            for w in words:
                self._add(w, k, n)

    def _add(self, word: str, k: int, n: float) -> None:
        self.counts[k][word] = self.counts[k].get(word, 0.0) + n
        self.sums[k] += n

    def learn(self, tokens: list[str], unwanted: bool) -> None:
        self.rows[unwanted] += 1
        for w in tokens:
            self._add(w, int(unwanted), 1.0)

    def odds(self, tokens: list[str]) -> float:
        """Log odds of unwanted. A word that was never met says nothing."""
        kinds = len(self.counts[0].keys() | self.counts[1].keys()) if not hasattr(self, "_kinds") else self._kinds
        self._kinds = kinds
        z = math.log(self.rows[1] / self.rows[0])
        for w in tokens:
            a, b = self.counts[1].get(w, 0.0), self.counts[0].get(w, 0.0)
            if a or b:
                z += math.log((a + self.smoothing) / (self.sums[1] + self.smoothing * kinds)) - math.log((b + self.smoothing) / (self.sums[0] + self.smoothing * kinds))
        return z


def seeded(tokens: list[str]) -> bool:
    return sum(2 * (w in STRONG) + (w in WEAK) for w in set(tokens)) >= 2


def unwanted_page(page: Column, how: UrlFilter) -> Column:
    """Whether a page's own words, markup left out, say that it is unwanted; a null page says nothing."""
    bare = F.regexp_replace(F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    words = F.filter(F.split(F.lower(bare), "[^a-z]+"), lambda w: w != "")
    n = F.size(F.filter(words, lambda w: w.isin(*STRONG)))
    return F.coalesce((n >= how.page_words) & (n >= F.size(words) * how.page_share), F.lit(False))


def train(hosts: DataFrame, how: UrlFilter) -> tuple[Segmenter, NaiveBayes]:
    """hosts: host, path and page of every row. Word counts are of all different urls, and so is the total that they are shares of;
    what stands in a single url may be no word at all."""
    delimited = F.filter(F.split("host", r"\."), lambda x: F.contains(x, F.lit("-")))
    words = hosts.select("host", "path").distinct().select(F.explode_outer(F.flatten(F.array(F.flatten(F.transform(delimited, lambda x: F.split(x, "[^a-z]+"))), F.split(F.lower("path"), "[^a-z]+")))).alias("w")).where("length(w) >= 2")
    counted = cut(words.groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    total = counted.agg(F.sum("n").alias("n")).first().n or 0
    counts = dict.fromkeys([*STRONG, *WEAK, *COMMON], 3)
    # at most 1 / least_share words have such a share
    for w, n in counted.where((F.col("n") >= 2) & (F.col("n") >= total * how.least_share)).collect():
        counts[w] = counts.get(w, 0) + n
    cutter, bayes = Segmenter(counts), NaiveBayes(how.smoothing)
    n = hosts.count()
    chosen = F.pmod(F.xxhash64("host", "path"), F.lit(1 << 30)) < F.lit(min(1.0, how.sample / max(n, 1)) * (1 << 30))
    sample = hosts.where(chosen).select("host", "path", unwanted_page(F.col("page"), how).alias("bad")).groupBy("host", "path").agg(F.max("bad").alias("bad"))
    for host, path, bad in sorted(tuple(r) for r in sample.collect()):
        tokens = cutter.tokens(host, path)
        bayes.learn(tokens, bad or seeded(tokens))
    return cutter, bayes


def filter_urls(pages: DataFrame, url_col: str = "url", id_col: str = "page_id", page_col: str | None = None, rules: tuple[Rule, ...] = RULES, how: UrlFilter = UrlFilter()) -> DataFrame:
    """page_id, host, path, rule, verdict, odds: one row per input row.

    verdict is the rule's, or else block if the log odds of the words are at least least_odds. What words mean is learned
    from urls with seed words and, with page_col, from urls whose pages say it. A null url, or one without `://`, has no
    host, no words, and is allowed. Urls of any length are split whole; of splits that cost the same, the one with the
    longer last word is taken, and of rules of one length block. Ids may repeat or be null, and repeated rows are judged
    alike. Other columns aren't read, so their names don't matter. An empty table gives an empty result.
    """
    id_type = pages.schema[id_col].dataType.simpleString()
    host, path = host_and_path(F.col(url_col))
    p = pages.select(F.col(id_col).alias("id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), (F.lit(None) if page_col is None else F.col(page_col)).cast("string").alias("page"))
    cutter, bayes = train(p, how)
    model = pages.sparkSession.sparkContext.broadcast((cutter, bayes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, bayes = model.value
        for batch in batches:
            odds = [bayes.odds(cutter.tokens(h, q)) if h else -math.inf for h, q in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odds, pa.float64())], names=["id", "host", "path", "odds"])

    p = p.drop("page").mapInArrow(run, f"id {id_type}, host string, path string, odds double")
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("odds") >= how.least_odds, F.lit("block")).otherwise(F.lit("allow"))
    return p.select(F.col("id").alias(id_col), "host", "path", name.alias("rule"), F.coalesce(verdict, judged).alias("verdict"), "odds")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return filter_urls(table(spark, sf_dir, "pages"), page_col="html").drop("odds")
