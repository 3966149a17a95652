"""Text functions as column expressions: normalisation, ages, grounding, chunks, content words, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Years in a unit of age.
AGE_FACTORS = {"year": 1.0, "month": 1.0 / 12, "week": 1.0 / 52.1775, "day": 1.0 / 365.25, "hour": 1.0 / (365.25 * 24), "minute": 1.0 / (365.25 * 24 * 60)}
# Words without content, for checking whether evidence bears on a criterion.
STOP_SUPPORT = """the a an of or and to in for with without any all other than more less at least most within prior previous current
currently including include such as who are is was be been have has had not no non will may must should can subject subject's
subjects patient patients study trial screening baseline visit day days week weeks month months year years old age aged during
from this that these those their there if by on per e g i e etc""".split()
# Words without content, for triage.
STOP_TRIAGE = """patient patients subject subjects study trial treatment treated therapy prior history disease diagnosis diagnosed years
year months month weeks week days male female clinical criteria criterion inclusion exclusion known evidence signs symptoms
present presents presenting receiving received current currently within must without requiring any other including include
included unable willing able informed consent participation medical condition conditions normal abnormal test tests results
level levels based with have has had""".split()
# Patterns on age, sex, negation and demographics.
AGE_PATTERNS = (
    r"(?i)\b(\d{1,3})\s*[-]?\s*(day|week|month|year)s?\s*[-]?\s*old",
    r"(?i)\b(\d{1,3})\s*(day|week|month|year)s?\s+(?:man|woman|male|female)",
    r"(?i)\b(\d{1,3})\s*[-]?\s*(?:y/o|yo)\b",
    r"\b(\d{1,3})\s*[MF]\b",
)
SEX_SHORT = r"\b\d{1,3}\s*[-]?\s*(?:y/?o|years?\s*[-]?\s*old)?\s*([MF])\b"
# A word's edge between ASCII letters, digits and underscores and all else, whatever a version of Java takes `\b` for.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
# Without regard to case, a long s is an s.
SEX_WORDS = tuple(tuple(f"(?i){EDGE}(?:{words.replace('s', '[sſ]')}){EDGE}" for words in pair) for pair in (("man|male|gentleman|boy", "woman|female|lady|girl"), ("he|his|him", "she|her|hers")))
NEGATION = r"(?i)\b(?:no\s+(?:history|evidence|signs?|prior)|denies|without|negative\s+for|ruled\s+out|not\s+(?:on|taking)|free\s+of|absence\s+of)\b"
NEGATION_LEAD = r"(?i)^\s*(?:no|not|none|without|absence of|free of)\b"
DEMOGRAPHIC_CRITERION = r"(?i)pregnan|breast.?feed|lactating|postmenopausal|menarche|vaginal bleed|endometri|uterus|women|female|male|\bmen\b|years? of age|aged?\b"
DEMOGRAPHIC_EVIDENCE = r"(?i)\b\d{1,3}[- ]?(year|month|week)s?[- ]?old\b|\b(man|woman|male|female|boy|girl)\b"
#: Longest evidence, in words, that still points at a place; longest head of a narrative that is searched for age and sex.
EVIDENCE_WORDS, HEAD_CHARS = 30, 220


def flat(c: Column) -> Column:
    """White space collapsed to single spaces; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def norm(c: Column) -> Column:
    """`flat` in lower case, empty instead of null."""
    return F.lower(F.coalesce(flat(c), F.lit("")))


def normalize_block(c: Column) -> Column:
    """Line ends unified, lines trimmed at their end and freed of the indentation they share, outer line breaks dropped.
    Lines are never joined. Null if nothing is left."""
    lines = F.transform(F.split(F.regexp_replace(c, "\r\n?", "\n"), "\n"), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    indent = F.array_min(F.transform(F.filter(lines, lambda x: F.length(x) > 0), lambda x: F.length(F.regexp_extract(x, r"(?U)^\s*", 0))))
    cut = F.transform(lines, lambda x: F.substr(x, F.coalesce(indent, F.lit(0)) + 1))
    return F.nullif(F.regexp_replace(F.array_join(cut, "\n"), r"^\n+|\n+$", ""), F.lit(""))


def age_years(raw: Column) -> Column:
    """Years of an age like `14 Months`; null where it can't be told, whatever the reason."""
    pattern = r"(?i)^\s*([\d.]+)\s*(year|month|week|day|hour|minute)s?\s*$"
    number = F.regexp_extract(raw, pattern, 1).try_cast("double")
    factors = F.create_map(*(F.lit(x) for kv in AGE_FACTORS.items() for x in kv))
    return number * F.try_element_at(factors, F.lower(F.regexp_extract(raw, pattern, 2)))


def age_raw(raw: Column) -> Column:
    return F.nullif(F.trim(raw), F.lit(""))


def grounded(quote: Column, source: Column) -> Column:
    """Whether a quote that isn't empty stands in the source, but for case and white space."""
    return (F.length(norm(quote)) > 0) & F.contains(norm(source), norm(quote))


def quoted(quote: Column, source: Column) -> Column:
    """As `grounded`, but an empty quote counts as standing in any source."""
    return F.contains(norm(source), norm(quote))


def n_words(c: Column) -> Column:
    return F.when(flat(c).isNull(), 0).otherwise(F.size(F.split(flat(c), " ")))


def localized(evidence: Column) -> Column:
    return n_words(evidence) <= EVIDENCE_WORDS


def prepare_query(c: Column, mode: str = "raw") -> Column:
    """A query text without search syntax: special characters become spaces; `nodeid` drops masked identifiers first."""
    if mode == "nodeid":
        c = F.regexp_replace(c, r"\[\*\*.*?\*\*\]", " ")
    return F.coalesce(flat(F.regexp_replace(c, r'[+\-!(){}\[\]^"~*?:\\/&|]', " ")), F.lit(""))


def tokens(c: Column) -> Column:
    """Lower-case ASCII letters and digits in runs. What separates them is what is split at: one pass without a match per word."""
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), "")


#: Items that are folded together: appending copies an array, so long arrays are folded in parts, and the parts joined.
FOLD_PART = 256


def fold(items: str, kind: str, at: str, add: str, start: str = "0") -> str:
    """SQL of a linear fold over an array that gathers rows of type `kind`.

    `at` is the state after the item `x`, `add` an array of what it adds; both see the state before it as `a.at`.
    """
    step = f"(a, x) -> named_struct('at', {at}, 'out', concat(a.out, {add}))"
    part = f"aggregate(slice(xs, CAST(c * {FOLD_PART} + 1 AS int), {FOLD_PART}), named_struct('at', o.at, 'out', CAST(array() AS array<{kind}>)), {step})"
    # the array and each part are bound to a variable, so that they are computed once
    return f"""element_at(transform(array({items}), xs -> flatten(aggregate(sequence(0, greatest(0, (size(xs) - 1) div {FOLD_PART})), named_struct('at', {start}, 'out', CAST(array() AS array<array<{kind}>>)),
      (o, c) -> element_at(transform(array({part}), i -> named_struct('at', i.at, 'out', array_append(o.out, i.out))), 1), o -> o.out))), 1)"""


def chunk_words(c: Column, size: int = 320, overlap: int = 40) -> Column:
    """Chunks of `size` words that begin every size - overlap words. A text of at most `size` words is one chunk, even
    empty; the last chunk may lie wholly in the one before it."""
    # the words are bound to a variable, so that the text is split once; white space is what \\s means in Unicode
    split = F.array_remove(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), "")
    starts = lambda ws: F.sequence(F.lit(0), F.size(ws) - 1, F.lit(size - overlap))
    chunks = lambda ws: F.when(F.size(ws) <= size, F.array(F.array_join(ws, " "))).otherwise(F.transform(starts(ws), lambda i: F.array_join(F.slice(ws, i + 1, F.lit(size)), " ")))
    return F.element_at(F.transform(F.array(split), chunks), 1)


def content_words(c: Column, triage: bool = False) -> Column:
    """Distinct words with content: four letters or digits and more, or for triage five characters and a letter first."""
    pattern, stop = (r"[a-z][a-z0-9\-]{4,}", STOP_TRIAGE) if triage else (r"[a-z0-9]{4,}", STOP_SUPPORT)
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(pattern), F.lit(0))), F.array(*map(F.lit, dict.fromkeys(stop))))


def supports(evidence: Column, quote: Column, exempt_demographic: bool = True) -> Column:
    """Whether evidence shares a content word with the quote, or settles it by stated sex or age."""
    shared = F.coalesce(F.arrays_overlap(content_words(evidence), content_words(quote)), F.lit(False))
    if not exempt_demographic:
        return shared
    demographic = F.coalesce(quote, F.lit("")).rlike(DEMOGRAPHIC_CRITERION) & F.coalesce(evidence, F.lit("")).rlike(DEMOGRAPHIC_EVIDENCE)
    return demographic | shared


def numbers(c: Column, strip_zeros: bool = False) -> Column:
    """Distinct numbers in a text, decimal commas as points. `strip_zeros` strips all zeros and points at the end, so that 10
    and 100 are 1; otherwise only zeros after a point go."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(".")))
    if strip_zeros:
        bare = lambda x: F.regexp_replace(x, r"[0.]+$", "")
        return F.array_distinct(F.transform(found, lambda x: F.when(bare(x) == "", F.lit("0")).otherwise(bare(x))))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"(\.\d*?)0+$", "$1").substr(F.lit(1), F.lit(1000))))


def said_sex(head: Column) -> Column:
    """The sex of whichever word for one comes first, of nouns if there is one, else of pronouns; null without any."""
    sex = F.lit(None).cast("string")
    for male, female in reversed(SEX_WORDS):
        m, f = F.regexp_instr(head, F.lit(male)), F.regexp_instr(head, F.lit(female))
        sex = F.when((m > 0) & ((f == 0) | (m < f)), F.lit("male")).when(f > 0, F.lit("female")).otherwise(sex)
    return sex


def gold_age_sex(text: Column) -> tuple[Column, Column, Column]:
    """Age, unit and sex that the first 220 characters state; null where they don't."""
    head = F.substring(text, 1, HEAD_CHARS)
    age = unit = F.lit(None)
    for k, p in reversed(list(enumerate(AGE_PATTERNS))):
        found = F.regexp_extract(head, p, 1)
        age = F.when(found != "", found.cast("int")).otherwise(age)
        unit = F.when(found != "", F.concat(F.lower(F.regexp_extract(head, p, 2)), F.lit("s")) if k < 2 else F.lit("years")).otherwise(unit)
    short = F.regexp_extract(head, SEX_SHORT, 1)
    return age, unit, F.when(short == "M", F.lit("male")).when(short == "F", F.lit("female")).otherwise(said_sex(head))


def short_hash(c: Column) -> Column:
    """The first 12 hex digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 12)
