"""Text expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIM = " -:;,"
# Noise of scraped pages.
NOISE = [
    r"skip to (?:content|footer|main content)",
    r"share this:?|sign in|subscribe|cookie",
    r"powered by|loading chart|view more|warning!",
    r"org chart|display daily|graphicspeak|babeltechreviews",
    r"santa clara, calif\.,",
]
# Organisations of well-known hosts, in order of precedence.
ORGS = [
    ("iea.org", "IEA"),
    ("deloitte.com", "Deloitte"),
    ("mckinsey.com", "McKinsey"),
    ("sec.gov", "SEC"),
    ("techcrunch.com", "TechCrunch"),
    ("cnbc.com", "CNBC"),
    ("prnewswire.com", "PR Newswire"),
    ("marketsandmarkets.com", "MarketsandMarkets"),
    ("precedenceresearch.com", "Precedence Research"),
    ("a16z.com", "Andreessen Horowitz"),
    ("groq.com", "Groq"),
    ("enchargeai.com", "EnCharge AI"),
]
# Words and hosts that tell the kind of a reference; TRIM above: what is cut from both ends.
PAPER = ["journal", "vol.", "doi", "학회", "연구", "논문"]
REPORT = ["outlook", "report", "보고서", "white paper", "whitepaper"]
REPORT_HOSTS = ["iea.org", "deloitte.com", "mckinsey.com", "sec.gov"]
# Strata of claims by pattern.
STRATA = {
    "number": r"\d",
    "currency": r"원|억|달러|USD|KRW|\$|€",
    "unit": r"TOPS|TFLOPS|\bW\b|와트|nm|나노|배|%",
    "date": r"\d{4}년|\d{4}-\d{2}|\d+월|분기",
    "technology": r"INT8|FP16|NPU|GPU|HBM|ResNet|TOPS|TFLOPS|공정|반도체",
    "commercial_status": r"PoC|계약|양산|검증|유료|고객",
}
# Patterns of secrets, names and dates.
BEARER = r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+"
SECRET = r"\bsk-[A-Za-z0-9_-]{16,}\b"
NAMES = [(r"\b([A-Z]{3,})/[A-Za-z0-9.-]+\b", 1), (r"\b[A-Z]{3,}\b", 0), (r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b", 0)]
FULL_DATE, YEAR = r"(20\d{2}[-./]\d{2}[-./]\d{2})", r"(20\d{2})"
# Words that look like names but are none.
NOT_NAMES = ["AID", "PDF", "MIT", "TOP", "GPT", "RAG", "API", "LCEL", "SUMMARY", "REFERENCE"]


def squeeze(text: Column) -> Column:
    """White space runs (of any script) to one space, both ends trimmed."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is found once, however often ``then`` names it: each name of a plain expression is a copy of it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def compact(text: Column, limit: int) -> Column:
    return once(squeeze(text), lambda s: F.when(F.length(s) <= limit, s).otherwise(F.concat(F.rtrim(F.left(s, F.lit(limit))), F.lit("..."))))


def clean_source(text: Column) -> Column:
    s = text
    for pattern in NOISE:
        s = F.regexp_replace(s, f"(?i){pattern}", " ")
    s = F.regexp_replace(s, r"https?://\S+", " ")
    return F.btrim(squeeze(F.regexp_replace(s, "[#|]+", " ")), F.lit(TRIM))


def meaningful(text: Column, sentences: int = 2, least: int = 40, limit: int = 280) -> Column:
    """The first long sentences without noise; the whole cleaned text if there is none."""
    parts = lambda clean: F.transform(F.split(clean, r"(?<=[.!?])\s+| \.\.\. |; "), lambda x: F.btrim(x, F.lit(TRIM)))
    good = lambda clean: F.slice(F.filter(parts(clean), lambda x: (F.length(x) >= least) & ~x.rlike("(?i)" + "|".join(NOISE))), 1, sentences)
    return compact(once(clean_source(text), lambda clean: once(good(clean), lambda g: F.when(F.size(g) > 0, F.array_join(g, " ")).otherwise(clean))), limit)


def letters(text: Column, script: str) -> Column:
    """Number of letters of a script: latin or hangul."""
    keep = {"latin": "[^A-Za-z]", "hangul": "[^가-힣]"}[script]
    return F.length(F.regexp_replace(text, keep, ""))


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9_]+", "_"), F.lit("_"))


def split_reference(raw: Column) -> Column:
    """STRUCT<title, url>."""
    at = F.length(raw) - F.length(F.substring_index(raw, " - ", -1))
    tail = F.substring_index(raw, " - ", -1)
    first = F.instr(raw, "http")
    title = F.when(raw.contains(" - http"), F.btrim(F.left(raw, at - 3))).when(first > 0, F.btrim(F.left(raw, first - 1), F.lit(" -"))).otherwise(F.btrim(raw))
    url = F.when(raw.contains(" - http"), F.btrim(tail)).when(first > 0, F.btrim(F.substr(raw, first))).otherwise("")
    return F.struct(title.alias("title"), url.alias("url"))


def year(text: Column) -> Column:
    full, short = F.regexp_extract(text, FULL_DATE, 1), F.regexp_extract(text, YEAR, 1)
    return F.coalesce(F.nullif(F.translate(full, "./", "--"), F.lit("")), F.nullif(short, F.lit("")), F.lit("n.d."))


def host(url: Column) -> Column:
    """Lower-cased network location without ``www.``."""
    return F.replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("www."), F.lit(""))


def organisation(url: Column) -> Column:
    h = host(url)
    out = F.when(url == "", "출처 미상")
    for tail, name in ORGS:
        out = out.when(h.endswith(tail), name)
    return out.otherwise(title_case(F.replace(F.substring_index(h, ".", 1), F.lit("-"), F.lit(" "))))


def title_case(text: Column) -> Column:
    """Each run of letters with a capital first, whatever stands before it."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def reference_kind(title: Column, url: Column) -> Column:
    has = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(c), w))
    return F.when(has(title, PAPER), "학술 논문").when(has(title, REPORT) | has(url, REPORT_HOSTS), "기관 보고서").otherwise("웹페이지")


def format_reference(raw: Column) -> Column:
    ref = split_reference(raw)
    org = organisation(ref["url"])
    return F.btrim(F.concat(F.lit("- "), org, F.lit("("), year(F.concat_ws(" ", ref["title"], ref["url"])), F.lit("). "), ref["title"], F.lit(". "), org, F.lit(". "), ref["url"]))


def strata(text: Column) -> Column:
    """The strata whose pattern the text has, else ``other``."""
    named = F.array(*[F.when(text.rlike(f"(?i){p}"), name) for name, p in STRATA.items()])
    found = F.array_compact(named)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other")))


def markers(text: Column) -> Column:
    """Citation markers in order: [SOURCE:x], [n] and URLs."""
    return F.regexp_extract_all(text, F.lit(r"(\[SOURCE:[^\]]+\]|\[\d+\]|https?://[^\s)\]]+)"), F.lit(1))


def footnotes(text: Column) -> Column:
    """Map from number to URL of ``[n]: url`` lines; the last of a number wins."""
    pattern = F.lit(r"(?m)^\[(\d+)\]:\s*(\S+)")
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("n"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("u"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["n"] == p["n"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["n"], p["u"])))


def redact(text: Column, values: tuple[str, ...] = ()) -> Column:
    """Secrets by pattern, and the given values, replaced."""
    out = F.regexp_replace(F.regexp_replace(text, BEARER, "Bearer [REDACTED]"), SECRET, "[REDACTED]")
    for v in values:
        out = F.replace(out, F.lit(v), F.lit("[REDACTED]"))
    return out


def names(text: Column, most: int = 10) -> Column:
    """Candidate names: before a slash, all capitals, camel case; in this order, each once."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in NAMES])
    return F.slice(F.array_distinct(F.filter(found, lambda x: ~x.isin(NOT_NAMES))), 1, most)


def numbers_kept(quote: Column, statement: Column) -> Column:
    """Every number of each text stands in the other."""
    of = lambda c: F.regexp_extract_all(c, F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0))
    return F.forall(of(quote), lambda n: F.contains(statement, n)) & F.forall(of(statement), lambda n: F.contains(quote, n))


def quoted_at(text: Column, start: Column, end: Column, quote: Column) -> Column:
    return F.substr(text, start + 1, end - start).eqNullSafe(quote)


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normal_statement(text: Column) -> Column:
    """NFKC, squeezed, without full stops at the end.  ASCII skips the UDF's work."""
    return F.rtrim(squeeze(nfkc(text)), F.lit(".。"))


# Words of a heading that name a section, in order.
SECTIONS = [
    ("technology assessment", "technology"), ("technical assessment", "technology"), ("기술", "technology"), ("market overview", "market"), ("market position", "market"), ("market drivers", "market"), ("시장", "market"),
    ("business", "business"), ("비즈니스", "business"), ("사업", "business"), ("executive overview", "business"), ("traction", "traction"), ("트랙션", "traction"), ("team", "team"), ("팀", "team"),
    ("competition", "competition"), ("경쟁", "competition"), ("risk assessment", "risk"), ("리스크", "risk"), ("investment recommendation", "ranking"), ("dd-worthiness decision", "ranking"), ("추천", "ranking"),
    ("scorecard evaluation", "ranking"), ("candidate comparison", "ranking"),
]
# Headings of source lists.
REFERENCE_HEADINGS = ("reference", "references", "출처", "참고문헌")


def section_of(heading: Column) -> Column:
    """The section that a heading names first, or null."""
    low = F.lower(heading)
    out = F
    for word, name in SECTIONS:
        out = out.when(F.contains(low, F.lit(word)), name)
    return out
