"""Text functions as column expressions: they stay in the JVM.

Python and Java disagree on white space, word boundaries and line ends beyond ASCII; the
character classes here follow Python's, stated in full.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What separates words and what ends lines, by the rules of Unicode that text was chunked with.
WHITE = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"

# The stop words of the query log and of excerpts, and the phrases with which an answer declines.
LOG_STOPWORDS = (
    "the a an and or of to in for on with from into onto over under "
    "what how why when where who which is are was were be been does do "
    "did can could should would will this that these those it its my "
    "your our their there here not no yes any all some but if then "
    "than as at by about you i we they he she them his her"
).split()
FOCUS_STOPWORDS = "about does from have what when where which with would".split()
DECLINES = (
    "do not contain", "does not contain", "don't contain", "do not answer", "does not answer",
    "cannot answer", "can't answer", "could not find", "not enough information", "without guessing",
)


def tokens(text: Column) -> Column:
    """Search terms: a blank at camel-case borders, lower case, runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, "(?<=[a-z0-9])(?=[A-Z])", " ")), F.lit("[a-z0-9]+"), F.lit(0))


def log_terms(text: Column) -> Column:
    """Terms of a logged query, repeats kept, stop words removed."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9\\-]{2,}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*LOG_STOPWORDS))


def words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def lines(text: Column) -> Column:
    """Lines without their ends; an end at the very end opens no further line."""
    parts = F.split(text, LINE_END)
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def doc_key(repo: Column, path: Column) -> Column:
    return F.concat(repo, F.lit(":"), path)


def chunk_id(repo: Column, path: Column, index: Column) -> Column:
    return F.sha1(F.concat(repo, F.lit(":"), path, F.lit(":"), index.cast("string")))


def suffix(path: Column) -> Column:
    """Lower-cased suffix of the last component with its dot; empty for none and for dot files."""
    return F.lower(F.regexp_extract(path, r"[^/]\s*(\.[^./]+)$", 1))


def iso_utc(epoch_seconds: Column) -> Column:
    """An epoch in seconds as YYYY-MM-DDTHH:MM:SSZ, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(epoch_seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def csv_list(text: Column) -> Column:
    """A comma list: trimmed, empty entries dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WHITE, " "))


def without_tags(text: Column) -> Column:
    """Tags to blanks; references are resolved and blanks squeezed by ``html.plain``."""
    return F.regexp_replace(text, "<[^>]+>", " ")


def display_excerpt(plain: Column, limit: int = 260) -> Column:
    """Of squeezed text: all of it up to ``limit`` characters, else one less and three dots."""
    return F.when(F.length(plain) <= limit, plain).otherwise(F.concat(F.rtrim(F.substring(plain, 1, limit - 1)), F.lit("...")))


def focus_terms(question: Column, domain: tuple[str, ...] = ()) -> Column:
    """Terms of a question that an excerpt may centre on: four characters or more, no stop words; words of
    the domain only if nothing else is left."""
    found = F.transform(F.regexp_extract_all(question, F.lit("[A-Za-z0-9_-]{4,}"), F.lit(0)), lambda t: F.lower(t))
    kept = F.filter(found, lambda t: ~t.isin(*FOCUS_STOPWORDS))
    if not domain:
        return kept
    special = F.filter(kept, lambda t: ~t.isin(*domain))
    return F.when(F.size(special) > 0, special).otherwise(kept)


def prompt_excerpt(plain: Column, question: Column, limit: int = 900, domain: tuple[str, ...] = ()) -> Column:
    """A window of ``limit`` characters near the longest question term that occurs, the earliest of
    those, with dots where text was left out."""
    low = F.lower(plain)
    places = F.transform(focus_terms(question, domain), lambda t: F.struct(F.length(t).alias("n"), (-F.call_function("locate", t, low)).alias("before")))
    best = F.array_max(F.filter(places, lambda p: p["before"] < 0))
    begin = F.coalesce(F.greatest(F.lit(0), -best["before"] - 1 - max(80, limit // 4)), F.lit(0))
    part = F.trim(F.substring(plain, begin + 1, F.lit(limit)))
    cut = F.concat(F.when(begin > 0, "...").otherwise(""), part, F.when(begin + limit < F.length(plain), "...").otherwise(""))
    return F.when(F.length(plain) <= limit, plain).otherwise(cut)


def declines(answer: Column) -> Column:
    low = F.lower(answer)
    out = F.lit(False)
    for phrase in DECLINES:
        out = out | low.contains(phrase)
    return out


def cosine(a: Column, b: Column) -> Column:
    """In doubles; 0 for unlike lengths and for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)
