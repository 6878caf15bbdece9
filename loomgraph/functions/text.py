"""Text functions as Column expressions: they run in the JVM (those with lambdas outside of whole-stage code)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+(?:(?<=\p{L})[.':](?=\p{L})[\p{L}\p{N}_]+|(?<=\p{N})[.,;'](?=\p{N})[\p{L}\p{N}_]+)*"
BRANCHES = r"\b(if|for|while|repeat|tryCatch|switch)\b"


def tokenize(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9 of at least two characters; null is no token."""
    return F.coalesce(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: F.length(x) >= 2), F.array().cast("array<string>"))


def node_text(signature: Column, body: Column, doc: Column) -> Column:
    """The parts that aren't blank, joined by a blank."""

    def part(c: Column) -> Column:
        return F.when(F.length(F.regexp_replace(c, r"\s+", "")) > 0, c)

    return F.concat_ws(" ", part(signature), part(body), part(doc))


def token_count(text: Column) -> Column:
    """ceil(1.3 * words); 0 for empty or null."""
    return F.coalesce(F.ceil(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))) * 1.3), F.lit(0)).cast("long")


def header_tokens(text: Column) -> Column:
    """ceil(characters / 3.5)."""
    return F.coalesce(F.ceil(F.length(text) / 3.5), F.lit(0)).cast("long")


def complexity(body: Column) -> Column:
    """1 plus the number of branching keywords, in comments and strings too."""
    return F.lit(1) + F.coalesce(F.size(F.regexp_extract_all(body, F.lit(BRANCHES), F.lit(1))), F.lit(0))


def one_liner(doc: Column) -> Column:
    """The first line of a doc block that has text and no tag, without its comment mark; else empty."""
    lines = F.transform(F.split(doc, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"^#'\s?", ""), r"^\s+|\s+$", ""))
    good = F.filter(lines, lambda x: (x != "") & ~x.startswith("@"))
    return F.coalesce(F.get(good, F.lit(0)), F.lit(""))


def truncate(text: Column, budget: int) -> Column:
    """The first ceil(3.5 * budget) characters, cut after their last line break if they have one."""
    cut = F.substring(text, 1, -(-7 * budget // 2))
    whole = F.regexp_extract(cut, r"^([\s\S]*\n)", 1)
    return F.when(whole != "", whole).otherwise(cut)


def search_score(query: str, *parts: Column) -> Column:
    """Matches of any term of the query in the lower-case parts."""
    import re

    terms = [t for t in re.split(r"[^a-z0-9]+", query.lower()) if t]
    if not terms:
        return F.lit(0)
    hay = F.lower(F.concat_ws(" ", *parts))
    return F.coalesce(F.size(F.regexp_extract_all(hay, F.lit("|".join(terms)), F.lit(0))), F.lit(0))


def captures2(text: Column, pattern: str) -> Column:
    """An array of (first, second) of all matches in which both groups have text."""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("first"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("second"))
    return F.filter(both, lambda x: (x["first"] != "") & (x["second"] != ""))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; arrays of different lengths are an error."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    value = F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot / (norm(a) * norm(b)))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different lengths")).cast("double")).otherwise(value)
