"""Text helpers with Unicode white-space semantics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from qassay.constants import INVALID_ANSWERS, WHITESPACE

WS_CLASS = "(?U)[\\s\\x1c-\\x1f]"
# White space that is not already one plain space.
WS_UNTIDY = "(?U)[\\s\\x1c-\\x1f&&[^ ]][\\s\\x1c-\\x1f]*| [\\s\\x1c-\\x1f]+"
WS_INLINE = "[\\t\\x0b-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it in the body, also inside the body's own lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def first_filled(*texts: Column) -> Column:
    """First argument that is neither null nor blank, stripped; else the empty string."""
    return F.coalesce(*[blank_to_null(t) for t in texts], F.lit(""))


def normalize_text(text: Column) -> Column:
    return F.regexp_replace(F.lower(strip(text)), WS_UNTIDY, " ")


def is_invalid_answer(text: Column) -> Column:
    return F.coalesce(F.lower(strip(text)), F.lit("")).isin(*INVALID_ANSWERS)


def words(text: Column) -> Column:
    """Runs of non-space characters; an empty array for blank text."""
    stripped = strip(text)
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(
        F.split(stripped, f"{WS_CLASS}+")
    )


def word_count(text: Column) -> Column:
    """Number of word tokens, letters of every script included."""
    return F.regexp_count(text, F.lit("(?U)\\b\\w+\\b"))


def ascii_tokens(text: Column) -> Column:
    """Distinct lower-case ASCII letter/digit runs."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def head(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def truncate(text: Column, limit: int) -> Column:
    """Strip, then cut to the limit with a three-dot tail."""
    t = strip(text)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(head(t, limit - 3), F.lit("...")))


def clean_markdown(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r"), F.lit("")), F.lit("\n\n\n"), F.lit("\n\n"))


def strip_code_fence(text: Column) -> Column:
    """Inside of a fenced block when the whole text is one, else the stripped text."""
    fence = "(?is)^```(?:json)?\\s*(.*?)```\\s*$"
    return bind(strip(text), lambda s: F.when(s.rlike(fence), strip(F.regexp_extract(s, fence, 1))).otherwise(s))
