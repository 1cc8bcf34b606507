"""Quality rules: a table of thresholds compiled into one projection of built-in expressions over each document."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qassay.functions.text import bind
from qassay.llm.line_dedup import BLANKS, split_lines


class Rule(NamedTuple):
    """A document passes if least <= numerator / denominator <= most (an absent bound passes); a ratio over nothing passes."""

    name: str
    numerator: str
    denominator: str
    least: float | None
    most: float | None


# Frequent function words of the four languages of the tables, and punctuation counted as symbols.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au avec dans de des du en et la le les par pas pour que qui sur un une "
    "auf das dem den der die ein eine er es ist mit nicht sich und von zu "
    "con del el las lo los no para por se su una y"
).split()
SYMBOLS = "#*$%&|<>"

RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.25),
    Rule("stop_word_share", "n_stop_words", "n_words", 0.04, None),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", None, 0.4),
    Rule("words_per_line", "n_words", "n_lines", 2.0, None),
)


def _repeat_words(words: Column) -> Column:
    """Words inside runs of three words that occur at least twice: equal runs meet by sorting (hash, position) pairs."""

    def covered(runs: Column) -> Column:
        again = F.filter(runs, lambda x, i: F.coalesce((F.get(runs, i - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get(runs, i + 1)["h"] == x["h"], F.lit(False)))
        at = F.sort_array(F.transform(again, lambda x: x["p"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(at, zero, lambda s, p: F.struct((s["n"] + p + 3 - F.greatest(s["end"], p)).alias("n"), (p + 3).alias("end")), lambda s: s["n"])

    inner = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    runs = F.transform(inner, lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")))
    return bind(F.sort_array(runs), covered)


def _line_counts(lines: Column) -> Column:
    filled = F.filter(lines, lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    return bind(filled, lambda own: F.struct(F.size(own).alias("filled"), (F.size(own) - F.size(F.array_distinct(own))).alias("dup")))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct _m of long counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines (with a word)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(whole, F.lit(BLANKS))
    words = F.when(F.length(bare) > 0, F.split(bare, r"[\x20\x09-\x0D]+", -1)).otherwise(F.expr("cast(array() as array<string>)"))
    from_words = bind(
        words,
        lambda w: F.struct(
            F.size(w).alias("n_words"), _repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).alias("n_stop_words"),
        ),
    )
    measured = docs.select("*", from_words.alias("_w"), _line_counts(split_lines(F.col(text))).alias("_l"))
    counts = {
        "n_words": F.col("_w.n_words"),
        "word_chars": F.length(F.translate(whole, BLANKS, "")),
        "n_symbols": F.length(whole) - F.length(F.translate(whole, SYMBOLS, "")),
        "n_dup_lines": F.col("_l.dup"),
        "n_repeat_words": F.col("_w.n_repeat_words"),
        "n_stop_words": F.col("_w.n_stop_words"),
        "n_lines": F.col("_l.filled"),
    }
    return measured.select(*docs.columns, F.struct(*(c.cast("long").alias(n) for n, c in counts.items())).alias("_m"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The rule table as one boolean expression over _m, and no user function."""
    passed = F.lit(True)
    for rule in rules:
        ratio = F.col(f"_m.{rule.numerator}") / F.nullif(F.col(f"_m.{rule.denominator}").cast("double"), F.lit(0.0))
        for bad in ([ratio < rule.least] if rule.least is not None else []) + ([ratio > rule.most] if rule.most is not None else []):
            passed = passed & ~F.coalesce(bad, F.lit(False))
    return passed


def apply_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_share: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, the counts, base_failed (fewer than min_words words, or more than max_repeat_share of them repeated) and kept.

    Null and empty texts have no words and fail the base. Rows are judged alone: ties, repeated rows and null ids change nothing, other columns are
    not looked at, and an empty table gives an empty result. Work grows with n log n of a text's words.
    """
    measured = measure(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    base = (F.col("_m.n_words") < min_words) | (F.col("_m.n_repeat_words") > max_repeat_share * F.col("_m.n_words"))
    return measured.select("doc_id", "_m.*", base.alias("base_failed"), (~base & verdict(rules)).alias("kept"))
