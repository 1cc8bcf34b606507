"""Answer metrics: exact match, token F1, vector cosine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qassay.functions.text import bind, normalize_text


def normalized_tokens(text: Column) -> Column:
    return F.filter(F.split(normalize_text(text), " "), lambda t: t != "")


def exact_match(pred: Column, gold: Column) -> Column:
    return normalize_text(pred) == normalize_text(gold)


def shared_tokens(left: Column, right: Column) -> Column:
    """Size of the multiset intersection of two token arrays.

    Where one side repeats no token, it is the size of the set intersection; else both are sorted and merged in one pass."""

    def merge(p: Column, g: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            a, b = F.get(p, s["i"]), F.get(g, s["j"])
            one = F.lit(1)
            return (
                F.when(a.isNull() | b.isNull(), s)
                .when(a == b, _cursor(s["i"] + one, s["j"] + one, s["n"] + one))
                .when(a < b, _cursor(s["i"] + one, s["j"], s["n"]))
                .otherwise(_cursor(s["i"], s["j"] + one, s["n"]))
            )

        steps = F.sequence(F.lit(1), F.size(p) + F.size(g))
        return F.aggregate(steps, _cursor(F.lit(0), F.lit(0), F.lit(0)), step, lambda s: s["n"])

    def no_repeats(x: Column) -> Column:
        return F.size(F.array_distinct(x)) == F.size(x)

    def count(p: Column, g: Column, both: Column) -> Column:
        walked = bind(F.sort_array(p), lambda a: bind(F.sort_array(g), lambda b: merge(a, b)))
        return F.when(both == 0, F.lit(0)).when(no_repeats(p) | no_repeats(g), both).otherwise(walked)

    return bind(left, lambda p: bind(right, lambda g: bind(F.size(F.array_intersect(p, g)), lambda n: count(p, g, n))))


def _cursor(i: Column, j: Column, n: Column) -> Column:
    return F.struct(i.alias("i"), j.alias("j"), n.alias("n"))


def f1_from_counts(common: Column, n_pred: Column, n_gold: Column) -> Column:
    precision = common / n_pred
    recall = common / n_gold
    return (
        F.when((n_pred == 0) & (n_gold == 0), F.lit(1.0))
        .when((n_pred == 0) | (n_gold == 0) | (common == 0), F.lit(0.0))
        .otherwise(2 * precision * recall / (precision + recall))
    )


def token_f1(pred: Column, gold: Column) -> Column:
    return f1_of_tokens(normalized_tokens(pred), normalized_tokens(gold))


def f1_of_tokens(pred: Column, gold: Column) -> Column:
    return bind(
        pred,
        lambda p: bind(
            gold,
            lambda g: bind(shared_tokens(p, g), lambda n: f1_from_counts(n, F.size(p), F.size(g))),
        ),
    )


def best_exact_match(pred: Column, golds: Column) -> Column:
    """1 when the prediction equals any of the gold texts."""
    hit = bind(normalize_text(pred), lambda p: F.exists(golds, lambda g: normalize_text(g) == p))
    return F.coalesce(hit, F.lit(False)).cast("int")


def best_token_f1(pred: Column, golds: Column) -> Column:
    """Highest F1 over the gold texts, 0 without any."""
    scores = bind(
        normalized_tokens(pred), lambda p: F.transform(golds, lambda g: f1_of_tokens(p, normalized_tokens(g)))
    )
    return F.coalesce(F.array_max(scores), F.lit(0.0))


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two vectors; they need not have unit length."""
    norm = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.try_divide(dot(left, right), norm)


def gap_tier(gap: Column, low: float = 0.2, high: float = 0.6) -> Column:
    return F.when(gap < low, "low").when(gap <= high, "medium").when(gap.isNotNull(), "high")
