"""Rubric helpers: score coercion, quality tiers, refusal classes, category rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qassay import constants as C
from qassay.functions.text import (
    bind,
    blank_to_null,
    head,
    is_invalid_answer,
    normalize_text,
    strip,
    word_count,
)


def _contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | F.contains(text, F.lit(phrase))
    return hit


def is_refusal_gold(gold: Column) -> Column:
    g = normalize_text(F.coalesce(gold, F.lit("")))
    return F.contains(g, F.lit(C.REFUSAL_SUBSTRING)) | g.isin(*C.REFUSAL_EXACT)


def refusal_class(pred: Column) -> Column:
    """How a prediction answers or declines; the first matching class wins."""
    p = strip(F.coalesce(pred, F.lit("")))
    low = F.lower(p)
    return (
        F.when(is_invalid_answer(p), "empty")
        .when(F.contains(low, F.lit(C.REFUSAL_SUBSTRING)), "canonical_refusal")
        .when(_contains_any(low, C.EXPLICIT_REFUSALS), "explicit_refusal")
        .when(_contains_any(head(low, C.SOFT_REFUSAL_PREFIX), C.SOFT_REFUSALS), "soft_refusal")
        .when(F.length(p) > C.CONTEXT_DUMP_CHARS, "context_dump")
        .otherwise("invented_answer")
    )


def is_invented(cls: Column) -> Column:
    return cls.isin(*C.INVENTED_CLASSES)


def is_refusal_like(cls: Column) -> Column:
    return cls.isin(*C.REFUSAL_CLASSES)


def is_hallucination(gold: Column, pred: Column, gold_alignment: Column) -> Column:
    """A missing alignment score counts as 0, so it reads as a hallucination."""
    low = F.coalesce(gold_alignment.cast("double"), F.lit(0.0)) <= 2
    return low | (is_refusal_gold(gold) & is_invented(refusal_class(pred)))


def is_correct_refusal(gold: Column, pred: Column, gold_alignment: Column) -> Column:
    aligned = F.coalesce(gold_alignment.cast("double"), F.lit(0.0)) >= 4
    return is_refusal_gold(gold) & is_refusal_like(refusal_class(pred)) & aligned


def quality_tier(
    answer: Column,
    grounding: Column,
    relevance: Column,
    document_necessity: Column,
    overall: Column,
    low_max: int = 2,
    high_min: int = 4,
) -> Column:
    worst = F.least(grounding, relevance, document_necessity, overall)
    return (
        F.when(is_invalid_answer(answer) | (grounding <= low_max), "drop")
        .when(worst <= low_max, "low")
        .when(worst >= high_min, "high")
        .otherwise("medium")
    )


def coerce_score(value: Column) -> Column:
    """Rubric score 1-5 from a VARIANT field.

    Numbers are truncated, text counts only when it is an integer, booleans never do.
    """

    def number(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        text = strip(F.try_variant_get(v, "$", "string"))
        return (
            F.when(v.isNull() | kind.isin("BOOLEAN", "VOID"), F.lit(None))
            .when(kind == "STRING", F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("double")))
            .otherwise(F.try_variant_get(v, "$", "double"))
            .cast("double")
        )

    def score(x: Column) -> Column:
        whole = F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("int")
        return F.when(whole.between(1, 5), whole)

    return bind(bind(value, number), score)


def rank_to_points(rank: Column, n: Column) -> Column:
    """(n + 1) - rank; a rank outside 1..n fails the job."""
    bad = F.raise_error(F.format_string("rank %s out of range 1..%s", rank.cast("string"), n.cast("string")))
    return F.when(rank.between(1, n), n + 1 - rank).otherwise(bad.cast("double"))


def gold_mode(answers: Column) -> Column:
    """Most frequent non-blank answer text; of equally frequent ones the earliest."""

    def ranked(texts: Column) -> Column:
        return F.transform(
            F.array_distinct(texts),
            lambda t: F.struct(
                (F.size(F.array_remove(texts, t)) - F.size(texts)).alias("rarity"),
                F.array_position(texts, t).alias("first"),
                t.alias("text"),
            ),
        )

    filled = F.filter(F.transform(answers, lambda a: strip(a["text"])), lambda t: t != "")
    return F.array_min(bind(filled, ranked))["text"]


def gold_reference(answers: Column, unanswerable: Column, gold: Column) -> Column:
    """One gold text for a multi-answer row; the fixed refusal when it has no answer."""
    no_answer = F.coalesce(unanswerable, F.lit(False)) | F.coalesce(F.size(answers) == 0, F.lit(False))
    return F.when(no_answer & (answers.isNotNull() | unanswerable), F.lit(C.REFUSAL_GOLD)).otherwise(
        F.coalesce(gold_mode(answers), strip(gold), F.lit(""))
    )


def heuristic_question_type(question: Column) -> Column:
    q = F.lower(strip(question))
    rules = F.when(q.rlike("(?U)^how (many|much)\\b"), "other")
    for label, forms in [
        ("what", ("what",)),
        ("who", ("who", "whom", "whose")),
        ("when", ("when",)),
        ("where", ("where",)),
        ("why", ("why",)),
        ("how", ("how",)),
        ("which", ("which",)),
        ("yes_no", C.YES_NO_HEURISTIC),
    ]:
        rules = rules.when(q.rlike(f"(?U)^({'|'.join(forms)})\\b"), label)
    return rules.otherwise("other")


def heuristic_evidence(context: Column, gold: Column) -> Column:
    g, ctx = normalize_text(gold), normalize_text(context)
    return F.when((g != "") & F.contains(ctx, g), "explicit_span").otherwise("paraphrase")


def heuristic_answer_form(gold: Column) -> Column:
    g = F.lower(strip(gold))
    n = word_count(g)
    return (
        F.when(n <= 3, "entity")
        .when(g.rlike("(?U)\\d|january|february"), "date_or_number")
        .when(n <= 12, "short_phrase")
        .otherwise("sentence")
    )


def question_starter(question: Column) -> Column:
    q = F.lower(strip(F.coalesce(question, F.lit(""))))
    first = F.regexp_extract(q, "(?U)^(\\w+)", 1)
    return (
        F.when(q == "", "empty")
        .when(first.isin(*C.WH_WORDS), first)
        .when(first.isin(*C.YES_NO_STARTERS), "yes_no")
        .otherwise("other")
    )


def answer_type(answer: Column, refuse_expected: Column) -> Column:
    a = F.coalesce(answer, F.lit(""))
    n = word_count(a)
    return (
        F.when(is_refusal_gold(a) | F.coalesce(refuse_expected, F.lit(False)), "unanswerable_refusal")
        .when(n <= 3, "short_span")
        .when(strip(a).rlike("(?U)^[\\d.,\\-%+\\s]+$"), "numeric")
        .when((n <= 12) & ~strip(a).endswith("."), "short_span")
        .when(n <= 20, "medium_span")
        .otherwise("explanatory")
    )


def document_id(document_id: Column, other_id: Column) -> Column:
    """Document id, else the part of the row id before '::', else 'unknown'."""
    return F.coalesce(
        blank_to_null(document_id), blank_to_null(F.split_part(strip(other_id), F.lit("::"), F.lit(1))), F.lit("unknown")
    )


def passage_id(tag: str, context: Column, title: Column, given: Column) -> Column:
    """Given id, else tag_[title digest_]context digest; null without a context."""
    ctx, name = blank_to_null(context), blank_to_null(title)
    slug = F.concat(head(F.sha2(name, 256), 8), F.lit("_"))
    return F.coalesce(
        blank_to_null(given),
        F.concat(F.lit(f"{tag}_"), F.coalesce(slug, F.lit("")), head(F.sha2(ctx, 256), 16)),
    )


def pick_category(value: Column, field: str) -> Column:
    """Known label for a free-text value: exact, else the longest known label it ends with, else the default."""
    allowed = sorted(C.CATEGORY_VALUES[field], key=lambda a: (-len(a), a))
    labels = F.array(*[F.lit(a) for a in allowed])

    def pick(v: Column) -> Column:
        ending = F.get(F.filter(labels, lambda a: v.endswith(a)), F.lit(0))
        return F.coalesce(F.when(F.array_contains(labels, v), v), ending, F.lit(C.CATEGORY_DEFAULTS[field]))

    return bind(F.regexp_replace(F.lower(strip(F.coalesce(value, F.lit("")))), "[ -]", "_"), pick)
