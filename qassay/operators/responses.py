"""Model responses to rows: tolerant JSON parsing with VARIANT and regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qassay.constants import CATEGORY_VALUES, EVAL_DIMENSIONS, JUDGE_DIMENSIONS
from qassay.functions.judging import coerce_score, pick_category, quality_tier, rank_to_points
from qassay.functions.text import bind, head, strip, strip_code_fence

_STRING = '"([^"\\\\]*+(?:\\\\.[^"\\\\]*+)*+)"'
PAIR_PATTERN = f'\\{{[^{{}}]*"question"\\s*:\\s*{_STRING}\\s*,\\s*"answer"\\s*:\\s*{_STRING}\\s*\\}}'
ONE_PAIR_PATTERN = '(?s)\\{[^{}]*"question"[^{}]*"answer"[^{}]*\\}'


def parse_json(text: Column) -> Column:
    """VARIANT of a text that is one JSON value and nothing else; null otherwise.

    The JSON reader ignores whatever follows the first value, so the text is read inside a list and
    inside an object: text after the value, or a bracket too many, spoils at least one of them.
    """

    def whole(x: Column) -> Column:
        listed = F.try_parse_json(F.concat(F.lit("["), x, F.lit("]")))
        held = F.try_parse_json(F.concat(F.lit('{"v":'), x, F.lit("}")))
        return F.when(listed.isNotNull(), F.try_variant_get(held, "$.v", "variant"))

    return bind(strip(text), whole)


def has_field(v: Column, key: str) -> Column:
    """Whether the field exists; a JSON null counts."""
    return F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")).isNotNull()


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _object_with(text: Column, key: str) -> Column:
    """JSON object that has the key: the whole (fenced) text; only if that is not JSON, the widest {...} around the quoted key."""

    def piece(s: Column) -> Column:
        inner = parse_json(F.nullif(F.regexp_extract(s, f'(?s)\\{{.*"{key}".*\\}}', 0), F.lit("")))
        return bind(inner, lambda v: F.when(is_object(v), v))

    def find(s: Column) -> Column:
        return bind(parse_json(s), lambda v: F.when(v.isNotNull(), F.when(is_object(v) & has_field(v, key), v)).otherwise(piece(s)))

    return bind(strip_code_fence(text), find)


def _text_field(v: Column, key: str) -> Column:
    return strip(F.coalesce(F.try_variant_get(v, f"$.{key}", "string"), F.lit("")))


def qa_pairs(raw: Column, expected: Column) -> Column:
    """Question/answer structs in a response: an object, {"pairs": [...]}, a list, or pieces of text."""
    empty = F.array().cast("array<struct<question:string,answer:string>>")

    def items(v: Column) -> Column:
        single = F.when(has_field(v, "question") & has_field(v, "answer"), F.array(v))
        in_object = F.coalesce(F.try_variant_get(v, "$.pairs", "array<variant>"), single)
        return F.when(is_object(v), in_object).otherwise(F.try_variant_get(v, "$", "array<variant>"))

    def from_text(s: Column) -> Column:
        one = parse_json(F.nullif(F.regexp_extract(s, ONE_PAIR_PATTERN, 0), F.lit("")))
        pieces = F.transform(
            F.regexp_extract_all(s, F.lit(f"(?s){PAIR_PATTERN}"), F.lit(0)), lambda p: _pair(F.try_parse_json(p))
        )
        return bind(one, lambda v: F.when(v.isNotNull(), F.array(_pair(v))).otherwise(pieces))

    def found(s: Column) -> Column:
        return bind(
            parse_json(s),
            lambda v: F.when(v.isNotNull(), F.coalesce(F.transform(items(v), _pair), empty)).otherwise(from_text(s)),
        )

    kept = F.filter(bind(strip_code_fence(raw), found), lambda p: (p["question"] != "") & (p["answer"] != ""))
    return bind(
        kept,
        lambda k: F.when(F.coalesce(expected, F.lit(0)) > 0, F.slice(k, F.lit(1), F.greatest(expected, F.lit(1)))).otherwise(k),
    )


def _pair(v: Column) -> Column:
    return F.struct(_text_field(v, "question").alias("question"), _text_field(v, "answer").alias("answer"))


def parse_qa_pairs(rows: DataFrame, key: str = "section_id", raw: str = "raw") -> DataFrame:
    """One row per parsed pair with its id."""
    return rows.select(
        key, F.posexplode(qa_pairs(F.col(raw), F.col("expected"))).alias("synthetic_pair_index", "_p")
    ).select(
        key,
        "synthetic_pair_index",
        F.format_string("%s::syn_%02d", F.col(key), F.col("synthetic_pair_index")).alias("chunk_id"),
        "_p.question",
        "_p.answer",
    )


def generation_outcomes(rows: DataFrame, key: str = "section_id", raw: str = "raw") -> DataFrame:
    """Log row per request: status, pairs parsed, preview of failed responses."""

    def without_text(v: Column) -> Column:
        return v.isNotNull() & ((_text_field(v, "question") == "") | (_text_field(v, "answer") == ""))

    n = F.col("n_pairs_parsed")
    status = (
        F.when(n >= F.col("expected_pairs"), "ok")
        .when(n > 0, "partial_pairs")
        .when((F.col("expected_pairs") == 1) & bind(_object_with(F.col(raw), "question"), without_text), "empty_qa")
        .otherwise("parse_error")
    )
    return (
        rows.select(key, raw, F.col("expected").alias("expected_pairs"), F.size(qa_pairs(F.col(raw), F.col("expected"))).alias("n_pairs_parsed"))
        .withColumn("status", status)
        .withColumn("raw_preview", F.when(F.col("status").isin("empty_qa", "parse_error"), head(F.col(raw), 500)))
        .drop(raw)
    )


def parse_judge(rows: DataFrame, raw: str = "raw", answer: str = "answer", gold: str | None = None) -> DataFrame:
    """Add llm_judge: coerced scores, tier and capped texts, or an error with a preview.

    The block is one expression, so a filter on one of its fields does not repeat the parsing of others.
    """
    preview = head(F.coalesce(raw, F.lit("")), 400)
    reference = head(F.col(gold), 500) if gold else F.lit(None).cast("string")

    def block(v: Column, scores: Column) -> Column:
        ok = v.isNotNull()
        for d in JUDGE_DIMENSIONS:
            ok = ok & scores[d].isNotNull()
        tier = quality_tier(F.col(answer), *[scores[d] for d in JUDGE_DIMENSIONS])
        reason = head(F.coalesce(F.try_variant_get(v, "$.brief_reason", "string"), F.lit("")), 500)
        return F.struct(
            *[F.when(ok, scores[d]).cast("double").alias(d) for d in EVAL_DIMENSIONS],
            F.when(ok, _truthy(F.try_variant_get(v, "$.refuse_expected", "variant"))).alias("refuse_expected"),
            F.when(ok, reason).alias("brief_reason"),
            F.when(ok, tier).alias("quality_tier"),
            F.when(ok, reference).alias("gold_reference"),
            F.when(~ok, "parse_error").alias("error"),
            F.when(~ok, preview).alias("raw_preview"),
        )

    def scored(v: Column) -> Column:
        scores = F.struct(*[coerce_score(F.try_variant_get(v, f"$.{d}", "variant")).alias(d) for d in EVAL_DIMENSIONS])
        return bind(scores, lambda s: block(v, s))

    return rows.withColumn("llm_judge", bind(_object_with(F.col(raw), "overall"), scored))


def _truthy(value: Column) -> Column:
    def test(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        return (
            F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
            .when(kind == "STRING", F.try_variant_get(v, "$", "string") != "")
            .when(kind.isNull() | (kind == "VOID"), F.lit(False))
            .otherwise(F.coalesce(F.try_variant_get(v, "$", "double") != 0, F.lit(True)))
        )

    return bind(value, test)


def parse_listwise(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Rows with label_to_condition and a raw response; a ranking must use every label exactly once."""
    labels = F.map_keys("label_to_condition")
    n = F.size(labels)
    listed = bind(_object_with(F.col(raw), "ranking"), lambda v: F.try_variant_get(v, "$.ranking", "array<string>"))
    full = bind(
        F.transform(listed, strip), lambda r: F.when(F.array_sort(r) == F.array_sort(labels), r)
    )
    order = F.col("ranking_labels")

    def per_condition(value) -> Column:
        conditions = F.transform(order, lambda lab: F.try_element_at("label_to_condition", lab))
        return F.map_from_arrays(conditions, F.transform(order, lambda lab, i: value(i + 1).cast("double")))

    return (
        rows.withColumn("n_candidates", n)
        .withColumn("ranking_labels", full)
        .withColumn("error", F.when(order.isNull(), "parse_error"))
        .withColumn("ranks_by_condition", per_condition(lambda rank: rank))
        .withColumn("points_by_condition", per_condition(lambda rank: rank_to_points(rank, n)))
    )


def parse_classes(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Add categories: known labels with defaults, null when the response cannot be read."""
    markers = ("answer_evidence", "finetuning_expected_gain", "question_type")

    def piece(s: Column) -> Column:
        pattern = '(?s)\\{.*?"(?:answer_evidence|finetuning_expected_gain)".*?\\}'
        return bind(parse_json(F.nullif(F.regexp_extract(s, pattern, 0), F.lit(""))), lambda v: F.when(is_object(v), v))

    def find(s: Column) -> Column:
        def choose(v: Column) -> Column:
            marked = F.lit(False)
            for key in markers:
                marked = marked | has_field(v, key)
            return F.when(is_object(v) & marked, v).otherwise(piece(s))

        return bind(parse_json(s), choose)

    def labels(v: Column) -> Column:
        fields = [pick_category(F.try_variant_get(v, f"$.{f}", "string"), f).alias(f) for f in CATEGORY_VALUES]
        return F.when(v.isNotNull(), F.struct(*fields))

    return rows.withColumn("categories", bind(bind(strip_code_fence(F.col(raw)), find), labels)).withColumn(
        "classifier_error", F.when(F.col("categories").isNull(), "parse_error")
    )
