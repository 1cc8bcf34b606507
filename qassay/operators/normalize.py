"""Raw dataset rows to the common question/answer layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qassay.functions.judging import passage_id
from qassay.functions.text import blank_to_null, clean_markdown, first_filled, strip


def _text(name: str):
    return strip(F.coalesce(F.col(name), F.lit("")))


def normalize_single_answer(rows: DataFrame, tag: str, drop_unanswerable: bool = False) -> DataFrame:
    """``tag`` names the corpus; the row's own split follows it in source."""
    out = rows.select(
        _text("document_extracted").alias("context"),
        _text("question").alias("question"),
        _text("answer").alias("answer"),
        F.concat(F.lit(f"{tag}/"), "split").alias("source"),
        F.coalesce(F.nullif("question_id", F.lit("")), F.col("document_id"), F.lit("")).alias("chunk_id"),
        F.coalesce("document_id", F.lit("")).alias("document_id"),
        "document_topic",
        "long_answer",
        "split",
    ).filter((F.col("context") != "") & (F.col("question") != ""))
    return out.filter(F.upper("answer") != "UNANSWERABLE") if drop_unanswerable else out


def _span_answers(texts):
    """Non-blank texts as {text, type} structs of type span."""
    kept = F.filter(F.transform(texts, lambda t: strip(t)), lambda t: t != "")
    return F.transform(kept, lambda t: F.struct(t.alias("text"), F.lit("span").alias("type")))


def normalize_multi_answer(rows: DataFrame, tag: str, require_answer: bool = False) -> DataFrame:
    """Rows without answers are kept as unanswerable, or dropped when an answer is required."""
    out = (
        rows.filter(F.col("answers.text").isNotNull())
        .select(
            _text("id").alias("eval_id"),
            _text("title").alias("title"),
            _text("context").alias("context"),
            _text("question").alias("question"),
            _span_answers(F.col("answers.text")).alias("answers"),
            F.concat(F.lit(f"{tag}/"), "split").alias("source"),
            "split",
        )
        .filter((F.col("context") != "") & (F.col("question") != "") & (F.col("eval_id") != ""))
        .withColumn("section_id", passage_id(tag, F.col("context"), F.col("title"), F.lit(None).cast("string")))
    )
    if require_answer:
        return out.filter(F.size("answers") > 0)
    return out.withColumn("unanswerable", F.size("answers") == 0)


def normalize_typed_spans(rows: DataFrame, tag: str) -> DataFrame:
    """Spans zipped with their types (span where a type is missing); rows without a span are dropped."""
    spans, types = F.col("answers_spans.spans"), F.col("answers_spans.types")
    pairs = F.transform(
        spans,
        lambda s, i: F.struct(
            strip(s).alias("text"),
            F.coalesce(blank_to_null(F.get(types, i)), F.lit("span")).alias("type"),
        ),
    )
    return (
        rows.select(
            _text("query_id").alias("eval_id"),
            _text("section_id").alias("section_id"),
            _text("passage").alias("context"),
            _text("question").alias("question"),
            F.filter(pairs, lambda p: p["text"] != "").alias("answers"),
            F.concat(F.lit(f"{tag}/"), "split").alias("source"),
            "split",
        )
        .filter((F.col("context") != "") & (F.col("question") != "") & (F.col("eval_id") != ""))
        .filter(F.size("answers") > 0)
    )


def answer_type_counts(rows: DataFrame) -> DataFrame:
    types = F.array_distinct(F.col("answers.type"))
    kind = F.when(F.size(types) > 1, "mixed").otherwise(F.get(types, 0))
    return rows.groupBy(kind.alias("answer_type")).agg(F.count(F.lit(1)).alias("n_rows"))


def eval_record(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.coalesce(blank_to_null(F.col("chunk_id")), F.concat("document_id", F.lit("-q"))).alias("eval_id"),
        "document_id",
        _text("question").alias("question"),
        _text("answer").alias("gold"),
        _text("context").alias("context"),
        "document_topic",
        "source",
    )


def resolve_fields(rows: DataFrame) -> DataFrame:
    """Row key, prediction and gold by precedence of their alternative names."""
    return rows.select(
        first_filled(F.col("eval_id"), F.col("chunk_id")).alias("row_key"),
        first_filled(F.col("pred"), F.col("prediction")).alias("pred"),
        first_filled(F.col("gold"), F.col("answer")).alias("gold"),
        first_filled(F.col("pred"), F.col("prediction"), F.col("answer")).alias("judged_text"),
    )


def gold_texts(rows: DataFrame, answers: str = "answers", golds: str = "golds") -> DataFrame:
    """Adds the accepted answers of a row: the stripped texts of ``answers`` (texts, or structs with a text) that are not blank; without any, the
    gold, or the answer where the gold is missing or empty. A row without either has an empty list."""
    kind = rows.schema[answers].dataType.elementType
    listed = F.transform(F.coalesce(answers, F.array().cast(rows.schema[answers].dataType)), lambda a: strip(a["text"] if isinstance(kind, T.StructType) else a))
    single = strip(F.coalesce(F.nullif("gold", F.lit("")), F.col("answer"), F.lit("")))
    filled = F.filter(listed, lambda a: a != "")
    return rows.withColumn(golds, F.when(F.size(filled) > 0, filled).when(single != "", F.array(single)).otherwise(F.array().cast("array<string>")))


def excerpts(chunks: DataFrame, min_chars: int = 40) -> DataFrame:
    """Title (unless INTRO), text and image notes joined by blank lines; too short ones dropped."""
    title = F.nullif(_text("title"), F.lit("INTRO"))
    parts = [blank_to_null(title), blank_to_null(F.col("text"))]
    if "image_descriptions" in chunks.columns:
        notes = F.filter("image_descriptions", lambda n: strip(n) != "")
        parts.append(
            F.when(
                F.size("image_descriptions") > 0,
                F.concat(F.lit("\n[Figure / image notes]\n"), F.array_join(notes, "\n")),
            )
        )
    return chunks.withColumn("excerpt", strip(F.concat_ws("\n\n", *parts))).filter(
        F.length("excerpt") >= min_chars
    )


def tidy_markdown(rows: DataFrame, text: str = "md") -> DataFrame:
    return rows.withColumn(text, clean_markdown(F.col(text)))
