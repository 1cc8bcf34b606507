"""One row per document, passage or question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qassay.functions.judging import passage_id
from qassay.functions.text import strip
from qassay.operators.ranking import first_per_key


def _acceptable(rows: DataFrame, key: str, min_chars: int) -> tuple[DataFrame, DataFrame]:
    tidy = (
        rows.withColumn(key, strip(F.coalesce(key, F.lit(""))))
        .withColumn("context", strip(F.coalesce("context", F.lit(""))))
        .filter(F.col(key) != "")
    )
    return tidy.filter(F.length("context") >= min_chars), tidy.filter(F.length("context") < min_chars)


def dedupe_first(
    rows: DataFrame,
    key: str = "document_id",
    keep: tuple[str, ...] = ("document_topic",),
    split: str | None = "split",
    order: str = "ord",
    min_context_chars: int = 40,
) -> DataFrame:
    """First row with a long enough context per key, plus how many rows follow it and in which splits.

    Rows before the first acceptable one are all short, so only short rows are joined back.
    """
    good, short = _acceptable(rows, key, min_context_chars)
    kept = good.groupBy(key).agg(
        F.min_by(F.struct("context", *keep), F.col(order)).alias("_row"), F.min(order).alias("_first")
    )
    firsts = good.groupBy(key).agg(F.min(order).alias("_first"))
    extra = [split] if split else []
    late = short.select(key, order, *extra).join(firsts, key).filter(F.col(order) > F.col("_first"))
    seen = good.select(key, *extra).unionByName(late.select(key, *extra)).groupBy(key)
    aggs = [F.count(F.lit(1)).alias("n_source_rows")]
    if split:
        aggs.append(F.array_sort(F.collect_set(split)).alias("splits"))
    return kept.select(key, "_row.*").join(seen.agg(*aggs), key)


def dedupe_first_stats(
    rows: DataFrame, key: str = "document_id", order: str = "ord", min_context_chars: int = 40
) -> DataFrame:
    """Counters of the dedupe: input rows, missing ids, short rows met before the first good one, survivors."""
    good, short = _acceptable(rows, key, min_context_chars)
    firsts = good.groupBy(key).agg(F.min(order).alias("_first"))
    skipped = (
        short.select(key, order)
        .join(firsts, key, "left")
        .filter(F.col("_first").isNull() | (F.col(order) < F.col("_first")))
    )
    blank = strip(F.coalesce(key, F.lit(""))) == ""
    totals = rows.agg(
        F.count(F.lit(1)).alias("input_rows"), F.count_if(blank).alias("skipped_missing_id")
    )
    return (
        totals.withColumn("skipped_short_context", skipped.agg(F.count(F.lit(1))).scalar())
        .withColumn("n_unique", firsts.agg(F.count(F.lit(1))).scalar())
    )


def dedupe_longest(
    rows: DataFrame, tag: str = "qa", order: str = "ord", min_context_chars: int = 40
) -> DataFrame:
    """Longest context per passage id, the earliest of equally long ones."""
    longest = F.struct(F.length("context").alias("n"), (-F.col(order)).alias("o"))
    return (
        passages_with_id(rows, tag, min_context_chars)
        .groupBy("section_id")
        .agg(F.max_by(F.struct("context", "source", "title"), longest).alias("_row"))
        .select(
            "section_id",
            F.concat("_row.context", F.lit("\n")).alias("text"),
            F.coalesce("_row.source", F.lit(tag)).alias("source"),
            F.length("_row.context").alias("char_count"),
            F.col("_row.title").alias("title"),
        )
    )


def passages_with_id(rows: DataFrame, tag: str, min_context_chars: int) -> DataFrame:
    given = F.coalesce(*[F.col(c) for c in ("section_id", "paragraph_id") if c in rows.columns], F.lit(None))
    title = F.col("title") if "title" in rows.columns else F.lit(None).cast("string")
    return (
        rows.withColumn("context", strip(F.coalesce("context", F.lit(""))))
        .filter(F.length("context") >= max(1, min_context_chars))
        .withColumn("title", title)
        .withColumn("section_id", passage_id(tag, F.col("context"), F.col("title"), given.cast("string")))
    )


def dedupe_eval_id(rows: DataFrame, key: str = "eval_id", split: str = "split", order: str = "ord") -> DataFrame:
    return first_per_key(rows, [split, key], order)


def passage_corpus_manifest(rows: DataFrame, tag: str = "qa", min_context_chars: int = 40) -> DataFrame:
    """Counts behind the passage corpus: one row."""
    context = strip(F.coalesce("context", F.lit("")))
    passages = passages_with_id(rows, tag, min_context_chars)
    unique = passages.select("section_id").distinct().agg(F.count(F.lit(1))).scalar()
    return (
        rows.agg(
            F.count(F.lit(1)).alias("input_qa_rows"),
            F.count_if(context == "").alias("skipped_missing_context"),
            F.count_if((context != "") & (F.length(context) < min_context_chars)).alias("skipped_short"),
        )
        .withColumn("unique_passages", unique)
        .withColumn(
            "duplicate_section_rows",
            F.col("input_qa_rows")
            - F.col("skipped_missing_context")
            - F.col("skipped_short")
            - F.col("unique_passages"),
        )
    )
