"""Counts of category labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAILED = "__error__"


def category_counts(rows: DataFrame, fields: Sequence[str], failed: str | None = None) -> DataFrame:
    """Rows per field and value: field, value, n_rows.

    A missing value, or one that only names a classifier fault (classifier_...), counts as an error where the column ``failed``
    says that the classifier failed, else not at all.
    """
    bad = F.lit(False) if failed is None else F.coalesce(F.col(failed).cast("boolean"), F.lit(False))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    value = F.col("_p.value")
    label = F.when(value.isNotNull() & ~F.startswith(value, F.lit("classifier_")), value).when(F.col("_bad"), FAILED)
    return (
        rows.select(bad.alias("_bad"), F.explode(pairs).alias("_p"))
        .select("_p.field", label.alias("value"))
        .filter(F.col("value").isNotNull())
        .groupBy("field", "value")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def cross_tab(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Rows per pair of labels; a missing label is 'unknown'."""
    sides = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in (left, right)]
    return rows.select(*sides).groupBy(left, right).agg(F.count(F.lit(1)).alias("n_rows"))
