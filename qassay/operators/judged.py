"""Statistics of judged rows: error buckets, tier profiles, ceilings, re-judging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qassay.constants import (
    AUTO_BASELINES,
    EVAL_DIMENSIONS,
    JUDGE_DIMENSIONS,
    MISSING_FIELDS_ERROR,
    TIER_WEIGHT_PRESETS,
    TIERS,
)
from qassay.functions.judging import answer_type, is_refusal_gold, question_starter
from qassay.functions.text import word_count
from qassay.operators.ranking import first_per_key, value_at_rank
from qassay.operators.scoring import mean4


def judge_stats(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Outcome counts, tier counts and mean scores of the rows judged without error."""
    j = F.col("llm_judge")
    skipped = F.coalesce(j["skipped"], F.lit(False))
    error = F.coalesce(j["error"], F.lit(""))
    failed = ~skipped & (error != "")
    ok = ~skipped & (error == "")
    tier = j["quality_tier"]
    counts = [
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(ok).alias("n_judged_ok"),
        F.count_if(skipped).alias("n_skipped_nan"),
        F.count_if(failed & (error == "parse_error")).alias("n_parse_error"),
        F.count_if(failed & (error == MISSING_FIELDS_ERROR)).alias("n_missing_fields"),
        F.count_if(failed & ~error.isin("parse_error", MISSING_FIELDS_ERROR)).alias("n_api_error"),
    ]
    for t in TIERS:
        hit = ok & (tier == t)
        counts.append(F.count_if(hit | skipped if t == "drop" else hit).alias(f"n_{t}"))
    counts.append(F.count_if(failed).alias("n_error"))
    means = [mean4(F.when(ok, j[d])).alias(f"mean_{d}") for d in EVAL_DIMENSIONS]
    return rows.groupBy(*([by] if by else [])).agg(*counts, *means)


def tier_label() -> Column:
    return F.lower(F.coalesce(F.col("llm_judge.quality_tier"), F.lit("missing")))


def tier_profile(rows: DataFrame) -> DataFrame:
    """Per tier: share, word counts (mean and upper median), score means, share of refusals."""
    j = F.col("llm_judge")
    narrow = rows.select(
        tier_label().alias("tier"),
        *[word_count(F.coalesce(c, F.lit(""))).alias(f"{c}_words") for c in ("question", "answer", "context")],
        *[j[d].alias(d) for d in JUDGE_DIMENSIONS],
        is_refusal_gold(F.col("answer")).alias("refusal"),
    )
    total = Window.partitionBy(F.lit(0))
    lengths = ("question_words", "answer_words", "context_words")
    out = (
        narrow.groupBy("tier")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[mean4(F.col(c), 1).alias(f"mean_{c}") for c in lengths],
            *[mean4(F.col(d), 2).alias(f"mean_{d}") for d in JUDGE_DIMENSIONS],
            F.count_if("refusal").alias("_ref"),
        )
        .withColumn("pct_of_pool", F.bround(100.0 * F.col("n") / F.sum("n").over(total), 1))
        .withColumn("refusal_gold_pct", F.bround(100.0 * F.col("_ref") / F.col("n"), 1))
        .drop("_ref")
    )
    # One histogram of all three lengths for the medians.
    long = narrow.unpivot(["tier"], list(lengths), "length", "words")
    medians = value_at_rank(long, ["tier", "length"], "words", lambda n: F.floor(n / 2) + 1)
    wide = medians.groupBy("tier").agg(
        *[F.max(F.when(F.col("length") == c, F.col("words"))).alias(f"median_{c}") for c in lengths]
    )
    return out.join(wide, "tier")


def label_shares(rows: DataFrame, label: Column, n: int) -> DataFrame:
    """Most frequent labels per tier with their percent of the tier; equal counts go by label.

    The n-th largest count of a tier is found first, from how many labels have which count. Only labels at or above it
    are ranked, and of those with just that count Spark keeps n per task before they meet.
    """
    counts = rows.groupBy(tier_label().alias("tier"), label.alias("label")).agg(F.count(F.lit(1)).alias("n_rows"))
    totals = counts.groupBy("tier").agg(F.sum("n_rows").alias("_all"))
    # The n-th from above stands at the place size - n + 1 from below.
    least = value_at_rank(counts.select("tier", "n_rows"), ["tier"], "n_rows", lambda size: F.greatest(size - n + 1, F.lit(1)))
    # One row per tier on this side.
    bounds = F.broadcast(totals.join(least.withColumnRenamed("n_rows", "_least"), "tier"))
    order = Window.partitionBy("tier").orderBy(F.desc("n_rows"), "label")
    return (
        counts.join(bounds, "tier")
        .filter(F.col("n_rows") >= F.col("_least"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .select("tier", "label", "n_rows", F.bround(100.0 * F.col("n_rows") / F.col("_all"), 1).alias("pct"), "rank")
    )


def tier_answer_types(rows: DataFrame, n: int = 6) -> DataFrame:
    return label_shares(rows, answer_type(F.col("answer"), F.col("llm_judge.refuse_expected")), n)


def tier_starters(rows: DataFrame, n: int = 10) -> DataFrame:
    return label_shares(rows, question_starter(F.col("question")), n)


def tier_topics(rows: DataFrame, n: int = 5) -> DataFrame:
    topic = F.coalesce(F.nullif("document_topic", F.lit("")), F.nullif("source", F.lit("")), F.lit("unknown"))
    return label_shares(rows, topic, n)


def tier_weights(rows: DataFrame, preset: str = "frequency") -> DataFrame:
    """Weight of each usable tier: its share of the rows, or a fixed preset."""
    counts = (
        rows.select(tier_label().alias("tier"))
        .filter(F.col("tier").isin("high", "medium", "low"))
        .groupBy("tier")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    if preset == "frequency":
        total = Window.partitionBy(F.lit(0))
        return counts.withColumn("weight", F.bround(F.col("n_rows") / F.sum("n_rows").over(total), 6))
    if preset not in TIER_WEIGHT_PRESETS:
        raise ValueError(f"unknown preset {preset}; choose frequency or one of {list(TIER_WEIGHT_PRESETS)}")
    high, medium, low = TIER_WEIGHT_PRESETS[preset]
    return counts.withColumn(
        "weight", F.when(F.col("tier") == "high", high).when(F.col("tier") == "medium", medium).otherwise(low)
    )


def ceiling_gap(
    table: DataFrame, ceiling: str, baseline: str | None = None, value: str = "mean_gold_alignment", candidates: Sequence[str] = AUTO_BASELINES
) -> DataFrame:
    """Gap to the ceiling arm and share of its gain over the baseline; reference arms are left out.

    The table has one row per arm, so both reference values are read off it with a window. Without a baseline the first of the candidates that is
    an arm of the table is taken; where none is, shares are null. A ceiling that is no arm fails the job.
    """
    arms = Window.partitionBy(F.lit(0))

    def of(name: str) -> Column:
        return F.max(F.when(F.col("condition") == name, F.col(value))).over(arms)

    def present(name: str) -> Column:
        return F.coalesce(F.bool_or(F.col("condition") == name).over(arms), F.lit(False))

    top = F.when(present(ceiling), of(ceiling)).otherwise(F.raise_error(F.lit(f"no arm {ceiling} to take as the ceiling")).cast("double"))
    base = F.lit(None).cast("double")
    for name in reversed(list(candidates) if baseline is None else [baseline]):
        base = F.when(present(name), of(name)).otherwise(base)
    known = table.withColumn("_top", top).withColumn("_base", base)
    denominator = F.col("_top") - F.col("_base")
    gain = F.when(F.abs(denominator) > 1e-9, (F.col(value) - F.col("_base")) / denominator)
    return known.filter((F.col("condition") != ceiling) & ~F.col("condition").startswith("REF_")).select(
        "condition",
        value,
        F.bround(F.col("_top") - F.col(value), 4).alias("gap_to_ceiling"),
        F.bround(gain, 4).alias("recovery_vs_baseline"),
        F.bround(100.0 * gain, 1).alias("pct_of_ceiling_gain"),
    )


FAILURE_MODES = ("low_score", "loses_to_a", "loses_to_b", "loses_to_best")


def select_failures(wide: DataFrame, mode: str, low: float = 2.0) -> DataFrame:
    """Rows (eval_id, candidate, baseline_a, baseline_b) where the candidate fails."""
    c, a, b = F.col("candidate"), F.col("baseline_a"), F.col("baseline_b")
    test = {
        "low_score": c <= low,
        "loses_to_a": c < a,
        "loses_to_b": c < b,
        "loses_to_best": c < F.greatest(a, b),
    }[mode]
    return wide.filter(test)


def rejudge_compare(
    old: DataFrame, new: DataFrame, key: str = "eval_id", score: str = "gold_alignment", order: str = "ord"
) -> DataFrame:
    """Changes of re-judged rows (the last of each key) and the mean of the whole set with them put in."""
    redone = first_per_key(new, [key], order, largest=True).select(key, F.col(score).cast("double").alias("_new")).filter(F.col("_new").isNotNull())
    both = old.select(key, F.col(score).cast("double").alias("_old")).filter(F.col("_old").isNotNull()).join(
        redone, key, "left"
    )
    delta = F.col("_new") - F.col("_old")
    hit = F.col("_new").isNotNull()
    return both.agg(
        F.count("_new").alias("n_compared"),
        mean4(F.when(hit, F.col("_old"))).alias("mean_old"),
        mean4(F.col("_new")).alias("mean_new"),
        mean4(delta).alias("mean_delta"),
        F.count_if(delta > 1e-9).alias("n_improved"),
        F.count_if(delta < -1e-9).alias("n_worse"),
        F.count_if(F.abs(delta) <= 1e-9).alias("n_same"),
        F.bround(100.0 * F.count_if(delta > 1e-9) / F.nullif(F.count("_new"), F.lit(0)), 1).alias("pct_improved"),
        mean4(F.col("_old")).alias("original_mean"),
        mean4(F.coalesce("_new", "_old")).alias("counterfactual_mean"),
    )
