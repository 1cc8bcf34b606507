"""What arms cost: training and merging apart, tier by tier, with sizes and ratios as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qassay.functions.formats import duration, size, speedup


def condition_costs(spans: DataFrame, parts: DataFrame) -> DataFrame:
    """Seconds of the training and merging steps each condition is made of, how many of them others use too, and the steps as text.

    ``parts`` has condition, kind (train or merge), step and pos (the order of the text). A step that never ran costs nothing; without any time in
    training (merging) that column is null. A step that stands twice in a condition counts twice.
    """
    seconds = spans.groupBy("step").agg(F.sum("duration_s").alias("_s"))
    users = parts.groupBy("step").agg(F.count_distinct("condition").alias("_users"))
    rows = parts.join(users, "step", "left").join(seconds, "step", "left").withColumn("_s", F.coalesce("_s", F.lit(0.0)))
    whole = F.bround("_s").cast("bigint").cast("string")
    rows = rows.withColumn("_text", F.concat("kind", F.lit(" "), "step", F.lit(" ("), whole, F.lit("s)")))
    shared = F.col("_users") > 1

    def total(test: Column) -> Column:
        return F.bround(F.coalesce(F.sum(F.when(test, F.col("_s"))), F.lit(0.0)), 3)

    return rows.groupBy("condition").agg(
        F.nullif(total(F.col("kind") == "train"), F.lit(0.0)).alias("train_s"),
        F.nullif(total(F.col("kind") == "merge"), F.lit(0.0)).alias("merge_s"),
        total(F.col("kind").isin("train", "merge")).alias("incremental_s"),
        F.count_if(shared).alias("n_shared_steps"),
        total(shared).alias("shared_s"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_text"))), lambda p: p["_text"]), "; ").alias("sources"),
    )


def tier_costs(
    runs: DataFrame, by: Sequence[str], baseline: str, tiered: str, tiers: Sequence[str] = ("high", "medium", "low", "merge")
) -> DataFrame:
    """Per group the seconds of the baseline arm and of each tier of the tiered arm, adapter sizes, and how much faster the tiered arm is.

    ``runs`` has arm, tier (null for the baseline), wall_s and adapter_bytes. What did not run is null, and — as text.
    """
    arm = F.col("arm")

    def seconds(test: Column) -> Column:
        return F.bround(F.sum(F.when(test, F.col("wall_s"))), 3)

    def adapter(name: str) -> Column:
        return F.sum(F.when(arm == name, F.col("adapter_bytes")))

    sums = runs.groupBy(*by).agg(
        seconds(arm == baseline).alias("baseline_s"),
        *[seconds((arm == tiered) & (F.col("tier") == t)).alias(f"{t}_s") for t in tiers],
        seconds(arm == tiered).alias("tiered_s"),
        adapter(baseline).alias("_baseline_bytes"),
        adapter(tiered).alias("_tiered_bytes"),
    )
    return sums.select(
        *by, "baseline_s", *[f"{t}_s" for t in tiers], "tiered_s",
        duration(F.col("tiered_s")).alias("tiered_time"),
        size(F.col("_baseline_bytes")).alias("baseline_size"),
        size(F.col("_tiered_bytes")).alias("tiered_size"),
        speedup(F.col("baseline_s"), F.col("tiered_s")).alias("speedup"),
    )
