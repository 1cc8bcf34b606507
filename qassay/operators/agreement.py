"""Agreement of two raters, computed from joint counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qassay.constants import JUDGE_DIMENSIONS
from qassay.functions.judging import quality_tier
from qassay.operators.ranking import running_totals, written


def confusion(rows: DataFrame, left: str, right: str) -> DataFrame:
    return rows.groupBy(left, right).agg(F.count(F.lit(1)).alias("n_rows"))


def cohen_kappa(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Kappa of two label columns; 1 or 0 when chance agreement is already complete."""
    both = rows.filter(F.col(left).isNotNull() & F.col(right).isNotNull())
    n, zero = F.col("n_rows"), F.lit(0)
    agreed = F.when(F.col(left) == F.col(right), n).otherwise(zero)
    # Each cell counts once for its left label and once for its right label.
    sides = F.array(
        F.struct(F.col(left).alias("label"), n.alias("a"), zero.cast("bigint").alias("b"), agreed.alias("same")),
        F.struct(F.col(right).alias("label"), zero.cast("bigint").alias("a"), n.alias("b"), zero.cast("bigint").alias("same")),
    )
    labels = (
        confusion(both, left, right)
        .select(F.explode(sides).alias("_s"))
        .groupBy("_s.label")
        .agg(F.sum("_s.a").alias("a"), F.sum("_s.b").alias("b"), F.sum("_s.same").alias("same"))
    )
    total = Window.partitionBy(F.lit(0))
    share = F.col("a") / F.sum("a").over(total) * (F.col("b") / F.sum("b").over(total))
    stats = labels.withColumn("_p", share).agg(F.sum("a").alias("n"), F.sum("same").alias("n_agree"), F.sum("_p").alias("chance"))
    observed, chance = F.col("n_agree") / F.col("n"), F.col("chance")
    # Full chance agreement leaves nothing to correct for.
    kappa = F.when(1.0 - chance == 0.0, F.when(F.abs(observed - 1.0) <= 1e-9, 1.0).otherwise(0.0)).otherwise(
        (observed - chance) / (1.0 - chance)
    )
    return stats.filter(F.col("n") > 0).select(
        "n", F.bround(observed, 6).alias("agreement"), F.bround(chance, 6).alias("chance"), F.bround(kappa, 6).alias("kappa")
    )


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties, from the joint histogram of two score columns.

    Ranks are running totals over range partitions of the distinct values, so continuous scores spread over tasks too.
    Rows with a null on either side do not count.
    """
    cells = written(
        rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        .groupBy("x", "y")
        .agg(F.count(F.lit(1)).alias("w"))
    )
    total = cells.agg(F.sum("w")).scalar()
    w, mid = F.col("w"), (total + 1) / 2
    dx, dy = F.col("rx") - mid, F.col("ry") - mid
    moments = _with_rank(_with_rank(cells, "x", total), "y", total).agg(
        F.sum("w").alias("n"), F.sum(w * dx * dy).alias("xy"), F.sum(w * dx * dx).alias("xx"), F.sum(w * dy * dy).alias("yy")
    )
    usable = (F.col("n") >= 2) & (F.col("xx") > 0) & (F.col("yy") > 0)
    rho = F.when(usable, F.col("xy") / (F.sqrt("xx") * F.sqrt("yy")))
    return moments.select("n", F.bround(rho, 6).alias("spearman"))


def _with_rank(cells: DataFrame, side: str, total: Column, hot_share: int = 64) -> DataFrame:
    """Adds r<side>, the average rank of the value. Fewer than hot_share values hold more than 1 / hot_share of all rows
    each; their ranks are broadcast, so no task gets all cells of such a value."""
    values = running_totals(cells.groupBy(side).agg(F.sum("w").alias("_same")), side, "_same")
    ranks = values.select(side, (F.col("_before") + (F.col("_same") + 1) / 2).alias(f"r{side}"), "_same")
    is_hot = F.col("_same") * hot_share > total
    hot, rest = ranks.filter(is_hot).drop("_same"), ranks.filter(~is_hot).drop("_same")
    return cells.join(F.broadcast(hot), side).unionByName(cells.join(F.broadcast(hot), side, "left_anti").join(rest, side))


def with_tiers(rows: DataFrame) -> DataFrame:
    """Teacher and student tiers; a student error is the tier 'error'."""
    s, t = F.col("student_judge"), F.col("teacher_judge")
    failed = F.coalesce(s["error"], F.lit("")) != ""

    def tier(j):
        return quality_tier(F.col("answer"), *[F.coalesce(j[d], F.lit(0)) for d in JUDGE_DIMENSIONS])

    return rows.withColumn(
        "teacher_tier", F.coalesce(F.nullif("teacher_quality_tier", F.lit("")), tier(t))
    ).withColumn("student_tier", F.when(failed, "error").otherwise(tier(s)))


def judge_agreement(rows: DataFrame) -> DataFrame:
    """Tier agreement, error per dimension and the two costly mistakes, in one pass."""
    s, t = F.col("student_judge"), F.col("teacher_judge")
    failed = F.coalesce(s["error"], F.lit("")) != ""
    scored = ~failed
    for d in JUDGE_DIMENSIONS:
        scored = scored & s[d].isNotNull() & t[d].isNotNull()
    tt, st = F.col("teacher_tier"), F.col("student_tier")
    n = F.count(F.lit(1))
    return with_tiers(rows).agg(
        n.alias("n_rows"),
        F.count_if(scored).alias("n_scored_rows"),
        F.count_if(failed).alias("n_parse_errors"),
        F.bround(F.count_if(tt == st) / n, 6).alias("tier_agreement"),
        *[F.bround(F.avg(F.when(scored, F.abs(s[d] - t[d]))), 6).alias(f"mae_{d}") for d in JUDGE_DIMENSIONS],
        F.bround(F.count_if((tt != "high") & (st == "high")) / n, 6).alias("false_high_rate"),
        F.bround(F.count_if((tt == "drop") & (st != "drop")) / n, 6).alias("false_drop_rate"),
    )


def tier_confusion(rows: DataFrame) -> DataFrame:
    return confusion(with_tiers(rows), "teacher_tier", "student_tier")
