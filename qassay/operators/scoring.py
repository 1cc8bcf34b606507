"""Prediction scores, their summaries and leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qassay.functions.judging import is_refusal_gold
from qassay.functions.metrics import (
    best_exact_match,
    best_token_f1,
    cosine,
    exact_match,
    f1_from_counts,
    gap_tier,
    normalized_tokens,
    token_f1,
)
from qassay.functions.text import blank_to_null, is_invalid_answer, strip


def score_predictions(rows: DataFrame) -> DataFrame:
    """Exact match and token F1 per row; an invalid prediction scores 0."""
    invalid = is_invalid_answer(F.col("pred"))
    return (
        rows.withColumn("pred_invalid", invalid)
        .withColumn("gold_is_refusal", is_refusal_gold(F.col("gold")))
        .withColumn("exact_match", (~invalid & exact_match(F.col("pred"), F.col("gold"))).cast("double"))
        .withColumn("token_f1", F.when(invalid, F.lit(0.0)).otherwise(token_f1(F.col("pred"), F.col("gold"))))
    )


def add_cosines(scored: DataFrame, cosines: DataFrame, key: tuple[str, ...] = ("eval_id", "condition")) -> DataFrame:
    """Scored rows with pred_gold_cosine from a table of at most one cosine per key; null for invalid predictions and where none was measured."""
    measured = cosines.select(*key, F.bround("cosine", 6).alias("_cosine"))
    return (
        scored.join(measured, list(key), "left")
        .withColumn("pred_gold_cosine", F.when(~F.col("pred_invalid"), F.col("_cosine")))
        .drop("_cosine")
    )


def score_long_predictions(rows: DataFrame, key: list[str]) -> DataFrame:
    """Token F1 by joining token counts, for texts of many thousand tokens; adds token_f1 to the keys."""

    def counts(side: str) -> DataFrame:
        return (
            rows.select(*key, F.explode(normalized_tokens(F.col(side))).alias("_t"))
            .groupBy(*key, "_t")
            .agg(F.count(F.lit(1)).alias(f"_{side}"))
        )

    merged = (
        counts("pred")
        .join(counts("gold"), [*key, "_t"], "full")
        .groupBy(*key)
        .agg(
            F.sum(F.least(F.coalesce("_pred", F.lit(0)), F.coalesce("_gold", F.lit(0)))).alias("_common"),
            F.sum("_pred").alias("_np"),
            F.sum("_gold").alias("_ng"),
        )
    )
    zero = F.lit(0)
    f1 = f1_from_counts(F.coalesce("_common", zero), F.coalesce("_np", zero), F.coalesce("_ng", zero))
    return rows.join(merged, key, "left").select(
        *key, F.when(is_invalid_answer(F.col("pred")), F.lit(0.0)).otherwise(f1).alias("token_f1")
    )


def mean4(value: Column, digits: int = 4) -> Column:
    return F.bround(F.avg(value), digits)


def score_summary(scored: DataFrame, by: str = "condition") -> DataFrame:
    """Means overall, over answerable rows and over refusal rows."""
    refusal = F.col("gold_is_refusal")
    metrics = [m for m in ("exact_match", "token_f1", "pred_gold_cosine") if m in scored.columns]
    means = []
    for m in metrics:
        means += [
            mean4(F.col(m), 6).alias(f"{m}_mean"),
            mean4(F.when(~refusal, F.col(m)), 6).alias(f"answerable_{m}_mean"),
            mean4(F.when(refusal, F.col(m)), 6).alias(f"refusal_{m}_mean"),
        ]
    return scored.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("pred_invalid").alias("n_invalid_pred"),
        F.count_if(refusal).alias("n_refusal_gold"),
        *means,
    )


def gold_texts(answers: Column, gold: Column) -> Column:
    """Non-blank answer texts, else the single gold."""
    texts = F.filter(F.transform(answers, lambda a: strip(a["text"])), lambda t: t != "")
    single = F.array_compact(F.array(blank_to_null(gold)))
    return F.when(F.coalesce(F.size(texts), F.lit(0)) > 0, texts).otherwise(single)


def score_multi_gold(rows: DataFrame) -> DataFrame:
    """Best score over all golds; invalid predictions are scored like any other."""
    golds = gold_texts(F.col("answers"), F.col("gold"))
    return (
        rows.withColumn("_g", golds)
        .withColumn("pred_invalid", is_invalid_answer(F.col("pred")))
        .withColumn("exact_match", best_exact_match(F.col("pred"), F.col("_g")))
        .withColumn("token_f1", best_token_f1(F.col("pred"), F.col("_g")))
        .drop("_g")
    )


def multi_gold_summary(scored: DataFrame, by: str = "condition") -> DataFrame:
    return scored.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("pred_invalid").alias("n_invalid_pred"),
        mean4(F.col("exact_match"), 6).alias("exact_match"),
        mean4(F.col("token_f1"), 6).alias("token_f1"),
    )


def rank_rows(table: DataFrame, *order: Column, group: tuple[str, ...] = ()) -> DataFrame:
    """1-based rank without ties; for aggregated tables of one row per arm."""
    w = Window.partitionBy(*group or [F.lit(0)]).orderBy(*order)
    return table.withColumn("rank", F.row_number().over(w))


def leaderboard(table: DataFrame, metrics: list[str], rank_by: str, name: str = "condition") -> DataFrame:
    """Descending by the chosen metric, then the others, then the name; a missing metric counts as 0."""
    keys = [rank_by] + [m for m in metrics if m != rank_by]
    return rank_rows(table, *[F.coalesce(m, F.lit(0.0)).desc() for m in keys], F.desc(name))


def cosine_pairs(pairs: DataFrame) -> DataFrame:
    """Cosine, gap and gap tier of two vector columns left and right."""
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(F.col("left"), F.col("right"))))
    return (
        pairs.withColumn("cosine", F.bround(c, 6))
        .withColumn("gap", F.bround(1 - c, 6))
        .withColumn("gap_tier", gap_tier(1 - c))
    )


def cosine_summary(scored: DataFrame, low: float = 0.35) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("cosine").alias("n_scored"),
        mean4(F.col("cosine"), 6).alias("mean_cosine"),
        F.min("cosine").alias("min_cosine"),
        F.max("cosine").alias("max_cosine"),
        F.count_if(F.col("cosine") < low).alias("n_low"),
    )


def gap_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("gap").alias("n_pairs"),
        mean4(F.col("cosine"), 6).alias("mean_cosine"),
        mean4(F.col("gap"), 6).alias("mean_gap"),
        *[F.count_if(F.col("gap_tier") == t).alias(f"n_{t}") for t in ("low", "medium", "high")],
    )


def pair_texts(rows: DataFrame, mode: str) -> DataFrame:
    """Left and right text of a similarity comparison."""
    ctx, q, a = [strip(F.coalesce(F.col(c), F.lit(""))) for c in ("context", "question", "answer")]
    left = {
        "context_vs_answer": ctx,
        "cq_vs_answer": F.when(q == "", ctx).otherwise(F.concat(ctx, F.lit("\n\nQuestion: "), q)),
        "question_vs_answer": q,
    }[mode]
    return rows.withColumn("left_text", left).withColumn("right_text", a)


def nli_label(contradiction: Column, neutral: Column, entailment: Column) -> Column:
    """Most likely label; of equal ones contradiction, then neutral."""
    top = F.greatest(contradiction, neutral, entailment)
    return (
        F.when(contradiction == top, "contradiction").when(neutral == top, "neutral").otherwise("entailment")
    )


def nli_aggregate(windows: DataFrame, mode: str = "max_entail", key: str = "row_id") -> DataFrame:
    """Window probabilities to one prediction per row."""
    pick = F.avg if mode == "mean_probs" else F.max
    probs = windows.groupBy(key).agg(
        pick("p_contradiction").alias("p_contradiction"),
        F.avg("p_neutral").alias("p_neutral"),
        pick("p_entailment").alias("p_entailment"),
        F.count(F.lit(1)).alias("n_windows"),
    )
    return probs.withColumn(
        "pred_label", nli_label(F.col("p_contradiction"), F.col("p_neutral"), F.col("p_entailment"))
    )


def nli_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        mean4(F.col("p_entailment"), 6).alias("mean_p_entailment"),
        mean4(F.col("p_contradiction"), 6).alias("mean_p_contradiction"),
        F.count_if(F.col("p_contradiction") >= 0.5).alias("high_contradiction"),
        F.count_if(F.col("p_entailment") <= 0.25).alias("low_entailment"),
        F.sum("n_windows").alias("total_windows"),
        F.count_if(F.col("n_windows") > 1).alias("rows_multi_window"),
        F.max("n_windows").alias("max_n_windows"),
        mean4(F.col("n_windows"), 3).alias("mean_n_windows"),
        *[F.count_if(F.col("pred_label") == p).alias(f"n_{p}") for p in ("contradiction", "neutral", "entailment")],
    )
