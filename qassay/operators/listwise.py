"""Listwise ranking: tasks, pass merging, points, win rates, slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qassay.functions.text import is_invalid_answer, strip
from qassay.operators.enrich import align_arms
from qassay.operators.ranking import first_per_key
from qassay.operators.requests import label_order
from qassay.operators.scoring import mean4, rank_rows


def listwise_tasks(
    questions: DataFrame,
    predictions: DataFrame,
    conditions: Sequence[str],
    require_all: bool = True,
    order: str = "ord",
) -> DataFrame:
    """Questions with the conditions that gave a valid prediction and those predictions, as parallel arrays."""
    conditions = sorted(conditions)
    wide = align_arms(predictions, conditions, ["pred"], ["eval_id"], order=order)
    entries = F.array(
        *[
            F.when(
                ~is_invalid_answer(F.col(c)["pred"]),
                F.struct(F.lit(c).alias("condition"), strip(F.col(c)["pred"]).alias("pred")),
            )
            for c in conditions
        ]
    )
    need = len(conditions) if require_all else 2
    return (
        questions.join(wide.select("eval_id", F.array_compact(entries).alias("_e")), "eval_id")
        .filter((F.size("_e") >= need) & (F.size("_e") >= 2))
        .withColumn("conditions", F.col("_e.condition"))
        .withColumn("preds", F.col("_e.pred"))
        .drop("_e")
    )


def listwise_labels(tasks: DataFrame, seed: int = 42, fixed_order: Sequence[str] | None = None) -> DataFrame:
    """Letters A, B, ... for the conditions of a task, in seeded or fixed order."""
    if fixed_order:
        fixed = F.array(*[F.lit(c) for c in fixed_order])
        wanted = F.filter(fixed, lambda c: F.array_contains("conditions", c))
        shown = F.when(F.size(wanted) >= 2, wanted).otherwise(F.col("conditions"))
    else:
        shown = label_order(seed, F.col("eval_id"), F.col("conditions"))
    labels = F.transform(F.col("_shown"), lambda c, i: F.char(F.lit(65) + i))
    pred_of = F.map_from_arrays("conditions", "preds")
    return (
        tasks.withColumn("_shown", shown)
        .withColumn("labels", labels)
        .withColumn("label_to_condition", F.map_from_arrays("labels", "_shown"))
        .withColumn("label_preds", F.transform("_shown", lambda c: F.try_element_at(pred_of, c)))
        .drop("_shown")
    )


def ranked_ok(results: DataFrame) -> DataFrame:
    return results.filter(F.coalesce("error", F.lit("")) == "")


def points_rows(results: DataFrame) -> DataFrame:
    """One row per question and condition with rank and points."""
    return (
        ranked_ok(results)
        .select("eval_id", "points_by_condition", F.explode("ranks_by_condition").alias("condition", "rank_value"))
        .select(
            "eval_id", "condition", "rank_value",
            F.try_element_at("points_by_condition", F.col("condition")).alias("points"),
        )
    )


def listwise_points(results: DataFrame) -> DataFrame:
    """Ranked questions, sum and mean of points per condition, with the counts of usable and failed rows."""
    ok = F.coalesce("error", F.lit("")) == ""
    totals = results.agg(F.struct(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("bad"))).scalar()
    return (
        ranked_ok(results)
        .select(F.explode("points_by_condition").alias("condition", "points"))
        .groupBy("condition")
        .agg(
            F.count(F.lit(1)).alias("n_ranked"),
            F.sum("points").alias("sum_points"),
            mean4(F.col("points")).alias("mean_points"),
        )
        .withColumn("n_questions_ok", totals["ok"])
        .withColumn("n_questions_error", totals["bad"])
    )


def listwise_leaderboard(points: DataFrame) -> DataFrame:
    return rank_rows(points, F.desc("mean_points"), F.asc("condition"))


def condition_names(results: DataFrame) -> DataFrame:
    return ranked_ok(results).select(F.explode(F.map_keys("ranks_by_condition")).alias("condition")).distinct()


def outcomes(results: DataFrame, baseline: str) -> DataFrame:
    """Outcome 1 / 0.5 / 0 of every other condition against the baseline, question by question; no join."""
    base = F.try_element_at("ranks_by_condition", F.lit(baseline))
    mine = F.col("rank_value")
    return (
        ranked_ok(results)
        .filter(base.isNotNull())
        .select("eval_id", base.alias("_base"), F.explode("ranks_by_condition").alias("condition", "rank_value"))
        .filter(F.col("condition") != baseline)
        .select(
            "eval_id",
            "condition",
            F.when(mine < F.col("_base"), 1.0).when(mine > F.col("_base"), 0.0).otherwise(0.5).alias("outcome"),
        )
    )


def win_counts() -> list[Column]:
    o = F.col("outcome")
    return [
        F.count_if(o == 1.0).alias("wins"),
        F.count_if(o == 0.0).alias("losses"),
        F.count_if(o == 0.5).alias("ties"),
    ]


def win_rate(results: DataFrame, baseline: str) -> DataFrame:
    n = F.col("n")
    return (
        outcomes(results, baseline)
        .groupBy("condition")
        .agg(F.count("outcome").alias("n"), *win_counts())
        .select(
            "*",
            F.bround(F.col("wins") / n, 4).alias("win_rate"),
            F.bround(F.col("losses") / n, 4).alias("loss_rate"),
            F.bround(F.col("ties") / n, 4).alias("tie_rate"),
        )
    )


def swap_merge_ranks(first: DataFrame, second: DataFrame, order: str = "ord") -> DataFrame:
    """Mean rank and points of both presentation orders, on questions ranked in both; of a question ranked again within a pass the last ranking counts."""
    first, second = (first_per_key(ranked_ok(p), ["eval_id"], order, largest=True) for p in (first, second))
    a = points_rows(first).select("eval_id", "condition", F.col("rank_value").alias("_r1"), F.col("points").alias("_p1"))
    b = points_rows(second).select("eval_id", "condition", F.col("rank_value").alias("_r2"), F.col("points").alias("_p2"))
    return a.join(b, ["eval_id", "condition"]).select(
        "eval_id",
        "condition",
        ((F.col("_r1") + F.col("_r2")) / 2).alias("mean_rank"),
        ((F.col("_p1") + F.col("_p2")) / 2).alias("mean_points"),
    )


def slice_metrics(
    classified: DataFrame, results: DataFrame, scored: DataFrame, fields: Sequence[str], baseline: str,
    conditions: Sequence[str] | None = None,
) -> DataFrame:
    """Per slice value and condition: points, F1, exact match, cosine (where scored) and win rate against the baseline. Results with an error do not count.

    Without conditions, those of the results are taken. Slices are exploded only after the per-question facts are joined, so nothing is joined per slice.
    """
    ranks = F.col("ranks_by_condition")
    given = None if conditions is None else F.array(*[F.lit(c) for c in conditions])
    arms = condition_names(results).agg(F.collect_set("condition")).scalar() if given is None else given
    metrics = [m for m in ("token_f1", "exact_match", "pred_gold_cosine") if m in scored.columns]
    per_question = (
        ranked_ok(results).select("eval_id", "points_by_condition", "ranks_by_condition", arms.alias("_arms"))
        .withColumn("condition", F.explode("_arms"))
        .withColumn("points", F.try_element_at("points_by_condition", F.col("condition")))
        .withColumn("_r", F.try_element_at(ranks, F.col("condition")))
        .withColumn("_b", F.when(F.col("condition") != baseline, F.try_element_at(ranks, F.lit(baseline))))
        .withColumn(
            "outcome",
            F.when(F.col("_r") < F.col("_b"), 1.0).when(F.col("_r") > F.col("_b"), 0.0).when(F.col("_r") == F.col("_b"), 0.5),
        )
        .select("eval_id", "condition", "points", "outcome")
    )
    facts = per_question.join(scored.select("eval_id", "condition", *metrics), ["eval_id", "condition"], "left")
    value = {f: F.coalesce(F.nullif(strip(F.col(f)), F.lit("")), F.lit("unknown")) for f in fields}
    slices = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in value.items()])
    return (
        facts.join(classified.select("eval_id", slices.alias("_s")), "eval_id")
        .withColumn("_s", F.explode("_s"))
        .groupBy("_s.field", "_s.value", "condition")
        .agg(
            F.count(F.lit(1)).alias("n_questions"),
            mean4(F.col("points")).alias("mean_points"),
            *[mean4(F.col(m)).alias(f"mean_{m}") for m in metrics],
            *win_counts(),
        )
        .withColumn(
            "win_rate",
            F.bround(F.try_divide("wins", F.col("wins") + F.col("losses") + F.col("ties")), 4),
        )
    )


def slice_leaderboard(slices: DataFrame, metric: str = "mean_points") -> DataFrame:
    rows = slices.filter(F.col(metric).isNotNull()).select("field", "value", "condition", metric)
    return rank_rows(rows, F.desc(metric), F.asc("condition"), group=("field", "value"))


def candidate_beats(results: DataFrame, wide: DataFrame, candidate: str, baseline: str) -> DataFrame:
    """Questions where the candidate is ranked above the baseline, with both answers, by question.

    ``wide`` is one row per eval_id with question, gold and the answers of both arms.
    """
    rank_c = F.try_element_at("ranks_by_condition", F.lit(candidate))
    rank_b = F.try_element_at("ranks_by_condition", F.lit(baseline))
    better = ranked_ok(results).filter(rank_c < rank_b).select("eval_id")
    return wide.join(better, "eval_id").orderBy("question", "eval_id")
