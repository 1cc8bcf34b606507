"""Timing and resource tables of training and inference runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qassay.constants import EXPECTED_EVAL_ROWS, TIMING_COVERAGE
from qassay.functions.formats import hms
from qassay.operators.ranking import magnitude_bucket, nth_keys


def span_rollup(spans: DataFrame) -> DataFrame:
    """Count, total and longest duration per step."""
    return spans.groupBy("step").agg(
        F.count(F.lit(1)).alias("n_spans"),
        F.bround(F.sum("duration_s"), 3).alias("total_s"),
        F.max("duration_s").alias("max_s"),
    )


def nearest_rank(n: Column, p: float) -> Column:
    """1-based position max(1, int(p * n))."""
    return F.greatest(F.lit(1), F.floor(n * F.lit(p)))


def timing_stats(times: DataFrame, by: str = "step", value: str = "duration_s") -> DataFrame:
    """Sum, mean, range and nearest-rank percentiles per group; rows without a value do not count."""
    marks = nth_keys(
        times.filter(F.col(value).isNotNull()),
        value,
        lambda n: {"p50": nearest_rank(n, 0.50), "p90": nearest_rank(n, 0.90)},
        group=[by],
        bucket=magnitude_bucket(F.col(value)),
    )
    ranks = marks.groupBy(by).agg(
        *[F.bround(F.max(F.when(F.col("mark") == m, F.col(value))), 3).alias(f"{m}_s") for m in ("p50", "p90")]
    )
    v = F.col(value)
    return (
        times.groupBy(by)
        .agg(
            F.count(v).alias("n"),
            F.bround(F.sum(v), 3).alias("sum_s"),
            F.bround(F.avg(v), 3).alias("mean_s"),
            F.bround(F.min(v), 3).alias("min_s"),
            F.bround(F.max(v), 3).alias("max_s"),
            hms(F.avg(v)).alias("mean_hms"),
            hms(F.sum(v)).alias("total_hms"),
        )
        .join(ranks, by, "left")
    )


def timing_reliability(
    runs: DataFrame,
    expected: dict[str, int] | None = None,
    mixed_backend_models: Sequence[str] = ("gemma3_",),
) -> DataFrame:
    """Why a run's timing is not comparable, or ok; the first reason that applies."""
    sizes = EXPECTED_EVAL_ROWS if expected is None else expected
    want = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[F.col("dataset")] * TIMING_COVERAGE
    backend = F.lower(F.coalesce(F.nullif("backend", F.lit("")), F.lit("hf")))
    mixed = F.lit(False)
    for prefix in mixed_backend_models:
        mixed = mixed | F.col("model_slug").startswith(prefix)
    reason = (
        F.when(mixed, "gemma_mixed_backends")
        .when(backend == "vllm", "vllm_batch")
        .when((F.col("n_questions") > 0) & (F.col("n_questions") < want), "partial_shard")
        .when((F.col("n_preds") > 0) & (F.col("n_preds") < want), "partial_preds")
        .when(F.col("mean_s") <= 0, "zero_mean")
        .otherwise("ok")
    )
    return runs.withColumn("timing_reason", reason).withColumn("timing_reliable", F.col("timing_reason") == "ok")


def _given(rows: DataFrame, *paths: str, kind: str) -> Column:
    """First of the (nested) columns that exist and are not null; null where none does."""

    def exists(path: str) -> bool:
        at = rows.schema
        for part in path.split("."):
            if not isinstance(at, T.StructType) or part not in at.names:
                return False
            at = at[part].dataType
        return True

    return F.coalesce(*[F.col(p).cast(kind) for p in paths if exists(p)], F.lit(None).cast(kind))


def normalize_timing(raw: DataFrame, expected: dict[str, int] | None = None) -> DataFrame:
    """Nested and flat timing layouts to one; the nested value wins.

    Columns that a layout lacks are null. Runs whose time is not comparable (see timing_reliability, by the columns dataset, model_slug and n_preds) give
    no mean, but the reason.
    """
    wall = F.coalesce("timing.total_wall_s", "total_wall_s")
    mean = _given(raw, "timing.generate_per_question.mean_s", "generate.mean_s", kind="double")
    out = raw.select(
        F.coalesce(F.nullif("condition", F.lit("")), F.col("model_id"), F.lit("")).alias("condition"),
        _given(raw, "load_type", kind="string").alias("load_type"),
        F.coalesce(F.nullif("decoding.backend", F.lit("")), F.nullif("backend", F.lit("")), F.lit("hf")).alias("backend"),
        F.coalesce(F.nullif("n_questions", F.lit(0)), "n_rows").alias("n_questions"),
        F.coalesce("timing.load_model_s", "load_s").alias("load_model_s"),
        wall.alias("total_wall_s"),
        F.coalesce("timing.total_wall_hms", hms(wall)).alias("total_wall_hms"),
        mean.alias("_mean"),
        _given(raw, "timing.generate_per_question.mean_hms", "generate.mean_hms", kind="string").alias("_hms"),
        _given(raw, "timing.generate_per_question.p50_s", "generate.p50_s", kind="double").alias("p50_s_per_question"),
        _given(raw, "timing.generate_per_question.p90_s", "generate.p90_s", kind="double").alias("p90_s_per_question"),
        (F.col("memory") if "memory" in raw.columns else F.lit(None).cast("string")).alias("memory"),
        F.struct(
            _given(raw, "dataset", kind="string").alias("dataset"),
            F.coalesce(_given(raw, "model_slug", kind="string"), F.lit("")).alias("model_slug"),
            F.coalesce(F.nullif("backend", F.lit("")), F.nullif("decoding.backend", F.lit(""))).alias("backend"),
            F.coalesce(F.nullif("n_questions", F.lit(0)), "n_rows").alias("n_questions"),
            _given(raw, "n_preds", kind="bigint").alias("n_preds"),
            F.lit(None).cast("double").alias("mean_s"),
        ).alias("_run"),
    )
    judged = timing_reliability(out.select(*[F.col(c).alias(f"_{c}") for c in out.columns if c != "_run"], "_run.*"), expected)
    reliable = F.col("timing_reliable")
    kept = [c for c in out.columns if not c.startswith("_")]
    return judged.select(
        *[F.col(f"_{c}").alias(c) for c in kept],
        F.when(reliable, F.col("__mean")).alias("mean_s_per_question"),
        F.when(reliable, F.coalesce(F.nullif("__hms", F.lit("")), hms(F.col("__mean")))).alias("mean_s_per_question_hms"),
        reliable.alias("timing_reliable"),
        F.when(~reliable, F.col("timing_reason")).alias("timing_skip_reason"),
    )


def resource_rollup(spans: DataFrame, parts: DataFrame) -> DataFrame:
    """Total time of each condition over the steps it is made of; ``parts`` is a small condition/step table."""
    users = parts.groupBy("step").agg(F.count(F.lit(1)).alias("_users"))
    per_step = spans.groupBy("step").agg(F.sum("duration_s").alias("_s"), F.count(F.lit(1)).alias("_n"))
    return (
        parts.join(users, "step")
        .join(per_step, "step")
        .groupBy("condition")
        .agg(
            F.bround(F.sum("_s"), 3).alias("total_s"),
            F.sum("_n").alias("n_spans"),
            F.count(F.lit(1)).alias("n_steps"),
            F.count_if(F.col("_users") > 1).alias("n_shared_steps"),
            hms(F.sum("_s")).alias("total_hms"),
        )
    )


def pivot_sum(rows: DataFrame, by: Sequence[str], arm: str, arms: Sequence[str], value: str, digits: int = 3) -> DataFrame:
    """One column per arm with the sum of a value."""
    return rows.groupBy(*by).pivot(arm, list(arms)).agg(F.bround(F.sum(value), digits))


def score_matrix(rows: DataFrame, by: Sequence[str], arms: Sequence[str], baseline: str, candidate: str) -> DataFrame:
    """Mean score per arm as text, 'blocked' where every row failed, and the candidate's delta and speedup.

    Rows carry condition, gold_alignment (null when failed) and duration_s.
    """
    cells = rows.groupBy(*by).pivot("condition", list(arms)).agg(
        F.avg("gold_alignment").alias("score"), F.count(F.lit(1)).alias("n"), F.avg("duration_s").alias("time")
    )

    def shown(a: str) -> Column:
        n, score = F.col(f"{a}_n"), F.col(f"{a}_score")
        return (
            F.when(F.coalesce(n, F.lit(0)) == 0, "—")
            .when(score.isNull(), "blocked")
            .otherwise(F.bround(score, 2).cast("decimal(10,2)").cast("string"))
            .alias(a)
        )

    return cells.select(
        *by,
        *[shown(a) for a in arms],
        F.bround(F.col(f"{candidate}_score") - F.col(f"{baseline}_score"), 4).alias("delta"),
        F.bround(F.try_divide(f"{baseline}_time", f"{candidate}_time"), 4).alias("speedup"),
    )
