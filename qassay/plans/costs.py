"""Queries for costs by kind and tier, and for scores with cosines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qassay.operators import costs, listwise, scoring
from qassay.plans import sqltext as s
from qassay.plans.evaluation import _COS_SQL, _SCORED, scored
from qassay.plans.ranking import _SLICES_SQL, slice_fields
from qassay.plans.registry import query
from qassay.plans.views import Tables

# Which steps a condition is made of; `resume` never ran.
_PARTS = [
    ("single", "train", "view", 0),
    ("tiered", "train", "signup", 0), ("tiered", "train", "purchase", 1), ("tiered", "merge", "click", 2),
    ("adaptive", "train", "purchase", 0), ("adaptive", "train", "resume", 1), ("adaptive", "merge", "error", 2),
    ("frozen", "train", "resume", 0),
]
_PARTS_SQL = "parts(condition, kind, step, pos) AS (VALUES " + ", ".join(f"('{c}', '{k}', '{p}', {i})" for c, k, p, i in _PARTS) + ")"


@query(
    "condition_costs",
    f"""WITH {_PARTS_SQL}, per_step AS (SELECT step, sum(duration_s) AS sec FROM v_spans GROUP BY 1), users AS (SELECT step, count(DISTINCT condition) AS u FROM parts GROUP BY 1),
x AS (SELECT condition, kind, step, pos, u, coalesce(sec, 0) AS sec FROM parts JOIN users USING (step) LEFT JOIN per_step USING (step))
SELECT condition, nullif({s.r("coalesce(sum(sec) FILTER (WHERE kind = 'train'), 0)", 3)}, 0) AS train_s, nullif({s.r("coalesce(sum(sec) FILTER (WHERE kind = 'merge'), 0)", 3)}, 0) AS merge_s,
  {s.r('sum(sec)', 3)} AS incremental_s, count(*) FILTER (WHERE u > 1) AS n_shared_steps, {s.r('coalesce(sum(sec) FILTER (WHERE u > 1), 0)', 3)} AS shared_s,
  string_agg(kind || ' ' || step || ' (' || CAST(round_even(sec, 0) AS BIGINT) || 's)', '; ' ORDER BY pos) AS sources FROM x GROUP BY 1""",
)
def condition_costs(t: Tables):
    return costs.condition_costs(t.spans, t.spark.createDataFrame(_PARTS, "condition string, kind string, step string, pos int"))


_SIZE = "CASE WHEN {b} IS NULL THEN '—' WHEN {b} >= 1e9 THEN printf('%.2f GB', {b} / 1e9::DOUBLE) ELSE printf('%.0f MB', {b} / 1e6::DOUBLE) END"


@query(
    "tier_costs",
    f"""WITH x AS (SELECT user_id % 50 AS model, event_type AS e, value, CAST(floor(value * 12345) AS BIGINT) AS b FROM events),
y AS (SELECT model, {s.r("sum(value) FILTER (WHERE e = 'view')", 3)} AS baseline_s, {s.r("sum(value) FILTER (WHERE e = 'signup')", 3)} AS high_s,
  {s.r("sum(value) FILTER (WHERE e = 'purchase')", 3)} AS medium_s, {s.r("sum(value) FILTER (WHERE e = 'click')", 3)} AS low_s, {s.r("sum(value) FILTER (WHERE e = 'error')", 3)} AS merge_s,
  {s.r("sum(value) FILTER (WHERE e <> 'view')", 3)} AS tiered_s, sum(b) FILTER (WHERE e = 'view') AS bb, sum(b) FILTER (WHERE e <> 'view') AS tb FROM x GROUP BY 1),
z AS (SELECT *, CAST(round_even(tiered_s, 0) AS BIGINT) AS n FROM y)
SELECT model, baseline_s, high_s, medium_s, low_s, merge_s, tiered_s,
  CASE WHEN n IS NULL THEN '—' WHEN n // 3600 > 0 THEN printf('%dh %02dm', n // 3600, n % 3600 // 60) WHEN n // 60 > 0 THEN printf('%dm %02ds', n // 60, n % 60) ELSE printf('%ds', n) END AS tiered_time,
  {_SIZE.format(b='bb')} AS baseline_size, {_SIZE.format(b='tb')} AS tiered_size,
  CASE WHEN baseline_s IS NOT NULL AND tiered_s > 0 THEN printf('%.1f×', baseline_s / tiered_s) ELSE '—' END AS speedup FROM z""",
)
def tier_costs(t: Tables):
    tier = F.create_map(*[F.lit(x) for kv in (("signup", "high"), ("purchase", "medium"), ("click", "low"), ("error", "merge")) for x in kv])
    runs = t.table("events").select(
        (F.col("user_id") % 50).alias("model"),
        F.when(F.col("event_type") == "view", "single").otherwise("tiered").alias("arm"),
        tier[F.col("event_type")].alias("tier"),
        F.col("value").alias("wall_s"),
        F.floor(F.col("value") * 12345).alias("adapter_bytes"),
    )
    return costs.tier_costs(runs, ["model"], "single", "tiered")


# Every prediction takes the cosine of a pair of vectors; the last predictions have none.
_MEASURED_SQL = f"""{_COS_SQL}, measured AS (SELECT sc.*, CASE WHEN NOT pred_invalid THEN cosine END AS pred_gold_cosine
  FROM (SELECT x.*, conv_id + arm AS vec FROM scored x JOIN (SELECT eval_id, condition, conv_id, arm FROM v_pred) USING (eval_id, condition)) sc LEFT JOIN cos ON cos.vec_id = vec)"""


def _measured(t: Tables) -> DataFrame:
    cosines = scoring.cosine_pairs(t.vec).select("vec_id", "cosine")
    pairs = t.pred.select("eval_id", "condition", (F.col("conv_id") + F.col("arm")).alias("vec_id")).join(cosines, "vec_id")
    return scoring.add_cosines(scored(t), pairs)


_METRICS = ("exact_match", "token_f1", "pred_gold_cosine")
_MEANS_SQL = ", ".join(
    f"{s.r(f'avg({m})', 6)} AS {m}_mean, {s.r(f'avg({m}) FILTER (WHERE NOT gold_is_refusal)', 6)} AS answerable_{m}_mean, "
    f"{s.r(f'avg({m}) FILTER (WHERE gold_is_refusal)', 6)} AS refusal_{m}_mean"
    for m in _METRICS
)


@query(
    "score_summary_cosine",
    f"""WITH {_SCORED}, {_MEASURED_SQL} SELECT condition, count(*) AS n_rows, count(*) FILTER (WHERE pred_invalid) AS n_invalid_pred,
  count(*) FILTER (WHERE gold_is_refusal) AS n_refusal_gold, {_MEANS_SQL} FROM measured GROUP BY condition""",
)
def score_summary_cosine(t: Tables):
    return scoring.score_summary(_measured(t))


@query(
    "slice_metrics_cosine",
    f"""WITH {_SLICES_SQL}, {_MEASURED_SQL},
sc AS (SELECT sl.field AS field, sl.value AS value, f.condition AS condition, {s.r('avg(m.pred_gold_cosine)')} AS mean_pred_gold_cosine
  FROM facts f JOIN cls USING (eval_id) LEFT JOIN measured m ON m.eval_id = f.eval_id AND m.condition = f.condition GROUP BY 1, 2, 3)
SELECT * FROM sm JOIN sc USING (field, value, condition)""",
)
def slice_metrics_cosine(t: Tables):
    """Conditions are those of the ranked results."""
    return listwise.slice_metrics(slice_fields(t), t.rank, _measured(t), ["topic", "size"], "baseline_a")
