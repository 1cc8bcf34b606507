"""Queries for listwise ranking, win rates, slices and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qassay.functions import judging
from qassay.operators import bootstrap, categories, enrich, listwise, order_bootstrap, requests
from qassay.plans import sqltext as s
from qassay.plans.corpus import fill_sql
from qassay.plans.evaluation import _SCORED, scored
from qassay.plans.registry import query
from qassay.plans.views import ARMS, Tables

N_BOOT = 2000

# ---- tasks

_VALID = f"(SELECT eval_id, condition, {s.strip('pred')} AS pred FROM v_pred WHERE NOT ({s.invalid('pred')}))"
_TASKS_SQL = f"""tasks AS (SELECT q.eval_id, q.question, q.context, q.answer AS gold, list(p.condition ORDER BY p.condition) AS conditions, list(p.pred ORDER BY p.condition) AS preds
  FROM v_qa q JOIN {_VALID} p USING (eval_id) GROUP BY ALL HAVING count(*) >= 2)"""


def tasks(t: Tables, require_all: bool = False) -> DataFrame:
    questions = t.qa.select("eval_id", "question", "context", F.col("answer").alias("gold"))
    return listwise.listwise_tasks(questions, t.pred, ARMS, require_all=require_all)


@query(
    "listwise_tasks",
    f"""WITH {_TASKS_SQL} SELECT eval_id, array_to_string(conditions, ',') AS conditions, array_to_string(preds, '|') AS preds, len(preds) = 3 AS complete FROM tasks""",
)
def listwise_tasks(t: Tables):
    return tasks(t).select(
        "eval_id", F.array_join("conditions", ",").alias("conditions"), F.array_join("preds", "|").alias("preds"),
        (F.size("preds") == 3).alias("complete"),
    )


_LABELS_SQL = f"""{_TASKS_SQL},
flat AS (SELECT eval_id, unnest(conditions) AS condition, unnest(preds) AS pred FROM tasks),
labelled AS (SELECT *, chr(CAST(64 + row_number() OVER (PARTITION BY eval_id ORDER BY {s.hash_key(42, 'eval_id', 'condition')}) AS INT)) AS label FROM flat)"""


@query("listwise_labels", f"WITH {_LABELS_SQL} SELECT eval_id, label, condition, pred FROM labelled")
def listwise_labels(t: Tables):
    labelled = listwise.listwise_labels(tasks(t))
    entries = F.transform(
        "labels",
        lambda lab, i: F.struct(
            lab.alias("label"), F.try_element_at("label_to_condition", lab).alias("condition"), F.get("label_preds", i).alias("pred")
        ),
    )
    return labelled.select("eval_id", F.explode(entries).alias("_e")).select("eval_id", "_e.*")


@query(
    "listwise_requests",
    f"""WITH {_LABELS_SQL}, blocks AS (SELECT eval_id, count(*) AS n, string_agg('[' || label || ']' || chr(10) || pred,
  chr(10) || chr(10) ORDER BY label) AS candidates FROM labelled GROUP BY 1)
SELECT eval_id, md5(candidates) AS candidates_md5, md5({fill_sql(requests.LISTWISE_TEMPLATE, context='context', question='question', gold='gold', candidates='candidates', n='n')}) AS prompt_md5
FROM blocks JOIN tasks USING (eval_id)""",
)
def listwise_requests(t: Tables):
    return requests.listwise_requests(listwise.listwise_labels(tasks(t))).select(
        "eval_id", F.md5("candidates").alias("candidates_md5"), F.md5("prompt").alias("prompt_md5")
    )


# ---- points and win rates

_OK_RANK = "(SELECT * FROM v_rank WHERE error IS NULL)"


@query("rank_points", "SELECT eval_id, condition, max(rank_value) OVER (PARTITION BY eval_id) + 1 - rank_value AS points FROM v_rank")
def rank_points(t: Tables):
    return t.rank.select(
        "eval_id", "n_candidates", F.explode("ranks_by_condition").alias("condition", "rank_value")
    ).select("eval_id", "condition", judging.rank_to_points(F.col("rank_value"), F.col("n_candidates")).cast("double").alias("points"))


_POINTS = f"""SELECT condition, count(*) AS n_ranked, sum(points) AS sum_points, {s.r('avg(points)')} AS mean_points,
  (SELECT count(DISTINCT eval_id) FROM {_OK_RANK}) AS n_questions_ok, (SELECT count(DISTINCT eval_id) FROM v_rank WHERE error IS NOT NULL) AS n_questions_error
FROM {_OK_RANK} GROUP BY 1"""


@query("listwise_points", _POINTS)
def listwise_points(t: Tables):
    return listwise.listwise_points(t.rank)


@query("leaderboard_listwise", f"SELECT *, row_number() OVER (ORDER BY mean_points DESC, condition) AS rank FROM ({_POINTS})")
def leaderboard_listwise(t: Tables):
    return listwise.listwise_leaderboard(listwise_points(t))


@query("condition_names", f"SELECT DISTINCT condition FROM {_OK_RANK}")
def condition_names(t: Tables):
    return listwise.condition_names(t.rank)


_OUTCOMES = f"""o AS (SELECT c.eval_id, c.condition, CASE WHEN c.rank_value < b.rank_value THEN 1.0::DOUBLE WHEN c.rank_value > b.rank_value THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS outcome
  FROM {_OK_RANK} c JOIN {_OK_RANK} b USING (eval_id) WHERE b.condition = 'baseline_a' AND c.condition <> 'baseline_a')"""
_WINS = "count(*) FILTER (WHERE outcome = 1) AS wins, count(*) FILTER (WHERE outcome = 0) AS losses, count(*) FILTER (WHERE outcome = 0.5) AS ties"


@query(
    "win_rate",
    f"""WITH {_OUTCOMES} SELECT condition, count(*) AS n, {_WINS}, {s.r('count(*) FILTER (WHERE outcome = 1) / count(*)')} AS win_rate,
  {s.r('count(*) FILTER (WHERE outcome = 0) / count(*)')} AS loss_rate, {s.r('count(*) FILTER (WHERE outcome = 0.5) / count(*)')} AS tie_rate FROM o GROUP BY 1""",
)
def win_rate(t: Tables):
    return listwise.win_rate(t.rank, "baseline_a")


def _second_pass(t: Tables) -> DataFrame:
    """The other presentation order: baseline_a and candidate swap places in every second question."""
    swap = F.col("conv_id") % 2 == 0

    def swapped(col: str):
        m = F.col(col)
        other = F.transform_keys(
            m, lambda k, v: F.when(k == "candidate", "baseline_a").when(k == "baseline_a", "candidate").otherwise(k)
        )
        return F.when(swap, other).otherwise(m)

    return t.rank.withColumn("ranks_by_condition", swapped("ranks_by_condition")).withColumn(
        "points_by_condition", swapped("points_by_condition")
    )


@query(
    "swap_merge_ranks",
    f"""WITH second AS (SELECT eval_id, CASE WHEN conv_id % 2 <> 0 THEN condition WHEN condition = 'candidate' THEN 'baseline_a' WHEN condition = 'baseline_a' THEN 'candidate' ELSE condition END AS condition,
  rank_value, points FROM {_OK_RANK})
SELECT eval_id, condition, (a.rank_value + b.rank_value) / 2 AS mean_rank, (a.points + b.points) / 2 AS mean_points FROM {_OK_RANK} a JOIN second b USING (eval_id, condition)""",
)
def swap_merge_ranks(t: Tables):
    """Some questions stand twice in the first pass."""
    first = t.rank.withColumn("ord", F.col("conv_id") * 2)
    # Every fifth question is ranked once more before, with the arms the other way round: the later ranking counts.
    redone = _second_pass(t).withColumn("ord", F.col("conv_id") * 2 - 1).filter(F.col("conv_id") % 5 == 0)
    return listwise.swap_merge_ranks(first.unionByName(redone), _second_pass(t).withColumn("ord", F.col("conv_id")))


# ---- slices

_SLICES_SQL = f"""{_SCORED},
cls AS (SELECT eval_id, unnest([{{'field': 'topic', 'value': document_topic}}, {{'field': 'size', 'value': CASE WHEN length(answer) < 300 THEN 'short' WHEN length(answer) < 900 THEN 'mid' ELSE 'unknown' END}}]) AS sl FROM v_qa),
r AS (SELECT eval_id, condition, points, rank_value FROM v_rank WHERE error IS NULL),
grid AS (SELECT q.eval_id, a.condition FROM (SELECT DISTINCT eval_id FROM r) q, (SELECT unnest(['candidate', 'baseline_a', 'baseline_b']) AS condition) a),
facts AS (SELECT g.eval_id, g.condition, r.points, sc.token_f1, sc.exact_match,
  CASE WHEN g.condition <> 'baseline_a' THEN CASE WHEN r.rank_value < b.rank_value THEN 1.0::DOUBLE WHEN r.rank_value > b.rank_value THEN 0.0::DOUBLE WHEN r.rank_value = b.rank_value THEN 0.5::DOUBLE END END AS outcome
  FROM grid g LEFT JOIN r ON r.eval_id = g.eval_id AND r.condition = g.condition LEFT JOIN r b ON b.eval_id = g.eval_id AND b.condition = 'baseline_a'
  LEFT JOIN scored sc ON sc.eval_id = g.eval_id AND sc.condition = g.condition),
sm AS (SELECT sl.field AS field, sl.value AS value, condition, count(*) AS n_questions, {s.r('avg(points)')} AS mean_points, {s.r('avg(token_f1)')} AS mean_token_f1,
  {s.r('avg(exact_match)')} AS mean_exact_match, {_WINS}, {s.r('count(*) FILTER (WHERE outcome = 1) / nullif(count(outcome), 0)')} AS win_rate FROM facts JOIN cls USING (eval_id) GROUP BY 1, 2, 3)"""


def slice_fields(t: Tables) -> DataFrame:
    n = F.length("answer")
    return t.qa.select(
        "eval_id", F.col("document_topic").alias("topic"), F.when(n < 300, "short").when(n < 900, "mid").otherwise(" ").alias("size")
    )


def _slices(t: Tables) -> DataFrame:
    return listwise.slice_metrics(slice_fields(t), t.rank, scored(t), ["topic", "size"], "baseline_a", ARMS)


@query("slice_metrics", f"WITH {_SLICES_SQL} SELECT * FROM sm")
def slice_metrics(t: Tables):
    return _slices(t)


@query(
    "slice_leaderboard",
    f"""WITH {_SLICES_SQL} SELECT field, value, condition, mean_points, row_number() OVER (PARTITION BY field, value ORDER BY mean_points DESC, condition) AS rank
FROM sm WHERE mean_points IS NOT NULL""",
)
def slice_leaderboard(t: Tables):
    return listwise.slice_leaderboard(_slices(t))


_CATS = """cats AS (SELECT eval_id, document_topic AS topic, CASE WHEN conv_id % 31 = 0 THEN '__error__' WHEN turn % 4 = 0 THEN 'low' WHEN conv_id % 3 = 0 THEN 'high' ELSE 'medium' END AS gain FROM v_qa)"""


def _categories(t: Tables) -> DataFrame:
    gain = (
        F.when(F.col("conv_id") % 31 == 0, "__error__").when(F.col("turn") % 4 == 0, "low").when(F.col("conv_id") % 3 == 0, "high")
        .otherwise("medium")
    )
    return t.qa.select("eval_id", F.col("document_topic").alias("topic"), gain.alias("gain"))


@query(
    "category_counts",
    f"WITH {_CATS} SELECT field, value, count(*) AS n_rows FROM (SELECT 'topic' AS field, topic AS value FROM cats UNION ALL SELECT 'gain', gain FROM cats) GROUP BY 1, 2",
)
def category_counts(t: Tables):
    return categories.category_counts(_categories(t), ["topic", "gain"])


@query("cross_tab", f"WITH {_CATS} SELECT topic, gain, count(*) AS n_rows FROM cats GROUP BY 1, 2")
def cross_tab(t: Tables):
    return categories.cross_tab(_categories(t), "topic", "gain")


@query(
    "category_counts_errors",
    """WITH c AS (SELECT CASE WHEN turn % 4 <> 1 THEN topic END AS topic, CASE WHEN gain = 'low' THEN 'classifier_timeout' WHEN gain <> '__error__' THEN gain END AS gain, turn % 3 = 0 AS failed
  FROM (SELECT q.turn, cats.* FROM cats JOIN v_qa q USING (eval_id))), l AS (SELECT 'topic' AS field, topic AS v, failed FROM c UNION ALL SELECT 'gain', gain, failed FROM c)
SELECT field, CASE WHEN v NOT LIKE 'classifier_%' THEN v ELSE '__error__' END AS value, count(*) AS n_rows FROM l WHERE v NOT LIKE 'classifier_%' OR failed GROUP BY 1, 2""".replace("WITH c AS", f"WITH {_CATS}, c AS"),
)
def category_counts_errors(t: Tables):
    """Missing labels and classifier faults, some with the mark of a failed classifier."""
    turn = t.qa.select("eval_id", "turn")
    rows = _categories(t).join(turn, "eval_id").select(
        F.when(F.col("turn") % 4 != 1, F.col("topic")).alias("topic"),
        F.when(F.col("gain") == "low", "classifier_timeout").when(F.col("gain") != "__error__", F.col("gain")).alias("gain"),
        (F.col("turn") % 3 == 0).alias("failed"),
    )
    return categories.category_counts(rows, ["topic", "gain"], "failed")


@query(
    "candidate_beats",
    f"""WITH w AS (SELECT eval_id, any_value(question) AS question, any_value(gold) AS gold, max(pred) FILTER (WHERE condition = 'candidate') AS candidate_answer,
  max(pred) FILTER (WHERE condition = 'baseline_a') AS baseline_answer FROM v_pred GROUP BY 1)
SELECT w.* FROM w JOIN {_OK_RANK} c ON c.eval_id = w.eval_id AND c.condition = 'candidate' JOIN {_OK_RANK} b ON b.eval_id = w.eval_id AND b.condition = 'baseline_a'
WHERE c.rank_value < b.rank_value""",
)
def candidate_beats(t: Tables):
    from qassay.operators.enrich import align_arms

    arms = align_arms(t.pred, ["candidate", "baseline_a"], ["question", "gold", "pred"])
    wide = arms.filter("candidate IS NOT NULL AND baseline_a IS NOT NULL").select(
        "eval_id", "candidate.question", "candidate.gold", F.col("candidate.pred").alias("candidate_answer"),
        F.col("baseline_a.pred").alias("baseline_answer"),
    )
    return listwise.candidate_beats(t.rank, wide, "candidate", "baseline_a")


# ---- bootstrap


def _interval(ci: DataFrame, values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n and point, and whether the interval lies where the normal approximation puts it."""
    v = F.col(value).cast("double")
    wide = values.filter(v.isNotNull()).groupBy(*keys).agg(F.avg(v).alias("_m"), (F.stddev_pop(v) / F.sqrt(F.count(v))).alias("_se"))
    slack = 0.5 * F.col("_se") + 1 / F.col("n")
    fits = (F.abs(F.col("ci_low") - F.col("_m") + 1.96 * F.col("_se")) <= slack) & (F.abs(F.col("ci_high") - F.col("_m") - 1.96 * F.col("_se")) <= slack)
    return ci.join(wide, keys).select(*[c for c in ci.columns if c not in ("ci_low", "ci_high", "excludes_zero")], F.bround("_se", 4).alias("se"), fits.alias("fits"))


def _boot_sql(values: str, keys: str) -> str:
    """Sizes, means, standard errors of a relation (keys, v); random intervals are held against them."""
    return f"""vals AS ({values}),
ci AS (SELECT {keys}, count(*) AS n, {s.r('avg(v)')} AS point, {s.r('stddev_pop(v) / sqrt(count(*))')} AS se, TRUE AS fits FROM vals GROUP BY {keys})"""


@query(
    "bootstrap_mean",
    f"WITH {_boot_sql('SELECT condition, gold_alignment AS v FROM v_pred WHERE gold_alignment IS NOT NULL', 'condition')} SELECT * FROM ci",
)
def bootstrap_mean(t: Tables):
    return _interval(bootstrap.bootstrap_mean(t.pred, "gold_alignment", ["condition"], n_boot=N_BOOT), t.pred, ["condition"], "gold_alignment")


@query(
    "bootstrap_mean_counts",
    f"WITH {_boot_sql('SELECT condition, gold_alignment AS v FROM v_pred WHERE gold_alignment IS NOT NULL', 'condition')} SELECT * FROM ci",
)
def bootstrap_mean_counts(t: Tables):
    """The same interval with the default number of replicas."""
    return _interval(bootstrap.bootstrap_mean(t.pred, "gold_alignment", ["condition"]), t.pred, ["condition"], "gold_alignment")


@query(
    "bootstrap_share",
    f"""SELECT condition, count(*) AS n, {s.r('avg(CASE WHEN gold_alignment >= 3 THEN 1.0 ELSE 0.0 END)')} AS point, TRUE AS inside FROM v_pred WHERE gold_alignment IS NOT NULL GROUP BY 1""",
)
def bootstrap_share(t: Tables):
    """Another statistic than the mean."""
    ci = bootstrap.bootstrap_statistic(t.pred, "gold_alignment", ["condition"], n_boot=N_BOOT, statistic=bootstrap.share_at_least(3))
    return ci.select("condition", "n", "point", F.col("point").between(F.col("ci_low"), F.col("ci_high")).alias("inside"))


_PAIRS = [("candidate", "baseline_a"), ("candidate", "baseline_b"), ("baseline_b", "baseline_a")]


def _pairs(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(_PAIRS, "challenger string, baseline string")


_DELTAS = """SELECT c.condition AS challenger, b.condition AS baseline, c.gold_alignment AS c_value, b.gold_alignment AS b_value, c.gold_alignment - b.gold_alignment AS v
FROM v_pred c JOIN v_pred b USING (eval_id) WHERE c.gold_alignment IS NOT NULL AND b.gold_alignment IS NOT NULL
  AND (c.condition, b.condition) IN ({pairs})"""
_ALL_PAIRS = _DELTAS.format(pairs="('candidate', 'baseline_a'), ('candidate', 'baseline_b'), ('baseline_b', 'baseline_a')")


@query(
    "bootstrap_paired",
    f"""WITH {_boot_sql(_ALL_PAIRS, 'challenger, baseline')} SELECT ci.*, {s.r('cm')} AS challenger_mean, {s.r('bm')} AS baseline_mean
FROM ci JOIN (SELECT challenger, baseline, avg(c_value) AS cm, avg(b_value) AS bm FROM vals GROUP BY 1, 2) USING (challenger, baseline)""",
)
def bootstrap_paired(t: Tables):
    ci = bootstrap.bootstrap_paired(t.pred, _pairs(t), "gold_alignment", n_boot=N_BOOT)
    return _interval(ci, bootstrap.pair_deltas(t.pred, _pairs(t), "gold_alignment"), ["challenger", "baseline"], "delta")


@query(
    "bootstrap_win_rate",
    f"""WITH {_OUTCOMES}, {_boot_sql('SELECT condition, outcome AS v FROM o', 'condition')}
SELECT ci.*, wins, losses, ties FROM ci JOIN (SELECT condition, {_WINS} FROM o GROUP BY 1) USING (condition)""",
)
def bootstrap_win_rate(t: Tables):
    outcomes = listwise.outcomes(t.rank, "baseline_a")
    return _interval(bootstrap.bootstrap_outcomes(outcomes, n_boot=N_BOOT), outcomes, ["condition"], "outcome")


def _quantile_interval(ci: DataFrame, values: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """n and point, and whether the ends of the interval stand at the places of the sorted values where the binomial law puts them."""
    v, sd = F.col(value).cast("double"), F.sqrt(F.col("n") * q * (1 - q))
    placed = values.filter(v.isNotNull()).join(F.broadcast(ci), keys).groupBy(*keys, "n", "point").agg(*[
        F.count_if(test).alias(name) for name, test in (
            ("low_from", v < F.col("ci_low") - 1e-4), ("low_to", v <= F.col("ci_low") + 1e-4), ("high_from", v < F.col("ci_high") - 1e-4), ("high_to", v <= F.col("ci_high") + 1e-4))
    ])
    # A quarter of the standard deviation, and three places, as few values repeat a lot and neighbours are interpolated.
    slack = 0.25 * sd + 3
    middle = F.col("n") * ((F.col("n") - 1) * q + 1) / (F.col("n") + 1)
    low, high = middle - 1.96 * sd, middle + 1.96 * sd
    fits = (F.col("low_from") <= low + slack) & (F.col("low_to") >= low - slack) & (F.col("high_from") <= high + slack) & (F.col("high_to") >= high - slack)
    return placed.select(*keys, "n", "point", fits.alias("fits"))


@query(
    "bootstrap_median",
    f"SELECT l_returnflag, count(*) AS n, {s.r('quantile_cont(l_extendedprice::DOUBLE, 0.5)')} AS point, TRUE AS fits FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1",
)
def bootstrap_median(t: Tables):
    """The median of a column with very many distinct values."""
    rows = t.table("lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("price"))
    return _quantile_interval(order_bootstrap.bootstrap_median(rows, "price", ["l_returnflag"]), rows, ["l_returnflag"], "price", 0.5)


@query(
    "bootstrap_p90",
    f"SELECT condition, count(*) AS n, {s.r('quantile_cont(gold_alignment::DOUBLE, 0.9)')} AS point, TRUE AS fits FROM v_pred WHERE gold_alignment IS NOT NULL GROUP BY 1",
)
def bootstrap_p90(t: Tables):
    ci = order_bootstrap.bootstrap_quantile(t.pred, "gold_alignment", ["condition"], q=0.9, n_boot=N_BOOT)
    return _quantile_interval(ci, t.pred, ["condition"], "gold_alignment", 0.9)


@query(
    "bootstrap_median_paired",
    f"WITH vals AS ({_ALL_PAIRS}) SELECT challenger, baseline, count(*) AS n, {s.r('quantile_cont(v::DOUBLE, 0.5)')} AS point, TRUE AS fits FROM vals GROUP BY 1, 2",
)
def bootstrap_median_paired(t: Tables):
    keys = ["challenger", "baseline"]
    ci = order_bootstrap.bootstrap_quantile_paired(t.pred, _pairs(t), "gold_alignment", n_boot=N_BOOT)
    return _quantile_interval(ci, bootstrap.pair_deltas(t.pred, _pairs(t), "gold_alignment"), keys, "delta", 0.5)


_MATCHED = _DELTAS.format(
    pairs="SELECT 'candidate', condition FROM v_pred WHERE condition <> 'candidate' AND gold_alignment IS NOT NULL GROUP BY 2 ORDER BY avg(gold_alignment) DESC, condition LIMIT 1"
)


@query(
    "bootstrap_leaderboard",
    f"""WITH {_boot_sql(f'''SELECT 'arm' AS kind, condition AS name, gold_alignment AS v FROM v_pred WHERE gold_alignment IS NOT NULL
UNION ALL SELECT 'pair', challenger || '_vs_' || baseline, v FROM ({_MATCHED})''', 'kind, name')} SELECT * FROM ci""",
)
def bootstrap_leaderboard(t: Tables):
    """Pairs come from the arms themselves: the candidate meets the best baseline of its family."""
    role = F.when(F.col("condition") == "candidate", "candidate").otherwise("baseline").alias("role")
    place = (-F.avg("gold_alignment")).alias("place")
    pairs = enrich.match_baselines(t.pred.groupBy("condition", role).agg(place).filter("place IS NOT NULL"), order=["place", "condition"])
    values = bootstrap.leaderboard_values(t.pred, pairs, "gold_alignment")
    return _interval(bootstrap.bootstrap_leaderboard(t.pred, pairs, "gold_alignment", n_boot=N_BOOT), values, ["kind", "name"], "_v")
