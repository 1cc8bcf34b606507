"""Queries that score predictions and judged rows, and the joins around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from qassay import constants as C
from qassay.functions import judging
from qassay.functions.metrics import token_f1
from qassay.operators import agreement, enrich, judged, scoring
from qassay.plans import sqltext as s
from qassay.plans.corpus import _STARTER, answer_type_sql, with_leads, _lead
from qassay.plans.registry import query
from qassay.plans.views import ARMS, Tables, h, h_sql

# ---- scores

_SCORED = f"""tok AS (SELECT *, {s.tokens('pred')} AS p, {s.tokens('gold')} AS g FROM v_pred),
scored AS (SELECT eval_id, condition, {s.invalid('pred')} AS pred_invalid, {s.refusal_gold('gold')} AS gold_is_refusal,
  CASE WHEN NOT ({s.invalid('pred')}) AND {s.norm('pred')} = {s.norm('gold')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact_match,
  CASE WHEN {s.invalid('pred')} THEN 0.0::DOUBLE ELSE {s.f1('p', 'g')} END AS token_f1 FROM tok)"""


def scored(t: Tables):
    return scoring.score_predictions(t.pred)


@query("exact_match", f"SELECT eval_id, condition, {s.norm('pred')} = {s.norm('gold')} AS em FROM v_pred")
def exact_match(t: Tables):
    from qassay.functions.metrics import exact_match as em

    return t.pred.select("eval_id", "condition", em(F.col("pred"), F.col("gold")).alias("em"))


@query(
    "token_f1",
    f"SELECT eval_id, condition, {s.r(s.f1('p', 'g'), 6)} AS token_f1 FROM (SELECT *, {s.tokens('pred')} AS p, {s.tokens('gold')} AS g FROM v_pred)",
)
def token_f1_rows(t: Tables):
    return t.pred.select("eval_id", "condition", F.bround(token_f1(F.col("pred"), F.col("gold")), 6).alias("token_f1"))


@query(
    "token_f1_long",
    f"""SELECT eval_id, condition, {s.r(f"CASE WHEN {s.invalid('pred')} THEN 0.0 ELSE {s.f1('p', 'g')} END", 6)} AS token_f1
FROM (SELECT *, {s.tokens('pred')} AS p, {s.tokens('gold')} AS g FROM v_pred)""",
)
def token_f1_long(t: Tables):
    rows = scoring.score_long_predictions(t.pred.select("eval_id", "condition", "pred", "gold"), ["eval_id", "condition"])
    return rows.withColumn("token_f1", F.bround("token_f1", 6))


_SUMMARY_COLS = ", ".join(
    f"{s.r(f'avg({m})', 6)} AS {m}_mean, {s.r(f'avg({m}) FILTER (WHERE NOT gold_is_refusal)', 6)} AS answerable_{m}_mean, "
    f"{s.r(f'avg({m}) FILTER (WHERE gold_is_refusal)', 6)} AS refusal_{m}_mean"
    for m in ("exact_match", "token_f1")
)
_SUMMARY = f"""SELECT condition, count(*) AS n_rows, count(*) FILTER (WHERE pred_invalid) AS n_invalid_pred,
  count(*) FILTER (WHERE gold_is_refusal) AS n_refusal_gold, {_SUMMARY_COLS} FROM scored GROUP BY condition"""


@query("score_summary", f"WITH {_SCORED} {_SUMMARY}")
def score_summary(t: Tables):
    return scoring.score_summary(scored(t))


@query(
    "leaderboard_scores",
    f"""WITH {_SCORED} SELECT *, row_number() OVER (ORDER BY token_f1_mean DESC, exact_match_mean DESC, condition DESC) AS rank FROM ({_SUMMARY})""",
)
def leaderboard_scores(t: Tables):
    return scoring.leaderboard(score_summary(t), ["token_f1_mean", "exact_match_mean"], "token_f1_mean")


def _multi_pred(t: Tables):
    """Candidate predictions against every line of the answer."""
    answers = F.transform("answers.text", lambda x: F.struct(x.alias("text"), F.lit("span").alias("type")))
    golds = t.multi.select(F.col("id").alias("eval_id"), answers.alias("answers"))
    return t.pred.select("eval_id", "condition", "pred", "gold").join(golds, "eval_id")


_MULTI_SQL = f"""g AS (SELECT eval_id, list_filter(list_transform(texts, lambda x: {s.strip('x')}), lambda x: x <> '') AS texts FROM v_multi),
j AS (SELECT p.eval_id, p.condition, p.pred, CASE WHEN len(g.texts) > 0 THEN g.texts ELSE [{s.strip('p.gold')}] END AS golds FROM v_pred p JOIN g USING (eval_id)),
x AS (SELECT eval_id, condition, pred, gold, {s.tokens('pred')} AS p, {s.tokens('gold')} AS g FROM (SELECT *, unnest(golds) AS gold FROM j)),
best AS (SELECT eval_id, condition, any_value({s.invalid('pred')}) AS pred_invalid, max(CASE WHEN {s.norm('pred')} = {s.norm('gold')} THEN 1 ELSE 0 END) AS exact_match,
  max({s.f1('p', 'g')}) AS token_f1 FROM x GROUP BY 1, 2)"""


@query("multi_gold_em_f1", f"WITH {_MULTI_SQL} SELECT eval_id, condition, exact_match, {s.r('token_f1', 6)} AS token_f1 FROM best")
def multi_gold_em_f1(t: Tables):
    return scoring.score_multi_gold(_multi_pred(t)).select(
        "eval_id", "condition", "exact_match", F.bround("token_f1", 6).alias("token_f1")
    )


@query(
    "multi_gold_summary",
    f"""WITH {_MULTI_SQL} SELECT condition, count(*) AS n_rows, count(*) FILTER (WHERE pred_invalid) AS n_invalid_pred,
  {s.r('avg(exact_match)', 6)} AS exact_match, {s.r('avg(token_f1)', 6)} AS token_f1 FROM best GROUP BY 1""",
)
def multi_gold_summary(t: Tables):
    return scoring.multi_gold_summary(scoring.score_multi_gold(_multi_pred(t)))


# ---- refusal functions


@query("refusal_gold", f"SELECT eval_id, condition, {s.refusal_gold('gold')} AS gold_is_refusal FROM v_pred")
def refusal_gold(t: Tables):
    return t.pred.select("eval_id", "condition", judging.is_refusal_gold(F.col("gold")).alias("gold_is_refusal"))


@query(
    "refusal_class",
    f"""SELECT eval_id, condition, cls AS refusal_class, {s.invented('cls')} AS invented, {s.refusing('cls')} AS refusal_like
FROM (SELECT *, {s.refusal_class('pred')} AS cls FROM v_pred)""",
)
def refusal_class(t: Tables):
    return t.pred.withColumn("refusal_class", judging.refusal_class(F.col("pred"))).select(
        "eval_id", "condition", "refusal_class", judging.is_invented(F.col("refusal_class")).alias("invented"),
        judging.is_refusal_like(F.col("refusal_class")).alias("refusal_like"),
    )


_HALL = f"(coalesce(gold_alignment, 0) <= 2 OR ({s.refusal_gold('gold')} AND {s.invented(s.refusal_class('pred'))}))"
_RIGHT_REFUSAL = f"({s.refusal_gold('gold')} AND {s.refusing(s.refusal_class('pred'))} AND coalesce(gold_alignment, 0) >= 4)"


@query("hallucination_flags", f"SELECT eval_id, condition, {_HALL} AS hallucination, {_RIGHT_REFUSAL} AS correct_refusal FROM v_pred")
def hallucination_flags(t: Tables):
    cols = (F.col("gold"), F.col("pred"), F.col("gold_alignment"))
    return t.pred.select(
        "eval_id", "condition", judging.is_hallucination(*cols).alias("hallucination"),
        judging.is_correct_refusal(*cols).alias("correct_refusal"),
    )


# ---- judged rows


@query(
    "quality_tier",
    f"SELECT eval_id, condition, {s.tier('pred', 'grounding', 'relevance', 'document_necessity', 'overall')} AS tier FROM v_pred",
)
def quality_tier(t: Tables):
    dims = [F.col(d) for d in C.JUDGE_DIMENSIONS]
    return t.pred.select("eval_id", "condition", judging.quality_tier(F.col("pred"), *dims).alias("tier"))


_STATS_COLS = f"""count(*) AS n_rows, count(*) FILTER (WHERE NOT skipped AND error IS NULL) AS n_judged_ok, count(*) FILTER (WHERE skipped) AS n_skipped_nan,
  count(*) FILTER (WHERE NOT skipped AND error = 'parse_error') AS n_parse_error,
  count(*) FILTER (WHERE NOT skipped AND error = '{C.MISSING_FIELDS_ERROR}') AS n_missing_fields,
  count(*) FILTER (WHERE NOT skipped AND error NOT IN ('parse_error', '{C.MISSING_FIELDS_ERROR}')) AS n_api_error,
  count(*) FILTER (WHERE NOT skipped AND quality_tier = 'high') AS n_high, count(*) FILTER (WHERE NOT skipped AND quality_tier = 'medium') AS n_medium,
  count(*) FILTER (WHERE NOT skipped AND quality_tier = 'low') AS n_low, count(*) FILTER (WHERE skipped OR quality_tier = 'drop') AS n_drop,
  count(*) FILTER (WHERE NOT skipped AND error IS NOT NULL) AS n_error, """ + ", ".join(
    f"{s.r(f'avg({d}) FILTER (WHERE NOT skipped AND error IS NULL)')} AS mean_{d}" for d in C.EVAL_DIMENSIONS
)


@query("judge_stats", f"SELECT document_topic, {_STATS_COLS} FROM v_judged GROUP BY 1")
def judge_stats(t: Tables):
    return judged.judge_stats(t.judged, "document_topic")


@query(
    "leaderboard_judge",
    f"""SELECT *, row_number() OVER (ORDER BY coalesce(mean_gold_alignment, 0) DESC, coalesce(mean_overall, 0) DESC, coalesce(mean_grounding, 0) DESC, document_topic DESC) AS rank
FROM (SELECT document_topic, count(*) FILTER (WHERE NOT skipped AND error IS NULL) AS n_judged_ok, {", ".join(
    f"{s.r(f'avg({d}) FILTER (WHERE NOT skipped AND error IS NULL)')} AS mean_{d}" for d in ("gold_alignment", "overall", "grounding"))}
FROM v_judged GROUP BY 1)""",
)
def leaderboard_judge(t: Tables):
    metrics = ["mean_gold_alignment", "mean_overall", "mean_grounding"]
    table = judge_stats(t).select("document_topic", "n_judged_ok", *metrics)
    return scoring.leaderboard(table, metrics, "mean_gold_alignment", name="document_topic")


def _median_sql(x: str) -> str:
    return f"list_sort(list({x}))[count(*) // 2 + 1]"


_PROFILE = ", ".join(
    f"{s.r(f'avg({c}_words)', 1)} AS mean_{c}_words, {_median_sql(f'{c}_words')} AS median_{c}_words" for c in ("question", "answer", "context")
)


@query(
    "tier_profile",
    f"""SELECT tier, count(*) AS n, {_PROFILE}, {", ".join(f"{s.r(f'avg({d})', 2)} AS mean_{d}" for d in C.JUDGE_DIMENSIONS)},
  {s.r('100.0 * count(*) / sum(count(*)) OVER ()', 1)} AS pct_of_pool, {s.r('100.0 * count(*) FILTER (WHERE refusal) / count(*)', 1)} AS refusal_gold_pct
FROM (SELECT *, coalesce(quality_tier, 'missing') AS tier, {s.refusal_gold('answer')} AS refusal, {s.word_count('question')} AS question_words,
  {s.word_count('answer')} AS answer_words, {s.word_count('context')} AS context_words FROM v_judged) GROUP BY tier""",
)
def tier_profile(t: Tables):
    return judged.tier_profile(t.judged)


def _shares_sql(label: str, rel: str, n: int) -> str:
    return f"""SELECT * FROM (SELECT tier, label, n_rows, {s.r('100.0 * n_rows / sum(n_rows) OVER (PARTITION BY tier)', 1)} AS pct,
  row_number() OVER (PARTITION BY tier ORDER BY n_rows DESC, label) AS rank
FROM (SELECT coalesce(quality_tier, 'missing') AS tier, {label} AS label, count(*) AS n_rows FROM {rel} GROUP BY 1, 2)) WHERE rank <= {n}"""


@query("tier_answer_types", _shares_sql(answer_type_sql("answer", "refuse_expected"), "v_judged", 6))
def tier_answer_types(t: Tables):
    return judged.tier_answer_types(t.judged)


@query(
    "tier_starters",
    _shares_sql(
        _STARTER,
        f"""(SELECT quality_tier, lower({s.strip('x')}) AS q, regexp_extract(lower({s.strip('x')}), '^([\\p{{L}}\\p{{N}}_]+)', 1) AS f
  FROM (SELECT quality_tier, {_lead()} AS x FROM v_judged))""",
        10,
    ),
)
def tier_starters(t: Tables):
    return judged.tier_starters(with_leads(t.judged))


@query("tier_topics", _shares_sql("document_topic", "v_judged", 5))
def tier_topics(t: Tables):
    return judged.tier_topics(t.judged)


@query(
    "tier_weights",
    f"""SELECT quality_tier AS tier, count(*) AS n_rows, {s.r('count(*) / sum(count(*)) OVER ()', 6)} AS weight
FROM v_judged WHERE quality_tier IN ('high', 'medium', 'low') GROUP BY 1""",
)
def tier_weights(t: Tables):
    return judged.tier_weights(t.judged)


@query("source_counts", "SELECT source, quality_tier, count(*) AS n_rows FROM (SELECT source, coalesce(quality_tier, 'missing') AS quality_tier FROM v_judged) GROUP BY 1, 2")
def source_counts(t: Tables):
    return t.judged.groupBy("source", judged.tier_label().alias("quality_tier")).agg(F.count(F.lit(1)).alias("n_rows"))


# ---- joins


@query(
    "eval_index",
    "SELECT document_topic AS row_key, max(ord) AS ord FROM v_docs GROUP BY 1",
)
def eval_index(t: Tables):
    rows = t.docs.select(F.lit(" ").alias("eval_id"), F.col("document_topic").alias("chunk_id"), "ord")
    return enrich.eval_index(rows).select("row_key", "ord")


def _gaps(t: Tables):
    """Predictions that lost their context on even conversations and their gold on every third."""
    conv = F.col("conv_id")
    return t.pred.select(
        "eval_id", "condition", "conv_id", "turn", "question",
        F.when(conv % 2 == 0, " ").otherwise(F.lit("own context")).alias("context"),
        F.when(conv % 3 != 0, F.col("gold")).alias("gold"),
    )


@query(
    "enrich_context",
    f"""SELECT eval_id, condition, CASE WHEN conv_id % 2 = 0 THEN md5({s.strip('q.context')}) ELSE md5('own context') END AS context_md5,
  CASE WHEN p.conv_id % 3 <> 0 THEN p.gold ELSE {s.strip('q.answer')} END AS gold, p.conv_id % 2 = 0 AS context_filled
FROM v_pred p JOIN (SELECT eval_id, context, answer FROM v_qa) q USING (eval_id)""",
)
def enrich_context(t: Tables):
    index = enrich.eval_index(t.qa.withColumn("gold", F.lit(" ")))
    return enrich.enrich_context(_gaps(t), index).select(
        "eval_id", "condition", F.md5("context").alias("context_md5"), "gold", "context_filled"
    )


@query(
    "enrich_multi_answer",
    f"""WITH m AS (SELECT eval_id, context, question, CASE WHEN len(texts) = 0 THEN {s.quote(C.REFUSAL_GOLD)} ELSE coalesce((SELECT {s.strip('x')} FROM
  (SELECT unnest(texts) AS x, generate_subscripts(texts, 1) AS i) WHERE {s.strip('x')} <> '' GROUP BY {s.strip('x')} ORDER BY count(*) DESC, min(i) LIMIT 1), '') END AS mode,
  len(texts) AS n FROM v_multi)
SELECT eval_id, condition, CASE WHEN conv_id % 2 = 0 THEN md5({s.strip('m.context')}) ELSE md5('own context') END AS context_md5,
  CASE WHEN p.conv_id % 3 <> 0 THEN p.gold ELSE m.mode END AS gold, m.n AS n_answers FROM v_pred p JOIN m USING (eval_id)""",
)
def enrich_multi_answer(t: Tables):
    answers = F.transform("answers.text", lambda x: F.struct(x.alias("text"), F.lit("span").alias("type")))
    index = enrich.eval_index(
        t.multi.select(
            F.col("id").alias("eval_id"), "context", "question", answers.alias("answers"), "ord",
            F.lit(False).alias("unanswerable"), F.lit("").alias("gold"),
        )
    )
    rows = _gaps(t).withColumn("answers", F.lit(None).cast("array<struct<text:string,type:string>>"))
    return enrich.enrich_multi_answer(rows, index).select(
        "eval_id", "condition", F.md5("context").alias("context_md5"), "gold", F.size("answers").alias("n_answers")
    )


_PREVIOUS = f"(SELECT * FROM v_judged WHERE {h_sql('conv_id', 'turn', 3)} <> 0)"
_USABLE_JUDGE = "(skipped OR (error IS NULL AND overall IS NOT NULL))"


def _previous(t: Tables):
    """An earlier run that judged two thirds of the rows."""
    return t.judged.filter(h(F.col("conv_id"), F.col("turn"), 3) != 0)


@query(
    "resume_reuse",
    f"""SELECT q.eval_id, j.eval_id IS NOT NULL AS reused, j.quality_tier FROM v_qa q
LEFT JOIN (SELECT * FROM {_PREVIOUS} WHERE {_USABLE_JUDGE}) j USING (eval_id)""",
)
def resume_reuse(t: Tables):
    return enrich.resume_reuse(t.qa, _previous(t)).select("eval_id", "reused", "llm_judge.quality_tier")


@query("resume_todo", f"SELECT eval_id FROM v_qa WHERE eval_id NOT IN (SELECT eval_id FROM {_PREVIOUS} WHERE {_USABLE_JUDGE})")
def resume_todo(t: Tables):
    return enrich.resume_todo(t.qa, _previous(t)).select("eval_id")


_PAIR = """SELECT c.eval_id, c.gold_alignment AS challenger_value, b.gold_alignment AS baseline_value, c.gold_alignment - b.gold_alignment AS delta
FROM v_pred c JOIN v_pred b USING (eval_id) WHERE c.condition = 'candidate' AND b.condition = 'baseline_a'
  AND c.gold_alignment IS NOT NULL AND b.gold_alignment IS NOT NULL"""


@query("paired_delta", _PAIR)
def paired_delta(t: Tables):
    return enrich.paired_delta(t.pred, "candidate", "baseline_a", "gold_alignment")


_HELD = "(SELECT * FROM v_pred WHERE NOT (condition = 'baseline_b' AND turn % 4 = 0))"


def _held(t: Tables):
    return t.pred.filter(~((F.col("condition") == "baseline_b") & (F.col("turn") % 4 == 0)))


@query("triple_paired", f"SELECT eval_id FROM {_HELD} GROUP BY 1 HAVING count(DISTINCT condition) = 3")
def triple_paired(t: Tables):
    return enrich.complete_keys(_held(t), ARMS)


@query(
    "arm_sizes",
    f"""SELECT condition, count(*) AS n_rows, (SELECT count(*) FROM (SELECT eval_id FROM {_HELD} GROUP BY 1 HAVING count(DISTINCT condition) = 3)) AS paired_n
FROM {_HELD} GROUP BY 1""",
)
def arm_sizes(t: Tables):
    return enrich.arm_sizes(_held(t), ARMS)


@query(
    "train_overlap",
    """SELECT document_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels) AS in_train, count(DISTINCT document_id) AS n_documents, count(*) AS n_rows
FROM v_qa GROUP BY 1""",
)
def train_overlap(t: Tables):
    return enrich.train_overlap(t.qa, t.table("labels").select(F.col("doc_id").cast("string").alias("document_id")))


_PASS_SQL = {
    d: (f"(1 + (conv_id + {k} * turn) % 5)", f"(1 + (conv_id + {k} * turn + CAST(turn % 3 = 0 AS INT)) % 5)")
    for k, d in enumerate(C.EVAL_DIMENSIONS)
}
_P1_BAD, _P2_BAD = "conv_id % 11 = 0", "conv_id % 13 = 0"
_BOTH = f"(NOT ({_P1_BAD}) AND NOT ({_P2_BAD}))"


def _merged_sql(d: str) -> str:
    a, b = _PASS_SQL[d]
    return f"""CASE WHEN {_BOTH} THEN round_even(({a} + {b}) / 2.0::DOUBLE, 4) WHEN {_P1_BAD} AND NOT ({_P2_BAD}) THEN CAST({b} AS DOUBLE)
  WHEN NOT ({_P1_BAD}) THEN CAST({a} AS DOUBLE) END"""


_ROUNDED = [f"round_even(({_PASS_SQL[d][0]} + {_PASS_SQL[d][1]}) / 2.0::DOUBLE, 0)" for d in C.JUDGE_DIMENSIONS]


@query(
    "swap_merge_scores",
    f"""SELECT eval_id, {_BOTH} AS debiased, {", ".join(f"{_merged_sql(d)} AS {d}" for d in C.EVAL_DIMENSIONS)},
  CASE WHEN {_BOTH} THEN {s.tier('answer', *_ROUNDED)} WHEN {_P1_BAD} AND {_P2_BAD} THEN NULL ELSE 'single' END AS quality_tier,
  coalesce(CASE WHEN {_BOTH} THEN conv_id % 2 = 0 OR turn % 4 = 0 WHEN {_P1_BAD} AND NOT ({_P2_BAD}) THEN turn % 4 = 0 WHEN NOT ({_P1_BAD}) THEN conv_id % 2 = 0 END, false) AS refuse_expected
FROM v_qa""",
)
def swap_merge_scores(t: Tables):
    conv, turn = F.col("conv_id"), F.col("turn")

    def judged_pass(name: str, bad, shift, refuse):
        dims = [
            F.when(~bad, (1 + (conv + k * turn + shift) % 5).cast("double")).alias(d) for k, d in enumerate(C.EVAL_DIMENSIONS)
        ]
        block = F.struct(
            *dims, F.when(~bad, refuse).alias("refuse_expected"), F.lit(name).alias("brief_reason"),
            F.when(~bad, "single").alias("quality_tier"), F.lit("v").alias("prompt_version"),
            F.when(bad, "parse_error").alias("error"),
        )
        return t.qa.select("eval_id", "answer", "ord", F.lit(name).alias("presentation"), block.alias("llm_judge"))

    first = judged_pass("gold_first", conv % 11 == 0, F.lit(0), conv % 2 == 0)
    second = judged_pass("pred_first", conv % 13 == 0, (turn % 3 == 0).cast("int"), turn % 4 == 0)
    merged = enrich.swap_merge_scores(first.unionByName(second))
    return merged.select(
        "eval_id", "debiased", *[f"llm_judge.{d}" for d in C.EVAL_DIMENSIONS], "llm_judge.quality_tier",
        F.coalesce("llm_judge.refuse_expected", F.lit(False)).alias("refuse_expected"),
    )


_MAIN = "(SELECT eval_id, conv_id, turn, gold_alignment FROM v_pred WHERE condition = 'candidate')"
_REDONE = f"(SELECT eval_id, least(5, gold_alignment + CASE WHEN turn % 4 = 0 THEN 2 ELSE -1 END) AS ga2 FROM {_MAIN} WHERE gold_alignment <= 2)"


def _main(t: Tables):
    return t.pred.filter("condition = 'candidate'").select("eval_id", "conv_id", "turn", "gold_alignment", "ord")


def _redone(t: Tables):
    """Failed rows judged again, some better and some worse."""
    step = F.when(F.col("turn") % 4 == 0, 2).otherwise(-1)
    new = F.least(F.lit(5.0), F.col("gold_alignment") + step)
    return _main(t).filter("gold_alignment <= 2").select("eval_id", "ord", new.alias("gold_alignment"))


@query(
    "rejudge_upsert",
    f"""WITH j AS (SELECT m.eval_id, m.gold_alignment, r.ga2, r.eval_id IS NOT NULL AS hit FROM {_MAIN} m LEFT JOIN {_REDONE} r USING (eval_id)),
gain AS (SELECT avg(coalesce(ga2, gold_alignment)) - avg(gold_alignment) > 0 AS better FROM j)
SELECT eval_id, CASE WHEN hit AND better THEN ga2 ELSE gold_alignment END AS gold_alignment, hit AND better AS replaced FROM j, gain""",
)
def rejudge_upsert(t: Tables):
    return enrich.rejudge_upsert(_main(t), _redone(t)).select("eval_id", "gold_alignment", "replaced")


_D = "ga2 - gold_alignment"


@query(
    "rejudge_compare",
    f"""WITH j AS (SELECT m.eval_id, m.gold_alignment, r.ga2 FROM {_MAIN} m LEFT JOIN {_REDONE} r USING (eval_id) WHERE m.gold_alignment IS NOT NULL)
SELECT count(ga2) AS n_compared, {s.r('avg(gold_alignment) FILTER (WHERE ga2 IS NOT NULL)')} AS mean_old, {s.r('avg(ga2)')} AS mean_new, {s.r(f'avg({_D})')} AS mean_delta,
  count(*) FILTER (WHERE {_D} > 1e-9) AS n_improved, count(*) FILTER (WHERE {_D} < -1e-9) AS n_worse, count(*) FILTER (WHERE abs({_D}) <= 1e-9) AS n_same,
  {s.r(f'100.0 * count(*) FILTER (WHERE {_D} > 1e-9) / count(ga2)', 1)} AS pct_improved, {s.r('avg(gold_alignment)')} AS original_mean,
  {s.r('avg(coalesce(ga2, gold_alignment))')} AS counterfactual_mean FROM j""",
)
def rejudge_compare(t: Tables):
    return judged.rejudge_compare(_main(t), _redone(t))


_WIDE_GA = ", ".join(f"max(gold_alignment) FILTER (WHERE condition = '{a}') AS {a}" for a in ARMS)


@query(
    "select_failures",
    f"""WITH w AS (SELECT eval_id, {_WIDE_GA} FROM v_pred GROUP BY 1)
SELECT eval_id, 'low_score' AS mode FROM w WHERE candidate <= 2 UNION ALL SELECT eval_id, 'loses_to_a' FROM w WHERE candidate < baseline_a
UNION ALL SELECT eval_id, 'loses_to_b' FROM w WHERE candidate < baseline_b UNION ALL SELECT eval_id, 'loses_to_best' FROM w WHERE candidate < greatest(baseline_a, baseline_b)""",
)
def select_failures(t: Tables):
    arms = enrich.align_arms(t.pred, ARMS, ["gold_alignment"])
    wide = arms.select("eval_id", *[F.col(a)["gold_alignment"].alias(a) for a in ARMS])
    out = None
    for mode in judged.FAILURE_MODES:
        part = judged.select_failures(wide, mode).select("eval_id", F.lit(mode).alias("mode"))
        out = part if out is None else out.unionByName(part)
    return out


_MEANS = f"SELECT condition, {s.r('avg(gold_alignment)')} AS mean_gold_alignment FROM v_pred GROUP BY 1"


@query(
    "ceiling_gap",
    f"""WITH m AS ({_MEANS} UNION ALL SELECT 'REF_top', {s.r('avg(overall) + 1')} FROM v_pred),
c AS (SELECT max(mean_gold_alignment) FILTER (WHERE condition = 'REF_top') AS top, max(mean_gold_alignment) FILTER (WHERE condition = 'baseline_a') AS base FROM m)
SELECT condition, mean_gold_alignment, {s.r('top - mean_gold_alignment')} AS gap_to_ceiling,
  CASE WHEN abs(top - base) > 1e-9 THEN {s.r('(mean_gold_alignment - base) / (top - base)')} END AS recovery_vs_baseline,
  CASE WHEN abs(top - base) > 1e-9 THEN {s.r('100.0 * ((mean_gold_alignment - base) / (top - base))', 1)} END AS pct_of_ceiling_gain
FROM m, c WHERE NOT starts_with(condition, 'REF_')""",
)
def ceiling_gap(t: Tables):
    means = t.pred.groupBy("condition").agg(scoring.mean4(F.col("gold_alignment")).alias("mean_gold_alignment"))
    top = t.pred.agg(F.bround(F.avg("overall") + 1, 4).alias("mean_gold_alignment")).select(
        F.lit("REF_top").alias("condition"), "mean_gold_alignment"
    )
    return judged.ceiling_gap(means.unionByName(top), "REF_top", "baseline_a")


@query(
    "ceiling_gap_auto",
    f"""WITH m AS (SELECT CASE condition WHEN 'baseline_a' THEN 'B3_lora_no_ctx' WHEN 'baseline_b' THEN 'B3_lora_all' ELSE condition END AS condition, mean_gold_alignment FROM ({_MEANS})
  UNION ALL SELECT 'REF_top', {s.r('avg(overall) + 1')} FROM v_pred),
c AS (SELECT max(mean_gold_alignment) FILTER (WHERE condition = 'REF_top') AS top, max(mean_gold_alignment) FILTER (WHERE condition = 'B3_lora_all') AS base FROM m)
SELECT condition, mean_gold_alignment, {s.r('top - mean_gold_alignment')} AS gap_to_ceiling,
  CASE WHEN abs(top - base) > 1e-9 THEN {s.r('(mean_gold_alignment - base) / (top - base)')} END AS recovery_vs_baseline,
  CASE WHEN abs(top - base) > 1e-9 THEN {s.r('100.0 * ((mean_gold_alignment - base) / (top - base))', 1)} END AS pct_of_ceiling_gain
FROM m, c WHERE NOT starts_with(condition, 'REF_')""",
)
def ceiling_gap_auto(t: Tables):
    """No baseline named: the first known one among the arms."""
    named = F.when(F.col("condition") == "baseline_a", "B3_lora_no_ctx").when(F.col("condition") == "baseline_b", "B3_lora_all").otherwise(F.col("condition"))
    means = t.pred.groupBy(named.alias("condition")).agg(scoring.mean4(F.col("gold_alignment")).alias("mean_gold_alignment"))
    top = t.pred.agg(F.bround(F.avg("overall") + 1, 4).alias("mean_gold_alignment")).select(F.lit("REF_top").alias("condition"), "mean_gold_alignment")
    return judged.ceiling_gap(means.unionByName(top), "REF_top")


@query(
    "match_baselines",
    """WITH c AS (SELECT DISTINCT arm || suffix AS condition, role, CASE WHEN suffix = '_no_ctx' THEN 'no_ctx' WHEN suffix = '_ctx' THEN 'ctx' ELSE 'all' END AS family
  FROM (SELECT CASE WHEN condition = 'candidate' THEN 'cand' ELSE 'base' END AS arm, CASE WHEN condition = 'candidate' THEN 'candidate' ELSE 'baseline' END AS role,
    CASE WHEN model = 'en' THEN '_ctx' WHEN model = 'de' THEN '_no_ctx' ELSE CASE WHEN condition = 'candidate' THEN '_merge' ELSE '_all' END END AS suffix FROM v_pred))
SELECT a.condition AS challenger, a.family, min(b.condition) AS baseline FROM c a JOIN c b ON b.role = 'baseline' AND b.family = a.family
WHERE a.role = 'candidate' GROUP BY 1, 2""",
)
def match_baselines(t: Tables):
    cand = F.col("condition") == "candidate"
    suffix = (
        F.when(F.col("model") == "en", "_ctx").when(F.col("model") == "de", "_no_ctx")
        .otherwise(F.when(cand, "_merge").otherwise("_all"))
    )
    conditions = t.pred.select(
        F.concat(F.when(cand, "cand").otherwise("base"), suffix).alias("condition"),
        F.when(cand, "candidate").otherwise("baseline").alias("role"),
    ).distinct()
    return enrich.match_baselines(conditions)


@query(
    "dim_lookup",
    """SELECT eval_id, condition, CASE model WHEN 'en' THEN 'germanic' WHEN 'de' THEN 'germanic' ELSE 'romance' END AS family,
  CASE model WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' ELSE 'Spanish' END AS label FROM v_pred""",
)
def dim_lookup(t: Tables):
    rows = [("en", "germanic", "English"), ("de", "germanic", "German"), ("fr", "romance", "French"), ("es", "romance", "Spanish")]
    dim = t.spark.createDataFrame(rows, "model string, family string, label string")
    # Fixed dimension of four rows.
    return t.pred.join(F.broadcast(dim), "model").select("eval_id", "condition", "family", "label")


# ---- vectors and entailment


def _pairs(t: Tables):
    return scoring.cosine_pairs(t.vec)


_DOT = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
_COS = f"greatest(-1, least(1, {_DOT.format(a='lft', b='rgt')} / (sqrt({_DOT.format(a='lft', b='lft')}) * sqrt({_DOT.format(a='rgt', b='rgt')}))))"
_COS_SQL = f"""c AS (SELECT vec_id, label, {_COS} AS c FROM v_vec),
cos AS (SELECT vec_id, label, {s.r('c', 6)} AS cosine, {s.r('1 - c', 6)} AS gap, CASE WHEN 1 - c < 0.2 THEN 'low' WHEN 1 - c <= 0.6 THEN 'medium' ELSE 'high' END AS gap_tier FROM c)"""


@query("cosine_pairs", f"WITH {_COS_SQL} SELECT vec_id, cosine, gap FROM cos")
def cosine_pairs(t: Tables):
    return _pairs(t).select("vec_id", "cosine", "gap")


@query("gap_tiers", f"WITH {_COS_SQL} SELECT vec_id, gap_tier FROM cos")
def gap_tiers(t: Tables):
    return _pairs(t).select("vec_id", "gap_tier")


@query(
    "cosine_summary",
    f"""WITH {_COS_SQL} SELECT count(*) AS n_rows, count(cosine) AS n_scored, {s.r('avg(cosine)', 6)} AS mean_cosine, min(cosine) AS min_cosine,
  max(cosine) AS max_cosine, count(*) FILTER (WHERE cosine < 0.35) AS n_low FROM cos""",
)
def cosine_summary(t: Tables):
    return scoring.cosine_summary(_pairs(t))


@query(
    "gap_summary",
    f"""WITH {_COS_SQL} SELECT count(*) AS n_rows, count(gap) AS n_pairs, {s.r('avg(cosine)', 6)} AS mean_cosine, {s.r('avg(gap)', 6)} AS mean_gap,
  count(*) FILTER (WHERE gap_tier = 'low') AS n_low, count(*) FILTER (WHERE gap_tier = 'medium') AS n_medium, count(*) FILTER (WHERE gap_tier = 'high') AS n_high FROM cos""",
)
def gap_summary(t: Tables):
    return scoring.gap_summary(_pairs(t))


@query(
    "pair_texts",
    f"""SELECT eval_id, mode, md5(CASE mode WHEN 'context_vs_answer' THEN c WHEN 'cq_vs_answer' THEN CASE WHEN q = '' THEN c ELSE c || chr(10) || chr(10) || 'Question: ' || q END ELSE q END) AS left_md5, md5(a) AS right_md5
FROM (SELECT eval_id, {s.strip('context')} AS c, {s.strip('question')} AS q, {s.strip('answer')} AS a, unnest(['context_vs_answer', 'cq_vs_answer', 'question_vs_answer']) AS mode FROM v_qa)""",
)
def pair_texts(t: Tables):
    out = None
    for mode in ("context_vs_answer", "cq_vs_answer", "question_vs_answer"):
        part = scoring.pair_texts(t.qa, mode).select(
            "eval_id", F.lit(mode).alias("mode"), F.md5("left_text").alias("left_md5"), F.md5("right_text").alias("right_md5")
        )
        out = part if out is None else out.unionByName(part)
    return out


_NLI_SQL = """w AS (SELECT doc_id AS row_id, i AS "window", a / (a + b + c) AS p_contradiction, b / (a + b + c) AS p_neutral, c / (a + b + c) AS p_entailment
  FROM (SELECT doc_id, i, CAST(1 + (doc_id * 3 + i) % 7 AS DOUBLE) AS a, CAST(1 + (doc_id + i * 5) % 4 AS DOUBLE) AS b, CAST(1 + (doc_id * 2 + i * 3) % 9 AS DOUBLE) AS c
    FROM (SELECT doc_id, unnest(range(1 + n_chars // 4000)) AS i FROM documents))),
agg AS (SELECT row_id, max(p_contradiction) AS pc, avg(p_neutral) AS pn, max(p_entailment) AS pe, count(*) AS n_windows FROM w GROUP BY 1),
lab AS (SELECT *, CASE WHEN pc >= pn AND pc >= pe THEN 'contradiction' WHEN pn >= pe THEN 'neutral' ELSE 'entailment' END AS pred_label FROM agg)"""


def _nli_windows(t: Tables):
    """Window probabilities per document; long documents have several windows."""
    i, d = F.col("window"), F.col("doc_id")
    a, b, c = [x.cast("double") for x in (1 + (d * 3 + i) % 7, 1 + (d + i * 5) % 4, 1 + (d * 2 + i * 3) % 9)]
    windows = F.explode(F.sequence(F.lit(0), F.floor(F.col("n_chars") / 4000)))
    return t.table("documents").select("doc_id", windows.alias("window")).select(
        F.col("doc_id").alias("row_id"), "window", (a / (a + b + c)).alias("p_contradiction"),
        (b / (a + b + c)).alias("p_neutral"), (c / (a + b + c)).alias("p_entailment"),
    )


@query(
    "nli_aggregate",
    f"WITH {_NLI_SQL} SELECT row_id, {s.r('pc', 6)} AS p_contradiction, {s.r('pn', 6)} AS p_neutral, {s.r('pe', 6)} AS p_entailment, n_windows FROM lab",
)
def nli_aggregate(t: Tables):
    rows = scoring.nli_aggregate(_nli_windows(t))
    rounded = [F.bround(c, 6).alias(c) for c in ("p_contradiction", "p_neutral", "p_entailment")]
    return rows.select("row_id", *rounded, "n_windows")


@query("nli_labels", f"WITH {_NLI_SQL} SELECT row_id, pred_label FROM lab")
def nli_labels(t: Tables):
    return scoring.nli_aggregate(_nli_windows(t)).select("row_id", "pred_label")


@query(
    "nli_summary",
    f"""WITH {_NLI_SQL} SELECT count(*) AS n_rows, {s.r('avg(pe)', 6)} AS mean_p_entailment, {s.r('avg(pc)', 6)} AS mean_p_contradiction,
  count(*) FILTER (WHERE pc >= 0.5) AS high_contradiction, count(*) FILTER (WHERE pe <= 0.25) AS low_entailment, CAST(sum(n_windows) AS BIGINT) AS total_windows,
  count(*) FILTER (WHERE n_windows > 1) AS rows_multi_window, max(n_windows) AS max_n_windows, {s.r('avg(n_windows)', 3)} AS mean_n_windows,
  count(*) FILTER (WHERE pred_label = 'contradiction') AS n_contradiction, count(*) FILTER (WHERE pred_label = 'neutral') AS n_neutral,
  count(*) FILTER (WHERE pred_label = 'entailment') AS n_entailment FROM lab""",
)
def nli_summary(t: Tables):
    return scoring.nli_summary(scoring.nli_aggregate(_nli_windows(t)))


# ---- agreement

_T = [f"t{k}" for k in range(4)]
_S = [f"s{k}" for k in range(4)]
_TIERS_SQL = f"""tt AS (SELECT *, coalesce(teacher_quality_tier, {s.tier('answer', *_T)}) AS teacher_tier,
  CASE WHEN s_error IS NOT NULL THEN 'error' ELSE {s.tier('answer', *_S)} END AS student_tier FROM v_teacher)"""


@query("tier_confusion", f"WITH {_TIERS_SQL} SELECT teacher_tier, student_tier, count(*) AS n_rows FROM tt GROUP BY 1, 2")
def tier_confusion(t: Tables):
    return agreement.tier_confusion(t.teacher)


@query(
    "judge_agreement",
    f"""WITH {_TIERS_SQL} SELECT count(*) AS n_rows, count(*) FILTER (WHERE s_error IS NULL) AS n_scored_rows, count(s_error) AS n_parse_errors,
  {s.r('count(*) FILTER (WHERE teacher_tier = student_tier) / count(*)', 6)} AS tier_agreement,
  {", ".join(f"{s.r(f'avg(abs(s{k} - t{k})) FILTER (WHERE s_error IS NULL)', 6)} AS mae_{d}" for k, d in enumerate(C.JUDGE_DIMENSIONS))},
  {s.r("count(*) FILTER (WHERE teacher_tier <> 'high' AND student_tier = 'high') / count(*)", 6)} AS false_high_rate,
  {s.r("count(*) FILTER (WHERE teacher_tier = 'drop' AND student_tier <> 'drop') / count(*)", 6)} AS false_drop_rate FROM tt""",
)
def judge_agreement(t: Tables):
    return agreement.judge_agreement(t.teacher)


@query(
    "cohen_kappa",
    f"""WITH {_TIERS_SQL}, n AS (SELECT count(*) AS n, count(*) FILTER (WHERE teacher_tier = student_tier) AS a FROM tt),
l AS (SELECT teacher_tier AS x, count(*)::DOUBLE AS c FROM tt GROUP BY 1), r AS (SELECT student_tier AS x, count(*)::DOUBLE AS c FROM tt GROUP BY 1),
pe AS (SELECT coalesce(sum(l.c / n.n * (r.c / n.n)), 0) AS pe FROM l JOIN r USING (x), n)
SELECT n, {s.r('a / n', 6)} AS agreement, {s.r('pe', 6)} AS chance, {s.r('(a / n - pe) / (1 - pe)', 6)} AS kappa FROM n, pe""",
)
def cohen_kappa(t: Tables):
    return agreement.cohen_kappa(agreement.with_tiers(t.teacher), "teacher_tier", "student_tier")


@query(
    "spearman",
    f"""WITH x AS (SELECT t3, s3 FROM v_teacher WHERE s_error IS NULL),
rk AS (SELECT rank() OVER (ORDER BY t3) + (count(*) OVER (PARTITION BY t3) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY s3) + (count(*) OVER (PARTITION BY s3) - 1) / 2.0::DOUBLE AS b FROM x)
SELECT count(*) AS n, {s.r('corr(a, b)', 6)} AS spearman FROM rk""",
)
def spearman(t: Tables):
    ok = F.col("student_judge.error").isNull()
    rows = t.teacher.filter(ok).select(F.col("teacher_judge.overall").alias("a"), F.col("student_judge.overall").alias("b"))
    return agreement.spearman(rows, "a", "b")


@query(
    "spearman_continuous",
    f"""WITH x AS (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
rk AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS b FROM x)
SELECT count(*) AS n, {s.r('corr(a, b)', 6)} AS spearman FROM rk""",
)
def spearman_continuous(t: Tables):
    rows = t.table("embeddings").select(F.col("embedding")[0].alias("a"), F.col("embedding")[1].alias("b"))
    return agreement.spearman(rows, "a", "b")
