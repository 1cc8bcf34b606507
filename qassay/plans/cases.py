"""Queries for coverage, case mining, refusal statistics and resources."""

from __future__ import annotations

from pyspark.sql import functions as F

from qassay import constants as C
from qassay.operators import coverage, mining, resources
from qassay.plans import sqltext as s
from qassay.plans.registry import query
from qassay.plans.views import ARMS, Tables

CANDIDATE, BASELINES = "candidate", ["baseline_a", "baseline_b"]

# ---- coverage

_QA_SQL = """qa AS (SELECT document_id, coalesce(quality_tier, 'unknown') AS tier, question || ' ' || answer AS text FROM v_judged WHERE coalesce(quality_tier, 'unknown') <> 'drop'),
toks AS (SELECT DISTINCT document_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM qa)"""

_HITS_SQL = f"""{_QA_SQL},
enough AS (SELECT document_id FROM toks GROUP BY 1 HAVING count(*) >= 3),
wins AS (SELECT document_id, i AS "window", {s.ascii_tokens("array_to_string(list_slice(w, i * (len(w) // 5) + 1, CASE WHEN i = 4 THEN len(w) ELSE (i + 1) * (len(w) // 5) END), ' ')")} AS tk
  FROM (SELECT document_id, {s.words('context')} AS w, unnest(range(5)) AS i FROM v_docs) WHERE len(w) >= 40),
shared AS (SELECT document_id, "window", count(*) AS sn FROM (SELECT document_id, "window", unnest(tk) AS token FROM wins) JOIN toks USING (document_id, token)
  WHERE document_id IN (SELECT document_id FROM enough) GROUP BY 1, 2),
hits AS (SELECT document_id, "window", coalesce(sn / nullif(len(tk), 0)::DOUBLE, 0.0::DOUBLE) AS ov FROM wins LEFT JOIN shared USING (document_id, "window")),
maj AS (SELECT document_id, sum(c) AS n_qa, first(tier ORDER BY c DESC, list_position(['high', 'medium', 'low', 'drop', 'unknown'], tier)) AS majority_tier
  FROM (SELECT document_id, tier, count(*) AS c FROM qa GROUP BY 1, 2) GROUP BY 1),
per_doc AS (SELECT document_id, CAST(coalesce(any_value(n_qa), 0) AS BIGINT) AS n_qa, count(*) AS n_windows, count(*) FILTER (WHERE ov >= 0.12) AS n_hits,
  {s.r('count(*) FILTER (WHERE ov >= 0.12) / count(*)')} AS coverage, coalesce(any_value(majority_tier), 'none') AS majority_tier
  FROM hits LEFT JOIN maj USING (document_id) GROUP BY 1)"""


def _qa(t: Tables):
    return t.judged.select("document_id", "chunk_id", "question", "answer", F.col("llm_judge.quality_tier").alias("quality_tier"))


def _hits(t: Tables):
    return coverage.window_hits(t.docs, _qa(t), exclude_tiers=("drop",))


def _per_doc(t: Tables):
    return coverage.coverage_per_doc(_hits(t), _qa(t), exclude_tiers=("drop",))


@query(
    "doc_qa_blob",
    f"""WITH {_QA_SQL} SELECT d.document_id, coalesce(n_qa, 0) AS n_qa, CAST(coalesce(blob_chars, 0) AS BIGINT) AS blob_chars, coalesce(n_tokens, 0) AS n_tokens FROM v_docs d
LEFT JOIN (SELECT document_id, count(*) AS n_qa, length(string_agg(text, ' ')) AS blob_chars FROM qa GROUP BY 1) USING (document_id)
LEFT JOIN (SELECT document_id, count(*) AS n_tokens FROM toks GROUP BY 1) USING (document_id)""",
)
def doc_qa_blob(t: Tables):
    return coverage.qa_text_stats(_qa(t), t.docs, exclude_tiers=("drop",))


@query("window_hits", f'WITH {_HITS_SQL} SELECT document_id, "window", {s.r("ov", 6)} AS overlap, ov >= 0.12 AS hit FROM hits')
def window_hits(t: Tables):
    return _hits(t)


@query("coverage_per_doc", f"WITH {_HITS_SQL} SELECT * FROM per_doc")
def coverage_per_doc(t: Tables):
    return _per_doc(t)


@query(
    "coverage_summary",
    f"""WITH {_HITS_SQL} SELECT count(*) AS n_documents, (SELECT count(*) FROM qa) AS n_qa_rows, {s.r('avg(n_hits / n_windows)')} AS mean_coverage, {s.r('median(n_hits / n_windows)')} AS median_coverage,
  {s.r('100.0 * count(*) FILTER (WHERE n_hits / n_windows >= 0.8) / count(*)', 2)} AS pct_ge_80, {s.r('100.0 * count(*) FILTER (WHERE n_hits / n_windows >= 0.4) / count(*)', 2)} AS pct_ge_40 FROM per_doc""",
)
def coverage_summary(t: Tables):
    return coverage.coverage_summary(_per_doc(t), _qa(t), exclude_tiers=("drop",))


@query(
    "coverage_by_position",
    f"""WITH {_HITS_SQL} SELECT "window", count(*) AS n_documents, {s.r('100.0 * count(*) FILTER (WHERE ov >= 0.12) / count(*)', 2)} AS pct_hit FROM hits GROUP BY 1""",
)
def coverage_by_position(t: Tables):
    return coverage.coverage_by_position(_hits(t))


@query(
    "coverage_by_tier",
    f"WITH {_HITS_SQL} SELECT majority_tier, count(*) AS n_documents, {s.r('avg(n_hits / n_windows)')} AS mean_coverage FROM per_doc GROUP BY 1",
)
def coverage_by_tier(t: Tables):
    return coverage.coverage_by_tier(_per_doc(t))


@query(
    "coverage_cosine",
    f"""WITH c AS (SELECT vec_id // 5 AS document_id, list_dot_product(CAST(lft AS DOUBLE[]), CAST(rgt AS DOUBLE[])) / (sqrt(list_dot_product(CAST(lft AS DOUBLE[]), CAST(lft AS DOUBLE[])))
  * sqrt(list_dot_product(CAST(rgt AS DOUBLE[]), CAST(rgt AS DOUBLE[])))) AS c FROM v_vec)
SELECT document_id, count(*) AS n_windows, count(*) FILTER (WHERE c >= 0.35) AS n_hits, {s.r('count(*) FILTER (WHERE c >= 0.35) / count(*)')} AS coverage, {s.r('avg(c)')} AS mean_cosine FROM c GROUP BY 1""",
)
def coverage_cosine(t: Tables):
    from qassay.functions.metrics import cosine

    windows = t.vec.select(
        F.floor(F.col("vec_id") / 5).alias("document_id"), cosine(F.col("left"), F.col("right")).alias("cosine")
    )
    return coverage.coverage_cosine(windows)


_DIM = 64
_VEC_SQL = f"""parts AS (SELECT CAST(vec_id // 10 AS BIGINT) AS document_id, vec_id % 10 AS w, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
summed AS (SELECT document_id, i, avg(e[i]) AS m FROM (SELECT document_id, e, unnest(range(1, {_DIM} + 1)) AS i FROM parts WHERE w >= 5) GROUP BY 1, 2),
means AS (SELECT document_id, list(m ORDER BY i) AS q FROM summed GROUP BY 1),
cosines AS (SELECT document_id, w, list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) AS c FROM parts LEFT JOIN means USING (document_id) WHERE w < 5),
flagged AS (SELECT *, coalesce(c >= 0.35, FALSE) AS hit FROM cosines),
tiers AS (SELECT coalesce(quality_tier, 'unknown') AS tier, count(*) AS n_rows, coalesce(quality_tier, 'unknown') = 'drop' AS excluded FROM v_judged GROUP BY ALL)"""


def _cosines(t: Tables):
    """Every ten vectors are a document: five windows, and the vectors of its questions."""
    own = t.table("embeddings").select(F.floor(F.col("vec_id") / 10).cast("bigint").alias("document_id"), (F.col("vec_id") % 10).alias("window"), "embedding")
    return coverage.window_cosines(own.filter("window < 5"), own.filter("window >= 5"), _DIM)


@query(
    "coverage_embedding",
    f"""WITH {_VEC_SQL} SELECT document_id, count(*) AS n_windows, count(*) FILTER (WHERE hit) AS n_hits, {s.r('count(*) FILTER (WHERE hit) / count(*)')} AS coverage, {s.r('avg(c)')} AS mean_cosine,
  {', '.join(f"any_value(hit) FILTER (WHERE w = {i}) AS hit_{i}" for i in range(5))} FROM flagged GROUP BY 1""",
)
def coverage_embedding(t: Tables):
    per_doc = coverage.coverage_by_embedding(_cosines(t))
    return per_doc.select("document_id", "n_windows", "n_hits", "coverage", "mean_cosine", *[F.get("hits", F.lit(i)).alias(f"hit_{i}") for i in range(5)])


@query(
    "coverage_embedding_summary",
    f"""WITH {_VEC_SQL}, per_doc AS (SELECT document_id, count(*) FILTER (WHERE hit) / count(*) AS cov FROM flagged GROUP BY 1)
SELECT count(*) AS n_documents, {s.r('avg(cov)')} AS mean_coverage, {s.r('quantile_cont(cov, 0.5)')} AS median_coverage, {s.r('100.0 * count(*) FILTER (WHERE cov >= 0.8) / count(*)', 2)} AS pct_ge_80,
  {s.r('100.0 * count(*) FILTER (WHERE cov >= 0.4) / count(*)', 2)} AS pct_ge_40, (SELECT CAST(coalesce(sum(n_rows) FILTER (WHERE NOT excluded), 0) AS BIGINT) FROM tiers) AS n_qa_rows,
  (SELECT CAST(coalesce(sum(n_rows) FILTER (WHERE excluded), 0) AS BIGINT) FROM tiers) AS n_qa_rows_excluded, (SELECT {s.r('avg(c)')} FROM cosines) AS mean_window_cosine,
  (SELECT {s.r('quantile_cont(c, 0.5)')} FROM cosines) AS median_window_cosine FROM per_doc""",
)
def coverage_embedding_summary(t: Tables):
    return coverage.embedding_summary(_cosines(t), _qa(t), exclude_tiers=("drop",))


@query("coverage_tier_counts", f"WITH {_VEC_SQL} SELECT * FROM tiers")
def coverage_tier_counts(t: Tables):
    return coverage.tier_counts(_qa(t), exclude_tiers=("drop",))


@query(
    "doc_qa_texts",
    """WITH rows AS (SELECT document_id, question || ' ' || answer AS text, ord FROM v_judged WHERE coalesce(quality_tier, 'unknown') <> 'drop')
SELECT d.document_id, length(coalesce(t, '')) AS n_chars, md5(coalesce(t, '')) AS text_md5 FROM v_docs d LEFT JOIN (SELECT document_id, string_agg(text, ' ' ORDER BY ord) AS t FROM rows GROUP BY 1) USING (document_id)""",
)
def doc_qa_texts(t: Tables):
    """The joined text itself."""
    qa = t.judged.select("document_id", "chunk_id", "question", "answer", F.col("llm_judge.quality_tier").alias("quality_tier"), "ord")
    texts = coverage.qa_texts(qa, t.docs, exclude_tiers=("drop",))
    return texts.select("document_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


# ---- mining

_FIELDS = ("pred", "gold_alignment", "grounding")
_WIDE_SQL = "w AS (SELECT model, dataset, eval_id, any_value(question) AS question, any_value(gold) AS gold, " + ", ".join(
    f"max({f}) FILTER (WHERE condition = '{a}') AS {a}_{f}" for a in ARMS for f in _FIELDS
) + " FROM v_pred GROUP BY 1, 2, 3)"


def _ga(a: str) -> str:
    return f"coalesce({a}_gold_alignment, 0)"


def _cls(a: str) -> str:
    return s.refusal_class(f"{a}_pred")


_RG = s.refusal_gold("gold")
_REFUSAL_PAIR = f"{_RG} AND {s.refusing(_cls('candidate'))} AND {s.invented(_cls('baseline_a'))}"
_REFUSAL_TRIPLE = f"{_REFUSAL_PAIR} AND {s.invented(_cls('baseline_b'))}"
_GAP_PAIR = f"NOT {_RG} AND {_ga('baseline_a')} <= 2 AND {_ga('candidate')} >= 4 AND {_ga('candidate')} - {_ga('baseline_a')} >= 2"
_GAP_TRIPLE = f"{_GAP_PAIR} AND {_ga('baseline_b')} <= 2 AND {_ga('candidate')} - {_ga('baseline_b')} >= 2"
_MIN_GAP = f"least({_ga('candidate')} - {_ga('baseline_a')}, {_ga('candidate')} - {_ga('baseline_b')})"
_MAX_GAP = f"{_ga('candidate')} - greatest({_ga('baseline_a')}, {_ga('baseline_b')})"


def _wide(t: Tables, arms=ARMS):
    return mining.wide_arms(t.pred, list(arms))


def _pair(t: Tables):
    return _wide(t, ("candidate", "baseline_a"))


_CASE = ["model", "dataset", "eval_id", "pattern", "score_gap"]


@query(
    "mine_refusal_pairs",
    f"""WITH {_WIDE_SQL} SELECT model, dataset, eval_id, 'refusal' AS pattern, {_ga('candidate')} - {_ga('baseline_a')} AS score_gap, candidate_pred,
  {_cls('baseline_a')} AS baseline_a_refusal_class FROM w WHERE {_REFUSAL_PAIR}""",
)
def mine_refusal_pairs(t: Tables):
    return mining.refusal_pairs(_pair(t), CANDIDATE, "baseline_a").select(
        *_CASE, "candidate_pred", "baseline_a_refusal_class"
    ).orderBy(F.desc("score_gap"), "eval_id")


@query(
    "mine_gap_pairs",
    f"WITH {_WIDE_SQL} SELECT model, dataset, eval_id, 'judge_gap' AS pattern, {_ga('candidate')} - {_ga('baseline_a')} AS score_gap FROM w WHERE {_GAP_PAIR}",
)
def mine_gap_pairs(t: Tables):
    return mining.gap_pairs(_pair(t), CANDIDATE, "baseline_a").select(*_CASE).orderBy(F.desc("score_gap"), "eval_id")


@query(
    "mine_gap_triples",
    f"WITH {_WIDE_SQL} SELECT model, dataset, eval_id, 'judge_gap' AS pattern, {_MIN_GAP} AS score_gap FROM w WHERE {_GAP_TRIPLE}",
)
def mine_gap_triples(t: Tables):
    return mining.gap_triples(_wide(t), CANDIDATE, BASELINES).select(*_CASE).orderBy(F.desc("score_gap"), "eval_id")


@query(
    "mine_refusal_triples",
    f"WITH {_WIDE_SQL} SELECT model, dataset, eval_id, 'refusal' AS pattern, {_MAX_GAP} AS score_gap FROM w WHERE {_REFUSAL_TRIPLE}",
)
def mine_refusal_triples(t: Tables):
    return mining.refusal_triples(_wide(t), CANDIDATE, BASELINES).select(*_CASE).orderBy(F.desc("score_gap"), "eval_id")


_CASES_SQL = f"""{_WIDE_SQL},
cases AS (SELECT model, dataset, eval_id, 'refusal' AS pattern, {_MAX_GAP} AS score_gap, candidate_gold_alignment, model || '/' || dataset || '/refusal/' || eval_id AS case_id FROM w WHERE {_REFUSAL_TRIPLE}
UNION ALL SELECT model, dataset, eval_id, 'judge_gap', {_MIN_GAP}, candidate_gold_alignment, model || '/' || dataset || '/judge_gap/' || eval_id FROM w WHERE {_GAP_TRIPLE})"""


@query(
    "mine_auto",
    f"""WITH {_CASES_SQL}, chosen AS (SELECT * FROM cases c WHERE pattern = 'refusal' OR NOT EXISTS (SELECT 1 FROM cases r WHERE r.pattern = 'refusal' AND r.model = c.model AND r.dataset = c.dataset))
SELECT model, dataset, eval_id, pattern, score_gap, row_number() OVER (PARTITION BY model, dataset ORDER BY score_gap DESC, eval_id) AS rank FROM chosen
QUALIFY rank <= 3""",
)
def mine_auto(t: Tables):
    return mining.mine_auto(_wide(t), CANDIDATE, BASELINES, 3).select(*_CASE, "rank")


_GR = lambda a: f"coalesce({a}_grounding, 0)"
_WINS_SQL = f"""{_WIDE_SQL},
wins AS (SELECT model, dataset, eval_id, 'answer_win' AS pattern, {_GR('candidate')} - {_GR('baseline_a')} + 0.25::DOUBLE * ({_ga('candidate')} - {_ga('baseline_a')}) AS score_gap FROM w
  WHERE NOT {_RG} AND {_GR('baseline_a')} <= 2 AND {_GR('candidate')} >= 4 AND NOT {s.refusing(_cls('candidate'))} AND {_ga('candidate')} >= 4 AND {_ga('baseline_a')} <= 2
UNION ALL SELECT model, dataset, eval_id, 'refusal_win', {_ga('candidate')} - {_ga('baseline_a')} FROM w WHERE {_REFUSAL_PAIR} AND {_ga('candidate')} >= 4)"""


@query("mine_answer_wins", f"WITH {_WINS_SQL} SELECT * FROM wins WHERE pattern = 'answer_win'")
def mine_answer_wins(t: Tables):
    return mining.answer_wins(_pair(t), CANDIDATE, "baseline_a").select(*_CASE)


@query("mine_refusal_wins", f"WITH {_WINS_SQL} SELECT * FROM wins WHERE pattern = 'refusal_win'")
def mine_refusal_wins(t: Tables):
    return mining.refusal_wins(_pair(t), CANDIDATE, "baseline_a").select(*_CASE)


def _catalog(t: Tables):
    return mining.case_catalog(_wide(t), CANDIDATE, BASELINES)


@query(
    "case_catalog",
    f"""WITH {_CASES_SQL}
SELECT case_id, model, dataset, pattern, score_gap, candidate_gold_alignment, length(context) AS context_chars, md5(context) AS context_md5
FROM cases LEFT JOIN (SELECT model, dataset, eval_id, CASE WHEN {s.strip('context')} <> '' THEN context END AS context FROM v_pred WHERE condition = 'candidate')
  USING (model, dataset, eval_id)""",
)
def case_catalog(t: Tables):
    cases = mining.with_context(_catalog(t), t.pred, ARMS)
    context = [F.length("context").cast("long").alias("context_chars"), F.md5("context").alias("context_md5")]
    return cases.select("case_id", "model", "dataset", "pattern", "score_gap", "candidate_gold_alignment", *context)


@query(
    "catalog_summary",
    f"""WITH {_CASES_SQL} SELECT 'model' AS "grouping", model, '*' AS dataset, '*' AS pattern, count(*) AS n_cases FROM cases GROUP BY model
UNION ALL SELECT 'dataset', '*', dataset, '*', count(*) FROM cases GROUP BY dataset UNION ALL SELECT 'pattern', '*', '*', pattern, count(*) FROM cases GROUP BY pattern
UNION ALL SELECT 'model+dataset', model, dataset, '*', count(*) FROM cases GROUP BY model, dataset UNION ALL SELECT 'all', '*', '*', '*', count(*) FROM cases""",
)
def catalog_summary(t: Tables):
    return mining.catalog_summary(_catalog(t))


_DATASETS = ["src1", "src2", "src3"]
_DATASET_POS = "coalesce(list_position(['src1', 'src2', 'src3'], dataset), 4)"


@query(
    "round_robin_pick",
    f"""WITH {_CASES_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY model, pattern, dataset ORDER BY score_gap DESC, case_id) AS br FROM cases WHERE candidate_gold_alignment >= 4)
SELECT model, case_id, row_number() OVER (PARTITION BY model ORDER BY CASE WHEN {_DATASET_POS} < 4 THEN 0 ELSE 1 END,
  CASE WHEN {_DATASET_POS} < 4 THEN CAST(br AS DOUBLE) ELSE -score_gap END, CASE WHEN {_DATASET_POS} < 4 THEN CASE WHEN pattern = 'refusal' THEN 0 ELSE 3 END + {_DATASET_POS} ELSE 0 END, case_id) AS pick
FROM b WHERE br <= 6 QUALIFY pick <= 6""",
)
def round_robin_pick(t: Tables):
    return mining.round_robin_pick(_catalog(t), CANDIDATE, _DATASETS, n=6).select("model", "case_id", "pick")


_WIN_CASES = f"{_WINS_SQL}, wc AS (SELECT *, model || '/' || dataset || '/' || pattern || '/' || eval_id AS case_id FROM wins)"


@query(
    "capped_pick",
    f"""WITH {_WIN_CASES}, b AS (SELECT *, row_number() OVER (PARTITION BY pattern, model, dataset ORDER BY score_gap DESC, case_id) AS br FROM wc)
SELECT pattern, case_id, row_number() OVER (PARTITION BY pattern ORDER BY br, coalesce(list_position(['fr', 'en'], model), 3), model, dataset) AS pick FROM b WHERE br <= 2
QUALIFY pick <= CASE WHEN pattern = 'refusal_win' THEN 10 ELSE 12 END""",
)
def capped_pick(t: Tables):
    pair = _pair(t)
    wins = mining.answer_wins(pair, CANDIDATE, "baseline_a").unionByName(mining.refusal_wins(pair, CANDIDATE, "baseline_a"))
    cases = wins.withColumn("case_id", F.concat_ws("/", "model", "dataset", "pattern", "eval_id"))
    return mining.capped_pick(cases, {"refusal_win": 10, "answer_win": 12}, ["fr", "en"]).select("pattern", "case_id", "pick")


@query(
    "highlights",
    f"""WITH {_CASES_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY pattern, model ORDER BY score_gap DESC, case_id) AS mr FROM cases WHERE candidate_gold_alignment >= 4),
ref AS (SELECT *, row_number() OVER (ORDER BY score_gap DESC, case_id) AS pick FROM m WHERE pattern = 'refusal' AND mr <= 3 QUALIFY pick <= 8),
gap AS (SELECT m.*, row_number() OVER (ORDER BY score_gap DESC, case_id) AS pick FROM m LEFT JOIN (SELECT model, count(*) AS used FROM ref GROUP BY 1) USING (model)
  WHERE pattern = 'judge_gap' AND mr <= 3 - coalesce(used, 0) QUALIFY pick <= 8)
SELECT case_id, pattern, pick FROM ref UNION ALL SELECT case_id, pattern, pick FROM gap""",
)
def highlights(t: Tables):
    return mining.highlights(_catalog(t), CANDIDATE).select("case_id", "pattern", "pick")


_FLAGS = f"f AS (SELECT model, dataset, condition AS arm, eval_id, {s.refusal_gold('gold')} AS un, {s.invented(s.refusal_class('pred'))} AS ans, grounding AS g FROM v_pred)"
_RATES = f"""count(*) AS n, count(*) FILTER (WHERE un) AS unanswerable_n, count(*) FILTER (WHERE NOT un) AS answerable_n,
  {s.r('count(*) FILTER (WHERE ans AND g <= 2) / nullif(count(*) FILTER (WHERE ans), 0)')} AS uar, {s.r('count(*) FILTER (WHERE ans) / count(*)')} AS coverage,
  {s.r('count(*) FILTER (WHERE NOT ans AND un) / nullif(count(*) FILTER (WHERE un), 0)')} AS correct_refusal,
  {s.r('count(*) FILTER (WHERE NOT ans AND NOT un) / nullif(count(*) FILTER (WHERE NOT un), 0)')} AS over_refusal,
  {s.r('count(*) FILTER (WHERE ans AND NOT un AND g > 2) / nullif(count(*) FILTER (WHERE NOT un), 0)')} AS grounded_accuracy, count(*) FILTER (WHERE ans AND g IS NULL) AS answered_no_grounding"""


@query(
    "grounded_rates",
    f"WITH {_FLAGS} SELECT model, arm, dataset, {_RATES} FROM f GROUP BY 1, 2, 3 UNION ALL SELECT model, arm, 'pooled', {_RATES} FROM f GROUP BY 1, 2",
)
def grounded_rates(t: Tables):
    return mining.grounded_rates(t.pred, ARMS)


_HALL_SQL = f"""c AS (SELECT model, dataset, condition, count(*) AS n, count(*) FILTER (WHERE {_RG}) AS unanswerable_n,
  count(*) FILTER (WHERE coalesce(gold_alignment, 0) <= 2 OR ({_RG} AND {s.invented(s.refusal_class('pred'))})) AS hallucination_n,
  count(*) FILTER (WHERE {_RG} AND {s.invented(s.refusal_class('pred'))}) AS invent_n,
  count(*) FILTER (WHERE {_RG} AND {s.refusing(s.refusal_class('pred'))} AND coalesce(gold_alignment, 0) >= 4) AS refusal_correct_n,
  count(*) FILTER (WHERE NOT {_RG} AND coalesce(gold_alignment, 0) <= 2) AS wrong_n FROM v_pred GROUP BY 1, 2, 3),
h AS (SELECT model, dataset, condition, max(n) OVER (PARTITION BY model, dataset) AS n_eval, unanswerable_n, n - unanswerable_n AS answerable_n, hallucination_n, invent_n, refusal_correct_n, wrong_n,
  max(hallucination_n) FILTER (WHERE condition = 'candidate') OVER (PARTITION BY model, dataset) AS cand FROM c)"""


def _stats(t: Tables):
    return mining.hallucination_stats(t.pred, CANDIDATE)


@query(
    "hallucination_stats",
    f"""WITH {_HALL_SQL} SELECT model, dataset, condition, n_eval, unanswerable_n, answerable_n, hallucination_n, invent_n, refusal_correct_n, wrong_n,
  {s.r('hallucination_n / n_eval')} AS hallucination_rate, {s.r('invent_n / nullif(unanswerable_n, 0)')} AS invent_rate, {s.r('refusal_correct_n / nullif(unanswerable_n, 0)')} AS refusal_correct_rate,
  {s.r('wrong_n / nullif(answerable_n, 0)')} AS wrong_rate, {s.r('(hallucination_n - cand) / n_eval')} AS delta_vs_candidate FROM h""",
)
def hallucination_stats(t: Tables):
    return _stats(t)


@query(
    "hallucination_by_model",
    f"""WITH {_HALL_SQL} SELECT model, condition, CAST(sum(n_eval) AS BIGINT) AS n_eval_rows, CAST(sum(unanswerable_n) AS BIGINT) AS unanswerable_n, CAST(sum(answerable_n) AS BIGINT) AS answerable_n,
  {s.r('sum(hallucination_n) / sum(n_eval)')} AS hallucination_rate, {s.r('sum(invent_n) / nullif(sum(unanswerable_n), 0)')} AS invent_rate,
  {s.r('sum(refusal_correct_n) / nullif(sum(unanswerable_n), 0)')} AS refusal_correct_rate, {s.r('sum(wrong_n) / nullif(sum(answerable_n), 0)')} AS wrong_rate FROM h GROUP BY 1, 2""",
)
def hallucination_by_model(t: Tables):
    return mining.hallucination_by_model(_stats(t), CANDIDATE)


@query(
    "showcase_stats",
    f"""WITH {_CASES_SQL}, n AS (SELECT model, count(*) FILTER (WHERE condition = 'candidate') AS n_eval_rows FROM v_pred GROUP BY 1)
SELECT model, n_eval_rows, count(case_id) AS n_cases, count(*) FILTER (WHERE candidate_gold_alignment >= 4) AS n_strong,
  count(*) FILTER (WHERE candidate_gold_alignment >= 4 AND pattern = 'refusal') AS n_strong_refusal, count(*) FILTER (WHERE candidate_gold_alignment >= 4 AND pattern = 'judge_gap') AS n_strong_gap,
  {s.r('count(case_id) / n_eval_rows')} AS case_rate FROM n LEFT JOIN cases USING (model) GROUP BY 1, 2""",
)
def showcase_stats(t: Tables):
    return mining.showcase_stats(_catalog(t), _stats(t), CANDIDATE)


# ---- resources


@query(
    "span_rollup",
    f"SELECT step, count(*) AS n_spans, {s.r('sum(duration_s)', 3)} AS total_s, max(duration_s) AS max_s FROM v_spans GROUP BY 1",
)
def span_rollup(t: Tables):
    return resources.span_rollup(t.spans)


@query(
    "timing_stats",
    f"""SELECT step, count(*) AS n, {s.r('sum(duration_s)', 3)} AS sum_s, {s.r('avg(duration_s)', 3)} AS mean_s, {s.r('min(duration_s)', 3)} AS min_s, {s.r('max(duration_s)', 3)} AS max_s,
  {s.hms('avg(duration_s)')} AS mean_hms, {s.hms('sum(duration_s)')} AS total_hms,
  {s.r('list_sort(list(duration_s))[greatest(1, CAST(floor(0.5::DOUBLE * count(*)) AS BIGINT))]', 3)} AS p50_s,
  {s.r('list_sort(list(duration_s))[greatest(1, CAST(floor(0.9::DOUBLE * count(*)) AS BIGINT))]', 3)} AS p90_s FROM v_spans GROUP BY 1""",
)
def timing_stats(t: Tables):
    return resources.timing_stats(t.spans)


# Runs with the timing fields of a report, one per document.
_RUNS_SQL = """runs AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'repliqa' WHEN 1 THEN 'quoref' ELSE 'squad' END AS dataset, CASE WHEN doc_id % 10 = 0 THEN 'gemma3_4b' ELSE 'model_' || lang END AS model_slug,
  CASE WHEN doc_id % 7 = 0 THEN 'VLLM' WHEN doc_id % 7 = 1 THEN '' ELSE 'hf' END AS backend, n_chars * 2 AS n_questions, n_chars * 2 - doc_id % 900 AS n_preds, CAST(doc_id % 4 AS DOUBLE) AS mean_s FROM documents)"""


def _runs(t: Tables):
    i = F.col("doc_id")
    return t.table("documents").select(
        "doc_id",
        F.when(i % 3 == 0, "repliqa").when(i % 3 == 1, "quoref").otherwise("squad").alias("dataset"),
        F.when(i % 10 == 0, "gemma3_4b").otherwise(F.concat(F.lit("model_"), "lang")).alias("model_slug"),
        F.when(i % 7 == 0, "VLLM").when(i % 7 == 1, "").otherwise("hf").alias("backend"),
        (F.col("n_chars") * 2).alias("n_questions"),
        (F.col("n_chars") * 2 - i % 900).alias("n_preds"),
        (i % 4).cast("double").alias("mean_s"),
    )


_WANT = "CASE dataset " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.EXPECTED_EVAL_ROWS.items()) + " END * 0.95::DOUBLE"


@query(
    "timing_reliability",
    f"""WITH {_RUNS_SQL} SELECT doc_id, reason AS timing_reason, reason = 'ok' AS timing_reliable FROM (SELECT doc_id, CASE WHEN starts_with(model_slug, 'gemma3_') THEN 'gemma_mixed_backends'
  WHEN lower(backend) = 'vllm' THEN 'vllm_batch' WHEN n_questions > 0 AND n_questions < {_WANT} THEN 'partial_shard' WHEN n_preds > 0 AND n_preds < {_WANT} THEN 'partial_preds'
  WHEN mean_s <= 0 THEN 'zero_mean' ELSE 'ok' END AS reason FROM runs)""",
)
def timing_reliability(t: Tables):
    return resources.timing_reliability(_runs(t)).select("doc_id", "timing_reason", "timing_reliable")


@query(
    "normalize_timing",
    f"""WITH r AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'repliqa' WHEN 1 THEN 'quoref' ELSE 'squad' END AS dataset, n_chars AS n_questions, n_chars - doc_id % 900 AS n_preds FROM documents),
f AS (SELECT *, CASE WHEN doc_id % 10 = 0 THEN 'gemma_mixed_backends' WHEN doc_id % 6 = 0 THEN 'vllm_batch' WHEN n_questions > 0 AND n_questions < {_WANT} THEN 'partial_shard'
  WHEN n_preds > 0 AND n_preds < {_WANT} THEN 'partial_preds' END AS reason FROM r)
SELECT doc_id, lang AS condition, CASE WHEN doc_id % 2 = 0 THEN '4bit' END AS load_type, CASE WHEN doc_id % 6 = 0 THEN 'vllm' WHEN doc_id % 3 = 1 THEN 'flat' ELSE 'hf' END AS backend, n_chars AS n_questions,
  CAST(CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE doc_id END AS DOUBLE) AS total_wall_s, {s.hms('CAST(CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE doc_id END AS DOUBLE)')} AS total_wall_hms,
  CASE WHEN reason IS NULL THEN CAST(CASE WHEN doc_id % 2 = 0 THEN 61.5 ELSE 2.5 END AS DOUBLE) END AS mean_s_per_question,
  CASE WHEN reason IS NULL THEN CASE WHEN doc_id % 2 = 0 THEN '00:01:02' ELSE '2.5 s' END END AS mean_s_per_question_hms,
  CAST(CASE WHEN doc_id % 2 = 0 THEN 1.25 END AS DOUBLE) AS p50_s, CAST(CASE WHEN doc_id % 2 = 0 THEN 2.75 END AS DOUBLE) AS p90_s, CAST(doc_id % 7 AS BIGINT) AS peak_mb,
  reason IS NULL AS timing_reliable, reason AS timing_skip_reason FROM f""",
)
def normalize_timing(t: Tables):
    """Nested and flat layouts, comparable runs and others."""
    i, even = F.col("doc_id"), F.col("doc_id") % 2 == 0
    number = F.lit(None).cast("double")
    nested = F.struct(
        number.alias("load_model_s"), F.col("n_chars").cast("double").alias("total_wall_s"), F.lit(None).cast("string").alias("total_wall_hms"),
        F.struct(F.lit(61.5).alias("mean_s"), F.lit(1.25).alias("p50_s"), F.lit(2.75).alias("p90_s")).alias("generate_per_question"),
    )
    raw = t.table("documents").select(
        F.when(even, F.concat_ws("#", "lang", i.cast("string"))).otherwise("").alias("condition"),
        F.concat_ws("#", "lang", i.cast("string")).alias("model_id"), F.when(even, "4bit").alias("load_type"),
        F.struct(F.when(i % 6 == 0, "vllm").alias("backend")).alias("decoding"),
        F.when(i % 3 == 1, "flat").otherwise("").alias("backend"),
        F.when(i % 3 == 0, "repliqa").when(i % 3 == 1, "quoref").otherwise("squad").alias("dataset"),
        F.when(i % 10 == 0, "gemma3_4b").otherwise("other").alias("model_slug"),
        F.when(even, F.col("n_chars")).otherwise(0).alias("n_questions"), F.col("n_chars").alias("n_rows"), (F.col("n_chars") - i % 900).alias("n_preds"),
        F.when(even, nested).alias("timing"), number.alias("load_s"), i.cast("double").alias("total_wall_s"),
        F.struct(F.lit(2.5).alias("mean_s"), F.when(~even, "2.5 s").alias("mean_hms")).alias("generate"), F.struct((i % 7).alias("peak_mb")).alias("memory"),
    )
    out = resources.normalize_timing(raw)
    return out.select(
        F.split_part("condition", F.lit("#"), F.lit(2)).cast("bigint").alias("doc_id"),
        F.split_part("condition", F.lit("#"), F.lit(1)).alias("condition"), "load_type", "backend", "n_questions", "total_wall_s", "total_wall_hms",
        "mean_s_per_question", "mean_s_per_question_hms", F.col("p50_s_per_question").alias("p50_s"), F.col("p90_s_per_question").alias("p90_s"),
        F.col("memory.peak_mb").alias("peak_mb"), "timing_reliable", "timing_skip_reason",
    )


_PARTS = [
    ("uniform", "view"), ("uniform", "click"), ("tiered", "view"), ("tiered", "signup"), ("tiered", "purchase"), ("adaptive", "error"),
]
_PARTS_SQL = "parts(condition, step) AS (VALUES " + ", ".join(f"('{c}', '{p}')" for c, p in _PARTS) + ")"


@query(
    "resource_rollup",
    f"""WITH {_PARTS_SQL}, per_step AS (SELECT step, sum(duration_s) AS sec, count(*) AS n FROM v_spans GROUP BY 1), users AS (SELECT step, count(*) AS u FROM parts GROUP BY 1)
SELECT condition, {s.r('sum(sec)', 3)} AS total_s, CAST(sum(n) AS BIGINT) AS n_spans, count(*) AS n_steps, count(*) FILTER (WHERE u > 1) AS n_shared_steps, {s.hms('sum(sec)')} AS total_hms
FROM parts JOIN per_step USING (step) JOIN users USING (step) GROUP BY 1""",
)
def resource_rollup(t: Tables):
    parts = t.spark.createDataFrame(_PARTS, "condition string, step string")
    return resources.resource_rollup(t.spans, parts)


_STEPS = ["click", "error", "purchase", "signup", "view"]


@query(
    "resource_matrix",
    "SELECT bucket, " + ", ".join(f"round_even(sum(value) FILTER (WHERE event_type = '{x}'), 3) AS {x}" for x in _STEPS)
    + " FROM (SELECT user_id % 10 AS bucket, event_type, value FROM events) GROUP BY 1",
)
def resource_matrix(t: Tables):
    rows = t.table("events").select((F.col("user_id") % 10).alias("bucket"), "event_type", "value")
    return resources.pivot_sum(rows, ["bucket"], "event_type", _STEPS, "value")


@query(
    "score_matrix",
    f"""WITH x AS (SELECT model, dataset, condition, CASE WHEN NOT (model = 'es' AND condition = 'baseline_b') THEN gold_alignment END AS v, length(pred) AS n FROM v_pred),
m AS (SELECT model, dataset, {", ".join(f"avg(v) FILTER (WHERE condition = '{a}') AS {a}_s, count(*) FILTER (WHERE condition = '{a}') AS {a}_n, avg(n) FILTER (WHERE condition = '{a}') AS {a}_t" for a in ARMS)} FROM x GROUP BY 1, 2)
SELECT model, dataset, {", ".join(f"CASE WHEN {a}_n = 0 THEN '—' WHEN {a}_s IS NULL THEN 'blocked' ELSE printf('%.2f', round_even({a}_s, 2)) END AS {a}" for a in ARMS)},
  {s.r('candidate_s - baseline_a_s')} AS delta, {s.r('baseline_a_t / nullif(candidate_t, 0)')} AS speedup FROM m""",
)
def score_matrix(t: Tables):
    blocked = (F.col("model") == "es") & (F.col("condition") == "baseline_b")
    rows = t.pred.select(
        "model", "dataset", "condition", F.when(~blocked, F.col("gold_alignment")).alias("gold_alignment"),
        F.length("pred").cast("double").alias("duration_s"),
    )
    return resources.score_matrix(rows, ["model", "dataset"], ARMS, "baseline_a", "candidate")
