"""Queries for files, shards, parsing of responses and the streaming roll-up.

Their inputs are written from the views to a new folder below the shared checkpoint folder first, or
built as text columns from the views, so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qassay import schemas
from qassay.functions import judging
from qassay.operators import responses, splitting
from qassay.plans import sqltext as s
from qassay.plans.registry import query, scratch
from qassay.plans.views import ARMS, Tables, h, h_sql
from qassay.sources import discovery, jsonl, markdown, shards
from qassay.streaming.spans import start_span_rollup

# ---- files


@query("scan_jsonl", "SELECT eval_id, question, answer, length(context) AS context_chars, ord FROM v_qa")
def scan_jsonl(t: Tables):
    path = scratch(t.spark, "qa")
    jsonl.write_jsonl(t.qa.select("eval_id", "question", "answer", "context", "ord"), path)
    rows = jsonl.read_jsonl(t.spark, path, "eval_id string, question string, answer string, context string, ord bigint")
    return rows.select("eval_id", "question", "answer", F.length("context").alias("context_chars"), "ord")


@query(
    "scan_jsonl_bad_rows",
    """SELECT count(*) FILTER (WHERE turn % 4 <> 0) AS n_good, count(*) FILTER (WHERE turn % 4 = 0) AS n_bad,
  CAST(sum(length(question)) FILTER (WHERE turn % 4 <> 0) AS BIGINT) AS question_chars FROM v_qa""",
)
def scan_jsonl_bad_rows(t: Tables):
    path = scratch(t.spark, "qa-bad")
    good = F.to_json(F.struct("eval_id", "question"))
    # Every row is followed by a blank line; rows of each fourth turn are cut off in the middle.
    line = F.when(F.col("turn") % 4 == 0, F.substr(good, F.lit(1), F.floor(F.length(good) / 2).cast("int"))).otherwise(good)
    t.qa.select(F.concat(line, F.lit("\n")).alias("value")).write.text(path)
    rows = jsonl.read_jsonl_tolerant(t.spark, path, schemas.struct_type("eval_id string, question string"))
    bad = F.col("_bad_line").isNotNull()
    return rows.agg(
        F.count_if(~bad).alias("n_good"), F.count_if(bad).alias("n_bad"), F.sum(F.when(~bad, F.length("question"))).alias("question_chars")
    )


@query(
    "bad_json_lines",
    """WITH lines AS (SELECT doc_id % 16 AS part, doc_id, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 7 = 0 THEN '{"doc_id": ' || doc_id || ', "text": "cut' ELSE 'good' END AS line,
  row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id) AS no FROM documents)
SELECT CAST(part AS BIGINT) AS part, no AS line, line AS text FROM lines WHERE doc_id % 5 <> 0 AND doc_id % 7 = 0""",
)
def bad_json_lines(t: Tables):
    """Whole texts as JSON lines in sixteen files; some lines are blank, some are cut off."""
    path, i = scratch(t.spark, "bad-lines"), F.col("doc_id")
    cut = F.concat(F.lit('{"doc_id": '), i.cast("string"), F.lit(', "text": "cut'))
    line = F.when(i % 5 == 0, "").when(i % 7 == 0, cut).otherwise(F.to_json(F.struct("doc_id", "text")))
    rows = t.table("documents").select((i % 16).alias("part"), "doc_id", line.alias("value"))
    rows.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(path)
    found = jsonl.bad_lines(t.spark, path, schemas.struct_type("doc_id bigint, text string"))
    return found.select(F.regexp_extract("file", r"part=(\d+)", 1).cast("bigint").alias("part"), "line", "text")


def _write_conditions(t: Tables) -> str:
    root = scratch(t.spark, "predictions")
    for arm in ARMS:
        jsonl.write_jsonl(t.pred.filter(F.col("condition") == arm).select("eval_id", "pred", "gold", "ord"), f"{root}/{arm}/predictions.jsonl")
    return root


_PRED_SCHEMA = "eval_id string, pred string, gold string, ord bigint"


@query("scan_conditions", "SELECT condition, eval_id, pred FROM v_pred")
def scan_conditions(t: Tables):
    return discovery.scan_conditions(t.spark, _write_conditions(t), _PRED_SCHEMA).select("condition", "eval_id", "pred")


@query("scan_index", "SELECT condition, count(*) AS n_rows, CAST(sum(length(pred)) AS BIGINT) AS pred_chars FROM v_pred GROUP BY 1")
def scan_index(t: Tables):
    root = _write_conditions(t)
    entries = F.map_from_entries(
        F.collect_list(
            F.struct("condition", F.struct(F.concat(F.lit(f"{root}/"), "condition", F.lit("/predictions.jsonl")).alias("predictions_jsonl")))
        )
    )
    t.pred.select("condition").distinct().agg(entries.alias("conditions")).coalesce(1).write.json(f"{root}/index.json")
    rows = discovery.scan_index(t.spark, f"{root}/index.json", _PRED_SCHEMA)
    return rows.groupBy("condition").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("pred")).alias("pred_chars"))


@query(
    "filter_conditions",
    "SELECT eval_id, condition, CASE condition WHEN 'baseline_b' THEN 1 ELSE 2 END AS condition_order FROM v_pred WHERE condition <> 'baseline_a'",
)
def filter_conditions(t: Tables):
    return discovery.filter_conditions(t.pred, ["baseline_b", "candidate"]).select("eval_id", "condition", "condition_order")


@query("scan_markdown", "SELECT length(md) AS n_chars, md5(md) AS md_md5 FROM v_md")
def scan_markdown(t: Tables):
    path = scratch(t.spark, "markdown")
    # One file per document, each ended with one line break.
    markdown.write_texts(t.md.select("md"), path)
    rows = markdown.scan_markdown(t.spark, path, file_glob="*.txt")
    body = F.regexp_replace("md", "\\n\\z", "")
    return rows.select(F.length(body).alias("n_chars"), F.md5(body).alias("md_md5"))


_SUMMARY_SCHEMA = "condition string, model_id_from_rows string, input_jsonl string, n_rows bigint, mean_overall double"


@query(
    "scan_judge_summaries",
    f"SELECT 'run_' || document_topic AS condition, count(*) AS n_rows, {s.r('avg(overall)')} AS mean_overall FROM v_judged GROUP BY 1",
)
def scan_judge_summaries(t: Tables):
    root = scratch(t.spark, "judged")
    table = t.judged.groupBy("document_topic").agg(
        F.count(F.lit(1)).alias("n_rows"), F.bround(F.avg("llm_judge.overall"), 4).alias("mean_overall")
    )
    doc = table.select(
        F.lit("judged").alias("condition"), F.lit("").alias("model_id_from_rows"),
        F.concat(F.lit("/data/run_"), "document_topic", F.lit("/predictions.jsonl")).alias("input_jsonl"), "n_rows", "mean_overall",
    )
    # The backup folder must not be read.
    for name in ("good", "good.bad_1"):
        doc.write.option("maxRecordsPerFile", 1).json(f"{root}/{name}/judge_summary.json")
    return discovery.scan_judge_summaries(t.spark, root, _SUMMARY_SCHEMA).select("condition", "n_rows", "mean_overall")


@query("scan_runs", "SELECT document_topic AS run_name, count(*) AS n_rows, CAST(sum(turn) AS BIGINT) AS turns FROM v_qa GROUP BY 1")
def scan_runs(t: Tables):
    root = scratch(t.spark, "artifacts")
    topics = [r[0] for r in t.table("documents").select("lang").distinct().collect()]  # one per language
    for topic in topics:
        t.qa.filter(F.col("document_topic") == topic).select("eval_id", "turn").write.json(f"{root}/runs/{topic}/eval/listwise_rank")
    rows = discovery.scan_runs(t.spark, root, "eval_id string, turn bigint", "*.json")
    return rows.groupBy("run_name").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("turn").alias("turns"))


@query("sink_roundtrip", "SELECT eval_id, md5(question) AS question_md5, md5(answer) AS answer_md5 FROM v_qa")
def sink_roundtrip(t: Tables):
    path = scratch(t.spark, "sink")
    jsonl.write_jsonl(t.qa.select("eval_id", "question", "answer"), path)
    rows = jsonl.read_jsonl(t.spark, path, "eval_id string, question string, answer string")
    return rows.select("eval_id", F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"))


@query(
    "summary_sink",
    f"""SELECT 'judge_stats/v1' AS schema, 42 AS seed, count(*) AS n_rows, {s.r("avg(overall) FILTER (WHERE NOT skipped AND error IS NULL)")} AS mean_overall FROM v_judged""",
)
def summary_sink(t: Tables):
    from qassay.operators.judged import judge_stats

    path = scratch(t.spark, "summary")
    jsonl.write_summary(judge_stats(t.judged), path, "judge_stats/v1", seed=42)
    doc = t.spark.read.schema("schema string, settings struct<seed:int>, stats struct<n_rows:bigint,mean_overall:double>").json(path)
    return doc.select("schema", "settings.seed", "stats.n_rows", "stats.mean_overall")


@query(
    "shard_merge_check",
    """SELECT 'shard' || printf('%06d', i * 128) || '_' || printf('%06d', least(i * 128 + 128, n)) AS shard, least(128, n - i * 128) AS n_rows, true AS contiguous
FROM (SELECT count(*) AS n, unnest(range((count(*) + 127) // 128)) AS i FROM v_docs)""",
)
def shard_merge_check(t: Tables):
    path = scratch(t.spark, "shards")
    shards.write_shards(splitting.shard_assign(t.docs.select("document_id", "source", "ord"), 128), path)
    merged = shards.merge_shards(t.spark, path, "document_id string, source string, ord bigint")
    return shards.shard_check(shards.shard_ranges(merged)).select("shard", "n_rows", "contiguous")


# ---- responses


def _qa_responses(t: Tables) -> DataFrame:
    """Responses as an object, a list, pairs, fenced, in prose, broken, or without an answer."""
    q, a, kind = F.col("question"), F.col("answer"), h(F.col("conv_id"), F.col("turn"), 7)
    one = F.struct(q.alias("question"), a.alias("answer"))
    two = F.struct(F.concat(q, F.lit(" (2)")).alias("question"), a.alias("answer"))
    raw = (
        F.when(kind == 0, F.to_json(one))
        .when(kind == 1, F.to_json(F.array(one, two)))
        .when(kind == 2, F.to_json(F.struct(F.array(one, two).alias("pairs"))))
        .when(kind == 3, F.concat(F.lit("```json\n"), F.to_json(one), F.lit("\n```")))
        .when(kind == 4, F.concat(F.lit("Here: "), F.to_json(one), F.lit(" done")))
        .when(kind == 5, F.concat(F.lit('{"question": "'), F.lit("cut off")))
        .otherwise(F.to_json(F.struct(q.alias("question"), F.lit(" ").alias("answer"))))
    )
    expected = F.when(kind.isin(1, 2), 2).otherwise(1)
    return t.qa.select(F.col("eval_id").alias("section_id"), expected.alias("expected"), raw.alias("raw"))


_KIND = h_sql("conv_id", "turn", 7)


@query(
    "parse_qa_pairs",
    f"""SELECT eval_id AS section_id, 0 AS synthetic_pair_index, eval_id || '::syn_00' AS chunk_id, {s.strip('question')} AS question, {s.strip('answer')} AS answer FROM v_qa WHERE {_KIND} <= 4
UNION ALL SELECT eval_id, 1, eval_id || '::syn_01', {s.strip("question || ' (2)'")}, {s.strip('answer')} FROM v_qa WHERE {_KIND} IN (1, 2)""",
)
def parse_qa_pairs(t: Tables):
    return responses.parse_qa_pairs(_qa_responses(t))


@query(
    "generation_outcomes",
    f"""SELECT eval_id AS section_id, CASE WHEN {_KIND} <= 4 THEN 'ok' WHEN {_KIND} = 5 THEN 'parse_error' ELSE 'empty_qa' END AS status,
  CASE WHEN {_KIND} IN (1, 2) THEN 2 WHEN {_KIND} <= 4 THEN 1 ELSE 0 END AS n_pairs_parsed, CASE WHEN {_KIND} IN (1, 2) THEN 2 ELSE 1 END AS expected_pairs FROM v_qa""",
)
def generation_outcomes(t: Tables):
    return responses.generation_outcomes(_qa_responses(t)).drop("raw_preview")


def _judge_responses(t: Tables) -> DataFrame:
    """Judge responses with scores as numbers, text, fractions, booleans and out of range."""
    kind = h(F.col("conv_id"), F.col("turn"), 8)
    g = (1 + F.col("conv_id") % 5).cast("string")

    def block(grounding, tail: str = "") -> F.Column:
        return F.concat(
            F.lit('{"grounding": '), grounding, F.lit(', "relevance": 4, "document_necessity": "5", "overall": 4.7, "gold_alignment": '),
            g, F.lit(', "refuse_expected": false, "brief_reason": "it is \\"fine\\""}'), F.lit(tail),
        )

    raw = (
        F.when(kind == 0, block(g))
        .when(kind == 1, block(F.concat(F.lit('"'), g, F.lit('"'))))
        .when(kind == 2, F.concat(F.lit("```\n"), block(g), F.lit("\n```")))
        .when(kind == 3, F.concat(F.lit("Scores: "), block(g), F.lit(" as asked.")))
        .when(kind == 4, block(F.lit("true")))
        .when(kind == 5, block(F.lit("6")))
        .when(kind == 6, block(F.lit('"4.5"')))
        .otherwise(block(g, ' {"overall": 1}'))
    )
    return t.qa.select("eval_id", "answer", raw.alias("raw"))


_JKIND = h_sql("conv_id", "turn", 8)
_G = "(1 + conv_id % 5)"


@query(
    "parse_judge",
    f"""SELECT eval_id, CAST({_G} AS DOUBLE) AS grounding, 4.0::DOUBLE AS relevance, 5.0::DOUBLE AS document_necessity, 4.0::DOUBLE AS overall, CAST({_G} AS DOUBLE) AS gold_alignment,
  {s.tier('answer', _G, '4', '5', '4')} AS quality_tier, 'it is "fine"' AS brief_reason FROM v_qa WHERE {_JKIND} <= 3""",
)
def parse_judge(t: Tables):
    rows = responses.parse_judge(_judge_responses(t)).filter("llm_judge.error IS NULL")
    j = ("grounding", "relevance", "document_necessity", "overall", "gold_alignment", "quality_tier", "brief_reason")
    return rows.select("eval_id", *[f"llm_judge.{x}" for x in j])


@query("parse_judge_errors", f"SELECT eval_id, 'parse_error' AS error FROM v_qa WHERE {_JKIND} > 3")
def parse_judge_errors(t: Tables):
    rows = responses.parse_judge(_judge_responses(t)).filter("llm_judge.error IS NOT NULL")
    return rows.select("eval_id", "llm_judge.error")


@query(
    "coerce_scores",
    """SELECT doc_id, kind, CASE kind WHEN 'int' THEN CASE WHEN v BETWEEN 1 AND 5 THEN v ELSE -1 END WHEN 'text' THEN CASE WHEN v BETWEEN 1 AND 5 THEN v ELSE -1 END
  WHEN 'fraction' THEN CASE WHEN v BETWEEN 1 AND 5 THEN v ELSE -1 END ELSE -1 END AS score
FROM (SELECT doc_id, doc_id % 8 AS v, unnest(['int', 'text', 'fraction', 'text_fraction', 'bool', 'null']) AS kind FROM documents)""",
)
def coerce_scores(t: Tables):
    v = (F.col("doc_id") % 8).cast("string")
    forms = {
        "int": v, "text": F.concat(F.lit('" '), v, F.lit('"')), "fraction": F.concat(v, F.lit(".7")),
        "text_fraction": F.concat(F.lit('"'), v, F.lit('.5"')), "bool": F.lit("true"), "null": F.lit("null"),
    }
    entries = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), x.alias("json")) for k, x in forms.items()]))
    rows = t.table("documents").select("doc_id", entries.alias("_e")).select("doc_id", "_e.*")
    score = judging.coerce_score(F.try_parse_json("json"))
    return rows.select("doc_id", "kind", F.coalesce(score, F.lit(-1)).alias("score"))


def _parsed_rankings(t: Tables) -> DataFrame:
    kind = h(F.col("conv_id"), F.col("turn"), 5)
    order = F.when(F.col("conv_id") % 2 == 0, '["A", " B", "C"]').otherwise('["C", "A", "B"]')
    good = F.concat(F.lit('{"ranking": '), order, F.lit(', "brief_reason": "x"}'))
    raw = (
        F.when(kind == 0, good).when(kind == 1, F.concat(F.lit("```json\n"), good, F.lit("```")))
        .when(kind == 2, F.concat(F.lit("I think "), good, F.lit(" fits.")))
        .when(kind == 3, '{"ranking": ["A", "A", "B"]}').otherwise('{"ranking": ["A", "B"]}')
    )
    labels = F.create_map(*[F.lit(x) for kv in zip("ABC", ARMS) for x in kv])
    return responses.parse_listwise(t.qa.select("eval_id", labels.alias("label_to_condition"), raw.alias("raw")))


@query(
    "parse_listwise",
    f"""SELECT eval_id, NULL AS error, condition, rank_value, 4 - rank_value AS points FROM (
  SELECT eval_id, conv_id, turn, unnest(['candidate', 'baseline_a', 'baseline_b']) AS condition, unnest(CASE WHEN conv_id % 2 = 0 THEN [1.0::DOUBLE, 2, 3] ELSE [2.0::DOUBLE, 3, 1] END) AS rank_value FROM v_qa)
WHERE {h_sql('conv_id', 'turn', 5)} < 3
UNION ALL SELECT eval_id, 'parse_error', NULL, NULL, NULL FROM v_qa WHERE {h_sql('conv_id', 'turn', 5)} >= 3""",
)
def parse_listwise(t: Tables):
    """Every response: its ranks, or one row with its error."""
    return _parsed_rankings(t).select(
        "eval_id", "error", "points_by_condition", F.explode_outer("ranks_by_condition").alias("condition", "rank_value")
    ).select("eval_id", "error", "condition", "rank_value", F.try_element_at("points_by_condition", F.col("condition")).alias("points"))


@query(
    "parse_classes",
    f"""SELECT eval_id, CASE WHEN k = 3 THEN 'failed' ELSE 'how' END AS question_type, CASE WHEN k = 3 THEN 'failed' WHEN k = 1 THEN 'multi_span' ELSE 'paraphrase' END AS answer_evidence,
  CASE WHEN k = 3 THEN 'failed' ELSE 'not_required' END AS document_necessity, CASE WHEN k = 3 THEN 'failed' ELSE 'short_phrase' END AS answer_form,
  CASE WHEN k = 3 THEN 'failed' WHEN k = 2 THEN 'high' ELSE 'medium' END AS gain FROM (SELECT eval_id, {h_sql('conv_id', 'turn', 4)} AS k FROM v_qa)""",
)
def parse_classes(t: Tables):
    kind = h(F.col("conv_id"), F.col("turn"), 4)
    head = '{"question_type": "How", "document_necessity": "is not-required", "answer_form": "unheard of", '
    raw = (
        F.when(kind == 0, head + '"answer_evidence": null}')
        .when(kind == 1, head + '"answer_evidence": "Multi Span"}')
        .when(kind == 2, "Sure: " + head + '"finetuning_expected_gain": "HIGH"} ok')
        .otherwise("no idea")
    )
    rows = responses.parse_classes(t.qa.select("eval_id", raw.alias("raw")))
    out = {"question_type": "question_type", "answer_evidence": "answer_evidence", "document_necessity": "document_necessity",
           "answer_form": "answer_form", "finetuning_expected_gain": "gain"}
    return rows.select("eval_id", *[F.coalesce(f"categories.{f}", F.lit("failed")).alias(n) for f, n in out.items()])


# ---- streaming


@query(
    "span_rollup_stream",
    f"SELECT step, count(*) AS n_spans, {s.r('sum(duration_s)', 3)} AS total_s, max(duration_s) AS max_s FROM v_spans GROUP BY 1",
)
def span_rollup_stream(t: Tables):
    events = (
        t.spark.readStream.schema(t.table("events").schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    )
    spans = events.select(F.col("event_type").alias("step"), F.col("value").alias("duration_s"))
    root = scratch(t.spark, "span-stream")
    start_span_rollup(spans, f"{root}/out", f"{root}/state").awaitTermination()
    return t.spark.read.parquet(f"{root}/out")
