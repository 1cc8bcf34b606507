"""Views of the test tables in the shape the operators take, as DataFrames and as SQL.

Scores and outcomes the tables do not hold are plain integer arithmetic on row keys, so both engines
see the same values. The views are inputs, not operators.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qassay.constants import REFUSAL_GOLD, TRAIN_RUBRIC_VERSION

ARMS = ("candidate", "baseline_a", "baseline_b")
REFUSALS = (REFUSAL_GOLD, "This cannot be answered from the text.", "The document does not mention it.")


def h(a: Column, b: Column, m: int) -> Column:
    return (a * 7919 + b * 104729) % m


def arm_score(conv: Column, turn: Column, arm: int, k: int) -> Column:
    if k == 4:  # gold alignment moves apart from the other scores
        return 1 + (conv * (3 + arm) + turn * (5 + 2 * arm) + arm + (arm + 1) * F.floor(conv / 5)) % 5
    return 1 + (conv * (7 + 2 * arm) + turn * (3 + arm) + k * (arm + 1) + arm * arm) % 5


class Tables:
    """Lazily built views over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def docs(self) -> DataFrame:
        return self.table("documents").select(
            F.col("doc_id").cast("string").alias("document_id"),
            F.col("text").alias("context"),
            F.col("lang").alias("document_topic"),
            "source",
            F.col("doc_id").alias("ord"),
        )

    @cached_property
    def turns(self) -> DataFrame:
        """User turns with the assistant turn that follows."""
        c = self.table("conversations")
        reply = c.filter(F.col("role") == "assistant").select(
            "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
        )
        return c.filter(F.col("role") == "user").join(reply, ["conv_id", "turn"]).select(
            "conv_id", "turn", F.col("text").alias("question"), "answer"
        )

    @cached_property
    def qa(self) -> DataFrame:
        d = self.table("documents").select(
            F.col("doc_id").alias("conv_id"), F.col("text").alias("context"), F.col("lang").alias("document_topic"), "source"
        )
        row_id = F.concat_ws("::", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        return self.turns.join(d, "conv_id").select(
            "conv_id", "turn",
            row_id.alias("eval_id"), row_id.alias("chunk_id"),
            F.col("conv_id").cast("string").alias("document_id"),
            "document_topic", "source", "context", "question", "answer",
            (F.col("conv_id") * (1 << 32) + F.col("turn")).alias("ord"),
        )

    @cached_property
    def judged(self) -> DataFrame:
        conv, turn = F.col("conv_id"), F.col("turn")
        g, r, dn, o = [F.least(F.lit(5), 1 + (conv * (k + 2) + turn * (2 * k + 3) + k) % 8).cast("double") for k in range(4)]
        ga = (1 + h(conv, turn, 5)).cast("double")
        bad, skip = h(conv, turn, 17) == 0, (h(conv, turn, 19) == 0) & (h(conv, turn, 17) != 0)
        error = F.when(
            bad,
            F.when(conv % 3 == 0, "parse_error").when(conv % 3 == 1, "api_error: timeout")
            .otherwise("missing_context_question_or_answer"),
        )
        ok = ~bad & ~skip
        worst = F.least(g, r, dn, o)
        tier = (
            F.when(bad, F.lit(None)).when(skip | (g <= 2), "drop").when(worst <= 2, "low").when(worst >= 4, "high")
            .otherwise("medium")
        )
        judge = F.struct(
            F.lit(TRAIN_RUBRIC_VERSION).alias("prompt_version"),
            *[F.when(ok, v).alias(n) for n, v in (("grounding", g), ("relevance", r), ("document_necessity", dn), ("overall", o))],
            F.when(ok & (conv % 2 == 0), ga).alias("gold_alignment"),
            F.when(ok, h(conv, turn, 13) == 0).alias("refuse_expected"),
            F.when(ok, F.concat(F.lit("reason "), turn.cast("string"))).alias("brief_reason"),
            tier.alias("quality_tier"),
            error.alias("error"),
            skip.alias("skipped"),
        )
        return self.qa.withColumn("llm_judge", judge).withColumn(
            "answer", F.when(h(conv, turn, 19) == 0, "nan").otherwise(F.col("answer"))
        )

    @cached_property
    def pred(self) -> DataFrame:
        """Three arms per question with judged scores; model is the topic, dataset the source."""
        conv, turn, a = F.col("conv_id"), F.col("turn"), F.col("answer")
        items = self.table("benchmark").select(F.col("item_id").alias("_item"), F.col("text").alias("_bench"))
        n_items = self.table("benchmark").agg(F.count(F.lit(1))).scalar()
        w = F.split(a, "[ \n]+")
        texts = [
            F.array_join(F.slice(w, F.lit(1), F.ceil(F.size(w) * 0.6).cast("int")), " "),
            F.col("_bench"),
            F.array_join(F.reverse(w), " "),
        ]
        refusal = F.element_at(F.array(*[F.lit(x) for x in REFUSALS]), (conv % 3 + 1).cast("int"))
        arms = [
            F.struct(
                F.lit(k).alias("arm"),
                F.lit(name).alias("condition"),
                F.when(h(conv, turn + k, 9) == 0, refusal).when(h(conv, turn + k, 41) == 0, "nan").otherwise(texts[k]).alias("pred"),
                *[
                    arm_score(conv, turn, k, i).cast("double").alias(n)
                    for i, n in enumerate(("grounding", "relevance", "document_necessity", "overall"))
                ],
                F.when(h(conv, turn + k, 31) != 0, arm_score(conv, turn, k, 4).cast("double")).alias("gold_alignment"),
            )
            for k, name in enumerate(ARMS)
        ]
        gold = F.when(h(conv, turn, 4) == 0, REFUSAL_GOLD).otherwise(a)
        return (
            self.qa.withColumn("_item", conv % n_items)
            .join(items, "_item")
            .withColumn("gold", gold)
            .withColumn("_x", F.explode(F.array(*arms)))
            .select(
                "conv_id", "turn", "eval_id", "document_id", "question", "gold", "context", "ord",
                F.col("document_topic").alias("model"), F.col("source").alias("dataset"), "document_topic", "source",
                "_x.*", F.concat(F.lit("reason "), F.col("_x.condition")).alias("brief_reason"),
            )
        )

    @cached_property
    def rank(self) -> DataFrame:
        """Listwise results: arms ranked by a hash; some rows failed, some miss an arm."""
        conv, turn = F.col("conv_id"), F.col("turn")
        row_id = F.concat_ws("::", conv.cast("string"), turn.cast("string"))
        arms = F.filter(
            F.array(*[F.struct(F.md5(F.concat(row_id, F.lit(a))).alias("k"), F.lit(a).alias("c")) for a in ARMS]),
            lambda s: (s["c"] != "baseline_b") | (h(conv, turn, 29) != 0),
        )
        names = F.transform(F.array_sort(arms), lambda s: s["c"])
        n = F.size("_names")
        return (
            self.turns.select("conv_id", "turn", row_id.alias("eval_id"), names.alias("_names"))
            .withColumn("error", F.when(h(conv, turn, 23) == 0, "parse_error"))
            .withColumn("n_candidates", n)
            .withColumn("ranks_by_condition", F.map_from_arrays("_names", F.transform("_names", lambda c, i: (i + 1).cast("double"))))
            .withColumn("points_by_condition", F.map_from_arrays("_names", F.transform("_names", lambda c, i: (n - i).cast("double"))))
            .drop("_names")
        )

    @cached_property
    def multi(self) -> DataFrame:
        """Raw multi-answer rows: the lines of the answer as gold texts, every third type missing."""
        lines = F.split("answer", "\n")
        types = F.transform(
            F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))),
            lambda t: F.when(F.length(t) % 3 == 0, "number").when(F.length(t) % 3 == 1, "date").otherwise("span"),
        )
        none = h(F.col("conv_id"), F.col("turn"), 6) == 0
        return self.qa.select(
            "conv_id", "turn",
            F.col("eval_id").alias("id"), F.col("eval_id").alias("query_id"),
            F.col("document_topic").alias("title"),
            F.col("document_id").alias("section_id"),
            "context", F.col("context").alias("passage"), "question",
            F.struct(F.when(none, F.array().cast("array<string>")).otherwise(lines).alias("text")).alias("answers"),
            F.struct(F.when(none, F.array().cast("array<string>")).otherwise(lines).alias("spans"), types.alias("types")).alias("answers_spans"),
            F.col("source").alias("split"), "ord",
        )

    @cached_property
    def teacher(self) -> DataFrame:
        """Labels as teacher scores next to synthetic student scores."""
        i = F.col("doc_id")
        t = [(1 + (i * (3 + k) + F.col("quality") * 2 + k) % 5).cast("int") for k in range(4)]
        s = [(1 + (i * (3 + k) + F.col("quality") * 2 + k + (i % (7 + k) == 0).cast("int")) % 5).cast("int") for k in range(4)]
        names = ("grounding", "relevance", "document_necessity", "overall")
        tier = (
            F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "high")
            .when(F.col("quality") == 1, "medium")
            .when(F.col("toxic") == 0, "low")
        )
        return self.table("labels").select(
            i.cast("string").alias("eval_id"),
            F.when(i % 29 == 0, "none").otherwise("text").alias("answer"),
            tier.alias("teacher_quality_tier"),
            F.struct(*[v.alias(n) for n, v in zip(names, t)]).alias("teacher_judge"),
            F.struct(*[v.alias(n) for n, v in zip(names, s)], F.when(i % 23 == 0, "parse_error").alias("error")).alias("student_judge"),
        )

    @cached_property
    def vec(self) -> DataFrame:
        """Each vector with the next one of the table when both carry the same label or an even id."""
        e = self.table("embeddings")
        left = e.select("vec_id", "label", F.col("embedding").alias("left"))
        right = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("right"))
        return left.join(right, "vec_id").select("vec_id", "label", "left", "right")

    @cached_property
    def spans(self) -> DataFrame:
        return self.table("events").select(F.col("event_type").alias("step"), F.col("value").alias("duration_s"))

    @cached_property
    def md(self) -> DataFrame:
        """Documents with every fifth line turned into a heading."""
        lines = F.transform(
            F.split("text", "\n"), lambda line, i: F.when(i % 5 == 4, F.concat(F.lit("## "), line)).otherwise(line)
        )
        return self.table("documents").select(
            F.col("doc_id").cast("string").alias("source"), F.array_join(lines, "\n").alias("md")
        )


def h_sql(a: str, b: str, m: int) -> str:
    return f"((({a}) * 7919 + ({b}) * 104729) % {m})"


def arm_score_sql(arm: int, k: int) -> str:
    if k == 4:
        return f"(1 + (conv_id * {3 + arm} + turn * {5 + 2 * arm} + {arm} + {arm + 1} * (conv_id // 5)) % 5)"
    return f"(1 + (conv_id * {7 + 2 * arm} + turn * {3 + arm} + {k * (arm + 1) + arm * arm}) % 5)"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _arm_sql(k: int, name: str, text: str) -> str:
    refusal = "[" + ", ".join(_quote(x) for x in REFUSALS) + "][CAST(conv_id % 3 + 1 AS INT)]"
    scores = ", ".join(
        f"CAST({arm_score_sql(k, i)} AS DOUBLE) AS {n}"
        for i, n in enumerate(("grounding", "relevance", "document_necessity", "overall"))
    )
    return f"""
SELECT conv_id, turn, eval_id, document_id, question, gold, context, ord, document_topic AS model, source AS dataset,
  document_topic, source, {k} AS arm, '{name}' AS condition,
  CASE WHEN {h_sql('conv_id', f'turn + {k}', 9)} = 0 THEN {refusal}
       WHEN {h_sql('conv_id', f'turn + {k}', 41)} = 0 THEN 'nan' ELSE {text} END AS pred,
  {scores},
  CASE WHEN {h_sql('conv_id', f'turn + {k}', 31)} <> 0 THEN CAST({arm_score_sql(k, 4)} AS DOUBLE) END AS gold_alignment,
  'reason {name}' AS brief_reason
FROM v_gold"""


_SCORES = [f"CAST(least(5, 1 + (conv_id * {k + 2} + turn * {2 * k + 3} + {k}) % 8) AS DOUBLE)" for k in range(4)]
_SCORES.append(f"CAST(1 + {h_sql('conv_id', 'turn', 5)} AS DOUBLE)")
_BAD = f"{h_sql('conv_id', 'turn', 17)} = 0"
_SKIP = f"({h_sql('conv_id', 'turn', 19)} = 0 AND {h_sql('conv_id', 'turn', 17)} <> 0)"
_OK = f"(NOT ({_BAD}) AND NOT {_SKIP})"
_WORST = f"least({', '.join(_SCORES[:4])})"

VIEWS_SQL: dict[str, str] = {
    "v_docs": """
SELECT CAST(doc_id AS VARCHAR) AS document_id, text AS context, lang AS document_topic, source, doc_id AS ord FROM documents""",
    "v_turns": """
SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'""",
    "v_qa": """
SELECT t.conv_id, t.turn, t.conv_id || '::' || t.turn AS eval_id, t.conv_id || '::' || t.turn AS chunk_id,
  CAST(t.conv_id AS VARCHAR) AS document_id, d.lang AS document_topic, d.source, d.text AS context, t.question, t.answer,
  t.conv_id * 4294967296 + t.turn AS ord
FROM v_turns t JOIN documents d ON d.doc_id = t.conv_id""",
    "v_judged": f"""
SELECT conv_id, turn, eval_id, chunk_id, document_id, document_topic, source, context, question,
  CASE WHEN {h_sql('conv_id', 'turn', 19)} = 0 THEN 'nan' ELSE answer END AS answer, ord,
  CASE WHEN {_OK} THEN {_SCORES[0]} END AS grounding, CASE WHEN {_OK} THEN {_SCORES[1]} END AS relevance,
  CASE WHEN {_OK} THEN {_SCORES[2]} END AS document_necessity, CASE WHEN {_OK} THEN {_SCORES[3]} END AS overall,
  CASE WHEN {_OK} AND conv_id % 2 = 0 THEN {_SCORES[4]} END AS gold_alignment,
  CASE WHEN {_OK} THEN {h_sql('conv_id', 'turn', 13)} = 0 END AS refuse_expected,
  CASE WHEN {_OK} THEN 'reason ' || turn END AS brief_reason,
  CASE WHEN {_BAD} THEN NULL WHEN {_SKIP} OR {_SCORES[0]} <= 2 THEN 'drop' WHEN {_WORST} <= 2 THEN 'low'
       WHEN {_WORST} >= 4 THEN 'high' ELSE 'medium' END AS quality_tier,
  CASE WHEN {_BAD} THEN CASE WHEN conv_id % 3 = 0 THEN 'parse_error' WHEN conv_id % 3 = 1 THEN 'api_error: timeout'
       ELSE 'missing_context_question_or_answer' END END AS error,
  {_SKIP} AS skipped
FROM v_qa""",
    "v_gold": f"""
SELECT q.*, CASE WHEN {h_sql('q.conv_id', 'q.turn', 4)} = 0 THEN {_quote(REFUSAL_GOLD)} ELSE q.answer END AS gold,
  b.text AS bench, regexp_split_to_array(q.answer, '[ \\n]+') AS w
FROM v_qa q JOIN benchmark b ON b.item_id = q.conv_id % (SELECT count(*) FROM benchmark)""",
    "v_pred": " UNION ALL ".join(
        [
            _arm_sql(0, "candidate", "array_to_string(list_slice(w, 1, CAST(ceil(len(w) * 0.6) AS INT)), ' ')"),
            _arm_sql(1, "baseline_a", "bench"),
            _arm_sql(2, "baseline_b", "array_to_string(list_reverse(w), ' ')"),
        ]
    ),
    "v_rank": f"""
SELECT eval_id, conv_id, turn, condition, CAST(row_number() OVER (PARTITION BY eval_id ORDER BY md5(eval_id || condition)) AS DOUBLE) AS rank_value,
  CAST(count(*) OVER (PARTITION BY eval_id) + 1 - row_number() OVER (PARTITION BY eval_id ORDER BY md5(eval_id || condition)) AS DOUBLE) AS points,
  CASE WHEN {h_sql('conv_id', 'turn', 23)} = 0 THEN 'parse_error' END AS error
FROM (SELECT conv_id || '::' || turn AS eval_id, conv_id, turn, unnest(['candidate', 'baseline_a', 'baseline_b']) AS condition FROM v_turns)
WHERE condition <> 'baseline_b' OR {h_sql('conv_id', 'turn', 29)} <> 0""",
    "v_multi": f"""
SELECT conv_id, turn, eval_id, document_topic AS title, document_id AS section_id, context, question, source AS split, ord,
  CASE WHEN {h_sql('conv_id', 'turn', 6)} = 0 THEN [] ELSE string_split(answer, chr(10)) END AS texts,
  list_transform(list_slice(string_split(answer, chr(10)), 1, len(string_split(answer, chr(10))) - 1),
    lambda t: CASE WHEN length(t) % 3 = 0 THEN 'number' WHEN length(t) % 3 = 1 THEN 'date' ELSE 'span' END) AS types
FROM v_qa""",
    "v_teacher": """
SELECT CAST(doc_id AS VARCHAR) AS eval_id, CASE WHEN doc_id % 29 = 0 THEN 'none' ELSE 'text' END AS answer,
  CASE WHEN quality = 1 AND toxic = 0 THEN 'high' WHEN quality = 1 THEN 'medium' WHEN toxic = 0 THEN 'low' END AS teacher_quality_tier,
"""
    + ",\n".join(f"  1 + (doc_id * {3 + k} + quality * 2 + {k}) % 5 AS t{k}" for k in range(4))
    + ",\n"
    + ",\n".join(
        f"  1 + (doc_id * {3 + k} + quality * 2 + {k} + CAST(doc_id % {7 + k} = 0 AS INT)) % 5 AS s{k}" for k in range(4)
    )
    + ",\n  CASE WHEN doc_id % 23 = 0 THEN 'parse_error' END AS s_error\nFROM labels",
    "v_vec": """
SELECT l.vec_id, l.label, l.embedding AS lft, r.embedding AS rgt FROM embeddings l JOIN embeddings r ON r.vec_id = l.vec_id + 1""",
    "v_spans": "SELECT event_type AS step, value AS duration_s FROM events",
    "v_md": """
SELECT CAST(doc_id AS VARCHAR) AS source,
  array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 5 = 0 THEN '## ' || x ELSE x END), chr(10)) AS md
FROM documents""",
}
