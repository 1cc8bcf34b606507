"""Queries over documents and question/answer rows: normalising, chunking, requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from qassay import constants as C
from qassay.functions import formats, judging, text
from qassay.operators import chunking, enrich, normalize, requests, splitting
from qassay.plans import sqltext as s
from qassay.plans.registry import query
from qassay.plans.views import Tables, h, h_sql

# ---- normalisers and filters


def _single(t: Tables):
    """Raw single-answer rows: some answers unanswerable, some questions blank."""
    conv, turn = F.col("conv_id"), F.col("turn")
    return t.qa.select(
        "document_id",
        F.when(h(conv, turn, 7) != 0, F.col("eval_id")).alias("question_id"),
        F.col("context").alias("document_extracted"),
        F.when(h(conv, turn, 10) == 0, "  ").otherwise(F.col("question")).alias("question"),
        F.when(h(conv, turn, 6) == 0, "Unanswerable").otherwise(F.concat(F.col("answer"), F.lit(" \n"))).alias("answer"),
        F.col("answer").alias("long_answer"), "document_topic", F.col("source").alias("split"),
    )


@query(
    "norm_single_answer",
    f"""SELECT CASE WHEN {h_sql('conv_id', 'turn', 7)} <> 0 THEN eval_id ELSE document_id END AS chunk_id, document_id,
  'corpus/' || source AS source, md5({s.strip('context')}) AS context_md5, {s.strip('question')} AS question,
  {s.strip('answer')} AS answer, document_topic
FROM v_qa WHERE {h_sql('conv_id', 'turn', 10)} <> 0 AND {h_sql('conv_id', 'turn', 6)} <> 0 AND {s.strip('context')} <> ''""",
)
def norm_single_answer(t: Tables):
    return normalize.normalize_single_answer(_single(t), "corpus", drop_unanswerable=True).select(
        "chunk_id", "document_id", "source", F.md5("context").alias("context_md5"), "question", "answer", "document_topic"
    )


_MULTI_SQL = f"""
SELECT eval_id, 'corpus_' || sha256({s.strip('title')})[1:8] || '_' || sha256({s.strip('context')})[1:16] AS section_id,
  'corpus/' || split AS source,
  array_to_string(list_filter(list_transform(texts, lambda x: {s.strip('x')}), lambda x: x <> ''), '|') AS answers,
  len(list_filter(list_transform(texts, lambda x: {s.strip('x')}), lambda x: x <> '')) AS n_answers
FROM v_multi WHERE {s.strip('context')} <> '' AND {s.strip('question')} <> ''"""


@query("norm_multi_answer", f"SELECT *, n_answers = 0 AS unanswerable FROM ({_MULTI_SQL})")
def norm_multi_answer(t: Tables):
    return normalize.normalize_multi_answer(t.multi, "corpus").select(
        "eval_id", "section_id", "source", F.array_join("answers.text", "|").alias("answers"),
        F.size("answers").alias("n_answers"), "unanswerable",
    )


@query("norm_multi_answer_strict", f"SELECT eval_id, section_id, source, answers FROM ({_MULTI_SQL}) WHERE n_answers > 0")
def norm_multi_answer_strict(t: Tables):
    return normalize.normalize_multi_answer(t.multi, "corpus", require_answer=True).select(
        "eval_id", "section_id", "source", F.array_join("answers.text", "|").alias("answers")
    )


_SPAN_SQL = f"""
SELECT eval_id, section_id, split, list_filter(list_transform(texts, lambda x, i:
    {{'text': {s.strip('x')}, 'type': CASE WHEN i <= len(types) THEN types[i] ELSE 'span' END}}), lambda p: p.text <> '') AS answers
FROM v_multi WHERE {s.strip('context')} <> '' AND {s.strip('question')} <> ''"""


@query(
    "norm_span_types",
    f"""SELECT eval_id, section_id, array_to_string(list_transform(answers, lambda p: p.type || '=' || p.text), '|') AS answers
FROM ({_SPAN_SQL}) WHERE len(answers) > 0""",
)
def norm_span_types(t: Tables):
    pairs = F.transform("answers", lambda p: F.concat_ws("=", p["type"], p["text"]))
    return normalize.normalize_typed_spans(t.multi, "corpus").select(
        "eval_id", "section_id", F.array_join(pairs, "|").alias("answers")
    )


@query(
    "answer_type_counts",
    f"""SELECT CASE WHEN len(list_distinct(list_transform(answers, lambda p: p.type))) > 1 THEN 'mixed' ELSE answers[1].type END
  AS answer_type, count(*) AS n_rows FROM ({_SPAN_SQL}) WHERE len(answers) > 0 GROUP BY 1""",
)
def answer_type_counts(t: Tables):
    return normalize.answer_type_counts(normalize.normalize_typed_spans(t.multi, "corpus"))


@query(
    "eval_record",
    f"""SELECT eval_id, document_id, {s.strip('question')} AS question, {s.strip('answer')} AS gold,
  length({s.strip('context')}) AS context_chars FROM v_qa""",
)
def eval_record(t: Tables):
    return normalize.eval_record(t.qa).select(
        "eval_id", "document_id", "question", "gold", F.length("context").alias("context_chars")
    )


_USABLE = f"({s.strip('context')} <> '' AND {s.strip('question')} <> '' AND NOT {s.invalid('answer')})"


@query("usable_rows", f"SELECT eval_id, answer FROM v_judged WHERE {_USABLE}")
def usable_rows(t: Tables):
    return splitting.usable_rows(t.judged).select("eval_id", "answer")


_TRAINABLE = f"{_USABLE} AND NOT skipped AND error IS NULL AND gold_alignment IS NULL AND overall IS NOT NULL"


@query("trainable_judged_rows", f"SELECT eval_id, quality_tier FROM v_judged WHERE {_TRAINABLE}")
def trainable_judged_rows(t: Tables):
    return splitting.trainable_judged_rows(t.judged).select("eval_id", "llm_judge.quality_tier")


@query("tier_filter", "SELECT eval_id, quality_tier FROM v_judged WHERE quality_tier IN ('high', 'medium')")
def tier_filter(t: Tables):
    return splitting.filter_by_tier(t.judged, "high+medium").select("eval_id", "llm_judge.quality_tier")


@query(
    "doc_id_derive",
    f"""SELECT eval_id, CASE WHEN conv_id % 3 = 0 THEN document_id WHEN conv_id % 3 = 1 THEN split_part(eval_id, '::', 1)
  ELSE 'unknown' END AS derived_id FROM v_qa""",
)
def doc_id_derive(t: Tables):
    own = F.when(F.col("conv_id") % 3 == 0, F.col("document_id")).otherwise(" ")
    other = F.when(F.col("conv_id") % 3 == 2, "").otherwise(F.col("eval_id"))
    return t.qa.select("eval_id", judging.document_id(own, other).alias("derived_id"))


@query(
    "passage_id",
    f"""SELECT document_id, CASE WHEN ord % 5 = 0 THEN 'p' || document_id
  ELSE 'tag_' || CASE WHEN ord % 2 = 0 THEN sha256(source)[1:8] || '_' ELSE '' END || sha256({s.strip('context')})[1:16] END AS passage_id
FROM v_docs""",
)
def passage_id(t: Tables):
    given = F.when(F.col("ord") % 5 == 0, F.concat(F.lit("p"), "document_id"))
    title = F.when(F.col("ord") % 2 == 0, F.col("source"))
    return t.docs.select("document_id", judging.passage_id("tag", F.col("context"), title, given).alias("passage_id"))


_BLANK_PRED = f"CASE WHEN {h_sql('conv_id', 'turn', 6)} = 0 THEN '  ' ELSE pred END"
_BLANK_QUESTION = f"CASE WHEN {h_sql('conv_id', 'turn', 10)} = 0 THEN '  ' ELSE question END"


def _first_sql(*texts: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({s.strip(x)}, '')" for x in texts) + ", '')"


@query(
    "resolve_fields",
    f"""SELECT CASE WHEN conv_id % 2 = 0 THEN eval_id ELSE 'c' || eval_id END AS row_key,
  {_first_sql('p', 'q')} AS pred, {_first_sql('g', 'q')} AS gold, {_first_sql('p', 'q')} AS judged_text
FROM (SELECT *, CASE WHEN turn % 4 = 0 THEN {_BLANK_PRED} END AS p, {_BLANK_QUESTION} AS q,
  CASE WHEN conv_id % 5 <> 0 THEN gold END AS g FROM v_pred)""",
)
def resolve_fields(t: Tables):
    """All rows, some with blank predictions or questions."""
    conv, turn = F.col("conv_id"), F.col("turn")
    question = F.when(h(conv, turn, 10) == 0, "  ").otherwise(F.col("question"))
    rows = t.pred.select(
        F.when(conv % 2 == 0, F.col("eval_id")).otherwise(" ").alias("eval_id"),
        F.concat(F.lit("c"), "eval_id").alias("chunk_id"),
        F.when(turn % 4 == 0, F.when(h(conv, turn, 6) == 0, "  ").otherwise(F.col("pred"))).alias("pred"),
        question.alias("prediction"),
        F.when(conv % 5 != 0, F.col("gold")).alias("gold"),
        question.alias("answer"),
    )
    return normalize.resolve_fields(rows)


@query(
    "gold_texts",
    f"""WITH x AS (SELECT eval_id, CASE WHEN turn % 3 = 0 THEN '' WHEN turn % 3 = 1 THEN gold END AS g, question AS a,
  list_filter(list_transform(string_split(CASE WHEN conv_id % 2 = 0 THEN gold || chr(10) || ' ' || chr(10) || question || ' ' ELSE ' ' END, chr(10)), lambda t: {s.strip('t')}), lambda t: t <> '') AS l FROM v_pred WHERE condition = 'candidate')
SELECT eval_id, len(CASE WHEN len(l) > 0 THEN l WHEN {s.strip("coalesce(nullif(g, ''), a, '')")} <> '' THEN [{s.strip("coalesce(nullif(g, ''), a, '')")}] ELSE [] END) AS n_golds,
  md5(array_to_string(CASE WHEN len(l) > 0 THEN l WHEN {s.strip("coalesce(nullif(g, ''), a, '')")} <> '' THEN [{s.strip("coalesce(nullif(g, ''), a, '')")}] ELSE [] END, '|')) AS golds_md5 FROM x""",
)
def gold_texts(t: Tables):
    """Every question once: half of them with a list of answers, the others with only blanks in it."""
    listed = F.when(F.col("conv_id") % 2 == 0, F.concat("gold", F.lit("\n \n"), "question", F.lit(" "))).otherwise(" ")
    rows = t.pred.filter("condition = 'candidate'").select(
        "eval_id",
        F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, F.col("gold")).alias("gold"),
        F.col("question").alias("answer"),
        F.transform(F.split(listed, "\n"), lambda x: F.struct(x.alias("text"))).alias("answers"),
    )
    golds = normalize.gold_texts(rows)
    return golds.select("eval_id", F.size("golds").alias("n_golds"), F.md5(F.array_join("golds", "|")).alias("golds_md5"))


@query(
    "clean_markdown",
    """SELECT document_id, md5(replace(replace(x, chr(13), ''), chr(10) || chr(10) || chr(10), chr(10) || chr(10))) AS text_md5
FROM (SELECT document_id, replace(context, '. ', '.' || chr(13) || chr(10) || chr(10) || chr(10) || chr(10)) AS x FROM v_docs)""",
)
def clean_markdown(t: Tables):
    raw = t.docs.select("document_id", F.replace("context", F.lit(". "), F.lit(".\r\n\n\n\n")).alias("md"))
    return normalize.tidy_markdown(raw).select("document_id", F.md5("md").alias("text_md5"))


_DOMAINS = {"first": "src1", "second": "src2", "exact": "src10"}


@query(
    "domain_holdouts",
    " UNION ALL ".join(f"SELECT eval_id, source, '{d}' AS domain FROM v_qa WHERE starts_with(source, '{p}')" for d, p in _DOMAINS.items()),
)
def domain_holdouts(t: Tables):
    return enrich.domain_rows(t.qa, _DOMAINS).select("eval_id", "source", "domain")


@query(
    "question_metadata",
    """SELECT eval_id || CASE WHEN turn % 4 = 0 THEN '-q' || turn ELSE '' END AS eval_id, document_topic, 'unknown' AS split,
  CASE WHEN turn % 4 = 0 THEN CAST(turn AS INT) ELSE -1 END AS question_index_in_doc,
  document_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1) AS in_synthetic_train_document
FROM v_qa""",
)
def question_metadata(t: Tables):
    numbered = F.when(F.col("turn") % 4 == 0, F.concat("eval_id", F.lit("-q"), F.col("turn").cast("string")))
    rows = t.qa.withColumn("eval_id", F.coalesce(numbered, F.col("eval_id"))).withColumn("split", F.lit(" "))
    train = t.table("labels").filter("quality = 1").select(F.col("doc_id").cast("string").alias("document_id"))
    return enrich.question_metadata(rows, train).fillna(-1, ["question_index_in_doc"])


@query(
    "case_preview",
    f"""SELECT eval_id, condition, CASE WHEN length({s.strip('pred')}) <= 60 THEN {s.strip('pred')}
  ELSE {s.strip('pred')}[1:57] || '...' END AS preview FROM v_pred""",
)
def case_preview(t: Tables):
    return t.pred.select("eval_id", "condition", text.truncate(F.col("pred"), 60).alias("preview"))


# ---- chunking


def _sections(t: Tables):
    return chunking.md_sections(t.md)


# Line-based: a heading starts a section, blank bodies vanish.
_SECTION_SQL = f"""
lines AS (SELECT source, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS i FROM v_md),
marked AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{{1,6}}\\s') THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY i) AS sec FROM lines),
sections AS (SELECT source, sec, coalesce(max({s.strip('line')}) FILTER (WHERE regexp_matches(line, '^#{{1,6}}\\s')), 'INTRO') AS title,
  {s.strip("string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT regexp_matches(line, '^#{1,6}' || chr(92) || 's'))")} AS body
  FROM marked GROUP BY source, sec),
kept AS (SELECT source, title, body, row_number() OVER (PARTITION BY source ORDER BY sec) - 1 AS section_index FROM sections WHERE body <> '')
"""


@query(
    "md_sections",
    f"WITH {_SECTION_SQL} SELECT source, section_index, title, length(body) AS body_chars, md5(body) AS body_md5 FROM kept",
)
def md_sections(t: Tables):
    return _sections(t).select(
        "source", "section_index", "title", F.length("body").alias("body_chars"), F.md5("body").alias("body_md5")
    )


def _windows_sql(rel: str, key: str, body: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"""SELECT *, {s.strip(f'substr(b, k * {step} + 1, {size})')} AS piece FROM (
  SELECT {key}, b, unnest(range(CASE WHEN length(b) <= {size} THEN 1 ELSE CAST(ceil((length(b) - {size}) / {step}.0) AS BIGINT) + 1 END)) AS k
  FROM (SELECT {key}, {s.strip(body)} AS b FROM {rel}))"""


@query(
    "char_chunks",
    f"""SELECT document_id, k AS piece_index, length(piece) AS n_chars, md5(piece) AS piece_md5
FROM ({_windows_sql('v_docs', 'document_id', 'context', 6000, 200)}) WHERE piece <> ''""",
)
def char_chunks(t: Tables):
    return chunking.char_chunks(t.docs.select("document_id", "context"), "context").select(
        "document_id", "piece_index", F.length("piece").alias("n_chars"), F.md5("piece").alias("piece_md5")
    )


@query(
    "chunk_ids",
    f"""WITH {_SECTION_SQL}, pieces AS ({_windows_sql('kept', 'source, section_index, title', 'body', 1000, 100)})
SELECT source || '::' || (row_number() OVER (PARTITION BY source ORDER BY section_index, k) - 1) AS chunk_id, title, length(piece) AS n_chars
FROM pieces WHERE piece <> ''""",
)
def chunk_ids(t: Tables):
    return chunking.chunk_markdown(t.md, max_chars=1000, overlap=100).select(
        "chunk_id", "title", F.length("text").alias("n_chars")
    )


_WORD_CHUNKS = f"""
w AS (SELECT document_id, context, {s.words('context')} AS w FROM v_docs),
k AS (SELECT document_id, context, w, unnest(range(CASE WHEN len(w) <= 350 THEN 1 ELSE
  greatest(0, least(CAST(ceil((len(w) - 350) / 300.0) AS BIGINT), CAST(floor((len(w) - 80) / 300.0) AS BIGINT))) + 1 END)) AS k FROM w),
p AS (SELECT document_id, k, list_slice(w, k * 300 + 1, k * 300 + 350) AS part, len(w) <= 350 AS whole, context FROM k),
c AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY k) - 1 AS chunk_index,
  CASE WHEN whole THEN {s.strip('context')} ELSE array_to_string(part, ' ') END AS piece FROM p WHERE len(part) >= 80)
"""


@query(
    "word_chunks",
    f"""WITH {_WORD_CHUNKS} SELECT document_id || '::c' || printf('%02d', chunk_index) AS section_id, chunk_index, md5(piece) AS piece_md5,
  count(*) OVER (PARTITION BY document_id) AS n_chunks_in_doc FROM c""",
)
def word_chunks(t: Tables):
    return chunking.word_chunks(t.docs).select(
        "section_id", "chunk_index", F.md5("context").alias("piece_md5"), "n_chunks_in_doc"
    )


@query(
    "word_chunks_summary",
    f"""WITH {_WORD_CHUNKS}, n AS (SELECT d.document_id, count(c.document_id) AS n FROM v_docs d LEFT JOIN c USING (document_id) GROUP BY 1)
SELECT count(*) AS n_documents, CAST(sum(n) AS BIGINT) AS n_chunks, min(n) AS min_chunks, max(n) AS max_chunks, {s.r('avg(n)')} AS mean_chunks FROM n""",
)
def word_chunks_summary(t: Tables):
    return chunking.word_chunks_summary(t.docs)


@query(
    "doc_windows",
    f"""SELECT document_id, i AS "window", len(part) AS n_words, md5(array_to_string(part, ' ')) AS words_md5 FROM (
  SELECT document_id, i, list_slice(w, i * (len(w) // 5) + 1, CASE WHEN i = 4 THEN len(w) ELSE (i + 1) * (len(w) // 5) END) AS part
  FROM (SELECT document_id, {s.words('context')} AS w, unnest(range(5)) AS i FROM v_docs) WHERE len(w) >= 40)""",
)
def doc_windows(t: Tables):
    return chunking.doc_windows(t.docs).select(
        "document_id", "window", F.size("window_words").alias("n_words"),
        F.md5(F.array_join("window_words", " ")).alias("words_md5"),
    )


# ---- requests


@query(
    "excerpts",
    f"""WITH {_SECTION_SQL}, x AS (SELECT source, section_index,
  CASE WHEN title <> 'INTRO' THEN title || chr(10) || chr(10) || body ELSE body END AS excerpt FROM kept)
SELECT source, section_index, length(excerpt) AS n_chars, md5(excerpt) AS excerpt_md5 FROM x WHERE length(excerpt) >= 40""",
)
def excerpts(t: Tables):
    return normalize.excerpts(_sections(t).withColumnRenamed("body", "text")).select(
        "source", "section_index", F.length("excerpt").alias("n_chars"), F.md5("excerpt").alias("excerpt_md5")
    )


def fill_sql(template: str, **slots: str) -> str:
    """The template as SQL concatenation."""
    out = quote_parts = [template]
    for name, column in slots.items():
        nxt = []
        for part in quote_parts:
            if isinstance(part, tuple):
                nxt.append(part)
                continue
            pieces = part.split("{" + name + "}")
            for i, piece in enumerate(pieces):
                if i:
                    nxt.append((column,))
                nxt.append(piece)
        out = quote_parts = nxt
    sql = [f"CAST({p[0]} AS VARCHAR)" if isinstance(p, tuple) else s.quote(p) for p in out if p]
    return " || ".join(sql)


@query(
    "generation_requests",
    f"""SELECT document_id, pair_index, length(prompt) AS n_chars, md5(prompt) AS prompt_md5 FROM (
  SELECT document_id, unnest(range(2)) AS pair_index, {fill_sql(requests.GENERATE_TEMPLATE, pairs='1', passage=s.strip('context'))} AS prompt FROM v_docs)""",
)
def generation_requests(t: Tables):
    return requests.by_length(requests.generation_requests(t.docs, pairs=2)).select(
        "document_id", F.col("pair_index"), F.length("prompt").alias("n_chars"), F.md5("prompt").alias("prompt_md5")
    )


@query(
    "judge_requests",
    f"""SELECT eval_id, condition, presentation, md5(CASE WHEN presentation = 'gold_first'
  THEN {fill_sql(requests.GOLD_FIRST_TEMPLATE, context='context', question='question', gold='gold', answer='pred')}
  ELSE {fill_sql(requests.PRED_FIRST_TEMPLATE, context='context', question='question', gold='gold', answer='pred')} END) AS prompt_md5
FROM (SELECT *, unnest(['gold_first', 'pred_first']) AS presentation FROM v_pred)""",
)
def judge_requests(t: Tables):
    """Every arm, with whole contexts."""
    rows = t.pred.withColumn("answer", F.col("pred"))
    return requests.judge_requests(rows, both_orders=True).select(
        "eval_id", "condition", "presentation", F.md5("prompt").alias("prompt_md5")
    )


@query(
    "answer_requests",
    f"""SELECT eval_id, 'half' AS mode, md5('Context:' || chr(10) || {s.strip('context')}[1:CAST(floor(length({s.strip('context')}) * 0.5) AS BIGINT)]
    || chr(10) || chr(10) || 'Question: ' || {s.strip('question')} || chr(10) || chr(10)
    || 'Answer the question using only the context above. Be direct and concise.') AS prompt_md5 FROM v_qa
UNION ALL SELECT eval_id, 'none', md5('Question: ' || {s.strip('question')} || chr(10) || chr(10) || 'Answer concisely.') FROM v_qa
UNION ALL SELECT eval_id, 'classify', md5({fill_sql(requests.CLASSIFY_TEMPLATE, context=s.strip('context'), question=s.strip('question'), gold=s.strip('answer'))}) FROM v_qa""",
)
def answer_requests(t: Tables):
    parts = [
        requests.answer_requests(t.qa, fraction=0.5).withColumn("mode", F.lit("half")),
        requests.answer_requests(t.qa, use_context=False).withColumn("mode", F.lit("none")),
        requests.classifier_requests(t.qa.withColumn("gold", F.col("answer"))).withColumn("mode", F.lit("classify")),
    ]
    slim = [p.select("eval_id", "mode", F.md5("prompt").alias("prompt_md5")) for p in parts]
    return slim[0].unionByName(slim[1]).unionByName(slim[2])


_TARGET = "to_json({'grounding': CAST(grounding AS INT), 'relevance': CAST(relevance AS INT), 'document_necessity': CAST(document_necessity AS INT), 'overall': CAST(overall AS INT), 'refuse_expected': refuse_expected, 'brief_reason': brief_reason})"
_PAIR_JSON = f"to_json({{'question': {s.strip('question')}, 'answer': {s.strip('answer')}}})"


def _chat_sql(system: str, user: str, target: str) -> str:
    turns = [("system", s.quote(system)), ("user", user), ("assistant", f"CAST({target} AS VARCHAR)")]
    return "md5(CAST(to_json([" + ", ".join(f"{{'role': '{r}', 'content': {c}}}" for r, c in turns) + "]) AS VARCHAR))"


_JUDGE_USER = fill_sql(requests.JUDGE_TEMPLATE, context="context", question="question", answer=s.strip("answer"))
_GEN_USER = fill_sql(requests.GENERATE_TEMPLATE, pairs="1", passage=s.strip("context"))


@query(
    "sft_chat_rows",
    f"""SELECT eval_id, 'judge' AS kind, CAST({_TARGET} AS VARCHAR) AS target_json, {_chat_sql('Score answers.', _JUDGE_USER, _TARGET)} AS messages_md5 FROM v_judged WHERE {_TRAINABLE}
UNION ALL SELECT eval_id, 'generator', CAST({_PAIR_JSON} AS VARCHAR), {_chat_sql('Write questions.', _GEN_USER, _PAIR_JSON)} FROM v_judged WHERE {_USABLE}""",
)
def sft_chat_rows(t: Tables):
    rows = splitting.trainable_judged_rows(t.judged)
    parts = [
        requests.sft_judge_rows(rows, "Score answers.").withColumn("kind", F.lit("judge")),
        requests.sft_generator_rows(splitting.usable_rows(t.judged), "Write questions.").withColumn("kind", F.lit("generator")),
    ]
    slim = [p.select("eval_id", "kind", "target_json", F.md5(F.to_json("messages")).alias("messages_md5")) for p in parts]
    return slim[0].unionByName(slim[1])


@query(
    "request_ids",
    f"""WITH p AS (SELECT eval_id, row_number() OVER (ORDER BY ord) - 1 AS row_index,
  trim(regexp_replace('q/' || document_id || '?', '[^a-zA-Z0-9_-]', '_', 'g'), '_')[1:64] AS id FROM v_qa), f AS (SELECT id, min(row_index) AS row_index FROM p GROUP BY 1),
a AS (SELECT f.row_index, p.row_index AS k FROM f JOIN p ON f.id = p.id[1:54] || '_' || p.row_index),
taken AS (SELECT row_index FROM a WHERE k NOT IN (SELECT row_index FROM f) OR k IN (SELECT row_index FROM a))
SELECT eval_id, CASE WHEN row_index IN (SELECT row_index FROM f) AND row_index NOT IN (SELECT row_index FROM taken) THEN id ELSE id[1:54] || '_' || row_index END AS request_id FROM p""",
)
def request_ids(t: Tables):
    rows = t.qa.select("eval_id", "ord", F.concat(F.lit("q/"), "document_id", F.lit("?")).alias("raw_id"))
    return requests.request_ids(rows, raw_id="raw_id").select("eval_id", "request_id")


# ---- scalar text functions


@query("normalize_text", f"SELECT document_id, md5({s.norm('context')}) AS text_md5 FROM v_docs")
def normalize_text(t: Tables):
    return t.docs.select("document_id", F.md5(text.normalize_text(F.col("context"))).alias("text_md5"))


@query("invalid_answers", f"SELECT eval_id, condition, {s.invalid('pred')} AS invalid FROM v_pred")
def invalid_answers(t: Tables):
    return t.pred.select("eval_id", "condition", text.is_invalid_answer(F.col("pred")).alias("invalid"))


@query(
    "word_counts",
    f"SELECT document_id, {s.word_count('context')} AS n_tokens, len({s.words('context')}) AS n_words FROM v_docs",
)
def word_counts(t: Tables):
    return t.docs.select(
        "document_id", text.word_count(F.col("context")).alias("n_tokens"),
        F.size(text.words(F.col("context"))).alias("n_words"),
    )


_STARTER = f"""CASE WHEN q = '' THEN 'empty' WHEN f IN {s.in_list(C.WH_WORDS)} THEN f WHEN f IN {s.in_list(C.YES_NO_STARTERS)} THEN 'yes_no' ELSE 'other' END"""
_LEADS = ("What ", "how many ", "Is ", "WHO ", "Does it ", "whose ", "How ", "", "which-", "Had ")


def _lead(col_a="conv_id", col_b="turn") -> str:
    leads = "[" + ", ".join(s.quote(x) for x in _LEADS) + "]"
    return f"({leads}[CAST({h_sql(col_a, col_b, len(_LEADS))} AS INT) + 1] || question)"


def with_leads(rows):
    """Questions with an English lead word, so that every question form occurs."""
    leads = F.array(*[F.lit(x) for x in _LEADS])
    pick = (h(F.col("conv_id"), F.col("turn"), len(_LEADS)) + 1).cast("int")
    return rows.withColumn("question", F.concat(F.element_at(leads, pick), "question"))


@query(
    "question_starters",
    f"""SELECT eval_id, {_STARTER} AS starter FROM (SELECT eval_id, lower({s.strip('x')}) AS q,
  regexp_extract(lower({s.strip('x')}), '^([\\p{{L}}\\p{{N}}_]+)', 1) AS f FROM (SELECT eval_id, {_lead()} AS x FROM v_qa))""",
)
def question_starters(t: Tables):
    return with_leads(t.qa).select("eval_id", judging.question_starter(F.col("question")).alias("starter"))


_HEUR = "CASE WHEN regexp_matches(q, '^how (many|much)\\b') THEN 'other' " + " ".join(
    f"WHEN regexp_matches(q, '^({forms})\\b') THEN '{label}'"
    for label, forms in [
        ("what", "what"), ("who", "who|whom|whose"), ("when", "when"), ("where", "where"), ("why", "why"), ("how", "how"),
        ("which", "which"), ("yes_no", "|".join(C.YES_NO_HEURISTIC)),
    ]
) + " ELSE 'other' END"


@query(
    "heuristic_classes",
    f"""SELECT eval_id, {_HEUR} AS question_type,
  CASE WHEN g <> '' AND contains(c, g) THEN 'explicit_span' ELSE 'paraphrase' END AS answer_evidence,
  CASE WHEN g <> '' AND contains(c, g) THEN 'low' ELSE 'medium' END AS finetuning_expected_gain,
  CASE WHEN n <= 3 THEN 'entity' WHEN regexp_matches(g, '[0-9]|january|february') THEN 'date_or_number' WHEN n <= 12 THEN 'short_phrase' ELSE 'sentence' END AS answer_form
FROM (SELECT eval_id, lower({s.strip('x')}) AS q, {s.norm('a')} AS g, {s.norm('context')} AS c, {s.word_count('lower(a)')} AS n
  FROM (SELECT eval_id, {_lead()} AS x, context, CASE WHEN turn % 4 = 0 THEN context[1:40] WHEN conv_id % 3 = 0 THEN answer[1:30] || ' 7' ELSE answer END AS a FROM v_qa))""",
)
def heuristic_classes(t: Tables):
    a = (
        F.when(F.col("turn") % 4 == 0, text.head(F.col("context"), 40))
        .when(F.col("conv_id") % 3 == 0, F.concat(text.head(F.col("answer"), 30), F.lit(" 7")))
        .otherwise(F.col("answer"))
    )
    rows = with_leads(t.qa).withColumn("answer", a)
    evidence = judging.heuristic_evidence(F.col("context"), F.col("answer"))
    return rows.select(
        "eval_id", judging.heuristic_question_type(F.col("question")).alias("question_type"),
        evidence.alias("answer_evidence"),
        F.when(evidence == "explicit_span", "low").otherwise("medium").alias("finetuning_expected_gain"),
        judging.heuristic_answer_form(F.col("answer")).alias("answer_form"),
    )


def answer_type_sql(a: str, refuse: str) -> str:
    n = s.word_count(a)
    return f"""CASE WHEN {s.refusal_gold(a)} OR coalesce({refuse}, false) THEN 'unanswerable_refusal' WHEN {n} <= 3 THEN 'short_span'
  WHEN regexp_full_match({s.strip(a)}, '[0-9.,\\-%+\\s]+') THEN 'numeric' WHEN {n} <= 12 AND NOT ends_with({s.strip(a)}, '.') THEN 'short_span'
  WHEN {n} <= 20 THEN 'medium_span' ELSE 'explanatory' END"""


@query(
    "answer_types",
    f"""SELECT eval_id, {answer_type_sql('a', 'refuse_expected')} AS answer_type FROM (SELECT eval_id, refuse_expected,
  CASE WHEN turn % 4 = 0 THEN answer[1:60] WHEN conv_id % 5 = 0 THEN '1,2 3 4% 5' ELSE answer END AS a FROM v_judged)""",
)
def answer_types(t: Tables):
    a = (
        F.when(F.col("turn") % 4 == 0, text.head(F.col("answer"), 60)).when(F.col("conv_id") % 5 == 0, "1,2 3 4% 5")
        .otherwise(F.col("answer"))
    )
    return t.judged.select("eval_id", judging.answer_type(a, F.col("llm_judge.refuse_expected")).alias("answer_type"))


@query(
    "gold_mode",
    f"""SELECT eval_id, CASE WHEN len(texts) = 0 THEN {s.quote(C.REFUSAL_GOLD)} ELSE coalesce((SELECT {s.strip('x')} FROM
  (SELECT unnest(texts || [texts[2]]) AS x, generate_subscripts(texts || [texts[2]], 1) AS i) WHERE {s.strip('x')} <> ''
  GROUP BY {s.strip('x')} ORDER BY count(*) DESC, min(i) LIMIT 1), '') END AS gold FROM v_multi""",
)
def gold_mode(t: Tables):
    texts = F.col("answers.text")
    twice = F.when(F.size(texts) > 0, F.concat(texts, F.array(F.get(texts, 1)))).otherwise(texts)
    answers = F.transform(twice, lambda x: F.struct(x.alias("text"), F.lit("span").alias("type")))
    return t.multi.select(
        F.col("id").alias("eval_id"), judging.gold_reference(answers, F.lit(False), F.lit("")).alias("gold")
    )


@query(
    "display_formats",
    f"""SELECT step, {s.hms('t')} AS hms,
  CASE WHEN z // 3600 > 0 THEN printf('%dh %02dm', z // 3600, z % 3600 // 60) WHEN z % 3600 // 60 > 0 THEN printf('%dm %02ds', z // 60, z % 60)
    ELSE printf('%ds', z) END AS duration, printf('%.1f%%', round(100.0 * n / sum(n) OVER (), 1)) AS share
FROM (SELECT step, sum(duration_s) AS t, CAST(round_even(sum(duration_s), 0) AS BIGINT) AS z, count(*) AS n FROM v_spans GROUP BY step)""",
)
def display_formats(t: Tables):
    steps = t.spans.groupBy("step").agg(F.sum("duration_s").alias("t"), F.count(F.lit(1)).alias("n"))
    total = t.spans.agg(F.count(F.lit(1))).scalar()
    return steps.select(
        "step", formats.hms(F.col("t")).alias("hms"), formats.duration(F.col("t")).alias("duration"),
        formats.percent(F.round(100.0 * F.col("n") / total, 1)).alias("share"),
    )


