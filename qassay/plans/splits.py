"""Queries for dedupe, splits, samples and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from qassay.operators import dedupe, passages, splitting
from qassay.plans import sqltext as s
from qassay.plans.corpus import _TRAINABLE, _USABLE
from qassay.plans.registry import query, scratch
from qassay.plans.views import Tables

# ---- dedupe

# Several rows per document: whole, short and blank contexts in two splits.
_RAW_SQL = """SELECT document_id, CASE WHEN turn % 3 = 0 THEN context[1:20] ELSE context END AS context, document_topic,
  CASE WHEN turn % 4 < 2 THEN 'a' ELSE 'b' END AS split, ord, turn, conv_id, source FROM v_qa"""


def _raw(t: Tables):
    return t.qa.withColumn(
        "context", F.when(F.col("turn") % 3 == 0, F.substring("context", 1, 20)).otherwise(F.col("context"))
    ).withColumn("split", F.when(F.col("turn") % 4 < 2, "a").otherwise("b"))


_FIRST_SQL = f"""raw AS ({_RAW_SQL}),
firsts AS (SELECT document_id, min(ord) AS first_ord FROM raw WHERE length({s.strip('context')}) >= 40 GROUP BY 1)"""


@query(
    "dedupe_first",
    f"""WITH {_FIRST_SQL}
SELECT document_id, md5(max({s.strip('context')}) FILTER (WHERE ord = first_ord)) AS context_md5, max(document_topic) FILTER (WHERE ord = first_ord) AS document_topic,
  count(*) AS n_source_rows, string_agg(DISTINCT split, ',' ORDER BY split) AS splits
FROM raw JOIN firsts USING (document_id) WHERE ord >= first_ord GROUP BY document_id""",
)
def dedupe_first(t: Tables):
    return dedupe.dedupe_first(_raw(t)).select(
        "document_id", F.md5("context").alias("context_md5"), "document_topic", "n_source_rows",
        F.array_join("splits", ",").alias("splits"),
    )


@query(
    "dedupe_first_stats",
    f"""WITH {_FIRST_SQL} SELECT count(*) AS input_rows, 0 AS skipped_missing_id,
  count(*) FILTER (WHERE length({s.strip('context')}) < 40 AND (first_ord IS NULL OR ord < first_ord)) AS skipped_short_context,
  (SELECT count(*) FROM firsts) AS n_unique FROM raw LEFT JOIN firsts USING (document_id)""",
)
def dedupe_first_stats(t: Tables):
    return dedupe.dedupe_first_stats(_raw(t))


@query(
    "dedupe_passages",
    f"""WITH raw AS (SELECT *, document_id || '::' || (turn // 2) AS section_id FROM ({_RAW_SQL})),
firsts AS (SELECT section_id, min(ord) AS first_ord FROM raw WHERE length({s.strip('context')}) >= 40 GROUP BY 1)
SELECT section_id, max(document_id) AS document_id, count(*) AS n_source_rows FROM raw JOIN firsts USING (section_id) WHERE ord >= first_ord GROUP BY 1""",
)
def dedupe_passages(t: Tables):
    rows = _raw(t).withColumn(
        "section_id", F.concat_ws("::", "document_id", F.floor(F.col("turn") / 2).cast("string"))
    )
    return dedupe.dedupe_first(rows, key="section_id", keep=("document_id",), split=None).select(
        "section_id", "document_id", "n_source_rows"
    )


_PASSAGES_SQL = f"""p AS (SELECT source AS section_id, {s.strip('context')} AS context, ord FROM v_docs WHERE length({s.strip('context')}) >= 40 AND ord % 4 <> 0
UNION ALL SELECT 'qa_' || sha256(document_topic)[1:8] || '_' || sha256({s.strip('context')})[1:16], {s.strip('context')}, ord FROM v_docs
WHERE length({s.strip('context')}) >= 40 AND ord % 4 = 0),
best AS (SELECT section_id, context, row_number() OVER (PARTITION BY section_id ORDER BY length(context) DESC, ord) AS rn FROM p)"""


def _passage_rows(t: Tables):
    """Three of four rows carry their source as a section id, the others get a digest."""
    given = F.when(F.col("ord") % 4 != 0, F.col("source"))
    return t.docs.withColumn("section_id", given).withColumn("title", F.col("document_topic"))


@query(
    "dedupe_longest",
    f"WITH {_PASSAGES_SQL} SELECT section_id, length(context) AS char_count, md5(context || chr(10)) AS text_md5 FROM best WHERE rn = 1",
)
def dedupe_longest(t: Tables):
    return dedupe.dedupe_longest(_passage_rows(t)).select("section_id", "char_count", F.md5("text").alias("text_md5"))


@query(
    "passage_corpus_manifest",
    f"""WITH {_PASSAGES_SQL} SELECT (SELECT count(*) FROM v_docs) AS input_qa_rows,
  (SELECT count(*) FROM v_docs WHERE {s.strip('context')} = '') AS skipped_missing_context,
  (SELECT count(*) FROM v_docs WHERE {s.strip('context')} <> '' AND length({s.strip('context')}) < 40) AS skipped_short,
  count(DISTINCT section_id) AS unique_passages, count(*) - count(DISTINCT section_id) AS duplicate_section_rows FROM p""",
)
def passage_corpus_manifest(t: Tables):
    return dedupe.passage_corpus_manifest(_passage_rows(t))


@query(
    "dedupe_eval_id",
    """SELECT source AS split, document_topic AS eval_id, document_id FROM v_docs
QUALIFY row_number() OVER (PARTITION BY source, document_topic ORDER BY ord) = 1""",
)
def dedupe_eval_id(t: Tables):
    rows = t.docs.select(F.col("source").alias("split"), F.col("document_topic").alias("eval_id"), "document_id", "ord")
    return dedupe.dedupe_eval_id(rows).select("split", "eval_id", "document_id")


# ---- splits

_STRATA_SQL = f"""ranked AS (SELECT document_id, source, row_number() OVER (PARTITION BY source ORDER BY {s.hash_key(42, 'document_id')}) AS rn,
  count(*) OVER (PARTITION BY source) AS n FROM v_docs),
sized AS (SELECT *, greatest(1, round_even(n * 0.1::DOUBLE, 0)) AS v, greatest(1, round_even(n * {1.0 - 0.8 - 0.1!r}::DOUBLE, 0)) AS te FROM ranked),
labelled AS (SELECT document_id, source, CASE WHEN n = 1 THEN 'train' WHEN n = 2 THEN CASE WHEN rn = 1 THEN 'train' ELSE 'val' END
  WHEN rn <= n - v - te THEN 'train' WHEN rn <= n - te THEN 'val' ELSE 'test' END AS split FROM sized)"""


def _strata(t: Tables):
    return splitting.stratified_split(t.docs.select("document_id", "source"), key="document_id")


@query("stratified_split", f"WITH {_STRATA_SQL} SELECT * FROM labelled")
def stratified_split(t: Tables):
    return _strata(t).select("document_id", "source", "split")


@query("stratified_split_counts", f"WITH {_STRATA_SQL} SELECT source, split, count(*) AS n_rows FROM labelled GROUP BY 1, 2")
def stratified_split_counts(t: Tables):
    return _strata(t).groupBy("source", "split").agg(F.count(F.lit(1)).alias("n_rows"))


def group_split_sql(rel: str, seed="42", where: str = "true") -> str:
    """Rows of a relation with the split of their document."""
    return f"""SELECT r.*, CASE WHEN g.rn <= least(g.n - 1, greatest(1, round_even(g.n * 0.1::DOUBLE, 0))) AND g.n > 1 THEN 'val' ELSE 'train' END AS split
FROM (SELECT * FROM {rel} WHERE {where}) r JOIN (SELECT document_id, row_number() OVER (ORDER BY {s.hash_key(seed, 'document_id')}) AS rn, count(*) OVER () AS n
  FROM (SELECT DISTINCT document_id FROM {rel} WHERE {where})) g USING (document_id)"""


@query("group_split", f"SELECT eval_id, document_id, split FROM ({group_split_sql('v_qa')})")
def group_split(t: Tables):
    return splitting.split_by_group(t.qa.select("eval_id", "document_id", "chunk_id")).select(
        "eval_id", "document_id", "split"
    )


@query(
    "group_split_manifest",
    f"SELECT split, count(DISTINCT document_id) AS n_documents, count(*) AS n_rows FROM ({group_split_sql('v_qa')}) GROUP BY 1",
)
def group_split_manifest(t: Tables):
    return splitting.split_manifest(splitting.split_by_group(t.qa.select("document_id", "chunk_id")))


_KEPT = f"quality_tier IN ('high', 'medium') AND {_USABLE}"


@query("sft_splits", f"SELECT eval_id, quality_tier, split FROM ({group_split_sql('v_judged', where=_KEPT)})")
def sft_splits(t: Tables):
    return splitting.sft_splits(t.judged, "high+medium").select("eval_id", "llm_judge.quality_tier", "split")


@query(
    "sft_split_counts",
    f"""SELECT count(*) AS n_input_rows, count(*) FILTER (WHERE quality_tier IN ('high', 'medium')) AS n_after_quality_tier,
  count(*) FILTER (WHERE quality_tier IN ('high', 'medium') AND NOT {_USABLE}) AS n_skipped_unusable,
  count(*) FILTER (WHERE quality_tier IS NULL) AS n_skipped_no_judge_tier FROM v_judged""",
)
def sft_split_counts(t: Tables):
    return splitting.sft_split_counts(t.judged, "high,medium")


_CORPORA = ("en", "de", "fr", "es")


@query(
    "multi_corpus_split",
    " UNION ALL ".join(
        f"SELECT eval_id, document_topic AS corpus, split, {'split = ' + s.quote('val') if c == 'fr' else 'false'} AS ood_test "
        f"FROM ({group_split_sql('v_judged', seed=42 + i, where=f'document_topic = {s.quote(c)} AND ' + _TRAINABLE)})"
        for i, c in enumerate(_CORPORA)
    ),
)
def multi_corpus_split(t: Tables):
    rows = splitting.trainable_judged_rows(t.judged).withColumn("corpus", F.col("document_topic"))
    return splitting.split_corpora(rows, _CORPORA, ood_corpus="fr").select("eval_id", "corpus", "split", "ood_test")


@query(
    "multi_corpus_ood_table",
    " UNION ALL ".join(
        f"SELECT eval_id, document_topic AS corpus, split, false AS ood_test FROM ({group_split_sql('v_judged', seed=42 + i, where=f'document_topic = {s.quote(c)} AND ' + _TRAINABLE)})"
        for i, c in enumerate(_CORPORA[:3])
    )
    + f" UNION ALL SELECT eval_id, NULL, NULL, true FROM v_judged WHERE document_topic = {s.quote(_CORPORA[3])} AND {_TRAINABLE}",
)
def multi_corpus_ood_table(t: Tables):
    """Three corpora are split; the rows of the fourth come as a test table of their own."""
    usable = splitting.trainable_judged_rows(t.judged)
    listed = usable.filter(F.col("document_topic").isin(*_CORPORA[:3])).withColumn("corpus", F.col("document_topic"))
    test = usable.filter(F.col("document_topic") == _CORPORA[3])
    return splitting.split_corpora(listed, _CORPORA[:3], ood_corpus="fr", ood_rows=test).select("eval_id", "corpus", "split", "ood_test")


@query(
    "zero_shot_holdout",
    f"SELECT eval_id, document_id FROM ({group_split_sql('v_judged', where=_TRAINABLE)}) WHERE split = 'val'",
)
def zero_shot_holdout(t: Tables):
    rows = splitting.split_by_group(splitting.trainable_judged_rows(t.judged))
    return rows.filter("split = 'val'").select("eval_id", "document_id")


@query(
    "random_holdout",
    f"""SELECT document_id, rn <= CASE WHEN n <= 1 THEN 0 WHEN greatest(1, floor(n * 0.05::DOUBLE)) >= n THEN greatest(1, n // 10)
  ELSE greatest(1, floor(n * 0.05::DOUBLE)) END AS is_eval
FROM (SELECT document_id, row_number() OVER (ORDER BY {s.hash_key(42, 'document_id')}) AS rn, count(*) OVER () AS n FROM v_docs)""",
)
def random_holdout(t: Tables):
    return splitting.random_holdout(t.docs.select("document_id"), "document_id", 0.05)


_SAMPLE_SQL = f"""pool AS (SELECT q.eval_id, q.document_id, q.document_topic AS split FROM v_qa q
  WHERE q.document_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)),
docs AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {s.hash_key(42, 'split', 'document_id')}) AS rn
  FROM (SELECT DISTINCT split, document_id FROM pool)),
picked AS (SELECT pool.* FROM pool JOIN docs USING (split, document_id) WHERE rn <= 20)"""


def _sample(t: Tables):
    toxic = t.table("labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("document_id"))
    rows = t.qa.select("eval_id", "document_id", F.col("document_topic").alias("split"))
    return splitting.sample_documents(rows, 20, exclude=toxic)


@query("eval_subset", f"WITH {_SAMPLE_SQL} SELECT eval_id, document_id, split FROM picked")
def eval_subset(t: Tables):
    return _sample(t).select("eval_id", "document_id", "split")


@query(
    "eval_subset_stats",
    f"WITH {_SAMPLE_SQL} SELECT split, count(DISTINCT document_id) AS n_documents, count(*) AS n_rows FROM picked GROUP BY 1",
)
def eval_subset_stats(t: Tables):
    return splitting.split_manifest(_sample(t).withColumn("split_key", F.col("document_id")))


@query(
    "balanced_sample",
    f"""WITH w AS (SELECT eval_id, max(rank_value) FILTER (WHERE condition = 'candidate' AND error IS NULL) AS rc,
  max(rank_value) FILTER (WHERE condition = 'baseline_b' AND error IS NULL) AS rb FROM v_rank GROUP BY 1),
b AS (SELECT eval_id, {s.hash_key(42, 'eval_id')} AS k, CASE WHEN rc IS NULL OR rb IS NULL THEN 'no_rank' WHEN rc < rb THEN 'challenger_wins'
  WHEN rb < rc THEN 'baseline_wins' ELSE 'tie' END AS bucket FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY k) AS rn FROM b),
st AS (SELECT *, CASE WHEN bucket = 'tie' OR rn > 10 THEN 3 WHEN bucket = 'challenger_wins' THEN 0 WHEN bucket = 'baseline_wins' THEN 1 ELSE 2 END AS stage FROM r)
SELECT eval_id, bucket, stage < 3 AS by_quota FROM st ORDER BY stage, k LIMIT 30""",
)
def balanced_sample(t: Tables):
    return splitting.balanced_sample(t.rank, 30, "candidate", "baseline_b")


@query("random_sample", f"SELECT eval_id FROM v_qa ORDER BY {s.hash_key(42, 'eval_id')} LIMIT 50")
def random_sample(t: Tables):
    return splitting.random_sample(t.qa.select("eval_id"), 50)


@query(
    "row_slice",
    "SELECT document_id FROM (SELECT document_id, row_number() OVER (ORDER BY ord) - 1 AS i FROM v_docs) WHERE i >= 30 AND i < 130",
)
def row_slice(t: Tables):
    return splitting.row_slice(t.docs.select("document_id", "ord"), start=30, end=5000, max_rows=100).select("document_id")


_SHARD_SQL = """s AS (SELECT document_id, row_number() OVER (ORDER BY ord) - 1 AS row_index, count(*) OVER () AS n FROM v_docs),
sh AS (SELECT document_id, row_index, 'shard' || printf('%06d', row_index // 64 * 64) || '_' || printf('%06d', least(row_index // 64 * 64 + 64, n)) AS shard FROM s)"""


@query("shard_assign", f"WITH {_SHARD_SQL} SELECT * FROM sh")
def shard_assign(t: Tables):
    return splitting.shard_assign(t.docs.select("document_id", "ord"), 64).select("document_id", "row_index", "shard")


@query(
    "head_cap",
    "SELECT document_id, source FROM v_docs ORDER BY ord LIMIT 25",
)
def head_cap(t: Tables):
    return t.docs.orderBy("ord").limit(25).select("document_id", "source")


# ---- set operations


@query(
    "union_corpora",
    """SELECT origin, count(*) AS n_rows, count(url) AS n_urls, count(document_topic) AS n_topics FROM (
  SELECT 'docs' AS origin, document_topic, NULL AS url FROM v_docs UNION ALL SELECT 'pages', NULL, url FROM pages) GROUP BY 1""",
)
def union_corpora(t: Tables):
    docs = t.docs.select(F.lit("docs").alias("origin"), "document_topic")
    pages = t.table("pages").select(F.lit("pages").alias("origin"), "url")
    both = docs.unionByName(pages, allowMissingColumns=True)
    return both.groupBy("origin").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("url").alias("n_urls"), F.count("document_topic").alias("n_topics")
    )


@query(
    "common_ids",
    "SELECT CAST(doc_id AS VARCHAR) AS document_id FROM documents INTERSECT SELECT CAST(doc_id AS VARCHAR) FROM labels",
)
def common_ids(t: Tables):
    return t.docs.select("document_id").intersect(t.table("labels").select(F.col("doc_id").cast("string")))


@query("new_ids", "SELECT CAST(doc_id AS VARCHAR) AS document_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def new_ids(t: Tables):
    known = t.table("labels").select(F.col("doc_id").cast("string").alias("document_id"))
    return t.docs.select("document_id").join(known, "document_id", "left_anti")


# ---- passage corpus

_CORPUS_SQL = f"""{_PASSAGES_SQL},
c AS (SELECT section_id AS document_id, length(context) AS char_count, md5(context || chr(10)) AS text_md5 FROM best WHERE rn = 1),
corpus AS ({group_split_sql('c')})"""


@query("passage_corpus", f"WITH {_CORPUS_SQL} SELECT document_id AS section_id, document_id, char_count, text_md5, split FROM corpus")
def passage_corpus(t: Tables):
    corpus = passages.passage_corpus(_passage_rows(t), monitor_ratio=0.1)
    return corpus.select("section_id", "document_id", "char_count", F.md5("text").alias("text_md5"), "split")


@query(
    "passage_corpus_counts",
    f"""WITH {_CORPUS_SQL}, z AS (SELECT count(*) AS n_passages_full_kb, count(*) FILTER (WHERE split = 'train') AS n_cpt_train_passages,
  count(*) FILTER (WHERE split = 'val') AS n_cpt_monitor_val_passages FROM corpus)
SELECT (SELECT count(*) FROM v_docs) AS input_qa_rows, (SELECT count(*) FROM v_docs WHERE {s.strip('context')} = '') AS skipped_missing_context,
  (SELECT count(*) FROM v_docs WHERE {s.strip('context')} <> '' AND length({s.strip('context')}) < 40) AS skipped_short,
  n_passages_full_kb AS unique_passages, (SELECT count(*) FROM p) - n_passages_full_kb AS duplicate_section_rows, z.* FROM z""",
)
def passage_corpus_counts(t: Tables):
    rows = _passage_rows(t)
    return passages.corpus_manifest(rows, passages.passage_corpus(rows, monitor_ratio=0.1))


@query(
    "passage_corpus_files",
    f"""WITH {_CORPUS_SQL} SELECT 'full' AS part, count(*) AS n_passages, CAST(sum(char_count) AS BIGINT) AS n_chars FROM corpus
UNION ALL SELECT split, count(*), CAST(sum(char_count) AS BIGINT) FROM corpus GROUP BY split""",
)
def passage_corpus_files(t: Tables):
    folder = scratch(t.spark, "passages")
    passages.write_corpus(passages.passage_corpus(_passage_rows(t), monitor_ratio=0.1), folder)
    lines = t.spark.read.schema("section_id string, text string").json(f"{folder}/passages_*.jsonl")
    part = F.regexp_extract(F.col("_metadata.file_path"), r"passages_(\w+)\.jsonl", 1)
    # The text ends with a line feed that does not count.
    return lines.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n_passages"), F.sum(F.length("text") - 1).cast("bigint").alias("n_chars"))
