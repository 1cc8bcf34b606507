"""Registered queries of the operators, with the SQL that checks them where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qassay.llm import decontaminate, jaccard_join, language_id, line_dedup, packing, pseudonyms, quality_rules, token_counts, toxicity, warc_revisits
from qassay.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401
from qassay.llm.shared import crc32_mod


@query(
    "op8_decontaminate",
    r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
),
item_windows AS (
  SELECT DISTINCT id AS item_id, least(10, len(w)) AS n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS k
  FROM (SELECT id, w, unnest(range(1, greatest(2, len(w) - 8))) AS p FROM words WHERE side = 'b' AND len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT id AS doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS k
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM words, sizes WHERE side = 'd' AND len(w) >= n)
),
found AS (SELECT doc_id, p, n, item_id FROM doc_windows JOIN item_windows USING (n, k)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit ON hit.doc_id = id LEFT JOIN items ON items.doc_id = id WHERE side = 'd'
""",
)
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("cast(aggregate(spans, 0L, (s, x) -> s + x.last - x.first + 1) as bigint)")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"),
    )


@query("op7_jaccard_join")
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "is_first")


@query(
    "op3_line_dedup",
    r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(common.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (common.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (k) GROUP BY doc_id
""",
)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    applied = line_dedup.apply_bitmaps(docs, line_dedup.drop_bitmaps(docs))
    return applied.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


@query(
    "op5_quality_rules",
    r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
),
runs AS (SELECT doc_id, p, array_to_string(w[p:p + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM words)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS n FROM runs) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM again) GROUP BY doc_id),
counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
         len(list_filter(w, lambda x: list_contains(string_split('"""
    + " ".join(quality_rules.STOP_WORDS)
    + r"""', ' '), lower(x))))::BIGINT AS n_stop_words
  FROM words LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_chars BETWEEN 2.0 * n_words AND 14.0 * n_words
         AND n_symbols <= 0.25 * n_words AND n_stop_words >= 0.04 * n_words AND n_dup_lines <= 0.4 * n_lines AND n_words >= 2.0 * n_lines AS kept
FROM counts
""",
)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_definition("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def tokenizer_definition(name: str) -> str:
    """A public tokenizer file, read on the driver; its size does not depend on the tables."""
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language_id.fit(docs.filter(crc32_mod("doc_id", 5) != 0))
    return language_id.identify(docs, net).select("doc_id", (crc32_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = toxicity.fit(docs, labels.filter(crc32_mod("doc_id", 4) != 2))
    scored = toxicity.score_toxicity(docs, net)
    return scored.select("doc_id", (crc32_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.TOXIC_FROM).cast("int").alias("predicted"))


@query("op10_pseudonyms")
def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), key="a key of the test tables")
    return found.select("doc_id", "text", F.size("found").cast("long").alias("n_replaced"))


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_definition("byte_bpe_50k.json"))


@query(
    "op9_warc_revisits",
    r"""
WITH urls AS (
  SELECT page_id AS p, html, url,
         regexp_replace(regexp_replace(lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^[^@]*@|:(80|443)?$', '', 'g'), '^(www|m)\.', '') AS host,
         regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path,
         list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(ref|utm_[a-z]+)(=|$)'))) AS params
  FROM pages
),
base AS (
  SELECT p, '"' || substr(md5(html), 1, 16) || '"' AS tag,
         CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS u
  FROM urls
),
responses AS (SELECT u, max(p) AS p, p * 10 AS ts, max_by(tag, p) AS tag FROM base WHERE u IS NOT NULL GROUP BY u, p * 10),
revisits AS (
  SELECT p, u, p * 10 + 5 + (p % 7) * 1000 AS ts, CASE WHEN p % 5 = 0 THEN NULL WHEN p % 4 = 3 THEN '"stale"' ELSE tag END AS tag,
         CASE WHEN p % 5 = 0 THEN 'd' || p END AS modified
  FROM base
),
joined AS (
  SELECT v.*, r.p AS rp, r.ts AS rts, r.tag AS rtag,
         CASE WHEN r.p IS NULL THEN 'orphan' WHEN v.tag IS NOT NULL AND v.tag = r.tag OR v.tag IS NULL AND v.modified = 'd' || r.p THEN 'resolved' ELSE 'mismatch' END AS verdict
  FROM revisits v ASOF LEFT JOIN responses r ON v.u = r.u AND v.ts > r.ts
)
SELECT p * 2 + 1 AS record_id, u AS canonical_url, rp * 2 AS matched_id, verdict,
       CASE WHEN verdict = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || rtag || chr(10) || 'server: origin' END AS headers
FROM joined
""",
)
def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_revisits.resolve_revisits(warc_revisits.page_captures(table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"])))
    return found.withColumn("headers", F.array_join(lines, "\n"))


from qassay.llm import corpus_queries  # noqa: E402, F401
