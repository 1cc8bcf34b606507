"""Registered queries of the operators that search, mine and shard whole corpora, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qassay.llm import collocations, ranked_search, shuffle_shards
from qassay.llm.registry import query, table
from qassay.llm.shared import row_keys

@query(
    "op12_shuffle_shards",
    r"""
WITH RECURSIVE sizes AS (SELECT count(*) AS n FROM documents),
sides AS (
  SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM (SELECT n, near + greatest(1, near // 8192) * unnest(range(4096)) AS a FROM (SELECT n, greatest(1, floor(sqrt(n))::BIGINT) AS near FROM sizes))
  ORDER BY a * b - n, a LIMIT 1
),
walk AS (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS no, row_number() OVER (ORDER BY doc_id) - 1 AS x, 0 AS step FROM documents
  UNION ALL
  SELECT no, x5 * b + (y4 + ('0x' || substr(md5('documents:5:' || x5), 1, 15))::BIGINT) % b, step + 1 FROM (
    SELECT *, (x3 + ('0x' || substr(md5('documents:4:' || y4), 1, 15))::BIGINT) % a AS x5 FROM (
      SELECT *, (y2 + ('0x' || substr(md5('documents:3:' || x3), 1, 15))::BIGINT) % b AS y4 FROM (
        SELECT *, (x1 + ('0x' || substr(md5('documents:2:' || y2), 1, 15))::BIGINT) % a AS x3 FROM (
          SELECT *, (x % b + ('0x' || substr(md5('documents:1:' || x1), 1, 15))::BIGINT) % b AS y2 FROM (
            SELECT *, (x // b + ('0x' || substr(md5('documents:0:' || (x % b)), 1, 15))::BIGINT) % a AS x1 FROM walk, sides WHERE step = 0 OR x >= n
          )
        )
      )
    )
  )
),
places AS (SELECT no, x AS place FROM walk, sizes WHERE step > 0 AND x < n),
codes AS (
  SELECT list(list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS code
  FROM (SELECT range::BIGINT AS i FROM range(256))
),
numbered AS (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS no, doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
  FROM documents
)
SELECT doc_id, size::BIGINT AS size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, code[xor(c & 255, x) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32,
       'rows' AS law, (place % 16)::INT AS shard, place // 16 AS slot, NULL::INT AS grown_shard
FROM numbered JOIN places USING (no), codes
""",
)
def op12_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    digest = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), *row_keys("doc_id", "text")
    )
    sharded = shuffle_shards.shard_rows(digest, [F.col("doc_id"), F.col("k1"), F.col("k2")], 16, "documents")
    return sharded.select("row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query(
    "op13_ranked_search",
    r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
),
sizes AS (SELECT count(*) AS total, sum(len(t))::BIGINT AS length FROM docs WHERE len(t) > 0),
item_terms AS (
  SELECT DISTINCT no, item_id, term FROM (
    SELECT no, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT *, row_number() OVER () AS no FROM benchmark)
  )
),
counts AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM docs) GROUP BY ALL),
weighted AS (SELECT term, floor(1000 * ln((2 * any_value(total) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counts, sizes GROUP BY term),
scores AS (
  SELECT no, item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * total) // length))))::BIGINT AS score
  FROM item_terms JOIN counts USING (term) JOIN weighted USING (term), sizes GROUP BY no, item_id, doc_id
)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY no ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
""",
)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op11_collocations",
    r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
  )
),
grams AS (
  SELECT lang, m, w[i:i + m - 1] AS g, count(*) AS f FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS m)) GROUP BY ALL
),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, m, g, f AS a FROM grams WHERE m >= 2 AND f >= 100),
cuts AS (
  SELECT c.lang, c.m, c.g, c.a, k, x.f AS l, y.f AS r, n, ((1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c JOIN grams x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN grams y ON y.lang = c.lang AND y.g = c.g[k + 1:c.m]
  JOIN totals t ON t.lang = c.lang
),
lowest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS o FROM cuts) WHERE o = 1),
inside AS (
  SELECT DISTINCT lang, part FROM (SELECT lang, a, m, s, o, g[o:o + s - 1] AS part FROM (SELECT *, unnest(range(1, m - s + 2)) AS o FROM (SELECT *, unnest(range(2, m)) AS s FROM candidates)))
  JOIN (SELECT lang AS own_lang, g AS own, a AS own_a FROM candidates) ON own_lang = lang AND own = part WHERE 100 * a >= 100 * own_a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) AS rank
  FROM lowest WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = lowest.lang AND i.part = lowest.g)
) WHERE rank <= 2000
""",
)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_collocations(collocations.scored_phrases(table(spark, sf_dir, "documents")))
