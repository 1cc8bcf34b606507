"""How much of each document its questions and answers touch, window by window.

Lexical coverage never concatenates question/answer text: only distinct (document, token) pairs are kept. They come to the documents as sets of
bounded size, several for a document with very many questions, so a document's own tokens are never shuffled. Coverage by embeddings sums the vectors of a document's questions element by element, with
map-side combine. The joined text itself is streamed over sorted ranges, so only its last few parts meet per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qassay.functions.judging import document_id
from qassay.functions.metrics import cosine
from qassay.functions.text import ascii_tokens, bind
from qassay.operators.chunking import equal_windows
from qassay.operators.ranking import magnitude_bucket, nth_keys, settle, written
from qassay.operators.scoring import mean4

TIER_SEVERITY = ("high", "medium", "low", "drop", "unknown")


def qa_rows(qa: DataFrame, exclude_tiers: tuple[str, ...] = (), *kept: str) -> DataFrame:
    """Document, tier and text of each question/answer row, with the kept columns; rows of excluded tiers are dropped."""
    other = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("section_id", "chunk_id") if c in qa.columns])
    text = F.concat_ws(" ", F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit("")))
    tier = F.coalesce(F.nullif("quality_tier", F.lit("")), F.lit("unknown"))
    rows = qa.select(document_id(F.col("document_id"), other).alias("document_id"), tier.alias("tier"), text.alias("text"), *kept)
    return rows.filter(~F.lower("tier").isin(*exclude_tiers)) if exclude_tiers else rows


def qa_text_stats(qa: DataFrame, docs: DataFrame, exclude_tiers: tuple[str, ...] = ()) -> DataFrame:
    """Per document: rows, length of their joined text and number of distinct tokens (zeros without rows)."""
    rows = qa_rows(qa, exclude_tiers)
    totals = rows.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_qa"), (F.sum(F.length("text") + 1) - 1).alias("blob_chars")
    )
    tokens = qa_tokens(rows).groupBy("document_id").agg(F.count(F.lit(1)).alias("n_tokens"))
    zero = F.lit(0)
    return (
        docs.select("document_id")
        .join(totals, "document_id", "left")
        .join(tokens, "document_id", "left")
        .select(
            "document_id",
            *[F.coalesce(c, zero).cast("bigint").alias(c) for c in ("n_qa", "blob_chars", "n_tokens")],
        )
    )


def joined_texts(rows: DataFrame, key: str, text: str, order: str = "ord", separator: str = " ", part_chars: int = 1 << 20) -> DataFrame:
    """key and all texts of the key in the order, joined by the separator. Null texts count as empty; a null key is a key.

    Rows are dealt by range over (key, order) and joined while they stream past, in parts of at most about part_chars characters (a longer text is one
    part). A key with very many rows lies in several ranges; only its parts meet in the end, as one value of its row.
    """
    own = rows.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(order).alias("_order"))
    ordered = own.repartitionByRange("_key", "_order").sortWithinPartitions("_key", "_order")
    placed = ordered.select("_key", "_text", F.monotonically_increasing_id().alias("_place"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        size, current, first = 0, None, None

        def part() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([current], kind), pa.array([separator.join(held)]), pa.array([first])], ["_key", "_text", "_place"])

        for batch in batches:
            kind = batch.schema.field("_key").type
            for value, words, place in zip(*(batch.column(c).to_pylist() for c in ("_key", "_text", "_place")), strict=True):
                if held and (value != current or size >= part_chars):
                    yield part()
                    held, size = [], 0
                if not held:
                    current, first = value, place
                held.append(words)
                size += len(words) + len(separator)
        if held:
            yield part()

    parts = placed.mapInArrow(join, placed.schema)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("_place", "_text"))), lambda p: p["_text"])
    return parts.groupBy("_key").agg(F.array_join(texts, separator).alias(text)).withColumnRenamed("_key", key)


def qa_texts(qa: DataFrame, docs: DataFrame, exclude_tiers: tuple[str, ...] = (), order: str = "ord") -> DataFrame:
    """Per document the text of its questions and answers, joined by blanks in their order; empty without rows."""
    text = joined_texts(qa_rows(qa, exclude_tiers, order), "document_id", "text", order)
    return docs.select("document_id").join(text, "document_id", "left").select("document_id", F.coalesce("text", F.lit("")).alias("text"))


def qa_tokens(rows: DataFrame) -> DataFrame:
    return rows.select("document_id", F.explode(ascii_tokens(F.col("text"))).alias("token")).distinct()


def majority_tier(rows: DataFrame) -> DataFrame:
    """Most frequent tier per document; of equal counts the better tier."""
    place = F.array_position(F.array(*[F.lit(t) for t in TIER_SEVERITY]), F.col("tier"))
    severity = F.when(place > 0, place).otherwise(len(TIER_SEVERITY) + 1)
    return (
        rows.groupBy("document_id", "tier")
        .agg(F.count(F.lit(1)).alias("_c"))
        .groupBy("document_id")
        .agg(
            F.sum("_c").alias("n_qa"),
            F.max_by("tier", F.struct(F.col("_c"), (-severity).alias("s"), F.col("tier"))).alias("majority_tier"),
        )
    )


def token_sets(tokens: DataFrame, least: int = 3, set_tokens: int = 4096) -> DataFrame:
    """The distinct tokens of every document that has at least ``least``: document_id, part, tokens.

    A document lies in one set, or by the hash of the token in as many parts as keep a set near set_tokens tokens. Part 0 is there always,
    if need be without tokens.
    """
    parts = tokens.groupBy("document_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    parts = written(parts.select("document_id", F.ceil(F.col("_n") / set_tokens).alias("_parts")))
    part = F.pmod(F.xxhash64("token"), F.col("_parts")).alias("part")
    first = parts.select("document_id", F.lit(0).cast("bigint").alias("part"), F.lit(None).cast("string").alias("token"))
    placed = tokens.join(parts, "document_id").select("document_id", part, "token").unionByName(first)
    # Nulls are not collected.
    return placed.groupBy("document_id", "part").agg(F.collect_list("token").alias("tokens"))


def window_hits(
    docs: DataFrame,
    qa: DataFrame,
    n_windows: int = 5,
    threshold: float = 0.12,
    exclude_tiers: tuple[str, ...] = (),
    set_tokens: int = 4096,
) -> DataFrame:
    """Per document window: share of its tokens found in the document's questions and answers, and the hit flag.

    The tokens of the questions come to the document as sets, so tokens of a document are compared where its text lies and none is
    shuffled; the row of a document with several sets is compared with each. Only documents with enough question/answer tokens are
    tokenised; the windows of the others are counted.
    """
    asked = token_sets(written(qa_tokens(qa_rows(qa, exclude_tiers))), set_tokens=set_tokens)
    met = docs.select("document_id", "context").join(asked, "document_id", "left")
    own = F.when(F.col("tokens").isNotNull(), ascii_tokens(F.array_join("_w", " ")))
    shared = (
        met.select("document_id", "part", "tokens", F.posexplode(equal_windows(F.col("context"), n_windows)).alias("window", "_w"))
        .select("document_id", "window", "part", bind(own, lambda t: F.struct(F.size(F.array_intersect(t, "tokens")).alias("s"), F.size(t).alias("n"))).alias("_c"))
        .groupBy("document_id", "window")
        .agg(F.coalesce(F.sum("_c.s"), F.lit(0)).alias("_s"), F.coalesce(F.sum(F.when(F.col("part") == 0, F.col("_c.n"))), F.lit(0)).alias("_n"))
    )
    overlap = F.coalesce(F.try_divide("_s", "_n"), F.lit(0.0))
    return shared.select(
        "document_id", "window", F.bround(overlap, 6).alias("overlap"), (F.col("_n") > 0) & (overlap >= threshold)
    ).toDF("document_id", "window", "overlap", "hit")


def coverage_per_doc(hits: DataFrame, qa: DataFrame, exclude_tiers: tuple[str, ...] = ()) -> DataFrame:
    tiers = majority_tier(qa_rows(qa, exclude_tiers))
    per_doc = hits.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_windows"), F.count_if("hit").alias("n_hits")
    )
    return per_doc.join(tiers, "document_id", "left").select(
        "document_id",
        F.coalesce("n_qa", F.lit(0)).alias("n_qa"),
        "n_windows",
        "n_hits",
        F.bround(F.col("n_hits") / F.col("n_windows"), 4).alias("coverage"),
        F.coalesce("majority_tier", F.lit("none")).alias("majority_tier"),
    )


def _covered() -> Column:
    """Coverage before rounding, so that means are rounded once."""
    return F.col("n_hits") / F.col("n_windows")


def _share(per_doc_at_least: float) -> Column:
    return F.bround(100.0 * F.count_if(_covered() >= per_doc_at_least) / F.count(F.lit(1)), 2)


def coverage_summary(per_doc: DataFrame, qa: DataFrame, exclude_tiers: tuple[str, ...] = ()) -> DataFrame:
    """Mean and median coverage and shares of well covered documents; coverage has few distinct values.

    Question/answer rows count if their tier is kept, also those of documents too short for windows.
    """
    kept = qa_rows(qa, exclude_tiers).agg(F.count(F.lit(1))).scalar()
    return per_doc.agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.first(kept).alias("n_qa_rows"),
        mean4(_covered()).alias("mean_coverage"),
        F.bround(F.percentile(_covered(), 0.5), 4).alias("median_coverage"),
        _share(0.8).alias("pct_ge_80"),
        _share(0.4).alias("pct_ge_40"),
    )


def coverage_by_position(hits: DataFrame) -> DataFrame:
    return hits.groupBy("window").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.bround(100.0 * F.count_if("hit") / F.count(F.lit(1)), 2).alias("pct_hit"),
    )


def coverage_by_tier(per_doc: DataFrame) -> DataFrame:
    return per_doc.groupBy("majority_tier").agg(
        F.count(F.lit(1)).alias("n_documents"), mean4(_covered()).alias("mean_coverage")
    )


def coverage_cosine(windows: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Per document from window cosines: hits, coverage and mean cosine (rows document_id, cosine)."""
    return windows.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.count_if(F.col("cosine") >= threshold).alias("n_hits"),
        F.bround(F.count_if(F.col("cosine") >= threshold) / F.count(F.lit(1)), 4).alias("coverage"),
        mean4(F.col("cosine")).alias("mean_cosine"),
    )


def tier_counts(qa: DataFrame, exclude_tiers: tuple[str, ...] = ()) -> DataFrame:
    """Question/answer rows per tier, and whether the tier is left out."""
    out = F.lower("tier").isin(*exclude_tiers) if exclude_tiers else F.lit(False)
    return qa_rows(qa).groupBy("tier").agg(F.count(F.lit(1)).alias("n_rows")).select("tier", "n_rows", out.alias("excluded"))


def mean_vectors(rows: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """key and the element-wise mean of the vectors of the key: one sum per element, combined map-side. Vectors of another length and null ones do not count."""
    fit = rows.filter(F.size(vector) == dim)
    sums = fit.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(vector)[i].cast("double")).alias(f"_s{i}") for i in range(dim)])
    return sums.select(key, F.array(*[F.col(f"_s{i}") / F.col("_n") for i in range(dim)]).alias(vector))


def window_cosines(windows: DataFrame, qa_vectors: DataFrame, dim: int, threshold: float = 0.35) -> DataFrame:
    """Per document window (document_id, window, embedding): cosine to the mean vector of the document's questions and answers (document_id, embedding),
    and the hit flag. Documents without such vectors have null cosines and no hits."""
    means = mean_vectors(qa_vectors, "document_id", "embedding", dim).withColumnRenamed("embedding", "_qa")
    similar = cosine(F.transform("embedding", lambda x: x.cast("double")), F.col("_qa"))
    found = windows.join(means, "document_id", "left").withColumn("cosine", F.when(F.col("_qa").isNotNull(), similar))
    return found.select("document_id", "window", "cosine", F.coalesce(F.col("cosine") >= threshold, F.lit(False)).alias("hit"))


def coverage_by_embedding(cosines: DataFrame) -> DataFrame:
    """Per document: windows, hits, coverage, mean cosine and the hit flags in the order of the windows."""
    flags = F.transform(F.array_sort(F.collect_list(F.struct("window", "hit"))), lambda w: w["hit"])
    return cosines.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_windows"), F.count_if("hit").alias("n_hits"), F.bround(F.count_if("hit") / F.count(F.lit(1)), 4).alias("coverage"),
        mean4(F.col("cosine")).alias("mean_cosine"), flags.alias("hits"),
    )


def embedding_summary(cosines: DataFrame, qa: DataFrame, exclude_tiers: tuple[str, ...] = ()) -> DataFrame:
    """One row: documents, rows kept and left out, mean and median coverage, shares of well covered documents, mean and median cosine of all windows."""
    cosines = settle(cosines)  # read for the coverage and for the middle cosines
    n = F.col("n_rows")
    rows = tier_counts(qa, exclude_tiers).agg(
        F.coalesce(F.sum(F.when(~F.col("excluded"), n)), F.lit(0)).alias("n_qa_rows"), F.coalesce(F.sum(F.when(F.col("excluded"), n)), F.lit(0)).alias("n_qa_rows_excluded")
    )
    known = cosines.filter(F.col("cosine").isNotNull()).select("cosine")
    middle = nth_keys(known, "cosine", lambda n: {"low": F.ceil(n / 2), "high": F.floor(n / 2) + 1}, bucket=magnitude_bucket(F.col("cosine")))
    mean, median = known.agg(mean4(F.col("cosine"))).scalar(), middle.agg(F.bround(F.avg("cosine"), 4)).scalar()
    kept = rows.select(F.struct("n_qa_rows", "n_qa_rows_excluded")).scalar()
    return coverage_by_embedding(cosines).agg(
        F.count(F.lit(1)).alias("n_documents"), mean4(_covered()).alias("mean_coverage"), F.bround(F.percentile(_covered(), 0.5), 4).alias("median_coverage"),
        _share(0.8).alias("pct_ge_80"), _share(0.4).alias("pct_ge_40"), F.first(kept["n_qa_rows"]).alias("n_qa_rows"),
        F.first(kept["n_qa_rows_excluded"]).alias("n_qa_rows_excluded"), F.first(mean).alias("mean_window_cosine"), F.first(median).alias("median_window_cosine"),
    )
