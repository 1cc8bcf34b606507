"""A training corpus from documents: toxic documents go, lines that very many documents share go, one document of each group of near duplicates stays,
contaminated documents go, and what is left is packed into token sequences.

Each stage reads what its predecessor wrote. Rows are never capped or sampled; only the toxicity model is fitted on a bounded sample.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qassay.llm import decontaminate, jaccard_join, line_dedup, packing, toxicity
from qassay.llm.queries import table, tokenizer_definition
from qassay.llm.shared import row_keys, settle


def _whole_row(docs: DataFrame):
    """All columns in one struct, so that no name of theirs meets a name of the operators."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below toxicity.TOXIC_FROM, as in op1_toxicity; the model learns from all rows of labels that have a text here."""
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_rows(docs, net, "_toxicity").filter(F.col("_toxicity") < toxicity.TOXIC_FROM).drop("_toxicity")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more documents share. A document may become empty, but stays; n_chars follows the text."""
    own = docs.select("doc_id", "text", _whole_row(docs))
    applied = line_dedup.apply_bitmaps(own, line_dedup.drop_bitmaps(own))
    changed = {"text": F.col("_kept"), "n_chars": F.length("_kept").cast("long")}
    lost = F.col("_n_dropped") > 0
    return applied.select(*[F.when(lost, changed[c]).otherwise(F.col("row")[c]).alias(c) if c in changed else F.col("row")[c].alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id, of each group linked by a 5-word shingle Jaccard similarity of 0.8 or more; of equal rows one."""
    first = jaccard_join.jaccard_join(docs).filter("is_first").select("k1", "k2").distinct()
    named = docs.select(_whole_row(docs), *row_keys("doc_id", "text"))
    return named.join(first, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten words of a benchmark item occurs."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep_row=True)
    return found.filter(F.size("items") == 0).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 tokens, with their ids."""
    return packing.pack(docs, tokenizer_definition("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

# The toxicity model and the tokenizer are beyond SQL; tests/llm/test_pipeline_stages.py compares the rows of every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
