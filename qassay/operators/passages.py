"""Passage corpus of question/answer rows: every passage once, with an optional slice that only monitors training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qassay.operators.dedupe import dedupe_longest, passage_corpus_manifest
from qassay.operators.ranking import key_at, written
from qassay.operators.splitting import split_by_group
from qassay.sources.jsonl import write_jsonl

SPLITS = ("train", "val")


def passage_corpus(
    rows: DataFrame,
    tag: str = "qa",
    order: str = "ord",
    min_context_chars: int = 40,
    monitor_ratio: float = 0.0,
    seed: int = 42,
    max_passages: int = 0,
) -> DataFrame:
    """section_id, document_id (the same), text, source, char_count, title, split.

    All passages are in train, unless monitor_ratio puts that share of them (at least one, never all) into val by hash order.
    max_passages keeps the first passages by section_id; 0 keeps all. The passages are written once, since they are read for the
    cuts and for the result.
    """
    passages = written(dedupe_longest(rows, tag, order, min_context_chars))
    if max_passages > 0:
        passages = passages.filter(F.col("section_id") <= key_at(passages, "section_id", lambda n: F.least(n, F.lit(max_passages))))
    passages = passages.withColumn("document_id", F.col("section_id"))
    if monitor_ratio > 0:
        passages = split_by_group(passages, F.col("section_id"), monitor_ratio, seed).drop("split_key")
    else:
        passages = passages.withColumn("split", F.lit("train"))
    return passages.select("section_id", "document_id", "text", "source", "char_count", "title", "split")


def corpus_manifest(rows: DataFrame, corpus: DataFrame, tag: str = "qa", min_context_chars: int = 40) -> DataFrame:
    """One row: the counts of the dedupe, and the passages in all and in each split of the corpus."""
    sizes = corpus.agg(F.struct(F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("split") == x).alias(x) for x in SPLITS])).scalar()
    return passage_corpus_manifest(rows, tag, min_context_chars).select(
        "*",
        sizes["all"].alias("n_passages_full_kb"),
        sizes["train"].alias("n_cpt_train_passages"),
        sizes["val"].alias("n_cpt_monitor_val_passages"),
    )


def write_corpus(corpus: DataFrame, folder: str) -> None:
    """passages_full, passages_train and passages_val as JSON lines below the folder."""
    write_jsonl(corpus.drop("split"), f"{folder}/passages_full.jsonl")
    for name in SPLITS:
        write_jsonl(corpus.filter(F.col("split") == name).drop("split"), f"{folder}/passages_{name}.jsonl")
