"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from qassay.plans import load_all
from qassay.plans.registry import QUERIES
from qassay.session import build_session

HEADLINE = [
    "leaderboard_scores", "multi_gold_summary", "judge_stats", "leaderboard_judge", "tier_profile", "tier_answer_types",
    "md_sections", "char_chunks", "chunk_ids", "word_chunks", "doc_windows", "generation_requests", "normalize_text",
    "word_counts", "dedupe_first", "dedupe_longest", "stratified_split", "group_split", "sft_splits", "multi_corpus_split",
    "eval_subset", "balanced_sample", "row_slice", "shard_assign", "enrich_context", "resume_todo", "swap_merge_scores",
    "rejudge_compare", "parse_judge", "parse_qa_pairs", "listwise_tasks", "win_rate", "slice_metrics", "bootstrap_mean",
    "bootstrap_leaderboard", "cohen_kappa", "spearman", "judge_agreement", "coverage_summary", "cosine_summary", "nli_summary",
    "case_catalog", "grounded_rates", "hallucination_stats", "round_robin_pick", "timing_stats", "resource_matrix",
    "span_rollup_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    load_all()
    names = sys.argv[1:] or HEADLINE
    names = list(QUERIES) if names == ["all"] else names
    spark = build_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
