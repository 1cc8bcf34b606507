"""Deterministic splits and samples.

Order comes from a hash of seed and key, sizes follow the usual rounding rules. A split is decided by
comparing each row's hash with the hash found at the cut position, so rows are never shuffled for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qassay.constants import JUDGE_DIMENSIONS, TRAIN_RUBRIC_VERSION
from qassay.functions.judging import document_id
from qassay.functions.text import blank_to_null, is_invalid_answer, strip
from qassay.operators.ranking import (
    key_at,
    lookup_join,
    nth_keys,
    order_key,
    row_positions,
    top_n,
    with_row_index,
)


def usable_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(
        blank_to_null(F.col("context")).isNotNull()
        & blank_to_null(F.col("question")).isNotNull()
        & ~is_invalid_answer(F.col("answer"))
    )


def trainable_judged_rows(rows: DataFrame, rubric: str = TRAIN_RUBRIC_VERSION) -> DataFrame:
    """Usable rows scored on the four training dimensions, without error or gold reference."""
    j = F.col("llm_judge")
    version = F.coalesce(j["prompt_version"], F.lit(""))
    scored = F.lit(True)
    for dim in JUDGE_DIMENSIONS:
        scored = scored & j[dim].isNotNull()
    return usable_rows(rows).filter(
        ~F.coalesce(j["skipped"], F.lit(False))
        & (F.coalesce(j["error"], F.lit("")) == "")
        & version.isin("", rubric)
        & j["gold_alignment"].isNull()
        & scored
    )


def parse_tiers(text: str) -> list[str]:
    return sorted({t.strip() for t in text.strip().lower().replace("+", ",").split(",") if t.strip()})


def row_tier() -> Column:
    return F.lower(strip(F.coalesce(F.col("llm_judge.quality_tier"), F.lit(""))))


def filter_by_tier(rows: DataFrame, tiers: str) -> DataFrame:
    return rows.filter(row_tier().isin(*parse_tiers(tiers)))


def row_document_id() -> Column:
    return document_id(F.col("document_id"), F.col("chunk_id"))


def _group_cut(n: Column, val_ratio: float) -> Column:
    size = F.greatest(F.lit(1), F.bround(n * F.lit(val_ratio)))
    return F.when((n > 1) & F.lit(val_ratio > 0), F.least(n - 1, size)).otherwise(F.lit(0))


def split_by_group(
    rows: DataFrame, group: Column | None = None, val_ratio: float = 0.1, seed: int = 42
) -> DataFrame:
    """Add split_key and split; whole groups go to val."""
    keyed = rows.withColumn("split_key", row_document_id() if group is None else group)
    units = keyed.select("split_key").distinct().select(order_key(seed, "split_key").alias("_k"))
    cut = key_at(units, "_k", lambda n: _group_cut(n, val_ratio))
    in_val = F.coalesce(order_key(seed, "split_key") <= cut, F.lit(False))
    return keyed.withColumn("split", F.when(in_val, "val").otherwise("train"))


def split_manifest(split_rows: DataFrame) -> DataFrame:
    """Rows and groups per split of a grouped split."""
    per_group = split_rows.groupBy("split", "split_key").agg(F.count(F.lit(1)).alias("_n"))
    return per_group.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum("_n").alias("n_rows")
    )


def sft_splits(rows: DataFrame, tiers: str, val_ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Tier filter, usable rows, grouped split."""
    return split_by_group(usable_rows(filter_by_tier(rows, tiers)), val_ratio=val_ratio, seed=seed)


def sft_split_counts(rows: DataFrame, tiers: str) -> DataFrame:
    """Rows left after each stage, in one pass."""
    kept = row_tier().isin(*parse_tiers(tiers))
    usable = (
        blank_to_null(F.col("context")).isNotNull()
        & blank_to_null(F.col("question")).isNotNull()
        & ~is_invalid_answer(F.col("answer"))
    )
    return rows.agg(
        F.count(F.lit(1)).alias("n_input_rows"),
        F.count_if(kept).alias("n_after_quality_tier"),
        F.count_if(kept & ~usable).alias("n_skipped_unusable"),
        F.count_if(row_tier() == "").alias("n_skipped_no_judge_tier"),
    )


def split_sizes(n: Column, train_ratio: float, val_ratio: float) -> tuple[Column, Column]:
    """Train and val sizes of one source; test takes the rest."""
    val = F.greatest(F.lit(1), F.bround(n * F.lit(val_ratio)))
    test = F.greatest(F.lit(1), F.bround(n * F.lit(1.0 - train_ratio - val_ratio)))
    over = val + test - (n - 1)  # more than zero when nothing is left to train on
    val_fit = (
        F.when(over <= 0, val)
        .when(over <= val - test, val - over)
        .when(over <= test - val, val)
        .otherwise(F.floor((n - 1) / 2))
    )
    test_fit = F.when(over <= 0, test).when(over <= test - val, test - over).when(over <= val - test, test).otherwise(
        n - 1 - F.floor((n - 1) / 2)
    )
    n_train = F.when(n <= 2, F.lit(1)).otherwise(n - val_fit - test_fit)
    n_val = F.when(n <= 1, F.lit(0)).when(n == 2, F.lit(1)).otherwise(val_fit)
    return n_train, n_val


def stratified_split(
    rows: DataFrame,
    key: str = "chunk_id",
    source: str = "source",
    train_ratio: float = 0.8,
    val_ratio: float = 0.1,
    seed: int = 42,
) -> DataFrame:
    """Train/val/test within every source. ``key`` must be unique."""
    if train_ratio + val_ratio >= 1:
        raise ValueError("train_ratio + val_ratio must be < 1")
    src = F.coalesce(blank_to_null(F.col(source)), F.lit("unknown"))
    keyed = rows.withColumn("split_source", src).withColumn("_k", order_key(seed, key))

    def marks(n: Column) -> dict[str, Column]:
        n_train, n_val = split_sizes(n, train_ratio, val_ratio)
        return {"train": n_train, "val": n_train + n_val}

    cuts = (
        nth_keys(keyed.select("split_source", "_k"), "_k", marks, group=["split_source"])
        .groupBy("split_source")
        .agg(
            F.max(F.when(F.col("mark") == "train", F.col("_k"))).alias("_train"),
            F.max(F.when(F.col("mark") == "val", F.col("_k"))).alias("_val"),
        )
    )
    label = F.when(F.col("_k") <= F.col("_train"), "train").when(F.col("_k") <= F.col("_val"), "val").otherwise("test")
    return (
        lookup_join(keyed, cuts, ["split_source"])
        .withColumn("split", label)
        .drop("_k", "_train", "_val")
    )


def split_corpora(
    rows: DataFrame, corpora: Sequence[str], corpus: str = "corpus", val_ratio: float = 0.1, seed: int = 42,
    ood_corpus: str | None = None, ood_rows: DataFrame | None = None,
) -> DataFrame:
    """Grouped split of several corpora in one pass, the i-th with seed + i; adds ood_test for one corpus's val.

    Rows of a corpus that is not listed, or of none, stay with a null split. Where a table of test rows is given, its rows are
    the test (with a null split, columns they lack are null) and no corpus's val is."""
    seeds = F.create_map(*[x for i, c in enumerate(corpora) for x in (F.lit(c), F.lit(seed + i))])
    keyed = (
        rows.withColumn("split_key", row_document_id())
        .withColumn(
            "_k",
            F.when(
                F.col(corpus).isin(*corpora),
                F.sha2(F.concat_ws(":", seeds[F.col(corpus)].cast("string"), "split_key"), 256),
            ),
        )
    )
    units = keyed.filter("_k IS NOT NULL").select(corpus, "_k").distinct()
    cuts = nth_keys(units, "_k", lambda n: {"cut": _group_cut(n, val_ratio)}, group=[corpus]).select(
        corpus, F.col("_k").alias("_cut")
    )
    # One row per named corpus.
    out = keyed.join(F.broadcast(cuts), corpus, "left")
    in_val = F.coalesce(F.col("_k") <= F.col("_cut"), F.lit(False))
    ood = in_val & F.lit(ood_corpus is not None) & (F.col(corpus) == F.lit(ood_corpus or ""))
    split = (
        out.withColumn("split", F.when(in_val, "val").when(F.col("_k").isNotNull(), "train"))
        .withColumn("ood_test", ood if ood_rows is None else F.lit(False))
        .drop("_k", "_cut")
    )
    if ood_rows is None:
        return split
    known = ood_rows.select(*[c for c in ood_rows.columns if c in rows.columns])
    test = known.withColumn("split", F.lit(None).cast("string")).withColumn("ood_test", F.lit(True))
    return split.unionByName(test, allowMissingColumns=True)


def random_holdout(rows: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Add is_eval for int(n * fraction) rows, at least one; nothing is held out of a single row."""
    keyed = rows.withColumn("_k", order_key(seed, key))

    def size(n: Column) -> Column:
        want = F.greatest(F.lit(1), F.floor(n * F.lit(fraction)))
        fit = F.when(want >= n, F.greatest(F.lit(1), F.floor(n / 10))).otherwise(want)
        return F.when(n <= 1, F.lit(0)).otherwise(fit)

    cut = key_at(keyed, "_k", size)
    return keyed.withColumn("is_eval", F.coalesce(F.col("_k") <= cut, F.lit(False))).drop("_k")


def sample_documents(
    rows: DataFrame, per_split: int, split: str = "split", exclude: DataFrame | None = None, seed: int = 42
) -> DataFrame:
    """All rows of n documents per split, documents of ``exclude`` left out first."""
    pool = rows.filter(blank_to_null(F.col("document_id")).isNotNull())
    if exclude is not None:
        pool = pool.join(exclude.select("document_id").distinct(), "document_id", "left_anti")
    keyed = pool.withColumn("_k", order_key(seed, split, "document_id"))
    units = keyed.select(split, "_k").distinct()
    cuts = nth_keys(
        units, "_k", lambda n: {"cut": F.least(n, F.lit(per_split))}, group=[split]
    ).select(split, F.col("_k").alias("_cut"))
    return lookup_join(keyed, cuts, [split]).filter(F.col("_k") <= F.col("_cut")).drop("_k", "_cut")


def random_sample(rows: DataFrame, n: int, key: str = "eval_id", seed: int = 42) -> DataFrame:
    """n rows by hash order (all rows when there are fewer)."""
    keyed = rows.withColumn("_k", order_key(seed, key))
    cut = key_at(keyed, "_k", lambda size: F.least(size, F.lit(n)))
    return keyed.filter(F.col("_k") <= cut).drop("_k")


def balanced_sample(
    rows: DataFrame, n: int, challenger: str, baseline: str, key: str = "eval_id", seed: int = 42
) -> DataFrame:
    """n // 3 rows each where the challenger wins, the baseline wins, or a rank is missing; then random fill. A failed ranking (error) has no ranks.

    Only the first n rows of each bucket by hash order can ever be taken, so the pool is cut to those.
    """
    ranks = F.when(F.coalesce("error", F.lit("")) == "", F.col("ranks_by_condition"))
    rc, rb = F.try_element_at(ranks, F.lit(challenger)), F.try_element_at(ranks, F.lit(baseline))
    bucket = (
        F.when(rc.isNull() | rb.isNull(), "no_rank")
        .when(rc < rb, "challenger_wins")
        .when(rb < rc, "baseline_wins")
        .otherwise("tie")
    )
    pool = rows.select(key, bucket.alias("bucket"), order_key(seed, key).alias("_k"))
    heads = top_n(pool, n, F.col("_k"), group=["bucket"])
    quota = F.when(F.col("bucket") == "tie", 0).otherwise(max(1, n // 3))
    stage = F.when(F.col("rank") > quota, 3).otherwise(
        F.when(F.col("bucket") == "challenger_wins", 0).when(F.col("bucket") == "baseline_wins", 1).otherwise(2)
    )
    return (
        heads.withColumn("stage", stage)
        .orderBy("stage", "_k")
        .limit(n)
        .select(key, "bucket", (F.col("stage") < 3).alias("by_quota"))
    )


def row_slice(
    rows: DataFrame, order: str = "ord", start: int = 0, end: int = 0, max_rows: int = 0
) -> DataFrame:
    """Rows at positions start..end by a unique order column, clamped to the table."""
    start = max(0, start)
    place = F.col("_i")
    inside = place >= start
    if end > 0:
        inside = inside & (place < end)
    if max_rows > 0:
        inside = inside & (place < start + max_rows)
    kept = row_positions(rows, order, "_i").filter(inside)
    span = kept.agg(F.struct(F.min(order).alias("lo"), F.max(order).alias("hi"))).scalar()
    return rows.filter(F.col(order).between(span["lo"], span["hi"]))


def shard_assign(rows: DataFrame, shard_rows: int, order: str = "ord") -> DataFrame:
    """Add row_index and the name of the row-range shard each row belongs to."""
    indexed = with_row_index(rows, order)
    total = rows.agg(F.count(F.lit(1))).scalar()
    lo = F.floor(F.col("row_index") / shard_rows) * shard_rows
    hi = F.least(lo + shard_rows, total)
    return indexed.withColumn("shard", F.format_string("shard%06d_%06d", lo, hi))
