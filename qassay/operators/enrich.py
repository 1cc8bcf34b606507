"""Joins of evaluation rows: context lookup, resume, arm alignment, pass merging, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qassay.constants import DEBIAS_RUBRIC_VERSION, EVAL_DIMENSIONS, JUDGE_DIMENSIONS
from qassay.functions.judging import gold_reference, quality_tier
from qassay.functions.text import blank_to_null, first_filled, head, strip
from qassay.operators.ranking import first_per_key


def row_key(rows: DataFrame) -> Column:
    """eval_id, else chunk_id; null when both are blank so such rows meet no join partner."""
    names = [c for c in ("eval_id", "chunk_id") if c in rows.columns]
    return F.coalesce(*[blank_to_null(F.col(c).cast("string")) for c in names])


def eval_index(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Last row per key."""
    keyed = rows.withColumn("row_key", row_key(rows)).filter(F.col("row_key").isNotNull())
    return first_per_key(keyed, ["row_key"], order, largest=True)


def enrich_context(rows: DataFrame, index: DataFrame, overwrite: bool = False) -> DataFrame:
    """Fill blank context and gold from the index; context_filled tells where the context came from it."""
    ref = index.select(
        "row_key",
        blank_to_null(F.col("context")).alias("_context"),
        blank_to_null(first_filled(F.col("gold"), F.col("answer"))).alias("_gold"),
    )
    own = blank_to_null(F.col("context"))
    filled = F.col("_context").isNotNull() & (F.lit(overwrite) | own.isNull())
    return (
        rows.withColumn("row_key", row_key(rows))
        .join(ref, "row_key", "left")
        .withColumn("context_filled", filled)
        .withColumn("context", F.when(filled, F.col("_context")).otherwise(F.col("context")))
        .withColumn("gold", F.coalesce(blank_to_null(F.col("gold")), F.col("_gold"), F.col("gold")))
        .drop("_context", "_gold", "row_key")
    )


def enrich_multi_answer(rows: DataFrame, index: DataFrame, overwrite: bool = False) -> DataFrame:
    """As enrich_context for multi-answer rows: answers always come from the index, gold is their mode."""
    ref = index.select(
        "row_key",
        F.lit(True).alias("_hit"),
        blank_to_null(F.col("context")).alias("_context"),
        F.col("answers").alias("_answers"),
        gold_reference(F.col("answers"), F.col("unanswerable"), F.col("gold")).alias("_gold"),
        F.col("question").alias("_question"),
    )
    own = blank_to_null(F.col("context"))
    filled = F.col("_context").isNotNull() & (F.lit(overwrite) | own.isNull())
    hit = F.col("_hit").isNotNull()
    own_gold = blank_to_null(F.col("gold"))
    from_answers = F.when(
        F.size("answers") > 0, gold_reference(F.col("answers"), F.lit(False), F.col("gold"))
    )
    gold = F.when(hit, F.when(F.lit(overwrite) | own_gold.isNull(), F.col("_gold")).otherwise(F.col("gold"))).otherwise(
        F.coalesce(own_gold, from_answers, F.col("gold"))
    )
    return (
        rows.withColumn("row_key", row_key(rows))
        .join(ref, "row_key", "left")
        .withColumn("context_filled", filled)
        .withColumn("context", F.when(filled, F.col("_context")).otherwise(F.col("context")))
        .withColumn("gold", gold)
        .withColumn("answers", F.coalesce("_answers", "answers"))
        .withColumn("question", F.coalesce(blank_to_null(F.col("question")), F.col("_question")))
        .drop("_hit", "_context", "_answers", "_gold", "_question", "row_key")
    )


def judge_ok(judge: Column) -> Column:
    """Skipped on purpose, or scored without an error."""
    skipped = F.coalesce(judge["skipped"], F.lit(False))
    clean = F.coalesce(judge["error"], F.lit("")) == ""
    return F.coalesce(skipped | (clean & judge["overall"].isNotNull()), F.lit(False))


def resume_reuse(current: DataFrame, previous: DataFrame, order: str = "ord") -> DataFrame:
    """Current rows with a usable earlier judgement attached; reused tells which."""
    known = eval_index(previous, order).filter(judge_ok(F.col("llm_judge"))).select("row_key", "llm_judge")
    return (
        current.drop("llm_judge")
        .withColumn("row_key", row_key(current))
        .join(known, "row_key", "left")
        .withColumn("reused", F.col("llm_judge").isNotNull())
    )


def resume_todo(current: DataFrame, previous: DataFrame, order: str = "ord") -> DataFrame:
    """Current rows that still need a judgement."""
    known = eval_index(previous, order).filter(judge_ok(F.col("llm_judge"))).select("row_key")
    return current.withColumn("row_key", row_key(current)).join(known, "row_key", "left_anti")


def align_arms(
    rows: DataFrame,
    arms: Sequence[str],
    fields: Sequence[str],
    keys: Sequence[str] = ("eval_id",),
    arm: str = "condition",
    order: str = "ord",
) -> DataFrame:
    """One row per key with a struct column per arm (null where the arm has no row; of repeats the last by ``order`` wins).

    One shuffle with map-side combine; the state per key is one row per arm however often a key repeats.
    """
    block = F.struct(*[F.col(f) for f in fields])
    named = [
        F.max_by(F.when(F.col(arm) == a, block), F.when(F.col(arm) == a, F.col(order))).alias(a) for a in arms
    ]
    return rows.filter(F.col(arm).isin(*arms)).groupBy(*keys).agg(*named)


def paired_delta(
    rows: DataFrame, challenger: str, baseline: str, value: str, keys: Sequence[str] = ("eval_id",), order: str = "ord"
) -> DataFrame:
    """Value of both arms and their difference on keys that have both."""
    wide = align_arms(rows.filter(F.col(value).isNotNull()), [challenger, baseline], [value], keys, order=order)
    c, b = F.col(challenger)[value], F.col(baseline)[value]
    return wide.filter(c.isNotNull() & b.isNotNull()).select(
        *keys, c.alias("challenger_value"), b.alias("baseline_value"), (c - b).alias("delta")
    )


def complete_keys(
    rows: DataFrame, arms: Sequence[str], keys: Sequence[str] = ("eval_id",), arm: str = "condition"
) -> DataFrame:
    """Keys present in every arm; only key and arm are shuffled."""
    return (
        rows.filter(F.col(arm).isin(*arms))
        .groupBy(*keys)
        .agg(*[F.max(F.col(arm) == a).alias(f"_{i}") for i, a in enumerate(arms)])
        .filter(" AND ".join(f"_{i}" for i in range(len(arms))))
        .select(*keys)
    )


def arm_sizes(rows: DataFrame, arms: Sequence[str], keys: Sequence[str] = ("eval_id",), arm: str = "condition") -> DataFrame:
    """Rows of each arm next to the number of keys they all share."""
    shared = complete_keys(rows, arms, keys, arm).agg(F.count(F.lit(1))).scalar()
    return (
        rows.filter(F.col(arm).isin(*arms))
        .groupBy(arm)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("paired_n", shared)
    )


def swap_merge_scores(passes: DataFrame, key: str = "eval_id", answer: str = "answer", order: str = "ord") -> DataFrame:
    """Merge gold-first and prediction-first judgements of the same rows (column presentation)."""
    wide = align_arms(passes, ["gold_first", "pred_first"], ["llm_judge", answer], [key], arm="presentation", order=order)
    g, p = F.col("gold_first.llm_judge"), F.col("pred_first.llm_judge")
    g_bad, p_bad = _failed(F.col("gold_first")), _failed(F.col("pred_first"))
    both = ~g_bad & ~p_bad
    one = F.when(g_bad & F.col("pred_first").isNotNull(), p).otherwise(g)
    mean = {
        d: F.when(both, F.bround((g[d].cast("double") + p[d].cast("double")) / 2, 4)).otherwise(one[d].cast("double"))
        for d in EVAL_DIMENSIONS
    }
    refuse = F.when(
        both, F.coalesce(g["refuse_expected"], F.lit(False)) | F.coalesce(p["refuse_expected"], F.lit(False))
    ).otherwise(one["refuse_expected"])
    reasons = F.concat_ws(" | ", blank_to_null(g["brief_reason"]), blank_to_null(p["brief_reason"]))
    text = F.coalesce(F.col("gold_first")[answer], F.col("pred_first")[answer])
    tier = quality_tier(text, *[F.bround(mean[d]) for d in JUDGE_DIMENSIONS])
    complete = F.lit(True)
    for d in JUDGE_DIMENSIONS:
        complete = complete & mean[d].isNotNull()
    block = F.struct(
        *[mean[d].alias(d) for d in EVAL_DIMENSIONS],
        refuse.alias("refuse_expected"),
        F.when(both, head(reasons, 500)).otherwise(one["brief_reason"]).alias("brief_reason"),
        F.when(both, F.when(complete, tier)).otherwise(one["quality_tier"]).alias("quality_tier"),
        F.when(both, F.lit(DEBIAS_RUBRIC_VERSION)).otherwise(one["prompt_version"]).alias("prompt_version"),
        one["error"].alias("error"),
    )
    return wide.select(key, both.alias("debiased"), block.alias("llm_judge"))


def _failed(side: Column) -> Column:
    return side.isNull() | (F.coalesce(side["llm_judge"]["error"], F.lit("")) != "")


def rejudge_upsert(
    main: DataFrame, redone: DataFrame, min_delta: float = 0.0, key: str = "eval_id", score: str = "gold_alignment", order: str = "ord"
) -> DataFrame:
    """Rows with every re-judged column put in where a new row exists, all of it only if the overall mean rises by more than min_delta.

    Of several new rows of a key the last by ``order`` counts. Columns only ``main`` has, and ``order`` itself, stay.
    """
    fields = [c for c in main.columns if c in redone.columns and c not in (key, order)]
    new = first_per_key(redone, [key], order, largest=True).select(key, F.struct(*fields).alias("_new"))
    joined = main.join(new, key, "left")
    gain = joined.agg(F.avg(F.coalesce(F.col("_new")[score], F.col(score))) - F.avg(score)).scalar()
    use = F.col("_new").isNotNull() & F.coalesce(gain > min_delta, F.lit(False))
    chosen = [F.when(use, F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in main.columns]
    return joined.select(*chosen, use.alias("replaced"))


def train_overlap(rows: DataFrame, train: DataFrame, key: str = "document_id") -> DataFrame:
    """Documents and rows that also occur in the training set, and those that do not."""
    ids = train.select(key).distinct().withColumn("_t", F.lit(True))
    return (
        rows.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .join(ids, key, "left")
        .groupBy(F.col("_t").isNotNull().alias("in_train"))
        .agg(F.count(F.lit(1)).alias("n_documents"), F.sum("_n").alias("n_rows"))
    )


def suffix_family(name: Column) -> Column:
    """Comparison family by name ending."""
    return (
        F.when(name.endswith("_no_ctx"), "no_ctx")
        .when(name.endswith("_ctx"), "ctx")
        .when(name.endswith("_merge") | name.endswith("_lora") | name.endswith("_all"), "all")
        .otherwise("other")
    )


def match_baselines(conditions: DataFrame, name: str = "condition", role: str = "role", order: Sequence[str] = ("condition",)) -> DataFrame:
    """Each candidate with the first baseline of its family by the order columns (the place on a leaderboard), or the only baseline there is.

    Conditions are model arms; both sides are a handful of rows.
    """
    family = conditions.select(name, role, suffix_family(F.col(name)).alias("family"), F.struct(*order).alias("_place"))
    base = F.when(F.col(role) == "baseline", F.col(name))
    first = F.min_by(base, F.when(base.isNotNull(), F.col("_place")))
    same, every = Window.partitionBy("family"), Window.partitionBy(F.lit(0))
    only = F.when(F.count(base).over(every) == 1, F.min(base).over(every))
    return (
        family.withColumn("baseline", F.coalesce(first.over(same), only))
        .filter((F.col(role) == "candidate") & F.col("baseline").isNotNull())
        .select(F.col(name).alias("challenger"), "family", "baseline")
    )


def domain_rows(rows: DataFrame, prefixes: dict[str, str], source: str = "source") -> DataFrame:
    """Rows labelled with each domain whose prefix their source starts with."""
    hits = F.array(*[F.when(F.col(source).startswith(p), F.lit(d)) for d, p in prefixes.items()])
    return rows.withColumn("domain", F.explode(F.array_compact(hits)))


def question_metadata(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Topic and split with defaults, question number in the document, whether the document was trained on."""
    ids = train.select("document_id").distinct().withColumn("_t", F.lit(True))

    def number(name: str) -> Column:
        return F.regexp_extract(strip(F.col(name)), "(?i)-q(\\d+)$", 1).try_cast("int")

    return rows.join(ids, "document_id", "left").select(
        "eval_id",
        F.coalesce(blank_to_null(F.col("document_topic")), F.lit("unknown")).alias("document_topic"),
        F.coalesce(blank_to_null(F.col("split")), F.lit("unknown")).alias("split"),
        F.coalesce(number("chunk_id"), number("eval_id")).alias("question_index_in_doc"),
        F.col("_t").isNotNull().alias("in_synthetic_train_document"),
    )
