"""Case mining over judged arms, refusal statistics, catalogs and picks.

Arms of a question are brought together by one grouped aggregate per run and question; everything a
case needs from the long context is cut before that shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qassay.functions.judging import (
    is_correct_refusal,
    is_hallucination,
    is_invented,
    is_refusal_gold,
    is_refusal_like,
    refusal_class,
)
from qassay.functions.text import blank_to_null, head
from qassay.operators.enrich import align_arms
from qassay.operators.ranking import top_n

RUN = ("model", "dataset")
CASE_FIELDS = ("question", "gold", "pred", "context_preview", "grounding", "gold_alignment", "brief_reason", "refusal_class")
PREVIEW_CHARS = 800


def prepare_arms(rows: DataFrame, preview_chars: int = PREVIEW_CHARS) -> DataFrame:
    """Judged rows with the refusal class and a preview of the context."""
    return rows.withColumn("refusal_class", refusal_class(F.col("pred"))).withColumn(
        "context_preview", head(F.col("context"), preview_chars)
    )


def wide_arms(
    rows: DataFrame, arms: Sequence[str], run: Sequence[str] = RUN, order: str = "ord", preview_chars: int = PREVIEW_CHARS
) -> DataFrame:
    """One row per run and question that every arm answered, one struct per arm; of repeats the last by ``order`` wins."""
    wide = align_arms(prepare_arms(rows, preview_chars), arms, CASE_FIELDS, [*run, "eval_id"], order=order)
    for a in arms:
        wide = wide.filter(F.col(a).isNotNull())
    return wide


def _score(arm: str, field: str) -> Column:
    return F.coalesce(F.col(arm)[field].cast("double"), F.lit(0.0))


def _shared(field: str, arms: Sequence[str]) -> Column:
    return F.coalesce(*[blank_to_null(F.col(a)[field]) for a in arms])


def _cases(wide: DataFrame, pattern: str | Column, arms: Sequence[str], gap: Column, run: Sequence[str]) -> DataFrame:
    parts = []
    for a in arms:
        parts += [F.col(a)[f].alias(f"{a}_{f}") for f in ("pred", "refusal_class", "gold_alignment", "grounding", "brief_reason")]
    return wide.select(
        *run,
        "eval_id",
        (F.lit(pattern) if isinstance(pattern, str) else pattern).alias("pattern"),
        _shared("question", arms).alias("question"),
        _shared("gold", arms).alias("gold"),
        _shared("context_preview", arms).alias("context_preview"),
        *parts,
        gap.alias("score_gap"),
    )


def refusal_pairs(wide: DataFrame, candidate: str, baseline: str, run: Sequence[str] = RUN) -> DataFrame:
    """Unanswerable questions the candidate declines and the baseline invents an answer for."""
    hit = (
        is_refusal_gold(_shared("gold", [baseline, candidate]))
        & is_refusal_like(F.col(candidate)["refusal_class"])
        & is_invented(F.col(baseline)["refusal_class"])
    )
    gap = _score(candidate, "gold_alignment") - _score(baseline, "gold_alignment")
    return _cases(wide.filter(hit), "refusal", [baseline, candidate], gap, run)


def gap_pairs(
    wide: DataFrame, candidate: str, baseline: str, run: Sequence[str] = RUN,
    baseline_max: float = 2.0, candidate_min: float = 4.0, min_gap: float = 2.0,
) -> DataFrame:
    """Answerable questions with a low baseline and a high candidate score."""
    c, b = _score(candidate, "gold_alignment"), _score(baseline, "gold_alignment")
    hit = ~is_refusal_gold(_shared("gold", [baseline, candidate])) & (b <= baseline_max) & (c >= candidate_min) & (c - b >= min_gap)
    return _cases(wide.filter(hit), "judge_gap", [baseline, candidate], c - b, run)


def _gap_hit(
    candidate: str, baselines: Sequence[str], baseline_max: float = 2.0, candidate_min: float = 4.0, min_gap: float = 2.0
) -> tuple[Column, Column]:
    """Test and score gap of an answerable question only the candidate gets right."""
    c = _score(candidate, "gold_alignment")
    hit = ~is_refusal_gold(_shared("gold", [candidate, *baselines])) & (c >= candidate_min)
    for b in baselines:
        s = _score(b, "gold_alignment")
        hit = hit & (s <= baseline_max) & (c - s >= min_gap)
    return hit, F.least(*[c - _score(b, "gold_alignment") for b in baselines])


def _refusal_hit(candidate: str, baselines: Sequence[str]) -> tuple[Column, Column]:
    """Test and score gap of an unanswerable question only the candidate declines."""
    hit = is_refusal_gold(_shared("gold", [candidate, *baselines])) & is_refusal_like(F.col(candidate)["refusal_class"])
    for b in baselines:
        hit = hit & is_invented(F.col(b)["refusal_class"])
    return hit, _score(candidate, "gold_alignment") - F.greatest(*[_score(b, "gold_alignment") for b in baselines])


def gap_triples(
    wide: DataFrame, candidate: str, baselines: Sequence[str], run: Sequence[str] = RUN, **limits: float
) -> DataFrame:
    hit, gap = _gap_hit(candidate, baselines, **limits)
    return _cases(wide.filter(hit), "judge_gap", [candidate, *baselines], gap, run)


def refusal_triples(wide: DataFrame, candidate: str, baselines: Sequence[str], run: Sequence[str] = RUN) -> DataFrame:
    hit, gap = _refusal_hit(candidate, baselines)
    return _cases(wide.filter(hit), "refusal", [candidate, *baselines], gap, run)


def triple_cases(wide: DataFrame, candidate: str, baselines: Sequence[str], run: Sequence[str] = RUN) -> DataFrame:
    """Both kinds of triple case in one pass; a question is answerable or not, so it is one kind at most."""
    refusal, refusal_gap = _refusal_hit(candidate, baselines)
    answer, answer_gap = _gap_hit(candidate, baselines)
    pattern = F.when(refusal, "refusal").otherwise("judge_gap")
    gap = F.when(refusal, refusal_gap).otherwise(answer_gap)
    return _cases(wide.filter(refusal | answer), pattern, [candidate, *baselines], gap, run)


def mine_auto(wide: DataFrame, candidate: str, baselines: Sequence[str], n: int, run: Sequence[str] = RUN) -> DataFrame:
    """Best n refusal cases per run, or best n gap cases of runs that have no refusal case."""
    best = (F.desc("score_gap"), F.asc("eval_id"))
    heads = top_n(triple_cases(wide, candidate, baselines, run), n, *best, group=[*run, "pattern"])
    has_refusal = F.max(F.col("pattern") == "refusal").over(Window.partitionBy(*run))
    return heads.withColumn("_r", has_refusal).filter(~F.col("_r") | (F.col("pattern") == "refusal")).drop("_r")


def answer_wins(
    wide: DataFrame, candidate: str, baseline: str, run: Sequence[str] = RUN, high: float = 4.0, low: float = 2.0
) -> DataFrame:
    """Answerable questions with a grounded, aligned candidate answer and an ungrounded, misaligned baseline."""
    cg, bg = _score(candidate, "grounding"), _score(baseline, "grounding")
    ca, ba = _score(candidate, "gold_alignment"), _score(baseline, "gold_alignment")
    hit = (
        ~is_refusal_gold(_shared("gold", [baseline, candidate]))
        & (bg <= low)
        & (cg >= high)
        & ~is_refusal_like(F.col(candidate)["refusal_class"])
        & (ca >= 4.0)
        & (ba <= 2.0)
    )
    return _cases(wide.filter(hit), "answer_win", [baseline, candidate], cg - bg + 0.25 * (ca - ba), run)


def refusal_wins(
    wide: DataFrame, candidate: str, baseline: str, run: Sequence[str] = RUN, candidate_min: float = 4.0
) -> DataFrame:
    """Refusal cases whose refusal was also scored as right."""
    return (
        refusal_pairs(wide, candidate, baseline, run)
        .filter(F.coalesce(F.col(f"{candidate}_gold_alignment").cast("double"), F.lit(0.0)) >= candidate_min)
        .withColumn("pattern", F.lit("refusal_win"))
    )


def case_catalog(wide: DataFrame, candidate: str, baselines: Sequence[str], run: Sequence[str] = RUN) -> DataFrame:
    """Triple cases of all runs with a stable id."""
    cases = triple_cases(wide, candidate, baselines, run)
    return cases.withColumn("case_id", F.concat_ws("/", *run, "pattern", "eval_id"))


def with_context(
    cases: DataFrame, rows: DataFrame, arms: Sequence[str], run: Sequence[str] = RUN, order: str = "ord"
) -> DataFrame:
    """Cases with the whole context (column context) next to its preview; only contexts of cases are shuffled.

    The context is the first one that is not blank in the order of ``arms``, as for the preview.
    """
    keys = [*run, "eval_id"]
    wanted = rows.select(*keys, "condition", "context", order).join(cases.select(*keys).distinct(), keys, "left_semi")
    whole = align_arms(wanted, arms, ["context"], keys, order=order)
    return cases.join(whole.select(*keys, _shared("context", arms).alias("context")), keys, "left")


def catalog_summary(cases: DataFrame) -> DataFrame:
    """Case counts by model, dataset, pattern, run and overall, from one small table of counts."""
    counts = cases.groupBy("model", "dataset", "pattern").agg(F.count(F.lit(1)).alias("_n"))
    sets = [
        [F.col("model")], [F.col("dataset")], [F.col("pattern")], [F.col("model"), F.col("dataset")], [],
    ]
    dims = ("model", "dataset", "pattern")
    kept = [F.when(F.grouping(d) == 0, F.lit(d)) for d in dims]
    return counts.groupingSets(sets, "model", "dataset", "pattern").agg(
        F.coalesce(F.nullif(F.concat_ws("+", *kept), F.lit("")), F.lit("all")).alias("grouping"),
        F.sum("_n").alias("n_cases"),
    ).select("grouping", *[F.coalesce(d, F.lit("*")).alias(d) for d in dims], "n_cases")


def grounded_rates(rows: DataFrame, arms: Sequence[str], ungrounded_max: float = 2.0, order: str = "ord") -> DataFrame:
    """Per model and arm, by dataset and pooled, over questions every arm answered.

    Each row is reduced to three small flags before the shuffle; the pooled rows are summed from the
    per-dataset counts.
    """
    flags = rows.select(
        "model", "dataset", "eval_id", "condition", order,
        is_refusal_gold(F.col("gold")).alias("unans"),
        is_invented(refusal_class(F.col("pred"))).alias("answered"),
        F.col("grounding").cast("double").alias("g"),
    )
    wide = align_arms(flags, arms, ["unans", "answered", "g"], ["model", "dataset", "eval_id"], order=order)
    for a in arms:
        wide = wide.filter(F.col(a).isNotNull())
    long = wide.select(
        "model", "dataset",
        F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a).alias("v")) for a in arms])).alias("_x"),
    ).select("model", "dataset", "_x.arm", "_x.v.*")
    un, ans, g = F.col("unans"), F.col("answered"), F.col("g")
    counts = long.groupBy("model", "arm", "dataset").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(un).alias("unanswerable_n"),
        F.count_if(ans).alias("_answered"),
        F.count_if(ans & (g <= ungrounded_max)).alias("_ungrounded"),
        F.count_if(ans & g.isNull()).alias("answered_no_grounding"),
        F.count_if(~ans & un).alias("_right_refusal"),
        F.count_if(~ans & ~un).alias("_over_refusal"),
        F.count_if(ans & ~un & (g > ungrounded_max)).alias("_grounded"),
    )
    names = [c for c in counts.columns if c not in ("model", "arm", "dataset")]
    sums = counts.groupingSets(
        [[F.col("model"), F.col("arm"), F.col("dataset")], [F.col("model"), F.col("arm")]], "model", "arm", "dataset"
    ).agg(*[F.sum(c).alias(c) for c in names])
    answerable = F.col("n") - F.col("unanswerable_n")

    def share(a: str, b: Column) -> Column:
        return F.bround(F.try_divide(F.col(a), b), 4)

    return sums.select(
        "model", "arm", F.coalesce("dataset", F.lit("pooled")).alias("dataset"), "n", "unanswerable_n",
        answerable.alias("answerable_n"),
        share("_ungrounded", F.col("_answered")).alias("uar"),
        share("_answered", F.col("n")).alias("coverage"),
        share("_right_refusal", F.col("unanswerable_n")).alias("correct_refusal"),
        share("_over_refusal", answerable).alias("over_refusal"),
        share("_grounded", answerable).alias("grounded_accuracy"),
        "answered_no_grounding",
    )


def hallucination_stats(rows: DataFrame, candidate: str) -> DataFrame:
    """Rates per run and arm; the denominator of a run is its largest arm."""
    gold, pred, ga = F.col("gold"), F.col("pred"), F.col("gold_alignment")
    un = is_refusal_gold(gold)
    counts = rows.groupBy("model", "dataset", "condition").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(un).alias("unanswerable_n"),
        F.count_if(is_hallucination(gold, pred, ga)).alias("hallucination_n"),
        F.count_if(un & is_invented(refusal_class(pred))).alias("invent_n"),
        F.count_if(is_correct_refusal(gold, pred, ga)).alias("refusal_correct_n"),
        F.count_if(~un & (F.coalesce(ga.cast("double"), F.lit(0.0)) <= 2)).alias("wrong_n"),
    )
    run = Window.partitionBy("model", "dataset")
    return (
        counts.withColumn("n_eval", F.max("_n").over(run))
        .withColumn("_cand", F.max(F.when(F.col("condition") == candidate, F.col("hallucination_n"))).over(run))
        .select(
            "model", "dataset", "condition", "n_eval", "unanswerable_n",
            (F.col("_n") - F.col("unanswerable_n")).alias("answerable_n"),
            "hallucination_n", "invent_n", "refusal_correct_n", "wrong_n",
            F.bround(F.col("hallucination_n") / F.col("n_eval"), 4).alias("hallucination_rate"),
            F.bround(F.try_divide("invent_n", "unanswerable_n"), 4).alias("invent_rate"),
            F.bround(F.try_divide("refusal_correct_n", "unanswerable_n"), 4).alias("refusal_correct_rate"),
            F.bround(F.try_divide(F.col("wrong_n"), F.col("_n") - F.col("unanswerable_n")), 4).alias("wrong_rate"),
            F.bround((F.col("hallucination_n") - F.col("_cand")) / F.col("n_eval"), 4).alias("delta_vs_candidate"),
        )
    )


def hallucination_by_model(stats: DataFrame, candidate: str) -> DataFrame:
    """Run statistics summed per model; question counts are those of the candidate arm."""
    cand = F.col("condition") == candidate
    run = Window.partitionBy("model", "dataset")
    shared = stats.withColumn("_un", F.max(F.when(cand, F.col("unanswerable_n"))).over(run)).withColumn(
        "_an", F.max(F.when(cand, F.col("answerable_n"))).over(run)
    )
    sums = shared.groupBy("model", "condition").agg(
        F.sum("n_eval").alias("n_eval_rows"),
        F.sum("_un").alias("unanswerable_n"),
        F.sum("_an").alias("answerable_n"),
        *[F.sum(c).alias(c) for c in ("hallucination_n", "invent_n", "refusal_correct_n", "wrong_n")],
    )
    return sums.select(
        "model", "condition", "n_eval_rows", "unanswerable_n", "answerable_n",
        F.bround(F.col("hallucination_n") / F.col("n_eval_rows"), 4).alias("hallucination_rate"),
        F.bround(F.try_divide("invent_n", "unanswerable_n"), 4).alias("invent_rate"),
        F.bround(F.try_divide("refusal_correct_n", "unanswerable_n"), 4).alias("refusal_correct_rate"),
        F.bround(F.try_divide("wrong_n", "answerable_n"), 4).alias("wrong_rate"),
    )


def showcase_stats(cases: DataFrame, stats: DataFrame, candidate: str) -> DataFrame:
    """Cases per model and per evaluated row, strong ones by pattern."""
    strong = F.coalesce(F.col(f"{candidate}_gold_alignment").cast("double"), F.lit(0.0)) >= 4
    mined = cases.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.count_if(strong).alias("n_strong"),
        F.count_if(strong & (F.col("pattern") == "refusal")).alias("n_strong_refusal"),
        F.count_if(strong & (F.col("pattern") == "judge_gap")).alias("n_strong_gap"),
    )
    sizes = (
        stats.filter(F.col("condition") == candidate).groupBy("model").agg(F.sum("n_eval").alias("n_eval_rows"))
    )
    zero = F.lit(0)
    names = ("n_cases", "n_strong", "n_strong_refusal", "n_strong_gap")
    return (
        sizes.join(mined, "model", "left")
        .select("model", "n_eval_rows", *[F.coalesce(c, zero).alias(c) for c in names])
        .withColumn("case_rate", F.bround(F.col("n_cases") / F.col("n_eval_rows"), 4))
    )


def _position(name: Column, listed: Sequence[str]) -> Column:
    place = F.array_position(F.array(*[F.lit(x) for x in listed]), name)
    return F.when(place > 0, place).otherwise(len(listed) + 1)


def round_robin_pick(
    cases: DataFrame, candidate: str, datasets: Sequence[str], n: int = 20, candidate_min: float = 4.0
) -> DataFrame:
    """Per model: cycle through (pattern, dataset) buckets, best case first; then the best of other datasets."""
    strong = cases.filter(F.col(f"{candidate}_gold_alignment").cast("double") >= candidate_min)
    best = (F.desc("score_gap"), F.asc("case_id"))
    heads = top_n(strong, n, *best, group=["model", "pattern", "dataset"]).withColumnRenamed("rank", "bucket_rank")
    listed = F.col("dataset").isin(*datasets)
    bucket = F.when(F.col("pattern") == "refusal", 0).otherwise(len(datasets)) + _position(F.col("dataset"), datasets)
    turn = F.struct(
        F.when(listed, 0).otherwise(1).alias("late"),
        F.when(listed, F.col("bucket_rank").cast("double")).otherwise(-F.col("score_gap")).alias("turn"),
        F.when(listed, bucket).otherwise(0).alias("bucket"),
        F.col("case_id"),
    )
    w = Window.partitionBy("model").orderBy(turn)
    return heads.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= n)


def capped_pick(
    cases: DataFrame, quotas: dict[str, int], models: Sequence[str], per_bucket: int = 2
) -> DataFrame:
    """Per pattern: cycle through (model, dataset) buckets with a cap on each, until the quota."""
    best = (F.desc("score_gap"), F.asc("case_id"))
    heads = top_n(
        cases.filter(F.col("pattern").isin(*quotas)), per_bucket, *best, group=["pattern", "model", "dataset"]
    ).withColumnRenamed("rank", "bucket_rank")
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])[F.col("pattern")]
    w = Window.partitionBy("pattern").orderBy(
        "bucket_rank", _position(F.col("model"), models), "model", "dataset"
    )
    return heads.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= quota)


def highlights(cases: DataFrame, candidate: str, per_pattern: int = 8, per_model: int = 3, candidate_min: float = 4.0) -> DataFrame:
    """Best refusal cases, then best gap cases, with a cap per model over both."""
    strong = cases.filter(F.col(f"{candidate}_gold_alignment").cast("double") >= candidate_min)
    best = (F.desc("score_gap"), F.asc("case_id"))
    heads = top_n(strong, per_model, *best, group=["pattern", "model"]).withColumnRenamed("rank", "model_rank")
    overall = Window.partitionBy(F.lit(0)).orderBy(*best)

    def first(rows: DataFrame) -> DataFrame:
        return rows.withColumn("pick", F.row_number().over(overall)).filter(F.col("pick") <= per_pattern)

    refusals = first(heads.filter(F.col("pattern") == "refusal"))
    used = refusals.groupBy("model").agg(F.count(F.lit(1)).alias("_used"))
    gaps = heads.filter(F.col("pattern") == "judge_gap").join(used, "model", "left").filter(
        F.col("model_rank") <= per_model - F.coalesce("_used", F.lit(0))
    )
    return refusals.unionByName(first(gaps.drop("_used")))
