"""Tables of model requests: prompts are filled from rows, the calls happen elsewhere.

Templates are plain text with {name} slots and can be replaced by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qassay.constants import JUDGE_DIMENSIONS
from qassay.functions.judging import quality_tier
from qassay.functions.text import head, strip
from qassay.operators.ranking import with_row_index

GENERATE_TEMPLATE = (
    "Write {pairs} question and short answer grounded only in this excerpt.\n\nExcerpt:\n{passage}\n\n"
    'Reply with JSON holding "question" and "answer".'
)
JUDGE_TEMPLATE = "Context:\n{context}\n\nQuestion:\n{question}\n\nAnswer to evaluate:\n{answer}\n\nScore 1-5 as JSON."
GOLD_FIRST_TEMPLATE = (
    "Context:\n{context}\n\nQuestion:\n{question}\n\nGold:\n{gold}\n\nPrediction:\n{answer}\n\nScore 1-5 as JSON."
)
PRED_FIRST_TEMPLATE = (
    "Context:\n{context}\n\nQuestion:\n{question}\n\nPrediction:\n{answer}\n\nGold:\n{gold}\n\nScore 1-5 as JSON."
)
LISTWISE_TEMPLATE = (
    "Context:\n{context}\n\nQuestion:\n{question}\n\nGold:\n{gold}\n\nCandidates:\n{candidates}\n\n"
    "Rank all {n} from best to worst as JSON."
)
CLASSIFY_TEMPLATE = "Context:\n{context}\n\nQuestion:\n{question}\n\nGold:\n{gold}\n\nClassify as JSON."


def fill(template: str, **slots: Column) -> Column:
    """Template with its slots replaced; slot text is never searched for further slots."""
    parts: list[Column] = []
    rest = template
    while rest:
        found = [(rest.find("{" + name + "}"), name) for name in slots]
        found = [f for f in found if f[0] >= 0]
        if not found:
            parts.append(F.lit(rest))
            break
        at, name = min(found)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(F.coalesce(slots[name].cast("string"), F.lit("")))
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def cut_context(context: Column, max_chars: int) -> Column:
    return head(context, max_chars) if max_chars > 0 else context


def context_fraction(context: Column, fraction: float) -> Column:
    if fraction >= 1.0:
        return context
    return F.substring(context, F.lit(1), F.floor(F.length(context) * F.lit(fraction)).cast("int"))


def generation_requests(
    docs: DataFrame, pairs: int, one_call: bool = False, template: str = GENERATE_TEMPLATE, key: str = "document_id"
) -> DataFrame:
    """One request per document and pair index, or one per document asking for all pairs."""
    index = F.sequence(F.lit(0), F.lit(0 if one_call else pairs - 1))
    expected = pairs if one_call else 1
    prompt = fill(template, pairs=F.lit(expected), passage=strip(F.col("context")))
    return (
        docs.select("*", F.explode(index).alias("pair_index"))
        .withColumn("expected_pairs", F.lit(expected))
        .withColumn("prompt", prompt)
    )


def by_length(requests: DataFrame, text: str = "prompt") -> DataFrame:
    """Shortest first within each partition, for even batches; no shuffle."""
    return requests.sortWithinPartitions(F.length(text))


def judge_requests(
    rows: DataFrame, max_context_chars: int = 0, with_gold: bool = True, both_orders: bool = False
) -> DataFrame:
    """Rubric prompts; with a gold answer optionally in both presentation orders."""
    slots = dict(
        context=cut_context(F.col("context"), max_context_chars), question=F.col("question"), answer=F.col("answer")
    )
    if not with_gold:
        return rows.withColumn("presentation", F.lit("answer")).withColumn("prompt", fill(JUDGE_TEMPLATE, **slots))
    orders = ["gold_first", "pred_first"] if both_orders else ["gold_first"]
    slots["gold"] = F.col("gold")
    prompt = F.when(F.col("presentation") == "gold_first", fill(GOLD_FIRST_TEMPLATE, **slots)).otherwise(
        fill(PRED_FIRST_TEMPLATE, **slots)
    )
    return rows.withColumn("presentation", F.explode(F.array(*[F.lit(o) for o in orders]))).withColumn(
        "prompt", prompt
    )


def candidates_block(labels: Column, preds: Column, max_pred_chars: int = 0) -> Column:
    """Blocks of label and prediction, long predictions cut with an ellipsis."""

    def block(label: Column, pred: Column) -> Column:
        p = strip(pred)
        cut = F.when(F.length(p) > max_pred_chars, F.concat(head(p, max_pred_chars), F.lit("…"))).otherwise(p)
        return F.concat(F.lit("["), label, F.lit("]\n"), cut if max_pred_chars > 0 else p)

    return F.array_join(F.zip_with(labels, preds, block), "\n\n")


def listwise_requests(
    tasks: DataFrame, max_context_chars: int = 0, max_pred_chars: int = 0, template: str = LISTWISE_TEMPLATE
) -> DataFrame:
    """Tasks with labels and label_preds arrays to ranking prompts."""
    block = candidates_block(F.col("labels"), F.col("label_preds"), max_pred_chars)
    return tasks.withColumn("candidates", block).withColumn(
        "prompt",
        fill(
            template,
            context=cut_context(F.col("context"), max_context_chars),
            question=F.col("question"),
            gold=F.col("gold"),
            candidates=F.col("candidates"),
            n=F.size("labels"),
        ),
    )


def answer_requests(rows: DataFrame, use_context: bool = True, fraction: float = 1.0) -> DataFrame:
    """Question prompts with the (cut) context or without any."""
    q = strip(F.col("question"))
    if not use_context:
        return rows.withColumn("prompt", F.concat(F.lit("Question: "), q, F.lit("\n\nAnswer concisely.")))
    ctx = context_fraction(strip(F.col("context")), fraction)
    tail = "\n\nAnswer the question using only the context above. Be direct and concise."
    return rows.withColumn(
        "prompt", F.concat(F.lit("Context:\n"), ctx, F.lit("\n\nQuestion: "), q, F.lit(tail))
    )


def classifier_requests(
    rows: DataFrame, max_context_chars: int = 0, template: str = CLASSIFY_TEMPLATE
) -> DataFrame:
    return rows.withColumn(
        "prompt",
        fill(
            template,
            context=cut_context(strip(F.col("context")), max_context_chars),
            question=strip(F.col("question")),
            gold=strip(F.col("gold")),
        ),
    )


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def sft_judge_rows(rows: DataFrame, system: str, max_context_chars: int = 0) -> DataFrame:
    """Chat rows whose assistant turn is the teacher's scores as JSON."""
    j = F.col("llm_judge")
    scores = F.to_json(
        F.struct(
            *[j[d].cast("int").alias(d) for d in JUDGE_DIMENSIONS],
            F.coalesce(j["refuse_expected"], F.lit(False)).alias("refuse_expected"),
            head(F.coalesce(j["brief_reason"], F.lit("")), 500).alias("brief_reason"),
        )
    )
    answer = strip(F.col("answer"))
    tier = F.coalesce(
        F.nullif(j["quality_tier"], F.lit("")), quality_tier(answer, *[j[d].cast("int") for d in JUDGE_DIMENSIONS])
    )
    user = fill(
        JUDGE_TEMPLATE,
        context=cut_context(F.col("context"), max_context_chars),
        question=F.col("question"),
        answer=answer,
    )
    return (
        rows.withColumn("answer", answer)
        .withColumn("target_json", scores)
        .withColumn("teacher_quality_tier", tier)
        .withColumn(
            "messages",
            F.array(message("system", F.lit(system)), message("user", user), message("assistant", scores)),
        )
    )


def sft_generator_rows(rows: DataFrame, system: str, template: str = GENERATE_TEMPLATE) -> DataFrame:
    """Chat rows whose assistant turn is the question and answer as JSON."""
    target = F.to_json(F.struct(strip(F.col("question")).alias("question"), strip(F.col("answer")).alias("answer")))
    user = fill(template, pairs=F.lit(1), passage=strip(F.col("context")))
    return rows.withColumn("target_json", target).withColumn(
        "messages", F.array(message("system", F.lit(system)), message("user", user), message("assistant", target))
    )


def request_ids(rows: DataFrame, raw_id: str = "chunk_id", order: str = "ord", fallback: str | None = None) -> DataFrame:
    """Unique ids of [a-zA-Z0-9_-], at most 64 long; rows whose id is taken get their position as a suffix.

    A position is in one suffixed id only, so a clash is one between a plain id and a suffixed id; the plain one then gets its
    position too. Rows without a raw id use the ``fallback`` column, then their position. Joins are on unique ids or positions.
    """
    indexed = with_row_index(rows, order)
    raw = [F.nullif(F.col(c), F.lit("")) for c in (raw_id, fallback) if c]
    clean = F.btrim(F.regexp_replace(F.coalesce(*raw, F.lit("")), "[^a-zA-Z0-9_-]", "_"), F.lit("_"))
    fallback = F.concat(F.lit("row_"), F.col("row_index").cast("string"))
    base = indexed.withColumn("_id", head(F.coalesce(F.nullif(clean, F.lit("")), fallback), 64))
    position = F.col("row_index").cast("string")
    suffixed = F.concat(F.left("_id", F.least(F.lit(54), 63 - F.length(position))), F.lit("_"), position)
    firsts = base.groupBy("_id").agg(F.min("row_index").alias("row_index"))
    # First rows whose plain id looks like the suffixed id of a row (_by), whether or not that row needs it.
    alike = firsts.join(base.select(suffixed.alias("_id"), F.col("row_index").alias("_by")), "_id").select("row_index", "_by")
    plain = firsts.select("row_index").join(alike, "row_index", "left_anti")
    taken = alike.join(plain.select(F.col("row_index").alias("_by")), "_by", "left_anti").select("row_index")
    keep = firsts.select("row_index").join(taken, "row_index", "left_anti").withColumn("_keep", F.lit(True))
    return (
        base.join(keep, "row_index", "left")
        .withColumn("request_id", F.when(F.col("_keep"), F.col("_id")).otherwise(suffixed))
        .drop("_id", "_keep")
    )


def label_order(seed: int, eval_id: Column, conditions: Column) -> Column:
    """Conditions of one question in a seeded pseudo-random order."""
    keyed = F.transform(
        conditions,
        lambda c: F.struct(
            F.sha2(F.concat_ws(":", F.lit(str(seed)), eval_id, c), 256).alias("k"), c.alias("condition")
        ),
    )
    return F.transform(F.array_sort(keyed), lambda s: s["condition"])


