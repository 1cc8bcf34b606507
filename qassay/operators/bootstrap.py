"""Bootstrap percentile intervals by resampling histograms, one method for every size.

Values are counted per group and value first; resampling never touches rows again. The distinct values of a group are dealt into chunks
of about CHUNK bins. A replica draws n rows with replacement in two multinomial steps: how many fall into each chunk, and within a chunk
how many fall on each value. That is the same distribution as drawing rows one by one, at a cost of replicas times distinct values, and a
chunk only meets its own bins. Random numbers depend on the seed, the group, the block of replicas and the chunk alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qassay.operators.ranking import settle

CHUNK = 4096
BLOCK = 250


@dataclass(frozen=True)
class Statistic:
    """A statistic of sums over rows: terms of one value, summed under their names, and how it follows from the sums (``n`` counts the rows)."""

    terms: dict[str, Callable[[Column], Column]] = field(default_factory=lambda: {"sum": lambda v: v})
    finish: Callable[[dict[str, Column]], Column] = lambda s: s["sum"] / s["n"]


MEAN = Statistic()
STD = Statistic(
    {"sum": lambda v: v, "squares": lambda v: v * v},
    lambda s: F.sqrt(F.greatest(s["squares"] / s["n"] - (s["sum"] / s["n"]) * (s["sum"] / s["n"]), F.lit(0.0))),
)


def share_at_least(bound: float) -> Statistic:
    return Statistic({"sum": lambda v: (v >= bound).cast("double")})


def _chunked(values: DataFrame, group: list[str], value: str, terms: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row per chunk of a group: _k (its keys), _g (their hash), _chunk, _c rows, and _bins as structs of count and terms."""
    v = F.col(value).cast("double")
    hist = values.filter(v.isNotNull()).groupBy(F.struct(*group).alias("_k"), v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    chunks = hist.groupBy("_k").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_chunks"))
    bins = F.struct(F.col("_v"), F.col("_c"), *[term(F.col("_v")).cast("double").alias(f"_t{i}") for i, term in enumerate(terms.values())])
    return (
        hist.join(chunks, "_k")
        .groupBy("_k", F.pmod(F.xxhash64("_v"), F.col("_chunks")).alias("_chunk"))
        .agg(F.sum("_c").alias("_c"), F.array_sort(F.collect_list(bins)).alias("_bins"))
        .withColumn("_g", F.xxhash64("_k"))
    )


def _generator(*key: int) -> np.random.Generator:
    return np.random.default_rng([k & ((1 << 64) - 1) for k in key])


def _deal(n_boot: int, seed: int):
    """Groups (_k, _g, _block, _parts) -> how many draws of each replica of the block fall into each chunk."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                group, block = batch.column("_g")[i].as_py(), batch.column("_block")[i].as_py()
                parts = batch.column("_parts")[i].values
                rows = parts.field("_c").to_numpy()
                taken = _generator(seed, group, block).multinomial(rows.sum(), rows / rows.sum(), size=BLOCK)[: n_boot - block * BLOCK]
                same = pa.array(np.full(len(rows), i))
                draws = pa.array(list(np.ascontiguousarray(taken.T)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_k").take(same), parts.field("_chunk"), batch.column("_block").take(same), draws], ["_k", "_chunk", "_block", "_draws"]
                )

    return deal


def _resample(names: list[str], seed: int):
    """Chunks with the draws of a block of replicas -> sums of the terms per replica."""

    def resample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                group, block, chunk = (batch.column(c)[i].as_py() for c in ("_g", "_block", "_chunk"))
                bins = batch.column("_bins")[i].values
                rows = bins.field("_c").to_numpy()
                terms = np.stack([bins.field(f"_t{j}").to_numpy() for j in range(len(names))], axis=1)
                draws = batch.column("_draws")[i].values.to_numpy()
                sums = _generator(seed, group, block, chunk + 1).multinomial(draws, rows / rows.sum()) @ terms
                boots = block * BLOCK + np.arange(len(draws))
                keys = batch.column("_k").take(pa.array(np.full(len(draws), i)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(boots), pa.array(draws), *map(pa.array, sums.T)], ["_k", "_boot", "n", *names])

    return resample


def bootstrap_statistic(
    values: DataFrame,
    value: str,
    group: Sequence[str] = (),
    n_boot: int = 10_000,
    ci_level: float = 0.95,
    seed: int = 42,
    statistic: Statistic = MEAN,
) -> DataFrame:
    """Point estimate and percentile interval of a statistic per group. Null values are left out; a null group is a group."""
    keys = list(group) or ["_all"]
    rows = values if group else values.withColumn("_all", F.lit(0))
    names = [f"_s{i}" for i in range(len(statistic.terms))]
    chunks = settle(_chunked(rows, keys, value, statistic.terms))  # read for the sizes and by every block of replicas
    key_type = chunks.schema["_k"].dataType

    def schema(*fields: tuple[str, T.DataType]) -> T.StructType:
        return T.StructType([T.StructField("_k", key_type), *[T.StructField(n, t) for n, t in fields]])

    def finish() -> Column:
        return statistic.finish({"n": F.col("n"), **{t: F.col(n) for t, n in zip(statistic.terms, names, strict=True)}})

    own = [F.expr(f"aggregate(_bins, 0D, (a, b) -> a + b._c * b._t{i})") for i in range(len(names))]
    totals = chunks.groupBy("_k", "_g").agg(
        F.sum("_c").alias("n"),
        *[F.sum(c).alias(n) for c, n in zip(own, names, strict=True)],
        F.array_sort(F.collect_list(F.struct("_chunk", "_c"))).alias("_parts"),
    )
    blocks = F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // BLOCK))).alias("_block")
    # Few small rows become much work, so their number of tasks is set, not adapted.
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = totals.select("_k", "_g", "_parts", blocks).repartition(tasks, "_k", "_block").mapInArrow(
        _deal(n_boot, seed), schema(("_chunk", T.LongType()), ("_block", T.IntegerType()), ("_draws", T.ArrayType(T.LongType())))
    )
    sums = dealt.join(chunks.select("_k", "_g", "_chunk", "_bins"), ["_k", "_chunk"]).mapInArrow(
        _resample(names, seed), schema(("_boot", T.LongType()), ("n", T.LongType()), *[(n, T.DoubleType()) for n in names])
    )
    boots = sums.groupBy("_k", "_boot").agg(F.sum("n").alias("n"), *[F.sum(n).alias(n) for n in names])
    alpha = (1.0 - ci_level) / 2.0
    ends = boots.select("_k", finish().alias("_stat")).groupBy("_k").agg(
        F.percentile("_stat", F.array(F.lit(alpha), F.lit(1.0 - alpha))).alias("_q")
    )
    low, high = F.col("_q")[0], F.col("_q")[1]
    out = totals.join(ends, "_k").select(
        "_k.*",
        "n",
        F.bround(finish(), 4).alias("point"),
        F.bround(low, 4).alias("ci_low"),
        F.bround(high, 4).alias("ci_high"),
        ((low > 0) | (high < 0)).alias("excludes_zero"),
    )
    return out if group else out.drop("_all")


def bootstrap_mean(values: DataFrame, value: str, group: Sequence[str] = (), **options) -> DataFrame:
    """Point estimate and percentile interval of the mean per group."""
    return bootstrap_statistic(values, value, group, **options)


def pair_deltas(rows: DataFrame, pairs: DataFrame, value: str, key: str = "eval_id", arm: str = "condition") -> DataFrame:
    """Per named pair (challenger, baseline) and key: both values and their difference."""
    scored = rows.filter(F.col(value).isNotNull()).select(key, arm, F.col(value).cast("double").alias("_v"))
    c = scored.join(pairs.select("challenger", "baseline"), F.col(arm) == F.col("challenger")).select(
        key, "challenger", "baseline", F.col("_v").alias("challenger_value")
    )
    b = scored.select(key, F.col(arm).alias("baseline"), F.col("_v").alias("baseline_value"))
    return c.join(b, [key, "baseline"]).withColumn(
        "delta", F.col("challenger_value") - F.col("baseline_value")
    )


def bootstrap_paired(rows: DataFrame, pairs: DataFrame, value: str, **options) -> DataFrame:
    """Interval of the mean difference per pair, with the means of both arms."""
    deltas = pair_deltas(rows, pairs, value)
    keys = ["challenger", "baseline"]
    means = deltas.groupBy(*keys).agg(
        F.bround(F.avg("challenger_value"), 4).alias("challenger_mean"),
        F.bround(F.avg("baseline_value"), 4).alias("baseline_mean"),
    )
    return bootstrap_mean(deltas, "delta", keys, **options).join(means, keys)


def leaderboard_values(rows: DataFrame, pairs: DataFrame, value: str) -> DataFrame:
    """kind, name and _v of every arm (its values) and every pair (its differences)."""
    single = rows.select(
        F.lit("arm").alias("kind"), F.col("condition").alias("name"), F.col(value).cast("double").alias("_v")
    )
    paired = pair_deltas(rows, pairs, value).select(
        F.lit("pair").alias("kind"), F.concat_ws("_vs_", "challenger", "baseline").alias("name"), F.col("delta").alias("_v")
    )
    return single.unionByName(paired)


def bootstrap_leaderboard(rows: DataFrame, pairs: DataFrame, value: str, **options) -> DataFrame:
    """Intervals of every arm and of every pair (from enrich.match_baselines, or named) in one job."""
    return bootstrap_mean(leaderboard_values(rows, pairs, value), "_v", ["kind", "name"], **options)


def bootstrap_outcomes(outcomes: DataFrame, **options) -> DataFrame:
    """Interval of the win rate per condition with its wins, losses and ties."""
    o = F.col("outcome")
    counts = outcomes.groupBy("condition").agg(
        F.count_if(o == 1.0).alias("wins"), F.count_if(o == 0.0).alias("losses"), F.count_if(o == 0.5).alias("ties")
    )
    return bootstrap_mean(outcomes, "outcome", ["condition"], **options).join(counts, "condition")
