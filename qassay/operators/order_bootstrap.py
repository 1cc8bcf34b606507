"""Bootstrap intervals of order statistics (median, any quantile) without drawing rows.

The k-th smallest of n rows drawn with replacement is the row at place ceil(U * n) of the sorted rows, U being the k-th smallest of n uniform numbers,
which follows a Beta(k, n - k + 1) law; the next one follows from U by a Beta(1, n - k) law. So a replica costs two random numbers, whatever n is.

Values are counted per group and value, and their histogram is dealt by range and cut into chunks of neighbouring values. A chunk knows how many rows
lie before it and looks up the replicas whose places lie in it; replicas are drawn again from the same seed wherever they are needed, so no
place is shuffled. Chunks beyond the least and greatest place of all replicas are left out before.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qassay.operators.bootstrap import BLOCK, _generator, pair_deltas
from qassay.operators.ranking import settle

CHUNK_BITS = 12  # at most 4,096 distinct values a chunk


def _position(n: int, q: float) -> tuple[int, float]:
    """1-based place of the lower order statistic of a quantile of n rows, and the weight of the next one (linear interpolation)."""
    at = (n - 1) * q
    low = min(int(at), n - 1)
    return low + 1, at - low


def _places(n: int, q: float, group: int, block: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Places in the sorted rows of the two order statistics of each replica of a block, and the weight of the second."""
    k, weight = _position(n, q)
    draw = _generator(seed, group, block)
    low = draw.beta(k, n - k + 1, BLOCK)
    high = low + (1 - low) * draw.beta(1, n - k, BLOCK) if k < n else low
    first, second = (np.clip(np.ceil(u * n), 1, n).astype(np.int64)[:size] for u in (low, high))
    return first, second, weight


def _blocks(n_boot: int) -> Iterator[tuple[int, int]]:
    for block in range(-(-n_boot // BLOCK)):
        yield block, min(BLOCK, n_boot - block * BLOCK)


def _extremes(q: float, n_boot: int, seed: int):
    """Groups (_k, _g, n) -> the least and greatest place that any replica, or the statistic of all rows, needs."""

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least, most = [], []
            for g, n in zip(batch.column("_g").to_pylist(), batch.column("n").to_pylist(), strict=True):
                k, _ = _position(n, q)
                places = [_places(n, q, g, block, size, seed)[:2] for block, size in _blocks(n_boot)]
                least.append(min([k, *(int(first.min()) for first, _ in places)]))
                most.append(max([min(k + 1, n), *(int(second.max()) for _, second in places)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least), pa.array(most)], ["_k", "_g", "n", "_least", "_most"])

    return extremes


def _look_up(q: float, n_boot: int, seed: int):
    """Chunks (_k, _g, n, _before, _bins) -> _k, _boot (-1: all rows) and what the chunk adds to that replica's quantile."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                g, n, before = (batch.column(c)[i].as_py() for c in ("_g", "n", "_before"))
                bins = batch.column("_bins")[i].values
                values, upto = bins.field("_v").to_numpy(), before + np.cumsum(bins.field("_c").to_numpy())
                k, weight = _position(n, q)
                boots, parts = [], []
                own = [(-1, np.array([k]), np.array([min(k + 1, n)]))]
                own += [(block * BLOCK, *_places(n, q, g, block, size, seed)[:2]) for block, size in _blocks(n_boot)]
                for start, first, second in own:
                    for places, share in ((first, 1 - weight), (second, weight)):
                        here = np.flatnonzero((places > before) & (places <= upto[-1]))
                        if share > 0 and len(here):
                            boots.append(start + here)
                            parts.append(share * values[np.searchsorted(upto, places[here])])
                if boots:
                    boot = np.concatenate(boots)
                    keys = batch.column("_k").take(pa.array(np.full(len(boot), i)))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(boot), pa.array(np.concatenate(parts))], ["_k", "_boot", "_part"])

    return look_up


def bootstrap_quantile(
    values: DataFrame, value: str, group: Sequence[str] = (), q: float = 0.5, n_boot: int = 10_000, ci_level: float = 0.95, seed: int = 42
) -> DataFrame:
    """The q-quantile (linear interpolation) per group with its percentile interval. Null values are left out; a null group is a group; no rows, no groups."""
    if not 0 <= q <= 1:
        raise ValueError("q must lie between 0 and 1")
    keys = list(group) or ["_all"]
    rows = values if group else values.withColumn("_all", F.lit(0))
    v = F.col(value).cast("double")
    hist = rows.filter(v.isNotNull()).groupBy(F.struct(*keys).alias("_k"), v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ordered = hist.repartitionByRange("_k", "_v").sortWithinPartitions("_k", "_v")
    # Partition and place in it, both ascending, without their last bits: neighbouring values of a group share a chunk.
    ordered = settle(ordered.withColumn("_chunk", F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS)))
    sizes = ordered.groupBy("_k", "_chunk").agg(F.sum("_c").alias("_n"))
    of_group = Window.partitionBy("_k")
    before = of_group.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_k", "_chunk", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(of_group).alias("n"))
    key_type = ordered.schema["_k"].dataType

    def schema(*fields: tuple[str, T.DataType]) -> T.StructType:
        return T.StructType([T.StructField("_k", key_type), *[T.StructField(n, t) for n, t in fields]])

    long = T.LongType()
    groups = sizes.groupBy("_k").agg(F.max("n").alias("n")).select("_k", F.xxhash64("_k").alias("_g"), "n")
    groups = groups.mapInArrow(_extremes(q, n_boot, seed), schema(("_g", long), ("n", long), ("_least", long), ("_most", long)))
    needed = sizes.drop("n").join(groups, "_k").filter("_before < _most and _before + _n >= _least")
    bins = F.array_sort(F.collect_list(F.struct("_v", "_c"))).alias("_bins")
    chunks = ordered.join(needed, ["_k", "_chunk"]).groupBy("_k", "_chunk", "_g", "n", "_before").agg(bins)
    found = chunks.select("_k", "_g", "n", "_before", "_bins").mapInArrow(_look_up(q, n_boot, seed), schema(("_boot", long), ("_part", T.DoubleType())))
    boots = found.groupBy("_k", "_boot").agg(F.sum("_part").alias("_stat"))
    alpha = (1.0 - ci_level) / 2.0
    drawn = F.when(F.col("_boot") >= 0, F.col("_stat"))
    ends = boots.groupBy("_k").agg(F.max(F.when(F.col("_boot") < 0, F.col("_stat"))).alias("_point"), F.percentile(drawn, F.array(F.lit(alpha), F.lit(1.0 - alpha))).alias("_q"))
    low, high = F.col("_q")[0], F.col("_q")[1]
    out = ends.join(sizes.groupBy("_k").agg(F.max("n").alias("n")), "_k").select(
        "_k.*", "n", F.bround("_point", 4).alias("point"), F.bround(low, 4).alias("ci_low"), F.bround(high, 4).alias("ci_high"),
        ((low > 0) | (high < 0)).alias("excludes_zero"),
    )
    return out if group else out.drop("_all")


def bootstrap_median(values: DataFrame, value: str, group: Sequence[str] = (), **options) -> DataFrame:
    return bootstrap_quantile(values, value, group, q=0.5, **options)


def bootstrap_quantile_paired(rows: DataFrame, pairs: DataFrame, value: str, q: float = 0.5, **options) -> DataFrame:
    """Interval of a quantile of the differences of named pairs (challenger, baseline)."""
    return bootstrap_quantile(pair_deltas(rows, pairs, value), "delta", ["challenger", "baseline"], q=q, **options)
