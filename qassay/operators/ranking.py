"""Ordering helpers that never sort or window a whole table in one task.

Rows are bucketed by their order key (a hash prefix, or the magnitude of a number), buckets are counted
with a partial aggregate, and only the buckets that hold a wanted position are looked into; heavy ones are
split again until few rows are left. Positions of all rows come from a range-partitioned sort and
per-partition offsets.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qassay.session import ensure_checkpoint_dir

HASH_PREFIX = 3  # 16**3 buckets per group in the first round, when nothing is counted yet
STRETCH_ROWS = 1 << 16  # rows of a bucket that may be sorted in one task


def order_key(seed, *cols) -> Column:
    """Pseudo-random order that depends on the seed and the row key only, not on partitioning."""
    parts = [F.lit(str(seed))] + [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)


def hash_bucket(key: Column, prefix: int = HASH_PREFIX) -> Column:
    return F.substring(key, 1, prefix)


def magnitude_bucket(value: Column) -> Column:
    """Log-scale bucket of a number, monotone in the value, so exact for order statistics of long tails; infinities and NaN come last."""
    v = value.cast("double")
    top = F.lit(float("inf"))

    def scale(x: Column) -> Column:
        return F.floor(F.log2(x) * 256) + 1_000_000

    return (
        F.when(F.isnan(v), 4_000_000).when(v == top, 3_000_000).when(v == -top, -3_000_000)
        .when(v > 0, scale(v)).when(v < 0, -scale(-v)).otherwise(F.lit(0))
    )


def nth_keys(
    units: DataFrame,
    key: str,
    wanted: Callable[[Column], dict[str, Column]],
    group: Sequence[str] = (),
    bucket: Column | None = None,
    stretch_rows: int = STRETCH_ROWS,
) -> DataFrame:
    """Keys found at given 1-based positions of each group: columns group, mark, nth, key.

    ``wanted`` maps the group size to named positions; positions outside 1..size give no row. Null keys do not
    count. Strings are split by ever longer prefixes, numbers (with ``bucket=magnitude_bucket(...)``) by ever finer
    parts of the range they really fill, until the stretch that holds a position has at most ``stretch_rows`` rows
    or one value only. The fan-out of a round follows from the largest count of the one before.
    """
    group = list(group)
    digits = HASH_PREFIX if bucket is None else 0
    keyed = (
        units.select(*group, key, (hash_bucket(F.col(key)) if bucket is None else bucket).alias("_b"))
        .filter(F.col(key).isNotNull())
        .select(*[F.struct(*group).alias("_g") if group else F.lit(0).alias("_g")], key, "_b")
    )
    sizes = [F.count(F.lit(1)).alias("_rows"), F.min(key).alias("_lo"), F.max(key).alias("_hi")]
    per_group = Window.partitionBy("_g")
    running = per_group.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = (
        keyed.groupBy("_g", "_b").agg(*sizes)
        .withColumn("_upto", F.sum("_rows").over(running))
        .withColumn("_n", F.sum("_rows").over(per_group))
    )
    marks = [F.struct(F.lit(name).alias("mark"), nth.cast("bigint").alias("nth")) for name, nth in wanted(F.col("_n")).items()]
    hits = written(_holding(counts.withColumn("_m", F.explode(F.array(*marks))).select("*", "_m.*")))
    # Longs that are one double can not be told apart by arithmetic; there are few of them.
    wide = F.col("_lo") < F.col("_hi") if bucket is None else F.col("_lo").cast("double") < F.col("_hi").cast("double")
    heavy = wide & (F.col("_rows") > stretch_rows)
    while most := hits.filter(heavy).agg(F.max("_rows")).first()[0]:
        parts = 2 * math.ceil(most / stretch_rows)
        digits += max(1, min(4, math.ceil(math.log(parts, 16))))
        part = _finer(F.col(key), digits, min(parts, 1 << 16), bucket is None)
        finer = Window.partitionBy("_g", "mark").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = (
            _inside(keyed, hits.filter(heavy), key)
            .groupBy("_g", "_b", "mark", "nth", "_before", part.alias("_part")).agg(*sizes)
            .withColumn("_upto", F.col("_before") + F.sum("_rows").over(finer))
        )
        hits = written(hits.filter(~heavy).unionByName(_holding(counts)))
    one = F.col("_lo") == F.col("_hi")
    inside = Window.partitionBy("_g", "mark").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Equal keys are counted before the window, so a hot value is one row there.
    sorted_out = (
        _inside(keyed, hits.filter(~one), key)
        .groupBy("_g", "mark", "nth", "_before", key).agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_to", F.col("_before") + F.sum("_c").over(inside))
        .filter((F.col("nth") <= F.col("_to")) & (F.col("nth") > F.col("_to") - F.col("_c")))
        .select("_g", "mark", "nth", key)
    )
    found = hits.filter(one).select("_g", "mark", "nth", F.col("_lo").alias(key)).unionByName(sorted_out)
    return found.select(*[F.col("_g")[g].alias(g) for g in group], "mark", "nth", key)


def _holding(counts: DataFrame) -> DataFrame:
    """The bucket of each mark that holds its position, with the rows before it."""
    here = (F.col("nth") <= F.col("_upto")) & (F.col("nth") > F.col("_upto") - F.col("_rows"))
    return counts.filter(here).select("_g", "_b", "mark", "nth", (F.col("_upto") - F.col("_rows")).alias("_before"), "_rows", "_lo", "_hi")


def _inside(keyed: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Keys within the stretches. One row per group and mark: a written table, so Spark broadcasts it if its files are small."""
    stretches = hits.select(F.col("_g").alias("_hg"), F.col("_b").alias("_hb"), "mark", "nth", "_before", "_lo", "_hi")
    same = F.col("_g").eqNullSafe(F.col("_hg")) & (F.col("_b") == F.col("_hb"))
    return keyed.join(stretches, same & F.col(key).between(F.col("_lo"), F.col("_hi"))).drop("_hg", "_hb")


def _finer(key: Column, digits: int, parts: int, text: bool) -> Column:
    """Part of a stretch, monotone in the key: a prefix of a text, or a place between the ends of the stretch."""
    if text:
        return F.substring(key, 1, digits)
    low, high = F.col("_lo").cast("double"), F.col("_hi").cast("double")
    return F.floor((key.cast("double") - low) / (high - low) * parts)


def key_at(
    units: DataFrame, key: str, nth: Callable[[Column], Column], bucket: Column | None = None
) -> Column:
    """Key at one position of the whole table, as a scalar subquery; null when there is none."""
    return nth_keys(units, key, lambda n: {"cut": nth(n)}, bucket=bucket).agg(F.max(key)).scalar()


def row_positions(df: DataFrame, order: str, name: str = "row_index") -> DataFrame:
    """0-based position of every value of a unique order column: columns order, name.

    Range partitions are balanced by sampling, so a dense stretch of keys does not end up in one task.
    The sorted keys are settled because partition numbers must not change between the two reads.
    """
    placed = settle(
        df.select(order)
        .repartitionByRange(F.col(order))
        .sortWithinPartitions(order)
        .select(order, F.monotonically_increasing_id().alias("_m"))
    )
    part = F.shiftright("_m", 33)
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_p"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_lo"))
    )
    # One offset per partition.
    return placed.withColumn("_p", part).join(F.broadcast(offsets), "_p").select(
        order, (F.col("_lo") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).alias(name)
    )


def with_row_index(df: DataFrame, order: str, name: str = "row_index") -> DataFrame:
    """Rows with their 0-based position by a unique order column."""
    return df.join(row_positions(df, order, name), order)


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared checkpoint folder so it is computed once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared checkpoint folder. Unlike a checkpoint it has a size Spark knows when it plans a join."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup_join(rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join to a table that is usually small: Spark broadcasts it by the size of its files, else it shuffles."""
    return rows.join(written(table), list(on), how)


def running_totals(counts: DataFrame, value: str, count: str) -> DataFrame:
    """Adds _before, the sum of the counts of all smaller values. Values are distinct and not null.

    Values lie in range partitions, summed apart; only one sum per partition meets in a task.
    """
    placed = written(counts.repartitionByRange(value).withColumn("_p", F.spark_partition_id()))
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_p").agg(F.sum(count).alias("_c")).select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_lo"))
    within = Window.partitionBy("_p").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        placed.withColumn("_before", F.sum(count).over(within) - F.col(count))
        .join(F.broadcast(offsets), "_p")
        .withColumn("_before", F.col("_before") + F.col("_lo"))
        .drop("_p", "_lo")
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: str, largest: bool = False) -> DataFrame:
    """One whole row per key, the first (or last) by the order column; combined map-side."""
    pick = F.max_by if largest else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*df.columns), F.col(order)).alias("_row")).select("_row.*")


def value_at_rank(df: DataFrame, group: Sequence[str], value: str, rank: Callable[[Column], Column]) -> DataFrame:
    """Order statistic per group from the histogram of a column with few distinct values."""
    group = list(group)
    per_group = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    running = per_group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        df.groupBy(*group, value)
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_hi", F.sum("_c").over(running))
        .withColumn("_n", F.sum("_c").over(per_group))
        .filter(F.col("_hi") >= rank(F.col("_n")))
        .groupBy(*group)
        .agg(F.min(value).alias(value))
    )


def top_n(df: DataFrame, n: int, *order: Column, group: Sequence[str] = ()) -> DataFrame:
    """First n rows per group in an order: a cut per part of a group first, then one over the survivors."""
    group = list(group)
    parted = df.withColumn("_s", F.spark_partition_id() % 64)
    part = Window.partitionBy(*group, "_s").orderBy(*order)
    whole = Window.partitionBy(*group or [F.lit(0)]).orderBy(*order)
    return (
        parted.withColumn("_r", F.row_number().over(part))
        .filter(F.col("_r") <= n)
        .withColumn("rank", F.row_number().over(whole))
        .filter(F.col("rank") <= n)
        .drop("_s", "_r")
    )
