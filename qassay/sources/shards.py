"""Row-range shards: naming, writing, gap check, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE = "shard(\\d+)_(\\d+)"
PIECE_ROWS = 1 << 20  # rows of a shard that one task writes


def is_sharded_run(start: int, end: int, total: int) -> bool:
    return start > 0 or 0 < end < total


def write_shards(rows: DataFrame, path: str, piece_rows: int = PIECE_ROWS) -> None:
    """One folder per shard name (column shard), with one file; shards of more than piece_rows rows have one for each so many.

    Rows of a shard are brought together first, else every task writes a file to every shard. The number of tasks is given, because
    the cost lies in the files: by the bytes, Spark would leave many thousands of small ones to one task.
    """
    start, end = (F.regexp_extract("shard", RANGE, i).try_cast("bigint") for i in (1, 2))
    piece = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.greatest(F.ceil((end - start) / piece_rows), F.lit(1)))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(tasks, "shard", piece).write.mode("overwrite").partitionBy("shard").json(path)


def shard_ranges(rows: DataFrame, name: str = "shard") -> DataFrame:
    """Distinct shards with their bounds and row counts."""
    return rows.groupBy(name).agg(F.count(F.lit(1)).alias("n_rows")).select(
        name,
        F.regexp_extract(name, RANGE, 1).cast("bigint").alias("start"),
        F.regexp_extract(name, RANGE, 2).cast("bigint").alias("end"),
        "n_rows",
    )


def shard_check(ranges: DataFrame) -> DataFrame:
    """Adds expected_start and contiguous: shards must cover rows from 0 without a gap. One row per shard."""
    w = Window.partitionBy(F.lit(0)).orderBy("start")
    return ranges.withColumn("expected_start", F.lag("end", 1, 0).over(w)).withColumn(
        "contiguous", F.col("start") == F.col("expected_start")
    )


def merge_shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all shards with shard_start for ordering; fails when the shards leave a gap."""
    rows = spark.read.schema(f"{schema}, shard string").json(path)
    gap = shard_check(shard_ranges(rows)).filter(~F.col("contiguous")).limit(1).collect()
    if gap:
        raise ValueError(f"shard gap: expected start {gap[0]['expected_start']}, got {gap[0]['start']}")
    return rows.withColumn("shard_start", F.regexp_extract("shard", RANGE, 1).cast("bigint"))
