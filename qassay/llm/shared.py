"""Helpers of the operators: tables in the shared folder, Arrow batches cut into bounded chunks, whole groups from sorted batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qassay.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder of spark.checkpoint.dir, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage, survives the loss of executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(settled: DataFrame) -> None:
    """Delete a table of settle that nothing reads any more."""
    spark = settled.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(settled.settled_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc32_mod(id_col, n: int):
    """crc32 of an id written as text, modulo n: the split of labelled rows into learned and held out ones (null id: 0)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n)), F.lit(0))


def text_chunks(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of consecutive texts as (index of the first, UTF-8 texts; null as empty) of about limit bytes; a longer text comes alone."""
    start, size, chunk = 0, 0, []
    for i in range(len(texts)):
        held = texts[i].as_buffer()
        raw = b"" if held is None else held.to_pybytes()
        if chunk and size + len(raw) > limit:
            yield start, chunk
            start, size, chunk = i, 0, []
        chunk.append(raw)
        size += len(raw)
    if chunk:
        yield start, chunk


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames that hold whole groups each, from frames sorted by keys; only the open last group waits for the next frame."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        first, last = tuple(frame[keys].iloc[0]), tuple(frame[keys].iloc[-1])
        if held and tuple(held[0][keys].iloc[0]) != first:
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            held = []
        if first == last:
            held.append(frame)
            continue
        open_rows = (frame[keys] == list(last)).all(axis=1).to_numpy()
        cut = int(open_rows.argmax())
        yield pd.concat([*held, frame.iloc[:cut]], ignore_index=True)
        held = [frame.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def row_keys(*cols) -> list:
    """Two 64-bit hashes k1, k2 that name the rows with these values; rows that repeat share their name. Never null, so plain equi-joins hold nulls."""
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit("second"), *reversed(cols)).alias("k2")]


_BLOCK_BITS = 15  # bits of one block of Spark's bitmap functions


class BitTable:
    """Bits set for a set of 64-bit hashes: holds what was put in, and little else."""

    def __init__(self, bits: int, blocks: dict[int, bytes]):
        self.bits, self.table = bits, np.zeros((1 << bits) // 8, dtype=np.uint8)
        for block, held in blocks.items():
            at = block << (_BLOCK_BITS - 3)
            self.table[at : at + len(held)] = np.frombuffer(held, dtype=np.uint8)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64((1 << self.bits) - 1)
        return (self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bit_table(hashes: DataFrame, max_bits: int = 28) -> BitTable:
    """The bits of rows (hash: long), about 16 a row and at most 2**max_bits: 32 MB reach the driver, and each task, at most, whatever the rows."""
    bits = min(max_bits, max(_BLOCK_BITS, (16 * hashes.count()).bit_length()))
    place = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))
    # Spark counts bitmap buckets and positions from one.
    own = hashes.select(F.bitmap_bucket_number(place + 1).alias("block"), F.bitmap_bit_position(place + 1).alias("bit"))
    blocks = own.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("held")).collect()
    return BitTable(bits, {r["block"] - 1: bytes(r["held"]) for r in blocks})
