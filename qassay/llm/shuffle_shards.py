"""Reproducible shuffle into shards by a permutation of global row numbers, in built-in expressions only.

Rows are numbered in a stated order. A keyed Feistel network permutes the numbers: the place of a row is its permuted number, its shard is the
place modulo the number of shards and its slot is the quotient. So the sizes of any two shards differ by one row at most, slots have no gaps, and
both follow from the row number alone, as the row number follows from them by the inverse network.

The network works on the numbers below left * right, the product closest above the number of rows among 4,096 roughly square ones. A number
that leaves the range of the rows is permuted again until it is back (cycle walking). Such walks only pass through the few numbers that are no
row, so the driver follows these and knows the longest walk before the rows are permuted.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qassay.llm.shared import settle

ROUNDS = 6
TRIED_SIDES = 4096


@dataclass(frozen=True)
class Permutation:
    """A permutation of 0 .. size - 1 named by a seed, as a Spark expression and as a plain function."""

    size: int
    seed: str

    @cached_property
    def sides(self) -> tuple[int, int]:
        near = max(1, math.isqrt(self.size))
        tried = range(near, near + TRIED_SIDES * (step := max(1, near // (2 * TRIED_SIDES))), step)
        return min(((a, max(1, -(-self.size // a))) for a in tried), key=lambda s: (s[0] * s[1] - self.size, s[0]))

    @cached_property
    def longest_walk(self) -> int:
        """The most times a number of the range is permuted beyond the first time."""
        left, right = self.sides
        longest = 0
        for start in range(self.size, left * right):
            steps, x = 0, start
            while x >= self.size and steps <= left * right - self.size:
                x, steps = self._network(x), steps + 1
            longest = max(longest, steps)
        return longest

    def _shift(self, round_: int, half: int, side: int) -> int:
        return int(hashlib.md5(f"{self.seed}:{round_}:{half}".encode()).hexdigest()[:15], 16) % side

    def _network(self, x: int) -> int:
        left, right = self.sides
        a, b = divmod(x, right)
        for i in range(ROUNDS):
            if i % 2 == 0:
                a = (a + self._shift(i, b, left)) % left
            else:
                b = (b + self._shift(i, a, right)) % right
        return a * right + b

    def of(self, x: int) -> int:
        x = self._network(x)
        while x >= self.size:
            x = self._network(x)
        return x

    def column(self, x: Column, inverse: bool = False) -> Column:
        """The permuted number of a long column with values of the range, or the number whose permuted one it is."""
        left, right = self.sides

        def shift(i: Column, half: Column, side: int) -> Column:
            text = F.concat(F.lit(f"{self.seed}:"), i.cast("string"), F.lit(":"), half.cast("string"))
            return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % F.lit(side)

        def turn(s: Column, i: Column) -> Column:
            on_a, on_b = shift(i, s["b"], left), shift(i, s["a"], right)
            a, b = (s["a"] - on_a, s["b"] - on_b) if inverse else (s["a"] + on_a, s["b"] + on_b)
            even = F.struct(F.pmod(a, F.lit(left)).alias("a"), s["b"].alias("b"))
            return F.when(i % 2 == 0, even).otherwise(F.struct(s["a"].alias("a"), F.pmod(b, F.lit(right)).alias("b")))

        def network(y: Column) -> Column:
            start = F.struct(F.call_function("div", y, F.lit(right)).alias("a"), (y % right).alias("b"))
            rounds = F.array(*[F.lit(i) for i in (range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS))])
            return F.aggregate(rounds, start, turn, lambda s: s["a"] * F.lit(right) + s["b"])

        steps = F.sequence(F.lit(0), F.lit(self.longest_walk))
        return F.aggregate(steps, x.cast("long"), lambda y, step: F.when((step == 0) | (y >= self.size), network(y)).otherwise(y))


def number_rows(rows: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, int]:
    """(row: a struct of all columns, row_number from 0 in the order) and the number of rows.

    Rows are dealt by range and sorted within their partition. Rows that are equal in the order are spread over partitions as well, and are numbered
    among themselves in any way. One offset per partition is joined to the rows.
    """
    keys = [f"key{i}" for i in range(len(order))]
    whole = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), *(c.alias(k) for c, k in zip(order, keys, strict=True)), F.monotonically_increasing_id().alias("spread"))
    dealt = whole.repartitionByRange(*keys, "spread").sortWithinPartitions(*keys, "spread")
    placed = settle(dealt.select("row", F.monotonically_increasing_id().alias("place")), "placed")
    placed = placed.select("row", F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    total = offsets.agg(F.sum("n")).first()[0] or 0
    # One row per partition.
    numbered = placed.join(F.broadcast(offsets.select("part", "first")), "part")
    return numbered.select("row", (F.col("first") + F.col("place")).alias("row_number")), total


def shard_rows(rows: DataFrame, order: Sequence[Column], shards: int, seed: str) -> DataFrame:
    """row (a struct of all columns), row_number (from 0, in the order), shard (from 0) and slot (from 0, gapless in its shard) of every row.

    Law `rows`: the counts of two shards differ by one at most, whatever the texts hold; a group of equal texts is spread like all other rows. Null
    keys come first. Rows that are equal in the order trade places at will, so give an order that tells apart whatever differs. Column names
    cannot clash, as all columns are in the struct. No rows give no rows.
    """
    numbered, total = number_rows(rows, order)
    place = Permutation(total, seed).column(F.col("row_number"))
    placed = numbered.withColumn("place", place)
    shard, slot = F.col("place") % shards, F.call_function("div", F.col("place"), F.lit(shards))
    return placed.select("row", "row_number", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def row_at(shard: Column, slot: Column, shards: int, seed: str, total: int) -> Column:
    """The number of the row that stands in a slot of a shard."""
    return Permutation(total, seed).column(slot.cast("long") * shards + shard, inverse=True)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the rows of shard_rows as one folder per shard (shard=0 and so on) with the columns of the rows and their slot. The files of a shard
    hold ascending ranges of slots; a shard larger than one partition is dealt over several files."""
    dealt = sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.select("shard", "slot", "row").write.partitionBy("shard").parquet(path)
