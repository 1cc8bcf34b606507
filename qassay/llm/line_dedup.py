"""Exact line deduplication over all documents, in built-in expressions only.

Every line becomes a 128-bit hash of its key. The hashes are dealt by range over (hash, document) and sorted within each partition by hash,
document and position, so a line that stands in a third of all documents is spread over many partitions, while one document's repeats of a line
lie side by side. Streaming over this order gives each (line, document) once, with its first and all its positions; their counts per hash decide.
Back to the documents goes no text, but a compressed bitmap: the runs of dropped line numbers.

Lines that more than 1/HOT_LINES of all (line, document) rows hold are fewer than HOT_LINES, so they are broadcast and their rows are not shuffled by
line again; the others meet their counts in a shuffle whose largest key is bounded by that share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qassay.functions.text import bind
from qassay.llm.shared import row_keys, settle

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUNS = "array<struct<first:int,last:int>>"
HOT_LINES = 1024


def split_lines(text: Column) -> Column:
    """Lines between \\n; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def runs_of(positions: Column) -> Column:
    """Ascending distinct line numbers as runs, both ends included."""

    def build(p: Column) -> Column:
        opens = F.filter(p, lambda x, i: F.coalesce(F.get(p, i - 1) != x - 1, F.lit(True)))
        closes = F.filter(p, lambda x, i: F.coalesce(F.get(p, i + 1) != x + 1, F.lit(True)))
        return F.zip_with(opens, closes, lambda a, b: F.struct(a.alias("first"), b.alias("last")))

    return bind(positions, build)


def drop_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """k1, k2 (name of the row, see row_keys) and drop_runs for every row that loses lines: lines whose key has at least min_chars code points and
    stands in at least min_docs documents go, everywhere, or everywhere but at their first position in order of document and line (keep_first).

    Repeated rows (same id and text) are one document. Null ids come first in that order. Null and empty texts are one empty line, which
    stays for min_chars >= 1. No input rows: no output rows.
    """
    keys = docs.select(F.col(doc_id).alias("doc_id"), *row_keys(F.col(doc_id), F.col(text)), F.posexplode(split_lines(F.col(text))).alias("pos", "line"))
    keys = keys.withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_chars)
    hashed = keys.select("doc_id", "k1", "k2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    hashed = settle(hashed, "lines")

    dealt = hashed.repartitionByRange("h1", "h2", "doc_id", "k1", "k2").sortWithinPartitions("h1", "h2", "doc_id", "k1", "k2", "pos")
    once = dealt.groupBy("h1", "h2", "doc_id", "k1", "k2").agg(F.min("pos").alias("first"), F.collect_set("pos").alias("positions"))
    once = settle(once, "line_documents")

    counted = once.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "k1", "k2", "first")).alias("origin"))
    common = settle(counted.filter(F.col("n_docs") >= min_docs).select("h1", "h2", "n_docs", *(["origin"] if keep_first else [])), "common_lines")
    share = once.count() // HOT_LINES
    hot, other = common.filter(F.col("n_docs") > share).drop("n_docs"), common.filter(F.col("n_docs") <= share).drop("n_docs")
    # At most HOT_LINES rows can pass the share.
    cold = once.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti")
    dropped = once.join(F.broadcast(hot), ["h1", "h2"]).unionByName(cold.join(other, ["h1", "h2"]))
    if keep_first:
        is_origin = (F.col("k1") == F.col("origin.k1")) & (F.col("k2") == F.col("origin.k2"))
        dropped = dropped.withColumn("positions", F.when(is_origin, F.array_remove("positions", F.col("first"))).otherwise(F.col("positions")))
    numbers = dropped.groupBy("k1", "k2").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("numbers"))
    return numbers.filter(F.size("numbers") > 0).select("k1", "k2", runs_of(F.col("numbers")).alias("drop_runs"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with _n_lines, _n_dropped and _kept (the kept lines joined by \\n; the text itself, null as empty, where nothing goes)."""
    own = docs.select("*", *(k.alias(n) for k, n in zip(row_keys(F.col(doc_id), F.col(text)), ("_k1", "_k2"), strict=True)))
    runs = bitmaps.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("drop_runs").alias("_runs"))
    whole = F.coalesce(F.col(text), F.lit(""))

    def kept(lines: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform("_runs", lambda r: r["last"] + 1))
        ends = F.concat(F.transform("_runs", lambda r: r["first"]), F.array(F.size(lines)))
        return F.array_join(F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a))), "\n")

    joined = own.join(runs, ["_k1", "_k2"], "left")
    n_dropped = F.aggregate(F.coalesce("_runs", F.expr(f"cast(array() as {RUNS})")), F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    return joined.select(
        *docs.columns, (F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("_n_lines"),
        n_dropped.alias("_n_dropped"), F.when(F.col("_runs").isNull(), whole).otherwise(bind(split_lines(F.col(text)), kept)).alias("_kept"),
    )
