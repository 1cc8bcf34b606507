"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of consecutive words; a document is contaminated where a window occurs. Each window is a set of shingles
(runs of five words, shorter where the window is shorter). Containment of a window is required in full, so its necessary prefix is one shingle:
the rarest over all documents, counted in a first pass. The second pass joins the shingles of every document with these prefix shingles, applies
the positional and length bounds (the window must begin and end inside the document), and verifies each candidate word by word.

The benchmark is a stated query set: it is taken in blocks of about `block_windows` windows with their items, so what is broadcast is bounded whatever its size,
and documents are neither shuffled nor expanded. Each further block costs another pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qassay.llm.shared import settle, text_chunks
from qassay.llm.words import batch_words, shingles

SPANS = "array<struct<first:long,last:long>>"


class WindowIndex:
    """Windows of one block, found by their prefix shingle."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, items: list, shingle: int):
        self.words, self.lengths, self.items, self.shingle = words, lengths, items, shingle
        rows = [(i, o, self._width(n)) for i, n in enumerate(lengths) for o in range(n - self._width(n) + 1)]
        self.window, self.offset, self.width = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
        self.token = np.zeros(len(rows), dtype=np.uint64)
        for width in np.unique(self.width):
            at = self.width == width
            runs = self.words[self.window[at][:, None], self.offset[at][:, None] + np.arange(width)]
            self.token[at] = _row_shingles(runs)
        self.use(np.ones(len(rows), dtype=bool))

    def _width(self, n: int) -> int:
        return min(self.shingle, int(n))

    def use(self, chosen: np.ndarray) -> None:
        """Keep only the chosen shingles for lookup."""
        self.window, self.offset, self.width, self.token = (x[chosen] for x in (self.window, self.offset, self.width, self.token))
        order = np.lexsort((self.window, self.token))
        self.window, self.offset, self.width, self.token = (x[order] for x in (self.window, self.offset, self.width, self.token))
        self.distinct, self.first = np.unique(self.token, return_index=True)
        self.count = np.diff(np.append(self.first, len(self.token)))
        bits = max(16, int(np.ceil(np.log2(len(self.distinct) + 1))) + 5)
        self.mask = np.uint64((1 << bits) - 1)
        self.seen = np.zeros(1 << bits, dtype=bool)
        self.seen[self.distinct & self.mask] = True
        self.widths = np.unique(self.width)

    def keep_rarest(self, frequency: dict[int, int]) -> None:
        """The necessary prefix of each window: its shingle in the fewest documents."""
        seen = np.array([frequency.get(int(t), 0) for t in self.distinct.view(np.int64)], dtype=np.int64)
        rarity = np.repeat(seen, self.count)
        order = np.lexsort((self.token, rarity, self.window))
        chosen = np.zeros(len(order), dtype=bool)
        chosen[order[np.append(True, np.diff(self.window[order]) != 0)]] = True
        self.use(chosen)

    def lookup(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words where a known shingle begins, and its place among the distinct ones."""
        places, slots = [], []
        for width in self.widths:
            found = shingles(words, int(width))
            at = np.flatnonzero(self.seen[found & self.mask])
            slot = np.minimum(np.searchsorted(self.distinct, found[at]), len(self.distinct) - 1)
            right = self.distinct[slot] == found[at]
            places.append(at[right])
            slots.append(slot[right])
        return np.concatenate(places), np.concatenate(slots)

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and window of every occurrence of a window in the words of one document."""
        places, slots = self.lookup(words)
        many = self.count[slots]
        entry = np.repeat(self.first[slots] - np.cumsum(many) + many, many) + np.arange(many.sum())
        window = self.window[entry]
        start = np.repeat(places, many) - self.offset[entry]
        inside = (start >= 0) & (start + self.lengths[window] <= len(words))
        window, start = window[inside], start[inside]
        good = np.ones(len(start), dtype=bool)
        for j in range(self.words.shape[1]):
            part = good & (j < self.lengths[window])
            good[part] = words[start[part] + j] == self.words[window[part], j]
        return start[good], window[good]


def _row_shingles(runs: np.ndarray) -> np.ndarray:
    width = runs.shape[1]
    flat = shingles(runs.reshape(-1), width)
    return flat[::width]


def item_windows(benchmark: DataFrame, window: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row per window of each item: item_id, words (hashes). An item with fewer words is one window, one without words none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, words = [], []
            for at, texts in text_chunks(batch.column(1)):
                hashes, offsets = batch_words(texts)
                for i in range(len(texts)):
                    own = hashes[offsets[i] : offsets[i + 1]].view(np.int64)
                    for start in range(max(1, len(own) - window + 1) if len(own) else 0):
                        items.append(batch.column(0)[at + i].as_py())
                        words.append(own[start : start + window])
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(words, pa.list_(pa.int64()))], ["item_id", "words"])

    ids = F.col(item_id).cast("string").alias("item_id")
    return benchmark.select(ids, F.col(text).alias("text")).mapInArrow(cut, "item_id string, words array<long>")


def shingle_frequency(texts: DataFrame, shared) -> dict[int, int]:
    """Documents that hold each shingle of a broadcast index, over all documents: at most one row per shingle reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        totals = np.zeros(len(index.distinct), dtype=np.int64)
        for batch in batches:
            for _, chunk in text_chunks(batch.column(0)):
                hashes, offsets = batch_words(chunk)
                for i in range(len(chunk)):
                    totals[np.unique(index.lookup(hashes[offsets[i] : offsets[i + 1]])[1])] += 1
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(index.distinct[at].view(np.int64)), pa.array(totals[at])], ["token", "n"])

    rows = texts.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r["token"]: r["n"] for r in rows}


def _match(docs: DataFrame, shared) -> DataFrame:
    """Hit spans (merged, in words, last included) and occurring items of each (doc_id, text_key, text[, row]) row."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        span = pa.struct([("first", pa.int64()), ("last", pa.int64())])
        for batch in batches:
            n_words, spans, found = [], [], []
            for _, chunk in text_chunks(batch.column(2)):
                hashes, offsets = batch_words(chunk)
                for i in range(len(chunk)):
                    own = hashes[offsets[i] : offsets[i + 1]]
                    start, window = index.hits(own)
                    n_words.append(len(own))
                    spans.append(_merge(start, index.lengths[window]))
                    found.append(sorted({index.items[w] for w in np.unique(window)}, key=lambda x: (x is None, x)))
            out = batch.remove_column(2)
            made = {"n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, pa.list_(span)), "items": pa.array(found, pa.list_(pa.string()))}
            for name, values in made.items():
                out = out.append_column(name, values)
            yield out

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return docs.mapInArrow(match, f"{kept}, n_words long, spans {SPANS}, items array<string>")


def _merge(start: np.ndarray, length: np.ndarray) -> list[dict]:
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    first, reach = start[order], np.maximum.accumulate((start + length)[order])
    opens = np.append(True, first[1:] > reach[:-1])
    closes = np.append(opens[1:], True)
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(first[opens], reach[closes], strict=True)]


def _index(rows: pd.DataFrame, window: int, shingle: int) -> WindowIndex:
    lengths = np.array([len(w) for w in rows["words"]], dtype=np.int64)
    words = np.zeros((len(rows), window), dtype=np.uint64)
    for i, w in enumerate(rows["words"]):
        words[i, : len(w)] = np.asarray(w, dtype=np.int64).view(np.uint64)
    return WindowIndex(words, lengths, [x if isinstance(x, str) else None for x in rows["item_id"]], shingle)


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, shingle: int = 5, block_windows: int = 200_000, keep_row: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, spans (merged runs of hit words, both ends included, ascending) and items (occurring item ids as
    sorted distinct strings); with keep_row also row, a struct of all columns of docs.

    Null and empty texts have no words. Items with a null id hit words like others and stand in items as one null, at the end. Repeated rows keep one
    row each with equal results; an item text that stands under two ids gives both. An empty benchmark leaves every document clean, and other columns of either input are not looked at.
    """
    spark = docs.sparkSession
    row = [F.struct(*[F.col(c) for c in docs.columns]).alias("row")] if keep_row else []
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("text"), *row)
    windows = settle(item_windows(benchmark, window, item_id, item_text).distinct(), "windows")
    blocks = max(1, -(-windows.count() // block_windows))
    # A window that very many items share is dealt over blocks by the items, so a block stays bounded; what its blocks find is united.
    block_of = F.pmod(F.xxhash64("words", "item_id"), F.lit(blocks))
    result = None
    for block in range(blocks):
        rows = windows.filter(block_of == block).select("item_id", "words").toPandas()
        if not len(rows):
            continue
        index = _index(rows, window, shingle)
        index.keep_rarest(shingle_frequency(own.select("text"), spark.sparkContext.broadcast(index)))
        found = _match(own, spark.sparkContext.broadcast(index))
        result = found if result is None else _join_blocks(result, found)
    if result is None:
        none = F.expr(f"cast(array() as {SPANS})")
        counted = own.withColumn("n_words", F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long"))
        return counted.select("doc_id", *(["row"] if keep_row else []), "n_words", none.alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    return result.drop("text_key")


def _join_blocks(left: DataFrame, right: DataFrame) -> DataFrame:
    """Results of two blocks; repeated rows are equal, so the right side needs one row of each."""
    more = right.filter(F.size("items") > 0).dropDuplicates(["doc_id", "text_key"]).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("spans").alias("_spans"), F.col("items").alias("_items")
    )
    joined = left.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    spans = F.concat("spans", F.coalesce("_spans", F.expr(f"cast(array() as {SPANS})")))
    items = F.array_sort(F.array_union("items", F.coalesce("_items", F.expr("cast(array() as array<string>)"))))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = []
            for row in batch.column("spans").to_pylist():
                first, last = (np.array([x[k] for x in row], dtype=np.int64) for k in ("first", "last"))
                merged.append(_merge(first, last - first + 1))
            yield batch.set_column(batch.schema.get_field_index("spans"), "spans", pa.array(merged, batch.schema.field("spans").type))

    return joined.select(*left.columns[:-2], spans.alias("spans"), items.alias("items")).mapInArrow(merge, left.schema)
