"""Ranked lexical search of a stated query set by dense blocked matrix products.

Every item is a set of terms with whole-number weights, every document a vector of whole-number impacts. Items are taken in blocks of bounded size,
so what is broadcast is bounded however many items there are. Two passes over the documents serve a block: the first counts the documents that hold
each term of the block, the second scores. There the documents of a tile and the terms that occur in the tile make a dense matrix of impacts, the
items and the same terms a dense matrix of weights, and their product is a tile of scores. Products are taken in float64 over so few terms at a time
that no partial sum can reach 2**53, so they are exact; these partial sums are added as 64-bit integers.

A task keeps the k best documents of each item. A tile adds every document that scores at least as high as an item's k-th one, so ties are decided
by the document id alone, however documents are dealt. The best of all tasks are cut again by parts of the tasks, then as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qassay.llm.shared import settle, text_chunks
from qassay.llm.words import batch_words

EXACT = 1 << 53
# Fixed values of the ranking: tf * SCALE div (FLAT * tf + STEP * m), with m from the share PART of the length in 100.
SCALE, FLAT, STEP, PART = 1_000_000_000, 1000, 8, 90


@dataclass
class Vocabulary:
    """The distinct terms of one block of items, ascending, and the items' terms as (item, term) places."""

    terms: np.ndarray
    item: np.ndarray
    place: np.ndarray
    n_items: int

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are terms, and the places of these terms."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        found = np.flatnonzero(self.terms[at] == hashes)
        return found, at[found]


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_no, item_id and terms (distinct hashes) of every row of items; a text without terms has none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = []
            for _, chunk in text_chunks(batch.column(2)):
                hashes, offsets = batch_words(chunk)
                terms += [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.int64()))], ["item_no", "item_id", "terms"])

    own = items.select(F.monotonically_increasing_id().alias("item_no"), F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    return own.mapInArrow(cut, f"item_no long, item_id {own.schema['item_id'].dataType.simpleString()}, terms array<long>")


def _tiles(batches: Iterator[pa.RecordBatch], text: int, vocabulary: Vocabulary, tile: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Consecutive rows, at most tile of them, with their numbers of terms and the (row, term, occurrences) of their known terms."""
    for batch in batches:
        for at, chunk in text_chunks(batch.column(text)):
            hashes, offsets = batch_words(chunk)
            for first in range(0, len(chunk), tile):
                last = min(first + tile, len(chunk))
                own = hashes[offsets[first] : offsets[last]]
                found, place = vocabulary.lookup(own)
                row = np.searchsorted(offsets[first : last + 1] - offsets[first], found, side="right") - 1
                pair, times = np.unique(row * len(vocabulary.terms) + place, return_counts=True)
                yield batch.slice(at + first, last - first), np.diff(offsets[first : last + 1]), *divmod(pair, len(vocabulary.terms)), times


def term_counts(docs: DataFrame, shared, tile: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that hold each term of a broadcast vocabulary. One row per term and task is
    shuffled, one per term of the block reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        held, n_docs, n_terms = np.zeros(len(vocabulary.terms), dtype=np.int64), 0, 0
        for _, lengths, _, place, _ in _tiles(batches, 0, vocabulary, tile):
            held += np.bincount(place, minlength=len(held))
            n_docs, n_terms = n_docs + int((lengths > 0).sum()), n_terms + int(lengths.sum())
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(held[at], [n_docs, n_terms]))], ["place", "n"])

    rows = docs.select("text").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    found = {r["place"]: r["n"] for r in rows}
    return found.get(-1, 0), found.get(-2, 0), np.array([found.get(i, 0) for i in range(len(shared.value.terms))], dtype=np.int64)


def weights(n_docs: int, held: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in held], dtype=np.int64)


def impacts(times: np.ndarray, length_terms: np.ndarray) -> np.ndarray:
    return (SCALE * times) // (FLAT * times + STEP * length_terms)


def exact_product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left (items by terms) times right (terms by documents), both of whole numbers from 0 on, as int64. Terms are taken in strips so narrow that
    no sum of products of a strip reaches 2**53."""
    largest = max(1, int(left.max(initial=0))) * max(1, int(right.max(initial=0)))
    strip = max(1, (EXACT - 1) // largest)
    if largest >= EXACT:
        return left @ right
    total = np.zeros((left.shape[0], right.shape[1]), dtype=np.int64)
    for at in range(0, left.shape[1], strip):
        total += (left[:, at : at + strip].astype(np.float64) @ right[at : at + strip].astype(np.float64)).astype(np.int64)
    return total


class Best:
    """The k best (score descending, id ascending) documents of each item so far, from tiles in any order. Null ids come first."""

    def __init__(self, n_items: int, k: int, kind: pa.DataType):
        self.k, self.least = k, np.ones(n_items, dtype=np.int64)
        self.item, self.score, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), pa.array([], kind)

    def add(self, ids: pa.Array, scores: np.ndarray) -> None:
        item, row = np.nonzero(scores >= self.least[:, None])
        if not len(item):
            return
        self.item, self.score = np.append(self.item, item), np.append(self.score, scores[item, row])
        self.ids = pa.concat_arrays([self.ids, ids.take(pa.array(row))])
        by_id = np.empty(len(self.ids), dtype=np.int64)
        by_id[pc.sort_indices(self.ids, null_placement="at_start").to_numpy()] = np.arange(len(self.ids))
        order = np.lexsort((by_id, -self.score, self.item))
        sorted_item = self.item[order]
        starts = np.flatnonzero(np.append(True, sorted_item[1:] != sorted_item[:-1]))
        place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        kept = order[place < self.k]
        last = order[place == self.k - 1]
        self.least[self.item[last]] = self.score[last]
        self.item, self.score, self.ids = self.item[kept], self.score[kept], self.ids.take(pa.array(kept))


def _score(docs: DataFrame, shared, k: int, tile: int, cells: int) -> DataFrame:
    """item (its place in the block), doc_id, score and part (of the tasks) of each task's k best documents of each item."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weight, n_docs, n_terms = shared.value
        best = None
        for rows, lengths, row, place, times in _tiles(batches, 1, vocabulary, tile):
            best = Best(vocabulary.n_items, k, rows.schema.field(0).type) if best is None else best
            if not len(row):
                continue
            # Python's whole numbers, as the product of length and documents may pass 64 bits.
            length_term = np.array([100 - PART + PART * int(n) * n_docs // n_terms for n in lengths], dtype=np.int64)
            impact = impacts(times, length_term[row])
            active, column = np.unique(place, return_inverse=True)
            dense = np.zeros((len(active), len(rows)), dtype=np.int64)
            dense[column, row] = impact
            known = np.full(len(vocabulary.terms), -1, dtype=np.int64)
            known[active] = np.arange(len(active))
            wanted = np.flatnonzero(known[vocabulary.place] >= 0)
            item, term = vocabulary.item[wanted], known[vocabulary.place[wanted]]
            strip = max(1, cells // len(active))
            scores = np.zeros((vocabulary.n_items, len(rows)), dtype=np.int64)
            for first in range(0, vocabulary.n_items, strip):
                some = np.flatnonzero((item >= first) & (item < first + strip))
                matrix = np.zeros((min(strip, vocabulary.n_items - first), len(active)), dtype=np.int64)
                matrix[item[some] - first, term[some]] = weight[active][term[some]]
                scores[first : first + strip] = exact_product(matrix, dense)
            best.add(rows.column(0), scores)
        if best is not None and len(best.item):
            part = np.full(len(best.item), TaskContext.get().partitionId())
            yield pa.RecordBatch.from_arrays([pa.array(best.item), best.ids, pa.array(best.score), pa.array(part)], ["item", "doc_id", "score", "task"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(score, f"item long, doc_id {kind}, score long, task long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_items: int = 4096, block_terms: int = 1 << 20, tile: int = 512, cells: int = 1 << 21, tasks_in_part: int = 64) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of every item with a score above 0; equal scores by ascending doc_id.

    Terms are the words of `words`. Null and empty texts have no terms: such items have no rows, such documents are in no ranking and not counted.
    Every row of items is an item of its own, also with a null or repeated id; every row of docs is a document, so rows that repeat an id are ranked
    apart, null ids before others. Other columns are not looked at. Without items or documents there are no rows. A block holds about block_items
    items and block_terms terms, and at least one item; each further block costs two more passes over the documents.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    parsed = settle(item_terms(items, item_id, item_text).filter(F.size("terms") > 0), "items")
    n_items, n_terms = parsed.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(-(-n_items // block_items), -(-n_terms // block_terms))
    result = None
    for block in range(blocks):
        rows = parsed.filter(F.pmod(F.xxhash64("item_no"), F.lit(blocks)) == block).select("item_no", "terms").toPandas()
        if not len(rows):
            continue
        terms, place = np.unique(np.concatenate([np.asarray(t, dtype=np.int64) for t in rows["terms"]]).view(np.uint64), return_inverse=True)
        vocabulary = Vocabulary(terms, np.repeat(np.arange(len(rows)), [len(t) for t in rows["terms"]]), place, len(rows))
        total, length, held = term_counts(own, spark.sparkContext.broadcast(vocabulary), tile)
        shared = spark.sparkContext.broadcast((vocabulary, weights(total, held), total, length))
        found = _score(own, shared, k, tile, cells)
        numbers = spark.createDataFrame([(i, int(no)) for i, no in enumerate(rows["item_no"])], "item long, item_no long")
        # One row per item of the block.
        found = found.join(F.broadcast(numbers), "item").select("item_no", "doc_id", "score", F.call_function("div", "task", F.lit(tasks_in_part)).alias("part"))
        result = found if result is None else result.unionByName(found)
    kind = own.schema["doc_id"].dataType.simpleString()
    if result is None:
        result = spark.createDataFrame([], f"item_no long, doc_id {kind}, score long, part long")
    by_score = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    of_part = result.withColumn("rank", F.row_number().over(Window.partitionBy("item_no", "part").orderBy(*by_score))).filter(F.col("rank") <= k)
    ranked = of_part.withColumn("rank", F.row_number().over(Window.partitionBy("item_no").orderBy(*by_score))).filter(F.col("rank") <= k)
    return ranked.join(parsed.select("item_no", "item_id"), "item_no").select("item_id", "rank", "doc_id", "score")
