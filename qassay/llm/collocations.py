"""Phrase collocations by external streams of counts.

Counting. Phrases are counted order by order, each in one pass over the documents: a task codes the words of a chunk of text by the chunk's own
dictionary, counts distinct phrases with sorted codes, and sends (language, phrase, count). Only a phrase whose parts all occur often enough can occur
often enough itself. So the pass over pairs leaves out words that are too rare, and the pass over three words and more leaves out rare pairs. What is
rare is told by a bit table of at most 2**MAX_BITS bits, sized by the number of frequent phrases: it never takes a frequent phrase for a rare one, and where a huge
corpus fills it, more phrases are counted than needed, with the same result.

Estimating. The frequent phrases of all orders make one stream of counts, kept twice: in prefix order (language, first word, second word, ...) and in suffix
order (from the last word backwards). As every part of a frequent phrase is itself in the stream, the beginnings of a phrase are the latest shorter
phrases before it in prefix order, and its endings those before it in suffix order; so a single sweep carries the counts of all parts along.
A phrase that is always followed (preceded) by the same word is followed at once by that longer phrase. The two streams then meet in a merge join. Streams are
dealt by range, and a few counts for each range are handed on to the next ones; no group of phrases has to fit into a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qassay.llm.shared import BitTable, bit_table, settle

MAX_BITS = 28
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BREAKS = bytes(10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in _LOWER)
_LINE = re.compile(rb"\n")


def _held(table: BitTable, phrases: list[bytes], language: bytes) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(language, 42)  # as Spark's xxhash64(language, phrase)
    return table.holds(np.array([xxhash.xxh64_intdigest(p, seed) for p in phrases], dtype=np.uint64))


def phrase_table(phrases: DataFrame) -> BitTable:
    """The bits of (lang, phrase) rows."""
    return bit_table(phrases.select(F.xxhash64("lang", "phrase").alias("hash")), MAX_BITS)


def _segments(raw: bytes, limit: int) -> Iterator[bytes]:
    """raw in parts of about limit bytes, cut where a piece ends; a longer piece stays whole."""
    at = 0
    while len(raw) - at > limit:
        cut = _LINE.search(raw, at + limit)
        if cut is None:
            break
        yield raw[at : cut.start()]
        at = cut.end()
    yield raw[at:]


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, bytes]]:
    """(language, text) of about limit bytes: whole pieces of consecutive documents of one language, in lower case, one piece a line."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        languages = batch.column(0).to_pylist()
        for i, language in enumerate(languages):
            text = batch.column(1)[i].as_buffer()
            if text is None:
                continue
            for part in _segments(text.to_pybytes().translate(_BREAKS), limit):
                held.setdefault(language, []).append(part)
                sizes[language] = sizes.get(language, 0) + len(part)
                if sizes[language] >= limit:
                    yield language, b"\n".join(held.pop(language))
                    sizes.pop(language)
        while sum(sizes.values()) >= 4 * limit:
            language = max(sizes, key=sizes.get)
            yield language, b"\n".join(held.pop(language))
            sizes.pop(language)
    for language, parts in held.items():
        yield language, b"\n".join(parts)


def _coded(text: bytes) -> tuple[np.ndarray, pa.Array]:
    """Codes of the words in order, -1 where a piece ends, and the words."""
    encoded = pa.array(text.replace(b"\n", b" \n ").split(b" "), pa.binary()).dictionary_encode()
    code, words = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary
    names = words.to_pylist()
    empty, line = (names.index(x) if x in names else -1 for x in (b"", b"\n"))
    code = code[code != empty]
    return np.where(code == line, -1, code), words


def _rows(language: str, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([language] * len(phrases), pa.string()), phrases.cast(pa.string()), pa.array(counts, pa.int64())], ["lang", "phrase", "n"])


def _joined(left: pa.Array, right: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(left, right, pa.scalar(b" ", pa.binary()))


def _count_words(limit: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for language, text in _chunks(batches, limit):
            code, words = _coded(text)
            times = np.bincount(code[code >= 0], minlength=len(words))
            at = np.flatnonzero(times)
            yield _rows(language, words.take(pa.array(at)), times[at])

    return count


def _frequent_words(code: np.ndarray, words: pa.Array, table: BitTable, language: str) -> np.ndarray:
    """Codes with -1 in place of rare words as well."""
    keep = np.append(_held(table, words.to_pylist(), language.encode()), False)
    return np.where(keep[code], code, -1)


def _pairs(code: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Where pairs begin, which pair that is, the pairs as phrases, and their counts."""
    at = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0))
    key, which, times = np.unique(code[at] * len(words) + code[at + 1], return_inverse=True, return_counts=True)
    first, second = np.divmod(key, max(1, len(words)))
    return at, which, _joined(words.take(pa.array(first)), words.take(pa.array(second))), times


def _count_pairs(shared, limit: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for language, text in _chunks(batches, limit):
            code, words = _coded(text)
            _, _, phrases, times = _pairs(_frequent_words(code, words, shared.value, language), words)
            yield _rows(language, phrases, times)

    return count


def _count_longer(shared, limit: int, longest: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_table, pair_table = shared.value
        for language, text in _chunks(batches, limit):
            code, words = _coded(text)
            code = _frequent_words(code, words, word_table, language)
            at, which, phrases, _ = _pairs(code, words)
            good = _held(pair_table, phrases.to_pylist(), language.encode())[which]
            at, which = at[good], which[good]
            opens = np.zeros(len(code) + longest, dtype=bool)  # a frequent pair begins here
            opens[at] = True
            code = np.append(code, np.full(longest, -1))
            for order in range(3, longest + 1):
                longer = opens[at + order - 2]
                at, which = at[longer], which[longer]
                if not len(at):
                    break
                key, back, times = np.unique(which * len(words) + code[at + order - 1], return_inverse=True, return_counts=True)
                stem, word = np.divmod(key, len(words))
                phrases, which = _joined(phrases.take(pa.array(stem)), words.take(pa.array(word))), back
                yield _rows(language, phrases, times)

    return count


def _summed(docs: DataFrame, count) -> DataFrame:
    """Counts over all documents, combined in each task first."""
    return docs.mapInArrow(count, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, least: int, longest: int, chunk_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of all phrases of 1 to longest words that occur at least `least` times in the language, and (lang, total) of all words."""
    spark = docs.sparkSession
    words = settle(_summed(docs, _count_words(chunk_bytes)), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = words.filter(F.col("n") >= least)
    word_table = phrase_table(frequent)
    pairs = settle(_summed(docs, _count_pairs(spark.sparkContext.broadcast(word_table), chunk_bytes)).filter(F.col("n") >= least), "pairs")
    stream = frequent.unionByName(pairs)
    if longest > 2:
        shared = spark.sparkContext.broadcast((word_table, phrase_table(pairs)))
        longer = settle(_summed(docs, _count_longer(shared, chunk_bytes, longest)).filter(F.col("n") >= least), "longer")
        stream = stream.unionByName(longer)
    return stream, totals


def sweep(stream: DataFrame, words: Column, longest: int) -> DataFrame:
    """lang, phrase, n, parts and alone for a stream (lang, phrase, n) that holds with every phrase its beginnings in the order of words.

    words is the array of words in the order of the sweep, parts[k - 1] the count of its first k words (for k below its length), alone tells that
    the next longer phrase in the order occurs as often, so that the phrase only ever occurs within it.
    """
    ordered = stream.select("lang", words.alias("words"), "phrase", "n").repartitionByRange("lang", "words").sortWithinPartitions("lang", "words")
    ordered = settle(ordered.withColumn("range", F.spark_partition_id()), "stream")

    def latest(k: int) -> Column:
        return F.when(F.size("words") == k, F.col("n"))

    head = F.struct("lang", "words", "n")
    handed = ordered.groupBy("range").agg(F.min(head).alias("head"), *[F.max_by(latest(k), F.when(F.size("words") == k, F.struct("lang", "words"))).alias(f"end{k}") for k in range(1, longest)])
    # One row per range.
    by_range, before = Window.orderBy("range"), Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    handed = handed.select("range", F.lead("head").over(by_range).alias("next_head"), *[F.last(f"end{k}", ignorenulls=True).over(before).alias(f"carry{k}") for k in range(1, longest)])
    within = Window.partitionBy("range").orderBy("lang", "words")
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ordered.select("*", F.lead(head).over(within).alias("follower"), *[F.last(latest(k), ignorenulls=True).over(so_far).alias(f"part{k}") for k in range(1, longest)])
    swept = swept.join(F.broadcast(handed), "range").withColumn("follower", F.coalesce("follower", "next_head"))
    parts = F.slice(F.array(*[F.coalesce(f"part{k}", f"carry{k}") for k in range(1, longest)]), F.lit(1), F.size("words") - 1)
    longer = (F.col("follower.lang") == F.col("lang")) & (F.slice(F.col("follower.words"), F.lit(1), F.size("words")) == F.col("words")) & (F.size("follower.words") == F.size("words") + 1)
    return swept.select("lang", "phrase", "n", parts.alias("parts"), F.coalesce(longer & (F.col("follower.n") >= F.col("n")), F.lit(False)).alias("alone"))


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, phrase, a, total, starts, ends) with the counts l, r and the score of the lowest-scoring cut, in whole numbers of any size."""
    for batch in batches:
        cuts = []
        for a, n, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("a", "total", "starts", "ends")), strict=True):
            size = len(starts) + 1
            score, k = min((1000 * a * n // (starts[k - 1] * ends[size - k - 1]), k) for k in range(1, size))
            cuts.append((starts[k - 1], ends[size - k - 1], n, score))
        made = [pa.array(x, pa.int64()) for x in (zip(*cuts, strict=True) if cuts else ([],) * 4)]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in range(3)] + made, ["lang", "phrase", "a", "l", "r", "n", "score"])


def scored_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 100, longest: int = 5, chunk_bytes: int = 4 << 20) -> DataFrame:
    """lang, phrase, a, l, r, n and score of every candidate that is in no longer candidate with the same count.

    Words lie between blanks and tabs in the pieces between `.,;:!?` and line ends, A-Z in lower case. A candidate is a phrase of 2 to longest words
    with a >= least contiguous occurrences, overlaps included, in its language. A cut after k words gives l and r, the counts of both parts, and
    floor(1000 * a * n / (l * r)), n being all words of the language; the lowest counts, ties to the smallest k. Null languages are `und`, null and
    empty texts have no words, repeated rows count again, other columns are not looked at, no rows give no rows.
    """
    own = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    stream, totals = phrase_counts(own, least, longest, chunk_bytes)
    words = F.split("phrase", " ")
    in_prefix_order = sweep(stream, words, longest).filter(F.size("parts") > 0)
    in_suffix_order = sweep(stream, F.reverse(words), longest).filter((F.size("parts") > 0) & ~F.col("alone")).select("lang", "phrase", F.col("parts").alias("ends"))
    met = in_prefix_order.filter(~F.col("alone")).hint("merge").join(in_suffix_order, ["lang", "phrase"])
    met = met.join(totals, "lang").select("lang", "phrase", F.col("n").alias("a"), "total", F.col("parts").alias("starts"), "ends")
    return met.mapInArrow(_scores, "lang string, phrase string, a long, l long, r long, n long, score long")


def top_collocations(scored: DataFrame, first: int = 2000, parts: int = 64) -> DataFrame:
    """The first phrases of each language by score and count descending and phrase ascending (byte order), with their rank from 1. Parts of the
    phrases are cut before the language is, so a language's phrases never meet in one task."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    some = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
