"""Operators that search, mine and shard whole corpora, on small fixtures against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from qassay.llm import collocations, ranked_search, shuffle_shards

SCHEMA = "doc_id long, text string, row string, place string, part string, n string"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
EDGES = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "a b c"), (None, None), (4, LONG), (5, "  \n\t \n"), (6, "x" * 5000)]


def frame(spark, rows):
    """Rows with further columns whose names clash with those the operators use."""
    return spark.createDataFrame([(*r, "own", "own", "own", "own") for r in rows], SCHEMA)


@pytest.mark.parametrize("size", [1, 2, 3, 16, 17, 101, 1000, 4099])
def test_permutation_is_one_and_walks_end(spark, size):
    permutation = shuffle_shards.Permutation(size, "seed")
    left, right = permutation.sides
    assert size <= left * right
    numbers = spark.range(size)
    got = numbers.select("id", permutation.column(F.col("id")).alias("y")).withColumn("back", permutation.column(F.col("y"), inverse=True)).collect()
    assert sorted(r.y for r in got) == list(range(size))
    assert all(r.y == permutation.of(r.id) and r.back == r.id for r in got)


def test_permutation_of_very_many_rows(spark):
    permutation = shuffle_shards.Permutation(10**17 + 3, "seed")
    numbers = spark.range(200).select((F.col("id") * 499999999999999 + 7).alias("x")).withColumn("y", permutation.column(F.col("x")))
    got = numbers.withColumn("back", permutation.column(F.col("y"), inverse=True)).collect()
    assert all(r.back == r.x and r.y == permutation.of(r.x) and 0 <= r.y < permutation.size for r in got)


def test_shards_are_even_gapless_and_reproducible(spark, tmp_path):
    rows = EDGES + [(100 + i, f"text {i % 7}") for i in range(90)] + [(500, "a copy")] * 60
    docs, order = frame(spark, rows), [F.col("doc_id"), F.col("text")]
    got = shuffle_shards.shard_rows(docs, order, 16, "seed").collect()
    again = shuffle_shards.shard_rows(docs.repartition(7, "text"), order, 16, "seed").collect()
    def seen(out):
        return Counter((r.row.doc_id, r.row.text, r.row_number, r.shard, r.slot) for r in out)
    assert seen(got) == seen(again) and len(got) == len(rows)
    by_order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [(r.row.doc_id, r.row.text) for r in sorted(got, key=lambda r: r.row_number)] == by_order
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in range(16)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    place = shuffle_shards.row_at(F.col("shard"), F.col("slot"), 16, "seed", len(rows)).alias("no")
    assert [r.no for r in spark.createDataFrame([(r.shard, r.slot) for r in got], "shard int, slot long").select(place).collect()] == [r.row_number for r in got]
    shuffle_shards.write_shards(shuffle_shards.shard_rows(docs, order, 16, "seed"), f"{tmp_path}/out")
    assert seen(got) == Counter((r.row.doc_id, r.row.text, n, r.shard, r.slot) for r in spark.read.parquet(f"{tmp_path}/out").collect() for n in [next(g.row_number for g in got if (g.shard, g.slot) == (r.shard, r.slot))])


def test_few_and_no_rows_to_shard(spark):
    order = [F.col("doc_id")]
    assert shuffle_shards.shard_rows(frame(spark, []), order, 16, "seed").count() == 0
    three = shuffle_shards.shard_rows(frame(spark, [(1, "a"), (2, None), (None, "b")]), order, 16, "seed").collect()
    assert {r.slot for r in three} == {0} and len({r.shard for r in three}) == 3


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def search_brute(docs, items, k=10):
    texts = [(i, re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))) for i, t in docs]
    n_docs, length = sum(1 for _, w in texts if w), sum(len(w) for _, w in texts)
    held = Counter(term for _, w in texts for term in set(w))
    out = Counter()
    for item_id, text in items:
        terms = set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text)))
        ranked = []
        for doc_id, words in texts:
            tf, score = Counter(words), 0
            for term in terms & set(tf):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[term] + 1)))
                score += w * (1000000000 * tf[term] // (1000 * tf[term] + 8 * (10 + 90 * len(words) * n_docs // length)))
            if score:
                ranked.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out.update((item_id, rank, r[3], -r[0]) for rank, r in enumerate(sorted(ranked)[:k], 1))
    return out


@pytest.mark.parametrize("limits", [{}, {"block_items": 2, "tile": 3, "cells": 4, "tasks_in_part": 1}])
def test_search_against_brute_force(spark, limits):
    words = [f"w{i}" for i in range(30)]
    rng = random.Random(3)
    docs = EDGES + [(100 + i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(60)] + [(50 - i, "W1 w2, W3") for i in range(20)] + [(7, "w1 w2 w3")] * 12
    items = [(1, "w1 w2"), (1, "w1 w2"), (None, "W3 w4 w4"), (2, None), (3, ""), (4, "..."), (5, "nowhere"), (6, " ".join(words)), (7, "word1 A é")]
    bench = spark.createDataFrame([(*i, "own") for i in items], "item_id long, text string, rank string")
    got = ranked_search.ranked_search(frame(spark, docs).repartition(5), bench, **limits).collect()
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == search_brute(docs, items)
    assert ranked_search.ranked_search(frame(spark, []), bench).count() == 0
    assert ranked_search.ranked_search(frame(spark, docs), bench.limit(0)).count() == 0


def test_search_with_text_ids_keeps_every_tie(spark):
    docs = spark.createDataFrame([(f"d{i:03d}", "same words") for i in range(200)] + [(None, "same words")], "doc_id string, text string").repartition(7)
    got = ranked_search.ranked_search(docs, spark.createDataFrame([("q", "words")], "item_id string, text string"), tile=4).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [None] + [f"d{i:03d}" for i in range(9)]


def test_products_stay_exact_beyond_one_strip():
    rng = np.random.default_rng(5)
    left, right = rng.integers(0, 1 << 30, (4, 50)), rng.integers(0, 1 << 21, (50, 6))
    want = [[sum(int(a) * int(b) for a, b in zip(left[i], right[:, j], strict=True)) for j in range(6)] for i in range(4)]
    assert ranked_search.exact_product(left, right).tolist() == want
    wide = np.array([[1 << 40, 3]]), np.array([[1 << 14], [5]])
    assert ranked_search.exact_product(*wide).tolist() == [[(1 << 54) + 15]]


def collocations_brute(rows, least, longest=5):
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            counts.update((lang or "und", tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    found = {k: a for k, a in counts.items() if a >= least and len(k[1]) > 1}
    out = set()
    for (lang, g), a in found.items():
        if any(o == lang and len(h) > len(g) and b >= a and any(h[i : i + len(g)] == g for i in range(len(h))) for (o, h), b in found.items()):
            continue
        n = totals[lang]
        score, k = min((1000 * a * n // (counts[lang, g[:k]] * counts[lang, g[k:]]), k) for k in range(1, len(g)))
        out.add((lang, " ".join(g), a, counts[lang, g[:k]], counts[lang, g[k:]], n, score))
    return out


@pytest.mark.parametrize("chunk", [4 << 20, 200])
def test_collocations_against_brute_force(spark, chunk):
    rng = random.Random(11)
    words = ["New", "york", "city", "é", "of", "the", "\x01a", "a", "b", "x\u00a0y"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ". ", "\n", ", "]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", "de", None])) for i in range(120)]
    rows += [(900 + i, "once upon a time there was, one", "en") for i in range(9)] + [(None, "a a a a a a", "de"), (1, None, "de"), (2, "", None), (3, "b " * 3000, "fr")]
    docs = spark.createDataFrame([(*r, "own", "own") for r in rows], "doc_id long, text string, lang string, phrase string, n string").repartition(5)
    got = collocations.scored_phrases(docs, least=6, chunk_bytes=chunk)
    assert {tuple(r) for r in got.select("lang", "phrase", "a", "l", "r", "n", "score").collect()} == collocations_brute(rows, 6)
    assert got.count() == len(collocations_brute(rows, 6))
    ranked = collocations.top_collocations(got, first=7, parts=3).collect()
    want = Counter()
    for lang in {r[2] or "und" for r in rows}:
        best = sorted((r for r in collocations_brute(rows, 6) if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:7]
        want.update((lang, i, r[1]) for i, r in enumerate(best, 1))
    assert Counter((r.lang, r["rank"], r.phrase) for r in ranked) == want


def test_no_rows_no_phrases_and_pairs_only(spark):
    schema = "doc_id long, text string, lang string"
    assert collocations.scored_phrases(spark.createDataFrame([], schema)).count() == 0
    rows = [(i, "one two three", "en") for i in range(5)]
    got = collocations.scored_phrases(spark.createDataFrame(rows, schema), least=5, longest=2)
    assert {r.phrase for r in got.collect()} == {"one two", "two three"}


def test_bits_are_those_of_the_hash(spark):
    rows = [("en", f"word{i} é") for i in range(5000)]
    table = collocations.phrase_table(spark.createDataFrame(rows, "lang string, phrase string"))
    assert collocations._held(table, [p.encode() for _, p in rows], b"en").all()
    assert collocations._held(table, [f"other{i}".encode() for i in range(5000)], b"en").mean() < 0.15


def test_sums_beyond_64_bits_stay_exact():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "phrase": ["a b"], "a": [10**12], "total": [10**16], "starts": [[10**13]], "ends": [[3 * 10**12]]})
    assert next(collocations._scores(iter([batch]))).column(6).to_pylist() == [1000 * 10**28 // (3 * 10**25)]
