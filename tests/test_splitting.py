import random
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from qassay.operators import dedupe, passages, ranking, splitting


def sizes(n, train=0.8, val=0.1):
    """Split sizes by stepwise reduction."""
    if n <= 2:
        return [(0, 0, 0), (1, 0, 0), (1, 1, 0)][n]
    v, t = max(1, round(n * val)), max(1, round(n * (1.0 - train - val)))
    while n - v - t < 1 and (v > 1 or t > 1):
        if v >= t and v > 1:
            v -= 1
        else:
            t -= 1
    return n - v - t, v, t


@pytest.mark.parametrize("train,val", [(0.8, 0.1), (0.05, 0.9), (0.1, 0.3), (0.02, 0.5)])
def test_split_sizes(spark, train, val):
    df = spark.range(1, 60).withColumnRenamed("id", "n")
    a, b = splitting.split_sizes(F.col("n"), train, val)
    for r in df.select("n", a.alias("a"), b.alias("b")).collect():
        assert (r.a, r.b) == sizes(r.n, train, val)[:2], r


def test_stratified_split_with_a_hot_source(spark):
    rows = [(f"h{i}", "hot") for i in range(400)] + [(f"s{i}", f"s{i % 7}") for i in range(30)] + [("u", " "), ("v", None)]
    df = spark.createDataFrame(rows, "chunk_id string, source string")
    out = splitting.stratified_split(df).collect()
    assert len(out) == len(rows)
    counts = {}
    for r in out:
        counts.setdefault(r.split_source, {"train": 0, "val": 0, "test": 0})[r.split] += 1
    for c in counts.values():
        assert tuple(c.values()) == sizes(sum(c.values()))
    assert sum(counts["unknown"].values()) == 2
    again = splitting.stratified_split(df.repartition(1)).collect()
    assert {r.chunk_id: r.split for r in again} == {r.chunk_id: r.split for r in out}


def test_split_by_group_keeps_documents_whole(spark):
    rows = [(f"d{i % 25}", f"c{i}") for i in range(200)] + [(" ", "d3::x"), (None, "")]
    df = spark.createDataFrame(rows, "document_id string, chunk_id string")
    out = splitting.split_by_group(df).collect()
    by_doc = {}
    for r in out:
        by_doc.setdefault(r.split_key, set()).add(r.split)
    assert all(len(v) == 1 for v in by_doc.values())
    assert sum(v == {"val"} for v in by_doc.values()) == round(26 * 0.1)
    order = sorted(by_doc, key=lambda d: hashlib.sha256(f"42:{d}".encode()).hexdigest())
    assert {d for d in by_doc if by_doc[d] == {"val"}} == set(order[: round(26 * 0.1)])
    assert splitting.split_by_group(df, val_ratio=0.0).filter("split = 'val'").count() == 0
    assert splitting.split_by_group(df.limit(1)).filter("split = 'val'").count() == 0


def test_random_holdout_sizes(spark):
    def held(n, f):
        return splitting.random_holdout(spark.range(n), "id", f).filter("is_eval").count()

    assert [held(1, 0.5), held(10, 0.25), held(10, 0.01), held(5, 1.0), held(30, 1.0)] == [0, 2, 1, 1, 3]


def test_random_sample_is_the_hash_head(spark):
    df = spark.createDataFrame([(str(i),) for i in range(50)], "eval_id string")
    got = {r[0] for r in splitting.random_sample(df, 7).collect()}
    assert got == set(sorted(map(str, range(50)), key=lambda x: hashlib.sha256(f"42:{x}".encode()).hexdigest())[:7])
    assert splitting.random_sample(df, 500).count() == 50


def test_row_slice_and_index(spark):
    df = spark.createDataFrame([(i * 7 if i % 2 else i,) for i in range(300)], "ord bigint").distinct()
    ordered = sorted(r[0] for r in df.collect())
    got = splitting.row_slice(df, start=10, end=50, max_rows=20).collect()
    assert sorted(r[0] for r in got) == ordered[10:30]
    assert splitting.row_slice(df, start=10_000).count() == 0
    for r in ranking.with_row_index(df, "ord").collect():
        assert ordered[r.row_index] == r.ord


def test_nth_keys_with_one_hot_value(spark):
    values = [5.0] * 500 + [0.0] * 40 + [-3.0] * 3 + [float(i) for i in range(100)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    marks = {"a": 1, "b": 3, "c": 44, "d": 300, "e": len(values)}
    got = ranking.nth_keys(
        df, "v", lambda n: {k: F.lit(m) for k, m in marks.items()}, group=["g"], bucket=ranking.magnitude_bucket(F.col("v"))
    ).collect()
    assert {r.mark: r.v for r in got} == {k: sorted(values)[m - 1] for k, m in marks.items()}


def test_top_n_per_group(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v")).repartition(7)
    rows = ranking.top_n(df, 4, F.desc("v"), group=["g"]).collect()
    assert sorted((r.g, r["rank"], r.v) for r in rows) == sorted(
        (g, k + 1, v) for g in range(3) for k, v in enumerate(sorted((x for x in range(1000) if x % 3 == g), reverse=True)[:4])
    )


def test_lookup_join_both_ways(spark):
    left = spark.range(20).withColumn("k", F.col("id") % 5)
    right = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    small = ranking.lookup_join(left, right, ["k"])
    assert "BroadcastHashJoin" in small._jdf.queryExecution().toString()
    want = sorted(small.collect())
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(ranking.lookup_join(left, right, ["k"]).collect()) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_nth_keys_splits_heavy_stretches_again(spark):
    rng = np.random.default_rng(3)
    close = 1.0 + rng.integers(0, 10**6, 3000) * 1e-9  # all in one magnitude bucket
    groups = {"close": close.tolist(), "wide": (10.0 ** rng.uniform(-300, 300, 2000) * rng.choice([-1, 1], 2000)).tolist()}
    groups["ends"] = [float("inf")] * 50 + [float("-inf")] * 50 + [float("nan")] * 50 + [0.0] * 50 + [5e-324, 1e308]
    groups[None] = [7.0] * 400 + [7.0000001] * 3
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("close", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    marks = {"first": lambda n: F.lit(1), "mid": lambda n: F.floor(n / 2) + 1, "late": lambda n: F.floor(n * 0.9), "last": lambda n: n, "none": lambda n: n + 1}
    for rows_a_task in (16, 1 << 16):
        found = ranking.nth_keys(df, "v", lambda n: {k: f(n) for k, f in marks.items()}, ["g"], ranking.magnitude_bucket(F.col("v")), rows_a_task)
        got = {(r.g, r.mark): r.v for r in found.collect()}
        for g, values in groups.items():
            ordered, n = sorted(values, key=lambda v: (v != v, v)), len(values)
            for mark, nth in {"first": 1, "mid": n // 2 + 1, "late": int(n * 0.9), "last": n}.items():
                assert got[g, mark] == ordered[nth - 1] or ordered[nth - 1] != ordered[nth - 1] and got[g, mark] != got[g, mark]
        assert len(got) == 4 * len(groups)


def test_nth_keys_of_long_prefixes_and_longs(spark):
    keys = sorted("abc" * 5 + f"{i:05d}" for i in range(2000))
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = ranking.nth_keys(df, "k", lambda n: {"a": F.lit(1000), "b": n}, stretch_rows=50).collect()
    assert {r.mark: r.k for r in got} == {"a": keys[999], "b": keys[-1]}
    longs = spark.range(2**62, 2**62 + 3000).withColumnRenamed("id", "k")
    got = ranking.nth_keys(longs, "k", lambda n: {"a": F.lit(77)}, bucket=ranking.magnitude_bucket(F.col("k")), stretch_rows=50).collect()
    assert [r.k for r in got] == [2**62 + 76]
    assert ranking.nth_keys(longs.limit(0), "k", lambda n: {"a": F.lit(1)}, bucket=ranking.magnitude_bucket(F.col("k"))).collect() == []


def test_dedupe_first_counts_from_the_first_good_row(spark):
    long = "x" * 40
    rows = [
        ("d", "short", "a", 1, "t"), ("d", long + "1", "b", 2, "t"), ("d", "short", "c", 3, "t"), ("d", long + "2", "b", 4, "t"),
        (" ", long, "a", 5, "t"), ("e", "short", "a", 6, "t"), (None, long, "a", 7, "t"),
    ]
    df = spark.createDataFrame(rows, "document_id string, context string, split string, ord int, document_topic string")
    out = dedupe.dedupe_first(df).collect()
    assert [(r.document_id, r.context, r.n_source_rows, r.splits) for r in out] == [("d", long + "1", 3, ["b", "c"])]
    stats = dedupe.dedupe_first_stats(df).first()
    assert tuple(stats) == (7, 2, 2, 1)


def test_dedupe_first_with_short_rows_anywhere(spark):
    rng = random.Random(3)
    rows = [(f"d{rng.randrange(25)}", ("x" * 40 if rng.random() < p else "short") + str(i), rng.choice("abcd"), i, "t") for p in (0.2, 0.9) for i in rng.sample(range(1000), 60)]
    rows = [(*r[:3], i, r[4]) for i, r in enumerate(rows)]
    want = {}
    for doc, context, split, _, _ in rows:
        if doc in want:
            want[doc][1] += 1
            want[doc][2].add(split)
        elif len(context) >= 40:
            want[doc] = [context, 1, {split}]
    df = spark.createDataFrame(rows, "document_id string, context string, split string, ord int, document_topic string")
    got = {r.document_id: [r.context, r.n_source_rows, set(r.splits)] for r in dedupe.dedupe_first(df).collect()}
    assert got == want and len(want) > 15
    assert dedupe.dedupe_first(df.limit(0)).count() == 0


def test_dedupe_longest_ties(spark):
    rows = [("s", "y" * 40, 1), ("s", "z" * 41, 3), ("s", "w" * 41, 2), ("t", "q" * 39, 4)]
    df = spark.createDataFrame(rows, "section_id string, context string, ord int").withColumn("source", F.lit("src"))
    assert [r.text for r in dedupe.dedupe_longest(df).collect()] == ["w" * 41 + "\n"]


def test_rows_of_unlisted_corpora_stay_without_a_split(spark):
    rows = [(c, f"{c}{i}", f"{c}{i}::0") for c in ("en", "xx", None) for i in range(20)]
    df = spark.createDataFrame(rows, "corpus string, document_id string, chunk_id string")
    got = [(r.corpus, r.split, r.ood_test) for r in splitting.split_corpora(df, ["en", "de"], ood_corpus="en").collect()]
    assert len(got) == 60 and {s for c, s, _ in got if c == "en"} == {"train", "val"}
    assert {x for x in got if x[0] != "en"} == {("xx", None, False), (None, None, False)}


def test_passage_corpus(spark, tmp_path):
    rows = [(f"s{i % 30:02d}", f"{'x' * 40}{'y' * (i // 30)}", i, None if i % 2 else "src") for i in range(90)]
    rows += [(None, "z" * 50, 90, None), (" ", "z" * 50, 91, "other"), ("s01", "short", 92, None), ("s02", None, 93, None)]
    df = spark.createDataFrame(rows, "section_id string, context string, ord int, source string")
    digest = f"qa_{hashlib.sha256(b'z' * 50).hexdigest()[:16]}"
    whole = {r.section_id: r for r in passages.passage_corpus(df).collect()}
    assert set(whole) == {*(f"s{i:02d}" for i in range(30)), digest} and {r.split for r in whole.values()} == {"train"}
    assert whole["s05"].text == "x" * 40 + "yy\n" and whole["s05"].char_count == 42 and whole["s05"].source == "qa" and whole["s04"].source == "src"
    assert all(r.document_id == r.section_id for r in whole.values())
    monitored = passages.passage_corpus(df, monitor_ratio=0.1)
    by_hash = sorted(whole, key=lambda k: hashlib.sha256(f"42:{k}".encode()).hexdigest())
    assert {r.section_id for r in monitored.collect() if r.split == "val"} == set(by_hash[:3])
    first = {r.section_id for r in passages.passage_corpus(df, max_passages=7).collect()}
    assert first == set(sorted(whole)[:7])
    assert tuple(passages.corpus_manifest(df, monitored).first()) == (94, 1, 1, 31, 61, 31, 28, 3)
    passages.write_corpus(monitored, str(tmp_path))
    counts = [spark.read.json(f"{tmp_path}/passages_{n}.jsonl").count() for n in ("full", "train", "val")]
    assert counts == [31, 28, 3]
    assert passages.passage_corpus(df.limit(0), monitor_ratio=0.1, max_passages=3).count() == 0
    one = passages.passage_corpus(df.filter("section_id = 's01'"), monitor_ratio=0.9).collect()
    assert [r.split for r in one] == ["train"]
