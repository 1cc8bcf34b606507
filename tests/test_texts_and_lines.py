"""Line numbers of bad lines over splits, joined texts over ranges, coverage by embeddings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from qassay import schemas
from qassay.operators import coverage
from qassay.sources import jsonl


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_line_numbers_of_files_in_many_splits(spark, tmp_path, small_splits):
    want = set()
    for name in ("a", "b", "empty"):
        lines = [] if name == "empty" else ["" if i % 9 == 4 else '{"x": cut' if i % 13 == 0 else '{"x": "é' + "y" * (i % 60) + '"}' for i in range(400)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines), encoding="utf-8")
        want |= {(f"{name}.jsonl", i + 1, x) for i, x in enumerate(lines) if x.endswith("cut")}
    got = jsonl.bad_lines(spark, str(tmp_path), schemas.struct_type("x string"))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    assert {(r.file.rsplit("/", 1)[1], r.line, r.text) for r in got.collect()} == want and got.count() == len(want)


@pytest.mark.parametrize("part_chars", [1 << 20, 5])
def test_joined_texts_of_a_hot_key(spark, part_chars):
    rows = [("hot", i, f"t{i}") for i in range(500)] + [(f"k{i % 40}", i, None if i % 7 == 0 else "é" * (i % 5)) for i in range(200)] + [(None, 3, "b"), (None, 1, "a")]
    df = spark.createDataFrame(rows, "k string, ord long, text string").repartition(6)
    got = {r.k: r.text for r in coverage.joined_texts(df, "k", "text", part_chars=part_chars).collect()}
    want = {}
    for k, _, t in sorted(rows, key=lambda r: r[1]):
        want.setdefault(k, []).append(t or "")
    assert got == {k: " ".join(v) for k, v in want.items()}
    assert coverage.joined_texts(df.limit(0), "k", "text").count() == 0


def test_coverage_by_embedding(spark):
    rng = np.random.default_rng(2)
    windows = [(d, w, rng.normal(size=4).tolist()) for d in range(4) for w in range(5)]
    qa = [(d, rng.normal(size=4).tolist()) for d in range(3) for _ in range(6)] + [(0, None), (0, [1.0])]
    w = spark.createDataFrame(windows, "document_id long, window long, embedding array<double>")
    q = spark.createDataFrame(qa, "document_id long, embedding array<double>")
    cosines = coverage.window_cosines(w, q, 4, threshold=0.1)
    got = {r.document_id: r for r in coverage.coverage_by_embedding(cosines).collect()}
    every = []
    for d in range(4):
        vectors = [v for i, v in qa if i == d and v and len(v) == 4]
        mean = np.mean(vectors, axis=0) if vectors else None
        own = [np.dot(v, mean) / np.linalg.norm(v) / np.linalg.norm(mean) for i, _, v in windows if i == d] if vectors else [None] * 5
        every += [c for c in own if c is not None]
        assert got[d].hits == [c is not None and bool(c >= 0.1) for c in own]
        assert got[d].mean_cosine == (None if mean is None else pytest.approx(np.mean(own), abs=1e-4))
    answers = spark.createDataFrame([("0", None, "q", "a", "drop"), ("0", None, "q", "a", "high")], "document_id string, chunk_id string, question string, answer string, quality_tier string")
    row = coverage.embedding_summary(cosines, answers, ("drop",)).first()
    assert (row.n_documents, row.n_qa_rows, row.n_qa_rows_excluded) == (4, 1, 1)
    assert row.median_window_cosine == pytest.approx(np.median(every), abs=1e-4) and row.mean_window_cosine == pytest.approx(np.mean(every), abs=1e-4)
    assert coverage.window_cosines(w, q.filter(F.lit(False)), 4).filter("hit OR cosine IS NOT NULL").count() == 0
