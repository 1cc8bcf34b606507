"""Resampled order statistics against plain resampling of rows."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from qassay.operators import judged, listwise, order_bootstrap, splitting


def plain(values, q, n_boot=20_000):
    rng = np.random.default_rng(1)
    drawn = np.array([np.quantile(rng.choice(values, len(values)), q) for _ in range(n_boot)])
    return np.quantile(drawn, [0.025, 0.975])


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_quantiles_against_plain_resampling(spark, q):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(10, 3, 61), "b": rng.integers(0, 5, 40).astype(float), None: np.array([2.0, 7.0]), "one": np.array([4.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in order_bootstrap.bootstrap_quantile(df, "v", ["g"], q=q, n_boot=20_000).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g].n == len(vs) and got[g].point == pytest.approx(np.quantile(vs, q), abs=1e-4)
        low, high = plain(vs, q)
        step = np.ptp(vs) / max(1, len(vs) - 1) + 1e-4
        assert abs(got[g].ci_low - low) <= step and abs(got[g].ci_high - high) <= step


def test_many_chunks_and_hot_values_give_the_same_law(spark, monkeypatch):
    monkeypatch.setattr(order_bootstrap, "CHUNK_BITS", 4)
    values = np.concatenate([np.arange(3000) / 7, np.full(1500, 100.0)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(9)
    got = order_bootstrap.bootstrap_median(df, "v", n_boot=5000).first()
    low, high = plain(values, 0.5, 5000)
    assert got.n == 4500 and got.point == pytest.approx(np.median(values), abs=1e-4)
    assert abs(got.ci_low - low) < 2 and abs(got.ci_high - high) < 2
    again = order_bootstrap.bootstrap_median(df.repartition(2), "v", n_boot=5000).first()
    assert (again.ci_low, again.ci_high) == (got.ci_low, got.ci_high)


def test_no_rows_and_paired(spark):
    assert order_bootstrap.bootstrap_median(spark.createDataFrame([], "v double"), "v").count() == 0
    rows = [(str(i), c, float(i % 5 + (c == "x"))) for i in range(50) for c in "xy"]
    pairs = spark.createDataFrame([("x", "y")], "challenger string, baseline string")
    got = order_bootstrap.bootstrap_quantile_paired(spark.createDataFrame(rows, "eval_id string, condition string, s double"), pairs, "s").first()
    assert (got.n, got.point, got.ci_low, got.ci_high, got.excludes_zero) == (50, 1.0, 1.0, 1.0, True)


def test_a_ceiling_that_is_no_arm_fails(spark):
    table = spark.createDataFrame([("a", 1.0), ("B3_lora_all", 2.0), ("top", 3.0)], "condition string, mean_gold_alignment double")
    with pytest.raises(PySparkException, match="no arm missing"):
        judged.ceiling_gap(table, "missing", "a").collect()
    got = {r.condition: r.recovery_vs_baseline for r in judged.ceiling_gap(table, "top").collect()}
    assert got == {"a": -1.0, "B3_lora_all": 0.0}
    assert {r.recovery_vs_baseline for r in judged.ceiling_gap(table, "top", "unknown").collect()} == {None}


RANKED = "eval_id string, ord long, error string, ranks_by_condition map<string,double>, points_by_condition map<string,double>"


def test_a_question_ranked_twice_counts_once(spark):
    first = [("q", 1, None, {"a": 1.0, "b": 2.0}, {"a": 2.0, "b": 1.0}), ("q", 2, None, {"a": 2.0, "b": 1.0}, {"a": 1.0, "b": 2.0}), ("q", 3, "parse_error", None, None)]
    second = [("q", 1, None, {"a": 1.0, "b": 2.0}, {"a": 2.0, "b": 1.0})] * 2
    got = listwise.swap_merge_ranks(spark.createDataFrame(first, RANKED), spark.createDataFrame(second, RANKED)).collect()
    assert sorted((r.condition, r.mean_rank, r.mean_points) for r in got) == [("a", 1.5, 1.5), ("b", 1.5, 1.5)]


def test_failed_rankings_have_no_rank(spark):
    rows = [(f"q{i}", i, "parse_error" if i % 2 else None, {"a": 1.0, "b": 2.0}, None) for i in range(8)]
    got = splitting.balanced_sample(spark.createDataFrame(rows, RANKED), 8, "a", "b").groupBy("bucket").agg(F.count("*").alias("n")).collect()
    assert {r.bucket: r.n for r in got} == {"challenger_wins": 4, "no_rank": 4}
