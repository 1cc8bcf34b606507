"""Costs by kind and tier, cosines of scored rows, conditions found in the results."""

from qassay.operators import costs, listwise, scoring


def test_condition_costs_keep_training_and_merging_apart(spark):
    spans = spark.createDataFrame([("a", 10.0), ("a", 2.5), ("b", 1.5), ("m", 0.25), ("unused", 9.0)], "step string, duration_s double")
    parts = spark.createDataFrame(
        [("x", "train", "a", 0), ("x", "merge", "m", 1), ("y", "train", "a", 1), ("y", "train", "b", 0), ("z", "train", "never", 0)],
        "condition string, kind string, step string, pos int",
    )
    got = {r.condition: tuple(r)[1:] for r in costs.condition_costs(spans, parts).collect()}
    assert got == {
        "x": (12.5, 0.25, 12.75, 1, 12.5, "train a (12s); merge m (0s)"),
        "y": (14.0, None, 14.0, 1, 12.5, "train b (2s); train a (12s)"),
        "z": (None, None, 0.0, 0, 0.0, "train never (0s)"),
    }
    assert costs.condition_costs(spans, parts.limit(0)).count() == 0


def test_tier_costs(spark):
    rows = [
        ("m1", "single", None, 90.0, 2_500_000_000), ("m1", "tiered", "high", 20.0, 40_000_000), ("m1", "tiered", "merge", 10.0, None),
        ("m2", "single", None, 5.0, None), ("m3", "tiered", "low", 3700.0, 1_000_000),
    ]
    runs = spark.createDataFrame(rows, "model string, arm string, tier string, wall_s double, adapter_bytes long")
    got = {r.model: r for r in costs.tier_costs(runs, ["model"], "single", "tiered").collect()}
    assert (got["m1"].high_s, got["m1"].medium_s, got["m1"].merge_s, got["m1"].tiered_s, got["m1"].tiered_time) == (20.0, None, 10.0, 30.0, "30s")
    assert (got["m1"].baseline_size, got["m1"].tiered_size, got["m1"].speedup) == ("2.50 GB", "40 MB", "3.0×")
    assert (got["m2"].tiered_s, got["m2"].tiered_time, got["m2"].baseline_size, got["m2"].speedup) == (None, "—", "—", "—")
    assert (got["m3"].tiered_time, got["m3"].speedup) == ("1h 01m", "—")


def test_cosines_of_valid_predictions_in_summaries_and_slices(spark):
    preds = spark.createDataFrame(
        [("q1", "a", "yes", "yes"), ("q1", "b", "nan", "yes"), ("q2", "a", "no", "yes"), ("q2", "b", "yes", "yes")], "eval_id string, condition string, pred string, gold string"
    )
    cosines = spark.createDataFrame([("q1", "a", 0.5), ("q1", "b", 0.9), ("q2", "a", 0.25)], "eval_id string, condition string, cosine double")
    measured = scoring.add_cosines(scoring.score_predictions(preds), cosines)
    assert {(r.eval_id, r.condition): r.pred_gold_cosine for r in measured.collect()} == {("q1", "a"): 0.5, ("q1", "b"): None, ("q2", "a"): 0.25, ("q2", "b"): None}
    assert {r.condition: r.pred_gold_cosine_mean for r in scoring.score_summary(measured).collect()} == {"a": 0.375, "b": None}
    ranks = "eval_id string, error string, ranks_by_condition map<string,double>, points_by_condition map<string,double>"
    results = spark.createDataFrame(
        [("q1", None, {"a": 1.0, "b": 2.0}, {"a": 2.0, "b": 1.0}), ("q2", None, {"a": 1.0}, {"a": 1.0}), ("q3", "parse_error", {"c": 1.0}, {"c": 1.0})], ranks
    )
    classified = spark.createDataFrame([("q1", "s"), ("q2", "s"), ("q3", "s")], "eval_id string, topic string")
    got = {r.condition: r for r in listwise.slice_metrics(classified, results, measured, ["topic"], "b").collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].n_questions, got["a"].mean_pred_gold_cosine, got["a"].wins, got["a"].win_rate) == (2, 0.375, 1, 1.0)
    assert (got["b"].mean_points, got["b"].mean_pred_gold_cosine, got["b"].win_rate) == (1.0, None, None)
