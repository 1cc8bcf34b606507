import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from qassay import schemas
from qassay.operators import agreement, bootstrap, categories, coverage, enrich, judged, listwise, mining, normalize, requests, responses, scoring
from qassay.sources import discovery, jsonl, markdown, shards
from qassay.streaming.spans import start_span_rollup


def test_parse_json_takes_exactly_one_value(column):
    good = ['{"a": 1}', " [1, {}] ", '{"a": "} ]"}', '"x"', '{"a": "\\"q\\" , {"}']
    bad = ['{"a": 1} tail', '{"a": 1}{"b": 2}', '{"a": 1}, {"b": 2}', '{"a": 1}]', '{"a": 1}}', "", "x", '1, "b": 2']
    got = column(good + bad, responses.parse_json(F.col("x")).isNotNull())
    assert got == [True] * len(good) + [False] * len(bad)


def test_qa_pairs(spark):
    q = '{"question": "Q", "answer": "A"}'
    cases = [
        (q, 1, [("Q", "A")]), (f"```json\n{q}\n```", 1, [("Q", "A")]), (f"[{q}, {q}, 3]", 1, [("Q", "A")]), (f"[{q}, {q}]", 5, [("Q", "A")] * 2),
        ('{"pairs": [' + q + ', {"question": " ", "answer": "x"}]}', 2, [("Q", "A")]), ("Well: " + q + " ok", 1, [("Q", "A")]),
        ('x {"question": "a \\"b\\"", "answer": "c"} y {"question": "d", "answer": "e"', 2, [('a "b"', "c")]), ("nothing", 1, []),
        ('{"question": "Q"}', 1, []), ("3", 1, []),
    ]
    df = spark.createDataFrame([(i, raw, n) for i, (raw, n, _) in enumerate(cases)], "i int, raw string, expected int")
    got = df.orderBy("i").select(responses.qa_pairs(F.col("raw"), F.col("expected")).alias("p")).collect()
    assert [[tuple(p) for p in r.p] for r in got] == [want for _, _, want in cases]


def test_many_escapes_do_not_blow_up(spark):
    raw = '{"question": "' + "a\\n" * 3000 + '", "answer": "' + "\\" * 2
    df = spark.createDataFrame([(raw, 1)], "raw string, expected int")
    assert df.select(F.size(responses.qa_pairs(F.col("raw"), F.col("expected")))).first()[0] == 0


def test_enrich_prefers_own_values_and_survives_blank_keys(spark):
    rows = spark.createDataFrame(
        [("1", " ", None), ("2", "own", "g"), (" ", " ", None), ("9", " ", None)], "eval_id string, context string, gold string"
    )
    index = spark.createDataFrame(
        [("1", "old", "", "a1", 1), ("1", "ctx", "", "a2", 2), ("2", "ctx2", "gg", "a3", 3)],
        "eval_id string, context string, gold string, answer string, ord int",
    )
    out = {r.eval_id: r for r in enrich.enrich_context(rows, enrich.eval_index(index)).collect()}
    assert (out["1"].context, out["1"].gold, out["1"].context_filled) == ("ctx", "a2", True)
    assert (out["2"].context, out["2"].gold, out["2"].context_filled) == ("own", "g", False)
    assert len(out) == 4 and not out["9"].context_filled


def test_align_arms_last_row_wins(spark):
    rows = spark.createDataFrame([("1", "a", 1.0, 1), ("1", "a", 2.0, 2), ("1", "b", 3.0, 1), ("2", "b", 4.0, 1)], "eval_id string, condition string, v double, ord int")
    wide = enrich.align_arms(rows, ["a", "b"], ["v"], order="ord").orderBy("eval_id").collect()
    assert [(r.a.v if r.a else None, r.b.v) for r in wide] == [(2.0, 3.0), (None, 4.0)]
    assert [r.eval_id for r in enrich.complete_keys(rows, ["a", "b"]).collect()] == ["1"]


def test_swap_merge_uses_the_pass_that_worked(spark):
    block = "grounding:double,relevance:double,gold_alignment:double,document_necessity:double,overall:double,refuse_expected:boolean,brief_reason:string,quality_tier:string,prompt_version:string,error:string"
    ok = (4.0, 4.0, 2.0, 5.0, 4.0, False, "a", "high", "v", None)
    half = (5.0, 4.0, 3.0, 5.0, 5.0, True, " b", "high", "v", None)
    bad = (None,) * 9 + ("parse_error",)
    rows = [("1", "gold_first", ok), ("1", "pred_first", half), ("2", "gold_first", bad), ("2", "pred_first", half), ("3", "gold_first", ok)]
    df = spark.createDataFrame(rows, f"eval_id string, presentation string, llm_judge struct<{block}>").withColumn("answer", F.lit("x")).withColumn("ord", F.lit(1))
    out = {r.eval_id: r for r in enrich.swap_merge_scores(df).collect()}
    one = out["1"].llm_judge
    assert (one.grounding, one.gold_alignment, one.refuse_expected, one.brief_reason, one.quality_tier) == (4.5, 2.5, True, "a | b", "high")
    assert out["2"].llm_judge.grounding == 5.0 and not out["2"].debiased
    assert out["3"].llm_judge.grounding == 4.0


def test_listwise_labels_are_a_permutation(spark):
    questions = spark.createDataFrame([(str(i), "q", "c", "g") for i in range(20)], "eval_id string, question string, context string, gold string")
    preds = spark.createDataFrame(
        [(str(i), c, "nan" if (i == 0 and c == "b") else f"{c}{i}") for i in range(20) for c in "abc"], "eval_id string, condition string, pred string"
    ).withColumn("ord", F.lit(1))
    tasks = listwise.listwise_tasks(questions, preds, ["c", "a", "b"])
    assert tasks.count() == 19
    for r in listwise.listwise_labels(tasks).collect():
        assert sorted(r.label_to_condition.values()) == ["a", "b", "c"]
        assert [p[0] for p in r.label_preds] == [r.label_to_condition[x] for x in r.labels]
    fixed = listwise.listwise_labels(tasks, fixed_order=["c", "b", "a"]).first()
    assert fixed.label_to_condition == {"A": "c", "B": "b", "C": "a"}


def test_win_rate_counts_add_up(spark):
    df = spark.createDataFrame(
        [("1", {"x": 1.0, "y": 2.0}, None), ("2", {"x": 1.5, "y": 1.5}, None), ("3", {"x": 2.0}, None), ("4", {"x": 2.0, "y": 1.0}, "e")],
        "eval_id string, ranks_by_condition map<string,double>, error string",
    )
    r = listwise.win_rate(df, "y").first()
    assert (r.n, r.wins, r.losses, r.ties, r.win_rate) == (2, 1, 0, 1, 0.5)


def test_bootstrap_against_normal_approximation(spark):
    rng = np.random.default_rng(3)
    values = [(("a" if i % 3 else None), float(v)) for i, v in enumerate(rng.integers(1, 6, 600))]
    df = spark.createDataFrame([*values, ("a", None)], "g string, v double")
    got = {r.g: r for r in bootstrap.bootstrap_mean(df, "v", ["g"], n_boot=2000).collect()}
    for g in ("a", None):
        x, r = np.array([v for k, v in values if k == g]), got[g]
        half = 1.96 * x.std() / np.sqrt(len(x))
        assert r.n == len(x) and abs(r.point - x.mean()) < 1e-4
        assert abs((r.ci_high - r.ci_low) / 2 - half) < 0.15 * half
        assert r.excludes_zero
    constant = bootstrap.bootstrap_mean(df.withColumn("v", F.lit(0.0)), "v", n_boot=20).first()
    assert (constant.ci_low, constant.ci_high, constant.excludes_zero) == (0.0, 0.0, False)


def test_bootstrap_of_continuous_values_over_several_chunks(spark):
    df = spark.range(20_000).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003).alias("v"))
    x = np.array([r.v for r in df.collect()])
    half = 1.96 * x.std() / np.sqrt(len(x))
    r = bootstrap.bootstrap_mean(df, "v", n_boot=600).first()
    assert r.n == 20_000 and abs(r.point - x.mean()) < 1e-4 and abs((r.ci_high - r.ci_low) / 2 - half) < 0.2 * half
    std = bootstrap.bootstrap_statistic(df, "v", n_boot=100, statistic=bootstrap.STD).first()
    assert abs(std.point - x.std()) < 1e-4 and std.ci_low < x.std() < std.ci_high


def test_bootstrap_of_some_values_does_not_depend_on_partitions_or_other_groups(spark):
    df = spark.range(120_000).select((F.col("id") % 7).cast("double").alias("v"), F.lit("a").alias("g"))
    more = df.unionByName(spark.range(50).select(F.col("id").cast("double").alias("v"), F.lit("b").alias("g"))).repartition(13)
    one = bootstrap.bootstrap_mean(df, "v", ["g"], n_boot=300).first()
    assert one == bootstrap.bootstrap_mean(more, "v", ["g"], n_boot=300).filter("g = 'a'").first()
    smaller = bootstrap.bootstrap_mean(df.filter("v < 5 or rand(1) < 0.2"), "v", ["g"], n_boot=300).first()
    assert smaller.n < 100_000 < one.n and abs(smaller.ci_high - smaller.ci_low) < 2 * (one.ci_high - one.ci_low)


def test_agreement_degenerate_cases(spark):
    same = spark.createDataFrame([("h", "h")] * 4, "a string, b string")
    assert agreement.cohen_kappa(same, "a", "b").first().kappa == 1.0
    nums = spark.createDataFrame([(1, 2), (2, 2), (2, 3), (4, 9)], "a int, b int")
    # Ranks 1, 2.5, 2.5, 4 and 1.5, 1.5, 3, 4: 3.75 / 4.5.
    assert agreement.spearman(nums, "a", "b").first().spearman == 0.833333
    assert agreement.spearman(nums.withColumn("b", F.lit(1)), "a", "b").first().spearman is None


def test_spearman_against_ranks(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 6, 200), rng.integers(0, 4, 200)

    def ranks(x):
        return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])

    want = np.corrcoef(ranks(a), ranks(b))[0, 1]
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a int, b int")
    assert abs(agreement.spearman(df, "a", "b").first().spearman - want) < 1e-6
    # Continuous scores, one value that holds a third of all rows, and nulls that do not count.
    a = np.where(rng.random(1500) < 0.33, 0.25, rng.random(1500))
    b = a + rng.random(1500)
    want = np.corrcoef(ranks(a), ranks(b))[0, 1]
    df = spark.createDataFrame([*zip(a.tolist(), b.tolist()), (None, 1.0), (1.0, None)], "a double, b double")
    got = agreement.spearman(df, "a", "b").first()
    assert got.n == 1500 and abs(got.spearman - want) < 1e-6
    assert tuple(agreement.spearman(df.limit(0), "a", "b").first()) == (None, None)


def test_label_shares_with_many_equal_counts(spark):
    labels = ["a"] * 5 + ["b"] * 3 + ["c"] * 3 + [f"once{i:03d}" for i in range(300)]
    rows = spark.createDataFrame([((t,), x) for t in ("high", "low") for x in (labels if t == "high" else labels[:8])], "llm_judge struct<quality_tier: string>, x string")
    for n in (1, 2, 3, 7):
        got = judged.label_shares(rows, F.col("x"), n).collect()
        for tier, own in (("high", labels), ("low", labels[:8])):
            best = sorted(Counter(own).items(), key=lambda p: (-p[1], p[0]))[:n]
            assert sorted((r["rank"], r.label, r.n_rows, r.pct) for r in got if r.tier == tier) == [
                (i + 1, x, c, round(100 * c / len(own), 1)) for i, (x, c) in enumerate(best)
            ]


def test_index_scan_reads_once(spark, tmp_path):
    odd = tmp_path / "a b+c%20"
    odd.mkdir()
    (odd / "one.jsonl").write_text('{"v": 1}\n{"v": 2}\n')
    folder = tmp_path / "two"
    folder.mkdir()
    for i in (3, 4):
        (folder / f"part-{i}.json").write_text(f'{{"v": {i}}}\n')
    paths = {"x": f"{odd}/one.jsonl", "again": f"file:{odd}/one.jsonl", "y": str(folder), "z": f"{folder}/part-4.json", "gone": None}
    index = tmp_path / "index.json"
    index.write_text(json.dumps({"conditions": {k: {"predictions_jsonl": p} for k, p in paths.items()}}))
    rows = discovery.scan_index(spark, str(index), "v bigint")
    assert sorted((r.condition, r.v) for r in rows.collect()) == [("again", 1), ("again", 2), ("x", 1), ("x", 2), ("y", 3), ("y", 4), ("z", 4)]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count(" json") == 1
    assert rows.columns == ["v", "condition"]


def test_coverage_against_sets(spark):
    import re

    words = [f"w{i}" for i in range(43)]
    docs = [("d", " ".join(words)), ("e", " ".join(words[:39])), ("f", " ".join(words))]
    qa = [("d", f"w{i} w{i + 20}", "W1!", "high" if i % 2 else "low") for i in range(6)] + [("f", "w1", "w2", "drop")]
    d = spark.createDataFrame(docs, "document_id string, context string")
    q = spark.createDataFrame(qa, "document_id string, question string, answer string, quality_tier string").withColumn("chunk_id", F.lit(""))
    got = {(r.document_id, r.window): r for r in coverage.window_hits(d, q).collect()}
    tokens = set(re.findall("[a-z0-9]+", " ".join(f"{x} {a}".lower() for k, x, a, _ in qa if k == "d")))
    for i in range(5):
        w = set(words[i * 8 : 43 if i == 4 else (i + 1) * 8])
        assert abs(got["d", i].overlap - len(w & tokens) / len(w)) < 1e-6
        assert got["f", i].overlap == 0.0 and not got["f", i].hit
    assert ("e", 0) not in got
    # A document with many question tokens is compared with several sets.
    for n in (1, 4):
        assert {(r.document_id, r.window): r for r in coverage.window_hits(d, q, set_tokens=n).collect()} == got
    plan = coverage.window_hits(d, q)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\([^)]*token", plan)
    per = {r.document_id: r for r in coverage.coverage_per_doc(coverage.window_hits(d, q), q, exclude_tiers=("drop",)).collect()}
    assert per["d"].majority_tier == "high" and per["f"].majority_tier == "none"


def test_long_and_short_f1_agree(spark):
    rows = spark.createDataFrame([("1", "a a b", "a b b"), ("2", "", ""), ("3", "x", ""), ("4", "nan", "nan"), ("5", "q", "z")], "id string, pred string, gold string")
    short = {r.id: r.token_f1 for r in scoring.score_predictions(rows).collect()}
    long = {r.id: r.token_f1 for r in scoring.score_long_predictions(rows, ["id"]).collect()}
    assert short == long


def test_fill_does_not_expand_slot_text(spark):
    df = spark.createDataFrame([("{b}", "x")], "a string, b string")
    assert df.select(requests.fill("1{a}2{b}3{c}", a=F.col("a"), b=F.col("b"))).first()[0] == "1{b}2x3{c}"


def test_request_ids_are_unique(spark):
    df = spark.createDataFrame([("a b", 1), ("a/b", 2), ("__", 3), ("x" * 80, 4), ("x" * 80, 5)], "chunk_id string, ord int")
    ids = [r.request_id for r in requests.request_ids(df).orderBy("ord").collect()]
    assert ids == ["a_b", "a_b_1", "row_2", "x" * 64, "x" * 54 + "_4"]


def test_request_ids_of_plain_ids_that_look_suffixed(spark):
    def ids(*raw):
        df = spark.createDataFrame([(r, i) for i, r in enumerate(raw)], "chunk_id string, ord int")
        return [r.request_id for r in requests.request_ids(df).orderBy("ord").collect()]

    assert ids("x", "x", "x_1") == ["x", "x_1", "x_1_2"]
    assert ids("x", "x_2", "x") == ["x", "x_2_1", "x_2"]
    assert ids("x", "y", "y_1") == ["x", "y", "y_1"]
    assert ids("x", "x", "x_1", "x_1_2") == ["x", "x_1", "x_1_2", "x_1_2_3"]
    df = spark.createDataFrame([(None, "d", 0), ("", None, 1)], "chunk_id string, document_id string, ord int")
    out = requests.request_ids(df, fallback="document_id").orderBy("ord").collect()
    assert [r.request_id for r in out] == ["d", "row_1"]


def test_upsert_takes_the_last_whole_row(spark):
    main = spark.createDataFrame([("1", 1.0, "low", "m"), ("2", 3.0, "high", "m")], "eval_id string, gold_alignment double, tier string, own string")
    redone = spark.createDataFrame([("1", 5.0, "high", 2), ("1", 2.0, "drop", 1)], "eval_id string, gold_alignment double, tier string, ord int")
    out = [tuple(r) for r in enrich.rejudge_upsert(main, redone).orderBy("eval_id").collect()]
    assert out == [("1", 5.0, "high", "m", True), ("2", 3.0, "high", "m", False)]
    assert [tuple(r)[:2] for r in enrich.rejudge_upsert(main, redone, min_delta=9.0).orderBy("eval_id").collect()] == [("1", 1.0), ("2", 3.0)]
    assert judged.rejudge_compare(main, redone).first().n_compared == 1


def test_cases_get_the_whole_context_back(spark):
    fields = "model string, dataset string, eval_id string, condition string, context string, ord int"
    rows = spark.createDataFrame([("m", "d", "1", "a", "old", 1), ("m", "d", "1", "a", "x" * 2000, 2), ("m", "d", "1", "b", "other", 1), ("m", "d", "2", "a", "y", 1)], fields)
    cases = spark.createDataFrame([("m", "d", "1", "refusal")], "model string, dataset string, eval_id string, pattern string")
    out = mining.with_context(cases, rows, ["a", "b"]).collect()
    assert [(r.eval_id, len(r.context)) for r in out] == [("1", 2000)]


def test_normalisers(spark):
    df = spark.createDataFrame(
        [("1", "t", " c ", "q", ([" a ", ""],), "s"), ("2", "t", "c", "q", ([],), "s"), ("3", "t", " ", "q", (["a"],), "s"), ("4", "", "c", "q", None, "s")],
        "id string, title string, context string, question string, answers struct<text:array<string>>, split string",
    )
    out = {r.eval_id: r for r in normalize.normalize_multi_answer(df, "k").collect()}
    assert set(out) == {"1", "2"} and out["2"].unanswerable and out["1"].answers[0].text == "a"
    assert [r.eval_id for r in normalize.normalize_multi_answer(df, "k", require_answer=True).collect()] == ["1"]


def test_jsonl_modes(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1, "b": "u v"}\n\n  \n{"a": 2\n{"a": 3}\n', encoding="utf-8")
    schema = schemas.struct_type("a int, b string")
    rows = jsonl.read_jsonl_tolerant(spark, str(path), schema).collect()
    assert [(r.a, r._bad_line is not None) for r in rows if r._bad_line is None] == [(1, False), (3, False)]
    assert sum(r._bad_line is not None for r in rows) == 1
    assert jsonl.read_jsonl_tolerant(spark, str(path), schema, skip=True).count() == 2
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, str(path), schema).collect()


def test_markdown_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# T\nx\xff")
    (tmp_path / "b b.markdown").write_text("two", encoding="utf-8")
    (tmp_path / "c.txt").write_text("no", encoding="utf-8")
    rows = {r.source: r.md for r in markdown.scan_markdown(spark, str(tmp_path)).collect()}
    assert rows == {"a": "# T\nx�", "b b": "two"}


def test_shard_gap_is_an_error(spark, tmp_path):
    rows = spark.createDataFrame([(1, "shard000000_000002"), (2, "shard000003_000004")], "a int, shard string")
    shards.write_shards(rows, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="expected start 2, got 3"):
        shards.merge_shards(spark, str(tmp_path / "s"), "a int")
    assert shards.is_sharded_run(0, 5, 9) and not shards.is_sharded_run(0, 9, 9)


def test_missing_condition_is_an_error(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "condition string")
    with pytest.raises(ValueError, match="zz"):
        discovery.filter_conditions(rows, ["a", "zz"])


def test_stream_equals_batch(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "step string, duration_s double"
    spark.createDataFrame([("a", 1.0), ("b", 2.0)], schema).write.json(source)
    start_span_rollup(spark.readStream.schema(schema).json(source), out, state).awaitTermination()
    spark.createDataFrame([("a", 4.5)], schema).write.mode("append").json(source)
    start_span_rollup(spark.readStream.schema(schema).json(source), out, state).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == [("a", 2, 5.5, 4.5), ("b", 1, 2.0, 2.0)]


def test_tier_weights_presets(spark):
    from qassay.operators import judged

    rows = spark.createDataFrame([("high",), ("high",), ("low",), ("drop",), (None,)], "t string").select(F.struct(F.col("t").alias("quality_tier")).alias("llm_judge"))
    assert {r.tier: r.weight for r in judged.tier_weights(rows).collect()} == {"high": 0.666667, "low": 0.333333}
    assert {r.tier: r.weight for r in judged.tier_weights(rows, "tier").collect()} == {"high": 0.6, "low": 0.1}
    with pytest.raises(ValueError):
        judged.tier_weights(rows, "other")


def test_ceiling_gap_degenerate(spark):
    from qassay.operators import judged

    table = spark.createDataFrame([("REF_a", 4.0), ("base", 4.0), ("cand", 3.0), ("REF_b", 5.0), ("none", None)], "condition string, mean_gold_alignment double")
    got = {r.condition: (r.gap_to_ceiling, r.recovery_vs_baseline) for r in judged.ceiling_gap(table, "REF_a", "base").collect()}
    assert got == {"base": (0.0, None), "cand": (1.0, None), "none": (None, None)}
    got = {r.condition: r.recovery_vs_baseline for r in judged.ceiling_gap(table, "REF_b", "cand").collect()}
    assert got == {"base": 0.5, "cand": 0.0, "none": None}


def test_slice_metrics_leaves_out_failed_rankings(spark):
    from qassay.operators.listwise import slice_metrics

    results = spark.createDataFrame(
        [("q1", {"a": 2.0}, {"a": 1.0}, None), ("q2", None, None, "parse_error")],
        "eval_id string, points_by_condition map<string,double>, ranks_by_condition map<string,double>, error string",
    )
    classified = spark.createDataFrame([("q1", "t"), ("q2", "t")], "eval_id string, topic string")
    scored = spark.createDataFrame([("q1", "a", 1.0, 1.0), ("q2", "a", 0.0, 0.0)], "eval_id string, condition string, token_f1 double, exact_match double")
    got = slice_metrics(classified, results, scored, ["topic"], "b", ["a"]).first()
    assert (got.n_questions, got.mean_token_f1) == (1, 1.0)


def test_timing_stats_ignores_missing_values(spark):
    from qassay.operators.resources import timing_stats

    rows = [("s", float(i)) for i in range(1, 11)] + [("s", None)] * 10 + [("none", None)]
    got = {r.step: r for r in timing_stats(spark.createDataFrame(rows, "step string, duration_s double")).collect()}
    assert (got["s"].p50_s, got["s"].p90_s, got["none"].n, got["none"].p50_s) == (5.0, 9.0, 0, None)


def test_listwise_answer_inside_a_list_is_no_ranking(spark):
    from qassay.operators.responses import parse_listwise

    rows = [({"A": "x", "B": "y"}, '[{"ranking": ["A", "B"]}]'), ({"A": "x", "B": "y"}, 'so {"ranking": ["A", "B"]} it is')]
    got = parse_listwise(spark.createDataFrame(rows, "label_to_condition map<string,string>, raw string")).collect()
    assert [r.error for r in got] == ["parse_error", None]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from qassay.session import ensure_checkpoint_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="local-cluster[2,1,1024]")
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


def test_gold_texts(spark):
    rows = [(["a ", " ", "b"], "g", "x"), ([" "], "g ", "x"), ([], "", " x"), (None, None, "x"), (None, "  ", "x"), (None, None, None), ([None, "c"], None, None)]
    df = spark.createDataFrame(rows, "answers array<string>, gold string, answer string")
    want = [["a", "b"], ["g"], ["x"], ["x"], [], [], ["c"]]
    assert [r.golds for r in normalize.gold_texts(df).collect()] == want
    structs = df.withColumn("answers", F.transform("answers", lambda a: F.struct(a.alias("text"))))
    assert [r.golds for r in normalize.gold_texts(structs).collect()] == want


def test_category_counts(spark):
    rows = [("a", "x", False), ("a", None, True), ("classifier_json", "x", True), ("classifier_json", "x", False), (None, "y", None)]
    df = spark.createDataFrame(rows, "f string, g string, bad boolean")
    got = {(r.field, r.value): r.n_rows for r in categories.category_counts(df, ["f", "g"], "bad").collect()}
    assert got == {("f", "a"): 2, ("f", "__error__"): 1, ("g", "x"): 3, ("g", "__error__"): 1, ("g", "y"): 1}
    assert ("f", "__error__") not in {(r.field, r.value) for r in categories.category_counts(df, ["f"]).collect()}
    tab = {(r.f, r.g): r.n_rows for r in categories.cross_tab(df, "f", "g").collect()}
    assert tab == {("a", "x"): 1, ("a", "unknown"): 1, ("classifier_json", "x"): 2, ("unknown", "y"): 1}
