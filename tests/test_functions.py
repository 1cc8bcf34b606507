from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qassay.functions import formats, judging, metrics, text

WORDS = st.lists(st.sampled_from(["a", "b", "B", "the", "é", "x1"]), max_size=12)


def f1(pred, gold):
    p, g = pred.lower().split(), gold.lower().split()
    if not p and not g:
        return 1.0
    common = sum((Counter(p) & Counter(g)).values())
    if not common:
        return 0.0
    return 2 * common / (len(p) + len(g))


def test_normalize_and_strip(column):
    values = ["  A \t b\n\nC ", " x y\u0085", "", "a  b", "É\x1cè"]
    want = [" ".join(v.split()).lower() for v in values]
    assert column(values, text.normalize_text(F.col("x"))) == want
    assert column(values, text.strip(F.col("x"))) == [v.strip() for v in values]


def test_invalid_answers(column):
    assert column(["nan", " None ", "", None, "nanna"], text.is_invalid_answer(F.col("x"))) == [True, True, True, True, False]


def test_word_counts(column):
    values = ["it's aé test_1", "", "--", "one"]
    assert column(values, text.word_count(F.col("x"))) == [4, 0, 0, 1]
    assert column([" a  b ", ""], F.size(text.words(F.col("x")))) == [2, 0]


def test_truncate(column):
    assert column(["  " + "a" * 10 + " ", "b" * 11], text.truncate(F.col("x"), 10)) == ["a" * 10, "b" * 7 + "..."]


def test_clean_markdown_is_one_pass(column):
    assert column(["a\r\n\n\n\n\nb"], text.clean_markdown(F.col("x"))) == ["a" + "\n\n\n\n\n".replace("\n\n\n", "\n\n") + "b"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(WORDS, WORDS), min_size=1, max_size=30))
def test_token_f1_matches_counters(column, pairs):
    rows = [(" ".join(p), "  ".join(g)) for p, g in pairs]
    got = column(rows, metrics.token_f1(F.col("p"), F.col("g")), "p string, g string")
    swapped = column(rows, metrics.token_f1(F.col("g"), F.col("p")), "p string, g string")
    for (p, g), a, b in zip(rows, got, swapped):
        assert abs(a - f1(p, g)) < 1e-12
        assert abs(a - b) < 1e-12


def test_best_scores_over_golds(column):
    rows = [("a b", ["x", "B  a", "A b"]), ("a", []), ("q", ["z"])]
    schema = "p string, g array<string>"
    assert column(rows, metrics.best_exact_match(F.col("p"), F.col("g")), schema) == [1, 0, 0]
    assert column(rows, metrics.best_token_f1(F.col("p"), F.col("g")), schema) == [1.0, 0.0, 0.0]


def test_gap_tier_bounds(column):
    assert column([0.19, 0.2, 0.6, 0.61, None], metrics.gap_tier(F.col("x")), "x double") == ["low", "medium", "medium", "high", None]


def test_refusal_class_order(column):
    values = {
        "": "empty", " NaN ": "empty", "This is not found in the document, unanswerable": "canonical_refusal",
        "It cannot be answered": "explicit_refusal", "The text does not mention it": "soft_refusal",
        "y" * 160 + " does not mention": "context_dump", "y" * 150: "invented_answer", "y" * 151: "context_dump",
        "y" * 140 + " no answer in": "explicit_refusal", "Paris": "invented_answer",
    }
    assert column(list(values), judging.refusal_class(F.col("x"))) == list(values.values())


def test_quality_tier_boundaries(column):
    rows = [("a", 2, 5, 5, 5), ("a", 3, 2, 5, 5), ("a", 4, 4, 4, 4), ("a", 3, 4, 4, 4), ("nan", 5, 5, 5, 5), ("a", 5, 5, 5, 3)]
    got = column(rows, judging.quality_tier(*[F.col(c) for c in "abcde"]), "a string, b int, c int, d int, e int")
    assert got == ["drop", "low", "high", "medium", "drop", "medium"]


def test_coerce_score(column):
    values = ["4", '"4"', "4.7", '"4.5"', "true", "0", "6", "null", '" 3 "', "-1", "0.9", '""', "[4]"]
    got = column(values, judging.coerce_score(F.try_parse_json("x")))
    assert got == [4, 4, 4, None, None, None, None, None, 3, None, None, None, None]


def test_gold_mode_tie_goes_to_the_first(column):
    rows = [(["b", "a", "a ", "b"],), ([" ", "z"],), ([],), (None,)]
    answers = F.transform("x", lambda t: F.struct(t.alias("text")))
    got = column(rows, judging.gold_reference(answers, F.lit(False), F.lit(" g ")), "x array<string>")
    assert got == ["b", "z", "The answer is not found in the document.", "g"]


def test_question_rules(column):
    values = ["How many?", "Whose is it", "is it", "Çe", "", "Whatever", "HOW so", "Had it"]
    assert column(values, judging.heuristic_question_type(F.col("x"))) == ["other", "who", "yes_no", "other", "other", "other", "how", "other"]
    assert column(values, judging.question_starter(F.col("x"))) == ["how", "whose", "yes_no", "other", "empty", "other", "how", "yes_no"]


def test_answer_type(column):
    w = lambda n, end="": " ".join(["w"] * n) + end
    values = ["unanswerable", "a b c", "1, 2 3-4 5", w(12), w(12, "."), w(20), w(21)]
    got = column(values, judging.answer_type(F.col("x"), F.lit(False)))
    assert got == ["unanswerable_refusal", "short_span", "numeric", "short_span", "medium_span", "medium_span", "explanatory"]


def test_pick_category(column):
    got = column(["is not-required", "NOT required", "required", "?", None], judging.pick_category(F.col("x"), "document_necessity"))
    assert got == ["not_required", "not_required", "required", "required", "required"]


def test_formats(column):
    assert column([59.4, 3661.0, 0.5, 1.5, None], formats.hms(F.col("x")), "x double") == ["00:00:59", "01:01:01", "00:00:00", "00:00:02", None]
    assert column([5.0, 65.0, 3660.0], formats.duration(F.col("x")), "x double") == ["5s", "1m 05s", "1h 01m"]
    assert column([2_500_000, 1_500_000_000], formats.size(F.col("x")), "x bigint")[1] == "1.50 GB"


def test_rank_to_points_rejects_bad_ranks(column):
    import pytest

    assert column([1.0, 8.0], judging.rank_to_points(F.col("x"), F.lit(8)), "x double") == [8.0, 1.0]
    with pytest.raises(Exception, match="out of range"):
        column([9.0], judging.rank_to_points(F.col("x"), F.lit(8)), "x double")
