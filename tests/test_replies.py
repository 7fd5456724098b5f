"""Edge rows of normalisation, strict parsing and bounded expressions."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import strict, text


def one(spark, column, *values):
    names = [f"c{k}" for k in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column(*[F.col(n) for n in names]).alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "error"),
    [
        ('{"answer": "a", "answer": "a"}', "not_json"), ('{"answer": Infinity}', "not_json"), ('{"answer": "a"} x', "not_json"), ("", "not_json"), ('"a"', "wrong_fields"),
        ('{"answer": {"q": 1, "q": 2}}', "not_json"), ('{"answer": "\\u00a0"}', "blank_or_non_string_answer"), ('{"answer": true}', "blank_or_non_string_answer"), ("{}", "wrong_fields"),
        ("[" * 100_000, "not_json"), ('{"answer": "\\ud800"}', None), ('{"\\udfff": 1}', "wrong_fields"), (' {"answer": " a "}\n', None), (None, "no_content"),
    ],
)
def test_answers(spark, raw, error):
    assert one(spark, lambda c: strict.answer_error(strict.parse_strict(c)), raw) == error


def test_normal_forms(spark):
    assert one(spark, text.normalize_answer, " Straße   Café\n") == "strasse café"
    assert one(spark, text.normalize_answer, "\x1c A\t\n B ") == "a b"
    assert one(spark, text.normalize_check, "ﬁ ²") == "fi 2"
    assert one(spark, text.normalize_strip, " A  B ") == "a  b"
    assert one(spark, text.normalize_answer, None) is None
    assert one(spark, text.unicode_words, "État_1, x-y") == ["état_1", "x", "y"]


@pytest.mark.parametrize(
    ("said", "wanted", "held"),
    [("Go to Café.", "café", True), ("cafés", "café", False), ("a\\Eb (c", "\\Eb (C", False), ("a \\Eb (c", "\\eb  (C", True), ("12.5 kg", "2.5", False), ("x.y", "x y", False)],
)
def test_expressions(spark, said, wanted, held):
    assert one(spark, text.contains_expression, said, wanted) is held


def test_leaves_of_what_is_no_json(spark):
    from palimpsest.plans.messages import string_leaves

    assert one(spark, string_leaves, '{"a": ["x", {"b": "\\ud800y"}], "c": 1}') == ["x", "\ufffdy"]
    assert one(spark, string_leaves, "{") is None and one(spark, string_leaves, "[" * 50_000) is None and one(spark, string_leaves, None) == []


@pytest.mark.parametrize(
    ("said", "valid"),
    [("2024-01-01T00:00:00Z", True), ("2024-01-01T00:00:00+23:59", True), ("2024-01-01T00:00:00+99:99", False), ("2024-01-01T00:00:00-24:00", False), ("2024-02-30T00:00:00Z", False), ("2024-01-01T25:00:00Z", False), ("2024-01-01T00:00:00", False), (None, False)],
)
def test_timestamps(spark, said, valid):
    from palimpsest.functions.times import rfc3339_valid

    assert one(spark, rfc3339_valid, said) is valid
