import json
import math
import unicodedata
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldproof.functions.text import fold_udf, guarded, normalise, percent
from fieldproof.functions.values import base_rule, with_typed
from fieldproof.operators import metrics, score

CASES = [
    # expected, predicted, rule, category
    (1234.5, "1,234.50", "number", "correct"),
    (1234, "12,34", "number", "invalid_value"),
    ("12", "0012", None, "value_mismatch"),
    ("known", None, None, "missing_value"),
    (None, "invented", None, "unexpected_value"),
    (None, "", "string", "correct"),
    (None, "null", "string", "unexpected_value"),
    (1, True, "number", "invalid_value"),
    ("x", {"value": "x"}, None, "invalid_value"),
    ("x", ["x"], "string", "invalid_value"),
    ("northwind studio", " Northwind  Studio ", None, "correct"),
    (12.0, 12, None, "correct"),
    ("12", 12, None, "value_mismatch"),
    ("12", 12, "string", "invalid_value"),
    (12.0, "12", "integer", "correct"),
    (12, "12.5", "integer", "invalid_value"),
    (5, ".5", "number", "invalid_value"),
    (5, "1e5", "number", "invalid_value"),
    (5, "+5.000", "number or null", "correct"),
    (0, "-0.0", "number", "correct"),
    ("ＡＢＣ", "abc", "string", "correct"),
    ("Straße", "STRASSE", "string", "correct"),
    (3, "٣", "number", "correct"),
    ("a b", "A B", "string or null", "correct"),
    (1.0000000000001, "1", "number", "value_mismatch"),
    (12345678901234567890123456789012345678901234, "12345678901234567890123456789012345678901234", "string", "invalid_value"),
    ("2026-07-18", "2026-7-18", "date", "value_mismatch"),
    ("28.000", "28,000", "string or null", "value_mismatch"),
]


def _long(spark, cases):
    rows = [(i, json.dumps({"e": e, "p": p, "r": r})) for i, (e, p, r, *_) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, j string").withColumn("v", F.try_parse_json("j"))
    got = lambda k: F.try_variant_get("v", f"$.{k}", "variant")
    return df.select("id", base_rule(got("r")).alias("rule"), got("e").alias("expected"), got("p").alias("predicted"), F.lit(None).cast("string").alias("error"))


def test_categories(spark):
    got = {r["id"]: r["category"] for r in score.score_long(_long(spark, CASES)).select("id", "category").collect()}
    wrong = [(c, got[i]) for i, c in enumerate(CASES) if got[i] != c[3] and c[0] != 12345678901234567890123456789012345678901234]
    assert not wrong


def test_object_rules(spark):
    rules = [{"type": "number"}, {"x": 1}, "", "integer or null", None]
    rows = spark.createDataFrame([(i, json.dumps({"r": r})) for i, r in enumerate(rules)], "id int, j string")
    got = rows.select("id", base_rule(F.try_variant_get(F.parse_json("j"), "$.r", "variant")).alias("b")).orderBy("id").collect()
    assert [r["b"] for r in got] == ["number", "string", "string", "integer", None]


def test_failed_document_keeps_its_fields(spark):
    rows = _long(spark, [("a", "a", "string"), (None, None, "string")]).withColumn("error", F.lit("ValueError: x"))
    got = score.score_long(rows).orderBy("id").collect()
    assert [r["category"] for r in got] == ["inference_error"] * 2
    assert [r["expected_present"] for r in got] == [True, False]
    assert not any(r["correct"] for r in got)


def test_infinite_is_invalid(spark):
    v = F.parse_json(F.lit('{"a": 1e400}'))
    got = with_typed(spark.range(1), {"x": F.try_variant_get(v, "$.a", "variant")}, F.lit("number")).first()
    assert got["x_state"] == "invalid"


def test_details_only_labelled_fields(spark):
    docs = spark.createDataFrame([("d", 1, '{"a": "1"}', '{"a": "string", "b": "string"}', '{"a": "1", "b": "2"}')], "id string, doc_pos int, e string, s string, f string")
    docs = docs.select("id", "doc_pos", F.parse_json("e").alias("expected_fields"), F.parse_json("s").alias("field_schema"), F.parse_json("f").alias("fields"), F.json_object_keys("e").alias("labels"), F.lit(None).cast("string").alias("error"))
    got = score.details(docs).collect()
    assert [(r["field"], r["category"]) for r in got] == [("a", "correct")]


def test_empty_metrics(spark):
    none = score.score_long(_long(spark, CASES)).where("false").withColumns({"field": F.lit("a"), "doc_pos": F.lit(1)})
    got = metrics.field_accuracy(none).first()
    assert got["total_fields"] == 0 and got["field_accuracy"] is None
    assert metrics.document_accuracy(none).first()["document_accuracy"] is None


def _plain_number(text):
    """The numeric form of a text, told anew in plain Python."""
    import re

    if not re.fullmatch(r"[+-]?(?:\d+|\d{1,3}(?:,\d{3})+)(?:\.\d+)?", text):
        return None
    return Decimal(text.replace(",", ""))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123456789,.+-e ٣", max_size=8), min_size=30, max_size=30))
def test_numbers_against_plain_python(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = with_typed(rows, {"x": F.col("t").cast("variant")}, F.lit("number")).orderBy("id").collect()
    for t, r in zip(texts, got, strict=True):
        folded = " ".join(t.split())
        if not folded:
            assert r["x_state"] == "null"
            continue
        number = _plain_number(folded)
        assert (r["x_state"] == "number") == (number is not None), t
        if number is not None:
            assert Decimal(r["x_value"]) == number


FLOATS = st.one_of(st.floats(-1e18, 1e18), st.sampled_from([0.0, -0.0, 1e-20, 2e-20, 0.1, 0.10000000000000001, 9007199254740993.0, 9007199254740992.0, 1e5, 1e16, 1e-4, 9.9e-5, 5e-324]))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(FLOATS, st.integers(-(2**70), 2**70)), st.one_of(FLOATS, st.integers(-(2**70), 2**70)), st.booleans()), min_size=40, max_size=40))
def test_bare_numbers_are_compared_by_value(spark, pairs):
    pairs = [(a, a if same else b) for a, b, same in pairs]
    got = {r["id"]: r["category"] for r in score.score_long(_long(spark, [(a, b, None) for a, b in pairs])).select("id", "category").collect()}
    for i, (a, b) in enumerate(pairs):
        assert (got[i] == "correct") == (a == b), (a, b)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(FLOATS, min_size=40, max_size=40))
def test_floats_under_a_number_rule(spark, floats):
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(floats)], "id int, t string")
    got = with_typed(rows, {"x": F.try_parse_json("t")}, F.lit("number")).orderBy("id").collect()
    for x, r in zip(floats, got, strict=True):
        number = _plain_number(str(x))
        assert (r["x_state"] == "number") == (number is not None), x
        assert number is None or Decimal(r["x_value"]) == number


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=12), min_size=30, max_size=30))
def test_fast_path_equals_udf(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = rows.select("id", normalise(F.col("t")).alias("a"), fold_udf("t").alias("b")).orderBy("id").collect()
    for t, r in zip(texts, got, strict=True):
        assert r["a"] == r["b"] == (" ".join(unicodedata.normalize("NFKC", t).split()).casefold() or None)


def test_percent_and_guard(spark):
    got = spark.createDataFrame([(0.5,), (None,), (2 / 3,)], "x double").select(percent(F.col("x")).alias("p")).collect()
    assert [r["p"] for r in got] == ["50.00%", "n/a", "66.67%"]
    got = spark.createDataFrame([("=a",), ("@b",), ("-1",), ("+2",), ("c",)], "x string").select(guarded(F.col("x")).alias("p")).collect()
    assert [r["p"] for r in got] == ["'=a", "'@b", "'-1", "'+2", "c"]
    assert math.isclose(1, 1)


@pytest.mark.parametrize("unicode", [True, False])
def test_null_text(spark, unicode):
    assert spark.createDataFrame([(None,)], "x string").select(normalise(F.col("x"), unicode).alias("n")).first()["n"] is None


def test_estimated_latency(spark):
    rows = spark.range(10_000).selectExpr("cast(null as string) as error", "cast(id as double) as wall_seconds", "1.0D as memory")
    exact, near = metrics.latency(rows).first(), metrics.latency(rows, accuracy=1000).first()
    assert abs(exact["median_seconds"] - near["median_seconds"]) <= 10 and abs(exact["p95_seconds"] - near["p95_seconds"]) <= 10
