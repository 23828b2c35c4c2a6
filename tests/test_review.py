import json

import pytest
from pyspark.sql import functions as F

from fieldproof.operators import compare, infer, review, validate
from fieldproof.sources import readers

FLAGGED = [("10%", review.PERCENT), (100000, review.NOT_TEXT), ("１０％", review.PERCENT), ("null", review.PLACEHOLDER), ("N/A", review.PLACEHOLDER), ("", review.PLACEHOLDER), ("unreadable", review.NO_DIGITS)]
FINE = [None, "0", "20,000", "20.000", "Rp 20.000", ":9,000", "0012"]


def test_flags(spark):
    values = FLAGGED + [(v, None) for v in FINE]
    rows = spark.createDataFrame([(i, json.dumps({"v": v})) for i, (v, _) in enumerate(values)], "i int, j string")
    value = F.try_variant_get(F.parse_json("j"), "$.v", "variant")
    rows = rows.withColumn("value", value)
    of = lambda field, rule, name: review.with_reason(rows.withColumns({"field": F.lit(field), "rule_text": F.lit(rule)}), {name: "value"}).select("i", name)
    out = of("tax_amount", "string or null", "r").join(of("tax_amount", "number", "n"), "i").join(of("other", "string or null", "o"), "i").orderBy("i").collect()
    assert [r["r"] for r in out] == [x for _, x in values]
    assert not any(r["n"] or r["o"] for r in out)


MERGES = [
    # policy, first, second, second's error, merged, accepted
    ("invalid-amount-v1", "10%", "5", None, "5", True),
    ("invalid-amount-v1", "10%", None, None, None, True),
    ("percent-crop-v1", "10%", None, None, "10%", False),
    ("percent-crop-v1", "N/A", "5", None, "N/A", False),
    ("label-context-v1", "10%", "11%", None, "10%", False),
    ("invalid-amount-v1", "10%", "5", "TimeoutError: x", "10%", False),
    ("none", "10%", "5", None, "10%", False),
    ("invalid-amount-v1", "7", "8", None, "7", False),
]


def test_merge(spark):
    rows = [(i, p, json.dumps({"a": a, "b": b}), e) for i, (p, a, b, e, *_) in enumerate(MERGES)]
    df = spark.createDataFrame(rows, "id int, policy string, j string, second_error string").withColumn("v", F.parse_json("j"))
    got = lambda k: F.try_variant_get("v", f"$.{k}", "variant")
    long = df.select("id", "policy", F.lit("tax_amount").alias("field"), F.lit("string or null").alias("rule_text"), got("a").alias("predicted"), got("b").alias("second"), "second_error")
    out = review.merge(long).select("id", F.try_variant_get("merged", "$", "string").alias("m"), "accepted").orderBy("id").collect()
    assert [(r["m"], r["accepted"]) for r in out] == [(m, a) for *_, m, a in MERGES]


def test_merge_documents(spark):
    kind = "id int, asked array<string>, accepted array<string>, evidence array<struct<field:string,text:string>>, second_evidence array<struct<field:string,text:string>>, answer string, confidence double, second_error string, request_started boolean, latency double, second_latency double, memory double, second_memory double"
    rows = [
        (0, ["tax"], ["tax"], [("tax", "old"), ("total", "t")], [("tax", "new"), ("x", "y")], "a", 0.5, None, True, 1.0, 2.0, 3.0, 4.0),
        (1, ["tax"], [], [("tax", "old")], [("tax", "new")], "a", 0.5, "E", True, 1.0, None, 3.0, None),
        (2, [], [], [("tax", "old")], [], "a", 0.5, None, False, 1.0, None, 3.0, None),
    ]
    out = review.merge_documents(spark.createDataFrame(rows, kind)).orderBy("id").collect()
    assert [[tuple(e) for e in r["evidence"]] for r in out] == [[("total", "t"), ("tax", "new")], [("tax", "old")], [("tax", "old")]]
    assert [(r["answer"], r["confidence"], r["model_calls"], r["latency"], r["memory"]) for r in out] == [("", None, 2, 3.0, 4.0), ("a", 0.5, 2, None, None), ("a", 0.5, 1, 1.0, 3.0)]
    assert out[0]["initial"]["answer"] == "a"


def test_crop_box(spark):
    out = spark.createDataFrame([(418, 985), (1, 1), (5, 0)], "w int, h int").select(review.crop_box(F.col("w"), F.col("h")).alias("b")).collect()
    assert [r["b"] and tuple(r["b"]) for r in out] == [(0, 98, 418, 887), (0, 0, 1, 1), None]


def test_guard_order(spark):
    kind = "pos int, mode string, complete boolean, fingerprint string, selected_ids array<string>, report_version int, source_sha256 string"
    first = (0, "live", True, "f", ["a", "b"], 2, "s")
    reason = lambda *rows: compare.guard(spark.createDataFrame(list(rows), kind)).first()["reason"]
    assert reason(first) == compare.TOO_FEW
    assert reason(first, (1, "dry-run", True, "g", ["a"], 1, "t")) == compare.NOT_LIVE
    assert reason(first, (1, "live", True, "g", ["a"], 1, "t")) == compare.FINGERPRINTS
    assert reason(first, (1, "live", True, "f", ["b", "a"], 1, "t")) == compare.SELECTIONS
    assert reason(first, (1, "live", True, "f", ["a", "b"], 1, "t")) == compare.VERSIONS
    assert reason(first, (1, "live", True, "f", ["a", "b"], 2, "t")) == compare.SOURCES
    assert reason(first, (1, *first[1:])) is None


def test_paired_changes(spark):
    a = spark.createDataFrame([("d", "x", False), ("d", "y", True), ("e", "x", True)], "id string, field string, correct boolean")
    b = spark.createDataFrame([("d", "x", True), ("d", "y", False), ("e", "x", True)], "id string, field string, correct boolean")
    assert {tuple(r) for r in compare.paired_changes(a, b).collect()} == {("x", 1, 0), ("y", 0, 1)}
    assert compare.unpaired_fields(a, b.where("field = 'x'")).count() == 1




class Teller:
    def analyze(self, image, question, field_schema):
        if question == "bad":
            error = ValueError("broken")
            error.raw_output = "raw"
            raise error
        return {"fields": {k: question for k in field_schema}}

    def describe(self):
        return {}


def test_infer_hides_labels(spark):
    rows = spark.createDataFrame([("a", "i", "q", '{"x": "string"}', "secret"), ("b", "i", "bad", "{}", "secret")], "id string, image string, question string, field_schema string, expected_fields string")
    out = {r["id"]: r for r in infer.infer(rows, Teller).collect()}
    assert json.loads(out["a"]["prediction"]) == {"fields": {"x": "q"}}
    assert (out["b"]["error"], out["b"]["raw_error_output"], out["b"]["prediction"]) == ("ValueError: broken", "raw", None)
    assert "expected_fields" not in infer.VISIBLE


def test_prompts():
    rules = {"tax_amount": "string or null", "vendor": "string"}
    assert infer.instructions(rules) == ""
    assert infer.instructions(rules, "receipt-compact-v1").startswith("tax_amount: ")
    assert len(infer.instructions(rules, "label-aware-v1").splitlines()) == 3
    with pytest.raises(ValueError):
        infer.instructions({"tax_amount": "number"}, "label-aware-v1")
    with pytest.raises(ValueError):
        infer.instructions(rules, "other")
    assert infer.prompt("Q", rules).startswith("Q\n") and '"vendor": "string"' in infer.prompt("Q", rules)


def test_settings():
    s = readers.settings({"MLLM_BACKEND": " Transformers ", "MLLM_LOAD_IN_4BIT": "no"})
    assert s.backend == "transformers" and not s.load_in_4bit
    for env in ({"MLLM_BACKEND": "x"}, {"MLLM_RECEIPT_RECHECK": "x"}, {"MLLM_API_MODE": "x"}, {"MLLM_MIN_PIXELS": "9", "MLLM_MAX_PIXELS": "3"}):
        with pytest.raises(ValueError):
            readers.settings(env)


def test_untexted_amounts(spark):
    rows = spark.createDataFrame([("a", "tax_amount", "number"), ("a", "total_amount", "string or null"), ("a", "vendor", "number")], "id string, field string, rule_text string")
    assert [r["field"] for r in validate.untexted_amounts(rows).collect()] == ["tax_amount"]
