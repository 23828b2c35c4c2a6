import json

from pyspark.sql import functions as F

from fieldproof.functions import values
from fieldproof.operators import parse

TEXTS = [
    # raw, requested, fields, confidence, error
    ('```json\n{"fields": {"total": 12}, "confidence": 1.2}\n```', ["total", "vendor"], {"total": "12", "vendor": None}, 1.0, None),
    ("no json here", ["total"], None, None, parse.NO_OBJECT),
    ('{"total": 1, "other": 2}', ["total"], {"total": "1"}, 0.0, None),
    ("  ", ["total"], None, None, parse.EMPTY),
    (None, ["total"], None, None, parse.EMPTY),
    ("{}", ["total"], None, None, parse.NO_FIELDS),
    ('{"fields": [1]}', ["total"], None, None, parse.NOT_FIELDS),
    ('{"fields": null, "total": 1}', ["total"], None, None, parse.NOT_FIELDS),
    ('{"fields": {"total": 1}, "confidence": "NaN"}', ["total"], {"total": "1"}, 0.0, None),
    ('{"fields": {"requested_field": "x"}}', ["total"], None, None, parse.NO_NAMES),
    ('{"fields": {}}', ["total"], {"total": None}, 0.0, None),
    ('note {not json} then {"fields": {"total": "7"}, "confidence": true} end', ["total"], {"total": "7"}, 1.0, None),
    ('[{"fields": {"total": "8"}}]', ["total"], {"total": "8"}, 0.0, None),
]


def test_parse_output(spark):
    rows = spark.createDataFrame([(i, t[0], t[1]) for i, t in enumerate(TEXTS)], "i int, raw_output string, requested array<string>")
    out = parse.parse_output(rows).select("i", "raw_output", "requested", F.to_json("fields").alias("f"), "confidence", "parse_error").orderBy("i").collect()
    for (raw, names, fields, sure, error), r in zip(TEXTS, out, strict=True):
        assert r["parse_error"] == error, raw
        assert r["raw_output"] == raw
        if fields is not None:
            got = json.loads(r["f"])
            assert {n: None if got.get(n) is None else str(got.get(n)) for n in names} == fields
            assert r["confidence"] == sure


def test_answer_and_lists(spark):
    raw = ['{"fields": {"a": 1}, "answer": 0, "evidence": {"x": 1}}', '{"fields": {"a": 1}, "answer": "yes", "evidence": [{"field": "a", "text": "t"}], "uncertainties": ["u"]}']
    rows = spark.createDataFrame([(i, r, ["a"]) for i, r in enumerate(raw)], "i int, raw_output string, requested array<string>")
    out = parse.parse_output(rows).select("i", "answer", F.to_json("evidence").alias("e"), F.to_json("uncertainties").alias("u")).orderBy("i").collect()
    assert [(r["answer"], r["e"], r["u"]) for r in out] == [("", "[]", "[]"), ("yes", '[{"field":"a","text":"t"}]', '["u"]')]


def test_labels(spark):
    truths = [
        ({"gt_parse": {"sub_total": {"tax_price": "1"}, "total": {"total_price": "5"}}}, {"tax_amount": "1", "total_amount": "5"}, None),
        ({"gt_parse": {"total": [{"total_price": "5"}]}}, None, "Ambiguous repeated label group: total"),
        ({"gt_parse": {"total": {"total_price": 5}}}, None, "Ambiguous/nontext CORD label: total.total_price"),
        ({"gt_parse": {"total": {"total_price": " "}}}, None, "Ambiguous/nontext CORD label: total.total_price"),
        ({"gt_parse": {}}, None, "No labelled amounts in the selected task"),
        ({"other": 1}, None, "CORD row has no gt_parse object"),
    ]
    rows = spark.createDataFrame([(i, json.dumps(t[0])) for i, t in enumerate(truths)], "i int, ground_truth string")
    for given in (rows, rows.withColumn("ground_truth", F.parse_json("ground_truth"))):
        out = parse.map_labels(given).orderBy("i").collect()
        assert [(r["expected"], r["reject"]) for r in out] == [(e, x) for _, e, x in truths]


def plain_first(text):
    """The first object that starts at any brace, brace by brace."""
    at = text.find("{")
    while at >= 0:
        try:
            return json.JSONDecoder().raw_decode(text, at)[0]
        except ValueError:
            at = text.find("{", at + 1)
    return None


def test_first_object_equals_a_plain_scan(spark):
    import random

    rng = random.Random(11)
    parts = ["{", "}", '{"a":', '"', "\\", "1", ",", " ", '{"b": 2}', "x", "{}", "\n", '"c":"{"', "[", "]", "é", '{ "k" : null }', "\\{"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(1500)] + ["", "}{", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    out = rows.select("i", parse.first_object(F.col("t")).alias("body")).withColumn("j", F.to_json(F.try_parse_json("body")))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["i"]: None if r["j"] is None else json.loads(r["j"]) for r in out.collect()}
    assert got == {i: None if t is None else plain_first(t) for i, t in enumerate(texts)}
    assert sum(v is not None for v in got.values()) > 500


def test_deep_texts_end_nothing(spark):
    """Nested to 900 levels, never closed, and deeper than a reader goes."""
    nest = lambda n, inner="1": '{"a":' * n + inner + "}" * n
    texts = [f'{{"fields": {{"total": {nest(900)}, "b": {"[" * 900 + "]" * 900}}}, "answer": {nest(900)}, "confidence": {nest(900)}}}', '{"a":' * 5000, '{"a":' * 1500 + '{"fields": {"total": 3}}']
    rows = spark.createDataFrame([(i, t, ["total"]) for i, t in enumerate(texts)], "i int, raw_output string, requested array<string>").repartition(2)
    out = parse.parse_output(rows)
    got = out.select("i", "parse_error", F.length(F.to_json(parse.field_value(F.col("fields"), F.lit("total")))).alias("n"), "confidence").orderBy("i").collect()
    assert [(r["parse_error"], r["n"], r["confidence"]) for r in got] == [(None, len(nest(900)), 0.0), (parse.NO_OBJECT, None, None), (None, 1, 0.0)]
    kept = out.select("i", parse.field_value(F.col("fields"), F.lit("total")).alias("v"), parse.field_value(F.col("fields"), F.lit("b")).alias("w"))
    typed = values.with_typed(kept, {"v": F.col("v"), "w": F.col("w")}, F.lit("number")).orderBy("i").select("v_state", "w_state").collect()
    assert [tuple(r) for r in typed] == [("invalid", "invalid"), ("null", "null"), ("number", "null")]
