import json

from pyspark.sql import functions as F

from fieldproof.plans import recheck as P


class Second:
    def analyze(self, image, question, field_schema, receipt_profile=None):
        assert (receipt_profile == "label-aware-v1") == (question == "whole")
        if image == "broken":
            raise TimeoutError("late")
        assert list(field_schema) == ["tax_amount"] or question == "whole"
        return {"fields": {"tax_amount": "5", "total_amount": "6"}}

    def describe(self):
        return {}


def documents(spark):
    rules = json.dumps({"tax_amount": "string or null", "total_amount": "string or null", "vendor": "string"})
    rows = [("a", "ok", {"tax_amount": "10%", "total_amount": "7", "vendor": "%"}), ("b", "broken", {"tax_amount": "10%"}), ("c", "ok", {"tax_amount": "3"}), ("d", "ok", {"tax_amount": "N/A"})]
    df = spark.createDataFrame([(i, m, "whole", rules, json.dumps(f)) for i, m, f in rows], "id string, image string, question string, s string, f string")
    return df.select("id", "image", "question", F.parse_json("s").alias("field_schema"), F.parse_json("f").alias("fields"))


def merged(fields):
    got = fields.where("field = 'tax_amount'").select("id", F.try_variant_get("merged", "$", "string").alias("m"), "accepted").collect()
    return {r["id"]: (r["m"], r["accepted"]) for r in got}


def test_only_flagged_documents_are_asked(spark):
    fields, attempts = P.recheck(documents(spark), Second, "invalid-amount-v1")
    assert merged(fields) == {"a": ("5", True), "b": ("10%", False), "c": ("3", False), "d": ("5", True)}
    assert {r["id"]: r["error"] for r in attempts.collect()} == {"a": None, "b": "TimeoutError: late", "d": None}
    assert fields.where("field = 'total_amount' and id = 'a'").select(F.try_variant_get("merged", "$", "string").alias("m")).first()["m"] == "7"


def test_policies(spark):
    fields, attempts = P.recheck(documents(spark), Second, "label-context-v1")
    assert merged(fields)["d"] == ("N/A", False) and attempts.count() == 2
    fields, attempts = P.recheck(documents(spark), Second, "none")
    assert merged(fields)["a"] == ("10%", False) and attempts.count() == 0
