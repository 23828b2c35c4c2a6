"""Scoring: one row per labelled field, with its category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import base_rule, settled, with_typed

#: The names of categories.
CORRECT, MISSING, UNEXPECTED, MISMATCH, INVALID, FAILED = (
    "correct", "missing_value", "unexpected_value", "value_mismatch", "invalid_value", "inference_error",
)


def category(expected: str = "_e", predicted: str = "_p") -> Column:
    """Category of two typed values, by the names under which ``with_typed`` added them: an invalid prediction first,
    then equality (null equals null)."""
    e, p = F.col(f"{expected}_state"), F.col(f"{predicted}_state")
    same = (e == p) & F.col(f"{expected}_value").eqNullSafe(F.col(f"{predicted}_value"))
    return F.when(p == "invalid", INVALID).when(same, CORRECT).when(p == "null", MISSING).when(e == "null", UNEXPECTED).otherwise(MISMATCH)


def score_long(fields: DataFrame, unicode: bool = True) -> DataFrame:
    """Adds correct, category and expected_present to (…, expected VARIANT, predicted VARIANT, rule, error).

    ``rule`` is a base rule or null. Where ``error`` is not null the document failed: its fields are wrong,
    whatever they hold. Row by row, no shuffle."""
    typed = with_typed(fields, {"_e": F.col("expected"), "_p": F.col("predicted")}, F.col("rule"), unicode)
    named = F.when(F.col("error").isNotNull(), FAILED).otherwise(category())
    return (
        settled(typed.withColumn("category", named), "category")
        .withColumns({"correct": F.col("category") == CORRECT, "expected_present": F.col("_e_state") != "null"})
        .drop("_e_state", "_e_value", "_p_state", "_p_value")
    )


def keys_in_order(json_text: Column) -> Column:
    """Keys of a JSON object as they stand in its text, the last of equal ones counting once."""
    return F.array_distinct(F.coalesce(F.json_object_keys(json_text), F.array().cast("array<string>")))


def details(documents: DataFrame, unicode: bool = True) -> DataFrame:
    """The long fact table (id, doc_pos, pos, field, rule, expected, predicted, error, correct, category, expected_present).

    ``documents``: id, doc_pos, expected_fields and field_schema as VARIANT, labels (names in label order),
    fields (VARIANT or null) and error. Only labelled fields are scored; a field that the prediction lacks is
    null; a failed document predicts nothing."""
    path = lambda k: F.concat(F.lit("$['"), k, F.lit("']"))
    each = documents.select(
        "id", "doc_pos", "error", "expected_fields", "field_schema", F.when(F.col("error").isNull(), F.col("fields")).alias("fields"),
        F.posexplode("labels").alias("pos", "field"),
    )
    got = lambda c: F.try_variant_get(F.col(c), path(F.col("field")), "variant")
    long = each.select("id", "doc_pos", "pos", "field", base_rule(got("field_schema")).alias("rule"), got("expected_fields").alias("expected"), got("fields").alias("predicted"), "error")
    return score_long(long, unicode)


def per_document(long: DataFrame, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """Correct and total fields of each document, its accuracy, and in label order field_results and details."""
    total = F.count("*")
    correct = F.count_if("correct")
    has = {"expected", "predicted", "category", "expected_present"} <= set(long.columns)
    detail = [F.struct("correct", "category", "expected", "predicted", "expected_present").alias("detail")] if has else []
    listed = F.array_sort(F.collect_list(F.struct("pos", "field", "correct", *detail)), lambda a, b: a["pos"] - b["pos"])
    out = long.groupBy(*by).agg(correct.alias("correct"), total.alias("total"), F.try_divide(correct, total).alias("accuracy"), listed.alias("_listed"))
    mapped = lambda part: F.map_from_entries(F.transform("_listed", lambda x: F.struct(x["field"], x[part])))
    return out.withColumns({"field_results": mapped("correct")} | ({"details": mapped("detail")} if has else {})).drop("_listed")
