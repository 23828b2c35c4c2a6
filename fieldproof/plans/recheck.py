"""A second reading of flagged amounts: only flagged documents are asked again, once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import review as R
from ..operators.infer import CENTRAL, LABELS, Analyzer, infer
from ..operators.parse import parse_output
from ..operators.validate import check_names
from ..session import durable, new_path, on_files

#: The profile of a second reading with context, and what is said of the raw text of a prediction that was read twice.
CONTEXT_PROFILE = "label-aware-v1"
SCOPE = "initial_request; see recheck_attempt for the additional response"
#: Our own wording of the second question.
AGAIN = "Read only these amounts again and copy each as it is printed. A percentage is no amount. Give null where no amount is printed or legible."


def _at(column: str) -> Column:
    return F.try_variant_get(column, F.concat(F.lit("$['"), F.col("field"), F.lit("']")), "variant")


def fields_long(documents: DataFrame, policy: str) -> DataFrame:
    """(id, policy, field, rule_text, predicted) of the requested fields of documents (id, field_schema, fields)."""
    names = F.coalesce(F.json_object_keys(F.to_json("field_schema")), F.array().cast("array<string>"))
    each = documents.select("id", "field_schema", "fields", F.explode(names).alias("field"))
    return each.select("id", F.lit(policy).alias("policy"), "field", F.try_variant_get(_at("field_schema"), "$", "string").alias("rule_text"), _at("fields").alias("predicted"))


def answers(inferred: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, prediction as JSON, error, raw_error_output, wall_seconds, view, request_started) of what ``infer`` returned: a model's text is
    parsed, by the names that its document (``asked``: id, field_schema as JSON) was asked for."""
    names = asked.select("id", F.json_object_keys("field_schema").alias("requested"))
    parsed = parse_output(inferred.join(names, "id"))
    pick = F.transform("requested", lambda n: F.struct(n, F.try_variant_get("fields", F.concat(F.lit("$['"), n, F.lit("']")), "variant")))
    parts = {"document_type": F.col("document_type"), "fields": F.map_from_entries(pick), "answer": F.col("answer"), "evidence": F.col("evidence"), "uncertainties": F.col("uncertainties"), "confidence": F.col("confidence"), "raw_output": F.col("raw_output"), "metadata": F.try_parse_json(F.coalesce("metadata", F.lit("{}")))}
    made = F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()]), {"ignoreNullFields": "false"})
    given = F.col("raw_output").isNotNull()
    failed = given & F.col("parse_error").isNotNull()
    return parsed.select(
        "id", F.when(given & ~failed, made).otherwise(F.col("prediction")).alias("prediction"), F.when(failed, F.concat(F.lit("OutputParseError: "), F.col("parse_error"))).otherwise(F.col("error")).alias("error"),
        F.when(failed, F.col("raw_output")).otherwise(F.col("raw_error_output")).alias("raw_error_output"), "wall_seconds", "view", "request_started",
    )


def requests(documents: DataFrame, policy: str, unicode: bool = True) -> DataFrame:
    """(id, image, question, field_schema as JSON, asked, profile, view) of the documents that are asked again. The context policy
    repeats the original question over all fields, under a profile of its own; the others ask for the flagged fields alone, the
    crop policy of the image's central rows."""
    asked = R.asked_again(fields_long(documents, policy), unicode).groupBy("id").agg(F.array_sort(F.collect_list("field")).alias("asked"))
    flagged, none = documents.join(asked, "id"), F.lit(None).cast("string")
    if policy == "label-context-v1":
        return flagged.select("id", "image", "question", F.to_json("field_schema").alias("field_schema"), "asked", F.lit(CONTEXT_PROFILE).alias("profile"), none.alias("view"))
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    lines = F.array_join(F.transform("asked", lambda n: F.concat(n, F.lit(": "), F.element_at(known, n))), "\n")
    rules = F.to_json(F.map_from_arrays("asked", F.transform("asked", lambda n: F.lit(R.TEXT_AMOUNT))))
    view = F.lit(CENTRAL) if policy == "percent-crop-v1" else none
    return flagged.select("id", "image", F.concat(F.lit(AGAIN + "\n"), lines).alias("question"), rules.alias("field_schema"), "asked", none.alias("profile"), view.alias("view"))


def recheck(documents: DataFrame, make: Callable[[], Analyzer], policy: str, unicode: bool = True, ledger: str | None = None, salt: str = "") -> tuple[DataFrame, DataFrame]:
    """(fields, attempts). ``documents``: id, image, question, field_schema and fields (VARIANT).

    fields: one row per requested field with asked, accepted, merged (VARIANT), reason and merged_reason. attempts:
    one row per document that was asked again, with what it was asked, its prediction as JSON, and its error; a
    failed attempt changes nothing. Documents without such a flag are never sent to the analyzer. Under the crop policy it gets the
    central rows of the image (PNG) as a file of the shared folder, under the context policy ``receipt_profile``. Attempts go
    through a ledger (a new one unless given), so none is made twice."""
    check_names(policy=policy)
    long = fields_long(documents, policy)
    if policy == "none":
        none = F.lit(None).cast("string")
        nobody = long.where("false").select("id", none.alias("prediction"), none.alias("error"), none.alias("raw_error_output"), F.lit(None).cast("double").alias("wall_seconds"), none.alias("view"), F.lit(None).cast("boolean").alias("request_started"), F.array(none).alias("asked"), none.alias("question"))
        return R.merge(long.withColumns({"second": F.lit(None).cast("variant"), "second_error": none}), unicode), nobody
    wanted = requests(documents, policy, unicode)
    spark = documents.sparkSession
    views = on_files(new_path(spark, "views"))
    made = infer(wanted, make, ledger or new_path(spark, "ledger"), f"{salt} {policy}", views)
    attempts = durable(answers(made, wanted).join(wanted.select("id", "asked", "question"), "id"), "attempts")
    second = attempts.select("id", "error", F.try_variant_get(F.try_parse_json("prediction"), "$.fields", "variant").alias("second_fields"))
    both = long.join(second, "id", "left").withColumn("second", _at("second_fields")).withColumn("second_error", F.col("error"))
    return R.merge(both.drop("second_fields", "error"), unicode), attempts


def _json(struct: Column) -> Column:
    return F.to_json(struct, {"ignoreNullFields": "false"})


def _part(column: str, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(F.col(column), f"$.{name}", kind)


def reread(documents: DataFrame, make: Callable[[], Analyzer], policy: str, unicode: bool = True, ledger: str | None = None, salt: str = "") -> DataFrame:
    """(id, prediction as JSON): predictions after review, and after a second reading where ``policy`` asks for one.

    ``documents``: id, image, question, field_schema, requested, prediction (VARIANT with ``fields``). Every prediction
    gets ``review_flags`` of its final fields, in the order in which fields were requested, unless the analyzer gave
    flags of its own. One that was read again also gets recheck_attempt (what was asked, its prediction or error, what
    was accepted), initial_prediction, and metadata of both calls."""
    docs = documents.withColumn("fields", _part("prediction", "fields"))
    fields, attempts = recheck(docs, make, policy, unicode, ledger, salt)
    ordered = fields.join(docs.select("id", F.posexplode("requested").alias("pos", "field")), ["id", "field"])
    flag = F.when(F.col("merged_reason").isNotNull(), F.struct("field", F.col("merged_reason").alias("reason"), F.col("merged").alias("value")))
    row = F.struct("pos", "field", "merged", "accepted", "asked", flag.alias("flag"))
    listed = ordered.groupBy("id").agg(F.array_sort(F.collect_list(row), lambda a, b: a["pos"] - b["pos"]).alias("listed"))
    names = lambda c: F.transform(F.filter("listed", lambda x: x[c]), lambda x: x["field"])
    listed = listed.select(
        "id", names("accepted").alias("accepted"), names("asked").alias("flagged"), F.map_from_entries(F.transform("listed", lambda x: F.struct(x["field"], x["merged"]))).alias("merged"),
        F.transform(F.filter("listed", lambda x: x["flag"].isNotNull()), lambda x: x["flag"]).alias("flags"),
    )
    second = attempts.select(
        "id", F.col("asked").alias("names"), F.col("question").alias("second_question"), F.try_parse_json("prediction").alias("second"), F.col("error").alias("second_error"),
        F.col("raw_error_output").alias("second_raw"), F.col("wall_seconds").alias("second_seconds"), F.try_parse_json("view").alias("second_view"), F.col("request_started").alias("started"),
    )
    both = docs.select("id", "prediction", "requested").join(listed, "id", "left").join(second, "id", "left")
    texts = "array<struct<field:string,text:string>>"
    both = both.withColumns(
        {
            "evidence": F.coalesce(F.from_json(F.to_json(_part("prediction", "evidence")), texts), F.array().cast(texts)), "second_evidence": F.coalesce(F.from_json(F.to_json(_part("second", "evidence")), texts), F.array().cast(texts)),
            "answer": _part("prediction", "answer", "string"), "confidence": _part("prediction", "confidence", "double"), "asked": F.coalesce("flagged", F.array().cast("array<string>")), "accepted": F.coalesce("accepted", F.array().cast("array<string>")),
            "tried": F.col("names").isNotNull(), "request_started": F.coalesce("started", F.lit(False)), "latency": _part("prediction", "metadata.latency_seconds", "double"), "second_latency": _part("second", "metadata.latency_seconds", "double"),
            "memory": _part("prediction", "metadata.peak_gpu_memory_gib", "double"), "second_memory": _part("second", "metadata.peak_gpu_memory_gib", "double"),
        }
    )
    tried = F.col("tried")
    out = R.merge_documents(both)
    attempt = {
        "policy": F.lit(policy), "requested_fields": F.when(F.lit(policy == "label-context-v1"), F.col("requested")).otherwise(F.col("asked")), "question": F.col("second_question"), "prediction": F.col("second"),
        "error": F.col("second_error"), "raw_error_output": F.col("second_raw"), "request_started": F.col("request_started"), "accepted_fields": F.col("accepted"), "wall_seconds": F.col("second_seconds"),
    }
    if policy == "percent-crop-v1":
        attempt["view"] = F.col("second_view")
    if policy == "label-context-v1":
        attempt["receipt_profile"] = F.lit(CONTEXT_PROFILE)
    meta = {"model_calls": F.col("model_calls"), "raw_output_scope": F.lit(SCOPE), "recheck_policy": F.lit(policy), "latency_seconds": F.col("latency"), "peak_gpu_memory_gib": F.col("memory")}
    struct = lambda parts: F.parse_json(_json(F.struct(*[v.alias(k) for k, v in parts.items()])))
    # each part as (name, VARIANT), null where the prediction keeps its own
    own = F.from_json(F.to_json("prediction"), "map<string,variant>")
    known = F.from_json(F.to_json(_part("prediction", "metadata")), "map<string,variant>")
    changed = (F.size("accepted") > 0) & tried
    whole = F.parse_json(F.to_json(F.map_concat(F.map_filter(F.coalesce(known, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))), lambda k, v: ~k.isin(*meta)), F.from_json(_json(F.struct(*[v.alias(k) for k, v in meta.items()])), "map<string,variant>"))))
    parts = {
        "fields": F.when(changed, F.parse_json(F.to_json("merged", {"ignoreNullFields": "false"}))), "evidence": F.when(changed, F.parse_json(F.to_json("evidence"))),
        "answer": F.when(changed, F.col("answer").cast("variant")), "confidence": F.when(changed, F.parse_json(F.lit("null"))),
        "review_flags": F.when(_part("prediction", "review_flags").isNull() | tried, F.parse_json(F.coalesce(F.to_json("flags", {"ignoreNullFields": "false"}), F.lit("[]")))),
        "initial_prediction": F.when(tried, F.col("prediction")), "recheck_attempt": F.when(tried, struct(attempt)), "metadata": F.when(tried, whole),
    }
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in parts.items()]), lambda x: x["value"].isNotNull())
    out = out.withColumn("_new", entries)
    replaced = F.map_filter(own, lambda k, v: ~F.exists("_new", lambda x: x["key"] == k))
    return out.select("id", F.to_json(F.map_concat(replaced, F.map_from_entries("_new")), {"ignoreNullFields": "false"}).alias("prediction"))
