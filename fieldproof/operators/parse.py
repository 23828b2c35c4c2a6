"""Parsing model text into fields, and nested labels into flat ones. Errors are columns; no task ever raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import is_kind, schema_of, text_of

#: Messages, the fence pattern and the label paths.
EMPTY = "The model returned an empty response."
NO_OBJECT = "The response did not contain a valid JSON object."
NOT_FIELDS = "The fields property must be an object."
NO_FIELDS = "No requested field object was found."
NO_NAMES = "The fields object contains no requested field names."
NO_TRUTH = "CORD row has no gt_parse object"
REPEATED_GROUP = "Ambiguous repeated label group: "
NO_TEXT_LABEL = "Ambiguous/nontext CORD label: "
NO_LABELS = "No labelled amounts in the selected task"
FENCE = "(?is)```(?:json)?\\s*(\\{.*?\\})\\s*```"
FIELD_PATHS = {
    "subtotal_amount": ("sub_total", "subtotal_price"),
    "tax_amount": ("sub_total", "tax_price"),
    "service_charge": ("sub_total", "service_price"),
    "total_amount": ("total", "total_price"),
    "cash_amount": ("total", "cashprice"),
    "change_amount": ("total", "changeprice"),
}


def unfenced(raw: Column) -> Column:
    """What the first fenced block holds, else the trimmed text."""
    return F.coalesce(F.nullif(F.regexp_extract(raw, FENCE, 1), F.lit("")), F.regexp_replace(raw, "(?U)^\\s+|\\s+$", ""))


#: Before a brace that may open an object: white space of JSON, then a key or the end must follow.
OPENING = "(?=\\{[ \\t\\n\\r]*+[\"}])"


def first_object(text: Column, scan: bool = True) -> Column:
    """Text of the first JSON object, from its brace on. Where the first brace opens none, each later one that a key or a
    closing brace follows is tried in turn, up to the first that opens an object; all of it by built-ins. A try costs a copy
    of the text behind it, and what stands behind the last closing brace is not looked at. Objects nested deeper than
    JSON readers go (1,000 levels), and those with literals that JSON lacks (NaN), open nothing."""
    from_brace = F.when(F.instr(text, "{") > 0, F.substr(text, F.instr(text, "{")))
    # what begins with a brace and can be read is an object
    opens = lambda t: F.try_parse_json(t).isNotNull()
    found = opens(from_brace)
    if not scan:
        return F.when(found, from_brace)
    # the text cut before each such brace: what the n-th opens is the rest from there on
    pieces = F.split(F.regexp_extract(from_brace, "(?s)^.*\\}", 0), OPENING)
    rest = lambda n: F.array_join(F.slice(pieces, n, F.size(pieces)), "")
    later = F.aggregate(F.sequence(F.lit(1), F.size(pieces)), F.lit(None).cast("string"), lambda got, n: F.coalesce(got, F.when(opens(rest(n)), rest(n))))
    return F.when(found, from_brace).otherwise(later)


def confidence(schema: Column, v: Column) -> Column:
    """Of a VARIANT and its schema: clamped to [0, 1]; 0 for what is no finite number. Numeric texts count, true is 1."""
    number = (
        F.when(schema == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double"))
        .when(schema == "STRING", F.trim(text_of(v)).try_cast("double"))
        .otherwise(F.try_variant_get(v, "$", "double"))
    )
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))).otherwise(F.lit(0.0))


def _list_or_empty(name: str) -> Column:
    got = F.try_variant_get(F.col("_object"), f"$.{name}", "variant")
    return F.when(is_kind(got, "array"), got).otherwise(F.parse_json(F.lit("[]")))


def answer(schema: Column, v: Column) -> Column:
    """Of a VARIANT and its schema: its text; empty for what Python takes for false."""
    shown = F.when(schema == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), F.lit("True"))).when(schema == "STRING", text_of(v))
    zero = F.coalesce(F.try_variant_get(v, "$", "double") == 0, F.lit(False))
    other = F.when(~zero & (schema != "VOID"), F.nullif(F.nullif(F.to_json(v), F.lit("[]")), F.lit("{}")))
    return F.coalesce(F.when(schema.isin("BOOLEAN", "STRING"), shown).otherwise(other), F.lit(""))


def parse_output(df: DataFrame, raw: str = "raw_output", requested: str = "requested", scan: bool = True) -> DataFrame:
    """Adds fields (VARIANT), field_names, parse_error, document_type, answer, evidence, uncertainties, confidence.

    ``requested`` holds the requested names. Fields lie under ``fields``, which must be an object, or, where there
    is no such key, beside it if any requested name does. A non-empty fields object without a requested name is
    an error; an empty one means that all are null. The raw text stays. What is used twice is a column first, so
    each text is searched, and each object parsed, once a step."""
    blank = F.col(raw).isNull() | ~F.coalesce(F.col(raw).rlike("[^\\s\\x1c-\\x1f\\x85]"), F.lit(False))
    df = df.withColumn("_text", unfenced(F.col(raw))).withColumn("_body", first_object(F.col("_text"), scan)).withColumn("_object", F.try_parse_json("_body"))
    part = lambda name: F.try_variant_get(F.col("_object"), f"$.{name}", "variant")
    df = df.withColumns({"_keys": F.coalesce(F.json_object_keys("_body"), F.array().cast("array<string>")), "_fields": part("fields"), "_confidence": part("confidence"), "_answer": part("answer")})
    df = df.withColumns(
        {
            "_nested": F.array_contains("_keys", "fields"), "_fields_schema": schema_of("_fields"),
            "_confidence_schema": schema_of("_confidence"), "_answer_schema": schema_of("_answer"),
            "_inner": F.coalesce(F.json_object_keys(F.to_json("_fields")), F.array().cast("array<string>")),
        }
    )
    nested = F.col("_nested")
    names = F.size(F.coalesce(F.col(requested), F.array().cast("array<string>"))) > 0
    error = (
        F.when(blank, EMPTY)
        .when(F.col("_object").isNull(), NO_OBJECT)
        .when(nested & ~F.coalesce(F.col("_fields_schema").startswith("OBJECT"), F.lit(False)), NOT_FIELDS)
        .when(~nested & ~(names & F.coalesce(F.arrays_overlap("_keys", requested), F.lit(False))), NO_FIELDS)
        .when(nested & names & (F.size("_inner") > 0) & ~F.coalesce(F.arrays_overlap("_inner", F.col(requested)), F.lit(False)), NO_NAMES)
    )
    df = df.withColumn("parse_error", error)
    ok = F.col("parse_error").isNull()
    return df.withColumns(
        {
            "fields": F.when(ok, F.when(nested, F.col("_fields")).otherwise(F.col("_object"))),
            "document_type": F.when(ok, part("document_type")),
            "answer": F.when(ok, answer(F.col("_answer_schema"), F.col("_answer"))),
            "evidence": F.when(ok, _list_or_empty("evidence")),
            "uncertainties": F.when(ok, _list_or_empty("uncertainties")),
            "confidence": F.when(ok, confidence(F.col("_confidence_schema"), F.col("_confidence"))),
        }
    ).drop("_text", "_body", "_object", "_keys", "_fields", "_confidence", "_answer", "_nested", "_fields_schema", "_confidence_schema", "_answer_schema", "_inner")


def field_value(fields: Column, name: Column) -> Column:
    """One requested field; null where it is missing."""
    return F.try_variant_get(fields, F.concat(F.lit("$['"), name, F.lit("']")), "variant")


def map_labels(df: DataFrame, truth: str = "ground_truth") -> DataFrame:
    """Adds expected (map of field to text) and reject (reason or null) from nested labels, given as JSON text or
    as VARIANT. A missing label is skipped; a group that is no object, a label that is no text or blank, and a
    row without any label are rejected, for the first reason in the order of the fields."""
    given = F.col(truth) if df.schema[truth].dataType.typeName() == "variant" else F.try_parse_json(truth)
    df = df.withColumn("_gt", F.try_variant_get(given, "$.gt_parse", "variant"))
    at = lambda path: F.try_variant_get("_gt", path, "variant")
    groups = list(dict.fromkeys(group for group, _ in FIELD_PATHS.values()))
    # one look at each group and at each label, then one at what was seen of them
    df = df.withColumns(
        {"_gt_schema": schema_of("_gt")}
        | {f"_is_{g}": schema_of(at(f"$.{g}")) for g in groups}
        | {f"_as_{f}": schema_of(at(f"$.{g}.{k}")) for f, (g, k) in FIELD_PATHS.items()}
        | {f"_of_{f}": F.try_variant_get("_gt", f"$.{g}.{k}", "string") for f, (g, k) in FIELD_PATHS.items()}
    )
    no, problems = F.lit(False), []
    written = lambda f: F.coalesce((F.col(f"_as_{f}") == "STRING") & F.col(f"_of_{f}").rlike("[^\\s\\x1c-\\x1f\\x85]"), no)
    df = df.withColumns({f"_has_{f}": written(f) for f in FIELD_PATHS})
    for f, (g, k) in FIELD_PATHS.items():
        group, label = F.col(f"_is_{g}"), F.col(f"_as_{f}")
        problems.append(F.when(group.isNotNull() & ~group.startswith("OBJECT"), REPEATED_GROUP + g))
        problems.append(F.when(label.isNotNull() & (label != "VOID") & ~F.col(f"_has_{f}"), f"{NO_TEXT_LABEL}{g}.{k}"))
    truth_missing = F.when(~F.coalesce(F.col("_gt_schema").startswith("OBJECT"), no), NO_TRUTH)
    none = F.when(~F.greatest(*[F.col(f"_has_{f}") for f in FIELD_PATHS]), NO_LABELS)
    df = df.withColumn("reject", F.coalesce(truth_missing, *problems, none))
    entries = F.filter(F.array(*[F.struct(F.lit(f).alias("key"), F.when(F.col(f"_has_{f}"), F.col(f"_of_{f}")).alias("value")) for f in FIELD_PATHS]), lambda x: x["value"].isNotNull())
    spare = [f"_{p}_{f}" for f in FIELD_PATHS for p in ("as", "of", "has")] + [f"_is_{g}" for g in groups]
    return df.withColumn("expected", F.when(F.col("reject").isNull(), F.map_from_entries(entries))).drop("_gt", "_gt_schema", *spare)
