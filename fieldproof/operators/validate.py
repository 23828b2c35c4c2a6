"""Admission of datasets and predictions: violations as rows, the first of them as an error."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import base_rule, is_blank_text, is_kind, settled, with_typed
from .review import AMOUNT_FIELDS, POLICIES, TEXT_AMOUNT

#: Messages, profiles and shapes.
NOT_OBJECT = "Row must be an object"
BAD_JSON = "Row is not valid JSON"
BAD_ID = "IDs must be nonempty and unique"
NO_SCHEMA = "field_schema and nonempty expected_fields are required"
NO_RULE = "Every label must have a requested schema field"
BAD_LABEL = "A label does not have its own type"
OUTSIDE = "Image must be inside the dataset directory"
NO_IMAGE = "Image does not exist"
PROFILES = ("baseline", "label-aware-v1", "receipt-compact-v1")
BACKENDS = ("openai", "transformers")
REVISION, REPOSITORY, CHECKSUM = "^[0-9a-f]{40}$", "^[\\w.-]+/[\\w.-]+$", "^([0-9a-f]{40}|[0-9a-f]{64})$"


def _keys(name: str) -> Column:
    return F.coalesce(F.json_object_keys(F.to_json(name)), F.array().cast("array<string>"))


def row_problems(rows: DataFrame) -> DataFrame:
    """(line_no, id, reason) of rows that are not admitted, except for labels' own types and images.

    ``rows``: line_no, row (VARIANT of the line, null if it is no JSON)."""
    got = lambda k, t="variant": F.try_variant_get(F.col("row"), f"$.{k}", t)
    each = rows.withColumns({"id": got("id"), "expected_fields": got("expected_fields"), "field_schema": got("field_schema")})
    name = F.try_variant_get("id", "$", "string")
    # the first in file order stays; its place is found by an aggregate that combines before its shuffle, so that an
    # id that many rows share meets only as a key of a join, which can be split; rows without an id are spread out
    each = each.withColumn("_key", F.coalesce(name, F.concat(F.lit("\x00"), F.col("line_no").cast("string"))))
    first = each.where(name.isNotNull()).groupBy("_key").agg(F.min("line_no").alias("_first"))
    each = each.join(first, "_key", "left").withColumn("_again", name.isNotNull() & (F.col("line_no") > F.col("_first")))
    is_object = lambda c: F.coalesce(is_kind(F.col(c), "object"), F.lit(False))
    reason = (
        F.when(F.col("row").isNull(), BAD_JSON)
        .when(~is_kind(F.col("row"), "object"), NOT_OBJECT)
        .when(is_blank_text(F.col("id")) | F.col("_again"), BAD_ID)
        .when(is_blank_text(got("image")), "Missing image")
        .when(is_blank_text(got("question")), "Missing question")
        .when(~is_object("field_schema") | ~is_object("expected_fields") | (F.size(_keys("expected_fields")) == 0), NO_SCHEMA)
        .when(F.size(F.array_except(_keys("expected_fields"), _keys("field_schema"))) > 0, NO_RULE)
    )
    return each.select("line_no", name.alias("id"), reason.alias("reason")).where("reason is not null")


def label_problems(rows: DataFrame, unicode: bool = True) -> DataFrame:
    """(line_no, id, reason) of admitted rows (line_no, id, field_schema, expected_fields) with a mistyped label.
    Labels are scored as rows, so the fallback for texts beyond ASCII can run."""
    path = F.concat(F.lit("$['"), F.col("field"), F.lit("']"))
    each = rows.select("line_no", "id", "field_schema", "expected_fields", F.explode(_keys("expected_fields")).alias("field"))
    each = with_typed(each, {"_v": F.try_variant_get("expected_fields", path, "variant")}, base_rule(F.try_variant_get("field_schema", path, "variant")), unicode)
    return settled(each, "_v_state").where("_v_state = 'invalid'").select("line_no", "id", F.lit(BAD_LABEL).alias("reason")).distinct()


def missing_images(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(line_no, id, reason) of rows (line_no, id, image) whose relative path has no file in ``files`` (image), or
    that leaves the dataset's directory."""
    parts = F.split("image", "/")
    depth = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda d, p: d + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)))
    outside = F.col("image").startswith("/") | F.exists(depth, lambda d: d < 0)
    away = rows.where(outside).select("line_no", "id", F.lit(OUTSIDE).alias("reason"))
    absent = rows.where(~outside).join(files.select("image"), "image", "left_anti")
    return away.union(absent.select("line_no", "id", F.concat(F.lit(NO_IMAGE + ": "), F.col("image"))))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def absent(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(have.select(key), key, "left_anti")


def require_none(problems: DataFrame, file: str = "dataset") -> None:
    """Raise for the problem on the first line, if there is any."""
    first = problems.orderBy("line_no").limit(1).collect()
    if first:
        raise ValueError(f"{file}:{first[0]['line_no']}: {first[0]['reason']}")


#: Errors of a prediction.
NO_FIELDS_OBJECT = "ValueError: Prediction must contain a fields object"
NOT_FINITE = "ValueError: Out of range float values are not JSON compliant"


def prediction_problem(prediction: Column, huge: Column | None = None) -> Column:
    """An error unless a prediction (VARIANT) holds an object ``fields`` and, by ``huge``, its text no number beyond a
    double (``text.overflows``)."""
    good = F.coalesce(is_kind(F.try_variant_get(prediction, "$.fields", "variant"), "object"), F.lit(False))
    return F.when(~good, F.lit(NO_FIELDS_OBJECT)).when(F.lit(False) if huge is None else huge, F.lit(NOT_FINITE))


def check_selection(offset: int = 0, limit: int | None = None) -> None:
    if offset < 0:
        raise ValueError("--offset must be nonnegative")
    if limit is not None and limit < 1:
        raise ValueError("--limit must be positive")


def check_names(profile: str = "baseline", policy: str = "none", backend: str | None = None) -> None:
    if profile not in PROFILES:
        raise ValueError("the receipt profile must be one of: " + ", ".join(PROFILES))
    if policy not in POLICIES:
        raise ValueError("Unknown recheck policy")
    if backend is not None and backend not in BACKENDS:
        raise ValueError("the backend must be one of: " + ", ".join(BACKENDS))


def untexted_amounts(rules: DataFrame) -> DataFrame:
    """Amount fields of (id, field, rule_text) whose rule is not the text rule; profiles other than the baseline
    need that there are none."""
    return rules.where(F.col("field").isin(*AMOUNT_FIELDS) & ~F.col("rule_text").eqNullSafe(F.lit(TEXT_AMOUNT)))


def precondition(rows: DataFrame, examples: int, constant: tuple[str, ...] = ("question", "field_schema")) -> DataFrame:
    """One row with ``reason``: why a dataset is not the full one of one task (its size, or a column that should be
    the same in all rows), or null. Columns are compared as text."""
    text = lambda c: F.to_json(c) if rows.schema[c].dataType.typeName() == "variant" else F.col(c).cast("string")
    seen = rows.agg(F.count("*").alias("n"), *[(F.coalesce(F.min(text(c)).eqNullSafe(F.max(text(c))), F.lit(True)) & (F.count(c).isin(0) | (F.count(c) == F.count("*")))).alias(f"c_{c}") for c in constant])
    reason = F.when(F.col("n") != examples, F.lit("not the full dataset"))
    for c in constant:
        reason = reason.when(~F.col(f"c_{c}"), F.lit(f"more than one {c}"))
    return seen.select(reason.alias("reason"))


def manifest_problems(files: DataFrame) -> DataFrame:
    """(file, reason) of an integrity manifest's entries (revision, repository, file, checksum)."""
    path = F.col("file")
    reason = (
        F.when(~F.col("revision").rlike(REVISION), "revision is not immutable")
        .when(~F.col("repository").rlike(REPOSITORY), "repository is not owner/name")
        .when(path.startswith("/") | F.array_contains(F.split(path, "/"), ".."), "path leaves the snapshot")
        .when(~F.col("checksum").rlike(CHECKSUM), "checksum has neither 40 nor 64 digits")
    )
    return files.select("file", reason.alias("reason")).where("reason is not null")


def integrity_problems(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """(file, reason) where (file, size, checksum) and the files found (file, length, sha256, blob_sha1) differ."""
    found = F.when(F.length("checksum") == 64, F.col("sha256")).otherwise(F.col("blob_sha1"))
    both = manifest.join(actual, "file", "left")
    reason = F.when(F.col("length").isNull(), "missing").when((F.col("size") != F.col("length")) | (F.col("checksum") != found), "checksum mismatch")
    return both.select("file", reason.alias("reason")).where("reason is not null")


def new_directory(path: str | Path) -> Path:
    """A directory that did not exist before."""
    path = Path(path)
    if path.exists():
        raise ValueError("Output already exists; choose a new directory")
    path.mkdir(parents=True)
    return path
