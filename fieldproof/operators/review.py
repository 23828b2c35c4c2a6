"""Review flags on predictions, and the merge of a second reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compatible
from ..functions.values import schema_of, settled, text_of
from .parse import FIELD_PATHS

#: Amount fields, reasons, placeholders and policies.
AMOUNT_FIELDS = tuple(FIELD_PATHS)
TEXT_AMOUNT = "string or null"
NOT_TEXT, PERCENT, PLACEHOLDER, NO_DIGITS = (
    "amount_must_be_string", "percentage_is_not_amount", "placeholder_is_not_amount", "amount_has_no_digits",
)
PLACEHOLDERS = ("", "null", "none", "n/a", "nan")
POLICIES = ("none", "invalid-amount-v1", "percent-crop-v1", "label-context-v1")
PERCENT_ONLY = ("percent-crop-v1", "label-context-v1")


def with_reason(df: DataFrame, values: dict[str, str], unicode: bool = True) -> DataFrame:
    """Adds, under each name, why a predicted amount (the VARIANT column of that name's value) needs review, or null.
    Only amounts whose whole rule is the text rule are looked at; labels are never consulted. ``df`` has field and
    rule_text."""
    asked = F.col("field").isin(*AMOUNT_FIELDS) & (F.col("rule_text") == TEXT_AMOUNT)
    df = df.withColumns({f"__{n}_schema": F.when(asked, schema_of(c)) for n, c in values.items()})
    df = df.withColumns({f"__{n}_text": F.when(F.col(f"__{n}_schema") == "STRING", text_of(F.col(c))) for n, c in values.items()})
    df = df.withColumns({f"__{n}_text": compatible(F.col(f"__{n}_text"), unicode) for n in values})

    def shown(n: str) -> Column:
        schema, text = F.col(f"__{n}_schema"), F.col(f"__{n}_text")
        return (
            F.when(schema.isNull() | (schema == "VOID"), F.lit(None).cast("string"))
            .when(schema != "STRING", NOT_TEXT)
            .when(text.contains("%"), PERCENT)
            .when(F.lower(text).isin(*PLACEHOLDERS), PLACEHOLDER)
            .when(~text.rlike("\\p{Nd}"), NO_DIGITS)
        )

    return df.withColumns({n: shown(n) for n in values}).drop(*[f"__{n}_{p}" for n in values for p in ("schema", "text")])


def flags(long: DataFrame, unicode: bool = True) -> DataFrame:
    """(…, field, reason, predicted) of the flagged rows of (id, field, rule_text, predicted VARIANT)."""
    return settled(with_reason(long, {"reason": "predicted"}, unicode), "reason").where("reason is not null")


def asked_again(long: DataFrame, unicode: bool = True) -> DataFrame:
    """Rows whose flag the row's ``policy`` reads again: percentages only for two policies, none for ``none``."""
    flagged = flags(long, unicode)
    return flagged.where((F.col("policy") != "none") & (~F.col("policy").isin(*PERCENT_ONLY) | (F.col("reason") == PERCENT)))


def merge(long: DataFrame, unicode: bool = True) -> DataFrame:
    """Merged value of each field: the second reading's where it was asked for and is acceptable.

    ``long``: id, policy, field, rule_text, predicted, second (VARIANT), second_error. A second value is accepted
    if it has no flag itself (and, for the crop policy, is not null); a failed second request changes nothing.
    Adds asked, accepted, merged, reason (of the first value) and merged_reason."""
    policy = F.col("policy")
    asked = F.col("reason").isNotNull() & (policy != "none") & (~policy.isin(*PERCENT_ONLY) | (F.col("reason") == PERCENT))
    absent = F.col("second").isNull() | F.is_variant_null("second")
    fine = F.col("second_error").isNull() & F.col("_again").isNull() & ~((policy == "percent-crop-v1") & absent)
    out = with_reason(long, {"reason": "predicted", "_again": "second"}, unicode).withColumn("asked", asked).withColumn("accepted", F.col("asked") & fine)
    merged = F.when(F.col("accepted"), F.col("second")).otherwise(F.col("predicted"))
    out = out.withColumn("merged", merged).withColumn("merged_reason", F.when(F.col("accepted"), F.col("_again")).otherwise(F.col("reason")))
    return out.drop("_again")


def exactly_rounded(x: Column, digits: int = 3) -> Column:
    """A double rounded by its exact binary value, ties to even, as Python rounds. ``F.round`` rounds the shortest spelling, so it takes
    0.6625 for a tie where the double lies below it. The fraction is counted in units of 2^-63, which a fraction from 2^-11 on fills exactly;
    a smaller one is far below any half that it could be taken for."""
    unit, whole = F.lit(str(1 << 63)).cast("decimal(19,0)"), F.floor(F.abs(x)).cast("double")
    # by way of an integer: a double becomes a decimal by its shortest spelling
    parts = ((F.abs(x) - whole) * F.lit(float(1 << 63))).cast("bigint").cast("decimal(19,0)") * F.lit(10**digits).cast("decimal(7,0)")
    low = ((parts - parts % unit) / unit).cast("bigint")
    over = 2 * (parts % unit)
    up = (over > unit) | ((over == unit) & (low % 2 == 1))
    size = (whole * 10**digits + low + up.cast("int")) / 10**digits
    return F.when(x < 0, -size).otherwise(size)


def cost(first: Column, second: Column, error: Column, started: Column, summed: bool) -> Column:
    """Latency (summed, three decimals) or memory (the larger): null if either is missing or the second failed."""
    known = error.isNull() & first.isNotNull() & second.isNotNull()
    both = exactly_rounded(first + second) if summed else F.greatest(first, second)
    return F.when(~started, first).when(known, both)


def merge_documents(documents: DataFrame) -> DataFrame:
    """Document columns of a merge: evidence, answer and confidence follow what was accepted.

    ``documents``: id, asked, accepted (arrays of names), evidence, second_evidence (arrays of struct(field, text)),
    answer, confidence, second_error, request_started, latency, second_latency, memory, second_memory. The first
    prediction's columns stay under ``initial``."""
    any_ = F.size("accepted") > 0
    attempted = F.size("asked") > 0
    mine = F.filter("evidence", lambda e: e["field"].isNull() | ~F.array_contains("accepted", e["field"]))
    theirs = F.filter("second_evidence", lambda e: F.coalesce(F.array_contains("accepted", e["field"]), F.lit(False)))
    empty = F.col("second_error")
    return documents.withColumns(
        {
            "initial": F.struct("evidence", "answer", "confidence", "latency", "memory"),
            "evidence": F.when(any_, F.concat(mine, theirs)).otherwise(F.col("evidence")),
            "answer": F.when(any_, F.lit("")).otherwise(F.col("answer")),
            "confidence": F.when(~any_, F.col("confidence")),
            "model_calls": F.when(attempted, 1 + F.col("request_started").cast("int")).otherwise(1),
            "latency": cost(F.col("latency"), F.col("second_latency"), empty, attempted, True),
            "memory": cost(F.col("memory"), F.col("second_memory"), empty, attempted, False),
        }
    )


def central_rows(height: int) -> tuple[int, int]:
    """The first row of the central four fifths, and the row behind them."""
    return height // 10, height - height // 10


def crop_box(width: Column, height: Column) -> Column:
    """The central four fifths by height as struct(left, top, right, bottom); null for no positive size."""
    margin = F.floor(height / 10).cast("int")
    box = F.struct(F.lit(0).alias("left"), margin.alias("top"), width.cast("int").alias("right"), (height - margin).cast("int").alias("bottom"))
    return F.when((width >= 1) & (height >= 1), box)
