"""Aggregates over the fact table and over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import percentiles


def _share(a, b):
    return F.try_divide(a.cast("double"), b.cast("double"))


def field_accuracy(long: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """correct_fields, total_fields, field_accuracy and present_field_accuracy; null for nothing scored."""
    right, all_ = F.count_if("correct"), F.count("*")
    present, present_right = F.count_if("expected_present"), F.count_if(F.col("expected_present") & F.col("correct"))
    return long.groupBy(*by).agg(
        right.alias("correct_fields"), all_.alias("total_fields"), _share(right, all_).alias("field_accuracy"),
        _share(present_right, present).alias("present_field_accuracy"),
    )


def per_field(long: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """correct, total and accuracy of each field, and of all (field is null), in one pass over both grains."""
    right, all_ = F.count_if("correct"), F.count("*")
    keys = [F.col(c) for c in by]
    grouped = long.groupingSets([[*keys, F.col("field")], keys], *keys, F.col("field"))
    return grouped.agg(right.alias("correct"), all_.alias("total"), _share(right, all_).alias("accuracy"))


def report_order(long: DataFrame) -> DataFrame:
    """Fields with the first place at which they stand."""
    return long.groupBy("field").agg(F.min(F.struct("doc_pos", "pos")).alias("first"))


def error_categories(long: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return long.where(~F.col("correct")).groupBy(*by, "category").agg(F.count("*").alias("n"))


def document_accuracy(long: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of documents with every labelled field right and no error."""
    each = long.groupBy(*by, "id").agg(F.bool_and(F.col("correct") & F.col("error").isNull()).alias("whole"))
    right, all_ = F.count_if("whole"), F.count("*")
    return each.groupBy(*by).agg(right.alias("whole_documents"), all_.alias("documents"), _share(right, all_).alias("document_accuracy"))


def counters(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Document counters and the mean wall time of successes. ``results``: error, n_flags, recheck_started
    (an attempt was made), recheck_error, wall_seconds."""
    return results.groupBy(*by).agg(
        F.count("*").alias("examples"),
        F.count_if(F.col("error").isNotNull()).alias("failed_examples"),
        F.count_if(F.col("error").isNull() & (F.col("n_flags") > 0)).alias("review_flagged_examples"),
        F.count_if("recheck_started").alias("rechecked_examples"),
        F.count_if(F.col("recheck_started") & F.col("recheck_error").isNotNull()).alias("failed_rechecks"),
        F.avg(F.when(F.col("error").isNull(), F.col("wall_seconds"))).alias("successful_examples_mean_wall_seconds"),
    )


def latency(results: DataFrame, by: tuple[str, ...] = (), accuracy: int | None = None) -> DataFrame:
    """Mean, median, 95th percentile (linear between neighbours) and the largest memory of successes.

    Percentiles are exact and found by counts of ranges (``ranks``), so no task holds a group's times; they cost a few passes over a
    narrow table. With ``accuracy`` they are estimated in one pass instead: observed times whose rank is off by at most one in
    ``accuracy``."""
    good = results.where("error is null")
    wall = F.col("wall_seconds").cast("double")
    if accuracy is not None:
        near = lambda q: F.percentile_approx(wall, q, accuracy)
        return good.groupBy(*by).agg(F.avg(wall).alias("mean_seconds"), near(0.5).alias("median_seconds"), near(0.95).alias("p95_seconds"), F.max("memory").alias("max_memory"))
    means = good.groupBy(*by).agg(F.avg(wall).alias("mean_seconds"), F.max("memory").alias("max_memory"))
    placed = percentiles(good, "wall_seconds", by, {"median_seconds": 0.5, "p95_seconds": 0.95}).drop("n")
    keys = {c: f"_of_{c}" for c in by}
    placed = placed.withColumnsRenamed(keys).withColumn("_one", F.lit(1))
    one = means.withColumn("_one", F.lit(1))  # each side has a row per group
    on = [one["_one"] == placed["_one"], *[one[c].eqNullSafe(placed[k]) for c, k in keys.items()]]
    return one.join(placed, on, "left").select(*by, "mean_seconds", "median_seconds", "p95_seconds", "max_memory")


def relative(runs: DataFrame, base: str, other: str) -> DataFrame:
    """Differences of two runs of (run_id, field_accuracy, mean_seconds, memory): points, and shares of the base."""
    of = lambda run, c: F.max(F.when(F.col("run_id") == run, F.col(c)))
    change = lambda c: F.try_divide(of(other, c) - of(base, c), of(base, c))
    points = of(other, "field_accuracy") - of(base, "field_accuracy")
    return runs.agg(points.alias("accuracy_points"), change("mean_seconds").alias("seconds_change"), change("memory").alias("memory_change"))
