"""Run comparison: guards in a fixed order, then paired changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The guards' messages, in the order in which they are tried.
TOO_FEW = "At least two runs are required"
NOT_LIVE = "Only completed live runs can be compared as model benchmarks"
FINGERPRINTS = "Different dataset fingerprints"
SELECTIONS = "Different document selections"
VERSIONS = "Different report versions"
SOURCES = "Different evaluation code; re-run with the same version"
RESULTS = "Run results do not match the recorded document selection"
FIELDS = "Different scored fields"


def guard(runs: DataFrame) -> DataFrame:
    """One row with ``reason``: the first guard that fails, or null. ``runs``: pos, mode, complete, fingerprint,
    selected_ids, report_version, source_sha256. Runs are tried in their order, each against the first."""
    columns = ("pos", "mode", "complete", "fingerprint", "selected_ids", "report_version", "source_sha256")
    # the runs that are compared are few, so one row holds them all
    listed = runs.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("r"))

    def reason(x: Column) -> Column:
        first = F.get("r", F.lit(0))
        differs = lambda c: ~x[c].eqNullSafe(first[c])
        return (
            F.when(~F.coalesce((x["mode"] == "live") & x["complete"], F.lit(False)), NOT_LIVE)
            .when(differs("fingerprint"), FINGERPRINTS)
            .when(differs("selected_ids"), SELECTIONS)
            .when(differs("report_version"), VERSIONS)
            .when(differs("source_sha256"), SOURCES)
        )

    reasons = F.filter(F.transform("r", reason), lambda x: x.isNotNull())
    return listed.select(F.when(F.size("r") < 2, TOO_FEW).otherwise(F.get(reasons, F.lit(0))).alias("reason"))


def result_problems(results: DataFrame, selected: DataFrame) -> DataFrame:
    """(run_id, id, problem): repeated, missing and unselected results of (run_id, id)."""
    counted = results.groupBy("run_id", "id").agg(F.count("*").alias("n"))
    both = counted.join(selected.select("run_id", "id", F.lit(True).alias("wanted")), ["run_id", "id"], "full")
    problem = F.when(F.col("n") > 1, "repeated").when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unselected")
    return both.select("run_id", "id", problem.alias("problem")).where("problem is not null")


def unpaired_fields(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, field) that one run scored and the other did not."""
    a, b = before.select("id", "field"), after.select("id", "field")
    return a.join(b, ["id", "field"], "left_anti").union(b.join(a, ["id", "field"], "left_anti"))


def paired(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, field, was, now_) of the fields that both runs scored, once each. Both runs go through one aggregate, which
    needs no sort; rows of a run meet its own rows of the same field only there."""
    of = lambda run, first: run.select("id", "field", F.when(F.lit(first), F.col("correct")).alias("was"), F.when(F.lit(not first), F.col("correct")).alias("now_"))
    both = of(before, True).union(of(after, False)).groupBy("id", "field").agg(F.max("was").alias("was"), F.max("now_").alias("now_"))
    return both.where("was is not null and now_ is not null")


def paired_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(field, improved, regressed) over the fields that both runs scored; fields without a change stay, as 0."""
    return paired(before, after).groupBy("field").agg(F.count_if(~F.col("was") & F.col("now_")).alias("improved"), F.count_if(F.col("was") & ~F.col("now_")).alias("regressed"))


def field_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, field, before, after, improved) of the fields whose correctness changed, one of each (id, field) a run.
    Values travel only with fields that are wrong in one run and right in the other."""
    a = before.select("id", "field", F.col("predicted").alias("before"), F.col("correct").alias("was"))
    b = after.select("id", "field", F.col("predicted").alias("after"), F.col("correct").alias("now_"))
    changed = a.join(b, (a["id"] == b["id"]) & (a["field"] == b["field"]) & (a["was"] != b["now_"]))
    return changed.select(a["id"], a["field"], "before", "after", F.col("now_").alias("improved"))
