"""Comparison of completed live runs, from their tables of facts."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare as C
from ..operators.metrics import report_order
from ..operators.select import order_digest
from ..sources import readers, sinks


def facts_of(spark: SparkSession, path: Path) -> DataFrame:
    """(id, doc_pos, pos, field, correct) of the run whose run.json this is: its facts, or, where only run.json was kept,
    its records."""
    if (path.parent / "facts").exists():
        return sinks.read_facts(spark, path.parent / "facts").select("id", "doc_pos", "pos", "field", "correct")
    shape = "results array<struct<id:string,score:struct<field_results:string>>>"
    text = spark.read.text(str(path), wholetext=True).select(F.from_json("value", shape).alias("run"))
    each = text.select(F.posexplode("run.results").alias("doc_pos", "r")).select("doc_pos", "r.id", F.col("r.score.field_results").alias("found"))
    each = each.select("id", "doc_pos", "found", F.posexplode(F.json_object_keys("found")).alias("pos", "field"))
    return each.select("id", "doc_pos", "pos", "field", F.element_at(F.from_json("found", "map<string,boolean>"), F.col("field")).alias("correct"))


def compare(spark: SparkSession, paths: list[str | Path]) -> str:
    """Markdown of runs that may be compared; raises for the first guard that fails."""
    paths = [Path(p) for p in paths]
    runs = [sinks.run_head(p) for p in paths]
    # ids and records are read where a run has no digest, or no tables beside it
    kept = all("selected_digest" in r["dataset"] for r in runs)
    runs = [r if kept and (p.parent / "facts").exists() and (p.parent / "documents").exists() else json.loads(p.read_text(encoding="utf-8")) for r, p in zip(runs, paths, strict=True)]
    shape = "pos int, mode string, complete boolean, fingerprint string, selected_ids array<string>, report_version int, source_sha256 string"
    # digests of the selections, where all runs have them; a run that lists no ids has one
    short = all("selected_digest" in r["dataset"] for r in runs)
    picked = lambda r: [r["dataset"]["selected_digest"]] if short else r["dataset"]["selected_ids"]
    heads = [(i, r.get("mode"), bool(r.get("complete")), r["dataset"]["fingerprint"], picked(r), r.get("report_version"), r["runtime"]["source_sha256"]) for i, r in enumerate(runs)]
    heads = spark.createDataFrame(heads, shape)
    reason = C.guard(heads).first()["reason"]
    if reason:
        raise ValueError(reason)
    facts = [facts_of(spark, p).withColumn("run_id", F.lit(i)) for i, p in enumerate(paths)]
    for i, (run, path) in enumerate(zip(runs, paths, strict=True)):
        if "selected_ids" not in run["dataset"]:
            # its documents, each with its place, make the digest of the selection
            if order_digest(sinks.read_documents(spark, path.parent / "documents"), "doc_pos", "id").first()["digest"] != run["dataset"]["selected_digest"]:
                raise ValueError(C.RESULTS)
            wanted = spark.read.parquet(str(path.parent / "documents")).select("id")
        else:
            wanted = spark.createDataFrame([(i,) for i in run["dataset"]["selected_ids"]], "id string")
        if not C.result_problems(facts[i].select("run_id", "id").distinct(), wanted.select(F.lit(i).alias("run_id"), "id")).isEmpty():
            raise ValueError(C.RESULTS)
    names = [r["field"] for r in sorted(report_order(facts[0]).collect(), key=lambda r: tuple(r["first"]))]
    changes = []
    for later in facts[1:]:
        if not C.unpaired_fields(facts[0], later).isEmpty():
            raise ValueError(C.FIELDS)
        found = {r["field"]: {"improved": r["improved"], "regressed": r["regressed"]} for r in C.paired_changes(facts[0], later).collect()}
        changes.append({k: found[k] for k in names})
    return sinks.comparison(runs, changes)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Compare completed live runs of one selection.")
    parser.add_argument("runs", nargs="+", type=Path, help="run.json of each run")
    args = parser.parse_args(argv)
    try:
        print(compare(readers.session(), args.runs))
    except (ValueError, OSError, KeyError) as e:
        parser.exit(2, f"Cannot compare: {e}\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
