"""Evaluation of a dataset from start to end: live, dry run or replay.

A run is a new directory. ``facts`` (one row per labelled field) and ``documents`` (one row per document) are Parquet and
hold all that comparisons and aggregates read; run.json, the JSON lines, the sheets and the summary are exports for
people, written one partition at a time.
"""

from __future__ import annotations

import argparse
import hashlib
import importlib
import json
import tempfile
from collections.abc import Callable
from datetime import datetime, timezone
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import is_kind
from ..operators import metrics as M
from ..operators import validate as V
from ..operators.infer import Analyzer, infer
from ..operators.score import details, per_document
from ..operators.select import SPLIT_LIMITS, offset_limit, order_digest
from ..session import drop, durable, new_path, ship
from ..sources import readers, sinks
from .recheck import answers, reread

#: Messages.
EMPTY = "Dataset is empty"
EMPTY_SELECTION = "Document selection is empty"
DUPLICATES = "Duplicate prediction IDs"
INCOMPLETE = "Saved predictions are missing selected dataset IDs"
NO_MANIFEST = "Replay requires the source run.json beside predictions.jsonl"
OTHER_DATASET = "Saved predictions use a different dataset fingerprint"
NO_FIXTURES = "--dry-run requires fixtures; it cannot evaluate real data"
NO_ANALYZER = "a live run needs --analyzer module:name"
RECORDED = "Recorded failure: "


def load(spark: SparkSession, path: str | Path, listed: bool | Path = True) -> tuple[DataFrame, dict]:
    """Admitted annotations in file order (with doc_pos) and the dataset's fingerprints; raises for the first bad line. ``listed``: with
    every image's hash, or, given a folder, with ``sinks.Lines`` of them there."""
    path = Path(path).resolve()
    rows = readers.annotations(spark, str(path)).persist()
    V.require_none(V.row_problems(rows.select("line_no", "row")), path.name)
    files = readers.binaries(spark, str(path.parent)).select("file", "sha256")
    wanted = rows.select("line_no", "id", "image")
    labels = V.label_problems(rows)
    V.require_none(labels.union(V.missing_images(wanted, files.withColumnRenamed("file", "image"))), path.name)
    if rows.isEmpty():
        raise ValueError(EMPTY)
    return rows, sinks.fingerprint(path, wanted.join(files, F.col("image") == F.col("file")), listed)


def select(rows: DataFrame, info: dict, offset: int = 0, limit: int | None = None, listed: bool | Path = True) -> tuple[DataFrame, dict]:
    """The selected rows, and what run.json says of them: a digest of which ids stand at which places, and, if ``listed``, all ids; given a
    folder, as ``sinks.Lines`` there."""
    V.check_selection(offset, limit)
    chosen = offset_limit(rows, offset, limit)
    seen = order_digest(chosen, "line_no", "id").first()
    if not seen["n"]:
        raise ValueError(EMPTY_SELECTION)
    said = {"selection": {"offset": offset, "limit": limit, "order": "annotation file order"}, "selected_examples": seen["n"], "selected_digest": seen["digest"]}
    if listed:
        ids = (r["id"] for r in chosen.select("id", "line_no").orderBy("line_no").toLocalIterator())
        if isinstance(listed, Path):
            said["selected_ids"] = sinks.Lines(listed / "selected_ids")
            with said["selected_ids"].path.open("w", encoding="utf-8") as out:
                out.writelines(json.dumps(i) + "\n" for i in ids)
        else:
            said["selected_ids"] = list(ids)
    return chosen.withColumn("doc_pos", F.col("line_no")), info | said


def replayed(rows: DataFrame, saved: DataFrame) -> DataFrame:
    """(id, prediction, error, …) of the selected rows; recorded failures stay failures."""
    if not V.duplicates(saved, "id").isEmpty():
        raise ValueError(DUPLICATES)
    if not V.absent(rows, saved, "id").isEmpty():
        raise ValueError(INCOMPLETE)
    failed = F.when(F.col("recorded_error").isNotNull(), F.concat(F.lit("ValueError: " + RECORDED), F.col("recorded_error")))
    return rows.select("id").join(saved, "id").select("id", "prediction", failed.alias("error"), "wall_seconds", F.lit(None).cast("string").alias("raw_error_output"), "huge")


def results(rows: DataFrame, predicted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fact table, documents) of rows and their predictions (id, prediction VARIANT, error, wall_seconds, huge)."""
    both = rows.drop("huge").join(predicted, "id")
    error = F.coalesce("error", V.prediction_problem(F.col("prediction"), F.col("huge")))
    documents = both.withColumn("error", error).withColumn("fields", F.when(error.isNull(), F.try_variant_get("prediction", "$.fields", "variant")))
    return details(documents), documents


def flagged(documents: DataFrame) -> DataFrame:
    """Flags in the predictions, one row each."""
    recorded = F.from_json(F.to_json(F.try_variant_get("prediction", "$.review_flags", "variant")), "array<struct<field:string,reason:string,value:variant>>")
    each = documents.where("error is null").select("id", "image", "doc_pos", F.posexplode(recorded).alias("pos", "f"))
    return each.select("id", "image", "doc_pos", "pos", "f.field", "f.reason", F.col("f.value").alias("predicted"))


def summarise(long: DataFrame, documents: DataFrame) -> dict:
    """All metrics of a run; each is a small aggregate."""
    attempt = F.try_variant_get("prediction", "$.recheck_attempt", "variant")
    n_flags = F.size(F.coalesce(F.from_json(F.to_json(F.try_variant_get("prediction", "$.review_flags", "variant")), "array<variant>"), F.array().cast("array<variant>")))
    failed = F.nullif(F.try_variant_get("prediction", "$.recheck_attempt.error", "string"), F.lit(""))
    fine = F.col("error").isNull()
    counted = documents.select("error", F.when(fine, n_flags).otherwise(0).alias("n_flags"), (fine & F.coalesce(is_kind(attempt, "object"), F.lit(False))).alias("recheck_started"), failed.alias("recheck_error"), "wall_seconds")
    c = M.counters(counted).first().asDict()
    a = M.field_accuracy(long).first().asDict()
    d = M.document_accuracy(long).first()
    fields = {r["field"]: {"correct": r["correct"], "total": r["total"], "accuracy": r["accuracy"]} for r in M.per_field(long).where("field is not null").collect()}
    categories = {r["category"]: r["n"] for r in M.error_categories(long).collect()}
    mean = c.pop("successful_examples_mean_wall_seconds")
    return {
        **c, **a, "document_accuracy": d["document_accuracy"] if d else None, "per_field": {k: fields[k] for k in ordered_fields(long)},
        "error_categories": categories, "performance": {"successful_examples_mean_wall_seconds": mean},
    }


def ordered_fields(long: DataFrame) -> list[str]:
    """Names of fields in the order of the first document that has each."""
    return [r["field"] for r in sorted(M.report_order(long).collect(), key=lambda r: tuple(r["first"]))]


def live(rows: DataFrame, root: Path, analyzer: Callable[[], Analyzer], policy: str, ledger: str, salt: str) -> DataFrame:
    """(id, prediction as JSON, error, …) of an analyzer: texts parsed, amounts reviewed, flagged ones read again. Each answer is in the
    ledger before the next document is asked, and what the ledger holds is not asked for again."""
    asked = rows.select("id", F.concat(F.lit(f"{root}/"), F.col("image")).alias("image"), "question", F.to_json("field_schema").alias("field_schema"))
    first = durable(answers(infer(asked, analyzer, ledger, salt), asked), "answers")
    good = first.where("error is null").select("id", F.try_parse_json("prediction").alias("prediction"))
    good = good.where(V.prediction_problem(F.col("prediction")).isNull())
    reviewed = reread(rows.select("id", F.concat(F.lit(f"{root}/"), F.col("image")).alias("image"), "question", "field_schema", "requested").join(good, "id"), analyzer, policy, ledger=ledger, salt=salt)
    both = first.join(reviewed.withColumnRenamed("prediction", "reviewed"), "id", "left")
    return both.select("id", F.coalesce("reviewed", "prediction").alias("prediction"), "error", "wall_seconds", "raw_error_output", F.lit(False).alias("huge"))


def evaluate(
    spark: SparkSession, dataset: str | Path, output: str | Path, mode: str = "dry-run", saved: str | Path | None = None,
    analyzer: Callable[[], Analyzer] | None = None, offset: int = 0, limit: int | None = None, policy: str = "none", records: bool = True, ledger: str | Path | None = None, returned: bool = True,
) -> dict:
    """One run into a new directory: run.json (incomplete first), facts and documents, predictions.jsonl, errors.csv,
    review-flags.csv, summary.md. ``policy`` is the second reading of a live run. ``records=False`` leaves the
    documents' records, the selected ids and the images' hashes out of run.json, where nobody wants them. ``returned=False`` leaves the same out of what is returned, not of
    run.json, so that the driver never holds them. ``ledger``: a folder for a live run's answers, which a later
    run over the same data with the same analyzer goes on from; without one, a run has a ledger of its own."""
    ship(spark)
    V.check_names(policy=policy)
    with tempfile.TemporaryDirectory(prefix="fieldproof-lists-") as folder:
        run = _evaluate(spark, dataset, output, mode, saved, analyzer, offset, limit, policy, ledger, Path(folder) if records else False)
        if returned:
            return _held(run) | {"dataset": _held(run["dataset"])}
        return {k: [] if isinstance(v, sinks.Lines) else v for k, v in run.items()} | {"dataset": {k: v for k, v in run["dataset"].items() if not isinstance(v, sinks.Lines)}}


def _held(part: dict) -> dict:
    return {k: v.held() if isinstance(v, sinks.Lines) else v for k, v in part.items()}


def _evaluate(spark, dataset, output, mode, saved, analyzer, offset, limit, policy, ledger, records: Path | bool) -> dict:
    rows, info = load(spark, dataset, records)
    rows, info = select(rows, info, offset, limit, records)
    configuration: dict = {}
    nothing = F.lit(None).cast("string")
    if mode == "dry-run":
        if not rows.where(~F.coalesce(is_kind(F.col("mock_response"), "object"), F.lit(False))).isEmpty():
            raise ValueError(NO_FIXTURES)
        predicted = readers.mock(rows).withColumns({"error": nothing, "wall_seconds": F.lit(0.0), "raw_error_output": nothing})
    elif mode == "replay":
        beside = Path(saved).parent / "run.json"
        predicted = replayed(rows, readers.predictions(spark, str(saved)))
        if not beside.exists():
            raise ValueError(NO_MANIFEST)
        source = sinks.run_head(beside)
        if source["dataset"]["fingerprint"] != info["fingerprint"]:
            raise ValueError(OTHER_DATASET)
        with Path(saved).open("rb") as stream:
            digest = hashlib.file_digest(stream, "sha256").hexdigest()
        configuration = {"source_mode": source["mode"], "source_configuration": source["configuration"], "predictions_sha256": digest}
    else:
        if analyzer is None:
            raise ValueError(NO_ANALYZER)
        model = analyzer().describe()
        configuration, salt = model | {"receipt_recheck": policy}, json.dumps([model, info["fingerprint"]], sort_keys=True)
        predicted = live(rows, Path(dataset).resolve().parent, analyzer, policy, str(Path(ledger).resolve()) if ledger else new_path(spark, "ledger"), salt)
    output = V.new_directory(output)
    run = sinks.manifest(mode, info, configuration, sinks.runtime_info(Path(__file__).resolve().parents[1]))
    sinks.save_json(output / "run.json", run)
    text = F.col("prediction") if mode == "live" else F.to_json("prediction", {"ignoreNullFields": "false"})
    made = durable(predicted.select("id", text.alias("prediction"), "error", "wall_seconds", "raw_error_output", "huge"), "made")
    long, documents = results(rows, made.withColumn("prediction", F.try_parse_json("prediction")))
    sinks.write_facts(long.join(rows.select("id", "image"), "id"), output / "facts")
    sinks.write_documents(documents, output / "documents")
    long, documents = sinks.read_facts(spark, output / "facts"), sinks.read_documents(spark, output / "documents")
    run |= summarise(long, documents)
    sinks.prediction_lines(sinks.records(documents, per_document(long)), output / "predictions.jsonl")
    if records:
        run["results"] = sinks.Lines(output / "predictions.jsonl")
    run["complete"] = True
    sinks.save_json(output / "run.json", run)
    sinks.write_csv(sinks.error_sheet(long), output / "errors.csv", sinks.ERROR_COLUMNS)
    sinks.write_csv(sinks.flag_sheet(flagged(documents)), output / "review-flags.csv", sinks.FLAG_COLUMNS)
    (output / "summary.md").write_text(sinks.summary(run), encoding="utf-8")
    rows.unpersist()
    drop(made)
    return run


def factory(named: str | None) -> Callable[[], Analyzer] | None:
    """What ``module:name`` stands for."""
    if named is None:
        return None
    module, _, name = named.partition(":")
    return getattr(importlib.import_module(module), name)


def chosen_analyzer() -> Callable[[], Analyzer]:
    """The analyzer that the settings name. The local backend is no part of this engine."""
    from ..sources.remote import Remote

    chosen = readers.settings()
    if chosen.backend != "openai":
        raise ValueError(NO_ANALYZER)
    Remote(chosen)  # a missing key is said before anything else is done
    return partial(Remote, chosen)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Run an analyzer over a dataset, re-score saved predictions, or check a labelled fixture.")
    parser.add_argument("--dataset", type=Path, default=Path("data/annotations.jsonl"))
    parser.add_argument("--output", type=Path)
    modes = parser.add_mutually_exclusive_group()
    modes.add_argument("--dry-run", action="store_true")
    modes.add_argument("--predictions", type=Path)
    parser.add_argument("--analyzer", help="module:name of what makes the analyzer of a live run; without it, the remote one of the settings")
    parser.add_argument("--ledger", type=Path, help="folder of a live run's answers, to go on from where an earlier run stopped")
    parser.add_argument("--split", choices=sorted(SPLIT_LIMITS), help="takes as many documents as a run of this split does")
    parser.add_argument("--limit", type=int)
    parser.add_argument("--offset", type=int, default=0)
    args = parser.parse_args(argv)
    mode = "dry-run" if args.dry_run else "replay" if args.predictions else "live"
    output = args.output or Path("runs") / f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S.%fZ}-{mode}"
    limit = args.limit if args.limit is not None else SPLIT_LIMITS.get(args.split)
    try:
        policy = readers.settings().recheck if mode == "live" else "none"
        make = (factory(args.analyzer) or chosen_analyzer()) if mode == "live" else None
        run = evaluate(readers.session(), args.dataset, output, mode, args.predictions, make, args.offset, limit, policy, ledger=args.ledger, returned=False)
    except (OSError, ValueError, KeyError, RuntimeError, ImportError, AttributeError) as e:
        parser.exit(2, f"Evaluation could not start or finish: {e}\n")
    print(f"{run['claim']}\nReport: {output / 'summary.md'}")
    return 1 if run["failed_examples"] else 0


if __name__ == "__main__":
    raise SystemExit(main())
