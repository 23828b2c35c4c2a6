"""Registered queries that go through files: lines, documents, corpora, binaries, and whole runs. Their inputs are derived
from the tables and written to the shared folder first."""

from __future__ import annotations

import json
import shutil
import uuid
from itertools import chain, islice
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import png
from ..operators import metrics as M
from ..operators import parse as P
from ..operators import review as R
from ..operators import select as S
from ..session import shared_dir
from ..sources import ledger, readers, sinks
from ..sources.files import joined_lines, write_files
from . import fixtures as X
from .prepare import annotations

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str | None = None):
    from ..session import ship

    def add(f):
        Q[f.__name__] = lambda spark, d: f(ship(spark), d)
        if sql:
            O[f.__name__] = sql
        return f

    return add


def _new(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, label: str) -> Path:
    """A new folder for files that this process writes itself: runs make directories on a file system."""
    path = _new(spark, label)
    if "://" in path and not path.startswith("file:"):
        raise ValueError("a run needs a shared folder on a file system")
    folder = Path("/" + path.removeprefix("file:").lstrip("/"))
    folder.mkdir(parents=True)
    return folder


def _written(df: DataFrame, order: str, label: str) -> str:
    """``df`` (its column value) as text files that follow ``order``."""
    path = _new(df.sparkSession, label)
    df.repartitionByRange(4, order).sortWithinPartitions(order).select("value").write.text(path)
    return path


_KEYS = "k, row_number() OVER (ORDER BY k) - 1 AS n FROM (SELECT o_orderkey AS k FROM orders)"


@query(f"SELECT 'doc-' || k AS id, n, 2 AS n_labels, 'total' AS first_label, CASE WHEN k % 3 = 0 THEN 'a' || chr(10) || 'b' ELSE 'q' END AS question FROM (SELECT {_KEYS})")
def jsonl_annotations(spark, d):
    """Annotation lines with blank ones between, read in splits and numbered over all files."""
    o = X.table(spark, d, "orders").selectExpr("o_orderkey as k")
    row = F.expr("""concat('{"id": "doc-', k, '", "image": "i.png", "question": "', if(k % 3 = 0, 'a\\\\nb', 'q'), '", "field_schema": {"z": "string", "total": "number"}, "expected_fields": {"total": 1, "z": "2"}}')""")
    path = _written(o.select("k", F.explode(F.array(row, F.lit(" "))).alias("value")), "k", "annotations")
    got = readers.annotations(spark, path)
    lines = readers.lines(spark, path).select("file", "line_no", F.try_variant_get(F.try_parse_json("value"), "$.id", "string").alias("id"))
    placed = S.numbered(lines.withColumnRenamed("id", "key"), ["file", "line_no"], "x", "y").select("key", "n")
    return got.join(placed, got["id"] == placed["key"]).select("id", "n", F.size("labels").alias("n_labels"), F.get("labels", F.lit(0)).alias("first_label"), "question")


@query("SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'late' END AS recorded_error, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 100) / 4.0 END AS wall_seconds, o_orderkey % 9 = 0 AS huge FROM orders")
def jsonl_predictions(spark, d):
    """Saved predictions: recorded errors, empty errors, seconds, and numbers beyond a double."""
    o = X.table(spark, d, "orders").selectExpr("o_orderkey as k")
    line = """concat('{"id": "', k, '", "error": ', case when k % 4 = 0 then '"late"' when k % 4 = 1 then '""' else 'null' end, ', "wall_seconds": ', if(k % 4 = 0, 'null', cast((k % 100) / 4.0D as string)),
      ', "prediction": {"fields": {"a": ', if(k % 9 = 0, '1e999', '"1e999"'), '}}}')"""
    path = _written(o.select("k", F.expr(line).alias("value")), "k", "predictions")
    return readers.predictions(spark, path).select("id", "recorded_error", "wall_seconds", "huge")


@query("SELECT n_nationkey AS k, n_name AS name, n_nationkey % 2 = 0 AS valid FROM nation")
def json_documents(spark, d):
    """Whole JSON files, one row each; what is no JSON is null."""
    n = X.table(spark, d, "nation")
    text = F.expr("""concat('{"k": ', n_nationkey, ',\\n "name": "', n_name, '"', if(n_nationkey % 2 = 0, '}', ''))""")
    path = _new(spark, "documents")
    n.select(text.alias("value"), F.col("n_nationkey").alias("k")).write.partitionBy("k").text(path)
    rows = readers.json_document(spark, f"{path}/*")
    key, name = F.regexp_extract("file", "k=([0-9]+)", 1).cast("int"), F.regexp_extract("value", '"name": "([^"]*)"', 1)
    return rows.select(key.alias("k"), name.alias("name"), F.col("row").isNotNull().alias("valid"))


@query("SELECT s, count(*) AS n, count(*) FILTER (WHERE k % 5 < 2) AS labelled, min(k) AS first_key FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'test' ELSE 'validation' END AS s FROM orders) GROUP BY s")
def corpus_splits(spark, d):
    """A raw corpus of Parquet files named by their split; each split is found by its files' names."""
    folder = _new(spark, "corpus")
    rows = X.nested_labels(spark, d).select("k", F.struct(F.lit(b"x").alias("bytes")).alias("image"), "ground_truth", F.expr("if(k % 2 = 0, 'test', 'validation')").alias("split"))
    for split in ("test", "validation"):
        part = _new(spark, "part")
        rows.where(F.col("split") == split).select("image", "ground_truth", "k").write.parquet(part)
        _renamed(spark, part, folder, split)
    found = None
    for split in ("test", "validation"):
        got = readers.corpus(spark, folder, split).select(F.lit(split).alias("s"), "file", "row_index", "ground_truth")
        keys = spark.read.option("pathGlobFilter", f"{split}-*.parquet").parquet(folder).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row_index"), "k")
        both = got.join(keys, ["file", "row_index"])
        found = both if found is None else found.union(both)
    labelled = P.map_labels(found).withColumn("ok", F.col("reject").isNull())
    return labelled.groupBy("s").agg(F.count("*").alias("n"), F.count_if("ok").alias("labelled"), F.min("k").alias("first_key"))


def _renamed(spark: SparkSession, source: str, target: str, split: str) -> None:
    """Part files of ``source`` as split-NNNNN.parquet of ``target``."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(target))
    names = sorted(f.getPath().getName() for f in files.listStatus(path(source)) if f.getPath().getName().endswith(".parquet"))
    for i, name in enumerate(names):
        files.rename(path(f"{source}/{name}"), path(f"{target}/{split}-{i:05d}.parquet"))


@query(
    """SELECT n, 'doc-test-' || lpad(n::VARCHAR, CAST(greatest(4, length(n::VARCHAR)) AS INTEGER), '0') AS id, k % 5 > 1 AS rejected, CASE WHEN k % 5 < 2 THEN k::VARCHAR END AS total
FROM (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders)"""
)
def prepared_rows(spark, d):
    """A corpus made into annotation lines: ids by place, rejected rows counting; the line holds the labels."""
    part, folder = _new(spark, "part"), _new(spark, "corpus")
    rows = X.nested_labels(spark, d).withColumn("t", F.col("k").cast("string"))
    truth = F.expr("""if(k % 5 < 2, concat('{"gt_parse": {"total": {"total_price": "', t, '"}}}'), ground_truth)""")
    rows.select("k", F.struct(F.lit(b"x").alias("bytes")).alias("image"), truth.alias("ground_truth")).repartitionByRange(3, "k").sortWithinPartitions("k").write.parquet(part)
    _renamed(spark, part, folder, "test")
    got = annotations(spark, folder, "test", None, {"split": "test"})
    return got.select("n", "id", F.col("reject").isNotNull().alias("rejected"), F.get_json_object("line", "$.expected_fields.total_amount").alias("total"))


@query("SELECT n_nationkey AS k, strlen(n_name) + 1 AS length, sha256(n_name || chr(10)) AS sha256 FROM nation")
def binary_files(spark, d):
    path = _new(spark, "binaries")
    X.table(spark, d, "nation").select(F.col("n_name").alias("value"), F.col("n_nationkey").alias("k")).write.partitionBy("k").text(path)
    got = readers.binaries(spark, path, "part-*")
    return got.select(F.regexp_extract("file", "k=([0-9]+)/", 1).cast("int").alias("k"), "length", "sha256")


#: Labels and answers of the suppliers' documents: right, a rate in place of an amount, no object, a failure, nothing.
_ANSWERS = ("right", "rate", "broken", "late", "null")


def key_of(image: str) -> int:
    """The key that a supplier's image holds: as text, or in the pixels of each of its rows."""
    raw = Path(image).read_bytes()
    return int.from_bytes(png.decode(raw).rows[0].tobytes(), "big") if raw.startswith(png.MAGIC) else int(raw)


class Reader:
    """Reads a supplier's document from its image; asked for the tax alone, or with care, it reads it right where the key is even."""

    def analyze(self, image, question, field_schema, *, receipt_profile=None):
        key = key_of(image)
        kind = _ANSWERS[key % 5]
        if kind == "late":
            raise TimeoutError("late")
        if kind == "broken":
            return "Total: none"
        if list(field_schema) == ["tax_amount"]:
            return json.dumps({"fields": {"tax_amount": str(key) if key % 2 == 0 else "N/A"}})
        fields = {"total_amount": f"{key}.50", "tax_amount": {"right": str(key), "rate": f"{key}%", "null": None}[kind]}
        if receipt_profile == "label-aware-v1" and key % 2 == 0:
            fields["tax_amount"] = str(key)
        return "```json\n" + json.dumps({"fields": fields, "confidence": 0.5}) + "\n```"

    def describe(self):
        return {"model": "suppliers"}


_LINE = """concat('{"id": "', id, '", "image": "images/', k, '.png", "question": "q", "field_schema": {"total_amount": "string or null", "tax_amount": "string or null"}, "expected_fields": {"total_amount": "', k,
  '.50", "tax_amount": "', k, '"}', if(mocked, concat(', "mock_response": {"fields": {"total_amount": "', k, '.50", "tax_amount": null}}'), ''), '}')"""


def _drawn(batches):
    """Images of 8 x (10 + key % 7) grey pixels, each row the key's eight bytes."""
    for batch in batches:
        made = [png.encode(png.Image(8, h, 8, 0, np.tile(np.frombuffer(k.to_bytes(8, "big"), np.uint8), (h, 1)))) for k, h in ((int(k), 10 + int(k) % 7) for k in batch["k"])]
        yield pd.DataFrame({"path": [f"{k}.png" for k in batch["k"]], "content": made})


def _suppliers(spark: SparkSession, d: str, drawn: bool = False, mocked: bool = True) -> Path:
    """A dataset of the suppliers, written by tasks: one image and two labels each."""
    folder = _folder(spark, "dataset")
    rows = X.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k")).withColumns({"id": F.format_string("n%07d", "k"), "mocked": F.lit(mocked)})
    plain = rows.select(F.format_string("%d.png", "k").alias("path"), F.col("k").cast("string").cast("binary").alias("content"))
    write_files(rows.select("k").mapInPandas(_drawn, "path string, content binary") if drawn else plain, str(folder / "images"))
    joined_lines(rows.withColumn("line", F.expr(_LINE)), ["k"], "line", str(folder / "annotations.jsonl"))
    return folder / "annotations.jsonl"


def _run(spark: SparkSession, d: str, **options) -> Path:
    from .evaluate import evaluate

    output = _folder(spark, "runs") / "run"
    evaluate(spark, options.pop("dataset", None) or _suppliers(spark, d), output, returned=False, **options)
    return output


_LIVE = """WITH r AS (SELECT s_suppkey::BIGINT AS k, 'n' || lpad(s_suppkey::VARCHAR, 7, '0') AS id, s_suppkey % 5 AS a FROM supplier)
"""


@query(
    _LIVE
    + """SELECT id, CASE a WHEN 2 THEN 'OutputParseError: The response did not contain a valid JSON object.' WHEN 3 THEN 'TimeoutError: late' END AS error,
  CASE WHEN a IN (2, 3) THEN 0 WHEN a = 0 THEN 2 ELSE 1 END AS correct, 2 AS total, CASE WHEN a = 1 THEN 'percentage_is_not_amount' END AS flag,
  CASE a WHEN 0 THEN 'correct' WHEN 1 THEN 'value_mismatch' WHEN 4 THEN 'missing_value' ELSE 'inference_error' END AS tax_category, CASE WHEN a = 2 THEN 'Total: none' END AS raw_error_output FROM r"""
)
def live_run_records(spark, d):
    """A live run over files: model texts parsed, amounts reviewed, failures kept; its records are read back."""
    run = _run(spark, d, mode="live", analyzer=Reader)
    got = readers.jsonl(spark, str(run / "predictions.jsonl"))
    at = lambda path, kind="string": F.try_variant_get("row", path, kind)
    return got.select(
        at("$.id").alias("id"), at("$.error").alias("error"), at("$.score.correct", "int").alias("correct"), at("$.score.total", "int").alias("total"),
        at("$.prediction.review_flags[0].reason").alias("flag"), at("$.score.details.tax_amount.category").alias("tax_category"), at("$.raw_error_output").alias("raw_error_output"),
    )


@query(
    _LIVE
    + """SELECT id, k || '%' AS first_value, CASE WHEN k % 2 = 0 THEN k::VARCHAR ELSE k || '%' END AS final_value, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS accepted,
  2 AS model_calls, k % 2 = 0 AS correct FROM r WHERE a = 1"""
)
def second_reading_run(spark, d):
    """A live run with a second reading of flagged amounts: what was read first, what it became, what it cost."""
    run = _run(spark, d, mode="live", analyzer=Reader, policy="invalid-amount-v1")
    got = readers.jsonl(spark, str(run / "predictions.jsonl"))
    at = lambda path, kind="string": F.try_variant_get("row", path, kind)
    rows = got.where(at("$.prediction.recheck_attempt", "variant").isNotNull())
    return rows.select(
        at("$.id").alias("id"), at("$.prediction.initial_prediction.fields.tax_amount").alias("first_value"), at("$.prediction.fields.tax_amount").alias("final_value"),
        F.size(F.from_json(F.to_json(at("$.prediction.recheck_attempt.accepted_fields", "variant")), "array<string>")).alias("accepted"),
        at("$.prediction.metadata.model_calls", "int").alias("model_calls"), at("$.score.field_results.tax_amount", "boolean").alias("correct"),
    )


@query(_LIVE + "SELECT 'total_amount' AS field, 0 AS place, count(*) FILTER (WHERE a NOT IN (2, 3)) AS correct, count(*) AS total FROM r UNION ALL SELECT 'tax_amount', 1, count(*) FILTER (WHERE a = 0), count(*) FROM r")
def replayed_run_fields(spark, d):
    """A live run re-scored from its saved lines, by its facts; fields stand in label order in run.json."""
    dataset = _suppliers(spark, d)
    first = _run(spark, d, dataset=dataset, mode="live", analyzer=Reader)
    again = _run(spark, d, dataset=dataset, mode="replay", saved=first / "predictions.jsonl")
    text = spark.read.text(str(again / "run.json"), wholetext=True)
    names = text.select(F.posexplode(F.json_object_keys(F.get_json_object("value", "$.per_field"))).alias("place", "field"))
    facts = spark.read.parquet(str(again / "facts")).groupBy("field").agg(F.count_if("correct").alias("correct"), F.count("*").alias("total"))
    return names.join(facts, "field").select("field", "place", "correct", "total")


@query(_LIVE + "SELECT 'total_amount' AS field, 0::BIGINT AS improved, 0::BIGINT AS regressed UNION ALL SELECT 'tax_amount', count(*) FILTER (WHERE a = 1 AND k % 2 = 0), 0 FROM r")
def compared_runs(spark, d):
    """Two live runs over files, with and without a second reading, paired by their facts."""
    from ..operators.compare import paired_changes
    from .compare import compare, facts_of

    dataset = _suppliers(spark, d)
    runs = [_run(spark, d, dataset=dataset, mode="live", analyzer=Reader, policy=p) / "run.json" for p in ("none", "invalid-amount-v1")]
    compare(spark, runs)  # raises unless the two may be compared
    return paired_changes(*[facts_of(spark, r) for r in runs])


@query(
    """WITH n AS (SELECT s_suppkey AS k, 'n' || lpad(s_suppkey::VARCHAR, 7, '0') AS id FROM supplier),
a AS (SELECT string_agg('{"id": "' || id || '", "image": "images/' || k || '.png", "question": "q", "field_schema": {"total_amount": "string or null", "tax_amount": "string or null"}, "expected_fields": {"total_amount": "' || k || '.50", "tax_amount": "' || k
  || '"}, "mock_response": {"fields": {"total_amount": "' || k || '.50", "tax_amount": null}}}' || chr(10), '' ORDER BY k) AS text, '{' || string_agg('"' || id || '": "' || sha256(k::VARCHAR) || '"', ', ' ORDER BY id) || '}' AS images FROM n)
SELECT sha256(text) AS annotations, sha256(text || images) AS fingerprint, 5 AS selected, 'n0000003' AS first_id FROM a"""
)
def dataset_fingerprint(spark, d):
    """Hashes of a dataset's lines and of its lines with its images, whatever is selected of it."""
    from .evaluate import load, select

    rows, info = load(spark, _suppliers(spark, d))
    _, chosen = select(rows, info, 3, 5)
    row = (chosen["annotations_sha256"], chosen["fingerprint"], chosen["selected_examples"], chosen["selected_ids"][0])
    return spark.createDataFrame([row], "annotations string, fingerprint string, selected int, first_id string")


@query(_LIVE + "SELECT id, 'tax_amount' AS field, 'missing_value' AS category FROM r")
def dry_run_errors(spark, d):
    """The error sheet of a run over the answers that the dataset itself holds."""
    run = _run(spark, d, mode="dry-run")
    sheet = spark.read.option("header", True).option("escape", '"').csv(str(run / "errors.csv"))
    return sheet.select(F.col(sheet.columns[0]).alias("id"), "field", "category")


@query(
    """WITH r AS (SELECT s_suppkey % 5 AS a FROM supplier WHERE s_suppkey BETWEEN 2 AND 9)
SELECT 'live' AS mode, 'Live model inference on the specified dataset' AS claim, 2 AS report_version, true AS complete, count(*) AS examples, count(*) FILTER (WHERE a IN (2, 3)) AS failed, count(*) FILTER (WHERE a = 1) AS flagged,
  count(*) FILTER (WHERE a NOT IN (2, 3)) + count(*) FILTER (WHERE a = 0) AS correct_fields, 2 * count(*) AS total_fields, round(count(*) FILTER (WHERE a = 0) / count(*)::DOUBLE, 6) AS document_accuracy,
  count(*) FILTER (WHERE a IN (2, 3)) * 2 AS inference_errors, 2 AS first_offset, 8 AS selected, 'n0000002' AS first_id, count(*) AS records FROM r"""
)
def run_manifest(spark, d):
    """run.json of a live run over a part of the documents: what it claims, what it selected, what it counted."""
    run = _run(spark, d, mode="live", analyzer=Reader, offset=2, limit=8)
    text = spark.read.text(str(run / "run.json"), wholetext=True).select(F.parse_json("value").alias("r"))
    at = lambda path, kind: F.try_variant_get("r", path, kind)
    names = {"mode": ("mode", "string"), "claim": ("claim", "string"), "report_version": ("report_version", "int"), "complete": ("complete", "boolean"), "examples": ("examples", "bigint")}
    names |= {"failed": ("failed_examples", "bigint"), "flagged": ("review_flagged_examples", "bigint"), "correct_fields": ("correct_fields", "bigint"), "total_fields": ("total_fields", "bigint")}
    names |= {"inference_errors": ("error_categories.inference_error", "bigint"), "first_offset": ("dataset.selection.offset", "int"), "selected": ("dataset.selected_examples", "int"), "first_id": ("dataset.selected_ids[0]", "string")}
    share = F.round(at("$.document_accuracy", "double"), 6).alias("document_accuracy")
    records = F.size(F.from_json(F.to_json(at("$.results", "variant")), "array<variant>")).cast("long").alias("records")
    return text.select(*[at(f"$.{path}", kind).alias(n) for n, (path, kind) in names.items()], share, records)


_FIELDS = "(VALUES ('vendor'), ('document_number'), ('date'), ('currency'), ('total_amount')) AS t(field)"


@query(f"SELECT field, 3 * n AS correct, 3 * n AS total FROM {_FIELDS}, (SELECT count(*) AS n FROM supplier)")
def fixture_run(spark, d):
    """A dry run over the synthetic documents, once for each supplier."""
    folder = readers.write_fixtures(_folder(spark, "fixtures") / "set").parent
    rows = F.explode(F.array(*[F.struct(F.lit(row["id"]).alias("id"), F.lit(json.dumps(row)).alias("line")) for row in readers.fixtures()])).alias("f")
    each = X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), rows).select("k", "f.*")
    named = F.expr("""replace(line, concat('"id": "', id, '"'), concat('"id": "', id, '-', k, '"'))""")
    joined_lines(each.withColumn("line", named), ["k", "id"], "line", str(folder / "annotations.jsonl"))
    run = _run(spark, d, dataset=folder / "annotations.jsonl", mode="dry-run")
    return spark.read.parquet(str(run / "facts")).groupBy("field").agg(F.count_if("correct").alias("correct"), F.count("*").alias("total"))


#: What a run, a comparison or a setting refuses, and the words it does it in.
_REFUSED = {
    "offset": "--offset must be nonnegative", "limit": "--limit must be positive", "beyond": "Document selection is empty", "fixtures": "--dry-run requires fixtures; it cannot evaluate real data", "policy": "Unknown recheck policy", "exists": "Output already exists; choose a new directory",
    "manifest": "Replay requires the source run.json beside predictions.jsonl", "dataset": "Saved predictions use a different dataset fingerprint", "missing": "Saved predictions are missing selected dataset IDs",
    "twice": "Duplicate prediction IDs", "analyzer": "a live run needs --analyzer module:name", "pixels": "Invalid pixel or token limits", "alone": "At least two runs are required", "dry": "Only completed live runs can be compared as model benchmarks",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{case}', '{said}')" for case, said in _REFUSED.items()) + ") AS t(what, said)")
def refusals(spark, d):
    """Runs, comparisons and settings that are refused, each tried, and what was said."""
    from .compare import compare
    from .evaluate import evaluate

    dataset, other = _suppliers(spark, d), _suppliers(spark, d)
    with other.open("a", encoding="utf-8") as out:
        out.write("\n")
    done = _run(spark, d, dataset=dataset, mode="dry-run")
    with (done / "predictions.jsonl").open("rb") as lines:
        n = sum(1 for _ in lines)

    def saved(most: int, again: int = 0, manifest: bool = True) -> Path:
        """The first ``most`` lines of the run, then the first ``again`` of them; they go by one at a time."""
        folder = _folder(spark, "saved")
        with (folder / "predictions.jsonl").open("wb") as out, (done / "predictions.jsonl").open("rb") as first, (done / "predictions.jsonl").open("rb") as second:
            out.writelines(chain(islice(first, most), islice(second, again)))
        if manifest:
            shutil.copyfile(done / "run.json", folder / "run.json")
        return folder / "predictions.jsonl"

    new = lambda: _folder(spark, "runs") / "run"
    replay = lambda path, of=dataset: evaluate(spark, of, new(), "replay", path)
    tries = {
        "offset": lambda: evaluate(spark, dataset, new(), offset=-1), "limit": lambda: evaluate(spark, dataset, new(), limit=0), "beyond": lambda: evaluate(spark, dataset, new(), offset=10**9), "fixtures": lambda: evaluate(spark, _suppliers(spark, d, mocked=False), new()),
        "policy": lambda: evaluate(spark, dataset, new(), policy="always"), "exists": lambda: evaluate(spark, dataset, done), "manifest": lambda: replay(saved(n, manifest=False)), "dataset": lambda: replay(saved(n), other),
        "missing": lambda: replay(saved(n - 1)), "twice": lambda: replay(saved(n, 1)), "analyzer": lambda: evaluate(spark, dataset, new(), "live"),
        "pixels": lambda: readers.settings({"MLLM_MIN_PIXELS": "9", "MLLM_MAX_PIXELS": "8"}), "alone": lambda: compare(spark, [done / "run.json"]), "dry": lambda: compare(spark, [done / "run.json"] * 2),
    }
    said = []
    for what, attempt in tries.items():
        try:
            attempt()
            said.append((what, ""))
        except ValueError as e:
            said.append((what, str(e)))
    return spark.createDataFrame(said, "what string, said string")


_AT = """SELECT k, 3 + k % 5 AS w, 10 + k % 7 AS h FROM (SELECT o_orderkey::BIGINT AS k FROM orders)"""


@query(
    f"""SELECT k, h // 10 AS first_row, h - h // 10 AS last_row, w AS width,
  sha256(unhex(array_to_string(list_transform(range((h // 10) * w, (h - h // 10) * w), lambda i: printf('%02x', (k * 7 + (i // w) * 3 + i % w) % 256)), ''))) AS pixels FROM ({_AT})"""
)
def crop_views(spark, d):
    """Images made, filtered, unpacked and cut to their central rows by tasks; the pixels that are left are hashed."""

    def cut(batches):
        import hashlib

        for batch in batches:
            keys = batch["k"].to_numpy(np.int64)
            for shape in np.unique(keys % 35):
                k = keys[keys % 35 == shape]
                w, h = 3 + int(shape) % 5, 10 + int(shape) % 7
                y, x = np.mgrid[:h, :w]
                pixels = ((k[:, None, None] * 7 + y * 3 + x) % 256).astype(np.uint8)
                wholes = png.encode_all([png.Image(w, h, 8, 0, p) for p in pixels], (k[:, None] + np.arange(h)) % 5)
                top, bottom = R.central_rows(h)
                parts = png.decode_all(png.encode_all([png.between(whole, top, bottom) for whole in png.decode_all(wholes)]))
                hashed = [hashlib.sha256(part.rows.tobytes()).hexdigest() for part in parts]
                yield pd.DataFrame({"k": k, "first_row": top, "last_row": [top + part.height for part in parts], "width": [part.width for part in parts], "pixels": hashed})

    keys = X.table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("k"))
    # dealt out first: a row costs little to read and much to draw, and a file of one row group would be one task
    return keys.repartition(_dealt(spark), "k").mapInPandas(cut, "k long, first_row long, last_row long, width long, pixels string")


def _dealt(spark: SparkSession) -> int:
    """Parts for rows that cost a task far more than their bytes tell."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _second(spark, d, policy):
    run = _run(spark, d, dataset=_suppliers(spark, d, drawn=True), mode="live", analyzer=Reader, policy=policy)
    got = readers.jsonl(spark, str(run / "predictions.jsonl"))
    at = lambda path, kind="string": F.try_variant_get("row", f"$.prediction.{path}", kind)
    rows = got.where(at("recheck_attempt", "variant").isNotNull()).withColumn("id", F.try_variant_get("row", "$.id", "string"))
    return rows, at


@query(
    _LIVE
    + """SELECT id, 'central-80-percent' AS kind, h // 10 AS first_row, h - h // 10 AS last_row, h AS source_height, 2 AS model_calls, CASE WHEN k % 2 = 0 THEN k::VARCHAR ELSE k || '%' END AS tax
FROM (SELECT *, 10 + k % 7 AS h FROM r WHERE a = 1)"""
)
def crop_reading_run(spark, d):
    """A live run whose flagged rates are read again from the central rows of the image, and what is kept of that view."""
    rows, at = _second(spark, d, "percent-crop-v1")
    view = lambda path, kind: at(f"recheck_attempt.view.{path}", kind)
    return rows.select("id", view("kind", "string").alias("kind"), view("box[1]", "long").alias("first_row"), view("box[3]", "long").alias("last_row"), view("source_size[1]", "long").alias("source_height"), at("metadata.model_calls", "int").alias("model_calls"), at("fields.tax_amount").alias("tax"))


@query(_LIVE + "SELECT id, 'label-aware-v1' AS profile, 'q' AS question, 2 AS n_fields, CASE WHEN k % 2 = 0 THEN k::VARCHAR ELSE k || '%' END AS tax, k || '%' AS first_tax FROM r WHERE a = 1")
def context_reading_run(spark, d):
    """A live run whose flagged rates are read again with all fields, under a profile of their own."""
    rows, at = _second(spark, d, "label-context-v1")
    asked = F.size(F.from_json(F.to_json(at("recheck_attempt.requested_fields", "variant")), "array<string>"))
    return rows.select("id", at("recheck_attempt.receipt_profile").alias("profile"), at("recheck_attempt.question").alias("question"), asked.alias("n_fields"), at("fields.tax_amount").alias("tax"), at("initial_prediction.fields.tax_amount").alias("first_tax"))


class Numbered:
    """Answers with the number of the job that asked, and fails for keys that end in 7."""

    def __init__(self, job: int):
        self.job = job

    def analyze(self, image, question, field_schema):
        if question.endswith("7"):
            raise ValueError("unreadable")
        return {"fields": {"job": self.job}}

    def describe(self):
        return {"model": "numbered"}


@query(
    """SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 10 = 7 THEN 0 WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS job, CASE WHEN c_custkey % 10 = 7 THEN 'ValueError: unreadable' END AS error,
  1::BIGINT AS times FROM customer"""
)
def resumed_answers(spark, d):
    """A job asks for a third of the documents, a second one for all: what the ledger holds is not asked for again, failures included."""
    from ..operators.infer import infer

    rows = X.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("id"), F.lit("none").alias("image"), F.col("c_custkey").cast("string").alias("question"), F.lit("{}").alias("field_schema"))
    kept = _new(spark, "ledger")
    infer(rows.where("k % 3 = 0"), lambda: Numbered(1), kept)
    out = infer(rows, lambda: Numbered(2), kept)
    lines = spark.read.schema(ledger.LINE).option("recursiveFileLookup", True).json(kept).groupBy("id").agg(F.count("*").alias("times"))
    return out.join(lines, "id").select("id", F.coalesce(F.get_json_object("prediction", "$.fields.job").cast("int"), F.lit(0)).alias("job"), "error", "times")


class Prompted:
    """Answers with what it is asked, and with the names of all that it is given."""

    def analyze(self, image, question, field_schema, *, receipt_profile="baseline"):
        from ..operators.infer import prompt

        return {"fields": {"prompt": prompt(question, field_schema, receipt_profile), "given": ",".join([image, question, *field_schema])}}

    def describe(self):
        return {"model": "prompted"}


@query(
    """WITH r AS (SELECT c_custkey::VARCHAR AS id, c_custkey AS k, chr(10) AS nl, CASE c_custkey % 4 WHEN 1 THEN 'label-aware-v1' WHEN 2 THEN 'baseline' END AS profile, c_custkey % 3 AS s FROM customer),
p AS (SELECT *, 'Read ' || id || nl || nl || 'Give exactly these fields, each by its rule:' || CASE WHEN s <> 1 THEN nl || '- "vendor": {"type": "string"}' ELSE '' END
  || CASE WHEN s > 0 THEN nl || '- "tax_amount": "string or null"' ELSE '' END AS plain FROM r)
SELECT id, CASE WHEN profile = 'label-aware-v1' AND s > 0 THEN plain || nl || nl || 'Find each printed label first, then copy the amount beside it.' || nl || 'tax_amount: the tax in money (Tax, PPN or PB1), never its rate' || nl
  || 'Copy every digit and separator; give null where none is printed.' ELSE plain END AS prompt,
  'i' || id || '.png,Read ' || id || CASE WHEN s <> 1 THEN ',vendor' ELSE '' END || CASE WHEN s > 0 THEN ',tax_amount' ELSE '' END AS given FROM p"""
)
def prompted_readings(spark, d):
    """What a model is told of each document: the question, the fields with their rules, and the lines of the profile that
    the row asks for; and that nothing else reaches it, though the rows hold labels."""
    from ..operators.infer import infer

    k = F.col("c_custkey")
    vendor, tax = '"vendor": {"type": "string"}', '"tax_amount": "string or null"'
    schema = F.when(k % 3 == 0, "{%s}" % vendor).when(k % 3 == 1, "{%s}" % tax).otherwise("{%s, %s}" % (vendor, tax))
    rows = X.table(spark, d, "customer").select(
        k.cast("string").alias("id"), F.format_string("i%d.png", k).alias("image"), F.format_string("Read %d", k).alias("question"), schema.alias("field_schema"),
        F.when(k % 4 == 1, "label-aware-v1").when(k % 4 == 2, "baseline").alias("profile"), F.col("c_name").alias("expected_fields"), F.col("c_name").alias("mock_response"),
    )
    at = lambda name: F.get_json_object("prediction", f"$.fields.{name}").alias(name)
    return infer(rows, Prompted).select("id", at("prompt"), at("given"))


@query("SELECT n, 'doc-test-' || lpad(n::VARCHAR, CAST(greatest(4, length(n::VARCHAR)) AS INTEGER), '0') AS id, k::VARCHAR AS ground_truth FROM (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) WHERE n < 1000")
def source_prefix(spark, d):
    """The first rows of a corpus of sixteen files: places come from footers and row numbers, and files behind the limit stay shut."""
    part, folder = _new(spark, "part"), _new(spark, "corpus")
    rows = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.struct(F.lit(b"x").alias("bytes")).alias("image"), F.col("o_orderkey").cast("string").alias("ground_truth"))
    rows.repartitionByRange(16, "k").sortWithinPartitions("k").drop("k").write.parquet(part)
    _renamed(spark, part, folder, "test")
    return readers.numbered_corpus(spark, folder, "test", 1000).select("n", "id", "ground_truth")


@query("SELECT s_suppkey::VARCHAR AS k, strlen(s_name) AS length, sha256(s_name) AS sha256 FROM supplier")
def exported_files(spark, d):
    """Files that tasks write and one rename publishes, read back."""
    folder = _new(spark, "files")
    write_files(X.table(spark, d, "supplier").select(F.concat(F.lit("of/"), F.col("s_suppkey").cast("string")).alias("path"), F.col("s_name").cast("binary").alias("content")), folder)
    return readers.binaries(spark, folder).select(F.regexp_extract("file", "of/([0-9]+)$", 1).alias("k"), "length", "sha256")


@query(
    """SELECT sha256(string_agg(doc_id || chr(10), '' ORDER BY doc_id)) AS annotations, count(*) AS examples,
  sha256(string_agg(doc_id || chr(10), '' ORDER BY doc_id) || '{' || string_agg('"' || doc_id || '": "' || sha256(text) || '"', ', ' ORDER BY doc_id::VARCHAR) || '}') AS fingerprint FROM documents"""
)
def ordered_fingerprint(spark, d):
    """The fingerprint of a dataset whose images are the documents, by a running hash over sorted rows."""
    docs = X.table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.sha2("text", 256).alias("sha256"))
    path = str(_folder(spark, "annotations") / "annotations.jsonl")
    joined_lines(docs, ["doc_id"], "id", path)
    got = sinks.fingerprint(path, docs, listed=False)
    return spark.createDataFrame([(got["annotations_sha256"], got["examples"], got["fingerprint"])], "annotations string, examples long, fingerprint string")


@query(
    """SELECT event_type, round(avg(value), 6) AS mean_seconds, round(quantile_cont(value::DOUBLE, 0.5), 6) AS median_seconds, round(quantile_cont(value::DOUBLE, 0.95), 6) AS p95_seconds FROM events GROUP BY event_type"""
)
def latency_by_group(spark, d):
    """Exact percentiles of each group, found by counts of ranges."""
    rows = X.table(spark, d, "events").select("event_type", F.col("value").alias("wall_seconds"), F.lit(0.0).alias("memory"), F.lit(None).cast("string").alias("error"))
    return M.latency(rows, ("event_type",)).select("event_type", *[F.round(c, 6).alias(c) for c in ("mean_seconds", "median_seconds", "p95_seconds")])


@query(
    """WITH x AS (SELECT o_orderkey AS k, (o_orderkey % 1000)::DOUBLE / 10 + (o_orderkey % 500)::DOUBLE / 16 AS x FROM orders),
p AS (SELECT k, x, floor(x) AS whole, CAST((x - floor(x)) * 9223372036854775808::DOUBLE AS HUGEINT) * 1000 AS parts FROM x),
q AS (SELECT k, x, whole, parts // 9223372036854775808::HUGEINT AS low, 2 * (parts % 9223372036854775808::HUGEINT) AS over FROM p)
SELECT k, x, (whole * 1000 + low::DOUBLE + CASE WHEN over > 9223372036854775808::HUGEINT OR (over = 9223372036854775808::HUGEINT AND low % 2 = 1) THEN 1 ELSE 0 END) / 1000 AS rounded FROM q"""
)
def exact_rounding(spark, d):
    """Sums of tenths and sixteenths, many of them next to a tie, rounded to three places by their exact value."""
    x = F.expr("cast(o_orderkey % 1000 as double) / 10 + cast(o_orderkey % 500 as double) / 16")
    return X.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), x.alias("x"), R.exactly_rounded(x).alias("rounded"))


@query(
    _LIVE
    + """, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE a NOT IN (2, 3)) + count(*) FILTER (WHERE a = 0) AS good, count(*) FILTER (WHERE a = 1) AS rates, count(*) FILTER (WHERE a = 1 AND k % 2 = 0) AS better FROM r)
SELECT 'flag' AS report, id || ',images/' || k || '.png,tax_amount,percentage_is_not_amount,"' || k || '%"' AS line FROM r WHERE a = 1
UNION ALL SELECT 'summary', '| labelled fields right | ' || good || '/' || 2 * n || ' |' FROM c UNION ALL SELECT 'summary', '| documents with review flags | ' || rates || ' |' FROM c
UNION ALL SELECT 'comparison', '| total_amount | 0 | 0 |' UNION ALL SELECT 'comparison', '| tax_amount | ' || better || ' | 0 |' FROM c"""
)
def written_reports(spark, d):
    """What stands in review-flags.csv and summary.md of a live run, and in its comparison with one that reads flagged amounts again."""
    from .compare import compare

    dataset = _suppliers(spark, d)
    runs = [_run(spark, d, dataset=dataset, mode="live", analyzer=Reader, policy=p) / "run.json" for p in ("none", "invalid-amount-v1")]
    text = _folder(spark, "comparison") / "comparison.md"
    text.write_text(compare(spark, runs), encoding="utf-8")
    sheet = spark.read.option("header", True).option("escape", '"').csv(str(runs[0].parent / "review-flags.csv"))
    flags = sheet.select(F.lit("flag").alias("report"), F.concat_ws(",", *[F.col(c) for c in sheet.columns]).alias("line"))
    lines = lambda name, path, kept: spark.read.text(str(path)).where(F.col("value").rlike(kept)).select(F.lit(name), "value")
    said = lines("summary", runs[0].parent / "summary.md", "^. (labelled fields right|documents with review flags) ")
    return flags.union(said).union(lines("comparison", text, "^. (total|tax)_amount "))


@query(
    """WITH r AS (SELECT o_orderkey AS k, o_orderkey % 60 + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 60 END AS minute, o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 1 AS good FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 50 <> 1),
last AS (SELECT max(minute) AS minute FROM r)
SELECT 1767225600 + (r.minute // 5) * 300 AS start_second, count(*) FILTER (WHERE good) AS correct, count(*) AS total FROM r, last
WHERE (r.minute // 5) * 5 + 5 <= last.minute - 60 GROUP BY ALL"""
)
def streamed_windows(spark, d):
    """Predictions of two hours that come in two steps, the second one with repeats of the first and rows that are too late: accuracy by
    windows that are closed. The second step is a stream of its own that goes on with the state of the first."""
    from ..streaming import live

    o = X.table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("k"))
    source, target, progress = (_new(spark, part) for part in ("stream", "windows", "progress"))

    def come(rows: DataFrame, minute: str) -> DataFrame:
        value = F.expr("case k % 3 when 0 then concat(k, '.0') when 1 then cast(k + 1 as string) else cast(k as string) end")
        at = F.timestamp_seconds(F.lit(1767225600) + 60 * F.expr(minute))
        made = rows.select(
            F.lit("r").alias("run_id"), F.col("k").cast("string").alias("id"), F.lit("total_amount").alias("field"), F.lit("number").alias("rule"), F.col("k").cast("string").alias("expected"),
            value.alias("predicted"), F.expr("if(k % 7 = 0, 'late', null)").alias("error"), F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"),
        )
        made.write.mode("append").json(source)
        return live.caught_up(spark, source, target, progress)

    come(o.where("k % 2 = 0"), "k % 60")
    again = o.where("k % 20 = 0").unionAll(o.where("k % 2 = 1"))
    closed = come(again, "case when k % 2 = 0 then k % 60 when k % 50 = 1 then -30 else 60 + k % 60 end")
    return closed.select(F.unix_timestamp("start").alias("start_second"), "correct", "total")
