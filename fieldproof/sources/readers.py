"""Sources: annotations, predictions, JSON documents, corpora, binary files, settings, fixtures."""

from __future__ import annotations

import json
import os
import struct
import zlib
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import blob_sha1, overflows


def session(builder: SparkSession.Builder | None = None) -> SparkSession:
    """A session in UTC in which the last of equal JSON keys wins."""
    builder = builder or SparkSession.builder
    return builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.variant.allowDuplicateKeys", "true").getOrCreate()


#: Line ends beyond those at which Spark's reader cuts; Python's splitlines() knows them all.
MORE_ENDS = "[\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of every line with a word; numbers are physical, from 1. Files are read in splits: a line
    is numbered by its place in its split and by the lines in the splits before it, one small row per split."""
    meta = F.col("_metadata")
    text = spark.read.text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("part"), F.explode(F.split("value", MORE_ENDS)).alias("value"))
    text = text.withColumn("at", F.monotonically_increasing_id())
    sizes = text.groupBy("file", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("file").orderBy("part")) - F.col("n")).drop("n")
    numbered = text.join(before, ["file", "part"]).withColumn("line_no", (F.col("before") + F.col("at") - F.col("first") + 1))
    return numbered.where(F.btrim("value", F.lit(" \t\n\r\f\x0b")) != "").select("file", "line_no", "value")


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value, row): each line and its VARIANT, null where it is no JSON."""
    return lines(spark, path).withColumn("row", F.try_parse_json("value"))


def _get(name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(F.col("row"), f"$.{name}", kind)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, id, image, question, field_schema, expected_fields, mock_response, source, labels, requested, row, huge)."""
    rows = jsonl(spark, path)
    # names in the order of the text: a VARIANT sorts them
    names = lambda key: F.array_distinct(F.coalesce(F.json_object_keys(F.get_json_object("value", f"$.{key}")), F.array().cast("array<string>")))
    return rows.select(
        "line_no", _get("id", "string").alias("id"), _get("image", "string").alias("image"), _get("question", "string").alias("question"),
        _get("field_schema").alias("field_schema"), _get("expected_fields").alias("expected_fields"), _get("mock_response").alias("mock_response"),
        _get("source").alias("source"), names("expected_fields").alias("labels"), names("field_schema").alias("requested"), "row",
        overflows(F.col("value")).alias("huge"),
    )


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, id, prediction, recorded_error, wall_seconds, score, huge) of saved predictions."""
    return jsonl(spark, path).select(
        "line_no", _get("id", "string").alias("id"), _get("prediction").alias("prediction"), F.nullif(_get("error", "string"), F.lit("")).alias("recorded_error"),
        _get("wall_seconds", "double").alias("wall_seconds"), _get("score").alias("score"), overflows(F.col("value")).alias("huge"),
    )


def json_document(spark: SparkSession, path: str) -> DataFrame:
    """(file, value, row) of whole JSON files."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("file"), "value", F.try_parse_json("value").alias("row"))


def manifest_files(spark: SparkSession, path: str) -> DataFrame:
    """(repository, revision, file, size, checksum) of an integrity manifest."""
    doc = json_document(spark, path).select(F.from_json("value", "repository string, revision string, files array<struct<file:string,size:bigint,checksum:string>>").alias("m"))
    return doc.select("m.repository", "m.revision", F.explode("m.files").alias("f")).select("repository", "revision", "f.file", "f.size", "f.checksum")


def corpus(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """(file, row_index, image, ground_truth) of a raw Parquet corpus; ``split`` keeps files ``split-*.parquet``."""
    reader = spark.read if split is None else spark.read.option("pathGlobFilter", f"{split}-*.parquet")
    found = reader.parquet(path)
    return found.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row_index"), "image", "ground_truth")


def counted_files(spark: SparkSession, path: str, split: str, limit: int | None) -> DataFrame | None:
    """(file, uri, before): the files of a split in the order of their names, with the rows that stand before each; null for no file.
    With a ``limit`` just the files that hold the first rows: footers are opened in order, until they tell of enough, and no other
    file is looked into. Without one, all footers are counted by tasks."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    pattern = spark._jvm.org.apache.hadoop.fs.Path(place, f"{split}-*.parquet")
    found = sorted((f.getPath() for f in store.globStatus(pattern)), key=lambda p: p.getName())
    if not found:
        return None
    if limit is None:
        sizes = spark.read.parquet(*[p.toString() for p in found]).groupBy(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("uri")).agg(F.count("*").alias("n"))
        # one row for each file that has rows
        return sizes.select("file", "uri", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    parquet, rows, before = spark._jvm.org.apache.parquet.hadoop, [], 0
    for p in found:
        reader = parquet.ParquetFileReader.open(parquet.util.HadoopInputFile.fromPath(p, spark._jsc.hadoopConfiguration()))
        try:
            rows.append((p.getName(), p.toString(), before))
            before += reader.getRecordCount()
        finally:
            reader.close()
        if before >= limit:
            break
    return spark.createDataFrame(rows, "file string, uri string, before long")


def numbered_corpus(spark: SparkSession, path: str, split: str, limit: int | None = None, prefix: str = "doc") -> DataFrame:
    """(file, row_index, image, ground_truth, n, id) of the first ``limit`` rows of a split, in the order of its files' names. n is the
    place in the whole split, from 0, and id is made of it. Places come from the files' own row counts and row numbers, so nothing is
    sorted or shuffled by row, and files behind the limit are not opened."""
    files = counted_files(spark, path, split, limit)
    if files is None:
        raise ValueError(f"no file {split}-*.parquet in {path}")
    names = [r["uri"] for r in files.select("uri").collect()]
    rows = spark.read.parquet(*names).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row_index"), "image", "ground_truth")
    placed = rows.join(files.select("file", "before"), "file").withColumn("n", F.col("before") + F.col("row_index")).drop("before")
    placed = placed if limit is None else placed.where(F.col("n") < limit)
    return placed.withColumn("id", F.format_string(f"{prefix}-{split}-%04d", "n"))


def binaries(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, length, sha256, blob_sha1, content) of binary files, file relative to ``path``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    root = str(path).rstrip("/") + "/"
    relative = F.regexp_replace(F.regexp_replace("path", "^file:(//)?(?=/)", ""), "^.*?" + "".join("\\" + c if not c.isalnum() else c for c in root), "")
    return reader.load(str(path)).select(relative.alias("file"), "length", F.sha2("content", 256).alias("sha256"), blob_sha1(F.col("content")).alias("blob_sha1"), "content")


def mock(annotated: DataFrame) -> DataFrame:
    """Predictions taken from the rows themselves."""
    return annotated.select("id", F.col("mock_response").alias("prediction"), "huge")


@dataclass(frozen=True)
class Settings:
    """Settings of a run. The defaults are fixed values."""

    backend: str = "openai"
    model: str = "gpt-4.1-mini"
    local_model: str = "Qwen/Qwen2.5-VL-3B-Instruct"
    base_url: str | None = "https://api.openai.com/v1"
    api_key: str | None = field(default=None, repr=False)
    api_mode: str = "responses"
    profile: str = "baseline"
    recheck: str = "none"
    compute_dtype: str = "bfloat16"
    load_in_4bit: bool = True
    min_pixels: int = 200704
    max_pixels: int = 802816
    max_new_tokens: int = 512


#: The variable of each setting.
VARIABLES = {
    "backend": "MLLM_BACKEND", "model": "MLLM_MODEL", "local_model": "MLLM_LOCAL_MODEL", "base_url": "MLLM_BASE_URL", "api_key": "MLLM_API_KEY",
    "api_mode": "MLLM_API_MODE", "profile": "MLLM_RECEIPT_PROFILE", "recheck": "MLLM_RECEIPT_RECHECK", "compute_dtype": "MLLM_COMPUTE_DTYPE",
    "load_in_4bit": "MLLM_LOAD_IN_4BIT", "min_pixels": "MLLM_MIN_PIXELS", "max_pixels": "MLLM_MAX_PIXELS", "max_new_tokens": "MLLM_MAX_NEW_TOKENS",
}
#: Settings that are names: blanks around them and their case don't matter.
NAMES = ("backend", "api_mode", "profile", "recheck", "compute_dtype")


def settings(env: dict[str, str] | None = None) -> Settings:
    """Settings from the variables, each read by the type of its default, and checked."""
    from ..operators.validate import check_names

    env = os.environ if env is None else env
    made = {}
    for f in fields(Settings):
        if (text := env.get(VARIABLES[f.name])) is None:
            continue
        if isinstance(f.default, bool):
            made[f.name] = text.strip().lower() in ("1", "true", "yes", "on")
        elif isinstance(f.default, int):
            made[f.name] = int(text)
        else:
            made[f.name] = text.strip().lower() if f.name in NAMES else text
    s = Settings(**made)
    check_names(s.profile, s.recheck, s.backend)
    if s.api_mode not in ("responses", "chat") or s.compute_dtype not in ("bfloat16", "float16"):
        raise ValueError("unknown API mode or compute type")
    if not 0 < s.min_pixels <= s.max_pixels or s.max_new_tokens < 1:
        raise ValueError("Invalid pixel or token limits")
    return s


#: Fixed values of the synthetic fixtures: the question, the answer's text, rules, and the documents' values.
FIXTURE_QUESTION, FIXTURE_ANSWER = "What is the total and who issued the document?", "Synthetic fixture"
FIXTURE_RULES = {"vendor": "string", "document_number": "string", "date": "date", "currency": "code", "total_amount": "number"}
FIXTURES = (
    ("invoice-001", "invoice", "Northwind Studio", "INV-2026-0142", "2026-07-18", 198.0),
    ("receipt-001", "receipt", "Laneway Coffee", "R-88421", "2026-07-21", 12.0),
    ("order-001", "purchase order", "Bluegum Supplies", "PO-7008", "2026-07-25", 55.0),
)


def fixtures() -> list[dict]:
    """Annotation rows of the invented documents, answers included."""
    out = []
    for name, kind, vendor, number, date, total in FIXTURES:
        fields = {"vendor": vendor, "document_number": number, "date": date, "currency": "AUD", "total_amount": total}
        answer = {"document_type": kind, "fields": fields, "answer": FIXTURE_ANSWER, "evidence": [], "uncertainties": [], "confidence": 1.0}
        image = f"images/{name.replace('-', '_')}.png"
        out.append({"id": name, "image": image, "question": FIXTURE_QUESTION, "field_schema": FIXTURE_RULES, "expected_fields": fields, "mock_response": answer})
    return out


def _png(words: str) -> bytes:
    """A white PNG that carries ``words`` as its text."""

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    width, height = 64, 32
    head = struct.pack(">IIBBBBB", width, height, 1, 0, 0, 0, 0)
    rows = (b"\0" + b"\xff" * (width // 8)) * height
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"tEXt", b"Comment\0" + words.encode("latin-1", "replace")) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def write_fixtures(folder: str | Path) -> Path:
    """The synthetic documents as a dataset directory; their images hold the labels as text, not drawn."""
    folder = Path(folder)
    (folder / "images").mkdir(parents=True)
    rows = fixtures()
    for row in rows:
        (folder / row["image"]).write_bytes(_png(json.dumps(row["expected_fields"])))
    (folder / "annotations.jsonl").write_text("".join(json.dumps(row, ensure_ascii=False) + "\n" for row in rows), encoding="utf-8")
    return folder / "annotations.jsonl"
