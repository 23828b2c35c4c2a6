"""A dataset from a raw Parquet corpus: ids, labels and images of the rows that the task can use, and why others can't."""

from __future__ import annotations

import argparse
import re
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.parse import FIELD_PATHS, map_labels
from ..operators.review import TEXT_AMOUNT
from ..operators.validate import REVISION
from ..sources import readers, sinks
from ..sources.files import write_files

SPLITS = ("validation", "test")
#: Our own wording of the question that every document of the task gets.
QUESTION = (
    "Which amounts are printed on this receipt: the sum before charges, the tax, the service charge, the final sum, the cash handed over and the change? "
    "Give each as a text with the digits, separators and currency sign that are printed, null where none is printed, and compute nothing."
)


def annotations(spark: SparkSession, corpus: str, split: str, limit: int | None, source: dict) -> DataFrame:
    """(n, id, file_name, content, expected, reject, line) of the first ``limit`` rows of a split's files, in file order.
    Rejected rows count, and have a reason and no line."""
    rows = map_labels(readers.numbered_corpus(spark, corpus, split, limit)).withColumn("image_file", F.concat(F.lit("images/"), "id", F.lit(".png")))
    rules = F.create_map(*[F.lit(x) for name in FIELD_PATHS for x in (name, TEXT_AMOUNT)])
    origin = F.create_map(*[F.lit(x) for pair in sorted(source.items()) for x in pair]) if source else F.lit(None)
    row = F.struct("id", F.col("image_file").alias("image"), F.lit(QUESTION).alias("question"), rules.alias("field_schema"), F.col("expected").alias("expected_fields"), origin.alias("source"))
    return rows.select("n", "id", "image_file", F.col("image.bytes").alias("content"), "expected", "reject", F.when(F.col("reject").isNull(), F.to_json(row)).alias("line"))


def prepare(spark: SparkSession, corpus: str | Path, output: str | Path, split: str = "validation", limit: int | None = None, revision: str | None = None) -> dict:
    """annotations.jsonl, images and manifest.json of a new dataset directory. Images are written by tasks, as they are in the
    corpus, and stand in their folder all together or not at all."""
    if split not in SPLITS:
        raise ValueError("the split must be one of: " + ", ".join(SPLITS))
    if limit is not None and limit < 1:
        raise ValueError("--limit must be positive")
    if revision is not None and not re.fullmatch(REVISION, revision):
        raise ValueError("--revision must be a commit of 40 digits")
    output = Path(output)
    if output.exists():
        raise ValueError(f"{output} already exists; choose a new directory")
    source = {"split": split} | ({"revision": revision} if revision else {})
    rows = annotations(spark, str(corpus), split, limit, source)
    good, gone = rows.where("reject is null"), rows.where("reject is not null")
    if good.isEmpty():
        raise ValueError(sinks.NOTHING)
    hashes = {r["file"]: r["sha256"] for r in readers.binaries(spark, str(corpus), f"{split}-*.parquet").select("file", "sha256").toLocalIterator()}
    bare = good.where(F.coalesce(F.octet_length("content"), F.lit(0)) == 0).select("image_file").limit(1).collect()
    if bare:
        raise ValueError(f"no image in the corpus for {bare[0]['image_file']}")
    examined = rows.count()
    made = sinks.export_dataset(good, gone, source | {"prepared_at_utc": datetime.now(timezone.utc).isoformat(), "source_files_sha256": hashes}, examined, output)
    write_files(good.select(F.regexp_replace("image_file", "^images/", "").alias("path"), "content"), str(output.resolve() / "images"))
    return made


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Make a labelled dataset from a local Parquet corpus.")
    parser.add_argument("--corpus", type=Path, required=True)
    parser.add_argument("--split", choices=SPLITS, default="validation")
    parser.add_argument("--limit", type=int)
    parser.add_argument("--revision")
    parser.add_argument("--output", type=Path)
    args = parser.parse_args(argv)
    output = args.output or Path("data") / args.split
    try:
        made = prepare(readers.session(), args.corpus, output, args.split, args.limit, args.revision)
    except (ValueError, OSError) as e:
        parser.exit(2, f"Cannot prepare: {e}\n")
    print(f"{made['included_examples']} documents, {len(made['excluded'])} left out: {output / 'annotations.jsonl'}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
