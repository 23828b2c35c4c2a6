"""An append-only ledger of what a model answered: each answer is there before the next document is asked.

A task writes what it was answered to a segment of its own, below ``<ledger>/<job>/<partition>/``. On a file system each answer is
appended and flushed at once; on an object store, which can't append, ``every`` answers are one object. Nothing is ever changed or
moved. A task that runs again reads the segments of its partition first and asks for the rest alone; a later job leaves out whatever
any segment holds. So a failed worker, executor or driver costs at most the answer that was on its way (and on an object store those
of the last unwritten segment). Two attempts that run at the same time can't see each other: keep ``spark.speculation`` off.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import made_folder, on_files

ANSWERS = ("prediction", "raw_output", "metadata", "error", "raw_error_output", "wall_seconds", "view", "request_started")
#: ``done`` is a line's last key: a line that a failure cut short lacks it, and counts as never written.
LINE = "request string, id string, prediction string, raw_output string, metadata string, error string, raw_error_output string, wall_seconds double, view string, request_started boolean, done boolean"


class Segments:
    """The segments of one partition of one job, as a task sees them."""

    def __init__(self, ledger: str, job: str, partition: int, every: int = 16):
        self.store, root = pyarrow.fs.FileSystem.from_uri(on_files(ledger) or ledger)
        self.folder, self.every, self.held = f"{root.rstrip('/')}/{job}/{partition}", every, []
        self.appends = isinstance(self.store, pyarrow.fs.LocalFileSystem)
        self.stream = None

    def answered(self) -> set[str]:
        """The requests that earlier attempts of this partition have the answers of."""
        found = set()
        for info in self.store.get_file_info(pyarrow.fs.FileSelector(self.folder, allow_not_found=True)):
            with self.store.open_input_stream(info.path) as stream:
                for line in stream.read().split(b"\n"):
                    try:
                        row = json.loads(line)
                    except ValueError:
                        continue
                    if row.get("done"):
                        found.add(row["request"])
        return found

    def _new(self) -> str:
        self.store.create_dir(self.folder, recursive=True)
        return f"{self.folder}/{uuid.uuid4().hex}.jsonl"

    def append(self, row: dict[str, Any]) -> None:
        line = (json.dumps(row | {"done": True}, ensure_ascii=False) + "\n").encode()
        if self.appends:
            if self.stream is None:
                self.stream = self.store.open_append_stream(self._new())
            self.stream.write(line)
            self.stream.flush()
            return
        self.held.append(line)
        if len(self.held) >= self.every:
            self.close()

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None
        if self.held:
            with self.store.open_output_stream(self._new()) as stream:
                stream.write(b"".join(self.held))
            self.held = []


def read(spark: SparkSession, ledger: str) -> DataFrame:
    """(request, id, …): one row per request that the ledger holds the answer of."""
    made_folder(spark, ledger)
    lines = spark.read.schema(LINE).option("recursiveFileLookup", True).json(ledger).where("done and request is not null").drop("done")
    # attempts that ran together may have asked for the same; any fixed choice will do
    return lines.groupBy("request").agg(F.min(F.struct(*[c for c in lines.columns if c != "request"])).alias("a")).select("request", "a.*")


def keyed(documents: DataFrame, salt: str) -> DataFrame:
    """``documents`` with ``request``: a hash of all that a model sees of a row, its id, and ``salt`` (which model, over which data)."""
    seen = F.to_json(F.struct(*[F.col(c) for c in documents.columns]), {"ignoreNullFields": "false"})
    return documents.withColumn("request", F.sha2(F.concat(F.lit(salt), F.lit("\n"), seen), 256))


def unanswered(requests: DataFrame, ledger: str) -> DataFrame:
    """The rows of ``requests`` (with ``request``) that the ledger has no answer for."""
    return requests.join(read(requests.sparkSession, ledger).select("request"), "request", "left_anti")


def asked(todo: DataFrame, ledger: str, ask, every: int = 16) -> int:
    """Ask for all rows of ``todo`` (with ``request``), and return how many were asked for now. ``ask`` makes, once a task, what gives
    a dict of ANSWERS for a row. A request that stands twice is asked once."""
    from pyspark import TaskContext

    job = uuid.uuid4().hex
    parts = max(int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions")), todo.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        segments = Segments(ledger, job, TaskContext.get().partitionId(), every)
        known, answer = segments.answered(), None
        try:
            for batch in batches:
                n = 0
                for row in batch.itertuples(index=False):
                    if row.request in known:
                        continue
                    answer = answer or ask()
                    segments.append({"request": row.request, "id": row.id} | answer(row))
                    known.add(row.request)
                    n += 1
                yield pd.DataFrame({"n": [n]})
        finally:
            segments.close()

    # all rows of a request meet in one task, and a task that runs again has the same rows
    counts = todo.repartition(parts, "request").mapInPandas(run, "n long")
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
