"""Files that tasks write: a sink of (path, content) rows that publishes all of them at once, and lines put together in order.

``FileSink`` is a data source of Spark's own interface. Tasks write below a folder beside the target, each file under a name of its own
first and then renamed, so an attempt that runs again, or twice, leaves the same files. The driver's only work is one rename of that
folder when all tasks are done, or its removal when one fails; no content goes through it.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..session import new_path, on_files

FORMAT = "fieldproof_files"
#: Fixed value: what a folder that is there already gets said.
EXISTS = "Output already exists; choose a new directory"


def store_of(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    store, root = pyarrow.fs.FileSystem.from_uri(on_files(path) or path)
    return store, root.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    files: int


def _exists(store: pyarrow.fs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type != pyarrow.fs.FileType.NotFound


class FileWriter(DataSourceWriter):
    def __init__(self, target: str):
        self.target, self.stage = target, f"{target.rstrip('/')}.staged-{uuid.uuid4().hex}"
        store, root = store_of(target)
        if _exists(store, root):
            raise ValueError(EXISTS)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, root = store_of(self.stage)
        made, n = set(), 0
        for path, content in iterator:
            clean = posixpath.normpath(path)
            if clean.startswith(("/", "..")) or clean == "." or content is None:
                raise ValueError(f"no file can be written as {path!r}" if content is not None else f"{path!r} has no content")
            target = f"{root}/{clean}"
            folder = posixpath.dirname(target)
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            own = f"{target}.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as stream:
                stream.write(bytes(content))
            store.move(own, target)
            n += 1
        return Written(n)

    def commit(self, messages: list) -> None:
        store, root = store_of(self.target)
        if not sum(m.files for m in messages if m):
            store.create_dir(root, recursive=True)
            return
        store.create_dir(posixpath.dirname(root), recursive=True)
        store.move(store_of(self.stage)[1], root)

    def abort(self, messages: list) -> None:
        store, root = store_of(self.stage)
        if _exists(store, root):
            store.delete_dir(root)


class FileSink(DataSource):
    """(path, content) rows as files below the folder ``path``, which must not be there yet."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"])


def write_files(files: DataFrame, folder: str) -> None:
    """(path, content) of ``files`` as files below ``folder``, all or none of them. Rows that share a path are an error: which of them
    stayed would depend on the order of tasks."""
    spark = files.sparkSession
    twice = files.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0]['path']!r} stands twice")
    spark.dataSource.register(FileSink)
    files.select("path", F.col("content").cast("binary").alias("content")).write.format(FORMAT).mode("append").save(folder)


def joined_lines(lines: DataFrame, order: list[str | Column], line: str, path: str, head: bytes = b"") -> int:
    """One file of the texts ``line`` in the order of ``order``, and how many there are. Tasks sort and write parts; the parts' bytes are
    then put one behind another in pieces, so neither a row nor a part is ever held whole here."""
    spark = lines.sparkSession
    parts = new_path(spark, "lines")
    lines.orderBy(*order).select(F.col(line).alias("value")).write.text(parts)
    store, root = store_of(parts)
    names = sorted(i.path for i in store.get_file_info(pyarrow.fs.FileSelector(root)) if posixpath.basename(i.path).startswith("part-"))
    target, place = store_of(path)
    n = 0
    with target.open_output_stream(place) as out:
        out.write(head)
        for name in names:
            with store.open_input_stream(name) as stream:
                while piece := stream.read(1 << 20):
                    out.write(piece)
                    n += piece.count(b"\n")
    store.delete_dir(root)
    return n
