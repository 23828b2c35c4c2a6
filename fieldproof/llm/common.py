"""Helpers shared by the corpus operators: table readers, durable cuts, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..session import drop, durable, ship

__all__ = ["beside", "connected", "drop", "durable", "few", "free", "labels", "partitions", "table", "utf8"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def free(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def beside(row: DataType, fields: str) -> StructType:
    """The schema of ``row`` (of that type, whatever its columns are called) and of ``fields``."""
    return StructType([StructField("row", row), *StructType.fromDDL(fields).fields])


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def few(df: DataFrame, by: int = 8) -> DataFrame:
    """The same rows in fewer partitions, one for ``by`` of the session's. For small tables that are written: each file
    costs the store, and a task that makes one, more than its rows do."""
    return df.coalesce(partitions(df) // by + 1)


def spark_hash(values: np.ndarray) -> np.ndarray:
    """Spark's ``hash`` of ints: 32-bit Murmur3 with the seed 42."""
    def turned(x, r):
        return (x << np.uint32(r)) | (x >> np.uint32(32 - r))

    k = turned(values.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = turned(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h = h ^ np.uint32(4)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).astype(np.int32)


def labels(parts: int, each: int = 1) -> np.ndarray:
    """parts * each different ints, of which the i-th falls into partition i % parts when they are dealt to ``parts``
    partitions by Spark's hash. Plain numbers would leave some partitions empty and give others several."""
    size = parts * (3 * each + 24)
    while True:
        at = spark_hash(np.arange(size)).astype(np.int64) % parts
        order = np.argsort(at, kind="stable")
        first = np.searchsorted(at[order], np.arange(parts))
        if np.bincount(at, minlength=parts).min() >= each:
            return np.concatenate([order[first + k] for k in range(each)]).astype(np.int32)
        size *= 2


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column as one array, and the n + 1 offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(at), np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def connected(links: DataFrame, label: str = "links") -> DataFrame:
    """(id, component) for every id that stands in ``links`` (a, b): component is the smallest id reachable.

    Alternating large-star and small-star steps; links that stay are written to the shared folder after
    each round, so nothing is gathered on the driver and no lineage builds up. A step moves every link
    once, whatever the size of a component; a hot centre is only a grouping key of min(), which is
    combined before the shuffle, and its join back can be split by AQE."""
    spark = links.sparkSession
    edges = durable(few(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()), label)
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour of u is linked to the least of u's neighbourhood
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour of u, and u itself, is linked to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after = durable(few(small), label)
        # a fixed point when every node has one link and no centre is itself linked
        tops = after.groupBy(F.col("u").alias("top")).agg(F.count("*").alias("n"))
        done = tops.where("n > 1").isEmpty() and after.join(tops, F.col("v") == F.col("top"), "left_semi").isEmpty()
        edges = after
        if done:
            break
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
