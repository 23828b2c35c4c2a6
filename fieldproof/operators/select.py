"""Selections in file order and generated ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import at_ranks

#: Rows from the beginning that a task and the driver may hold (of one column).
NEAR = 10_000

#: Phases of an experiment as (offset, limit), and how many documents of a split a run takes.
PHASES = {"pilot": (0, 20), "holdout": (20, 80)}
SPLIT_LIMITS = {"validation": 20, "test": 100}


def offset_limit(rows: DataFrame, offset: int = 0, limit: int | None = None, order: str = "line_no") -> DataFrame:
    """Rows from ``offset`` on, ``limit`` of them at most, in file order. ``order`` differs from row to row.

    The places where the selection begins and ends are found first: near the beginning among the first rows alone (each task sends no
    more of them than are asked for), farther on by rank (``ranks``; ``order`` is a number), so no task or driver holds the rows
    before. The selection itself is a filter, so all that follows stays distributed."""

    def place(n: int):
        if n <= NEAR:
            return rows.select(order).orderBy(order).limit(n).agg(F.max(order)).first()[0] if n else None
        found = at_ranks(rows, order, (), {"at": (F.least(F.lit(n - 1), F.col("n") - 1),)}).first()
        return found and found["at"][0]

    start, end = place(offset), None if limit is None else place(offset + limit)
    if limit is not None and end is None:
        return rows.where("false")
    out = rows if start is None else rows.where(F.col(order) > start)
    return out if limit is None else out.where(F.col(order) <= end)


def numbered(rows: DataFrame, order: list[str], prefix: str, split: str) -> DataFrame:
    """Adds n (the place in the whole source, from 0, rejected rows included) and id (``prefix-split-0000``).

    Places are counted by file part first, so that a sort of each part, not of the whole source, gives them:
    ``order`` is the part and the place within it."""
    part, place = order
    sizes = rows.groupBy(part).agg(F.count("*").alias("_c"))
    # one row per file: the running total over files is small
    before = sizes.select(part, (F.sum("_c").over(Window.orderBy(part)) - F.col("_c")).alias("_before"))
    within = F.row_number().over(Window.partitionBy(part).orderBy(place)) - 1
    out = rows.withColumn("_within", within).join(before, part).withColumn("n", F.col("_before") + F.col("_within"))
    return out.drop("_within", "_before").withColumn("id", F.format_string(f"{prefix}-{split}-%04d", "n"))


def first_of_source(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first rows of a numbered source, rejected ones counting."""
    return rows if limit is None else rows.where(F.col("n") < limit)


def order_digest(rows: DataFrame, place: str, name: str) -> DataFrame:
    """One row with ``n`` and ``digest``: of which names stand at which places. Each row's two hashes are added up, so tasks' sums are
    added too, in any order; another name, or another place of a name, gives another digest (but for a chance of 2^-128)."""
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), F.col(place).cast("long"), F.col(name).cast("string")).cast("decimal(20,0)")) % F.lit(str(1 << 64)).cast("decimal(20,0)")
    shown = lambda seed: F.coalesce(part(seed).cast("string"), F.lit("0"))
    return rows.agg(F.count("*").alias("n"), F.concat_ws(":", F.count("*").cast("string"), shown(1), shown(2)).alias("digest"))


def first_failures(results: DataFrame, n: int = 5) -> DataFrame:
    """Failed or imperfect documents in their order."""
    return results.where("error is not null or correct < total").orderBy("doc_pos").limit(n)


def arms(documents: DataFrame, selections: dict[str, tuple[int, int | None]], names: list[str]) -> DataFrame:
    """(arm, phase, …): each selection of documents (with doc_pos) for each arm."""
    wanted = [
        F.when((F.col("doc_pos") >= low) & (F.col("doc_pos") < (1 << 62 if n is None else low + n)), F.struct(F.lit(arm).alias("arm"), F.lit(phase).alias("phase")))
        for phase, (low, n) in selections.items()
        for arm in names
    ]
    chosen = F.explode(F.filter(F.array(*wanted), lambda x: x.isNotNull())).alias("_arm")
    return documents.select("*", chosen).select("_arm.arm", "_arm.phase", *documents.columns)
