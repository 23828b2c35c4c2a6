"""Exact values by rank in bounded memory, by counts of value ranges.

A group's range of values is cut into parts; one aggregate counts the values of each part, and the running sum of at most ``PARTS``
counts a group tells which part holds a rank. That part is cut again, until all its values are equal or so few are left that they fit
one row. A group's values never meet in a task, however many there are. The first cut is by magnitude, so that what is cut later spans
a factor of about two, and a few equal cuts reach the last bit of a double.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop, durable

#: Parts of a range, and values of a part that are sorted in one row.
PARTS, FEW = 4096, 4096
#: Groups whose ranges are broadcast; with more, rows and ranges meet in a join by group.
MANY = 10_000


#: More than the logarithm of any finite double, however small or large, is away from 0.
SPAN = 746


def _part(x: Column, low: Column, high: Column, first: bool) -> Column:
    """The part of a range in which a value lies. Each step keeps the order of values, so parts never cross. Behind the first cut a range
    is far from overflow, and its two ends fall into different parts, so it always gets smaller."""
    if first:
        size = F.when(x == 0, F.lit(0.0)).otherwise(F.ln(F.abs(x)) + SPAN)
        at = F.floor((F.when(x < 0, -size).otherwise(size) + 2 * SPAN) / (4 * SPAN) * PARTS)
    else:
        at = F.floor((x - low) / F.when(high > low, high - low) * PARTS)
    return F.least(F.greatest(at, F.lit(0)), F.lit(PARTS - 1)).cast("int")


def at_ranks(rows: DataFrame, value: str, by: tuple[str, ...], ranks: dict[str, tuple[Column, ...]]) -> DataFrame:
    """(by…, n, and for each name of ``ranks`` an array of values): the values that have the ranks (from 0, in ascending order) that
    ``ranks`` names, each an expression over ``n``, the number of a group's values. Values that are null, NaN or infinite are
    left out; groups without a value have no row. Groups that are null in a key are groups. ``rows`` is read once; what is read
    of it is written to the shared folder."""
    keys = [f"_k{i}" for i in range(len(by))]
    same = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in ["_one", *keys]])
    x = F.col(value).cast("double")
    slim = rows.where(F.abs(x) < float("inf")).select(F.lit(1).alias("_one"), *[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], (x + F.lit(0.0)).alias("x"))
    slim = durable(slim, "ranks")
    ends = slim.groupBy("_one", *keys).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    wanted = F.array_distinct(F.array(*[r.cast("bigint") for rs in ranks.values() for r in rs]))
    totals = durable(ends.withColumn("ranks", wanted), "ranks-groups")
    small = totals.count() <= MANY
    # one row for each group and rank: the range that holds it, how many values the range has, and how many lie below it
    open_ = durable(totals.select("_one", *keys, F.explode("ranks").alias("rank"), "low", "high", F.lit(0).cast("bigint").alias("below"), F.col("n").alias("held")), "ranks-open")
    first = True
    while not open_.where((F.col("low") < F.col("high")) & (F.col("held") > FEW)).isEmpty():
        ranges = open_.where((F.col("low") < F.col("high")) & (F.col("held") > FEW)).select("_one", *keys, "low", "high", "below").distinct()
        r = F.broadcast(ranges) if small else ranges
        inside = slim.join(r, same(slim, r) & (slim["x"] >= r["low"]) & (slim["x"] <= r["high"])).select(slim["_one"], *[slim[k] for k in keys], "low", "below", "x", _part(F.col("x"), F.col("low"), F.col("high"), first).alias("part"))
        counts = inside.groupBy("_one", *keys, "low", "below", "part").agg(F.count("*").alias("held"), F.min("x").alias("first"), F.max("x").alias("last"))
        running = F.sum("held").over(Window.partitionBy(*keys, "low").orderBy("part")) - F.col("held") + F.col("below")
        parts = counts.withColumn("from", running).select(*["_one", *keys], F.col("low").alias("of"), "first", "last", "from", F.col("held").alias("size"))
        met = open_.join(parts, same(open_, parts) & (open_["low"] == parts["of"]) & (open_["held"] > FEW) & (open_["low"] < open_["high"]) & (open_["rank"] >= parts["from"]) & (open_["rank"] < parts["from"] + parts["size"]), "left")
        pick = lambda new, old: F.coalesce(parts[new], open_[old]).alias(old)
        after = durable(met.select(open_["_one"], *[open_[k] for k in keys], "rank", pick("first", "low"), pick("last", "high"), pick("from", "below"), pick("size", "held")), "ranks-open")
        drop(open_)
        open_, first = after, False
    ranges = open_.where("low < high").select("_one", *keys, "low", "high").distinct()
    r = F.broadcast(ranges) if small else ranges
    inside = slim.join(r, same(slim, r) & (slim["x"] >= r["low"]) & (slim["x"] <= r["high"])).select(slim["_one"], *[slim[k] for k in keys], "low", "x")
    lists = inside.groupBy("_one", *keys, "low").agg(F.array_sort(F.collect_list("x")).alias("xs")).withColumnRenamed("low", "of")
    met = open_.join(lists, same(open_, lists) & (open_["low"] == lists["of"]), "left")
    found = met.select(open_["_one"], *[open_[k] for k in keys], "rank", F.coalesce(F.get("xs", (F.col("rank") - F.col("below")).cast("int")), F.col("low")).alias("v"))
    mapped = found.groupBy("_one", *keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    both = totals.join(mapped, same(totals, mapped)).select(*[totals[k].alias(c) for c, k in zip(by, keys, strict=True)], "n", "at")
    return both.select(*by, "n", *[F.array(*[F.element_at("at", r.cast("bigint")) for r in rs]).alias(name) for name, rs in ranks.items()])


def percentiles(rows: DataFrame, value: str, by: tuple[str, ...], shares: dict[str, float]) -> DataFrame:
    """(by…, n, a column of each name): exact percentiles, linear between neighbouring values, by ``at_ranks``."""
    place = lambda q: F.lit(q) * (F.col("n") - 1)
    got = at_ranks(rows, value, by, {name: (F.floor(place(q)), F.ceil(place(q))) for name, q in shares.items()})
    part = lambda q: place(q) - F.floor(place(q))
    lerp = lambda name, q: F.get(name, F.lit(0)) * (1 - part(q)) + F.get(name, F.lit(1)) * part(q)
    return got.select(*by, "n", *[lerp(name, q).alias(name) for name, q in shares.items()])
