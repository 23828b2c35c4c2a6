"""Chat formatting: collapse cumulative snapshots, then render.

A chat client logs the conversation so far after every exchange, so most logged conversations are
prefixes of longer ones. Rolling hashes of the turn prefixes find them, and anti-joins keep the maximal ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("conv_id", "turn", "role", "text")


def _hashed(turns: DataFrame) -> DataFrame:
    """Two hashes of role and text; nulls differ from empty texts."""
    parts = [F.coalesce("role", F.lit("")), F.col("role").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull()]
    return turns.withColumns({"h1": F.xxhash64(*parts), "h2": F.xxhash64(F.lit(7), *parts)})


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, k, n, p1, p2): the hash of each conversation's first k of n turns.

    The rolling hash is the xor of the turns' hashes, each salted by its place, so a running window
    computes it. Only hashes are shuffled, no text. Two of 64 bits tell prefixes apart; they are not compared turn by
    turn."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "h1", "h2")
    slim = _hashed(turns).select("conv_id", "turn", "h1", "h2")
    before = F.lag(F.struct("turn", "h1", "h2")).over(order)
    once = slim.withColumn("again", before.eqNullSafe(F.struct("turn", "h1", "h2"))).where(~F.col("again"))
    placed = once.withColumn("k", F.row_number().over(order).cast("long"))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select(
        "conv_id", "k", F.max("k").over(Window.partitionBy("conv_id")).alias("n"),
        F.bit_xor(F.xxhash64("k", "h1")).over(running).alias("p1"), F.bit_xor(F.xxhash64("k", "h2")).over(running).alias("p2"),
    )


def alone(turns: DataFrame) -> DataFrame:
    """(p1, p2, turn, role, text): turns that belong to no conversation, each one distinct, with the hashes of a
    conversation of that turn alone."""
    lost = _hashed(turns.where("conv_id is null").select(*COLUMNS[1:]).distinct())
    return lost.withColumns({"p1": F.xxhash64(F.lit(1).cast("long"), "h1"), "p2": F.xxhash64(F.lit(1).cast("long"), "h2")})


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, p1, p2) of conversations that no longer one starts with. Of equal conversations
    the smallest conv_id stays and n_copies counts them all."""
    one = F.lit(1).cast("long")
    single = alone(turns).select(F.lit(None).cast(turns.schema["conv_id"].dataType).alias("conv_id"), one.alias("k"), one.alias("n"), "p1", "p2")
    rolled = prefixes(turns.where("conv_id is not null"))
    whole = rolled.where("k = n").union(single).groupBy("n", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    shorter = rolled.where("k < n").select(F.col("k").alias("n"), "p1", "p2").distinct()
    return whole.join(shorter, ["n", "p1", "p2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies", "p1", "p2")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered): one row per maximal conversation.

    Turns are ordered by ``turn`` (null first), ties by content hash; a repeated row counts once. A null role
    reads ``unknown``, a null text is empty, and ``<|`` inside a role or text becomes ``< |`` so that no text
    can forge a turn. A turn without a conv_id belongs to no conversation and stands as one of its own. Other columns are
    ignored; an empty table gives an empty result. Texts of any length are passed on whole; a conversation is one row of
    the result."""
    turns = turns.select(*COLUMNS)
    chosen = maximal(turns)
    safe = lambda c, default: F.replace(F.coalesce(F.col(c), F.lit(default)), F.lit("<|"), F.lit("< |"))
    said = F.concat(F.lit("<|im_start|>"), safe("role", "unknown"), F.lit("\n"), safe("text", ""), F.lit("<|im_end|>\n"))
    kept = _hashed(turns.where("conv_id is not null")).withColumn("said", said).join(chosen.drop("p1", "p2"), "conv_id")
    rows = kept.select("conv_id", "n_turns", "n_copies", F.struct("turn", "h1", "h2", "said").alias("row"))
    # a row of the result holds one conversation, so its turns meet in one row anyway
    lists = rows.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_sort(F.array_distinct(F.collect_list("row"))).alias("rows"))
    whole = lists.select("conv_id", "n_turns", "n_copies", F.array_join(F.col("rows.said"), "").alias("rendered"))
    lost = alone(turns).join(chosen.where("conv_id is null"), ["p1", "p2"])
    single = lost.groupBy("p1", "p2", "conv_id", "n_turns", "n_copies").agg(F.min(said).alias("rendered"))
    return whole.union(single.select(*whole.columns))


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return render(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (
  SELECT NULL AS conv_id, 1 AS n, [{'r': role, 't': text}] AS turns, '<|im_start|>' || replace(coalesce(role, 'unknown'), '<|', '< |') || chr(10)
         || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10) AS rendered FROM d WHERE conv_id IS NULL
  UNION ALL
  SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY turn NULLS FIRST) AS turns,
         string_agg('<|im_start|>' || replace(coalesce(role, 'unknown'), '<|', '< |') || chr(10)
                    || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST) AS rendered
  FROM d WHERE conv_id IS NOT NULL GROUP BY conv_id),
g AS (SELECT turns, n, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(rendered) AS rendered FROM c GROUP BY turns, n)
SELECT conv_id, n::BIGINT AS n_turns, n_copies::BIGINT AS n_copies, rendered
FROM g WHERE NOT EXISTS (SELECT 1 FROM g AS o WHERE o.n > g.n AND o.turns[1:g.n] = g.turns)
"""
