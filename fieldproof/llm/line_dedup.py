"""Line dedup: overlapping windows of three consecutive lines, found globally by hash.

The first occurrence of a window stays; later ones cover their lines, covered positions are merged, and
covered lines are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

SPACES = " \t\n\x0b\f\r"
LINES = 3


def _windows(docs: DataFrame, doc_id: str, text: str, lines: int) -> DataFrame:
    """(doc, at, k1, k2): place (from 0, among the lines with a word) and 128-bit hash of each window."""
    trimmed = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES))), lambda x: x != "")
    pairs = F.transform(trimmed, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b")))
    keyed = lambda h, i, part: F.xxhash64(*[F.get(h, i + k)[part] for k in range(lines)])
    windows = F.transform(
        F.array(pairs),
        lambda h: F.when(
            F.size(h) >= lines,
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.size(h) - lines, F.lit(0))),
                lambda i: F.struct(i.alias("at"), keyed(h, i, "a").alias("k1"), keyed(h, i, "b").alias("k2")),
            ),
        ),
    )[0]
    return docs.select(F.col(doc_id).alias("doc"), F.explode(windows).alias("w")).select("doc", "w.at", "w.k1", "w.k2")


def covered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lines: int = LINES) -> DataFrame:
    """(doc, starts): the places of each document's windows that also stand earlier (smaller doc_id, or an
    earlier place of the same document). First occurrences are found by an aggregate that combines before the
    shuffle, so a window that a third of all documents share costs one row per task."""
    found = _windows(docs, doc_id, text, lines)
    first = found.groupBy("k1", "k2").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = found.join(first, ["k1", "k2"]).where(F.struct("doc", "at") > F.col("first"))
    return later.groupBy("doc").agg(F.collect_set("at").alias("starts"))


def _bound(x: Column, f) -> Column:
    """f(x) with x evaluated once."""
    return F.transform(F.array(x), f)[0]


def _strip(text: Column, starts: Column, lines: int) -> Column:
    """(kept, n_lines, n_removed) of a text whose windows at ``starts`` are covered; every step is linear."""

    def cut(rows: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(rows) - 1)
        full = F.filter(numbers, lambda i: F.btrim(F.get(rows, i), F.lit(SPACES)) != "")

        def merged(at: Column) -> Column:
            gone = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.array(*[F.get(at, s + k) for k in range(lines)]))))

            def rest(gone: Column) -> Column:
                kept = F.array_join(F.transform(F.array_except(numbers, gone), lambda i: F.get(rows, i)), "\n")
                return F.struct(kept.alias("kept"), F.size(at).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_removed"))

            return _bound(F.coalesce(gone, F.array().cast("array<int>")), rest)

        return _bound(full, merged)

    return _bound(F.split(F.coalesce(text, F.lit("")), "\n"), cut)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lines: int = LINES) -> DataFrame:
    """(row, kept_text, n_lines, n_removed): every row of ``docs`` as a struct, its text replaced by what is left.

    Lines are compared without outer white space; lines without a word take no part in windows and stay. Texts
    of fewer than ``lines`` such lines have no window and stay as they are, as do null and empty texts. Rows
    that share a doc_id are one place: a repeated row is not later than itself, so both stay whole. A null
    doc_id sorts before all others. A very long text is cut line by line in one task, as arrays of its lines and their
    places; its windows are rows of their own, spread by what they hold. An empty table gives an empty result.
    Extra columns, whatever their names, travel inside ``row``."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]) if len(docs.columns) > 1 else F.struct(F.lit(None).cast("int"))
    slim = docs.select(rest.alias("_rest"), F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    places = covered(docs, doc_id, text, lines)
    joined = slim.join(places, slim["_doc"].eqNullSafe(places["doc"]), "left").withColumn("_cut", _strip(F.col("_text"), F.col("starts"), lines))
    kept = F.when(F.col("starts").isNull(), F.col("_text")).otherwise(F.col("_cut.kept"))
    row = F.struct(*[kept.alias(c) if c == text else F.col("_rest").getField(c).alias(c) for c in docs.columns])
    return joined.select(row.alias("row"), kept.alias("kept_text"), "_cut.n_lines", "_cut.n_removed")


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup(docs)
    return out.select("row.doc_id", "n_lines", "n_removed", "kept_text")


ORACLE = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
f AS (SELECT doc_id, i, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM l),
o AS (SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM f WHERE x <> ''),
w AS (SELECT doc_id, i, p, x AS a, lead(x, 1) OVER d AS b, lead(x, 2) OVER d AS c FROM o WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS k FROM w WHERE c IS NOT NULL),
g AS (SELECT DISTINCT doc_id, p + d AS p FROM r, range(3) AS t(d) WHERE k > 1),
s AS (SELECT l.doc_id, l.i, l.line, o.p, g.p IS NOT NULL AS gone
      FROM l LEFT JOIN o ON o.doc_id = l.doc_id AND o.i = l.i LEFT JOIN g ON g.doc_id = l.doc_id AND g.p = o.p)
SELECT d.doc_id, count(s.p)::BIGINT AS n_lines, (count(*) FILTER (WHERE s.gone))::BIGINT AS n_removed,
       CASE WHEN any_value(d.text) IS NULL THEN NULL
            ELSE coalesce(string_agg(s.line, chr(10) ORDER BY s.i) FILTER (WHERE NOT s.gone), '') END AS kept_text
FROM documents AS d JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""
