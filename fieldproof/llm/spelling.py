"""Spelling variant grouping: words one edit apart, found by an even-partition pigeonhole join.

A word of length l is cut into two even segments. One edit leaves one of them whole, so an equal word of length l, or
one of length l + 1, holds one segment at its place, or shifted by one behind the edit. Words are indexed by each segment
of their own length; equal and one-longer words probe by the substrings that may match. A segment that many words share
is cut again the same way: as the edit must lie in the rest, the rest's two halves obey the same pigeonhole, so the key
grows by one of them. In the end only words that agree in all but one place meet, so no group is ever paired whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, durable, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
#: A group of one key with more words than this is cut again, unless only one place is left open.
GROUP = 64
#: Of so many pairs (document, run) one loses a code point.
TYPO = 97


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = 5, typo: int = TYPO) -> DataFrame:
    """(word), a row per occurrence: runs of letters, A-Z lower-cased, of ``least_chars`` code points and more. If ``typo``
    divides the crc32 of ``<doc_id>:<run>``, the run loses its code point number crc32 % length (0: no run does)."""
    runs = F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))
    said = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    said = said.where(F.char_length("run") >= least_chars).select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    if not typo:
        return said.select(F.col("run").alias("word"))
    hashed = said.select("run", F.crc32(F.concat("doc", F.lit(":"), "run")).alias("h"), F.char_length("run").alias("size"))
    at = (F.col("h") % F.col("size")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("size")))
    words = hashed.select(F.when(F.col("h") % typo == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= least_chars)


def vocabulary(said: DataFrame, least: int = 3) -> DataFrame:
    """(word, n, rank) of the words that occur ``least`` times or more, written to the shared folder. Ranks rise from the
    most frequent word to the rarest, words of equal n in code-point order, so that the best of some words is the least rank."""
    counted = said.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return durable(counted.orderBy(F.desc("n"), "word").withColumn("rank", F.monotonically_increasing_id()), "spelling-words")


def _keyed(rows: DataFrame, gaps: Column) -> DataFrame:
    """(key, rank, word, longer, a, b) for every gap [a, b) of a word: what stands before and behind the gap is the key.
    Places are those of the shorter word; the gap of a word that is one longer (longer = 1) is one longer too."""
    each = rows.select("rank", "word", "longer", F.explode(gaps).alias("gap")).select("rank", "word", "longer", "gap.a", "gap.b")
    before, behind = F.substring("word", F.lit(1), F.col("a")), F.substring("word", F.col("b") + F.col("longer") + 1, F.char_length("word"))
    return each.select(F.xxhash64(F.char_length("word") - F.col("longer"), "a", "b", before, behind).alias("key"), "rank", "word", "longer", "a", "b")


def _gap(a: Column, b: Column) -> Column:
    return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))


def _segments(words: DataFrame, least_chars: int) -> DataFrame:
    """The keys of both segments: of the words' own length, and of the length below, for which a word is one longer."""
    sized = words.select("rank", "word", F.explode(F.array(F.lit(0), F.lit(1))).alias("longer"))
    base = F.char_length("word") - F.col("longer")
    half = F.floor(base / 2)
    return _keyed(sized.where(base >= least_chars), F.array(_gap(F.lit(0), half), _gap(half, base)))


def _verified(keys: DataFrame) -> DataFrame:
    """(one, other), ranks of the words of a key that are one edit apart. Of the gaps that hold a pair's edit, just the
    one with the first place at which the words differ gives it, so no pair comes twice."""
    r = keys.where("longer = 0").select("key", "a", "b", F.col("rank").alias("one"), F.col("word").alias("x"))
    s = keys.select("key", "a", "b", F.col("rank").alias("other"), F.col("word").alias("y"), "longer")
    prefix = lambda w, n: F.substring(w, F.lit(1), F.col(n))
    met = r.join(s, ["key", "a", "b"]).where((F.col("longer") == 1) | (F.col("one") < F.col("other")))
    met = met.where(F.char_length("y") - F.col("longer") == F.char_length("x"))
    met = met.where((prefix("x", "a") == prefix("y", "a")) & ((F.col("b") == F.char_length("x")) | (prefix("x", "b") != prefix("y", "b"))))
    return met.where(F.levenshtein("x", "y", 1) == 1).select("one", "other")


def near(words: DataFrame, least_chars: int = 1, group: int = GROUP) -> DataFrame:
    """(rank, n_near, best) for each of ``words`` (word, rank; no word twice) that has a near word: how many it has and the least
    rank of them. ``words`` is read at each step, so it should be a written table."""
    keys, found = durable(_segments(words, least_chars), "spelling-keys"), []
    while True:
        large = keys.where("b - a > 1").groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > group).select("key")
        pairs = _verified(keys.join(large, "key", "left_anti"))
        both = pairs.select(F.explode(F.array(F.struct(F.col("one").alias("rank"), F.col("other").alias("best")), F.struct(F.col("other").alias("rank"), F.col("one").alias("best")))).alias("p"))
        found.append(durable(both.select("p.*").groupBy("rank").agg(F.count("*").alias("n_near"), F.min("best").alias("best")), "spelling-near"))
        middle = F.floor((F.col("a") + F.col("b")) / 2)
        rest = keys.join(large, "key", "left_semi")
        halves = rest.select("rank", "word", "longer", F.array(_gap(F.col("a"), middle), _gap(middle, F.col("b"))).alias("gaps"))
        after = durable(_keyed(halves, F.col("gaps")), "spelling-keys")
        drop(keys)
        keys = after
        if keys.isEmpty():
            break
    met = found[0]
    for more in found[1:]:
        met = met.union(more)
    return met.groupBy("rank").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(rank, root) for ``forms`` (rank, form): the last of the chain of forms, each of which stands before the word it is
    the form of. Chains are halved in each round, so there are as many rounds as the logarithm of the longest."""
    reached = durable(forms.select("rank", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = reached.select(F.col("rank").alias("root"), F.col("root").alias("further"))
        after = durable(reached.join(ahead, "root", "left").select("rank", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        drop(reached)
        reached = after
        if reached.where("moved").isEmpty():
            return reached.select("rank", "root")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 3, least_chars: int = 5, ratio: int = 2, group: int = GROUP, typo: int = TYPO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the whole texts that occurs ``least`` times or more.

    Words are near if one inserted, deleted or replaced code point makes one of the other. A word's form is its near word of
    largest n (ties: the smallest in code-point order) if that n is at least ``ratio`` times its own; its root is the last
    word that forms lead to, or the word itself. Null and empty texts have no word; a null doc_id counts as empty
    text in what is hashed; repeated rows count each; an empty table gives no row; other columns are not read. A text is one
    row's array of runs, so it may be as long as an array of its letters fits a task. Words of any length are compared whole."""
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or forms may lead in a circle")
    words = vocabulary(occurrences(docs, doc_id, text, least_chars, typo), least)
    close = durable(near(words, least_chars, group), "spelling-close")
    named = words.select(F.col("rank").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n"))
    # words without a near word, or without a form, lead to themselves: no null is ever a key of a join
    best = words.join(close, "rank", "left").select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("best", "rank").alias("form"))
    formed = best.join(named, "form").withColumn("has", (F.col("form") != F.col("rank")) & (F.col("form_n") >= ratio * F.col("n")))
    formed = durable(formed, "spelling-forms")
    last = roots(formed.where("has").select("rank", "form"))
    out = formed.join(last, "rank", "left").withColumn("root", F.coalesce("root", "rank"))
    out = out.join(words.select(F.col("rank").alias("root"), F.col("word").alias("root_word")), "root")
    only = lambda c: F.when(F.col("has"), F.col(c))
    return out.select("word", only("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", only("form_n").alias("form_n"))


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: crc32 by its rule: eight shifts of each byte; letters beyond ASCII are two bytes, 0xC3 and the code point less 0x40.
ORACLE = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
said AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 5 GROUP BY ALL),
bytes AS (
  SELECT run, k, list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':', ''), lambda c: unicode(c)::BIGINT)
         || flatten(list_transform(string_split(run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)) AS b FROM said),
rule AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda x, s: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) AS r(i))),
hashed AS (
  SELECT run, k, xor(list_reduce([4294967295::BIGINT] || b, lambda x, y: xor(t[(xor(x, y) & 255) + 1], x >> 8)), 4294967295::BIGINT) AS h FROM bytes, rule),
cut AS (
  SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed),
v AS (SELECT word, sum(k)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
holes AS (
  SELECT word, n, substring(word, 1, i::INT) AS x, substring(word, i::INT + 2) AS y, length(word) AS size FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM holes AS a JOIN holes AS b ON a.x = b.x AND a.y = b.y AND a.word <> b.word
  UNION SELECT h.word, v.word, v.n FROM holes AS h JOIN v ON v.word = h.x || h.y
  UNION SELECT v.word, h.word, h.n FROM holes AS h JOIN v ON v.word = h.x || h.y),
best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top, min_by(other, struct_pack(a := -other_n, b := encode(other))) AS other FROM pairs GROUP BY word),
forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * v.n THEN other END AS form, CASE WHEN top >= 2 * v.n THEN top END AS form_n
  FROM v LEFT JOIN best ON best.word = v.word),
walk AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.at WHERE forms.form IS NOT NULL),
ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN forms ON forms.word = walk.at WHERE forms.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms AS f JOIN ends AS e ON e.word = f.word
"""
