"""Quality rules: a threshold table compiled into one Spark projection.

Every ratio is a built-in expression, so a scan, one projection and no shuffle do the whole job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, table

SPACE = "[\\x20\\x09-\\x0D]"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Marks that may stand around a word.
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»‹›“”„‘’‚…–—"

#: Common function words of the languages that the corpus is written in.
STOP_WORDS = (
    "the be to of and that have with is are was in it for on as by this he from "
    "de la le les et un une des du est que dans pour sur par au qui ou "
    "der die das und ist von zu den mit ein eine für im auf nicht als "
    "el los las en y se por con del al su para una como"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails if ``metric`` (an SQL expression over the measured columns) is below ``least`` or above ``most``,
    and ``given`` holds, where there is one."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None
    given: str | None = None


#: Half way to another limit: a second sign of junk.
SUSPECT = "n_symbols > 0.15 * n_words or n_bangs > 0.25 * n_words or n_dup_lines > 0.25 * n_lines or n_repeat_words > 0.1 * n_words"

#: The threshold table. Ratios of a document without words are null and fail nothing here (the base rule has it). A lack of
#: stop words, with the marks around words taken off, counts only with a second sign, as short texts and those in other
#: languages have none either.
RULES = (
    Rule("mean_word_length", "word_chars / n_words", 2.0, 24.0),
    Rule("symbols_per_word", "n_symbols / n_words", most=0.3),
    Rule("bangs_per_word", "n_bangs / n_words", most=0.5),
    Rule("stop_word_ratio", "n_stop_tokens / n_words", least=0.01, given=SUSPECT),
    Rule("duplicate_line_ratio", "n_dup_lines / n_lines", most=0.5),
)


def _passes(rule: Rule) -> Column:
    value = F.expr(f"cast({rule.metric.split(' / ')[0]} as double) / nullif({rule.metric.split(' / ')[1]}, 0)")
    ok = F.lit(True)
    if rule.least is not None:
        ok = ok & (value >= rule.least)
    if rule.most is not None:
        ok = ok & (value <= rule.most)
    if rule.given is not None:
        ok = ok | ~F.expr(rule.given)
    return F.coalesce(ok, F.lit(True))


def _removed(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def _repeated(words: Column, windows: Column) -> Column:
    """Words that stand in a window which the text has twice or more.

    ``windows`` are 64-bit hashes. Texts with no hash twice are done at once. Else the hashes are sorted
    with their places in the low bits, equal neighbours become candidates, and the candidates' words are
    compared as strings, so that no hash collision can count."""
    low = (1 << 31) - 1
    packed = F.sort_array(F.transform(windows, lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))

    def bound(x: Column, f) -> Column:
        """f(x) with x evaluated once: lambdas refer to a bound value, while a column would be evaluated at each use."""
        return F.transform(F.array(x), f)[0]

    def equal(xs: Column, key) -> Column:
        return F.filter(
            xs,
            lambda x, j: F.coalesce(key(F.get(xs, j - 1)) == key(x), F.lit(False)) | F.coalesce(key(F.get(xs, j + 1)) == key(x), F.lit(False)),
        )

    maybe = bound(packed, lambda p: F.transform(equal(p, lambda x: x.bitwiseAND(F.lit(~low))), lambda x: x.bitwiseAND(F.lit(low)).cast("int")))
    spelled = F.sort_array(F.transform(maybe, lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, WINDOW)).alias("w"), i.alias("i"))))
    spans = bound(spelled, lambda s: F.sort_array(F.transform(equal(s, lambda x: x["w"]), lambda x: x["i"])))
    covered = bound(
        spans,
        lambda at: F.aggregate(
            F.transform(at, lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - i, F.lit(WINDOW)))),
            F.lit(0).cast("long"),
            lambda n, x: n + x,
        ),
    )
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(covered)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measured columns of every whole text. A null text counts as empty."""
    at_words, at_windows, at_lines = (free(x, docs.columns) for x in ("_words", "_windows", "_lines"))
    value = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(value, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))
    hashed = F.transform(F.col(at_words), lambda w: F.xxhash64(w))
    windows = F.when(
        F.size(at_words) >= WINDOW,
        F.transform(
            F.array(hashed),
            lambda h: F.transform(
                F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
            ),
        )[0],
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(value, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return (
        docs.withColumn(at_words, words)
        .withColumns({at_windows: windows, at_lines: lines})
        .withColumns(
            {
                "n_words": F.size(at_words).cast("long"),
                "word_chars": _removed(value, SPACES).cast("long"),
                "n_symbols": (F.char_length(value) - _removed(value, SYMBOLS)).cast("long"),
                "n_bangs": (F.char_length(value) - _removed(value, "!")).cast("long"),
                "n_lines": F.size(at_lines).cast("long"),
                "n_dup_lines": (F.size(at_lines) - F.size(F.array_distinct(at_lines))).cast("long"),
                "n_stop_words": F.size(F.filter(at_words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
                "n_repeat_words": _repeated(F.col(at_words), F.col(at_windows)),
            }
        )
        # words are stripped of marks only where too few are stop words as they stand
        .withColumn(
            "n_stop_tokens",
            F.when(F.col("n_stop_words") >= 0.01 * F.col("n_words"), F.col("n_stop_words")).otherwise(
                F.size(F.filter(at_words, lambda w: F.btrim(F.lower(w), F.lit(EDGES)).isin(STOP_WORDS))).cast("long")
            ),
        )
        .drop(at_words, at_windows, at_lines)
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_bangs", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words", "n_stop_tokens")


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``failed_rules`` and ``kept``.

    Rows are judged one by one: repeated rows and ties get equal verdicts, an empty table gives an empty
    result, an empty or null text has no word and fails the base rule. Columns of ``docs`` that carry the name
    of a measure or verdict are replaced. A text of any length is one row's arrays of words, lines and window hashes."""
    extra = {*MEASURES, "base_failed", "failed_rules", "kept"}
    measured = measure(docs.drop(*(extra - {text})), text)
    base = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    failed = F.filter(F.array(*[F.when(~_passes(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return measured.withColumns({"base_failed": base, "failed_rules": failed}).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    )


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``, clashing names included."""
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    # a column that is not deterministic keeps the filter above the measures; pushed below, it would compute each again
    judged = judge(marked, "text", rules).withColumn("_place", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("_place") >= 0)).select("row.*")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_bangs", "n_lines", "n_stop_words", "n_stop_tokens", F.concat_ws(",", "failed_rules").alias("failed_rules"),
    )


def _case(rule: Rule) -> str:
    top, bottom = rule.metric.split(" / ")
    ratio = f"(cast({top} as double) / nullif({bottom}, 0))"
    tests = [f"{ratio} < {rule.least}"] * (rule.least is not None) + [f"{ratio} > {rule.most}"] * (rule.most is not None)
    found = " OR ".join(tests)
    return f"CASE WHEN {f'({found}) AND ({rule.given})' if rule.given else found} THEN '{rule.name}' END"


_EDGES = EDGES.replace("'", "''")


ORACLE = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ln
  FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
k AS (SELECT doc_id, i, array_to_string(words[i:i+4], ' ') AS win FROM g),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM k),
r AS (
  SELECT doc_id, sum(least(5, coalesce(nx - i, 5))) AS n FROM (
    SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM d WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_bangs, len(ln)::BIGINT AS n_lines,
         len(list_filter(words, lambda x: list_contains({STOP_WORDS!r}, lower(x))))::BIGINT AS n_stop_words,
         len(list_filter(words, lambda x: list_contains({STOP_WORDS!r}, trim(lower(x), '{_EDGES}'))))::BIGINT AS n_stripped
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
t AS (SELECT *, CASE WHEN n_stop_words >= 0.01 * n_words THEN n_stop_words ELSE n_stripped END AS n_stop_tokens FROM m),
v AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
         concat_ws(',', {', '.join(map(_case, RULES))}) AS failed_rules
  FROM t)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND failed_rules = '') AS kept, n_bangs, n_lines, n_stop_words, n_stop_tokens, failed_rules
FROM v
"""
