"""URL filters: pattern rules indexed by their rarest literal token.

A URL's tokens fetch the candidate rules, and only those run regular expressions. With up to
``INLINE_RULES`` rules the index is a literal map inside one projection (no shuffle); a longer list
becomes a table that is joined by token, over distinct URLs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
INLINE_RULES = 256
HOST, PATTERN = "host", "pattern"


@dataclass(frozen=True)
class Rule:
    """kind ``host``: host and path prefix, regex over host and path; kind ``pattern``: regex over the
    lower-cased rest of the URL after ``://``. Of the host rules that fit, the longest decides; a pattern
    rule decides only where no host rule fits."""

    rule: str
    verdict: str
    kind: str
    regex: str
    tokens: tuple[str, ...]


def _escape(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", s)


def _whole_tokens(s: str) -> tuple[str, ...]:
    """Alphanumeric runs of a rule that are whole tokens of every URL that it fits: bounded on both sides by
    other characters, where the host's start counts as a bound and a wildcard does not."""
    found = re.finditer(r"[a-z0-9]+", s)
    return tuple(m[0] for m in found if (m.start() and s[m.start() - 1] != "*") and (m.end() < len(s) and s[m.end()] != "*"))


def host_rule(text: str, verdict: str) -> Rule:
    """``org/fr/`` fits the host ``org``, all its subdomains, and paths that start with ``/fr/``."""
    host, _, path = text.partition("/")
    host = host.translate(str.maketrans(UPPER, LOWER))
    return Rule(text, verdict, HOST, rf"(?s)^(?:[^/]*\.)?{_escape(host)}{_escape('/' + path)}", _whole_tokens("." + host + "/" + path.lower()))


def pattern_rule(text: str, verdict: str = "block") -> Rule:
    """``||`` stands for the start of a host label, ``*`` for any run of characters, the rest for itself."""
    body = text.removeprefix("||")
    regex = ".*".join(map(_escape, body.split("*")))
    start = r"^(?:[^/?#]*\.)?" if body != text else ""
    return Rule(text, verdict, PATTERN, f"(?s){start}{regex}", _whole_tokens(("." if body != text else "*") + body))


BASE_RULES = (
    host_rule("net/", "block"),
    host_rule("example.net/en/", "allow"),
    host_rule("example.com/de/", "block"),
    host_rule("org/fr/", "allow"),
)
#: The method's own rules, for URLs that no host rule fits.
PATTERN_RULES = tuple(
    pattern_rule(x)
    for x in (
        "||spam-farm.", "||cheap-pills.", "||free-casino.", "||casino.", "||porn.", "||xxx.", "||adult.", "||viagra.",
        "||payday-loans.", "||malware.", "||phishing.", "||adserver.", "/casino/", "/porn/", "/viagra/",
    )
)


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.split(_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)), "[^a-z0-9]+"))


def index(pages: DataFrame, rules: tuple[Rule, ...], url: str = "url") -> dict[str, list[Rule]]:
    """Rules by their rarest literal token; ``""`` holds rules that have none. Each URL counts a token once.
    What reaches the driver is one count per token of the rules."""
    known = sorted({t for r in rules for t in r.tokens})
    counts = {}
    if known:
        seen = pages.select(F.explode(F.array_intersect(_tokens(F.col(url)), F.array(*map(F.lit, known)))).alias("t"))
        counts = {r["t"]: r["n"] for r in seen.groupBy("t").agg(F.count("*").alias("n")).collect()}
    out: dict[str, list[Rule]] = {}
    for r in rules:
        out.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(r)
    return out


def _struct(r: Rule) -> Column:
    values = (len(r.rule), r.rule, r.verdict, r.kind, r.regex)
    return F.struct(*[F.lit(v).alias(k) for k, v in zip(("size", "rule", "verdict", "kind", "regex"), values, strict=True)])


def _fits(host: Column, path: Column, rest: Column, r: Column) -> Column:
    return F.rlike(F.when(r["kind"] == HOST, F.concat(host, path)).otherwise(rest), r["regex"])


def _rest(url: Column) -> Column:
    return _lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + PATTERN_RULES, url: str = "url", inline: int = INLINE_RULES) -> DataFrame:
    """``pages`` with host, path, rule (the host rule that decides, else null), pattern (a pattern rule that
    decides, else null) and verdict (``allow`` where nothing fits).

    A null URL, or one without ``://``, has an empty host and path and no rule. Each row is judged by its URL
    alone, so repeated rows get equal verdicts; equally long rules tie-break by text; a very long URL is
    looked at whole, by as many tokens as it has and the rules that share one; columns of ``pages`` that
    carry the name of a result are replaced; an empty table gives an empty result."""
    pages = pages.drop(*({"host", "path", "rule", "pattern", "verdict"} - {url}))
    at_found, at_host, at_pattern, at_url = (free(x, pages.columns) for x in ("_found", "_host", "_pattern", "_url"))
    by_token = index(pages, rules, url)
    link = F.coalesce(F.col(url), F.lit(""))
    parsed = pages.withColumns({"host": _lower(F.regexp_extract(link, PARTS, 1)), "path": F.regexp_extract(link, PARTS, 2)})
    kind = "array<struct<size:int,rule:string,verdict:string,kind:string,regex:string>>"
    none = F.array().cast(kind)
    if len(rules) <= inline:
        found = none
        if rules:
            table = F.create_map(*[x for t, rs in sorted(by_token.items()) for x in (F.lit(t), F.array(*map(_struct, rs)).cast(kind))])
            tokens = F.array_union(_tokens(F.col(url)), F.array(F.lit("")))
            found = F.flatten(F.transform(tokens, lambda t: F.coalesce(F.element_at(table, t), none)))
        rest = _rest(F.col(url))
        hits = parsed.withColumn(at_found, F.filter(found, lambda r: _fits(F.col("host"), F.col("path"), rest, r)))
    else:
        spark = pages.sparkSession
        rows = [(t, len(r.rule), r.rule, r.verdict, r.kind, r.regex) for t, rs in by_token.items() for r in rs]
        listed = spark.createDataFrame(rows, "token string, size int, rule string, verdict string, kind string, regex string")
        links = pages.select(F.col(url).alias(at_url)).where(F.col(at_url).isNotNull()).distinct()
        text = F.col(at_url)
        tokens = F.array_union(_tokens(text), F.array(F.lit("")))
        each = links.select(at_url, F.explode(tokens).alias("token")).join(listed, "token")
        host, path = _lower(F.regexp_extract(text, PARTS, 1)), F.regexp_extract(text, PARTS, 2)
        fitting = each.where(_fits(host, path, _rest(text), {k: F.col(k) for k in ("kind", "regex")}))
        # a URL meets each rule once at most, so its list is no longer than the rules
        lists = fitting.groupBy(at_url).agg(F.collect_list(F.struct("size", "rule", "verdict", "kind", "regex")).alias(at_found))
        hits = parsed.join(lists, parsed[url] == lists[at_url], "left").drop(at_url).withColumn(at_found, F.coalesce(at_found, none))
    host_hit = F.array_max(F.filter(at_found, lambda r: r["kind"] == HOST))
    pattern_hit = F.array_max(F.filter(at_found, lambda r: r["kind"] == PATTERN))
    return (
        hits.withColumns({at_host: host_hit, at_pattern: pattern_hit})
        .withColumns(
            {
                "rule": F.col(f"{at_host}.rule"),
                "pattern": F.when(F.col(at_host).isNull(), F.col(f"{at_pattern}.rule")),
                "verdict": F.coalesce(f"{at_host}.verdict", f"{at_pattern}.verdict", F.lit("allow")),
            }
        )
        .drop(at_found, at_host, at_pattern)
    )


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "pattern")


def _pattern_sql() -> str:
    tests = [(len(r.rule), r.rule, r.regex.replace("'", "''")) for r in PATTERN_RULES]
    return "CASE " + " ".join(f"WHEN regexp_matches(rest, '{x}') THEN '{name}'" for _, name, x in sorted(tests, reverse=True)) + " END"


ORACLE = f"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '{PARTS}', 2) AS path,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1), '{UPPER}', '{LOWER}') AS rest
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p),
q AS (SELECT *, CASE WHEN rule IS NULL THEN {_pattern_sql()} END AS pattern FROM r)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern
FROM q
"""
