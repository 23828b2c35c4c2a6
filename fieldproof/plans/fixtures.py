"""Labelled amounts, predictions and model texts derived from the ``orders`` table.

Money is printed from whole cents, so that two engines print alike. Each expression is arithmetic on the order's
key, so every table is one narrow projection of a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("subtotal_amount", "tax_amount", "total_amount", "cash_amount", "change_amount")
CENTS = ("tc - tc div 11", "tc div 11", "tc", "(tc div 10000 + 1) * 10000", "(tc div 10000 + 1) * 10000 - tc")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def printed(spark: SparkSession, sf_dir: str, also: tuple[str, ...] = ()) -> DataFrame:
    """(k, fi, field, c, printed): five printed amounts of each order."""
    cents = table(spark, sf_dir, "orders").selectExpr("o_orderkey as k", "cast(round(o_totalprice * 100) as bigint) as tc", *also)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("fi"), F.lit(n).alias("field"), F.expr(c).alias("c")) for i, (n, c) in enumerate(zip(FIELDS, CENTS, strict=True))]))
    flat = cents.select("k", *also, each.alias("f")).select("k", *also, "f.*")
    return flat.withColumn("printed", F.expr("concat(cast(c div 100 as string), '.', lpad(cast(c % 100 as string), 2, '0'))"))


def expected(fi: str = "fi") -> Column:
    return F.expr(f"if((k + {fi}) % 13 = 5, cast(null as string), printed)")


def predicted(a: int = 7, b: int = 3, n: int = 20) -> Column:
    """Printed amounts, some of them lost or altered, by (k * a + fi * b) % n."""
    return F.expr(
        f"""case (k * {a} + fi * {b}) % {n} when 0 then cast(null as string) when 1 then 'N/A' when 2 then '10%'
        when 3 then replace(printed, '.', ',') when 4 then concat('  ', printed, '  ') when 5 then '' when 6 then concat('Rp ', printed)
        else printed end"""
    )


def long(spark: SparkSession, sf_dir: str, a: int = 7, b: int = 3, n: int = 20, failing: bool = False) -> DataFrame:
    """The labelled fields of (id, doc_pos, pos, field, rule, expected, predicted, error), values as VARIANT."""
    rows = printed(spark, sf_dir).where("(k + fi) % 7 <> 0")
    error = F.expr("if(k % 17 = 0, 'ValueError: recorded', cast(null as string))") if failing else F.lit(None).cast("string")
    return rows.select(
        F.col("k").alias("id"), F.col("k").alias("doc_pos"), F.col("fi").alias("pos"), "field", F.lit("string").alias("rule"),
        F.lit("string or null").alias("rule_text"), expected().cast("variant").alias("expected"), predicted(a, b, n).cast("variant").alias("predicted"), error.alias("error"),
    )


def numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts under number and integer rules, spelled in eight ways."""
    rows = printed(spark, sf_dir).where("(k + fi) % 7 <> 0")
    spelled = F.expr(
        """case (k + fi) % 8 when 0 then format_number(cast(c div 100 as bigint), 0) when 1 then concat(cast(c div 100 as string), ',34')
        when 2 then concat(cast(c % 10 as string), 'e5') when 3 then concat('.', cast(c % 100 as string)) when 4 then concat('+', printed)
        when 5 then concat(printed, '000') when 6 then concat('00', printed) else printed end"""
    )
    rule = F.expr("if(fi % 2 = 1, 'integer', 'number')")
    return rows.select(
        F.col("k").alias("id"), F.col("fi").alias("pos"), "field", rule.alias("rule"), F.expr("if(fi % 2 = 1, cast(c div 100 as string), printed)").cast("variant").alias("expected"),
        spelled.cast("variant").alias("predicted"), F.lit(None).cast("string").alias("error"),
    )


def model_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, form, raw_output, requested): a model's text of each order, fenced, bare, after prose, flat, broken or empty."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey as k", "cast(round(o_totalprice * 100) as bigint) as tc").withColumn(
        "t", F.expr("concat(cast(tc div 100 as string), '.', lpad(cast(tc % 100 as string), 2, '0'))")
    )
    score = "case when k % 5 = 0 then '1.7' when k % 5 = 1 then '-1' when k % 5 = 2 then '\"0.25\"' when k % 5 = 3 then 'null' else '0.5' end"
    body = f"""concat('{{"fields": {{"total_amount": "', t, '"}}, "confidence": ', {score}, ', "answer": "paid"}}')"""
    raw = F.expr(
        f"""case k % 6 when 0 then concat('Here it is:\\n```json\\n', {body}, '\\n```\\nDone.') when 1 then {body} when 2 then concat('The answer is ', {body}, ' as asked')
        when 3 then concat('{{"total_amount": "', t, '"}}') when 4 then '{{"fields": {{"total_amount": ' else '   ' end"""
    )
    return o.select("k", F.expr("k % 6").alias("form"), raw.alias("raw_output"), F.array(F.lit("total_amount")).alias("requested"))


def nested_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, ground_truth): nested labels as JSON text: full, partial, a list for a group, a blank label, none."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey as k", "cast(round(o_totalprice * 100) as bigint) as tc").withColumn("t", F.expr("cast(tc div 100 as string)"))
    text = F.expr(
        """case k % 5 when 0 then concat('{"gt_parse": {"sub_total": {"subtotal_price": "', t, '", "tax_price": "1"}, "total": {"total_price": "', t, '"}}}')
        when 1 then concat('{"gt_parse": {"total": {"total_price": "', t, '", "cashprice": null}}}')
        when 2 then '{"gt_parse": {"sub_total": [{"subtotal_price": "1"}], "total": {}}}'
        when 3 then '{"gt_parse": {"total": {"total_price": "  "}}}' else '{"gt_parse": {"menu": []}}' end"""
    )
    return o.select("k", text.alias("ground_truth"))


_PICK = " ".join(f"WHEN {i} THEN {c.replace(' div ', ' // ')}" for i, c in enumerate(CENTS))
_ROWS = ", ".join(f"({i}, '{n}')" for i, n in enumerate(FIELDS))


def sql_predicted(a: int = 7, b: int = 3, n: int = 20) -> str:
    return (
        f"CASE (k * {a} + fi * {b}) % {n} WHEN 0 THEN NULL WHEN 1 THEN 'N/A' WHEN 2 THEN '10%' WHEN 3 THEN replace(printed, '.', ',') "
        "WHEN 4 THEN '  ' || printed || '  ' WHEN 5 THEN '' WHEN 6 THEN 'Rp ' || printed ELSE printed END"
    )


#: The same tables as common table expressions of DuckDB.
SQL_PRINTED = f"""o AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS tc FROM orders),
f AS (SELECT k, fi, field, CASE fi {_PICK} END AS c FROM o, (VALUES {_ROWS}) AS t(fi, field)),
p AS (SELECT k, fi, field, c, (c // 100)::VARCHAR || '.' || lpad((c % 100)::VARCHAR, 2, '0') AS printed FROM f WHERE (k + fi) % 7 <> 0)"""


def sql_scored(name: str = "s", a: int = 7, b: int = 3, n: int = 20, failing: bool = False) -> str:
    fold = lambda c: f"nullif(lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), '')"
    fails = "WHEN k % 17 = 0 THEN 'inference_error' " if failing else ""
    return f"""{name}0 AS (SELECT *, CASE WHEN (k + fi) % 13 = 5 THEN NULL ELSE printed END AS expected, {sql_predicted(a, b, n)} AS predicted FROM p),
{name}1 AS (SELECT *, {fold("expected")} AS e, {fold("predicted")} AS g FROM {name}0),
{name} AS (SELECT *, CASE {fails}WHEN e IS NOT DISTINCT FROM g THEN 'correct' WHEN g IS NULL THEN 'missing_value' WHEN e IS NULL THEN 'unexpected_value'
  ELSE 'value_mismatch' END AS category FROM {name}1)"""
