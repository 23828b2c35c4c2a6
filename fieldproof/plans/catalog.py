"""Registered queries of the evaluation engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.values import with_typed
from ..operators import compare as C
from ..operators import metrics as M
from ..operators import parse as P
from ..operators import review as R
from ..operators import select as S
from ..operators import validate as V
from ..operators.score import per_document, score_long
from ..session import ship
from ..sources import sinks
from . import catalog_files
from . import fixtures as X

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        # the package goes to the Python workers, which meet texts beyond ASCII
        Q[f.__name__] = lambda spark, d: f(ship(spark), d)
        if sql:
            O[f.__name__] = sql
        return f

    return add


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join((X.SQL_PRINTED, *parts)) + "\n"


def _scored(spark: SparkSession, d: str, **o) -> DataFrame:
    return score_long(X.long(spark, d, **o))


def _ratio(c: str):
    return F.round(c, 6).alias(c)


@query(_with(X.sql_scored()) + "SELECT field, category, count(*) AS n FROM s GROUP BY field, category")
def field_score_categories(spark, d):
    return _scored(spark, d).groupBy("field", "category").agg(F.count("*").alias("n"))


@query(_with(X.sql_scored()) + "SELECT k AS id, fi AS pos, field, category, category = 'correct' AS correct, e IS NOT NULL AS expected_present FROM s")
def score_details(spark, d):
    return _scored(spark, d).select("id", "pos", "field", "category", "correct", "expected_present")


_NUM = "regexp_full_match({0}, '[+-]?([0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+)([.][0-9]+)?')"


@query(
    _with(
        """n0 AS (SELECT *, CASE WHEN fi % 2 = 1 THEN 'integer' ELSE 'number' END AS rule, CASE WHEN fi % 2 = 1 THEN (c // 100)::VARCHAR ELSE printed END AS expected,
  CASE (k + fi) % 8 WHEN 0 THEN format('{:,}', c // 100) WHEN 1 THEN (c // 100)::VARCHAR || ',34' WHEN 2 THEN (c % 10)::VARCHAR || 'e5'
  WHEN 3 THEN '.' || (c % 100)::VARCHAR WHEN 4 THEN '+' || printed WHEN 5 THEN printed || '000' WHEN 6 THEN '00' || printed ELSE printed END AS predicted FROM p)""",
        f"n1 AS (SELECT *, CASE WHEN {_NUM.format('predicted')} THEN CAST(replace(predicted, ',', '') AS DECIMAL(38, 9)) END AS g, CAST(expected AS DECIMAL(38, 9)) AS e FROM n0)",
    )
    + """SELECT rule, CASE WHEN g IS NULL OR (rule = 'integer' AND g <> floor(g)) THEN 'invalid_value' WHEN g = e THEN 'correct' ELSE 'value_mismatch' END AS category,
  count(*) AS n FROM n1 GROUP BY ALL"""
)
def typed_numeric_scoring(spark, d):
    return score_long(X.numeric(spark, d)).groupBy("rule", "category").agg(F.count("*").alias("n"))


@query(
    """SELECT count(*) AS n, count(*) FILTER (WHERE l_quantity = floor(l_quantity)) AS whole,
  count(*) FILTER (WHERE CAST(l_extendedprice AS VARCHAR) = CAST(l_quantity AS VARCHAR)) AS equal FROM lineitem"""
)
def typed_json_numbers(spark, d):
    """Numbers of JSON values (not texts) under an integer rule, and two number values compared."""
    rows = X.table(spark, d, "lineitem").select(F.col("l_quantity").cast("variant").alias("q"), F.col("l_extendedprice").cast("variant").alias("x"))
    one = with_typed(with_typed(rows, {"i": F.col("q")}, F.lit("integer")), {"a": F.col("q"), "b": F.col("x")}, F.lit("number"))
    same = (F.col("a_state") == F.col("b_state")) & (F.col("a_value") == F.col("b_value"))
    return one.agg(F.count("*").alias("n"), F.count_if(F.col("i_state") == "number").alias("whole"), F.count_if(same).alias("equal"))


_SHARE = "round(count(*) FILTER (WHERE {0}) / count(*)::DOUBLE, 6)"


@query(_with(X.sql_scored()) + "SELECT category, count(*) AS n FROM s WHERE category <> 'correct' GROUP BY category")
def error_histogram(spark, d):
    return M.error_categories(_scored(spark, d))


@query(
    _with(X.sql_scored())
    + f"SELECT field, count(*) FILTER (WHERE category = 'correct') AS correct, count(*) AS total, {_SHARE.format(chr(99) + 'ategory = ' + repr('correct'))} AS accuracy FROM s GROUP BY GROUPING SETS ((field), ())"
)
def per_field_accuracy(spark, d):
    return M.per_field(_scored(spark, d)).select("field", "correct", "total", _ratio("accuracy"))


@query(
    _with(X.sql_scored())
    + """SELECT count(*) FILTER (WHERE category = 'correct') AS correct_fields, count(*) AS total_fields, round(count(*) FILTER (WHERE category = 'correct') / count(*)::DOUBLE, 6) AS field_accuracy,
  round(count(*) FILTER (WHERE category = 'correct' AND e IS NOT NULL) / (count(*) FILTER (WHERE e IS NOT NULL))::DOUBLE, 6) AS present_field_accuracy FROM s"""
)
def present_accuracy(spark, d):
    return M.field_accuracy(_scored(spark, d)).select("correct_fields", "total_fields", _ratio("field_accuracy"), _ratio("present_field_accuracy"))


_DOCS = """SELECT count(*) FILTER (WHERE ok) AS whole_documents, count(*) AS documents, round(count(*) FILTER (WHERE ok) / count(*)::DOUBLE, 6) AS document_accuracy
  FROM (SELECT k, bool_and(category = 'correct') AS ok FROM s GROUP BY k)"""


@query(_with(X.sql_scored()) + _DOCS)
def document_accuracy(spark, d):
    return M.document_accuracy(_scored(spark, d)).select("whole_documents", "documents", _ratio("document_accuracy"))


@query(_with(X.sql_scored(failing=True)) + _DOCS)
def document_accuracy_with_failures(spark, d):
    return M.document_accuracy(_scored(spark, d, failing=True)).select("whole_documents", "documents", _ratio("document_accuracy"))


@query(
    _with(X.sql_scored(failing=True))
    + "SELECT k AS id, count(*) FILTER (WHERE category = 'correct') AS correct, count(*) AS total, round(count(*) FILTER (WHERE category = 'correct') / count(*)::DOUBLE, 6) AS accuracy FROM s GROUP BY k"
)
def document_scores(spark, d):
    return per_document(_scored(spark, d, failing=True)).select("id", "correct", "total", _ratio("accuracy"))


@query(_with(X.sql_scored(failing=True)) + "SELECT category, e IS NOT NULL AS expected_present, count(*) AS n FROM s GROUP BY ALL")
def failed_documents_denominator(spark, d):
    return _scored(spark, d, failing=True).groupBy("category", "expected_present").agg(F.count("*").alias("n"))


@query(
    _with(X.sql_scored(failing=True))
    + """, r AS (SELECT k, bool_or(k % 17 = 0) AS failed, count(*) FILTER (WHERE category = 'correct') AS c, count(*) AS t FROM s GROUP BY k)
SELECT k AS id, c AS correct, t AS total FROM r WHERE failed OR c < t ORDER BY k LIMIT 5"""
)
def first_failures(spark, d):
    scored = _scored(spark, d, failing=True)
    each = per_document(scored, ("id", "error", "doc_pos"))
    return S.first_failures(each).select("id", "correct", "total")


def _events(spark, d):
    e = X.table(spark, d, "events")
    return e.select(F.when(F.col("event_type") == "error", "failed").alias("error"), F.col("value").alias("wall_seconds"), F.col("user_id").cast("double").alias("memory"), "event_type", "user_id")


@query(
    """SELECT round(avg(value), 6) AS mean_seconds, round(quantile_cont(value::DOUBLE, 0.5), 6) AS median_seconds, round(quantile_cont(value::DOUBLE, 0.95), 6) AS p95_seconds,
  max(user_id::DOUBLE) AS max_memory FROM events WHERE event_type <> 'error'"""
)
def latency_summary(spark, d):
    return M.latency(_events(spark, d)).select(_ratio("mean_seconds"), _ratio("median_seconds"), _ratio("p95_seconds"), "max_memory")


@query(
    """SELECT count(*) AS examples, count(*) FILTER (WHERE event_type = 'error') AS failed_examples,
  count(*) FILTER (WHERE event_type = 'click') AS review_flagged_examples, count(*) FILTER (WHERE event_type = 'purchase') AS rechecked_examples,
  count(*) FILTER (WHERE event_type = 'purchase' AND user_id % 3 = 0) AS failed_rechecks,
  round(avg(value) FILTER (WHERE event_type <> 'error'), 6) AS successful_examples_mean_wall_seconds FROM events"""
)
def document_counters(spark, d):
    kind = F.col("event_type")
    rows = _events(spark, d).withColumns({"n_flags": (kind == "click").cast("int"), "recheck_started": kind == "purchase", "recheck_error": F.when(F.col("user_id") % 3 == 0, "failed")})
    return M.counters(rows).withColumn("successful_examples_mean_wall_seconds", F.round("successful_examples_mean_wall_seconds", 6))


_TEXTS = r"""WITH o AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS tc FROM orders),
t AS (SELECT k, (tc // 100)::VARCHAR || '.' || lpad((tc % 100)::VARCHAR, 2, '0') AS t FROM o),
r AS (SELECT k, k % 6 AS form, t, CASE WHEN k % 6 = 4 THEN 'The response did not contain a valid JSON object.' WHEN k % 6 = 5 THEN 'The model returned an empty response.' END AS parse_error,
  CASE WHEN k % 6 = 3 THEN 0.0 WHEN k % 6 < 3 THEN CASE k % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.25 WHEN 3 THEN 0.0 ELSE 0.5 END END AS confidence FROM t)
"""


@query(_TEXTS + "SELECT k, form, CASE WHEN form < 4 THEN t END AS total_amount, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN form < 3 THEN 'paid' WHEN form = 3 THEN '' END AS answer, parse_error FROM r")
def parse_model_text(spark, d):
    out = P.parse_output(X.model_texts(spark, d))
    total = F.try_variant_get(P.field_value(F.col("fields"), F.lit("total_amount")), "$", "string")
    return out.select("k", "form", total.alias("total_amount"), "confidence", "answer", "parse_error")


@query(_TEXTS + "SELECT form, parse_error, count(*) AS n FROM r GROUP BY ALL")
def parse_errors(spark, d):
    return P.parse_output(X.model_texts(spark, d)).groupBy("form", "parse_error").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def parse_bare_json(spark, d):
    rows = X.table(spark, d, "events").select("event_id", F.try_parse_json("props").alias("o"))
    return rows.select("event_id", F.try_variant_get("o", "$.k", "bigint").alias("k"))


@query(
    """WITH o AS (SELECT o_orderkey AS k, (CAST(round(o_totalprice * 100) AS BIGINT) // 100)::VARCHAR AS t FROM orders)
SELECT k, 'subtotal_amount' AS field, t AS expected FROM o WHERE k % 5 = 0 UNION ALL SELECT k, 'tax_amount', '1' FROM o WHERE k % 5 = 0
UNION ALL SELECT k, 'total_amount', t FROM o WHERE k % 5 < 2"""
)
def nested_label_mapping(spark, d):
    # rejected rows have no map; an outer explode infers no filter, which would map all labels once more below it
    rows = P.map_labels(X.nested_labels(spark, d)).select("k", F.explode_outer("expected").alias("field", "expected"))
    return rows.where("field is not null")


@query(
    """SELECT CASE o_orderkey % 5 WHEN 2 THEN 'Ambiguous repeated label group: sub_total' WHEN 3 THEN 'Ambiguous/nontext CORD label: total.total_price'
  WHEN 4 THEN 'No labelled amounts in the selected task' END AS reject, count(*) AS n FROM orders GROUP BY ALL"""
)
def mapping_rejects(spark, d):
    return P.map_labels(X.nested_labels(spark, d)).groupBy("reject").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return V.duplicates(X.table(spark, d, "lineitem").select("l_orderkey"), "l_orderkey")


@query("SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 4)")
def missing_prediction_ids(spark, d):
    have = X.table(spark, d, "lineitem").where("l_linenumber >= 4").selectExpr("l_orderkey as id")
    return V.absent(X.table(spark, d, "orders").selectExpr("o_orderkey as id"), have, "id")


_ADMIT = """case k % 9 when 0 then '[1]' when 1 then '{"id": " ", "image": "a"}' when 2 then concat('{"id": "x', cast(k div 50 as string), '", "image": "", "question": "q"}')
when 3 then concat('{"id": "y', cast(k as string), '", "image": "a", "question": "q", "field_schema": {}, "expected_fields": {}}')
when 4 then concat('{"id": "z', cast(k as string), '", "image": "a", "question": "q", "field_schema": {"a": "string"}, "expected_fields": {"b": "1"}}')
when 5 then concat('{"id": "w', cast(k as string), '", "image": "a", "question": " "}') when 6 then '{broken' when 7 then '{"id": "same", "image": "", "question": "q"}'
else concat('{"id": "v', cast(k as string), '", "image": "a", "question": "q", "field_schema": {"b": "string"}, "expected_fields": {"b": "1"}}') end"""


@query(
    """SELECT reason, count(*) AS n FROM (SELECT CASE o_orderkey % 9 WHEN 0 THEN 'Row must be an object' WHEN 1 THEN 'IDs must be nonempty and unique'
  WHEN 2 THEN CASE WHEN row_number() OVER (PARTITION BY o_orderkey % 9, o_orderkey // 50 ORDER BY o_orderkey) > 1 THEN 'IDs must be nonempty and unique' ELSE 'Missing image' END
  WHEN 3 THEN 'field_schema and nonempty expected_fields are required' WHEN 4 THEN 'Every label must have a requested schema field' WHEN 5 THEN 'Missing question'
  WHEN 6 THEN 'Row is not valid JSON' WHEN 7 THEN CASE WHEN row_number() OVER (PARTITION BY o_orderkey % 9 ORDER BY o_orderkey) > 1 THEN 'IDs must be nonempty and unique' ELSE 'Missing image' END END AS reason
  FROM orders) WHERE reason IS NOT NULL GROUP BY reason"""
)
def admission_problems(spark, d):
    rows = X.table(spark, d, "orders").selectExpr("o_orderkey as k").select(F.col("k").alias("line_no"), F.try_parse_json(F.expr(_ADMIT)).alias("row"))
    return V.row_problems(rows).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    """SELECT p_partkey AS k FROM part WHERE p_size % 3 = 1"""
)
def label_type_violations(spark, d):
    """Labels that are not of their own type: sizes under an integer rule, some of them with a fraction."""
    p = X.table(spark, d, "part")
    value = F.when(F.col("p_size") % 3 == 1, F.concat(F.col("p_size").cast("string"), F.lit(".5"))).otherwise(F.col("p_size").cast("string"))
    rows = p.select(
        F.col("p_partkey").alias("line_no"), F.col("p_partkey").alias("id"), F.parse_json(F.lit('{"size": "integer or null"}')).alias("field_schema"),
        F.parse_json(F.concat(F.lit('{"size": "'), value, F.lit('"}'))).alias("expected_fields"),
    )
    return V.label_problems(rows).select(F.col("id").alias("k"))


@query("SELECT o_orderkey AS line_no, o_custkey FROM orders ORDER BY o_orderkey LIMIT 80 OFFSET 20")
def offset_limit_selection(spark, d):
    return S.offset_limit(X.table(spark, d, "orders").select(F.col("o_orderkey").alias("line_no"), "o_custkey"), 20, 80)


@query(
    _with(X.sql_scored(), X.sql_scored("z", 11, 5, 23))
    + """, q AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS n FROM (SELECT DISTINCT o_orderkey AS k FROM orders)),
r AS (SELECT 'baseline' AS arm, k, category FROM s UNION ALL SELECT 'candidate', k, category FROM z)
SELECT arm, CASE WHEN n < 20 THEN 'pilot' ELSE 'holdout' END AS phase, count(*) FILTER (WHERE category = 'correct') AS correct, count(*) AS total
FROM r JOIN q USING (k) WHERE n < 100 GROUP BY ALL"""
)
def pilot_holdout_split(spark, d):
    docs = S.offset_limit(X.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), 0, 100, "id")
    # the first hundred documents, numbered
    docs = docs.agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.posexplode("ids").alias("doc_pos", "id"))
    plan = S.arms(docs, S.PHASES, ["baseline", "candidate"])
    run = lambda name, **o: _scored(spark, d, **o).select(F.lit(name).alias("arm"), "id", "correct")
    runs = run("baseline").union(run("candidate", a=11, b=5, n=23))
    return runs.join(F.broadcast(plan), ["arm", "id"]).groupBy("arm", "phase").agg(F.count_if("correct").alias("correct"), F.count("*").alias("total"))


@query(
    """WITH q AS (SELECT o_orderkey, o_custkey % 7 AS part, row_number() OVER (ORDER BY o_custkey % 7, o_orderkey) - 1 AS n FROM orders)
SELECT o_orderkey, n, 'doc-test-' || lpad(n::VARCHAR, CAST(greatest(4, length(n::VARCHAR)) AS INTEGER), '0') AS id FROM q WHERE n < 1000"""
)
def generated_ids(spark, d):
    rows = X.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 7).alias("part"))
    return S.first_of_source(S.numbered(rows, ["part", "o_orderkey"], "doc", "test"), 1000).select("o_orderkey", "n", "id")


_REASON = """CASE WHEN {0} IS NULL THEN NULL WHEN contains(trim({0}), '%') THEN 'percentage_is_not_amount'
  WHEN lower(trim({0})) IN ('', 'null', 'none', 'n/a', 'nan') THEN 'placeholder_is_not_amount' WHEN NOT regexp_matches({0}, '[0-9]') THEN 'amount_has_no_digits' END"""


@query(_with(X.sql_scored(), f"r AS (SELECT *, {_REASON.format('predicted')} AS reason FROM s)") + "SELECT k AS id, field, reason FROM r WHERE reason IS NOT NULL")
def review_flags(spark, d):
    return R.flags(X.long(spark, d)).select("id", "field", "reason")


@query(_with(X.sql_scored(), f"r AS (SELECT *, {_REASON.format('predicted')} AS reason FROM s)") + "SELECT reason, count(*) AS n, count(DISTINCT k) AS documents FROM r WHERE reason IS NOT NULL GROUP BY reason")
def review_flag_counts(spark, d):
    each = R.flags(X.long(spark, d)).groupBy("reason", "id").agg(F.count("*").alias("n"))
    return each.groupBy("reason").agg(F.sum("n").alias("n"), F.count("*").alias("documents"))


_SECOND = "CASE (k + fi) % 5 WHEN 0 THEN NULL WHEN 1 THEN 'unreadable' ELSE printed END"
_POLICY = "CASE k % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'invalid-amount-v1' WHEN 2 THEN 'percent-crop-v1' ELSE 'label-context-v1' END"


def _rechecked(spark, d):
    rows = X.printed(spark, d).where("(k + fi) % 7 <> 0").select(
        F.col("k").alias("id"), "field", F.lit("string or null").alias("rule_text"), X.predicted().cast("variant").alias("predicted"), F.expr(_SECOND).cast("variant").alias("second"),
        F.expr(_POLICY).alias("policy"), F.expr("if(k % 10 = 9, 'failed', cast(null as string))").alias("second_error"),
    )
    return R.merge(rows)


_MERGED = [
    X.sql_scored(),
    f"r AS (SELECT *, {_REASON.format('predicted')} AS reason, {_SECOND} AS second, {_POLICY} AS policy FROM s)",
    f"a AS (SELECT *, coalesce(reason IS NOT NULL AND policy <> 'none' AND (policy = 'invalid-amount-v1' OR reason = 'percentage_is_not_amount'), false) AS asked, {_REASON.format('second')} AS again FROM r)",
    "m AS (SELECT *, asked AND k % 10 <> 9 AND again IS NULL AND NOT (policy = 'percent-crop-v1' AND second IS NULL) AS accepted FROM a)",
]


@query(_with(*_MERGED) + "SELECT k AS id, field, policy, reason, asked, accepted, CASE WHEN accepted THEN second ELSE predicted END AS merged, CASE WHEN accepted THEN NULL ELSE reason END AS merged_reason FROM m")
def recheck_merge(spark, d):
    out = _rechecked(spark, d)
    return out.select("id", "field", "policy", "reason", "asked", "accepted", F.try_variant_get("merged", "$", "string").alias("merged"), "merged_reason")


@query(_with(*_MERGED) + "SELECT policy, count(*) FILTER (WHERE asked) AS asked, count(*) FILTER (WHERE accepted) AS accepted, count(DISTINCT k) FILTER (WHERE asked) AS documents FROM m GROUP BY policy")
def policy_matrix(spark, d):
    each = _rechecked(spark, d).groupBy("policy", "id").agg(F.count_if("asked").alias("a"), F.count_if("accepted").alias("b"))
    return each.groupBy("policy").agg(F.sum("a").alias("asked"), F.sum("b").alias("accepted"), F.count_if(F.col("a") > 0).alias("documents"))


@query(
    """WITH r AS (SELECT o_orderkey AS id, o_orderkey % 3 <> 0 AS attempted, o_orderkey % 10 = 9 AS failed, (o_orderkey % 1000) / 8.0 AS a,
  CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 500) / 8.0 END AS b FROM orders)
SELECT id, CASE WHEN attempted THEN 2 ELSE 1 END AS model_calls, CAST(round(CASE WHEN NOT attempted THEN a WHEN NOT failed AND b IS NOT NULL THEN a + b END, 3) AS DOUBLE) AS latency,
  CAST(CASE WHEN NOT attempted THEN a WHEN NOT failed AND b IS NOT NULL THEN greatest(a, b) END AS DOUBLE) AS memory FROM r"""
)
def recheck_cost_metadata(spark, d):
    a, b = F.expr("(k % 1000) / 8.0D"), F.expr("if(k % 7 <> 0, (k % 500) / 8.0D, cast(null as double))")
    none = F.array().cast("array<struct<field:string,text:string>>")
    rows = X.table(spark, d, "orders").selectExpr("o_orderkey as k").select(
        F.col("k").alias("id"), F.expr("if(k % 3 <> 0, array('tax_amount'), cast(array() as array<string>))").alias("asked"), F.array().cast("array<string>").alias("accepted"),
        none.alias("evidence"), none.alias("second_evidence"), F.lit("x").alias("answer"), F.lit(1.0).alias("confidence"),
        F.expr("if(k % 10 = 9, 'failed', cast(null as string))").alias("second_error"), F.lit(True).alias("request_started"), a.alias("latency"), b.alias("second_latency"), a.alias("memory"), b.alias("second_memory"),
    )
    return R.merge_documents(rows).select("id", "model_calls", "latency", "memory")


@query(
    _with(X.sql_scored(), X.sql_scored("z", 11, 5, 23))
    + """SELECT field, count(*) FILTER (WHERE s.category <> 'correct' AND z.category = 'correct') AS improved,
  count(*) FILTER (WHERE s.category = 'correct' AND z.category <> 'correct') AS regressed FROM s JOIN z USING (k, fi, field) GROUP BY field"""
)
def paired_changes(spark, d):
    return C.paired_changes(_scored(spark, d), _scored(spark, d, a=11, b=5, n=23))


@query(
    _with(X.sql_scored(), X.sql_scored("z", 11, 5, 23))
    + """SELECT k AS id, field, max(predicted) FILTER (WHERE run = 0) AS before, max(predicted) FILTER (WHERE run = 1) AS after, max(ok) FILTER (WHERE run = 1) = 1 AS improved
FROM (SELECT 0 AS run, k, field, predicted, (category = 'correct')::INT AS ok FROM s UNION ALL SELECT 1, k, field, predicted, (category = 'correct')::INT FROM z)
GROUP BY k, field HAVING count(*) = 2 AND sum(ok) = 1"""
)
def field_changes(spark, d):
    out = C.field_changes(_scored(spark, d), _scored(spark, d, a=11, b=5, n=23))
    text = lambda c: F.try_variant_get(c, "$", "string").alias(c)
    return out.select("id", "field", text("before"), text("after"), "improved")


@query(
    """SELECT n_nationkey AS case_no, CASE n_nationkey % 7 WHEN 0 THEN 'At least two runs are required' WHEN 1 THEN 'Only completed live runs can be compared as model benchmarks'
  WHEN 2 THEN 'Different dataset fingerprints' WHEN 3 THEN 'Different document selections' WHEN 4 THEN 'Different report versions'
  WHEN 5 THEN 'Different evaluation code; re-run with the same version' END AS reason FROM nation"""
)
def comparability_guard(spark, d):
    """Guards of seven cases of two runs each, as one plan per case."""
    cases = X.table(spark, d, "nation").select(F.col("n_nationkey").alias("case_no"), (F.col("n_nationkey") % 7).alias("c"))
    shape = ["pos", "mode", "complete", "fingerprint", "selected_ids", "report_version", "source_sha256"]
    first = (0, "live", True, "f", ["a", "b"], 2, "s")
    other = {1: (1, "live", False, *first[3:]), 2: (1, "live", True, "g", *first[4:]), 3: (1, "live", True, "f", ["b", "a"], 2, "s"), 4: (1, *first[1:5], 3, "s"), 5: (1, *first[1:6], "t"), 6: (1, *first[1:])}
    found = None
    for c in range(7):
        runs = spark.createDataFrame([first] + ([other[c]] if c else []), "pos int, mode string, complete boolean, fingerprint string, selected_ids array<string>, report_version int, source_sha256 string").select(*shape)
        one = C.guard(runs).select(F.lit(c).alias("c"), "reason")
        found = one if found is None else found.union(one)
    return cases.join(F.broadcast(found), "c").select("case_no", "reason")


@query(
    """WITH r AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 5 <> 0 GROUP BY 1),
w AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 7 <> 0)
SELECT problem, count(*) AS n FROM (SELECT CASE WHEN r.n > 1 THEN 'repeated' WHEN r.n IS NULL THEN 'missing' WHEN w.id IS NULL THEN 'unselected' END AS problem FROM r FULL JOIN w ON r.id = w.id)
WHERE problem IS NOT NULL GROUP BY problem"""
)
def result_set_problems(spark, d):
    results = X.table(spark, d, "lineitem").where("l_linenumber <= 2 and l_orderkey % 5 <> 0").select(F.lit(1).alias("run_id"), F.col("l_orderkey").alias("id"))
    wanted = X.table(spark, d, "orders").where("o_orderkey % 7 <> 0").select(F.lit(1).alias("run_id"), F.col("o_orderkey").alias("id"))
    return C.result_problems(results, wanted).groupBy("problem").agg(F.count("*").alias("n"))


@query(
    _with(X.sql_scored())
    + """SELECT k::VARCHAR AS id, CASE WHEN k % 2 = 0 THEN '''=cmd' ELSE 'img' END AS image, field, category, CASE WHEN expected IS NULL THEN 'null' ELSE '"' || expected || '"' END AS expected,
  CASE WHEN predicted IS NULL THEN 'null' ELSE '"' || predicted || '"' END AS predicted, '' AS error FROM s WHERE category <> 'correct'"""
)
def error_sheet_guarded(spark, d):
    long = _scored(spark, d).withColumns({"image": F.expr("if(id % 2 = 0, '=cmd', 'img')"), "id": F.col("id").cast("string")})
    return sinks.error_sheet(long).select("id", "image", "field", "category", "expected", "predicted", "error")


@query("SELECT p_partkey, p_size // 10 AS top, p_size AS right_, p_size - p_size // 10 AS bottom FROM part")
def crop_box(spark, d):
    box = R.crop_box(F.col("p_size"), F.col("p_size"))
    return X.table(spark, d, "part").select("p_partkey", box["top"].alias("top"), box["right"].alias("right_"), box["bottom"].alias("bottom"))


@query("SELECT doc_id, nullif(replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss'), '') AS folded FROM documents")
def text_normalise(spark, d):
    return X.table(spark, d, "documents").select("doc_id", T.normalise(F.col("text")).alias("folded"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def document_fingerprints(spark, d):
    return X.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query(
    """SELECT doc_id::VARCHAR AS file, CASE WHEN doc_id % 11 = 0 THEN 'missing' ELSE 'checksum mismatch' END AS reason FROM documents WHERE doc_id % 11 = 0 OR doc_id % 10 = 0 OR doc_id % 13 = 0"""
)
def integrity_join(spark, d):
    docs = X.table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("file"), F.octet_length("text").cast("long").alias("length"), F.sha2("text", 256).alias("sha256"), T.blob_sha1(F.col("text").cast("binary")).alias("blob_sha1"))
    listed = docs.select("file", F.expr("if(doc_id % 13 = 0, length + 1, length)").alias("size"), F.expr("if(doc_id % 10 = 0, sha2('x', 256), if(doc_id % 2 = 0, sha256, blob_sha1))").alias("checksum"))
    return V.integrity_problems(listed, docs.where("doc_id % 11 <> 0").select("file", "length", "sha256", "blob_sha1"))


@query(
    """SELECT p_partkey::VARCHAR AS file, CASE p_partkey % 6 WHEN 1 THEN 'revision is not immutable' WHEN 2 THEN 'repository is not owner/name' WHEN 3 THEN 'path leaves the snapshot'
  WHEN 4 THEN 'checksum has neither 40 nor 64 digits' END AS reason FROM part WHERE p_partkey % 6 BETWEEN 1 AND 4"""
)
def manifest_shape(spark, d):
    k = F.col("p_partkey") % 6
    rows = X.table(spark, d, "part").select(
        F.when(k == 3, F.concat(F.lit("../"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_partkey").cast("string")).alias("file"), F.when(k == 1, "main").otherwise(F.sha1(F.lit("r").cast("binary"))).alias("revision"),
        F.when(k == 2, "alone").otherwise("owner/name").alias("repository"), F.when(k == 4, "abc").otherwise(F.sha2(F.lit("c"), 256)).alias("checksum"),
    )
    return V.manifest_problems(rows).select(F.regexp_replace("file", "^\\.\\./", "").alias("file"), "reason")


@query(
    """SELECT quality, count(*) AS n, count(*) FILTER (WHERE (n_chars > 800) = (quality = 1)) AS correct FROM documents JOIN labels USING (doc_id) GROUP BY quality"""
)
def label_quality_join(spark, d):
    docs, labels = X.table(spark, d, "documents").select("doc_id", "n_chars"), X.table(spark, d, "labels").select("doc_id", "quality")
    both = docs.join(labels, "doc_id").withColumns(
        {"expected": F.when(F.col("quality") == 1, "good").otherwise("bad").cast("variant"), "predicted": F.when(F.col("n_chars") > 800, "Good ").otherwise("BAD").cast("variant"), "rule": F.lit("string"), "error": F.lit(None).cast("string")}
    )
    return score_long(both).groupBy("quality").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"))


@query(
    _with(X.sql_scored(), X.sql_scored("z", 11, 5, 23))
    + """, r AS (SELECT 'a' AS run_id, count(*) FILTER (WHERE category = 'correct') / count(*)::DOUBLE AS x FROM s UNION ALL SELECT 'b', count(*) FILTER (WHERE category = 'correct') / count(*)::DOUBLE FROM z)
SELECT round((SELECT x FROM r WHERE run_id = 'b') - (SELECT x FROM r WHERE run_id = 'a'), 6) AS accuracy_points, CAST(0.25 AS DOUBLE) AS seconds_change, CAST(-0.5 AS DOUBLE) AS memory_change"""
)
def relative_deltas(spark, d):
    one = lambda name, s, m, **o: M.field_accuracy(_scored(spark, d, **o)).select(F.lit(name).alias("run_id"), "field_accuracy", F.lit(s).alias("mean_seconds"), F.lit(m).alias("memory"))
    both = M.relative(one("a", 2.0, 8.0).union(one("b", 2.5, 4.0, a=11, b=5, n=23)), "a", "b")
    return both.withColumn("accuracy_points", F.round("accuracy_points", 6))


@query(
    """SELECT CASE WHEN round(100 * acc, 2) IS NULL THEN 'n/a' ELSE printf('%.2f%%', 100 * acc) END AS shown, count(*) AS n
  FROM (SELECT CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 4) / 8.0 END AS acc FROM customer) GROUP BY ALL"""
)
def percent_format(spark, d):
    share = F.when(F.col("c_custkey") % 4 != 0, (F.col("c_custkey") % 4) / F.lit(8.0))
    return X.table(spark, d, "customer").select(T.percent(share).alias("shown")).groupBy("shown").agg(F.count("*").alias("n"))


@query(
    """SELECT c_custkey, 'data:' || CASE c_custkey % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/gif' ELSE 'image/png' END || ';base64,' || to_base64(encode(c_name)) AS url FROM customer"""
)
def data_urls(spark, d):
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, "a.JPG").when(k == 1, "b.gif").when(k == 2, "c.png").otherwise("noext")
    return X.table(spark, d, "customer").select("c_custkey", T.data_url(F.col("c_name").cast("binary"), name).alias("url"))


@query(
    """SELECT 'all' AS part, CASE WHEN count(*) <> 25 THEN 'not the full dataset' WHEN count(DISTINCT n_regionkey) <> 1 THEN 'more than one n_regionkey' END AS reason FROM nation
UNION ALL SELECT 'one', CASE WHEN count(*) <> 5 THEN 'not the full dataset' WHEN count(DISTINCT n_regionkey) <> 1 THEN 'more than one n_regionkey' END FROM nation WHERE n_regionkey = 1"""
)
def dataset_precondition(spark, d):
    n = X.table(spark, d, "nation")
    whole = V.precondition(n, 25, ("n_regionkey",)).select(F.lit("all").alias("part"), "reason")
    return whole.union(V.precondition(n.where("n_regionkey = 1"), 5, ("n_regionkey",)).select(F.lit("one"), "reason"))


@query(
    """SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'ValueError: Prediction must contain a fields object' END AS error FROM nation"""
)
def prediction_shape(spark, d):
    text = F.expr("""if(n_nationkey % 4 = 0, '{"fields": [1]}', '{"fields": {}}')""")
    return X.table(spark, d, "nation").select("n_nationkey", V.prediction_problem(F.parse_json(text)).alias("error"))


_BARE = """CASE l_linenumber WHEN 1 THEN '1e-20' WHEN 2 THEN '2e-20' WHEN 3 THEN '0.1' WHEN 4 THEN '9007199254740993.0' WHEN 5 THEN '5' ELSE l_quantity::VARCHAR END"""
_BARE_TOO = """CASE l_linenumber WHEN 1 THEN '0' WHEN 2 THEN '2e-20' WHEN 3 THEN '0.10000000000000001' WHEN 4 THEN '9007199254740992.0' WHEN 5 THEN '5.0' ELSE (l_quantity + l_orderkey % 2)::VARCHAR END"""


@query(
    f"""SELECT l_linenumber AS form, CASE WHEN e = g THEN 'correct' ELSE 'value_mismatch' END AS category, count(*) AS n
FROM (SELECT l_linenumber, CAST({_BARE} AS DOUBLE) AS e, CAST({_BARE_TOO} AS DOUBLE) AS g FROM lineitem) GROUP BY ALL"""
)
def bare_number_scoring(spark, d):
    """JSON numbers without a rule are compared by value: small ones, spellings of one double, integers and decimals."""
    i = X.table(spark, d, "lineitem")
    spelled = lambda sql: F.expr(sql.replace("l_quantity::VARCHAR", "cast(l_quantity as string)").replace("(l_quantity + l_orderkey % 2)::VARCHAR", "cast(l_quantity + l_orderkey % 2 as string)"))
    rows = i.select(F.col("l_linenumber").alias("form"), F.parse_json(spelled(_BARE)).alias("expected"), F.parse_json(spelled(_BARE_TOO)).alias("predicted"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("error"))
    return score_long(rows).groupBy("form", "category").agg(F.count("*").alias("n"))


@query(
    """SELECT k % 4 AS form, CASE WHEN k % 4 IN (0, 2) THEN 'correct' ELSE 'value_mismatch' END AS category, count(*) AS n FROM (SELECT o_orderkey AS k FROM orders) GROUP BY ALL"""
)
def integers_and_floats(spark, d):
    """JSON integers against floats, without a rule: equal only if the float is that very integer. 1e23 is a little less than 10^23."""
    integer = F.expr("case k % 4 when 0 then '100000000000000000000' when 1 then '100000000000000000000000' when 2 then '-99999999999999991611392' else '9007199254740993' end")
    real = F.expr("case k % 4 when 0 then '1e20' when 1 then '1e23' when 2 then '-1e23' else '9007199254740992.0' end")
    rows = X.table(spark, d, "orders").selectExpr("o_orderkey as k").select((F.col("k") % 4).alias("form"), F.parse_json(integer).alias("expected"), F.parse_json(real).alias("predicted"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("error"))
    return score_long(rows).groupBy("form", "category").agg(F.count("*").alias("n"))


@query(
    """SELECT form, category, count(*) AS n FROM (SELECT o_orderkey % 5 AS form, CASE o_orderkey % 5 WHEN 0 THEN 'correct' WHEN 1 THEN 'correct' WHEN 2 THEN 'correct' WHEN 3 THEN 'correct' ELSE 'value_mismatch' END AS category FROM orders) GROUP BY ALL"""
)
def unicode_scoring(spark, d):
    """Texts beyond ASCII: full-width and Arabic digits, sharp s, ideographic spaces, composed letters, and a digit off."""
    digits = lambda base: F.translate(F.col("t"), "0123456789", "".join(chr(base + i) for i in range(10)))
    o = X.table(spark, d, "orders").selectExpr("o_orderkey as k", "cast(o_orderkey as string) as t")
    form = F.col("k") % 5
    expected = F.when(form.isin(0, 4), F.col("t")).when(form == 1, F.col("t")).when(form == 2, F.concat(F.lit("Straße "), "t")).otherwise(F.concat(F.lit("caf\u00e9 "), "t"))
    predicted = (
        F.when(form == 0, digits(0xFF10)).when(form == 1, digits(0x0660)).when(form == 2, F.concat(F.lit("\u3000STRASSE\u3000\u3000"), "t"))
        .when(form == 3, F.concat(F.lit("CAFE\u0301 "), "t")).otherwise(F.concat(digits(0xFF10), F.lit("\uff10")))
    )
    rows = o.select(form.alias("form"), expected.cast("variant").alias("expected"), predicted.cast("variant").alias("predicted"), F.when(form < 2, "number").otherwise("string").alias("rule"), F.lit(None).cast("string").alias("error"))
    return score_long(rows).groupBy("form", "category").agg(F.count("*").alias("n"))


@query(
    """SELECT p_size % 6 AS form, CASE p_size % 6 WHEN 5 THEN 'correct' WHEN 4 THEN 'missing_value' ELSE 'invalid_value' END AS category, count(*) AS n FROM part GROUP BY ALL"""
)
def text_rule_other_values(spark, d):
    """Under a text rule: numbers, booleans, objects and arrays are invalid, null is missing."""
    value = F.expr("case p_size % 6 when 0 then '5' when 1 then 'true' when 2 then '{\"a\": \"5\"}' when 3 then '[\"5\"]' when 4 then 'null' else '\"5\"' end")
    rows = X.table(spark, d, "part").select((F.col("p_size") % 6).alias("form"), F.lit("5").cast("variant").alias("expected"), F.parse_json(value).alias("predicted"), F.lit("code").alias("rule"), F.lit(None).cast("string").alias("error"))
    return score_long(rows).groupBy("form", "category").agg(F.count("*").alias("n"))


@query(
    """SELECT k, form, CASE form WHEN 0 THEN 'The fields property must be an object.' WHEN 1 THEN 'No requested field object was found.' WHEN 2 THEN 'The fields object contains no requested field names.' END AS parse_error,
  CASE WHEN form = 3 THEN k::VARCHAR END AS total, CASE WHEN form > 2 THEN CASE WHEN form = 3 THEN 1 ELSE 0 END ELSE -1 END AS evidence, CASE WHEN form > 2 THEN CASE WHEN form = 4 THEN 2 ELSE 0 END ELSE -1 END AS uncertainties, raw_length
FROM (SELECT o_orderkey AS k, o_orderkey % 5 AS form, CASE o_orderkey % 5 WHEN 0 THEN 15 WHEN 1 THEN 12 WHEN 2 THEN 24 WHEN 3 THEN 72 + 2 * length(o_orderkey::VARCHAR) ELSE 61 END AS raw_length FROM orders)"""
)
def parse_field_objects(spark, d):
    """Objects without requested fields, an object after braces that open none, evidence, uncertainties, and the raw text."""
    raw = """case k % 5 when 0 then '{"fields": [1]}' when 1 then '{"other": 1}' when 2 then '{"fields": {"other": 1}}'
      when 3 then concat('see {', k, '} {"fields": {"total_amount": "', k, '"}, "evidence": [{"field": "a"}]} ok') else '{"fields": {}, "evidence": 7, "uncertainties": ["a", "b"]}   ' end"""
    rows = X.table(spark, d, "orders").selectExpr("o_orderkey as k").select("k", (F.col("k") % 5).alias("form"), F.expr(raw).alias("raw_output"), F.array(F.lit("total_amount")).alias("requested"))
    out = P.parse_output(rows)
    size = lambda c: F.size(F.from_json(F.to_json(c), "array<variant>"))
    held = lambda c: F.when(F.col("parse_error").isNull(), size(c)).otherwise(-1).alias(c)
    total = F.try_variant_get(P.field_value(F.col("fields"), F.lit("total_amount")), "$", "string")
    return out.select("k", "form", "parse_error", total.alias("total"), held("evidence"), held("uncertainties"), F.length("raw_output").alias("raw_length"))


@query(O["mapping_rejects"])
def mapping_of_variants(spark, d):
    """Nested labels given as VARIANT instead of as JSON text."""
    rows = X.nested_labels(spark, d).withColumn("ground_truth", F.parse_json("ground_truth"))
    return P.map_labels(rows).groupBy("reject").agg(F.count("*").alias("n"))


@query(
    """SELECT reason, count(*) AS n FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'Image must be inside the dataset directory' WHEN 1 THEN 'Image does not exist: images/no.png'
  WHEN 2 THEN 'Image must be inside the dataset directory' END AS reason FROM part) WHERE reason IS NOT NULL GROUP BY reason"""
)
def image_paths(spark, d):
    p = X.table(spark, d, "part").select(F.col("p_partkey").alias("line_no"), F.col("p_partkey").cast("string").alias("id"))
    image = F.expr("case line_no % 4 when 0 then '../x.png' when 1 then 'images/no.png' when 2 then 'images/../../x.png' else concat('images/./a/../', id, '.png') end")
    rows = p.withColumn("image", image)
    files = p.select(F.concat(F.lit("images/./a/../"), "id", F.lit(".png")).alias("image"))
    return V.missing_images(rows, files).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, 'tax_amount' AS field FROM part WHERE p_partkey % 3 > 0")
def untexted_amount_rules(spark, d):
    """Amounts whose rule is not the text rule, which a receipt profile refuses."""
    rule = F.expr("case p_partkey % 3 when 0 then 'string or null' when 1 then 'number' else cast(null as string) end")
    p = X.table(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("id"), F.lit("tax_amount").alias("field"), rule.alias("rule_text")).union(p.select("p_partkey", F.lit("note"), F.lit("string")))
    return V.untexted_amounts(rows).select("id", "field")


@query("WITH " + X.SQL_PRINTED + " SELECT field, min(k) AS doc_pos, arg_min(fi, k) AS pos FROM p GROUP BY field")
def report_field_order(spark, d):
    return M.report_order(_scored(spark, d)).select("field", "first.doc_pos", "first.pos")


@query(
    """SELECT k AS id, policy, CASE policy WHEN 'label-context-v1' THEN 'q' ELSE 'again' END AS question, CASE WHEN policy <> 'invalid-amount-v1' OR k % 6 = 1 THEN 'tax_amount' ELSE 'tax_amount,total_amount' END AS asked,
  CASE WHEN policy = 'label-context-v1' THEN 3 WHEN policy = 'invalid-amount-v1' AND k % 6 = 2 THEN 2 ELSE 1 END AS n_rules
FROM (SELECT o_orderkey AS k, unnest(['none', 'invalid-amount-v1', 'percent-crop-v1', 'label-context-v1']) AS policy FROM orders) WHERE policy <> 'none' AND k % 6 IN (1, 2)"""
)
def second_reading_requests(spark, d):
    """Which documents are asked again under each policy, for what, and by which question. None without a flag is."""
    from .recheck import requests

    fields = F.expr("""case k % 6 when 1 then '{"tax_amount": "10%", "note": "N/A"}' when 2 then '{"tax_amount": "10%", "total_amount": "none"}' when 3 then '{"tax_amount": "1"}' else '{"tax_amount": null}' end""")
    rules = F.lit('{"tax_amount": "string or null", "total_amount": "string or null", "note": "string"}')
    docs = X.table(spark, d, "orders").selectExpr("o_orderkey as k").select(F.col("k").alias("id"), F.lit("i").alias("image"), F.lit("q").alias("question"), F.parse_json(rules).alias("field_schema"), F.parse_json(fields).alias("fields"))
    found = None
    for policy in R.POLICIES[1:]:
        one = requests(docs, policy).withColumn("policy", F.lit(policy))
        found = one if found is None else found.union(one)
    return found.select("id", "policy", F.when(F.col("question") == "q", "q").otherwise("again").alias("question"), F.array_join("asked", ",").alias("asked"), F.size(F.json_object_keys("field_schema")).alias("n_rules"))


@query(
    """SELECT k AS id, CASE WHEN k % 3 = 0 THEN 'tax:2,total:1' ELSE 'tax:1,total:1' END AS evidence, CASE WHEN k % 3 = 0 THEN '' ELSE 'paid' END AS answer,
  CASE WHEN k % 3 <> 0 THEN 0.5 END AS confidence, 'paid' AS first_answer, 2 AS first_evidence FROM (SELECT o_orderkey AS k FROM orders)"""
)
def evidence_merge(spark, d):
    """Evidence of accepted fields comes from the second reading, all else from the first, which is kept."""
    kind = "array<struct<field:string,text:string>>"
    rows = X.table(spark, d, "orders").selectExpr("o_orderkey as k").select(
        F.col("k").alias("id"), F.expr("if(k % 3 < 2, array('tax'), cast(array() as array<string>))").alias("asked"), F.expr("if(k % 3 = 0, array('tax'), cast(array() as array<string>))").alias("accepted"),
        F.expr(f"cast(array(struct('tax' as field, 'tax:1' as text), struct('total' as field, 'total:1' as text)) as {kind})").alias("evidence"),
        F.expr(f"cast(array(struct('tax' as field, 'tax:2' as text), struct('total' as field, 'total:2' as text)) as {kind})").alias("second_evidence"), F.lit("paid").alias("answer"), F.lit(0.5).alias("confidence"),
        F.lit(None).cast("string").alias("second_error"), F.lit(True).alias("request_started"), F.lit(1.0).alias("latency"), F.lit(1.0).alias("second_latency"), F.lit(1.0).alias("memory"), F.lit(1.0).alias("second_memory"),
    )
    out = R.merge_documents(rows)
    return out.select("id", F.array_join(F.array_sort(F.transform("evidence", lambda e: e["text"])), ",").alias("evidence"), "answer", "confidence", F.col("initial.answer").alias("first_answer"), F.size("initial.evidence").alias("first_evidence"))


@query("SELECT CASE WHEN c_custkey % 10 = 0 THEN 'ValueError: unreadable' END AS error, count(*) AS n FROM customer GROUP BY ALL")
def mock_replay_counts(spark, d):
    """An analyzer over documents without labels: each answers from its question, every fifth fails."""
    from ..operators.infer import infer

    rows = X.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.lit("none").alias("image"), F.col("c_custkey").cast("string").alias("question"), F.lit('{"name": "string"}').alias("field_schema"))
    out = infer(rows, Echo)
    return out.groupBy(F.col("error").alias("error")).agg(F.count("*").alias("n"))


class Echo:
    """A stub that repeats the question and fails for names that end in 0."""

    def analyze(self, image, question, field_schema):
        if question.endswith("0"):
            raise ValueError("unreadable")
        return {"fields": {"name": question}, "confidence": 1.0}

    def describe(self):
        return {"backend": "echo"}


def queries() -> dict:
    return Q | catalog_files.Q


def oracle_sql() -> dict[str, str]:
    return O | catalog_files.O
