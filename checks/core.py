"""Queries of the verification core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import query, table
from checks.sqltext import CHECKS, EVENTS, OBS, ROLLED, STEPS, with_
from claimlake.plans import workload as W
from claimlake.plans.verify import Verification


def run(spark: SparkSession, sf_dir: str, *keep: str) -> Verification:
    return Verification(spark, W.log_lines(table(spark, sf_dir, "orders")), W.registry(), W.state(spark, sf_dir), keep=keep)


def claimed(spark: SparkSession, sf_dir: str, kinds: list[str] | None = None) -> Verification:
    """The same claims without the log text around them."""
    return Verification(spark, None, W.registry(), W.state(spark, sf_dir), kinds, W.observations(table(spark, sf_dir, "orders")))


# --- logs ---------------------------------------------------------------------------------

@query("load_events", with_(EVENTS, """
SELECT type, COUNT(*) AS n, COUNT(DISTINCT workflow_id) AS workflows, COUNT(seq) AS seqs, SUM(CAST(seq AS BIGINT))::BIGINT AS seq_sum,
  COUNT(parent) AS parents, COUNT(status) AS statuses, SUM(CAST(hits AS BIGINT))::BIGINT AS hit_sum, COUNT(decision) AS decisions, MAX(line_no) AS last_line
FROM ev WHERE valid GROUP BY type"""))
def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir).events.filter("valid").groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("workflow_id").alias("workflows"), F.count("seq").alias("seqs"),
        F.sum("seq").alias("seq_sum"), F.count("parent_run_event_id").alias("parents"), F.count("status").alias("statuses"),
        F.sum("hit_count").alias("hit_sum"), F.count("decision").alias("decisions"), F.max("line_no").alias("last_line"),
    )


@query("event_validity", with_(EVENTS, """
SELECT source_file, line_no, valid, COALESCE(type, '') AS type, COALESCE(run_event_id, '') AS run_event_id FROM ev"""))
def event_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir).events.select(
        "source_file", "line_no", "valid", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("run_event_id", F.lit("")).alias("run_event_id")
    )


@query("event_file_counts", with_(EVENTS, """,
f AS (SELECT source_file, COUNT(*) AS non_empty_lines, COUNT(*) FILTER (WHERE valid) AS valid_events, COUNT(*) FILTER (WHERE NOT valid) AS malformed_lines,
  COUNT(*) FILTER (WHERE type='tool_observed') AS t FROM ev GROUP BY 1),
w AS (SELECT source_file, workflow_id, COUNT(*) FILTER (WHERE type='tool_observed') AS tool_observed_own FROM ev WHERE valid GROUP BY 1, 2)
SELECT source_file, workflow_id, non_empty_lines, valid_events, malformed_lines, tool_observed_own, t - tool_observed_own AS tool_observed_others
FROM w JOIN f USING (source_file)"""))
def event_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimlake.sources.events import workflow_counts

    return workflow_counts(run(spark, sf_dir, "events").events)


@query("workflow_filter", with_(EVENTS, """
SELECT workflow_id, COUNT(*) AS n_events, COUNT(*) FILTER (WHERE type='tool_observed') AS n_claims FROM ev WHERE valid GROUP BY 1"""))
def workflow_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir).events.filter("valid").groupBy("workflow_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("type") == "tool_observed").alias("n_claims")
    )


@query("ingest_index", with_(EVENTS, """
SELECT workflow_id, run_event_id, row_number() OVER (PARTITION BY workflow_id ORDER BY source_file, line_no) - 1 AS ingest_index FROM ev WHERE valid"""))
def ingest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimlake.sources.events import with_ingest_index

    return with_ingest_index(run(spark, sf_dir, "events").events).select("workflow_id", "run_event_id", "ingest_index")


# --- steps --------------------------------------------------------------------------------

@query("logical_steps", with_(STEPS, "SELECT workflow_id, seq, tool_id, 't' || k AS claim, repeat_count FROM planned"))
def logical_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claimed(spark, sf_dir).planned.select(
        "workflow_id", "seq", "tool_id", F.concat(F.lit("t"), F.floor(F.col("line_no") / 8)).alias("claim"), "repeat_count"
    )


@query("retry_divergence", with_(STEPS, "SELECT workflow_id, seq, repeat_count, divergent FROM planned WHERE repeat_count > 1"))
def retry_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claimed(spark, sf_dir).planned.filter("repeat_count > 1").select("workflow_id", "seq", "repeat_count", "divergent")


@query("stable_seq_sort", with_(OBS, """
SELECT workflow_id, seq, line_no, row_number() OVER (PARTITION BY workflow_id ORDER BY seq, line_no) - 1 AS place FROM obs"""))
def stable_seq_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimlake.operators.steps import seq_positions

    return seq_positions(claimed(spark, sf_dir).observations).select("workflow_id", "seq", "line_no", "place")


@query("capture_order", with_(OBS, """,
m AS (SELECT workflow_id, seq, MAX(seq) OVER (PARTITION BY workflow_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM obs)
SELECT workflow_id, COALESCE(BOOL_OR(seq < mx), false) AS capture_irregular, COUNT(*) FILTER (WHERE seq < mx) AS late_observations FROM m GROUP BY 1"""))
def capture_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimlake.operators.steps import capture_irregular

    return capture_irregular(claimed(spark, sf_dir).observations)


_TS = """,
nx AS (SELECT workflow_id, seq, line_no, epoch, LAG(seq) OVER w AS pseq, LAG(epoch) OVER w AS pepoch FROM obs WINDOW w AS (PARTITION BY workflow_id ORDER BY seq, line_no)),
firstdrop AS (SELECT workflow_id, MIN_BY(pseq, (seq, line_no)) AS seq_before, MIN_BY(seq, (seq, line_no)) AS seq_after FROM nx WHERE pepoch > epoch GROUP BY 1)
"""


@query("timestamp_order", with_(OBS, _TS + "SELECT workflow_id, seq_before, seq_after FROM firstdrop"))
def timestamp_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimlake.operators.steps import timestamp_regressions

    return timestamp_regressions(claimed(spark, sf_dir).observations)


# --- registry and resolution ----------------------------------------------------------------

@query("registry_join", with_(STEPS, """
SELECT workflow_id, seq, tool_id, tool_id <> 'ghost.tool' AS known,
  CASE tool_id WHEN 'orders.upsert' THEN 'sql_row' WHEN 'orders.audit' THEN 'sql_effects' WHEN 'orders.purge' THEN 'sql_row_absent'
    WHEN 'orders.link' THEN 'sql_relational' ELSE '' END AS tool_kind FROM planned"""))
def registry_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = W.registry().checks(spark).filter("check_ord = 0").select("tool_id", "tool_kind")
    return claimed(spark, sf_dir).planned.join(F.broadcast(tools), "tool_id", "left").select(
        "workflow_id", "seq", "tool_id", F.col("tool_kind").isNotNull().alias("known"), F.coalesce("tool_kind", F.lit("")).alias("tool_kind")
    )


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claimed(spark, sf_dir).resolved


_WANT = """,
step AS (
  SELECT p.*, b.c, b.st, b.price, b.fault, CASE b.fault WHEN 'absent' THEN b.k+100000000 WHEN 'nokey' THEN NULL ELSE b.k END AS rec,
    CASE WHEN b.k%3=0 THEN b.k%7+1 ELSE 8 END AS line_claimed FROM planned p JOIN base b USING (k) WHERE NOT p.divergent)
"""


@query("resolve_row_expectation", with_(STEPS, _WANT + """
SELECT workflow_id, seq, 'orders' AS table_name, COALESCE('o_orderkey=' || rec, '') AS identity,
  CASE WHEN fault='shape' THEN 'o_ghost:string=' || st || ',' ELSE 'o_orderstatus:string=' || CASE WHEN fault='mismatch' THEN 'X' ELSE st END || ',' END
    || 'o_totalprice:number=' || regexp_replace(regexp_replace(CAST(price AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS required,
  CASE WHEN rec IS NULL THEN 'KEY_VALUE_POINTER_MISSING' ELSE '' END AS code
FROM step WHERE tool_id='orders.upsert'"""))
def resolve_row_expectation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimlake.operators.rollup import eq_text

    required = F.array_join(F.transform("required", lambda f: F.concat(f["k"], F.lit(":"), f["t"], F.lit("="), f["v"])), ",")
    return resolved(spark, sf_dir).filter("tool_id = 'orders.upsert' and not divergent").select(
        "workflow_id", "seq", "table_name", eq_text(F.filter("identity_eq", lambda p: p["value"].isNotNull())).alias("identity"),
        required.alias("required"), F.coalesce("problem_code", F.lit("")).alias("code"),
    )


@query("resolve_row_absent", with_(STEPS, _WANT + """
SELECT workflow_id, seq, 'lineitem' AS table_name, COALESCE('l_orderkey=' || rec, '') AS identity, 'l_linenumber=' || line_claimed AS filters,
  CASE WHEN rec IS NULL THEN 'KEY_VALUE_POINTER_MISSING' ELSE '' END AS code FROM step WHERE tool_id='orders.purge'"""))
def resolve_row_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimlake.operators.rollup import eq_text

    return resolved(spark, sf_dir).filter("tool_id = 'orders.purge' and not divergent").select(
        "workflow_id", "seq", "table_name", eq_text(F.filter("identity_eq", lambda p: p["value"].isNotNull())).alias("identity"),
        eq_text(F.col("filter_eq")).alias("filters"), F.coalesce("problem_code", F.lit("")).alias("code"),
    )


@query("resolve_relational", with_(STEPS, _WANT + """,
kinds(check_id, check_kind, table_name, lookup_table) AS (VALUES ('a_lines','related_exists','lineitem',''),('b_count','aggregate','lineitem',''),
  ('c_sum','aggregate','lineitem',''),('d_join','join_count','orders','lineitem'),('e_orphans','anti_join','orders','lineitem'))
SELECT workflow_id, seq, check_id, check_kind, table_name, lookup_table,
  CASE check_id WHEN 'b_count' THEN CAST(k%4 AS DOUBLE) WHEN 'c_sum' THEN 150.0 WHEN 'd_join' THEN 2.0 ELSE -1.0 END AS expect_value,
  CASE WHEN rec IS NULL AND check_id <> 'e_orphans' THEN 'KEY_VALUE_POINTER_MISSING' ELSE '' END AS code
FROM step CROSS JOIN kinds WHERE tool_id='orders.link'"""))
def resolve_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir).filter("tool_id = 'orders.link' and not divergent").select(
        "workflow_id", "seq", "check_id", "check_kind", "table_name", F.coalesce("lookup_table", F.lit("")).alias("lookup_table"),
        F.coalesce("expect_value", F.lit(-1.0)).alias("expect_value"), F.coalesce("problem_code", F.lit("")).alias("code"),
    )


@query("resolve_effects", with_(STEPS, _WANT + """,
kinds(check_id, table_name) AS (VALUES ('customer_row','customer'),('order_row','orders'))
SELECT workflow_id, seq, check_id, table_name, CASE WHEN check_id='order_row' AND rec IS NULL THEN 'KEY_VALUE_POINTER_MISSING' ELSE '' END AS code
FROM step CROSS JOIN kinds WHERE tool_id='orders.audit'"""))
def resolve_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir).filter("tool_id = 'orders.audit' and not divergent").select(
        "workflow_id", "seq", "check_id", "table_name", F.coalesce("problem_code", F.lit("")).alias("code")
    )


@query("resolver_errors", with_(ROLLED, """
SELECT problem AS code, COUNT(*) AS steps FROM grouped WHERE problem IS NOT NULL GROUP BY 1"""))
def resolver_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = resolved(spark, sf_dir).filter("problem_code is not null").groupBy("workflow_id", "seq").agg(
        F.min_by("problem_code", F.coalesce("check_ord", F.lit(0))).alias("code")
    )
    return first.groupBy("code").agg(F.count(F.lit(1)).alias("steps"))


@query("intended_effect", with_(STEPS, _WANT + """
SELECT workflow_id, seq, CASE tool_id WHEN 'ghost.tool' THEN 'Unknown tool: ghost.tool'
  WHEN 'orders.upsert' THEN 'Upsert order ' || COALESCE('"' || rec || '"', 'MISSING') || ' with {"' || CASE WHEN fault='shape' THEN 'o_ghost' ELSE 'o_orderstatus' END || '":"'
    || CASE WHEN fault='mismatch' THEN 'X' ELSE st END || '","o_totalprice":' || regexp_replace(CAST(CAST(price AS DOUBLE) AS VARCHAR), '\\.0$', '') || '}'
  WHEN 'orders.audit' THEN 'Audit order ' || COALESCE('"' || rec || '"', 'MISSING')
  WHEN 'orders.purge' THEN 'Purge line ' || line_claimed || ' of ' || COALESCE('"' || rec || '"', 'MISSING')
  ELSE 'Link ' || COALESCE('"' || rec || '"', 'MISSING') END AS narrative
FROM step"""))
def intended_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir).filter("not divergent and coalesce(check_ord, 0) = 0").select("workflow_id", "seq", "narrative")


@query("canonical_params", with_(OBS, """
SELECT workflow_id, line_no, '{"attempt":' || attempt || ',"custId":' || c || ',"lineNo":' || (k%7) || ',"recordId":"' || k || '"}' AS canonical FROM obs"""))
def canonical_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimlake.functions.jsonval import canonical

    claims = claimed(spark, sf_dir).observations
    k = F.floor(F.col("line_no") / 8)
    attempt = F.when((F.col("line_no") % 8 == 6) & (k % 2 == 1), 2).otherwise(1)
    unordered = F.format_string(
        '{ "recordId": "%d", "lineNo": %d.0,\t"custId": %s , "attempt": %d }', k, k % 7, F.get_json_object("params", "$.custId"), attempt
    )
    return claims.select("workflow_id", "line_no", canonical(unordered).alias("canonical"))


# --- checks -------------------------------------------------------------------------------

def _checks(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    return claimed(spark, sf_dir, list(kinds)).checks


_ROW = "SELECT workflow_id, seq, check_id, status, COALESCE(code, '') AS code, COALESCE(field, '') AS field FROM checks WHERE check_kind='sql_row'"


@query("verify_row", with_(CHECKS, _ROW + " AND check_id=''"))
def verify_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checks(spark, sf_dir, "sql_row").filter("check_id = ''").select(
        "workflow_id", "seq", "check_id", "status", F.coalesce("code", F.lit("")).alias("code"), F.coalesce("field", F.lit("")).alias("field")
    )


@query("verify_effects", with_(CHECKS, _ROW + " AND check_id<>''"))
def verify_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checks(spark, sf_dir, "sql_row").filter("check_id <> ''").select(
        "workflow_id", "seq", "check_id", "status", F.coalesce("code", F.lit("")).alias("code"), F.coalesce("field", F.lit("")).alias("field")
    )


def _counted(kind: str) -> str:
    return with_(CHECKS, f"SELECT workflow_id, seq, check_id, status, COALESCE(code, '') AS code, COALESCE(matched, -1) AS matched FROM checks WHERE check_kind='{kind}'")


def _count_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "workflow_id", "seq", "check_id", "status", F.coalesce("code", F.lit("")).alias("code"), F.coalesce("matched", F.lit(-1)).cast("bigint").alias("matched")
    )


@query("verify_row_absent", _counted("sql_row_absent"))
def verify_row_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count_columns(_checks(spark, sf_dir, "sql_row_absent").filter("check_kind is not null"))


@query("related_exists", _counted("related_exists"))
def related_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count_columns(_checks(spark, sf_dir, "related_exists").filter("check_kind is not null"))


@query("orphan_anti_join", _counted("anti_join"))
def orphan_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count_columns(_checks(spark, sf_dir, "anti_join").filter("check_kind is not null"))


def _measured(kind: str) -> str:
    return with_(CHECKS, f"SELECT workflow_id, seq, check_id, status, COALESCE(code, '') AS code, COALESCE(measured, -1) AS measured FROM checks WHERE check_kind='{kind}'")


def _measure_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "workflow_id", "seq", "check_id", "status", F.coalesce("code", F.lit("")).alias("code"), F.coalesce("measured", F.lit(-1.0)).alias("measured")
    )


@query("aggregate_check", _measured("aggregate"))
def aggregate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measure_columns(_checks(spark, sf_dir, "aggregate").filter("check_kind is not null"))


@query("join_count", _measured("join_count"))
def join_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measure_columns(_checks(spark, sf_dir, "join_count").filter("check_kind is not null"))


@query("sample_rows_3", """
WITH bad AS (SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1),
r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS rn
  FROM lineitem JOIN bad USING (l_orderkey, l_linenumber))
SELECT l_orderkey, l_linenumber, CAST(rn AS INTEGER) AS place, l_partkey FROM r WHERE rn <= 3""")
def sample_rows_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimlake.operators.topk import sample_rows

    lines = table(spark, sf_dir, "lineitem")
    repeated = lines.groupBy("l_orderkey", "l_linenumber").count().filter("count > 1").drop("count")
    return sample_rows(
        lines.join(repeated, ["l_orderkey", "l_linenumber"], "left_semi"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"]
    ).select("l_orderkey", "l_linenumber", "place", "l_partkey")


@query("failing_samples", with_(CHECKS, """, bad AS (SELECT DISTINCT s.rec, s.line_claimed FROM checks c JOIN step s USING (workflow_id, seq) WHERE c.code='ROW_PRESENT_WHEN_FORBIDDEN'),
r AS (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem l JOIN bad ON l_orderkey=rec AND l_linenumber=line_claimed)
SELECT l_orderkey, l_linenumber, CAST(rn AS INTEGER) AS place, l_partkey FROM r WHERE rn <= 3"""))
def failing_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimlake.operators.reconcile import failing_samples as samples
    from claimlake.plans.verify import registry_bindings

    v = claimed(spark, sf_dir, ["sql_row_absent"])
    found = samples(v.checks, v.state, registry_bindings(v.registry, v.kinds), {"lineitem": ["l_partkey", "l_suppkey", "l_extendedprice"]})
    number = lambda c: F.get_json_object("row", f"$.{c}").cast("bigint").alias(c)
    return found.select(number("l_orderkey"), number("l_linenumber"), "place", number("l_partkey"))


@query("two_row_probe", """
SELECT l_orderkey, l_linenumber, CAST(LEAST(COUNT(*), 2) AS INTEGER) AS row_count, CASE WHEN COUNT(*) > 1 THEN 'DUPLICATE_ROWS' ELSE '' END AS code
FROM lineitem GROUP BY 1, 2""")
def two_row_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.least(n, F.lit(2)).cast("int").alias("row_count"), F.when(n > 1, "DUPLICATE_ROWS").otherwise("").alias("code")
    )


# --- rollups ------------------------------------------------------------------------------

@query("multi_rollup", with_(ROLLED, "SELECT workflow_id, seq, tool_id, status, COALESCE(code, '') AS code, effects FROM steps WHERE multi"))
def multi_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.array_join(F.transform("effects", lambda e: F.concat_ws(":", e["id"], e["status"], F.coalesce(e["code"], F.lit("")))), ";")
    return claimed(spark, sf_dir).steps.filter("effects is not null").select(
        "workflow_id", "seq", "tool_id", "status", F.coalesce("code", F.lit("")).alias("code"), text.alias("effects")
    )


@query("workflow_status", with_(ROLLED, "SELECT workflow_id, status, malformed, n_steps, n_verified, n_incomplete FROM wfs"))
def workflow_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, "events").workflows.select(
        "workflow_id", "status", "malformed", "n_steps", "n_verified", F.col("n_incomplete_verification").alias("n_incomplete")
    )


@query("step_status_counts", with_(ROLLED, """
SELECT workflow_id, n_verified AS verified, n_missing AS missing, n_inconsistent AS inconsistent, n_incomplete AS incomplete_verification,
  n_partial AS partially_verified, CAST(0 AS BIGINT) AS uncertain,
  CASE status WHEN 'complete' THEN 'TRUSTED: Every step matched the database under the configured verification rules.'
  WHEN 'inconsistent' THEN 'NOT TRUSTED: At least one step failed verification against the database (determinate failure).'
  ELSE 'NOT TRUSTED: Verification is incomplete; the workflow cannot be fully confirmed.' END AS trust FROM wfs"""))
def step_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimlake.operators.rollup import trust_line

    w = run(spark, sf_dir, "events").workflows
    return w.select("workflow_id", *[F.col(f"n_{s}").alias(s) for s in (
        "verified", "missing", "inconsistent", "incomplete_verification", "partially_verified", "uncertain")], trust_line().alias("trust"))


@query("no_steps_reason", with_(EVENTS, """,
asked AS (SELECT 'wf_' || c_custkey AS workflow_id, 'log_' || (c_custkey // 4) AS source_file FROM customer UNION ALL SELECT 'lost_' || c_custkey, 'log_' || (c_custkey // 3) FROM customer WHERE c_custkey%3=0),
f AS (SELECT source_file, COUNT(*) AS lines, COUNT(*) FILTER (WHERE valid) AS ok, COUNT(*) FILTER (WHERE type='tool_observed') AS t FROM ev GROUP BY 1),
own AS (SELECT DISTINCT workflow_id FROM ev WHERE type='tool_observed')
SELECT workflow_id, 'NO_STEPS_FOR_WORKFLOW' AS code, 'No tool_observed events for workflowId "' || workflow_id || '" after filtering. event_file_non_empty_lines='
  || COALESCE(lines,0) || ' schema_valid_events=' || COALESCE(ok,0) || ' tool_observed_for_workflow=0 tool_observed_other_workflows=' || COALESCE(t,0) || '.' AS message
FROM asked LEFT JOIN f USING (source_file) WHERE workflow_id NOT IN (SELECT workflow_id FROM own)"""))
def no_steps_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's workflow is asked for, and for each third one a workflow that left no claims, in a file that may not exist."""
    from claimlake.plans.verify import no_steps_reasons

    c = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    file = lambda n: F.concat(F.lit("log_"), F.floor(c / n)).alias("source_file")
    asked = customers.select(F.concat(F.lit("wf_"), c).alias("workflow_id"), file(4)).unionByName(
        customers.filter(c % 3 == 0).select(F.concat(F.lit("lost_"), c).alias("workflow_id"), file(3)))
    return no_steps_reasons(asked, run(spark, sf_dir).events).select("workflow_id", "code", "message")


@query("verify_workflows", with_(ROLLED, """
SELECT workflow_id, seq, tool_id, s.status, COALESCE(code, '') AS code, repeat_count, w.status AS workflow_status FROM steps s JOIN wfs w USING (workflow_id)"""))
def verify_workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimlake.operators.skew import lookup_join

    v = run(spark, sf_dir, "events", "steps")
    steps = v.steps.select("workflow_id", "seq", "tool_id", "status", F.coalesce("code", F.lit("")).alias("code"), "repeat_count")
    return lookup_join(steps, v.workflows.select("workflow_id", F.col("status").alias("workflow_status")), ["workflow_id"])
