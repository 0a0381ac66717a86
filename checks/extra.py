"""Queries of registry validation, pointers, sinks and small helpers."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import query, table
from checks.comparison import SAVED, steps
from checks.core import claimed
from checks.inference import TABLES
from checks.kpi import DAY, FUNNEL, _D, funnel
from checks.sqltext import OBS, ROLLED, STEPS, with_
from claimlake.functions import jsonval as J
from claimlake.functions.decisions import outcome_label
from claimlake.operators.rollup import eq_text
from claimlake.plans import kpi
from claimlake.plans import workload as W
from claimlake.plans.verify import validate_registry as validate
from claimlake.session import shared_dir
from claimlake.sources.corpus import write_bundles
from claimlake.sources.registry import Registry
from claimlake.sources.state import State


@query("load_registry", "SELECT tool_id, COUNT(*) AS claims FROM (SELECT CASE WHEN o_orderkey%5<2 THEN 'orders.upsert' WHEN o_orderkey%5=2 THEN 'orders.audit' WHEN o_orderkey%5=3 THEN 'orders.purge' ELSE 'orders.link' END AS tool_id FROM orders WHERE NOT (o_orderkey%19=0 AND o_orderkey%17<>0 AND o_orderkey%13<>0)) GROUP BY 1")
def load_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry goes through a file and comes back as a table that claims join to."""
    folder = f"{shared_dir(spark)}/registry-{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(W.REGISTRY),)], "value string").coalesce(1).write.text(folder)
    registry = Registry.load(spark, folder)
    tools = registry.fixed_checks(spark).filter("check_ord = 0").select("tool_id")
    return W.claims(table(spark, sf_dir, "orders")).join(F.broadcast(tools), "tool_id").groupBy("tool_id").agg(F.count(F.lit(1)).alias("claims"))


@query("validate_registry", with_(ROLLED, "SELECT workflow_id, seq, problem AS code FROM grouped WHERE problem IS NOT NULL"))
def validate_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(claimed(spark, sf_dir).resolved).select("workflow_id", "seq", "code")


@query("resolve_pointer", with_(OBS, """SELECT workflow_id, line_no, CAST(c AS VARCHAR) AS cust, CASE WHEN fault='nokey' THEN 'missing' ELSE 'string' END AS record_type, 'object' AS fields_type FROM obs"""))
def resolve_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda p: J.pointer_value(F.col("params"), p)
    return claimed(spark, sf_dir).observations.select(
        "workflow_id", "line_no", at("/custId").alias("cust"), J.json_type(at("/recordId")).alias("record_type"), J.json_type(at("/fields")).alias("fields_type"))


@query("identifier_check", "SELECT p_partkey, regexp_matches(replace(p_name, ' ', CASE WHEN p_partkey%2=0 THEN '_' ELSE '-' END), '^[a-zA-Z_][a-zA-Z0-9_]*$') AS ok FROM part")
def identifier_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimlake.operators.resolve import IDENTIFIER

    name = F.when(F.col("p_partkey") % 2 == 0, F.translate("p_name", " ", "_")).otherwise(F.translate("p_name", " ", "-"))
    return table(spark, sf_dir, "part").select("p_partkey", name.rlike(IDENTIFIER).alias("ok"))


@query("normalize_identity", "SELECT l_orderkey, l_linenumber, l_partkey, 'l_linenumber=' || l_linenumber || '&l_orderkey=' || l_orderkey || '&l_partkey=' || l_partkey AS identity FROM lineitem")
def normalize_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in ("l_partkey", "l_orderkey", "l_linenumber")])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", eq_text(F.array_sort(pairs)).alias("identity"))


@query("request_fingerprint", with_(STEPS, """, asked AS (SELECT p.workflow_id, p.seq, p.tool_id, b.c, b.fault, CASE b.fault WHEN 'absent' THEN b.k+100000000 ELSE b.k END AS rec FROM planned p JOIN base b USING (k) WHERE NOT p.divergent)
SELECT workflow_id, seq, CASE tool_id WHEN 'orders.audit' THEN 'order_row' ELSE '' END AS check_id, 'orders|o_orderkey=' || rec AS fingerprint FROM asked WHERE tool_id IN ('orders.upsert','orders.audit') AND fault<>'nokey'
UNION ALL SELECT workflow_id, seq, 'customer_row', 'customer|c_custkey=' || c FROM asked WHERE tool_id='orders.audit'"""))
def request_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = claimed(spark, sf_dir, ["sql_row"]).resolved.filter("problem_code is null")
    return rows.select("workflow_id", "seq", F.coalesce("check_id", F.lit("")).alias("check_id"), F.concat_ws("|", "table_name", eq_text(F.col("identity_eq"))).alias("fingerprint"))


@query("verdict_labels", SAVED + """SELECT status, COUNT(*) AS n, CASE status WHEN 'verified' THEN 'VERIFIED' WHEN 'missing' THEN 'FAILED_ROW_MISSING' WHEN 'inconsistent' THEN 'FAILED_VALUE_MISMATCH' WHEN 'partially_verified' THEN 'PARTIALLY_VERIFIED' ELSE 'INCOMPLETE_CANNOT_VERIFY' END AS label FROM s GROUP BY 1""")
def verdict_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("label", outcome_label(F.col("status")))


@query("write_results", SAVED + """, p AS (SELECT workflow_id, run_index, seq, '{"status":"' || status || '"' || CASE WHEN code IS NULL THEN '' ELSE ',"code":"' || code || '"' END || ',"tool_id":"' || tool_id || '"}' AS payload FROM s)
SELECT workflow_id || '/' || run_index || '/' || seq AS run_id, sha256(payload) AS sha256, CAST(strlen(payload) AS INTEGER) AS byte_length FROM p""")
def write_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir).select(
        F.concat_ws("/", "workflow_id", F.col("run_index").cast("string"), F.col("seq").cast("string")).alias("run_id"), "workflow_id", F.to_json(F.struct("status", "code", "tool_id")).alias("payload"))
    return write_bundles(rows, f"{shared_dir(spark)}/results-{uuid.uuid4().hex}").select("run_id", "sha256", "byte_length")


_PACK = ("funnel_counts", "verify_workload", "join_quality", "integrate_attributed", "rolling_30d")


def _pack_sql() -> str:
    """The five tables, each by the SQL of its own query, as lines of text."""
    from checks.base import SQL
    from checks.kpi import _attr

    month = f"created_at >= TIMESTAMP '{DAY}' - INTERVAL 29 DAY AND created_at < TIMESTAMP '{DAY}' + INTERVAL 1 DAY"
    four = "integrate_distinct_fid_count || ',' || global_non_bundled_outcome_row_count || ',' || global_non_bundled_outcome_distinct_fid_count || ',' || integrate_attributed_non_bundled_outcome_distinct_fid_count"
    counts = FUNNEL + f"""SELECT x.event, COUNT(fe.id) AS row_count FROM (VALUES ('acquisition_landed'),('integrate_landed'),('verify_started'),('verify_outcome')) x(event) LEFT JOIN fe ON fe.event=x.event AND {_D} GROUP BY x.event"""
    return " UNION ALL ".join([
        f"SELECT 'funnel_counts' AS part, '{DAY},' || event || ',' || row_count AS line FROM ({counts})",
        f"SELECT 'verify_workload', '{DAY},' || event || ',' || workload_bucket || ',' || row_count FROM ({SQL['verify_workload_daily']})",
        f"SELECT 'join_quality', '{DAY},' || event || ',' || rows_with_fid || ',' || rows_without_fid FROM ({SQL['join_quality_daily']})",
        f"SELECT 'integrate_attributed', '{DAY},' || {four} FROM ({_attr(_D)})",
        f"SELECT 'rolling_30d', '{DAY},' || strftime(TIMESTAMP '{DAY}' - INTERVAL 29 DAY, '%Y-%m-%d') || ',' || {four} FROM ({_attr(month)})",
    ])


@query("daily_pack_csv", _pack_sql())
def daily_pack_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five files, written and read back."""
    folder = f"{shared_dir(spark)}/pack-{uuid.uuid4().hex}"
    kpi.write_daily_pack(spark, funnel(spark, sf_dir), DAY, folder)
    parts = []
    for name in _PACK:
        back = spark.read.option("header", True).csv(f"{folder}/day={DAY}/{name}")
        parts.append(back.select(F.lit(name).alias("part"), F.concat_ws(",", *back.columns).alias("line")))
    return reduce(DataFrame.unionByName, parts)


@query("state_tables", " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS n FROM {t}" for t in TABLES))
def state_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = State.parquet(spark, sf_dir, TABLES).tables
    return reduce(DataFrame.unionByName, [df.groupBy(F.lit(t).alias("table_name")).agg(F.count(F.lit(1)).alias("n")) for t, df in tables.items()])


@query("user_phrase", SAVED + """SELECT COALESCE(code, 'MAPPING_LOW_CONFIDENCE') AS code, COUNT(*) AS n, CASE code WHEN 'ROW_ABSENT' THEN 'Success was implied, but no matching row was found in the database.'
  WHEN 'VALUE_MISMATCH' THEN 'Wrong value in the database for a required field.' WHEN 'UNKNOWN_TOOL' THEN 'The tool is not defined in the registry (or could not be resolved).'
  WHEN 'MULTI_EFFECT_PARTIAL' THEN 'Some intended effects matched; others did not.' ELSE 'Mapping: low confidence.' END AS phrase FROM s GROUP BY 1, 3""")
def user_phrase_(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimlake.functions.phrases import user_phrase

    coded = steps(spark, sf_dir).groupBy(F.coalesce("code", F.lit("MAPPING_LOW_CONFIDENCE")).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return coded.withColumn("phrase", user_phrase(F.col("code")))


@query("verify_target", with_(STEPS, """, asked AS (SELECT p.workflow_id, p.seq, p.tool_id, b.c, b.k, b.fault, CASE b.fault WHEN 'absent' THEN b.k+100000000 ELSE b.k END AS rec,
    CASE WHEN b.fault='shape' THEN 'o_ghost, o_totalprice' ELSE 'o_orderstatus, o_totalprice' END AS fields FROM planned p JOIN base b USING (k) WHERE NOT p.divergent)
SELECT workflow_id, seq, CASE tool_id WHEN 'orders.audit' THEN 'order_row' ELSE '' END AS check_id, 'table=orders identity=[o_orderkey=' || rec || '] required_fields=[' || fields || ']' AS target
  FROM asked WHERE tool_id IN ('orders.upsert','orders.audit') AND fault<>'nokey'
UNION ALL SELECT workflow_id, seq, 'customer_row', 'table=customer identity=[c_custkey=' || c || '] required_fields=[c_name]' FROM asked WHERE tool_id='orders.audit'
UNION ALL SELECT workflow_id, seq, '', 'sql_row_absent table=lineitem identity=[l_orderkey=' || rec || '] filter=[l_linenumber=' || CASE WHEN k%3=0 THEN k%7+1 ELSE 8 END || ']' FROM asked WHERE tool_id='orders.purge' AND fault<>'nokey'
UNION ALL SELECT workflow_id, seq, id, id || ':' || kind FROM asked, (VALUES ('a_lines','related_exists'),('b_count','aggregate'),('c_sum','aggregate'),('d_join','join_count'),('e_orphans','anti_join')) v(id, kind)
  WHERE tool_id='orders.link' AND (fault<>'nokey' OR id='e_orphans')"""))
def verify_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimlake.functions.phrases import target_summary

    rows = claimed(spark, sf_dir).resolved.filter("problem_code is null")
    return rows.select("workflow_id", "seq", F.coalesce("check_id", F.lit("")).alias("check_id"), target_summary().alias("target"))


@query("observed_state_summary", with_(ROLLED, """SELECT s.workflow_id, s.seq, CASE WHEN code IN ('RETRY_OBSERVATIONS_DIVERGE','UNKNOWN_TOOL','KEY_VALUE_POINTER_MISSING') THEN 'No SQL verification request (registry resolution or unknown tool).'
  WHEN tool_id='orders.audit' THEN 'multi_effect effect_rows=2' WHEN tool_id='orders.link' THEN 'multi_effect effect_rows=5'
  WHEN tool_id='orders.upsert' AND code='ROW_ABSENT' THEN 'rowCount=0' WHEN tool_id='orders.upsert' AND code='DUPLICATE_ROWS' THEN 'rowCount=2'
  WHEN tool_id='orders.upsert' AND code='VALUE_MISMATCH' THEN 'rowCount=1 field=o_orderstatus expected="X" actual="' || b.st || '"' WHEN tool_id='orders.upsert' THEN 'rowCount=1'
  ELSE 'SQL evidence present (no rowCount in summary).' END AS summary FROM steps s JOIN base b ON b.k=s.k"""))
def observed_state_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimlake.functions.phrases import evidence_summary

    return claimed(spark, sf_dir).steps.select("workflow_id", "seq", evidence_summary().alias("summary"))
