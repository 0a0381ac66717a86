"""Queries of failure diagnosis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import query
from checks.core import _TS, run
from checks.sqltext import EVENTS, full, with_
from claimlake.plans import diagnose as D

_IDX = """,
ix AS (SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY source_file, line_no) - 1 AS i FROM ev WHERE valid),
ctx AS (SELECT workflow_id, 2 AS max_wire, COUNT(*) FILTER (WHERE type='retrieval') AS n_retrieval, COUNT(*) FILTER (WHERE type='control') AS n_control,
  COUNT(*) FILTER (WHERE type='model_turn') AS n_model_turn, COUNT(*) FILTER (WHERE type='tool_skipped') AS n_tool_skipped,
  COUNT(*) FILTER (WHERE type='tool_observed') AS n_tool_observed, MIN(i) FILTER (WHERE type='tool_observed') AS first_tool_index,
  COALESCE(BOOL_OR(control_kind='run_completed'), false) AS run_completed, MAX(i) AS last_index, MAX_BY(type, i) AS last_type, ARG_MAX_NULL(status, i) AS last_status, COALESCE(ARG_MAX_NULL(control_kind, i)='run_completed', false) AS ends_completed FROM ix GROUP BY 1)
"""
_DRIVER = """,
bad AS (SELECT s.*, CASE status WHEN 'incomplete_verification' THEN 0 WHEN 'missing' THEN 1 WHEN 'inconsistent' THEN 2 WHEN 'partially_verified' THEN 3 ELSE 4 END AS rk FROM steps s WHERE status<>'verified'),
effcode AS (SELECT workflow_id, seq, MIN_BY(code, check_id) AS ecode FROM checks WHERE status<>'verified' GROUP BY 1, 2),
driver AS (SELECT workflow_id, MIN_BY(seq, (rk, seq)) AS driver_seq, MIN_BY(tool_id, (rk, seq)) AS driver_tool_id, MIN_BY(b.code, (rk, seq)) AS step_code,
  MIN_BY(CASE WHEN b.code LIKE 'MULTI_EFFECT%' THEN ecode ELSE b.code END, (rk, seq)) AS primary_code FROM bad b LEFT JOIN effcode USING (workflow_id, seq) GROUP BY 1)
"""
_CAUSE = """,
frontier AS (SELECT b.workflow_id, MIN(li) AS frontier FROM bad b JOIN (SELECT workflow_id, seq, MAX(i) AS li FROM ix WHERE type='tool_observed' GROUP BY 1, 2) l USING (workflow_id, seq) GROUP BY 1),
sus AS (SELECT ix.workflow_id, i, run_event_id,
  CASE WHEN type='retrieval' AND status='error' THEN 'RETRIEVAL_ERROR' WHEN type='model_turn' AND status<>'completed' THEN 'MODEL_TURN_' || upper(status)
    WHEN control_kind='interrupt' THEN 'CONTROL_INTERRUPT' WHEN control_kind IN ('branch','gate') AND decision='skipped' THEN 'CONTROL_' || upper(control_kind) || '_SKIPPED'
    WHEN type='tool_skipped' THEN 'TOOL_SKIPPED' END AS cc FROM ix),
ph AS (SELECT sus.*, CASE WHEN cc='RETRIEVAL_ERROR' THEN 1 WHEN cc LIKE 'MODEL_TURN%' THEN 2 WHEN cc='CONTROL_INTERRUPT' THEN 3 WHEN cc LIKE 'CONTROL%' THEN 4 ELSE 5 END AS p
  FROM sus JOIN frontier USING (workflow_id) WHERE cc IS NOT NULL AND i < frontier),
cause AS (SELECT workflow_id, MIN_BY(p, (p, i)) AS p, MIN_BY(i, (p, i)) AS cause_index, MIN_BY(cc, (p, i)) AS cause_code, MIN_BY(run_event_id, (p, i)) AS cause_event FROM ph GROUP BY 1)
"""
_CAP = """,
cap AS (SELECT workflow_id, COALESCE(BOOL_OR(seq < mx), false) AS capture_irregular FROM (
  SELECT workflow_id, seq, MAX(seq) OVER (PARTITION BY workflow_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM obs) GROUP BY 1)"""

DIAG = full() + _CAP + _TS.rstrip() + _IDX + _DRIVER + _CAUSE


def diagnosis(spark: SparkSession, sf_dir: str) -> D.Diagnosis:
    return D.Diagnosis(spark, run(spark, sf_dir, "events", "steps"))


@query("run_context", with_(EVENTS, _IDX.replace("ARG_MAX_NULL", "arg_max_null") + """
SELECT workflow_id, max_wire, n_retrieval, n_control, n_model_turn, n_tool_skipped, n_tool_observed, COALESCE(first_tool_index, -1) AS first_tool_index,
  run_completed, last_index, last_type, COALESCE(last_status, '') AS last_status FROM ctx"""))
def run_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosis(spark, sf_dir).context.select(
        "workflow_id", "max_wire", "n_retrieval", "n_control", "n_model_turn", "n_tool_skipped", "n_tool_observed",
        F.coalesce("first_tool_index", F.lit(-1)).alias("first_tool_index"), "run_completed", "last_index", "last_type", F.coalesce("last_status", F.lit("")).alias("last_status"))


@query("driver_step", with_(DIAG, "SELECT workflow_id, driver_seq, driver_tool_id, primary_code FROM driver"))
def driver_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    from checks.core import claimed

    return D.driver_steps(claimed(spark, sf_dir).steps).select("workflow_id", "driver_seq", "driver_tool_id", F.col("driver_primary_code").alias("primary_code"))


@query("failure_frontier", with_(DIAG, "SELECT workflow_id, frontier FROM frontier"))
def failure_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosis(spark, sf_dir).frontier


@query("upstream_cause", with_(DIAG, "SELECT workflow_id, p AS cause_phase, cause_index, cause_code FROM cause"))
def upstream_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosis(spark, sf_dir).causes.select("workflow_id", "cause_phase", "cause_index", "cause_code")


_MEANING = """,
meaning(code, origin, category, action) AS (VALUES
  ('MALFORMED_EVENT_LINE','inputs','bad_input','fix_event_ingest_and_steps'),
  ('CAPTURE_ORDER_NOT_MONOTONIC_IN_SEQ','workflow_flow','control_flow_problem','fix_event_sequence_order'),
  ('TIMESTAMP_NOT_MONOTONIC_WITH_SEQ_SORT_ORDER','workflow_flow','control_flow_problem','fix_event_sequence_order'),
  ('RETRIEVAL_ERROR','retrieval','retrieval_failure','fix_run_context_controls'),('MODEL_TURN_ERROR','decision_making','decision_error','fix_run_context_controls'),
  ('MODEL_TURN_ABORTED','decision_making','decision_error','fix_run_context_controls'),('MODEL_TURN_INCOMPLETE','decision_making','decision_error','fix_run_context_controls'),
  ('CONTROL_INTERRUPT','decision_making','decision_error','fix_run_context_controls'),('CONTROL_BRANCH_SKIPPED','decision_making','control_flow_problem','fix_run_context_controls'),
  ('CONTROL_GATE_SKIPPED','decision_making','control_flow_problem','fix_run_context_controls'),('TOOL_SKIPPED','tool_use','control_flow_problem','fix_run_context_controls'),
  ('UNKNOWN_TOOL','tool_use','bad_input','correct_verification_inputs'),('RETRY_OBSERVATIONS_DIVERGE','tool_use','decision_error','align_tool_observations'),
  ('KEY_VALUE_POINTER_MISSING','inputs','bad_input','correct_verification_inputs'),
  ('ROW_ABSENT','downstream_system_state','state_inconsistency','reconcile_downstream_state'),('VALUE_MISMATCH','downstream_system_state','state_inconsistency','reconcile_downstream_state'),
  ('ROW_SHAPE_MISMATCH','downstream_system_state','downstream_execution_failure','improve_read_connectivity'),
  ('ROW_PRESENT_WHEN_FORBIDDEN','downstream_system_state','state_inconsistency','reconcile_downstream_state'),
  ('RELATED_ROWS_ABSENT','downstream_system_state','state_inconsistency','reconcile_downstream_state'),
  ('RELATIONAL_EXPECTATION_MISMATCH','downstream_system_state','state_inconsistency','reconcile_downstream_state'),
  ('ORPHAN_ROW_DETECTED','downstream_system_state','state_inconsistency','reconcile_downstream_state')),
led AS (SELECT w.workflow_id, w.status, c.cause_index, c.cause_event, d.driver_seq, d.driver_tool_id, d.step_code, w.n_missing+w.n_inconsistent+w.n_partial AS bad_steps,
    CASE WHEN w.malformed THEN 'p0' WHEN c.p=1 THEN 'p1' WHEN c.p IN (2,3) THEN 'p2' WHEN c.p=4 THEN 'p2b' WHEN c.p=5 THEN 'p3'
      WHEN capture_irregular OR f.seq_after IS NOT NULL THEN 'p4' ELSE 'p5' END AS phase,
    CASE WHEN w.malformed THEN 'MALFORMED_EVENT_LINE' WHEN c.p IS NOT NULL THEN c.cause_code WHEN capture_irregular THEN 'CAPTURE_ORDER_NOT_MONOTONIC_IN_SEQ'
      WHEN f.seq_after IS NOT NULL THEN 'TIMESTAMP_NOT_MONOTONIC_WITH_SEQ_SORT_ORDER' ELSE d.primary_code END AS code
  FROM wfs w LEFT JOIN cause c USING (workflow_id) LEFT JOIN cap USING (workflow_id) LEFT JOIN firstdrop f USING (workflow_id) LEFT JOIN driver d USING (workflow_id)
  WHERE w.status<>'complete'),
analysis AS (SELECT led.*, origin, category, action, (phase='p5' AND code IN ('ROW_ABSENT','VALUE_MISMATCH')) OR phase='p2b' AS alt FROM led LEFT JOIN meaning USING (code))
"""
ANALYSIS = DIAG + _MEANING


@query("failure_analysis", with_(ANALYSIS, """
SELECT workflow_id, phase, code AS lead_code, origin, CASE WHEN alt OR phase='p3' THEN 'medium' ELSE 'high' END AS confidence FROM analysis"""))
def failure_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosis(spark, sf_dir).analysis.select("workflow_id", "phase", "lead_code", "origin", "confidence")


@query("actionable_failure", with_(ANALYSIS, """
SELECT workflow_id, CASE WHEN alt THEN 'ambiguous' ELSE category END AS category, CASE WHEN status='inconsistent' OR bad_steps>0 THEN 'high' ELSE 'medium' END AS severity,
  CASE WHEN alt THEN 'manual_review' ELSE action END AS action FROM analysis"""))
def actionable_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosis(spark, sf_dir).analysis.select("workflow_id", "category", "severity", "action")


_FIND = """,
found AS (
  SELECT workflow_id, i AS ingest_index, NULL AS seq, CASE WHEN type='retrieval' AND status='empty' THEN 'RETRIEVAL_EMPTY' WHEN type='retrieval' AND status='error' THEN 'RETRIEVAL_ERROR'
    WHEN type='retrieval' AND hits=0 THEN 'RETRIEVAL_THIN_HITS' WHEN type='model_turn' AND status<>'completed' THEN 'MODEL_TURN_ABNORMAL' WHEN control_kind='interrupt' THEN 'CONTROL_INTERRUPT'
    WHEN control_kind IN ('branch','gate') AND decision='skipped' THEN 'BRANCH_OR_GATE_SKIPPED' WHEN type='tool_skipped' THEN 'TOOL_SKIPPED' END AS code FROM ix
  UNION ALL SELECT workflow_id, NULL, seq, CASE WHEN code='RETRY_OBSERVATIONS_DIVERGE' THEN code ELSE 'ACTION_INPUT_RESOLUTION_FAILED' END FROM steps
    WHERE code IN ('UNKNOWN_TOOL','KEY_VALUE_POINTER_MISSING','RETRY_OBSERVATIONS_DIVERGE')
  UNION ALL SELECT workflow_id, NULL, seq, 'LOGICAL_STEP_RETRIES' FROM steps WHERE repeat_count>1
  UNION ALL SELECT workflow_id, NULL, NULL, 'RUN_LEVEL_INGEST_ISSUES' FROM wfs WHERE malformed
  UNION ALL SELECT workflow_id, NULL, NULL, 'EVENT_SEQUENCE_IRREGULAR' FROM cap LEFT JOIN firstdrop USING (workflow_id) WHERE capture_irregular OR seq_after IS NOT NULL
  UNION ALL SELECT workflow_id, NULL, NULL, 'NO_RETRIEVAL_EVENTS' FROM ctx WHERE n_retrieval=0 AND first_tool_index IS NOT NULL
  UNION ALL SELECT workflow_id, NULL, NULL, 'MISSING_RUN_COMPLETED' FROM ctx WHERE NOT run_completed AND first_tool_index IS NOT NULL
  UNION ALL SELECT workflow_id, last_index, NULL, 'LAST_EVENT_MODEL_ABNORMAL' FROM ctx WHERE last_type='model_turn' AND last_status<>'completed')
"""


@query("path_findings", with_(DIAG, _FIND + "SELECT workflow_id, code, COALESCE(ingest_index, -1) AS ingest_index, COALESCE(seq, -1) AS seq FROM found WHERE code IS NOT NULL"))
def path_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosis(spark, sf_dir).findings.select("workflow_id", "code", F.coalesce("ingest_index", F.lit(-1)).alias("ingest_index"), F.coalesce("seq", F.lit(-1)).alias("seq"))


@query("path_summary", with_(DIAG, _FIND + """
SELECT workflow_id, COUNT(code) AS concerns, CASE WHEN COUNT(code)=0 THEN 'No execution-path concerns detected under current rules.'
  ELSE 'execution_path_concerns=' || COUNT(code) || '; codes=' || string_agg(DISTINCT code, ',' ORDER BY code) END AS summary
FROM (SELECT DISTINCT workflow_id FROM ix) LEFT JOIN (SELECT * FROM found WHERE code IS NOT NULL) USING (workflow_id) GROUP BY 1"""))
def path_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = diagnosis(spark, sf_dir)
    return D.path_summary(d.findings, d.context)


@query("classify_codes", with_(full(), """
SELECT COALESCE(code, '') AS code, COUNT(*) AS steps, CASE code WHEN 'UNKNOWN_TOOL' THEN 'bad_input' WHEN 'KEY_VALUE_POINTER_MISSING' THEN 'bad_input' WHEN 'MULTI_EFFECT_INCOMPLETE' THEN 'bad_input'
  WHEN 'RETRY_OBSERVATIONS_DIVERGE' THEN 'decision_error' WHEN 'ROW_SHAPE_MISMATCH' THEN 'downstream_execution_failure' WHEN 'MULTI_EFFECT_PARTIAL' THEN 'downstream_execution_failure'
  WHEN 'MULTI_EFFECT_ALL_FAILED' THEN 'downstream_execution_failure' ELSE 'state_inconsistency' END AS category FROM steps WHERE code IS NOT NULL GROUP BY 1, 3"""))
def classify_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from checks.core import claimed

    steps = claimed(spark, sf_dir).steps.filter("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias("steps"))
    return steps.join(D.reason_catalog(spark).select("code", "category"), "code", "left").select("code", "steps", "category")
