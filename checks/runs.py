"""Queries over saved results, corpus rules, explanations and streaming forms (batch twins and replays)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.base import query, table
from checks.comparison import SAVED, steps
from checks.diagnosis import ANALYSIS, diagnosis
from checks.core import claimed
from checks.kpi import FUNNEL, _RES, funnel
from checks.sqltext import ROLLED, with_
from claimlake.functions.phrases import PHRASES
from claimlake.plans.verify import Verification
from claimlake.session import shared_dir
from claimlake.sources import corpus as K
from claimlake.sources import saved as V
from claimlake.streaming import streams as Z
from claimlake.streaming.reservations import reservation_expiry as reservation_expiry_stream


# Each run saved by a tool of some version. A seventh of the reports were changed afterwards, and of some steps the events are lost, which older versions need.
_VERSION = "CAST(n%13+4 AS INTEGER)"


@query("normalize_saved_results", SAVED + f""", r AS (SELECT workflow_id, run_index, CAST(substr(workflow_id, 4) AS BIGINT) + run_index AS n, COUNT(*) AS n_steps, BOOL_OR(status='incomplete_verification') AS open_, BOOL_OR(status IN ('missing','inconsistent','partially_verified')) AS bad,
  BOOL_OR(seq%97=0) AS lost, string_agg(seq || ':' || CASE status WHEN 'verified' THEN 'VERIFIED' WHEN 'missing' THEN 'FAILED_ROW_MISSING' WHEN 'inconsistent' THEN 'FAILED_VALUE_MISMATCH' WHEN 'partially_verified' THEN 'PARTIALLY_VERIFIED' ELSE 'INCOMPLETE_CANNOT_VERIFY' END
    || ':' || CASE WHEN status='incomplete_verification' THEN 'null' WHEN status='partially_verified' THEN 'sql_effects count=2 a:orders identity=[' || substr(lkey, 16) || ']; b:orders identity=[' || substr(lkey, 16) || ']' ELSE 'table=orders identity=[' || substr(lkey, 16) || '] required_fields=[o_orderstatus, o_totalprice]' END
    || ':' || CASE status WHEN 'verified' THEN 'rowCount=1' WHEN 'missing' THEN 'rowCount=0' WHEN 'inconsistent' THEN 'rowCount=1 field=o_orderstatus expected="X" actual="O"' WHEN 'partially_verified' THEN 'multi_effect effect_rows=2' ELSE 'No SQL verification request (registry resolution or unknown tool).' END
    || ':' || CASE status WHEN 'verified' THEN '' WHEN 'incomplete_verification' THEN 'verification_setup' ELSE 'workflow_execution' END || ':{{"k":' || seq || '}}', ';' ORDER BY seq) AS told FROM s GROUP BY 1, 2),
v AS (SELECT *, {_VERSION} AS ver, CASE WHEN open_ THEN 'incomplete' WHEN bad THEN 'inconsistent' ELSE 'complete' END AS status FROM r),
p AS (SELECT *, CASE WHEN ver=4 OR ver=16 THEN 'RESULT_VERSION_UNSUPPORTED' WHEN ver=9 AND n%2=0 THEN 'RUN_LEVEL_CODES_INCONSISTENT' WHEN ver<11 AND lost THEN 'RESULT_PARAMS_MISSING' WHEN ver>5 AND n%7=3 THEN 'COMPARE_WORKFLOW_TRUTH_MISMATCH' ELSE '' END AS problem FROM v)
SELECT workflow_id || '/' || run_index AS run_id, ver AS saved_version, status, n_steps, problem,
  CASE WHEN problem NOT IN ('', 'COMPARE_WORKFLOW_TRUTH_MISMATCH') THEN '' WHEN status='complete' THEN 'TRUSTED: Every step matched the database under the configured verification rules.'
    WHEN status='incomplete' THEN 'NOT TRUSTED: Verification is incomplete; the workflow cannot be fully confirmed.' ELSE 'NOT TRUSTED: At least one step failed verification against the database (determinate failure).' END AS trust,
  CASE WHEN problem IN ('', 'COMPARE_WORKFLOW_TRUTH_MISMATCH') THEN told ELSE '' END AS steps FROM p""")
def normalize_saved_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs as files of their version hold them, brought to the current shape; the steps are read off the recomputed report."""
    rows = steps(spark, sf_dir)
    run_id = F.concat_ws("/", "workflow_id", F.col("run_index").cast("string")).alias("run_id")
    loaded = V.normalize_saved_results(_saved_files(rows), rows.filter("seq % 97 <> 0").select(run_id, "seq", F.format_string('{"k":%d}', F.col("seq")).alias("params")))
    told = F.from_json(F.get_json_object("report", "$.steps"), "array<struct<seq:bigint,outcomeLabel:string,verifyTarget:string,observedStateSummary:string,failureCategory:string,observedExecution:struct<paramsCanonical:string>>>")
    text = F.array_join(F.transform(told, lambda s: F.concat_ws(":", s["seq"].cast("string"), s["outcomeLabel"], F.coalesce(s["verifyTarget"], F.lit("null")), s["observedStateSummary"], F.coalesce(s["failureCategory"], F.lit("")), s["observedExecution"]["paramsCanonical"])), ";")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return loaded.select("run_id", "saved_version", "status", F.size("steps").cast("bigint").alias("n_steps"), blank(F.col("problem")).alias("problem"), blank(F.get_json_object("report", "$.trustSummary")).alias("trust"), blank(text).alias("steps"))


def _saved_files(rows: DataFrame) -> DataFrame:
    """(run_id, payload): the results of all runs in the shapes that tools of different versions saved, written by Spark's own JSON writer."""
    n = F.substring("workflow_id", 4, 20).cast("bigint") + F.col("run_index")
    version = (n % 13 + 4).cast("int")
    json = lambda **of: F.struct(*[v.alias(k) for k, v in of.items()])
    say = F.lit
    partial, unasked = F.col("status") == "partially_verified", F.col("status") == "incomplete_verification"
    key = F.regexp_extract("logical_step_key", "=(.*)$", 1)
    identity = F.array(json(column=say("o_orderkey"), value=key))
    request = json(kind=F.when(partial, "sql_effects").otherwise("sql_row"), table=F.when(~partial, "orders"), identityEq=F.when(~partial, identity),
                   requiredFields=F.when(~partial, json(o_totalprice=say(1), o_orderstatus=say("X"))), effects=F.when(partial, F.array(*[json(id=say(i), table=say("orders"), identityEq=identity) for i in "ba"])))
    reasons = F.when(F.col("code").isNull(), F.array().cast("array<struct<code:string,message:string>>")).otherwise(F.array(json(code=F.col("code"), message=say("why"))))
    parts = F.transform("effects", lambda e: json(id=e["id"], status=e["status"], reasons=F.when(e["code"].isNull(), F.array().cast("array<struct<code:string,message:string>>")).otherwise(F.array(json(code=e["code"], message=say("why"))))))
    label = F.create_map(*[F.lit(x) for x in ("verified", "VERIFIED", "missing", "FAILED_ROW_MISSING", "inconsistent", "FAILED_VALUE_MISMATCH", "partially_verified", "PARTIALLY_VERIFIED", "incomplete_verification", "INCOMPLETE_CANNOT_VERIFY")])
    wrong = F.col("status") == "inconsistent"
    evidence = json(rowCount=F.when(~partial & ~unasked, F.when(F.col("status") == "missing", 0).otherwise(1)), field=F.when(wrong, "o_orderstatus"), expected=F.when(wrong, '"X"'), actual=F.when(wrong, '"O"'), effects=parts)
    old = version < 11
    effect, params = F.concat(F.lit("Do  "), F.col("seq").cast("string")), json(paramsCanonical=F.format_string('{"k":%d}', F.col("seq")))
    flat = F.concat(F.lit("Do "), F.col("seq").cast("string"))
    target = F.when(unasked, None).when(partial, F.concat(F.lit("sql_effects count=2 a:orders identity=[o_orderkey="), key, F.lit("]; b:orders identity=[o_orderkey="), key, F.lit("]"))).otherwise(
        F.concat(F.lit("table=orders identity=[o_orderkey="), key, F.lit("] required_fields=[o_orderstatus, o_totalprice]")))
    seen = (F.when(unasked, "No SQL verification request (registry resolution or unknown tool).").when(partial, "multi_effect effect_rows=2").when(wrong, 'rowCount=1 field=o_orderstatus expected="X" actual="O"')
            .when(F.col("status") == "missing", "rowCount=0").otherwise("rowCount=1"))
    engine = F.to_json(json(
        seq=F.col("seq"), toolId=F.col("tool_id"), status=F.col("status"), reasons=reasons, verificationRequest=F.when(~unasked, request), evidenceSummary=evidence, repeatObservationCount=say(1), evaluatedObservationOrdinal=say(1),
        observedExecution=F.when(~old, params)))
    shown = F.to_json(json(
        outcomeLabel=label[F.col("status")], seq=F.col("seq"), toolId=F.col("tool_id"), reasons=reasons, observations=json(repeatCount=say(1), evaluatedOrdinal=say(1)), verifyTarget=target, observedStateSummary=F.when(version == 15, seen),
        observedExecution=F.when(~old, params), failureCategory=F.when(unasked, "verification_setup").when(F.col("status") != "verified", "workflow_execution"),
        effects=F.transform(parts, lambda e: json(id=e["id"], reasons=e["reasons"], outcomeLabel=label[e["status"]]))))
    add = lambda text, member: F.concat(text.substr(F.lit(1), F.length(text) - 1), member, F.lit("}"))
    named = lambda text: F.when(old, F.concat(F.lit(',"intendedEffect":"'), text, F.lit('"'))).otherwise(F.concat(F.lit(',"intendedEffect":{"narrative":"'), text, F.lit('"}')))
    lines = rows.select("workflow_id", "run_index", "seq", "status", add(engine, named(effect)).alias("engine"), add(shown, F.concat(named(flat), F.when(unasked, ',"verifyTarget":null').otherwise(""))).alias("shown"))
    runs = lines.groupBy("workflow_id", "run_index").agg(
        F.array_sort(F.collect_list(F.struct("seq", "engine", "shown"))).alias("s"), F.bool_or(F.col("status") == "incomplete_verification").alias("open"), F.bool_or(F.col("status").isin("missing", "inconsistent", "partially_verified")).alias("bad"))
    status = F.when(F.col("open"), "incomplete").when(F.col("bad"), "inconsistent").otherwise("complete")
    trust = (F.when(n % 7 == 3, "TRUSTED").when(status == "complete", "TRUSTED: Every step matched the database under the configured verification rules.")
             .when(status == "incomplete", "NOT TRUSTED: Verification is incomplete; the workflow cannot be fully confirmed.").otherwise("NOT TRUSTED: At least one step failed verification against the database (determinate failure)."))
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.col(f"s.{c}"), ", "), F.lit("]"))
    told = F.when(status == "complete", "null").otherwise('{"a":1}')
    report = F.concat(
        F.lit('{"steps":'), listed("shown"), F.lit(',"workflowId":"'), F.col("workflow_id"), F.lit('","workflowStatus":"'), status, F.lit('","trustSummary":"'), trust, F.lit('","runLevelIssues":[],"eventSequence":{"kind":"normal"},"failureAnalysis":'), told,
        F.lit(',"executionPathFindings":[],"executionPathSummary":"Full upstream execution-path visibility requires schemaVersion 2 run events (retrieval, model_turn, control, tool_skipped) with run graph fields."'),
        F.when(version == 15, F.concat(F.lit(',"failureExplanation":'), told, F.lit(',"correctnessDefinition":'), told)).otherwise(""), F.lit(',"schemaVersion":'), F.when(old, "4").when(version < 15, "6").otherwise("9"), F.lit("}"))
    payload = F.concat(
        F.format_string('{"schemaVersion":%d,"workflowId":"%s","status":"%s","runLevelReasons":[],"eventSequenceIntegrity":{"kind":"normal"},"steps":', version, F.col("workflow_id"), status), listed("engine"),
        F.when(version == 9, F.when(n % 2 == 0, ',"runLevelCodes":["B"]').otherwise(',"runLevelCodes":[]')).otherwise(""), F.when(version >= 8, ',"verificationRunContext":{"maxWireSchemaVersion":1}').otherwise(""),
        F.when(version > 5, F.concat(F.lit(',"workflowTruthReport":'), report)).otherwise(""), F.lit("}"))
    return runs.select(F.concat_ws("/", "workflow_id", F.col("run_index").cast("string")).alias("run_id"), payload.alias("payload"))


@query("artifact_integrity", """SELECT 'run_' || doc_id AS run_id, CASE WHEN doc_id%5=0 THEN 'ARTIFACT_LENGTH_MISMATCH' WHEN doc_id%3=0 THEN 'ARTIFACT_INTEGRITY_MISMATCH' ELSE '' END AS code FROM documents""")
def artifact_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"), F.concat(F.lit("run_"), "doc_id").alias("run_id"))
    d = F.col("doc_id")
    manifest = F.format_string(
        '{"artifacts":{"events":{"relativePath":"events.ndjson","sha256":"%s","byteLength":%d}}}',
        F.when(d % 3 == 0, F.repeat(F.lit("0"), F.lit(64))).otherwise(F.sha2("content", 256)), F.length("content") + F.when(d % 5 == 0, 1).otherwise(0))
    files = docs.select("run_id", F.lit("events.ndjson").alias("name"), "content").unionByName(
        docs.select("run_id", F.lit(K.MANIFEST).alias("name"), F.encode(manifest, "UTF-8").alias("content")))
    return K.artifact_integrity(files).select("run_id", F.coalesce("code", F.lit("")).alias("code"))


@query("load_corpus", """SELECT 'run_' || doc_id AS run_id, CASE doc_id%6 WHEN 0 THEN 'MISSING_AGENT_RUN' WHEN 1 THEN 'AGENT_RUN_JSON_SYNTAX' WHEN 2 THEN 'MISSING_EVENTS' WHEN 3 THEN 'RUN_ID_MISMATCH' WHEN 4 THEN 'WORKFLOW_RESULT_WORKFLOW_ID_MISMATCH' ELSE '' END AS code FROM documents""")
def load_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("events"), F.concat(F.lit("run_"), "doc_id").alias("run_id"))
    result = F.encode(F.format_string('{"workflowId":"wf_%d","status":"complete"}', F.when(d % 6 == 4, d + 1).otherwise(d)), "UTF-8")
    entry = lambda name, c: F.format_string('"%s":{"relativePath":"%s","sha256":"%s","byteLength":%d}', F.lit(name), F.lit(name), F.sha2(c, 256), F.length(c))
    manifest = F.when(d % 6 == 1, "{oops").otherwise(F.concat(
        F.format_string('{"runId":"run_%d","workflowId":"wf_%d","artifacts":{', F.when(d % 6 == 3, d + 1).otherwise(d), d),
        entry("workflow-result.json", result), F.lit(","), entry("events.ndjson", F.col("events")), F.lit("}}")))
    file = lambda name, c, keep: docs.filter(keep).select("run_id", F.lit(name).alias("name"), c.alias("content"), F.lit("2024-01-01").cast("timestamp").alias("modified_at"))
    files = file(K.MANIFEST, F.encode(manifest, "UTF-8"), d % 6 != 0).unionByName(file("workflow-result.json", result, d % 6 >= 0)).unionByName(file("events.ndjson", F.col("events"), d % 6 != 2))
    return K.load_corpus(files).select("run_id", F.coalesce("code", F.lit("")).alias("code"))


# A run for each document, saved and read back. Of ten, one loses its manifest, one its events, one has other events than its manifest says.
@query("saved_runs", """SELECT 'run_' || doc_id AS run_id, CASE doc_id%10 WHEN 3 THEN 'MISSING_AGENT_RUN' WHEN 5 THEN 'MISSING_EVENTS' WHEN 7 THEN CASE WHEN coalesce(text, '')='' THEN 'ARTIFACT_LENGTH_MISMATCH' ELSE 'ARTIFACT_INTEGRITY_MISMATCH' END ELSE '' END AS code,
  CASE WHEN doc_id%10<>3 THEN 'wf_' || doc_id%7 END AS workflow_id, CASE WHEN doc_id%10 NOT IN (3, 5, 7) THEN 'complete' END AS status FROM documents""")
def saved_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    root = f"{shared_dir(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    d = F.col("doc_id")
    runs = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("run_"), d).alias("run_id"), F.concat(F.lit("wf_"), d % 7).alias("workflow_id"), F.lit("c").alias("customer_id"), F.lit("2024-01-01").cast("timestamp").alias("captured_at"),
        F.format_string('{"workflowId":"wf_%d","status":"complete"}', d % 7).alias("result"), F.col("text").alias("events"))
    whole, cut = runs.filter(~(d % 10).isin(3, 5)), runs.filter((d % 10).isin(3, 5))
    K.save_runs(whole, root)
    # what broken jobs and hands leave: artifacts without a manifest, a manifest without its events, events of the same length that were changed
    K.write_files(cut.select("run_id", F.lit(K.ARTIFACTS[0]).alias("name"), F.encode("result", "UTF-8").alias("content")), root)
    K.write_files(cut.filter(d % 10 == 5).select("run_id", F.lit(K.MANIFEST).alias("name"), F.encode(F.format_string(
        '{"runId":"run_%d","workflowId":"wf_%d","artifacts":{"w":{"relativePath":"%s","sha256":"%s","byteLength":%d}}}', d, d % 7, F.lit(K.ARTIFACTS[0]), F.sha2(F.encode("result", "UTF-8"), 256), F.length("result")), "UTF-8").alias("content")), root)
    changed = F.rpad(F.lit("~"), F.greatest(F.lit(1), F.coalesce(F.octet_length("events"), F.lit(0))), "~")
    K.write_files(runs.filter(d % 10 == 7).select("run_id", F.lit(K.ARTIFACTS[1]).alias("name"), F.encode(changed, "UTF-8").alias("content")), root)
    loaded = K.load_corpus(K.read_corpus(spark, root))
    return loaded.select("run_id", F.coalesce("code", F.lit("")).alias("code"), "workflow_id", F.get_json_object("result", "$.status").alias("status"))


_POLICY = "consistencyMode=strong; verificationWindowMs=0; pollIntervalMs=0"
_SUMMARY = """CASE phase WHEN 'p0' THEN 'Run-level ingest or planning issue (MALFORMED_EVENT_LINE); origin: inputs.'
  WHEN 'p1' THEN 'A retrieval step failed before the failing tool observation (kb); origin: retrieval.'
  WHEN 'p2' THEN 'A model or control event indicates the run did not complete normally before the failing tool observation; origin: decision_making.'
  WHEN 'p2b' THEN 'A branch or gate was skipped before the failing tool observation; decision-making may explain downstream behavior (see alternatives).'
  WHEN 'p3' THEN 'A tool was skipped before the failing tool observation; origin: tool_use.' WHEN 'p4' THEN 'Event capture order or timestamps were irregular (' || code || '); origin: workflow_flow.'
  ELSE 'Primary failure at seq ' || driver_seq || ' tool ' || driver_tool_id || ' (code ' || code || '); origin: ' || origin || '.' ||
    CASE WHEN step_code LIKE 'MULTI_EFFECT%' THEN ' Multi-effect verification: authoritative per-effect outcomes are under workflowTruthReport.steps[].effects.' ELSE '' END END"""

# What each failing workflow's worst step was to do and did, then the texts of its scope. The phrases are the fixed values of claimlake.functions.phrases.
_EXPLAIN = f""",
phrase(pcode, meaning) AS (VALUES {", ".join("('" + c + "', '" + p.replace("'", "''") + "')" for c, p in PHRASES.items())}),
eid AS (SELECT workflow_id, seq, MIN(check_id) AS eid FROM checks WHERE status<>'verified' GROUP BY 1, 2),
told AS (SELECT a.workflow_id, a.step_code, s.tool_id, a.code, s.rec, s.c, s.k, s.st, s.price, s.fault, s.line_claimed, s.name_claimed, e.eid, ch.matched, ch.measured, ch.field, fo.st AS seen, fo.price AS seen_price, fc.name AS seen_name,
    CASE s.fault WHEN 'shape' THEN 'o_ghost' ELSE 'o_orderstatus' END AS status_field, CASE s.fault WHEN 'mismatch' THEN 'X' ELSE s.st END AS status_claimed,
    CASE WHEN a.step_code LIKE 'MULTI_EFFECT%' THEN e.eid END AS effect_id, s.pre IS NULL AND a.step_code<>'KEY_VALUE_POINTER_MISSING' AS resolved,
    'table=orders o_orderkey=' || s.rec AS row_key, CASE s.tool_id WHEN 'orders.audit' THEN 'effects[order_row].' WHEN 'orders.link' THEN 'checks[a_lines].' ELSE '' END AS place
  FROM analysis a JOIN step s ON s.workflow_id=a.workflow_id AND s.seq=a.driver_seq LEFT JOIN eid e ON e.workflow_id=a.workflow_id AND e.seq=a.driver_seq
    LEFT JOIN checks ch ON ch.workflow_id=e.workflow_id AND ch.seq=e.seq AND ch.check_id=e.eid LEFT JOIN fo ON fo.id=s.rec LEFT JOIN fc ON fc.id=s.c WHERE a.phase='p5'),
number AS (SELECT *, regexp_replace(CAST(CAST(price AS DOUBLE) AS VARCHAR), '\\.0$', '') AS price_text, regexp_replace(CAST(seen_price AS VARCHAR), '\\.?0+$', '') AS seen_price_text, regexp_replace(CAST(measured AS VARCHAR), '\\.0$', '') AS measured_text FROM told),
detailed AS (SELECT workflow_id, effect_id,
    CASE WHEN NOT resolved THEN 'null' WHEN tool_id='orders.upsert' THEN 'table=orders identity=[o_orderkey=' || rec || '] required_fields=[' || status_field || ', o_totalprice]'
      WHEN tool_id='orders.purge' THEN 'sql_row_absent table=lineitem identity=[l_orderkey=' || rec || '] filter=[l_linenumber=' || line_claimed || ']'
      WHEN tool_id='orders.audit' THEN 'sql_effects count=2 customer_row:customer identity=[c_custkey=' || c || ']; order_row:orders identity=[o_orderkey=' || rec || ']'
      ELSE 'sql_relational count=5 a_lines:related_exists; b_count:aggregate; c_sum:aggregate; d_join:join_count; e_orphans:anti_join' END AS target,
    CASE tool_id WHEN 'ghost.tool' THEN 'Unknown tool: ghost.tool' WHEN 'orders.upsert' THEN 'Upsert order ' || COALESCE('"' || rec || '"', 'MISSING') || ' with {{"' || status_field || '":"' || status_claimed || '","o_totalprice":' || price_text || '}}'
      WHEN 'orders.audit' THEN 'Audit order ' || COALESCE('"' || rec || '"', 'MISSING') WHEN 'orders.purge' THEN 'Purge line ' || line_claimed || ' of ' || COALESCE('"' || rec || '"', 'MISSING') ELSE 'Link ' || COALESCE('"' || rec || '"', 'MISSING') END AS narrative,
    CASE code WHEN 'UNKNOWN_TOOL' THEN 'Unknown toolId: ghost.tool' WHEN 'RETRY_OBSERVATIONS_DIVERGE' THEN 'Multiple observations for this seq do not all match the last observation (toolId and canonical params).'
      WHEN 'KEY_VALUE_POINTER_MISSING' THEN place || 'identityEq[0]. key.value missing at /recordId' WHEN 'ROW_ABSENT' THEN 'No row matched key (' || row_key || ')' WHEN 'DUPLICATE_ROWS' THEN 'More than one row matched key (' || row_key || ')'
      WHEN 'ROW_SHAPE_MISMATCH' THEN 'Column not in row: o_ghost (' || row_key || ')' WHEN 'ROW_PRESENT_WHEN_FORBIDDEN' THEN 'Row present when forbidden (table=lineitem identity=[l_orderkey=' || rec || '] filter=[l_linenumber=' || line_claimed || ']); matched ' || matched
      WHEN 'VALUE_MISMATCH' THEN 'Expected ' || CASE field WHEN 'c_name' THEN '"' || name_claimed || '" but found "' || seen_name || '" for field c_name (table=customer c_custkey=' || c
          WHEN 'o_orderstatus' THEN '"' || status_claimed || '" but found "' || seen || '" for field o_orderstatus (' || row_key ELSE price_text || ' but found ' || seen_price_text || ' for field o_totalprice (' || row_key END || ')'
      WHEN 'RELATED_ROWS_ABSENT' THEN 'Relational check a_lines: related row does not exist' WHEN 'ORPHAN_ROW_DETECTED' THEN 'Relational check e_orphans: ' || matched || ' orphan row(s)'
      ELSE 'Relational check ' || eid || ': expected ' || CASE eid WHEN 'b_count' THEN 'gte ' || k%4 WHEN 'c_sum' THEN 'lte 150' ELSE 'gte 2' END || ' but actual ' || measured_text END AS message,
    CASE WHEN tool_id='orders.upsert' AND code='VALUE_MISMATCH' THEN field END AS seen_field, CASE WHEN tool_id='orders.upsert' AND code='VALUE_MISMATCH' THEN CASE field WHEN 'o_orderstatus' THEN '"' || status_claimed || '"' ELSE price_text END END AS seen_expected,
    CASE WHEN tool_id='orders.upsert' AND code='VALUE_MISMATCH' THEN CASE field WHEN 'o_orderstatus' THEN '"' || seen || '"' ELSE seen_price_text END END AS seen_actual,
    CASE WHEN tool_id='orders.upsert' AND resolved THEN CASE code WHEN 'ROW_ABSENT' THEN '0' WHEN 'DUPLICATE_ROWS' THEN '2' ELSE '1' END END AS seen_rows FROM number),
lined AS (SELECT a.*, d.* EXCLUDE (workflow_id), p.meaning, f.seq_before, f.seq_after, cap.capture_irregular, {_SUMMARY} AS summary,
    CASE phase WHEN 'p0' THEN 'run_level' WHEN 'p4' THEN 'event_sequence' WHEN 'p5' THEN 'step' ELSE 'run_context' END AS scope,
    CASE WHEN phase='p0' THEN 'MALFORMED_EVENT_LINE' WHEN phase='p4' THEN concat_ws(',', CASE WHEN cap.capture_irregular THEN 'CAPTURE_ORDER_NOT_MONOTONIC_IN_SEQ' END, CASE WHEN f.seq_after IS NOT NULL THEN 'TIMESTAMP_NOT_MONOTONIC_WITH_SEQ_SORT_ORDER' END) ELSE a.code END AS codes,
    CASE WHEN alt OR phase='p3' THEN 'medium' ELSE 'high' END AS confidence,
    CASE WHEN status='inconsistent' THEN 'NOT TRUSTED: At least one step failed verification against the database (determinate failure).' ELSE 'NOT TRUSTED: Verification is incomplete; the workflow cannot be fully confirmed.' END
      || CASE WHEN cap.capture_irregular OR f.seq_after IS NOT NULL THEN ' Event capture or timestamps were irregular; verification used seq-sorted order. See event_sequence below.' ELSE '' END AS trust,
    CASE WHEN a.code='RETRIEVAL_ERROR' THEN 'source=kb status=error' WHEN a.code LIKE 'MODEL_TURN%' THEN 'status=' || lower(substr(a.code, 12)) WHEN a.code='CONTROL_INTERRUPT' THEN 'controlKind=interrupt'
      WHEN a.code='CONTROL_BRANCH_SKIPPED' THEN 'controlKind=branch decision=skipped' WHEN a.code='CONTROL_GATE_SKIPPED' THEN 'controlKind=gate decision=skipped' ELSE 'toolId=orders.upsert' END AS upstream
  FROM analysis a LEFT JOIN detailed d ON d.workflow_id=a.workflow_id LEFT JOIN phrase p ON p.pcode=a.code LEFT JOIN firstdrop f ON f.workflow_id=a.workflow_id LEFT JOIN cap ON cap.workflow_id=a.workflow_id)
SELECT workflow_id, summary,
  CASE scope WHEN 'run_level' THEN 'Verification expected a valid captured run for workflowId=' || workflow_id || ' under policy [{_POLICY}] with no run-level ingest or planning failures.'
    WHEN 'event_sequence' THEN 'Verification expected monotonic, well-formed event capture for workflowId=' || workflow_id || ' under policy [{_POLICY}].'
    WHEN 'run_context' THEN 'Verification expected upstream run context through ingest_index=' || cause_index || ' to allow fair evaluation of the failing tool observation under policy [{_POLICY}].'
    ELSE 'Verification expected post-execution database state to satisfy verify_target "' || target || '" and intended_effect "' || narrative || '" for seq=' || driver_seq || ' toolId=' || driver_tool_id || ' under policy [{_POLICY}].' END AS expected,
  CASE scope WHEN 'run_level' THEN 'Run-level failure: code=' || code || ' detail=' || meaning || '.'
    WHEN 'event_sequence' THEN 'Event-sequence irregularity: code=' || code || ' detail=' || CASE WHEN capture_irregular THEN meaning ELSE 'In seq-sorted order, timestamp decreased between seq ' || seq_before || ' and seq ' || seq_after || '.' END || '.'
    WHEN 'run_context' THEN 'Run-context signal before the failing observation: code=' || code || ' ' || upstream || '.'
    ELSE 'Step verification outcome: code=' || code || ' detail=' || message || COALESCE('; field=' || seen_field, '') || COALESCE('; expected=' || seen_expected, '') || COALESCE('; actual=' || seen_actual, '') || COALESCE('; rowCount=' || seen_rows, '') END AS observed,
  CASE scope WHEN 'run_context' THEN 'Divergence at run_context before the failing tool observation: code=' || code WHEN 'step' THEN 'Divergence at step seq=' || driver_seq || ' toolId=' || driver_tool_id || ': primary_code=' || code
    ELSE 'Divergence at ' || scope || ': code=' || code END || ' meaning=' || meaning AS divergence,
  concat_ws('; ', 'trust_summary=' || trust, 'workflow_status=' || status, 'verification_policy={_POLICY}', 'primary_origin=' || origin, 'classification_confidence=' || confidence, 'failure_analysis_summary=' || summary, 'primary_scope=' || scope, 'primary_codes=' || codes,
    CASE WHEN scope='run_context' THEN 'primary_ingest_index=' || cause_index END, CASE WHEN phase='p3' THEN 'primary_tool_id=orders.upsert' WHEN scope='step' THEN 'primary_tool_id=' || driver_tool_id END, CASE WHEN phase='p1' THEN 'primary_source=kb' END,
    CASE WHEN phase IN ('p1','p2','p2b') THEN 'primary_run_event_id=' || cause_event END, CASE WHEN scope='step' THEN 'primary_seq=' || driver_seq END, 'primary_effect_id=' || effect_id, 'verify_target=' || target, 'intended_effect_narrative=' || narrative,
    'evidence_summary_field=' || seen_field, 'evidence_summary_expected=' || seen_expected, 'evidence_summary_actual=' || seen_actual, 'evidence_summary_row_count=' || seen_rows) AS known_facts,
  concat_ws('; ', CASE WHEN confidence='medium' THEN 'classification_confidence_band=medium' END, CASE WHEN phase='p2b' THEN 'competing_hypothesis=origin=workflow_flow' WHEN phase='p5' AND code='ROW_ABSENT' THEN 'competing_hypothesis=origin=downstream_system_state; competing_hypothesis=origin=tool_use'
    WHEN phase='p5' AND code='VALUE_MISMATCH' THEN 'competing_hypothesis=origin=downstream_system_state; competing_hypothesis=origin=inputs' END) AS unknowns FROM lined"""


@query("failure_explanation", with_(ANALYSIS, _EXPLAIN))
def failure_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts and unknowns as text; of a competing hypothesis its origin, the rationale being a fixed value of that origin."""
    from claimlake.plans.explain import failure_explanations

    flat = lambda c, value: F.array_join(F.transform(c, lambda x: F.concat(x["id"], F.lit("="), value(x["value"]))), "; ")
    fact = lambda facts, name: F.filter(facts, lambda x: x["id"] == name)[0]["value"]
    return failure_explanations(diagnosis(spark, sf_dir)).select(
        "workflow_id", fact(F.col("known_facts"), "failure_analysis_summary").alias("summary"), "expected", "observed", "divergence", flat("known_facts", lambda v: v).alias("known_facts"),
        flat("unknowns", lambda v: F.split_part(v, F.lit("|rationale="), F.lit(1))).alias("unknowns"))


# The machine's form of each rule: JSON with keys in order. A step brings what it asks of the tables, unless its check did not resolve.
_KEY = """'[{{"column":"{column}","value":"' || {value} || '"}}]'"""
_ORDER, _LINE, _CUST = (_KEY.format(column=c, value=v) for c, v in (("o_orderkey", "q.rec"), ("l_orderkey", "q.rec"), ("c_custkey", "q.c")))
_WANTED = """'{"' || CASE q.fault WHEN 'shape' THEN 'o_ghost' ELSE 'o_orderstatus' END || '":"' || CASE q.fault WHEN 'mismatch' THEN 'X' ELSE q.st END || '","o_totalprice":' || regexp_replace(CAST(CAST(q.price AS DOUBLE) AS VARCHAR), '\\.0$', '') || '}'"""
_REQUEST = f"""CASE WHEN q.pre IS NOT NULL OR step_code='KEY_VALUE_POINTER_MISSING' THEN 'null'
  WHEN q.tool_id='orders.upsert' THEN '{{"identityEq":' || {_ORDER} || ',"kind":"sql_row","requiredFields":' || {_WANTED} || ',"table":"orders"}}'
  WHEN q.tool_id='orders.purge' THEN '{{"filterEq":[{{"column":"l_linenumber","value":"' || q.line_claimed || '"}}],"identityEq":' || {_LINE} || ',"kind":"sql_row_absent","table":"lineitem"}}'
  WHEN q.tool_id='orders.audit' THEN '{{"effects":[{{"id":"order_row","identityEq":' || {_ORDER} || ',"kind":"sql_row","requiredFields":' || {_WANTED} || ',"table":"orders"}},{{"id":"customer_row","identityEq":' || {_CUST} || ',"kind":"sql_row","requiredFields":{{"c_name":"' || q.name_claimed || '"}},"table":"customer"}}],"kind":"sql_effects"}}'
  ELSE '{{"checks":[{{"checkKind":"related_exists","childTable":"lineitem","id":"a_lines","matchEq":' || {_LINE} || '}},{{"checkKind":"aggregate","expectOp":"gte","expectValue":' || q.k%4 || ',"fn":"COUNT_STAR","id":"b_count","table":"lineitem","whereEq":' || {_LINE}
    || '}},{{"checkKind":"aggregate","expectOp":"lte","expectValue":150,"fn":"SUM","id":"c_sum","sumColumn":"l_quantity","table":"lineitem","whereEq":' || {_LINE}
    || '}},{{"checkKind":"join_count","expectOp":"gte","expectValue":2,"id":"d_join","leftJoinColumn":"o_orderkey","leftTable":"orders","rightJoinColumn":"l_orderkey","rightTable":"lineitem","whereEq":[{{"column":"o_orderkey","side":"left","value":"' || q.rec
    || '"}}]}},{{"anchorColumn":"o_orderkey","anchorTable":"orders","checkKind":"anti_join","filterEqAnchor":[{{"column":"o_custkey","value":"' || q.c || '"}}],"filterEqLookup":[],"id":"e_orphans","lookupColumn":"l_orderkey","lookupPresenceColumn":"l_orderkey","lookupTable":"lineitem"}}],"kind":"sql_relational"}}' END"""
_PROJECTION = f"""CASE phase WHEN 'p0' THEN '{{"ingestContractRequirement":"no_run_level_failures","primaryFailureCodes":["' || code || '"],"projectionKind":"run_ingest_integrity"'
  WHEN 'p4' THEN '{{"forbiddenEventSequenceCodes":["' || concat_ws('","', CASE WHEN capture_irregular THEN 'CAPTURE_ORDER_NOT_MONOTONIC_IN_SEQ' END, CASE WHEN f.seq_after IS NOT NULL THEN 'TIMESTAMP_NOT_MONOTONIC_WITH_SEQ_SORT_ORDER' END) || '"],"projectionKind":"event_capture_integrity"'
  WHEN 'p5' THEN '{{"projectionKind":"step_sql_expectation","seq":' || driver_seq || ',"toolId":"' || driver_tool_id || '"'
  ELSE '{{"ingestIndex":' || cause_index || ',"primaryRunContextCodes":["' || code || '"],"projectionKind":"run_context_fairness","requiredUpstreamContract":"' || CASE WHEN code='RETRIEVAL_ERROR' THEN 'retrieval_ok_before_observation' WHEN code LIKE 'MODEL_TURN%' THEN 'model_turn_completed_before_observation'
    WHEN code='CONTROL_INTERRUPT' THEN 'no_interrupt_before_observation' WHEN code='CONTROL_BRANCH_SKIPPED' THEN 'branch_not_skipped_before_observation' WHEN code='CONTROL_GATE_SKIPPED' THEN 'gate_not_skipped_before_observation' ELSE 'tool_not_skipped_before_observation' END || '"' END
  || ',"verificationPolicyFragment":"{_POLICY}"' || CASE phase WHEN 'p5' THEN ',"verificationRequest":' || {_REQUEST} ELSE '' END || ',"workflowId":"' || a.workflow_id || '"}}'"""


@query("correctness_definition", with_(ANALYSIS, f"""SELECT a.workflow_id, CASE phase WHEN 'p0' THEN 'run_ingest_integrity' WHEN 'p4' THEN 'event_capture_integrity' WHEN 'p5' THEN 'step_sql_expectation' ELSE 'run_context_fairness' END AS kind,
  CASE phase WHEN 'p0' THEN 'Must: ingest for workflowId=' || a.workflow_id || ' SHALL deliver a valid captured run under policy [{_POLICY}] with no blocking run-level failures (codes: ' || code || ').'
  WHEN 'p4' THEN 'Must: event capture for workflowId=' || a.workflow_id || ' SHALL preserve monotonic, well-formed ordering under policy [{_POLICY}] and SHALL NOT emit event-sequence fault codes '
    || concat_ws(',', CASE WHEN capture_irregular THEN 'CAPTURE_ORDER_NOT_MONOTONIC_IN_SEQ' END, CASE WHEN f.seq_after IS NOT NULL THEN 'TIMESTAMP_NOT_MONOTONIC_WITH_SEQ_SORT_ORDER' END) || '.'
  WHEN 'p5' THEN 'Must: after tool_observed seq=' || driver_seq || ' toolId=' || driver_tool_id || ', database state SHALL satisfy the verification contract in verificationRequest under policy [{_POLICY}] for workflowId=' || a.workflow_id || '.'
  ELSE 'Must: before evaluating the failing tool observation at ingest_index=' || cause_index || ', upstream run context SHALL satisfy contract ' || CASE WHEN code='RETRIEVAL_ERROR' THEN 'retrieval_ok_before_observation'
    WHEN code LIKE 'MODEL_TURN%' THEN 'model_turn_completed_before_observation' WHEN code='CONTROL_INTERRUPT' THEN 'no_interrupt_before_observation' WHEN code='CONTROL_BRANCH_SKIPPED' THEN 'branch_not_skipped_before_observation'
    WHEN code='CONTROL_GATE_SKIPPED' THEN 'gate_not_skipped_before_observation' ELSE 'tool_not_skipped_before_observation' END || ' under policy [{_POLICY}] for workflowId=' || a.workflow_id || ' (primary codes: ' || code || ').' END AS must_always_hold,
  CASE WHEN alt THEN 'manual_review' ELSE action END AS action,
  {_PROJECTION} AS projection
FROM analysis a LEFT JOIN cap USING (workflow_id) LEFT JOIN firstdrop f USING (workflow_id) LEFT JOIN step q ON q.workflow_id=a.workflow_id AND q.seq=a.driver_seq"""))
def correctness_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimlake.plans.correctness import diagnosed_rules

    return diagnosed_rules(diagnosis(spark, sf_dir)).select("workflow_id", "kind", "must_always_hold", "action", "projection")


# Every document becomes a plan. Each line of its text gives a citation named after the line's first word: even lines oblige, odd ones
# are only read, every fifth stands in a fenced block; the words of a line are its reason.
@query("plan_path_harvest", r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS n FROM documents),
w AS (SELECT doc_id, n, regexp_extract(line, '[a-z]{3,9}', 0) AS w FROM l)
SELECT DISTINCT doc_id, unnest(['src/' || w || '.ts', 'docs/' || w || n || '.md']) AS path FROM w WHERE w<>'' AND n%2=0 AND n%5<>4
UNION SELECT doc_id, 'test/t' || doc_id || '.mjs' FROM documents WHERE doc_id%3=0 UNION SELECT doc_id, 'schemas/todo' || doc_id || '.json' FROM documents""")
def plan_path_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimlake.plans.harvest import harvest_paths

    d = F.col("doc_id").cast("string")
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])

    def cited(line, n):
        word = F.regexp_extract(line, "[a-z]{3,9}", 0)
        plain = F.substr(F.regexp_replace(line, r"[^a-z ]+", ""), F.lit(1), F.lit(40))
        both = say("[it](./src/", word, ".TS) and `docs/", word, n.cast("string"), ".md`. ", F.translate(plain, "aeiou", ""))
        said = F.when(n % 2 == 0, say("Update ", both)).otherwise(say("Read ", both))
        return F.when(word == "", F.lit("nothing")).when(n % 5 == 4, say("```\n", said, "\n```")).otherwise(said)

    lines = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), cited), "\n")
    body = say(
        "---\ntitle: x\n---\n# ", d, "\n`src/before", d, ".ts` must change\n## Implementation notes\n", lines, "\n![no](src/image", d, ".ts) Update\n",
        "For example add `src/example", d, ".ts`\n## Testing\nmust pass `test/t", d, F.when(F.col("doc_id") % 3 == 0, ".mjs").otherwise(".exe"), "`\n",
        "Expect: add `src/expected", d, ".ts`\n## Background\nAdd `src/background", d, ".ts`\n")
    todos = F.array(say("create `schemas/todo", d, ".json`; similar to `schemas/old", d, ".json` update"))
    return harvest_paths(table(spark, sf_dir, "documents").select("doc_id", body.alias("text"), todos.alias("todos")))


# --- streams ---------------------------------------------------------------------------------------

def _timed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = funnel(spark, sf_dir).select("id", "event", F.concat(F.lit("u"), "user_id").alias("key"), F.col("created_at").cast("timestamp").alias("ts"))
    claims = rows.filter("event = 'verify_started'").select(F.col("id").alias("claim_id"), "key", F.col("ts").alias("claimed_at"))
    return claims, rows


# Presence of a user's row: it comes with each verify_outcome and goes `hold` hours later, every third one for good.
_EV = FUNNEL + """, c AS (SELECT id AS claim_id, 'u' || user_id AS key, created_at AS claimed_at FROM fe WHERE event='verify_started'),
h AS (SELECT 'u' || user_id AS key, created_at AS appeared, CASE WHEN id%3<>0 THEN created_at + to_hours(CAST(id%5 AS INTEGER) + 1) END AS removed, id%4<>0 AS matches FROM fe WHERE event='verify_outcome')
"""


def presence(rows: DataFrame) -> DataFrame:
    hold = F.make_dt_interval(hours=(F.col("id") % 5 + 1).cast("int"))
    return rows.filter("event = 'verify_outcome'").select(
        "key", F.col("ts").alias("appeared_at"), F.when(F.col("id") % 3 != 0, F.col("ts") + hold).alias("removed_at"), (F.col("id") % 4 != 0).alias("matches"))


@query("eventual_row", _EV + """, s AS (SELECT claim_id, c.key, min_by(matches, struct_pack(a := appeared, m := matches)) AS m, count(appeared) AS n FROM c LEFT JOIN h ON h.key=c.key AND appeared <= claimed_at + INTERVAL 1 HOUR
  AND COALESCE(removed, TIMESTAMP '9999-12-31') > claimed_at GROUP BY 1, 2)
SELECT claim_id, key, CASE WHEN n=0 THEN 'uncertain' WHEN m THEN 'verified' ELSE 'inconsistent' END AS status FROM s""")
def eventual_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, rows = _timed(spark, sf_dir)
    return Z.eventual_rows(claims, presence(rows), 3_600_000).select("claim_id", "key", "status")


# A time between claim and window end without a row: the claim itself, the window's end, or where a presence ends.
@query("eventual_absent", _EV + """, e AS (SELECT key, appeared, COALESCE(removed, TIMESTAMP '9999-12-31') AS gone FROM h),
t AS (SELECT claim_id, key, claimed_at, claimed_at AS at FROM c UNION ALL SELECT claim_id, key, claimed_at, claimed_at + INTERVAL 1 HOUR FROM c
  UNION ALL SELECT claim_id, c.key, claimed_at, gone FROM c JOIN e ON e.key=c.key AND gone > claimed_at AND gone <= claimed_at + INTERVAL 1 HOUR),
f AS (SELECT t.claim_id, t.key, t.at, count(e.key) AS n FROM t LEFT JOIN e ON e.key=t.key AND e.appeared <= t.at AND e.gone > t.at GROUP BY 1, 2, 3)
SELECT claim_id, key, CASE WHEN min(n)=0 THEN 'verified' ELSE 'uncertain' END AS status FROM f GROUP BY 1, 2""")
def eventual_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, rows = _timed(spark, sf_dir)
    return Z.eventual_absent(claims, presence(rows), 3_600_000).select("claim_id", "key", "status")


@query("eventual_multi", _EV + """, e AS (SELECT claim_id, user_id%7 AS a, claim_id%5 AS b FROM c JOIN fe ON fe.id=claim_id),
s AS (SELECT claim_id, unnest(['verified','verified','uncertain','inconsistent','uncertain','incomplete_verification','missing'][a+1:a+1] || ['verified','uncertain','inconsistent','uncertain','verified'][b+1:b+1]) AS st FROM e),
g AS (SELECT claim_id, count(*) AS n, count(*) FILTER (st='verified') AS ok, count(*) FILTER (st IN ('uncertain','missing')) AS open, count(*) FILTER (st='incomplete_verification') AS inc FROM s GROUP BY 1)
SELECT claim_id AS step_id, CASE WHEN inc>0 THEN 'incomplete_verification' WHEN ok=n THEN 'verified' WHEN open=n THEN 'uncertain' WHEN ok=0 THEN 'inconsistent' ELSE 'partially_verified' END AS status,
  CASE WHEN inc>0 THEN 'MULTI_EFFECT_INCOMPLETE' WHEN ok=n THEN '' WHEN open=n THEN 'MULTI_EFFECT_UNCERTAIN_WITHIN_WINDOW' WHEN ok=0 THEN 'MULTI_EFFECT_ALL_FAILED' ELSE 'MULTI_EFFECT_PARTIAL' END AS code FROM g""")
def eventual_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = funnel(spark, sf_dir).filter("event = 'verify_started'")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))
    first = pick(["verified", "verified", "uncertain", "inconsistent", "uncertain", "incomplete_verification", "missing"], F.col("user_id"))
    second = pick(["verified", "uncertain", "inconsistent", "uncertain", "verified"], F.col("id"))
    effects = rows.select(F.col("id").alias("step_id"), F.explode(F.array(first, second)).alias("status"))
    return Z.eventual_multi(effects).select("step_id", "status", F.coalesce("code", F.lit("")).alias("code"))


@query("eventual_stream", _EV + """, x AS (SELECT 'u' || user_id AS key, created_at AS t, event='verify_outcome' AS turn_on FROM fe WHERE event IN ('verify_outcome','integrate_landed')),
y AS (SELECT key, t AS appeared, turn_on, lead(t) OVER (PARTITION BY key ORDER BY t, turn_on) AS gone FROM x),
z AS (SELECT claim_id, c.key, count(appeared) AS n FROM c LEFT JOIN y ON y.key=c.key AND turn_on AND appeared <= claimed_at + INTERVAL 1 HOUR AND (gone IS NULL OR gone > claimed_at) GROUP BY 1, 2)
SELECT CAST(claim_id AS VARCHAR) AS claim_id, key, CASE WHEN n>0 THEN 'verified' ELSE 'uncertain' END AS status FROM z""")
def eventual_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's row comes with a verify_outcome and goes with an integrate_landed; the last row of the stream closes every window."""
    kind = F.when(F.col("event") == "verify_started", "claim").when(F.col("event") == "verify_outcome", "row").when(F.col("event") == "integrate_landed", "gone")
    rows = funnel(spark, sf_dir).select(F.concat(F.lit("u"), "user_id").alias("key"), kind.alias("kind"), F.col("id").cast("string").alias("claim_id"), F.col("created_at").cast("timestamp").alias("ts")).filter("kind is not null")
    return replayed(spark, rows, lambda s: Z.eventual_stream(s, 3_600_000), "eventual", closing={"key": "closing", "kind": "gone", "ts": CLOSING}).select("claim_id", "key", "status")


@query("skew_filter", FUNNEL + "SELECT id FROM fe WHERE id%10*60 <= 300")
def skew_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    beacons = funnel(spark, sf_dir).select("id", F.col("created_at").alias("issued_at"), (F.col("created_at") + F.make_dt_interval(secs=(F.col("id") % 10 * 60).cast("decimal(18,6)"))).alias("arrived_at"))
    return Z.skew_filter(beacons).select("id")


CLOSING = "2099-01-01 00:00:00"


def replayed(spark: SparkSession, df: DataFrame, build, name: str, mode: str = "append", closing: dict | list[dict] | None = None) -> DataFrame:
    """Write the rows as a file source, run the stream over all of it, and read what it wrote.

    closing: values of further rows, far ahead in time, that close what waits for later events.
    """
    import uuid

    base = f"{shared_dir(spark)}/replay-{name}-{uuid.uuid4().hex}"
    for end in closing if isinstance(closing, list) else [closing] if closing else []:
        df = df.unionByName(spark.range(1).select(*[F.lit(end.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema]))
    df.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{base}/in")
    q = build(stream).writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


FILES = 4


def in_parts(rows: DataFrame, part: Column, parts: int, folder: str) -> DataFrame:
    """A stream that reads the rows part by part, a batch each. Rows are dealt to folders in one pass; each part then is FILES files,
    and the source takes files in the order they were written."""
    spark = rows.sparkSession
    rows.withColumn("part", part).repartition(parts * FILES, "part", F.pmod(F.xxhash64(*rows.columns), F.lit(FILES))).write.partitionBy("part").parquet(f"{folder}-dealt")
    for p in range(parts):
        dealt = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType())])).parquet(f"{folder}-dealt").filter(F.col("part") == p).drop("part")
        dealt.repartition(FILES).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(folder)


@query("idempotent_beacons", FUNNEL + "SELECT 'r' || q AS run_id, event, COUNT(*) AS n FROM (SELECT DISTINCT id//4 AS q, event FROM fe) GROUP BY 1, 2")
def idempotent_beacons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = funnel(spark, sf_dir).select(F.concat(F.lit("r"), F.floor(F.col("id") / 4)).alias("run_id"), "event", F.col("created_at").cast("timestamp").alias("created_at"))
    out = replayed(spark, rows, Z.idempotent_beacons, "beacons")
    return out.groupBy("run_id", "event").agg(F.count(F.lit(1)).alias("n"))


@query("hourly_counts", FUNNEL + "SELECT CAST(epoch(date_trunc('hour', created_at)) AS BIGINT) AS window_start, event AS scope, COUNT(*) AS n FROM fe GROUP BY 1, 2")
def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = funnel(spark, sf_dir).select(F.col("event").alias("scope"), F.col("created_at").cast("timestamp").alias("ts"))
    return replayed(spark, rows, Z.hourly_counts, "hours", closing={"scope": "closing", "ts": CLOSING}).filter("scope <> 'closing'").select(F.unix_seconds("w.start").alias("window_start"), "scope", "n")


_SESSIONS = FUNNEL + """, o AS (SELECT 'u' || user_id AS workflow_id, created_at AS t, event='verify_outcome' AS claim, lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at, id) AS p FROM fe),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR t >= p + INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY workflow_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM o)
"""


@query("session_close", _SESSIONS + "SELECT workflow_id, CAST(floor(epoch(min(t))) AS BIGINT) AS started, count(*) AS n_events, count(*) FILTER (claim) AS n_claims FROM g GROUP BY workflow_id, s")
def session_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = funnel(spark, sf_dir).select(F.concat(F.lit("u"), "user_id").alias("workflow_id"), F.when(F.col("event") == "verify_outcome", "tool_observed").otherwise("control").alias("type"), F.col("created_at").cast("timestamp").alias("ts"))
    closed = replayed(spark, rows, lambda s: Z.closed_sessions(s, "2 hours"), "sessions", closing={"workflow_id": "closing", "type": "control", "ts": CLOSING})
    return closed.filter("workflow_id <> 'closing'").select("workflow_id", F.unix_seconds("session.start").alias("started"), "n_events", "n_claims")


@query("session_verify", with_(ROLLED, "SELECT workflow_id, seq, status, COALESCE(code, '') AS code FROM steps"))
def session_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workflows are verified when their session closes; the verdicts of all batches together are those of the batch job."""
    import uuid

    base = f"{shared_dir(spark)}/closing-{uuid.uuid4().hex}"
    whole = claimed(spark, sf_dir)
    whole.observations.write.parquet(f"{base}/claims")
    claims = spark.read.parquet(f"{base}/claims")
    log = claims.select("workflow_id", F.lit("tool_observed").alias("type"), F.timestamp_seconds(F.lit(1704067200) + F.col("line_no")).alias("ts"))
    log.unionByName(spark.range(1).select(F.lit("closing").alias("workflow_id"), F.lit("control").alias("type"), F.lit(CLOSING).cast("timestamp").alias("ts"))).write.parquet(f"{base}/log")

    def verify(closed: DataFrame) -> DataFrame:
        known = closed.select("workflow_id").distinct()
        return Verification(spark, None, whole.registry, whole.state, claimed=claims.join(known, "workflow_id", "left_semi")).steps.select("workflow_id", "seq", "status", "code")

    stream = spark.readStream.schema(log.schema).parquet(f"{base}/log")
    Z.close_and_verify(stream, "30 days", verify, f"{base}/verdicts", f"{base}/ck").awaitTermination()
    return spark.read.parquet(f"{base}/verdicts").select("workflow_id", "seq", "status", F.coalesce("code", F.lit("")).alias("code"))


# Events arrive by id in eight parts; late is what is an hour older than the latest of the parts before.
@query("late_events", FUNNEL + """, b AS (SELECT id, created_at, id * 8 // (SELECT max(id) + 1 FROM fe) AS part FROM fe), m AS (SELECT part, max(created_at) AS top FROM b GROUP BY 1)
SELECT id, coalesce(created_at < (SELECT max(top) FROM m WHERE m.part < b.part) - INTERVAL 1 HOUR, false) AS late FROM b""")
def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    base = f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    rows = funnel(spark, sf_dir).select("id", F.col("created_at").cast("timestamp").alias("ts"))
    most = rows.agg(F.max("id").alias("m")).first()["m"] + 1
    stream = in_parts(rows, F.floor(F.col("id") * 8 / most), 8, f"{base}/in")
    Z.split_late(stream, "1 hour", f"{base}/on-time", f"{base}/late", f"{base}/ck").awaitTermination()
    read = lambda side, late: spark.read.schema(rows.schema).parquet(f"{base}/{side}").select("id", F.lit(late).alias("late"))
    return read("on-time", False).unionByName(read("late", True))


@query("reservation_expiry", _RES + "SELECT id, 'k' || user_id AS api_key, CASE WHEN what<>'held' THEN what WHEN rn=1 THEN 'accepted' ELSE 'repeat' END AS decision FROM d")
def reservation_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event") == "reserve_allowed", "reserve").when(F.col("event") == "verify_outcome", "outcome")
    rows = funnel(spark, sf_dir).select(F.concat(F.lit("k"), "user_id").alias("api_key"), F.to_date("created_at").cast("string").alias("run_id"), kind.alias("kind"), F.col("id").cast("bigint").alias("id"), F.col("created_at").cast("timestamp").alias("created_at")).filter("kind is not null")
    ends = [{"api_key": "closing", "run_id": "", "kind": kind, "created_at": CLOSING} for kind in ("reserve", "outcome")]
    return replayed(spark, rows, reservation_expiry_stream, "reservations", closing=ends).filter("api_key <> 'closing'")


@query("rolling_kpis", FUNNEL + """, d AS (SELECT unnest(range((SELECT date_trunc('day', min(created_at)) FROM fe), (SELECT max(created_at) FROM fe), INTERVAL 1 DAY)) AS as_of)
SELECT strftime(as_of, '%Y-%m-%d') AS as_of, COUNT(DISTINCT install_id) FILTER (event='verify_started' AND install_id<>'') AS distinct_installs, COUNT(*) FILTER (event='verify_outcome') AS outcome_rows
FROM d JOIN fe ON created_at >= as_of - INTERVAL 7 DAY WHERE src IS DISTINCT FROM 'local_dev' GROUP BY 1""")
def rolling_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimlake.plans import kpi

    return kpi.rolling(funnel(spark, sf_dir))
