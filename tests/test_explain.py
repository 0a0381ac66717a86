"""What is told about each failing workflow: texts by scope, facts in order, unknowns."""

import json

import pytest
from test_verify import ROW, TOOLS, eq, event, ptr, state, up

from claimlake.plans.correctness import change_set_rules, diagnosed_rules, quick_rules
from claimlake.plans.diagnose import Diagnosis
from claimlake.plans.explain import FACTS, failure_explanations
from claimlake.plans.verify import Verification
from claimlake.sources.registry import Registry

MORE = [
    {"toolId": "sum", "effectDescriptionTemplate": "Sum\n of  {/id}", "verification": {"kind": "sql_relational", "checks": [
        {"checkKind": "aggregate", "id": "total", "table": {"const": "contacts"}, "fn": "SUM", "sumColumn": {"const": "qty"}, "whereEq": [eq("id", "/id")], "expect": {"op": "eq", "value": {"const": 5}}}]}},
    {"toolId": "keyed", "effectDescriptionTemplate": "", "verification": {**ROW, "identityEq": [eq("status", "/s"), eq("id", "/recordId")]}},
]


def wire(workflow, kind, n, **fields):
    return json.dumps({"schemaVersion": 2, "workflowId": workflow, "type": kind, "runEventId": f"e{n}", **fields})


LINES = {
    "w_null": [event("w_null", "crm.upsert", up("c_partial", name="N"))],
    "w_sum": [event("w_sum", "sum", {"id": "c_ok"})],
    "w_none": [event("w_none", "ghost_table", up("x"))],
    "w_keyed": [event("w_keyed", "keyed", {"recordId": "zz", "s": "new  one", "fields": {"qty": 1}})],
    "w_two": [event("w_two", "two", {"a": "yy", "fa": {}, "b": "zz", "fb": {}})],
    "w_fine": [event("w_fine", "crm.upsert", up("c_ok", name="Alice"))],
    "w_skip": [wire("w_skip", "tool_skipped", 0, toolId="a.b", reason="r"), wire("w_skip", "tool_observed", 1, seq=0, toolId="crm.upsert", params=up("c_none"))],
    "w_gate": [wire("w_gate", "control", 0, controlKind="gate", decision="skipped"), wire("w_gate", "tool_observed", 1, seq=0, toolId="crm.upsert", params=up("c_none"))],
    "w_order": [event("w_order", "nope", {}, seq=1), event("w_order", "crm.upsert", up("c_ok", name="Alice"), seq=0)],
    "w_idle": [wire("w_idle", "model_turn", 0, status="completed")],
    "w_torn": [wire("w_torn", "model_turn", 0, status="completed"), "{"],
}


@pytest.fixture(scope="module")
def diagnosis(spark):
    rows = [(wf, i, line) for wf, lines in LINES.items() for i, line in enumerate(lines)]
    run = Verification(spark, spark.createDataFrame(rows, "source_file string, line_no long, line string"), Registry(TOOLS + MORE), state(spark), keep=("events", "steps"))
    yield Diagnosis(spark, run)
    run.release()


@pytest.fixture(scope="module")
def told(diagnosis):
    return {r.workflow_id: r for r in failure_explanations(diagnosis, "eventual", 500, 50).collect()}


def facts(row):
    return {x.id: x.value for x in row.known_facts}


def test_one_row_for_each_failing_workflow(told):
    assert set(told) == set(LINES) - {"w_fine"}
    for row in told.values():
        ids = [x.id for x in row.known_facts]
        assert ids == [f for f in FACTS if f in ids] and row.expected and row.observed and row.divergence
        assert facts(row)["verification_policy"] == "consistencyMode=eventual; verificationWindowMs=500; pollIntervalMs=50"


def test_step_scope(told):
    row = told["w_null"]
    assert row.observed == 'Step verification outcome: code=VALUE_MISMATCH detail=Expected "N" but found null for field name (table=contacts id=c_partial); field=name; expected="N"; actual=null; rowCount=1'
    assert facts(row)["evidence_summary_actual"] == "null" and facts(row)["intended_effect_narrative"] == 'Upsert "c_partial"'
    assert [x.id for x in row.unknowns] == ["classification_confidence_band", "competing_hypothesis", "competing_hypothesis"]
    assert row.unknowns[1].value.startswith("origin=downstream_system_state|rationale=Stored column values differ")


def test_numbers_of_a_single_relational_check(told):
    row = told["w_sum"]
    assert row.observed.endswith("Relational check total: expected eq 5 but actual 3; expected=5; actual=3")
    assert facts(row)["verify_target"] == "sql_relational count=1 total:aggregate" and facts(row)["intended_effect_narrative"] == 'Sum of "c_ok"'
    assert "evidence_summary_row_count" not in facts(row)


def test_unreadable_table_has_an_unknown_count(told):
    assert facts(told["w_none"])["evidence_summary_row_count"] == "null" and told["w_none"].observed.endswith("; rowCount=null")


def test_target_names_its_keys_in_order(told):
    assert facts(told["w_keyed"])["verify_target"] == "table=contacts identity=[id=zz, status=new one] required_fields=[qty]"
    assert facts(told["w_keyed"])["intended_effect_narrative"] == "(no message)" and 'intended_effect ""' in told["w_keyed"].expected


def test_effects_speak_through_the_first_that_failed(told):
    row = told["w_two"]
    assert facts(row)["primary_effect_id"] == "first" and facts(row)["primary_codes"] == "ROW_ABSENT" and "(table=contacts id=yy)" in row.observed
    assert facts(row)["verify_target"] == "sql_effects count=2 first:contacts identity=[id=yy]; second:contacts identity=[id=zz]"


def test_upstream_scopes(told):
    skip, gate = told["w_skip"], told["w_gate"]
    assert skip.observed == "Run-context signal before the failing observation: code=TOOL_SKIPPED toolId=a.b." and facts(skip)["primary_tool_id"] == "a.b" and "primary_run_event_id" not in facts(skip)
    assert "controlKind=gate decision=skipped" in gate.observed and facts(gate)["primary_run_event_id"] == "e0" and "through ingest_index=0 to allow" in gate.expected
    assert [x.id for x in gate.unknowns] == ["classification_confidence_band", "competing_hypothesis"] and "verify_target" not in facts(gate)


def test_sequence_scope(told):
    row = told["w_order"]
    assert facts(row)["primary_scope"] == "event_sequence" and "code=CAPTURE_ORDER_NOT_MONOTONIC_IN_SEQ" in row.divergence and facts(row)["trust_summary"].endswith("See event_sequence below.")


def test_run_level_scope(told):
    idle, torn = told["w_idle"], told["w_torn"]
    assert idle.observed == ('Run-level failure: code=NO_STEPS_FOR_WORKFLOW detail=No tool_observed events for workflowId "w_idle" after filtering. event_file_non_empty_lines=1 '
                             "schema_valid_events=1 tool_observed_for_workflow=0 tool_observed_other_workflows=0..")
    assert facts(torn)["primary_codes"] == "MALFORMED_EVENT_LINE,NO_STEPS_FOR_WORKFLOW" and "code=MALFORMED_EVENT_LINE" in torn.observed


def test_rules_and_their_projections(diagnosis):
    found = {r.workflow_id: r for r in diagnosed_rules(diagnosis, "eventual", 500, 50).collect()}
    shown = {k: json.loads(r.projection) for k, r in found.items()}
    assert set(found) == set(LINES) - {"w_fine"}
    assert all(shown[k]["projectionKind"] == r.kind and shown[k]["workflowId"] == k and shown[k]["verificationPolicyFragment"].startswith("consistencyMode=eventual;") for k, r in found.items())
    assert all(r.projection == json.dumps(shown[k], separators=(",", ":"), sort_keys=True, ensure_ascii=False) for k, r in found.items())
    assert shown["w_sum"]["verificationRequest"] == {"kind": "sql_relational", "checks": [{
        "checkKind": "aggregate", "id": "total", "table": "contacts", "fn": "SUM", "sumColumn": "qty", "whereEq": [{"column": "id", "value": "c_ok"}], "expectOp": "eq", "expectValue": 5}]}
    assert [e["id"] for e in shown["w_two"]["verificationRequest"]["effects"]] == ["first", "second"] and shown["w_two"]["verificationRequest"]["effects"][0]["requiredFields"] == {}
    assert shown["w_null"]["verificationRequest"] == {"kind": "sql_row", "table": "contacts", "identityEq": [{"column": "id", "value": "c_partial"}], "requiredFields": {"name": "N"}}
    assert shown["w_torn"]["primaryFailureCodes"] == ["MALFORMED_EVENT_LINE", "NO_STEPS_FOR_WORKFLOW"]
    assert shown["w_gate"] | {"x": 1} == shown["w_gate"] | {"x": 1, "ingestIndex": 0, "requiredUpstreamContract": "gate_not_skipped_before_observation"}


def test_quick_rules(spark):
    pairs = "array<struct<column:string,value:string>>"
    units = spark.createDataFrame([
        ("d", [0], "row", "b", "orders", "fail", "ROW_ABSENT", [("k", 'a"b')], [("q", "number", "1")], 0), ("d", [0], "row", "c", "", "uncertain", "MAPPING_FAILED", None, None, 1), ("d", [0], "row", "d", "t", "uncertain", "MAPPING_LOW_CONFIDENCE", None, None, 2),
        ("d", [1], "related_exists", "fk:t.c", "t", "fail", "RELATED_ROWS_ABSENT", [("c", "7")], None, 3), ("d", [1], "row", "e", "t", "verified", None, [("c", "7")], None, 4), ("d", [1], "row", "f", "t", "uncertain", "CONNECTOR_ERROR", [], [], 5),
    ], f"doc_id string, place array<int>, kind string, name string, table_name string, verdict string, code string, identity_eq {pairs}, fields array<struct<k:string,t:string,v:string>>, unit long")
    actions = spark.createDataFrame([("d", [0], 0, "t.x"), ("d", [1], 1, "t.y")], "doc_id string, place array<int>, n long, tool_name string")
    got = {r.unit: r for r in quick_rules(units, actions).collect()}
    assert {k: (r.kind, r.action) for k, r in got.items()} == {
        0: ("quick_inferred_sql_row", "reconcile_downstream_state"), 1: ("quick_mapping_gap", "correct_verification_inputs"), 2: ("quick_mapping_gap", "manual_review"),
        3: ("quick_inferred_relational", "manual_review"), 5: ("quick_inferred_sql_row", "improve_read_connectivity")}
    assert json.loads(got[0].projection)["sqlRowRequest"] == {"kind": "sql_row", "table": "orders", "identityEq": [{"column": "k", "value": 'a"b'}], "requiredFields": {"q": 1}}
    assert json.loads(got[1].projection) == {"projectionKind": "quick_mapping_gap", "quickProvisional": True, "toolName": "t.x", "actionIndex": 0, "reasonCodes": ["MAPPING_FAILED"], "table": None}
    assert "tool t.x actionIndex=0 SHALL map" in got[1].must_always_hold and got[1].must_always_hold.endswith("(reason codes: MAPPING_FAILED).")
    assert json.loads(got[3].projection)["matchEq"] == [{"column": "c", "value": "7"}] and "childTable=t SHALL hold" in got[3].must_always_hold and len(got[3].enforce_as) == 2


def test_change_set_rules(spark):
    rows = [("c", 2, "plan_transition.rule.b", "inconsistent", "PLAN_RULE_FORBIDDEN_ROW"), ("c", 1, "plan_transition.rule.a", "inconsistent", "PLAN_RULE_RENAME_MISMATCH"), ("d", 1, "plan_transition.rule.a", "verified", None), ("e", 1, "x", "inconsistent", "NEW")]
    got = {r.change_id: r for r in change_set_rules(spark.createDataFrame(rows, "change_id string, seq int, tool_id string, status string, code string")).collect()}
    assert set(got) == {"c", "e"} and "seq=1 toolId=plan_transition.rule.a SHALL" in got["c"].must_always_hold and got["e"].action == "manual_review"
    assert json.loads(got["c"].projection)["primaryCodes"] == ["PLAN_RULE_RENAME_MISMATCH"] and json.loads(got["c"].projection)["verifyTarget"] is None


def test_evidence_reads_the_analysis_once(diagnosis):
    from test_quick import plan_of

    evidence = diagnosis.evidence
    assert "effects" not in plan_of(evidence)
    got = {(r.workflow_id, r.scope, r.seq) for r in evidence.collect()}
    assert ("w_null", "step", 0) in got and ("w_torn", "run_level", None) in got and "w_fine" not in {g[0] for g in got}
