"""The whole trace of a run: nodes with their verdicts, backward paths, parent problems and how it ended."""

import json

import pytest
from test_verify import TOOLS, event, state, up

from claimlake.plans import trace as T
from claimlake.plans.diagnose import Diagnosis
from claimlake.plans.verify import Verification
from claimlake.sources.registry import Registry


def wire(workflow, kind, name, **fields):
    return json.dumps({"schemaVersion": 2, "workflowId": workflow, "type": kind, "runEventId": name, **fields})


GOOD, BAD = up("c_ok", name="Alice"), up("c_none")
LINES = {
    "w_chain": [
        wire("w_chain", "model_turn", "m", status="completed"),
        wire("w_chain", "tool_observed", "t1", parentRunEventId="m", seq=7, toolId="crm.upsert", params=GOOD),
        wire("w_chain", "tool_observed", "t2", parentRunEventId="t1", seq=3, toolId="crm.upsert", params=BAD),
        wire("w_chain", "tool_observed", "t3", parentRunEventId="t1", seq=7, toolId="crm.upsert", params=GOOD),
        wire("w_chain", "tool_skipped", "s", toolId="a.b", reason="r"),
        wire("w_chain", "control", "z", parentRunEventId="t3", controlKind="run_completed")],
    "w_old": [event("w_old", "crm.upsert", GOOD), "{", event("w_old", "crm.upsert", GOOD)],
    "w_torn": [
        wire("w_torn", "model_turn", "a", status="completed", parentRunEventId="nowhere"), wire("w_torn", "model_turn", "b", status="error", parentRunEventId="c"),
        wire("w_torn", "model_turn", "c", status="completed"), wire("w_torn", "model_turn", "c", status="completed")],
}


@pytest.fixture(scope="module")
def view(spark):
    rows = [(wf, i, line) for wf, lines in LINES.items() for i, line in enumerate(lines)]
    run = Verification(spark, spark.createDataFrame(rows, "source_file string, line_no long, line string"), Registry(TOOLS), state(spark), keep=("events", "steps"))
    d = Diagnosis(spark, run)
    yield T.execution_trace(d.indexed, run.steps, run.malformed_lines).collect()
    run.release()


def test_every_event_is_a_node_with_the_step_it_closes(view):
    nodes = {(r.workflow_id, r.ingest_index): (r.run_event_id, r.schema_version, r.parent_run_event_id, r.trace_kind, r.tool_seq, r.tool_id, r.step_index, r.step_status, r.outcome_label) for r in view if r.part == "node"}
    assert len(nodes) == 12
    assert nodes["w_chain", 1] == ("t1", 2, "m", "repeated_observation", 7, "crm.upsert", None, None, None)
    assert nodes["w_chain", 2] == ("t2", 2, "t1", "failed", 3, "crm.upsert", 0, "missing", "FAILED_ROW_MISSING")
    assert nodes["w_chain", 3] == ("t3", 2, "t1", "success", 7, "crm.upsert", 1, "verified", "VERIFIED")
    assert nodes["w_chain", 4] == ("s", 2, None, "skipped", None, "a.b", None, None, None)
    assert nodes["w_old", 0] == ("syn:0", 1, None, "repeated_observation", 0, "crm.upsert", None, None, None)
    assert nodes["w_old", 1] == ("syn:1", 1, None, "success", 0, "crm.upsert", 0, "verified", "VERIFIED")
    assert nodes["w_torn", 1][3] == "failed"


def test_paths_lead_back_from_the_end_and_from_each_step(view):
    paths = {}
    for r in view:
        if r.part == "path":
            paths.setdefault((r.workflow_id, r.path_kind, r.tool_seq, r.step_index, r.seed), {})[r.distance] = r.run_event_id
    assert {k: [v[n] for n in sorted(v)] for k, v in paths.items()} == {
        ("w_chain", "workflow_terminal", None, None, "z"): ["z", "t3", "t1", "m"], ("w_chain", "verification_step", 3, 0, "t2"): ["t2", "t1", "m"],
        ("w_chain", "verification_step", 7, 1, "t3"): ["t3", "t1", "m"],
        ("w_old", "workflow_terminal", None, None, "syn:1"): ["syn:1"], ("w_old", "verification_step", 0, 0, "syn:1"): ["syn:1"]}
    assert len([r for r in view if r.part == "path"]) == 12


def test_parent_problems_and_the_end_of_the_run(view):
    assert sorted((r.workflow_id, r.run_event_id, r.code) for r in view if r.part == "problem") == [
        ("w_torn", "a", "TRACE_UNKNOWN_PARENT_RUN_EVENT_ID"), ("w_torn", "b", "TRACE_PARENT_FORWARD_REFERENCE"), ("w_torn", "c", "TRACE_DUPLICATE_RUN_EVENT_ID")]
    assert {(r.workflow_id, r.run_completion, r.malformed_event_lines) for r in view} == {
        ("w_chain", "completed", 0), ("w_old", "unknown_or_interrupted", 1), ("w_torn", "unknown_or_interrupted", 0)}
