"""One workflow per outcome, on small state tables."""

import json

import pytest

from claimlake.operators.resolve import resolve_checks, resolve_fixed
from claimlake.plans.verify import Verification
from claimlake.sources.registry import Registry
from claimlake.sources.state import State


def ptr(p):
    return {"pointer": p}


def eq(column, pointer):
    return {"column": {"const": column}, "value": ptr(pointer)}


ROW = {"kind": "sql_row", "table": {"const": "contacts"}, "identityEq": [eq("id", "/recordId")], "requiredFields": ptr("/fields")}
TOOLS = [
    {"toolId": "crm.upsert", "effectDescriptionTemplate": "Upsert {/recordId}", "verification": ROW},
    {"toolId": "dup.check", "effectDescriptionTemplate": "", "verification": {**ROW, "table": {"const": "dups"}, "identityEq": [eq("k", "/recordId")]}},
    {"toolId": "two", "effectDescriptionTemplate": "", "verification": {"kind": "sql_effects", "effects": [
        {"id": "first", "table": {"const": "contacts"}, "identityEq": [eq("id", "/a")], "requiredFields": ptr("/fa")},
        {"id": "second", "table": {"const": "contacts"}, "identityEq": [eq("id", "/b")], "requiredFields": ptr("/fb")}]}},
    {"toolId": "rel", "effectDescriptionTemplate": "", "verification": {"kind": "sql_relational", "checks": [
        {"checkKind": "related_exists", "id": "lines", "childTable": {"const": "rel_lines"}, "matchEq": [eq("order_id", "/order")]}]}},
    {"toolId": "gone", "effectDescriptionTemplate": "", "verification": {"kind": "sql_row_absent", "table": {"const": "contacts"}, "identityEq": [eq("id", "/recordId")]}},
    {"toolId": "orphans", "effectDescriptionTemplate": "", "verification": {"kind": "sql_relational", "checks": [
        {"checkKind": "anti_join", "id": "o", "anchorTable": {"const": "rel_b"}, "lookupTable": {"const": "rel_a"}, "anchorColumn": {"const": "a_id"},
         "lookupColumn": {"const": "id"}, "lookupPresenceColumn": {"const": "id"}, "filterEqLookup": [eq("tag", "/tag")]}]}},
    {"toolId": "ghost_table", "effectDescriptionTemplate": "", "verification": {**ROW, "table": {"const": "nowhere"}}},
]


def event(workflow, tool, params, seq=0, n=0):
    return json.dumps({"schemaVersion": 1, "workflowId": workflow, "seq": seq, "type": "tool_observed", "toolId": tool, "params": params})


def up(id_, **fields):
    return {"recordId": id_, "fields": fields}


CASES = [
    ("wf_ok", [event("wf_ok", "crm.upsert", up("c_ok", name="Alice", status="active"))], "verified", None, "complete"),
    ("wf_missing", [event("wf_missing", "crm.upsert", up("nope", name="x"))], "missing", "ROW_ABSENT", "inconsistent"),
    ("wf_null", [event("wf_null", "crm.upsert", up("c_partial", name="N"))], "inconsistent", "VALUE_MISMATCH", "inconsistent"),
    ("wf_null_ok", [event("wf_null_ok", "crm.upsert", up("c_partial", name=None))], "verified", None, "complete"),
    ("wf_number_text", [event("wf_number_text", "crm.upsert", up("c_ok", qty="3"))], "verified", None, "complete"),
    ("wf_number", [event("wf_number", "crm.upsert", up("c_ok", qty=3.0))], "verified", None, "complete"),
    ("wf_bool", [event("wf_bool", "crm.upsert", up("c_one", qty=True))], "verified", None, "complete"),
    ("wf_case", [event("wf_case", "crm.upsert", up("c_ok", Name="Alice"))], "verified", None, "complete"),
    ("wf_shape", [event("wf_shape", "crm.upsert", up("c_ok", ghost=1))], "incomplete_verification", "ROW_SHAPE_MISMATCH", "incomplete"),
    ("wf_object", [event("wf_object", "crm.upsert", up("c_ok", tags="x"))], "incomplete_verification", "UNREADABLE_VALUE", "incomplete"),
    ("wf_dup", [event("wf_dup", "dup.check", up("dupkey"))], "inconsistent", "DUPLICATE_ROWS", "inconsistent"),
    ("wf_unknown", [event("wf_unknown", "nope.tool", {})], "incomplete_verification", "UNKNOWN_TOOL", "incomplete"),
    ("wf_nokey", [event("wf_nokey", "crm.upsert", {"fields": {}})], "incomplete_verification", "KEY_VALUE_POINTER_MISSING", "incomplete"),
    ("wf_badkey", [event("wf_badkey", "crm.upsert", {"recordId": [1], "fields": {}})], "incomplete_verification", "KEY_VALUE_NOT_SCALAR", "incomplete"),
    ("wf_nofields", [event("wf_nofields", "crm.upsert", {"recordId": "c_ok"})], "incomplete_verification", "REQUIRED_FIELDS_POINTER_MISSING", "incomplete"),
    ("wf_fields_list", [event("wf_fields_list", "crm.upsert", {"recordId": "c_ok", "fields": [1]})], "incomplete_verification", "REQUIRED_FIELDS_NOT_OBJECT", "incomplete"),
    ("wf_nested", [event("wf_nested", "crm.upsert", up("c_ok", name={"a": 1}))], "incomplete_verification", "REQUIRED_FIELDS_VALUE_NOT_SCALAR", "incomplete"),
    ("wf_badname", [event("wf_badname", "crm.upsert", {"recordId": "c_ok", "fields": {"a b": 1}})], "incomplete_verification", "INVALID_IDENTIFIER", "incomplete"),
    ("wf_retry", [event("wf_retry", "crm.upsert", up("c_ok", name="Alice"))] * 2, "verified", None, "complete"),
    ("wf_diverge", [event("wf_diverge", "crm.upsert", up("c_ok", name=n)) for n in ("Alice", "Bob")], "incomplete_verification", "RETRY_OBSERVATIONS_DIVERGE", "incomplete"),
    ("wf_multi_ok", [event("wf_multi_ok", "two", {"a": "c_ok", "fa": {}, "b": "c_one", "fb": {}})], "verified", None, "complete"),
    ("wf_multi_part", [event("wf_multi_part", "two", {"a": "c_ok", "fa": {}, "b": "zz", "fb": {}})], "partially_verified", "MULTI_EFFECT_PARTIAL", "inconsistent"),
    ("wf_multi_none", [event("wf_multi_none", "two", {"a": "yy", "fa": {}, "b": "zz", "fb": {}})], "inconsistent", "MULTI_EFFECT_ALL_FAILED", "inconsistent"),
    ("wf_rel_ok", [event("wf_rel_ok", "rel", {"order": "o1"})], "verified", None, "complete"),
    ("wf_rel_none", [event("wf_rel_none", "rel", {"order": "o9"})], "missing", "RELATED_ROWS_ABSENT", "inconsistent"),
    ("wf_gone_ok", [event("wf_gone_ok", "gone", {"recordId": "nope"})], "verified", None, "complete"),
    ("wf_gone_bad", [event("wf_gone_bad", "gone", {"recordId": "c_ok"})], "inconsistent", "ROW_PRESENT_WHEN_FORBIDDEN", "inconsistent"),
    ("wf_orphan_ok", [event("wf_orphan_ok", "orphans", {"tag": "t1"})], "inconsistent", "ORPHAN_ROW_DETECTED", "inconsistent"),
    ("wf_no_table", [event("wf_no_table", "ghost_table", up("x"))], "incomplete_verification", "CONNECTOR_ERROR", "incomplete"),
]


def state(spark):
    contacts = spark.createDataFrame(
        [("c_ok", "Alice", "active", 3, ["t"]), ("c_partial", None, "pending", 0, None), ("c_one", "One", "active", 1, None)],
        "id string, name string, status string, qty int, tags array<string>")
    return State({
        "contacts": contacts, "dups": spark.createDataFrame([("dupkey", "a"), ("dupkey", "b")], "k string, v string"),
        "rel_lines": spark.createDataFrame([("l1", "o1"), ("l2", "o1")], "id string, order_id string"),
        "rel_a": spark.createDataFrame([("a1", "t1"), ("a1", "t2")], "id string, tag string"),
        "rel_b": spark.createDataFrame([("b1", "a_other"), ("b2", "a1")], "id string, a_id string"),
    })


def lines(spark, cases, repartition=None):
    rows = [(f"log_{wf}", i, line) for wf, events, *_ in cases for i, line in enumerate(events)]
    df = spark.createDataFrame(rows, "source_file string, line_no long, line string")
    return df.repartition(repartition) if repartition else df


@pytest.fixture(scope="module")
def verdicts(spark):
    v = Verification(spark, lines(spark, CASES, 5), Registry(TOOLS), state(spark))
    steps = {r.workflow_id: (r.status, r.code) for r in v.steps.collect()}
    workflows = {r.workflow_id: r.status for r in v.workflows.collect()}
    return steps, workflows


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0])
def test_outcome(verdicts, case):
    workflow, _, status, code, workflow_status = case
    assert verdicts[0][workflow] == (status, code)
    assert verdicts[1][workflow] == workflow_status


def test_general_and_fixed_resolution_agree(spark):
    v = Verification(spark, lines(spark, CASES), Registry(TOOLS), state(spark))
    columns = ["workflow_id", "check_id", "problem_code", "problem_message", "binding", "key_values", "identity_eq", "filter_eq", "filter2_eq", "narrative"]
    general = resolve_checks(v.planned, v.registry.checks(spark)).select(*columns)
    fixed = resolve_fixed(v.planned, v.registry.fixed_checks(spark)).select(*columns)
    norm = lambda df: sorted(str(r) for r in df.collect())
    assert norm(general) == norm(fixed)


def test_names_from_params(spark):
    tool = [{"toolId": "any", "effectDescriptionTemplate": "", "verification": {
        **ROW, "table": ptr("/table"), "identityEq": [{"column": ptr("/column"), "value": ptr("/recordId")}]}}]
    cases = [
        ("d_ok", [event("d_ok", "any", {"table": "contacts", "column": "id", "recordId": "c_ok", "fields": {}})]),
        ("d_bad", [event("d_bad", "any", {"table": "contacts", "column": "1d", "recordId": "c_ok", "fields": {}})]),
        ("d_none", [event("d_none", "any", {"column": "id", "recordId": "c_ok", "fields": {}})]),
    ]
    v = Verification(spark, lines(spark, cases), Registry(tool), state(spark))
    got = {r.workflow_id: (r.status, r.code) for r in v.steps.collect()}
    assert got == {"d_ok": ("verified", None), "d_bad": ("incomplete_verification", "INVALID_IDENTIFIER"), "d_none": ("incomplete_verification", "TABLE_POINTER_INVALID")}


def test_bad_line_makes_its_file_incomplete(spark):
    rows = [("f", 0, CASES[0][1][0]), ("f", 1, '{"schemaVersion":1'), ("g", 0, event("wf_other", "crm.upsert", up("c_ok")))]
    v = Verification(spark, spark.createDataFrame(rows, "source_file string, line_no long, line string"), Registry(TOOLS), state(spark))
    assert {r.workflow_id: r.status for r in v.workflows.collect()} == {"wf_ok": "incomplete", "wf_other": "complete"}


def test_duplicate_tool_is_refused():
    with pytest.raises(ValueError, match="REGISTRY_DUPLICATE_TOOL_ID"):
        Registry(TOOLS + TOOLS[:1]).check_rows()
