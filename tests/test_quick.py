"""Inference from activity documents without a registry."""

import json

import pytest
from pyspark.sql import functions as F

from claimlake.plans import infer as Q
from claimlake.plans.verify import Verification
from claimlake.sources.registry import Registry
from claimlake.sources.state import State

IDS = ["doc_id", "place"]


def actions_of(spark, *texts):
    values = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, place int, j string")
    return Q.extract_actions(values, ["doc_id"])


def got(df):
    return sorted((r.doc_id, r.tool_name, json.loads(r.params)) for r in df.collect())


def test_deep_lists_and_kept_values(spark):
    call = {"tool": "t.x", "id": 5, "o": {"a": 1, "b": [True, None]}}
    found = got(actions_of(spark, json.dumps([[[[[call]]]]]), json.dumps({"tool_calls": [{"tool_calls": [{"name": "in"}], "name": "out"}]})))
    assert found == [(0, "t.x", {"id": 5, "o": {"a": 1, "b": [True, None]}}), (1, "in", {}), (1, "out", {})]


def test_params_come_from_the_right_place(spark):
    args = json.dumps({"a": 1})
    found = got(actions_of(
        spark, json.dumps({"function": {"name": "f", "arguments": args}, "arguments": {}}), json.dumps({"tool": "t", "params": "not json", "input": {"b": 2}}),
        json.dumps({"tool": 7, "name": "n", "params": "[1]"}), json.dumps({"tool": 7}), json.dumps({"action": "x", "arguments": "  " + args})))
    assert found == [(0, "f", {"a": 1}), (1, "t", {"b": 2}), (2, "n", {"params": "[1]"}), (4, "x", {"a": 1})]


def test_flatten_has_no_limit(spark):
    deep = {"v": 1}
    for _ in range(40):
        deep = {"d": deep}
    wide = {f"k{i:04d}": i for i in range(600)}
    rows = [(0, 0, json.dumps(deep)), (1, 0, json.dumps(wide)), (2, 0, json.dumps({"l": [1, {"x": 1e21}, [{"y": "é"}], None], "z": None, "n": 10.0})), (3, 0, "{oops")]
    flat = Q.flatten_params(spark.createDataFrame(rows, "doc_id long, place int, params string"), IDS)
    assert flat.filter("doc_id = 0").first()["path"] == ".".join(["d"] * 40) + ".v" and flat.filter("doc_id = 1").count() == 600
    assert [(r.path, r.t, r.v) for r in flat.filter("doc_id = 2").orderBy("ord").collect()] == [("l[1].x", "number", "1e+21"), ("l[2][0].y", "string", "é"), ("n", "number", "10"), ("z", "null", "null")]
    assert flat.filter("doc_id = 3").count() == 0


def test_document_ladder(spark):
    tool = json.dumps({"tool": "t", "params": {"a": 1}})
    texts = ["﻿ [" + tool + "," + tool + "]", "INFO " + tool + "\nbroken {\n\n2024-01-01T00:00:00Z " + tool, "x {no} y " + tool + " then " + tool, "", "only words", "{open " + tool]
    acts, docs = Q.ingest_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    n = {r.doc_id: r.n for r in acts.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert n == {0: 2, 1: 2, 2: 1}
    assert {r.doc_id: (r.rung, r.malformed_lines, r.code) for r in docs.collect()} == {
        0: (1, 0, None), 1: (2, 1, None), 2: (3, 1, None), 3: (None, 0, "INGEST_NO_ACTIONS"), 4: (None, 1, "INGEST_NO_STRUCTURED_TOOL_ACTIVITY"), 5: (None, 1, "INGEST_NO_STRUCTURED_TOOL_ACTIVITY")}


@pytest.fixture(scope="module")
def shop(spark):
    state = State({
        "users": spark.createDataFrame([(1, "ann", 7), (2, "bob", 8)], "user_id long, name string, team_id long"),
        "teams": spark.createDataFrame([(7, "red")], "team_id long, label string"),
    })
    keys = {"users": {"primary": ["user_id"], "foreign": {"team_id": ("teams", "team_id")}}, "teams": {"unique": [["team_id"]]}}
    return state, state.catalog(spark, keys)


def units(spark, shop, *calls):
    state, catalog = shop
    acts = actions_of(spark, *[json.dumps(c) for c in calls])
    flat = Q.flatten_params(acts, IDS)
    rows = Q.verify_units(spark, Q.plan_units(flat, acts, catalog, sorted(state.tables)), state, catalog)
    return Q.all_units(rows, Q.verify_relations(spark, Q.fk_checks(flat, catalog, IDS), state), acts.select(*IDS, "params"))


def call(user, **more):
    return {"tool": "users.save", "params": {"user": user, **more}}


def test_buckets_without_a_key_and_foreign_keys(spark, shop):
    found = units(spark, shop, call({"user_id": 1, "name": "ann"}, team_id=7), call({"colour": "blue"}), call({"user_id": 2, "name": "ann"}, team_id=None), call({"user_id": 1}, team_id=9))
    got = {(r.doc_id, r.kind, r.table_name): (r.verdict, r.code) for r in found.collect()}
    assert got[0, "row", "users"] == ("verified", None) and got[0, "row", "teams"] == ("verified", None) and got[0, "related_exists", "users"] == ("verified", None)
    assert got[1, "row", "users"] == ("uncertain", "MAPPING_NO_UNIQUE_KEY")
    assert got[2, "row", "users"] == ("fail", "VALUE_MISMATCH") and (2, "related_exists", "users") not in got
    assert got[3, "row", "teams"] == ("fail", "ROW_ABSENT") and got[3, "related_exists", "users"] == ("fail", "RELATED_ROWS_ABSENT")
    rollup = {r.doc_id: r.verdict for r in Q.quick_rollup(found, spark.range(5).select(F.col("id").alias("doc_id"))).collect()}
    assert rollup == {0: "pass", 1: "uncertain", 2: "fail", 3: "fail", 4: "uncertain"}


def test_exported_registry_loads_and_verifies(spark, shop):
    state, _ = shop
    entries = Q.export_registry(units(spark, shop, call({"user_id": 1, "name": "ann"}, team_id=7))).cache()
    listed = [json.loads(r.entry) for r in entries.collect()]
    assert len({e["toolId"] for e in listed}) == len(listed) == 3
    replay = Q.export_replay_events(entries).collect()
    assert [r.seq for r in sorted(replay, key=lambda r: r.tool_id)] == [0, 1, 2]
    claims = spark.createDataFrame([("w", "f", r.seq, r.seq, r.tool_id, r.params, None) for r in replay], "workflow_id string, source_file string, line_no long, seq long, tool_id string, params string, ts string")
    again = Verification(spark, None, Registry(listed), state, claimed=claims).steps.collect()
    assert {r.status for r in again} == {"verified"} and len(again) == 3


def test_pointer_export_keeps_the_params(spark):
    units = spark.createDataFrame([(0, [0], "row", "r", "users", 0.52, "verified", None, [("user_id", "1")], [((("a", "b")), "name", "string", "ann")], [("user_id", "/who/user_id")], 0, '{"who":{"user_id":1}}', "pointer")],
        "doc_id long, place array<long>, kind string, name string, table_name string, confidence double, verdict string, code string, identity_eq array<struct<column:string,value:string>>, fields array<struct<o:struct<a:string,b:string>,k:string,t:string,v:string>>, pointers array<struct<column:string,pointer:string>>, unit long, params string, export string")
    entries = Q.export_registry(units)
    assert json.loads(entries.first()["entry"])["verification"]["identityEq"] == [{"column": {"const": "user_id"}, "value": {"pointer": "/who/user_id"}}]
    assert json.loads(Q.export_replay_events(entries).first()["params"]) == {"who": {"user_id": 1}, "__qvFields": {"name": "ann"}}


def test_every_tool_stands_against_every_table(spark):
    tools = spark.createDataFrame([("orders.sync",), ("orders.sync",), ("zzz",), (None,)], "tool_name string")
    got = sorted(tuple(r) for r in Q.tool_table_scores(tools, ["orders", "part", "nation"]).select("tool_name", "table_name", "score", "rank").collect())
    assert got == [("orders.sync", "nation", 0.0, 2), ("orders.sync", "orders", 1.0, 1), ("orders.sync", "part", 0.0, 3),
                   ("zzz", "nation", 0.0, 1), ("zzz", "orders", 0.0, 2), ("zzz", "part", 0.0, 3)]


def test_every_key_stands_against_every_column(spark):
    keys = spark.createDataFrame([("orders", "O_CUSTKEY"), ("orders", "O_CUSTKEY"), ("orders", "price"), ("part", "x")], "table_name string, mapping_key string")
    columns = spark.createDataFrame([("orders", "o_custkey", True), ("orders", "o_orderdate", False)], "table_name string, column_name string, is_primary boolean")
    got = sorted(tuple(r) for r in Q.param_column_scores(keys, columns).select("mapping_key", "column_name", "score").collect())
    assert got == [("O_CUSTKEY", "o_custkey", 0.95), ("O_CUSTKEY", "o_orderdate", 0.0), ("price", "o_custkey", 0.0), ("price", "o_orderdate", 0.0)]


def plan_of(df):
    import contextlib
    import io

    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_parameters_are_not_dealt_by_their_few_paths(spark):
    flat = Q.flatten_params(spark.createDataFrame([(i, 0, json.dumps({"o_id": i, "x": 1})) for i in range(20)], "doc_id long, place int, params string"), IDS)
    catalog = spark.createDataFrame([("lines", "o_id", "orders")], "table_name string, column_name string, ref_table string")
    found = Q.fk_checks(flat, catalog, IDS)
    assert "hashpartitioning(path" not in plan_of(found)
    assert sorted((r.doc_id, r.check_id, r.path, r.value) for r in found.collect()) == [(i, "fk:lines.o_id", "o_id", str(i)) for i in range(20)]


def test_logs_are_dealt_by_their_rows(spark, monkeypatch):
    from claimlake.plans import workload as W

    monkeypatch.setattr(W, "LOG_ROWS", 10)
    dealt = W.spread(spark.range(1000), "id")
    assert ", 100), REPARTITION_BY_NUM" in plan_of(dealt) and dealt.count() == 1000


def test_pointers_that_do_not_resolve_to_the_same_request_are_not_exported(spark):
    pairs, fields = "array<struct<column:string,value:string>>", "array<struct<o:struct<a:string,b:string>,k:string,t:string,v:string>>"
    name = [(("n", "N"), "name", "string", "ann"), (("o", "O"), "open", "boolean", "true"), (("t", "T"), "total", "number", "1.5"), (("z", "Z"), "zip", "null", "null")]

    def unit(doc, params, value, pointer, required=name, column="user_id", confidence=0.52):
        row = (doc, [0], "users", "users", confidence, "verified", None, [(column, value)], required, [(column, pointer)])
        return row, (doc, [0], json.dumps(params))

    made = [
        unit(0, {"who": {"user_id": 1}}, "1", "/who/user_id"),
        unit(1, {"who.user_id": 1}, "1", "/who/user_id"),  # a key with a dot reads as a path of two
        unit(2, {"user_id": None}, "null", "/user_id"),
        unit(3, {"l": [{"id": "a"}, {"id": "b"}]}, "b", "/l/1/id"),
        unit(4, {"l": {"1": {"a/b~": 9007199254740993}}}, "9007199254740992", "/l/1/a~1b~0"),
        unit(5, {"__qvFields": {"user_id": 1}}, "1", "/__qvFields/user_id"),  # the replay puts the required fields there
        unit(6, {"user_id": 1, "__qvFields": 3}, "1", "/user_id"),
        unit(7, {"user_id": 1}, "1", "/user_id", required=[(("n", "N"), "full name", "string", "ann")]),
        unit(8, {"user id": 1}, "1", "/user id", column="user id"),
        unit(9, {"user_id": {"x": 1}}, "1", "/user_id"),
        unit(10, {"user_id": 1}, "1", "/user_id", required=[]),
        unit(11, {"who.user_id": 1}, "1", "/who/user_id", confidence=0.7),
    ]
    rows = spark.createDataFrame([m[0] for m in made], f"doc_id long, place array<long>, bucket string, table_name string, confidence double, verdict string, code string, identity_eq {pairs}, fields {fields}, pointers array<struct<column:string,pointer:string>>")
    related = [(0, [0], "fk:a", "lines", "verified", None, [("user_id", "1")], []), (1, [0], "fk:b", "my lines", "verified", None, [("user_id", "1")], [])]
    relations = spark.createDataFrame(related, f"doc_id long, place array<long>, check_id string, table_name string, verdict string, code string, identity_eq {pairs}, fields {fields}")
    found = Q.all_units(rows, relations, spark.createDataFrame([m[1] for m in made], "doc_id long, place array<long>, params string")).cache()
    assert {r.doc_id: r.export for r in found.filter("kind = 'row'").collect()} == {
        0: "pointer", 1: None, 2: None, 3: "pointer", 4: "pointer", 5: None, 6: "pointer", 7: None, 8: None, 9: None, 10: "pointer", 11: "const"}
    assert {r.doc_id: r.export for r in found.filter("kind = 'related_exists'").collect()} == {0: "related_exists", 1: None}
    replay = {r.doc_id: json.loads(r.params) for r in Q.export_replay_events(Q.export_registry(found.filter("kind = 'row'"))).collect()}
    asked = {"name": "ann", "open": True, "total": 1.5, "zip": None}
    assert replay[6] == {"user_id": 1, "__qvFields": asked} and replay[10] == {"user_id": 1, "__qvFields": {}} and replay[11] == {"__qvFields": asked}


def test_lines_are_made_behind_the_deal(spark):
    from claimlake.plans import workload as W

    made = F.to_json(F.struct(F.lit("t").alias("tool"), F.col("id")))
    lines = W.spread(spark.range(50), "id").select(F.col("id").alias("doc_id"), F.lit(0).alias("place"), F.concat(F.lit("INFO "), made).alias("line"))
    plan = plan_of(Q.ingest_lines(lines))
    below = plan[plan.index("REPARTITION_BY_NUM"):]
    assert "Project" not in below and "Filter" not in below
    assert {r.j for r in Q.ingest_lines(lines).collect()} == {json.dumps({"tool": "t", "id": i}, separators=(",", ":")) for i in range(50)}
