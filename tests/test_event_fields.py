"""Lines to events: which fields make a line valid."""

import json

from claimlake.sources.events import parse_events


def line(**change):
    event = {"schemaVersion": 2, "workflowId": "w", "runEventId": "r", "type": "tool_observed", "seq": 0, "toolId": "put", "params": {}} | change
    return json.dumps({k: v for k, v in event.items() if v != "drop"})


HITS = {"type": "retrieval", "source": "s", "status": "ok", "seq": "drop", "toolId": "drop", "params": "drop"}
LINES = [
    (line(), True), (line(schemaVersion=2.0), True), (line(schemaVersion="2"), False), (line(schemaVersion=3), False), (line(schemaVersion=None), False),
    (line(seq=1.0), True), (line(seq=1e2), True), (line(seq=0.5), False), (line(seq=-1), False), (line(seq="1"), False), (line(seq=2**62), True),
    (line(toolId=5), False), (line(toolId=""), False), (line(toolId=None), False), (line(toolId="drop"), False), (line(workflowId={"a": 1}), False),
    (line(params=[]), False), (line(params="{}"), False), (line(extra=1), False), (line(timestamp=""), True), (line(timestamp=7), False),
    (line(type=["tool_observed"]), False), (line(type="other"), False), ("[1]", False), ("{", False), ("5", False),
    (line(**HITS), True), (line(**HITS, hitCount=0), True), (line(**HITS, hitCount=1.5), False), (line(**HITS | {"status": "late"}), False),
    (line(schemaVersion=1, runEventId="drop"), True), (line(schemaVersion=1), False),
]


def test_validity_of_odd_fields(spark):
    rows = spark.createDataFrame([("f", i, x) for i, (x, _) in enumerate(LINES)], "source_file string, line_no bigint, line string")
    events = parse_events(rows)
    assert {r.line_no: r.valid for r in events.collect()} == {i: ok for i, (_, ok) in enumerate(LINES)}
    assert [r.seq for r in events.filter("valid and type = 'tool_observed'").orderBy("line_no").collect()] == [0, 0, 1, 100, 2**62, 0, 0]
    assert {r.ts for r in events.filter("valid").collect()} == {None, ""}


def test_texts_are_not_cast_from_variants(spark):
    rows = spark.createDataFrame([("f", 1, line())], "source_file string, line_no bigint, line string")
    plan = parse_events(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "workflowId as string" not in plan and "toolId as string" not in plan
