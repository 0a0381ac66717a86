"""Cases that earlier versions cut short or got wrong."""

import datetime as dt

from pyspark.sql import functions as F

from claimlake.functions import decisions as D
from claimlake.functions.phrases import user_phrase
from claimlake.functions.scalars import display_message, operational_message
from claimlake.plans import compare as C
from claimlake.plans import trace as T
from claimlake.sources import corpus as K


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_flat_keys(spark):
    keys = {"a.": "/a", "a.b[0]": "/a/b/0", "a[0]b": "/a/0/b", "[3]": "/3", "a/b.c~d": "/a~1b/c~0d", "x]": "/x]"}
    bad = {"": "EMPTY_KEY", "a..b": "INVALID_SYNTAX", ".a": "INVALID_SYNTAX", "a[x]": "INVALID_ARRAY_INDEX", "a[0": "INVALID_SYNTAX", "a.[]": "INVALID_ARRAY_INDEX"}
    for key, pointer in keys.items():
        assert one(spark, D.flat_key_pointer(F.lit(key))) == pointer and one(spark, D.flat_key_problem(F.lit(key))) is None, key
    for key, code in bad.items():
        assert one(spark, D.flat_key_pointer(F.lit(key))) is None and one(spark, D.flat_key_problem(F.lit(key))) == code, key


def test_trim_takes_tabs_and_wide_spaces(spark):
    uuid = "0b5f2a3c-1d2e-4f3a-8b4c-5d6e7f8a9b0c"
    assert one(spark, D.anon_id(F.lit(f"\t{uuid.upper()} \n"))) == uuid
    assert one(spark, D.hypothesis_label(F.lit("\tone label "))) in ("one label", None)
    assert one(spark, D.hypothesis_label(F.lit("\tone label\n"))) == "one label"


def test_texts_stay_whole(spark):
    long = "word " * 2000 + "end"
    assert one(spark, operational_message(F.lit(long))).endswith("end") and one(spark, display_message(F.lit(long))).endswith("...")
    assert one(spark, D.redact(F.lit(long))) == long and one(spark, D.redact(F.lit(long), shorten=True)) == f"[REDACTED_LONG_STRING_LEN_{len(long)}]"
    assert one(spark, user_phrase(F.lit("MAPPING_" + "X" * 300))) == "Mapping: " + "x" * 300 + "."


def test_run_index_keeps_all_codes_and_findings(spark):
    steps = spark.createDataFrame([("w", 0, i, "t", f"CODE_{i:02d}") for i in range(45)], "workflow_id string, run_index int, seq long, tool_id string, code string")
    postures = spark.createDataFrame([("w", 0, "inconsistent", "x")], "workflow_id string, run_index int, status string, category string")
    meta = spark.createDataFrame([("w", 0, None, dt.datetime(2024, 1, 1), None, None)], "workflow_id string, run_index int, customer_id string, captured_at timestamp, verified_at timestamp, modified_at timestamp")
    findings = spark.createDataFrame([("w", 0, "RETRIEVAL_EMPTY"), ("w", 0, "RETRIEVAL_EMPTY")], "workflow_id string, run_index int, code string")
    row = C.run_index(steps, postures, meta, findings)
    assert len(row.first()["reason_codes"]) == 45 and row.first()["finding_codes"] == ["RETRIEVAL_EMPTY"]
    assert C.run_list_filter(row, has_findings=True).count() == 1
    assert C.run_list_filter(C.run_index(steps, postures, meta), has_findings=True).count() == 0


def test_first_integrity_fault_follows_the_artifacts(spark):
    import hashlib
    import json

    body = {"workflow-result.json": b"{}", "events.ndjson": b"line"}
    entry = {n: {"relativePath": n, "sha256": hashlib.sha256(c).hexdigest(), "byteLength": len(c)} for n, c in body.items()}
    entry["workflow-result.json"]["byteLength"] += 1
    entry["events.ndjson"]["sha256"] = "0" * 64
    manifest = json.dumps({"runId": "r", "workflowId": "w", "artifacts": entry}).encode()
    rows = [("r", K.MANIFEST, manifest), *(("r", n, c) for n, c in body.items())]
    files = spark.createDataFrame([(*r, dt.datetime(2024, 1, 1)) for r in rows], "run_id string, name string, content binary, modified_at timestamp")
    assert K.load_corpus(files).first()["code"] == "ARTIFACT_LENGTH_MISMATCH"


def test_focus_targets_name_events(spark):
    rows = [("w", 3, "e3", None), ("w", 3, "e3", None), ("v", None, "", 7), ("u", None, None, None)]
    got = T.focus_targets(spark.createDataFrame(rows, "workflow_id string, ingest_index long, run_event_id string, seq long")).collect()
    assert {tuple(r) for r in got} == {("w", "ingestIndex:3"), ("w", "runEventId:e3"), ("v", "seq:7")}


def test_paths_are_harvested_under_obligations_only(spark):
    from claimlake.plans.harvest import harvest_paths, qualified

    text = (
        "---\na: 1\n---\nadd `src/x.ts`\n## Deliverables\r\n- Add [x](<../no/src/up.ts>), [y](/repo/src/deep/src/y.JSON) and `docs/d.md`. Nothing for `schemas/s.sql`\n"
        "same pattern: add `src/ref.ts`\n```\nadd `src/fence.ts`\n```lang\n```\n## Testing plan\nmust hold `test/t.ts`; Expect: `test/e.ts`\n## Notes\nadd `src/z.ts`\n")
    rows = [(1, text, ["update `plans/p.md`; e.g. update `plans/q.md`"]), (2, "no front matter\n## Testing\nadd `src/a.ts`", []), (3, None, None)]
    got = {tuple(r) for r in harvest_paths(spark.createDataFrame(rows, "doc_id long, text string, todos array<string>")).collect()}
    assert got == {(1, "src/y.json"), (1, "docs/d.md"), (1, "plans/p.md")}
    cases = {"file:///home/src/a%2Eb.ts": "src/a.b.ts", "./././docs/x.md": "docs/x.md", "src\\win\\a.js": "src/win/a.js", "src//a.ts": None, "src/a.exe": None, "lib/a.ts": None, "src/a.ts#l1": None}
    for raw, path in cases.items():
        assert one(spark, qualified(F.lit(raw))) == path, raw


def test_redaction_walks_json(spark):
    import json

    value = {"a": ["x@y.com", {"k": "Bearer abc", "n": 1.5, "z": None}], "sk": "sk-" + "a" * 20, "x@y.com": True}
    got = json.loads(one(spark, D.redact_json(F.lit(json.dumps(value)))))
    assert got == {"a": ["[REDACTED_EMAIL]", {"k": "[REDACTED_BEARER]", "n": 1.5, "z": None}], "sk": "[REDACTED_SK]", "x@y.com": True}
    assert one(spark, D.redact_json(F.lit("mail x@y.com {"))) == "mail [REDACTED_EMAIL] {" and one(spark, D.redact_json(F.lit(None).cast("string"))) is None
    assert json.loads(one(spark, D.redact_json(F.lit(json.dumps(["b" * 300])), shorten=True))) == ["[REDACTED_LONG_STRING_LEN_300]"]


def test_pages_follow_a_row(spark):
    from claimlake.operators.topk import page_after

    rows = [(i % 7 if i % 5 else None, i) for i in range(60)]
    df = spark.createDataFrame(rows, "a long, b long")
    for descending in (True, False):
        order = [("a", descending), ("b", False)]
        whole = [tuple(r) for r in df.orderBy(*[F.col(n).desc() if d else F.col(n).asc() for n, d in order]).collect()]
        seen, after = [], None
        while page := [tuple(r) for r in page_after(df, order, after, 13).collect()]:
            seen += page
            after = page[-1]
        assert seen == whole


def test_a_hot_seq_is_cut_into_blocks(spark):
    import random

    from claimlake.operators.steps import seq_positions, timestamp_regressions, with_seq_block

    rng = random.Random(4)
    rows = [("w", rng.choice("ab"), i * 300, 7 if i % 3 else rng.randrange(20), f"2024-01-01T00:{rng.randrange(60):02d}:00Z") for i in range(900)] + [("v", "a", i, i, None) for i in range(40)]
    df = spark.createDataFrame(rows, "workflow_id string, source_file string, line_no long, seq long, ts string")
    fine, coarse = with_seq_block(df, 100), with_seq_block(df)
    assert fine.groupBy("workflow_id", "seq_block").count().agg(F.max("count")).first()[0] < 500 and coarse.select("workflow_id", "seq_block").distinct().count() == 2
    key = lambda r: (r["workflow_id"], r["place"])
    listed = [tuple(r) for r in sorted(seq_positions(df, 100).collect(), key=key)]
    assert listed == [tuple(r) for r in sorted(seq_positions(df).collect(), key=key)]
    assert [r[1:4] for r in listed if r[0] == "w"] == [(f, n, s) for s, f, n in sorted((s, f, n) for w, f, n, s, _ in rows if w == "w")]
    assert timestamp_regressions(df, 100).collect() == timestamp_regressions(df).collect()
