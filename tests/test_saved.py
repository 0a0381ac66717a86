"""Bundles are written and read back; torn ones say so."""

import json
import os

import pytest

from claimlake.sources import corpus as K

RUNS = "run_id string, workflow_id string, customer_id string, captured_at timestamp, result string, events string"


def save(spark, root, *rows):
    import datetime as dt

    K.save_runs(spark.createDataFrame([(i, w, None, dt.datetime(2024, 1, 1), json.dumps({"workflowId": w, "status": "complete"}), e) for i, w, e in rows], RUNS).repartition(3), str(root))


def codes(spark, root):
    return {r.run_id: (r.code, r.workflow_id) for r in K.load_corpus(K.read_corpus(spark, str(root))).collect()}


def test_saved_runs_are_loaded(spark, tmp_path):
    save(spark, tmp_path, ("a", "w", "one\ntwo é"), ("b.1", "w2", None), ("c", "w", "x" * 200_000))
    assert codes(spark, tmp_path) == {"a": (None, "w"), "b.1": (None, "w2"), "c": (None, "w")}
    assert (tmp_path / "a" / "events.ndjson").read_text() == "one\ntwo é"
    said = json.loads((tmp_path / "a" / K.MANIFEST).read_text())
    assert said["runId"] == "a" and said["artifacts"]["events"]["byteLength"] == len("one\ntwo é".encode()) and said["capturedAt"] == "2024-01-01T00:00:00Z"
    save(spark, tmp_path, ("a", "w", "again"))  # a repeated job
    assert codes(spark, tmp_path)["a"] == (None, "w")


def test_corpus_is_listed_in_tasks(spark, tmp_path):
    """The rows are those of Spark's file reader, without a list of the files on the driver."""
    save(spark, tmp_path, *[(f"r{k}", "w", "x" * k) for k in range(9)], ("_hidden", "w", "x"))
    (tmp_path / "r1" / "deep").mkdir()
    (tmp_path / "r1" / "deep" / "more.txt").write_text("m")
    (tmp_path / "r1" / ".crc").write_text("m")
    (tmp_path / "loose.txt").write_text("l")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    want = sorted((*r.path.split("/")[-2:], bytes(r.content), r.modificationTime) for r in files.collect())
    read = K.read_corpus(spark, str(tmp_path))
    assert sorted((r.run_id, r.name, bytes(r.content), r.modified_at) for r in read.collect()) == want and len(want) > 20
    assert not read.inputFiles()


def test_torn_bundles_have_codes(spark, tmp_path):
    save(spark, tmp_path, *[(k, "w", "events") for k in "abcdef"])
    os.remove(tmp_path / "a" / K.MANIFEST)
    os.remove(tmp_path / "b" / "events.ndjson")
    (tmp_path / "c" / "events.ndjson").write_text("EVENTS")
    (tmp_path / "d" / "workflow-result.json").write_text("{}")
    (tmp_path / "e" / K.MANIFEST).write_text('{"runId": "e", "workflow')
    assert {k: c for k, (c, _) in codes(spark, tmp_path).items()} == {
        "a": "MISSING_AGENT_RUN", "b": "MISSING_EVENTS", "c": "ARTIFACT_INTEGRITY_MISMATCH", "d": "ARTIFACT_LENGTH_MISMATCH", "e": "AGENT_RUN_JSON_SYNTAX", "f": None}


def test_manifests_come_last(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.range(6).select(F.concat(F.lit("r"), "id").alias("run_id"), F.lit("w").alias("workflow_id"), F.lit(None).cast("string").alias("customer_id"), F.lit("2024-01-01").cast("timestamp").alias("captured_at"),
                                 F.lit("{}").alias("result"), F.when(F.col("id") == 4, F.raise_error(F.lit("lost"))).otherwise("x").alias("events"))
    with pytest.raises(Exception, match="lost"):
        K.save_runs(rows.repartition(2), str(tmp_path))
    assert not list(tmp_path.glob(f"*/{K.MANIFEST}"))


@pytest.mark.parametrize("name", ["../up", "a/b", "..", "", None])
def test_names_that_are_no_folder_are_refused(spark, tmp_path, name):
    with pytest.raises(Exception, match="no folder name"):
        K.write_files(spark.createDataFrame([(name, "x", b"")], "run_id string, name string, content binary"), str(tmp_path))
