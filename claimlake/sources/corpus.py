"""Saved runs: one folder per run with a manifest and its artifacts."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "agent-run.json"
ARTIFACTS = ["workflow-result.json", "events.ndjson"]


# Bytes of content and names that a task hands on at once.
_BATCH_BYTES, _BATCH_NAMES = 1 << 22, 10_000


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, name, content, modified_at) of every file below the corpus folder but empty ones and those of hidden names.

    Nothing is listed on the driver: one task hands on the names in the folder, and the tasks that get them list and read what is below.
    """
    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            system, folder = fs.FileSystem.from_uri(root)
            found = (e.name for e in os.scandir(folder)) if system.type_name == "local" else (i.base_name for i in system.get_file_info(fs.FileSelector(folder)))
            held = []
            for name in found:
                held.append(name)
                if len(held) == _BATCH_NAMES:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["entry"])
                    held = []
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["entry"])

    def hidden(name: str) -> bool:
        """What Spark's readers pass over."""
        return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")

    def below(system: fs.FileSystem, path: str) -> Iterator[fs.FileInfo]:
        info = system.get_file_info(path)
        found = system.get_file_info(fs.FileSelector(path, recursive=True)) if info.type == fs.FileType.Directory else [info]
        above = len(path) - len(info.base_name)
        return (i for i in found if i.type == fs.FileType.File and i.size and not any(map(hidden, i.path[above:].split("/"))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(root)
        schema = pa.schema([("run_id", pa.string()), ("name", pa.string()), ("content", pa.binary()), ("modified_at", pa.timestamp("us", "UTC"))])
        held, size = [], 0
        for entry in (e for batch in batches for e in batch.column(0).to_pylist()):
            for info in below(system, f"{folder.rstrip('/')}/{entry}"):
                with system.open_input_stream(info.path, compression=None) as file:
                    content = file.read()
                held.append((info.path.split("/")[-2], info.base_name, content, (info.mtime_ns or 0) // 1_000_000 * 1000))
                size += len(content)
                if size >= _BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    entries = spark.range(1, numPartitions=1).mapInArrow(names, "entry string").repartition(tasks, "entry")
    return entries.mapInArrow(read, "run_id string, name string, content binary, modified_at timestamp")


_SAFE_ID = r"^(?!\.{1,2}$)[A-Za-z0-9._-]+$"


def write_files(files: DataFrame, root: str) -> None:
    """Write (run_id, name, content) as root/run_id/name, where the rows are. A repeated task writes the same files again."""
    named = files.select(F.when(F.col("run_id").rlike(_SAFE_ID), F.col("run_id")).otherwise(F.raise_error(F.concat(F.lit("no folder name: "), F.coalesce("run_id", F.lit("null"))))).alias("run_id"), "name", "content")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(root)
        for batch in batches:
            for k in range(batch.num_rows):
                run, name, content = (c[k].as_py() for c in batch.columns)
                system.create_dir(f"{folder}/{run}", recursive=True)
                with system.open_output_stream(f"{folder}/{run}/{name}", compression=None) as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    named.mapInArrow(put, "n long").write.format("noop").mode("overwrite").save()


def save_runs(runs: DataFrame, root: str) -> None:
    """Write run bundles: (run_id, workflow_id, customer_id, captured_at, result, events), texts, as folders that read_corpus reads.

    All artifacts are written before any manifest is, so what a job leaves behind when it breaks off are folders without a manifest.
    """
    data = lambda c: F.encode(F.coalesce(c, F.lit("")), "UTF-8")
    wide = runs.select("run_id", F.inline(F.array(*[F.struct(F.lit(name).alias("name"), data(c).alias("content")) for name, c in zip(ARTIFACTS, ("result", "events"), strict=True)])))
    write_files(wide, root)

    def entry(name: str, c: str) -> Column:
        return F.struct(F.lit(name).alias("relativePath"), F.sha2(data(c), 256).alias("sha256"), F.octet_length(data(c)).cast("long").alias("byteLength"))

    manifest = F.to_json(F.struct(
        F.lit(1).alias("schemaVersion"), F.col("run_id").alias("runId"), F.col("workflow_id").alias("workflowId"), F.col("customer_id").alias("customerId"), F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("capturedAt"),
        F.struct(entry(ARTIFACTS[0], "result").alias("workflowResult"), entry(ARTIFACTS[1], "events").alias("events")).alias("artifacts")))
    write_files(runs.select("run_id", F.lit(MANIFEST).alias("name"), F.encode(manifest, "UTF-8").alias("content")), root)


def _declared(manifest: Column) -> Column:
    return F.from_json(F.get_json_object(manifest, "$.artifacts"), "map<string,struct<relativePath:string,sha256:string,byteLength:bigint>>")


def manifest_entries(files: DataFrame) -> DataFrame:
    """(run_id, name, sha256, byte_length) that each manifest declares."""
    text = F.decode("content", "UTF-8")
    listed = files.filter(F.col("name") == MANIFEST).select("run_id", F.explode(_declared(text)))
    return listed.select("run_id", F.col("value.relativePath").alias("name"), F.col("value.sha256").alias("sha256"), F.col("value.byteLength").alias("byte_length"))


def artifact_integrity(files: DataFrame) -> DataFrame:
    """Declared length, then declared hash, of every artifact; hashes are computed where the file is read. Spark lists no empty files, so
    an artifact declared empty counts as there."""
    actual = files.select("run_id", "name", F.length("content").alias("bytes"), F.sha2("content", 256).alias("hash"))
    joined = manifest_entries(files).join(actual, ["run_id", "name"], "left").withColumns({
        "hash": F.when(F.col("bytes").isNull() & (F.col("byte_length") == 0), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("hash")),
        "bytes": F.when(F.col("bytes").isNull() & (F.col("byte_length") == 0), 0).otherwise(F.col("bytes"))})
    return joined.select(
        "run_id", "name",
        F.when(F.col("bytes").isNull(), "ARTIFACT_MISSING").when(F.col("bytes") != F.col("byte_length"), "ARTIFACT_LENGTH_MISMATCH")
        .when(F.col("hash") != F.lower("sha256"), "ARTIFACT_INTEGRITY_MISMATCH").alias("code"))


def load_corpus(files: DataFrame) -> DataFrame:
    """One row per run folder: ok with its result text, or the first problem in load order."""
    pick = lambda n: F.max(F.when(F.col("name") == n, F.decode("content", "UTF-8")))
    # the events file is only asked for: its content stays out of the shuffle
    files_ = files.withColumn("content", F.when(F.col("name") != ARTIFACTS[1], F.col("content")))
    runs = files_.filter(F.col("name").isin(MANIFEST, *ARTIFACTS)).groupBy("run_id").agg(
        pick(MANIFEST).alias("manifest"), pick(ARTIFACTS[0]).alias("result"), F.bool_or(F.col("name") == ARTIFACTS[1]).alias("events"), F.max("modified_at").alias("modified_at"))
    of = lambda n: F.max(F.when(F.col("name") == n, F.col("code")))
    broken = artifact_integrity(files).filter("code is not null").groupBy("run_id").agg(of(ARTIFACTS[0]).alias("result_code"), of(ARTIFACTS[1]).alias("events_code"))
    parsed = lambda c: F.try_parse_json(c).isNull()
    doc = lambda p: F.get_json_object("manifest", p)
    no_events = F.exists(F.map_values(_declared(F.col("manifest"))), lambda v: (v["relativePath"] == ARTIFACTS[1]) & (v["byteLength"] == 0))
    code = (
        F.when(F.col("manifest").isNull(), "MISSING_AGENT_RUN").when(parsed("manifest"), "AGENT_RUN_JSON_SYNTAX")
        .when(doc("$.runId").isNull() | doc("$.workflowId").isNull() | doc("$.artifacts").isNull(), "AGENT_RUN_INVALID")
        .when(doc("$.runId") != F.col("run_id"), "RUN_ID_MISMATCH")
        .when(F.col("result").isNull(), "MISSING_WORKFLOW_RESULT").when(F.col("result_code").isNotNull(), F.col("result_code"))
        .when(~F.col("events") & ~F.coalesce(no_events, F.lit(False)), "MISSING_EVENTS").when(F.col("events_code").isNotNull(), F.col("events_code"))
        .when(parsed("result"), "WORKFLOW_RESULT_JSON_SYNTAX")
        .when(F.get_json_object("result", "$.workflowId") != doc("$.workflowId"), "WORKFLOW_RESULT_WORKFLOW_ID_MISMATCH")
    )
    return runs.join(broken, "run_id", "left").select(
        "run_id", code.alias("code"), F.when(code.isNull(), "ok").otherwise("error").alias("load_status"), doc("$.workflowId").alias("workflow_id"),
        doc("$.customerId").alias("customer_id"), F.try_to_timestamp(doc("$.capturedAt")).alias("captured_at"), F.try_to_timestamp(doc("$.verifiedAt")).alias("verified_at"),
        "modified_at", F.when(code.isNull(), F.col("result")).alias("result"))


def write_bundles(results: DataFrame, folder: str) -> DataFrame:
    """Write result rows (run_id, workflow_id, payload) as parquet by workflow bucket, with hash and length beside each payload."""
    signed = results.withColumn("sha256", F.sha2("payload", 256)).withColumn("byte_length", F.octet_length("payload")).withColumn(
        "bucket", F.pmod(F.xxhash64("workflow_id"), F.lit(64)))
    signed.write.mode("overwrite").partitionBy("bucket").parquet(folder)
    return results.sparkSession.read.parquet(folder)
