"""Run event logs: NDJSON lines to typed events, with validity and per-file counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.functions.stage import sealed
from claimlake.operators.skew import block_positions

# Per event type, the required fields, the optional fields and the closed value lists.
EVENT_SHAPES = {
    (1, "tool_observed"): (["seq", "toolId", "params"], ["timestamp"]),
    (2, "tool_observed"): (["runEventId", "seq", "toolId", "params"], ["parentRunEventId", "timestamp"]),
    (2, "model_turn"): (["runEventId", "status"], ["parentRunEventId", "summary", "timestamp"]),
    (2, "retrieval"): (["runEventId", "source", "status"], ["parentRunEventId", "querySummary", "hitCount", "timestamp"]),
    (2, "control"): (["runEventId", "controlKind"], ["parentRunEventId", "label", "decision", "timestamp"]),
    (2, "tool_skipped"): (["runEventId", "toolId", "reason"], ["parentRunEventId", "timestamp"]),
}
ENUMS = {
    "model_turn": {"status": ["completed", "error", "aborted", "incomplete"]},
    "retrieval": {"status": ["ok", "empty", "error"]},
    "control": {"controlKind": ["branch", "loop", "interrupt", "gate", "run_completed"], "decision": ["taken", "skipped"]},
}
NON_EMPTY = ["workflowId", "runEventId", "parentRunEventId", "toolId", "source"]

# Lines per block when positions are counted inside one workflow.
LINES_PER_BLOCK = 1 << 20


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, line_no, line) from text files, in file order.

    Spark splits large files, so a line's place is its byte-ordered place inside its split plus
    the split's own order; both rise with the position in the file.
    """
    raw = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("task_order"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    )
    # task_order rises inside a split; block_start orders the splits of one file.
    within = F.col("task_order").bitwiseAND(F.lit((1 << 33) - 1))
    return raw.select("source_file", (F.col("block_start") * F.lit(4) + within).alias("line_no"), "line").filter(
        F.trim("line") != ""
    )


FIELDS = [
    "schemaVersion", "workflowId", "type", "runEventId", "parentRunEventId", "seq", "toolId", "params", "status", "source",
    "hitCount", "controlKind", "decision", "label", "reason", "timestamp", "summary", "querySummary",
]


def _quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


TEXTS = [f for f in FIELDS if f not in ("schemaVersion", "seq", "hitCount", "params")]


def _field_ok(name: str) -> str:
    """The field is missing, or its value has the declared type and range; on its kind k and its text t."""
    kind, text = f"k.{name}", f"t.{name}"
    if name in ("seq", "hitCount"):
        value = f"cast(e.{name} as double)"
        ok = f"if({kind} = 'BIGINT', cast(e.{name} as bigint) >= 0, {kind} rlike '^(DECIMAL|DOUBLE)' and {value} >= 0 and {value} = floor({value}))"
    elif name == "params":
        ok = f"startswith({kind}, 'OBJECT')"
    elif name in ("controlKind", "decision"):
        ok = f"({kind} = 'STRING' and {text} in ({_quoted(ENUMS['control'][name])}))"
    elif name == "status":
        ok = (
            f"({kind} = 'STRING' and case t.type when 'model_turn' then {text} in ({_quoted(ENUMS['model_turn']['status'])})"
            f" when 'retrieval' then {text} in ({_quoted(ENUMS['retrieval']['status'])}) end)"
        )
    elif name in NON_EMPTY:
        ok = f"({kind} = 'STRING' and {text} <> '')"
    else:
        ok = f"{kind} = 'STRING'"
    return f"({kind} is null or coalesce({ok}, false))"


def event_valid() -> Column:
    """The closed union over (schemaVersion, type), on columns keys, e (a struct of variants), k (their kinds), t (texts) and shape."""
    def lists(pick) -> str:
        return "case shape " + " ".join(
            f"when '{version}:{type_name}' then array({_quoted(['schemaVersion', 'workflowId', 'type', *pick(required, optional)])})"
            for (version, type_name), (required, optional) in EVENT_SHAPES.items()
        ) + " end"

    allowed = lists(lambda required, optional: [*required, *optional])
    required = lists(lambda required, optional: required)
    fields = " and ".join(_field_ok(f) for f in FIELDS if f not in ("schemaVersion", "type"))
    return F.expr(f"coalesce(size(array_except(keys, {allowed})) = 0 and size(array_except({required}, keys)) = 0 and {fields}, false)")


def parse_events(lines: DataFrame) -> DataFrame:
    """One row per non-blank line with its typed fields and a `valid` flag; bad lines are kept.

    A line is read twice: as texts, and as variants, which tell a text from a number or an object. Casting a variant to text costs
    more than reading the line again.
    """
    variants = ", ".join(f"{f} VARIANT" for f in FIELDS)
    texts = ", ".join(f"{f} STRING" for f in TEXTS)
    doc = sealed(lines.filter("trim(line) != ''").selectExpr(
        "source_file", "line_no", f"from_json(line, '{variants}') as e", f"from_json(line, '{texts}') as t", "json_object_keys(line) as keys",
    ))
    version = (
        "case when k.schemaVersion = 'BIGINT' then cast(cast(e.schemaVersion as bigint) as string)"
        " when k.schemaVersion rlike '^(DECIMAL|DOUBLE)' then case cast(e.schemaVersion as double) when 1.0 then '1' when 2.0 then '2' end end"
    )
    kinds = sealed(doc.selectExpr("*", "named_struct(" + ", ".join(f"'{f}', schema_of_variant(e.{f})" for f in FIELDS) + ") as k"))
    shaped = sealed(kinds.selectExpr("*", f"concat({version}, ':', if(k.type = 'STRING', t.type, null)) as shape"))
    parsed = sealed(shaped.select("source_file", "line_no", "e", "t", event_valid().alias("valid")))
    text = {
        "workflow_id": "workflowId", "run_event_id": "runEventId", "parent_run_event_id": "parentRunEventId", "type": "type",
        "tool_id": "toolId", "status": "status", "source": "source", "control_kind": "controlKind", "decision": "decision",
        "label": "label", "reason": "reason", "ts": "timestamp",
    }
    number = {"schema_version": "schemaVersion", "seq": "seq", "hit_count": "hitCount"}
    return parsed.selectExpr(
        "source_file", "line_no", "valid",
        *[f"case when valid then t.{f} end as {n}" for n, f in text.items()],
        *[f"case when valid then cast(e.{f} as bigint) end as {n}" for n, f in number.items()],
        "case when valid then to_json(e.params) end as params",
    )


def file_counts(events: DataFrame) -> DataFrame:
    """Per file: non-empty lines, valid events, malformed lines, tool observations."""
    return events.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("non_empty_lines"),
        F.count_if("valid").alias("valid_events"),
        F.count_if(~F.col("valid")).alias("malformed_lines"),
        F.count_if(F.col("type") == "tool_observed").alias("tool_observed"),
    )


def workflow_counts(events: DataFrame) -> DataFrame:
    """Per (file, workflow): own observations and those of the file's other workflows."""
    own = events.filter("valid").groupBy("source_file", "workflow_id").agg(
        F.count_if(F.col("type") == "tool_observed").alias("tool_observed_own")
    )
    return own.join(file_counts(events), "source_file").select(
        "source_file",
        "workflow_id",
        "non_empty_lines",
        "valid_events",
        "malformed_lines",
        "tool_observed_own",
        (F.col("tool_observed") - F.col("tool_observed_own")).alias("tool_observed_others"),
    )


def with_ingest_index(events: DataFrame) -> DataFrame:
    """0-based place of each valid event inside its workflow, in capture order."""
    return block_positions(
        events.filter("valid"),
        ["workflow_id"],
        F.struct("source_file", F.floor(F.col("line_no") / LINES_PER_BLOCK).alias("b")),
        ["line_no"],
        "ingest_index",
    )
