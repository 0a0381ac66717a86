"""Why a workflow failed: run context, upstream causes, origin, category and path findings."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.functions.catalog import ROLLUP_CODES, STATUS_RANK, RESOLVER_CODES, catalog_rows
from claimlake.functions.stage import sealed
from claimlake.operators.rollup import trust_line
from claimlake.operators.skew import lookup_join
from claimlake.plans.verify import Verification
from claimlake.session import stored
from claimlake.sources.events import with_ingest_index

BAD_TURNS = ["error", "aborted", "incomplete"]

# How a reason reads as an alternative explanation.
ALTERNATIVES = {
    "ROW_ABSENT": [
        ("downstream_system_state", "The database has no row at the verified key; the tool log may not have committed a write, or replication lag prevented observation."),
        ("tool_use", "The database has no row at the verified key; the registry key/value or pointer resolution from tool params may not match the row that was written."),
    ],
    "VALUE_MISMATCH": [
        ("downstream_system_state", "Stored column values differ from required fields; the live database state may have diverged from what the tool reported."),
        ("inputs", "Stored column values differ from required fields; registry pointers or consts used to build the verification request may not match the observation payload."),
    ],
    "BRANCH_SKIPPED": [
        ("workflow_flow", "A branch or gate was skipped earlier in capture order; sequencing or capture may also explain the later verification outcome."),
    ],
}


def reason_catalog(spark: SparkSession) -> DataFrame:
    """code -> scope, origin, category, action. A fixed list of under a hundred rows."""
    return F.broadcast(spark.createDataFrame(catalog_rows(), "code string, scope string, origin string, category string, action string"))


def context_code() -> Column:
    """The run-context code an event stands for, null for ordinary events."""
    kind, decision = F.col("control_kind"), F.col("decision")
    return (
        F.when((F.col("type") == "retrieval") & (F.col("status") == "error"), "RETRIEVAL_ERROR")
        .when((F.col("type") == "model_turn") & F.col("status").isin(BAD_TURNS), F.concat(F.lit("MODEL_TURN_"), F.upper("status")))
        .when(kind == "interrupt", "CONTROL_INTERRUPT")
        .when(kind.isin("branch", "gate") & (decision == "skipped"), F.concat(F.lit("CONTROL_"), F.upper(kind), F.lit("_SKIPPED")))
        .when(F.col("type") == "tool_skipped", "TOOL_SKIPPED")
    )


def run_context(indexed: DataFrame) -> DataFrame:
    """Digest per workflow in one aggregation; the event lists themselves stay rows of the event table."""
    kind = F.col("type")
    return indexed.groupBy("workflow_id").agg(
        F.max("schema_version").alias("max_wire"),
        *[F.count_if(kind == t).alias(f"n_{t}") for t in ("retrieval", "control", "model_turn", "tool_skipped", "tool_observed")],
        F.min(F.when(kind == "tool_observed", F.col("ingest_index"))).alias("first_tool_index"),
        F.coalesce(F.bool_or(F.col("control_kind") == "run_completed"), F.lit(False)).alias("run_completed"),
        F.max_by(F.struct("ingest_index", "type", "status", "control_kind"), "ingest_index").alias("last"),
    ).select(
        "*", F.col("last.ingest_index").alias("last_index"), F.col("last.type").alias("last_type"), F.col("last.status").alias("last_status"),
        F.coalesce((F.col("last.type") == "control") & (F.col("last.control_kind") == "run_completed"), F.lit(False)).alias("ends_completed"),
    ).drop("last")


def primary_code() -> Column:
    """A step's own code, or under a rolled-up code the first failing effect's."""
    failing = F.try_element_at(F.filter("effects", lambda e: e["status"] != "verified"), F.lit(1))
    return F.when(F.col("code").isin(ROLLUP_CODES), F.coalesce(failing["code"], F.col("code"))).otherwise(F.coalesce(F.col("code"), F.lit("STEP_NO_REASON")))


def driver_steps(steps: DataFrame) -> DataFrame:
    """Worst failing step per workflow: by status rank, then seq, then tool. One min per workflow."""
    rank = F.lit(99)
    for status, r in STATUS_RANK.items():
        rank = F.when(F.col("status") == status, F.lit(r)).otherwise(rank)
    failing_effect = F.try_element_at(F.filter("effects", lambda e: e["status"] != "verified"), F.lit(1))
    worst = steps.filter("status <> 'verified'").groupBy("workflow_id").agg(
        F.min(F.struct(rank.alias("rank"), "seq", "tool_id", "status", primary_code().alias("primary_code"), F.col("code").alias("step_code"),
                       failing_effect["id"].alias("effect_id"))).alias("d")
    )
    return worst.select("workflow_id", *[F.col(f"d.{c}").alias(f"driver_{c}") for c in ("seq", "tool_id", "status", "primary_code", "step_code", "effect_id")])


def failure_frontier(steps: DataFrame, indexed: DataFrame) -> DataFrame:
    """Smallest capture index at which a failing step was last observed."""
    last = indexed.filter("type = 'tool_observed'").groupBy("workflow_id", "seq").agg(F.max("ingest_index").alias("last_index"))
    failing = steps.filter("status <> 'verified'").select("workflow_id", "seq")
    return failing.join(last, ["workflow_id", "seq"]).groupBy("workflow_id").agg(F.min("last_index").alias("frontier"))


def upstream_causes(indexed: DataFrame, frontier: DataFrame) -> DataFrame:
    """First upstream event before the frontier, by kind precedence and then capture order."""
    suspects = sealed(indexed.withColumn("context_code", context_code())).filter("context_code is not null")
    code = F.col("context_code")
    phase = (
        F.when(code == "RETRIEVAL_ERROR", 1).when(code.startswith("MODEL_TURN"), 2).when(code == "CONTROL_INTERRUPT", 3)
        .when(code.startswith("CONTROL_"), 4).otherwise(5)
    )
    before = lookup_join(
        suspects.select("workflow_id", "ingest_index", "run_event_id", "context_code", "source", "tool_id"), frontier, ["workflow_id"], "inner"
    ).filter(F.col("ingest_index") < F.col("frontier"))
    first = before.groupBy("workflow_id").agg(F.min(F.struct(phase.alias("phase"), "ingest_index", "context_code", "run_event_id", "source", "tool_id")).alias("u"), F.max("frontier").alias("frontier"))
    return first.select("workflow_id", "frontier", *[F.col(f"u.{c}").alias(n) for c, n in (
        ("phase", "cause_phase"), ("ingest_index", "cause_index"), ("context_code", "cause_code"), ("run_event_id", "cause_event"), ("source", "cause_source"), ("tool_id", "cause_tool"))])


@dataclass
class Diagnosis:
    """Failure analysis over one verification run."""

    spark: SparkSession
    run: Verification

    @cached_property
    def indexed(self) -> DataFrame:
        return with_ingest_index(self.run.events)

    @cached_property
    def context(self) -> DataFrame:
        return run_context(self.indexed)

    @cached_property
    def frontier(self) -> DataFrame:
        return failure_frontier(self.run.steps, self.indexed)

    @cached_property
    def causes(self) -> DataFrame:
        return upstream_causes(self.indexed, self.frontier)

    @cached_property
    def analysis(self) -> DataFrame:
        """Origin, confidence, category, severity and action per workflow that is not complete."""
        open_ = self.run.workflows.filter("status <> 'complete'")
        rows = (
            open_.join(self.causes, "workflow_id", "left")
            .join(self.run.integrity, "workflow_id", "left")
            .join(driver_steps(self.run.steps), "workflow_id", "left")
        )
        run_level = F.col("malformed") | F.col("no_steps")
        irregular = F.coalesce(F.col("capture_irregular") | F.col("timestamp_irregular"), F.lit(False))
        phase = (
            F.when(run_level, "p0").when(F.col("cause_phase") == 1, "p1").when(F.col("cause_phase").isin(2, 3), "p2")
            .when(F.col("cause_phase") == 4, "p2b").when(F.col("cause_phase") == 5, "p3").when(irregular, "p4").otherwise("p5")
        )
        code = (
            F.when(F.col("malformed"), "MALFORMED_EVENT_LINE").when(F.col("no_steps"), "NO_STEPS_FOR_WORKFLOW")
            .when(F.col("cause_phase").isNotNull(), F.col("cause_code"))
            .when(F.coalesce(F.col("capture_irregular"), F.lit(False)), "CAPTURE_ORDER_NOT_MONOTONIC_IN_SEQ")
            .when(irregular, "TIMESTAMP_NOT_MONOTONIC_WITH_SEQ_SORT_ORDER")
            .otherwise(F.col("driver_primary_code"))
        )
        coded = sealed(rows.select("*", phase.alias("phase"), code.alias("lead_code")))
        known = coded.join(reason_catalog(self.spark).withColumnRenamed("code", "lead_code"), "lead_code", "left")
        two_run_codes = F.col("malformed") & F.col("no_steps")
        alternatives = ((F.col("phase") == "p5") & F.col("lead_code").isin("ROW_ABSENT", "VALUE_MISMATCH")) | (F.col("phase") == "p2b")
        confidence = (
            F.when(F.col("origin").isNull(), "low").when((F.col("phase") == "p0") & two_run_codes, "medium")
            .when(alternatives | (F.col("phase") == "p3"), "medium").otherwise("high")
        )
        bad = F.col("n_missing") + F.col("n_inconsistent") + F.col("n_partially_verified") > 0
        judged = sealed(known.select(
            "workflow_id", "status", "phase", "lead_code", F.coalesce("origin", F.lit("workflow_flow")).alias("origin"), confidence.alias("confidence"),
            F.when(F.col("origin").isNull(), "unclassified").when(alternatives, "ambiguous").otherwise(F.col("category")).alias("category"),
            F.when((F.col("status") == "inconsistent") | bad, "high").otherwise("medium").alias("severity"),
            F.when(F.col("origin").isNull() | alternatives, "manual_review").otherwise(F.col("action")).alias("action"),
            "malformed", "no_steps", "capture_irregular", "timestamp_irregular", "seq_before", "seq_after", "cause_index", "cause_event", "cause_source", "cause_tool", "frontier",
            trust_line(irregular).alias("trust"), "driver_seq", "driver_tool_id", "driver_status", "driver_step_code", "driver_effect_id",
        ))
        return judged.withColumn("summary", analysis_summary())

    @cached_property
    def evidence(self) -> DataFrame:
        """What each analysis rests on, one row for each item: workflow_id, scope, ingest_index, run_event_id, seq, tool_id, code."""
        none = lambda kind: F.lit(None).cast(kind)
        # read twice below, so the narrow rows are written and their shuffles are done once
        judged = stored(self.analysis.select("workflow_id", "phase", "lead_code", "cause_index", "cause_event", "driver_seq", "driver_tool_id", "frontier"))
        lead = judged.select(
            "workflow_id",
            F.when(F.col("phase") == "p0", "run_level").when(F.col("phase").isin("p2", "p2b", "p3"), "run_context").when(F.col("phase") == "p4", "event_sequence")
            .when(F.col("phase") == "p5", "step").alias("scope"),
            F.when(F.col("phase").isin("p2", "p2b", "p3"), F.col("cause_index")).alias("ingest_index"),
            F.when(F.col("phase").isin("p2", "p2b"), F.col("cause_event")).alias("run_event_id"),
            F.when(F.col("phase") == "p5", F.col("driver_seq")).alias("seq"),
            F.when(F.col("phase") == "p5", F.col("driver_tool_id")).alias("tool_id"), F.col("lead_code").alias("code")).filter("scope is not null")
        # every failed retrieval before the frontier is evidence, not only the first
        retrievals = lookup_join(
            self.indexed.filter("type = 'retrieval' and status = 'error'").select("workflow_id", "ingest_index", "run_event_id"),
            judged.filter("phase = 'p1'").select("workflow_id", "frontier"), ["workflow_id"], "inner").filter("ingest_index < frontier")
        return lead.unionByName(retrievals.select(
            "workflow_id", F.lit("run_context").alias("scope"), "ingest_index", "run_event_id", none("bigint").alias("seq"), none("string").alias("tool_id"), F.lit("RETRIEVAL_ERROR").alias("code")))

    @cached_property
    def findings(self) -> DataFrame:
        return path_findings(self.indexed, self.context, self.run.steps, self.run.workflows, self.run.integrity)


def analysis_summary() -> Column:
    """One sentence naming the phase that explains the failure."""
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    phase, origin = F.col("phase"), F.col("origin")
    codes = F.concat_ws(", ", F.when(F.col("malformed"), "MALFORMED_EVENT_LINE"), F.when(F.col("no_steps"), "NO_STEPS_FOR_WORKFLOW"))
    rolled = F.when(F.col("driver_step_code").isin(ROLLUP_CODES),
                    " Multi-effect verification: authoritative per-effect outcomes are under workflowTruthReport.steps[].effects.").otherwise("")
    return (
        F.when(phase == "p0", say("Run-level ingest or planning issue (", codes, "); origin: ", origin, "."))
        .when(phase == "p1", say("A retrieval step failed before the failing tool observation (", F.coalesce("cause_source", F.lit("retrieval error")), "); origin: retrieval."))
        .when(phase == "p2", say("A model or control event indicates the run did not complete normally before the failing tool observation; origin: ", origin, "."))
        .when(phase == "p2b", F.lit("A branch or gate was skipped before the failing tool observation; decision-making may explain downstream behavior (see alternatives)."))
        .when(phase == "p3", F.lit("A tool was skipped before the failing tool observation; origin: tool_use."))
        .when(phase == "p4", say("Event capture order or timestamps were irregular (", F.col("lead_code"), "); origin: workflow_flow."))
        .otherwise(say("Primary failure at seq ", F.col("driver_seq").cast("string"), " tool ", F.col("driver_tool_id"), " (code ", F.col("lead_code"),
                       "); origin: ", origin, ".", rolled))
    )


# Severity and concern of each path finding.
FINDINGS = {
    "RUN_LEVEL_INGEST_ISSUES": ("high", "capture_integrity"),
    "EVENT_SEQUENCE_IRREGULAR": ("medium", "capture_integrity"),
    "RETRIEVAL_EMPTY": ("high", "context_quality"),
    "RETRIEVAL_ERROR": ("high", "context_quality"),
    "RETRIEVAL_THIN_HITS": ("medium", "context_quality"),
    "NO_RETRIEVAL_EVENTS": ("low", "context_quality"),
    "MODEL_TURN_ABNORMAL": ("high", "decision_execution"),
    "CONTROL_INTERRUPT": ("high", "decision_execution"),
    "BRANCH_OR_GATE_SKIPPED": ("medium", "decision_execution"),
    "TOOL_SKIPPED": ("medium", "tool_selection_execution"),
    "ACTION_INPUT_RESOLUTION_FAILED": ("high", "action_inputs_invalid"),
    "RETRY_OBSERVATIONS_DIVERGE": ("medium", "workflow_completeness"),
    "LOGICAL_STEP_RETRIES": ("low", "workflow_completeness"),
    "MISSING_RUN_COMPLETED": ("medium", "workflow_completeness"),
    "LAST_EVENT_MODEL_ABNORMAL": ("high", "workflow_completeness"),
}


def path_findings(indexed: DataFrame, context: DataFrame, steps: DataFrame, workflows: DataFrame, integrity: DataFrame) -> DataFrame:
    """Concerns along the run path: per event, per step and per workflow.

    Rows of the three parts cannot repeat each other: events differ in index, steps in seq, and
    workflow findings have neither, so no de-duplication shuffle is needed.
    """
    status, kind = F.col("status"), F.col("control_kind")
    event_code = (
        F.when((F.col("type") == "retrieval") & (status == "empty"), "RETRIEVAL_EMPTY")
        .when((F.col("type") == "retrieval") & (status == "error"), "RETRIEVAL_ERROR")
        .when((F.col("type") == "retrieval") & (F.col("hit_count") == 0), "RETRIEVAL_THIN_HITS")
        .when((F.col("type") == "model_turn") & status.isin(BAD_TURNS), "MODEL_TURN_ABNORMAL")
        .when(kind == "interrupt", "CONTROL_INTERRUPT")
        .when(kind.isin("branch", "gate") & (F.col("decision") == "skipped"), "BRANCH_OR_GATE_SKIPPED")
        .when(F.col("type") == "tool_skipped", "TOOL_SKIPPED")
    )
    none_long, none_text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    events = sealed(indexed.select(
        "workflow_id", event_code.alias("code"), "ingest_index", none_long.alias("seq"),
        F.when(F.col("type") == "tool_skipped", F.col("tool_id")).alias("tool_id"))).filter("code is not null")

    input_failed = (status == "incomplete_verification") & F.col("code").isin(["UNKNOWN_TOOL", *RESOLVER_CODES])
    diverged = (status == "incomplete_verification") & (F.col("code") == "RETRY_OBSERVATIONS_DIVERGE")
    step_codes = F.array_compact(F.array(
        F.when(input_failed, "ACTION_INPUT_RESOLUTION_FAILED").when(diverged, "RETRY_OBSERVATIONS_DIVERGE"),
        F.when(F.col("repeat_count") > 1, "LOGICAL_STEP_RETRIES")))
    stepwise = steps.select("workflow_id", F.explode(step_codes).alias("code"), none_long.alias("ingest_index"), "seq", "tool_id")

    per_workflow = workflows.select("workflow_id", "malformed", "no_steps").join(context, "workflow_id").join(
        integrity.select("workflow_id", "capture_irregular", "timestamp_irregular"), "workflow_id", "left")
    traced = (F.col("max_wire") == 2) & F.col("first_tool_index").isNotNull()
    workflow_codes = F.array_compact(F.array(
        F.when(F.col("malformed") | F.col("no_steps"), "RUN_LEVEL_INGEST_ISSUES"),
        F.when(F.col("capture_irregular") | F.col("timestamp_irregular"), "EVENT_SEQUENCE_IRREGULAR"),
        F.when(traced & (F.col("n_retrieval") == 0), "NO_RETRIEVAL_EVENTS"),
        F.when(traced & ~F.col("run_completed"), "MISSING_RUN_COMPLETED"),
        F.when((F.col("last_type") == "model_turn") & (F.col("last_status") != "completed"), "LAST_EVENT_MODEL_ABNORMAL")))
    last = F.when(F.col("code") == "LAST_EVENT_MODEL_ABNORMAL", F.col("last_index"))
    overall = per_workflow.select("workflow_id", "last_index", F.explode(workflow_codes).alias("code")).select(
        "workflow_id", "code", last.alias("ingest_index"), none_long.alias("seq"), none_text.alias("tool_id"))

    found = reduce(DataFrame.unionByName, [events, stepwise, overall])
    label = lambda i: F.create_map(*[F.lit(x) for c, v in FINDINGS.items() for x in (c, v[i])])[F.col("code")]
    return found.select("*", label(0).alias("severity"), label(1).alias("concern"))


# What the path summary says when nothing was found.
PATH_CLEAR = "No execution-path concerns detected under current rules."
PATH_UNSEEN = (
    "Full upstream execution-path visibility requires schemaVersion 2 run events "
    "(retrieval, model_turn, control, tool_skipped) with run graph fields."
)


def path_summary(findings: DataFrame, context: DataFrame) -> DataFrame:
    """Count and sorted distinct codes per workflow; there are fifteen codes, so the set is small."""
    found = findings.groupBy("workflow_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("code")).alias("codes"))
    text = F.concat(F.lit("execution_path_concerns="), F.col("n").cast("string"), F.lit("; codes="), F.array_join("codes", ","))
    return context.select("workflow_id", "max_wire").join(found, "workflow_id", "left").select(
        "workflow_id", F.coalesce("n", F.lit(0)).alias("concerns"),
        F.when(F.col("n") > 0, text).when(F.col("max_wire") == 1, PATH_UNSEEN).otherwise(PATH_CLEAR).alias("summary"))
