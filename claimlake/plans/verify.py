"""The batch verification job: logs + registry + state -> check, step and workflow verdicts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.operators.reconcile import attach_facts, discover_bindings, judge_checks
from claimlake.operators.resolve import resolve_checks, resolve_fixed
from claimlake.operators.rollup import rollup_steps, workflow_status
from claimlake.operators.steps import logical_steps, sequence_integrity
from claimlake.sources.events import file_counts, parse_events
from claimlake.sources.registry import Registry, check_binding
from claimlake.sources.state import State


def registry_bindings(registry: Registry, kinds: list[str] | None = None) -> list[str]:
    """Bindings of a registry whose names are all constants."""
    rows = [r for r in registry.check_rows() if not kinds or r["check_kind"] in kinds]
    return sorted({b for b in map(check_binding, rows) if b})


def verify_claims(
    spark: SparkSession, resolved: DataFrame, registry: Registry, state: State, kinds: list[str] | None = None
) -> DataFrame:
    """Verdicts of resolved checks, optionally of some check kinds only."""
    if kinds:
        resolved = resolved.filter(F.col("check_kind").isin(kinds))
    bindings = discover_bindings(resolved, state) if registry.needs_discovery() else registry_bindings(registry, kinds)
    return judge_checks(attach_facts(spark, resolved, state, bindings), kinds)


# Fixed value: the message a workflow without claims gets.
NO_STEPS = (
    'No tool_observed events for workflowId "%s" after filtering. event_file_non_empty_lines=%d '
    "schema_valid_events=%d tool_observed_for_workflow=0 tool_observed_other_workflows=%d."
)


def no_steps_reasons(asked: DataFrame, events: DataFrame) -> DataFrame:
    """Run-level reason of asked-for workflows (workflow_id, source_file) that have no claims."""
    claimed = events.filter("type = 'tool_observed'").select("workflow_id").distinct()
    zero = F.lit(0).cast("bigint")
    return asked.join(claimed, "workflow_id", "left_anti").join(file_counts(events), "source_file", "left").select(
        "workflow_id", "source_file", F.lit("NO_STEPS_FOR_WORKFLOW").alias("code"),
        F.format_string(NO_STEPS, F.col("workflow_id"), F.coalesce("non_empty_lines", zero), F.coalesce("valid_events", zero),
                        F.coalesce("tool_observed", zero)).alias("message"),
    )


@dataclass
class Verification:
    """Every table of one verification run, each built when first asked for."""

    spark: SparkSession
    lines: DataFrame | None  # log lines, or
    registry: Registry
    state: State
    kinds: list[str] | None = None  # verify only these check kinds
    claimed: DataFrame | None = None  # observations already parsed
    keep: tuple[str, ...] = ()  # tables several branches read, kept in memory or on disk once computed

    def _kept(self, name: str, df: DataFrame) -> DataFrame:
        """Kept tables spill to disk, and a lost executor's part is computed again from its lineage."""
        return df.persist() if name in self.keep else df

    def release(self) -> None:
        for name in self.keep:
            getattr(self, name).unpersist()

    @cached_property
    def events(self) -> DataFrame:
        return self._kept("events", parse_events(self.lines))

    @cached_property
    def observations(self) -> DataFrame:
        return self.claimed if self.claimed is not None else self.events.filter("valid and type = 'tool_observed'")

    @cached_property
    def planned(self) -> DataFrame:
        return logical_steps(self.observations)

    def resolve(self, planned: DataFrame) -> DataFrame:
        """The checks that some steps ask for."""
        if self.registry.needs_discovery():
            return resolve_checks(planned, self.registry.checks(self.spark))
        return resolve_fixed(planned, self.registry.fixed_checks(self.spark), self.registry.value_paths(), self.kinds)

    @cached_property
    def resolved(self) -> DataFrame:
        return self.resolve(self.planned)

    @cached_property
    def checks(self) -> DataFrame:
        # a verdict does not read a claim's text or its place in the log
        return verify_claims(self.spark, self.resolved.drop("params", "ts", "source_file", "line_no"), self.registry, self.state, self.kinds)

    @cached_property
    def steps(self) -> DataFrame:
        return self._kept("steps", rollup_steps(self.checks))

    @cached_property
    def run_codes(self) -> DataFrame:
        """Every workflow named in a log, and whether a file it appears in holds a bad line."""
        homes = self.events.filter("valid").select("workflow_id", "source_file").distinct()
        bad = file_counts(self.events).select("source_file", (F.col("malformed_lines") > 0).alias("bad"))
        return homes.join(bad, "source_file").groupBy("workflow_id").agg(F.bool_or("bad").alias("malformed"))

    @cached_property
    def malformed_lines(self) -> DataFrame:
        """Every workflow named in a log, and how many bad lines the files have that it appears in."""
        homes = self.events.filter("valid").select("workflow_id", "source_file").distinct()
        return homes.join(file_counts(self.events), "source_file").groupBy("workflow_id").agg(F.sum("malformed_lines").alias("malformed_lines"))

    @cached_property
    def integrity(self) -> DataFrame:
        return sequence_integrity(self.observations)

    @cached_property
    def workflows(self) -> DataFrame:
        return workflow_status(self.steps, self.run_codes)


def validate_registry(resolved: DataFrame) -> DataFrame:
    """Resolution problems per step, found without reading state: the first problem in registry order."""
    first = resolved.filter("problem_code is not null").groupBy("workflow_id", "seq").agg(
        F.min_by(F.struct("problem_code", "problem_message", "tool_id"), F.coalesce("check_ord", F.lit(0))).alias("p"))
    return first.select("workflow_id", "seq", "p.tool_id", F.col("p.problem_code").alias("code"), F.col("p.problem_message").alias("message"))
