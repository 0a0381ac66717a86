"""Runs against runs: step and effect changes, recurring failures, streaks, trends and corpus patterns.

Step tables carry run_index; a pair table says which runs of a workflow are compared. Everything is
keyed by workflow, so any number of workflows and runs is compared in the same few joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.operators.skew import block_positions, previous_row
from claimlake.operators.topk import HIGHLIGHTS, TOP_PATTERNS, ranked

UNSPECIFIED_CUSTOMER = "__unspecified__"


# Runs per block when a workflow's runs are walked in order.
RUNS_PER_BLOCK = 4096


def run_block() -> Column:
    return F.floor(F.col("run_index") / RUNS_PER_BLOCK)


def failing(status: str = "status") -> Column:
    return F.col(status) != "verified"


def recurrence_signature() -> Column:
    """status|codes, then the failing effects in id order."""
    parts = F.transform(
        F.filter(F.coalesce(F.col("effects"), F.expr("cast(array() as array<struct<id:string,status:string,code:string>>)")), lambda e: e["status"] != "verified"),
        lambda e: F.concat(F.lit("|e:"), e["id"], F.lit(":"), e["status"], F.lit(":r:"), F.coalesce(e["code"], F.lit(""))))
    return F.concat(F.col("status"), F.lit("|"), F.coalesce(F.col("code"), F.lit("")), F.array_join(F.array_sort(parts), ""))


def keyed_steps(steps: DataFrame) -> DataFrame:
    """One step per (workflow, run, key): the lowest seq keeps the key."""
    return steps.filter("logical_step_key is not null").groupBy("workflow_id", "run_index", "logical_step_key").agg(
        F.min_by(F.struct("seq", "tool_id", "status", "code", "effects"), "seq").alias("s")
    )


def ambiguous_keys(steps: DataFrame) -> DataFrame:
    """Every step that lost its key to a lower seq of the same run."""
    keyed = steps.filter("logical_step_key is not null").select("workflow_id", "run_index", "logical_step_key", "seq")
    chosen = keyed.groupBy("workflow_id", "run_index", "logical_step_key").agg(F.min("seq").alias("chosen_seq"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return keyed.join(chosen, ["workflow_id", "run_index", "logical_step_key"]).filter("seq > chosen_seq").withColumnRenamed("seq", "dropped_seq")


def last_pairs(steps: DataFrame) -> DataFrame:
    """(workflow, prior run, current run): the two newest runs of each workflow."""
    runs = steps.groupBy("workflow_id", "run_index").agg(F.lit(1).alias("one")).drop("one")
    newest = ranked(runs, ["workflow_id"], [F.col("run_index").desc()], 2)
    return newest.groupBy("workflow_id").agg(
        F.max(F.when(F.col("place") == 2, F.col("run_index"))).alias("prior_run"), F.max(F.when(F.col("place") == 1, F.col("run_index"))).alias("current_run")
    ).filter("prior_run is not null")


def consecutive_pairs(steps: DataFrame) -> DataFrame:
    """(workflow, prior run, current run) for every neighbouring pair of runs."""
    runs = steps.groupBy("workflow_id", "run_index").agg(F.lit(1).alias("one")).drop("one")
    paired = previous_row(runs, ["workflow_id"], run_block(), ["run_index"], ["run_index"], "prior")
    return paired.filter("prior is not null").select("workflow_id", F.col("prior.run_index").alias("prior_run"), F.col("run_index").alias("current_run"))


def _side(keyed: DataFrame, pairs: DataFrame, run: str, name: str) -> DataFrame:
    at = pairs.select("workflow_id", "prior_run", "current_run", F.col(run).alias("run_index"))
    return keyed.join(at, ["workflow_id", "run_index"]).select("workflow_id", "prior_run", "current_run", "logical_step_key", F.col("s").alias(name))


def multiset_minus(a: Column, b: Column) -> Column:
    """Codes of a beyond their number in b, sorted. The lists hold a step's few reason codes."""
    def extra(code: Column) -> Column:
        n = F.size(F.filter(a, lambda x: x == code)) - F.size(F.filter(b, lambda x: x == code))
        return F.array_repeat(code, F.greatest(n, F.lit(0)))

    return F.array_sort(F.flatten(F.transform(F.array_distinct(a), extra)))


def _codes(c: Column) -> Column:
    return F.array_compact(F.array(c))


def compare_steps(steps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Full outer join of two runs on the step key: six kinds of change."""
    keyed = keyed_steps(steps)
    both = _side(keyed, pairs, "prior_run", "p").join(
        _side(keyed, pairs, "current_run", "c"), ["workflow_id", "prior_run", "current_run", "logical_step_key"], "full_outer")
    fp, fc = F.col("p.status") != "verified", F.col("c.status") != "verified"
    kind = (
        F.when(F.col("c").isNull(), "structuralRemoval").when(F.col("p").isNull(), "structuralAddition")
        .when(fp & fc, "bothFailing").when(fc, "introducedFailure").when(fp, "resolvedFailure").otherwise("unchangedOk")
    )
    was, now = _codes(F.col("p.code")), _codes(F.col("c.code"))
    churn = lambda col: F.when(F.col("kind") == "bothFailing", col)
    return both.withColumn("kind", kind).select(
        "workflow_id", "prior_run", "current_run", "logical_step_key", "kind",
        F.col("p.seq").alias("seq_prior"), F.col("c.seq").alias("seq_current"), F.col("p.tool_id").alias("tool_prior"), F.col("c.tool_id").alias("tool_current"),
        F.coalesce(F.when(F.col("kind") == "structuralRemoval", fp).when(F.col("kind") == "structuralAddition", fc), F.lit(False)).alias("lone_failing"),
        churn(multiset_minus(now, was)).alias("introduced_codes"), churn(multiset_minus(was, now)).alias("resolved_codes"),
        churn(F.col("p.effects")).alias("effects_prior"), churn(F.col("c.effects")).alias("effects_current"),
    )


def compare_effects(step_changes: DataFrame) -> DataFrame:
    """Per effect of steps failing in both runs: which effects broke, healed or stayed."""
    def lists(col: str) -> Column:
        return F.coalesce(F.col(col), F.expr("cast(array() as array<struct<id:string,status:string,code:string>>)"))

    ids = F.array_sort(F.array_union(F.transform(lists("effects_prior"), lambda e: e["id"]), F.transform(lists("effects_current"), lambda e: e["id"])))
    exploded = step_changes.filter("kind = 'bothFailing'").select("*", F.explode(ids).alias("effect_id"))
    pick = lambda col: F.try_element_at(F.filter(lists(col), lambda e: e["id"] == F.col("effect_id")), F.lit(1))
    found = exploded.withColumn("p", pick("effects_prior")).withColumn("c", pick("effects_current"))
    fp = F.coalesce(F.col("p.status") != "verified", F.lit(False))
    fc = F.coalesce(F.col("c.status") != "verified", F.lit(False))
    return found.select(
        "workflow_id", "prior_run", "current_run", "logical_step_key", "effect_id",
        F.when(fp & fc, "bothFailing").when(fc, "introducedFailure").when(fp, "resolvedFailure").otherwise("unchangedOk").alias("kind"),
        F.col("p.status").alias("status_prior"), F.col("c.status").alias("status_current"),
        multiset_minus(_codes(F.col("c.code")), _codes(F.col("p.code"))).alias("introduced_codes"),
        multiset_minus(_codes(F.col("p.code")), _codes(F.col("c.code"))).alias("resolved_codes"),
    )


def signature_changes(steps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Failures without a step key, counted per signature in both runs: new, gone and matched."""
    lone = steps.filter("logical_step_key is null and status <> 'verified'").select("workflow_id", "run_index", recurrence_signature().alias("signature"))
    counts = lone.groupBy("workflow_id", "run_index", "signature").agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select("workflow_id", "prior_run", "current_run", F.explode(F.array("prior_run", "current_run")).alias("run_index"))
    at = counts.join(sides, ["workflow_id", "run_index"])
    prior = F.coalesce(F.sum(F.when(F.col("run_index") == F.col("prior_run"), F.col("n"))), F.lit(0))
    current = F.coalesce(F.sum(F.when(F.col("run_index") == F.col("current_run"), F.col("n"))), F.lit(0))
    return at.groupBy("workflow_id", "prior_run", "current_run", "signature").agg(
        F.greatest(current - prior, F.lit(0)).alias("introduced"), F.greatest(prior - current, F.lit(0)).alias("resolved"), F.least(prior, current).alias("matched"))


def recurrence_patterns(steps: DataFrame) -> DataFrame:
    """Signatures failing in two or more runs of a workflow, with the first three exemplars."""
    sig = steps.filter(failing()).select("workflow_id", "run_index", "seq", "tool_id", recurrence_signature().alias("signature"))
    per_run = sig.groupBy("workflow_id", "signature", "run_index").agg(F.min(F.struct("seq", "tool_id")).alias("first"))
    hits = per_run.groupBy("workflow_id", "signature").agg(F.count(F.lit(1)).alias("runs_hit")).filter("runs_hit >= 2")
    firsts = ranked(per_run, ["workflow_id", "signature"], ["run_index"], 3).groupBy("workflow_id", "signature").agg(
        F.array_sort(F.collect_list(F.struct("run_index", "first.seq", "first.tool_id"))).alias("exemplars"))
    return hits.join(firsts, ["workflow_id", "signature"])


def recurrence_burden(patterns: DataFrame, workflows: DataFrame) -> DataFrame:
    burden = patterns.groupBy("workflow_id").agg(F.count(F.lit(1)).alias("pattern_count"), F.max("runs_hit").alias("max_runs_hit"))
    return workflows.select("workflow_id").distinct().join(burden, "workflow_id", "left").select(
        "workflow_id", F.coalesce("pattern_count", F.lit(0)).alias("pattern_count"), F.coalesce("max_runs_hit", F.lit(0)).alias("max_runs_hit"),
        (F.coalesce("pattern_count", F.lit(0)) > 0).alias("cross_run"))


def recurrence_top(steps: DataFrame) -> DataFrame:
    """Corpus-wide signatures by number of runs hit: a top list of fifty."""
    sig = steps.filter(failing()).select("workflow_id", "run_index", recurrence_signature().alias("signature"))
    per_run = sig.groupBy("signature", "workflow_id", "run_index").agg(F.lit(1).alias("one"))
    return per_run.groupBy("signature").agg(F.count(F.lit(1)).alias("hit_runs")).orderBy(F.col("hit_runs").desc(), "signature").limit(TOP_PATTERNS)


def top_exemplars(steps: DataFrame, top: DataFrame, n: int = 5) -> DataFrame:
    """First exemplars of the listed signatures, every occurrence counting."""
    sig = steps.filter(failing()).select("workflow_id", "run_index", "seq", "tool_id", recurrence_signature().alias("signature"))
    listed = sig.join(F.broadcast(top.select("signature")), "signature", "left_semi")
    return ranked(listed, ["signature"], ["workflow_id", "run_index", "seq"], n)


def category_streaks(runs: DataFrame) -> DataFrame:
    """Per workflow and category: runs hit and the longest streak of consecutive runs."""
    hit = runs.filter("category <> 'complete'").groupBy("workflow_id", "category", "run_index").agg(F.lit(1).alias("one"))
    placed = block_positions(hit, ["workflow_id", "category"], run_block(), ["run_index"], "place")
    streaks = placed.withColumn("island", F.col("run_index") - F.col("place")).groupBy("workflow_id", "category", "island").agg(F.count(F.lit(1)).alias("n"))
    return streaks.groupBy("workflow_id", "category").agg(F.sum("n").alias("runs_hit"), F.max("n").alias("longest_streak"))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).otherwise(2)


def trend(category_a: Column, severity_a: Column, category_b: Column, severity_b: Column) -> Column:
    """From posture a to posture b."""
    done = "complete"
    ra, rb = severity_rank(severity_a), severity_rank(severity_b)
    return (
        F.when((category_a == done) & (category_b == done), "unchanged").when(category_b == done, "improving").when(category_a == done, "worsening")
        .when(category_a != category_b, "mixed").when(rb > ra, "improving").when(rb < ra, "worsening").otherwise("unchanged")
    )


def reliability(runs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Window and latest-step trend per workflow, and the headline they give together."""
    posture = F.struct("category", "severity")
    ends = runs.groupBy("workflow_id").agg(F.min_by(posture, "run_index").alias("a"), F.max_by(posture, "run_index").alias("z"), F.count(F.lit(1)).alias("n_runs"))
    newest = ranked(runs, ["workflow_id"], [F.col("run_index").desc()], 2).filter("place = 2").select("workflow_id", posture.alias("y"))
    burden = recurrence_burden(patterns, runs)
    rows = ends.filter("n_runs >= 2").join(newest, "workflow_id").join(burden, "workflow_id").select(
        "workflow_id", trend(F.col("a.category"), F.col("a.severity"), F.col("z.category"), F.col("z.severity")).alias("window_trend"),
        trend(F.col("y.category"), F.col("y.severity"), F.col("z.category"), F.col("z.severity")).alias("pairwise_trend"),
        "pattern_count", "max_runs_hit", "cross_run")
    headline = (
        F.when(F.col("window_trend") != "unchanged", F.col("window_trend")).when(F.col("pairwise_trend") != "unchanged", F.col("pairwise_trend"))
        .when(F.col("cross_run"), "mixed").otherwise("unchanged")
    )
    return rows.withColumn("headline", headline)


def run_postures(steps: DataFrame, drivers: DataFrame, catalog: DataFrame) -> DataFrame:
    """category and severity per (workflow, run) from its driver step."""
    runs = steps.groupBy("workflow_id", "run_index").agg(
        F.coalesce(F.bool_or(F.col("status").isin("missing", "inconsistent", "partially_verified")), F.lit(False)).alias("bad"),
        F.coalesce(F.bool_or(F.col("status") == "incomplete_verification"), F.lit(False)).alias("open"))
    coded = runs.join(drivers, ["workflow_id", "run_index"], "left").join(catalog.select(F.col("code").alias("driver_primary_code"), "category"), "driver_primary_code", "left")
    doubtful = F.col("driver_primary_code").isin("ROW_ABSENT", "VALUE_MISMATCH")
    return coded.select(
        "workflow_id", "run_index",
        F.when(F.col("open"), "incomplete").when(F.col("bad"), "inconsistent").when(F.col("driver_primary_code").isNull(), "complete").otherwise("incomplete").alias("status"),
        F.when(F.col("driver_primary_code").isNull(), "complete").when(F.col("category").isNull(), "unclassified").when(doubtful, "ambiguous").otherwise(F.col("category")).alias("category"),
        F.when(F.col("driver_primary_code").isNull(), "low").when(F.col("bad"), "high").otherwise("medium").alias("severity"))


def highlights(step_changes: DataFrame) -> DataFrame:
    """The first twenty keys per workflow pair and kind of change."""
    shown = step_changes.filter(
        F.col("kind").isin("introducedFailure", "resolvedFailure")
        | ((F.col("kind") == "bothFailing") & ((F.size("introduced_codes") > 0) | (F.size("resolved_codes") > 0))))
    return ranked(shown, ["workflow_id", "prior_run", "current_run", "kind"], ["logical_step_key"], HIGHLIGHTS)


# --- corpus -------------------------------------------------------------------------------

def run_index(steps: DataFrame, postures: DataFrame, meta: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """One list row per run. findings: workflow_id, run_index, code of the concerns along each run's path."""
    lists = steps.groupBy("workflow_id", "run_index").agg(
        F.array_sort(F.collect_set("tool_id")).alias("tool_ids"),
        F.array_sort(F.collect_set("code")).alias("reason_codes"))
    joined = postures.join(lists, ["workflow_id", "run_index"]).join(meta, ["workflow_id", "run_index"], "left")
    found = F.array().cast("array<string>")
    if findings is not None:
        each = findings.groupBy("workflow_id", "run_index").agg(F.array_sort(F.collect_set("code")).alias("found"))
        joined, found = joined.join(each, ["workflow_id", "run_index"], "left"), F.coalesce("found", found)
    return joined.select(
        F.concat_ws("/", "workflow_id", F.col("run_index").cast("string")).alias("run_id"), "workflow_id", "run_index", F.lit("ok").alias("load_status"),
        "status", "category", "tool_ids", "reason_codes", found.alias("finding_codes"),
        F.when(F.coalesce(F.col("customer_id"), F.lit("")) != "", F.col("customer_id")).otherwise(UNSPECIFIED_CUSTOMER).alias("customer_id"),
        F.coalesce("captured_at", "verified_at", "modified_at").alias("captured_at"))


def run_list_filter(rows: DataFrame, **q) -> DataFrame:
    """Facets: load_status, workflow_id, status, category, reason_code, tool_id, customer_id, time_from, time_to, has_findings, include_load_errors."""
    ok = F.col("load_status") == "ok"
    keep = F.lit(True)
    if not q.get("include_load_errors"):
        keep = keep & ok
    if q.get("load_status"):
        keep = keep & (F.col("load_status") == q["load_status"])
    if q.get("workflow_id"):
        keep = keep & (~ok | (F.col("workflow_id") == q["workflow_id"]))
    for facet in ("status", "category"):
        if q.get(facet):
            keep = keep & ok & (F.col(facet) == q[facet])
    if q.get("reason_code"):
        keep = keep & F.array_contains("reason_codes", q["reason_code"])
    if q.get("tool_id"):
        keep = keep & ok & F.array_contains("tool_ids", q["tool_id"])
    if q.get("customer_id"):
        keep = keep & (F.col("customer_id") == q["customer_id"])
    if q.get("time_from"):
        keep = keep & (F.col("captured_at") >= F.lit(q["time_from"]).cast("timestamp"))
    if q.get("time_to"):
        keep = keep & (F.col("captured_at") <= F.lit(q["time_to"]).cast("timestamp"))
    if q.get("has_findings"):
        keep = keep & ok & (F.size("finding_codes") > 0)
    return rows.filter(keep)


def code_counts(steps: DataFrame) -> DataFrame:
    return steps.filter("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def pin(steps: DataFrame) -> DataFrame:
    """Canonical projection of step results, to be stored and compared later."""
    effects = F.to_json(F.transform("effects", lambda e: F.struct(e["id"].alias("id"), e["status"].alias("status"), e["code"].alias("code"))))
    return steps.select("workflow_id", "seq", "tool_id", "status", "code", effects.alias("effects"))


def lock_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Steps whose pinned and current projections differ, with the differing fields."""
    fields = ["tool_id", "status", "code", "effects"]
    e = expected.select("workflow_id", "seq", F.struct(*fields).alias("e"))
    a = actual.select("workflow_id", "seq", F.struct(*fields).alias("a"))
    both = e.join(a, ["workflow_id", "seq"], "full_outer")
    differing = F.array_compact(F.array(*[F.when(~F.col(f"e.{f}").eqNullSafe(F.col(f"a.{f}")), F.lit(f)) for f in fields]))
    return both.select(
        "workflow_id", "seq", F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").otherwise("changed").alias("kind"),
        differing.alias("fields")).filter("kind <> 'changed' or size(fields) > 0")
