"""Check verdicts -> step verdicts -> workflow verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.functions.scalars import js_number, operational_message


def eq_text(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["column"], F.lit("="), p["value"])), "&")


def sorted_eq_text(pairs: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(pairs, lambda p: F.concat(p["column"], F.lit("="), p["value"]))), "&")


def check_key_part() -> Column:
    """This check's part of the step's stable key across runs."""
    kind, names = F.col("check_kind"), F.col("name_list")
    name = lambda i: F.coalesce(F.try_element_at(names, F.lit(i)), F.lit(""))
    number = js_number(F.col("expect_value"))
    return (
        F.when(kind == "sql_row", F.concat_ws("|", F.col("table_name"), eq_text(F.col("identity_eq"))))
        .when(kind == "sql_row_absent", F.concat_ws("|", F.col("table_name"), eq_text(F.col("identity_eq")), eq_text(F.col("filter_eq"))))
        .when(kind == "related_exists", F.concat_ws("|", F.lit("related_exists"), F.col("table_name"), eq_text(F.col("identity_eq"))))
        .when(kind == "aggregate", F.concat_ws("|", F.lit("aggregate"), F.col("table_name"), F.col("fn"), name(1),
                                               F.col("expect_op"), number, sorted_eq_text(F.col("filter_eq"))))
        .when(kind == "anti_join", F.concat_ws(
            "|", F.lit("anti_join"), F.col("table_name"), F.col("lookup_table"), name(1), name(2), name(3),
            F.concat(F.lit("fa:"), eq_text(F.col("filter_eq"))), F.concat(F.lit("fl:"), eq_text(F.col("filter2_eq")))))
        .when(kind == "join_count", F.concat_ws("|", F.lit("join_count"), F.col("table_name"), F.col("lookup_table"), name(1), name(2),
                                                F.col("expect_op"), number, sorted_eq_text(F.col("filter_eq"))))
    )


STEP_KEYS = ["workflow_id", "seq"]


def rollup_steps(checks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per step. The effects list is as long as the tool's registry entry, never as the data."""
    keys = keys or STEP_KEYS
    effect = F.struct(
        F.col("check_id").alias("id"), "status", "code", "message", "field",
        F.concat(F.lit("id|"), F.col("check_id"), F.lit("|"), F.col("key_part"), F.lit("|")).alias("part"),
    )
    grouped = checks.withColumn("key_part", check_key_part()).groupBy(*keys).agg(
        *[F.any_value(c).alias(c) for c in ("tool_id", "tool_kind", "repeat_count", "divergent", "narrative", "n_checks")],
        F.sort_array(F.collect_list(effect)).alias("effects"),
        F.min_by(
            F.struct(F.col("problem_code").alias("code"), F.col("problem_message").alias("message")),
            F.when(F.col("problem_code").isNotNull(), F.coalesce("check_ord", F.lit(0))),
        ).alias("problem"),
        F.any_value(F.struct("status", "code", "message", "field", "expected", "actual", "matched", "measured", "key_part")).alias("only"),
    )
    many = (F.col("tool_kind") == "sql_effects") | ((F.col("tool_kind") == "sql_relational") & (F.col("n_checks") > 1))
    eff = F.col("effects")
    ids = lambda keep: F.array_join(F.transform(F.filter(eff, keep), lambda e: e["id"]), ", ")
    detail = lambda keep: F.array_join(
        F.transform(F.filter(eff, keep), lambda e: F.concat(e["id"], F.lit(" ("), F.coalesce(e["code"], F.lit("UNKNOWN")), F.lit(")"))), "; "
    )
    ok = F.size(F.filter(eff, lambda e: e["status"] == "verified"))
    open_ = F.exists(eff, lambda e: e["status"] == "incomplete_verification")
    failed = lambda e: e["status"].isin("missing", "inconsistent")
    n = F.size(eff)
    resolved = F.col("problem").isNull() | F.col("problem.code").isNull()
    status = (
        F.when(~resolved, "incomplete_verification")
        .when(~many, F.col("only.status"))
        .when(open_, "incomplete_verification")
        .when(ok == n, "verified")
        .when(ok == 0, "inconsistent")
        .otherwise("partially_verified")
    )
    code = (
        F.when(~resolved, F.col("problem.code"))
        .when(~many, F.col("only.code"))
        .when(open_, "MULTI_EFFECT_INCOMPLETE")
        .when(ok == n, F.lit(None).cast("string"))
        .when(ok == 0, "MULTI_EFFECT_ALL_FAILED")
        .otherwise("MULTI_EFFECT_PARTIAL")
    )
    every = lambda e: F.lit(True)
    message = (
        F.when(~resolved, F.col("problem.message"))
        .when(~many, F.col("only.message"))
        .when(open_, F.concat(F.lit("Incomplete verification for effects: "), ids(lambda e: e["status"] == "incomplete_verification")))
        .when(ok == n, F.lit(None).cast("string"))
        .when(ok == 0, operational_message(F.concat(
            F.lit("All "), n.cast("string"), F.lit(" effects failed: "), ids(every), F.lit(". Per effect: "), detail(every))))
        .otherwise(operational_message(F.concat(
            F.lit("Verified "), ok.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" effects; not verified: "),
            ids(failed), F.lit(". Per effect: "), detail(failed))))
    )
    key = F.when(resolved & F.col("tool_kind").isNotNull(), F.concat(
        F.col("tool_kind"), F.lit("|"),
        F.when(F.col("tool_kind").isin("sql_effects", "sql_relational"), F.array_join(F.transform(eff, lambda e: e["part"]), ""))
        .otherwise(F.col("only.key_part")),
    ))
    out = grouped.withColumn("status", status).withColumn("code", code).withColumn("message", message).withColumn("logical_step_key", key)
    single = resolved & ~many
    keep_effects = F.when(resolved & many, F.transform(eff, lambda e: F.struct(
        e["id"].alias("id"), e["status"].alias("status"), e["code"].alias("code"), e["message"].alias("message"), e["field"].alias("field"))))
    return out.select(
        *keys, "tool_id", "tool_kind", "narrative", "status", "code", "message", "logical_step_key", "repeat_count", "divergent",
        *[F.when(single, F.col(f"only.{c}")).alias(c) for c in ("field", "expected", "actual", "matched", "measured")],
        keep_effects.alias("effects"),
    )


FAILED = ["missing", "inconsistent", "partially_verified"]


def workflow_status(steps: DataFrame, run_codes: DataFrame | None = None) -> DataFrame:
    """Verdict per workflow.

    run_codes holds one row per workflow of interest: (workflow_id, malformed boolean). A workflow
    without steps is incomplete.
    """
    counts = steps.groupBy("workflow_id").agg(
        F.count(F.lit(1)).alias("n_steps"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in
          ("verified", "missing", "inconsistent", "incomplete_verification", "partially_verified", "uncertain")],
    )
    if run_codes is not None:
        counts = run_codes.join(counts, "workflow_id", "left").fillna(0)
    else:
        counts = counts.withColumn("malformed", F.lit(False))
    bad = F.col("n_missing") + F.col("n_inconsistent") + F.col("n_partially_verified") > 0
    return counts.withColumn("no_steps", F.col("n_steps") == 0).withColumn(
        "status",
        F.when(F.col("malformed") | F.col("no_steps") | (F.col("n_incomplete_verification") > 0), "incomplete")
        .when(bad, "inconsistent")
        .when(F.col("n_verified") == F.col("n_steps"), "complete")
        .otherwise("incomplete"),
    )


# What a reader is told per workflow status.
TRUST_LINES = {
    "complete": "TRUSTED: Every step matched the database under the configured verification rules.",
    "incomplete": "NOT TRUSTED: Verification is incomplete; the workflow cannot be fully confirmed.",
    "inconsistent": "NOT TRUSTED: At least one step failed verification against the database (determinate failure).",
}
TRUST_LINE_UNCERTAIN = (
    "NOT TRUSTED: At least one step could not be confirmed within the verification window "
    "(row not observed; replication or processing delay is possible)."
)
TRUST_LINE_IRREGULAR = "Event capture or timestamps were irregular; verification used seq-sorted order. See event_sequence below."


def trust_line(irregular: Column | None = None) -> Column:
    """The trust line of a workflow_status row."""
    only_uncertain = (
        (F.col("status") == "incomplete") & ~F.col("malformed") & (F.col("n_uncertain") > 0)
        & (F.col("n_uncertain") + F.col("n_verified") == F.col("n_steps"))
    )
    line = F.when(only_uncertain, TRUST_LINE_UNCERTAIN)
    for status, text in TRUST_LINES.items():
        line = line.when(F.col("status") == status, text)
    return line if irregular is None else F.when(irregular, F.concat_ws(" ", line, F.lit(TRUST_LINE_IRREGULAR))).otherwise(line)
