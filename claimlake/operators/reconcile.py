"""Resolved checks against keyed facts: one join, then a verdict per check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.functions.scalars import display_actual, display_expected, js_number, operational_message, scalar_match
from claimlake.functions.stage import sealed
from claimlake.session import stored
from claimlake.operators.topk import SAMPLE_ROWS, ranked
from claimlake.sources.state import Binding, State, binding_types, claimed_only, key_text_claimed, key_text_stored, state_facts

def discover_bindings(checks: DataFrame, state: State) -> list[str]:
    """Bindings named in the claims that state can answer: combinations of its tables and columns, so metadata in size."""
    known = {c for df in state.tables.values() for c in df.columns} | {c.lower() for df in state.tables.values() for c in df.columns}
    parts = F.split("binding", "\\|")
    columns = F.flatten(F.transform(F.slice(parts, F.lit(3), F.size(parts)), lambda p: F.split(p, ",")))
    plain = F.transform(columns, lambda c: F.regexp_replace(c, r"^(left|right)\.", ""))
    # names that are no table or column leave the list before it is collected
    answerable = F.size(F.array_except(plain, F.array(*[F.lit(x) for x in sorted({"", *known, *state.tables})]))) == 0
    rows = checks.filter(F.col("binding").isNotNull() & parts[1].isin(list(state.tables))).filter(answerable).select("binding").distinct().collect()
    return sorted(r[0] for r in rows)


def attach_facts(spark: SparkSession, checks: DataFrame, state: State, bindings: list[str]) -> DataFrame:
    """Add n, total and payload of each check's (binding, key). The checks are computed once: their keys cut state first.

    The fact side is a union of aggregates and so is shuffled by itself for the join; AQE can then
    split a hot key's claims over several tasks and re-read its one fact row.
    """
    types = F.broadcast(binding_types(spark, state, bindings))
    keyed = checks.join(types.select("binding", "key_kinds"), "binding", "left").withColumn("key", F.zip_with("key_values", "key_kinds", key_text_claimed))
    # what a binding fixes is not written beside every check
    typed = stored(keyed.drop("key_kinds", "key_values")).join(types, "binding", "left")
    facts = state_facts(spark, state, bindings, typed.filter("key is not null").select("binding", "key"))
    joined = typed.join(facts, ["binding", "key"], "left")
    if any(b.startswith("orphan|") and not b.endswith("|") for b in bindings):
        totals = facts.filter(F.col("binding").endswith("#anchors")).select(
            F.regexp_replace("binding", "#anchors$", "").alias("binding"), F.col("key").alias("anchor_key"), F.col("n").alias("anchors")
        )
        joined = joined.withColumn("anchor_key", F.slice("key", F.lit(1), F.greatest(F.col("n_anchor_keys"), F.lit(0)))).join(
            totals, ["binding", "anchor_key"], "left"
        ).withColumn("n", F.when(F.col("anchors").isNull(), F.col("n")).otherwise(F.col("anchors") + F.coalesce("n", F.lit(0)))).drop(
            "anchors", "anchor_key"
        )
    return joined


def _context(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(operational_message(p["column"]), F.lit("="), operational_message(p["value"]))), " ")


def _stored(f: Column) -> Column:
    """A required field next to the kind and text of its stored value."""
    name = F.lower(f["k"])
    return F.struct(
        f["k"].alias("k"), f["t"].alias("t"), f["v"].alias("v"),
        F.try_element_at("field_kinds", name).alias("kind"), F.try_element_at("payload", name).alias("actual"),
    )


def _field_failure(f: Column) -> Column:
    code = (
        F.when(f["kind"].isNull(), "ROW_SHAPE_MISMATCH")
        .when((f["kind"] == "object") & f["actual"].isNotNull(), "UNREADABLE_VALUE")
        .when(~scalar_match(f["t"], f["v"], f["kind"], f["actual"]), "VALUE_MISMATCH")
    )
    return F.struct(code.alias("code"), f["k"].alias("field"), f["t"].alias("t"), f["v"].alias("v"), f["kind"].alias("kind"), f["actual"].alias("stored"))


def judge_checks(joined: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """status, code, message, field, expected, actual and matched count per check."""
    rows = not kinds or "sql_row" in kinds
    kind = F.col("check_kind")
    matched = F.coalesce(F.col("n"), F.lit(0))
    measured = F.when(F.col("fn") == "SUM", F.coalesce(F.col("total"), F.lit(0.0))).otherwise(matched.cast("double"))
    holds = (
        F.when(F.col("expect_op") == "eq", measured == F.col("expect_value"))
        .when(F.col("expect_op") == "gte", measured >= F.col("expect_value"))
        .otherwise(measured <= F.col("expect_value"))
    )
    failure = F.col("failure")
    unreadable = F.col("problem_code").isNull() & F.col("key_kinds").isNull()
    status = (
        F.when(F.col("problem_code").isNotNull() | unreadable, "incomplete_verification")
        .when(kind == "sql_row", F.when(matched == 0, "missing").when(matched >= 2, "inconsistent")
              .when(failure["code"].isin("ROW_SHAPE_MISMATCH", "UNREADABLE_VALUE"), "incomplete_verification")
              .when(failure.isNotNull(), "inconsistent").otherwise("verified"))
        .when(kind.isin("sql_row_absent", "anti_join"), F.when(matched == 0, "verified").otherwise("inconsistent"))
        .when(kind == "related_exists", F.when(matched > 0, "verified").otherwise("missing"))
        .otherwise(F.when(holds, "verified").otherwise("inconsistent"))
    )
    code = (
        F.when(F.col("problem_code").isNotNull(), F.col("problem_code"))
        .when(unreadable, "CONNECTOR_ERROR")
        .when(kind == "sql_row", F.when(matched == 0, "ROW_ABSENT").when(matched >= 2, "DUPLICATE_ROWS").otherwise(failure["code"]))
        .when((kind == "sql_row_absent") & (matched > 0), "ROW_PRESENT_WHEN_FORBIDDEN")
        .when((kind == "anti_join") & (matched > 0), "ORPHAN_ROW_DETECTED")
        .when((kind == "related_exists") & (matched == 0), "RELATED_ROWS_ABSENT")
        .when(kind.isin("aggregate", "join_count") & ~holds, "RELATIONAL_EXPECTATION_MISMATCH")
    )
    where = F.concat(F.lit("table="), F.col("table_name"), F.lit(" "), _context(F.col("identity_eq")))
    absent_where = F.concat(
        F.lit("table="), F.col("table_name"), F.lit(" identity=["), _context(F.col("identity_eq")), F.lit("]"),
        F.when(F.size("filter_eq") > 0, F.concat(F.lit(" filter=["), _context(F.col("filter_eq")), F.lit("]"))).otherwise(""),
    )
    relational = F.concat(F.lit("Relational check "), F.col("check_id"), F.lit(": "))
    message = (
        F.when(F.col("problem_code").isNotNull(), F.col("problem_message"))
        .when(F.col("code") == "CONNECTOR_ERROR", F.concat(F.lit("no such table or column ("), F.col("binding"), F.lit(")")))
        .when(F.col("code") == "ROW_ABSENT", F.concat(F.lit("No row matched key ("), where, F.lit(")")))
        .when(F.col("code") == "DUPLICATE_ROWS", F.concat(F.lit("More than one row matched key ("), where, F.lit(")")))
        .when(F.col("code") == "ROW_SHAPE_MISMATCH", F.concat(F.lit("Column not in row: "), failure["field"], F.lit(" ("), where, F.lit(")")))
        .when(F.col("code") == "UNREADABLE_VALUE", F.concat(F.lit("Non-scalar value for "), failure["field"], F.lit(" ("), where, F.lit(")")))
        .when(F.col("code") == "VALUE_MISMATCH", F.concat(
            F.lit("Expected "), failure["expected"], F.lit(" but found "), failure["actual"],
            F.lit(" for field "), failure["field"], F.lit(" ("), where, F.lit(")")))
        .when(F.col("code") == "ROW_PRESENT_WHEN_FORBIDDEN", operational_message(F.concat(
            F.lit("Row present when forbidden ("), absent_where, F.lit("); matched "), matched.cast("string"))))
        .when(F.col("code") == "ORPHAN_ROW_DETECTED", operational_message(F.concat(relational, matched.cast("string"), F.lit(" orphan row(s)"))))
        .when(F.col("code") == "RELATED_ROWS_ABSENT", operational_message(F.concat(relational, F.lit("related row does not exist"))))
        .when(F.col("code") == "RELATIONAL_EXPECTATION_MISMATCH", operational_message(F.concat(
            relational, F.lit("expected "), F.col("expect_op"), F.lit(" "), js_number(F.col("expect_value")),
            F.lit(" but actual "), js_number(measured))))
    )
    first = F.try_element_at(F.filter(F.transform("pairs", _field_failure), lambda x: x["code"].isNotNull()), F.lit(1))
    if rows:
        paired = sealed(joined.withColumn("pairs", F.when((kind == "sql_row") & (matched == 1), F.transform("required", _stored))).drop("payload", "field_kinds", "required"))
        failed = sealed(paired.withColumn("failure", first).drop("pairs"))
    else:
        failed = joined.drop("payload", "field_kinds", "required").withColumn(
            "failure", F.expr("cast(null as struct<code:string,field:string,t:string,v:string,kind:string,stored:string>)"))
    coded = sealed(
        failed.withColumn("failure", F.when(F.col("failure").isNotNull(), F.struct(
            "failure.code", "failure.field", display_expected(F.col("failure.t"), F.col("failure.v")).alias("expected"),
            display_actual(F.col("failure.kind"), F.col("failure.stored")).alias("actual"))))
        .withColumn("status", status)
        .withColumn("code", code)
    )
    return (
        coded.withColumn("message", message)
        .withColumn("matched", F.when(F.col("problem_code").isNull() & F.col("key_kinds").isNotNull(), matched))
        .withColumn("measured", F.when(F.col("problem_code").isNull() & kind.isin("aggregate", "join_count") & F.col("key_kinds").isNotNull(), measured))
        .withColumn("field", F.when(F.col("code").isin("VALUE_MISMATCH", "UNREADABLE_VALUE"), failure["field"]))
        .withColumn("expected", F.when(F.col("code") == "VALUE_MISMATCH", failure["expected"]))
        .withColumn("actual", F.when(F.col("code") == "VALUE_MISMATCH", failure["actual"]))
        .drop("failure", "key_kinds", "n", "total", "n_anchor_keys", "key_values")
    )


def failing_samples(judged: DataFrame, state: State, bindings: list[str], order: dict[str, list[str]]) -> DataFrame:
    """The first SAMPLE_ROWS stored rows behind each failing forbidden-row check: binding, key, place and the row as JSON.

    judged: verdicts with binding and key. Only the failing checks' distinct keys reach state. order: a total order per table.
    """
    failing = stored(judged.filter("code = 'ROW_PRESENT_WHEN_FORBIDDEN'").select("binding", "key").distinct())
    parts = []
    for b in map(Binding.parse, bindings):
        if b.kind != "count" or not b.readable(state):
            continue
        table, cols = b.tables[0], [c for _, c in b.keys]
        asked = failing.filter(F.col("binding") == b.name)
        rows = claimed_only(state.tables[table], cols, asked.select("key"), [F.col("key")[i] for i in range(len(cols))])
        keyed = rows.select(F.lit(b.name).alias("binding"), F.array(*[key_text_stored(F.col(c), state.dtype(table, c)) for c in cols]).alias("key"), F.struct(*rows.columns).alias("row"))
        parts.append(ranked(keyed, ["binding", "key"], [F.col(f"row.{c}") for c in order[table]], SAMPLE_ROWS).withColumn("row", F.to_json("row")).join(asked, ["binding", "key"], "left_semi"))
    empty = judged.sparkSession.createDataFrame([], "binding string, key array<string>, row string, place int")
    return reduce(DataFrame.unionByName, parts, empty)
