"""Run logs and a registry derived from the order tables.

Every order yields one claim about state, with faults placed by order key, plus upstream events.
The formulas are plain arithmetic on the order row, so logs grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.functions.stage import sealed
from claimlake.sources.registry import Registry
from claimlake.sources.state import State

_KEY = {"pointer": "/recordId"}


def _eq(column: str, pointer: str = "/recordId", side: str | None = None) -> dict:
    pair = {"column": {"const": column}, "value": {"pointer": pointer}}
    return pair | ({"tableSide": side} if side else {})


REGISTRY = [
    {
        "toolId": "orders.upsert",
        "effectDescriptionTemplate": "Upsert order {/recordId} with {/fields}",
        "verification": {"kind": "sql_row", "table": {"const": "orders"}, "identityEq": [_eq("o_orderkey")], "requiredFields": {"pointer": "/fields"}},
    },
    {
        "toolId": "orders.audit",
        "effectDescriptionTemplate": "Audit order {/recordId}",
        "verification": {
            "kind": "sql_effects",
            "effects": [
                {"id": "order_row", "table": {"const": "orders"}, "identityEq": [_eq("o_orderkey")], "requiredFields": {"pointer": "/fields"}},
                {"id": "customer_row", "table": {"const": "customer"}, "identityEq": [_eq("c_custkey", "/custId")], "requiredFields": {"pointer": "/custFields"}},
            ],
        },
    },
    {
        "toolId": "orders.purge",
        "effectDescriptionTemplate": "Purge line {/lineNo} of {/recordId}",
        "verification": {"kind": "sql_row_absent", "table": {"const": "lineitem"}, "identityEq": [_eq("l_orderkey")], "filterEq": [_eq("l_linenumber", "/lineNo")]},
    },
    {
        "toolId": "orders.link",
        "effectDescriptionTemplate": "Link {/recordId}",
        "verification": {
            "kind": "sql_relational",
            "checks": [
                {"checkKind": "related_exists", "id": "a_lines", "childTable": {"const": "lineitem"}, "matchEq": [_eq("l_orderkey")]},
                {"checkKind": "aggregate", "id": "b_count", "table": {"const": "lineitem"}, "fn": "COUNT_STAR", "whereEq": [_eq("l_orderkey")],
                 "expect": {"op": "gte", "value": {"pointer": "/minLines"}}},
                {"checkKind": "aggregate", "id": "c_sum", "table": {"const": "lineitem"}, "fn": "SUM", "sumColumn": {"const": "l_quantity"}, "whereEq": [_eq("l_orderkey")],
                 "expect": {"op": "lte", "value": {"const": 150}}},
                {"checkKind": "join_count", "id": "d_join", "leftTable": {"const": "orders"}, "rightTable": {"const": "lineitem"},
                 "join": {"leftColumn": {"const": "o_orderkey"}, "rightColumn": {"const": "l_orderkey"}},
                 "whereEq": [_eq("o_orderkey", "/recordId", "left")], "expect": {"op": "gte", "value": {"const": 2}}},
                {"checkKind": "anti_join", "id": "e_orphans", "anchorTable": {"const": "orders"}, "lookupTable": {"const": "lineitem"},
                 "anchorColumn": {"const": "o_orderkey"}, "lookupColumn": {"const": "l_orderkey"}, "lookupPresenceColumn": {"const": "l_orderkey"},
                 "filterEqAnchor": [_eq("o_custkey", "/custId")]},
            ],
        },
    },
]


def registry() -> Registry:
    return Registry(REGISTRY)


def state(spark: SparkSession, sf_dir: str) -> State:
    return State.parquet(spark, sf_dir, ["orders", "lineitem", "customer"])


def fault(k: Column, shift: int = 0) -> Column:
    """Which fault an order's claim carries; the first that hits wins."""
    hit = lambda m: F.pmod(k + F.lit(shift), F.lit(m)) == 0
    return (
        F.when(hit(17), "absent").when(hit(13), "mismatch").when(hit(19), "unknown").when(hit(23), "nokey")
        .when(hit(29), "retry").when(hit(31), "shape").otherwise("ok")
    )


#: Rows whose log one task derives.
LOG_ROWS = 1 << 16


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows that logs are derived from by key: a table may be one split, and its derived log is much larger than itself.

    The number of tasks follows the rows; left to itself, Spark sizes them by the short rows that go in.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // LOG_ROWS))
    return df.repartition(tasks, key)


def claims(orders: DataFrame, shift: int = 0) -> DataFrame:
    """One claim per order: workflow, seq, tool, params text, timestamp."""
    orders = sealed(spread(orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), "o_orderkey").withColumn("fault", fault(F.col("o_orderkey"), shift)))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    f = F.col("fault")
    tool = F.when(f == "unknown", "ghost.tool").otherwise(
        F.element_at(F.array(*[F.lit(t) for t in ("orders.upsert", "orders.upsert", "orders.audit", "orders.purge", "orders.link")]), (F.pmod(k, F.lit(5)) + 1).cast("int"))
    )
    record = F.when(f == "absent", (k + 100000000).cast("string")).when(f != "nokey", k.cast("string"))
    status = F.when(f == "mismatch", F.lit("X")).otherwise(F.col("o_orderstatus"))
    params = F.to_json(F.struct(
        F.struct(F.when(F.pmod(k, F.lit(7)) == 0, F.lit("nobody")).otherwise(F.concat(F.lit("Customer#"), F.lpad(c.cast("string"), 9, "0"))).alias("c_name")).alias("custFields"),
        c.alias("custId"),
        F.struct(
            F.when(f == "shape", status).alias("o_ghost"),
            F.when(f != "shape", status).alias("o_orderstatus"),
            F.col("o_totalprice").alias("o_totalprice"),
        ).alias("fields"),
        F.when(F.pmod(k, F.lit(3)) == 0, F.pmod(k, F.lit(7)) + 1).otherwise(F.lit(8)).alias("lineNo"),
        F.pmod(k, F.lit(4)).alias("minLines"),
        record.alias("recordId"),
    ))
    moved = (F.pmod(k, F.lit(37)) == 0) & (k >= 200)
    clock = F.timestamp_seconds(F.lit(1704067200) + k - F.when(F.pmod(k, F.lit(41)) == 0, F.lit(86400)).otherwise(F.lit(0)))
    return sealed(orders.select(
        F.concat(F.lit("wf_"), c).alias("workflow_id"),
        F.concat(F.lit("log_"), F.floor(c / 4)).alias("source_file"),
        (k * 8).alias("line_no"),
        F.when(moved, k - 200).otherwise(k).alias("seq"),
        tool.alias("tool_id"),
        params.alias("params"),
        F.when(F.pmod(k, F.lit(5)) != 0, F.date_format(clock, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("ts"),
        f.alias("fault"),
        k.alias("k"),
    ))


def observations(orders: DataFrame, shift: int = 0) -> DataFrame:
    """The claims as parsed observations: each once, retried ones twice."""
    twice = F.when(F.col("fault") == "retry", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    changed = (F.col("attempt") == 1) & (F.pmod("k", F.lit(2)) == 1)
    return claims(orders, shift).withColumn("attempt", F.explode(twice)).select(
        "workflow_id", "source_file", (F.col("line_no") + 5 + F.col("attempt")).alias("line_no"), "seq", "tool_id",
        F.when(changed, F.concat(F.lit('{"attempt":2,'), F.substr("params", F.lit(2)))).otherwise(F.col("params")).alias("params"), "ts",
    )


def log_lines(orders: DataFrame, shift: int = 0) -> DataFrame:
    """(source_file, line_no, line): the claims as NDJSON among model, retrieval, control and skip events, with some broken lines."""
    base = claims(orders, shift)
    k = F.col("k")
    at = lambda m, r: F.pmod(k, F.lit(m)) == r
    head = [F.lit(2).alias("schemaVersion"), F.col("workflow_id").alias("workflowId")]
    rid = lambda tag: F.concat(F.lit(tag), k).alias("runEventId")
    parent = F.concat(F.lit("t"), k).alias("parentRunEventId")

    def event(offset: int, hit: Column, *fields: Column) -> Column:
        return F.when(hit, F.struct((F.col("line_no") + offset).alias("line_no"), F.to_json(F.struct(*head, *fields)).alias("line")))

    params_of = lambda p: F.concat(F.lit('"params":'), p, F.lit("}"))

    def observed(offset: int, hit: Column, params: Column, tag: str) -> Column:
        shell = F.to_json(F.struct(*head, rid(tag), F.lit("tool_observed").alias("type"), F.col("seq"), F.col("tool_id").alias("toolId"), F.col("ts").alias("timestamp")))
        return F.when(hit, F.struct((F.col("line_no") + offset).alias("line_no"), F.concat(F.rtrim(shell, F.lit("}")), F.lit(","), params_of(params)).alias("line")))

    pick = lambda names, m: F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(F.floor(k / m), F.lit(len(names))) + 1).cast("int"))
    again = F.when(F.pmod(k, F.lit(2)) == 0, F.col("params")).otherwise(F.concat(F.lit('{"attempt":2,'), F.substr("params", F.lit(2))))
    lines = F.array(
        event(0, at(7, 1), rid("r"), F.lit("retrieval").alias("type"), F.lit("kb").alias("source"), pick(["ok", "ok", "empty", "error"], 7).alias("status"),
              F.when(at(14, 1), F.pmod(F.floor(k / 14), F.lit(3))).alias("hitCount")),
        event(1, at(11, 2), rid("m"), F.lit("model_turn").alias("type"), pick(["completed", "completed", "error", "aborted", "incomplete"], 11).alias("status")),
        event(2, at(43, 3), rid("c"), F.lit("control").alias("type"), F.lit("interrupt").alias("controlKind")),
        event(3, at(47, 4), rid("b"), F.lit("control").alias("type"), pick(["branch", "gate", "loop"], 47).alias("controlKind"), pick(["taken", "skipped"], 141).alias("decision")),
        event(4, at(53, 5), rid("s"), F.lit("tool_skipped").alias("type"), F.lit("orders.upsert").alias("toolId"), F.lit("guard").alias("reason")),
        observed(5, F.lit(True), F.col("params"), "t"),
        observed(6, F.col("fault") == "retry", again, "u"),
        F.when(at(1009, 5), F.struct((F.col("line_no") + 7).alias("line_no"), F.lit('{"schemaVersion":2,"workflowId":').alias("line"))),
        event(7, at(3, 0) & ~at(1009, 5), rid("z"), parent, F.lit("control").alias("type"), F.lit("run_completed").alias("controlKind")),
    )
    return base.select("source_file", F.explode(lines).alias("e")).filter("e is not null").select("source_file", "e.line_no", "e.line")


# --- product events ------------------------------------------------------------------------

AS_OF = "2024-01-31 00:00:00"


def funnel_events(events: DataFrame) -> DataFrame:
    """Product funnel rows from the events table: id, event, user, install, metadata JSON, created_at."""
    n = F.get_json_object("props", "$.k").cast("bigint")
    eid, user = F.col("event_id"), F.col("user_id")
    pick = lambda names, m: F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod(n, F.lit(m)) + 1).cast("int"))
    name = (
        F.when(F.col("event_type") == "view", "acquisition_landed").when(F.col("event_type") == "click", "integrate_landed")
        .when(F.col("event_type") == "signup", "verify_started").when(F.col("event_type") == "purchase", "verify_outcome")
        .otherwise("reserve_allowed")
    )
    metadata = F.to_json(F.struct(
        F.when(F.pmod(eid, F.lit(22)) == 0, F.lit(" ")).when(F.pmod(eid, F.lit(11)) != 0, F.concat(F.lit("u"), user)).alias("funnel_anon_id"),
        F.when(F.pmod(n, F.lit(3)) == 0, "bundled_examples").when(F.pmod(n, F.lit(3)) == 1, "non_bundled").alias("workload_class"),
        F.when(F.pmod(n, F.lit(10)) == 0, "local_dev").when(F.pmod(n, F.lit(10)) > 1, "cli").alias("telemetry_source"),
        pick(["complete", "inconsistent", "incomplete", "weird"], 4).alias("terminal_status"),
        pick(["integrator_scoped", "catalog_shipped"], 2).alias("workflow_lineage"),
    ))
    return events.select(
        eid.alias("id"), name.alias("event"), user.alias("user_id"),
        F.when(F.pmod(eid, F.lit(13)) != 0, F.concat(F.lit("i"), F.pmod(user, F.lit(50)))).alias("install_id"),
        metadata.alias("metadata"), F.col("ts").alias("created_at"), F.col("value"),
    )


# --- saved runs ----------------------------------------------------------------------------

def saved_steps(orders: DataFrame, runs: int = 3) -> DataFrame:
    """Step results of several runs: twenty orders make a workflow, and faults move with the run."""
    k, r = F.col("o_orderkey"), F.col("run_index")
    h = k + r * 5
    hit = lambda m: F.pmod(h, F.lit(m)) == 0
    status = (
        F.when(hit(17), "missing").when(hit(13), "inconsistent").when(hit(19), "incomplete_verification").when(hit(11), "partially_verified").otherwise("verified")
    )
    code = F.when(hit(17), "ROW_ABSENT").when(hit(13), "VALUE_MISMATCH").when(hit(19), "UNKNOWN_TOOL").when(hit(11), "MULTI_EFFECT_PARTIAL")
    rows = spread(orders.select("o_orderkey", "o_orderdate"), "o_orderkey").withColumn("run_index", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).filter(F.pmod(k + r, F.lit(23)) != 0)
    second = F.when(F.pmod(h, F.lit(2)) == 0, F.struct(F.lit("b").alias("id"), F.lit("missing").alias("status"), F.lit("ROW_ABSENT").alias("code"))).otherwise(
        F.struct(F.lit("b").alias("id"), F.lit("inconsistent").alias("status"), F.lit("VALUE_MISMATCH").alias("code")))
    first = F.struct(F.lit("a").alias("id"), F.lit("verified").alias("status"), F.lit(None).cast("string").alias("code"))
    key = F.when(F.pmod(k, F.lit(10)) == 3, k - 1).otherwise(k)
    out = sealed(rows.select(
        F.concat(F.lit("wf_"), F.floor(k / 20)).alias("workflow_id"), "run_index", k.alias("seq"),
        F.when(status == "incomplete_verification", "ghost.tool").when(F.pmod(k, F.lit(2)) == 0, "orders.upsert").otherwise("orders.audit").alias("tool_id"),
        status.alias("status"), code.alias("code"), F.when(status == "partially_verified", F.array(first, second)).alias("effects"),
        F.when(status != "incomplete_verification", F.concat(F.lit("sql_row|orders|o_orderkey="), key)).alias("logical_step_key")))
    return out
