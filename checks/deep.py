"""Queries of exact sums, deep pages and jump pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import query, table
from checks.tracing import _TR, nodes
from claimlake.operators.exact import exact_double_sum
from claimlake.operators.topk import page
from claimlake.plans import trace as T


# Whole multiples of 2**-12 up to 2**17, and for each line 1e300 and 1e-300 with either sign, which leave nothing behind.
@query("exact_sums", """SELECT l_suppkey, CAST(SUM(CAST(CASE WHEN l_orderkey%2=0 THEN l_linenumber ELSE -l_linenumber END * pow(2, l_partkey%30) AS HUGEINT)) AS DOUBLE) / 4096 AS total FROM lineitem GROUP BY l_suppkey""")
def exact_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    signed = F.when(F.col("l_orderkey") % 2 == 0, F.col("l_linenumber")).otherwise(-F.col("l_linenumber")) * F.pow(F.lit(2.0), F.col("l_partkey") % 30 - 12)
    far = [F.lit(s * x) * F.col("l_linenumber") for s in (1, -1) for x in (1e300, 1e-300)]
    return exact_double_sum(lines.select("l_suppkey", F.explode(F.array(signed, *far)).alias("v")), ["l_suppkey"], F.col("v"), "total")


@query("page_deep", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 1000")
def page_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return page(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 100, 1000)


@query("trace_jumps", _TR.replace("WITH n AS", "WITH RECURSIVE n AS") + """, ok AS (SELECT c.workflow_id, c.run_event_id AS child, p.run_event_id AS parent FROM n c JOIN n p ON c.workflow_id=p.workflow_id AND c.parent=p.run_event_id WHERE p.i<c.i),
ch AS (SELECT workflow_id, run_event_id AS seed, run_event_id AS ancestor, 0 AS distance FROM n
  UNION ALL SELECT ch.workflow_id, seed, parent, distance+1 FROM ch JOIN ok ON ok.workflow_id=ch.workflow_id AND ok.child=ch.ancestor) SELECT workflow_id, seed, distance, ancestor FROM ch WHERE distance IN (1, 6, 11)""")
def trace_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first, sixth and eleventh ancestor of every event, without its other ancestors."""
    rows = nodes(spark, sf_dir)
    parents = rows.select("workflow_id", F.col("run_event_id").alias("parent_run_event_id"), F.col("ingest_index").alias("pi"))
    edges = rows.join(parents, ["workflow_id", "parent_run_event_id"]).filter("pi < ingest_index").select(
        "workflow_id", F.col("run_event_id").alias("child"), F.col("parent_run_event_id").alias("parent"))
    seeds = rows.select("workflow_id", F.col("run_event_id").alias("seed"), F.explode(F.array(*[F.lit(n) for n in (1, 6, 11)])).alias("distance"))
    return T.ancestor_at(T.jump_table(edges), seeds)
