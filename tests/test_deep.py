"""Exact sums, deep pages and jump pointers."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from claimlake.operators.exact import exact_double_sum
from claimlake.operators.topk import page
from claimlake.plans import trace as T
from claimlake.sources.state import State, state_facts


def exact(values):
    total = sum(map(Fraction, values))
    return total.numerator / total.denominator


def test_sums_are_exact_in_any_order_and_partitioning(spark):
    rng = random.Random(4)
    wild = lambda: math.ldexp(rng.uniform(-1, 1), rng.randint(-1074, 1020))
    groups = {
        0: [1e300, 1.0, -1e300, 1e-300], 1: [0.1] * 10, 2: [wild() for _ in range(300)], 3: [5e-324, 5e-324, -5e-324], 4: [1.7976931348623157e308, -1.7976931348623157e308, 2.2250738585072014e-308],
        5: [2.0**k for k in range(-1074, 1000, 7)], 6: [math.ldexp(1.5, -900), -math.ldexp(1.5, -901), math.ldexp(1, -1000)], 7: [-0.0, 0.0], 8: [2.0**53, 1.0, 1.0, -(2.0**32), 2.0**-33], 9: [rng.uniform(-1e9, 1e9) for _ in range(500)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [(7, None)]
    want = {k: exact(vs) for k, vs in groups.items()}
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        got = exact_double_sum(spark.createDataFrame(rows, "k int, v double").repartition(3 * seed), ["k"], F.col("v"), "s").collect()
        assert {r.k: r.s for r in got} == want
    odd = [(0, math.inf), (0, 1.0), (1, math.inf), (1, -math.inf), (2, math.nan), (2, 1.0), (3, 1.7976931348623157e308), (3, 1.7976931348623157e308), (4, -math.inf), (5, None)]
    got = {r.k: r.s for r in exact_double_sum(spark.createDataFrame(odd, "k int, v double"), ["k"], F.col("v"), "s").collect()}
    assert got[0] == got[3] == math.inf and math.isnan(got[1]) and math.isnan(got[2]) and got[4] == -math.inf and 5 not in got


def test_state_sums_take_bins_where_decimals_are_not_exact(spark):
    rows = [(1, 1e300, 0.5), (1, 1.0, 0.25), (1, -1e300, None), (2, 1e-300, 1.0), (3, None, 2.0)]
    state = State({"t": spark.createDataFrame(rows, "id int, far double, near double")})
    facts = state_facts(spark, state, ["sum:far|t|id", "sum:near|t|id", "sum:far|t|"])
    got = {(r.binding, *r.key): (r.n, r.total) for r in facts.collect()}
    assert got == {
        ("sum:far|t|id", "1"): (3, 1.0), ("sum:far|t|id", "2"): (1, 1e-300), ("sum:far|t|id", "3"): (1, 0.0), ("sum:near|t|id", "1"): (3, 0.75), ("sum:near|t|id", "2"): (1, 1.0), ("sum:near|t|id", "3"): (1, 2.0),
        ("sum:far|t|",): (5, 1.0)}
    assert state.inexact == {("t", "far"): True, ("t", "near"): False}


@pytest.mark.parametrize("offset", [0, 1, 499, 500, 2467, 4995, 5000, 9999])
def test_pages_at_any_depth(spark, offset):
    rows = spark.range(5000).select((F.col("id") * 37 % 101).alias("a"), "id")
    want = sorted(((i * 37 % 101, i) for i in range(5000)), key=lambda r: (-r[0], r[1]))[offset : offset + 50]
    assert [tuple(r) for r in page(rows, [F.col("a").desc(), F.col("id")], 50, offset).collect()] == want


def test_a_long_chain_answers_by_jumps(spark):
    n = 10_000
    edges = spark.range(1, n).select(F.lit("w").alias("workflow_id"), F.col("id").cast("string").alias("child"), (F.col("id") - 1).cast("string").alias("parent"))
    levels = T.jump_table(edges)
    assert len(levels) == 14 and sum(x.count() for x in levels) < n * 14
    asked = spark.createDataFrame([("w", "9999", 9999), ("w", "9999", 10_000), ("w", "5000", 4097), ("w", "3", 0), ("w", "9999", 99_999)], "workflow_id string, seed string, distance int")
    assert sorted((r.seed, r.distance, r.ancestor) for r in T.ancestor_at(levels, asked).collect()) == [("3", 0, "3"), ("5000", 4097, "903"), ("9999", 9999, "0")]
    paths = T.paths_up(levels, spark.createDataFrame([("w", "9999"), ("w", "4")], "workflow_id string, seed string"))
    assert paths.count() == 10_005 and {(r.ancestor, r.distance) for r in paths.filter("seed = '4'").collect()} == {(str(4 - d), d) for d in range(5)}
