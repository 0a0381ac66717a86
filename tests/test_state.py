"""Keyed facts of state tables."""

from decimal import Decimal

from pyspark.sql import functions as F

from claimlake.sources.state import State, state_facts


def facts(df):
    return {(r.binding, tuple(r.key)): (r.n, r.total, r.payload) for r in df.collect()}


def test_one_aggregate_serves_all_bindings_of_a_key(spark):
    state = State({"t": spark.createDataFrame([(1, "a", 2.5), (1, "a", 1.5), (2, "b", 1.0), (None, "a", 9.0)], "id long, name string, v double")})
    names = ["count|t|id", "sum:v|t|id", "row|t|id", "count|t|name", "count|t|ghost"]
    asked = spark.createDataFrame([(n, [k]) for n in names[:3] for k in ("1", "2", "7")] + [("count|t|name", ["a"])], "binding string, key array<string>")
    got = state_facts(spark, state, names, asked)
    assert facts(got) == {
        ("count|t|id", ("1",)): (2, None, None), ("count|t|id", ("2",)): (1, None, None), ("sum:v|t|id", ("1",)): (2, 4.0, None), ("sum:v|t|id", ("2",)): (1, 1.0, None),
        ("row|t|id", ("1",)): (2, None, None), ("row|t|id", ("2",)): (1, None, {"id": "2", "name": "b", "v": "1"}), ("count|t|name", ("a",)): (3, None, None)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2 and plan.count("LogicalRDD [id") + plan.count("LocalRelation [id") <= 2


def test_sums_do_not_depend_on_order(spark):
    values = [0.1, 0.2, 0.3, 1e15, -1e15] * 40
    for rows in (values, sorted(values), values[::-1]):
        state = State({"t": spark.createDataFrame([(1, v, 2**62, Decimal("0.10")) for v in rows], "id long, v double, big long, d decimal(10,2)").repartition(7)})
        got = facts(state_facts(spark, state, ["sum:v|t|id", "sum:big|t|id", "sum:d|t|id"]))
        assert got["sum:v|t|id", ("1",)][1] == 24.0 and got["sum:d|t|id", ("1",)][1] == 20.0 and got["sum:big|t|id", ("1",)][1] == float(200 * 2**62)


def test_claimed_texts_meet_typed_columns(spark):
    state = State({"t": spark.range(1).select(F.lit(5).cast("int").alias("i"), F.lit("1.50").cast("decimal(6,2)").alias("d"), F.lit("2024-01-02").cast("date").alias("day"), F.lit(True).alias("b"), F.lit(0.5).alias("x"))})
    asked = [("count|t|i", ["5"]), ("count|t|i", ["99999999999999"]), ("count|t|d", ["1.5000000000"]), ("count|t|day", ["1704153600000000"]), ("count|t|b", ["true"]), ("count|t|x", ["0.5"])]
    got = facts(state_facts(spark, state, [a for a, _ in dict(asked).items()], spark.createDataFrame(asked, "binding string, key array<string>")))
    assert set(got) == {(n, tuple(k)) for n, k in asked if k != ["99999999999999"]}


def test_stored_tables_can_be_cleared(spark):
    import glob

    from claimlake.session import clear_stored, shared_dir, stored

    found = lambda: set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/stored-*"))
    before = found()
    kept = stored(spark.range(5))
    mine = found() - before
    assert kept.count() == 5 and mine
    clear_stored(spark)
    assert not mine & found()
