"""Scalar rules, skew helpers, globs and the entry contract."""

import random

import pytest
from pyspark.sql import functions as F

from claimlake.functions import scalars as S
from claimlake.operators import skew
from claimlake.plans.changes import glob_regex
from claimlake.streaming.streams import check_policy


def test_number_text(spark):
    cases = {10.0: "10", 0.1: "0.1", 1e21: "1e+21", 1.5e-7: "1.5e-7", 12345678.5: "12345678.5", 1e7: "10000000", 123456789012.0: "123456789012", -0.0: "0", 1e-6: "0.000001", 0.00012: "0.00012", -2.5: "-2.5"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "d double, want string")
    assert [r for r in df.select("d", "want", S.js_number(F.col("d")).alias("got")).collect() if r.want != r.got] == []


@pytest.mark.parametrize("hot", [True, False])
def test_lookup_join_keeps_every_row(spark, hot):
    rnd = random.Random(1)
    left = [(0 if rnd.random() < 0.4 else rnd.randrange(50), i) for i in range(2000)]
    lookup = [(k, f"v{k}") for k in range(40)]
    l = spark.createDataFrame(left, "k int, i int")
    r = spark.createDataFrame(lookup, "k int, v string")
    got = sorted(skew.lookup_join(l, r, ["k"], hot_rows=100 if hot else None, salts=8).collect(), key=lambda x: x.i)
    named = dict(lookup)
    assert [(x.k, x.i, x.v) for x in got] == [(k, i, named.get(k)) for k, i in left]


def test_block_helpers_match_brute_force(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("aab"), i, rnd.randrange(30)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, pos long, v int").repartition(7)
    block = F.floor(F.col("pos") / 37)
    want_pos, want_max, want_prev = {}, {}, {}
    for key in "ab":
        mine = [r for r in rows if r[0] == key]
        for n, r in enumerate(mine):
            want_pos[r[1]] = n
            want_max[r[1]] = max((x[2] for x in mine[:n]), default=None)
            want_prev[r[1]] = mine[n - 1][2] if n else None
    assert {r.pos: r.position for r in skew.block_positions(df, ["k"], block, ["pos"]).collect()} == want_pos
    assert {r.pos: r.m for r in skew.running_max_before(df, ["k"], block, ["pos"], "v", "m").collect()} == want_max
    assert {r.pos: (r.p.v if r.p else None) for r in skew.previous_row(df, ["k"], block, ["pos"], ["v"], "p").collect()} == want_prev


@pytest.mark.parametrize("pattern,path,want", [
    ("src/**", "src/a/b.ts", True), ("src/*", "src/a/b.ts", False), ("**/*.ts", "a.ts", True), ("**/*.{ts,js}", "x/y.js", True),
    ("docs/?.md", "docs/a.md", True), ("a.b", "axb", False), ("src/*", "src/.env", True),
])
def test_glob(pattern, path, want):
    import re

    assert bool(re.match(glob_regex(pattern), path)) is want


@pytest.mark.parametrize("bad", ["", "../x", "/x", "C:x"])
def test_glob_refuses(bad):
    with pytest.raises(ValueError):
        glob_regex(bad)


def test_policy():
    assert check_policy("strong") == (0, 0)
    assert check_policy("eventual", 1000, 100) == (1000, 100)
    for bad in [(0, 0), (10, 20), (1.5, 1)]:
        with pytest.raises(ValueError):
            check_policy("eventual", *bad)


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.count() > 0 and "status" in df.columns


def test_read_lines_keeps_file_order(spark, tmp_path):
    from claimlake.sources.events import read_lines

    (tmp_path / "a.ndjson").write_text("".join(f'{{"n":{i}}}\r\n' for i in range(5000)) + "\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.line for r in rows] == [f'{{"n":{i}}}' for i in range(5000)]
