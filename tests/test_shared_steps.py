"""The step that all verdicts share: claims to resolved and stored checks."""

import json

import pyspark.sql.functions as F
import pytest

from claimlake import session
from claimlake.functions.jsonval import known_at
from claimlake.operators.resolve import resolve_fixed
from claimlake.plans.verify import Verification
from claimlake.sources.registry import Registry
from claimlake.sources.state import State

TOOL = {"toolId": "put", "effectDescriptionTemplate": "Put {/id} {/gone/0}", "verification": {"kind": "sql_effects", "effects": [
    {"id": "one", "table": {"const": "t"}, "identityEq": [{"column": {"const": "k"}, "value": {"pointer": "/id"}}], "requiredFields": {"pointer": "/fields"}},
    {"id": "two", "table": {"const": "t"}, "identityEq": [{"column": {"const": "k"}, "value": {"pointer": "/more/0"}}], "requiredFields": {"pointer": "/fields"}}]}}
PARAMS = [{"id": 1, "fields": {"b": "x", "_a": 1.50, "B": None}, "more": [2]}, {"id": "1", "fields": {}, "more": {"0": 3}}, {"fields": 5}, {"id": {}, "fields": {"z": []}, "gone": ["g"]}]


@pytest.fixture(scope="module")
def claims(spark):
    rows = [("w", i, "put" if i < 4 else "other", json.dumps(PARAMS[i % 4]), None, "f", i, 1, i == 3) for i in range(5)]
    return spark.createDataFrame(rows, "workflow_id string, seq bigint, tool_id string, params string, ts string, source_file string, line_no bigint, repeat_count bigint, divergent boolean")


def test_known_paths_give_the_values_of_any_path(spark, claims):
    registry = Registry([TOOL])
    paths = registry.value_paths()
    assert '$["id"]' in paths and len(paths) == len(set(paths))
    rows = lambda df: sorted(str(r) for r in df.collect())
    assert rows(resolve_fixed(claims, registry.fixed_checks(spark))) == rows(resolve_fixed(claims, registry.fixed_checks(spark), paths))
    at = claims.select(F.try_parse_json("params").alias("d"), F.explode(F.array(*map(F.lit, paths))).alias("p"))
    assert rows(at.select(F.to_json(known_at(F.col("d"), F.col("p"), paths)).alias("v"))) == rows(at.select(F.to_json(known_at(F.col("d"), F.col("p"), [])).alias("v")))


def test_a_claim_is_told_once_whatever_kinds_are_asked(spark, claims):
    registry = Registry([TOOL | {"toolId": "other", "verification": TOOL["verification"] | {"effects": TOOL["verification"]["effects"][1:]}}, TOOL])
    told = {(r.seq, r.check_id): r.narrative for r in resolve_fixed(claims, registry.fixed_checks(spark), registry.value_paths()).collect()}
    assert told[0, "one"] == told[0, "two"] == "Put 1 MISSING" and told[1, "two"] == 'Put "1" MISSING'
    assert (3, "two") not in told and told[3, "one"] == 'Put {} "g"' and told[4, "two"] == "Put 1 MISSING"
    none = resolve_fixed(claims, registry.fixed_checks(spark), registry.value_paths(), ["anti_join"]).collect()
    assert {r.narrative for r in none} == {"Unknown tool: put", "Unknown tool: other"} and len(none) == 5


def test_checks_write_only_what_a_claim_brings(spark, claims):
    state = State({"t": spark.createDataFrame([("1", "x")], "k string, b string")})
    checks = Verification(spark, None, Registry([TOOL]), state, claimed=claims.drop("repeat_count", "divergent")).checks
    written = set(spark.read.parquet(session._STORED[-1]).columns)
    assert not written & {"params", "ts", "field_kinds", "key_kinds", "n_anchor_keys"} and {"binding", "key", "required"} <= written
    assert {(r.seq, r.check_id): r.status for r in checks.filter("seq = 1").collect()} == {(1, "one"): "verified", (1, "two"): "missing"}
