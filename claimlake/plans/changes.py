"""Change-set rules: change rows against glob rules, per change set."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.operators.topk import EVIDENCE_ROWS, ranked

# Kinds of change rows, and the code each rule kind fails with.
ROW_KINDS = ["add", "modify", "delete", "rename", "copy", "type_change", "unmerged"]
RULE_CODES = {
    "matchingRowsMustHaveRowKinds": "PLAN_RULE_ROW_KIND_MISMATCH",
    "forbidMatchingRows": "PLAN_RULE_FORBIDDEN_ROW",
    "requireMatchingRow": "PLAN_RULE_REQUIRED_ROW_MISSING",
    "allChangedPathsMustMatchAllowlist": "PLAN_RULE_ALLOWLIST_VIOLATION",
    "requireRenameFromTo": "PLAN_RULE_RENAME_MISMATCH",
}


def glob_regex(pattern: str) -> str:
    """A path glob as an anchored regular expression: ** crosses folders, * and ? do not, {a,b} chooses."""
    if not pattern or ".." in pattern or pattern.startswith("/") or re.match(r"^[A-Za-z]:", pattern) or "\0" in pattern:
        raise ValueError(f"PLAN_VALIDATION_INVALID_PATTERN: {pattern!r}")
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, "|" if c == "," and depth else re.escape(c))
        i += 1
    return f"^{out}$"


def matches(path: Column, pattern: str) -> Column:
    return F.translate(path, "\\", "/").rlike(glob_regex(pattern))


def _touches(pattern: str) -> Column:
    return F.exists("paths", lambda p: matches(p, pattern))


def rule_hit(rule: dict) -> Column:
    """True for rows that count for a rule: violations, or for require-rules the wanted rows."""
    kind = rule["kind"]
    if kind == "matchingRowsMustHaveRowKinds":
        return _touches(rule["pattern"]) & ~F.col("row_kind").isin(rule["rowKinds"])
    if kind == "forbidMatchingRows":
        return _touches(rule["pattern"])
    if kind == "requireMatchingRow":
        return _touches(rule["pattern"]) & F.col("row_kind").isin(rule["rowKinds"])
    if kind == "allChangedPathsMustMatchAllowlist":
        allowed = lambda p: _any([matches(p, a) for a in rule["allowPatterns"]])
        return F.exists("paths", lambda p: ~allowed(p))
    wanted = ["rename", "copy"] if rule.get("includeCopy") else ["rename"]
    return F.col("row_kind").isin(wanted) & (F.size("paths") == 2) & matches(F.col("paths")[0], rule["fromPattern"]) & matches(F.col("paths")[1], rule["toPattern"])


def _any(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def rule_matches(changes: DataFrame, rules: list[dict]) -> DataFrame:
    """(change row, rule) pairs that count. Rules are configuration, so each is a compiled expression, not a joined row."""
    hits = F.array_compact(F.array(*[F.when(rule_hit(r), F.struct(F.lit(i).alias("seq"), F.lit(r["id"]).alias("rule_id"))) for i, r in enumerate(rules, 1)]))
    return changes.withColumn("hit", F.explode(hits)).select("*", "hit.seq", "hit.rule_id").drop("hit")


def evaluate_rules(changes: DataFrame, rules: list[dict]) -> DataFrame:
    """One step outcome per (change set, rule): counts combine map-side, then each rule is judged."""
    counted = changes.groupBy("change_id").agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(rule_hit(r)).alias(f"hits_{i}") for i, r in enumerate(rules)])
    required = ("requireMatchingRow", "requireRenameFromTo")
    verdicts = F.array(*[
        F.struct(
            F.lit(i + 1).alias("seq"), F.lit(r["id"]).alias("rule_id"), F.lit(RULE_CODES[r["kind"]]).alias("rule_code"),
            F.col(f"hits_{i}").alias("hits"), ((F.col(f"hits_{i}") > 0) if r["kind"] in required else (F.col(f"hits_{i}") == 0)).alias("holds"))
        for i, r in enumerate(rules)])
    return counted.select("change_id", "rows", F.explode(verdicts).alias("v")).select(
        "change_id", "rows", "v.seq", "v.rule_id", F.concat(F.lit("plan_transition.rule."), "v.rule_id").alias("tool_id"),
        F.when(F.col("v.holds"), "verified").otherwise("inconsistent").alias("status"), F.when(~F.col("v.holds"), F.col("v.rule_code")).alias("code"), "v.hits")


def rule_evidence(changes: DataFrame, rules: list[dict]) -> DataFrame:
    """Up to fifty violating rows per (change set, rule), with the number there are."""
    violations = rule_matches(changes, [r for r in rules if not r["kind"].startswith("require")])
    totals = violations.groupBy("change_id", "rule_id").agg(F.count(F.lit(1)).alias("total"))
    shown = ranked(violations, ["change_id", "rule_id"], ["row_kind", "paths"], EVIDENCE_ROWS)
    return shown.join(totals, ["change_id", "rule_id"]).withColumn("truncated", F.col("total") > EVIDENCE_ROWS)
