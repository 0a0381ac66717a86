"""Small decision tables and text rules over columns."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from claimlake.functions.catalog import RESOLVER_CODES
from claimlake.functions.scalars import js_trim

# Patterns and limits of text redaction.
_SPACE = r"[\s\u00A0\uFEFF\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
_NOT_SPACE = r"[^\s\u00A0\uFEFF\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
BEARER = f"(?i)Bearer{_SPACE}+{_NOT_SPACE}+"
SECRET_KEY = "(?i)sk-[a-zA-Z0-9]{20,}"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
REDACT_MAX = 240


def utf16_length(s: Column) -> Column:
    return F.octet_length(F.encode(s, "UTF-16BE")) / 2


def redact(s: Column, shorten: bool = False) -> Column:
    """Mask bearer tokens, secret keys and e-mail addresses; where asked to shorten, a long masked text becomes its length."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, BEARER, "[REDACTED_BEARER]"), SECRET_KEY, "[REDACTED_SK]"), EMAIL, "[REDACTED_EMAIL]")
    if not shorten:
        return t
    n = utf16_length(t).cast("int")
    return F.when(n > REDACT_MAX, F.concat(F.lit("[REDACTED_LONG_STRING_LEN_"), n.cast("string"), F.lit("]"))).otherwise(t)


def redact_json(s: Column, shorten: bool = False) -> Column:
    """The same for every string value inside a JSON text; keys, numbers and shape stay. Text that is no JSON is masked whole."""
    rules = [(re.compile(p), by) for p, by in ((BEARER, "[REDACTED_BEARER]"), (SECRET_KEY, "[REDACTED_SK]"), (EMAIL, "[REDACTED_EMAIL]"))]

    def mask(text: str) -> str:
        for pattern, by in rules:
            text = pattern.sub(by, text)
        n = len(text.encode("utf-16-le", "surrogatepass")) // 2
        return f"[REDACTED_LONG_STRING_LEN_{n}]" if shorten and n > REDACT_MAX else text

    def walk(value):
        if isinstance(value, dict):
            return {k: walk(v) for k, v in value.items()}
        return [walk(v) for v in value] if isinstance(value, list) else mask(value) if isinstance(value, str) else value

    def masked(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return json.dumps(walk(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return mask(text)

    @F.pandas_udf("string")
    def redacted(texts: pd.Series) -> pd.Series:
        return texts.map(masked, na_action="ignore")

    return redacted(s)


# Attribution fields and their longest length in code points.
UTM_KEYS = ["utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term"]
PATH_KEYS = ["landing_path", "referrer_path"]
ATTRIBUTION_LIMITS = {k: 128 for k in UTM_KEYS} | {k: 512 for k in PATH_KEYS}


def attribution_problem(values: dict[str, Column], keys: Column) -> Column:
    """First violation of an attribution record, null when it is clean. A record with any violation is rejected whole."""
    checks = []
    for name, limit in ATTRIBUTION_LIMITS.items():
        if name not in values:
            continue
        t = js_trim(values[name])
        checks += [
            F.when(t.rlike("[\\x00-\\x1F\\x7F-\\x9F]"), F.lit(f"ATTRIBUTION_CONTROL_{name}")),
            F.when(t.contains("://"), F.lit("ATTRIBUTION_PROTOCOL")),
            F.when(F.length(t) > limit, F.lit(f"ATTRIBUTION_LENGTH_{name}")),
        ]
    unknown = F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in ATTRIBUTION_LIMITS])))
    checks.append(F.when(F.size(unknown) > 0, F.concat(F.lit("ATTRIBUTION_UNKNOWN_"), unknown[0])))
    return F.coalesce(*checks)


def attribution_json_problem(raw: Column) -> Column:
    """The same over the JSON text of a record: also a root that is no object, and values that are no text. A null record is clean."""
    v = F.try_parse_json(raw)
    checks = [F.when(~F.schema_of_variant(v).startswith("OBJECT") & (F.schema_of_variant(v) != "VOID"), "ATTRIBUTION_ROOT")]
    for name in ATTRIBUTION_LIMITS:
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        checks.append(F.when(kind.isNotNull() & ~kind.isin("STRING", "VOID"), F.lit(f"ATTRIBUTION_TYPE_{name}")))
        text = F.when(kind == "STRING", F.try_variant_get(v, f"$.{name}", "string"))
        checks.append(attribution_problem({name: text}, F.array().cast("array<string>")))
    unknown = F.filter(F.json_object_keys(raw), lambda k: ~k.isin(list(ATTRIBUTION_LIMITS)))
    checks.append(F.when(F.size(unknown) > 0, F.concat(F.lit("ATTRIBUTION_UNKNOWN_"), F.try_element_at(unknown, F.lit(1)))))
    return F.coalesce(*checks)


UUID_V4 = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def anon_id(raw: Column) -> Column:
    """Lower-cased UUID v4, or null."""
    t = js_trim(raw)
    return F.when(t.rlike(UUID_V4), F.lower(t))


def hypothesis_label(raw: Column) -> Column:
    """Trimmed label of 1..240 printable ASCII characters without quotes, or null."""
    t = js_trim(raw)
    return F.when(t.rlike("^[\\x20\\x21\\x23-\\x26\\x28-\\x7E]{1,240}$"), t)


def entitlement(plan: Column, status: Column, intent: Column, emergency: Column) -> Column:
    """Deny code, or null when the request may go on to the quota check."""
    paid = plan.isin("individual", "team", "business", "enterprise")
    active = (status == "active") | (paid & emergency)
    return (
        F.when((intent == "enforce") & (plan == "starter"), "ENFORCEMENT_REQUIRES_PAID_PLAN")
        .when((intent == "verify") & (plan == "starter"), "VERIFICATION_REQUIRES_SUBSCRIPTION")
        .when(intent.isin("enforce", "verify") & paid & ~F.coalesce(active, F.lit(False)), "SUBSCRIPTION_INACTIVE")
    )


# Path endings and workflow ids of the shipped examples.
BUNDLED_SUFFIXES = [
    "/examples/events.ndjson",
    "/examples/tools.json",
    "/examples/demo.db",
    "/examples/partner-quickstart/partner.events.ndjson",
    "/examples/partner-quickstart/partner.tools.json",
    "/examples/partner-quickstart/partner.seed.sql",
]
SHIPPED_WORKFLOWS = ["wf_complete", "wf_missing", "wf_partner", "wf_bootstrap_fixture"]
SPINE_WORKFLOW = "wf_integrate_spine"


def _bundled(path: Column) -> Column:
    p = F.lower(F.translate(path, "\\", "/"))
    out = F.lit(False)
    for suffix in BUNDLED_SUFFIXES:
        out = out | p.endswith(suffix)
    return F.coalesce(out, F.lit(False))


def workload_class(db_kind: Column, *paths: Column) -> Column:
    every = F.lit(True)
    for p in paths:
        every = every & _bundled(p)
    return F.when((db_kind != "postgres") & every, "bundled_examples").otherwise("non_bundled")


def workflow_lineage(command: Column, workload: Column, workflow_id: Column) -> Column:
    wf = F.coalesce(js_trim(workflow_id), F.lit(""))
    return (
        F.when(command == "quick_verify", F.when(workload == "bundled_examples", "catalog_shipped").otherwise("integrator_scoped"))
        .when(wf == "", "unknown").when(wf == SPINE_WORKFLOW, "integrate_spine").when(wf.isin(SHIPPED_WORKFLOWS), "catalog_shipped")
        .otherwise("integrator_scoped")
    )


def report_freshness(issued_at: Column, as_of: Column, max_age_hours: int) -> Column:
    t = F.try_to_timestamp(issued_at)
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(t)
    return F.when(t.isNull(), "invalid").when(age > max_age_hours * 3_600_000_000, "stale").otherwise("fresh")


def activation_metadata(version: Column, lineage: Column, terminal: Column) -> Column:
    """Metadata JSON of an outcome by wire version; first-version clients carry no attribution."""
    return F.to_json(F.struct(
        version.alias("schema_version"), terminal.alias("terminal_status"),
        F.when(version == 1, "legacy_unattributed").otherwise("cli").alias("telemetry_source"),
        F.when(version >= 3, lineage).alias("workflow_lineage")))


# Codes that point at the set-up rather than at the workflow.
SETUP_CODES = ["MULTI_EFFECT_INCOMPLETE", "UNKNOWN_TOOL", *RESOLVER_CODES, "CONNECTOR_ERROR", "ROW_SHAPE_MISMATCH", "UNREADABLE_VALUE", "RELATIONAL_SCALAR_UNUSABLE"]


def failure_diagnostic(status: Column, code: Column) -> Column:
    """Which side a non-verified step points at."""
    return (
        F.when(status == "uncertain", "observation_uncertainty").when(status.isin("missing", "inconsistent", "partially_verified"), "workflow_execution")
        .when(code == "RETRY_OBSERVATIONS_DIVERGE", "workflow_execution").when(code.isin(SETUP_CODES), "verification_setup")
    )


# Outcome label per step status.
STATUS_LABELS = {
    "verified": "VERIFIED",
    "missing": "FAILED_ROW_MISSING",
    "inconsistent": "FAILED_VALUE_MISMATCH",
    "incomplete_verification": "INCOMPLETE_CANNOT_VERIFY",
    "partially_verified": "PARTIALLY_VERIFIED",
    "uncertain": "UNCERTAIN_NOT_OBSERVED_WITHIN_WINDOW",
}


def outcome_label(status: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in STATUS_LABELS.items() for x in pair])[status]


# --- log lines ------------------------------------------------------------------------------

# What a log line may carry before its JSON.
ANSI = "\\x1b\\[[\\d;?]*[\\s\\-/]*[@-~]"
LOG_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\s+"
LOG_LEVEL = r"(?i)^(?:DEBUG|INFO|WARN|WARNING|ERROR|TRACE)\s+"
LOG_BRACKET = r"^\[[^\]]{1,64}\]\s+"


def log_untimed(line: Column) -> Column:
    """A log line without colours and its leading time."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(line, ANSI, "")), LOG_TIME, ""))


def untimed_salvage(s1: Column) -> Column:
    """The JSON text of a log line whose time is gone."""
    s2 = F.trim(F.regexp_replace(s1, LOG_LEVEL, ""))
    s3 = F.trim(F.regexp_replace(s1, LOG_BRACKET, ""))
    reads = lambda s: F.try_parse_json(s).isNotNull() & (s != "null")
    return F.when(reads(s1), s1).when((s1 != s2) & reads(s2), s2).when((s1 != s3) & reads(s3), s3)


def log_salvage(line: Column) -> Column:
    """The JSON text of a log line: as it is, or after its time, level or bracket prefix; null if none parses."""
    return untimed_salvage(log_untimed(line))


_KEY_STEPS = r"^(?:(?:\[\d+\]|[^.\[]+)\.?)*+"


def flat_key_problem(key: Column) -> Column:
    """Why a flat key is no pointer, by its first bad place; null when it is well formed."""
    rest = F.regexp_replace(key, _KEY_STEPS, "")
    return F.when(key == "", "EMPTY_KEY").when(rest == "", F.lit(None)).when(rest.startswith("[") & rest.contains("]"), "INVALID_ARRAY_INDEX").otherwise(
        F.when(rest.isNotNull(), "INVALID_SYNTAX"))


def flat_key_pointer(key: Column) -> Column:
    """a.b[0] -> /a/b/0; a dot may end the key. Null when the key is not well formed."""
    escaped = F.regexp_replace(F.regexp_replace(key, "~", "~0"), "/", "~1")
    steps = F.regexp_replace(F.regexp_replace(escaped, r"\[(\d+)\]\.?", "/$1/"), r"\.", "/")
    pointer = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(steps, "/+", "/"), "^/|/$", ""))
    return F.when(flat_key_problem(key).isNull() & key.isNotNull(), pointer)
