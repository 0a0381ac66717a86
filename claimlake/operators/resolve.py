"""Claims + registry -> resolved checks, or the first resolver problem in emit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.functions import jsonval as J
from claimlake.functions.jsonval import known_at
from claimlake.functions.scalars import js_number_text
from claimlake.functions.stage import sealed

IDENTIFIER = r"^[a-zA-Z_][a-zA-Z0-9_]*$"


def _problem(when: Column, ord_: Column | int, code: str, message: Column) -> Column:
    """A reported problem with its place in emit order, or null."""
    place = F.lit(ord_) if isinstance(ord_, int) else ord_
    return F.when(when, F.struct(place.alias("ord"), F.lit(code).alias("code"), message.alias("message")))


def _read(doc: Column, s: Column) -> Column:
    """Stage 1: the value each spec points at."""
    keep = [s[n].alias(n) for n in ("role", "ord", "side", "label", "const", "pointer", "v_const", "v_pointer")]
    return F.struct(
        *keep,
        F.when(s["path"].isNotNull(), J.variant_at(doc, s["path"], s["alt"])).alias("raw"),
        F.when(s["v_path"].isNotNull(), J.variant_at(doc, s["v_path"], s["v_alt"])).alias("v_raw"),
    )


def _schema(s: Column) -> Column:
    """Stage 2: variant schemas beside the values."""
    keep = [s[n].alias(n) for n in ("role", "ord", "side", "label", "const", "pointer", "v_const", "v_pointer", "raw", "v_raw")]
    return F.struct(*keep, F.schema_of_variant(s["raw"]).alias("sch"), F.schema_of_variant(s["v_raw"]).alias("v_sch"))


def _text(raw: Column, schema: Column) -> Column:
    """What String(x) gives for a scalar; objects and arrays have no text here."""
    text = raw.cast("string")
    return F.when(schema.isin("STRING", "BOOLEAN", "BIGINT"), text).when(schema.rlike("^(DECIMAL|DOUBLE)"), js_number_text(text))


def _type(s: Column) -> Column:
    """Stage 3: type and text of the name, type and text of the compared value."""
    return F.struct(
        s["role"].alias("role"), s["ord"].alias("ord"), s["side"].alias("side"), s["label"].alias("label"),
        s["pointer"].alias("pointer"), s["v_pointer"].alias("v_pointer"),
        F.when(s["pointer"].isNull(), "const").otherwise(J.variant_kind(s["sch"])).alias("kind"),
        F.when(s["pointer"].isNull(), s["const"]).otherwise(_text(s["raw"], s["sch"])).alias("text"),
        F.when(s["v_pointer"].isNull(), "const").otherwise(J.variant_kind(s["v_sch"])).alias("v_kind"),
        F.when(s["v_pointer"].isNull(), s["v_const"]).otherwise(_text(s["v_raw"], s["v_sch"])).alias("v_text"),
    )


def _judge(s: Column, prefix: Column, taken: Column) -> Column:
    """Stage 3: the first problem of one spec."""
    label, role, kind, text = F.concat(prefix, s["label"]), s["role"], s["kind"], s["text"]
    pair = role.isin("identity", "filter", "filter2")
    name = pair | (role == "name")
    named = F.when(pair, F.concat(label, F.lit(".column"))).otherwise(label)
    at = F.concat(F.lit(" at "), s["pointer"])
    say = lambda words: F.concat(named, F.lit(words), at)
    absent = kind.isin("missing", "null")
    pointed = kind != "const"
    v_absent = s["v_kind"].isin("missing", "null")
    code = (
        F.when((role == "table") & pointed & ((kind != "string") | (text == "")), "TABLE_POINTER_INVALID")
        .when(name & ~pointed & (text == ""), "CONST_STRING_EMPTY")
        .when(name & absent, "STRING_SPEC_POINTER_MISSING")
        .when(name & pointed & (kind != "string"), "STRING_SPEC_TYPE")
        .when(name & pointed & (text == ""), "STRING_SPEC_EMPTY")
        .when((name | (role == "table")) & ~text.rlike(IDENTIFIER), "INVALID_IDENTIFIER")
        .when((role == "filter") & F.array_contains(taken, text), "FILTER_EQ_OVERLAPS_IDENTITY")
        .when(pair & v_absent, "KEY_VALUE_POINTER_MISSING")
        .when(pair & s["v_kind"].isin("object", "array"), "KEY_VALUE_NOT_SCALAR")
        .when((role == "fields") & absent, "REQUIRED_FIELDS_POINTER_MISSING")
        .when((role == "fields") & (kind != "object"), "REQUIRED_FIELDS_NOT_OBJECT")
        .when((role == "expect") & (~kind.isin("number", "const") | text.try_cast("double").isNull()), "RELATIONAL_EXPECT_VALUE_INVALID")
    )
    return F.struct(s["ord"].alias("ord"), code.alias("code"), label.alias("label"), named.alias("named"), at.alias("at"),
                    kind.alias("kind"), text.alias("text"), s["v_pointer"].alias("v_pointer"))


def _explain(p: Column, prefix: Column) -> Column:
    """Stage 4, for failing specs only: the message of a problem."""
    code = p["code"]
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    message = (
        F.when(code == "TABLE_POINTER_INVALID", say(p["label"], ": expected non-empty string", p["at"]))
        .when(code == "CONST_STRING_EMPTY", say(p["named"], ": const must be non-empty string"))
        .when(code == "STRING_SPEC_POINTER_MISSING", say(p["named"], ": missing", p["at"]))
        .when(code == "STRING_SPEC_TYPE", say(p["named"], ": expected string", p["at"]))
        .when(code == "STRING_SPEC_EMPTY", say(p["named"], ": empty string", p["at"]))
        .when(code == "INVALID_IDENTIFIER", say(p["named"], ": ", p["text"]))
        .when(code == "FILTER_EQ_OVERLAPS_IDENTITY", say(prefix, "filterEq column ", p["text"], " duplicates identityEq"))
        .when(code == "KEY_VALUE_POINTER_MISSING", say(p["label"], ". key.value missing at ", p["v_pointer"]))
        .when(code == "KEY_VALUE_NOT_SCALAR", say(p["label"], ". key.value must be scalar at ", p["v_pointer"]))
        .when(code == "REQUIRED_FIELDS_POINTER_MISSING", say(p["label"], " missing", p["at"]))
        .when(code == "REQUIRED_FIELDS_NOT_OBJECT", say(p["label"], " must be object", p["at"]))
        .when(p["kind"] == "const", say(p["label"], ": const must be a finite number"))
        .when(p["kind"].isin("missing", "null"), say(p["label"], ": missing number", p["at"]))
        .otherwise(say(p["label"], ": expected finite number", p["at"]))
    )
    return F.struct(p["ord"].alias("ord"), code.alias("code"), message.alias("message"))


def _of(role: str) -> Column:
    return F.filter("typed", lambda s: s["role"] == role)


def _texts(role: str) -> Column:
    return F.transform(_of(role), lambda s: s["text"])


def _equalities(role: str) -> Column:
    """Sorted column = value pairs; a join's columns are told apart by side."""
    return F.array_sort(F.transform(
        _of(role), lambda s: F.struct(F.concat_ws(".", s["side"], s["text"]).alias("column"), s["v_text"].alias("value"))))


def _twice(pairs: Column) -> Column:
    """First column that stands twice in a sorted pair list."""
    following = F.slice(pairs, F.lit(2), F.greatest(F.size(pairs), F.lit(1)))
    hits = F.filter(F.zip_with(pairs, following, lambda a, b: F.when(a["column"] == b["column"], a["column"])), lambda x: x.isNotNull())
    return F.try_element_at(hits, F.lit(1))


# Locale order of identifiers: underscore, digits, letters; lower case before upper on ties.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def locale_key(name: Column) -> Column:
    swapped = F.translate(name, _UPPER + _UPPER.lower(), _UPPER.lower() + _UPPER)
    return F.struct(F.translate(F.lower(name), "_", "!").alias("a"), swapped.alias("b"))


def render_effect(doc: Column, template: Column) -> Column:
    """Effect description: literal parts and the JSON text of each pointer."""
    return F.array_join(
        F.transform(template, lambda t: F.coalesce(t["const"], J.json_at(doc, t["path"], t["alt"]), F.lit("MISSING"))), ""
    )


def resolve_checks(steps: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per (step, check). Unknown tools and divergent steps give one row with no check.

    The work is staged over narrow projections, so every JSON path is read once per claim.
    """
    s, r = sealed(steps.withColumn("doc", F.try_parse_json("params"))).alias("s"), registry.alias("r")
    joined = s.join(
        r, (F.col("s.tool_id") == F.col("r.tool_id")) & (~F.col("s.divergent") | (F.col("r.check_ord") == 0)), "left"
    ).select("s.*", *[F.col(f"r.{c}") for c in registry.columns if c != "tool_id"])

    doc, prefix = F.col("doc"), F.coalesce(F.col("prefix"), F.lit(""))
    read = (
        joined.withColumn("read", F.transform(F.transform("specs", lambda x: _read(doc, x)), _schema))
        .withColumn("narrative", F.when(F.col("check_kind").isNull(), F.concat(F.lit("Unknown tool: "), F.col("tool_id"))).otherwise(render_effect(doc, F.col("template"))))
        .withColumn("entries", F.when(F.col("fields_path").isNotNull(), F.transform(
            F.map_entries(F.call_function("try_variant_get", doc, F.col("fields_path"), F.lit("map<string,variant>"))),
            lambda e: F.struct(e["key"].alias("k"), e["value"].alias("raw"), F.schema_of_variant(e["value"]).alias("sch")))))
        .drop("doc", "specs", "template", "fields_path", "fields_alt")
    )
    typed = (
        sealed(read).withColumn("typed", F.transform("read", _type))
        .withColumn("entries", F.transform("entries", lambda e: F.struct(e["k"].alias("k"), J.variant_kind(e["sch"]).alias("t"), F.when(e["sch"] == "VOID", "null").otherwise(_text(e["raw"], e["sch"])).alias("v"))))
        .drop("read")
    )
    named = (
        sealed(typed).withColumn("table_name", F.try_element_at(_texts("table"), F.lit(1)))
        .withColumn("lookup_table", F.try_element_at(_texts("table"), F.lit(2)))
        .withColumn("name_list", _texts("name"))
        .withColumn("identity_eq", _equalities("identity"))
        .withColumn("filter_eq", _equalities("filter"))
        .withColumn("filter2_eq", _equalities("filter2"))
        .withColumn("expect_value", F.try_element_at(_texts("expect"), F.lit(1)).try_cast("double"))
        .withColumn("required", F.when(F.col("check_kind") == "sql_row", F.array_sort(F.transform(
            "entries", lambda e: F.struct(locale_key(e["k"]).alias("o"), e["k"].alias("k"), e["t"].alias("t"), e["v"].alias("v"))))))
    )
    taken = F.when(F.col("check_kind") == "sql_row_absent", F.transform("identity_eq", lambda p: p["column"])).otherwise(F.array().cast("array<string>"))
    judged = sealed(named).withColumn("taken", taken).withColumn(
        "failing", F.filter(F.transform("typed", lambda x: _judge(x, prefix, F.col("taken"))), lambda p: p["code"].isNotNull())
    )
    kind = F.col("check_kind")
    repeated = lambda pairs, ord_, label: F.when(
        _twice(F.col(pairs)).isNotNull(),
        F.struct(F.lit(ord_).alias("ord"), F.lit("EQUALITY_DUPLICATE_COLUMN").alias("code"),
                 F.concat(prefix, F.lit(f"{label}duplicate equality column: "), _twice(F.col(pairs))).alias("message")))
    bad_entries = F.filter(F.transform("entries", lambda e: F.struct(
        F.lit(700).alias("ord"),
        F.when(~e["k"].rlike(IDENTIFIER), "INVALID_IDENTIFIER").when(e["t"].isin("object", "array"), "REQUIRED_FIELDS_VALUE_NOT_SCALAR").alias("code"),
        F.when(~e["k"].rlike(IDENTIFIER), F.concat(prefix, F.lit("requiredFields key: "), e["k"]))
        .otherwise(F.concat(prefix, F.lit("requiredFields."), e["k"], F.lit(" must be string, number, boolean, or null"))).alias("message"),
    )), lambda p: p["code"].isNotNull())
    whole = F.array_compact(F.array(
        _problem(F.col("divergent"), -3, "RETRY_OBSERVATIONS_DIVERGE", F.lit(
            "Multiple observations for this seq do not all match the last observation (toolId and canonical params).")),
        _problem(kind.isNull(), -2, "UNKNOWN_TOOL", F.concat(F.lit("Unknown toolId: "), F.col("tool_id"))),
        F.when(F.col("static_code").isNotNull(), F.struct(F.lit(-1).alias("ord"), F.col("static_code").alias("code"), F.col("static_message").alias("message"))),
        _problem((kind == "aggregate") & (F.col("fn") == "SUM") & (F.size("name_list") == 0), 99, "RELATIONAL_SUM_COLUMN_REQUIRED",
                 F.concat(prefix, F.lit("sumColumn required when fn is SUM"))),
        F.when(kind.isin("sql_row", "sql_row_absent", "related_exists"), repeated("identity_eq", 299, "")),
        F.when(kind == "sql_row_absent", repeated("filter_eq", 500, "filterEq: ")),
        F.when(kind == "anti_join", repeated("filter_eq", 500, "filterEqAnchor: ")),
        F.when(kind == "anti_join", repeated("filter2_eq", 501, "filterEqLookup: ")),
        F.when(kind == "sql_row", F.try_element_at(bad_entries, F.lit(1))),
    ))
    none = F.array().cast("array<struct<ord:int,code:string,message:string>>")
    spec_problems = F.when(F.size("failing") > 0, F.transform("failing", lambda p: _explain(p, prefix))).otherwise(none)
    out = sealed(judged).withColumn("problem", F.array_min(F.concat(whole, F.coalesce(spec_problems, none))))
    return sealed(_with_binding(sealed(out.drop("typed", "failing", "entries", "taken"))).select(
        *steps.columns, "tool_kind", "check_ord", "check_id", "check_kind", "n_checks", "narrative",
        F.col("problem.code").alias("problem_code"), F.col("problem.message").alias("problem_message"),
        "table_name", "lookup_table", "name_list", "identity_eq", "filter_eq", "filter2_eq", "required",
        "fn", "expect_op", "expect_value", "binding", "key_values",
    ))


def _columns(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: p["column"]), ",")


def _with_binding(df: DataFrame) -> DataFrame:
    """Name the keyed fact a check reads, and the key values it looks up.

    Checks with the same binding read the same pre-aggregated state, however many claims there are.
    """
    kind = F.col("check_kind")
    keyed = (
        F.when(kind == "sql_row_absent", F.array_sort(F.concat("identity_eq", "filter_eq")))
        .when(kind == "anti_join", F.concat("filter_eq", "filter2_eq"))
        .when(kind.isin("aggregate", "join_count"), F.col("filter_eq"))
        .otherwise(F.col("identity_eq"))
    )
    joined_names = F.array_join("name_list", "|")
    binding = (
        F.when(kind == "sql_row", F.concat_ws("|", F.lit("row"), "table_name", _columns(F.col("keyed"))))
        .when(kind == "join_count", F.concat_ws("|", F.lit("join"), "table_name", "lookup_table", joined_names, _columns(F.col("keyed"))))
        .when(kind == "anti_join", F.concat_ws("|", F.lit("orphan"), "table_name", "lookup_table", joined_names, _columns(F.col("filter_eq")), _columns(F.col("filter2_eq"))))
        .when((kind == "aggregate") & (F.col("fn") == "SUM"), F.concat_ws("|", F.concat(F.lit("sum:"), F.col("name_list")[0]), "table_name", _columns(F.col("keyed"))))
        .otherwise(F.concat_ws("|", F.lit("count"), "table_name", _columns(F.col("keyed"))))
    )
    return df.withColumn("keyed", keyed).withColumn(
        "binding", F.when(F.col("problem").isNull(), binding)
    ).withColumn("key_values", F.when(F.col("problem").isNull(), F.transform("keyed", lambda p: p["value"])))


# --- registries whose names are all constants -------------------------------------------------

_FAILING = """
transform(filter(typed, s -> s.pointer is not null and s.kind in ('missing', 'null', 'object', 'array')), s -> named_struct(
  'ord', s.ord, 'code', if(s.kind in ('missing', 'null'), 'KEY_VALUE_POINTER_MISSING', 'KEY_VALUE_NOT_SCALAR'),
  'message', concat(s.label, if(s.kind in ('missing', 'null'), '. key.value missing at ', '. key.value must be scalar at '), s.pointer)))
"""
_WHOLE = """
array_compact(array(
  case when divergent then named_struct('ord', -3, 'code', 'RETRY_OBSERVATIONS_DIVERGE', 'message',
    'Multiple observations for this seq do not all match the last observation (toolId and canonical params).') end,
  case when check_kind is null then named_struct('ord', -2, 'code', 'UNKNOWN_TOOL', 'message', concat('Unknown toolId: ', tool_id)) end,
  case when static_code is not null then named_struct('ord', static_ord, 'code', static_code, 'message', static_message) end,
  case when check_kind = 'sql_row' and fields_kind in ('missing', 'null') then named_struct('ord', 600, 'code', 'REQUIRED_FIELDS_POINTER_MISSING',
    'message', concat(prefix, 'requiredFields missing at ', fields_pointer)) end,
  case when check_kind = 'sql_row' and fields_kind not in ('missing', 'null', 'object') then named_struct('ord', 600, 'code', 'REQUIRED_FIELDS_NOT_OBJECT',
    'message', concat(prefix, 'requiredFields must be object at ', fields_pointer)) end,
  try_element_at(transform(filter(required, e -> not (e.k rlike '^[a-zA-Z_][a-zA-Z0-9_]*$') or e.t in ('object', 'array')), e -> named_struct(
    'ord', 700, 'code', if(not (e.k rlike '^[a-zA-Z_][a-zA-Z0-9_]*$'), 'INVALID_IDENTIFIER', 'REQUIRED_FIELDS_VALUE_NOT_SCALAR'),
    'message', if(not (e.k rlike '^[a-zA-Z_][a-zA-Z0-9_]*$'), concat(prefix, 'requiredFields key: ', e.k),
      concat(prefix, 'requiredFields.', e.k, ' must be string, number, boolean, or null')))), 1),
  case when expect_pointer is not null and expect_value is null then named_struct('ord', 800, 'code', 'RELATIONAL_EXPECT_VALUE_INVALID', 'message',
    concat(prefix, if(expect_kind in ('missing', 'null'), 'expect.value: missing number at ', 'expect.value: expected finite number at '), expect_pointer)) end))
"""


def resolve_fixed(steps: DataFrame, registry: DataFrame, paths: list[str] = (), kinds: list[str] | None = None) -> DataFrame:
    """Same result as resolve_checks when every table and column name is a constant.

    Names, their validity and the fact binding come ready from the registry; a claim only supplies values. A claim's text and
    its description are made once, before the claim meets the checks of its tool. paths: the registry's paths, compiled once.
    """
    doc, known = F.col("doc"), list(paths)
    parts = F.transform("template", lambda t: F.coalesce(
        t["const"], F.to_json(known_at(doc, t["path"], known)), F.to_json(known_at(doc, t["alt"], known)), F.lit("MISSING")))
    tools = registry.filter("check_ord = 0").select("tool_id", "template")
    told = sealed(steps.withColumn("doc", F.try_parse_json("params"))).join(tools, "tool_id", "left").select(
        *steps.columns, "doc", F.array_join(parts, "").alias("effect"))
    s, r = told.alias("s"), (registry.filter(F.col("check_kind").isin(kinds)) if kinds else registry).drop("template").alias("r")
    joined = s.join(
        r, (F.col("s.tool_id") == F.col("r.tool_id")) & (~F.col("s.divergent") | (F.col("r.check_ord") == 0)), "left"
    ).select("s.*", *[F.col(f"r.{c}") for c in registry.columns if c not in ("tool_id", "template")])
    read = F.transform("fixed_values", lambda v: F.struct(v.alias("s"), F.when(v["path"].isNotNull(), F.coalesce(
        known_at(doc, v["path"], known), F.when(v["alt"].isNotNull(), known_at(doc, v["alt"], known)))).alias("raw")))
    seen = F.transform(read, lambda v: F.struct(v["s"].alias("s"), v["raw"].alias("raw"), F.schema_of_variant(v["raw"]).alias("sch")))
    entries = F.transform(
        F.transform(
            F.map_entries(F.call_function("try_variant_get", known_at(doc, F.col("fields_path"), known), F.lit("$"), F.lit("map<string,variant>"))),
            lambda e: F.struct(e["key"].alias("k"), e["value"].alias("raw"), F.schema_of_variant(e["value"]).alias("sch"))),
        lambda e: F.struct(
            locale_key(e["k"]).alias("o"), e["k"].alias("k"), J.variant_kind(e["sch"]).alias("t"),
            F.when(e["sch"] == "VOID", "null").otherwise(_text(e["raw"], e["sch"])).alias("v")))
    expect = known_at(doc, F.col("expect_path"), known)
    expect_kind = J.variant_kind(F.schema_of_variant(expect))
    expect_value = F.when(F.col("expect_const").isNotNull(), F.col("expect_const")).when(
        expect_kind == "number", F.call_function("try_variant_get", expect, F.lit("$"), F.lit("double")))
    typed = sealed(joined.select(
        *[c for c in joined.columns if c not in ("doc", "effect", "fixed_values", "fields_path", "expect_path", "expect_const")],
        F.when(F.col("check_kind").isNull(), F.concat(F.lit("Unknown tool: "), F.col("tool_id"))).otherwise(F.col("effect")).alias("narrative"),
        F.transform(seen, lambda v: F.struct(
            v["s"]["role"].alias("role"), v["s"]["ord"].alias("ord"), v["s"]["column"].alias("column"), v["s"]["label"].alias("label"), v["s"]["pointer"].alias("pointer"),
            J.variant_kind(v["sch"]).alias("kind"), F.coalesce(v["s"]["const"], _text(v["raw"], v["sch"])).alias("text"))).alias("typed"),
        F.when(F.col("fields_path").isNotNull(), F.sort_array(entries)).alias("required"),
        F.when(F.col("fields_path").isNotNull(), J.variant_kind(F.schema_of_variant(known_at(doc, F.col("fields_path"), known)))).otherwise("missing").alias("fields_kind"),
        F.when(F.col("expect_path").isNotNull(), expect_kind).otherwise("missing").alias("expect_kind"), expect_value.alias("expect_value"),
    ))
    pairs = lambda role: f"transform(filter(typed, s -> s.role = '{role}'), s -> named_struct('column', s.column, 'value', s.text))"
    none = "cast(array() as array<struct<ord:int,code:string,message:string>>)"
    judged = sealed(typed.selectExpr(
        *steps.columns, "tool_kind", "check_ord", "check_id", "check_kind", "n_checks", "narrative",
        f"array_min(concat({_WHOLE}, coalesce({_FAILING}, {none}))) as problem",
        "table_name", "lookup_table", "name_list", f"{pairs('identity')} as identity_eq", f"{pairs('filter')} as filter_eq", f"{pairs('filter2')} as filter2_eq",
        "required", "fn", "expect_op", "expect_value", "binding", "transform(typed, s -> s.text) as key_values",
    ))
    return judged.selectExpr(
        *steps.columns, "tool_kind", "check_ord", "check_id", "check_kind", "n_checks", "narrative",
        "problem.code as problem_code", "problem.message as problem_message", "table_name", "lookup_table", "name_list",
        "identity_eq", "filter_eq", "filter2_eq", "required", "fn", "expect_op", "expect_value",
        "case when problem is null then binding end as binding", "case when problem is null then key_values end as key_values",
    )
