"""Expectations inferred from activity logs that have no registry."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import accumulate, tee

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlake.functions import scoring as S
from claimlake.functions.decisions import ANSI, flat_key_pointer, log_untimed, untimed_salvage
from claimlake.functions.jsonval import variant_kind
from claimlake.functions.phrases import target_summary
from claimlake.functions.scalars import js_number_text, operational_message
from claimlake.functions.stage import sealed
from claimlake.operators.reconcile import attach_facts, judge_checks
from claimlake.operators.resolve import IDENTIFIER, locale_key
from claimlake.operators.similar import column_matches, token_matches
from claimlake.operators.skew import block_positions
from claimlake.session import stored
from claimlake.sources.state import State

TOOL_KEYS = ["toolId", "tool", "name", "function.name", "action"]
# What is not a parameter of an action without a parameter object.
NOT_PARAMS = ["tool_calls", "toolId", "tool", "name", "action", "function"]
GLOBAL = "__global__"
_REQUIRED = "array<struct<o:struct<a:string,b:string>,k:string,t:string,v:string>>"
#: An action stands after the calls listed inside it.
_OWN = 2**62


# --- actions ------------------------------------------------------------------------------------

def extract_actions(values: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, place, tool_name, params) from JSON values: objects, arrays of them, and tool_calls lists, however deep.

    values: ids, place (orderable), j (JSON text). One pass for each level of lists; a level without rows ends it.
    """
    level = values.select(*ids, F.array(F.col("place").cast("long")).alias("place"), "j")
    objects = []
    while True:
        head = F.substring(F.ltrim("j"), 1, 1)
        objects.append(level.filter(head == "{"))
        listed = F.expr("case when substring(ltrim(j), 1, 1) = '[' then from_json(j, 'array<string>') else from_json(get_json_object(j, '$.tool_calls'), 'array<string>') end")
        inner = level.select(*ids, "place", F.posexplode(listed).alias("i", "j")).filter(F.substring(F.ltrim("j"), 1, 1).isin("{", "["))
        level = stored(inner.select(*ids, F.concat("place", F.array(F.col("i").cast("long"))).alias("place"), "j"))
        if level.isEmpty():
            break
    every = objects[0]
    for more in objects[1:]:
        every = every.unionByName(more)
    at = lambda path: F.expr(f"try_variant_get(v, '$.{path}', 'variant')")
    is_text = lambda path: F.coalesce(F.schema_of_variant(at(path)) == "STRING", F.lit(False))
    text = lambda path: F.expr(f"try_variant_get(v, '$.{path}', 'string')")
    tool = F.coalesce(*[F.when(is_text(k) & (text(k) != ""), text(k)) for k in TOOL_KEYS])

    def body(path: str) -> Column:
        """An object, or a text that reads as one, as JSON text in its own order."""
        raw = F.trim(F.get_json_object("j", "$." + path))
        return F.when(raw.startswith("{") & F.coalesce(F.schema_of_variant(F.try_parse_json(raw)).startswith("OBJECT"), F.lit(False)), raw)

    named = is_text("function.name") & (text("function.name") != "")
    rest = F.expr(f"to_json(map_filter(try_variant_get(v, '$', 'map<string,variant>'), (k, x) -> k not in ({', '.join(repr(k) for k in NOT_PARAMS)})))")
    params = F.coalesce(F.when(named, body("function.arguments")), body("params"), body("arguments"), body("input"), body("function.arguments"), rest)
    parsed = sealed(every.withColumn("v", F.try_parse_json("j"))).filter("v is not null")
    own = F.concat("place", F.array(F.lit(_OWN)))
    return sealed(parsed.select(*ids, own.alias("place"), tool.alias("tool_name"), params.alias("params"))).filter("tool_name is not null")


def salvaged(lines: DataFrame) -> DataFrame:
    """(doc_id, place, j): the JSON of each line, null where there is none. In stages, or what makes a line would be done for every place that reads it."""
    made = sealed(lines.select("doc_id", "place", "line"))
    untimed = sealed(made.select("doc_id", "place", log_untimed(F.col("line")).alias("untimed")))
    return sealed(untimed.select("doc_id", "place", untimed_salvage(F.col("untimed")).alias("j")))


def ingest_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, place, j): the JSON of each activity line, found behind log prefixes where needed."""
    return salvaged(lines).filter("j is not null")


#: Inside a piece: a quoted text (to the end of the document if it is never closed), or a brace.
_MARK = re.compile(r"""(?s)"(?:[^"\\]|\\.)*+(?:"|\Z)|'(?:[^'\\]|\\.)*+(?:'|\Z)|[{}]""")
_STEP = {"{": 1, "}": -1}


def balanced_pieces(text: str) -> Iterator[str]:
    """The pieces of a text from an opening brace to the mark at which as many braces are closed as opened; quoted braces are no marks.

    Quotes between pieces mean nothing. A piece that is never closed is the last, and is none.
    """
    begin = text.find("{")
    while begin >= 0:
        marks, counted = tee(_MARK.finditer(text, begin))
        open_braces = accumulate(_STEP.get(m[0], 0) for m in counted)
        closing = next((m.end() for m, n in zip(marks, open_braces, strict=False) if n == 0), None)
        if closing is None:
            return
        yield text[begin:closing]
        begin = text.find("{", closing)


def ingest_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(actions, documents) of activity documents (doc_id, text): doc_id, place, tool_name, params; and doc_id, rung, malformed_lines, code.

    Each document takes the first rung that gives an action: the whole text as JSON, its lines, or the first piece
    between balanced braces.
    """
    clean = stored(documents.select("doc_id", F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "^\uFEFF", ""), ANSI, "").alias("text")))
    ids = ["doc_id"]
    whole = stored(extract_actions(clean.select("doc_id", F.lit(0).alias("place"), F.trim("text").alias("j")).filter("try_parse_json(j) is not null"), ids))
    left = clean.join(whole.select("doc_id").distinct(), "doc_id", "left_anti")
    lines = left.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line")).filter(F.trim("line") != "")
    read = stored(salvaged(lines))
    by_line = stored(extract_actions(read.filter("j is not null"), ids))
    malformed = read.groupBy("doc_id").agg(F.count_if(F.col("j").isNull()).alias("malformed_lines"))

    def pieces(batches):
        for batch in batches:
            doc, place, found = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for n, piece in enumerate(balanced_pieces(text)):
                    doc.append(i)
                    place.append(n)
                    found.append(piece)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), pa.array(place, pa.int64()), pa.array(found, pa.string())], ["doc_id", "place", "j"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    still = left.join(by_line.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "text")
    braced = stored(extract_actions(still.mapInArrow(pieces, f"doc_id {kind}, place long, j string"), ids))
    first = braced.groupBy("doc_id").agg(F.min(F.col("place")[0]).alias("piece"))
    braced = braced.join(first, "doc_id").filter(F.col("place")[0] == F.col("piece")).drop("piece")
    actions = whole.unionByName(by_line).unionByName(braced)
    rung = whole.select("doc_id", F.lit(1).alias("rung")).unionByName(by_line.select("doc_id", F.lit(2).alias("rung"))).unionByName(braced.select("doc_id", F.lit(3).alias("rung"))).distinct()
    judged = clean.join(rung, "doc_id", "left").join(malformed, "doc_id", "left").select(
        "doc_id", "rung", F.coalesce("malformed_lines", F.lit(0)).alias("malformed_lines"),
        F.when(F.col("rung").isNotNull(), F.lit(None)).when(F.trim("text") == "", "INGEST_NO_ACTIONS").otherwise("INGEST_NO_STRUCTURED_TOOL_ACTIVITY").alias("code"))
    return actions, judged


class _Number(str):
    """A JSON number as it is written."""


def _leaves(value, path: str, out: list) -> None:
    """Scalars inside a parsed JSON value, keys in order: (path, kind, text). Lists are entered for the objects and lists in them."""
    open_ = [(path, value)]
    while open_:
        path, value = open_.pop()
        if isinstance(value, dict):
            open_ += [(f"{path}.{k}" if path else k, value[k]) for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"), reverse=True)]
        elif isinstance(value, list):
            open_ += [(f"{path}[{i}]", value[i]) for i in range(len(value) - 1, -1, -1) if isinstance(value[i], dict | list)]
        elif value is None:
            out.append((path or "value", "null", "null"))
        elif isinstance(value, bool):
            out.append((path or "value", "boolean", "true" if value else "false"))
        elif isinstance(value, _Number):
            out.append((path or "value", "number", str(value)))
        else:
            out.append((path or "value", "string", value))


def flatten_params(actions: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, path, t, v, ord) for every scalar inside params, of any depth and number; ord is its place."""
    out = T.StructType([actions.schema[c] for c in ids] + [T.StructField("path", T.StringType()), T.StructField("t", T.StringType()), T.StructField("v", T.StringType()), T.StructField("ord", T.IntegerType())])

    def walk(batches):
        reader = json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=_Number)
        for batch in batches:
            row, found, place = [], [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                try:
                    value = reader.decode(text or "")
                except ValueError:
                    continue
                first = len(found)
                _leaves(value, "", found)
                row += [i] * (len(found) - first)
                place += range(len(found) - first)
            at = pa.array(row, pa.int64())
            columns = [c.take(at) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([f[k] for f in found], pa.string()) for k in range(3)), pa.array(place, pa.int32())], [*ids, "path", "t", "v", "ord"])

    flat = actions.select(*ids, "params").mapInArrow(walk, out)
    return flat.withColumn("v", F.when(F.col("t") == "number", js_number_text(F.col("v"))).otherwise(F.col("v")))


def dedupe_actions(flat: DataFrame, actions: DataFrame) -> DataFrame:
    """First action per document, tool and flat params; the number dropped travels along."""
    ids = ["doc_id", "place"]
    content = flat.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("path", "t", "v"))).alias("content"))
    keyed = actions.join(content, ids, "left").withColumn("content", F.to_json("content"))
    return keyed.groupBy("doc_id", "tool_name", "content").agg(F.min("place").alias("place"), (F.count(F.lit(1)) - 1).alias("dropped")).drop("content")


# --- scoring ------------------------------------------------------------------------------------

def _variants(spark: SparkSession, tables: list[str]) -> DataFrame:
    """(table_name, b): the words that stand for each table of the catalog."""
    names = spark.createDataFrame([(t,) for t in sorted(tables)], "table_name string")
    return names.select("table_name", F.explode(S.word_variants(F.col("table_name"))).alias("b"))


def tool_table_scores(tools: DataFrame, tables: list[str]) -> DataFrame:
    """Every distinct tool name against every table, at 0 where none of its words matches; rank 1 is the chosen table, ties by name."""
    variants = _variants(tools.sparkSession, tables)
    names = tools.select("tool_name").filter("tool_name is not null").distinct()
    words = names.select("tool_name", F.explode(F.array_distinct(S.tokens(F.col("tool_name")))).alias("a"))
    scored = words.join(stored(token_matches(words, variants)), "a").join(variants, "b").groupBy("tool_name", "table_name").agg(F.max("score").alias("score"))
    each = names.select("tool_name", F.explode(F.array(*[F.lit(t) for t in sorted(tables)])).alias("table_name"))
    every = each.join(scored, ["tool_name", "table_name"], "left").fillna(0.0, ["score"])
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("tool_name").orderBy(F.col("score").desc(), "table_name")))


def segment_tables(flat: DataFrame, tables: list[str]) -> DataFrame:
    """Best table of every distinct first path segment that matches one."""
    variants = _variants(flat.sparkSession, tables)
    segments = flat.select(F.split_part("path", F.lit("."), F.lit(1)).alias("a")).distinct()
    scored = stored(token_matches(segments, variants)).join(variants, "b")
    best = scored.groupBy(F.col("a").alias("segment")).agg(F.min(F.struct((-F.col("score")).alias("s"), "table_name")).alias("b"))
    return best.select("segment", F.col("b.table_name").alias("segment_table"), (-F.col("b.s")).alias("segment_score"))


def param_column_scores(keys: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distinct (table, mapping key) against every column of the table, at 0 where the names do not match."""
    asked = keys.select("table_name", "mapping_key").distinct()
    columns = catalog.select("table_name", "column_name", "is_primary")
    matches = stored(column_matches(asked, columns))
    return asked.join(columns, "table_name").join(matches, ["mapping_key", "column_name"], "left").fillna(0.0, ["score"])


def fk_checks(flat: DataFrame, catalog: DataFrame, ids: list[str]) -> DataFrame:
    """Per action and foreign-key column: the best matching parameter, as a related-row check; none where that parameter is null."""
    edges = catalog.filter("ref_table is not null").select("table_name", "column_name")
    matches = stored(column_matches(flat.select(F.col("path").alias("mapping_key")), edges))  # names are few: they are matched once
    # written, so that its size is known and flat is not shuffled by its few paths
    scored = stored(matches.filter(F.col("score") >= S.T_COLUMN).withColumnRenamed("mapping_key", "path").join(F.broadcast(edges), "column_name"))
    best = flat.join(scored, "path").groupBy(*ids, "table_name", "column_name").agg(F.min(F.struct((-F.col("score")).alias("s"), "ord", "path", "t", "v")).alias("b"))
    return best.filter("b.t <> 'null'").select(*ids, F.concat(F.lit("fk:"), "table_name", F.lit("."), "column_name").alias("check_id"), "table_name", "column_name", F.col("b.path").alias("path"), F.col("b.v").alias("value"))


# --- units --------------------------------------------------------------------------------------

def key_columns(catalog: DataFrame) -> DataFrame:
    """(table_name, column_name) of each table's key: its primary key, or else its first unique column by name."""
    primary = catalog.filter("is_primary").select("table_name", "column_name")
    unique = catalog.filter("is_unique").join(primary, "table_name", "left_anti").groupBy("table_name").agg(F.min("column_name").alias("column_name"))
    return primary.unionByName(unique)


def plan_units(flat: DataFrame, actions: DataFrame, catalog: DataFrame, tables: list[str]) -> DataFrame:
    """Row expectations per (action, bucket): table, identity, required fields and confidence. Every bucket gives a unit."""
    ids = ["doc_id", "place"]
    # tools without a match stand for the first table, at no score; so does the second place where only one table matches
    # names are few next to the parameters: what is known of them is written, so that its size is known and parameters are not shuffled by name
    best = stored(actions.select("tool_name").distinct().join(tool_table_scores(actions, tables), "tool_name", "left").groupBy("tool_name").agg(
        F.coalesce(F.max(F.when(F.col("rank") == 1, F.col("table_name"))), F.lit(min(tables))).alias("tool_table"), F.coalesce(F.max(F.when(F.col("rank") == 1, F.col("score"))), F.lit(0.0)).alias("s1"),
        F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0 if len(tables) > 1 else None).cast("double")).alias("s2")))
    segment = F.split_part("path", F.lit("."), F.lit(1))
    paths = flat.withColumn("segment", segment).join(stored(segment_tables(flat, tables)), "segment", "left").fillna(0.0, ["segment_score"]).join(actions.select(*ids, "tool_name"), ids).join(best, "tool_name")
    bucket = F.when(F.col("segment_score") >= S.T_TABLE, F.col("segment_table")).otherwise(GLOBAL)
    nested = F.col("path").contains(".") & (F.col("bucket") != GLOBAL)
    keyed = stored(paths.withColumn("bucket", bucket).withColumn("table_name", F.when(F.col("bucket") == GLOBAL, F.col("tool_table")).otherwise(F.col("bucket"))).withColumn(
        "mapping_key", F.when(nested, F.expr("substring(path, instr(path, '.') + 1)")).otherwise(F.col("path"))))
    keys = key_columns(catalog).withColumn("is_key", F.lit(True))
    columns = catalog.select("table_name", "column_name", "is_primary").join(keys, ["table_name", "column_name"], "left").withColumn("is_primary", F.coalesce("is_key", F.lit(False))).drop("is_key")
    scores = stored(param_column_scores(keyed, columns).filter(F.col("score") >= S.T_COLUMN))
    unit = [*ids, "tool_name", "bucket", "table_name", "s1", "s2"]
    mapped = keyed.join(scores, ["table_name", "mapping_key"]).groupBy(*unit, "column_name", "is_primary").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "mapping_key", "path", "t", "v")).alias("p"))
    pairs = F.struct(F.col("column_name").alias("column"), F.col("p.v").alias("value"))
    fields = F.struct(locale_key(F.col("column_name")).alias("o"), F.col("column_name").alias("k"), F.col("p.t").alias("t"), F.col("p.v").alias("v"))
    sources = F.struct(F.col("column_name").alias("column"), flat_key_pointer(F.col("p.path")).alias("pointer"))
    units = mapped.groupBy(*unit).agg(
        F.array_sort(F.collect_list(F.when(F.col("is_primary"), pairs))).alias("identity_eq"), F.array_sort(F.collect_list(F.when(~F.col("is_primary"), fields))).alias("required"),
        F.array_sort(F.collect_list(F.when(F.col("is_primary"), sources))).alias("pointers"), F.min(F.when(F.col("is_primary"), -F.col("p.s"))).alias("key_score"))
    every = keyed.select(*unit).distinct().join(units.drop("tool_name", "table_name", "s1", "s2"), [*ids, "bucket"], "left")
    counted = every.join(F.broadcast(keys.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_keys"))), "table_name", "left")
    own = S.table_score(S.tokens(F.col("tool_name")), S.word_variants(F.col("table_name")))
    whole = F.coalesce(F.size("identity_eq") == F.col("n_keys"), F.lit(False))
    ambiguous = (F.col("bucket") == GLOBAL) & (F.col("s1") - F.col("s2") <= S.T_AMBIGUITY)
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return sealed(counted.select(
        *unit, none("identity_eq", "array<struct<column:string,value:string>>"), none("required", _REQUIRED),
        none("pointers", "array<struct<column:string,pointer:string>>"),
        F.when(ambiguous, F.col("s1")).when(whole, F.least(F.lit(1.0), (own + F.col("key_score") + F.col("s1")) / 3)).otherwise(0.0).alias("confidence"),
        F.when(ambiguous, "MAPPING_AMBIGUOUS").when(~whole, "MAPPING_NO_UNIQUE_KEY").alias("mapping_code"),
        F.coalesce((F.col("bucket") == GLOBAL) & (F.col("s1") < S.T_OVERALL), F.lit(False)).alias("low_confidence")))


_NO_PAIRS = "array<struct<column:string,value:string>>"


def _verdict(status: Column) -> Column:
    return F.when(status == "verified", "verified").when(status.isin("missing", "inconsistent"), "fail").otherwise("uncertain")


def _checks(units: DataFrame, kind: str, problem: Column, binding: Column, values: Column) -> DataFrame:
    """Units in the shape that checks are judged in."""
    none = F.lit(None)
    return units.select(
        "*", F.col("required").alias("fields"), F.lit(kind).alias("check_kind"), problem.alias("problem_code"), problem.alias("problem_message"),
        none.cast("string").alias("lookup_table"), F.array().cast(_NO_PAIRS).alias("filter_eq"), none.cast("string").alias("fn"),
        none.cast("string").alias("expect_op"), none.cast("double").alias("expect_value"),
        F.when(problem.isNull(), binding).alias("binding"), F.when(problem.isNull(), values).alias("key_values"))


def verify_units(spark: SparkSession, units: DataFrame, state: State, catalog: DataFrame) -> DataFrame:
    """Row checks of the mapped units; unmapped ones are uncertain. The bindings are the catalog's tables and keys."""
    binding = F.concat(F.lit("row|"), "table_name", F.lit("|"), F.array_join(F.transform("identity_eq", lambda p: p["column"]), ","))
    checks = _checks(units.withColumn("check_id", F.lit("")), "sql_row", F.col("mapping_code"), binding, F.transform("identity_eq", lambda p: p["value"]))
    keyed = key_columns(catalog).groupBy("table_name").agg(F.array_join(F.array_sort(F.collect_set("column_name")), ",").alias("c")).collect()  # a row for each table
    bindings = sorted(f"row|{r['table_name']}|{r['c']}" for r in keyed if r["table_name"] in state.tables)
    return judge_checks(attach_facts(spark, checks, state, bindings)).withColumn("verdict", _verdict(F.col("status")))


def verify_relations(spark: SparkSession, relations: DataFrame, state: State) -> DataFrame:
    """Foreign-key checks, each (document, table, column) once: that of the first action that gives it."""
    first = relations.groupBy("doc_id", "table_name", "column_name").agg(F.min(F.struct("place", "check_id", "path", "value")).alias("f")).select(
        "doc_id", "table_name", "column_name", F.col("f.place").alias("place"), F.col("f.check_id").alias("check_id"), F.col("f.path").alias("path"), F.col("f.value").alias("value"))
    pairs = F.array(F.struct(F.col("column_name").alias("column"), F.col("value").alias("value")))
    shaped = first.withColumn("identity_eq", pairs).withColumn("required", F.array().cast(_REQUIRED))
    binding = F.concat(F.lit("count|"), "table_name", F.lit("|"), "column_name")
    checks = _checks(shaped, "related_exists", F.lit(None).cast("string"), binding, F.array("value"))
    edges = relations.select("table_name", "column_name").distinct().collect()  # declared foreign keys at most
    bindings = sorted({f"count|{t}|{c}" for t, c in edges})
    return judge_checks(attach_facts(spark, checks, state, bindings), ["related_exists"]).withColumn("verdict", _verdict(F.col("status")))


REL_CONFIDENCE = 0.8  # fixed value
QV_FIELDS = "__qvFields"


def _value_at(doc: Column, pointer: Column) -> Column:
    """The variant that a JSON Pointer of the row names; null where nothing is there. A number is an index in a list and a key in an object."""
    tokens = F.transform(F.split(F.substr(pointer, F.lit(2)), "/", -1), lambda t: F.replace(F.replace(t, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    inside = lambda v, kind: F.call_function("try_variant_get", v, F.lit("$"), F.lit(kind))
    place = lambda t: F.when(t.rlike(r"^(0|[1-9]\d*)$"), t.try_cast("int") + 1)
    return F.aggregate(tokens, doc, lambda v, t: F.coalesce(
        F.try_element_at(inside(v, "map<string,variant>"), t), F.try_element_at(inside(v, "array<variant>"), place(t))))


def _scalar(raw: Column) -> Column:
    """(t, v) of a variant: its kind and, for scalars, its text."""
    kind = variant_kind(F.schema_of_variant(raw))
    text = raw.cast("string")
    return F.struct(kind.alias("t"), F.when(kind.isin("string", "boolean"), text).when(kind == "number", js_number_text(text)).when(kind == "null", "null").alias("v"))


def resolves_again() -> Column:
    """Whether a row unit's pointers, read in the params that a replay gets, ask for the same row and the same required fields as the unit.

    On columns table_name, identity_eq, fields, pointers and params.
    """
    named = F.col("table_name").rlike(IDENTIFIER) & F.forall("identity_eq", lambda p: p["column"].rlike(IDENTIFIER)) & F.forall("fields", lambda f: f["k"].rlike(IDENTIFIER))
    doc = F.try_parse_json(synthetic_params(F.col("params"), F.col("fields")))
    read = F.transform("pointers", lambda p: F.struct(p["column"].alias("column"), _scalar(_value_at(doc, p["pointer"])).alias("s")))
    identity = F.transform(read, lambda p: F.struct(p["column"].alias("column"), F.when(p["s"]["t"] != "null", p["s"]["v"]).alias("value")))
    entries = F.map_entries(F.call_function("try_variant_get", doc, F.lit(f"$.{QV_FIELDS}"), F.lit("map<string,variant>")))
    required = F.transform(entries, lambda e: F.struct(e["key"].alias("k"), _scalar(e["value"]).alias("s")))
    asked = F.transform("fields", lambda f: F.struct(f["k"].alias("k"), F.struct(f["t"].alias("t"), f["v"].alias("v")).alias("s")))
    same = (F.array_sort(identity) == F.array_sort("identity_eq")) & (F.array_sort(required) == F.array_sort(asked))
    return F.coalesce(named & same, F.lit(False))


def all_units(rows: DataFrame, relations: DataFrame, params: DataFrame) -> DataFrame:
    """Row and relation units of every document, numbered in the order actions bring them; whether and how each may be exported.

    A row unit goes out with its values where it is confident enough, or else, if it is verified, with pointers into its params, provided
    that these resolve to the same request again. params: doc_id, place, params of the actions.
    """
    one = rows.select(
        "doc_id", "place", F.lit("row").alias("kind"), F.col("bucket").alias("name"), "table_name", "confidence", "verdict", F.col("code"), "identity_eq", "fields", "pointers")
    two = relations.select(
        "doc_id", "place", F.lit("related_exists").alias("kind"), F.col("check_id").alias("name"), "table_name", F.lit(REL_CONFIDENCE).alias("confidence"), "verdict", "code", "identity_eq", "fields",
        F.array().cast("array<struct<column:string,pointer:string>>").alias("pointers"))
    both = stored(one.unionByName(two)).withColumn("turn", F.struct("place", (F.col("kind") == "related_exists").alias("late"), "name"))
    numbered = block_positions(both, ["doc_id"], F.floor(F.col("place")[0] / 256), ["turn"], "unit").drop("turn").join(params, ["doc_id", "place"])
    mapped = ~F.coalesce(F.col("code").startswith("MAPPING_"), F.lit(False))
    pointed = (F.size("pointers") > 0) & ~F.exists("pointers", lambda p: p["pointer"].isNull())
    named = F.col("table_name").rlike(IDENTIFIER) & F.forall("identity_eq", lambda p: p["column"].rlike(IDENTIFIER))
    return numbered.withColumn(
        "export",
        F.when(F.col("kind") == "related_exists", F.when((F.col("verdict") == "verified") & (F.col("confidence") >= S.T_EXPORT) & named, "related_exists"))
        .when(mapped & (F.col("confidence") >= S.T_EXPORT), "const")
        .when(mapped & (F.col("verdict") == "verified") & (F.col("confidence") >= S.T_COLUMN) & pointed, F.when(resolves_again(), "pointer")))


# What a reader is told was expected and observed where there is nothing to name.
NO_EXPECTATION = "(none \u2014 no resolvable SQL expectation)"
NOT_RUN = "No database observation (verification not run)."
RELATED = {"verified": "Related-exists scalar: present (1).", "fail": "Related-exists scalar: absent (0).", "uncertain": "Related-exists scalar: unusable."}


def numbered_actions(actions: DataFrame) -> DataFrame:
    """(doc_id, place, tool_name, n): each action's number in its document."""
    return block_positions(actions.select("doc_id", "place", "tool_name"), ["doc_id"], F.floor(F.col("place")[0] / 256), ["place"], "n")


def quick_reconciliation(rows: DataFrame, relations: DataFrame, flat: DataFrame, actions: DataFrame) -> DataFrame:
    """(doc_id, place, kind, name, declared, expected, observed, verdict_text) of every unit."""
    ids = ["doc_id", "place"]
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    pair = lambda x: F.concat(quoted(x["path"]), F.lit(":"), F.when(x["t"] == "string", quoted(x["v"])).otherwise(x["v"]))
    digest = flat.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("path", "t", "v"))).alias("a")).select(*ids, F.concat(F.lit("{"), F.array_join(F.transform("a", pair), ","), F.lit("}")).alias("digest"))
    numbered = numbered_actions(actions).join(digest, ids, "left")
    declared = numbered.select(*ids, operational_message(F.concat(F.lit("tool="), "tool_name", F.lit("; action#="), F.col("n").cast("string"), F.lit("; parameters_digest="), F.coalesce("digest", F.lit("{}")))).alias("declared"))
    shown = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", F.col("confidence")), "0+$", ""), r"\.$", "")
    said = operational_message(F.concat(F.lit("outcome="), "verdict", F.lit("; confidence="), shown)).alias("verdict_text")
    unmapped = F.col("mapping_code").isNotNull()
    target = rows.withColumn("required", F.col("fields")).withColumn("found", F.coalesce(F.col("matched"), F.lit(0)))
    detail = F.concat(F.lit(" field="), "field", F.lit(" expected="), "expected", F.lit(" actual="), "actual")
    row = target.select(
        *ids, F.lit("row").alias("kind"), F.col("bucket").alias("name"),
        F.when(unmapped, NO_EXPECTATION).otherwise(operational_message(F.concat(F.lit("table="), "table_name", F.lit("; "), target_summary()))).alias("expected_text"),
        F.when(unmapped, NOT_RUN).otherwise(operational_message(F.concat(F.lit("rowCount="), F.least("found", F.lit(2)).cast("string"), F.coalesce(detail, F.lit(""))))).alias("observed"), said)
    known = F.create_map(*[F.lit(x) for p in RELATED.items() for x in p])
    related = relations.withColumn("confidence", F.lit(REL_CONFIDENCE)).select(
        *ids, F.lit("related_exists").alias("kind"), F.col("check_id").alias("name"), operational_message(F.concat(F.lit("related_exists; id="), "check_id")).alias("expected_text"),
        known[F.col("verdict")].alias("observed"), said)
    return row.unionByName(related).join(declared, ids).select(*ids, "kind", "name", "declared", F.col("expected_text").alias("expected"), "observed", "verdict_text")


def quick_rollup(units: DataFrame, documents: DataFrame) -> DataFrame:
    """pass / fail / uncertain per document; a document without units is uncertain."""
    counted = units.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("units"), F.count_if(F.col("verdict") == "fail").alias("failed"), F.count_if(F.col("verdict") == "verified").alias("verified"))
    return documents.select("doc_id").join(counted, "doc_id", "left").select(
        "doc_id", F.coalesce("units", F.lit(0)).alias("units"),
        F.when(F.col("failed") > 0, "fail").when(F.col("verified") == F.col("units"), "pass").otherwise("uncertain").alias("verdict"))


def export_registry(units: DataFrame) -> DataFrame:
    """Registry entries of units that may be exported, one registry for each document: tool ids are unique in it."""
    tool = F.when(F.col("kind") == "row", F.concat(F.lit("quick:u"), F.col("unit").cast("string"))).otherwise(F.concat(F.lit("quick:rel:"), "name"))
    const = lambda c: F.struct(c.alias("const"))
    by_value = F.transform("identity_eq", lambda p: F.struct(const(p["column"]).alias("column"), const(p["value"]).alias("value")))
    by_pointer = F.transform("pointers", lambda p: F.struct(const(p["column"]).alias("column"), F.struct(p["pointer"].alias("pointer")).alias("value")))
    row = lambda identity: F.to_json(F.struct(
        F.concat(F.lit("Quick inferred row: "), "table_name").alias("effectDescriptionTemplate"), tool.alias("toolId"),
        F.struct(identity.alias("identityEq"), F.lit("sql_row").alias("kind"), F.struct(F.lit("/__qvFields").alias("pointer")).alias("requiredFields"), const(F.col("table_name")).alias("table")).alias("verification")))
    related = F.to_json(F.struct(
        F.concat(F.lit("Quick inferred related_exists: "), "name").alias("effectDescriptionTemplate"), tool.alias("toolId"),
        F.struct(F.array(F.struct(F.lit("related_exists").alias("checkKind"), const(F.col("table_name")).alias("childTable"), F.col("name").alias("id"), by_value.alias("matchEq"))).alias("checks"), F.lit("sql_relational").alias("kind")).alias("verification")))
    entry = F.when(F.col("export") == "const", row(by_value)).when(F.col("export") == "pointer", row(by_pointer)).otherwise(related)
    return units.filter("export is not null").select("doc_id", "place", "export", tool.alias("tool_id"), entry.alias("entry"), "fields", "params")


def synthetic_params(params: Column, fields: Column) -> Column:
    """The params of an action with the required fields in their place, as a replay gets them."""
    filled = F.concat(F.lit(f'"{QV_FIELDS}":'), required_json(fields), F.lit("}"))
    rest = F.to_json(F.map_filter(F.call_function("try_variant_get", F.try_parse_json(params), F.lit("$"), F.lit("map<string,variant>")), lambda k, _: k != QV_FIELDS))
    kept = F.when(F.array_contains(F.json_object_keys(params), QV_FIELDS), rest).otherwise(params)
    return F.when(F.regexp_like(kept, F.lit(r"^\s*\{\s*\}\s*$")), F.concat(F.lit("{"), filled)).otherwise(F.concat(F.rtrim(F.regexp_replace(kept, r"\}\s*$", "")), F.lit(","), filled))


def export_replay_events(entries: DataFrame) -> DataFrame:
    """Synthetic observations that replay exported entries: seq counts tools within a document by id."""
    params = (
        F.when(F.col("export") == "related_exists", "{}")
        .when(F.col("export") == "const", F.concat(F.lit(f'{{"{QV_FIELDS}":'), required_json(F.col("fields")), F.lit("}")))
        .otherwise(synthetic_params(F.col("params"), F.col("fields"))))
    placed = block_positions(entries, ["doc_id"], F.substring("tool_id", 1, 10), ["tool_id"], "seq")
    return placed.select("doc_id", F.col("seq").cast("bigint").alias("seq"), "tool_id", params.alias("params"))


def required_json(required: Column) -> Column:
    """Required fields as a JSON object text, keys in order."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    pair = lambda f: F.concat(quoted(f["k"]), F.lit(":"), F.when(f["t"] == "string", quoted(f["v"])).otherwise(f["v"]))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.transform(required, lambda f: F.struct(f["k"].alias("k"), f["t"].alias("t"), f["v"].alias("v")))), pair), ","), F.lit("}"))
