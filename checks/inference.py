"""Queries of inference from activity logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import query, table
from claimlake.plans import infer as Q
from claimlake.session import stored
from claimlake.plans.workload import spread
from claimlake.sources.state import State

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
KEYS = {
    "customer": {"primary": ["c_custkey"], "foreign": {"c_nationkey": ("nation", "n_nationkey")}},
    "orders": {"primary": ["o_orderkey"], "foreign": {"o_custkey": ("customer", "c_custkey")}},
    "lineitem": {"primary": ["l_orderkey", "l_linenumber"], "foreign": {"l_orderkey": ("orders", "o_orderkey")}},
    "part": {"primary": ["p_partkey"]}, "supplier": {"primary": ["s_suppkey"], "foreign": {"s_nationkey": ("nation", "n_nationkey")}},
    "nation": {"unique": [["n_nationkey"]], "foreign": {"n_regionkey": ("region", "r_regionkey")}}, "region": {"unique": [["r_regionkey"]]},
    "events": {"primary": ["event_id"]}, "documents": {"primary": ["doc_id"]}, "pages": {"primary": ["page_id"]}, "benchmark": {"primary": ["item_id"]},
    "conversations": {"primary": ["conv_id", "turn"]},
}


def state(spark: SparkSession, sf_dir: str) -> State:
    return State.parquet(spark, sf_dir, TABLES)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return State.parquet(spark, sf_dir, TABLES).catalog(spark, KEYS)


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One activity line per order: tool calls in three shapes, some behind log prefixes."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    key = F.when(k % 17 == 0, k + 100000000).otherwise(k)
    name = F.when(k % 7 == 0, "nobody").otherwise(F.concat(F.lit("Customer#"), F.lpad(c.cast("string"), 9, "0")))
    params = F.struct(key.alias("o_orderkey"), F.col("o_orderstatus").alias("o_orderstatus"), F.struct(c.alias("c_custkey"), name.alias("c_name")).alias("customer"))
    plain = F.to_json(F.struct(F.lit("orders.upsert").alias("toolId"), params.alias("params")))
    call = F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("orders.upsert").alias("name"), F.to_json(params).alias("arguments")).alias("function"))).alias("tool_calls")))
    listed = F.to_json(F.array(F.struct(F.lit("orders.upsert").alias("tool"), params.alias("input"))))
    line = F.when(k % 3 == 0, plain).when(k % 3 == 1, call).otherwise(F.concat(F.lit("2024-01-01T00:00:00Z INFO "), listed))
    return spread(table(spark, sf_dir, "orders"), "o_orderkey").select(k.alias("doc_id"), F.lit(0).alias("place"), line.alias("line"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.extract_actions(Q.ingest_lines(activity(spark, sf_dir)), ["doc_id"])


_ACT = """WITH a AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey%17=0 THEN o_orderkey+100000000 ELSE o_orderkey END AS key, o_orderstatus AS st, o_custkey AS c,
  CASE WHEN o_orderkey%7=0 THEN 'nobody' ELSE 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS name FROM orders)
"""


@query("ingest_activity", "SELECT COUNT(*) AS documents, COUNT(*) FILTER (WHERE o_orderkey%3=2) AS lists, COUNT(*) FILTER (WHERE o_orderkey%3<>2) AS objects FROM orders")
def ingest_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.ingest_lines(activity(spark, sf_dir)).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("j").startswith("[")).alias("lists"), F.count_if(F.col("j").startswith("{")).alias("objects"))


@query("extract_actions", _ACT + """SELECT doc_id, 'orders.upsert' AS tool_name, '{"o_orderkey":' || key || ',"o_orderstatus":"' || st || '","customer":{"c_custkey":' || c || ',"c_name":"' || name || '"}}' AS params FROM a""")
def extract_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions(spark, sf_dir).select("doc_id", "tool_name", "params")


@query("flatten_params", _ACT + """SELECT doc_id, unnest(['o_orderkey','o_orderstatus','customer.c_custkey','customer.c_name']) AS path, unnest([CAST(key AS VARCHAR), st, CAST(c AS VARCHAR), name]) AS v FROM a""")
def flatten_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.flatten_params(actions(spark, sf_dir), ["doc_id", "place"]).select("doc_id", "path", "v")


@query("dedupe_actions", "SELECT 'c' || o_custkey AS doc_id, COUNT(DISTINCT o_orderstatus) AS kept, COUNT(*) - COUNT(DISTINCT o_orderstatus) AS dropped FROM orders GROUP BY 1")
def dedupe_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), "o_custkey").alias("doc_id"), F.array(F.col("o_orderkey")).alias("place"), F.lit("orders.status").alias("tool_name"), F.to_json(F.struct("o_orderstatus")).alias("params"))
    unique = Q.dedupe_actions(Q.flatten_params(rows, ["doc_id", "place"]), rows)
    return unique.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"), F.sum("dropped").alias("dropped"))


_TOOLS = """WITH t AS (SELECT DISTINCT lower(c_mktsegment) || '.sync_' || CASE c_custkey%4 WHEN 0 THEN 'order' WHEN 1 THEN 'part' WHEN 2 THEN 'nations' ELSE 'costumers' END AS tool_name FROM customer),
n AS (SELECT unnest(['region','nation','customer','supplier','part','orders','lineitem','events','documents','embeddings','pages','benchmark','labels','conversations']) AS table_name),
v AS (SELECT table_name, unnest(list_distinct([table_name, CASE WHEN table_name LIKE '%s' THEN left(table_name,-1) ELSE table_name END, CASE WHEN table_name LIKE '%s' THEN table_name ELSE table_name || 's' END])) AS v FROM n),
w AS (SELECT tool_name, unnest(string_split_regex(tool_name, '[^a-zA-Z0-9]+')) AS w FROM t),
sc AS (SELECT tool_name, table_name, MAX(CASE WHEN w=v THEN 1.0 WHEN contains(w, v) OR contains(v, w) THEN 0.75 WHEN 1.0 - levenshtein(w, v)::DOUBLE / GREATEST(length(w), length(v)) >= 0.85 THEN 0.7 ELSE 0.0 END) AS score FROM w, v GROUP BY 1, 2)
"""


@query("tool_table_scores", _TOOLS + "SELECT tool_name, table_name, score, CAST(row_number() OVER (PARTITION BY tool_name ORDER BY score DESC, table_name) AS INTEGER) AS rank FROM sc")
def tool_table_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    tools = table(spark, sf_dir, "customer").select(F.concat(F.lower("c_mktsegment"), F.lit(".sync_"), F.when(k == 0, "order").when(k == 1, "part").when(k == 2, "nations").otherwise("costumers")).alias("tool_name"))
    return Q.tool_table_scores(tools, TABLES)


@query("param_column_scores", """WITH p AS (SELECT DISTINCT CASE o_orderkey%5 WHEN 0 THEN 'oOrderkey' WHEN 1 THEN 'o_orderdat' WHEN 2 THEN 'O_CUSTKEY' WHEN 3 THEN 'o_orderstatus' ELSE 'price' END AS mapping_key FROM orders),
c AS (SELECT unnest(['o_orderkey','o_custkey','o_orderstatus','o_totalprice','o_orderdate','o_orderpriority']) AS column_name),
r AS (SELECT *, lower(mapping_key) AS k, lower(column_name) AS c FROM p, c)
SELECT mapping_key, column_name, CASE WHEN mapping_key=column_name THEN 1.0 WHEN k=c THEN 0.95 WHEN replace(k,'_','')=replace(c,'_','') THEN 0.9 WHEN k=c || 'id' OR k=c || '_id' THEN 0.85
  WHEN 1.0 - levenshtein(k, c)::DOUBLE / GREATEST(length(k), length(c)) >= 0.8 THEN 1.0 - levenshtein(k, c)::DOUBLE / GREATEST(length(k), length(c)) ELSE 0.0 END AS score FROM r""")
def param_column_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    keys = table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("table_name"), F.when(k == 0, "oOrderkey").when(k == 1, "o_orderdat").when(k == 2, "O_CUSTKEY").when(k == 3, "o_orderstatus").otherwise("price").alias("mapping_key"))
    return Q.param_column_scores(keys, catalog(spark, sf_dir)).select("mapping_key", "column_name", "score")


@query("fk_checks", _ACT + """SELECT doc_id, 'fk:lineitem.l_orderkey' AS check_id, 'o_orderkey' AS path, CAST(key AS VARCHAR) AS value FROM a""")
def fk_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = Q.flatten_params(actions(spark, sf_dir), ["doc_id", "place"])
    return Q.fk_checks(flat, catalog(spark, sf_dir), ["doc_id", "place"]).select("doc_id", "check_id", "path", "value")


def row_units(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(actions, their parameters, row units, relation units), verified against every table. What is read several times is written once."""
    acts = stored(actions(spark, sf_dir))
    flat, known, tables = stored(Q.flatten_params(acts, ["doc_id", "place"])), catalog(spark, sf_dir), state(spark, sf_dir)
    rows = Q.verify_units(spark, Q.plan_units(flat, acts, known, TABLES), tables, known)
    return acts, flat, rows, Q.verify_relations(spark, stored(Q.fk_checks(flat, known, ["doc_id", "place"])), tables)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts, _, rows, relations = row_units(spark, sf_dir)
    return Q.all_units(rows, relations, acts.select("doc_id", "place", "params"))


_UNITS = _ACT + """, u AS (SELECT doc_id, 'row' AS kind, 'orders' AS table_name, CASE WHEN doc_id%17=0 THEN 'ROW_ABSENT' ELSE '' END AS code, 0 AS unit FROM a
  UNION ALL SELECT doc_id, 'row', 'customer', CASE WHEN doc_id%7=0 THEN 'VALUE_MISMATCH' ELSE '' END, 1 FROM a
  UNION ALL SELECT doc_id, 'related_exists', 'lineitem', CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=a.key) THEN '' ELSE 'RELATED_ROWS_ABSENT' END, 2 FROM a)
"""


@query("quick_verify", _UNITS + "SELECT doc_id, kind, table_name, CASE WHEN code='' THEN 'verified' ELSE 'fail' END AS verdict, code FROM u")
def quick_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, sf_dir).select("doc_id", "kind", "table_name", "verdict", F.coalesce("code", F.lit("")).alias("code"))


@query("quick_rollup", _UNITS + "SELECT doc_id, COUNT(*) AS units, CASE WHEN COUNT(*) FILTER (WHERE code<>'')>0 THEN 'fail' ELSE 'pass' END AS verdict FROM u GROUP BY 1")
def quick_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.quick_rollup(units(spark, sf_dir), activity(spark, sf_dir))


@query("quick_rules", _UNITS + """SELECT doc_id, u.table_name, CASE kind WHEN 'row' THEN 'quick_inferred_sql_row' ELSE 'quick_inferred_relational' END AS kind,
  CASE kind WHEN 'row' THEN 'Must: when tool orders.upsert actionIndex=0 is treated as successful for quick verification, table ' || u.table_name || ' SHALL satisfy the inferred sql_row contract (provisional, not a signed export) under read-only SQL checks.'
    ELSE 'Must: when tool orders.upsert actionIndex=0 is treated as successful, related row existence for childTable=lineitem SHALL hold as checked by the inferred related_exists contract (provisional).' END AS must_always_hold,
  CASE kind WHEN 'row' THEN 'reconcile_downstream_state' ELSE 'manual_review' END AS action,
  CASE u.table_name WHEN 'lineitem' THEN '{"actionIndex":0,"checkId":"fk:lineitem.l_orderkey","childTable":"lineitem","matchEq":[{"column":"l_orderkey","value":"' || a.key || '"}],"projectionKind":"quick_inferred_relational","quickProvisional":true,"toolName":"orders.upsert","unitId":"u2"}'
    WHEN 'orders' THEN '{"actionIndex":0,"projectionKind":"quick_inferred_sql_row","quickProvisional":true,"sqlRowRequest":{"identityEq":[{"column":"o_orderkey","value":"' || a.key || '"}],"kind":"sql_row","requiredFields":{"o_orderstatus":"' || a.st || '"},"table":"orders"},"table":"orders","toolName":"orders.upsert","unitId":"u1"}'
    ELSE '{"actionIndex":0,"projectionKind":"quick_inferred_sql_row","quickProvisional":true,"sqlRowRequest":{"identityEq":[{"column":"c_custkey","value":"' || a.c || '"}],"kind":"sql_row","requiredFields":{"c_name":"' || a.name || '"},"table":"customer"},"table":"customer","toolName":"orders.upsert","unitId":"u0"}' END AS projection
FROM u JOIN a USING (doc_id) WHERE u.code<>''""")
def quick_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimlake.plans.correctness import quick_rules as rules

    acts, _, rows, relations = row_units(spark, sf_dir)
    found = Q.all_units(rows, relations, acts.select("doc_id", "place", "params"))
    table_name = F.coalesce(F.get_json_object("projection", "$.table"), F.get_json_object("projection", "$.childTable"))
    return rules(found, Q.numbered_actions(acts)).select("doc_id", table_name.alias("table_name"), "kind", "must_always_hold", "action", "projection")


# Buckets are numbered by name. The customer bucket: a tool named after orders scores 0 for the table, 1 for the key and 1 for its best table, so 2/3; orders scores 1.
_EXPORT = _UNITS + """, x AS (SELECT u.*, a.key, a.st, a.c, a.name, CASE WHEN kind='row' THEN 'const' WHEN code='' THEN 'related_exists' END AS export,
  CASE WHEN kind='row' THEN 'quick:u' || rank ELSE 'quick:rel:fk:lineitem.l_orderkey' END AS tool_id FROM (SELECT *, CASE table_name WHEN 'customer' THEN 0 ELSE 1 END AS rank FROM u) u JOIN a USING (doc_id))
"""


@query("quick_export_eligibility", _EXPORT + "SELECT doc_id, kind, table_name, COALESCE(export, '') AS export FROM x")
def quick_export_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, sf_dir).select("doc_id", "kind", "table_name", F.coalesce("export", F.lit("")).alias("export"))


_ROW = """'{"effectDescriptionTemplate":"Quick inferred row: ' || table_name || '","toolId":"' || tool_id || '","verification":{"identityEq":[{"column":{"const":"' || {col} || '"},"value":{"const":"' || {val} || '"}}],"kind":"sql_row","requiredFields":{"pointer":"/__qvFields"},"table":{"const":"' || table_name || '"}}}'"""


@query("export_registry", _EXPORT + """SELECT doc_id, tool_id, CASE table_name WHEN 'orders' THEN """ + _ROW.replace("{col}", "'o_orderkey'").replace("{val}", "key")
       + " WHEN 'customer' THEN " + _ROW.replace("{col}", "'c_custkey'").replace("{val}", "c")
       + """ ELSE '{"effectDescriptionTemplate":"Quick inferred related_exists: fk:lineitem.l_orderkey","toolId":"' || tool_id || '","verification":{"checks":[{"checkKind":"related_exists","childTable":{"const":"lineitem"},"id":"fk:lineitem.l_orderkey","matchEq":[{"column":{"const":"l_orderkey"},"value":{"const":"' || key || '"}}]}],"kind":"sql_relational"}}' END AS entry FROM x WHERE export IS NOT NULL""")
def export_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.export_registry(units(spark, sf_dir)).select("doc_id", "tool_id", "entry")


@query("export_replay_events", _EXPORT + """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY tool_id) - 1 AS seq, tool_id,
  CASE table_name WHEN 'orders' THEN '{"__qvFields":{"o_orderstatus":"' || st || '"}}' WHEN 'customer' THEN '{"__qvFields":{"c_name":"' || name || '"}}' ELSE '{}' END AS params FROM x WHERE export IS NOT NULL""")
def export_replay_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.export_replay_events(Q.export_registry(units(spark, sf_dir)))


@query("quick_reconciliation", _UNITS + """SELECT doc_id, kind, table_name, 'tool=orders.upsert; action#=0; parameters_digest={"customer.c_custkey":' || c || ',"customer.c_name":"' || name || '","o_orderkey":' || key || ',"o_orderstatus":"' || st || '"}' AS declared,
  CASE table_name WHEN 'orders' THEN 'table=orders; table=orders identity=[o_orderkey=' || key || '] required_fields=[o_orderstatus]' WHEN 'customer' THEN 'table=customer; table=customer identity=[c_custkey=' || c || '] required_fields=[c_name]'
    ELSE 'related_exists; id=fk:lineitem.l_orderkey' END AS expected,
  CASE WHEN kind='related_exists' THEN CASE code WHEN '' THEN 'Related-exists scalar: present (1).' ELSE 'Related-exists scalar: absent (0).' END WHEN code='ROW_ABSENT' THEN 'rowCount=0'
    WHEN code='VALUE_MISMATCH' THEN 'rowCount=1 field=c_name expected="nobody" actual="Customer#' || lpad(CAST(c AS VARCHAR), 9, '0') || '"' ELSE 'rowCount=1' END AS observed,
  'outcome=' || CASE code WHEN '' THEN 'verified' ELSE 'fail' END || '; confidence=' || CASE table_name WHEN 'orders' THEN {orders} WHEN 'customer' THEN {customer} ELSE '0.8' END AS verdict_text
FROM u JOIN a USING (doc_id)""".replace("{orders}", "'1'").replace("{customer}", "'0.667'"))
def quick_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts, flat, rows, relations = row_units(spark, sf_dir)
    texts = Q.quick_reconciliation(rows, relations, flat, acts)
    table_name = F.when(F.col("kind") == "row", F.col("name")).otherwise("lineitem")
    return texts.select("doc_id", "kind", table_name.alias("table_name"), "declared", "expected", "observed", "verdict_text")


# Documents of eight orders' lines: whole JSON, lines behind prefixes with a broken one, prose around braces, and prose alone.
@query("ingest_documents", """SELECT o_orderkey//8 AS doc_id, CASE o_orderkey//8%4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END AS rung,
  CASE o_orderkey//8%4 WHEN 0 THEN count(*) WHEN 1 THEN count(*) WHEN 2 THEN 1 ELSE 0 END AS actions, CASE o_orderkey//8%4 WHEN 0 THEN 0 ELSE 1 END AS malformed_lines,
  CASE WHEN o_orderkey//8%4=3 THEN 'INGEST_NO_STRUCTURED_TOOL_ACTIVITY' ELSE '' END AS code FROM orders GROUP BY o_orderkey//8""")
def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = activity(spark, sf_dir).withColumn("doc", F.floor(F.col("doc_id") / 8)).withColumn("j", F.regexp_replace("line", "^[^{\\[]*", ""))
    packed = lines.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("doc_id", "j"))).alias("a"))
    each = F.transform("a", lambda x: x["j"])
    kind = F.col("doc") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("["), F.array_join(each, ","), F.lit("]")))
        .when(kind == 1, F.concat(F.lit("WARN broken {\n"), F.array_join(F.transform(each, lambda j: F.concat(F.lit("2024-01-01 00:00:00 "), j)), "\n")))
        .when(kind == 2, F.concat(F.lit("it said {not json} and "), F.regexp_replace(F.array_join(each, " then "), "^\\[|\\]$", "")))
        .otherwise("nothing here, {brace"))
    acts, docs = Q.ingest_documents(packed.select(F.col("doc").alias("doc_id"), text.alias("text")))
    n = acts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("actions"))
    return docs.join(n, "doc_id", "left").select(
        "doc_id", F.coalesce("rung", F.lit(0)).alias("rung"), F.coalesce("actions", F.lit(0)).alias("actions"), "malformed_lines", F.coalesce("code", F.lit("")).alias("code"))
