"""Queries of text rules, decision tables and change-set rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import query, table
from checks.sqltext import ROLLED, with_
from claimlake.functions import decisions as D
from claimlake.functions import scalars as S
from claimlake.functions import scoring as N
from claimlake.plans import changes as G
from claimlake.plans.workload import spread

_SP = r"[\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NSP = r"[^\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query("redact", f"""WITH r AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?i)Bearer{_SP}+{_NSP}+', '[REDACTED_BEARER]', 'g'),
  '(?i)sk-[a-zA-Z0-9]{{20,}}', '[REDACTED_SK]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', '[REDACTED_EMAIL]', 'g') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) + length(regexp_replace(t, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS n FROM r)
SELECT doc_id, CASE WHEN n>240 THEN '[REDACTED_LONG_STRING_LEN_' || n || ']' ELSE t END AS redacted FROM n""")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", D.redact(F.col("text"), shorten=True).alias("redacted"))


@query("operational_message", """WITH f AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\\t\\r\\n]', ' ', 'g'), ' +', ' ', 'g'), ' ') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t)>2048 THEN substr(t, 1, 2045) || '...' ELSE t END AS message FROM f""")
def operational_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", S.display_message(F.col("text")).alias("message"))


# Both again without the display's length rules: whole texts.
@query("redact_text", f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?i)Bearer{_SP}+{_NSP}+', '[REDACTED_BEARER]', 'g'),
  '(?i)sk-[a-zA-Z0-9]{{20,}}', '[REDACTED_SK]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', '[REDACTED_EMAIL]', 'g') AS redacted FROM documents""")
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", D.redact(F.col("text")).alias("redacted"))


@query("redact_params", f"""WITH r AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?i)Bearer{_SP}+{_NSP}+', '[REDACTED_BEARER]', 'g'),
  '(?i)sk-[a-zA-Z0-9]{{20,}}', '[REDACTED_SK]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', '[REDACTED_EMAIL]', 'g') AS t FROM documents)
SELECT doc_id, '{{"id":' || doc_id || ',"parts":[{{"text":' || to_json(t) || '}},true]}}' AS redacted FROM r""")
def redact_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts nested in lists and objects of a JSON document."""
    nested = F.concat(F.lit('{"id":'), F.col("doc_id"), F.lit(',"parts":['), F.to_json(F.struct("text")), F.lit(",true]}"))
    return table(spark, sf_dir, "documents").select("doc_id", D.redact_json(nested).alias("redacted"))


@query("operational_text", "SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\\t\\r\\n]', ' ', 'g'), ' +', ' ', 'g'), ' ') AS message FROM documents")
def operational_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.operational_message(F.col("text")).alias("message"))


@query("code_point_length", "SELECT doc_id, CAST(length(text) AS INTEGER) AS code_points FROM documents")
def code_point_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("code_points"))


@query("attribution_normalize", """WITH p AS (SELECT page_id, trim(regexp_replace(url, '^https?://[^/]+', '')) AS lp, CASE WHEN page_id%5=0 THEN url END AS rp, CASE WHEN page_id%7=0 THEN repeat('x', 129) ELSE 'news' END AS src FROM pages)
SELECT page_id, COALESCE(CASE WHEN length(src)>128 THEN 'ATTRIBUTION_LENGTH_utm_source' END, CASE WHEN lp LIKE '%://%' THEN 'ATTRIBUTION_PROTOCOL' END,
  CASE WHEN length(lp)>512 THEN 'ATTRIBUTION_LENGTH_landing_path' END, CASE WHEN rp LIKE '%://%' THEN 'ATTRIBUTION_PROTOCOL' END, CASE WHEN page_id%11=0 THEN 'ATTRIBUTION_UNKNOWN_gclid' END, '') AS problem FROM p""")
def attribution_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    values = {
        "utm_source": F.when(page % 7 == 0, F.repeat(F.lit("x"), F.lit(129))).otherwise("news"),
        "landing_path": F.regexp_replace("url", "^https?://[^/]+", ""), "referrer_path": F.when(page % 5 == 0, F.col("url")),
    }
    keys = F.array_compact(F.array(*[F.lit(k) for k in values], F.when(page % 11 == 0, "gclid")))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(D.attribution_problem(values, keys), F.lit("")).alias("problem"))


@query("attribution_json", """WITH p AS (SELECT page_id, url LIKE '%://%' AS far, page_id%6 AS m FROM pages)
SELECT page_id, CASE m WHEN 0 THEN 'ATTRIBUTION_ROOT' WHEN 1 THEN 'ATTRIBUTION_TYPE_utm_medium' WHEN 2 THEN 'ATTRIBUTION_UNKNOWN_zz' WHEN 3 THEN CASE WHEN far THEN 'ATTRIBUTION_PROTOCOL' ELSE '' END ELSE '' END AS problem FROM p""")
def attribution_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, url = F.col("page_id") % 6, F.to_json(F.struct(F.col("url").alias("referrer_path")))
    raw = (
        F.when(m == 0, F.concat(F.lit("["), url, F.lit("]"))).when(m == 1, F.concat(F.lit('{"utm_source":"\\t news ","utm_medium":'), F.col("page_id"), F.lit(',"zz":1}')))
        .when(m == 2, F.lit('{"zz":1,"aa":2,"utm_term":null}')).when(m == 3, url).when(m == 4, F.lit("null")).otherwise('{"utm_source":"  ","landing_path":"/a"}')
    )
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(D.attribution_json_problem(raw), F.lit("")).alias("problem"))


@query("anon_id_valid", """WITH i AS (SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS h FROM events), u AS (SELECT event_id, upper(substr(h,1,8) || '-' || substr(h,9,4) || '-4' || substr(h,14,3) || '-' || substr(h,17,4) || '-' || substr(h,21,12)) AS raw FROM i)
SELECT event_id, CASE WHEN regexp_matches(lower(raw), '^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$') THEN lower(raw) ELSE '' END AS anon_id FROM u""")
def anon_id_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.md5(F.col("event_id").cast("string"))
    raw = F.upper(F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12)))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(D.anon_id(F.concat(F.lit(" "), raw)), F.lit("")).alias("anon_id"))


@query("hypothesis_label", """SELECT conv_id, turn, CASE WHEN regexp_matches(trim(text, ' '), '^[\\x20\\x21\\x23-\\x26\\x28-\\x7E]{1,240}$') THEN trim(text, ' ') ELSE '' END AS label FROM conversations""")
def hypothesis_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(D.hypothesis_label(F.col("text")), F.lit("")).alias("label"))


@query("entitlement_decision", """WITH r AS (SELECT event_id, (['starter','individual','team','business','enterprise'])[event_id%5+1] AS plan, (['active','inactive','none'])[event_id%3+1] AS st, (['verify','enforce'])[event_id%2+1] AS intent, event_id%7=0 AS em FROM events)
SELECT event_id, CASE WHEN plan='starter' AND intent='enforce' THEN 'ENFORCEMENT_REQUIRES_PAID_PLAN' WHEN plan='starter' THEN 'VERIFICATION_REQUIRES_SUBSCRIPTION' WHEN st='active' OR em THEN '' ELSE 'SUBSCRIPTION_INACTIVE' END AS deny_code FROM r""")
def entitlement_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    pick = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (e % len(names) + 1).cast("int"))
    code = D.entitlement(pick(["starter", "individual", "team", "business", "enterprise"]), pick(["active", "inactive", "none"]), pick(["verify", "enforce"]), e % 7 == 0)
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(code, F.lit("")).alias("deny_code"))


@query("report_freshness", "SELECT event_id, CASE WHEN event_id%17=0 THEN 'invalid' WHEN TIMESTAMP '2024-01-31' - ts > INTERVAL 240 HOUR THEN 'stale' ELSE 'fresh' END AS freshness FROM events")
def report_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    issued = F.when(F.col("event_id") % 17 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return table(spark, sf_dir, "events").select("event_id", D.report_freshness(issued, F.lit("2024-01-31"), 240).alias("freshness"))


@query("workload_class", """SELECT o_orderkey, CASE WHEN o_orderkey%3=0 OR o_orderkey%4=0 THEN 'non_bundled' ELSE 'bundled_examples' END AS workload FROM orders""")
def workload_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    events = F.when(k % 4 == 0, "C:\\work\\mine.ndjson").otherwise("C:\\work\\Examples\\events.ndjson")
    cls = D.workload_class(F.when(k % 3 == 0, "postgres").otherwise("sqlite"), events, F.lit("/a/examples/tools.json"), F.lit("/a/examples/demo.db"))
    return table(spark, sf_dir, "orders").select("o_orderkey", cls.alias("workload"))


@query("workflow_lineage", """SELECT o_orderkey, CASE WHEN o_orderkey%5=0 THEN CASE WHEN o_orderkey%2=0 THEN 'catalog_shipped' ELSE 'integrator_scoped' END WHEN o_orderkey%7=0 THEN 'unknown' WHEN o_orderkey%11=0 THEN 'integrate_spine'
  WHEN o_orderkey%13=0 THEN 'catalog_shipped' ELSE 'integrator_scoped' END AS lineage FROM orders""")
def workflow_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    wf = F.when(k % 7 == 0, "  ").when(k % 11 == 0, "wf_integrate_spine").when(k % 13 == 0, " wf_partner ").otherwise(F.concat(F.lit("wf_"), "o_custkey"))
    lineage = D.workflow_lineage(F.when(k % 5 == 0, "quick_verify").otherwise("batch_verify"), F.when(k % 2 == 0, "bundled_examples").otherwise("non_bundled"), wf)
    return table(spark, sf_dir, "orders").select("o_orderkey", lineage.alias("lineage"))


@query("activation_metadata", """SELECT event_id, '{"schema_version":' || (event_id%3+1) || ',"terminal_status":"complete","telemetry_source":"' || CASE WHEN event_id%3=0 THEN 'legacy_unattributed' ELSE 'cli' END || '"'
  || CASE WHEN event_id%3=2 THEN ',"workflow_lineage":"integrator_scoped"' ELSE '' END || '}' AS metadata FROM events""")
def activation_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", D.activation_metadata(F.col("event_id") % 3 + 1, F.lit("integrator_scoped"), F.lit("complete")).alias("metadata"))


# --- names ----------------------------------------------------------------------------------

@query("levenshtein_ratio", "SELECT p_partkey, CASE WHEN p_type=upper(split_part(p_name,' ',1)) THEN 1.0 ELSE 1.0 - levenshtein(upper(split_part(p_name,' ',1)), p_type)::DOUBLE / GREATEST(length(split_part(p_name,' ',1)), length(p_type)) END AS ratio FROM part")
def levenshtein_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", N.levenshtein_ratio(F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))), F.col("p_type")).alias("ratio"))


@query("tool_tokens", "SELECT c_custkey, array_to_string(list_filter(string_split_regex(c_name || '.upsert_' || c_mktsegment, '[^a-zA-Z0-9]+'), lambda x: x<>''), '|') AS tokens FROM customer")
def tool_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(N.tokens(F.concat("c_name", F.lit(".upsert_"), "c_mktsegment")), "|").alias("tokens"))


@query("word_variants", """WITH w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS w FROM part UNION SELECT DISTINCT lower(c_mktsegment) FROM customer),
s AS (SELECT w, CASE WHEN length(w)>=4 AND w LIKE '%ies' THEN left(w, -3) || 'y' WHEN length(w)>=3 AND regexp_matches(w, '(ses|xes|ches|shes)$') THEN left(w, -2) WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND length(w)>1 THEN left(w, -1) ELSE w END AS sg,
  CASE WHEN w LIKE '%y' AND length(w)>=2 AND NOT regexp_matches(w, '[aeiou].$') THEN left(w, -1) || 'ies' WHEN w LIKE '%s' THEN w ELSE w || 's' END AS pl FROM w)
SELECT w, array_to_string(list_sort(list_distinct([w, sg, pl])), ',') AS variants FROM s""")
def word_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")).union(table(spark, sf_dir, "customer").select(F.lower("c_mktsegment"))).distinct()
    return words.select("w", F.array_join(N.word_variants(F.col("w")), ",").alias("variants"))


@query("token_match_score", """SELECT p_partkey, CASE WHEN a=b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.75 WHEN 1.0 - levenshtein(a, b)::DOUBLE / GREATEST(length(a), length(b)) >= 0.85 THEN 0.7 ELSE 0.0 END AS score
FROM (SELECT p_partkey, split_part(p_name, ' ', 2) AS a, CASE WHEN p_partkey%3=0 THEN split_part(p_name, ' ', 2) || 's' WHEN p_partkey%3=1 THEN lower(p_type) ELSE split_part(p_name, ' ', 2) END AS b FROM part)""")
def token_match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.split_part("p_name", F.lit(" "), F.lit(2))
    key = F.col("p_partkey")
    b = F.when(key % 3 == 0, F.concat(a, F.lit("s"))).when(key % 3 == 1, F.lower("p_type")).otherwise(a)
    return table(spark, sf_dir, "part").select("p_partkey", N.token_match(a, b).alias("score"))


# --- display and labels ------------------------------------------------------------------------

@query("canonical_display", """SELECT c_custkey, '"' || c_name || '"' AS shown_name, CASE WHEN c_acctbal=CAST(c_acctbal AS BIGINT) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) ELSE CAST(c_acctbal AS VARCHAR) END AS shown_balance,
  CAST(CAST(c_acctbal*100000000 AS HUGEINT) AS VARCHAR) AS shown_large FROM customer""")
def canonical_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = F.bround(F.col("c_acctbal").cast("decimal(20,2)") * 100000000, 0).cast("double")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", S.display_actual(F.lit("str"), F.col("c_name")).alias("shown_name"), S.display_actual(F.lit("num"), S.js_number(F.col("c_acctbal"))).alias("shown_balance"),
        S.js_number(large).alias("shown_large"))


@query("scalar_match", """SELECT o_orderkey, CASE o_orderkey%6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN o_orderstatus='F' WHEN 3 THEN true WHEN 4 THEN o_orderkey=1 ELSE false END AS matches FROM orders""")
def scalar_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = lambda *v: F.element_at(F.array(*[F.lit(x) if isinstance(x, str) or x is None else x for x in v]), (k % 6 + 1).cast("int"))
    price = S.js_number(F.col("o_totalprice"))
    null = F.lit(None).cast("string")
    expected_type = kind("number", "number", "string", "string", "boolean", "null")
    expected = kind(price, S.js_number(F.col("o_totalprice") + 1), "  F ", price, "true", "null")
    stored_kind = kind("str", "num", "str", "num", "num", "num")
    stored = kind(F.concat(F.lit(" "), price), price, F.col("o_orderstatus"), price, k.cast("string"), price)
    del null
    return spread(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", S.scalar_match(expected_type, expected, stored_kind, stored).alias("matches"))


_LABEL = """SELECT workflow_id, seq, CASE status WHEN 'verified' THEN 'VERIFIED' WHEN 'missing' THEN 'FAILED_ROW_MISSING' WHEN 'inconsistent' THEN 'FAILED_VALUE_MISMATCH' WHEN 'partially_verified' THEN 'PARTIALLY_VERIFIED' ELSE 'INCOMPLETE_CANNOT_VERIFY' END AS label,
  CASE WHEN status='verified' THEN '' WHEN status<>'incomplete_verification' OR code='RETRY_OBSERVATIONS_DIVERGE' THEN 'workflow_execution' ELSE 'verification_setup' END AS diagnostic FROM steps"""


@query("step_diagnostics", with_(ROLLED, _LABEL))
def step_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from checks.core import claimed

    return claimed(spark, sf_dir).steps.select(
        "workflow_id", "seq", D.outcome_label(F.col("status")).alias("label"), F.coalesce(D.failure_diagnostic(F.col("status"), F.col("code")), F.lit("")).alias("diagnostic"))


# --- logs and keys ---------------------------------------------------------------------------------

@query("log_salvage", """SELECT event_id, CASE WHEN event_id%5=4 THEN '' ELSE props END AS salvaged FROM events""")
def log_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, stamp = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    line = (
        F.when(e % 5 == 0, F.col("props")).when(e % 5 == 1, F.concat(stamp, F.lit("Z "), "props")).when(e % 5 == 2, F.concat(stamp, F.lit(" warn "), "props"))
        .when(e % 5 == 3, F.concat(F.lit("\u001b[32m[worker-1] "), "props")).otherwise(F.concat(F.lit("took "), "props"))
    )
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(D.log_salvage(line), F.lit("")).alias("salvaged"))


@query("flat_key_to_pointer", """SELECT o_orderkey, CASE o_orderkey%5 WHEN 0 THEN '/order/' || o_orderkey WHEN 1 THEN '/lines/' || o_orderkey || '/sku' WHEN 2 THEN '/a~1b/c~0d' WHEN 3 THEN '' ELSE '/m/0/1/x' END AS pointer FROM orders""")
def flat_key_to_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    key = (
        F.when(k % 5 == 0, F.concat(F.lit("order."), k)).when(k % 5 == 1, F.concat(F.lit("lines["), k, F.lit("].sku"))).when(k % 5 == 2, "a/b.c~d")
        .when(k % 5 == 3, F.concat(F.lit("bad..key"), k)).otherwise("m[0][1].x")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(D.flat_key_pointer(key), F.lit("")).alias("pointer"))


# --- change sets ---------------------------------------------------------------------------------

RULES = [
    {"id": "kinds", "kind": "matchingRowsMustHaveRowKinds", "pattern": "src/economy/**", "rowKinds": ["add", "modify"]},
    {"id": "no_small", "kind": "forbidMatchingRows", "pattern": "src/small/*bolt*"},
    {"id": "need_promo", "kind": "requireMatchingRow", "pattern": "**/*.{ts,js}", "rowKinds": ["type_change"]},
    {"id": "allow", "kind": "allChangedPathsMustMatchAllowlist", "allowPatterns": ["src/{economy,small,standard}/**", "old/**"]},
    {"id": "moved", "kind": "requireRenameFromTo", "fromPattern": "old/**", "toPattern": "src/*/*ring*.ts", "includeCopy": False},
]
_CH = """WITH ch AS (SELECT p_partkey AS k, 'ch' || (p_partkey//50) AS change_id, (['add','modify','delete','rename','copy','type_change','unmerged'])[p_partkey%7+1] AS row_kind,
  'src/' || lower(p_type) || '/' || replace(p_name, ' ', '_') || '.ts' AS path, CASE WHEN p_partkey%7 IN (3,4) THEN 'old/' || p_partkey || '.ts' END AS old FROM part),
hit AS (SELECT *, path LIKE 'src/economy/%' AND row_kind NOT IN ('add','modify') AS h1, regexp_matches(path, '^src/small/[^/]*bolt[^/]*$') AS h2, row_kind='type_change' AS h3,
  NOT regexp_matches(path, '^src/(economy|small|standard)/.*$') AS h4, row_kind='rename' AND regexp_matches(path, '^src/[^/]*/[^/]*ring[^/]*\\.ts$') AS h5 FROM ch),
n AS (SELECT change_id, COUNT(*) AS total, COUNT(*) FILTER (WHERE h1) AS c1, COUNT(*) FILTER (WHERE h2) AS c2, COUNT(*) FILTER (WHERE h3) AS c3, COUNT(*) FILTER (WHERE h4) AS c4, COUNT(*) FILTER (WHERE h5) AS c5 FROM hit GROUP BY 1),
v AS (SELECT change_id, 'kinds' AS rule_id, c1 AS hits, CASE WHEN c1>0 THEN 'PLAN_RULE_ROW_KIND_MISMATCH' ELSE '' END AS code FROM n UNION ALL SELECT change_id, 'no_small', c2, CASE WHEN c2>0 THEN 'PLAN_RULE_FORBIDDEN_ROW' ELSE '' END FROM n
  UNION ALL SELECT change_id, 'need_promo', c3, CASE WHEN c3=0 THEN 'PLAN_RULE_REQUIRED_ROW_MISSING' ELSE '' END FROM n UNION ALL SELECT change_id, 'allow', c4, CASE WHEN c4>0 THEN 'PLAN_RULE_ALLOWLIST_VIOLATION' ELSE '' END FROM n
  UNION ALL SELECT change_id, 'moved', c5, CASE WHEN c5=0 THEN 'PLAN_RULE_RENAME_MISMATCH' ELSE '' END FROM n)
"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    path = F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), F.translate("p_name", " ", "_"), F.lit(".ts"))
    moved = (k % 7).isin(3, 4)
    return table(spark, sf_dir, "part").select(
        k.alias("k"), F.concat(F.lit("ch"), F.floor(k / 50)).alias("change_id"), F.element_at(F.array(*[F.lit(x) for x in G.ROW_KINDS]), (k % 7 + 1).cast("int")).alias("row_kind"),
        F.when(moved, F.array(F.concat(F.lit("old/"), k, F.lit(".ts")), path)).otherwise(F.array(path)).alias("paths"))


@query("change_rule_join", _CH + "SELECT k, change_id, unnest(list_filter([CASE WHEN h1 THEN 'kinds' END, CASE WHEN h2 THEN 'no_small' END, CASE WHEN h3 THEN 'need_promo' END, CASE WHEN h4 THEN 'allow' END, CASE WHEN h5 THEN 'moved' END], lambda x: x IS NOT NULL)) AS rule_id FROM hit")
def change_rule_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.rule_matches(changes(spark, sf_dir), RULES).select("k", "change_id", "rule_id")


@query("verify_change_sets", _CH + "SELECT change_id, rule_id, hits, CASE WHEN code='' THEN 'verified' ELSE 'inconsistent' END AS status, code FROM v")
def verify_change_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.evaluate_rules(changes(spark, sf_dir), RULES).select("change_id", "rule_id", "hits", "status", F.coalesce("code", F.lit("")).alias("code"))


@query("change_set_rules", _CH + """, d AS (SELECT change_id, MIN_BY(seq, seq) AS seq, MIN_BY(rule_id, seq) AS rule_id, MIN_BY(code, seq) AS code FROM (SELECT *, CASE rule_id WHEN 'kinds' THEN 1 WHEN 'no_small' THEN 2 WHEN 'need_promo' THEN 3 WHEN 'allow' THEN 4 ELSE 5 END AS seq FROM v) WHERE code<>'' GROUP BY 1)
SELECT change_id, 'Must: plan-validation step seq=' || seq || ' toolId=plan_transition.rule.' || rule_id || ' SHALL satisfy declared plan rules under policy [consistencyMode=strong; verificationWindowMs=0; pollIntervalMs=0] for workflowId=' || change_id || ' (primary codes: ' || code || ').' AS must_always_hold,
  'reconcile_downstream_state' AS action, '{"primaryCodes":["' || code || '"],"projectionKind":"plan_transition_expectation","seq":' || seq || ',"toolId":"plan_transition.rule.' || rule_id || '","verificationPolicyFragment":"consistencyMode=strong; verificationWindowMs=0; pollIntervalMs=0","verifyTarget":null,"workflowId":"' || change_id || '"}' AS projection FROM d""")
def change_set_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimlake.plans.correctness import change_set_rules as rules

    return rules(G.evaluate_rules(changes(spark, sf_dir), RULES)).select("change_id", "must_always_hold", "action", "projection")


@query("evidence_50", _CH + """, e AS (SELECT change_id, row_kind, CASE WHEN old IS NULL THEN [path] ELSE [old, path] END AS paths, unnest(list_filter([CASE WHEN h1 THEN 'kinds' END, CASE WHEN h2 THEN 'no_small' END, CASE WHEN h4 THEN 'allow' END], lambda x: x IS NOT NULL)) AS rule_id FROM
  (SELECT * FROM hit UNION ALL SELECT * REPLACE ('all' AS change_id) FROM hit)),
x AS (SELECT change_id, rule_id, row_number() OVER (PARTITION BY change_id, rule_id ORDER BY row_kind, paths) AS place, COUNT(*) OVER (PARTITION BY change_id, rule_id) AS total FROM e)
SELECT change_id, rule_id, CAST(place AS INTEGER) AS place, total, total>50 AS truncated FROM x WHERE place<=50""")
def evidence_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules, over change sets of fifty parts and, so that lists are cut, one of all parts."""
    rows = changes(spark, sf_dir)
    return G.rule_evidence(rows.unionByName(rows.withColumn("change_id", F.lit("all"))), RULES).select("change_id", "rule_id", "place", "total", "truncated")


@query("glob_match", "SELECT p_partkey, regexp_matches('src/' || lower(p_type) || '/' || replace(p_name, ' ', '_') || '.ts', '^src/[^/]*/(red|blue)_[^/]*\\.ts$') AS hit FROM part")
def glob_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), F.translate("p_name", " ", "_"), F.lit(".ts"))
    return table(spark, sf_dir, "part").select("p_partkey", G.matches(path, "src/*/{red,blue}_*.ts").alias("hit"))
