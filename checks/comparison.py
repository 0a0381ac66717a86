"""Queries of run comparison and corpus patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import query, table
from claimlake.operators.topk import page, page_after, page_info
from claimlake.plans import compare as C
from claimlake.plans.diagnose import driver_steps, reason_catalog
from claimlake.plans.workload import saved_steps

SAVED = """WITH h AS (SELECT o_orderkey AS k, r AS run_index, o_orderkey + r*5 AS h FROM orders, (SELECT unnest([0,1,2]) AS r) WHERE (o_orderkey + r)%23<>0),
st AS (SELECT 'wf_' || (k//20) AS workflow_id, run_index, k AS seq, h,
  CASE WHEN h%17=0 THEN 'missing' WHEN h%13=0 THEN 'inconsistent' WHEN h%19=0 THEN 'incomplete_verification' WHEN h%11=0 THEN 'partially_verified' ELSE 'verified' END AS status,
  CASE WHEN h%17=0 THEN 'ROW_ABSENT' WHEN h%13=0 THEN 'VALUE_MISMATCH' WHEN h%19=0 THEN 'UNKNOWN_TOOL' WHEN h%11=0 THEN 'MULTI_EFFECT_PARTIAL' END AS code, k FROM h),
s AS (SELECT *, CASE WHEN status='incomplete_verification' THEN 'ghost.tool' WHEN k%2=0 THEN 'orders.upsert' ELSE 'orders.audit' END AS tool_id,
  CASE WHEN status<>'incomplete_verification' THEN 'sql_row|orders|o_orderkey=' || CASE WHEN k%10=3 THEN k-1 ELSE k END END AS lkey,
  CASE WHEN status='partially_verified' THEN CASE WHEN h%2=0 THEN 'ROW_ABSENT' ELSE 'VALUE_MISMATCH' END END AS bcode,
  CASE WHEN status='partially_verified' THEN CASE WHEN h%2=0 THEN 'missing' ELSE 'inconsistent' END END AS bstatus FROM st),
sg AS (SELECT *, status || '|' || COALESCE(code, '') || CASE WHEN bcode IS NULL THEN '' ELSE '|e:b:' || bstatus || ':r:' || bcode END AS signature FROM s),
km AS (SELECT workflow_id, run_index, lkey, MIN(seq) AS seq FROM s WHERE lkey IS NOT NULL GROUP BY 1, 2, 3),
kx AS (SELECT s.* FROM s JOIN km USING (workflow_id, run_index, lkey, seq)),
cmp AS (SELECT COALESCE(p.workflow_id, c.workflow_id) AS workflow_id, COALESCE(p.lkey, c.lkey) AS logical_step_key, p.seq AS ps, c.seq AS cs, p.code AS pc, c.code AS cc,
  p.bcode AS pb, c.bcode AS cb, p.bstatus AS pbs, c.bstatus AS cbs,
  CASE WHEN c.seq IS NULL THEN 'structuralRemoval' WHEN p.seq IS NULL THEN 'structuralAddition' WHEN p.status<>'verified' AND c.status<>'verified' THEN 'bothFailing'
    WHEN c.status<>'verified' THEN 'introducedFailure' WHEN p.status<>'verified' THEN 'resolvedFailure' ELSE 'unchangedOk' END AS kind
  FROM (SELECT * FROM kx WHERE run_index=1) p FULL JOIN (SELECT * FROM kx WHERE run_index=2) c ON p.workflow_id=c.workflow_id AND p.lkey=c.lkey),
dr AS (SELECT workflow_id, run_index, MIN_BY(CASE WHEN bcode IS NOT NULL THEN bcode ELSE code END, (CASE status WHEN 'incomplete_verification' THEN 0 WHEN 'missing' THEN 1 WHEN 'inconsistent' THEN 2 ELSE 3 END, seq)) AS pcode
  FROM s WHERE status<>'verified' GROUP BY 1, 2),
po AS (SELECT a.workflow_id, a.run_index, CASE WHEN op THEN 'incomplete' WHEN bd THEN 'inconsistent' ELSE 'complete' END AS status,
  CASE WHEN pcode IS NULL THEN 'complete' WHEN pcode='UNKNOWN_TOOL' THEN 'bad_input' ELSE 'ambiguous' END AS category,
  CASE WHEN pcode IS NULL THEN 'low' WHEN bd THEN 'high' ELSE 'medium' END AS severity FROM
  (SELECT workflow_id, run_index, BOOL_OR(status IN ('missing','inconsistent','partially_verified')) AS bd, BOOL_OR(status='incomplete_verification') AS op FROM s GROUP BY 1, 2) a LEFT JOIN dr USING (workflow_id, run_index))
"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved_steps(table(spark, sf_dir, "orders"))


def postures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir)
    named = rows.withColumn("workflow_id", F.concat_ws("#", "workflow_id", "run_index"))
    drivers = driver_steps(named).select(
        F.substring_index("workflow_id", "#", 1).alias("workflow_id"), F.substring_index("workflow_id", "#", -1).cast("int").alias("run_index"), "driver_primary_code")
    return C.run_postures(rows, drivers, reason_catalog(spark))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir)
    return C.compare_steps(s, C.last_pairs(s))


@query("compare_steps", SAVED + "SELECT workflow_id, logical_step_key, kind, COALESCE(ps, -1) AS seq_prior, COALESCE(cs, -1) AS seq_current FROM cmp")
def compare_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("workflow_id", "logical_step_key", "kind", F.coalesce("seq_prior", F.lit(-1)).alias("seq_prior"), F.coalesce("seq_current", F.lit(-1)).alias("seq_current"))


@query("compare_effects", SAVED + """, e AS (SELECT workflow_id, logical_step_key, unnest(['a','b']) AS effect_id, pb, cb, pbs, cbs FROM cmp WHERE kind='bothFailing' AND (pb IS NOT NULL OR cb IS NOT NULL))
SELECT workflow_id, logical_step_key, effect_id, CASE WHEN effect_id='a' THEN 'unchangedOk' WHEN pb IS NOT NULL AND cb IS NOT NULL THEN 'bothFailing' WHEN pb IS NOT NULL THEN 'resolvedFailure' ELSE 'introducedFailure' END AS kind,
  CASE WHEN effect_id='b' AND cb IS DISTINCT FROM pb AND cb IS NOT NULL THEN cb ELSE '' END AS introduced_codes, CASE WHEN effect_id='b' AND cb IS DISTINCT FROM pb AND pb IS NOT NULL THEN pb ELSE '' END AS resolved_codes FROM e""")
def compare_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.compare_effects(_changes(spark, sf_dir)).select(
        "workflow_id", "logical_step_key", "effect_id", "kind", F.array_join("introduced_codes", ",").alias("introduced_codes"), F.array_join("resolved_codes", ",").alias("resolved_codes"))


@query("reason_multiset_diff", SAVED + """SELECT workflow_id, logical_step_key, CASE WHEN cc<>pc THEN cc ELSE '' END AS introduced, CASE WHEN cc<>pc THEN pc ELSE '' END AS resolved FROM cmp WHERE kind='bothFailing'""")
def reason_multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).filter("kind = 'bothFailing'").select(
        "workflow_id", "logical_step_key", F.array_join("introduced_codes", ",").alias("introduced"), F.array_join("resolved_codes", ",").alias("resolved"))


@query("signature_multiset_diff", SAVED + """, n AS (SELECT workflow_id, signature, COUNT(*) FILTER (WHERE run_index=1) AS p, COUNT(*) FILTER (WHERE run_index=2) AS c FROM sg
  WHERE lkey IS NULL AND status<>'verified' AND run_index>0 GROUP BY 1, 2)
SELECT workflow_id, signature, GREATEST(c-p, 0) AS introduced, GREATEST(p-c, 0) AS resolved, LEAST(p, c) AS matched FROM n""")
def signature_multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir)
    return C.signature_changes(s, C.last_pairs(s)).select("workflow_id", "signature", "introduced", "resolved", "matched")


@query("key_union", SAVED + "SELECT DISTINCT workflow_id, lkey AS logical_step_key FROM s WHERE lkey IS NOT NULL AND run_index>0")
def key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("workflow_id", "logical_step_key")


@query("ambiguous_keys", SAVED + "SELECT s.workflow_id, s.run_index, lkey AS logical_step_key, km.seq AS chosen_seq, s.seq AS dropped_seq FROM s JOIN km USING (workflow_id, run_index, lkey) WHERE s.seq>km.seq")
def ambiguous_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ambiguous_keys(steps(spark, sf_dir))


@query("run_pair", SAVED + "SELECT workflow_id, MIN(run_index) FILTER (WHERE run_index=MX-1) AS prior_run, MX AS current_run FROM (SELECT DISTINCT workflow_id, run_index, MAX(run_index) OVER (PARTITION BY workflow_id) AS mx FROM s) GROUP BY workflow_id, mx")
def run_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.last_pairs(steps(spark, sf_dir))


@query("logical_step_key", SAVED + "SELECT workflow_id, run_index, seq, lkey AS logical_step_key FROM s WHERE lkey IS NOT NULL")
def logical_step_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).filter("logical_step_key is not null").select("workflow_id", "run_index", "seq", "logical_step_key")


@query("recurrence_signature", SAVED + "SELECT workflow_id, run_index, seq, signature FROM sg WHERE status<>'verified'")
def recurrence_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).filter("status <> 'verified'").select("workflow_id", "run_index", "seq", C.recurrence_signature().alias("signature"))


_PAT = """, pat AS (SELECT workflow_id, signature, COUNT(DISTINCT run_index) AS runs_hit FROM sg WHERE status<>'verified' GROUP BY 1, 2 HAVING COUNT(DISTINCT run_index)>=2)
"""


@query("recurrence_patterns", SAVED + _PAT + "SELECT workflow_id, signature, runs_hit, runs_hit AS exemplars FROM pat")
def recurrence_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.recurrence_patterns(steps(spark, sf_dir)).select("workflow_id", "signature", "runs_hit", F.size("exemplars").alias("exemplars"))


@query("recurrence_burden", SAVED + _PAT + "SELECT workflow_id, COUNT(signature) AS pattern_count, COALESCE(MAX(runs_hit), 0) AS max_runs_hit, COUNT(signature)>0 AS cross_run FROM (SELECT DISTINCT workflow_id FROM s) LEFT JOIN pat USING (workflow_id) GROUP BY 1")
def recurrence_burden(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir)
    return C.recurrence_burden(C.recurrence_patterns(s), s)


_TOP = "SELECT signature, COUNT(DISTINCT workflow_id || '#' || run_index) AS hit_runs FROM sg WHERE status<>'verified' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50"


@query("recurrence_top", SAVED + _TOP)
def recurrence_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.recurrence_top(steps(spark, sf_dir))


@query("top_50_recurrence", SAVED + f""", top AS ({_TOP}), x AS (SELECT signature, workflow_id, run_index, seq, row_number() OVER (PARTITION BY signature ORDER BY workflow_id, run_index, seq) AS place FROM sg JOIN top USING (signature) WHERE status<>'verified')
SELECT signature, CAST(place AS INTEGER) AS place, workflow_id, run_index, seq FROM x WHERE place<=5""")
def top_50_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir)
    return C.top_exemplars(s, C.recurrence_top(s)).select("signature", "place", "workflow_id", "run_index", "seq")


@query("run_postures", SAVED + "SELECT workflow_id, run_index, status, category, severity FROM po")
def run_postures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postures(spark, sf_dir)


@query("category_histogram", SAVED + "SELECT category, COUNT(*) AS n FROM po GROUP BY 1")
def category_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postures(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("category_streak", SAVED + """, g AS (SELECT workflow_id, category, run_index, run_index - row_number() OVER (PARTITION BY workflow_id, category ORDER BY run_index) AS island FROM po WHERE category<>'complete'),
i AS (SELECT workflow_id, category, island, COUNT(*) AS n FROM g GROUP BY 1, 2, 3) SELECT workflow_id, category, SUM(n)::BIGINT AS runs_hit, MAX(n) AS longest_streak FROM i GROUP BY 1, 2""")
def category_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.category_streaks(postures(spark, sf_dir))


_TREND = "CASE WHEN {a}c='complete' AND {b}c='complete' THEN 'unchanged' WHEN {b}c='complete' THEN 'improving' WHEN {a}c='complete' THEN 'worsening' WHEN {a}c<>{b}c THEN 'mixed' WHEN {b}r>{a}r THEN 'improving' WHEN {b}r<{a}r THEN 'worsening' ELSE 'unchanged' END"
_REL = SAVED + _PAT + f""", pr AS (SELECT workflow_id, run_index, category AS c, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS r FROM po),
t AS (SELECT a.workflow_id, a.c AS ac, a.r AS ar, y.c AS yc, y.r AS yr, z.c AS zc, z.r AS zr FROM pr a JOIN pr y USING (workflow_id) JOIN pr z USING (workflow_id) WHERE a.run_index=0 AND y.run_index=1 AND z.run_index=2),
rel AS (SELECT workflow_id, {_TREND.format(a='a', b='z')} AS window_trend, {_TREND.format(a='y', b='z')} AS pairwise_trend, (SELECT COUNT(*) FROM pat WHERE pat.workflow_id=t.workflow_id)>0 AS cross_run FROM t)
"""


@query("trend", _REL + "SELECT workflow_id, window_trend, pairwise_trend, cross_run, CASE WHEN window_trend<>'unchanged' THEN window_trend WHEN pairwise_trend<>'unchanged' THEN pairwise_trend WHEN cross_run THEN 'mixed' ELSE 'unchanged' END AS headline FROM rel")
def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.reliability(postures(spark, sf_dir), C.recurrence_patterns(steps(spark, sf_dir))).select("workflow_id", "window_trend", "pairwise_trend", "cross_run", "headline")


@query("highlights_20", SAVED + """, x AS (SELECT workflow_id, kind, logical_step_key, row_number() OVER (PARTITION BY workflow_id, kind ORDER BY logical_step_key) AS place FROM cmp
  WHERE kind IN ('introducedFailure','resolvedFailure') OR (kind='bothFailing' AND pc<>cc)) SELECT workflow_id, kind, logical_step_key, CAST(place AS INTEGER) AS place FROM x WHERE place<=20""")
def highlights_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.highlights(_changes(spark, sf_dir)).select("workflow_id", "kind", "logical_step_key", "place")


@query("compare_runs", SAVED + "SELECT workflow_id, kind, COUNT(*) AS n FROM cmp GROUP BY 1, 2")
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).groupBy("workflow_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("reason_code_counts", SAVED + "SELECT code, COUNT(*) AS n FROM s WHERE code IS NOT NULL GROUP BY 1")
def reason_code_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.code_counts(steps(spark, sf_dir))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir)
    n = F.substring("workflow_id", 4, 20).cast("bigint")
    runs = s.groupBy("workflow_id", "run_index").agg(F.lit(1).alias("one")).select(
        "workflow_id", "run_index", F.when(n % 3 != 0, F.concat(F.lit("c"), n % 10)).alias("customer_id"),
        F.when(n % 4 != 0, F.timestamp_seconds(F.lit(1704067200) + n)).alias("captured_at"), F.timestamp_seconds(F.lit(1704067200) + n + 60).alias("verified_at"),
        F.lit(None).cast("timestamp").alias("modified_at"))
    return C.run_index(s, postures(spark, sf_dir), runs)


_LIST = SAVED + """, li AS (SELECT po.workflow_id || '/' || po.run_index AS run_id, po.status, po.category, tools, codes, CASE WHEN n%3<>0 THEN 'c' || (n%10) ELSE '__unspecified__' END AS customer_id,
  1704067200 + n + CASE WHEN n%4=0 THEN 60 ELSE 0 END AS captured FROM (SELECT *, CAST(substr(workflow_id, 4) AS BIGINT) AS n FROM po) po
  JOIN (SELECT workflow_id, run_index, string_agg(DISTINCT tool_id, ',' ORDER BY tool_id) AS tools, COALESCE(string_agg(DISTINCT code, ',' ORDER BY code), '') AS codes FROM s GROUP BY 1, 2) USING (workflow_id, run_index))
"""


def _listed(df: DataFrame) -> DataFrame:
    return df.select("run_id", "status", "category", F.array_join("tool_ids", ",").alias("tools"), F.array_join("reason_codes", ",").alias("codes"), "customer_id", F.unix_seconds("captured_at").alias("captured"))


@query("run_index", _LIST + "SELECT run_id, status, category, tools, codes, customer_id, captured FROM li")
def run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(_rows(spark, sf_dir))


@query("run_list_filter", _LIST + "SELECT run_id, status, category, tools, codes, customer_id, captured FROM li WHERE status='inconsistent' AND codes LIKE '%ROW_ABSENT%' AND customer_id='c1'")
def run_list_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(C.run_list_filter(_rows(spark, sf_dir), status="inconsistent", reason_code="ROW_ABSENT", customer_id="c1"))


@query("page", _LIST + "SELECT run_id, status FROM li ORDER BY captured DESC, run_id LIMIT 100 OFFSET 100")
def page_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(_rows(spark, sf_dir), [F.col("captured_at").desc(), "run_id"], 100, 100).select("run_id", "status")


@query("page_cursor", _LIST + "SELECT run_id, status FROM li ORDER BY captured DESC, run_id LIMIT 100 OFFSET 100")
def page_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page, found behind the last row of the first."""
    rows, order = _rows(spark, sf_dir), [("captured_at", True), ("run_id", False)]
    last = page_after(rows, order, None, 100).collect()[-1]
    return page_after(rows, order, (last["captured_at"], last["run_id"]), 100).select("run_id", "status")


@query("page_info", _LIST + "SELECT COUNT(*) AS total, CASE WHEN COUNT(*)>200 THEN 200 END AS next_offset FROM li")
def page_info_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_info(_rows(spark, sf_dir), 100, 100)


@query("corpus_patterns", _LIST + "SELECT 'category' AS part, status, category AS name, COUNT(*) AS n FROM po GROUP BY 2, 3 UNION ALL SELECT 'code', po.status, code, COUNT(*) FROM s JOIN po USING (workflow_id, run_index) WHERE code IS NOT NULL GROUP BY 2, 3")
def corpus_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories and codes of runs of every status."""
    runs = C.run_list_filter(_rows(spark, sf_dir))
    matched = steps(spark, sf_dir).drop("status").join(runs.select("workflow_id", "run_index", "status"), ["workflow_id", "run_index"])
    count = F.count(F.lit(1)).alias("n")
    return runs.groupBy(F.lit("category").alias("part"), "status", F.col("category").alias("name")).agg(count).unionByName(
        matched.filter("code is not null").groupBy(F.lit("code").alias("part"), "status", F.col("code").alias("name")).agg(count))


def _pinned(spark: SparkSession, sf_dir: str, run: int) -> DataFrame:
    return C.pin(steps(spark, sf_dir).filter(F.col("run_index") == run))


_PIN = SAVED + """, pins AS (SELECT workflow_id, run_index, seq, tool_id, status, COALESCE(code, '') AS code, CASE WHEN bcode IS NULL THEN '' ELSE '[{"id":"a","status":"verified"},{"id":"b","status":"' || bstatus || '","code":"' || bcode || '"}]' END AS effects FROM s)
"""


@query("pin_and_diff", _PIN + "SELECT workflow_id, seq, tool_id, status, code, effects FROM pins WHERE run_index=0")
def pin_and_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pinned(spark, sf_dir, 0).select("workflow_id", "seq", "tool_id", "status", F.coalesce("code", F.lit("")).alias("code"), F.coalesce("effects", F.lit("")).alias("effects"))


@query("lock_diff", _PIN + """, d AS (SELECT COALESCE(a.workflow_id, b.workflow_id) AS workflow_id, COALESCE(a.seq, b.seq) AS seq, CASE WHEN b.seq IS NULL THEN 'missing' WHEN a.seq IS NULL THEN 'unexpected' ELSE 'changed' END AS kind,
  a.status IS DISTINCT FROM b.status OR a.effects IS DISTINCT FROM b.effects OR a.tool_id IS DISTINCT FROM b.tool_id AS x FROM (SELECT * FROM pins WHERE run_index=0) a FULL JOIN (SELECT * FROM pins WHERE run_index=1) b ON a.workflow_id=b.workflow_id AND a.seq=b.seq)
SELECT workflow_id, seq, kind FROM d WHERE x""")
def lock_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.lock_diff(_pinned(spark, sf_dir, 0), _pinned(spark, sf_dir, 1)).select("workflow_id", "seq", "kind")


@query("consecutive_pairs", SAVED + """, d AS (SELECT DISTINCT workflow_id, run_index FROM s) SELECT workflow_id, prior_run, run_index AS current_run FROM (
  SELECT workflow_id, run_index, LAG(run_index) OVER (PARTITION BY workflow_id ORDER BY run_index) AS prior_run FROM d) WHERE prior_run IS NOT NULL""")
def consecutive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.consecutive_pairs(steps(spark, sf_dir))
