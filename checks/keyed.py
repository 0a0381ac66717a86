"""Queries over streams with keyed state, outer interval joins and refreshed tables, replayed from files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import query
from checks.kpi import FUNNEL, funnel
from checks.runs import CLOSING, in_parts, replayed
from claimlake.session import shared_dir
from claimlake.streaming import keyed as K
from claimlake.streaming import rolling as R

# A user's row comes or changes with a verify_outcome and goes with an integrate_landed; every eleventh value can't be read.
_LINE = FUNNEL + """, x AS (SELECT 'u' || user_id AS key, created_at AS t, bool_or(event='verify_outcome') AS is_on, max(CASE WHEN event='verify_outcome' AND id%11<>0 THEN 'v' || id%4 END) AS value
  FROM fe WHERE event IN ('verify_outcome','integrate_landed') GROUP BY 1, 2),
y AS (SELECT *, lead(t) OVER (PARTITION BY key ORDER BY t) AS until FROM x),
c AS (SELECT id AS claim_id, 'u' || user_id AS key, user_id, created_at AS since, CASE WHEN id%3<>0 THEN 'v' || id%4 END AS wanted FROM fe WHERE event='verify_started')
"""

# What a claim on a present row sees first, in its window of an hour.
_SEEN = """SELECT {k}, min(t) AS t, min_by(struct_pack(v := value), t) AS f FROM {c} LEFT JOIN y ON y.key={c}.key AND is_on AND t <= since + INTERVAL 1 HOUR AND (until IS NULL OR until > since) GROUP BY {k}"""
_STATUS = "CASE WHEN t IS NULL THEN 'uncertain' WHEN wanted IS NULL OR f.v=wanted THEN 'verified' WHEN f.v IS NULL THEN 'incomplete_verification' ELSE 'inconsistent' END"


def _turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The changes of rows, and claims without what they expect."""
    rows = funnel(spark, sf_dir).withColumn("ts", F.col("created_at").cast("timestamp")).withColumn("key", F.concat(F.lit("u"), "user_id"))
    value = F.when((F.col("event") == "verify_outcome") & (F.col("id") % 11 != 0), F.concat(F.lit("v"), F.col("id") % 4))
    turns = rows.filter(F.col("event").isin("verify_outcome", "integrate_landed")).select(
        "key", "ts", F.when(F.col("event") == "verify_outcome", "row").otherwise("gone").alias("kind"), value.alias("value"))
    wanted = F.when(F.col("id") % 3 != 0, F.concat(F.lit("v"), F.col("id") % 4))
    claims = rows.filter("event = 'verify_started'").select("key", "ts", F.lit("claim").alias("kind"), F.col("id").cast("string").alias("claim_id"), "user_id", "id", wanted.alias("wanted"))
    return turns, claims


def _changes(turns: DataFrame, claims: DataFrame) -> DataFrame:
    names = {"claim_id": "string", "expect": "string", "wanted": "string", "step_id": "string", "n_effects": "int", "value": "string"}
    whole = lambda df: df.select("key", "kind", "ts", *[(F.col(n) if n in df.columns else F.lit(None)).cast(k).alias(n) for n, k in names.items()])
    return whole(turns).unionByName(whole(claims))


@query("eventual_row_stream", _LINE + ", s AS (" + _SEEN.format(c="c", k="claim_id, c.key, wanted, since") + f""")
SELECT CAST(claim_id AS VARCHAR) AS claim_id, key, {_STATUS} AS status, CAST(epoch_us(CASE WHEN t IS NOT NULL THEN greatest(t, since) END) AS BIGINT) AS seen_at FROM s""")
def eventual_row_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, claims = _turns(spark, sf_dir)
    out = replayed(spark, _changes(turns, claims.withColumn("expect", F.lit("row"))), lambda s: K.eventual_verdicts(s, 3_600_000), "keyed", closing={"key": "closing", "kind": "gone", "ts": CLOSING})
    return out.select("claim_id", "key", "status", "seen_at")


@query("eventual_absent_stream", _LINE + """, b AS (SELECT key, TIMESTAMP '1970-01-01' AS t, min(t) AS until FROM x GROUP BY key UNION ALL SELECT key, t, until FROM y WHERE NOT is_on),
s AS (SELECT claim_id, c.key, since, min(greatest(b.t, since)) AS t, bool_or(b.key IS NOT NULL) AS free FROM c LEFT JOIN b ON b.key=c.key AND b.t <= since + INTERVAL 1 HOUR AND (until IS NULL OR until > since) GROUP BY 1, 2, 3)
SELECT CAST(claim_id AS VARCHAR) AS claim_id, key, CASE WHEN free OR key NOT IN (SELECT key FROM x) THEN 'verified' ELSE 'uncertain' END AS status,
  CASE WHEN free OR key NOT IN (SELECT key FROM x) THEN '' ELSE 'FORBIDDEN_ROWS_STILL_PRESENT_WITHIN_WINDOW' END AS code,
  CASE WHEN free THEN CAST(epoch_us(t) AS BIGINT) WHEN key NOT IN (SELECT key FROM x) THEN CAST(epoch_us(since) AS BIGINT) END AS seen_at FROM s""")
def eventual_absent_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, claims = _turns(spark, sf_dir)
    out = replayed(spark, _changes(turns, claims.withColumn("expect", F.lit("absent"))), lambda s: K.eventual_verdicts(s, 3_600_000), "keyed", closing={"key": "closing", "kind": "gone", "ts": CLOSING})
    return out.select("claim_id", "key", "status", F.coalesce("code", F.lit("")).alias("code"), "seen_at")


# A step has an effect on its user's row, one on the next user's, and every fifth step one on the row behind that.
@query("eventual_steps_stream", _LINE + """, e AS (SELECT claim_id, 0 AS n, key, since, wanted FROM c UNION ALL SELECT claim_id, 1, 'u' || (user_id + 1), since, NULL FROM c
  UNION ALL SELECT claim_id, 2, 'u' || (user_id + 2), since, 'v1' FROM c WHERE claim_id%5=0),
s AS (""" + _SEEN.format(c="e", k="claim_id, n, wanted, since") + f"""),
v AS (SELECT claim_id, {_STATUS} AS status, CASE WHEN t IS NOT NULL THEN greatest(t, since) END AS seen FROM s),
w AS (SELECT claim_id, CASE WHEN seen IS NULL OR seen > min(seen) OVER (PARTITION BY claim_id) THEN 'missing' ELSE status END AS st FROM v),
g AS (SELECT claim_id, count(*) AS n, count(*) FILTER (st='verified') AS ok, count(*) FILTER (st='missing') AS open, count(*) FILTER (st='incomplete_verification') AS inc FROM w GROUP BY 1)
SELECT CAST(claim_id AS VARCHAR) AS step_id, CASE WHEN inc>0 THEN 'incomplete_verification' WHEN ok=n THEN 'verified' WHEN open=n THEN 'uncertain' WHEN ok=0 THEN 'inconsistent' ELSE 'partially_verified' END AS status,
  CASE WHEN inc>0 THEN 'MULTI_EFFECT_INCOMPLETE' WHEN ok=n THEN '' WHEN open=n THEN 'MULTI_EFFECT_UNCERTAIN_WITHIN_WINDOW' WHEN ok=0 THEN 'MULTI_EFFECT_ALL_FAILED' ELSE 'MULTI_EFFECT_PARTIAL' END AS code FROM g""")
def eventual_steps_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, claims = _turns(spark, sf_dir)
    user, third = F.col("user_id"), F.col("id") % 5 == 0
    nth = lambda n, key, wanted: F.struct(F.lit(n).alias("n"), key.alias("key"), wanted.alias("wanted"))
    next_user = lambda n: F.concat(F.lit("u"), user + n)
    effects = F.array(nth(0, F.col("key"), F.col("wanted")), nth(1, next_user(1), F.lit(None).cast("string")), F.when(third, nth(2, next_user(2), F.lit("v1"))))
    every = claims.select("ts", "kind", F.col("claim_id").alias("step_id"), F.when(third, 3).otherwise(2).alias("n_effects"), F.lit("row").alias("expect"), F.explode(F.filter(effects, lambda e: e.isNotNull())).alias("e"))
    every = every.select("ts", "kind", "step_id", "n_effects", "expect", "e.key", "e.wanted", F.concat_ws("/", "step_id", "e.n").alias("claim_id"))
    out = replayed(spark, _changes(turns, every), lambda s: K.eventual_steps(s, 3_600_000), "keyed", closing={"key": "closing", "kind": "gone", "ts": CLOSING})
    return out.select("step_id", "status", F.coalesce("code", F.lit("")).alias("code"))


# A user's day is a workflow. A reserve_allowed of every third id completes it; two silent hours close it as well, and later events are refused.
@query("session_state_close", FUNNEL + """, e AS (SELECT 'u' || user_id || '/' || CAST(created_at AS DATE) AS w, lpad(CAST(id AS VARCHAR), 12, '0') AS id, created_at AS t, event='verify_outcome' AS claim, event='reserve_allowed' AND id%3=0 AS done,
  lag(created_at) OVER o AS p, row_number() OVER o AS rn FROM fe WINDOW o AS (PARTITION BY user_id, CAST(created_at AS DATE) ORDER BY created_at, id)),
k AS (SELECT w, min(rn) FILTER (done) AS c, min(rn) FILTER (t >= p + INTERVAL 2 HOUR) AS g, max(rn) AS n FROM e GROUP BY w),
l AS (SELECT w, c IS NOT NULL AND (g IS NULL OR c < g) AS said, CASE WHEN c IS NOT NULL AND (g IS NULL OR c < g) THEN c ELSE coalesce(g - 1, n) END AS final FROM k)
SELECT w AS workflow_id, 'closed' AS outcome, CASE WHEN said THEN 'run_completed' ELSE 'gap' END AS how, '' AS event_id, CAST(epoch_us(min(t)) AS BIGINT) AS started,
  CAST(epoch_us(max(t) + CASE WHEN said THEN INTERVAL 0 HOUR ELSE INTERVAL 2 HOUR END) AS BIGINT) AS ended, count(*) AS n_events, count(*) FILTER (claim) AS n_claims FROM e JOIN l USING (w) WHERE rn <= final GROUP BY w, said
UNION ALL SELECT w, 'refused', '', id, NULL, CAST(epoch_us(t) AS BIGINT), NULL, NULL FROM e JOIN l USING (w) WHERE rn > final""")
def session_state_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = funnel(spark, sf_dir)
    completes = (F.col("event") == "reserve_allowed") & (F.col("id") % 3 == 0)
    events = rows.select(
        F.concat(F.lit("u"), "user_id", F.lit("/"), F.to_date("created_at").cast("string")).alias("workflow_id"), F.lpad(F.col("id").cast("string"), 12, "0").alias("event_id"), F.when(F.col("event") == "verify_outcome", "tool_observed").otherwise("control").alias("type"),
        F.when(completes, "run_completed").alias("control_kind"), F.col("created_at").cast("timestamp").alias("ts"))
    closing = {"workflow_id": "closing", "event_id": "", "type": "control", "ts": CLOSING}
    out = replayed(spark, events, lambda s: K.sessions(s, 2 * 3_600_000, 365 * 86_400_000), "closing", closing=closing).filter("workflow_id <> 'closing'")
    return out.select("workflow_id", "outcome", F.coalesce("how", F.lit("")).alias("how"), F.coalesce("event_id", F.lit("")).alias("event_id"), "started", "ended", "n_events", "n_claims")


@query("rolling_kpis_stream", FUNNEL + """, d AS (SELECT unnest(range((SELECT date_trunc('day', min(created_at)) FROM fe), (SELECT max(created_at) FROM fe), INTERVAL 1 DAY)) AS as_of)
SELECT strftime(as_of, '%Y-%m-%d') AS as_of, COUNT(DISTINCT install_id) FILTER (event='verify_started' AND install_id<>'') AS distinct_installs, COUNT(*) FILTER (event='verify_outcome') AS outcome_rows
FROM d JOIN fe ON created_at >= as_of - INTERVAL 7 DAY WHERE src IS DISTINCT FROM 'local_dev' GROUP BY 1""")
def rolling_kpis_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive by a mixed order of ids in four parts, so later parts hold rows of earlier days."""
    base = f"{shared_dir(spark)}/rolling-{uuid.uuid4().hex}"
    rows = funnel(spark, sf_dir).select("id", "event", "install_id", "metadata", "created_at")
    stream = in_parts(rows, F.pmod(F.floor(F.col("id") / 100), F.lit(4)), 4, f"{base}/in")
    R.rolling_stream(stream, f"{base}/kpi", f"{base}/ck").awaitTermination()
    return R.current(spark, f"{base}/kpi").select(F.date_format("as_of", "yyyy-MM-dd").alias("as_of"), "distinct_installs", "outcome_rows")
