"""Queries of the metric and usage jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import query, table
from claimlake.plans import kpi, usage
from claimlake.plans.workload import AS_OF, funnel_events

DAY = "2024-01-20"

FUNNEL = """WITH fe AS (
  SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'acquisition_landed' WHEN 'click' THEN 'integrate_landed' WHEN 'signup' THEN 'verify_started'
      WHEN 'purchase' THEN 'verify_outcome' ELSE 'reserve_allowed' END AS event, user_id,
    CASE WHEN event_id%13<>0 THEN 'i' || (user_id%50) END AS install_id,
    CASE WHEN event_id%22=0 THEN ' ' WHEN event_id%11<>0 THEN 'u' || user_id END AS fid,
    CASE WHEN n%3=0 THEN 'bundled_examples' WHEN n%3=1 THEN 'non_bundled' END AS wc,
    CASE WHEN n%10=0 THEN 'local_dev' WHEN n%10>1 THEN 'cli' END AS src,
    (['complete','inconsistent','incomplete','weird'])[n%4+1] AS st, (['integrator_scoped','catalog_shipped'])[n%2+1] AS lin, ts AS created_at, value
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n FROM events))
"""
_W7 = "created_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY"
_Q = "src IS DISTINCT FROM 'local_dev' AND wc='non_bundled'"


def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel_events(table(spark, sf_dir, "events"))


def _conv(start: str, finish: str, extra: str) -> str:
    return FUNNEL + f""", a AS (SELECT DISTINCT fid FROM fe WHERE event='{start}' AND fid<>'' AND {_W7}),
b AS (SELECT DISTINCT fid FROM fe WHERE event='{finish}' AND fid<>'' AND {_W7} AND {extra})
SELECT (SELECT COUNT(*) FROM a) AS d, (SELECT COUNT(*) FROM a JOIN b USING (fid)) AS n,
  (SELECT CAST(COUNT(*) AS DOUBLE) FROM a JOIN b USING (fid)) / NULLIF((SELECT COUNT(*) FROM a), 0) AS rate"""


_LIVE = "src IS DISTINCT FROM 'local_dev'"
for _key, _name, _sql in [
    ("conv_acq_to_integrate_7d", "acq_to_integrate", _conv("acquisition_landed", "integrate_landed", "true")),
    ("conv_integrate_to_outcome_7d", "integrate_to_outcome", _conv("integrate_landed", "verify_outcome", _LIVE)),
    ("conv_integrate_to_outcome_7d_qualified", "integrate_to_outcome_qualified", _conv("integrate_landed", "verify_outcome", _Q)),
    ("conv_integrate_to_outcome_7d_scoped", "integrate_to_outcome_scoped", _conv("integrate_landed", "verify_outcome", _Q + " AND lin='integrator_scoped'")),
    ("conv_integrate_to_started_7d", "integrate_to_started", _conv("integrate_landed", "verify_started", _Q)),
    ("conv_acq_to_outcome_7d", "acq_to_outcome", _conv("acquisition_landed", "verify_outcome", _LIVE)),
]:
    query(_key, _sql)(lambda spark, sf_dir, name=_name: kpi.conversion(funnel(spark, sf_dir), AS_OF, name))


@query("funnel_cohort_join", FUNNEL + """, a AS (SELECT DISTINCT fid FROM fe WHERE event='acquisition_landed' AND fid<>''), b AS (SELECT DISTINCT fid FROM fe WHERE event='verify_started' AND fid<>'')
SELECT a.fid AS funnel_anon_id, b.fid IS NOT NULL AS converted FROM a LEFT JOIN b USING (fid)""")
def funnel_cohort_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kpi.with_metadata(funnel(spark, sf_dir)).filter("funnel_anon_id <> ''")
    per_id = rows.groupBy("funnel_anon_id").agg(
        F.bool_or(kpi.is_event("acquisition_landed")).alias("started"), F.bool_or(kpi.is_event("verify_started")).alias("converted"))
    return per_id.filter("started").select("funnel_anon_id", "converted")


@query("terminal_status_counts_7d", FUNNEL + f"""
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE st='complete') AS complete, COUNT(*) FILTER (WHERE st='inconsistent') AS inconsistent,
  COUNT(*) FILTER (WHERE st='incomplete') AS incomplete, COUNT(*) FILTER (WHERE st='weird') AS malformed_other
FROM fe WHERE event='verify_outcome' AND {_Q} AND {_W7}""")
def terminal_status_counts_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.terminal_status_counts(funnel(spark, sf_dir), AS_OF)


@query("active_installs_7d", FUNNEL + f"SELECT COUNT(DISTINCT install_id) AS distinct_installs FROM fe WHERE event='verify_started' AND install_id<>'' AND {_LIVE} AND {_W7}")
def active_installs_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.active_installs(funnel(spark, sf_dir), AS_OF)


@query("time_to_first_outcome", FUNNEL + """
SELECT fid AS funnel_anon_id, CAST(round_even((epoch_us(MIN(created_at) FILTER (WHERE event='verify_outcome' AND src IS DISTINCT FROM 'local_dev'))
  - epoch_us(MIN(created_at) FILTER (WHERE event='acquisition_landed'))) / 1000000.0, 0) AS BIGINT) AS seconds FROM fe WHERE fid IS NOT NULL GROUP BY 1""")
def time_to_first_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.time_to_first_outcome(funnel(spark, sf_dir))


@query("retention_28d", FUNNEL + """, u AS (SELECT user_id, COUNT(DISTINCT CAST(created_at AS DATE)) AS days FROM fe
  WHERE event='reserve_allowed' AND created_at >= TIMESTAMP '2024-01-31' - INTERVAL 28 DAY GROUP BY 1)
SELECT COUNT(*) FILTER (WHERE days>=2) AS numerator, COUNT(*) AS denominator, CAST(COUNT(*) FILTER (WHERE days>=2) AS DOUBLE) / NULLIF(COUNT(*), 0) AS rate FROM u""")
def retention_28d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.retention(funnel(spark, sf_dir), AS_OF)


@query("active_days_per_user", FUNNEL + "SELECT user_id, strftime(created_at, '%Y-%m') AS month, COUNT(DISTINCT CAST(created_at AS DATE)) AS active_days FROM fe WHERE event='reserve_allowed' GROUP BY 1, 2")
def active_days_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.active_days(funnel(spark, sf_dir), by_month=True)


@query("licensed_outcomes_month", FUNNEL + "SELECT user_id, strftime(created_at, '%Y-%m') AS month, COUNT(*) AS outcomes FROM fe WHERE event='verify_outcome' GROUP BY 1, 2")
def licensed_outcomes_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.outcomes_per_month(funnel(spark, sf_dir), "verify_outcome")


_D = f"created_at >= TIMESTAMP '{DAY}' AND created_at < TIMESTAMP '{DAY}' + INTERVAL 1 DAY"


@query("funnel_daily_counts", FUNNEL + f"""SELECT '{DAY}' AS day_utc, x.event, COUNT(fe.id) AS row_count
FROM (VALUES ('acquisition_landed'),('integrate_landed'),('verify_started'),('verify_outcome')) x(event) LEFT JOIN fe ON fe.event=x.event AND {_D} GROUP BY x.event""")
def funnel_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.daily_counts(spark, funnel(spark, sf_dir), DAY)


@query("verify_workload_daily", FUNNEL + f"""SELECT '{DAY}' AS day_utc, x.event, b.workload_bucket, COUNT(fe.id) AS row_count
FROM (VALUES ('verify_started'),('verify_outcome')) x(event) CROSS JOIN (VALUES ('bundled_examples'),('non_bundled'),('__other__')) b(workload_bucket)
LEFT JOIN fe ON fe.event=x.event AND COALESCE(wc,'__other__')=b.workload_bucket AND {_D} GROUP BY 2, 3""")
def verify_workload_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.daily_workload(spark, funnel(spark, sf_dir), DAY)


@query("dimension_fill", FUNNEL + f"""SELECT x.event, b.workload_bucket, COUNT(fe.id) AS row_count FROM (VALUES ('verify_started'),('verify_outcome')) x(event) CROSS JOIN (VALUES ('bundled_examples'),('non_bundled'),('__other__')) b(workload_bucket)
LEFT JOIN fe ON fe.event=x.event AND COALESCE(wc,'__other__')=b.workload_bucket AND {_D} AND (wc='non_bundled' OR fe.event='verify_outcome' AND wc IS NULL) GROUP BY 1, 2""")
def dimension_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's events of which some (event, bucket) never happen: those appear with zero."""
    rows = kpi.with_metadata(funnel(spark, sf_dir))
    some = rows.filter((F.col("workload_class") == "non_bundled") | ((F.col("event") == "verify_outcome") & F.col("workload_class").isNull()))
    return kpi.daily_workload(spark, some.select(*funnel(spark, sf_dir).columns), DAY).drop("day_utc")


@query("join_quality_daily", FUNNEL + f"""SELECT '{DAY}' AS day_utc, event, COUNT(*) FILTER (WHERE trim(fid)<>'') AS rows_with_fid,
  COUNT(*) FILTER (WHERE fid IS NULL OR trim(fid)='') AS rows_without_fid FROM fe WHERE event IN ('verify_started','verify_outcome') AND {_D} GROUP BY 2""")
def join_quality_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.daily_join_quality(spark, funnel(spark, sf_dir), DAY)


def _attr(where: str) -> str:
    return FUNNEL + f""", i AS (SELECT DISTINCT trim(fid) AS f FROM fe WHERE event='integrate_landed' AND trim(fid)<>'' AND {where}),
q AS (SELECT * FROM fe WHERE event='verify_outcome' AND {_Q} AND {where}), qd AS (SELECT DISTINCT trim(fid) AS f FROM q WHERE trim(fid)<>'')
SELECT (SELECT COUNT(*) FROM i) AS integrate_distinct_fid_count, (SELECT COUNT(*) FROM q) AS global_non_bundled_outcome_row_count,
  (SELECT COUNT(*) FROM qd) AS global_non_bundled_outcome_distinct_fid_count, (SELECT COUNT(*) FROM i JOIN qd USING (f)) AS integrate_attributed_non_bundled_outcome_distinct_fid_count"""


@query("attributed_daily", _attr(_D))
def attributed_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.attributed(funnel(spark, sf_dir), DAY)


@query("attributed_rolling_30d", _attr(f"created_at >= TIMESTAMP '{DAY}' - INTERVAL 29 DAY AND created_at < TIMESTAMP '{DAY}' + INTERVAL 1 DAY"))
def attributed_rolling_30d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.attributed(funnel(spark, sf_dir), DAY, 29)


@query("event_tier", FUNNEL + "SELECT event, CASE WHEN event='reserve_allowed' THEN 'core' ELSE 'telemetry' END AS tier, COUNT(*) AS n FROM fe GROUP BY 1, 2")
def event_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel(spark, sf_dir).groupBy("event", kpi.event_tier(F.col("event")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("catalog_partition", FUNNEL + """, a AS (SELECT event FROM fe UNION ALL SELECT event_type FROM events)
SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (event NOT IN ('acquisition_landed','integrate_landed','verify_started','verify_outcome','reserve_allowed')) AS untiered,
  COUNT(*) FILTER (event IN ('acquisition_landed','integrate_landed','verify_started','verify_outcome') AND event='reserve_allowed') AS in_both FROM a""")
def catalog_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funnel events are of one tier; the raw event types beside them are of none."""
    e = F.col("event")
    t, c = e.isin(kpi.TELEMETRY_EVENTS), e.isin(kpi.CORE_EVENTS)
    rows = funnel(spark, sf_dir).select("event").unionByName(table(spark, sf_dir, "events").select(F.col("event_type").alias("event")))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~t & ~c).alias("untiered"), F.count_if(t & c).alias("in_both"))


# --- usage --------------------------------------------------------------------------------

_USE = FUNNEL + """, r AS (SELECT 'k' || (user_id%40) AS api_key, 'r' || (id//3) AS run_id, created_at, id FROM fe WHERE event<>'verify_outcome'),
first AS (SELECT api_key, run_id, MIN(created_at) AS first_at FROM r GROUP BY 1, 2),
placed AS (SELECT *, strftime(first_at, '%Y-%m') AS month, row_number() OVER (PARTITION BY api_key, strftime(first_at, '%Y-%m') ORDER BY first_at, run_id) - 1 AS place FROM first)
"""


def reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel(spark, sf_dir).filter("event <> 'verify_outcome'").select(
        F.concat(F.lit("k"), F.col("user_id") % 40).alias("api_key"), F.concat(F.lit("r"), F.floor(F.col("id") / 3)).alias("run_id"), "created_at", "id"
    )


@query("usage_monthly", _USE + "SELECT api_key, run_id, month, place, place < 60 AS allowed FROM placed")
def usage_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.usage_monthly(reservations(spark, sf_dir), 60).select("api_key", "run_id", "month", "place", "allowed")


@query("key_usage_join", _USE + """, keys AS (SELECT DISTINCT 'k' || (user_id%60) AS api_key, user_id%60 AS u FROM events),
c AS (SELECT api_key, COUNT(*) AS used FROM placed WHERE place<60 AND month='2024-01' GROUP BY 1)
SELECT api_key, u AS user_id, CASE u%3 WHEN 0 THEN 'individual' WHEN 1 THEN 'team' ELSE 'enterprise' END AS plan, COALESCE(used, 0) AS used,
  CASE u%3 WHEN 0 THEN 60 WHEN 1 THEN 500 END AS month_limit FROM keys LEFT JOIN c USING (api_key) WHERE u%7<>0""")
def key_usage_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("u")
    keys = table(spark, sf_dir, "events").select((F.col("user_id") % 60).alias("u")).distinct().select(
        F.concat(F.lit("k"), u).alias("api_key"), u.alias("user_id"),
        F.when(u % 3 == 0, "individual").when(u % 3 == 1, "team").otherwise("enterprise").alias("plan"),
        F.when(u % 7 == 0, F.lit("2024-01-05")).alias("revoked_at"),
    )
    counters = usage.month_counter(reservations(spark, sf_dir), 60)
    return usage.key_usage(keys, counters, "2024-01", {"individual": 60, "team": 500, "enterprise": None})


@query("hourly_rate_limit", FUNNEL + """, p AS (SELECT id, event AS scope, 'ip' || (user_id%10) AS scope_key, date_trunc('hour', created_at) AS h, created_at FROM fe)
SELECT id, scope, scope_key, CAST(epoch(h) AS BIGINT) AS window_start, row_number() OVER (PARTITION BY scope, scope_key, h ORDER BY created_at, id) AS place,
  row_number() OVER (PARTITION BY scope, scope_key, h ORDER BY created_at, id) <= 3 AS allowed FROM p""")
def hourly_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = funnel(spark, sf_dir).select("id", F.col("event").alias("scope"), F.concat(F.lit("ip"), F.col("user_id") % 10).alias("scope_key"), F.col("created_at").alias("ts"))
    return usage.hourly_limit(requests, 3).select("id", "scope", "scope_key", F.unix_seconds(F.col("window_start").cast("timestamp")).alias("window_start"), "place", "allowed")


_RES = FUNNEL + """, r AS (SELECT user_id, CAST(CAST(created_at AS DATE) AS VARCHAR) AS run_id, MIN(created_at) AS reserved_at FROM fe WHERE event='reserve_allowed' GROUP BY 1, 2),
o AS (SELECT f.id, f.user_id, CAST(CAST(f.created_at AS DATE) AS VARCHAR) AS run_id, f.created_at FROM fe f WHERE event='verify_outcome'),
m AS (SELECT o.*, CASE WHEN reserved_at IS NULL OR created_at < reserved_at THEN 'unknown' WHEN created_at > reserved_at + INTERVAL 6 HOUR THEN 'expired' ELSE 'held' END AS what FROM o LEFT JOIN r USING (user_id, run_id)),
d AS (SELECT *, row_number() OVER (PARTITION BY user_id, run_id, what ORDER BY created_at, id) AS rn FROM m)
"""


@query("reservation_outcome", _RES + "SELECT id, 'k' || user_id AS api_key, CASE WHEN what<>'held' THEN what WHEN rn=1 THEN 'accepted' ELSE 'repeat' END AS decision FROM d")
def reservation_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = funnel(spark, sf_dir).select("id", "event", F.concat(F.lit("k"), "user_id").alias("api_key"), F.to_date("created_at").cast("string").alias("run_id"), "created_at")
    return usage.reservation_outcomes(keyed.filter("event = 'verify_outcome'").drop("event"), keyed.filter("event = 'reserve_allowed'")).select("id", "api_key", "decision")


@query("recent_activity", FUNNEL + """, s AS (SELECT id, user_id, st, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS seen FROM fe WHERE event='verify_outcome'),
k AS (SELECT id, user_id, st, row_number() OVER (PARTITION BY user_id ORDER BY seen) AS place FROM s WHERE seen<=50 AND st<>'weird')
SELECT id, user_id, st AS terminal_status, CAST(place AS INTEGER) AS place FROM k WHERE place<=10""")
def recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kpi.with_metadata(funnel(spark, sf_dir)).filter("event = 'verify_outcome'")
    valid = F.col("terminal_status").isin("complete", "inconsistent", "incomplete")
    return usage.recent_activity(rows, valid).select("id", "user_id", "terminal_status", "place")


@query("utc_bounds", FUNNEL + """SELECT id, CAST(epoch(date_trunc('hour', created_at)) AS BIGINT) AS hour_start, strftime(created_at, '%Y-%m-%d') AS day, strftime(created_at, '%Y-%m') AS month,
  created_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AS in_7d FROM fe""")
def utc_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("created_at").cast("timestamp")
    return funnel(spark, sf_dir).select(
        "id", F.unix_seconds(usage.hour_start(ts).cast("timestamp")).alias("hour_start"), F.date_format(ts, "yyyy-MM-dd").alias("day"),
        F.date_format(ts, "yyyy-MM").alias("month"), kpi.since(AS_OF, 7).alias("in_7d"))
