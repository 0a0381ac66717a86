"""Funnel, conversion, retention and install metrics over a funnel event table.

Every metric takes its reference time. Rolling windows have only a lower bound; daily windows are
half-open UTC days. Distinct ids are counted by grouping on the id once, so a frequent id costs one
partial row per task, and several metrics share one scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Event names by tier, and the lists that daily reports fill with zeros.
TELEMETRY_EVENTS = ["demo_verify_ok", "acquisition_landed", "integrate_landed", "verify_started", "verify_outcome"]
CORE_EVENTS = [
    "sign_in", "checkout_started", "subscription_checkout_completed", "api_key_created", "reserve_allowed",
    "report_share_created", "report_share_view", "licensed_verify_outcome", "oss_claim_redeemed",
]
DAILY_EVENTS = ["acquisition_landed", "integrate_landed", "verify_started", "verify_outcome"]
VERIFY_EVENTS = ["verify_started", "verify_outcome"]
WORKLOAD_BUCKETS = ["bundled_examples", "non_bundled", "__other__"]


def event_tier(event: Column) -> Column:
    return F.when(event.isin(TELEMETRY_EVENTS), "telemetry").when(event.isin(CORE_EVENTS), "core")


def with_metadata(events: DataFrame) -> DataFrame:
    """Funnel rows with the metadata fields the metrics use."""
    names = ["funnel_anon_id", "workload_class", "telemetry_source", "terminal_status", "workflow_lineage", "run_id"]
    return events.select("*", *[F.get_json_object("metadata", f"$.{n}").alias(n) for n in names])


def not_local() -> Column:
    return ~F.col("telemetry_source").eqNullSafe("local_dev")


def qualified() -> Column:
    return not_local() & (F.col("workload_class") == "non_bundled")


def since(as_of: str, days: int) -> Column:
    return F.col("created_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days")


def on_day(day: str, days_before: int = 0) -> Column:
    start = F.lit(day).cast("timestamp")
    return (F.col("created_at") >= start - F.expr(f"interval {days_before} days")) & (F.col("created_at") < start + F.expr("interval 1 day"))


def _rate(n: Column, d: Column) -> Column:
    return F.when(d != 0, n.cast("double") / d)


def cohort_conversion(events: DataFrame, as_of: str, start: Column, finish: Column, days: int = 7) -> DataFrame:
    """d = ids with `start` in the window, n = those that also have `finish`, and their rate."""
    fid = F.col("funnel_anon_id")
    per_id = (
        with_metadata(events).filter(since(as_of, days) & fid.isNotNull() & (fid != ""))
        .groupBy("funnel_anon_id").agg(F.coalesce(F.bool_or(start), F.lit(False)).alias("started"), F.coalesce(F.bool_or(finish), F.lit(False)).alias("finished"))
    )
    counted = per_id.agg(F.count_if("started").alias("d"), F.count_if(F.col("started") & F.col("finished")).alias("n"))
    return counted.withColumn("rate", _rate(F.col("n"), F.col("d")))


def is_event(name: str) -> Column:
    return F.col("event") == name


CONVERSIONS = {
    "acq_to_integrate": (lambda: is_event("acquisition_landed"), lambda: is_event("integrate_landed")),
    "integrate_to_outcome": (lambda: is_event("integrate_landed"), lambda: is_event("verify_outcome") & not_local()),
    "integrate_to_outcome_qualified": (lambda: is_event("integrate_landed"), lambda: is_event("verify_outcome") & qualified()),
    "integrate_to_outcome_scoped": (
        lambda: is_event("integrate_landed"),
        lambda: is_event("verify_outcome") & qualified() & (F.col("workflow_lineage") == "integrator_scoped"),
    ),
    "integrate_to_started": (lambda: is_event("integrate_landed"), lambda: is_event("verify_started") & qualified()),
    "acq_to_outcome": (lambda: is_event("acquisition_landed"), lambda: is_event("verify_outcome") & not_local()),
}


def conversion(events: DataFrame, as_of: str, name: str) -> DataFrame:
    start, finish = CONVERSIONS[name]
    return cohort_conversion(events, as_of, start(), finish())


def terminal_status_counts(events: DataFrame, as_of: str) -> DataFrame:
    status = F.col("terminal_status")
    known = ["complete", "inconsistent", "incomplete"]
    counted = with_metadata(events).filter(since(as_of, 7) & is_event("verify_outcome") & qualified()).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(status == s).alias(s) for s in known]
    )
    return counted.withColumn("malformed_other", F.col("total") - reduce(lambda a, b: a + b, [F.col(s) for s in known]))


def active_installs(events: DataFrame, as_of: str) -> DataFrame:
    rows = with_metadata(events).filter(
        since(as_of, 7) & is_event("verify_started") & F.col("install_id").isNotNull() & (F.col("install_id") != "") & not_local()
    )
    return rows.groupBy("install_id").agg(F.lit(1).alias("one")).agg(F.count(F.lit(1)).alias("distinct_installs"))


def rolling(events: DataFrame, days: int = 7) -> DataFrame:
    """For every day of the data, installs and outcomes from `days` before that day on: one scan for all days.

    An install counts for every day up to `days` after its last start, an outcome for every day up to `days` after it,
    so counts per last day are summed from the last day backwards; that table has one row for each day.
    """
    rows = with_metadata(events).filter(not_local())
    reach = F.to_date(F.col("created_at") + F.make_dt_interval(days=F.lit(days)))
    started = is_event("verify_started") & F.col("install_id").isNotNull() & (F.col("install_id") != "")
    installs = rows.filter(started).groupBy("install_id").agg(F.max(reach).alias("until")).groupBy("until").agg(F.count(F.lit(1)).alias("installs"), F.lit(0).cast("bigint").alias("outcomes"))
    outcomes = rows.filter(is_event("verify_outcome")).groupBy(reach.alias("until")).agg(F.lit(0).cast("bigint").alias("installs"), F.count(F.lit(1)).alias("outcomes"))
    span = events.agg(F.to_date(F.min("created_at")).alias("a"), F.max("created_at").alias("b")).select(F.explode(F.sequence("a", F.to_date("b"))).alias("day"), "b").filter(F.col("day") < F.col("b"))
    seen = span.select("day", F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("installs"), F.lit(0).cast("bigint").alias("outcomes"))
    line = seen.unionByName(installs.unionByName(outcomes).select(F.col("until").alias("day"), F.lit(1).alias("k"), "installs", "outcomes"))
    later = Window.orderBy(F.col("day").desc(), F.col("k").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return line.withColumn("distinct_installs", F.sum("installs").over(later)).withColumn("outcome_rows", F.sum("outcomes").over(later)).filter("k = 0").select(
        F.date_format("day", "yyyy-MM-dd").alias("as_of"), "distinct_installs", "outcome_rows")


def time_to_first_outcome(events: DataFrame) -> DataFrame:
    """Seconds from an id's first landing to its first outcome, rounded; null while a side is missing."""
    rows = with_metadata(events).filter(F.col("funnel_anon_id").isNotNull())
    first = rows.groupBy("funnel_anon_id").agg(
        F.min(F.when(is_event("acquisition_landed"), F.col("created_at"))).alias("landed"),
        F.min(F.when(is_event("verify_outcome") & not_local(), F.col("created_at"))).alias("outcome"),
    )
    micros = F.unix_micros(F.col("outcome").cast("timestamp")) - F.unix_micros(F.col("landed").cast("timestamp"))
    return first.select("funnel_anon_id", F.bround(micros / F.lit(1000000.0), 0).cast("bigint").alias("seconds"))


def retention(events: DataFrame, as_of: str) -> DataFrame:
    """Users active on two or more UTC days, of all users active in 28 days."""
    days = events.filter(since(as_of, 28) & is_event("reserve_allowed") & F.col("user_id").isNotNull()).groupBy("user_id", F.to_date("created_at").alias("day")).agg(
        F.lit(1).alias("one")
    )
    users = days.groupBy("user_id").agg(F.count(F.lit(1)).alias("days"))
    return users.agg(F.count_if(F.col("days") >= 2).alias("numerator"), F.count(F.lit(1)).alias("denominator")).withColumn(
        "rate", _rate(F.col("numerator"), F.col("denominator"))
    )


def active_days(events: DataFrame, event: str = "reserve_allowed", by_month: bool = False) -> DataFrame:
    """Distinct UTC dates per user, all time or per month."""
    keys = ["user_id", *(["month"] if by_month else [])]
    dated = events.filter(is_event(event) & F.col("user_id").isNotNull()).select(
        "user_id", F.to_date("created_at").alias("day"), F.date_format("created_at", "yyyy-MM").alias("month")
    )
    return dated.groupBy(*keys, "day").agg(F.lit(1).alias("one")).groupBy(*keys).agg(F.count(F.lit(1)).alias("active_days"))


def outcomes_per_month(events: DataFrame, event: str = "licensed_verify_outcome") -> DataFrame:
    return events.filter(is_event(event) & F.col("user_id").isNotNull()).groupBy(
        "user_id", F.date_format("created_at", "yyyy-MM").alias("month")
    ).agg(F.count(F.lit(1)).alias("outcomes"))


# --- daily pack ---------------------------------------------------------------------------

def fill(spark: SparkSession, counts: DataFrame, keys: list[str], values: list[tuple], zero: list[str]) -> DataFrame:
    """Every listed key appears, with zero where nothing was counted. The list is a fixed dimension."""
    frame = spark.createDataFrame(values, ", ".join(f"{k} string" for k in keys))
    return frame.join(counts, keys, "left").fillna(0, zero)


def daily_counts(spark: SparkSession, events: DataFrame, day: str) -> DataFrame:
    counted = events.filter(on_day(day) & F.col("event").isin(DAILY_EVENTS)).groupBy("event").agg(F.count(F.lit(1)).alias("row_count"))
    return fill(spark, counted, ["event"], [(e,) for e in DAILY_EVENTS], ["row_count"]).select(F.lit(day).alias("day_utc"), "event", "row_count")


def workload_bucket() -> Column:
    known = F.col("workload_class").isin(WORKLOAD_BUCKETS[:2])
    return F.when(known, F.col("workload_class")).otherwise(WORKLOAD_BUCKETS[2])


def daily_workload(spark: SparkSession, events: DataFrame, day: str) -> DataFrame:
    counted = with_metadata(events).filter(on_day(day) & F.col("event").isin(VERIFY_EVENTS)).groupBy(
        "event", workload_bucket().alias("workload_bucket")
    ).agg(F.count(F.lit(1)).alias("row_count"))
    values = [(e, b) for e in VERIFY_EVENTS for b in WORKLOAD_BUCKETS]
    return fill(spark, counted, ["event", "workload_bucket"], values, ["row_count"]).select(F.lit(day).alias("day_utc"), "event", "workload_bucket", "row_count")


def has_id() -> Column:
    return F.coalesce(F.trim("funnel_anon_id") != "", F.lit(False))


def daily_join_quality(spark: SparkSession, events: DataFrame, day: str) -> DataFrame:
    counted = with_metadata(events).filter(on_day(day) & F.col("event").isin(VERIFY_EVENTS)).groupBy("event").agg(
        F.count_if(has_id()).alias("rows_with_fid"), F.count_if(~has_id()).alias("rows_without_fid")
    )
    return fill(spark, counted, ["event"], [(e,) for e in VERIFY_EVENTS], ["rows_with_fid", "rows_without_fid"]).select(
        F.lit(day).alias("day_utc"), "event", "rows_with_fid", "rows_without_fid"
    )


def attributed(events: DataFrame, day: str, days_before: int = 0) -> DataFrame:
    """Integrate ids, qualified outcome rows and ids, and ids with both, in one scan."""
    outcome = is_event("verify_outcome") & qualified()
    per_id = with_metadata(events).filter(on_day(day, days_before) & (is_event("integrate_landed") | outcome)).groupBy(
        F.when(has_id(), F.trim("funnel_anon_id")).alias("fid")
    ).agg(F.count_if(is_event("integrate_landed")).alias("landed"), F.count_if(outcome).alias("outcomes"))
    known = F.col("fid").isNotNull()
    return per_id.agg(
        F.count_if(known & (F.col("landed") > 0)).alias("integrate_distinct_fid_count"),
        F.coalesce(F.sum("outcomes"), F.lit(0)).alias("global_non_bundled_outcome_row_count"),
        F.count_if(known & (F.col("outcomes") > 0)).alias("global_non_bundled_outcome_distinct_fid_count"),
        F.count_if(known & (F.col("landed") > 0) & (F.col("outcomes") > 0)).alias("integrate_attributed_non_bundled_outcome_distinct_fid_count"),
    )


def daily_pack(spark: SparkSession, events: DataFrame, day: str) -> dict[str, DataFrame]:
    """The five tables of one UTC day."""
    return {
        "funnel_counts": daily_counts(spark, events, day),
        "verify_workload": daily_workload(spark, events, day),
        "join_quality": daily_join_quality(spark, events, day),
        "integrate_attributed": attributed(events, day).select(F.lit(day).alias("day_utc"), "*"),
        "rolling_30d": attributed(events, day, 29).select(
            F.lit(day).alias("window_end_day_utc"), F.date_sub(F.lit(day).cast("date"), 29).cast("string").alias("window_start_day_utc"), "*"),
    }


def write_daily_pack(spark: SparkSession, events: DataFrame, day: str, folder: str) -> None:
    """Five CSV folders; each table has a handful of rows, so one file each."""
    for name, df in daily_pack(spark, events, day).items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/day={day}/{name}")
