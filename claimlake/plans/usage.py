"""Usage quotas, hourly caps, reservations and recent activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.operators.skew import block_positions
from claimlake.operators.topk import ranked

# How long a reservation backs an outcome, and activity list sizes.
RESERVATION_HOURS = 6
RECENT_SCAN, RECENT_KEEP = 50, 10


def hour_start(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def usage_monthly(reservations: DataFrame, limit: int) -> DataFrame:
    """Per (key, run): its first reservation, month, place in the month, and whether the quota allows it.

    Repeats of a run are free. Places are counted per minute, so one busy key, or one busy day of it, is not one task.
    """
    first = reservations.groupBy("api_key", "run_id").agg(F.min("created_at").alias("first_at")).withColumn(
        "month", F.date_format("first_at", "yyyy-MM")
    )
    placed = block_positions(first, ["api_key", "month"], F.date_trunc("minute", "first_at"), ["first_at", "run_id"], "place")
    return placed.withColumn("allowed", F.col("place") < limit)


def month_counter(reservations: DataFrame, limit: int) -> DataFrame:
    return usage_monthly(reservations, limit).groupBy("api_key", "month").agg(
        F.count_if("allowed").alias("used"), F.count_if(~F.col("allowed")).alias("denied")
    )


def key_usage(keys: DataFrame, counters: DataFrame, month: str, limits: dict[str, int | None]) -> DataFrame:
    """Live keys with their month counter and plan limit."""
    limit = F.lit(None).cast("int")
    for plan, n in limits.items():
        limit = F.when(F.col("plan") == plan, F.lit(n).cast("int")).otherwise(limit)
    current = counters.filter(F.col("month") == month).select("api_key", "used")
    return keys.filter("revoked_at is null").join(current, "api_key", "left").select(
        "api_key", "user_id", "plan", F.coalesce("used", F.lit(0)).alias("used"), limit.alias("month_limit")
    )


def hourly_limit(requests: DataFrame, cap: int) -> DataFrame:
    """Each request's 1-based place in its (scope, key, UTC hour) and whether the cap lets it pass."""
    hourly = requests.withColumn("window_start", hour_start(F.col("ts")))
    placed = block_positions(hourly, ["scope", "scope_key", "window_start"], F.date_trunc("second", "ts"), ["ts", "id"], "before")
    return placed.withColumn("place", F.col("before") + 1).withColumn("allowed", F.col("place") <= cap).drop("before")


def reservation_outcomes(outcomes: DataFrame, reservations: DataFrame) -> DataFrame:
    """Each outcome against the reservation of its (key, run): unknown (none yet), expired, accepted or repeat."""
    held = reservations.groupBy("api_key", "run_id").agg(F.min("created_at").alias("reserved_at"))
    # Only an outcome inside the window can be accepted, so the earliest such outcome is the accepted one.
    matched = outcomes.join(held, ["api_key", "run_id"], "left").withColumn("known", F.coalesce(F.col("created_at") >= F.col("reserved_at"), F.lit(False))).withColumn(
        "in_time", F.col("known") & (F.col("created_at") <= F.col("reserved_at") + F.expr(f"interval {RESERVATION_HOURS} hours"))
    )
    first = matched.filter("in_time").groupBy("api_key", "run_id").agg(F.min(F.struct("created_at", "id")).alias("first"))
    return matched.join(first, ["api_key", "run_id"], "left").withColumn(
        "decision",
        F.when(~F.col("known"), "unknown").when(~F.col("in_time"), "expired")
        .when(F.struct("created_at", "id") == F.col("first"), "accepted").otherwise("repeat"),
    ).drop("first", "in_time", "known")


def recent_activity(outcomes: DataFrame, valid: Column) -> DataFrame:
    """Newest outcomes per user: the last 50 are read, the first 10 well-formed ones are shown."""
    newest = ranked(outcomes, ["user_id"], [F.col("created_at").desc(), F.col("id").desc()], RECENT_SCAN, "seen")
    return ranked(newest.filter(valid), ["user_id"], ["seen"], RECENT_KEEP, "place").drop("seen")
