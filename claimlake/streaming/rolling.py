"""Rolling distinct counts refreshed by a stream: exact bitmaps per day, merged over the window, late days replaced.

A folder holds four tables with a part for each batch, so a replayed batch reads what it read before and overwrites itself:
`ids` (install -> number, dense over hash groups), `days` (the merged bitmaps of the days a batch touched; the latest part of a
day counts), `outcomes` (rows per day of the batch), and `kpis` (the reference days a batch changes; the latest part counts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlake.plans.kpi import is_event, not_local, with_metadata

#: Groups in which installs are numbered, each by itself.
GROUPS = 256
WINDOW_DAYS = 7


def _before(folder: str, name: str, schema: str, like: DataFrame, batch: int) -> DataFrame:
    """The parts of earlier batches."""
    spark = like.sparkSession
    if batch == 0:
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/{name}").filter(F.col("batch") < batch)


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("x")).select(*keys, "x.*")


IDS, DAYS, OUTCOMES, SPAN, KPIS = "install_id string, number long", "day date, bucket long, bits binary", "day date, n long", "first date, last timestamp", "as_of date, distinct_installs long, outcome_rows long"


def refresh(batch: DataFrame, batch_id: int, folder: str, days: int = WINDOW_DAYS) -> None:
    """Take in a batch of funnel events and write the reference days it changes."""
    def put(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
        return batch.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}/batch={batch_id}")

    rows = with_metadata(batch).withColumn("day", F.to_date("created_at"))
    span = put(rows.agg(F.min("day").alias("first"), F.max(F.col("created_at").cast("timestamp")).alias("last")), "span")
    counted = rows.filter(not_local())
    starts = counted.filter(is_event("verify_started") & F.col("install_id").isNotNull() & (F.col("install_id") != "")).select("install_id", "day").distinct()
    known = _before(folder, "ids", IDS, batch, batch_id).select("install_id", "number")
    group = lambda: F.pmod(F.xxhash64("install_id"), F.lit(GROUPS))
    tops = known.groupBy(F.pmod("number", F.lit(GROUPS)).alias("g")).agg((F.max("number") / GROUPS).cast("long").alias("top"))
    new = starts.select("install_id").distinct().join(known, "install_id", "left_anti").withColumn("g", group()).join(F.broadcast(tops), "g", "left")  # GROUPS rows at most
    place = F.row_number().over(Window.partitionBy("g").orderBy("install_id")) + F.coalesce("top", F.lit(-1))
    added = put(new.select("install_id", (place * GROUPS + F.col("g")).cast("long").alias("number")), "ids")

    numbered = starts.join(known.unionByName(added), "install_id").withColumn("number", F.col("number") + 1)
    fresh = numbered.groupBy("day", F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
    old = _latest(_before(folder, "days", DAYS, batch, batch_id), ["day", "bucket"])
    touched = fresh.select("day", "bucket").distinct()
    merged = put(fresh.unionByName(old.join(touched, ["day", "bucket"], "left_semi")).groupBy("day", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")), "days")
    outcomes = put(counted.filter(is_event("verify_outcome")).groupBy("day").agg(F.count("*").alias("n")), "outcomes")

    whole = old.join(touched, ["day", "bucket"], "left_anti").unionByName(merged)
    sums = _before(folder, "outcomes", OUTCOMES, batch, batch_id).select("day", "n").unionByName(outcomes).groupBy("day").agg(F.sum("n").alias("n"))
    spans = _before(folder, "span", SPAN, batch, batch_id).select("first", "last").unionByName(span).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    put(_kpis(whole, sums, spans, days).join(F.broadcast(span.select(F.to_date("last").alias("most"))), F.col("as_of") <= F.date_add("most", days)).drop("most"), "kpis")  # one row


def _kpis(bitmaps: DataFrame, outcomes: DataFrame, spans: DataFrame, days: int) -> DataFrame:
    """as_of, distinct_installs, outcome_rows: what happened from `days` before each day of the span on.

    Bitmaps and sums run from the last day backwards, per bucket; a running value holds for the reference days up to `days` after its day
    and behind those of the day before it.
    """
    def spread(df: DataFrame, keys: list[str]) -> DataFrame:
        earlier = F.lag("day").over(Window.partitionBy(*keys).orderBy("day"))
        asked = df.withColumn("earlier", earlier).join(F.broadcast(spans))  # one row
        first = F.greatest("first", F.date_add("earlier", days + 1))
        last = F.least(F.date_add("day", days), F.to_date("last"))
        return asked.filter(first <= last).withColumn("as_of", F.explode(F.sequence(first, last))).filter(F.col("as_of").cast("timestamp") < F.col("last"))

    def later(*keys: str) -> object:
        return Window.partitionBy(*keys).orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    installs = spread(bitmaps.select("day", "bucket", F.bitmap_count(F.bitmap_or_agg("bits").over(later("bucket"))).alias("n")), ["bucket"])
    rows = spread(outcomes.select("day", F.lit(0).alias("k"), F.sum("n").over(later()).alias("n")), ["k"])
    both = installs.select("as_of", F.col("n").alias("distinct_installs"), F.lit(0).cast("long").alias("outcome_rows")).unionByName(rows.select("as_of", F.lit(0).cast("long").alias("distinct_installs"), F.col("n").alias("outcome_rows")))
    day = spans.select(F.explode(F.sequence("first", F.to_date("last"))).alias("as_of"), "last").filter(F.col("as_of").cast("timestamp") < F.col("last"))
    both = both.unionByName(day.select("as_of", F.lit(0).cast("long").alias("distinct_installs"), F.lit(0).cast("long").alias("outcome_rows")))
    return both.groupBy("as_of").agg(F.sum("distinct_installs").alias("distinct_installs"), F.sum("outcome_rows").alias("outcome_rows"))


def rolling_stream(events: DataFrame, folder: str, checkpoint: str, days: int = WINDOW_DAYS):
    """Refresh the tables in `folder` with every batch of funnel events."""
    return events.writeStream.foreachBatch(lambda batch, n: refresh(batch, n, folder, days)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, folder: str) -> DataFrame:
    """as_of, distinct_installs, outcome_rows as the last batches left them."""
    return _latest(spark.read.schema(f"{KPIS}, batch long").parquet(f"{folder}/kpis"), ["as_of"])
