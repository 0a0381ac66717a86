"""Outcomes against reservations as a stream: an outer interval join of two streams, each with its watermark."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from claimlake.plans.usage import RESERVATION_HOURS
from claimlake.streaming.keyed import with_rocksdb

DECIDED = "id long, api_key string, decision string"


class FirstUse(StatefulProcessor):
    """Outcomes of one (key, run), in event-time order: the first in time uses the reservation. The mark ends with it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "reserved long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802,N803
        for r in sorted(rows, key=lambda r: (r.at, r.id)):
            if r.reserved is None:
                said = "unknown"
            elif r.at > r.reserved + RESERVATION_HOURS * 3_600_000_000:
                said = "expired"
            elif self.used.exists():
                said = "repeat"
            else:
                said = "accepted"
                self.used.update((r.reserved,))
                self.handle.registerTimer(r.reserved // 1000 + RESERVATION_HOURS * 3_600_000 + 1)
            yield Row(id=r.id, api_key=key[0], decision=said)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802,N803
        self.used.clear()
        return iter(())

    def close(self) -> None:
        pass


def reservation_expiry(events: DataFrame, keep: str = "1 hour", remember_hours: int = 24) -> DataFrame:
    """id, api_key, decision of every outcome: unknown before a reservation, accepted once within RESERVATION_HOURS of the first, then
    repeat, and expired after.

    events: api_key, run_id, kind (`reserve` or `outcome`), id, created_at. A reservation is remembered for remember_hours; an outcome later
    than that finds none. All state ends by itself: join rows with that bound, an outcome's first reservation when the watermark
    passes the outcome, the mark of a use with the reservation.
    """
    with_rocksdb(events.sparkSession)
    outcomes = events.filter("kind = 'outcome'").select("api_key", "run_id", "id", "created_at").withWatermark("created_at", keep)
    reserves = events.filter("kind = 'reserve'").select(F.col("api_key").alias("r_key"), F.col("run_id").alias("r_run"), F.col("created_at").alias("reserved_at")).withWatermark("reserved_at", keep)
    near = F.expr(f"api_key = r_key AND run_id = r_run AND reserved_at <= created_at AND reserved_at >= created_at - interval {remember_hours} hours")
    first = outcomes.join(reserves, near, "leftOuter").groupBy("api_key", "run_id", "id", "created_at").agg(F.min("reserved_at").alias("reserved_at"))
    timed = first.select("api_key", "run_id", "id", "created_at", F.unix_micros("created_at").alias("at"), F.unix_micros("reserved_at").alias("reserved"))
    return timed.groupBy("api_key", "run_id").transformWithState(FirstUse(), DECIDED, "Append", "EventTime")
