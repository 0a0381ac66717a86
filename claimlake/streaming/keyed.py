"""Streams with keyed state and event-time timers: eventual checks of rows, absences and steps, and session closing.

Everything is decided when the watermark has passed the moment in question, on events in event-time order, so verdicts depend
neither on the order of arrival (within the lateness allowed) nor on how events fall into batches. State lives in RocksDB.

State per key is what can still matter: claims whose window is open, by deadline, and the row's turns since the oldest such
claim could have been made, with the last one before it.
"""

from __future__ import annotations

import datetime as dt
from bisect import bisect_right
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers asks for the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


def _instant(ms: int) -> dt.datetime:
    return dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc)


# --- eventual checks ------------------------------------------------------------------------------

CLAIMS_OUT = "key string, claim_id string, step_id string, n_effects int, status string, code string, seen_at long, deadline timestamp"
#: Claims of a key that one entry of its state holds; more only where so many are due at one instant.
CLAIMS_HELD = 1024


class KeyedClaims(StatefulProcessor):
    """Claims about one row, each decided at its own deadline, claim time + window.

    A claim that expects the row looks for the first moment from its own time on at which the row is there: its value then is
    right (verified), wrong (inconsistent) or unreadable (incomplete). One that expects its absence looks for the first moment without it.
    Of turns at one instant a present row counts, and of several such rows the largest value.

    Each call on state or timers goes to the JVM and back, so claims are held by runs of deadlines, under the first of the run, and the
    first run of all has a timer.
    """

    def __init__(self, window_us: int) -> None:
        self.window = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        claim = "struct<id:string,at:bigint,absent:boolean,wanted:string,step:string,effects:int>"
        self.claims = handle.getMapState("claims", "due long", f"list array<{claim}>")
        self.turns = handle.getMapState("turns", "at long", "is_on boolean, value string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802,N803
        claims: list[tuple] = []
        turns: dict[int, tuple] = {}
        for r in rows:
            at = r.at
            if r.kind == "claim":
                claims.append((r.claim_id, at, r.expect == "absent", r.wanted, r.step_id, r.n_effects))
            else:
                turns[at] = max(turns.get(at, (False, None)), (r.kind == "row", r.value), key=_rank)
        if claims:
            self.handle.registerTimer(self._hold(claims))
        if turns:
            held = {k[0]: (v[0], v[1]) for k, v in self.turns.iterator()}
            line = held | {at: max(held[at], turn, key=_rank) if at in held else turn for at, turn in turns.items()}
            self._keep(line, held, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802,N803
        """All claims that are due by now, in one pass over the turns; other timers then find them gone."""
        due, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        if not self.claims.containsKey((due,)):
            return
        held = {k[0]: (v[0], v[1]) for k, v in self.turns.iterator()}
        line = sorted((at, *turn) for at, turn in held.items())
        times = [turn[0] for turn in line]
        runs = {k[0]: [tuple(c) for c in v[0]] for k, v in self.claims.iterator()}
        passed = lambda d: d == due or d < now
        last = due
        for first in sorted(d for d in runs if passed(d)):
            for claim in sorted(runs[first], key=self._due):
                if passed(d := self._due(claim)):
                    last = max(last, d)
                    yield self._verdict(key[0], d, claim, line, times)
        rest = [c for first, run in runs.items() if passed(first) for c in run if not passed(self._due(c))]
        waiting = [first for first in runs if not passed(first)]
        if waiting:
            for first in runs.keys() - set(waiting):
                self.claims.removeKey((first,))
        else:
            self.claims.clear()
        if rest:
            waiting.append(self._hold(rest))
        if waiting:
            self.handle.registerTimer(min(waiting))
        self._keep(held, held, last)

    def _due(self, claim: tuple) -> int:
        return -(-(claim[1] + self.window) // 1000)

    def _hold(self, claims: list[tuple]) -> int:
        """Add claims to the state, by runs of deadlines; the first deadline of them."""
        claims = sorted(claims, key=self._due)
        start = 0
        while start < len(claims):
            end = min(start + CLAIMS_HELD, len(claims))
            while end < len(claims) and self._due(claims[end]) == self._due(claims[end - 1]):
                end += 1
            first = self._due(claims[start])
            held = self.claims.getValue((first,))
            self.claims.updateValue((first,), ([*(tuple(c) for c in held[0]), *claims[start:end]] if held else claims[start:end],))
            start = end
        return self._due(claims[0])

    def _verdict(self, key: str, due: int, claim: tuple, line: list[tuple[int, bool, str | None]], times: list[int]) -> Row:
        name, at, absent, wanted, step, effects = claim
        first, last = bisect_right(times, at), bisect_right(times, at + self.window)
        start = (at, *line[first - 1][1:]) if first else (at, False, None)
        hits = [turn for turn in (start, *line[first:last]) if turn[1] != absent]
        seen, value = (hits[0][0], hits[0][2]) if hits else (None, None)
        if not hits:
            status, code = "uncertain", "FORBIDDEN_ROWS_STILL_PRESENT_WITHIN_WINDOW" if absent else "ROW_NOT_OBSERVED_WITHIN_WINDOW"
        elif absent or wanted is None or value == wanted:
            status, code = "verified", None
        elif value is None:
            status, code = "incomplete_verification", "UNREADABLE_VALUE"
        else:
            status, code = "inconsistent", "VALUE_MISMATCH"
        return Row(key=key, claim_id=name, step_id=step, n_effects=effects, status=status, code=code, seen_at=seen, deadline=_instant(due))

    def _keep(self, line: dict[int, tuple], held: dict[int, tuple], watermark_ms: int) -> None:
        """Hold the turns, of which the state has those in held, without any that no open claim and no later one can ask for."""
        oldest = watermark_ms * 1000 - self.window
        old = sorted(at for at in line if at <= oldest)
        # absent is what no turn at all says
        gone = set(old if old and not line[old[-1]][0] else old[:-1])
        kept = {at: turn for at, turn in line.items() if at not in gone}
        dropped = [at for at in held if at in gone]
        if len(dropped) > len(kept):
            self.turns.clear()
            held, dropped = {}, []
        for at in dropped:
            self.turns.removeKey((at,))
        for at, turn in kept.items():
            if held.get(at) != turn:
                self.turns.updateValue((at,), turn)

    def close(self) -> None:
        pass


def _rank(turn: tuple) -> tuple:
    return turn[0], turn[1] is not None, turn[1] or ""


def eventual_verdicts(changes: DataFrame, window_ms: int, late: str = "0 seconds") -> DataFrame:
    """Claims against the changes of their rows, in one stream.

    changes: key, ts and kind: `claim` with claim_id, expect (`row` or `absent`), wanted (the value asked for, null for any), step_id and
    n_effects; `row` with value (null if unreadable); `gone`. Result: CLAIMS_OUT; seen_at is the deciding moment in microseconds.
    """
    with_rocksdb(changes.sparkSession)
    timed = changes.withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    return timed.groupBy("key").transformWithState(KeyedClaims(window_ms * 1000), CLAIMS_OUT, "Append", "EventTime", eventTimeColumnName="deadline")


STEPS_OUT = "step_id string, status string, code string"


class StepEffects(StatefulProcessor):
    """Effects of one step, handed over by their keys: the step is decided by what they were when the first of them was seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.effects = handle.getMapState("effects", "claim_id string", "status string, seen_at long, n_effects int")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802,N803
        new, dues = {}, set()
        for r in rows:
            new[r.claim_id] = (r.status, r.seen_at, r.n_effects)
            dues.add(r.due + 1)
        held = {k[0]: tuple(v) for k, v in self.effects.iterator()}
        every = held | new
        if len(every) >= next(iter(every.values()))[2]:
            if held:
                self.effects.clear()
            yield self._said(key[0], list(every.values()))
            return
        for name, effect in new.items():
            self.effects.updateValue((name,), effect)
        for due in dues:
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802,N803
        held = [v for _, v in self.effects.iterator()]
        if held:  # an effect was never claimed
            self.effects.clear()
            yield Row(step_id=key[0], status="incomplete_verification", code="MULTI_EFFECT_INCOMPLETE")

    @staticmethod
    def _said(step: str, held: list) -> Row:
        moments = [at for _, at, _ in held if at is not None]
        then = ["missing" if not moments or at != min(moments) else status for status, at, _ in held]
        ok = sum(s == "verified" for s in then)
        if "incomplete_verification" in then:
            status, code = "incomplete_verification", "MULTI_EFFECT_INCOMPLETE"
        elif ok == len(then):
            status, code = "verified", None
        elif not moments:
            status, code = "uncertain", "MULTI_EFFECT_UNCERTAIN_WITHIN_WINDOW"
        elif ok == 0:
            status, code = "inconsistent", "MULTI_EFFECT_ALL_FAILED"
        else:
            status, code = "partially_verified", "MULTI_EFFECT_PARTIAL"
        return Row(step_id=step, status=status, code=code)

    def close(self) -> None:
        pass


def eventual_steps(changes: DataFrame, window_ms: int, late: str = "0 seconds") -> DataFrame:
    """Steps of several effects, each an eventual check of its own row: a step waits only while all its effects are missing."""
    verdicts = eventual_verdicts(changes, window_ms, late).filter(F.col("step_id").isNotNull())
    verdicts = verdicts.withColumn("due", F.unix_millis("deadline"))
    return verdicts.groupBy("step_id").transformWithState(StepEffects(), STEPS_OUT, "Append", "EventTime")


# --- sessions ------------------------------------------------------------------------------

SESSIONS_OUT = "workflow_id string, outcome string, how string, event_id string, started long, ended long, n_events long, n_claims long"


class Session(StatefulProcessor):
    """One workflow's session: open from its first event until run_completed or a silence of `gap`, then closed for good.

    Outcomes: one row `closed` (how: run_completed or gap), and a row `refused` for each event behind the close. A closed session is
    remembered for `remember`; an event after that opens a new one.
    """

    def __init__(self, gap_us: int, remember_us: int) -> None:
        self.gap, self.remember = gap_us, remember_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id string, claim boolean, completes boolean")
        self.session = handle.getValueState("session", "started long, last long, n_events long, n_claims long, closed boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802,N803
        new = [(r.at, r.event_id, r.type == "tool_observed", r.type == "control" and r.control_kind == "run_completed") for r in rows]
        self.waiting.appendList(new)
        self.handle.registerTimer(min(e[0] for e in new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802,N803
        """All events up to the watermark, in order; those behind it wait on."""
        now = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted(tuple(e) for e in self.waiting.get())
        rest = [e for e in events if e[0] >= now]
        held = self.session.get() if self.session.exists() else None
        state = tuple(held) if held else None
        for at, name, claim, completes in events[: len(events) - len(rest)]:
            if state and not state[4] and at >= state[1] + self.gap:
                yield self._closed(key[0], state, "gap", state[1] + self.gap)
                state = (*state[:4], True)
            if state and state[4] and at >= state[1] + self.remember:
                state = None
            if state and state[4]:
                yield Row(workflow_id=key[0], outcome="refused", how=None, event_id=name, started=None, ended=at, n_events=None, n_claims=None)
                continue
            state = (state[0] if state else at, at, (state[2] if state else 0) + 1, (state[3] if state else 0) + int(claim), completes)
            if completes:
                yield self._closed(key[0], state, "run_completed", at)
        if state and not state[4] and state[1] + self.gap <= now:
            yield self._closed(key[0], state, "gap", state[1] + self.gap)
            state = (*state[:4], True)
        if state and state[4] and state[1] + self.remember <= now:
            state = None
        if len(rest) < len(events):
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        if state:
            self.session.update(state)
            self.handle.registerTimer((state[1] + (self.remember if state[4] else self.gap)) // 1000 + 1)
        else:
            self.session.clear()
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)

    @staticmethod
    def _closed(workflow: str, state: tuple, how: str, at: int) -> Row:
        return Row(workflow_id=workflow, outcome="closed", how=how, event_id=None, started=state[0], ended=at, n_events=state[2], n_claims=state[3])

    def close(self) -> None:
        pass


def sessions(events: DataFrame, gap_ms: int, remember_ms: int, late: str = "0 seconds") -> DataFrame:
    """Closed sessions and refused events of workflow_id, event_id, type, control_kind, ts; times of the result are microseconds."""
    with_rocksdb(events.sparkSession)
    timed = events.withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    return timed.groupBy("workflow_id").transformWithState(Session(gap_ms * 1000, remember_ms * 1000), SESSIONS_OUT, "Append", "EventTime")
