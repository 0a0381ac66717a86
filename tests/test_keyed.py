"""Keyed streams: the same verdicts however events arrive, and tables that batches refresh."""

import random

from claimlake.plans import kpi
from claimlake.streaming import keyed as K
from claimlake.streaming import rolling as R
from tests.test_streams import at, replay, write_batches

CHANGES = "key string, kind string, claim_id string, expect string, wanted string, step_id string, n_effects int, value string, ts timestamp"
END = ("end", "gone", None, None, None, None, None, None, at(10_000))


def claim(key, name, minute, expect="row", wanted=None, step=None, effects=None):
    return (key, "claim", name, expect, wanted, step, effects, None, at(minute))


def row(key, minute, value="x"):
    return (key, "row", None, None, None, None, None, value, at(minute))


def gone(key, minute):
    return (key, "gone", None, None, None, None, None, None, at(minute))


EVENTS = [
    claim("a", "seen later", 0, wanted="x"), row("a", 3), claim("a", "there", 4, wanted="x"), row("a", 6, "y"), claim("a", "other value", 7, wanted="x"), claim("a", "any value", 7),
    row("a", 8, None), claim("a", "unreadable", 9, wanted="x"), gone("a", 10), claim("a", "gone", 10), claim("a", "back at the end", 15), row("a", 20),
    claim("b", "never there", 1, "absent"), row("c", 0), claim("c", "goes", 1, "absent"), gone("c", 6), row("d", 0), claim("d", "stays", 1, "absent"), gone("d", 6.5), claim("d", "went before", 7, "absent"),
    row("e", 5, "m"), row("e", 5, "z"), gone("e", 5), claim("e", "largest of a moment", 5, wanted="z"), claim("z", "no key", 0),
]
VERDICTS = {
    "seen later": ("verified", 3), "there": ("verified", 4), "other value": ("inconsistent", 7), "any value": ("verified", 7), "unreadable": ("incomplete_verification", 9), "gone": ("uncertain", None),
    "back at the end": ("verified", 20), "never there": ("verified", 1), "goes": ("verified", 6), "stays": ("uncertain", None), "went before": ("verified", 7), "largest of a moment": ("verified", 5), "no key": ("uncertain", None),
}


def micros(minute):
    return None if minute is None else int((at(minute) - at(0)).total_seconds()) * 1_000_000 + 1_704_067_200_000_000


def test_verdicts_do_not_depend_on_arrival(spark, tmp_path):
    shuffled = EVENTS[:]
    random.Random(7).shuffle(shuffled)
    for n, batches in enumerate(([[*EVENTS, END]], [shuffled[k::3] for k in range(3)] + [[END]])):
        folder = tmp_path / str(n)
        write_batches(spark, folder / "in", CHANGES, batches)
        got = replay(spark, CHANGES, str(folder / "in"), str(folder), lambda s: K.eventual_verdicts(s, 5 * 60_000, "1 day"))
        assert {r.claim_id: (r.status, r.seen_at) for r in got.collect()} == {name: (status, micros(minute)) for name, (status, minute) in VERDICTS.items()}
        codes = {r.status: r.code for r in got.filter("claim_id IN ('gone', 'stays', 'unreadable', 'other value', 'there')").orderBy("claim_id").collect()}
        assert codes["inconsistent"] == "VALUE_MISMATCH" and codes["incomplete_verification"] == "UNREADABLE_VALUE"


def test_open_claims_wait_and_old_turns_go(spark, tmp_path):
    turns = [row("k", m) if m % 2 == 0 else gone("k", m) for m in range(400)]
    write_batches(spark, tmp_path / "in", CHANGES, [turns[i : i + 100] for i in range(0, 400, 100)] + [[claim("k", "open", 401)]])
    source = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = K.eventual_verdicts(source, 5 * 60_000).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(rows) < 260 and spark.read.schema(K.CLAIMS_OUT).parquet(f"{tmp_path}/out").count() == 0


def test_steps_are_decided_at_the_first_sight_of_an_effect(spark, tmp_path):
    step = lambda name, *effects: [claim(key, f"{name}/{i}", 0, wanted=wanted, step=name, effects=len(effects)) for i, (key, wanted) in enumerate(effects)]
    events = [
        *step("both at once", ("a", "x"), ("b", None)), *step("one later", ("a", "x"), ("c", "x")), *step("all wrong", ("a", "q"), ("b", "q")), *step("wrong and late", ("a", "q"), ("c", "x")),
        *step("nothing", ("n", None), ("m", None)), *step("unreadable first", ("u", "x"), ("a", "x")), *step("alone", ("c", "x")), claim("a", "half/0", 0, step="half", effects=2),
        row("a", 2), row("b", 2), row("c", 3), row("u", 2, None),
    ]
    write_batches(spark, tmp_path / "in", CHANGES, [events, [END]])
    got = replay(spark, CHANGES, str(tmp_path / "in"), str(tmp_path), lambda s: K.eventual_steps(s, 5 * 60_000))
    assert {r.step_id: (r.status, r.code) for r in got.collect()} == {
        "both at once": ("verified", None), "one later": ("partially_verified", "MULTI_EFFECT_PARTIAL"), "all wrong": ("inconsistent", "MULTI_EFFECT_ALL_FAILED"), "wrong and late": ("inconsistent", "MULTI_EFFECT_ALL_FAILED"),
        "nothing": ("uncertain", "MULTI_EFFECT_UNCERTAIN_WITHIN_WINDOW"), "unreadable first": ("incomplete_verification", "MULTI_EFFECT_INCOMPLETE"), "alone": ("verified", None), "half": ("incomplete_verification", "MULTI_EFFECT_INCOMPLETE"),
    }


def test_sessions_close_once_and_refuse_what_follows(spark, tmp_path):
    schema = "workflow_id string, event_id string, type string, control_kind string, ts timestamp"
    event = lambda w, name, minute, kind=None, type_="tool_observed": (w, name, "control" if kind else type_, kind, at(minute))
    events = [
        event("a", "1", 0), event("a", "2", 5, "run_completed"), event("a", "3", 6), event("a", "4", 7, "run_completed"), event("b", "1", 0), event("b", "2", 29), event("b", "3", 59), event("b", "4", 60, "run_completed"),
        event("c", "1", 0, "gate"), event("d", "1", 3, "run_completed"), event("e", "1", 0), event("e", "2", 40 + 24 * 60),
    ]
    shuffled = events[:]
    random.Random(3).shuffle(shuffled)
    for n, batches in enumerate(([[*events, event("end", "", 99_000)]], [shuffled[:6], shuffled[6:], [event("end", "", 99_000)]])):
        folder = tmp_path / str(n)
        write_batches(spark, folder / "in", schema, batches)
        got = replay(spark, schema, str(folder / "in"), str(folder), lambda s: K.sessions(s, 30 * 60_000, 24 * 3_600_000, "3 days")).filter("workflow_id <> 'end'").collect()
        assert sorted((r.workflow_id, r.how, r.started, r.ended, r.n_events, r.n_claims) for r in got if r.outcome == "closed") == [
            ("a", "run_completed", micros(0), micros(5), 2, 1), ("b", "gap", micros(0), micros(59), 2, 2), ("c", "gap", micros(0), micros(30), 1, 0), ("d", "run_completed", micros(3), micros(3), 1, 0),
            ("e", "gap", micros(0), micros(30), 1, 1), ("e", "gap", micros(1480), micros(1510), 1, 1)]
        assert sorted((r.workflow_id, r.event_id) for r in got if r.outcome == "refused") == [("a", "3"), ("a", "4"), ("b", "3"), ("b", "4")]


def test_rolling_counts_after_every_batch(spark, tmp_path):
    rng = random.Random(5)
    schema = "id long, event string, install_id string, metadata string, created_at timestamp"
    rows = [(
        k, rng.choice(["verify_started", "verify_started", "verify_outcome", "integrate_landed"]), rng.choice([None, "", *(f"i{n}" for n in range(60))]),
        rng.choice([None, '{"telemetry_source":"local_dev"}', '{"telemetry_source":"cli"}']), at(rng.randint(0, 25 * 1440)),
    ) for k in range(600)]
    batches = [[r for r in rows if r[4] < at(9 * 1440) and r[0] % 5], [r for r in rows if r[4] >= at(9 * 1440) and r[0] % 5], [r for r in rows if r[0] % 5 == 0], []]
    for n, batch in enumerate(batches):
        R.refresh(spark.createDataFrame(batch, schema), n, str(tmp_path))
        if n == 1:
            R.refresh(spark.createDataFrame(batch, schema), n, str(tmp_path))  # a replayed batch
        whole = spark.createDataFrame(sum(batches[: n + 1], []), schema)
        want = {(r.as_of, r.distinct_installs, r.outcome_rows) for r in kpi.rolling(whole).collect()}
        assert {(str(r.as_of), r.distinct_installs, r.outcome_rows) for r in R.current(spark, str(tmp_path)).collect()} == want


class Held(dict):
    """Map state that counts how often it is read through."""

    reads = 0

    containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.get, dict.__setitem__, dict.__delitem__  # noqa: N815

    def iterator(self):
        self.reads += 1
        return iter(list(self.items()))


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs  # noqa: N815


def test_due_claims_share_a_pass_over_the_turns():
    keyed = K.KeyedClaims(5_000)
    keyed.turns = Held({(i * 1_000_000,): (i % 2 == 0, "x") for i in range(200)})
    keyed.claims = Held({(1000 * i + 5,): ([(f"c{i}", i * 1_000_000, False, None, None, None)],) for i in range(200)})
    due = sorted(k[0] for k in keyed.claims)
    got = [v for ms in due for v in keyed.handleExpiredTimer(("k",), Clock(10_000_000), Clock(ms))]
    assert [(v.claim_id, v.status) for v in got] == [(f"c{i}", "verified" if i % 2 == 0 else "uncertain") for i in range(200)]
    assert not keyed.claims and keyed.turns.reads <= 2


class Calls(dict):
    """Map state that counts the calls on it, and a handle that counts timers."""

    def __init__(self):
        super().__init__()
        self.calls, self.timers = 0, []

    def __getattribute__(self, name):
        if name in ("containsKey", "getValue", "updateValue", "removeKey", "clear", "iterator"):
            self.calls += 1
        return super().__getattribute__(name)

    containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.get, dict.__setitem__, dict.__delitem__  # noqa: N815

    def iterator(self):
        return iter(list(self.items()))

    def registerTimer(self, due):  # noqa: N802
        self.timers.append(due)


class Change:
    def __init__(self, kind, at, **more):
        self.__dict__ = {"kind": kind, "at": at, "claim_id": None, "expect": "row", "wanted": None, "step_id": None, "n_effects": None, "value": None, **more}


def test_a_key_of_many_claims_makes_few_calls():
    keyed = K.KeyedClaims(5_000_000)
    keyed.claims, keyed.turns, keyed.handle = Calls(), Calls(), Calls()
    second = 1_000_000
    rows = [Change("claim", i * second, claim_id=f"c{i}") for i in range(3000)] + [Change("row" if i % 20 < 10 else "gone", i * second, value="x") for i in range(0, 3000, 10)]
    random.Random(2).shuffle(rows)
    assert list(keyed.handleInputRows(("k",), iter(rows), Clock(0))) == []
    assert keyed.handle.timers == [5000] and keyed.claims.calls <= 6 and keyed.turns.calls <= 301
    got, at = [], 0
    for clock in (1_000_000, 2_500_500, 9_000_000):  # a timer that a later one overtakes finds nothing
        for due in [t for t in keyed.handle.timers if t < clock]:
            keyed.handle.timers.remove(due)
            found = list(keyed.handleExpiredTimer(("k",), Clock(clock), Clock(due)))
            assert all(v.deadline < K._instant(clock) for v in found)
            got += found
    assert [v.claim_id for v in got] == [f"c{i}" for i in range(3000)] and not keyed.claims
    assert all((v.status, v.seen_at) == (("verified", at * second) if at % 20 < 10 else ("uncertain", None) if at % 20 < 15 else ("verified", (at // 20 + 1) * 20 * second)) or at > 2980 for at, v in enumerate(got))
    assert keyed.claims.calls <= 20 and keyed.turns.calls <= 700


def test_a_step_whose_effects_come_together_is_not_written():
    step = K.StepEffects()
    step.effects = step.handle = Calls()
    effect = lambda name, due=9: Change("", 0, claim_id=name, status="verified", seen_at=5, n_effects=3, due=due)
    assert [r.status for r in step.handleInputRows(("s",), iter([effect("a"), effect("b"), effect("a"), effect("c")]), Clock(0))] == ["verified"]
    assert step.effects.calls == 1 and step.handle.timers == []
    assert list(step.handleInputRows(("s",), iter([effect("a"), effect("b")]), Clock(0))) == [] and step.handle.timers == [10]
    assert [r.code for r in step.handleInputRows(("s",), iter([effect("c")]), Clock(0))] == [None] and not step.effects
