"""Streams run over file sources until all input is read."""

import datetime as dt

from pyspark.sql import functions as F

from claimlake.streaming import streams as Z

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def write_batches(spark, folder, schema, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/b{i}")


def replay(spark, schema, folder, out, build):
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    q = build(source).writeStream.outputMode("append").format("parquet").option("path", f"{out}/out").option(
        "checkpointLocation", f"{out}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/out")


def test_eventual_stream(spark, tmp_path):
    schema = "key string, kind string, claim_id string, ts timestamp"
    batches = [
        [("k1", "claim", "c1", at(0)), ("k2", "claim", "c2", at(0)), ("k3", "row", None, at(0))],
        [("k1", "row", None, at(1)), ("k3", "claim", "c3", at(1))],
        [("k9", "claim", "c9", at(60))],
        [("k9", "row", None, at(90))],
    ]
    write_batches(spark, tmp_path / "in", schema, batches)
    got = replay(spark, schema, str(tmp_path / "in"), str(tmp_path), lambda s: Z.eventual_stream(s, 5 * 60 * 1000))
    assert {(r.claim_id, r.status) for r in got.collect()} == {("c1", "verified"), ("c2", "uncertain"), ("c3", "verified"), ("c9", "uncertain")}


def test_first_beacon_wins(spark, tmp_path):
    schema = "run_id string, event string, created_at timestamp"
    write_batches(spark, tmp_path / "in", schema, [[("r", "a", at(0)), ("r", "a", at(1)), ("r", "b", at(1))], [("r", "a", at(2)), ("q", "a", at(2))]])
    got = replay(spark, schema, str(tmp_path / "in"), str(tmp_path), Z.idempotent_beacons)
    assert sorted((r.run_id, r.event) for r in got.collect()) == [("q", "a"), ("r", "a"), ("r", "b")]


def test_verify_each_batch(spark, tmp_path):
    schema = "source_file string, line_no long, line string"
    write_batches(spark, tmp_path / "in", schema, [[("f", 0, "x")], [("g", 0, "y"), ("g", 1, "z")]])
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = Z.verify_each_batch(source, lambda b: b.groupBy("source_file").agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert sorted((r.source_file, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("f", 1), ("g", 2)]


def test_each_claim_has_its_own_deadline(spark, tmp_path):
    schema = "key string, kind string, claim_id string, ts timestamp"
    batches = [
        [("k", "claim", "early", at(0)), ("k", "claim", "later", at(4)), ("g", "row", None, at(0)), ("g", "gone", None, at(2)), ("g", "claim", "after", at(3))],
        [("k", "row", None, at(7)), ("k", "gone", None, at(8)), ("x", "claim", "x", at(8))],
        [("k", "claim", "last", at(20)), ("x", "row", None, at(20))],
        [("end", "gone", None, at(600))],
    ]
    write_batches(spark, tmp_path / "in", schema, batches)
    got = replay(spark, schema, str(tmp_path / "in"), str(tmp_path), lambda s: Z.eventual_stream(s, 5 * 60 * 1000))
    assert {(r.claim_id, r.status) for r in got.collect()} == {("early", "uncertain"), ("later", "verified"), ("after", "uncertain"), ("x", "uncertain"), ("last", "uncertain")}


def test_eventual_rows_follow_presence(spark):
    claims = spark.createDataFrame([(1, "a", at(0)), (2, "a", at(30)), (3, "b", at(0)), (4, "c", at(0)), (5, "d", at(0))], "claim_id int, key string, claimed_at timestamp")
    history = spark.createDataFrame([("a", at(-10), at(-5), True), ("a", at(3), at(4), False), ("b", at(6), None, True), ("d", at(-3), at(1), True)], "key string, appeared_at timestamp, removed_at timestamp, matches boolean")
    got = {r.claim_id: r.status for r in Z.eventual_rows(claims, history, 300_000).collect()}
    assert got == {1: "inconsistent", 2: "uncertain", 3: "uncertain", 4: "uncertain", 5: "verified"}


def test_forbidden_row_must_be_gone_once(spark):
    claims = spark.createDataFrame([(1, "a", at(0)), (2, "b", at(0)), (3, "c", at(0)), (4, "d", at(0)), (5, "e", at(0))], "claim_id int, key string, claimed_at timestamp")
    history = spark.createDataFrame(
        [("a", at(-1), at(4)), ("b", at(-1), at(3)), ("b", at(2), None), ("c", at(2), None), ("d", at(-9), at(-1)), ("e", at(-1), at(2)), ("e", at(3), None)], "key string, appeared_at timestamp, removed_at timestamp")
    got = {r.claim_id: r.status for r in Z.eventual_absent(claims, history, 300_000).collect()}
    assert got == {1: "verified", 2: "uncertain", 3: "verified", 4: "verified", 5: "verified"}


def test_multi_effects_that_all_fail(spark):
    rows = [(1, "missing"), (1, "inconsistent"), (2, "uncertain"), (2, "uncertain"), (3, "verified"), (3, "uncertain"), (4, "verified"), (4, "incomplete_verification"), (5, "verified")]
    got = {r.step_id: (r.status, r.code) for r in Z.eventual_multi(spark.createDataFrame(rows, "step_id int, status string")).collect()}
    assert got == {
        1: ("inconsistent", "MULTI_EFFECT_ALL_FAILED"), 2: ("uncertain", "MULTI_EFFECT_UNCERTAIN_WITHIN_WINDOW"), 3: ("partially_verified", "MULTI_EFFECT_PARTIAL"),
        4: ("incomplete_verification", "MULTI_EFFECT_INCOMPLETE"), 5: ("verified", None)}


def test_late_events_go_aside(spark, tmp_path):
    schema = "id int, ts timestamp"
    write_batches(spark, tmp_path / "in", schema, [[(1, at(0)), (2, at(100))], [(3, at(50)), (4, at(39)), (5, at(200))], [(6, at(139)), (7, at(141))]])
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    Z.split_late(source, "1 hour", f"{tmp_path}/on", f"{tmp_path}/late", f"{tmp_path}/ck").awaitTermination()
    read = lambda side: {r.id for r in spark.read.schema(schema).parquet(f"{tmp_path}/{side}").collect()}
    assert read("late") == {4, 6} and read("on") == {1, 2, 3, 5, 7}


def test_reservation_stream_matches_batch(spark, tmp_path):
    from claimlake.plans.usage import reservation_outcomes
    from claimlake.streaming.reservations import reservation_expiry

    rows = [("k", "r1", "outcome", 1, at(60)), ("k", "r1", "outcome", 4, at(70)), ("k", "r2", "outcome", 2, at(500)), ("k", "r9", "outcome", 3, at(10)), ("k", "r3", "outcome", 5, at(5)),
            ("k", "r1", "reserve", None, at(0)), ("k", "r1", "reserve", None, at(65)), ("k", "r2", "reserve", None, at(0)), ("k", "r3", "reserve", None, at(6))]
    want = {1: "accepted", 2: "expired", 3: "unknown", 4: "repeat", 5: "unknown"}
    schema = "api_key string, run_id string, kind string, id long, created_at timestamp"
    every = spark.createDataFrame(rows, schema)
    got = reservation_outcomes(every.filter("kind = 'outcome'").drop("kind"), every.filter("kind = 'reserve'").drop("kind", "id"))
    assert {r.id: r.decision for r in got.collect()} == want
    end = lambda days: [("end", "", kind, None, at(60 * 24 * days)) for kind in ("reserve", "outcome")]
    write_batches(spark, tmp_path / "in", schema, [rows[:4], rows[4:], end(9)])
    streamed = replay(spark, schema, str(tmp_path / "in"), str(tmp_path), lambda s: reservation_expiry(s, "10 days"))
    assert streamed.count() == 0  # nothing is decided while the watermark waits
    closing = tmp_path / "again"
    write_batches(spark, closing / "in", schema, [[*rows, *end(30)]])
    streamed = replay(spark, schema, str(closing / "in"), str(closing), reservation_expiry)
    assert {r.id: r.decision for r in streamed.filter("api_key = 'k'").collect()} == want


def test_reservation_state_ends_by_itself(spark, tmp_path):
    from claimlake.plans.usage import reservation_outcomes
    from claimlake.streaming.reservations import reservation_expiry

    schema = "api_key string, run_id string, kind string, id long, created_at timestamp"
    day = lambda d: [row for k in range(20) for row in (
        (f"k{k}", f"r{d}", "reserve", None, at(d * 1440 + k)), (f"k{k}", f"r{d}", "outcome", d * 100 + k, at(d * 1440 + 2 * k)), (f"k{k}", f"r{d}", "outcome", d * 100 + 50 + k, at(d * 1440 + 10 * k + 300)))]
    batches = [day(d) for d in range(10)]
    write_batches(spark, tmp_path / "in", schema, [*batches, [("end", "", kind, None, at(1440 * 60)) for kind in ("reserve", "outcome")]])
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = reservation_expiry(source, "1 hour").writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    most = max(sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"])
    assert most < 5 * len(batches[0])  # some two days of rows with the join's own marks, of ten
    every = spark.createDataFrame(sum(batches, []), schema)
    want = reservation_outcomes(every.filter("kind = 'outcome'").drop("kind"), every.filter("kind = 'reserve'").drop("kind", "id"))
    assert {(r.id, r.decision) for r in spark.read.parquet(f"{tmp_path}/out").filter("api_key <> 'end'").collect()} == {(r.id, r.decision) for r in want.collect()}
