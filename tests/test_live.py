"""The live cycle's parts on small feeds: goldens, lifetimes, restarts, subscriptions."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tramline.functions import geo, text
from tramline.operators import gps, imports
from tramline.plans import live_plans
from tramline.plans.stream_plans import folder_for
from tramline.streaming import gps_stream, live, subscriptions

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(seconds: float) -> datetime.datetime:
    return T0 + datetime.timedelta(seconds=seconds)


def fed(spark, polls: list[list[tuple]], schema: str, folder: str | None = None):
    folder = folder or folder_for(spark, "feed")
    for rows in polls:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    live.use_state_store(spark)
    return gps_stream.read_pings(spark, folder, spark.createDataFrame([], schema).schema, files_per_trigger=1), folder


def run(spark, stream, name: str, folder: str | None = None, sinks: dict | None = None):
    folder = folder or folder_for(spark, name)
    live.write_cycles(stream, f"{folder}/out", f"{folder}/state", sinks or {}).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/rows"), folder


STOPS = "vehicle_id long, itinerary_id long, event_id long, seen_at timestamp, fraction double, length_m double, stop string, stop_m double, stop_id long"


def test_passages_golden_and_a_restart(spark):
    """A@120, A@60, B@140, B@200, A@100 are the passages A, B, A; a restart in between neither loses nor doubles one."""
    seen = [("A", 120.0), ("A", 60.0), ("B", 140.0), ("B", 200.0), ("A", 100.0)]
    rows = [(1, 2, k, at(60.5 * k), k / 10, 1000.0, s, m, 5) for k, (s, m) in enumerate(seen)]
    rows_of = lambda i: [r for r in rows if r[2] in i]
    raw, feed = fed(spark, [rows_of({0}), rows_of({1, 2}) + [(1, None, 90, at(100), 0.5, 1000.0, "Z", 1.0, 5)]], STOPS)
    stream = lambda r: live.with_passages(r.withColumn("ts", F.col("seen_at")).withWatermark("seen_at", "300 seconds"))
    _, out = run(spark, stream(raw), "golden", sinks={"passages": lambda d: d.filter("passage")})
    more, _ = fed(spark, [rows_of({3, 4})], STOPS, feed)
    done, _ = run(spark, stream(more), "golden", out)
    got = sorted((r.event_id, r.stop, r.secs_since_prev, r.leg_m) for r in done.filter("passage").collect())
    assert got == [(0, "A", None, None), (2, "B", 121.0, 200.0), (4, "A", 121.0, 200.0)]
    assert done.count() == 6
    assert spark.read.parquet(f"{out}/out/passages").count() == 2  # the sink of the first run


PINGS = "vehicle_id long, event_id long, ts timestamp, polled_at timestamp, line_code string, lat double, lon double, speed double"


def test_lifetimes_speeds_and_switches(spark):
    ping = lambda v, e, t, polled, line="L1", speed=30.0, lat=0.0: (v, e, at(t), at(polled), line, lat, e * 0.001, speed)
    polls = [
        [ping(1, 1, 0, 20), ping(1, 2, 5, 20, speed=40.0), ping(2, 3, 1, 20), ping(3, 4, -400, 20)],  # 1 counts once, 3 is too old
        [ping(1, 5, 5, 40, speed=99.0), ping(1, 6, 30, 40, speed=200.0, line="l1")],  # not newer; a spurious speed keeps the mean; the line is the same
        [ping(1, 7, 60, 65, line="L2", speed=50.0)],
        [ping(4, 8, 700, 700)],
        [ping(1, 9, 705, 710), ping(4, 10, 701, 710, speed=None)],
    ]
    raw, _ = fed(spark, polls, PINGS)
    bare = raw.withColumn("enriched", F.lit(False)).withColumn("candidates", F.lit(None).cast(live.CANDIDATE))
    states = live.vehicle_states(bare, 40, 180, 300, late="10 seconds")
    rows, _ = run(spark, states, "lives")
    got = {(r.event_id, r.status): r for r in rows.collect()}
    active = sorted(e for e, s in got if s == "active")
    assert active == [2, 3, 6, 7, 8, 9, 10]
    assert [got[e, "active"].mean_speed for e in (2, 6, 7)] == [40.0, 40.0, 45.0]
    assert [got[e, "active"].old_line for e in (6, 7, 9)] == [None, "l1", None]
    assert got[6, "active"].heading is not None and got[9, "active"].heading is None  # its last place was gone
    assert got[9, "active"].mean_speed == 30.0 and got[10, "active"].mean_speed == 30.0
    assert sorted((e, s) for e, s in got if s != "active") == [(3, "gone"), (3, "no_signal")]  # 7's vehicle was back before the watermark told


def test_a_line_index_lets_switched_and_gone_vehicles_go(spark):
    schema = "vehicle_id long, ts timestamp, seen_at timestamp, line_code string, old_line string, status string"
    row = lambda v, t, line, old=None, status="active": (v, at(t), at(t), line, old, status)
    polls = [[row(1, 0, "a "), row(2, 1, "A")], [row(1, 10, "B", "a "), row(2, 11, "a")], [row(2, 20, "A", None, "gone"), row(1, 21, "b")]]
    raw, _ = fed(spark, polls, schema)
    rows, _ = run(spark, live.line_changes(raw.withWatermark("seen_at", "10 seconds")), "index")
    assert sorted((r.cycle, r.line_code, r.vehicle_id, r.present) for r in rows.select("*", "cycle").collect()) == [(0, "A", 1, True), (0, "A", 2, True), (1, "A", 1, False), (1, "B", 1, True), (2, "A", 2, False)]


def test_a_vehicle_back_on_another_line_after_its_lifetime_leaves_the_first(spark):
    """Nobody was told that it was gone, so its first line must let it go when it is back."""
    ping = lambda v, e, t, line: (v, e, at(t), at(t), line, 0.0, 0.0, 30.0)
    raw, _ = fed(spark, [[ping(1, 1, 0, "L1"), ping(2, 2, 0, "L1")], [ping(1, 3, 700, "L2"), ping(2, 4, 700, "l1")]], PINGS)
    bare = raw.withColumn("enriched", F.lit(False)).withColumn("candidates", F.lit(None).cast(live.CANDIDATE))
    rows, _ = run(spark, live.line_changes(live.vehicle_states(bare, 40, 180, 300, late="10 seconds")), "back")
    got = sorted((r.cycle, r.line_code, r.vehicle_id, r.present) for r in rows.select("*", "cycle").collect())
    assert got == [(0, "L1", 1, True), (0, "L1", 2, True), (1, "L1", 1, False), (1, "L2", 1, True)]


def test_subscriptions_count_connections_and_are_read_anew(spark):
    folder = folder_for(spark, "subs")
    change = lambda *rows: subscriptions.change(spark.createDataFrame(list(rows), subscriptions.CHANGES), folder)
    turns = subscriptions.by_line(subscriptions.read_changes(spark, folder))
    assert turns.count() == 0
    change((1, "x", at(0), True), (1, "x", at(1), True), (1, "y", at(5), True), (1, "x", at(9), False))
    times = spark.createDataFrame([(k, at(k)) for k in (-1, 0, 4, 9, 20, 30)], "k int, t timestamp").withColumn("line_id", F.lit(1).cast("long"))
    wanted = lambda: {r.k: r.w for r in times.join(turns, "line_id", "left").select("k", subscriptions.wanted_at(F.col("turns"), F.col("t")).alias("w")).collect()}
    assert wanted() == {-1: False, 0: True, 4: True, 9: True, 20: True, 30: True}
    change((1, "y", at(15), False), (1, "z", at(25), True))
    assert wanted() == {-1: False, 0: True, 4: True, 9: True, 20: False, 30: True}


def test_ways_of_candidates_are_the_lines_local_headings(spark):
    """Looked up in pieces, also at the ends of a line, for pings before, on and behind it."""
    line = [(7, 1, [(-43.60, -23.0), (-43.598, -23.0), (-43.598, -22.998), (-43.598, -22.998), (-43.596, -22.997)])]
    own = spark.createDataFrame(line, "itinerary_id long, line_id long, vertices array<struct<lon:double,lat:double>>")
    pings = spark.createDataFrame([(k, 1, -23.0 + 0.0004 * k, -43.601 + 0.0007 * k) for k in range(9)], "event_id long, line_id long, lat double, lon double")
    found = live.with_candidates(pings, live.route_pieces(own, 250.0), 250.0).select("event_id", F.explode("candidates").alias("c")).crossJoin(own.select("vertices"))
    rows = found.select("c.way", geo.local_heading(F.col("vertices"), F.col("c.fraction")).alias("want"), "c.fraction").collect()
    assert len(rows) > 4 and min(r.fraction for r in rows) == 0.0
    assert all(abs(r.way - r.want) < 1e-6 for r in rows)


def test_near_stop_wants_an_itinerary_and_a_place(spark):
    rows = spark.createDataFrame([(1, 1, 0.5, "A", 10.0), (2, None, 0.5, "A", 10.0), (3, 1, None, "A", 10.0), (4, 1, 0.5, None, 10.0)], "event_id long, itinerary_id long, fraction double, stop string, stop_m double")
    assert [r.event_id for r in gps.near_stop(rows).collect()] == [1]


def test_double_keys_tell_all_doubles_apart(spark):
    values = [0.1, 0.1 + 2**-56, 0.30000000000000004, 0.3, 1e300, -1.5, 0.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(text.double_key(F.col("x"))).collect()]
    assert len(set(got)) == len(set(values)) and [float(g) for g in got] == values


def test_stable_ids_keep_parts_apart(spark):
    ids = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "abc"), ("", "abc")], "x string, y string").select(imports.stable_id(F.col("x"), F.col("y")).alias("i")).collect()
    assert len({r.i for r in ids[:3]}) == 3 and ids[2].i == ids[3].i


def test_only_the_newest_ping_of_a_poll_goes_on(spark, monkeypatch):
    """Of a task that holds too many vehicles older pings may stay, the newest always does."""
    rows = [(v, 100 * v + k, at(k // 2 if v % 2 else -k), "x") for v in range(50) for k in range(20)] + [(None, 9, at(0), "x")]
    df = spark.createDataFrame(rows, "vehicle_id long, event_id long, ts timestamp, kept string").repartition(7)
    newest = {100 * v + (19 if v % 2 else 0) for v in range(50)}
    assert sorted(r.event_id for r in live.newest_of_poll(df).collect()) == sorted(newest)
    monkeypatch.setattr(live, "AT_ONCE", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    got = [r.event_id for r in live.newest_of_poll(df).collect()]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert newest <= set(got) and len(set(got)) == len(got) < len(rows) - 1


def test_a_polls_files_are_one_micro_batch(spark):
    """As many as there are cores, and no cycle has rows of two polls."""
    rows, _ = run(spark, live_plans.feed(spark, "/root/testdata/sf0.01").select("event_id", "polled_at", F.input_file_name().alias("file")), "cycles")
    cycles = rows.groupBy("cycle").agg(F.count_distinct("polled_at").alias("polls"), F.count_distinct("file").alias("files")).collect()
    assert len(cycles) == 9 and all(r.polls == 1 and r.files == spark.sparkContext.defaultParallelism for r in cycles)


def test_stops_of_a_name_at_one_fraction_are_one_entry(spark):
    links = spark.range(3000).select(F.lit(1).cast("long").alias("itinerary_id"), "id", (F.col("id") % 3 / 4).alias("fraction")).select("itinerary_id", F.col("id").alias("stop_id"), F.lit("A").alias("name"), "fraction")
    assert sorted((r.fraction, r.stop_id) for r in gps.first_named(links).collect()) == [(0.0, 0), (0.25, 1), (0.5, 2)]
    rows = spark.createDataFrame([(1, "A", f) for f in (0.0, 0.2, 0.5, 0.6)], "itinerary_id long, stop string, fraction double")
    assert sorted((r.fraction, r.stop_id) for r in gps.stop_by_name(rows, links).collect()) == [(0.0, 0), (0.2, 1), (0.5, 2)]


def test_a_silent_vehicle_is_told_once_and_may_come_back(spark):
    """No signal and gone in cycles of their own; of a vehicle that is back in between no old timer tells."""
    ping = lambda v, e, t: (v, e, at(t), at(t), "L1", 0.0, 0.0, 30.0)
    raw, _ = fed(spark, [[ping(1, 1, 0), ping(2, 2, 0), ping(3, 3, 0.123456)], [ping(1, 4, 60)], [ping(1, 6, 75)], [ping(3, 5, 100), ping(1, 7, 160)], [ping(1, 8, 220)], [ping(1, 9, 221)]], PINGS)
    bare = raw.withColumn("enriched", F.lit(False)).withColumn("candidates", F.lit(None).cast(live.CANDIDATE))
    rows, _ = run(spark, live.vehicle_states(bare, 40, 180, 300, late="10 seconds"), "silent")
    got = sorted((r.event_id, r.status, r.cycle) for r in rows.filter("status <> 'active'").collect())
    assert got == [(2, "gone", 5), (2, "no_signal", 2), (3, "no_signal", 2), (5, "no_signal", 4)]
    assert {r.event_id: r.ts for r in rows.filter("status = 'active'").select("event_id", F.col("ts").cast("string").alias("ts")).collect()}[3] == "2024-01-01 00:00:00.123456"


def test_columns_that_passages_hand_on_stay_as_they_are(spark):
    own = (1, 2, 3, at(0.000001), 0.1 + 2**-56, 1e300, 'a "b" \\ ü\n', -0.5, 7, float("inf"), [1.5, None], at(1.000003))
    schema = "vehicle_id long, itinerary_id long, event_id long, seen_at timestamp, fraction double, length_m double, stop string, stop_m double, stop_id long, d double, many array<double>, t timestamp"
    raw, _ = fed(spark, [[own]], schema)
    rows, _ = run(spark, live.with_passages(raw.withColumn("ts", F.col("seen_at")).withWatermark("seen_at", "300 seconds")), "kept")
    names = [c.split()[0] for c in schema.split(", ")]
    want = spark.createDataFrame([own], schema).collect()[0]
    got = rows.collect()[0]
    assert tuple(got[c] for c in names) == tuple(want) and got.ts == got.seen_at and got.passage
