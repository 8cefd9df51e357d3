"""The arrival model's held-out error, overlapping polls, the board, what a reader of vehicles sees."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from tramline.operators import arrival_model, gps, network
from tramline.plans.stream_plans import folder_for
from tramline.sources import polled
from tramline.streaming import gps_stream

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(seconds: float) -> datetime.datetime:
    return T0 + datetime.timedelta(seconds=seconds)


def test_the_model_beats_the_speed_only_estimate_on_held_out_rows(spark):
    r = random.Random(1)
    rows = []
    for k in range(3000):
        line, hour = r.randrange(6), r.randrange(24)
        metres, speed = r.uniform(20, 3000), r.uniform(0, 60)
        true = metres / ((20 + 2 * line) / 3.6) * (1.4 if 7 <= hour <= 9 else 1.0) + r.gauss(20, 5)
        rows.append((k, f" l{line}", at(86400 * (k % 28) + 3600 * hour), metres, speed, r.uniform(0.01, 0.99), max(1.0, true)))
    df = spark.createDataFrame(rows, "k long, line_code string, ts timestamp, next_m double, mean_speed double, fraction double, secs double")
    path = folder_for(spark, "model")
    arrival_model.fit(df.filter("k % 4 > 0"), path)
    held = arrival_model.score(df.filter("k % 4 = 0"), arrival_model.load(path)).filter("eta_s IS NOT NULL")
    own, plain = held.agg(F.avg(F.abs(F.col("eta_s") - F.col("secs"))), F.avg(F.abs(F.col("next_m") / (F.greatest(F.col("mean_speed"), F.lit(3.0)) / 3.6) - F.col("secs")))).first()
    assert own < 0.5 * plain
    odd = [(1, "L1", at(0), 5.0, 10.0, 0.5), (2, None, at(0), 50.0, 10.0, 0.5), (3, "L1", at(0), 50.0, None, 0.5), (4, "L1", None, 50.0, 10.0, 1.0), (5, "zz", at(0), 50.0, 10.0, 0.5), (6, "L2", at(0), 50.0, 10.0, 0.5)]
    got = arrival_model.score(spark.createDataFrame(odd, "k long, line_code string, ts timestamp, next_m double, mean_speed double, fraction double"), arrival_model.load(path)).collect()
    assert {r.k: (r.eta_s is not None, r.known_line, r.next_m) for r in got} == {1: (False, None, 5.0), 2: (False, None, 50.0), 3: (False, None, 50.0), 4: (False, None, 50.0), 5: (True, False, 50.0), 6: (True, True, 50.0)}


def test_polls_overlap_and_the_stream_drops_repeats(spark):
    folder = folder_for(spark, "slots")
    sent = spark.createDataFrame([(at(t), f'{{"v": {t}}}') for t in (0, 5, 10, 19.5, 20, 31, 39, 40, 55)], "sent_at timestamp, payload string")
    polled.write_slots(sent, folder, T0.timestamp(), 10)
    reader = lambda until: polled.read_polls(spark, folder, T0.timestamp(), 10, 25, T0.timestamp() + until)
    out = folder_for(spark, "polls")
    for until in (20, 40, 60):
        gps_stream.run_once(reader(until), f"{out}/raw", f"{out}/raw-state")
        gps_stream.run_once(gps_stream.deduplicated(reader(until).select(F.lit(1).alias("vehicle_id"), F.col("sent_at").alias("ts")), "60 seconds"), f"{out}/once", f"{out}/once-state")
    seen = sorted((r.sent_at.timestamp() - spark.createDataFrame([(T0,)], "t timestamp").first().t.timestamp()) for r in spark.read.parquet(f"{out}/raw").collect())
    want = sorted(t for poll in range(10, 61, 10) for t in (0, 5, 10, 19.5, 20, 31, 39, 40, 55) if poll - 25 < t <= poll)
    assert seen == want and len(want) > 9
    assert spark.read.parquet(f"{out}/once").count() == 9


def test_current_tells_active_silent_and_nothing(spark):
    rows = [(1, 1, at(0)), (1, 2, at(90)), (2, 3, at(50)), (3, 4, at(10)), (4, 5, at(200))]
    df = spark.createDataFrame(rows, "vehicle_id long, event_id long, ts timestamp").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.vehicle_id: (r.event_id, r.status) for r in gps.current(df, "2024-01-01 00:01:40", 40, 90).collect()}
    assert got == {1: (2, "active"), 2: (3, "no_signal")}


def test_board_takes_one_itinerary_a_line_and_tells_clock_times(spark):
    live = [(1, 10, 0.2, 36.0, None, 5), (2, 10, 0.6, 36.0, None, 5), (3, 11, 0.1, 36.0, None, 5), (4, 10, 0.4, 50.0, 0.0, 5), (5, 20, 0.0, 1.0, 72.0, 6)]
    df = spark.createDataFrame([(*r, datetime.datetime(2024, 1, 1, 12, 0, 0)) for r in live], "vehicle_id long, itinerary_id long, fraction double, speed double, mean_speed double, line_id long, ts timestamp_ntz")
    links = spark.createDataFrame([(10, 5, 9, 0.5, 3.0), (11, 5, 9, 0.3, 4.0), (20, 6, 9, 0.5, 1.0)], "itinerary_id long, line_id long, stop_id long, fraction double, distance_m double")
    lengths = spark.createDataFrame([(10, 12000.0), (11, 1.0), (20, 100.0)], "itinerary_id long, length_m double")
    got = [(r.vehicle_id, None if r.eta_s is None else round(r.eta_s, 6), r.due_local) for r in gps.board(df, links, 9, lengths, "2024-01-01 12:05:00").collect()]
    assert got == [(5, 2.5, "09:05"), (1, 360.0, "09:06"), (4, None, None)]


def test_observed_counters(spark):
    rows = [(1, 1.0, 1.0, datetime.datetime(2024, 1, 1, 0, 0, 0)), (2, None, 1.0, datetime.datetime(2024, 1, 1, 0, 4, 0)), (3, 1.0, 1.0, datetime.datetime(2024, 1, 1, 0, 4, 30)), (4, 1.0, 1.0, datetime.datetime(2024, 1, 1, 0, 5, 30))]
    df = spark.createDataFrame(rows, "vehicle_id long, lat double, lon double, ts timestamp_ntz")
    seen, o = network.observed(df, "2024-01-01 00:05:31", most_s=300, stale_s=60)
    assert seen.count() == 4 or seen.collect()
    assert o.get == {"seen": 4, "valid": 3, "age_dropped": 1, "stale": 1}
