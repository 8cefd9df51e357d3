"""The batch route state against a plain fold, over small Arrow batches."""

from __future__ import annotations

import random
from types import SimpleNamespace

from tramline.operators import gps

KIND = "vehicle_id long, event_id long, ts timestamp, speed double, mean_speed double, heading double, itinerary_id long, fraction double, metres double"


class Plain:
    """Confirmation told plainly: what a vehicle's entry holds, and what each kind of ping does to it."""

    def __init__(self):
        self.entry, self.cycles = None, 0

    def ping(self, speed, mean_speed, heading, itinerary, fraction, metres):
        stopped = (speed if mean_speed is None else mean_speed) < 3
        found = None if itinerary is None or heading is None else {"id": itinerary, "at": fraction, "m": metres}
        if heading is None and self.entry is not None:
            found = dict(self.entry)
        if found is not None:
            self.cycles = 0
            if self.entry is not None and found["id"] != self.entry["id"]:
                gained = self.entry["m"] - found["m"]
                if not ((not stopped and heading is not None and gained > 30) or gained > 100):
                    found = {"id": self.entry["id"], "at": found["at"], "m": found["m"]}
            self.entry = found
        elif self.entry is not None:
            self.cycles += 1
            if self.cycles >= 3:
                self.entry, self.cycles = None, 0
        return None if self.entry is None else (self.entry["id"], self.entry["at"], self.entry["m"])


def test_route_state_as_plain_and_holds_only_the_state(spark):
    import datetime

    r, start = random.Random(4), datetime.datetime(2024, 1, 1)
    rows = []
    for e in range(400):
        on = r.choice([1, 1, 2, None])
        rows.append((r.choice([None, 7, 7, 7, 8, 2**53 + 1]), e, start + datetime.timedelta(seconds=r.randrange(90)), r.random() * 9, r.choice([None, r.random() * 9]), r.choice([None, 90.0, 90.0]), on, None if on is None else r.random(), None if on is None else r.random() * 150))
    state, want = {}, []
    for row in sorted(rows, key=lambda x: (x[2], x[1])):
        got = state.setdefault(row[0], Plain()).ping(*row[3:])
        want.append((row[0], row[1], *(got or (None, None, None))))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = gps.route_state(spark.createDataFrame(rows, KIND))
        got = [tuple(x)[:5] for x in df.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()


def test_a_blocked_change_measures_from_the_new_distance():
    ping = lambda i, f, m, **k: SimpleNamespace(**({"itinerary_id": i, "fraction": f, "metres": m, "heading": 90.0, "speed": 20.0, "mean_speed": None} | k))
    state, _ = gps.route_step(gps.NO_ROUTE, ping(1, 0.1, 60.0), 30, 100, 3, 3)
    state, row = gps.route_step(state, ping(2, 0.2, 40.0), 30, 100, 3, 3)
    assert row == (1, 0.2, 40.0, "blocked")
    state, row = gps.route_step(state, ping(2, 0.3, 25.0), 30, 100, 3, 3)
    assert row[3] == "blocked"
    state, row = gps.route_step(state, ping(None, None, None), 30, 100, 3, 3)
    assert row == (1, 0.3, 25.0, "kept")
    state, row = gps.route_step(state, ping(2, 0.3, 20.0, heading=None), 30, 100, 3, 3)
    assert row == (1, 0.3, 25.0, "held")


def test_passages_pass_the_gate(spark):
    import datetime

    start = datetime.datetime(2024, 1, 1)
    rows = [(1, 2, k, start + datetime.timedelta(seconds=60 * k), k / 10, 1000.0, stop, metres) for k, (stop, metres) in enumerate([("A", 120.0), ("A", 60.0), ("B", 140.0), ("B", 200.0), ("C", 151.0), (" ", 10.0), ("A", 100.0)])]
    got = gps.passages(spark.createDataFrame(rows, "vehicle_id long, itinerary_id long, event_id long, ts timestamp_ntz, fraction double, length_m double, stop string, stop_m double")).orderBy("event_id").collect()
    assert [(r.stop, r.event_id, r.secs_since_prev, r.leg_m) for r in got] == [("A", 0, None, None), ("B", 2, 120, 200.0), ("A", 6, 240, 400.0)]


def test_streamed_route_state_as_plain_without_a_table_for_each_vehicle(spark, tmp_path):
    import datetime

    from tramline.streaming import gps_stream, live

    r, start = random.Random(9), datetime.datetime(2024, 1, 1)
    state, last, want = {}, {}, []
    for part in range(2):  # the second batch begins before the first one's end
        rows = []
        for e in range(part * 200, part * 200 + 200):
            on, at = r.choice([1, 1, 2, None]), start + datetime.timedelta(seconds=60 * part + r.randrange(90), microseconds=r.randrange(3))
            rows.append((r.choice([7, 7, 7, 8, 2**53 + 1]), e, at, r.random() * 9, r.choice([None, r.random() * 9]), r.choice([None, 90.0, 90.0]), on, None if on is None else r.random(), None if on is None else r.random() * 150))
        rows += [(None, 900, start, 5.0, None, 90.0, 1, 0.5, 1.0), (8 + part, 901 + part, None, 5.0, None, 90.0, 1, 0.5, 1.0)]
        for row in sorted(rows, key=lambda x: (x[2] is None, x[2] or start, x[1])):
            if row[0] is not None and (row[2] is None or row[2] > last.get(row[0], datetime.datetime.min)):
                want.append((row[0], row[1], *(state.setdefault(row[0], Plain()).ping(*row[3:]) or (None, None, None))))
                last[row[0]] = row[2] or last.get(row[0], datetime.datetime.min)
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live.use_state_store(spark)
    found = gps_stream.confirmed_routes(gps_stream.read_pings(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, files_per_trigger=1))
    assert "InPandas" not in found._jdf.queryExecution().toString()
    gps_stream.run_once(found, f"{tmp_path}/out", f"{tmp_path}/state")
    got = [tuple(x)[:5] for x in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
