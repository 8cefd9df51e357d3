"""Many points at one place: distances once for each pair of places, nothing spread is sent whole, all pairs are there."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.operators import spatial

LINE = [(7, 1, [(-43.60 + 0.0025 * i, -23.0) for i in range(5)])]


def stops(spark, copies):
    rows = [(n * 5 + k, f"s{k}", -23.0003, -43.60 + 0.0025 * k) for n in range(copies) for k in range(5)]
    return spark.createDataFrame(rows, "stop_id long, name string, lat double, lon double")


def lines(spark):
    return spark.createDataFrame(LINE, "itinerary_id long, line_id long, vertices array<struct<lon:double,lat:double>>")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_a_spread_side_is_never_sent_whole(spark):
    left, right = stops(spark, 2), stops(spark, 400).withColumnRenamed("stop_id", "other").drop("name")
    text = plan(spatial.within(left, right, 100.0))
    for i, row in enumerate(text):
        if "BroadcastExchange" in row:
            deep = len(row) - len(row.lstrip(" :+-"))
            below = [r for r in text[i + 1 :]]
            own = below[: next((j for j, r in enumerate(below) if len(r) - len(r.lstrip(" :+-")) <= deep), len(below))]
            assert not own[:4] or not any("explode(" in r for r in own[:4])


def test_points_at_one_place_keep_all_their_pairs(spark):
    left, right = stops(spark, 3).drop("name"), stops(spark, 4).withColumnRenamed("stop_id", "other").drop("name")
    found = spatial.within(left, right, 100.0)
    assert found.count() == 5 * 3 * 4
    assert found.select("stop_id", "other").distinct().count() == 5 * 3 * 4
    assert spatial.near_places(spatial.places(left), spatial.places(right), 100.0).count() == 5


def test_pairs_become_rows_only_after_the_last_shuffle(spark, monkeypatch):
    """What is shuffled and joined are lists of a place's points, however many pairs they make; lists have an end."""
    left, right = stops(spark, 30), stops(spark, 40).withColumnsRenamed({"stop_id": "other", "name": "title"}).withColumn("lat", F.col("lat") + 1e-4)
    monkeypatch.setattr(spatial, "TOGETHER", 7)
    found = spatial.within(left, right, 100.0, digits=3)
    text = plan(found)  # before it has run
    rows = found.collect()
    assert sorted((r.stop_id, r.name, r.other, r.title) for r in rows) == sorted((a * 5 + k, f"s{k}", b * 5 + k, f"s{k}") for a in range(30) for b in range(40) for k in range(5))
    assert {r.metres for r in rows} == {11.074} and {round(r.r_lat - r.lat, 9) for r in rows} == {1e-4}
    last = max(i for i, row in enumerate(text) if "explode(__" in row)
    assert not any("Exchange" in row or "Join" in row for row in text[:last])
    assert spatial._lists(left, ["lat", "lon"], "l").select(F.max(F.size("l"))).first()[0] == 7


def test_candidates_and_winners_with_copies(spark):
    found = spatial.stop_candidates(lines(spark), stops(spark, 3), 100.0)
    assert sorted((r.stop_id, r.vertex) for r in found.collect()) == sorted((n * 5 + k, k + 1) for n in range(3) for k in range(5))
    firsts = spatial.vertex_winners(spatial.stop_candidates(lines(spark), spatial.first_stops(stops(spark, 3)), 100.0))
    assert sorted(map(tuple, firsts.collect())) == sorted(map(tuple, spatial.vertex_winners(found).collect()))


def test_nearest_stop_of_copies_is_the_first_in_order(spark):
    links = spark.createDataFrame([(7, s, 9 - s) for s in range(10)], "itinerary_id long, stop_id long, seq long")
    pois = spark.createDataFrame([(i, -23.0003, -43.60) for i in range(4)], "poi_id long, lat double, lon double")
    got = spatial.poi_nearest_stop(pois, links, stops(spark, 2)).collect()
    assert sorted((r.poi_id, r.stop_id) for r in got) == [(i, 5) for i in range(4)]


def test_an_itinerary_has_an_entry_a_fraction_however_many_stops(spark):
    links = spark.createDataFrame([(7, n * 5 + k, k / 4, f"s{n}") for n in range(50) for k in range(5)], "itinerary_id long, stop_id long, fraction double, name string")
    lists = spatial.stops_in_order(links, "name").first().stops
    assert [(s.fraction, s.stop_id, s.name) for s in lists] == [(k / 4, k, "s0") for k in range(5)]
    at = spark.createDataFrame([(1, 7, 0.3), (2, 7, 1.0), (3, 8, 0.0)], "event_id long, itinerary_id long, fraction double")
    assert {r.event_id: r.next_stop for r in spatial.next_stop(at, links).collect()} == {1: 2, 2: None, 3: None}


def test_fractions_of_places(spark):
    rows = stops(spark, 3).withColumn("itinerary_id", F.lit(7))
    at = spatial.place_fractions(rows, lines(spark))
    assert sorted(round(r.fraction, 6) for r in at.collect()) == [0.0, 0.25, 0.5, 0.75, 1.0]
