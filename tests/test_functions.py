"""Known values of the geospatial and text functions, and rows at the edges."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tramline.functions import geo, text
from tramline.operators import catalog, gps, ingest, trains


def _line():
    return F.array(*(F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0))))


def _value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def _lit(*xs):
    return [F.lit(float(x)) for x in xs]


def test_distances_and_bearings(spark):
    assert _value(spark, geo.haversine(*_lit(0, 0, 0, 1))) == pytest.approx(111194.92664455874)
    assert _value(spark, geo.haversine(*_lit(-22.9035, -43.1732, -22.9123, -43.1842))) == pytest.approx(1492.27786624843)
    assert _value(spark, geo.bearing(*_lit(-22.9035, -43.1732, -22.9123, -43.1842))) == pytest.approx(229.02364787473437)
    assert [round(_value(spark, geo.bearing(*_lit(0, 0, a, b))), 9) for a, b in ((1, 0), (0, 1), (-1, 0), (0, -1))] == [0, 90, 180, 270]
    assert _value(spark, geo.bearing(*_lit(1, 1, 1, 1))) is None
    assert [_value(spark, geo.heading_difference(*_lit(a, b))) for a, b in ((350, 10), (10, 350), (180, 0))] == [20, 20, 180]


def test_linear_referencing(spark):
    assert _value(spark, geo.locate(_line(), *_lit(1.2, 0.5))) == pytest.approx(0.75)
    assert _value(spark, geo.locate(_line(), *_lit(0.5, 0.3))) == pytest.approx(0.25)
    p = _value(spark, geo.interpolate(_line(), F.lit(0.75)))
    assert (p.lon, p.lat) == pytest.approx((1, 0.5))
    p = _value(spark, geo.nearest(_line(), *_lit(0.5, 0.3)))
    assert (p.lon, p.lat, p.distance) == pytest.approx((0.5, 0, 0.3))
    assert _value(spark, geo.perpendicular(*_lit(1, 1, 1, 1, 2, 2))) == 0


def test_lag_compensation(spark):
    rows = [(0.5, 36, 30, 0.53), (0.5, 36, 5, 0.5), (0.5, 36, 120, 0.5), (0.5, 1.9, 30, 0.5), (0.98, 36, 30, 0.98)]
    for f, v, lag, want in rows:
        assert _value(spark, geo.compensated(*_lit(f, v, lag, 10000))) == pytest.approx(want)


def test_smoothed_speed(spark):
    rows = spark.createDataFrame([(1, i, i, float(s)) for i, s in enumerate((30, 40, 200, 50, 60))], "vehicle_id long, event_id long, ts long, speed double")
    assert [r.mean_speed for r in gps.smooth_speed(rows).orderBy("ts").collect()] == [30, 35, 35, 40, 50]
    assert gps.smooth_speed(rows.limit(0)).collect() == []


def test_parsing(spark):
    assert [_value(spark, text.decimal_comma(F.lit(x))) for x in ("-22,9035", "abc", None)] == [-22.9035, None, None]
    assert [_value(spark, text.number_or_zero(F.lit(x))) for x in ("", "12.5", None)] == [0, 12.5, 0]
    assert _value(spark, text.plain_name(F.lit(" São-João/da  Praça "))) == "sao joao da praca"
    name = text.poi_name(F.create_map(F.lit("name:pt"), F.lit(""), F.lit("name"), F.lit("x")))
    assert _value(spark, name) == ""
    got = _value(spark, text.log_entry(F.lit("2024-01-01T00:00:00Z some Failure"), F.lit("2020-01-01").cast("timestamp")))
    assert (got.level, got.message) == ("error", "some Failure")


def test_bad_payloads_give_no_rows(spark):
    raw = spark.createDataFrame([("not json",), (None,), ("[]",), ("{}",)], "json string")
    for parsed in (gps.normalise_bus(raw, "json", "2024-01-01"), gps.normalise_brt(raw, "json"), ingest.parse_routes(raw, "json"), ingest.parse_stops(raw, "json"), ingest.parse_pois(raw, "json")):
        assert parsed.collect() == []


def test_pages_and_requests(spark):
    rows = spark.range(41)
    assert {(r.total, r.pages) for r in catalog.page(rows, [F.asc("id")], 1, 20).collect()} == {(41, 3)}
    assert catalog.page(rows.limit(0), [F.asc("id")], 1, 20).collect() == []
    for bad in ((0, 10), (1, 0), (1, 101)):
        with pytest.raises(catalog.InvalidRequest):
            catalog.check_page(*bad, 100)
    with pytest.raises(catalog.InvalidRequest):
        catalog.check_point(91, 0, 100, 1000)


def test_trains_before_opening(spark):
    stations = spark.createDataFrame([("a", 1, 0.0, None, 0.0, 0.0), ("a", 2, 2.3, None, 0.0, 1.0)], "branch string, ord int, km double, first_s int, lat double, lon double")
    legs = trains.leg_times(stations)
    assert legs.first().secs == pytest.approx(184)
    line = trains.timeline(legs, stations, 25)
    assert line.first().dwell == 75
    assert trains.positions(line, 3 * 3600, 360).collect() == []
    assert trains.headway(21600, 6, 12, ((21600, 32400),)) == 360


def test_chaining_turns_parts():
    parts = [[(0, 0), (1, 0)], [(2, 0), (1, 0)], []]
    assert ingest.chain_parts(parts) == [(0, 0), (1, 0), (2, 0)]
    assert ingest.chain_parts([[(0, 0)]]) == []


def test_pairs_are_found_at_every_latitude(spark):
    from pyspark.sql import functions as F

    from tramline.operators import spatial

    for lat in (0.0, 45.0, 60.0, 80.0, -89.0):
        step = 240 / 111_320 / math.cos(math.radians(lat)) if lat > -80 else 0.1
        rows = [(k, lat, -180 + step * k / 2) for k in range(60)]
        left = spark.createDataFrame([(k, la, lo) for k, la, lo in rows], "a long, lat double, lon double")
        right = spark.createDataFrame([(k, la, lo + step if lo + step <= 180 else lo + step - 360) for k, la, lo in rows], "b long, lat double, lon double")
        got = {(r.a, r.b) for r in spatial.within(left, right, 250.0, metric=spatial.geo.haversine).collect()}
        both = left.crossJoin(right.withColumnsRenamed({"lat": "la", "lon": "lo"}))
        want = {(r.a, r.b) for r in both.filter(spatial.geo.haversine(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo")) <= 250).collect()}
        assert got == want and len(got) >= 60


def test_an_empty_page_has_an_envelope(spark):
    from tramline.operators import catalog

    rows = spark.range(7)
    assert catalog.page(rows, [rows.id.asc()], 9, 3).count() == 0
    assert catalog.envelope(rows, 3).first().asDict() == {"total": 7, "pages": 3}
    assert catalog.envelope(rows.limit(0), 3).first().asDict() == {"total": 0, "pages": 0}
