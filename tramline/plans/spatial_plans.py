"""Spatial reads and matching: distances, linear referencing, stops to routes, points of interest to stops, pings to routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions import geo
from tramline.operators import gps, spatial
from tramline.plans.registry import SEGMENTS, bearing, ellipsoid, haversine, located, query
from tramline.sources.tables import itineraries, prelude, view

REACH = 250.0
LAT, LON = -22.95, -43.575
_POINT = (f"({LAT}e0)", f"({LON}e0)")


@query(
    prelude("ping") + f"SELECT event_id, round({haversine('plat', 'plon', 'lat', 'lon')}, 6) AS moved_m, round({bearing('plat', 'plon', 'lat', 'lon')}, 6) AS bearing,"
    f" round({ellipsoid('plat', 'plon', 'lat', 'lon')}, 6) AS moved_ellipsoid_m FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM ping WINDOW w AS (PARTITION BY vehicle_id ORDER BY ts, event_id)) AS p"
)
def ping_moves(spark: SparkSession, sf: str) -> DataFrame:
    p = gps.with_previous(view(spark, sf, "ping"))
    at = [F.col(c) for c in ("prev_lat", "prev_lon", "lat", "lon")]
    return p.select("event_id", F.round(geo.haversine(*at), 6).alias("moved_m"), F.round(geo.bearing(*at), 6).alias("bearing"), F.round(geo.ellipsoid(*at), 6).alias("moved_ellipsoid_m"))


HEADED = f"""headed0 AS (SELECT *, CASE WHEN {haversine('plat', 'plon', 'lat', 'lon')} >= 10 THEN {bearing('plat', 'plon', 'lat', 'lon')} END AS raw
  FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM ping WINDOW w AS (PARTITION BY vehicle_id ORDER BY ts, event_id)) AS p0),
headed AS (SELECT *, last_value(raw IGNORE NULLS) OVER (PARTITION BY vehicle_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM headed0)"""


@query(prelude("ping") + f", {HEADED} SELECT event_id, round(heading, 6) AS heading FROM headed")
def ping_headings(spark: SparkSession, sf: str) -> DataFrame:
    return gps.with_heading(view(spark, sf, "ping")).select("event_id", F.round("heading", 6).alias("heading"))


@query(prelude("vertex") + f", {SEGMENTS} SELECT itinerary_id, round(sum(n), 9) AS planar, round(sum({ellipsoid('ay', 'ax', 'by_', 'bx')}), 6) AS metres FROM seg GROUP BY itinerary_id")
def itinerary_lengths(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("vertices")
    return itineraries(spark, sf).select("itinerary_id", F.round(geo.planar_length(v), 9).alias("planar"), F.round(geo.length_metres(v), 6).alias("metres"))


@query(
    prelude("vertex", "itinerary_stop", "stop") + f", {SEGMENTS}, pt AS (SELECT i.stop_id, i.itinerary_id AS it, s.lon, s.lat FROM itinerary_stop i JOIN stop s ON s.stop_id = i.stop_id), "
    + located("pt", "stop_id", "seg.itinerary_id = p.it") + " SELECT stop_id, s.itinerary_id, round(fraction, 6) AS fraction, round(gap, 6) AS metres FROM spots s JOIN (SELECT stop_id, itinerary_id, min(gap) AS gap FROM placed GROUP BY ALL) g USING (stop_id, itinerary_id)"
)
def stop_fractions(spark: SparkSession, sf: str) -> DataFrame:
    """Linear referencing of every stop on its itineraries, and its distance from them."""
    rows = view(spark, sf, "itinerary_stop").select("stop_id", "itinerary_id").join(view(spark, sf, "stop").select("stop_id", "lon", "lat").hint("merge"), "stop_id")
    at = spatial.place_fractions(rows, itineraries(spark, sf))
    return rows.join(at, ["itinerary_id", "lat", "lon"]).select("stop_id", "itinerary_id", F.round("fraction", 6).alias("fraction"), F.round("metres", 6).alias("metres"))


@query(
    prelude("vertex") + f", {SEGMENTS}, goal AS (SELECT itinerary_id, k, k / 10e0 * total AS goal FROM (SELECT DISTINCT itinerary_id, total FROM seg) AS s, range(0, 11) AS r(k))"
    " SELECT itinerary_id, CAST(k AS INTEGER) AS k, round(ax + (goal - upto) / n * (bx - ax), 6) AS lon, round(ay + (goal - upto) / n * (by_ - ay), 6) AS lat FROM"
    " (SELECT *, row_number() OVER (PARTITION BY itinerary_id, k ORDER BY idx) AS rn FROM goal JOIN seg USING (itinerary_id) WHERE upto + n >= goal - 1e-12) AS x WHERE rn = 1"
)
def itinerary_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points at every tenth of each itinerary."""
    rows = itineraries(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(10))))
    p = geo.interpolate(F.col("vertices"), F.col("k") / 10)
    return rows.withColumn("p", p).select("itinerary_id", "k", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))


@query(prelude("stop") + f"SELECT stop_id, name, round({ellipsoid(*_POINT, 'lat', 'lon')}, 6) AS metres FROM stop WHERE {ellipsoid(*_POINT, 'lat', 'lon')} <= 500 ORDER BY {ellipsoid(*_POINT, 'lat', 'lon')}, stop_id LIMIT 10")
def stops_nearby(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.nearby(view(spark, sf, "stop"), LAT, LON, 500, 10, "stop_id").select("stop_id", "name", F.round("metres", 6).alias("metres"))


@query(
    prelude("poi") + f"SELECT poi_id, round({haversine(*_POINT, 'lat', 'lon')}, 6) AS metres FROM poi WHERE abs(lat - {_POINT[0]}) <= 800 / 111000e0 AND abs(lon - {_POINT[1]}) <= 800 / 111000e0"
    f" AND {haversine(*_POINT, 'lat', 'lon')} <= 800"
)
def pois_by_point(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.pois_by_point(view(spark, sf, "poi"), LAT, LON, 800).select("poi_id", F.round("metres", 6).alias("metres"))


@query(prelude("poi", "stop") + f"SELECT poi_id, stop_id, round({ellipsoid('p.lat', 'p.lon', 's.lat', 's.lon')}, 6) AS metres FROM poi p JOIN stop s ON abs(p.lat - s.lat) < 0.01 AND {ellipsoid('p.lat', 'p.lon', 's.lat', 's.lon')} <= 150")
def poi_stop_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = spatial.within(view(spark, sf, "poi").select("poi_id", "lat", "lon"), view(spark, sf, "stop").select("stop_id", "lat", "lon"), 150, digits=6)
    return pairs.select("poi_id", "stop_id", "metres")


_D = ellipsoid("s.lat", "s.lon", "v.lat", "v.lon")
_CANDIDATES = f"""cand AS (SELECT itinerary_id, stop_id, vertex, metres FROM (SELECT v.itinerary_id, s.stop_id, v.idx + 1 AS vertex, {_D} AS metres,
  row_number() OVER (PARTITION BY v.itinerary_id, s.stop_id ORDER BY round({_D}, 6), v.idx) AS rn FROM stop s JOIN vertex v ON abs(s.lat - v.lat) < 0.01 WHERE {_D} <= 250) AS c WHERE rn = 1),
won AS (SELECT itinerary_id, stop_id, vertex, metres FROM (SELECT *, row_number() OVER (PARTITION BY itinerary_id, vertex ORDER BY round(metres, 6), stop_id) AS rn FROM cand) AS c WHERE rn = 1)"""


@query(prelude("stop", "vertex") + f", {_CANDIDATES} SELECT itinerary_id, stop_id, vertex, round(metres, 6) AS metres FROM cand")
def stop_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.stop_candidates(itineraries(spark, sf), view(spark, sf, "stop"), REACH).withColumn("metres", F.round("metres", 6))


@query(prelude("stop", "vertex") + f", {_CANDIDATES} SELECT itinerary_id, stop_id, vertex, round(metres, 6) AS metres FROM won")
def vertex_winners(spark: SparkSession, sf: str) -> DataFrame:
    found = spatial.stop_candidates(itineraries(spark, sf), spatial.first_stops(view(spark, sf, "stop")), REACH)
    return spatial.vertex_winners(found).withColumn("metres", F.round("metres", 6))


_SEQUENCE = f"""{SEGMENTS}, {_CANDIDATES}, pt AS (SELECT won.stop_id, won.itinerary_id AS it, stop.lon, stop.lat FROM won JOIN stop USING (stop_id)), {located("pt", "stop_id", "seg.itinerary_id = p.it")},
full_ AS (SELECT won.*, s.lon, s.lat, round(fraction, 9) AS fraction, a.lon AS alon, a.lat AS alat, b.lon AS blon, b.lat AS blat FROM won JOIN stop s USING (stop_id) JOIN spots USING (itinerary_id, stop_id)
  JOIN vertex a ON a.itinerary_id = won.itinerary_id AND a.idx = greatest(vertex - 2, 0) JOIN vertex b ON b.itinerary_id = won.itinerary_id AND b.idx = least(vertex, 20)),
perp_ AS (SELECT *, coalesce(abs((blon - alon) * (lat - alat) - (blat - alat) * (lon - alon)) / nullif(sqrt((blon - alon) * (blon - alon) + (blat - alat) * (blat - alat)), 0), 0) AS perp FROM full_),
scored AS (SELECT *, 0.5e0 * (1 - metres / 250) + 0.5e0 * (1 - least(perp / 15, 1)) AS score FROM perp_ WHERE (NOT (fraction < 0.03e0 OR fraction > 0.97e0) OR metres <= 250 * 0.6e0) AND perp <= 15),
sequence_ AS (SELECT itinerary_id, stop_id, fraction, metres, score, row_number() OVER (PARTITION BY itinerary_id ORDER BY fraction, stop_id) AS seq FROM scored WHERE score >= 0.4e0)"""
_SEQUENCE_COLUMNS = "itinerary_id, stop_id, round(fraction, 6) AS fraction, round(metres, 6) AS metres, round(score, 6) AS score, seq"


def _sequence(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.stop_sequence(itineraries(spark, sf), view(spark, sf, "stop"), REACH)


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select("itinerary_id", "stop_id", *(F.round(c, 6).alias(c) for c in ("fraction", "metres", "score")), "seq")


@query(prelude("stop", "vertex") + f", {_SEQUENCE} SELECT {_SEQUENCE_COLUMNS} FROM sequence_")
def stop_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """All stops matched to all itineraries in one job."""
    return _rounded(_sequence(spark, sf))


@query(prelude("stop", "vertex", "itinerary_stop") + f", {_SEQUENCE} SELECT {_SEQUENCE_COLUMNS} FROM sequence_ q WHERE NOT EXISTS (SELECT 1 FROM itinerary_stop i WHERE i.itinerary_id = q.itinerary_id AND i.stop_id = q.stop_id AND i.stop_id % 2 = 0)")
def new_stop_relations(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(spatial.new_relations(_sequence(spark, sf), view(spark, sf, "itinerary_stop").filter("stop_id % 2 = 0")))


_H = haversine("p.lat", "p.lon", "s.lat", "s.lon")
_NEAREST_STOP = f"""nearest_ AS (SELECT itinerary_id, poi_id, stop_id, metres FROM (SELECT i.itinerary_id, p.poi_id, s.stop_id, {_H} AS metres,
  row_number() OVER (PARTITION BY i.itinerary_id, p.poi_id ORDER BY round({_H}, 6), i.seq, s.stop_id) AS rn FROM poi p JOIN stop s ON abs(p.lat - s.lat) < 0.01 AND {_H} <= 150
  JOIN itinerary_stop i ON i.stop_id = s.stop_id) AS n WHERE rn = 1)"""


def _nearest(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.poi_nearest_stop(view(spark, sf, "poi"), view(spark, sf, "itinerary_stop"), view(spark, sf, "stop"))


@query(prelude("poi", "stop", "itinerary_stop") + f", {_NEAREST_STOP} SELECT itinerary_id, poi_id, stop_id, round(metres, 6) AS metres FROM nearest_")
def poi_nearest_stop(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest(spark, sf).withColumn("metres", F.round("metres", 6))


@query(
    prelude("poi", "stop", "itinerary_stop", "poi_stop") + f", {_NEAREST_STOP}, had AS (SELECT itinerary_id, poi_id, min(stop_id) AS old_stop, CAST(60 + poi_id % 7 AS DOUBLE) AS m FROM poi_stop JOIN itinerary_stop USING (stop_id) WHERE poi_id % 3 <> 0 GROUP BY itinerary_id, poi_id)"
    " SELECT itinerary_id, poi_id, stop_id, round(metres, 6) AS metres, CASE WHEN old_stop IS NULL THEN 'insert' WHEN old_stop = stop_id THEN 'skip' WHEN metres < m THEN 'replace' ELSE 'skip' END AS action, old_stop"
    " FROM nearest_ LEFT JOIN had USING (itinerary_id, poi_id)"
)
def poi_competition(spark: SparkSession, sf: str) -> DataFrame:
    """Found relations against stored ones, whose distances are made up here."""
    stored = view(spark, sf, "poi_stop").filter("poi_id % 3 <> 0").withColumn("metres", (F.col("poi_id") % 7 + 60).cast("double"))
    return spatial.compete(_nearest(spark, sf), stored, view(spark, sf, "itinerary_stop")).select("itinerary_id", "poi_id", "stop_id", F.round("metres", 6).alias("metres"), "action", "old_stop")


@query(
    prelude("stop") + """, box AS (SELECT min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east FROM stop),
size_ AS (SELECT *, greatest(CAST(ceil(round((north - south) / 0.027e0, 9)) AS INTEGER), 1) AS ny, greatest(CAST(ceil(round((east - west) / 0.027e0, 9)) AS INTEGER), 1) AS nx FROM box)
SELECT CAST(y AS INTEGER) AS iy, CAST(x AS INTEGER) AS ix, round(south + y * 0.027e0, 9) AS s, round(west + x * 0.027e0, 9) AS w, round(least(north, south + (y + 1) * 0.027e0), 9) AS n,
  round(least(east, west + (x + 1) * 0.027e0), 9) AS e FROM size_, range(0, 100) AS a(y), range(0, 100) AS b(x) WHERE y < ny AND x < nx"""
)
def import_tiles(spark: SparkSession, sf: str) -> DataFrame:
    t = spatial.tiles(spatial.bounding_box(view(spark, sf, "stop")))
    return t.select("iy", "ix", *(F.round(c, 9).alias(c) for c in ("s", "w", "n", "e")))


_ENDS = " UNION ALL ".join(f"SELECT event_id, itinerary_id, {side} AS side, greatest(0e0, least(1e0, fraction {op} 0.025e0)) AS f FROM spots" for side, op in ((0, "-"), (1, "+")))
MATCHED = f"""{SEGMENTS}, {HEADED}, {located("headed", "event_id", "seg.line_id = p.line_id")},
near_ AS (SELECT event_id, itinerary_id, min(gap) AS metres FROM placed GROUP BY ALL HAVING min(gap) <= 250),
tip AS (SELECT * FROM (SELECT e.event_id, e.itinerary_id, side, ax + (f * total - upto) / n * (bx - ax) AS lon, ay + (f * total - upto) / n * (by_ - ay) AS lat,
  row_number() OVER (PARTITION BY e.event_id, e.itinerary_id, side ORDER BY idx) AS rn FROM ({_ENDS}) e JOIN seg USING (itinerary_id) WHERE upto + n >= f * total - 1e-12) AS x WHERE rn = 1),
way AS (SELECT event_id, itinerary_id, {bearing('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS route_heading FROM tip a JOIN tip b USING (event_id, itinerary_id) WHERE a.side = 0 AND b.side = 1),
fit AS (SELECT event_id, itinerary_id, metres, fraction, route_heading, abs((route_heading - heading + 540) % 360 - 180) AS diff FROM near_ JOIN spots USING (event_id, itinerary_id)
  JOIN way USING (event_id, itinerary_id) JOIN headed USING (event_id)),
matched AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(diff, 6), round(metres, 6), itinerary_id) AS rn FROM fit WHERE diff < 80) AS x WHERE rn = 1)"""


def matched_pings(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.match_routes(gps.with_heading(view(spark, sf, "ping")), itineraries(spark, sf), "heading", REACH)


@query(prelude("ping", "vertex") + f", {MATCHED} SELECT event_id, itinerary_id, round(fraction, 6) AS fraction, round(metres, 6) AS metres, round(diff, 6) AS diff FROM matched")
def route_match(spark: SparkSession, sf: str) -> DataFrame:
    """Every ping on the itinerary of its line that fits its place and heading best."""
    return matched_pings(spark, sf).select("event_id", "itinerary_id", *(F.round(c, 6).alias(c) for c in ("fraction", "metres", "diff")))


@query(
    prelude("ping", "vertex", "itinerary_stop") + f", {MATCHED}, ahead AS (SELECT event_id, i.stop_id, i.fraction, row_number() OVER (PARTITION BY event_id ORDER BY i.fraction, i.stop_id) AS k FROM matched m"
    " JOIN (SELECT itinerary_id, fraction, min(stop_id) AS stop_id FROM itinerary_stop GROUP BY ALL) i ON i.itinerary_id = m.itinerary_id AND round(i.fraction, 6) > round(m.fraction, 6))"
    " SELECT m.event_id, m.itinerary_id, a.stop_id AS next_stop, round(a.fraction, 6) AS next_fraction FROM matched m LEFT JOIN (SELECT * FROM ahead WHERE k = 1) a ON a.event_id = m.event_id"
)
def next_stops(spark: SparkSession, sf: str) -> DataFrame:
    """The next stop on each matched ping's itinerary; fractions compare at six digits."""
    links = view(spark, sf, "itinerary_stop").select("itinerary_id", F.round("fraction", 6).alias("fraction"), "stop_id")
    m = matched_pings(spark, sf).select("event_id", "itinerary_id", F.round("fraction", 6).alias("fraction"))
    return spatial.next_stop(m, links).select("event_id", "itinerary_id", "next_stop", "next_fraction")
