"""Trains: timetable text, leg times, timelines and positions.  Modes stand in for branches, lines for stations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.operators import network, trains
from tramline.plans.registry import query
from tramline.sources.tables import prelude, view

#: A stop of 20 s, legs by timetable where they last 20 to 3600 s, else 2.3 km at 45 km/h.
_LEGS = """legs AS (SELECT branch, ord, to_ord, CASE WHEN t BETWEEN 20 AND 3600 THEN t ELSE abs(to_km - km) / 45e0 * 3600 END AS secs, to_km, km FROM
  (SELECT *, (to_s - first_s + 86400) % 86400 - 20e0 AS t FROM (SELECT *, lead(ord) OVER w AS to_ord, lead(km) OVER w AS to_km, lead(first_s) OVER w AS to_s FROM station WINDOW w AS (PARTITION BY branch ORDER BY ord)) AS a) AS b WHERE to_ord IS NOT NULL),
timed AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY branch ORDER BY ord) = 1 THEN 60e0 ELSE 20e0 END AS dwell FROM legs),
run AS (SELECT *, sum(dwell + secs) OVER (PARTITION BY branch ORDER BY ord) - dwell - secs AS begins FROM timed)"""


def _timeline(spark: SparkSession, sf: str) -> DataFrame:
    stations = view(spark, sf, "station")
    return trains.timeline(trains.leg_times(stations), stations)


@query(prelude("station") + f", {_LEGS} SELECT branch, ord, to_ord, round(secs, 6) AS secs FROM legs")
def train_legs(spark: SparkSession, sf: str) -> DataFrame:
    return trains.leg_times(view(spark, sf, "station")).withColumn("secs", F.round("secs", 6))


@query(prelude("station") + f", {_LEGS} SELECT branch, ord, round(begins, 6) AS begins, round(begins + dwell, 6) AS leaves, round(begins + dwell + secs, 6) AS arrives FROM run")
def train_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return _timeline(spark, sf).select("branch", "ord", *(F.round(c, 6).alias(c) for c in ("begins", "leaves", "arrives")))


@query(
    prelude("station") + f""", {_LEGS}, trip AS (SELECT CAST(train AS BIGINT) AS train, 28800 - 14400 - train * 360e0 AS rode FROM range(1, 41) AS r(train)),
here AS (SELECT r.branch, train, r.ord, rode, begins + dwell AS leaves, secs, r.km, r.to_km, a.lat AS alat, a.lon AS alon, b.lat AS blat, b.lon AS blon FROM run r JOIN trip ON rode >= begins AND rode < begins + dwell + secs
  JOIN station a ON a.branch = r.branch AND a.ord = r.ord JOIN station b ON b.branch = r.branch AND b.ord = r.to_ord)
SELECT branch, train, branch || '-' || lpad(CAST(train AS VARCHAR), 3, '0') AS vehicle_id, ord, round(alat + greatest(0e0, (rode - leaves) / secs) * (blat - alat), 9) AS lat,
  round(alon + greatest(0e0, (rode - leaves) / secs) * (blon - alon), 9) AS lon, round(CASE WHEN rode < leaves THEN 0 ELSE greatest(8e0, least(110e0, abs(to_km - km) / secs * 3600)) END, 6) AS speed FROM here"""
)
def train_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Where trains are at eight in the morning, a peak hour."""
    eight = 8 * 3600
    every = trains.headway(eight, 6, 12, ((6 * 3600, 9 * 3600), (16 * 3600, 20 * 3600)))
    p = trains.positions(_timeline(spark, sf), eight, every)
    return p.select("branch", "train", "vehicle_id", "ord", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), F.round("speed", 6).alias("speed"))


_WAYS = """ways AS (SELECT branch || '>' AS branch, ord, km, CAST(first_s AS DOUBLE) AS first_s, lat, lon FROM station UNION ALL
  SELECT branch || '<', max(ord) OVER (PARTITION BY branch) + 1 - ord, km, CASE WHEN ord % 3 > 0 THEN CAST(20000 - ord * 130 AS DOUBLE) END, lat, lon FROM station)"""


@query(
    prelude("station") + f""", {_WAYS}, {_LEGS.replace("FROM station", "FROM ways")}, trip AS (SELECT CAST(train AS BIGINT) AS train, 28800 - 14400 - train * 360e0 AS rode FROM range(1, 41) AS r(train)),
here AS (SELECT r.branch, train, r.ord, rode, begins + dwell AS leaves, secs, r.km, r.to_km, a.lat AS alat, b.lat AS blat FROM run r JOIN trip ON rode >= begins AND rode < begins + dwell + secs
  JOIN ways a ON a.branch = r.branch AND a.ord = r.ord JOIN ways b ON b.branch = r.branch AND b.ord = r.to_ord)
SELECT branch, train, ord, round(alat + greatest(0e0, (rode - leaves) / secs) * (blat - alat), 9) AS lat, round(CASE WHEN rode < leaves THEN 0 ELSE greatest(8e0, least(110e0, abs(to_km - km) / secs * 3600)) END, 6) AS speed FROM here"""
)
def train_positions_both_ways(spark: SparkSession, sf: str) -> DataFrame:
    """Trains out and back at eight in the morning; the way back has a timetable of its own."""
    s = view(spark, sf, "station").withColumn("first_s", F.col("first_s").cast("double"))
    both = network.stations_both_ways(s.withColumn("back_s", F.when(F.col("ord") % 3 > 0, 20000 - F.col("ord") * 130).cast("double")), "back_s").drop("back_s")
    eight = 8 * 3600
    p = trains.positions(trains.timeline(trains.leg_times(both), both), eight, trains.headway(eight, 6, 12, ((6 * 3600, 9 * 3600), (16 * 3600, 20 * 3600))))
    return p.select("branch", "train", "ord", F.round("lat", 9).alias("lat"), F.round("speed", 6).alias("speed"))


@query(prelude("line") + "SELECT 'Estação ' || line_id AS station, 'Centro' AS direction, CAST((4 + line_id % 22) % 24 * 3600 + line_id * 60 AS INTEGER) AS secs FROM line")
def train_timetable(spark: SparkSession, sf: str) -> DataFrame:
    """Text lines: a header, its first train, and a repeat that does not count."""
    k = F.col("line_id")
    head = F.concat(F.lit("Estação "), k, F.lit(" - Sentido Centro"))
    hour = lambda h: F.concat(F.lit("Primeiro Trem: "), h.cast("string"), F.lit("h"), F.lpad(k.cast("string"), 2, "0"), F.lit(" (dias úteis 1h00)"))
    rows = view(spark, sf, "line").select("line_id", F.posexplode(F.array(head, hour(k % 22 + 4), hour(F.lit(23)))).alias("i", "value"))
    return trains.parse_timetable(rows.select("value", (k * 3 + F.col("i")).alias("n")))
