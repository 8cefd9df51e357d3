"""Queries of ``operators.network``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.operators import gps, network
from tramline.plans import vehicle_plans
from tramline.plans.registry import SQL, query
from tramline.sources.tables import prelude, view

NOW = vehicle_plans.NOW


@query(
    prelude("poi", "poi_stop", "itinerary_stop") + "SELECT poi_id, name FROM poi p WHERE EXISTS (SELECT 1 FROM poi_stop r WHERE r.poi_id = p.poi_id"
    " AND EXISTS (SELECT 1 FROM itinerary_stop i WHERE i.stop_id = r.stop_id AND i.line_id = 3))"
)
def pois_on_line(spark: SparkSession, sf: str) -> DataFrame:
    on = view(spark, sf, "itinerary_stop").filter("line_id = 3")
    return network.with_linked(view(spark, sf, "poi"), view(spark, sf, "poi_stop"), on, "poi_id", "stop_id").select("poi_id", "name")


@query(prelude("passage") + ", g AS (SELECT line_id, count(*) AS n FROM passage GROUP BY line_id) SELECT line_id, n, CAST(sum(n) OVER () AS BIGINT) AS total, count(*) OVER () AS n_groups FROM g")
def passage_totals(spark: SparkSession, sf: str) -> DataFrame:
    return network.with_total(view(spark, sf, "passage").groupBy("line_id").agg(F.count("*").alias("n")), "n")


_FEED = "vehicle_id, line_code, lat, lon, speed, ts"


@query(f"SELECT {_FEED} FROM ({SQL['bus_pings']}) AS a UNION ALL SELECT {_FEED} FROM ({SQL['brt_pings']}) AS b")
def all_pings(spark: SparkSession, sf: str) -> DataFrame:
    """Both feeds' pings together."""
    both = network.union_pings(vehicle_plans.bus_pings(spark, sf), vehicle_plans.brt_pings(spark, sf))
    return both.select("vehicle_id", "line_code", "lat", "lon", "speed", "ts")


_HELD = "TIMESTAMP '2024-01-30 12:00:00'"


@query(
    prelude("ping") + f""", before_ AS (SELECT * FROM (SELECT vehicle_id, ts, 'l' || (event_id // 64) % 3 AS line_code, row_number() OVER (PARTITION BY vehicle_id ORDER BY ts DESC, event_id DESC) AS k FROM ping WHERE ts < {_HELD}) AS x WHERE k = 1),
cycle AS (SELECT * FROM (SELECT vehicle_id, 'L' || (event_id // 64) % 3 AS line_code, row_number() OVER (PARTITION BY vehicle_id ORDER BY ts DESC, event_id DESC) AS k FROM ping WHERE ts >= {_HELD}) AS x WHERE k = 1),
members AS (SELECT vehicle_id, line_code FROM cycle UNION SELECT b.vehicle_id, upper(b.line_code) FROM before_ b LEFT JOIN cycle c ON c.vehicle_id = b.vehicle_id
  WHERE b.ts >= {_HELD} - INTERVAL 2 DAYS AND (c.line_code IS NULL OR c.line_code = upper(b.line_code)))
SELECT line_code, CAST(vehicle_id AS VARCHAR) AS vehicle_id FROM members"""
)
def line_index_members(spark: SparkSession, sf: str) -> DataFrame:
    """The line index after a cycle, written as joined sets and taken apart again."""
    p = view(spark, sf, "ping").withColumn("line_code", F.concat(F.lit("l"), F.expr("(event_id div 64) % 3").cast("string"))).select("vehicle_id", "event_id", "ts", "line_code")
    last = gps.latest(p.filter("ts < TIMESTAMP_NTZ '2024-01-30 12:00:00'"))
    cycle = gps.latest(p.filter("ts >= TIMESTAMP_NTZ '2024-01-30 12:00:00'"))
    return network.index_members(network.line_index(cycle, last, last.filter("ts >= TIMESTAMP_NTZ '2024-01-28 12:00:00'")))


@query(
    "WITH s AS (SELECT n_regionkey AS branch, n_name AS station, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey % 9 END AS weight FROM nation)"
    " SELECT branch, first(station ORDER BY coalesce(weight, 999), station) AS origin, first(station ORDER BY coalesce(weight, 999) DESC, station DESC) AS destination FROM s GROUP BY branch"
)
def branch_terminals(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.read.parquet(f"{sf}/nation.parquet")
    weight = F.when(F.col("n_nationkey") % 4 != 0, (F.col("n_nationkey") % 9).cast("int"))
    return network.terminals(n.select(F.col("n_regionkey").alias("branch"), F.col("n_name").alias("station"), weight.alias("weight")))


_TURNED = """t AS (SELECT branch, max(ord) OVER (PARTITION BY branch) + 1 - ord AS ord, km, CASE WHEN ord % 3 > 0 THEN 20000 - ord * 130 END AS first_s FROM station),
legs AS (SELECT 0 AS way, branch, ord, km, CAST(first_s AS DOUBLE) AS first_s FROM station UNION ALL SELECT 1, branch, ord, km, CAST(first_s AS DOUBLE) FROM t),
nexts AS (SELECT *, lead(ord) OVER w AS to_ord, lead(km) OVER w AS to_km, lead(first_s) OVER w AS to_s FROM legs WINDOW w AS (PARTITION BY way, branch ORDER BY ord)),
timed AS (SELECT *, (to_s - first_s + 86400) % 86400 - 20 AS table_s FROM nexts WHERE to_ord IS NOT NULL)"""


@query(prelude("station") + f", {_TURNED} SELECT way, branch, ord, to_ord, round(CASE WHEN table_s BETWEEN 20 AND 3600 THEN table_s ELSE abs(to_km - km) / 45e0 * 3600 END, 6) AS secs FROM timed")
def train_legs_both_ways(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "station")
    s = s.withColumn("first_s", F.col("first_s").cast("double")).withColumn("back_s", F.when(F.col("ord") % 3 > 0, 20000 - F.col("ord") * 130).cast("double"))
    return network.legs_both_ways(s, "back_s").select("way", "branch", "ord", "to_ord", F.round("secs", 6).alias("secs"))


@query(
    prelude("ping") + f", a AS (SELECT CASE WHEN event_id % 9 > 0 THEN lat END AS lat, trunc((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 1000000.0) AS age FROM ping)"
    " SELECT count(*) AS seen, count(lat) AS valid, count(*) FILTER (lat IS NOT NULL AND age > 259200) AS age_dropped, count(*) FILTER (lat IS NOT NULL AND age <= 259200 AND age > 86400) AS stale FROM a"
)
def cycle_counters(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "ping").withColumn("lat", F.when(F.col("event_id") % 9 > 0, F.col("lat")))
    return p.agg(*network.cycle_counters(p, NOW, 259200, 86400))
