"""Vehicle pings: normalising, smoothing, passages, status, arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions import geo
from tramline.operators import gps, stats
from tramline.plans.registry import query, route_fold
from tramline.plans.spatial_plans import MATCHED, matched_pings
from tramline.sources.tables import itineraries, prelude, view

NOW = "2024-01-30 12:00:00"


@query(
    prelude("ping") + "SELECT 'A' || vehicle_id AS vehicle_id, 'L' || line_id AS line_code, round(lat, 9) AS lat, round(lon, 9) AS lon, CASE WHEN event_id % 11 = 0 THEN 0 ELSE speed END AS speed,"
    f" CASE WHEN event_id % 13 = 0 THEN TIMESTAMP '{NOW}' ELSE date_trunc('milliseconds', ts) END AS ts FROM ping WHERE event_id % 97 <> 0"
)
def bus_pings(spark: SparkSession, sf: str) -> DataFrame:
    """Raw text pings: decimal commas, blank speeds, bad stamps, unreadable latitudes."""
    e = F.col("event_id")
    lat = F.col("lat").cast("string")
    raw = view(spark, sf, "ping").select(
        F.to_json(
            F.struct(
                F.concat(F.lit(" a"), F.col("vehicle_id")).alias("ordem"), F.concat(F.lit("l"), F.col("line_id"), F.lit(" ")).alias("linha"),
                F.when(e % 97 == 0, "abc").when(e % 3 == 0, F.replace(lat, F.lit("."), F.lit(","))).otherwise(lat).alias("latitude"), F.col("lon").cast("string").alias("longitude"),
                F.when(e % 11 == 0, "").otherwise(F.col("speed").cast("string")).alias("velocidade"), F.when(e % 13 == 0, "x").otherwise(F.unix_millis(F.col("ts").cast("timestamp")).cast("string")).alias("datahora"),
            )
        ).alias("json")
    )
    p = gps.normalise_bus(raw, "json", NOW)
    return p.select("vehicle_id", "line_code", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "speed", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(
    prelude("ping") + "SELECT 'BRT-V' || event_id AS vehicle_id, 'L' || line_id AS line_code, round(lat, 9) AS lat, round(lon, 9) AS lon, speed, date_trunc('milliseconds', ts) AS ts,"
    " CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 361 AS DOUBLE) END AS heading FROM ping WHERE event_id % 19 <> 0 AND line_id <> 0 AND event_id % 23 <> 0"
)
def brt_pings(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    one = F.struct(
        F.when(e % 19 == 0, " ").otherwise(F.concat(F.lit("v"), e)).alias("codigo"), F.when(F.col("line_id") == 0, "0").otherwise(F.concat(F.lit("l"), F.col("line_id"))).alias("linha"),
        F.when(e % 23 == 0, 0.0).otherwise(F.col("lat")).alias("latitude"), F.col("lon").alias("longitude"), F.unix_millis(F.col("ts").cast("timestamp")).alias("dataHora"), F.col("speed").alias("velocidade"),
        F.when(e % 2 == 0, (e % 361).cast("string")).otherwise(" ").alias("direcao"),
    )
    p = gps.normalise_brt(view(spark, sf, "ping").select(F.to_json(F.struct(F.array(one).alias("veiculos"))).alias("json")), "json")
    return p.select("vehicle_id", "line_code", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "speed", F.col("ts").cast("timestamp_ntz").alias("ts"), "heading")


_LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY ts DESC, event_id DESC) AS rn FROM ping) AS p WHERE rn = 1)"


@query(prelude("ping") + f", {_LATEST} SELECT vehicle_id, event_id, ts, line_id, speed FROM latest")
def latest_pings(spark: SparkSession, sf: str) -> DataFrame:
    return gps.latest(view(spark, sf, "ping").select("vehicle_id", "event_id", "ts", "line_id", "speed"))


@query(prelude("ping") + f"SELECT event_id, ts FROM ping WHERE (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 1000000.0 < 259201")
def fresh_pings(spark: SparkSession, sf: str) -> DataFrame:
    return gps.fresh(view(spark, sf, "ping"), NOW, 3 * 86400).select("event_id", "ts")


@query(
    prelude("ping") + ", good AS (SELECT event_id, avg(speed) OVER (PARTITION BY vehicle_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM ping WHERE speed <= 90)"
    " SELECT event_id, round(last_value(m IGNORE NULLS) OVER (PARTITION BY vehicle_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS mean_speed FROM ping LEFT JOIN good USING (event_id)"
)
def smooth_speeds(spark: SparkSession, sf: str) -> DataFrame:
    return gps.smooth_speed(view(spark, sf, "ping").select("vehicle_id", "event_id", "ts", "speed")).select("event_id", F.round("mean_speed", 6).alias("mean_speed"))


@query(
    prelude("ping") + ", coded AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'l' ELSE 'L' END || (event_id // 64) % 3 AS line_code FROM ping)"
    " SELECT event_id, vehicle_id, old_line, line_code FROM (SELECT *, lag(line_code) OVER (PARTITION BY vehicle_id ORDER BY ts, event_id) AS old_line FROM coded) AS x WHERE upper(old_line) <> upper(line_code)"
)
def line_switches(spark: SparkSession, sf: str) -> DataFrame:
    code = F.concat(F.when(F.col("event_id") % 2 == 0, "l").otherwise("L"), F.expr("(event_id div 64) % 3").cast("string"))
    return gps.line_switches(view(spark, sf, "ping").withColumn("line_code", code)).select("event_id", "vehicle_id", "old_line", "line_code")


_PASSAGES = """heads AS (SELECT * FROM (SELECT *, lag(stop) OVER (PARTITION BY vehicle_id, itinerary_id ORDER BY ts, event_id) AS old FROM r) AS x WHERE old IS NULL OR old <> stop),
gaps AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS gap, lag(fraction) OVER w AS lf FROM heads WINDOW w AS (PARTITION BY vehicle_id, itinerary_id ORDER BY ts, event_id))"""


@query(
    prelude("ping") + f""", r AS (SELECT vehicle_id, line_id * 2 AS itinerary_id, event_id, ts, k / 20e0 AS fraction, 'S' || (k // 2) AS stop FROM ping WHERE event_id % 17 <> 0 AND event_id % 190 <= 150),
{_PASSAGES}
SELECT vehicle_id, itinerary_id, event_id, ts, stop, CASE WHEN gap BETWEEN 0 AND 36000 THEN round(gap, 6) END AS secs_since_prev, CASE WHEN fraction > lf THEN round((fraction - lf) * 10000, 6) END AS leg_m FROM gaps"""
)
def stop_passages(spark: SparkSession, sf: str) -> DataFrame:
    return gps.passages(near_stops(spark, sf), 36000)


def near_stops(spark: SparkSession, sf: str) -> DataFrame:
    """Pings with a next stop, 0 to 189 metres ahead."""
    stop = F.when(F.col("event_id") % 17 != 0, F.concat(F.lit("S"), F.expr("k div 2").cast("string")))
    return view(spark, sf, "ping").select("vehicle_id", (F.col("line_id") * 2).alias("itinerary_id"), "event_id", "ts", (F.col("k") / 20).alias("fraction"), F.lit(10000.0).alias("length_m"), stop.alias("stop"), (F.col("event_id") % 190).cast("double").alias("stop_m"))


_LINKS = "link_ AS (SELECT itinerary_id, stop_id, 'S' || (stop_id % 21) AS name, fraction FROM itinerary_stop)"


@query(
    prelude("ping", "itinerary_stop") + f""", {_LINKS}, p AS (SELECT vehicle_id, line_id * 2 AS itinerary_id, event_id, ts, k / 20e0 AS fraction, 'S' || (k // 2) AS stop FROM ping WHERE event_id % 17 <> 0 AND event_id % 190 <= 150),
r AS (SELECT p.*, stop_id FROM p JOIN (SELECT event_id, first(stop_id ORDER BY l.fraction, stop_id) AS stop_id FROM p JOIN link_ l ON l.itinerary_id = p.itinerary_id AND l.name = p.stop AND l.fraction >= p.fraction GROUP BY event_id) USING (event_id)),
{_PASSAGES}
SELECT vehicle_id, itinerary_id, event_id, ts, stop, stop_id, CASE WHEN gap BETWEEN 0 AND 36000 THEN round(gap, 6) END AS secs_since_prev, CASE WHEN fraction > lf THEN round((fraction - lf) * 10000, 6) END AS leg_m FROM gaps"""
)
def stop_passages_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Passages at the first stop of the announced name that is not behind the vehicle."""
    return gps.passages(gps.stop_by_name(gps.near_stop(near_stops(spark, sf)), named_links(spark, sf)), 36000)


def named_links(spark: SparkSession, sf: str) -> DataFrame:
    """Stops of itineraries under names that several share."""
    return view(spark, sf, "itinerary_stop").select("itinerary_id", "stop_id", F.concat(F.lit("S"), F.col("stop_id") % 21).alias("name"), "fraction")


@query(prelude("ping") + "SELECT CAST(hour(ts - INTERVAL 3 HOURS) AS INTEGER) AS hour, CAST(dayofweek(ts - INTERVAL 3 HOURS) AS INTEGER) AS weekday, count(*) AS n FROM ping GROUP BY 1, 2")
def pings_by_clock(spark: SparkSession, sf: str) -> DataFrame:
    return gps.clock(view(spark, sf, "ping").select("ts")).groupBy("hour", "weekday").agg(F.count("*").alias("n"))


@query(
    prelude("ping") + "SELECT event_id, next_m, round(CASE WHEN v > 0 THEN next_m / (v * 1000 / 3600) END, 6) AS eta_s FROM (SELECT event_id, k * 300e0 AS next_m, speed - 20 AS v, k / 20e0 AS f FROM ping) AS p"
    " WHERE next_m > 10 AND next_m < 5000 AND v >= 0 AND f > 0 AND f < 1"
)
def eta_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "ping").select("event_id", (F.col("k") * F.lit(300.0)).alias("next_m"), (F.col("speed") - 20).alias("mean_speed"), (F.col("k") / 20).alias("fraction"))
    return gps.eta_features(rows).select("event_id", "next_m", F.round(geo.eta_seconds(F.col("next_m"), F.col("mean_speed")), 6).alias("eta_s"))


@query(
    prelude("ping") + "SELECT event_id, round(CASE WHEN v >= 2 AND f < 0.98 AND lag > 5 AND lag < 120 THEN least(1e0, f + v / 3.6e0 * lag / 10000e0) ELSE f END, 9) AS fraction"
    " FROM (SELECT event_id, k / 20e0 AS f, speed AS v, event_id % 130 AS lag FROM ping) AS p"
)
def lag_compensation(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "ping")
    return rows.select("event_id", F.round(geo.compensated(F.col("k") / 20, F.col("speed"), F.col("event_id") % 130, F.lit(10000.0)), 9).alias("fraction"))


@query(
    prelude("ping") + f", {_LATEST}, cycle AS (SELECT * FROM latest WHERE ts >= TIMESTAMP '2024-01-30 18:00:00') SELECT vehicle_id, 'active' AS status FROM cycle UNION ALL"
    " SELECT vehicle_id, 'no_signal' AS status FROM latest l WHERE ts >= TIMESTAMP '2024-01-29' AND NOT EXISTS (SELECT 1 FROM cycle c WHERE c.vehicle_id = l.vehicle_id)"
)
def no_signal(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "ping").select("vehicle_id", "event_id", "ts")
    last = gps.latest(p)
    cycle = last.filter("ts >= TIMESTAMP_NTZ '2024-01-30 18:00:00'")
    return gps.no_signal(p.select("vehicle_id").distinct(), cycle, last.filter("ts >= TIMESTAMP_NTZ '2024-01-29 00:00:00'")).select("vehicle_id", "status")


_STATUS = f"status_ AS (SELECT *, CASE WHEN age <= 86400 THEN 'active' WHEN age <= 259200 THEN 'no_signal' ELSE 'gone' END AS status FROM (SELECT *, trunc((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 1000000.0) AS age FROM latest) AS l)"


@query(prelude("ping") + f", {_LATEST}, {_STATUS} SELECT line_id, count(*) FILTER (status = 'active') AS n_active, count(*) FILTER (status = 'no_signal') AS n_no_signal FROM status_ GROUP BY line_id")
def status_histogram(spark: SparkSession, sf: str) -> DataFrame:
    last = gps.latest(view(spark, sf, "ping").select("vehicle_id", "event_id", "ts", "line_id"))
    return stats.status_histogram(stats.vehicle_status(last, NOW, 86400, 3 * 86400))


@query(
    prelude("ping") + f", {_LATEST} SELECT line_id, '[' || string_agg('{{\"vehicle_id\":' || vehicle_id || ',\"lat\":' || round(lat, 6) || ',\"lon\":' || round(lon, 6) || ',\"status\":\"active\"}}', ',' ORDER BY vehicle_id) || ']' AS message FROM latest GROUP BY line_id"
)
def line_messages(spark: SparkSession, sf: str) -> DataFrame:
    last = gps.latest(view(spark, sf, "ping").select("vehicle_id", "event_id", "ts", "line_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")))
    return gps.by_line(last.withColumn("status", F.lit("active")))


@query(
    prelude("ping", "itinerary_stop") + f""", {_LATEST}, here AS (SELECT itinerary_id, line_id, min(fraction) AS sf FROM itinerary_stop WHERE stop_id = 9 GROUP BY ALL),
live AS (SELECT l.vehicle_id, l.ts, l.speed, l.line_id, a.itinerary_id, k / 20e0 AS fraction, a.sf FROM latest l JOIN here a ON a.itinerary_id = l.line_id * 2),
due AS (SELECT *, (sf - fraction) * 5000 AS metres FROM live WHERE fraction <= sf)
SELECT vehicle_id, round(metres, 6) AS metres, round(CASE WHEN speed > 0 THEN metres / (speed * 1000 / 3600) END, 6) AS eta_s FROM due"""
)
def arrivals_board(spark: SparkSession, sf: str) -> DataFrame:
    last = gps.latest(view(spark, sf, "ping").select("vehicle_id", "event_id", "ts", "line_id", "speed", "k"))
    live = last.withColumn("itinerary_id", F.col("line_id") * 2).withColumn("fraction", F.col("k") / 20)
    links = view(spark, sf, "itinerary_stop")
    lengths = links.select("itinerary_id").distinct().withColumn("length_m", F.lit(5000.0))
    return gps.arrivals(live, links, 9, lengths, NOW).select("vehicle_id", F.round("metres", 6).alias("metres"), F.round("eta_s", 6).alias("eta_s"))


@query(
    prelude("ping", "vertex").replace("WITH ", "WITH RECURSIVE ", 1) + f""", {MATCHED},
steps AS (SELECT h.vehicle_id, row_number() OVER (PARTITION BY h.vehicle_id ORDER BY h.ts, h.event_id) AS n, h.event_id, h.speed, h.heading, m.itinerary_id, m.fraction, m.metres FROM headed h LEFT JOIN matched m USING (event_id)),
{route_fold("steps")} SELECT vehicle_id, event_id, route, round(pos, 6) AS "at", round(metres, 6) AS metres, status FROM folded WHERE n > 0"""
)
def confirmed_routes(spark: SparkSession, sf: str) -> DataFrame:
    """The route of each vehicle with hysteresis, ping by ping."""
    m = matched_pings(spark, sf).select("event_id", "itinerary_id", "fraction", "metres")
    rows = gps.with_heading(view(spark, sf, "ping")).select("vehicle_id", "event_id", "ts", "speed", "heading").join(m, "event_id", "left")
    return gps.route_state(rows).select("vehicle_id", "event_id", "route", F.round("at", 6).alias("at"), F.round("metres", 6).alias("metres"), "status")


@query(prelude("vertex") + "SELECT DISTINCT itinerary_id, line_id, 21 AS n_vertices FROM vertex")
def itinerary_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return itineraries(spark, sf).select("itinerary_id", "line_id", F.size("vertices").alias("n_vertices"))
