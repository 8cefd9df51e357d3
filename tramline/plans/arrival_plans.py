"""Arrivals: overlapping polls, the arrival model, the board of a stop from matched pings, counters of a cycle."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions import geo
from tramline.operators import arrival_model, catalog, gps, network
from tramline.plans.live_plans import START
from tramline.plans.registry import ellipsoid, query
from tramline.plans.spatial_plans import MATCHED, matched_pings
from tramline.plans.stream_plans import folder_for
from tramline.plans.vehicle_plans import NOW
from tramline.sources import polled
from tramline.sources.tables import itineraries, prelude, view
from tramline.streaming import gps_stream

HOUR = 3600.0


@query("SELECT event_id, user_id AS vehicle_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS k FROM events) AS e WHERE k = 1")
def polled_pings(spark: SparkSession, sf: str) -> DataFrame:
    """Every ping once, from polls every six hours that look back nine; the query stops half-way and goes on."""
    at = folder_for(spark, "polled")
    start = datetime.fromisoformat(START).replace(tzinfo=timezone.utc).timestamp()
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("user_id").alias("vehicle_id"), F.col("ts").cast("timestamp").alias("sent_at"))
    once = events.groupBy("vehicle_id", "sent_at").agg(F.min("event_id").alias("event_id"))  # one of those that share vehicle and time
    polled.write_slots(once.select("sent_at", F.to_json(F.struct("event_id", "vehicle_id")).alias("payload")), f"{at}/slots", start, 6 * HOUR)
    for days in (15, 32):
        polls = polled.read_polls(spark, f"{at}/slots", start, 6 * HOUR, 9 * HOUR, start + days * 24 * HOUR)
        rows = polls.select(F.from_json("payload", "event_id long, vehicle_id long").alias("p"), F.col("sent_at").alias("ts")).select("p.*", "ts")
        gps_stream.run_once(gps_stream.deduplicated(rows, "12 hours"), f"{at}/rows", f"{at}/state")
    return spark.read.parquet(f"{at}/rows").select("event_id", "vehicle_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


_SCORED = "SELECT event_id, 'L' || user_id % 27 AS line_code, ts, event_id % 60 * 100e0 AS next_m, CASE WHEN event_id % 9 > 0 THEN value - 5 END AS mean_speed, event_id % 21 / 20e0 AS fraction FROM events"


@query(
    f"""WITH p AS ({_SCORED}), q AS (SELECT *, coalesce(next_m > 10 AND next_m < 5000 AND mean_speed >= 0 AND fraction > 0 AND fraction < 1, false) AS may FROM p)
SELECT event_id, may AS scored, CASE WHEN may THEN CAST(substr(line_code, 2) AS BIGINT) IN (SELECT l_suppkey % 25 FROM lineitem WHERE l_quantity * 100 < 5000) END AS known_line, CAST(hour(ts - INTERVAL 3 HOURS) AS INTEGER) AS hour,
  round(next_m / (greatest(mean_speed, 3) / 3.6e0), 4) AS by_speed FROM q"""
)
def eta_scored(spark: SparkSession, sf: str) -> DataFrame:
    """Pings scored by a model that was fitted on passages, stored and loaded again: which rows have an estimate, and what it read."""
    path = f"{folder_for(spark, 'eta')}/model"
    legs = spark.read.parquet(f"{sf}/lineitem.parquet")
    learned = legs.select(
        F.concat(F.lit("L"), F.col("l_suppkey") % 25).alias("line_code"), F.col("l_shipdate").cast("timestamp").alias("ts"), (F.col("l_quantity") * 100).cast("double").alias("next_m"),
        (F.col("l_discount") * 200 + 5).cast("double").alias("mean_speed"), ((F.col("l_linenumber") % 7 + 1) / 10).cast("double").alias("fraction"), (F.col("l_quantity") * 30).cast("double").alias("secs"),
    )
    arrival_model.fit(learned, path)
    e = spark.read.parquet(f"{sf}/events.parquet")
    rows = e.select(
        "event_id", F.concat(F.lit("L"), F.col("user_id") % 27).alias("line_code"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 60 * 100).cast("double").alias("next_m"),
        F.when(F.col("event_id") % 9 > 0, F.col("value") - 5).alias("mean_speed"), (F.col("event_id") % 21 / 20).alias("fraction"),
    )
    done = arrival_model.features(arrival_model.score(rows, arrival_model.load(path)))
    by_speed = F.when(F.col("mean_speed").isNotNull(), F.col("by_speed")).otherwise(F.col("next_m") / (arrival_model.CRAWL / 3.6))
    return done.select("event_id", F.col("eta_s").isNotNull().alias("scored"), "known_line", "hour", F.round(by_speed, 4).alias("by_speed"))


STOP, YOUNG, OLD = 9, 86400, 3 * 86400


@query(
    prelude("ping", "vertex", "itinerary_stop") + f""", {MATCHED}, sized AS (SELECT itinerary_id, sum({ellipsoid('ay', 'ax', 'by_', 'bx')}) AS length_m FROM seg GROUP BY itinerary_id),
seen AS (SELECT h.vehicle_id, h.ts, h.speed, m.itinerary_id, m.fraction, row_number() OVER (PARTITION BY h.vehicle_id ORDER BY h.ts DESC, h.event_id DESC) AS k FROM matched m JOIN headed h USING (event_id) WHERE h.ts <= TIMESTAMP '{NOW}'),
live AS (SELECT *, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 1e6 AS age FROM seen WHERE k = 1),
here AS (SELECT itinerary_id, line_id, CAST(stop_id % 5 + itinerary_id % 2 AS DOUBLE) AS d, min(fraction) AS f FROM itinerary_stop WHERE stop_id = {STOP} GROUP BY ALL),
met AS (SELECT l.*, h.line_id, h.d, h.f FROM live l JOIN here h USING (itinerary_id) WHERE age < {OLD}),
best AS (SELECT line_id, first(itinerary_id ORDER BY d, f, itinerary_id) AS itinerary_id FROM met GROUP BY line_id),
far AS (SELECT m.*, (f - fraction) * length_m AS metres FROM met m JOIN best USING (line_id, itinerary_id) JOIN sized USING (itinerary_id) WHERE fraction <= f),
eta AS (SELECT *, CASE WHEN speed > 0 THEN metres / (speed * 1000 / 3600) END AS eta_s FROM far)
SELECT vehicle_id, CASE WHEN age < {YOUNG} THEN 'active' ELSE 'no_signal' END AS status, itinerary_id, round(metres, 4) AS metres, round(eta_s, 4) AS eta_s,
  strftime(greatest(TIMESTAMP '{NOW}', ts + to_microseconds(CAST(round(eta_s * 1e6) AS BIGINT))) - INTERVAL 3 HOURS, '%H:%M') AS due_local FROM eta"""
)
def arrivals_from_matches(spark: SparkSession, sf: str) -> DataFrame:
    """The board of a stop from matched pings: status by age, one itinerary a line, metres, seconds and local clock time."""
    seen = matched_pings(spark, sf).select("vehicle_id", "event_id", "ts", "line_id", "speed", "itinerary_id", "fraction")
    live = gps.current(seen, NOW, YOUNG, OLD).withColumn("mean_speed", F.lit(None).cast("double"))
    links = view(spark, sf, "itinerary_stop").withColumn("distance_m", (F.col("stop_id") % 5 + F.col("itinerary_id") % 2).cast("double"))
    lengths = itineraries(spark, sf).select("itinerary_id", geo.length_metres(F.col("vertices")).alias("length_m"))
    rows = gps.board(live, links, STOP, lengths, NOW)
    return rows.select("vehicle_id", "status", "itinerary_id", F.round("metres", 4).alias("metres"), F.round("eta_s", 4).alias("eta_s"), "due_local")


@query(
    prelude("ping") + f""", a AS (SELECT *, CASE WHEN event_id % 9 > 0 THEN lat END AS y, trunc((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 1000000.0) AS age, CASE WHEN event_id % 4 > 0 THEN ts + to_seconds(CAST(event_id % 3 - 1 AS INTEGER)) END AS had FROM ping)
SELECT count(*) FILTER (y IS NOT NULL AND age <= 259200 AND (had IS NULL OR ts > had)) AS fresh, count(*) AS seen, count(y) AS valid, count(*) FILTER (y IS NOT NULL AND age > 259200) AS age_dropped, count(*) FILTER (y IS NOT NULL AND age <= 259200 AND age > 86400) AS stale FROM a"""
)
def cycle_counters_fresh(spark: SparkSession, sf: str) -> DataFrame:
    """The counters of a cycle with the pings that are newer than what is stored."""
    e = F.col("event_id")
    had = F.when(e % 4 > 0, F.col("ts") + F.make_dt_interval(secs=(e % 3 - 1)))
    p = view(spark, sf, "ping").withColumn("lat", F.when(e % 9 > 0, F.col("lat"))).withColumn("had", had)
    return p.agg(*network.cycle_counters(p, NOW, 259200, 86400, "had"))


@query(prelude("line") + "SELECT name, true AS found FROM line WHERE line_id % 2 = 0 UNION ALL SELECT name || '?', false FROM line WHERE line_id % 2 = 1")
def lines_exist(spark: SparkSession, sf: str) -> DataFrame:
    """Whether lines of given names exist, all names in one join."""
    lines = view(spark, sf, "line")
    asked = lines.select(F.when(F.col("line_id") % 2 == 0, F.col("name")).otherwise(F.concat("name", F.lit("?"))).alias("name"))
    return catalog.exist(asked, lines, "name")
