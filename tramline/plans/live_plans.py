"""The live cycle as streams: polls of the pings table run to their end, the sinks read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.operators import gps
from tramline.plans.registry import SQL, bearing, ellipsoid, haversine, query, route_fold
from tramline.plans.spatial_plans import HEADED, MATCHED, REACH
from tramline.plans.stream_plans import folder_for
from tramline.plans.vehicle_plans import named_links, near_stops
from tramline.sources.tables import itineraries, prelude, view
from tramline.streaming import gps_stream, live, subscriptions

#: A poll every four days of the table's month, and lifetimes to go with pings that come some hours apart.
START, DAYS, POLLS = "2024-01-01 00:00:00", 4, 8
ACTIVE, RECENT, OLDEST = 5 * 86400, 12 * 86400, 3 * 86400
LATE = 9 * 86400

_NTH = f"CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '{START}')) / {DAYS * 86400}e6) AS BIGINT)"
_POLLED = f"TIMESTAMP '{START}' + to_days(CAST((poll + 1) * {DAYS} AS INTEGER))"
#: Every ping with its poll; a tenth comes again with the next one, as polls overlap.
FED = f"fed AS (SELECT *, {_POLLED} AS polled_at FROM (SELECT *, {_NTH} AS poll FROM ping UNION ALL SELECT *, {_NTH} + 1 AS poll FROM ping WHERE event_id % 10 = 0) AS p)"
#: The pings that count: the newest of a vehicle in its poll, not too old, newer than the last; gap is the time since that one.
ACCEPTED = f"""newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, poll ORDER BY ts DESC, event_id DESC) AS rn FROM fed) AS n WHERE rn = 1 AND polled_at - ts <= INTERVAL {OLDEST} SECONDS),
accepted AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY vehicle_id ORDER BY poll) AS gap FROM
  (SELECT *, max(ts) OVER (PARTITION BY vehicle_id ORDER BY poll ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM newest) AS b WHERE before IS NULL OR ts > before)"""


def feed(spark: SparkSession, sf: str, rows: DataFrame | None = None, overlap: bool = True) -> DataFrame:
    """A stream of the pings (or ``rows`` with event_id and ts) in polls: as many files for each, in the order of their polls, that carry its time.

    A poll's files are one micro-batch, and each is a task's, so that a poll's rows are spread over the cores.
    """
    at = folder_for(spark, "polls")
    rows = view(spark, sf, "ping") if rows is None else rows
    start = F.lit(START).cast("timestamp_ntz").cast("timestamp")
    nth = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(start)) / (DAYS * 86400e6)).cast("long")
    polls = F.when(F.col("event_id") % 10 == 0, F.array(nth, nth + 1)).otherwise(F.array(nth)) if overlap else F.array(nth)
    fed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("poll", F.explode(polls))
    fed = fed.withColumn("polled_at", start + F.make_dt_interval(days=((F.col("poll") + 1) * DAYS).cast("int")))
    fed.write.partitionBy("poll").parquet(f"{at}/all")
    written = spark.read.parquet(f"{at}/all")
    polls = [n for (n,) in written.select("poll").distinct().orderBy("poll").collect()]
    files = max(1, spark.sparkContext.defaultParallelism)
    part = lambda n: F.coalesce(F.pmod(F.xxhash64("event_id"), F.lit(n)), F.lit(0)).cast("int")
    if written.select("poll", part(files)).distinct().count() < files * len(polls):
        files = 1  # an empty part leaves no file, and a poll's files would run into the next one's
    for n in polls:
        written.filter(F.col("poll") == n).drop("poll").repartitionById(files, part(files)).write.mode("append").parquet(f"{at}/feed")
    live.use_state_store(spark)
    return gps_stream.read_pings(spark, f"{at}/feed", written.drop("poll").schema, files_per_trigger=files)


def _once(spark: SparkSession, side: DataFrame, name: str) -> DataFrame:
    """A static side written and read back, so that it is not computed again for every micro-batch."""
    at = folder_for(spark, name)
    side.write.parquet(at)
    return spark.read.parquet(at)


def _pieces(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    cells, lines = live.route_pieces(itineraries(spark, sf), REACH)
    return _once(spark, cells, "cells"), _once(spark, lines, "lines")


def ran(spark: SparkSession, stream: DataFrame, name: str, after=None) -> DataFrame:
    """What a stream wrote in all its cycles."""
    at = folder_for(spark, name)
    live.write_cycles(stream, f"{at}/out", f"{at}/state", {}, after=after).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out/rows")


def _coded(pings: DataFrame) -> DataFrame:
    return pings.withColumn("line_code", F.concat(F.lit("L"), F.col("line_id")))


_WAYS = MATCHED[: MATCHED.index("fit AS")].rstrip().rstrip(",").replace(HEADED, "headed AS (SELECT *, 0e0 AS heading FROM ping)")


@query(
    prelude("ping", "vertex") + f""", {_WAYS}
SELECT event_id, itinerary_id, round(metres, 6) AS metres, round(fraction, 6) AS fraction, round(route_heading, 6) AS way FROM near_ JOIN spots USING (event_id, itinerary_id) JOIN way USING (event_id, itinerary_id)"""
)
def stream_matched(spark: SparkSession, sf: str) -> DataFrame:
    """Every ping of the stream against the cell-cut lines: a stream-static join without a shuffle of pairs."""
    found = live.with_candidates(feed(spark, sf, overlap=False), _pieces(spark, sf), REACH)
    each = found.select("event_id", F.explode_outer("candidates").alias("c")).filter("c IS NOT NULL")  # a plain explode infers filters that match again
    rows = ran(spark, each, "matched")
    return rows.select("event_id", "c.itinerary_id", *(F.round(f"c.{c}", 6).alias(c) for c in ("metres", "fraction", "way")))


_LIVES = f"""lives AS (SELECT *, coalesce(gap < {ACTIVE}e6, false) AS alive, sum(CASE WHEN gap IS NULL OR gap >= {RECENT}e6 THEN 1 ELSE 0 END) OVER v AS life, sum(CASE WHEN gap IS NULL OR gap >= {ACTIVE}e6 THEN 1 ELSE 0 END) OVER v AS run,
  lag(lat) OVER v AS plat, lag(lon) OVER v AS plon FROM accepted WINDOW v AS (PARTITION BY vehicle_id ORDER BY ts)),
raw_ AS (SELECT *, CASE WHEN alive AND {haversine('plat', 'plon', 'lat', 'lon')} >= 10 THEN {bearing('plat', 'plon', 'lat', 'lon')} END AS raw FROM lives),
good AS (SELECT event_id, avg(speed) OVER (PARTITION BY vehicle_id, life ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM lives WHERE speed <= 90),
headed AS (SELECT r.*, last_value(raw IGNORE NULLS) OVER (PARTITION BY vehicle_id, run ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading,
  last_value(m IGNORE NULLS) OVER (PARTITION BY vehicle_id, life ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mean_speed FROM raw_ r LEFT JOIN good USING (event_id))"""
_CYCLE = f"""{FED}, {ACCEPTED}, {MATCHED.replace(HEADED, _LIVES)},
steps AS (SELECT h.vehicle_id * 1000 + life AS vehicle_id, row_number() OVER (PARTITION BY h.vehicle_id, life ORDER BY h.ts) AS n, h.event_id, coalesce(mean_speed, speed) AS speed, h.heading, m.itinerary_id, m.fraction, m.metres FROM headed h LEFT JOIN matched m USING (event_id)),
{route_fold("steps")},
sized AS (SELECT itinerary_id, sum({ellipsoid('ay', 'ax', 'by_', 'bx')}) AS length_m FROM seg GROUP BY itinerary_id),
held_ AS (SELECT h.vehicle_id, h.event_id, h.ts, (epoch_us(h.polled_at) - epoch_us(h.ts)) / 1e6 AS lag_s, h.mean_speed, h.heading, f.route, f.pos AS fraction, f.status, s.length_m FROM folded f JOIN headed h USING (event_id) LEFT JOIN sized s ON s.itinerary_id = f.route WHERE f.n > 0),
nexts AS (SELECT event_id, i.stop_id, i.fraction AS stop_fraction, row_number() OVER (PARTITION BY event_id ORDER BY i.fraction, i.stop_id) AS k FROM held_ h JOIN itinerary_stop i ON i.itinerary_id = h.route AND round(i.fraction, 6) > round(h.fraction, 6)
  WHERE status IN ('first', 'same', 'switched', 'blocked', 'held')),
stopped AS (SELECT h.*, n.stop_id AS next_stop, s.name AS stop, (n.stop_fraction - h.fraction) * h.length_m AS stop_m FROM held_ h LEFT JOIN (SELECT * FROM nexts WHERE k = 1) n USING (event_id) LEFT JOIN stop s ON s.stop_id = n.stop_id),
by_stop AS (SELECT *, lag(stop) OVER (PARTITION BY vehicle_id, route ORDER BY ts) AS old FROM stopped WHERE stop_m <= 150 AND trim(coalesce(stop, '')) <> ''),
heads AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS gap_s, lag(fraction) OVER w AS lf FROM by_stop WHERE old IS NULL OR old <> stop WINDOW w AS (PARTITION BY vehicle_id, route ORDER BY ts))"""



def _states(spark: SparkSession, sf: str, pings: DataFrame, late: int = LATE, wanted: DataFrame | None = None) -> DataFrame:
    found = live.with_candidates(live.newest_of_poll(_coded(pings)), _pieces(spark, sf), REACH, wanted)
    return live.vehicle_states(found, ACTIVE, RECENT, OLDEST, late=f"{late} seconds")


@query(
    prelude("ping", "vertex", "itinerary_stop", "stop").replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_CYCLE}
SELECT s.event_id, round(s.mean_speed, 6) AS mean_speed, round(s.heading, 6) AS heading, s.route, round(CASE WHEN s.mean_speed >= 2 AND s.fraction < 0.98 AND s.length_m > 0 AND s.lag_s > 5 AND s.lag_s < 120 THEN least(1e0, s.fraction + s.mean_speed / 3.6e0 * s.lag_s / s.length_m) ELSE s.fraction END, 6) AS fraction, s.status AS step, s.next_stop, coalesce(h.event_id IS NOT NULL, false) AS passage,
  CASE WHEN gap_s BETWEEN 0 AND {RECENT} THEN round(gap_s, 6) END AS secs_since_prev, CASE WHEN h.fraction > lf THEN round((h.fraction - lf) * h.length_m, 3) END AS leg_m
FROM stopped s LEFT JOIN heads h USING (event_id)"""
)
def gps_cycle(spark: SparkSession, sf: str) -> DataFrame:
    """The whole cycle as one stream: polls, matching, vehicle state, next stop, passages."""
    links = view(spark, sf, "itinerary_stop").join(view(spark, sf, "stop").select("stop_id", "name"), "stop_id").select("itinerary_id", "stop_id", "name", "fraction")
    firsts = links.groupBy("itinerary_id", "fraction").agg(F.min(F.struct("stop_id", "name")).alias("s")).select("itinerary_id", "fraction", "s.stop_id", "s.name")
    states = _states(spark, sf, feed(spark, sf)).filter("status = 'active'")
    stopped = live.with_next_stop(states, _once(spark, firsts, "stops")).withColumnsRenamed({"route": "itinerary_id", "next_stop": "stop_id"})
    stopped = stopped.drop("line_code", "old_line", "left_line", "lat", "lon", "speed", "metres", "status")  # nothing of this cycle's end needs them
    rows = live.compensated(ran(spark, live.with_passages(stopped, RECENT), "cycle"))
    return rows.select("event_id", *(F.round(c, 6).alias(c) for c in ("mean_speed", "heading")), F.col("itinerary_id").alias("route"), F.round("fraction", 6).alias("fraction"), "step", F.col("stop_id").alias("next_stop"), "passage", F.round("secs_since_prev", 6).alias("secs_since_prev"), F.round("leg_m", 3).alias("leg_m"))


_CUT = SQL["stop_passages_by_name"]


@query(_CUT)
def stream_passages(spark: SparkSession, sf: str) -> DataFrame:
    """``stop_passages_by_name`` from a stream: named stops joined stream-static, state by vehicle and itinerary, appended cycle by cycle."""
    rows = feed(spark, sf, near_stops(spark, sf), overlap=False).withColumn("seen_at", F.col("ts")).withWatermark("seen_at", "300 seconds")
    found = live.with_passages(gps.stop_by_name(gps.near_stop(rows), _once(spark, gps.first_named(named_links(spark, sf)), "named")).drop("polled_at"), 36000, others=False)
    done = ran(spark, found, "passages").filter("passage")
    return done.select("vehicle_id", "itinerary_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "stop", "stop_id", F.round("secs_since_prev", 6).alias("secs_since_prev"), F.round("leg_m", 6).alias("leg_m"))


#: A third of the vehicles stops for good after nine days, another is silent for sixteen days.
_HEARD = f"NOT (vehicle_id % 3 = 0 AND ts >= TIMESTAMP '{START}' + INTERVAL 9 DAYS) AND NOT (vehicle_id % 3 = 1 AND ts >= TIMESTAMP '{START}' + INTERVAL 9 DAYS AND ts < TIMESTAMP '{START}' + INTERVAL 25 DAYS)"
_FED_ONCE = f"fed AS (SELECT *, {_POLLED} AS polled_at FROM (SELECT *, {_NTH} AS poll FROM ping WHERE {_HEARD}) AS p)"
_MARKS = f"""marks AS (SELECT n, (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 300 SECONDS FROM fed WHERE poll < n) AS w FROM (SELECT DISTINCT poll + 1 AS n FROM fed) AS p),
ends AS (SELECT a.*, coalesce(lead(poll) OVER (PARTITION BY vehicle_id ORDER BY poll) - 1, (SELECT max(n) FROM marks)) AS n FROM accepted a)"""


def _heard(spark: SparkSession, sf: str) -> DataFrame:
    return feed(spark, sf, view(spark, sf, "ping").filter(_HEARD.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")), overlap=False)


def _bare(pings: DataFrame) -> DataFrame:
    """Pings that are not to be matched."""
    return pings.withColumn("enriched", F.lit(False)).withColumn("candidates", F.lit(None).cast(live.CANDIDATE))


@query(
    prelude("ping") + f""", {_FED_ONCE}, {ACCEPTED}, {_MARKS}, told AS (SELECT vehicle_id, event_id, date_trunc('milliseconds', ts) AS ms, w FROM ends JOIN marks USING (n))
SELECT vehicle_id, event_id, 'no_signal' AS status FROM told WHERE ms + INTERVAL {ACTIVE} SECONDS <= w UNION ALL SELECT vehicle_id, event_id, 'gone' FROM told WHERE ms + INTERVAL {RECENT} SECONDS <= w"""
)
def stream_no_signal(spark: SparkSession, sf: str) -> DataFrame:
    """Vehicles that fell silent, told by timers while nothing of theirs arrives: first without signal, later gone."""
    states = live.vehicle_states(_bare(_coded(_heard(spark, sf))), ACTIVE, RECENT, OLDEST)
    return ran(spark, states.filter("status <> 'active'"), "silence").select("vehicle_id", "event_id", "status")


@query(
    prelude("ping") + f""", {_FED_ONCE}, {ACCEPTED}, {_MARKS}, last_ AS (SELECT vehicle_id, arg_max(event_id, ts) AS event_id, max(ts) AS ts FROM accepted GROUP BY vehicle_id)
SELECT 'L' || (event_id // 64) % 3 AS line_code, vehicle_id FROM last_ WHERE date_trunc('milliseconds', ts) + INTERVAL {RECENT} SECONDS > (SELECT max(w) FROM marks)"""
)
def stream_line_index(spark: SparkSession, sf: str) -> DataFrame:
    """The line index at the end of a stream in which vehicles switch lines and vanish: its changes, last by last."""
    code = F.concat(F.when(F.col("event_id") % 2 == 0, "l").otherwise("L"), F.expr("(event_id div 64) % 3").cast("string"))
    states = live.vehicle_states(_bare(_heard(spark, sf).withColumn("line_code", code)), ACTIVE, RECENT, OLDEST)
    changes = ran(spark, live.line_changes(states), "index")
    last = changes.groupBy("line_code", "vehicle_id").agg(F.max(F.struct("cycle", "present")).alias("l"))
    return last.filter("l.present").select("line_code", "vehicle_id")


_WANTED = f"(line_id < 10 AND NOT (line_id < 5 AND polled_at >= TIMESTAMP '{START}' + INTERVAL 20 DAYS) OR line_id BETWEEN 10 AND 14 AND polled_at >= TIMESTAMP '{START}' + INTERVAL 24 DAYS)"


@query(
    prelude("ping", "vertex") + f""", {FED}, {ACCEPTED}, {_LIVES} SELECT event_id, round(mean_speed, 6) AS mean_speed, {_WANTED} AS enriched FROM headed"""
)
def stream_subscribed(spark: SparkSession, sf: str) -> DataFrame:
    """Only lines that somebody wants are matched; who wants what changes while the stream runs, after its third cycle."""
    folder = f"{folder_for(spark, 'wanted')}/changes"
    lines = view(spark, sf, "line").select("line_id")
    at = lambda days: (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(days=F.lit(days))).cast("timestamp").alias("at")
    who = F.concat(F.lit("c"), F.col("line_id")).alias("connection")
    subscriptions.change(lines.filter("line_id < 10").select("line_id", who, at(0), F.lit(True).alias("wanted")), folder)

    def after(session: SparkSession, n: int) -> None:
        if n == 2:
            left = lines.filter("line_id < 5").select("line_id", who, at(20), F.lit(False).alias("wanted"))
            subscriptions.change(left.unionByName(lines.filter("line_id BETWEEN 10 AND 14").select("line_id", who, at(24), F.lit(True).alias("wanted"))), folder)

    states = _states(spark, sf, feed(spark, sf), wanted=subscriptions.by_line(subscriptions.read_changes(spark, folder)))
    rows = ran(spark, states.filter("status = 'active'"), "subscribed", after)
    return rows.select("event_id", F.round("mean_speed", 6).alias("mean_speed"), F.col("step").isNotNull().alias("enriched"))
