"""Streaming queries over pings, run to the end of what is there; the sinks are read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.plans.registry import query, route_fold
from tramline.streaming import gps_stream, live


def folder_for(spark: SparkSession, name: str) -> str:
    """A new folder where the session's executors can all write; only a local master may do without a shared one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tramline-stream-")
    return f"{at.rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"


def _pings(spark: SparkSession, sf: str) -> DataFrame:
    raw = gps_stream.read_pings(spark, sf, spark.read.parquet(f"{sf}/events.parquet").schema, names="events.parquet")
    line = (F.col("user_id") % 25).alias("line_id")
    return raw.select("event_id", F.col("user_id").alias("vehicle_id"), line, F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("speed"))


def _result(spark: SparkSession, rows: DataFrame, name: str, mode: str = "append") -> DataFrame:
    at = folder_for(spark, name)
    gps_stream.run_once(rows, f"{at}/rows", f"{at}/state", mode)
    return spark.read.parquet(f"{at}/rows")


@query("SELECT DISTINCT user_id AS vehicle_id, ts FROM events")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every ping comes twice, as from overlapping polls."""
    p = _pings(spark, sf).select("vehicle_id", "ts", F.explode(F.array(F.lit(0), F.lit(1))).alias("poll"))
    return _result(spark, gps_stream.deduplicated(p), "dedup").select("vehicle_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, user_id % 25 AS line_id, count(*) AS n, round(avg(value), 6) AS mean_speed FROM events GROUP BY 1, 2"
    " HAVING time_bucket(INTERVAL 1 HOUR, min(ts)) + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 300 SECONDS FROM events)"
)
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly windows that the watermark has closed."""
    w = _result(spark, gps_stream.windowed_counts(_pings(spark, sf), "1 hour"), "windows")
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "line_id", "n", F.round("mean_speed", 6).alias("mean_speed"))


@query(
    "WITH s AS (SELECT user_id, ts, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOURS, true) AS new FROM events) AS e)"
    " SELECT user_id AS vehicle_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 2 HOURS <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 300 SECONDS FROM events)"
)
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = _result(spark, gps_stream.sessions(_pings(spark, sf), "2 hours"), "sessions")
    return s.select("vehicle_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT user_id AS vehicle_id, max(ts) AS ts FROM events GROUP BY 1")
def stream_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The snapshot table after the last cycle: the newest ping of each vehicle."""
    at = folder_for(spark, "snapshot")
    gps_stream.run_snapshots(gps_stream.latest_rows(_pings(spark, sf)), f"{at}/rows", f"{at}/state", once=True).awaitTermination()
    rows = spark.read.parquet(f"{at}/rows")
    return rows.groupBy("vehicle_id").agg(F.max("ts").cast("timestamp_ntz").alias("ts"))


@query(
    f"""WITH RECURSIVE once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS k FROM events) AS e WHERE k = 1),
steps AS (SELECT user_id AS vehicle_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n, event_id, value % 60 AS speed, CASE WHEN event_id % 5 > 0 THEN CAST(event_id % 360 AS DOUBLE) END AS heading,
  CASE WHEN event_id % 7 <> 0 THEN user_id % 25 * 2 + event_id % 2 END AS itinerary_id, (event_id % 20) / 20e0 AS fraction, CAST(event_id % 200 AS DOUBLE) AS metres FROM once),
{route_fold("steps")} SELECT vehicle_id, event_id, route, pos AS "at", metres, status FROM folded WHERE n > 0"""
)
def stream_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Confirmed routes as keyed state; every ping brings a candidate route, every seventh none, every fifth no heading."""
    e = F.col("event_id")
    rows = _pings(spark, sf).select(
        "vehicle_id", "event_id", "ts", (F.col("speed") % 60).alias("speed"), F.when(e % 5 > 0, (e % 360).cast("double")).alias("heading"), F.when(e % 7 != 0, F.col("line_id") * 2 + e % 2).alias("itinerary_id"),
        ((e % 20) / 20).alias("fraction"), (e % 200).cast("double").alias("metres"),
    )
    live.use_state_store(spark)
    return _result(spark, gps_stream.confirmed_routes(rows), "routes")
