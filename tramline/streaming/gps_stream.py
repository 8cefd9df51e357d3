"""The live path: streaming queries over pings (de-duplication, windows, sessions, route state, snapshots)."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tramline.operators.gps import NO_ROUTE, STATE, route_step

#: A ping's columns as they are handed over, each at a cost for every row; the last is none of them.
PING = namedtuple("PING", "vehicle_id event_id ts speed heading itinerary_id fraction metres mean_speed", defaults=[None])
ROUTE_ROW = Row(*(c.split()[0] for c in STATE.split(", ")))


def read_pings(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000, names: str = "*.parquet") -> DataFrame:
    """A stream of the files of a folder whose names fit ``names``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", names).parquet(path)


def deduplicated(pings: DataFrame, late: str = "300 seconds") -> DataFrame:
    """Polls overlap by design; a ping is its vehicle and time.  State goes with the watermark."""
    return pings.withWatermark("ts", late).dropDuplicatesWithinWatermark(["vehicle_id", "ts"])


def windowed_counts(pings: DataFrame, width: str = "10 minutes", late: str = "300 seconds") -> DataFrame:
    """Pings and mean speed of each line in tumbling event-time windows."""
    w = pings.withWatermark("ts", late).groupBy(F.window("ts", width), "line_id")
    return w.agg(F.count("*").alias("n"), F.avg("speed").alias("mean_speed"))


def sessions(pings: DataFrame, gap: str = "30 minutes", late: str = "300 seconds") -> DataFrame:
    s = pings.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "vehicle_id")
    return s.agg(F.count("*").alias("n"))


def latest_rows(pings: DataFrame) -> DataFrame:
    """The newest ping of each vehicle as a stream in update mode; its state has one row a vehicle and no end of life."""
    return pings.groupBy("vehicle_id").agg(F.max(F.struct("ts", "event_id", "line_id", "speed")).alias("b")).select("vehicle_id", "b.*")


def _micros(ts: datetime | None) -> int | None:
    return None if ts is None else (ts.astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


class RouteProcessor(StatefulProcessor):
    """One vehicle's confirmed route, by ``gps.route_step``: a ping not newer than the last is dropped, and the state goes ``ttl_ms`` after it."""

    def __init__(self, rules: tuple, ttl_ms: int) -> None:
        self.rules, self.ttl_ms = rules, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("route", "route long, held double, at double, missed int, last long, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        *now, last, due = self.held.get() or (*NO_ROUTE, None, None)
        now, untimed, out = tuple(now), False, []
        pings = [(micros is None, micros or 0, p.event_id is None, p.event_id or 0, p) for p in (PING(*r) for r in rows) for micros in [_micros(p.ts)]]
        for no_time, micros, *_, r in sorted(pings, key=lambda p: p[:4]):
            if untimed or (not no_time and last is not None and micros <= last):
                continue  # of a batch's pings without a time the first counts, after the others
            now, row = route_step(now, r, *self.rules)
            untimed, last = no_time, last if no_time else micros
            out.append(ROUTE_ROW(key[0], r.event_id, *row))
        if out:
            if due is not None:
                self.handle.deleteTimer(due)
            due = max((last or 0) // 1000, timerValues.getCurrentWatermarkInMs()) + self.ttl_ms
            self.held.update((*now, last, due))
            self.handle.registerTimer(due)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def confirmed_routes(rows: DataFrame, gain: float = 30.0, jump: float = 100.0, misses: int = 3, least_speed: float = 3.0, ttl_ms: int = 180_000, late: str = "300 seconds") -> DataFrame:
    """``gps.route_state`` as keyed state: a ping not newer than the last is dropped; idle vehicles expire.

    Columns as there; output one row for each accepted ping.  Age is event time, so that a replay
    expires the same states and a run over what is there comes to its end.  Rows and state are handed over as they are, with
    no table made for each vehicle.  Needs the RocksDB state store (``live.use_state_store``).
    """
    if "mean_speed" in rows.columns:
        rows = rows.withColumn("speed", F.coalesce(F.when(~F.isnan("mean_speed"), F.col("mean_speed")), "speed"))
    own = rows.filter("vehicle_id IS NOT NULL").withWatermark("ts", late).select(*PING._fields[:-1])
    return own.groupBy("vehicle_id").transformWithState(RouteProcessor((gain, jump, misses, least_speed), ttl_ms), STATE, "Append", "EventTime")


def run_once(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; the sink is a Parquet folder."""
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def run_snapshots(stream: DataFrame, sink: str, checkpoint: str, seconds: int = 20, once: bool = False):
    """Write each cycle's rows as a snapshot of its own, keyed by the batch number (so repeats overwrite)."""
    def write(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{sink}/cycle={n}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update")
    return (q.trigger(availableNow=True) if once else q.trigger(processingTime=f"{seconds} seconds")).start()
