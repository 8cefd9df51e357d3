"""A streaming source of overlapping polls: poll n gives what was sent in the window before its time.

Polls overlap by design, since what was sent last arrives late; the stream that reads them drops repeats
(``gps_stream.deduplicated``).  Offsets are numbers of polls and come from the clock alone, so a restart
goes on from its checkpoint and a batch that is run again reads the same window.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Rows: the time a ping was sent, and its payload.
ROWS = "sent_at timestamp, payload string"
_KIND = pa.schema([("sent_at", pa.timestamp("us", "UTC")), ("payload", pa.string())])


class Poll(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class PollReader(DataSourceStreamReader):
    """Options: path (a folder of slots, slot=n holding what was sent in [n, n + 1) steps), start and step in seconds, window in
    seconds, and until, the time at which polling ends (now if absent)."""

    def __init__(self, options: dict) -> None:
        self.path, self.start, self.step, self.window = options["path"], float(options["start"]), float(options["step"]), float(options["window"])
        self.until = float(options["until"]) if "until" in options else None

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def latestOffset(self) -> dict:
        now = time.time() if self.until is None else min(time.time(), self.until)
        return {"poll": max(0, int((now - self.start) // self.step))}

    def partitions(self, start: dict, end: dict) -> list[Poll]:
        """A task for each poll after ``start``."""
        return [Poll(n) for n in range(start["poll"] + 1, end["poll"] + 1)]

    def read(self, partition: Poll) -> Iterator[pa.RecordBatch]:
        at = self.start + partition.number * self.step
        first, last = int((at - self.window - self.start) // self.step), partition.number
        system, path = fs.FileSystem.from_uri(self.path)
        low, high = (pa.scalar(round(t * 1e6), pa.int64()).cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC")) for t in (at - self.window, at))
        for slot in range(max(0, first), last + 1):
            folder = f"{path}/slot={slot}"
            if system.get_file_info(folder).type != fs.FileType.NotFound:
                table = ds.dataset(folder, schema=_KIND, filesystem=system, format="parquet")
                yield from table.to_batches(filter=(ds.field("sent_at") > low) & (ds.field("sent_at") <= high))


class PollSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "overlapping_polls"

    def schema(self) -> str:
        return ROWS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PollReader(self.options)


def write_slots(sent: DataFrame, path: str, start: float, step: float) -> None:
    """Land (sent_at, payload) in slots of ``step`` seconds."""
    slot = F.floor((F.unix_micros("sent_at") - int(start * 1e6)) / (step * 1e6)).cast("long")
    sent.select("sent_at", "payload", slot.alias("slot")).repartition("slot").write.mode("append").partitionBy("slot").parquet(path)


def read_polls(spark: SparkSession, path: str, start: float, step: float, window: float = 60.0, until: float | None = None) -> DataFrame:
    spark.dataSource.register(PollSource)
    r = spark.readStream.format("overlapping_polls").option("path", path).option("start", start).option("step", step).option("window", window)
    return (r if until is None else r.option("until", until)).load()
