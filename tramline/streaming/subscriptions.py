"""Who wants which line, as a table that changes while streams run.

The table is a folder of Parquet files to which changes are appended: (line_id, connection, at, wanted).  A stream
joins it through a Python data source, which reads the folder anew in every micro-batch; a file listing that
Spark keeps for a query's life would not see later changes.  What counts for a ping is the time of its poll,
so that a replay gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

CHANGES = "line_id long, connection string, at timestamp, wanted boolean"


class ChangesReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(self.path)
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return
        kind = pa.schema([("line_id", pa.int64()), ("connection", pa.string()), ("at", pa.timestamp("us", "UTC")), ("wanted", pa.bool_())])
        yield from ds.dataset(path, schema=kind, filesystem=system, format="parquet").to_batches()


class ChangesSource(DataSource):
    """``spark.read.format("subscription_changes").option("path", folder)``."""

    @classmethod
    def name(cls) -> str:
        return "subscription_changes"

    def schema(self) -> str:
        return CHANGES

    def reader(self, schema) -> DataSourceReader:
        return ChangesReader(self.options["path"])


def change(changes: DataFrame, folder: str) -> None:
    """Append changes, each with its time."""
    changes.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in CHANGES.split(", "))).write.mode("append").parquet(folder)


def read_changes(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(ChangesSource)
    return spark.read.format("subscription_changes").option("path", folder).load()


def by_line(changes: DataFrame) -> DataFrame:
    """(line_id, turns): for each line every time at which a connection came (1) or went (-1), repeats left out, in order."""
    each = changes.groupBy("line_id", "connection").agg(F.array_sort(F.collect_list(F.struct("at", "wanted"))).alias("c"))
    new = F.filter("c", lambda x, i: x["wanted"] != F.when(i == 0, False).otherwise(F.get("c", i - 1)["wanted"]))
    turns = each.select("line_id", F.explode(new).alias("t")).select("line_id", F.struct(F.col("t.at").alias("at"), F.when(F.col("t.wanted"), 1).otherwise(-1).alias("step")).alias("t"))
    return turns.groupBy("line_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def wanted_at(turns: Column, at: Column) -> Column:
    """Whether any connection wants the line at a time; false for a line without turns."""
    return F.coalesce(F.aggregate(F.filter(turns, lambda t: t["at"] <= at), F.lit(0), lambda n, t: n + t["step"]) > 0, F.lit(False))
