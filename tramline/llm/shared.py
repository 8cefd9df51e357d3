"""Shared storage for written intermediate tables, and small helpers of the corpus operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"

#: Rows of a few numbers that may be sent to every task; more meet in a shuffle.
SENT = 500_000

_fallback: str | None = None
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as a URI.

    It is ``spark.checkpoint.dir`` of the session.  Only where that is unset and the master is
    local (tests on one machine) a temporary folder stands in for it; on a cluster that is an error.
    """
    global _fallback
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        _fallback = _fallback or tempfile.mkdtemp(prefix="tramline-")
        at = _fallback
    return at if "://" in at or at.startswith("file:") else f"file://{at}"


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for one written table or folder; it goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tramline-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a short lineage that survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written with a number for each row that stays the same, and the name of that column, which none of theirs has."""
    name = "__row"
    while name in docs.columns:
        name += "_"
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def without(rows: DataFrame, gone: DataFrame, on: str) -> DataFrame:
    """``rows`` less those whose ``on`` is in ``gone``, a written table of numbers.

    Wide rows stay where they are as long as ``gone`` is small by count; else both are shuffled.
    """
    return rows.join(F.broadcast(gone) if gone.count() <= SENT else gone, on, "left_anti")


def one_of_each(rows: DataFrame, number: str, roots: DataFrame, id_col: str) -> DataFrame:
    """Of ``numbered`` rows those with the least (id, number) of each root (row, root; every row has one); null ids come last."""
    ids = rows.select(F.col(number).alias("row"), F.col(f"`{id_col}`").alias("id"))
    roots = written(roots, "roots")
    least = roots.join(ids, "row").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least"))
    gone = roots.select("row").join(least.select(F.col("least.row").alias("row")), "row", "left_anti")
    return without(rows, written(gone.select(F.col("row").alias(number)), "gone"), number).drop(number)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it; works in tasks as well as on the driver."""
    return pafs.FileSystem.from_uri(uri)


def drop_path(uri: str) -> None:
    try:
        system, path = filesystem(uri)
        system.delete_dir(path)
    except (OSError, ValueError):
        pass


def drop_written(*tables: DataFrame) -> None:
    """Give back the disk of written tables that nothing will read again."""
    for t in tables:
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            drop_path(folder)


@atexit.register
def _drop_all() -> None:
    for uri in _written:
        drop_path(uri)


def by_bytes(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices, in order, whose values of a text or binary column hold about ``most`` bytes, or in one row more."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, as a lambda's variable."""
    return F.transform(F.array(value), body)[0]


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def json_literal(values: list, kind: str) -> Column:
    """A constant array as one literal; Catalyst folds it when it plans the query."""
    import json

    return F.from_json(F.lit(json.dumps(values)), kind)
