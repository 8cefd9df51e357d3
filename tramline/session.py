"""Session builder with the settings the library is written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(name: str = "tramline", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with AQE on.

    ``master`` is only for local work; on a cluster the submit tool sets it.  Further
    settings come as keywords with ``__`` for dots.
    """
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def local_session(cores: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return build_session(
        master=f"local[{cores}]",
        spark__sql__shuffle__partitions=str(cores),
        spark__driver__memory=memory,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
