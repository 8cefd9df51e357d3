"""Counts and averages for dashboards.  Every "now" is a parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def training_stats(passages: DataFrame, least: int) -> DataFrame:
    """Per line: passages, those with a leg time, and the lines' share that has ``least`` of them."""
    by = passages.groupBy("line_id").agg(F.count("*").alias("n"), F.count("secs_since_prev").alias("n_timed"))
    return by.withColumn("pct_timed", F.when(F.col("n") == 0, 0.0).otherwise(F.round(100.0 * F.col("n_timed") / F.col("n"), 2))).withColumn("trainable", F.col("n_timed") >= least)


def history(passages: DataFrame, as_of: str, hours: int) -> DataFrame:
    """Of the last hours, per line: passages and mean leg minutes (null without any)."""
    end = F.lit(as_of).cast("timestamp_ntz")
    recent = passages.filter((F.col("ts") >= end - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("ts") <= end))
    return recent.groupBy("line_id").agg(F.count("*").alias("n"), F.round(F.avg("secs_since_prev") / 60, 6).alias("mean_leg_min"))


def dashboard(lines: DataFrame, stops: DataFrame, links: DataFrame, fares: DataFrame, pois: DataFrame, as_of: str) -> DataFrame:
    """One row of counts; each is a scan of one narrow column."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    week = F.lit(as_of).cast("date") - F.expr("INTERVAL 7 DAYS")
    parts = [one(lines, "n_lines"), one(stops, "n_stops"), one(stops.join(links, "stop_id", "left_anti"), "n_stops_unlinked"), one(fares.filter((F.col("valid_from") >= week) & (F.col("valid_from") <= F.lit(as_of).cast("date"))), "n_new_fares"), one(pois, "n_pois")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))
    return out


def vehicle_status(pings: DataFrame, as_of: str, active_s: int, recent_s: int) -> DataFrame:
    """The latest ping of each vehicle with its state by age: active, no_signal, or gone."""
    age = F.timestamp_diff("SECOND", F.col("ts"), F.lit(as_of).cast("timestamp_ntz")) if hasattr(F, "timestamp_diff") else F.expr(f"timestampdiff(SECOND, ts, TIMESTAMP_NTZ '{as_of}')")
    return pings.withColumn("age_s", age).withColumn("status", F.when(F.col("age_s") <= active_s, "active").when(F.col("age_s") <= recent_s, "no_signal").otherwise("gone"))


def status_histogram(vehicles: DataFrame) -> DataFrame:
    return vehicles.groupBy("line_id").agg(F.count_if(F.col("status") == "active").alias("n_active"), F.count_if(F.col("status") == "no_signal").alias("n_no_signal"))


def table_sizes(spark: SparkSession, paths: dict[str, str], most: int = 10) -> DataFrame:
    """Tables by their number of rows, the largest first; row counts come from file footers."""
    out = None
    for name, path in sorted(paths.items()):
        one = spark.read.parquet(path).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("n_rows"), "table_name").limit(most)
