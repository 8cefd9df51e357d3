"""Timetable-driven trains: leg times, timelines, positions at an instant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOWEST, FASTEST, USUAL = 8.0, 110.0, 45.0


def parse_timetable(lines: DataFrame, line_col: str = "value", order_col: str = "n") -> DataFrame:
    """Header lines ``<station> - Sentido <direction>`` and ``Primeiro Trem: 4h10`` to (station, direction, secs).

    The header carries forward; the first entry of a key wins; hours are taken modulo 24.
    """
    head = F.regexp_extract(line_col, r"^(.+?) - Sentido (.+)$", 1)
    way = F.regexp_extract(line_col, r"^(.+?) - Sentido (.+)$", 2)
    w = Window.orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)  # a timetable is a small text file
    rows = lines.withColumn("station", F.last(F.when(head != "", head), ignorenulls=True).over(w)).withColumn("direction", F.last(F.when(way != "", way), ignorenulls=True).over(w))
    first = rows.filter(F.col(line_col).startswith("Primeiro Trem:"))
    body = F.split_part(F.col(line_col), F.lit("("), F.lit(1))
    times = F.transform(F.regexp_extract_all(body, F.lit(r"(\d{1,2}h(?:\d{2})?)")), lambda t: (F.split_part(t, F.lit("h"), F.lit(1)).cast("int") % 24) * 3600 + F.coalesce(F.split_part(t, F.lit("h"), F.lit(2)).try_cast("int"), F.lit(0)) * 60)
    return first.groupBy("station", "direction").agg(F.min_by(F.array_min(times), order_col).alias("secs"))


def leg_times(stations: DataFrame, dwell_s: float = 20.0) -> DataFrame:
    """Legs of each branch in order: timetable difference less the dwell where that is 20 to 3600 s, else by distance.

    Stations: branch, ord, km, first_s (first departure, null if unknown).
    """
    w = Window.partitionBy("branch").orderBy("ord")
    legs = stations.withColumn("to_ord", F.lead("ord").over(w)).withColumn("to_km", F.lead("km").over(w)).withColumn("to_s", F.lead("first_s").over(w)).filter("to_ord IS NOT NULL")
    table = F.pmod(F.col("to_s") - F.col("first_s") + 86400, F.lit(86400)) - dwell_s
    usual = F.abs(F.col("to_km") - F.col("km")) / USUAL * 3600
    return legs.select("branch", "ord", "to_ord", F.when(table.between(20, 3600), table.cast("double")).otherwise(usual).alias("secs"))


def timeline(legs: DataFrame, stations: DataFrame, dwell_s: float = 20.0) -> DataFrame:
    """Each leg's dwell and move as offsets from the departure; terminals dwell at least a minute."""
    w = Window.partitionBy("branch").orderBy("ord")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    ends = F.greatest(F.lit(3 * dwell_s), F.lit(60.0))
    d = F.when(F.row_number().over(w) == 1, ends).otherwise(F.lit(dwell_s))
    rows = legs.withColumn("dwell", d).withColumn("total", F.col("dwell") + F.col("secs"))
    rows = rows.withColumn("begins", F.coalesce(F.sum("total").over(before), F.lit(0.0))).withColumn("leaves", F.col("begins") + F.col("dwell")).withColumn("arrives", F.col("begins") + F.col("total"))
    a = stations.select("branch", "ord", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.col("km").alias("a_km"))
    b = stations.select("branch", F.col("ord").alias("to_ord"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), F.col("km").alias("b_km"))
    return rows.join(a, ["branch", "ord"]).join(b, ["branch", "to_ord"])


def headway(second_of_day: int, peak_min: float, off_min: float, peaks: tuple[tuple[int, int], ...]) -> float:
    """Seconds between trains; peak windows include both ends."""
    return 60 * (peak_min if any(a <= second_of_day <= b for a, b in peaks) else off_min)


def positions(lines: DataFrame, second_of_day: int, every_s: float, opens: int = 4 * 3600, most: int = 40) -> DataFrame:
    """Trains under way: the last ``most`` departures since opening against the timeline's intervals.

    No trains before the opening.  A train dwells or moves linearly between two stations; speeds
    are kept within what trains run.
    """
    n = int((second_of_day - opens) // every_s) if second_of_day >= opens else -1
    first = max(0, n - most + 1)
    trips = lines.sparkSession.range(first, n + 1).withColumnRenamed("id", "train") if n >= 0 else lines.sparkSession.range(0).withColumnRenamed("id", "train")
    rode = F.lit(float(second_of_day - opens)) - F.col("train") * every_s
    rows = lines.join(F.broadcast(trips.withColumn("rode", rode)), (F.col("rode") >= F.col("begins")) & (F.col("rode") < F.col("arrives")))
    share = F.greatest(F.lit(0.0), (F.col("rode") - F.col("leaves")) / F.col("secs"))
    kmh = F.when(F.col("rode") < F.col("leaves"), 0.0).otherwise(F.greatest(F.lit(SLOWEST), F.least(F.lit(FASTEST), F.abs(F.col("b_km") - F.col("a_km")) / F.col("secs") * 3600)))
    return rows.select(
        "branch", "train", F.concat("branch", F.lit("-"), F.format_string("%03d", "train")).alias("vehicle_id"), "ord",
        (F.col("a_lat") + share * (F.col("b_lat") - F.col("a_lat"))).alias("lat"), (F.col("a_lon") + share * (F.col("b_lon") - F.col("a_lon"))).alias("lon"), kmh.alias("speed"),
    )
