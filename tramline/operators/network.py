"""Network-wide reads: nested existence, totals over groups, line index, terminals, legs both ways, cycle counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tramline.operators import trains


def with_linked(parents: DataFrame, relations: DataFrame, children: DataFrame, parent: str, child: str) -> DataFrame:
    """Parents that have a relation whose child exists in ``children``: one existence inside another."""
    return parents.join(relations.join(children.select(child), child, "left_semi").select(parent), parent, "left_semi")


def with_total(groups: DataFrame, count: str, total: str = "total") -> DataFrame:
    """Grouped rows with the sum over all groups and their number; an empty input stays empty."""
    whole = groups.agg(F.coalesce(F.sum(count), F.lit(0)).alias(total), F.count("*").alias("n_groups"))
    return groups.crossJoin(F.broadcast(whole))  # one row


def union_pings(*feeds: DataFrame) -> DataFrame:
    """The feeds' pings in one bag; a column that a feed lacks is null there."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def line_index(cycle: DataFrame, held: DataFrame, alive: DataFrame) -> DataFrame:
    """The vehicles of each line after a cycle: those seen, and those held before that are alive and did not change line.

    All have vehicle_id and line_code but ``alive`` (vehicle_id); codes compare without case.  Vehicles come
    as one sorted, comma-joined string a line.
    """
    code = F.upper(F.trim("line_code"))
    now = cycle.select("vehicle_id", code.alias("line_code"))
    moved = held.select("vehicle_id", code.alias("line_code")).join(now.select("vehicle_id", F.col("line_code").alias("new")), "vehicle_id").filter("new <> line_code").select("vehicle_id")
    still = held.select("vehicle_id", code.alias("line_code")).join(alive.select("vehicle_id"), "vehicle_id", "left_semi").join(moved, "vehicle_id", "left_anti")
    both = now.unionByName(still).distinct()
    return both.groupBy("line_code").agg(F.array_join(F.array_sort(F.collect_set(F.col("vehicle_id").cast("string"))), ",").alias("vehicles"), F.count("*").alias("n"))


def index_members(index: DataFrame) -> DataFrame:
    """The line index taken apart again: one row for each line and vehicle, blanks left out."""
    each = F.explode(F.filter(F.transform(F.split("vehicles", ","), lambda v: F.trim(v)), lambda v: v != ""))
    return index.select("line_code", each.alias("vehicle_id"))


def terminals(stations: DataFrame, none: int = 999) -> DataFrame:
    """First and last station of each branch by weight (branch, weight, station); a station without weight counts as ``none``, ties go by name."""
    at = F.struct(F.coalesce("weight", F.lit(none)).alias("w"), F.col("station").alias("s"))
    ends = stations.groupBy("branch").agg(F.min(at).alias("a"), F.max(at).alias("b"))
    return ends.select("branch", F.col("a.s").alias("origin"), F.col("b.s").alias("destination"))


def legs_both_ways(stations: DataFrame, back_first_s: str | None = None, dwell_s: float = 20.0) -> DataFrame:
    """Leg times of every branch out (way 0) and back (way 1): the way back runs the stations in reverse.

    Its timetable is the column ``back_first_s``; without one its legs are timed by distance.
    """
    out = trains.leg_times(stations, dwell_s).withColumn("way", F.lit(0))
    last = F.max("ord").over(Window.partitionBy("branch"))
    first = F.col(back_first_s) if back_first_s else F.lit(None).cast("double")
    turned = stations.withColumn("turned", last + 1 - F.col("ord")).withColumn("first_s", first).withColumn("ord", F.col("turned"))
    return out.unionByName(trains.leg_times(turned.drop("turned"), dwell_s).withColumn("way", F.lit(1)))


def stations_both_ways(stations: DataFrame, back_first_s: str) -> DataFrame:
    """Stations of every branch out (``branch>``) and back (``branch<``), each way a branch of its own, so that all of ``trains`` runs both.

    ``back_first_s`` has the first departures of the way back.
    """
    last = F.max("ord").over(Window.partitionBy("branch"))
    back = stations.withColumn("turned", last + 1 - F.col("ord")).withColumn("first_s", F.col(back_first_s)).withColumn("ord", F.col("turned")).withColumn("branch", F.concat("branch", F.lit("<")))
    return stations.withColumn("branch", F.concat("branch", F.lit(">"))).unionByName(back.drop("turned"))


def itinerary_stop_counts(lines: DataFrame, directions: DataFrame, itineraries: DataFrame, links: DataFrame) -> DataFrame:
    """(line_id, itineraries): for every line its itineraries' directions and numbers of stops, in order; an itinerary without stops counts 0."""
    n = links.groupBy("itinerary_id").agg(F.count_distinct("stop_id").alias("n_stops"))
    each = itineraries.join(directions.select("direction_id", "line_id", "name"), "direction_id").join(n, "itinerary_id", "left")
    one = F.struct("name", "itinerary_id", F.coalesce("n_stops", F.lit(0)).alias("n_stops"))
    return lines.select("line_id").join(each.groupBy("line_id").agg(F.array_sort(F.collect_list(one)).alias("itineraries")), "line_id", "left")


def cycle_counters(pings: DataFrame, as_of: str, most_s: int = 300, stale_s: int = 60, last_ts: str | None = None) -> list:
    """Counts of a cycle as aggregates: seen, valid (with coordinates), dropped for age, stale; and, with a column of the
    vehicles' stored times, fresh: not too old and newer than what is stored."""
    age = F.expr(f"timestampdiff(SECOND, ts, TIMESTAMP_NTZ '{as_of}')")
    valid = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    fresh = [F.count_if(valid & (age <= most_s) & (F.col(last_ts).isNull() | (F.col("ts") > F.col(last_ts)))).alias("fresh")] if last_ts else []
    return [*fresh, F.count("*").alias("seen"), F.count_if(valid).alias("valid"), F.count_if(valid & (age > most_s)).alias("age_dropped"), F.count_if(valid & (age <= most_s) & (age > stale_s)).alias("stale")]


def observed(pings: DataFrame, as_of: str, name: str = "cycle", **limits: int) -> tuple[DataFrame, Observation]:
    """``pings`` as they are, and an observation that holds the counters once something has run over them."""
    o = Observation(name)
    return pings.observe(o, *cycle_counters(pings, as_of, **limits)), o
