"""Read queries over the catalog: pages, searches, details, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class InvalidRequest(ValueError):
    """A page, size, radius or coordinate out of its bounds."""


class NotFound(LookupError):
    """A key that no row has."""


def check_page(page: int, size: int, most: int) -> None:
    if page < 1 or size < 1 or size > most:
        raise InvalidRequest(f"page from 1, size from 1 to {most}")


def check_point(lat: float, lon: float, radius: float, most: float) -> None:
    if not (-90 <= lat <= 90 and -180 <= lon <= 180 and 0 < radius <= most):
        raise InvalidRequest(f"latitude, longitude, or radius over {most}")


def page(rows: DataFrame, order: list[Column], number: int, size: int, most: int = 100) -> DataFrame:
    """One page of ``rows`` in a total order, with ``total`` and ``pages``.

    Filter and order run once for the page (a top-k) and once for the count; give the key last in
    ``order`` so that pages don't overlap.  Deep offsets cost a sort of all rows before them.
    """
    check_page(number, size, most)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).join(F.broadcast(envelope(rows, size)))


def envelope(rows: DataFrame, size: int) -> DataFrame:
    """``total`` and ``pages`` in one row, whatever page is asked for: a page beyond the last has no rows to carry them."""
    return rows.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))


def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.filter(F.col(key) == value).limit(1)


def exists(rows: DataFrame, key: str, value) -> bool:
    return not by_key(rows, key, value).isEmpty()


def exist(asked: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``asked`` with found: whether ``rows`` has its key; one join for all of them."""
    return asked.join(rows.select(key).distinct().withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def search(rows: DataFrame, text: str | None, *columns: str) -> DataFrame:
    """Case-insensitive contains in any column; wildcards in the text are live; blank finds all."""
    if not text or not text.strip():
        return rows
    test = F.lit(False)
    for c in columns:
        test = test | F.col(c).ilike(f"%{text.strip()}%")
    return rows.filter(test)


def narrow(rows: DataFrame, **wanted) -> DataFrame:
    """Equality filters for those parameters that are given."""
    for c, v in wanted.items():
        if v is not None:
            rows = rows.filter(F.col(c) == v)
    return rows


def by_id_or_name(rows: DataFrame, value: str, id_col: str, name_col: str) -> DataFrame:
    """A value that parses as an id filters by id, any other by name."""
    return rows.filter(F.col(id_col) == int(value)) if value.strip().isdigit() else search(rows, value, name_col)


def sort_columns(spec: str | None, fields: dict[str, str], default: str) -> list[Column]:
    """A comma list of fields, ``-`` for descending; unknown ones mean the default."""
    parts = [p.strip() for p in (spec or "").split(",") if p.strip()] or [default]
    out = []
    for p in parts:
        name = fields.get(p.lstrip("-"), fields[default.lstrip("-")])
        out.append(F.desc(name) if p.startswith("-") else F.asc(name))
    return out


def lines_by_stop(links: DataFrame, lines: DataFrame, stop_id) -> DataFrame:
    at = links.filter(F.col("stop_id") == stop_id).select("line_id").distinct()
    return lines.join(at, "line_id", "left_semi").select("line_id", "code", "name")


def stop_lines(links: DataFrame, directions: DataFrame, lines: DataFrame) -> DataFrame:
    """Per stop and line its directions as a sorted list, and how many distinct ones."""
    rows = links.join(directions.select(F.col("direction_id").alias("itinerary_id"), F.col("name").alias("direction")), "itinerary_id").join(lines.select("line_id", "code"), "line_id")
    return rows.groupBy("stop_id", "code").agg(F.array_join(F.array_sort(F.collect_set("direction")), ";").alias("directions"), F.count_distinct("itinerary_id").alias("n_directions"))


def itinerary_counts(directions: DataFrame, links: DataFrame) -> DataFrame:
    """Every itinerary with its number of stops, 0 where it has none: aggregated before the join."""
    n = links.groupBy("itinerary_id").agg(F.count("*").alias("n_stops"))
    return directions.select(F.col("direction_id").alias("itinerary_id"), "line_id", "name").join(n, "itinerary_id", "left").withColumn("n_stops", F.coalesce("n_stops", F.lit(0).cast("long")))


def fare_at(fares: DataFrame, as_of: str, key: str = "line_id") -> DataFrame:
    """The fare of each line that is valid at a date (ends inclusive), the latest begun; ties by id."""
    at = F.lit(as_of).cast("date")
    ok = fares.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") >= at)))
    w = Window.partitionBy(key).orderBy(F.desc("valid_from"), F.desc("fare_id"))
    return ok.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def line_counts(lines: DataFrame, directions: DataFrame, links: DataFrame) -> DataFrame:
    d = directions.groupBy("line_id").agg(F.count_distinct("direction_id").alias("n_directions"))
    s = links.groupBy("line_id").agg(F.count_distinct("stop_id").alias("n_stops"))
    out = lines.select("line_id", "code").join(d, "line_id", "left").join(s, "line_id", "left")
    return out.select("line_id", "code", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_directions", "n_stops")))


def with_links(rows: DataFrame, links: DataFrame, key: str) -> DataFrame:
    return rows.join(links.select(key), key, "left_semi")


def without_links(rows: DataFrame, links: DataFrame, key: str) -> DataFrame:
    return rows.join(links.select(key), key, "left_anti")


def pois_of_itinerary(pois: DataFrame, poi_stops: DataFrame, links: DataFrame, itinerary_id) -> DataFrame:
    """POIs at an itinerary's stops with the first stop's place in the order."""
    own = links.filter(F.col("itinerary_id") == itinerary_id).select("stop_id", "seq")
    first = poi_stops.join(own, "stop_id").groupBy("poi_id").agg(F.min("seq").alias("stop_order"))
    return pois.join(first, "poi_id").select("poi_id", "name", "category", "priority", "stop_order")


def poi_counts(directions: DataFrame, links: DataFrame, poi_stops: DataFrame) -> DataFrame:
    """POIs by itinerary: the sum over its stops, a stop that comes twice counting twice."""
    n = poi_stops.groupBy("stop_id").agg(F.count("*").alias("n"))
    per = links.join(n, "stop_id").groupBy("itinerary_id").agg(F.sum("n").alias("total_pois"))
    return directions.select(F.col("direction_id").alias("itinerary_id"), "name").join(per, "itinerary_id", "left").withColumn("total_pois", F.coalesce("total_pois", F.lit(0).cast("long")))


def itinerary_map(itineraries: DataFrame, links: DataFrame) -> DataFrame:
    """Each itinerary with its vertices (from 1) and its stops in order, as arrays of structs."""
    stops = links.groupBy("itinerary_id").agg(F.array_sort(F.collect_list(F.struct("seq", "stop_id", "fraction"))).alias("stops"))
    numbered = F.transform("vertices", lambda p, i: F.struct((i + 1).alias("ord"), p["lat"].alias("lat"), p["lon"].alias("lon")))
    return itineraries.select("itinerary_id", "line_id", numbered.alias("vertices")).join(stops, "itinerary_id", "left")
