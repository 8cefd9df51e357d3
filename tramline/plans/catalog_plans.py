"""Catalog reads: modes, lines, directions, itineraries, stops, fares, points of interest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions import geo
from tramline.operators import catalog, stats
from tramline.plans.registry import query
from tramline.sources.tables import itineraries, prelude, view

AS_OF = "1998-06-01"
SORTS = {"prioridade": "priority", "ordemParada": "stop_order", "nome": "name", "categoria": "category"}


@query(prelude("mode") + "SELECT mode_id, name FROM mode")
def modes(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "mode").orderBy("name")


@query(
    prelude("line") + "SELECT line_id, code, name, total, CAST(ceil(total / 4.0) AS BIGINT) AS pages FROM (SELECT *, count(*) OVER () AS total FROM line"
    " WHERE name ILIKE '%nation_1%' OR code ILIKE '%nation_1%') AS t ORDER BY name, line_id LIMIT 4 OFFSET 4"
)
def lines_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.search(view(spark, sf, "line"), " nation_1 ", "name", "code").select("line_id", "code", "name")
    return catalog.page(rows, [F.asc("name"), F.asc("line_id")], 2, 4)


@query(prelude("line") + "SELECT line_id, code, name, mode_id, route_type FROM line WHERE mode_id = 2 AND route_type = 'brt'")
def lines_narrowed(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.narrow(view(spark, sf, "line"), mode_id=2, route_type="brt", code=None)


@query(prelude("line") + "SELECT line_id, code, name FROM line WHERE line_id = 7")
def line_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.by_key(view(spark, sf, "line"), "line_id", 7).select("line_id", "code", "name")


@query(prelude("line") + "SELECT line_id, name FROM line WHERE line_id = 12 UNION ALL SELECT line_id, name FROM line WHERE name ILIKE '%ION_2%'")
def lines_by_id_or_name(spark: SparkSession, sf: str) -> DataFrame:
    lines = view(spark, sf, "line").select("line_id", "name")
    return catalog.by_id_or_name(lines, "12", "line_id", "name").unionByName(catalog.by_id_or_name(lines, "ion_2", "line_id", "name"))


@query(
    prelude("direction", "line", "mode") + "SELECT direction_id, d.name, l.code, m.name AS mode FROM direction d JOIN line l ON d.line_id = l.line_id JOIN mode m ON m.mode_id = l.mode_id"
)
def directions_by_mode(spark: SparkSession, sf: str) -> DataFrame:
    lines, modes_ = view(spark, sf, "line"), view(spark, sf, "mode").withColumnRenamed("name", "mode")
    return view(spark, sf, "direction").join(lines.select("line_id", "code", "mode_id"), "line_id").join(modes_, "mode_id").select("direction_id", "name", "code", "mode")


@query(prelude("itinerary_stop", "line") + "SELECT DISTINCT l.line_id, l.code, l.name FROM line l JOIN itinerary_stop s ON s.line_id = l.line_id WHERE s.stop_id = 7")
def lines_by_stop(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.lines_by_stop(view(spark, sf, "itinerary_stop"), view(spark, sf, "line"), 7)


@query(
    prelude("itinerary_stop", "direction", "line") + "SELECT stop_id, code, string_agg(DISTINCT d.name, ';' ORDER BY d.name) AS directions, count(DISTINCT i.itinerary_id) AS n_directions"
    " FROM itinerary_stop i JOIN direction d ON d.direction_id = i.itinerary_id JOIN line l ON l.line_id = i.line_id GROUP BY stop_id, code"
)
def stop_lines(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.stop_lines(view(spark, sf, "itinerary_stop"), view(spark, sf, "direction").select("direction_id", "name"), view(spark, sf, "line"))


@query(
    prelude("itinerary_stop", "direction") + "SELECT direction_id AS itinerary_id, d.line_id, name, count(i.stop_id) AS n_stops FROM direction d LEFT JOIN"
    " (SELECT * FROM itinerary_stop WHERE line_id % 4 <> 1) i ON i.itinerary_id = d.direction_id GROUP BY ALL"
)
def itinerary_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Itineraries of every fourth line have no stops here, so that zeros show."""
    return catalog.itinerary_counts(view(spark, sf, "direction"), view(spark, sf, "itinerary_stop").filter("line_id % 4 <> 1"))


_FARE_AT = (
    f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY valid_from DESC, fare_id DESC) AS rn FROM fare WHERE valid_from <= DATE '{AS_OF}'"
    f" AND (valid_to IS NULL OR valid_to >= DATE '{AS_OF}')) AS f WHERE rn = 1)"
)


@query(prelude("fare") + f"SELECT fare_id, line_id, value, valid_from, valid_to, source, active FROM {_FARE_AT} AS x")
def fare_at(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.fare_at(view(spark, sf, "fare"), AS_OF)


@query(
    prelude("line", "direction", "itinerary_stop", "fare") + "SELECT l.line_id, l.code, l.name, d.directions, coalesce(s.n_stops, 0) AS n_stops, f.value FROM line l"
    " LEFT JOIN (SELECT line_id, string_agg(name, ';' ORDER BY name) AS directions FROM direction GROUP BY line_id) d ON d.line_id = l.line_id"
    " LEFT JOIN (SELECT line_id, count(DISTINCT stop_id) AS n_stops FROM itinerary_stop GROUP BY line_id) s ON s.line_id = l.line_id"
    f" LEFT JOIN {_FARE_AT} f ON f.line_id = l.line_id"
)
def line_details(spark: SparkSession, sf: str) -> DataFrame:
    """Header, directions, number of stops and the fare now valid, for every line at once."""
    d = view(spark, sf, "direction").groupBy("line_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ";").alias("directions"))
    counts = catalog.line_counts(view(spark, sf, "line"), view(spark, sf, "direction"), view(spark, sf, "itinerary_stop")).select("line_id", "n_stops")
    fares = catalog.fare_at(view(spark, sf, "fare"), AS_OF).select("line_id", "value")
    return view(spark, sf, "line").select("line_id", "code", "name").join(d, "line_id", "left").join(counts, "line_id").join(fares, "line_id", "left")


@query(
    prelude("fare") + "SELECT fare_id, line_id, value, valid_from, total, CAST(ceil(total / 20.0) AS BIGINT) AS pages FROM (SELECT *, count(*) OVER () AS total FROM fare WHERE active) AS t"
    " ORDER BY valid_from DESC, fare_id LIMIT 20 OFFSET 40"
)
def fares_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "fare").filter("active").select("fare_id", "line_id", "value", "valid_from")
    return catalog.page(rows, [F.desc("valid_from"), F.asc("fare_id")], 3, 20)


@query(
    prelude("line", "direction", "itinerary_stop") + "SELECT l.line_id, l.code, (SELECT count(DISTINCT direction_id) FROM direction d WHERE d.line_id = l.line_id) AS n_directions,"
    " (SELECT count(DISTINCT stop_id) FROM itinerary_stop s WHERE s.line_id = l.line_id) AS n_stops FROM line l"
)
def line_counts(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.line_counts(view(spark, sf, "line"), view(spark, sf, "direction"), view(spark, sf, "itinerary_stop"))


@query(prelude("poi", "poi_stop") + "SELECT poi_id, name FROM poi p WHERE EXISTS (SELECT 1 FROM poi_stop s WHERE s.poi_id = p.poi_id)")
def pois_with_stops(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.with_links(view(spark, sf, "poi"), view(spark, sf, "poi_stop"), "poi_id").select("poi_id", "name")


@query(prelude("stop", "poi_stop") + "SELECT stop_id, name FROM stop p WHERE NOT EXISTS (SELECT 1 FROM poi_stop s WHERE s.stop_id = p.stop_id AND s.poi_id % 3 = 0)")
def stops_without_pois(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.without_links(view(spark, sf, "stop"), view(spark, sf, "poi_stop").filter("poi_id % 3 = 0"), "stop_id").select("stop_id", "name")


@query(
    prelude("poi", "poi_stop", "itinerary_stop") + "SELECT p.poi_id, p.name, p.category, p.priority, min(i.seq) AS stop_order FROM poi p JOIN poi_stop s ON s.poi_id = p.poi_id"
    " JOIN itinerary_stop i ON i.stop_id = s.stop_id WHERE i.itinerary_id = 4 GROUP BY ALL"
)
def pois_by_itinerary(spark: SparkSession, sf: str) -> DataFrame:
    found = catalog.pois_of_itinerary(view(spark, sf, "poi"), view(spark, sf, "poi_stop"), view(spark, sf, "itinerary_stop"), 4)
    return found.orderBy(*catalog.sort_columns("-prioridade,nome", SORTS, "ordemParada"), "poi_id")


@query(
    prelude("poi", "poi_stop", "itinerary_stop") + "SELECT poi_id, name, priority, stop_order, total, CAST(ceil(total / 10.0) AS BIGINT) AS pages FROM (SELECT *, count(*) OVER () AS total FROM"
    " (SELECT p.poi_id, p.name, p.priority, min(i.seq) AS stop_order FROM poi p JOIN poi_stop s ON s.poi_id = p.poi_id JOIN itinerary_stop i ON i.stop_id = s.stop_id"
    " WHERE i.line_id = 2 GROUP BY ALL) AS g) AS t ORDER BY stop_order, priority, poi_id LIMIT 10"
)
def pois_page_sorted_inside(spark: SparkSession, sf: str) -> DataFrame:
    """The wanted order applies within the page, after it is cut."""
    own = view(spark, sf, "itinerary_stop").filter("line_id = 2").select("stop_id", "seq")
    first = view(spark, sf, "poi_stop").join(own, "stop_id").groupBy("poi_id").agg(F.min("seq").alias("stop_order"))
    rows = view(spark, sf, "poi").join(first, "poi_id").select("poi_id", "name", "priority", "stop_order")
    cut = catalog.page(rows, [F.asc("stop_order"), F.asc("priority"), F.asc("poi_id")], 1, 10)
    return cut.orderBy(*catalog.sort_columns("nome,bogus", {"nome": "name", "prioridade": "priority"}, "prioridade"))


@query(
    prelude("direction", "itinerary_stop", "poi_stop") + "SELECT direction_id AS itinerary_id, name, CAST(coalesce(n, 0) AS BIGINT) AS total_pois FROM direction d LEFT JOIN"
    " (SELECT i.itinerary_id, count(*) AS n FROM itinerary_stop i JOIN poi_stop s ON s.stop_id = i.stop_id GROUP BY 1) x ON x.itinerary_id = d.direction_id"
)
def poi_counts(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.poi_counts(view(spark, sf, "direction"), view(spark, sf, "itinerary_stop"), view(spark, sf, "poi_stop"))


@query(prelude("poi") + "SELECT category, count(*) AS n FROM poi WHERE name LIKE '%ring%' AND contains(lower(category), 'eco') GROUP BY category")
def pois_by_category(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "poi").filter(F.col("name").like("%ring%") & F.lower("category").contains("eco"))
    return p.groupBy("category").agg(F.count("*").alias("n"))


@query(
    prelude("vertex", "itinerary_stop") + "SELECT v.itinerary_id, v.line_id, v.vertices, s.stops FROM (SELECT itinerary_id, line_id, string_agg((idx + 1) || ':' || CAST(round(lat * 1000000) AS BIGINT) || ':'"
    " || CAST(round(lon * 1000000) AS BIGINT), ';' ORDER BY idx) AS vertices FROM vertex GROUP BY ALL) v"
    " LEFT JOIN (SELECT itinerary_id, string_agg(stop_id::VARCHAR, ',' ORDER BY seq) AS stops FROM itinerary_stop GROUP BY 1) s ON s.itinerary_id = v.itinerary_id"
)
def itinerary_map(spark: SparkSession, sf: str) -> DataFrame:
    m = catalog.itinerary_map(itineraries(spark, sf), view(spark, sf, "itinerary_stop"))
    micro = lambda c: F.round(c * 1000000).cast("long").cast("string")
    flat = F.array_join(F.transform("vertices", lambda p: F.concat_ws(":", p["ord"].cast("string"), micro(p["lat"]), micro(p["lon"]))), ";")
    return m.select("itinerary_id", "line_id", flat.alias("vertices"), F.array_join(F.transform("stops", lambda s: s["stop_id"].cast("string")), ",").alias("stops"))


@query(
    prelude("vertex") + "SELECT itinerary_id, '{\"type\":\"LineString\",\"coordinates\":[' || string_agg('[' || round(lon, 9) || ',' || round(lat, 9) || ']', ',' ORDER BY idx) || ']}' AS geojson"
    " FROM vertex GROUP BY itinerary_id"
)
def itinerary_geojson(spark: SparkSession, sf: str) -> DataFrame:
    return itineraries(spark, sf).select("itinerary_id", geo.geojson(F.col("vertices")).alias("geojson"))


@query(prelude("passage") + "SELECT line_id, count(*) AS n, count(secs_since_prev) AS n_timed, round(100.0e0 * count(secs_since_prev) / count(*), 2) AS pct_timed, count(secs_since_prev) >= 50 AS trainable FROM passage GROUP BY line_id")
def training_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.training_stats(view(spark, sf, "passage"), 50)


@query(
    prelude("passage") + "SELECT line_id, count(*) AS n, round(avg(secs_since_prev) / 60, 6) AS mean_leg_min FROM passage WHERE ts >= TIMESTAMP '1998-06-01' - INTERVAL 240 HOURS"
    " AND ts <= TIMESTAMP '1998-06-01' GROUP BY line_id"
)
def passage_history(spark: SparkSession, sf: str) -> DataFrame:
    return stats.history(view(spark, sf, "passage"), "1998-06-01", 240)


@query(
    prelude("line", "stop", "itinerary_stop", "fare", "poi") + "SELECT (SELECT count(*) FROM line) AS n_lines, (SELECT count(*) FROM stop) AS n_stops,"
    " (SELECT count(*) FROM stop s WHERE NOT EXISTS (SELECT 1 FROM itinerary_stop i WHERE i.stop_id = s.stop_id AND i.line_id < 20)) AS n_stops_unlinked,"
    " (SELECT count(*) FROM fare WHERE valid_from >= DATE '1998-05-25' AND valid_from <= DATE '1998-06-01') AS n_new_fares, (SELECT count(*) FROM poi) AS n_pois"
)
def dashboard(spark: SparkSession, sf: str) -> DataFrame:
    links = view(spark, sf, "itinerary_stop").filter("line_id < 20")
    return stats.dashboard(view(spark, sf, "line"), view(spark, sf, "stop"), links, view(spark, sf, "fare"), view(spark, sf, "poi"), AS_OF)


_SIZED = ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _SIZED) + ") AS t ORDER BY n_rows DESC, table_name LIMIT 5")
def table_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return stats.table_sizes(spark, {t: f"{sf}/{t}.parquet" for t in _SIZED}, 5)
