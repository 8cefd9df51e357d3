"""Landed payloads to catalog rows.  The payloads are written from the generic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.operators import ingest
from tramline.plans.registry import query
from tramline.sources.tables import itineraries, prelude, view


@query(
    prelude("direction") + "SELECT 'D' || direction_id AS code, name AS destination, CASE d WHEN 0 THEN '0' ELSE '1' END AS direction, 'regular' AS route_type, 's' || direction_id AS shape_id,"
    " direction_id + 0.5e0 AS length_m FROM direction WHERE direction_id % 7 <> 0"
)
def parsed_routes(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("direction_id")
    a = F.struct(
        F.concat(F.lit(" d"), i).alias("servico"), F.concat("name", F.lit(" ")).alias("destino"), F.col("d").cast("string").alias("direcao"), F.lit("Regular").alias("tipo_rota"),
        F.when(i % 7 == 0, " ").otherwise(F.concat(F.lit("s"), i)).alias("shape_id"), F.concat(i, F.lit(",5")).alias("extensao"),
    )
    page = view(spark, sf, "direction").select(F.to_json(F.struct(F.array(F.struct(a.alias("attributes"))).alias("features"))).alias("json"))
    return ingest.parse_routes(page, "json").drop("consortium")


@query(prelude("stop") + "SELECT code, name, round(lon, 9) AS lon, round(lat, 9) AS lat FROM stop WHERE stop_id % 10 <> 3")
def parsed_stops(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("stop_id") % 10 == 3, "Polygon").otherwise("Point")
    f = F.struct(F.struct(kind.alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct(F.col("code").alias("stop_id"), F.concat(F.lit(" "), F.col("name")).alias("stop_name")).alias("properties"))
    page = view(spark, sf, "stop").select(F.to_json(F.struct(F.array(f).alias("features"))).alias("json"))
    return ingest.parse_stops(page, "json").select("code", "name", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


@query(prelude("vertex") + "SELECT itinerary_id, CASE WHEN itinerary_id % 5 <> 0 THEN 21 END AS n_vertices, CASE WHEN itinerary_id % 5 <> 0 THEN round(max(lon) FILTER (idx = 20), 9) END AS last_lon FROM vertex GROUP BY itinerary_id")
def parsed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line strings; one of a single point is none."""
    v = F.when(F.col("itinerary_id") % 5 == 0, F.slice("vertices", 1, 1)).otherwise(F.col("vertices"))
    raw = itineraries(spark, sf).select("itinerary_id", F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(v, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))).alias("json"))
    return ingest.parse_line(raw, "json").select("itinerary_id", F.when(F.col("vertices").isNotNull(), F.size("vertices")).alias("n_vertices"), F.round(F.element_at("vertices", -1)["lon"], 9).alias("last_lon"))


@query(
    prelude("poi") + """, tagged AS (SELECT poi_id, lat, lon, CASE poi_id % 5 WHEN 0 THEN 'Hospital ' WHEN 1 THEN 'Praça ' WHEN 2 THEN 'Plaza ' WHEN 3 THEN 'P' ELSE 'Loja ' END || CASE WHEN poi_id % 5 = 3 THEN '' ELSE name END AS name FROM poi)
SELECT poi_id AS id, name, CASE poi_id % 5 WHEN 0 THEN 'Hospital' WHEN 1 THEN 'Parque' ELSE 'Shopping' END AS category, CASE poi_id % 5 WHEN 1 THEN 3 ELSE 1 END AS priority, round(lat, 9) AS lat, round(lon, 9) AS lon
FROM tagged WHERE (poi_id % 5 IN (0, 1, 2) OR poi_id % 5 = 4 AND contains(lower(name), 'mall')) AND poi_id % 11 <> 0"""
)
def parsed_pois(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.parse_pois(poi_elements(spark, sf), "json").select("id", "name", "category", "priority", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


def poi_elements(spark: SparkSession, sf: str) -> DataFrame:
    """Map elements: tagged, doubtful, named by a keyword only, unnamed; nodes and ways."""
    k, name = F.col("poi_id") % 5, F.col("name")
    title = F.when(k == 0, F.concat(F.lit("Hospital "), name)).when(k == 1, F.concat(F.lit("Praça "), name)).when(k == 2, F.concat(F.lit("Plaza "), name)).when(k == 3, "P").otherwise(F.concat(F.lit("Loja "), name))
    tag = F.when(k == 0, "amenity").when(k.isin(1, 3), "leisure").when(k == 4, "building").otherwise("office")
    value = F.when(k == 0, "hospital").when(k.isin(1, 3), "park").when(k == 4, "retail").otherwise("yes")
    node = F.col("poi_id") % 2 == 0
    named = F.when(F.col("poi_id") % 11 == 0, "ref").otherwise("name")
    e = F.struct(
        F.when(node, "node").otherwise("way").alias("type"), F.col("poi_id").alias("id"), F.when(node, F.col("lat")).alias("lat"), F.when(node, F.col("lon")).alias("lon"),
        F.when(~node, F.struct("lat", "lon")).alias("center"), F.create_map(tag, value, named, title).alias("tags"),
    )
    return view(spark, sf, "poi").select(F.to_json(F.struct(F.array(e).alias("elements"))).alias("json"))


@query(
    prelude("line") + "SELECT 'central ' || line_id AS station, 'central ' || line_id AS place, 1 AS step FROM line WHERE line_id % 3 = 0 UNION ALL SELECT 'alias ' || line_id, 'central ' || line_id, 2 FROM line WHERE line_id % 3 = 1"
    " UNION ALL SELECT 'central station' || line_id, 'central 0', 3 FROM line WHERE line_id % 3 = 2"
)
def matched_stations(spark: SparkSession, sf: str) -> DataFrame:
    """Exact names, aliases, and a first word that several places begin with."""
    k = F.col("line_id")
    lines = view(spark, sf, "line").select("line_id")
    name = F.when(k % 3 == 0, F.concat(F.lit("central "), k)).when(k % 3 == 1, F.concat(F.lit("alias "), k)).otherwise(F.concat(F.lit("central station"), k))
    places = lines.select(F.concat(F.lit("central "), k).alias("place"))
    aliases = lines.select(F.concat(F.lit("alias "), k).alias("station"), F.concat(F.lit("central "), k).alias("place"))
    return ingest.match_stations(lines.select(name.alias("station")), places, aliases)


@query(prelude("vertex") + "SELECT itinerary_id, CAST(count(*) AS INTEGER) AS n_vertices, true AS same FROM vertex GROUP BY itinerary_id")
def chained_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every itinerary cut into three parts, the middle one turned, and chained again."""
    v = F.col("vertices")
    parts = F.array(F.slice(v, 1, 8), F.reverse(F.slice(v, 8, 7)), F.slice(v, 14, 8))
    rows = itineraries(spark, sf).select("itinerary_id", "vertices", ingest.chained(parts).alias("whole"))
    return rows.select("itinerary_id", F.size("whole").alias("n_vertices"), (F.col("whole") == F.col("vertices")).alias("same"))
