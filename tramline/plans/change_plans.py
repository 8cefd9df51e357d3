"""Changes: what a table is after an import, an update or a deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.operators import mutate
from tramline.plans.registry import query
from tramline.sources.tables import prelude, view


def _incoming(lines: DataFrame) -> DataFrame:
    """Made-up imports: every third line in other case, every fourth renamed, and ten new ones."""
    k = F.col("line_id")
    old = lines.select("line_id", F.when(k % 4 == 0, F.concat("name", F.lit(" X"))).when(k % 3 == 0, F.lower("name")).otherwise(F.col("name")).alias("name"), "route_type").filter(k % 5 != 0)
    new = lines.filter(k < 10).select((k + 100).alias("line_id"), F.concat(F.lit("NEW"), k).alias("name"), F.lit("brt").alias("route_type"))
    return old.unionByName(new)


_INCOMING = """incoming AS (SELECT line_id, CASE WHEN line_id % 4 = 0 THEN name || ' X' WHEN line_id % 3 = 0 THEN lower(name) ELSE name END AS name, route_type FROM line WHERE line_id % 5 <> 0
UNION ALL SELECT line_id + 100, 'NEW' || line_id, 'brt' FROM line WHERE line_id < 10)"""


@query(
    prelude("line") + f""", {_INCOMING} SELECT coalesce(l.line_id, i.line_id) AS line_id, CASE WHEN l.line_id IS NULL OR lower(i.name) <> lower(l.name) THEN i.name ELSE l.name END AS name,
coalesce(l.route_type, i.route_type) AS route_type, CASE WHEN l.line_id IS NULL THEN 'insert' WHEN i.line_id IS NULL THEN 'keep' WHEN lower(i.name) <> lower(l.name) THEN 'update' ELSE 'same' END AS change
FROM line l FULL JOIN incoming i ON i.line_id = l.line_id"""
)
def upsert_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = view(spark, sf, "line").select("line_id", "name", "route_type")
    return mutate.upsert(lines, _incoming(lines), "line_id", ["name", "route_type"])


@query(prelude("stop") + "SELECT min(stop_id) AS stop_id, upper(code) AS code FROM stop WHERE stop_id % 2 = 1 GROUP BY upper(code)")
def insert_missing_stops(spark: SparkSession, sf: str) -> DataFrame:
    """Of incoming stops (each comes twice, in two cases) those whose code is not stored."""
    stops = view(spark, sf, "stop").select("stop_id", "code")
    twice = stops.unionByName(stops.select((F.col("stop_id") + 10_000_000).alias("stop_id"), F.lower("code").alias("code")))
    out = mutate.insert_missing(stops.filter("stop_id % 2 = 0"), twice, F.upper("code"), [F.asc("stop_id")])
    return out.select("stop_id", F.upper("code").alias("code"))


_KEY = "category || '|' || lower(trim(name))"


@query(
    prelude("poi") + f""", fresh AS (SELECT * FROM (SELECT *, {_KEY} AS k, row_number() OVER (PARTITION BY {_KEY} ORDER BY poi_id) AS rn FROM poi WHERE poi_id % 2 = 0) AS f WHERE rn = 1),
box AS (SELECT min(lat) - 0.001e0 AS s, max(lat) + 0.001e0 AS n, min(lon) - 0.001e0 AS w, max(lon) + 0.001e0 AS e FROM poi WHERE poi_id % 2 = 0),
stored AS (SELECT {_KEY} AS k, min(poi_id) AS stored_id FROM poi, box WHERE poi_id % 2 = 1 AND lat BETWEEN s AND n AND lon BETWEEN w AND e GROUP BY 1)
SELECT poi_id, stored_id, name, category FROM fresh LEFT JOIN stored USING (k)"""
)
def upsert_pois(spark: SparkSession, sf: str) -> DataFrame:
    pois = view(spark, sf, "poi").select("poi_id", "name", "category", "lat", "lon")
    return mutate.upsert_pois(pois.filter("poi_id % 2 = 1"), pois.filter("poi_id % 2 = 0"))


@query(prelude("poi_stop") + "SELECT DISTINCT poi_id, stop_id FROM poi_stop WHERE poi_id % 4 <> 0")
def insert_relations(spark: SparkSession, sf: str) -> DataFrame:
    r = view(spark, sf, "poi_stop")
    return mutate.relation_insert(r.filter("poi_id % 4 = 0"), r.unionByName(r), ["poi_id", "stop_id"])


@query(prelude("itinerary_stop") + "SELECT itinerary_id, stop_id FROM itinerary_stop WHERE NOT (line_id = 3 OR stop_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))")
def delete_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Deletion by a predicate, then by a list of keys."""
    gone = spark.read.parquet(f"{sf}/customer.parquet").filter("c_acctbal < 0").select(F.col("c_custkey").alias("stop_id"))
    left = mutate.delete_where(view(spark, sf, "itinerary_stop"), F.col("line_id") == 3)
    return mutate.delete_keys(left, gone, "stop_id").select("itinerary_id", "stop_id")


@query(prelude("poi", "poi_stop") + "SELECT poi_id FROM poi p WHERE EXISTS (SELECT 1 FROM poi_stop s WHERE s.poi_id = p.poi_id AND s.stop_id % 3 <> 0)")
def delete_orphans(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.delete_orphans(view(spark, sf, "poi"), view(spark, sf, "poi_stop").filter("stop_id % 3 <> 0"), "poi_id").select("poi_id")


@query(prelude("poi_stop") + "SELECT poi_id, stop_id FROM poi_stop WHERE 1 = 0")
def truncate_relations(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.truncate(view(spark, sf, "poi_stop"))


@query(prelude("poi", "poi_stop") + "SELECT 'poi' AS kept, count(*) AS n FROM poi WHERE poi_id <> 8 UNION ALL SELECT 'relation', count(*) FROM poi_stop WHERE poi_id <> 8")
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    parents, children = mutate.cascade(view(spark, sf, "poi"), view(spark, sf, "poi_stop"), "poi_id", 8)
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kept"), "n")
    return count(parents, "poi").unionByName(count(children, "relation"))


@query(prelude("fare") + "SELECT fare_id, active AND NOT (line_id = 5) AS active FROM fare")
def soft_delete_fares(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.soft_delete(view(spark, sf, "fare"), F.col("line_id") == 5).select("fare_id", "active")


@query(prelude("line") + "SELECT line_id, CASE WHEN line_id = 6 THEN 'Centro' ELSE name END AS name, route_type, line_id = 6 AS changed FROM line")
def update_line(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.point_update(view(spark, sf, "line"), F.col("line_id") == 6, name=" Centro ", route_type=None).select("line_id", "name", "route_type", "changed")


@query(prelude("fare", "line") + "SELECT f.fare_id, f.line_id, l.mode_id, f.value FROM fare f JOIN line l ON l.line_id = f.line_id")
def create_fares(spark: SparkSession, sf: str) -> DataFrame:
    asked = view(spark, sf, "fare").select("fare_id", "value", (F.col("line_id")).alias("line_id"))
    unknown = asked.withColumn("line_id", F.col("line_id") + 1000)
    return mutate.create_fares(asked.unionByName(unknown), view(spark, sf, "line")).select("fare_id", "line_id", "mode_id", "value")


@query(
    prelude("stop") + "SELECT line_id, stop_id, row_number() OVER (PARTITION BY line_id ORDER BY k, stop_id) AS seq,"
    " round((row_number() OVER (PARTITION BY line_id ORDER BY k, stop_id) - 1) / CAST(count(*) OVER (PARTITION BY line_id) - 1 AS DOUBLE), 9) AS fraction FROM stop"
)
def replace_relations(spark: SparkSession, sf: str) -> DataFrame:
    out = mutate.replace_relations(view(spark, sf, "stop").select("line_id", "stop_id", "k"), "line_id", [F.asc("k"), F.asc("stop_id")])
    return out.select("line_id", "stop_id", "seq", F.round("fraction", 9).alias("fraction"))
