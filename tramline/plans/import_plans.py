"""Imports of several tables at once.  The payloads are written from the generic tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.operators import imports, network
from tramline.plans.ingest_plans import poi_elements
from tramline.plans.registry import SQL, haversine, query
from tramline.sources.tables import itineraries, prelude, view


@query(
    prelude("vertex") + """, v AS (SELECT itinerary_id, itinerary_id % 8 AS form, count(*) AS n, arg_min(lon, idx) AS first_lon, arg_max(lat, idx) AS last_lat FROM vertex GROUP BY itinerary_id)
SELECT itinerary_id, CASE WHEN form < 6 THEN CASE form WHEN 5 THEN n - 1 ELSE n END END AS n_vertices, CASE WHEN form < 6 THEN round(first_lon, 6) END AS first_lon, CASE WHEN form < 6 THEN round(last_lat, 6) END AS last_lat FROM v"""
)
def parsed_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as geometries, parts, features, collections, numeric text, with points that are none, of one point, and unreadable."""
    form = F.col("itinerary_id") % 8
    numbers = F.transform("vertices", lambda p: F.array(p["lon"], p["lat"]))
    words = F.transform("vertices", lambda p: F.array(F.replace(p["lon"].cast("string"), F.lit("."), F.lit(",")), F.concat(F.lit(" "), p["lat"].cast("string"))))
    text = lambda c: F.to_json(F.struct(c.alias("c")))
    inner = lambda c: F.regexp_replace(text(c), r'^\{"c":|\}$', "")
    line = lambda kind, body: F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), body, F.lit("}"))
    plain = line("LineString", inner(numbers))
    holes = F.concat(F.lit('[7,[1],["x",2],null,'), F.substring(inner(F.filter(numbers, lambda p, i: i != 1)), 2, 1 << 20))
    json = (
        F.when(form == 0, plain).when(form == 1, line("MultiLineString", F.concat(F.lit("["), inner(numbers), F.lit(",[[1,2],[3,4]]]")))).when(form == 2, F.concat(F.lit('{"type":"Feature","geometry":'), plain, F.lit("}")))
        .when(form == 3, F.concat(F.lit('{"type":"FeatureCollection","features":[{"geometry":'), plain, F.lit('},{"geometry":null}]}'))).when(form == 4, line("linestring", inner(words)))
        .when(form == 5, line("LineString", holes)).when(form == 6, line("LineString", inner(F.slice(numbers, 1, 1)))).otherwise("{not json")
    )
    rows = imports.parse_shapes(itineraries(spark, sf).select("itinerary_id", json.alias("json")), "json")
    return rows.select("itinerary_id", F.when(F.col("vertices").isNotNull(), F.size("vertices").cast("long")).alias("n_vertices"), F.round(F.get("vertices", F.lit(0))["lon"], 6).alias("first_lon"), F.round(F.try_element_at("vertices", F.lit(-1))["lat"], 6).alias("last_lat"))


def _id(*parts: str) -> str:
    return "md5(" + " || ".join(f"length({p}) || ':' || {p}" for p in parts) + ")"


_NATION = "SELECT n_nationkey AS n, n_regionkey AS r, 'E' || n_nationkey AS sid, n_name AS name, lower(n_name) AS station FROM nation"
_SUM = "CAST(sum(CAST('0x' || substr(md5(t), 1, 8) AS BIGINT)) AS BIGINT)"


@query(
    f"""WITH st AS ({_NATION}), place AS (SELECT station AS place, -43.2e0 - 0.02e0 * n AS lon, -22.9e0 + 0.01e0 * n AS lat FROM st WHERE n % 6 <> 0),
found AS (SELECT st.*, coalesce((SELECT p.place FROM place p WHERE p.place = st.station), CASE station WHEN 'algeria' THEN 'argentina' END,
  (SELECT min(p.place) FROM place p WHERE length(split_part(station, ' ', 1)) >= 4 AND starts_with(p.place, split_part(station, ' ', 1)))) AS place FROM st),
stops AS (SELECT f.sid, {_id("'stop'", "sid")} AS stop_id, 'TREM-' || sid AS code, name, lon, lat FROM found f JOIN place USING (place)),
member AS (SELECT sid, name, 'b' || r AS branch, coalesce(CASE WHEN n % 4 <> 0 THEN n % 9 END, 999) AS w FROM st UNION ALL SELECT sid, name, 'b' || (r + 1) % 5, n % 9 + 20 FROM st WHERE n % 5 = 0),
lines AS (SELECT branch, 'TREM-' || upper(branch) AS code, r_name AS line_name, first(m.name ORDER BY w, sid) AS central, first(m.name ORDER BY w DESC, sid DESC) AS terminal FROM member m JOIN region ON branch = 'b' || r_regionkey GROUP BY ALL),
line_ AS (SELECT *, {_id("'line'", "code")} AS line_id FROM lines),
way_ AS (SELECT branch, line_id, name, max(way) AS way FROM (SELECT branch, line_id, 0 AS way, terminal AS name FROM line_ UNION ALL SELECT branch, line_id, 1, central FROM line_) AS w GROUP BY ALL),
dir AS (SELECT *, {_id("'direction'", "line_id", "name")} AS direction_id FROM way_),
pt AS (SELECT 'b' || r_regionkey AS branch, i, CASE WHEN r_regionkey < 3 THEN -43e0 - 0.1e0 * r_regionkey + 0.01e0 * i WHEN i = 0 THEN -43.1731e0 ELSE -43.1730e0 END AS lon, CASE WHEN r_regionkey < 3 THEN -22e0 - 0.02e0 * i WHEN i = 0 THEN -22.9035e0 ELSE -22.9034e0 END AS lat
  FROM region, range(0, 4) AS x(i) WHERE r_regionkey < 3 OR i < 2),
size_ AS (SELECT branch, count(*) AS n, sum(d) AS len, arg_min(lon, i) AS first_lon, arg_max(lon, i) AS last_lon FROM (SELECT *, sqrt(pow(lon - lag(lon) OVER w, 2) + pow(lat - lag(lat) OVER w, 2)) AS d FROM pt WINDOW w AS (PARTITION BY branch ORDER BY i)) AS p GROUP BY branch),
it AS (SELECT {_id("'itinerary'", "direction_id")} AS itinerary_id, direction_id, branch, way, n, len, CASE way WHEN 1 THEN last_lon ELSE first_lon END AS begins FROM dir JOIN size_ USING (branch)),
num AS (SELECT branch, stop_id, row_number() OVER (PARTITION BY branch ORDER BY w, sid) AS k, count(*) OVER (PARTITION BY branch) AS o FROM member JOIN stops USING (sid)),
link_ AS (SELECT itinerary_id, stop_id, CASE way WHEN 1 THEN o + 1 - k ELSE k END AS seq, o FROM it JOIN num USING (branch))
SELECT 'stop' AS tab, count(*) AS n, {_SUM} AS digest FROM (SELECT concat_ws('|', stop_id, code, name, CAST(round(lon * 1e6) AS BIGINT), CAST(round(lat * 1e6) AS BIGINT)) AS t FROM stops) AS x
UNION ALL SELECT 'line', count(*), {_SUM} FROM (SELECT concat_ws('|', line_id, code, line_name) AS t FROM line_) AS x
UNION ALL SELECT 'direction', count(*), {_SUM} FROM (SELECT concat_ws('|', direction_id, line_id, name) AS t FROM dir) AS x
UNION ALL SELECT 'itinerary', count(*), {_SUM} FROM (SELECT concat_ws('|', itinerary_id, direction_id, n, CAST(round(len * 1e6) AS BIGINT), CAST(round(begins * 1e6) AS BIGINT)) AS t FROM it) AS x
UNION ALL SELECT 'link', count(*), {_SUM} FROM (SELECT concat_ws('|', itinerary_id, stop_id, seq, CAST(round(CASE WHEN o > 1 THEN (seq - 1) / (o - 1) ELSE 0 END * 1e6) AS BIGINT)) AS t FROM link_) AS x"""
)
def imported_network(spark: SparkSession, sf: str) -> DataFrame:
    """The train network from nested payloads: a count and a digest of each of its five tables."""
    nation = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"), F.col("n_name").alias("name"))
    region = spark.read.parquet(f"{sf}/region.parquet")
    branch = lambda r, w: F.struct(w.cast("int").alias("weight"), F.concat(F.lit("b"), r.cast("string")).alias("id_branch"))
    n, r = F.col("n"), F.col("r")
    both = F.array_compact(F.array(branch(r, F.when(n % 4 != 0, n % 9)), F.when(n % 5 == 0, branch((r + 1) % 5, n % 9 + 20))))
    again = F.array(branch(r, F.lit(-5)))
    station = lambda place, b: F.struct(place.alias("id"), F.concat(F.lit("e"), n).alias("id_station"), F.concat(F.lit(" "), "name").alias("title"), b.alias("station_x_branch"))
    rows = nation.select("r", F.explode(F.array_compact(F.array(station(n * 2, both), F.when(n % 6 == 1, station(n * 2 + 1, again))))).alias("s"))
    stations = rows.groupBy("r").agg(F.to_json(F.array_sort(F.collect_list("s"))).alias("json"))
    at = F.struct(F.struct(F.lit("Point").alias("type"), F.array(F.lit(-43.2) - F.lit(0.02) * n, F.lit(-22.9) + F.lit(0.01) * n).alias("coordinates")).alias("geometry"), F.struct(F.col("name").alias("nome")).alias("properties"))
    places = nation.filter(n % 6 != 0).select(F.to_json(F.struct(F.array(at).alias("features"))).alias("json"))
    k = F.col("r_regionkey")
    p = lambda i: F.array(F.lit(-43.0) - F.lit(0.1) * k + F.lit(0.01 * i), F.lit(-22.0 - 0.02 * i))
    geometry = lambda kind, c: F.to_json(F.struct(F.lit(kind).alias("type"), c.alias("coordinates")))
    whole = geometry("LineString", F.array(*(p(i) for i in range(4))))
    json = F.when(k == 0, whole).when(k == 1, geometry("MultiLineString", F.array(F.array(p(0), p(1)), F.array(p(3), p(2))))).when(k == 2, F.concat(F.lit('{"geometry":'), whole, F.lit("}"))).otherwise("{")
    code = F.concat(F.lit("b"), k.cast("string")).alias("branch")
    aliases = spark.range(1).select(F.lit("algeria").alias("station"), F.lit("argentina").alias("place"))
    made = imports.train_network(stations, places, aliases, region.filter("r_regionkey < 4").select(code, json.alias("json")), region.select(code, F.col("r_name").alias("name")))
    micro = lambda c: F.round(c * 1e6).cast("long").cast("string")
    texts = {
        "stop": ["stop_id", "code", "name", micro(F.col("lon")), micro(F.col("lat"))], "line": ["line_id", "code", "name"], "direction": ["direction_id", "line_id", "name"],
        "itinerary": ["itinerary_id", "direction_id", F.size("vertices").cast("string"), micro(F.col("length")), micro(F.get("vertices", F.lit(0))["lon"])], "link": ["itinerary_id", "stop_id", F.col("seq").cast("string"), micro(F.col("fraction"))],
    }
    out = None
    for name, columns in texts.items():
        one = made[name].select(_digest(F.concat_ws("|", *columns)).alias("d")).agg(F.lit(name).alias("tab"), F.count("*").alias("n"), F.sum("d").alias("digest"))
        out = one if out is None else out.unionByName(one)
    return out


def _digest(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


@query(
    "SELECT 'b' || n_regionkey AS branch, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS ord, 'E' || n_nationkey AS station, round(2.3e0 * n_nationkey, 6) AS km,"
    " CASE WHEN n_nationkey % 7 <> 0 THEN round(-22.9e0 + 0.01e0 * n_nationkey, 6) END AS lat, CAST(6 + n_regionkey AS DOUBLE) AS peak_min, '06:00' AS morning_from, CAST(20 AS DOUBLE) AS dwell_s, count(*) OVER (PARTITION BY n_regionkey) AS n_stations FROM nation"
)
def railway_config(spark: SparkSession, sf: str) -> DataFrame:
    """A railway configuration of nested maps as rows: stations without coordinates keep nulls."""
    n = spark.read.parquet(f"{sf}/nation.parquet")
    sid = F.concat(F.lit("E"), F.col("n_nationkey"))
    listed = n.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", sid.alias("id"), "n_name"))), lambda s: F.struct(s["id"].alias("id"), s["n_name"].alias("nome"), (s["n_nationkey"] * F.lit(2.3)).alias("distancia_central_km"))).alias("estacoes"))
    one = F.struct((F.col("n_regionkey") + 6).cast("double").alias("intervalo_pico_minutos"), F.lit("06:00").alias("pico_manha_inicio"), F.lit(20.0).alias("tempo_parada_segundos"), "estacoes")
    branches = listed.agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("b"), F.col("n_regionkey")), one))).alias("ramais"))
    spots = n.filter("n_nationkey % 7 <> 0").agg(F.map_from_entries(F.collect_list(F.struct(sid, F.struct((F.lit(-22.9) + F.lit(0.01) * F.col("n_nationkey")).alias("lat"), F.lit(-43.2).alias("lon"))))).alias("coordenadas_estacoes"))
    raw = branches.join(F.broadcast(spots)).select(F.to_json(F.struct("ramais", "coordenadas_estacoes")).alias("json"))  # a row each
    settings, stations = imports.parse_railway(raw, "json")
    rows = stations.join(settings.select("branch", "peak_min", "morning_from", "dwell_s", "n_stations"), "branch")
    return rows.select("branch", F.col("ord").cast("long").alias("ord"), "station", F.round("km", 6).alias("km"), F.round("lat", 6).alias("lat"), "peak_min", "morning_from", "dwell_s", F.col("n_stations").cast("long").alias("n_stations"))


_ROUTES = """r AS (SELECT o_orderkey AS pos, lpad(CAST(o_custkey % 25 AS VARCHAR), 3, '0') AS code, CASE WHEN o_orderkey % 3 = 0 THEN 'd' ELSE 'D' END || o_custkey % 7 || ' (' || o_orderkey % 2 || ')' AS name,
  CASE o_orderkey % 4 WHEN 0 THEN 'BRT' WHEN 1 THEN 'brt' ELSE 'regular' END AS route_type, 's' || o_orderkey AS shape_id, (o_orderkey % 50) / 8e0 AS length_m FROM orders)"""


@query(
    f"""WITH {_ROUTES}, first_ AS (SELECT code, arg_max(route_type, pos) AS t FROM r GROUP BY code), had AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS code FROM nation WHERE n_nationkey % 3 = 0),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code, upper(name) ORDER BY pos) AS k FROM r) AS x WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM r o WHERE o.pos % 13 = 5 AND o.code = x.code AND upper(o.name) = upper(x.name))),
i AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code, upper(name), length_m ORDER BY pos) AS k FROM r WHERE pos % 5 <> 0) AS x WHERE k = 1
  AND NOT EXISTS (SELECT 1 FROM r o WHERE o.pos % 11 = 3 AND o.code = x.code AND upper(o.name) = upper(x.name) AND o.length_m = x.length_m))
SELECT 'line' AS tab, f.code, f.t AS name, CAST(NULL AS DOUBLE) AS length_m, CASE WHEN h.code IS NULL THEN 'insert' ELSE 'update' END || ' ' || CASE lower(f.t) WHEN 'brt' THEN 'BRT' ELSE 'Ônibus' END AS note
  FROM first_ f LEFT JOIN had h USING (code) WHERE h.code IS NULL OR lower(f.t) <> 'regular'
UNION ALL SELECT 'direction', code, name, NULL, NULL FROM d UNION ALL SELECT 'itinerary', code, name, length_m, shape_id FROM i"""
)
def imported_itineraries(spark: SparkSession, sf: str) -> DataFrame:
    """Lines, directions and itineraries by natural keys; many rows share a direction and length, and some shapes can't be read."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    routes = o.select(
        k.alias("pos"), F.lpad((c % 25).cast("string"), 3, "0").alias("code"), F.concat(F.when(k % 3 == 0, "d").otherwise("D"), (c % 7).cast("string")).alias("destination"), (k % 2).cast("string").alias("direction"),
        F.when(k % 4 == 0, "BRT").when(k % 4 == 1, "brt").otherwise("regular").alias("route_type"), F.concat(F.lit("s"), k).alias("shape_id"), ((k % 50) / F.lit(8.0)).alias("length_m"),
    )
    shapes = routes.select("shape_id", F.when(F.col("pos") % 5 != 0, F.array(F.struct(F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat")), F.struct(F.lit(1.0).alias("lon"), F.lit(0.0).alias("lat")))).alias("vertices"))
    lines = view(spark, sf, "line").filter("line_id % 3 = 0").select("code", F.lit("regular").alias("route_type"))
    named = routes.withColumn("name", F.concat("destination", F.lit(" ("), "direction", F.lit(")")))
    made = imports.itineraries_by_key(routes, shapes, lines, named.filter("pos % 13 = 5").select("code", "name"), named.filter("pos % 11 = 3").select("code", "name", "length_m"))
    none = lambda t: F.lit(None).cast(t)
    out = made["line"].select(F.lit("line").alias("tab"), "code", F.col("route_type").alias("name"), none("double").alias("length_m"), F.concat_ws(" ", "change", "mode").alias("note"))
    out = out.unionByName(made["direction"].select(F.lit("direction").alias("tab"), "code", "name", none("double").alias("length_m"), none("string").alias("note")))
    return out.unionByName(made["itinerary"].select(F.lit("itinerary").alias("tab"), "code", "name", "length_m", F.col("shape_id").alias("note")))


STOP = 9
_H = haversine("s.lat", "s.lon", "p.lat", "p.lon")


@query(
    prelude("poi", "stop", "itinerary_stop", "poi_stop") + f""", near_ AS (SELECT p.poi_id, s.stop_id, {_H} AS metres FROM poi p JOIN stop s ON s.stop_id = {STOP} AND abs(p.lat - s.lat) <= 150 / 111000e0 AND abs(p.lon - s.lon) <= 150 / 111000e0),
rel AS (SELECT poi_id, stop_id, CAST(60 + poi_id % 7 * 10 AS DOUBLE) AS metres FROM poi_stop UNION ALL SELECT poi_id, CAST(poi_id % 400 AS BIGINT), CAST(90 AS DOUBLE) FROM poi WHERE poi_id % 400 > 0),
rivals AS (SELECT DISTINCT stop_id FROM itinerary_stop WHERE itinerary_id IN (SELECT itinerary_id FROM itinerary_stop WHERE stop_id = {STOP})),
had AS (SELECT poi_id, min(metres) AS m, first(stop_id ORDER BY metres, stop_id) AS s FROM rel WHERE stop_id IN (SELECT stop_id FROM rivals) GROUP BY poi_id)
SELECT poi_id, round(metres, 6) AS metres, CASE WHEN metres > 150 THEN 'too far' WHEN m IS NULL THEN 'insert' WHEN m <= metres THEN 'farther' ELSE 'replace' END AS action, CASE WHEN metres <= 150 AND m > metres THEN s END AS old_stop
FROM near_ n LEFT JOIN had USING (poi_id) WHERE NOT EXISTS (SELECT 1 FROM rel r WHERE r.poi_id = n.poi_id AND r.stop_id = n.stop_id)"""
)
def pois_of_stop(spark: SparkSession, sf: str) -> DataFrame:
    """POIs about one stop against their relations to stops that share an itinerary with it."""
    stored = view(spark, sf, "poi_stop").select("poi_id", "stop_id", (F.col("poi_id") % 7 * 10 + 60).cast("double").alias("metres"))
    more = view(spark, sf, "poi").filter("poi_id % 400 > 0").select("poi_id", (F.col("poi_id") % 400).alias("stop_id"), F.lit(90.0).alias("metres"))
    stop = view(spark, sf, "stop").filter(F.col("stop_id") == STOP)
    rows = imports.pois_of_stop(view(spark, sf, "poi"), stop, stored.unionByName(more), view(spark, sf, "itinerary_stop"))
    return rows.select("poi_id", F.round("metres", 6).alias("metres"), "action", "old_stop")


@query(
    prelude("stop") + "SELECT md5('4:stop' || length('C' || stop_id) || ':C' || stop_id) AS stop_id, 'C' || stop_id AS code, name, round(lon, 9) AS lon, round(lat, 9) AS lat, true AS active FROM stop WHERE stop_id % 10 <> 3 AND stop_id % 4 <> 0"
)
def imported_stops(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of stops, each twice in two cases, into a table that has every fourth of them."""
    kind = F.when(F.col("stop_id") % 10 == 3, "Polygon").otherwise("Point")
    code = F.explode(F.array(F.concat(F.lit("c"), F.col("stop_id")), F.concat(F.lit(" C"), F.col("stop_id"))))
    each = view(spark, sf, "stop").select("*", code.alias("given"))
    f = F.struct(F.struct(kind.alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct(F.col("given").alias("stop_id"), F.col("name").alias("stop_name")).alias("properties"))
    stored = view(spark, sf, "stop").filter("stop_id % 4 = 0").select(F.concat(F.lit("c"), F.col("stop_id")).alias("code"))
    rows = imports.import_stops(each.select(F.to_json(F.struct(F.array(f).alias("features"))).alias("json")), "json", stored, F.current_timestamp())
    return rows.select("stop_id", "code", "name", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), "active")


_NEAR = haversine("p.lat", "p.lon", "s.lat", "s.lon")


@query(
    prelude("poi", "stop", "itinerary_stop", "poi_stop") + f""", parsed AS ({SQL["parsed_pois"].replace(prelude("poi"), "WITH poi AS (SELECT * FROM poi) ").replace("WITH poi AS (SELECT * FROM poi) , tagged", "WITH tagged")}),
fresh AS (SELECT * FROM (SELECT *, category || '|' || lower(trim(name)) AS k, row_number() OVER (PARTITION BY category || '|' || lower(trim(name)) ORDER BY id) AS rn FROM parsed) AS f WHERE rn = 1),
box AS (SELECT min(lat) - 0.001e0 AS s, max(lat) + 0.001e0 AS n, min(lon) - 0.001e0 AS w, max(lon) + 0.001e0 AS e FROM parsed),
stored AS (SELECT 'Hospital|' || lower('hospital ' || name) AS k, min(poi_id) AS stored_id FROM poi, box WHERE poi_id % 10 = 0 AND lat BETWEEN s AND n AND lon BETWEEN w AND e GROUP BY 1),
kept AS (SELECT coalesce(stored_id, id) AS poi_id, lat, lon FROM fresh LEFT JOIN stored USING (k)),
near_ AS (SELECT * FROM (SELECT i.itinerary_id, p.poi_id, s.stop_id, {_NEAR} AS metres, row_number() OVER (PARTITION BY i.itinerary_id, p.poi_id ORDER BY round({_NEAR}, 6), i.seq, s.stop_id) AS rn
  FROM kept p JOIN stop s ON abs(p.lat - s.lat) < 0.01 AND {_NEAR} <= 150 JOIN itinerary_stop i ON i.stop_id = s.stop_id) AS n WHERE rn = 1),
had AS (SELECT itinerary_id, poi_id, min(stop_id) AS old_stop, CAST(60 + poi_id % 7 AS DOUBLE) AS m FROM poi_stop JOIN itinerary_stop USING (stop_id) GROUP BY itinerary_id, poi_id)
SELECT itinerary_id, poi_id, stop_id, round(metres, 6) AS metres, CASE WHEN old_stop IS NULL THEN 'insert' WHEN old_stop = stop_id THEN 'skip' WHEN metres < m THEN 'replace' ELSE 'skip' END AS action, old_stop FROM near_ LEFT JOIN had USING (itinerary_id, poi_id)"""
)
def imported_pois(spark: SparkSession, sf: str) -> DataFrame:
    """Map elements to POIs to the nearest stops of every itinerary, against stored POIs and relations, in one plan."""
    stored = view(spark, sf, "poi").filter("poi_id % 10 = 0").select("poi_id", F.concat(F.lit("Hospital "), "name").alias("name"), F.lit("Hospital").alias("category"), "lat", "lon")
    relations = view(spark, sf, "poi_stop").withColumn("metres", (F.col("poi_id") % 7 + 60).cast("double"))
    made = imports.import_pois(poi_elements(spark, sf), "json", stored, view(spark, sf, "itinerary_stop"), view(spark, sf, "stop"), relations)
    return made["relation"].select("itinerary_id", "poi_id", "stop_id", F.round("metres", 6).alias("metres"), "action", "old_stop")


@query(
    prelude("line", "direction", "itinerary_stop") + """, n AS (SELECT itinerary_id, count(DISTINCT stop_id) AS k FROM itinerary_stop WHERE line_id <> 4 GROUP BY itinerary_id)
SELECT l.line_id, string_agg(d.name || '=' || coalesce(n.k, 0), ';' ORDER BY d.name, d.direction_id) AS itineraries FROM line l LEFT JOIN direction d USING (line_id) LEFT JOIN n ON n.itinerary_id = d.direction_id GROUP BY l.line_id"""
)
def line_itineraries(spark: SparkSession, sf: str) -> DataFrame:
    """Every line with its itineraries and how many stops each has; one line's have none."""
    d = view(spark, sf, "direction")
    own = d.select(F.col("direction_id").alias("itinerary_id"), "direction_id")
    rows = network.itinerary_stop_counts(view(spark, sf, "line"), d, own, view(spark, sf, "itinerary_stop").filter("line_id <> 4"))
    return rows.select("line_id", F.array_join(F.transform("itineraries", lambda i: F.concat(i["name"], F.lit("="), i["n_stops"])), ";").alias("itineraries"))
