"""Imports that write several catalog tables in one plan.

Ids are made from natural keys (``stable_id``), so that dependent tables need no round trip for the ids of their parents,
an import run twice gives the same rows, and nothing is looked up row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import geo, text
from tramline.operators import ingest, mutate, spatial

#: The line that stands in for a branch without geometry, as (lon, lat).
STAND_IN = ((-43.1731, -22.9035), (-43.1730, -22.9034))
STATIONS = "array<struct<id:int,title:string,id_station:string,is_terminal:boolean,is_transfer:boolean,weight:int,url:string,station_x_branch:array<struct<weight:int,name:string,id_branch:string,color:string>>>>"
PLACES = "struct<features:array<struct<geometry:struct<type:string,coordinates:array<double>>,properties:struct<nome:string>>>>"
RAILWAY = (
    "struct<ramais:map<string,struct<intervalo_pico_minutos:double,intervalo_fora_pico_minutos:double,pico_manha_inicio:string,pico_manha_fim:string,pico_tarde_inicio:string,pico_tarde_fim:string,"
    "tempo_parada_segundos:double,estacoes:array<struct<id:string,nome:string,distancia_central_km:double>>>>,coordenadas_estacoes:map<string,struct<lat:double,lon:double>>>"
)


def stable_id(*parts: Column) -> Column:
    """An id from a natural key: the digest of its parts, nulls as empty text, each with its length."""
    plain = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat(*(x for p in plain for x in (F.length(p).cast("string"), F.lit(":"), p))).cast("binary"))


def parse_shapes(raw: DataFrame, json_col: str) -> DataFrame:
    """GeoJSON lines of changing shape as ``vertices``: bare geometries, features and collections (the first), numbers or numeric
    text, and of a MultiLineString the first part.  Points that are none are left out; fewer than two leave null."""
    v = F.try_parse_json(json_col)
    g = F.coalesce(F.try_variant_get(v, "$.features[0].geometry", "variant"), F.try_variant_get(v, "$.geometry", "variant"), v)
    rows = raw.withColumn("__g", g)
    kind = F.lower(F.try_variant_get("__g", "$.type", "string"))
    whole = F.when(kind == "linestring", F.try_variant_get("__g", "$.coordinates", "variant")).when(kind == "multilinestring", F.try_variant_get("__g", "$.coordinates[0]", "variant"))
    rows = rows.withColumn("__c", F.try_variant_get(whole, "$", "array<variant>"))
    number = lambda p, i: text.decimal_comma(F.try_variant_get(p, f"$[{i}]", "string"))
    points = F.filter(F.transform("__c", lambda p: F.struct(number(p, 0).alias("lon"), number(p, 1).alias("lat"))), lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())
    return rows.withColumn("__v", points).withColumn("vertices", F.when(F.size("__v") >= 2, F.col("__v"))).drop("__g", "__c", "__v")


def parse_railway(raw: DataFrame, json_col: str) -> tuple[DataFrame, DataFrame]:
    """A railway configuration as its branches' settings and their stations: (branch, ..., dwell_s) and (branch, ord, station, name, km, lat, lon)."""
    own = raw.select(F.from_json(json_col, RAILWAY).alias("c"))
    each = own.select(F.explode("c.ramais").alias("branch", "r"), F.col("c.coordenadas_estacoes").alias("at"))
    settings = each.select(
        "branch", F.col("r.intervalo_pico_minutos").alias("peak_min"), F.col("r.intervalo_fora_pico_minutos").alias("off_min"),
        *(F.col(f"r.pico_{a}_{b}").alias(f"{name}_{end}") for a, name in (("manha", "morning"), ("tarde", "evening")) for b, end in (("inicio", "from"), ("fim", "to"))),
        F.col("r.tempo_parada_segundos").alias("dwell_s"), F.size("r.estacoes").alias("n_stations"),
    )
    listed = each.select("branch", "at", F.posexplode("r.estacoes").alias("i", "s"))
    stations = listed.select("branch", (F.col("i") + 1).alias("ord"), F.col("s.id").alias("station"), F.col("s.nome").alias("name"), F.col("s.distancia_central_km").alias("km"), F.try_element_at("at", F.col("s.id")).alias("p"))
    return settings, stations.select("branch", "ord", "station", "name", "km", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))


def train_network(stations: DataFrame, places: DataFrame, aliases: DataFrame, shapes: DataFrame, names: DataFrame, prefix: str = "TREM-", none: int = 999) -> dict[str, DataFrame]:
    """The train network's tables from landed payloads: stops, lines, directions both ways, itineraries, and their links to stops.

    ``stations`` and ``places`` have a JSON column ``json``; ``aliases``: station, place (plain names); ``shapes``: branch and
    JSON; ``names``: branch, name, the branches to import.  A station counts once a branch, its first row's; of a station's
    rows the first gives its name.  Stations order by the branch's weight (``none`` without one), ties by id.
    Stations without a place get no stop and no link; a branch without readable geometry gets the stand-in line.
    """
    each = stations.select(F.posexplode(F.from_json("json", STATIONS)).alias("pos", "s")).select("pos", "s.*")
    known = each.filter(F.trim(F.coalesce("id_station", F.lit(""))) != "").withColumn("station_id", F.upper("id_station"))
    first = known.groupBy("station_id").agg(F.min_by(F.trim("title"), "pos").alias("name")).filter(F.coalesce("name", F.lit("")) != "")
    spots = places.select(F.explode(F.from_json("json", PLACES)["features"]).alias("f")).filter("f.geometry.type = 'Point'")
    spots = spots.select(text.plain_name(F.col("f.properties.nome")).alias("place"), F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"))
    spots = spots.groupBy("place").agg(F.min(F.struct("lon", "lat")).alias("p"))
    plain = first.withColumn("station", text.plain_name(F.col("name")))
    placed = plain.join(ingest.match_stations(plain.select("station").distinct(), spots, aliases).select("station", "place"), "station").join(spots, "place")
    stops = placed.select(stable_id(F.lit("stop"), F.col("station_id")).alias("stop_id"), F.concat(F.lit(prefix), "station_id").alias("code"), "name", "p.lon", "p.lat", "station_id")
    listed = known.select("pos", "station_id", F.explode("station_x_branch").alias("b")).select("pos", "station_id", F.col("b.id_branch").alias("branch"), F.coalesce("b.weight", F.lit(none)).alias("weight"))
    once = listed.filter(F.trim(F.coalesce("branch", F.lit(""))) != "").groupBy("branch", "station_id").agg(F.min(F.struct("pos", "weight"))["weight"].alias("weight")).join(names, "branch")
    ends = once.join(first.withColumnRenamed("name", "station_name"), "station_id", "left").groupBy("branch", "name").agg(
        F.min_by("station_name", F.struct("weight", "station_id")).alias("central"), F.max_by("station_name", F.struct("weight", "station_id")).alias("terminal")
    )
    code = F.concat(F.lit(prefix), F.upper("branch"))
    lines = ends.select(stable_id(F.lit("line"), code).alias("line_id"), code.alias("code"), "name", "branch", "central", "terminal")
    ways = lines.select("line_id", "branch", F.explode(F.array(F.struct(F.lit(0).alias("way"), F.coalesce("terminal", F.lit("Terminal")).alias("name")), F.struct(F.lit(1).alias("way"), F.coalesce("central", F.lit("Central do Brasil")).alias("name")))).alias("w")).select("line_id", "branch", "w.*")
    # Two ways of one name are one direction, which the later way then overwrites.
    directions = ways.groupBy("line_id", "branch", "name").agg(F.max("way").alias("way")).withColumn("direction_id", stable_id(F.lit("direction"), F.col("line_id"), F.col("name")))
    stand_in = F.array(*(F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in STAND_IN))
    drawn = network_shapes(shapes)
    drawn = directions.join(drawn, "branch", "left").withColumn("v", F.coalesce("vertices", stand_in))
    itineraries = drawn.select(stable_id(F.lit("itinerary"), F.col("direction_id")).alias("itinerary_id"), "direction_id", "branch", "way", F.when(F.col("way") == 1, F.reverse("v")).otherwise(F.col("v")).alias("vertices"))
    itineraries = itineraries.withColumn("length", geo.planar_length(F.col("vertices")))
    with_stop = once.join(stops.select("station_id", "stop_id"), "station_id").select("branch", "weight", "station_id", "stop_id")
    out = Window.partitionBy("branch").orderBy("weight", "station_id")
    whole = Window.partitionBy("branch")
    numbered = with_stop.withColumn("n", F.row_number().over(out)).withColumn("of", F.count("*").over(whole))
    links = itineraries.select("itinerary_id", "branch", "way").join(numbered, "branch").withColumn("seq", F.when(F.col("way") == 1, F.col("of") + 1 - F.col("n")).otherwise(F.col("n")).cast("int"))
    links = links.select("itinerary_id", "stop_id", "seq", F.when(F.col("of") > 1, (F.col("seq") - 1) / (F.col("of") - 1)).otherwise(F.lit(0.0)).alias("fraction"))
    return {
        "stop": stops.select("stop_id", "code", "name", "lon", "lat"), "line": lines.select("line_id", "code", "name"), "direction": directions.select("direction_id", "line_id", "name"),
        "itinerary": itineraries.select("itinerary_id", "direction_id", "vertices", "length"), "link": links,
    }


def network_shapes(shapes: DataFrame) -> DataFrame:
    """(branch, vertices): a line as it is, and the parts of a multi-part line chained end to end."""
    v = F.try_parse_json("json")
    g = F.coalesce(F.try_variant_get(v, "$.geometry", "variant"), v)
    rows = shapes.withColumn("g", g)
    point = lambda p: F.struct(F.try_variant_get(p, "$[0]", "double").alias("lon"), F.try_variant_get(p, "$[1]", "double").alias("lat"))
    part = lambda c: F.filter(F.transform(F.try_variant_get(c, "$", "array<variant>"), point), lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())
    kind = F.lower(F.try_variant_get("g", "$.type", "string"))
    many = F.filter(F.transform(F.try_variant_get("g", "$.coordinates", "array<variant>"), part), lambda p: F.size(p) >= 2)
    one = part(F.try_variant_get("g", "$.coordinates", "variant"))
    rows = rows.select("branch", kind.alias("kind"), one.alias("one"), many.alias("many"))
    whole = F.when((F.col("kind") == "linestring") & (F.size("one") >= 2), F.col("one")).when((F.col("kind") == "multilinestring") & (F.size("many") > 0), ingest.chained(F.col("many")))
    return rows.select("branch", whole.alias("vertices")).filter("vertices IS NOT NULL")


def itineraries_by_key(routes: DataFrame, shapes: DataFrame, lines: DataFrame, directions: DataFrame, itineraries: DataFrame) -> dict[str, DataFrame]:
    """Lines, directions and itineraries of route metadata, each inserted unless its natural key is there already.

    ``routes``: code, destination, direction, route_type, shape_id, length_m, pos; ``shapes``: shape_id, vertices; stored tables:
    lines (code, route_type), directions (code, name), itineraries (code, name, length_m).  A direction's key is its line and
    its name without case; an itinerary's is its direction and its length to 17 digits.  Of rows with one key the first
    by ``pos`` that has a geometry wins.  ``brt`` is a mode of its own.
    """
    rows = routes.withColumn("mode", F.when(F.lower("route_type") == "brt", "BRT").otherwise("Ônibus")).withColumn("name", F.concat("destination", F.lit(" ("), "direction", F.lit(")")))
    first = rows.groupBy("code").agg(F.max_by(F.struct("mode", "route_type"), "pos").alias("r"))  # later rows overwrite a line's type
    new_lines = mutate.upsert(lines.select("code", "route_type"), first.select("code", F.col("r.route_type").alias("route_type")), "code", ["route_type"]).filter("change IN ('insert', 'update')")
    mode = first.select("code", F.col("r.mode").alias("mode"))
    key = F.concat_ws("|", "code", F.upper(F.trim("name")))
    fresh = mutate.insert_missing(directions.select("code", "name"), rows.select("code", "name", "pos"), key, [F.col("pos")])
    drawn = rows.join(shapes, "shape_id").filter("vertices IS NOT NULL")
    full = F.concat_ws("|", "code", F.upper(F.trim("name")), text.double_key(F.col("length_m")))
    own = mutate.insert_missing(itineraries.select("code", "name", "length_m"), drawn.select("code", "name", "length_m", "shape_id", "vertices", "pos"), full, [F.col("pos")])
    return {"line": new_lines.join(mode, "code", "left"), "direction": fresh.select("code", "name"), "itinerary": own.select("code", "name", "length_m", "shape_id", "vertices")}


def pois_of_stop(pois: DataFrame, stop: DataFrame, relations: DataFrame, links: DataFrame, metres: float = 150.0) -> DataFrame:
    """POIs for one stop (a row of stop_id, lat, lon): what to insert, and which relation of a POI each replaces.

    Candidates lie in a box of degrees about the stop and in its reach.  A POI competes only with its relations to
    stops on an itinerary of this stop, of which the nearest counts; it must be nearer than that.  POIs
    that the stop has already are left out.  ``relations``: poi_id, stop_id, metres; ``links``: itinerary_id, stop_id.
    """
    margin = metres / geo.CELL_METRES
    here = F.broadcast(stop.select("stop_id", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")))  # one row
    near = pois.join(here, F.col("lat").between(F.col("s_lat") - margin, F.col("s_lat") + margin) & F.col("lon").between(F.col("s_lon") - margin, F.col("s_lon") + margin))
    near = near.withColumn("metres", geo.haversine(F.col("s_lat"), F.col("s_lon"), F.col("lat"), F.col("lon"))).select("poi_id", "stop_id", "metres")
    own = links.join(stop.select("stop_id"), "stop_id", "left_semi").select("itinerary_id")
    rivals = links.join(own, "itinerary_id", "left_semi").select("stop_id").distinct()
    had = relations.join(rivals, "stop_id", "left_semi").groupBy("poi_id").agg(F.min(F.struct(F.col("metres").alias("m"), F.col("stop_id").alias("s"))).alias("had"))
    fresh = near.join(relations.select("poi_id", "stop_id"), ["poi_id", "stop_id"], "left_anti").join(had, "poi_id", "left")
    action = F.when(F.col("metres") > metres, "too far").when(F.col("had").isNull(), "insert").when(F.col("had.m") <= F.col("metres"), "farther").otherwise("replace")
    return fresh.select("poi_id", "stop_id", "metres", action.alias("action"), F.when(action == "replace", F.col("had.s")).alias("old_stop"))


def import_stops(raw: DataFrame, json_col: str, stops: DataFrame, now: Column) -> DataFrame:
    """Landed stop pages as new rows of the stop table: points with a code, one a code without case, that the table (code) lacks.

    Columns: stop_id (from the code), code, name, lon, lat, created_at, active.
    """
    parsed = ingest.parse_stops(raw, json_col).withColumn("code", F.upper("code"))
    order = [F.asc("name"), F.asc("lon"), F.asc("lat")]
    fresh = mutate.insert_missing(stops.select(F.upper(F.trim("code")).alias("code")), parsed, F.col("code"), order)
    return fresh.select(stable_id(F.lit("stop"), F.col("code")).alias("stop_id"), "code", "name", "lon", "lat", now.alias("created_at"), F.lit(True).alias("active"))


def import_pois(raw: DataFrame, json_col: str, pois: DataFrame, links: DataFrame, stops: DataFrame, relations: DataFrame, metres: float = 150.0) -> dict[str, DataFrame]:
    """Landed map elements as POIs and their relations to stops, all tiles in one plan.

    Elements are classified, told apart by category and name, and given the stored POI's id where there is one (``poi``); each
    is matched to the nearest stop in reach of every itinerary (``match``), which then competes with the
    POI's stored relations on that itinerary (``relation``: insert, replace or skip).
    """
    parsed = ingest.parse_pois(raw, json_col).withColumnRenamed("id", "poi_id")
    own = mutate.upsert_pois(pois, parsed)
    placed = own.join(parsed.select("poi_id", "lat", "lon", "priority").dropDuplicates(["poi_id"]), "poi_id")
    kept = placed.withColumn("poi_id", F.coalesce("stored_id", "poi_id"))
    found = spatial.poi_nearest_stop(kept, links, stops, metres)
    return {"poi": kept, "match": found, "relation": spatial.compete(found, relations, links)}
