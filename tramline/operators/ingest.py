"""Transforms of landed outside payloads into catalog rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tramline.functions import text

ROUTES = "struct<features:array<struct<attributes:struct<servico:string,destino:string,direcao:string,tipo_rota:string,shape_id:string,extensao:string,consorcio:string>>>>"
STOPS = "struct<features:array<struct<geometry:struct<type:string,coordinates:array<double>>,properties:struct<stop_id:string,stop_name:string>>>>"
ELEMENTS = "struct<elements:array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>>"
LINE = "struct<type:string,coordinates:array<array<double>>>"


def parse_routes(raw: DataFrame, json_col: str) -> DataFrame:
    """Route metadata pages; rows without service or shape go, the length may have a comma."""
    a = raw.select(F.explode(F.from_json(json_col, ROUTES)["features"]).alias("f")).select("f.attributes.*")
    ok = (F.trim(F.coalesce("servico", F.lit(""))) != "") & (F.trim(F.coalesce("shape_id", F.lit(""))) != "")
    return a.filter(ok).select(text.upper_trim(F.col("servico")).alias("code"), F.trim("destino").alias("destination"), F.trim("direcao").alias("direction"), F.lower(F.trim("tipo_rota")).alias("route_type"), F.trim("shape_id").alias("shape_id"), text.decimal_comma(F.col("extensao")).alias("length_m"), F.trim("consorcio").alias("consortium"))


def parse_stops(raw: DataFrame, json_col: str) -> DataFrame:
    f = raw.select(F.explode(F.from_json(json_col, STOPS)["features"]).alias("f"))
    ok = (F.col("f.geometry.type") == "Point") & (F.size("f.geometry.coordinates") >= 2) & (F.trim(F.coalesce("f.properties.stop_id", F.lit(""))) != "")
    return f.filter(ok).select(F.trim("f.properties.stop_id").alias("code"), F.trim("f.properties.stop_name").alias("name"), F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"))


def parse_line(raw: DataFrame, json_col: str) -> DataFrame:
    """A GeoJSON line string as vertices; null with fewer than two."""
    g = F.from_json(json_col, LINE)
    v = F.transform(F.filter(g["coordinates"], lambda c: F.size(c) >= 2), lambda c: F.struct(c[0].alias("lon"), c[1].alias("lat")))
    return raw.withColumn("vertices", F.when(F.size(v) >= 2, v))


def parse_pois(raw: DataFrame, json_col: str) -> DataFrame:
    """Map elements to classified POIs; unnamed, unclassified and doubtful ones go."""
    e = raw.select(F.explode(F.from_json(json_col, ELEMENTS)["elements"]).alias("e")).select("e.*")
    named = e.withColumn("name", text.poi_name(F.col("tags"))).filter(F.trim(F.coalesce("name", F.lit(""))) != "")
    made = named.withColumn("c", text.poi_class(F.col("tags"), F.col("name"))).filter("c IS NOT NULL").filter(text.poi_trusted(F.col("c.category"), F.col("name")))
    lat, lon = (F.when(F.col("type") == "node", F.col(x)).otherwise(F.col(f"center.{x}")) for x in ("lat", "lon"))
    return made.select("id", F.trim("name").alias("name"), "c.category", "c.priority", lat.alias("lat"), lon.alias("lon")).filter("lat IS NOT NULL AND lon IS NOT NULL")


def match_stations(stations: DataFrame, places: DataFrame, aliases: DataFrame) -> DataFrame:
    """Station names to places: exact, then by alias, then by a first word of four letters or more.

    ``stations`` has station, ``places`` place (both as normalised by ``text.plain_name``),
    ``aliases`` station and place.  Prefix ties go to the smallest place.
    """
    p = places.select("place").distinct()
    exact = stations.join(p, F.col("station") == F.col("place")).select("station", "place", F.lit(1).alias("step"))
    alias = stations.join(aliases, "station").join(p, "place").select("station", "place", F.lit(2).alias("step"))
    word = F.split_part(F.col("station"), F.lit(" "), F.lit(1))
    heads = stations.withColumn("word", word).filter(F.length("word") >= 4).withColumn("head", F.substring("word", 1, 4))
    byhead = p.withColumn("head", F.substring("place", 1, 4))
    prefix = heads.join(byhead, "head").filter(F.col("place").startswith(F.col("word"))).select("station", "place", F.lit(3).alias("step"))
    w = Window.partitionBy("station").orderBy("step", "place")
    return exact.unionByName(alias).unionByName(prefix).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def chain_parts(parts: list[list[tuple[float, float]]], joint: float = 0.0001) -> list[tuple[float, float]]:
    """Line parts joined end to end: always the part with the nearest end, turned if need be."""
    left = [list(map(tuple, p)) for p in parts if len(p) >= 2]
    if not left:
        return []
    out = left.pop(0)
    gap = lambda a, b: ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5
    while left:
        tail = out[-1]
        k = min(range(2 * len(left)), key=lambda i: gap(tail, left[i // 2][-(i % 2)]))
        part = left.pop(k // 2)
        part = part[::-1] if k % 2 else part
        out += part[1:] if gap(tail, part[0]) < joint else part
    return out


@F.pandas_udf(ArrayType(StructType([StructField("lon", DoubleType()), StructField("lat", DoubleType())])))
def _chained(points: pd.Series, sizes: pd.Series) -> pd.Series:
    out = []
    for ps, ns in zip(points, sizes, strict=True):
        if ps is None or ns is None:
            out.append(None)
            continue
        pairs = iter([(p["lon"], p["lat"]) for p in ps])
        out.append([{"lon": x, "lat": y} for x, y in chain_parts([[next(pairs) for _ in range(n)] for n in ns])])
    return pd.Series(out)


def chained(parts: Column) -> Column:
    """``chain_parts`` on an array of arrays of (lon, lat) structs: sequential within one geometry."""
    return _chained(F.flatten(parts), F.transform(parts, lambda p: F.size(p)))
