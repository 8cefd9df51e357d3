"""Geospatial Column functions.  A line string is an array of (lon, lat) structs in degrees.

Distances in metres come in two kinds: ``haversine`` on a sphere of 6,371 km, and ``ellipsoid``,
a local metric of the WGS84 spheroid that is good to some kilometres.  Fractions along a line are
shares of its planar length in degrees.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPHERE = 6371000.0
#: WGS84.
AXIS, ECC2 = 6378137.0, 0.00669437999014
CELL_METRES = 111000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return 2 * SPHERE * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def _radii(lat: Column) -> tuple[Column, Column]:
    """Metres for each radian of latitude and of longitude (times cos) at a latitude in degrees."""
    w = 1 - ECC2 * F.sin(F.radians(lat)) * F.sin(F.radians(lat))
    return AXIS * (1 - ECC2) / F.pow(w, F.lit(1.5)), AXIS / F.sqrt(w) * F.cos(F.radians(lat))


def ellipsoid(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    m, n = _radii((lat1 + lat2) / 2)
    x, y = n * F.radians(lon2 - lon1), m * F.radians(lat2 - lat1)
    return F.sqrt(x * x + y * y)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360); null for coincident points."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    deg = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.when((lat1 == lat2) & (lon1 == lon2), None).otherwise(F.pmod(deg + 360, F.lit(360.0)))


def heading_difference(a: Column, b: Column) -> Column:
    """0 to 180 degrees between two headings."""
    return F.abs(F.pmod(a - b + 540, F.lit(360.0)) - 180)


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def segments(line: Column) -> Column:
    """(a, b, length, before) of each segment, lengths planar."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(line) - 1), lambda i: F.struct(F.element_at(line, i).alias("a"), F.element_at(line, i + 1).alias("b")))
    sized = F.transform(pairs, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), planar(p["a"]["lon"], p["a"]["lat"], p["b"]["lon"], p["b"]["lat"]).alias("n")))
    return F.when(F.size(line) >= 2, sized)


def planar_length(line: Column) -> Column:
    return F.aggregate(segments(line), F.lit(0.0), lambda acc, s: acc + s["n"])


def length_metres(line: Column) -> Column:
    return F.aggregate(segments(line), F.lit(0.0), lambda acc, s: acc + ellipsoid(s["a"]["lat"], s["a"]["lon"], s["b"]["lat"], s["b"]["lon"]))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once; lambdas compute what they mention for every element."""
    return F.transform(F.array(value), body)[0]


def _share(s: Column, x: Column, y: Column) -> Column:
    """Share along a segment of the place closest to (x, y), clamped to the segment."""
    dx, dy = s["b"]["lon"] - s["a"]["lon"], s["b"]["lat"] - s["a"]["lat"]
    t = ((x - s["a"]["lon"]) * dx + (y - s["a"]["lat"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))


def nearest(line: Column, x: Column, y: Column) -> Column:
    """(distance, fraction, lon, lat) of the place of a line closest to a point; all planar.  The first segment wins ties."""
    shared = F.transform(segments(line), lambda s: F.struct(s.alias("s"), _share(s, x, y).alias("t")))
    placed = F.transform(
        shared,
        lambda e: F.struct(
            e["s"]["n"].alias("n"), e["t"].alias("t"), (e["s"]["a"]["lon"] + e["t"] * (e["s"]["b"]["lon"] - e["s"]["a"]["lon"])).alias("lon"),
            (e["s"]["a"]["lat"] + e["t"] * (e["s"]["b"]["lat"] - e["s"]["a"]["lat"])).alias("lat"),
        ),
    )
    apart = F.transform(placed, lambda e: F.struct(planar(e["lon"], e["lat"], x, y).alias("d"), e["n"].alias("n"), e["t"].alias("t"), e["lon"].alias("lon"), e["lat"].alias("lat")))

    def best(acc: Column, e: Column) -> Column:
        near = e["d"] < acc["d"]
        keep = lambda new, name: F.when(near, new).otherwise(acc[name]).alias(name)
        return F.struct(keep(e["d"], "d"), keep(acc["upto"] + e["t"] * e["n"], "at"), keep(e["lon"], "lon"), keep(e["lat"], "lat"), (acc["upto"] + e["n"]).alias("upto"))

    zero = F.struct(F.lit(float("inf")).alias("d"), F.lit(0.0).alias("at"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("upto"))
    return F.aggregate(apart, zero, best, lambda a: F.struct(a["d"].alias("distance"), F.coalesce(a["at"] / F.nullif(a["upto"], F.lit(0.0)), F.lit(0.0)).alias("fraction"), a["lon"].alias("lon"), a["lat"].alias("lat")))


def locate(line: Column, x: Column, y: Column) -> Column:
    return nearest(line, x, y)["fraction"]


def interpolate(line: Column, fraction: Column) -> Column:
    """The point at a fraction (clamped to 0..1) of a line's planar length."""

    def step(acc: Column, s: Column) -> Column:
        here = (acc["upto"] + s["n"] >= acc["goal"]) & acc["lon"].isNull()
        t = F.coalesce((acc["goal"] - acc["upto"]) / F.nullif(s["n"], F.lit(0.0)), F.lit(0.0))
        along = lambda c: F.when(here, s["a"][c] + t * (s["b"][c] - s["a"][c])).otherwise(acc[c]).alias(c)
        return F.struct(along("lon"), along("lat"), (acc["upto"] + s["n"]).alias("upto"), acc["goal"].alias("goal"))

    goal = F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction)) * planar_length(line)
    zero = F.struct(F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"), F.lit(0.0).alias("upto"), goal.alias("goal"))
    end = F.element_at(line, -1)
    return F.aggregate(segments(line), zero, step, lambda a: F.struct(F.coalesce(a["lon"], end["lon"]).alias("lon"), F.coalesce(a["lat"], end["lat"]).alias("lat")))


def point_line_metres(line: Column, lat: Column, lon: Column) -> Column:
    """Least distance from a point to a line in the local metric at the point."""
    k = pi / 180

    def gaps(r: Column) -> Column:
        flat = lambda p: F.struct(((p["lon"] - lon) * k * r["n"]).alias("x"), ((p["lat"] - lat) * k * r["m"]).alias("y"))
        ends = F.transform(segments(line), lambda s: F.struct(flat(s["a"]).alias("a"), flat(s["b"]).alias("b")))
        shared = F.transform(ends, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), toward(s).alias("t")))
        at = lambda e, c: e["a"][c] + e["t"] * (e["b"][c] - e["a"][c])
        return F.array_min(F.transform(shared, lambda e: F.sqrt(at(e, "x") * at(e, "x") + at(e, "y") * at(e, "y"))))

    def toward(s: Column) -> Column:
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        t = -(s["a"]["x"] * dx + s["a"]["y"] * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))

    m, n = _radii(lat)
    return let(F.struct(m.alias("m"), n.alias("n")), gaps)


def local_heading(line: Column, fraction: Column, reach: float = 0.025) -> Column:
    """Bearing of a line about a fraction, from a little before to a little after."""
    ends = F.struct(interpolate(line, fraction - reach).alias("a"), interpolate(line, fraction + reach).alias("b"))
    return let(ends, lambda e: bearing(e["a"]["lat"], e["a"]["lon"], e["b"]["lat"], e["b"]["lon"]))


def geojson(line: Column) -> Column:
    return F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(line, lambda p: F.array(F.round(p["lon"], 9), F.round(p["lat"], 9))).alias("coordinates")))


def perpendicular(ax: Column, ay: Column, bx: Column, by: Column, x: Column, y: Column) -> Column:
    """Planar distance of (x, y) from the line through a and b; 0 where these coincide."""
    dx, dy = bx - ax, by - ay
    return F.coalesce(F.abs(dx * (y - ay) - dy * (x - ax)) / F.nullif(F.sqrt(dx * dx + dy * dy), F.lit(0.0)), F.lit(0.0))


def compensated(fraction: Column, speed: Column, lag_s: Column, length_m: Column) -> Column:
    """A fraction moved on by the lag, where speed, place and lag make that sensible; else unchanged."""
    ok = fraction.isNotNull() & length_m.isNotNull() & speed.isNotNull() & (speed >= 2) & (fraction < 0.98) & (length_m > 0) & (lag_s > 5) & (lag_s < 120)
    return F.when(ok, F.least(F.lit(1.0), fraction + speed / 3.6 * lag_s / length_m)).otherwise(fraction)


def eta_seconds(metres: Column, speed_kmh: Column) -> Column:
    return F.when(speed_kmh > 0, metres / (speed_kmh * 1000 / 3600))


def composite_score(distance: Column, distance_max: float, perp: Column, perp_max: float, w1: float = 0.5, w2: float = 0.5) -> Column:
    return w1 * (1 - distance / distance_max) + w2 * (1 - F.least(perp / perp_max, F.lit(1.0)))


#: Metres in a degree of latitude are nowhere fewer.
DEGREE_METRES = 110_574.0


def beside_segments(rows: DataFrame) -> DataFrame:
    """``rows`` of a point (lon, lat) and a segment (ax, ay, bx, by) with ``gap``, their distance in metres in the local
    metric at the point, and ``t`` and ``apart``, the share along the segment and the distance of its closest place in degrees.

    Steps are columns of their own, so that none is written out again in the next.
    """
    k, c, zero = pi / 180, F.col, F.lit(0.0)
    m, n = _radii(c("lat"))
    out = rows.withColumns({"__m": k * m, "__n": k * n})
    out = out.withColumns({"__px": (c("ax") - c("lon")) * c("__n"), "__py": (c("ay") - c("lat")) * c("__m"), "__dx": (c("bx") - c("ax")) * c("__n"), "__dy": (c("by") - c("ay")) * c("__m"), "__ex": c("bx") - c("ax"), "__ey": c("by") - c("ay")})
    along = lambda num, x, y: F.greatest(zero, F.least(F.lit(1.0), F.coalesce(num / F.nullif(x * x + y * y, zero), zero)))
    out = out.withColumns({
        "__s": along(-(c("__px") * c("__dx") + c("__py") * c("__dy")), c("__dx"), c("__dy")),
        "t": along((c("lon") - c("ax")) * c("__ex") + (c("lat") - c("ay")) * c("__ey"), c("__ex"), c("__ey")),
    })
    out = out.withColumns({"__gx": c("__px") + c("__s") * c("__dx"), "__gy": c("__py") + c("__s") * c("__dy"), "__cx": c("ax") + c("t") * c("__ex"), "__cy": c("ay") + c("t") * c("__ey")})
    out = out.withColumns({"gap": F.sqrt(c("__gx") * c("__gx") + c("__gy") * c("__gy")), "apart": planar(c("__cx"), c("__cy"), c("lon"), c("lat"))})
    return out.drop("__m", "__n", "__px", "__py", "__dx", "__dy", "__ex", "__ey", "__s", "__gx", "__gy", "__cx", "__cy")


def beside_segment(ax: Column, ay: Column, bx: Column, by: Column, lat: Column, lon: Column) -> Column:
    """(gap, t, apart) of ``beside_segments`` for one segment, inside a lambda over an array of them."""
    k, zero = pi / 180, F.lit(0.0)
    along = lambda num, x, y: F.greatest(zero, F.least(F.lit(1.0), F.coalesce(num / F.nullif(x * x + y * y, zero), zero)))

    def flat(r: Column) -> Column:
        return F.struct(((ax - lon) * r["n"]).alias("px"), ((ay - lat) * r["m"]).alias("py"), ((bx - ax) * r["n"]).alias("dx"), ((by - ay) * r["m"]).alias("dy"))

    def shares(p: Column) -> Column:
        s = along(-(p["px"] * p["dx"] + p["py"] * p["dy"]), p["dx"], p["dy"])
        return F.struct(p["px"], p["py"], p["dx"], p["dy"], s.alias("s"), along((lon - ax) * (bx - ax) + (lat - ay) * (by - ay), bx - ax, by - ay).alias("t"))

    def gaps(q: Column) -> Column:
        x, y = q["px"] + q["s"] * q["dx"], q["py"] + q["s"] * q["dy"]
        return F.struct(F.sqrt(x * x + y * y).alias("gap"), q["t"].alias("t"), planar(ax + q["t"] * (bx - ax), ay + q["t"] * (by - ay), lon, lat).alias("apart"))

    m, n = _radii(lat)
    return let(let(let(F.struct((k * m).alias("m"), (k * n).alias("n")), flat), shares), gaps)


def _cell_columns(row: Column, size: float) -> Column:
    """How many cells a row has: the whole circle over the least width."""
    far = F.least(F.lit(90.0), F.greatest(F.abs(row * size), F.abs((row + 1) * size)))
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(far)) / size)).cast("long")


def with_cell(rows: DataFrame, metres: float, spread: bool = False) -> DataFrame:
    """``rows`` of points (lat, lon) with ``cell``, their grid cell as one long; with ``spread`` a row for each of the cells around that hold every point within ``metres``.

    Rows of cells are ``metres`` high; a row's cells are as wide as its latitude farthest from the equator
    asks for, so that the neighbourhood holds at every latitude and across the 180th meridian.
    At the poles, where no width does, a row is one cell.  Steps are columns of their own: one expression of all nine cells is too large to compile.
    """
    size, steps = metres / DEGREE_METRES * 1.001, F.array(*(F.lit(k) for k in (-1, 0, 1)))
    y = F.floor(F.col("lat") / size).cast("long")
    out = rows.withColumn("__step", F.explode(steps)).withColumn("__y", y + F.col("__step")) if spread else rows.withColumn("__y", y)
    out = out.withColumn("__n", _cell_columns(F.col("__y"), size)).withColumn("__x", F.floor((F.col("lon") + 180.0) / 360.0 * F.col("__n")))
    if spread:
        at = F.array(*(F.pmod(F.col("__x") + k, F.col("__n")) for k in (-1, 0, 1)))
        out = out.withColumn("__around", at).withColumn("__x", F.explode(F.when(F.col("__n") < 3, F.array_distinct("__around")).otherwise(F.col("__around"))))
    else:
        out = out.withColumn("__x", F.pmod("__x", "__n"))
    return out.withColumn("cell", F.shiftleft("__y", 32) + F.col("__x")).drop("__step", "__y", "__n", "__x", "__around")
