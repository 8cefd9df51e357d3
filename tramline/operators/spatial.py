"""Spatial joins and matching.  Distance joins are equi-joins on grid cells, then exact distances."""

from __future__ import annotations

from math import cos, radians

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import geo

#: Rows of a static side that is sent to every task; beyond it the join shuffles.
SENT_ROWS = 500_000
#: Points of one place that meet others as one list.
TOGETHER = 2048


def places(points: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The places where points are, each once."""
    return points.select(*(extra or []), "lat", "lon").filter("lat IS NOT NULL AND lon IS NOT NULL").distinct()


def near_places(left: DataFrame, right: DataFrame, metres: float, extra: list[str] | None = None, metric=geo.ellipsoid, as_col: str = "metres") -> DataFrame:
    """Pairs of different rows (``extra``, lat, lon) and (``extra``, r_lat, r_lon) at most ``metres`` apart: a join on cells, and exact distances.

    The left side is spread over its 3 x 3 cells.  Spark's sizes know nothing of that, so it is dealt and never sent whole; the right
    side goes to every task only where its counted rows are few.
    """
    extra = extra or []
    a = geo.with_cell(left, metres, spread=True)
    b = geo.with_cell(right, metres).withColumnsRenamed({"lat": "r_lat", "lon": "r_lon"})
    pairs = a.join(_sent(b), [*extra, "cell"]).drop("cell")
    return pairs.withColumn(as_col, metric(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))).filter(F.col(as_col) <= metres)


def _lists(points: DataFrame, key: list[str], name: str) -> DataFrame:
    """``key``, a number and ``name``: the other columns of the points of a place as lists of at most ``TOGETHER``."""
    others = [c for c in points.columns if c not in key]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*(others or [F.lit(0)])))
    cut = points.withColumn(f"{name}_n", F.floor((nth - 1) / TOGETHER))
    return cut.groupBy(*key, f"{name}_n").agg(F.collect_list(F.struct(*others, F.lit(None).alias("__none"))).alias(name))


def within(left: DataFrame, right: DataFrame, metres: float, extra: list[str] | None = None, metric=geo.ellipsoid, as_col: str = "metres", digits: int | None = None) -> DataFrame:
    """Pairs of points at most ``metres`` apart (and equal in ``extra`` columns), the distance rounded to ``digits``.

    Distances are computed, and rounded, once for each pair of places (``near_places``); the points of a place are lists of
    at most ``TOGETHER``. Lists that meet are dealt over the tasks, and only there become rows, which are streamed and not shuffled.
    Right columns must not clash with left ones but for ``extra``, ``lat`` and ``lon`` (which come as r_lat, r_lon).
    """
    extra, session = extra or [], left.sparkSession
    key, r_key = [*extra, "lat", "lon"], [*extra, "r_lat", "r_lon"]
    pairs = near_places(places(left, extra), places(right, extra), metres, extra, metric, as_col)
    pairs = _sent(pairs if digits is None else pairs.withColumn(as_col, F.round(as_col, digits)))
    there = right.withColumnsRenamed({"lat": "r_lat", "lon": "r_lon"})
    met = _lists(left, key, "__left").join(pairs, key).join(_lists(there, r_key, "__right").hint("merge"), r_key)
    parts = 2 * max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    each = met.repartition(parts, *key, "r_lat", "r_lon", "__left_n", "__right_n").withColumn("__l", F.explode("__left")).withColumn("__r", F.explode("__right"))
    own = lambda rows, k, at: [F.col(f"{at}.`{c}`") for c in rows.columns if c not in k]
    return each.select(*key, *own(left, key, "__l"), as_col, "r_lat", "r_lon", *own(there, r_key, "__r"))


def _least(rows: DataFrame, key: list[str], order: list, columns: list[str]) -> DataFrame:
    """``columns`` of the first row of each key in ``order``; combined before the shuffle."""
    names = [*order, *(F.col(c).alias(f"own_{c}") for c in columns)]
    return rows.groupBy(*key).agg(F.min(F.struct(*names)).alias("b")).select(*key, *(F.col(f"b.own_{c}").alias(c) for c in columns))


def nearby(points: DataFrame, lat: float, lon: float, metres: float, limit: int, key: str) -> DataFrame:
    """The nearest points within a radius: a box that reaches the scan, exact distances, a top-k."""
    margin = metres / geo.DEGREE_METRES * 1.001
    box = points.filter(F.col("lat").between(lat - margin, lat + margin))
    far = min(90.0, abs(lat) + margin)
    wide = margin / max(cos(radians(far)), 1e-9)
    if wide < 180:  # near a pole every meridian is near
        west, east = lon - wide, lon + wide
        here = F.col("lon").between(west, east)
        box = box.filter(here | (F.col("lon") >= west + 360) | (F.col("lon") <= east - 360))
    d = geo.ellipsoid(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    return box.withColumn("metres", d).filter(F.col("metres") <= metres).orderBy("metres", key).limit(limit)


def pois_by_point(pois: DataFrame, lat: float, lon: float, metres: float, true_width: bool = False) -> DataFrame:
    """POIs in a degree box and radius.  The box takes a degree of longitude for one of latitude, which is part of
    the result (points east and west in the radius fall out); ``true_width`` corrects that."""
    m = metres / geo.CELL_METRES
    wide = m * 2 if true_width else m
    box = pois.filter(F.col("lat").between(lat - m, lat + m) & F.col("lon").between(lon - wide, lon + wide))
    return box.withColumn("metres", geo.haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))).filter(F.col("metres") <= metres)


def vertices(itineraries: DataFrame) -> DataFrame:
    """One row a vertex, numbered from 1."""
    return itineraries.select("itinerary_id", "line_id", F.posexplode("vertices").alias("i", "p")).select("itinerary_id", "line_id", (F.col("i") + 1).alias("vertex"), F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"))


def stop_candidates(itineraries: DataFrame, stops: DataFrame, metres: float) -> DataFrame:
    """For each itinerary and stop in reach its nearest vertex; ties go to the earlier vertex.

    The nearest vertex is found once for each place where stops are.
    """
    v = vertices(itineraries).withColumnRenamed("line_id", "v_line")
    pairs = near_places(places(stops), v, metres)
    nearest = _least(pairs, ["itinerary_id", "lat", "lon"], [F.round("metres", 6).alias("about"), "vertex"], ["vertex", "metres"])
    return stops.select("stop_id", "lat", "lon").join(_sent(nearest), ["lat", "lon"]).select("itinerary_id", "stop_id", "vertex", "metres")


def first_stops(stops: DataFrame) -> DataFrame:
    """Of the stops at one place that with the smallest id: only it can win a vertex."""
    return stops.groupBy("lat", "lon").agg(F.min("stop_id").alias("stop_id"))


def vertex_winners(candidates: DataFrame) -> DataFrame:
    """For each itinerary and vertex the nearest stop; ties go to the smaller id."""
    return _least(candidates, ["itinerary_id", "vertex"], [F.round("metres", 6).alias("about"), "stop_id"], ["stop_id", "metres"]).select("itinerary_id", "stop_id", "vertex", "metres")


def stop_sequence(itineraries: DataFrame, stops: DataFrame, metres: float, perp_max: float = 15.0, terminal: float = 0.6, ends: tuple[float, float] = (0.03, 0.97), least: float = 0.4, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Stops of every itinerary in order, all itineraries in one job.

    Candidates, winners, then the terminal radius, the perpendicular filter (in degrees, as
    stored data has it), the score and the numbering by fraction.
    """
    firsts = first_stops(stops)
    won = vertex_winners(stop_candidates(itineraries, firsts, metres))
    full = won.join(firsts.hint("merge"), "stop_id").join(itineraries.select("itinerary_id", "vertices"), "itinerary_id")
    f = geo.locate(F.col("vertices"), F.col("lon"), F.col("lat"))
    full = full.withColumn("fraction", F.round(f, 9))
    a, b = F.get("vertices", F.greatest(F.col("vertex") - 2, F.lit(0))), F.get("vertices", F.least(F.col("vertex"), F.size("vertices") - 1))
    full = full.withColumn("perp", geo.perpendicular(a["lon"], a["lat"], b["lon"], b["lat"], F.col("lon"), F.col("lat")))
    at_end = (F.col("fraction") < ends[0]) | (F.col("fraction") > ends[1])
    ok = full.filter(~at_end | (F.col("metres") <= metres * terminal)).filter(F.col("perp") <= perp_max)
    ok = ok.withColumn("score", geo.composite_score(F.col("metres"), metres, F.col("perp"), perp_max, *weights)).filter(F.col("score") >= least)
    w = Window.partitionBy("itinerary_id").orderBy("fraction", "stop_id")
    return ok.withColumn("seq", F.row_number().over(w).cast("long")).select("itinerary_id", "stop_id", "fraction", "metres", "score", "seq")


def place_fractions(points: DataFrame, itineraries: DataFrame) -> DataFrame:
    """(itinerary_id, lat, lon, fraction, metres): the places of ``points`` on their itineraries and their distances from them, each place once."""
    at = places(points, ["itinerary_id"]).join(_sent(itineraries.select("itinerary_id", "vertices")), "itinerary_id")
    v = F.col("vertices")
    return _sent(at.select("itinerary_id", "lat", "lon", geo.locate(v, F.col("lon"), F.col("lat")).alias("fraction"), geo.point_line_metres(v, F.col("lat"), F.col("lon")).alias("metres")))


def new_relations(sequence: DataFrame, existing: DataFrame) -> DataFrame:
    """Numbered before the known ones are left out, so numbers may have gaps."""
    return sequence.join(existing.select("itinerary_id", "stop_id"), ["itinerary_id", "stop_id"], "left_anti")


def poi_nearest_stop(pois: DataFrame, links: DataFrame, stops: DataFrame, metres: float = 150.0) -> DataFrame:
    """For each itinerary and POI the nearest of the itinerary's stops in reach; ties to the smaller seq."""
    own = links.select("itinerary_id", "stop_id", "seq").join(stops.select("stop_id", "lat", "lon").hint("merge"), "stop_id")
    own = _least(own, ["itinerary_id", "lat", "lon"], ["seq", "stop_id"], ["seq", "stop_id"])  # the others of a place lose every tie
    pairs = near_places(places(pois), own, metres, metric=geo.haversine)
    nearest = _least(pairs, ["itinerary_id", "lat", "lon"], [F.round("metres", 6).alias("about"), "seq", "stop_id"], ["stop_id", "metres"])
    return pois.select("poi_id", "lat", "lon").join(_sent(nearest), ["lat", "lon"]).select("itinerary_id", "poi_id", "stop_id", "metres")


def compete(found: DataFrame, existing: DataFrame, links: DataFrame) -> DataFrame:
    """Found (itinerary, poi, stop, metres) against the POI's stored relations: insert, replace, or skip.

    Only relations with stops of the same itinerary (``links``) compete; of several the nearest.
    """
    own = existing.join(links.select("itinerary_id", "stop_id").distinct(), "stop_id")
    had = own.groupBy("itinerary_id", "poi_id").agg(F.min(F.struct(F.col("metres").alias("m"), F.col("stop_id").alias("s"))).alias("had"))
    both = found.join(had, ["itinerary_id", "poi_id"], "left")
    action = F.when(F.col("had").isNull(), "insert").when(F.col("had.s") == F.col("stop_id"), "skip").when(F.col("metres") < F.col("had.m"), "replace").otherwise("skip")
    return both.withColumn("action", action).withColumn("old_stop", F.col("had.s")).drop("had")


def bounding_box(points: DataFrame) -> DataFrame:
    return points.agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))


def tiles(box: DataFrame, size: float = 0.027) -> DataFrame:
    """The box cut into tiles, the outer ones clipped."""
    steps = lambda lo, hi: F.sequence(F.lit(0), F.greatest(F.ceil(F.round((hi - lo) / size, 9)).cast("int") - 1, F.lit(0)))
    ys = box.withColumn("iy", F.explode(steps(F.col("south"), F.col("north"))))
    both = ys.withColumn("ix", F.explode(steps(F.col("west"), F.col("east"))))
    return both.select(
        "iy", "ix", (F.col("south") + F.col("iy") * size).alias("s"), (F.col("west") + F.col("ix") * size).alias("w"),
        F.least(F.col("north"), F.col("south") + (F.col("iy") + 1) * size).alias("n"), F.least(F.col("east"), F.col("west") + (F.col("ix") + 1) * size).alias("e"),
    )


def segment_rows(itineraries: DataFrame) -> DataFrame:
    """One row a segment: its ends, planar length, the length up to its begin (``upto``) and its end (``done``), and the whole."""
    each = itineraries.select("itinerary_id", "line_id", F.posexplode(geo.segments(F.col("vertices"))).alias("k", "s"))
    flat = each.select("itinerary_id", "line_id", "k", F.col("s.a.lon").alias("ax"), F.col("s.a.lat").alias("ay"), F.col("s.b.lon").alias("bx"), F.col("s.b.lat").alias("by"), F.col("s.n").alias("n"))
    w = Window.partitionBy("itinerary_id").orderBy("k")
    run = lambda upto: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, upto)), F.lit(0.0))
    whole = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return flat.withColumn("upto", run(-1)).withColumn("done", run(0)).withColumn("total", whole)


def _sent(side: DataFrame) -> DataFrame:
    """A static side for every task where its counted rows are few; else for a shuffled join that keeps no side in memory."""
    return F.broadcast(side) if side.limit(SENT_ROWS + 1).count() <= SENT_ROWS else side.hint("merge")


def cell_size(metres: float) -> float:
    """Degrees of a cell's side in ``covered_segments``."""
    return 2 * metres / geo.DEGREE_METRES


def covered_segments(segments: DataFrame, metres: float) -> DataFrame:
    """Segments in every cell from which one may be the nearest within ``metres``, in metres or in degrees."""
    size = cell_size(metres)
    far = F.least(F.lit(89.9), F.greatest(F.abs("ay"), F.abs("by")) + size)
    reach = F.lit(metres / geo.DEGREE_METRES * 1.001) / F.cos(F.radians(far))
    at = lambda a, b: F.sequence(F.floor((F.least(a, b) - reach) / size), F.floor((F.greatest(a, b) + reach) / size))
    return segments.withColumn("cy", F.explode(at("ay", "by"))).withColumn("cx", F.explode(at("ax", "bx")))


def _point_at(rows: DataFrame, bins: DataFrame, fraction: Column, name: str, parts: int) -> DataFrame:
    """``rows`` with (lat, lon) as ``name`` at a fraction of their itinerary: an equi-join on the piece of the line it is in."""
    at = rows.withColumn("goal", F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction)) * F.col("total")).withColumn("piece", F.floor(F.col("goal") / F.nullif(F.col("total"), F.lit(0.0)) * parts))
    b = bins.select("itinerary_id", "piece", *(F.col(c).alias(f"b_{c}") for c in ("k", "ax", "ay", "bx", "by", "n", "upto", "done")))
    here = (F.col("b_done") >= F.col("goal")) & ((F.col("b_upto") < F.col("goal")) | (F.col("b_k") == 0))
    t = F.coalesce((F.col("goal") - F.col("b_upto")) / F.nullif(F.col("b_n"), F.lit(0.0)), F.lit(0.0))
    spot = F.struct((F.col("b_ay") + t * (F.col("b_by") - F.col("b_ay"))).alias("lat"), (F.col("b_ax") + t * (F.col("b_bx") - F.col("b_ax"))).alias("lon"))
    return at.join(b, ["itinerary_id", "piece"]).filter(here).withColumn(name, spot).select(*rows.columns, name)


def match_routes(pings: DataFrame, itineraries: DataFrame, heading: str, metres: float = 250.0, most: float = 80.0, key: str = "event_id", reach: float = 0.025, parts: int = 64) -> DataFrame:
    """The itinerary of its line that each ping is on: in reach, heading within ``most`` degrees, best by (difference, distance, id).

    Lines are cut once into segments with their cells.  A ping meets only the segments of its line
    that its cell can reach; the nearest gives distance and fraction, and the local heading comes from
    the two pieces of line about that fraction.  Pings are dealt by ``key`` once, over as many
    parts as shuffles have, and stay there; the columns are plain, so that the work is compiled.
    """
    segments = segment_rows(itineraries)
    size = cell_size(metres)
    n = int(pings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = F.struct(*(F.col(f"`{c}`") for c in pings.columns)).alias("ping")
    dealt = pings.repartition(n, key).select(F.col(key).alias("ping_key"), whole, "line_id", "lat", "lon", F.floor(F.col("lat") / size).alias("cy"), F.floor(F.col("lon") / size).alias("cx"))
    near = dealt.join(_sent(covered_segments(segments, metres)), ["line_id", "cy", "cx"])
    near = geo.beside_segments(near)
    spot = F.struct(F.col("apart").alias("d"), "k", (F.col("upto") + F.col("t") * F.col("n")).alias("at"))
    fit = near.groupBy("ping_key", "itinerary_id").agg(F.min("gap").alias("metres"), F.min(spot).alias("spot"), F.first("total").alias("total"), F.first("ping").alias("ping")).filter(F.col("metres") <= metres)
    fit = fit.withColumn("fraction", F.coalesce(F.col("spot.at") / F.nullif(F.col("total"), F.lit(0.0)), F.lit(0.0))).drop("spot")
    piece = lambda c: F.floor(F.col(c) / F.nullif(F.col("total"), F.lit(0.0)) * parts)
    bins = _sent(segments.withColumn("piece", F.explode(F.sequence(piece("upto"), piece("done")))))
    tips = _point_at(_point_at(fit, bins, F.col("fraction") - reach, "tail", parts), bins, F.col("fraction") + reach, "head", parts)
    way = geo.bearing(F.col("tail.lat"), F.col("tail.lon"), F.col("head.lat"), F.col("head.lon"))
    placed = tips.withColumn("route_heading", way).withColumn("diff", geo.heading_difference(F.col("route_heading"), F.col(f"ping.`{heading}`"))).filter(F.col("diff") < most)
    order = F.struct(F.round("diff", 6).alias("d"), F.round("metres", 6).alias("m"), "itinerary_id", "metres", "fraction", "route_heading", "diff")
    best = placed.groupBy("ping_key").agg(F.min(order).alias("b"), F.first("ping").alias("ping"))
    return best.select("ping.*", *(f"b.{c}" for c in ("itinerary_id", "metres", "fraction", "route_heading", "diff")))


def next_stop(matched: DataFrame, links: DataFrame, key: str = "event_id") -> DataFrame:
    """The stop of the itinerary with the least fraction beyond the ping's; none leaves nulls.

    Of the stops at one fraction of an itinerary only the first can be the next one, so an itinerary's sorted array
    has an entry a fraction, however many stops there are; a ping looks up its next stop without a row for each pair.
    """
    ahead = F.get(F.filter("stops", lambda s: s["fraction"] > F.col("fraction")), 0)
    found = matched.join(_sent(stops_in_order(links)), "itinerary_id", "left").withColumn("next", ahead)
    return found.select(*matched.columns, F.col("next.stop_id").alias("next_stop"), F.col("next.fraction").alias("next_fraction"))


def stops_in_order(links: DataFrame, *more: str) -> DataFrame:
    """itinerary_id and ``stops``, its array of (fraction, stop_id and ``more``), by fraction; of several at one fraction the smallest stop_id."""
    first = links.groupBy("itinerary_id", "fraction").agg(F.min("stop_id").alias("stop_id"))
    if more:
        first = first.join(links.select("itinerary_id", "fraction", "stop_id", *more).hint("merge"), ["itinerary_id", "fraction", "stop_id"])
    return first.groupBy("itinerary_id").agg(F.array_sort(F.collect_list(F.struct("fraction", "stop_id", *more))).alias("stops"))


def heading_or(previous: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column, least: float = 10.0) -> Column:
    """Bearing of a move of at least ``least`` metres, else the previous one."""
    far = geo.haversine(lat1, lon1, lat2, lon2) >= least
    return F.when(far, geo.bearing(lat1, lon1, lat2, lon2)).otherwise(previous)
