"""Where plans register a query next to the SQL that checks it, and SQL texts that several share."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) under its name, with its SQL where SQL can say it."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def haversine(a: str, b: str, c: str, d: str) -> str:
    s = f"(sin(radians({c} - {a}) / 2) * sin(radians({c} - {a}) / 2) + cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) * sin(radians({d} - {b}) / 2))"
    return f"(2 * 6371000e0 * atan2(sqrt({s}), sqrt(1 - {s})))"


def _radii(lat: str) -> tuple[str, str]:
    w = f"(1 - 0.00669437999014e0 * sin(radians({lat})) * sin(radians({lat})))"
    return f"(6378137e0 * (1 - 0.00669437999014e0) / pow({w}, 1.5e0))", f"(6378137e0 / sqrt({w}) * cos(radians({lat})))"


def ellipsoid(a: str, b: str, c: str, d: str) -> str:
    m, n = _radii(f"(({a} + {c}) / 2)")
    return f"sqrt(pow({n} * radians({d} - {b}), 2) + pow({m} * radians({c} - {a}), 2))"


def bearing(a: str, b: str, c: str, d: str) -> str:
    dl = f"radians({d} - {b})"
    deg = f"degrees(atan2(sin({dl}) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos({dl})))"
    return f"(CASE WHEN {a} = {c} AND {b} = {d} THEN NULL ELSE ({deg} + 360) % 360 END)"


def segment_gap(lat: str, lon: str) -> str:
    """Metres from a point to the segment (ax, ay) to (bx, by_)."""
    m, n = _radii(lat)
    px, py, qx, qy = (f"(({c} - {o}) * {k} * (pi() / 180))" for c, o, k in (("ax", lon, n), ("ay", lat, m), ("bx", lon, n), ("by_", lat, m)))
    dx, dy = f"({qx} - {px})", f"({qy} - {py})"
    t = f"greatest(0e0, least(1e0, coalesce(-({px} * {dx} + {py} * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0e0), 0e0)))"
    return f"sqrt(pow({px} + {t} * {dx}, 2) + pow({py} + {t} * {dy}, 2))"


#: Segments of every itinerary with their planar lengths, what is before them and the whole.
SEGMENTS = """seg0 AS (SELECT itinerary_id, line_id, idx, lon AS ax, lat AS ay, lead(lon) OVER w AS bx, lead(lat) OVER w AS by_ FROM vertex WINDOW w AS (PARTITION BY itinerary_id ORDER BY idx)),
seg1 AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS n FROM seg0 WHERE bx IS NOT NULL),
seg AS (SELECT *, sum(n) OVER (PARTITION BY itinerary_id ORDER BY idx) - n AS upto, sum(n) OVER (PARTITION BY itinerary_id) AS total FROM seg1)"""


def share(x: str, y: str) -> str:
    return f"greatest(0e0, least(1e0, coalesce((({x} - ax) * (bx - ax) + ({y} - ay) * (by_ - ay)) / nullif((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay), 0e0), 0e0)))"


def located(points: str, key: str, on: str) -> str:
    """Two tables, ``placed`` and ``spots``: every (key, itinerary) with the fraction of the closest place."""
    t = share("p.lon", "p.lat")
    return f"""placed AS (SELECT p.{key}, seg.*, {t} AS t, p.lon AS x, p.lat AS y, {segment_gap("p.lat", "p.lon")} AS gap FROM {points} p JOIN seg ON {on}),
spots AS (SELECT {key}, itinerary_id, (upto + t * n) / total AS fraction FROM (SELECT *, row_number() OVER (PARTITION BY {key}, itinerary_id
  ORDER BY sqrt((x - (ax + t * (bx - ax))) * (x - (ax + t * (bx - ax))) + (y - (ay + t * (by_ - ay))) * (y - (ay + t * (by_ - ay)))), idx) AS rn FROM placed) WHERE rn = 1)"""


def route_fold(source: str) -> str:
    """``folded``: the confirmed route of every ping of ``source`` (vehicle_id, n from 1 in order, event_id, speed, heading, itinerary_id, fraction, metres), as a recursion."""
    new = "CASE WHEN p.heading IS NULL THEN s.route ELSE p.itinerary_id END"
    step = f"""CASE WHEN p.heading IS NULL AND s.route IS NOT NULL THEN 'held' WHEN {new} IS NULL THEN CASE WHEN s.route IS NULL OR s.missed + 1 >= 3 THEN 'none' ELSE 'kept' END
      WHEN s.route IS NULL THEN 'first' WHEN p.itinerary_id = s.route THEN 'same' WHEN (p.speed >= 3 AND s.metres - p.metres > 30) OR s.metres - p.metres > 100 THEN 'switched' ELSE 'blocked' END"""
    return f"""folded(vehicle_id, n, event_id, route, pos, metres, missed, status) AS (
  SELECT DISTINCT vehicle_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 0, '' FROM {source}
  UNION ALL SELECT vehicle_id, n, event_id, CASE WHEN status = 'none' THEN NULL WHEN status IN ('held', 'kept', 'blocked') THEN old ELSE itinerary_id END,
    CASE WHEN status = 'none' THEN NULL WHEN status IN ('held', 'kept') THEN old_pos ELSE fraction END, CASE WHEN status = 'none' THEN NULL WHEN status IN ('held', 'kept') THEN old_metres ELSE metres END,
    CASE WHEN status = 'kept' THEN missed + 1 ELSE 0 END, status
  FROM (SELECT p.*, s.route AS old, s.pos AS old_pos, s.metres AS old_metres, s.missed, {step} AS status FROM folded s JOIN {source} p ON p.vehicle_id = s.vehicle_id AND p.n = s.n + 1) AS x)"""
