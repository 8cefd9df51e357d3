"""Vehicle pings in batch: normalising, de-duplication, smoothing, route state, passages, arrivals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import geo, text

BUS_PING = "struct<ordem:string,latitude:string,longitude:string,datahora:string,velocidade:string,linha:string,datahoraenvio:string,datahoraservidor:string>"
BRT_PING = "struct<veiculos:array<struct<codigo:string,linha:string,latitude:double,longitude:double,dataHora:bigint,velocidade:double,direcao:string,sentido:string>>>"


def normalise_bus(raw: DataFrame, json_col: str, as_of: str) -> DataFrame:
    """Raw bus pings (all text) to typed rows; a row without readable coordinates goes."""
    p = raw.select(F.from_json(json_col, BUS_PING).alias("p")).select("p.*")
    now = F.lit(as_of).cast("timestamp")
    out = p.select(
        text.upper_trim(F.col("ordem")).alias("vehicle_id"), text.upper_trim(F.col("linha")).alias("line_code"), text.decimal_comma(F.col("latitude")).alias("lat"),
        text.decimal_comma(F.col("longitude")).alias("lon"), text.number_or_zero(F.col("velocidade")).alias("speed"), text.epoch_millis(F.col("datahora"), now).alias("ts"),
    )
    return out.filter("lat IS NOT NULL AND lon IS NOT NULL AND vehicle_id IS NOT NULL")


def normalise_brt(raw: DataFrame, json_col: str) -> DataFrame:
    """BRT payloads (an array each); rows without code, on line 0 or at 0/0 go."""
    p = raw.select(F.explode(F.from_json(json_col, BRT_PING)["veiculos"]).alias("p")).select("p.*")
    ok = (F.trim(F.coalesce("codigo", F.lit(""))) != "") & (F.trim(F.coalesce("linha", F.lit(""))) != "") & (F.trim("linha") != "0") & (F.col("latitude") != 0) & (F.col("longitude") != 0)
    return p.filter(ok).select(
        F.concat(F.lit("BRT-"), text.upper_trim(F.col("codigo"))).alias("vehicle_id"), text.upper_trim(F.col("linha")).alias("line_code"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
        F.coalesce("velocidade", F.lit(0.0)).alias("speed"), F.timestamp_millis("dataHora").alias("ts"), F.trim("direcao").try_cast("double").alias("heading"),
    )


def latest(pings: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """The newest ping of each vehicle, ties to the larger event id; combined before the shuffle."""
    others = [c for c in pings.columns if c not in (key, "ts", "event_id")]
    best = pings.groupBy(key).agg(F.max(F.struct("ts", "event_id", *others)).alias("b"))
    return best.select(key, "b.*")


def fresh(pings: DataFrame, as_of: str, most_s: int = 300) -> DataFrame:
    """Pings at most so old; those of the future stay."""
    return pings.filter(F.expr(f"timestampdiff(SECOND, ts, TIMESTAMP_NTZ '{as_of}')") <= most_s)


def _by_vehicle():
    return Window.partitionBy("vehicle_id").orderBy("ts", "event_id")


def with_previous(pings: DataFrame) -> DataFrame:
    w = _by_vehicle()
    return pings.select("*", *(F.lag(c).over(w).alias(f"prev_{c}") for c in ("lat", "lon", "ts")))


def with_heading(pings: DataFrame, least: float = 10.0) -> DataFrame:
    """Bearing from the previous ping; a shorter move keeps the last bearing."""
    p = with_previous(pings)
    moved = geo.haversine(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon")) >= least
    raw = F.when(moved, geo.bearing(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon")))
    return p.withColumn("raw", raw).withColumn("heading", F.last("raw", ignorenulls=True).over(_by_vehicle().rowsBetween(Window.unboundedPreceding, 0))).drop("raw")


def smooth_speed(pings: DataFrame, size: int = 3, most: float = 90.0) -> DataFrame:
    """Mean of the last accepted speeds; a rejected reading leaves it as it was, null before any."""
    ok = F.col("speed") <= most
    accepted = pings.filter(ok).withColumn("mean_speed", F.avg("speed").over(_by_vehicle().rowsBetween(1 - size, 0)))
    both = accepted.unionByName(pings.filter(~ok | F.col("speed").isNull()).withColumn("mean_speed", F.lit(None).cast("double")))
    return both.withColumn("mean_speed", F.last("mean_speed", ignorenulls=True).over(_by_vehicle().rowsBetween(Window.unboundedPreceding, 0)))


def line_switches(pings: DataFrame) -> DataFrame:
    w = _by_vehicle()
    old = F.lag("line_code").over(w)
    return pings.withColumn("old_line", old).filter(F.upper("old_line") != F.upper("line_code"))


def stop_by_name(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` (itinerary_id, stop: a name, fraction) with stop_id, the first stop of that name not before the fraction; rows without one go.

    ``links``: itinerary_id, stop_id, name, fraction.  A name's stops on an itinerary are one sorted list with an entry a fraction.
    """
    lists = first_named(links).groupBy("itinerary_id", F.col("name").alias("stop")).agg(F.array_sort(F.collect_list(F.struct("fraction", "stop_id"))).alias("stops"))
    ahead = F.get(F.filter("stops", lambda s: s["fraction"] >= F.col("fraction")), 0)["stop_id"]
    return rows.join(lists, ["itinerary_id", "stop"]).withColumn("stop_id", ahead).filter("stop_id IS NOT NULL").select(*rows.columns, "stop_id")


def first_named(links: DataFrame) -> DataFrame:
    """Of the stops of one name at one fraction of an itinerary that with the smallest id: only it can be the first ahead, however many share name and place."""
    return links.groupBy("itinerary_id", "name", "fraction").agg(F.min("stop_id").alias("stop_id"))


def near_stop(rows: DataFrame, gate: float = 150.0) -> DataFrame:
    """Rows that may be passages: on an itinerary, at a known place of it, a named next stop at most ``gate`` metres away (stop, stop_m)."""
    return rows.filter("itinerary_id IS NOT NULL AND fraction IS NOT NULL").filter(F.trim(F.coalesce("stop", F.lit(""))) != "").filter(F.col("stop_m") <= gate)


def passages(rows: DataFrame, most_s: int = 1800, gate: float = 150.0) -> DataFrame:
    """Rows (vehicle_id, itinerary_id, event_id, ts, fraction, length_m, stop, stop_m) near a stop where the stop changes.

    With the time since the passage before (null if negative or over ``most_s``) and the way since
    (null unless the fraction grew).
    """
    w = Window.partitionBy("vehicle_id", "itinerary_id").orderBy("ts", "event_id")
    heads = near_stop(rows, gate).withColumn("old", F.lag("stop").over(w)).filter("old IS NULL OR old <> stop")
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("lag_ts").cast("timestamp"))) / 1e6
    out = heads.withColumn("lag_ts", F.lag("ts").over(w)).withColumn("lag_f", F.lag("fraction").over(w)).withColumn("gap", gap)
    more = ["stop_id"] if "stop_id" in rows.columns else []
    return out.select(
        "vehicle_id", "itinerary_id", "event_id", "ts", "stop", *more, F.when(F.col("gap").between(0, most_s), F.round("gap", 6)).alias("secs_since_prev"),
        F.when(F.col("fraction") > F.col("lag_f"), F.round((F.col("fraction") - F.col("lag_f")) * F.col("length_m"), 6)).alias("leg_m"),
    )


def clock(rows: DataFrame, zone: str = "America/Sao_Paulo") -> DataFrame:
    """Local hour, and weekday with 0 for Sunday, of a UTC time ``ts``."""
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone)
    return rows.withColumn("hour", F.hour(local)).withColumn("weekday", F.dayofweek(local) - 1)


def eligible(rows: DataFrame) -> Column:
    """Whether an arrival model may score a row; a line code, where there is one, must not be blank."""
    ok = (F.col("next_m") > 10) & (F.col("next_m") < 5000) & (F.col("mean_speed") >= 0) & (F.col("fraction") > 0) & (F.col("fraction") < 1)
    if "line_code" in rows.columns:
        ok = ok & (F.trim(F.coalesce("line_code", F.lit(""))) != "")
    return F.coalesce(ok, F.lit(False))


def eta_features(rows: DataFrame) -> DataFrame:
    """Rows that an arrival model may score."""
    return rows.filter(eligible(rows))


def current(snapshots: DataFrame, as_of: str, active_s: int, recent_s: int) -> DataFrame:
    """What a reader of vehicles sees: the newest row of each at ``as_of``, active while it is young, else without signal, else nothing."""
    age = (F.unix_micros(F.lit(as_of).cast("timestamp_ntz").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    last = latest(snapshots.filter(age >= 0)).withColumn("age_s", age)
    return last.filter(F.col("age_s") < recent_s).withColumn("status", F.when(F.col("age_s") < active_s, "active").otherwise("no_signal")).drop("age_s")


def no_signal(index: DataFrame, cycle: DataFrame, recent: DataFrame) -> DataFrame:
    """The cycle's vehicles, and those of the line index it lacks whose recent state lives, as ``no_signal``."""
    lost = index.join(cycle.select("vehicle_id"), "vehicle_id", "left_anti").select("vehicle_id").distinct()
    return cycle.withColumn("status", F.lit("active")).unionByName(recent.join(lost, "vehicle_id", "left_semi").withColumn("status", F.lit("no_signal")))


def by_line(vehicles: DataFrame) -> DataFrame:
    """One message a line for a push sink."""
    return vehicles.groupBy("line_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("vehicle_id", "lat", "lon", "status")))).alias("message"))


def arrivals(matched: DataFrame, links: DataFrame, stop_id, lengths: DataFrame, as_of: str) -> DataFrame:
    """Vehicles that have not passed a stop: metres to it, seconds, and a clock time not before ``as_of``.

    Of a line's itineraries through the stop that have vehicles the nearest to it counts.
    """
    at = links.filter(F.col("stop_id") == stop_id).groupBy("itinerary_id", "line_id").agg(F.min("fraction").alias("stop_fraction"))
    live = matched.join(F.broadcast(at.drop("line_id")), "itinerary_id")
    first = Window.partitionBy("line_id").orderBy("stop_fraction", "itinerary_id")
    chosen = live.select("line_id", "itinerary_id", "stop_fraction").distinct().withColumn("rn", F.row_number().over(first)).filter("rn = 1").select("itinerary_id")
    rows = live.join(chosen, "itinerary_id", "left_semi").filter(F.col("fraction") <= F.col("stop_fraction")).join(lengths, "itinerary_id")
    rows = rows.withColumn("metres", (F.col("stop_fraction") - F.col("fraction")) * F.col("length_m"))
    eta = geo.eta_seconds(F.col("metres"), F.col("speed"))
    due = F.greatest(F.lit(as_of).cast("timestamp_ntz"), F.col("ts") + F.make_dt_interval(secs=F.floor("eta_s")))
    return rows.withColumn("eta_s", eta).withColumn("due", due).orderBy(F.asc_nulls_last("eta_s"), "vehicle_id")


def board(live: DataFrame, links: DataFrame, stop_id, lengths: DataFrame, as_of: str, zone: str = "America/Sao_Paulo") -> DataFrame:
    """The arrivals board of a stop from matched vehicles (``current`` rows with itinerary_id, line_id, fraction, mean_speed, speed).

    ``links``: itinerary_id, line_id, stop_id, fraction, distance_m.  Of a line's itineraries through the stop that have vehicles
    the one whose stop is nearest to it counts, then the earlier place.  With metres, eta_s by the mean speed or
    else the speed, due (not before ``as_of``) and its local clock time; vehicles without an estimate come last.
    """
    at = links.filter(F.col("stop_id") == stop_id).groupBy("itinerary_id", "line_id").agg(F.min(F.struct("distance_m", "fraction")).alias("p"))
    found = live.drop("line_id").join(F.broadcast(at), "itinerary_id")  # the itineraries of one stop
    best = found.groupBy("line_id").agg(F.min(F.struct("p.distance_m", "p.fraction", "itinerary_id"))["itinerary_id"].alias("itinerary_id"))
    rows = found.join(best, ["line_id", "itinerary_id"]).filter(F.col("fraction") <= F.col("p.fraction")).join(lengths, "itinerary_id", "left")
    rows = rows.withColumn("metres", (F.col("p.fraction") - F.col("fraction")) * F.col("length_m"))
    rows = rows.withColumn("eta_s", geo.eta_seconds(F.col("metres"), F.coalesce("mean_speed", "speed")))
    due = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("eta_s") * 1e6).cast("long"))
    rows = rows.withColumn("due", F.when(F.col("eta_s").isNotNull(), F.greatest(F.lit(as_of).cast("timestamp_ntz").cast("timestamp"), due)))
    rows = rows.withColumn("due_local", F.date_format(F.from_utc_timestamp("due", zone), "HH:mm")).drop("p")
    return rows.orderBy(F.asc_nulls_last("eta_s"), F.asc_nulls_last("metres"), "vehicle_id")


STATE = "vehicle_id long, event_id long, route long, at double, metres double, status string"
#: Route, metres from it, fraction along it, pings without a match in a row.
NO_ROUTE = (None, None, None, 0)


def route_state(rows: DataFrame, gain: float = 30.0, jump: float = 100.0, misses: int = 3, least_speed: float = 3.0) -> DataFrame:
    """The confirmed route of each vehicle, ping by ping.

    Columns in: vehicle_id, event_id, ts, speed, mean_speed (null or absent: the speed counts),
    heading, itinerary_id, fraction, metres; itinerary_id is null where nothing matched.  The same
    route is accepted; another one takes over for a clear gain while the vehicle moves, or a large one; a
    blocked change keeps the old route with the new fraction and distance; a ping without heading keeps
    the confirmed route as it was; a vehicle without match keeps route and fraction for fewer than
    ``misses`` pings.  A fold over a vehicle's own pings in order; between Arrow batches only its
    last state is held.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, NO_ROUTE
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.key != last:
                    last, state = r.key, NO_ROUTE
                state, row = route_step(state, r, gain, jump, misses, least_speed)
                out.append((int(r.key) if r.key else None, r.event_id, *row))
            done = pd.DataFrame(out, columns=["vehicle_id", "event_id", "route", "at", "metres", "status"])
            yield done.astype({"vehicle_id": "Int64", "route": "Int64", "at": "Float64", "metres": "Float64"})

    if "mean_speed" not in rows.columns:
        rows = rows.withColumn("mean_speed", F.lit(None).cast("double"))
    keyed = rows.withColumn("key", F.coalesce(F.col("vehicle_id").cast("string"), F.lit("")))
    in_order = keyed.repartition("key").sortWithinPartitions("key", F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))
    return in_order.mapInPandas(fold, STATE)


def route_step(state: tuple, r, gain: float, jump: float, misses: int, least_speed: float) -> tuple[tuple, tuple]:
    """One ping: (route, metres, fraction, misses) to the next such state and (route, fraction, metres, status)."""
    route, held, at, missed = state
    if pd.isna(r.heading) and route is not None:
        return (route, held, at, 0), (route, at, held, "held")
    if pd.isna(r.heading) or pd.isna(r.itinerary_id):
        missed += 1
        if route is None or missed >= misses:
            return NO_ROUTE, (None, None, None, "none")
        return (route, held, at, missed), (route, at, held, "kept")
    new = int(r.itinerary_id)
    moving = (r.speed if pd.isna(r.mean_speed) else r.mean_speed) >= least_speed
    better = 0.0 if route is None else held - r.metres
    if route is None or new == route or (moving and better > gain) or better > jump:
        status = "first" if route is None else "same" if new == route else "switched"
        return (new, r.metres, r.fraction, 0), (new, r.fraction, r.metres, status)
    return (route, r.metres, r.fraction, 0), (route, r.fraction, r.metres, "blocked")
