"""The transit tables, derived from the generic tables by one portable SQL text each.

The same text runs in Spark and, as a common table expression, in the SQL that checks a query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The two directions and the places of a line's 21 vertices, as rows.
_D = "(SELECT CAST(r_regionkey AS INTEGER) AS d FROM <region> WHERE r_regionkey < 2)"
_I = "(SELECT CAST(n_nationkey AS INTEGER) AS i FROM <nation> WHERE n_nationkey < 21)"


def num(x: str) -> str:
    """A double literal that both engines read as a double."""
    return f"CAST({x} AS DOUBLE)"


def whole(x: str) -> str:
    return f"CAST(floor({x}) AS BIGINT)"


TABLES = {
    "mode": "SELECT CAST(r_regionkey AS BIGINT) AS mode_id, r_name AS name FROM <region>",
    "line": "SELECT CAST(n_nationkey AS BIGINT) AS line_id, lpad(CAST(n_nationkey AS STRING), 3, '0') AS code, n_name AS name, CAST(n_regionkey AS BIGINT) AS mode_id,"
    " CASE n_nationkey % 3 WHEN 0 THEN 'regular' WHEN 1 THEN 'frescao' ELSE 'brt' END AS route_type FROM <nation>",
    "direction": f"SELECT CAST(n_nationkey * 2 + d AS BIGINT) AS direction_id, concat(n_name, CASE d WHEN 0 THEN ' ida' ELSE ' volta' END) AS name, CAST(n_nationkey AS BIGINT) AS line_id, d FROM <nation> CROSS JOIN {_D} AS dd",
    "vertex": f"SELECT CAST(n_nationkey * 2 + d AS BIGINT) AS itinerary_id, CAST(n_nationkey AS BIGINT) AS line_id, d, CASE d WHEN 0 THEN i ELSE 20 - i END AS idx,"
    f" {num('-43.60')} + {num('0.0025')} * i AS lon, {num('-23.0')} + {num('0.004')} * n_nationkey + {num('0.0004')} * (i % 3) AS lat FROM <nation> CROSS JOIN {_D} AS dd CROSS JOIN {_I} AS ii",
    "stop": f"SELECT c_custkey AS stop_id, CAST(c_custkey AS STRING) AS code, c_name AS name, CAST(c_nationkey AS BIGINT) AS line_id, c_custkey % 21 AS k,"
    f" {num('-43.60')} + {num('0.0025')} * (c_custkey % 21) + {num('0.0003')} * ((c_custkey % 7) - 3) AS lon,"
    f" {num('-23.0')} + {num('0.004')} * c_nationkey + {num('0.0004')} * ((c_custkey % 21) % 3) + {num('0.0003')} * ((c_custkey % 5) - 2) AS lat FROM <customer>",
    "itinerary_stop": f"SELECT stop_id, line_id * 2 + d AS itinerary_id, line_id, fraction, row_number() OVER (PARTITION BY line_id, d ORDER BY fraction, stop_id) AS seq"
    f" FROM (SELECT stop_id, line_id, d, CASE d WHEN 0 THEN k / {num('20')} ELSE 1 - k / {num('20')} END AS fraction FROM <stop> CROSS JOIN {_D} AS dd) AS sd",
    "poi": f"SELECT p_partkey AS poi_id, p_name AS name, p_type AS category, CAST(p_size % 3 + 1 AS BIGINT) AS priority, p_partkey % 25 AS line_id,"
    f" {num('-43.60')} + {num('0.0025')} * ({whole('p_partkey / 25')} % 21) + {num('0.0002')} * ((p_partkey % 11) - 5) AS lon,"
    f" {num('-23.0')} + {num('0.004')} * (p_partkey % 25) + {num('0.0004')} * (({whole('p_partkey / 25')} % 21) % 3) + {num('0.0002')} * ((p_partkey % 13) - 6) AS lat FROM <part>",
    "poi_stop": "SELECT p_partkey AS poi_id, c_custkey AS stop_id FROM <part> JOIN <customer> ON p_partkey = c_custkey UNION ALL SELECT p_partkey AS poi_id, c_custkey AS stop_id FROM <part> JOIN <customer> ON p_partkey = c_custkey + 25",
    "fare": "SELECT o_orderkey AS fare_id, o_custkey % 25 AS line_id, CAST(round(o_totalprice / 100000, 2) AS DECIMAL(18, 2)) AS value, CAST(o_orderdate AS DATE) AS valid_from,"
    " CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 365 AS INT) END AS valid_to, o_orderpriority AS source, o_orderstatus <> 'P' AS active FROM <orders>",
    "ping": f"SELECT event_id, user_id AS vehicle_id, user_id % 25 AS line_id, ts, k, value AS speed,"
    f" {num('-43.60')} + {num('0.0025')} * k + {num('0.0001')} * ((event_id % 5) - 2) AS lon, {num('-23.0')} + {num('0.004')} * (user_id % 25) + {num('0.0004')} * (k % 3) + {num('0.0001')} * ((event_id % 7) - 3) AS lat"
    f" FROM (SELECT event_id, user_id, ts, value, CASE WHEN {whole('n / 21')} % 2 = 0 THEN n % 21 ELSE 20 - n % 21 END AS k"
    " FROM (SELECT event_id, user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM <events>) AS e1) AS e2",
    "station": f"SELECT concat('B', CAST(n_regionkey AS STRING)) AS branch, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS ord, {num('2.3')} * n_nationkey AS km,"
    f" CASE WHEN n_nationkey % 7 <> 0 THEN {num('14400')} + {num('110')} * n_nationkey END AS first_s, {num('-22.9')} + {num('0.01')} * n_nationkey AS lat, {num('-43.2')} - {num('0.02')} * n_nationkey AS lon FROM <nation>",
    "passage": "SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS leg, l_suppkey % 25 AS line_id, l_shipdate AS ts, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity * 30 END AS secs_since_prev FROM <lineitem>",
}


def _names(text: str) -> list[str]:
    return sorted(set(re.findall(r"<(\w+)>", text)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One transit table as a DataFrame; reads only the columns it is made of."""
    own = {n: view(spark, sf_dir, n) if n in TABLES else spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in _names(TABLES[name])}
    return spark.sql(re.sub(r"<(\w+)>", r"{\1}", TABLES[name]), **own)


def prelude(*names: str) -> str:
    """The tables as common table expressions, for SQL that goes on with ``SELECT`` or more of them."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in (*(x for x in _names(TABLES[n]) if x in TABLES), n) if x not in wanted]
    return "WITH " + ", ".join(f"{n} AS ({_plain(TABLES[n])})" for n in wanted) + " "


def _plain(text: str) -> str:
    return re.sub(r"<(\w+)>", r"\1", text)


def itineraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """itinerary_id, line_id, vertices in order: a line string is an array of (lon, lat)."""
    v = view(spark, sf_dir, "vertex")
    return v.groupBy("itinerary_id", "line_id").agg(F.array_sort(F.collect_list(F.struct("idx", "lon", "lat"))).alias("v")).select("itinerary_id", "line_id", F.transform("v", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("vertices"))

