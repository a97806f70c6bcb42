"""Weather-like tables derived by arithmetic from the general tables, the same in Spark and DuckDB.

A dense forecast cube comes from orders (20 longitudes, 15 latitudes, 5 lead hours, members by size),
requests and their texts from customers, run arrivals and messages from events. The library takes any
tables of these shapes; only the registered queries use the derived ones.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORECAST = """
SELECT 'gefs' AS model, TIMESTAMP '2014-01-01 06:00:00' AS run_time, lead_hours, realization, lat_idx, lon_idx,
  CAST(-84 + 12 * lat_idx AS DOUBLE) AS latitude,
  CAST(CASE WHEN 18 * lon_idx >= 180 THEN 18 * lon_idx - 360 ELSE 18 * lon_idx END AS DOUBLE) AS longitude,
  (c % 4001) / 100.0E0 - 20 AS x_wind, (c {div} 4001 % 4001) / 100.0E0 - 20 AS y_wind,
  CAST(96000 + c % 9001 AS DOUBLE) AS air_pressure_at_sea_level,
  255 + (c % 501) / 10.0E0 AS air_temperature,
  CASE WHEN (lat_idx + lon_idx) % 7 <> 0 THEN ((c % 4001) / 100.0E0 - 20) / 20 END AS sea_water_x_velocity,
  CASE WHEN (lat_idx + lon_idx) % 7 <> 0 THEN ((c {div} 4001 % 4001) / 100.0E0 - 20) / 20 END AS sea_water_y_velocity,
  (cust % 170) / 10.0E0 AS sea_surface_wave_significant_height,
  CAST(7 * cust % 360 AS DOUBLE) AS sea_surface_wave_to_direction
FROM (
  SELECT CAST(round(o_totalprice * 100) AS BIGINT) AS c, o_custkey AS cust,
    CAST(o_orderkey % 20 AS INT) AS lon_idx, CAST(o_orderkey {div} 20 % 15 AS INT) AS lat_idx,
    CAST(6 * (o_orderkey {div} 300 % 5) AS INT) AS lead_hours, CAST(o_orderkey {div} 1500 AS INT) AS realization
  FROM orders) b
"""

REQUESTS = """
SELECT request_id, kind, 'gefs' AS model, s, s + 6 + k % 20 AS n, w,
  CASE WHEN w + width >= 180 THEN w + width - 360 ELSE w + width END AS e,
  s + 0.37E0 * (k % 10) AS lat, w AS lon,
  CASE WHEN k % 4 <> 0 THEN 12.0E0 * (k % 3) END AS resolution,
  CASE WHEN k % 2 = 0 THEN {list12} ELSE {list24} END AS hours
FROM (
  SELECT c_custkey AS request_id, c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'spot' ELSE 'gridded' END AS kind,
    CAST(7 * c_custkey % 90 - 60 AS DOUBLE) AS s, 37 * c_custkey % 360 - 179.5E0 AS w, CAST(10 + c_custkey % 60 AS DOUBLE) AS width
  FROM customer) b
"""

RUNS = """
SELECT CASE event_type WHEN 'click' THEN 'gefs' WHEN 'view' THEN 'gfs' WHEN 'purchase' THEN 'rtofs' ELSE 'cmcens' END AS model,
  {floor6} AS run_time, CAST(ts AS TIMESTAMP) AS arrived_at
FROM events
"""

#: Texts of several kinds, some of them faulty.
MESSAGES = """
SELECT c_custkey AS msg_id,
  CASE WHEN c_custkey % 5 = 0 THEN 'someone@sailmail.com' WHEN c_custkey % 5 = 1 THEN 'boat@iridium.example' ELSE 'a@b.example' END AS sender,
  CASE c_custkey % 6
    WHEN 0 THEN concat('Hello\\nsend GEFS:', CAST(c_custkey % 40 AS STRING), 'N,', CAST(c_custkey % 40 + 20 AS STRING), 'N,', CAST(c_custkey % 90 + 60 AS STRING), 'W,', CAST(c_custkey % 50 AS STRING), 'W|2,2|24,48..96|WIND,press\\nbye')
    WHEN 1 THEN concat('send spot:', CAST(c_custkey % 60 AS STRING), '.5S,', CAST(c_custkey % 180 AS STRING), 'E|6,', CAST(c_custkey % 4 * 3 AS STRING), '|wind\\nsend spot:gfs:10n,20w|0,6..48|wind_speed,pressure')
    WHEN 2 THEN concat('SEND gfs:40n,50n,175e,175w|native|12..48 someopt=3\\n\\nsend nomodel:1n,2n,3e,4e')
    WHEN 3 THEN concat('please help with ', CAST(c_custkey AS STRING))
    WHEN 4 THEN concat('send gfsens:', CAST(c_custkey % 30 AS STRING), 'n,10n,20w,', CAST(c_custkey % 100 AS STRING), 'e|1,2,3|0..144|xyz')
    ELSE concat('send gefs:100n,10n,20w,30e\\nsend fnens:10s,20s,120e,140e||24,48,72|temp, Wave_Height')
  END AS body
FROM customer
"""

_SPARK = {
    "div": "div",
    "list12": "array(6, 12)",
    "list24": "array(0, 24, 36)",
    "floor6": "timestamp_seconds(unix_seconds(CAST(ts AS TIMESTAMP)) div 21600 * 21600)",
}
_DUCK = {"div": "//", "list12": "[6, 12]", "list24": "[0, 24, 36]", "floor6": "make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) // 21600 * 21600 * 1000000)"}


def duck(sql: str) -> str:
    return sql.format(**_DUCK).replace("AS STRING", "AS VARCHAR").replace("\\\\n", "\\n").replace("concat('", "concat(E'").replace("'|wind\\n", "E'|wind\\n").replace("'W|2", "E'W|2")


def _from(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    return spark.sql(sql.format(**_SPARK).replace(f"FROM {table}", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from(spark, sf_dir, "orders", FORECAST)


#: Columns of the same cube on a grid whose steps grow northwards and eastwards; it still goes all around.
UNEVEN = {"latitude": "CAST(-80 + 4 * lat_idx AS DOUBLE) + lat_idx * lat_idx * 0.5E0", "longitude": "CAST(10 * lon_idx AS DOUBLE) + lon_idx * lon_idx * 0.4375E0"}


def uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast(spark, sf_dir).withColumns({c: F.expr(x) for c, x in UNEVEN.items()})


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a temporary one of this machine only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        named = "file://" + tempfile.mkdtemp(prefix="seagrid-")
    return f"{named.rstrip('/')}/seagrid-{uuid.uuid4().hex}"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from(spark, sf_dir, "customer", REQUESTS)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from(spark, sf_dir, "events", RUNS)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from(spark, sf_dir, "customer", MESSAGES)


#: Rows of the cube's grid as DuckDB derives them, for the oracles.
SPEC = "SELECT 'gefs' AS model, -84.0E0 AS lat0, 12.0E0 AS dlat, 15 AS n_lat, 0.0E0 AS lon0, 18.0E0 AS dlon, 20 AS n_lon"

CTE = f"WITH forecast AS ({duck(FORECAST)}), requests AS ({duck(REQUESTS)}), runs AS ({duck(RUNS)}), messages AS ({duck(MESSAGES)}), spec AS ({SPEC})"

#: The uneven grid and its axes, for the oracles.
UNEVEN_CTE = f"""{CTE}, uneven AS (SELECT * REPLACE ({', '.join(f'{x} AS {c}' for c, x in UNEVEN.items())}) FROM forecast),
lats AS (SELECT DISTINCT lat_idx AS i, latitude AS x FROM uneven), lons AS (SELECT DISTINCT lon_idx AS i, longitude AS x FROM uneven)"""
