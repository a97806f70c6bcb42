"""Registered queries of the forecast operators, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seagrid.functions import angles, units
from seagrid.operators import axes, containers, ensemble, quantize, runs, subset
from seagrid.operators import requests as rq
from seagrid.plans import derived
from seagrid.plans.derived import CTE
from seagrid.sources import dims, ingest, store
from seagrid.streaming.answers import answer_batch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql if sql.lstrip().startswith("WITH") else f"{CTE} {sql}"
        return f

    return register


def rnd(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + 0.0


def _edges(values: list[float]) -> str:
    return "[" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "]"


def _bin(x: str, edges: list[float]) -> str:
    return f"len(list_filter({_edges(edges)}, lambda q: q <= {x}))"


def _norm(x: str) -> str:
    return f"(({x}) + 180 - 360 * floor((({x}) + 180) / 360) - 180)"


def _normr(x: str) -> str:
    return f"(({x}) + pi() - 2 * pi() * floor((({x}) + pi()) / (2 * pi())) - pi())"


_SPEED = "sqrt(x_wind * x_wind + y_wind * y_wind)"
_FROM = _normr("atan2(x_wind + 0.0, y_wind + 0.0) + pi()")
CELL = ["lead_hours", "realization", "lat_idx", "lon_idx"]
CELLS = ", ".join(CELL)


def _wind(df: DataFrame) -> DataFrame:
    return angles.velocity_columns(df, "x_wind", "y_wind", "wind_speed", "wind_from_direction")


# Angles, vectors, units


@query(f"SELECT {CELLS}, round({_norm('7 * longitude + 3 * latitude')}, 6) AS norm, round({_norm('longitude - latitude * 4')}, 6) AS diff, round({_norm('longitude + latitude * 4')}, 6) AS total FROM forecast")
def c1_c2_c4_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = derived.forecast(spark, sf_dir)
    lon, lat = F.col("longitude"), F.col("latitude")
    return df.select(*CELL, rnd(angles.normalize(7 * lon + 3 * lat)).alias("norm"), rnd(angles.diff(lon, lat * 4)).alias("diff"), rnd(angles.add(lon, lat * 4)).alias("total"))


@query(f"SELECT model, lead_hours, lon_idx, round({_norm('longitude - lag(longitude) OVER (PARTITION BY model, lead_hours ORDER BY lon_idx)')}, 6) AS step FROM (SELECT DISTINCT model, lead_hours, lon_idx, longitude FROM forecast)")
def c3_lagged_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = derived.forecast(spark, sf_dir).select("model", "lead_hours", "lon_idx", "longitude").distinct()
    along = Window.partitionBy("model", "lead_hours").orderBy("lon_idx")
    return axis.select("model", "lead_hours", "lon_idx", rnd(angles.diff_lag(F.col("longitude"), along)).alias("step"))


@query(f"SELECT request_id, CASE WHEN {_norm('w - e')} <= 0 THEN [w, e] ELSE [e, w] END AS lons FROM requests")
def c5_circular_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.requests(spark, sf_dir).select("request_id", angles.sorted_circular(F.array("e", "w")).alias("lons"))


@query(
    "SELECT request_id, round(2 * 6370997.0 * asin(sqrt(least(1.0, pow(sin(radians(n - s) / 2), 2) + cos(radians(s)) * cos(radians(n)) * pow(sin(radians(e - w) / 2), 2)))), 3) AS metres FROM requests"
)
def c6_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derived.requests(spark, sf_dir)
    return r.select("request_id", rnd(angles.distance(F.col("w"), F.col("s"), F.col("e"), F.col("n")), 3).alias("metres"))


@query(
    f"SELECT {CELLS}, round(speed, 6) AS wind_speed, round(dir, 6) AS wind_from_direction, round(-speed * sin(dir), 6) + 0.0 AS u, round(-speed * cos(dir), 6) + 0.0 AS v FROM (SELECT {CELLS}, {_SPEED} AS speed, {_FROM} AS dir FROM forecast)"
)
def c7_c8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _wind(derived.forecast(spark, sf_dir))
    u, v = angles.components(F.col("wind_speed"), F.col("wind_from_direction"))
    return df.select(*CELL, rnd("wind_speed").alias("wind_speed"), rnd("wind_from_direction").alias("wind_from_direction"), rnd(u).alias("u"), rnd(v).alias("v"))


@query(
    f"SELECT lead_hours, count(*) AS n, count(*) FILTER (abs(stored - sqrt(u * u + v * v)) > 1.5e-4) AS n_bad, round(sum(u), 4) + 0.0 AS u, round(sum(v), 4) + 0.0 AS v FROM (SELECT lead_hours, CASE WHEN lat_idx = 3 THEN speed + 1 ELSE speed END AS stored, -speed * sin(dir) AS u, -speed * cos(dir) AS v FROM (SELECT lead_hours, lat_idx, {_SPEED} AS speed, {_FROM} AS dir FROM forecast)) GROUP BY lead_hours"
)
def c9_velocity_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components from speed and direction; the stored speeds of one row of the grid are false, and found."""
    polar = _wind(derived.forecast(spark, sf_dir)).drop("x_wind", "y_wind")
    both = angles.velocity_columns(polar, "x_wind", "y_wind", "wind_speed", "wind_from_direction")
    both = both.withColumn("wind_speed", F.when(F.col("lat_idx") == 3, F.col("wind_speed") + 1).otherwise(F.col("wind_speed")))
    bad = angles.disagreeing(both, "x_wind", "y_wind", "wind_speed").groupBy("lead_hours").agg(F.count("*").alias("n_bad"))
    sums = both.groupBy("lead_hours").agg(F.count("*").alias("n"), rnd(F.sum("x_wind"), 4).alias("u"), rnd(F.sum("y_wind"), 4).alias("v"))
    return sums.join(bad, "lead_hours", "left").select("lead_hours", "n", F.coalesce("n_bad", F.lit(0)).cast("long").alias("n_bad"), "u", "v")


_UNIT_ROWS = "SELECT o_orderkey AS id, CAST(o_custkey AS DOUBLE) AS value, CASE o_orderkey % 5 WHEN 0 THEN 'knots' WHEN 1 THEN 'm/s' WHEN 2 THEN 'hPa' WHEN 3 THEN 'ft' ELSE 'furlong' END AS unit FROM orders"


@query(
    f"WITH x AS ({_UNIT_ROWS}) SELECT id, CASE unit WHEN 'knots' THEN round(value / 1.94384449, 6) WHEN 'm/s' THEN value END AS converted, CASE WHEN unit = 'furlong' THEN 'unknown unit' WHEN unit IN ('hPa', 'ft') THEN 'another family' END AS error FROM x"
)
def d1_convert_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_UNIT_ROWS.replace("FROM orders", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return units.convert_units(rows, "m/s").select("id", rnd("converted").alias("converted"), "error")


@query(
    f"WITH x AS ({_UNIT_ROWS}) SELECT id, round(CASE unit WHEN 'knots' THEN value / 1.94384449 WHEN 'hPa' THEN value * 100 WHEN 'ft' THEN value / 3.2808399 ELSE value END, 6) AS value, CASE unit WHEN 'knots' THEN 'm/s' WHEN 'hPa' THEN 'Pa' WHEN 'ft' THEN 'm' ELSE unit END AS unit FROM x"
)
def d2_normalize_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_UNIT_ROWS.replace("FROM orders", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return units.normalize_units(rows).select("id", rnd("value").alias("value"), "unit")


@query(
    "SELECT r.rule, CASE r.rule WHEN 'latitude' THEN b.lat WHEN 'wave_height' THEN b.wave ELSE b.dir END AS n_bad, b.n_rows FROM (VALUES ('latitude'), ('wave_height'), ('wave_direction')) r(rule), (SELECT count(*) AS n_rows, count(*) FILTER (latitude NOT BETWEEN -90 AND 90) AS lat, count(*) FILTER (sea_surface_wave_significant_height <= 0) AS wave, count(*) FILTER (sea_surface_wave_to_direction NOT BETWEEN -180 AND 180) AS dir FROM forecast) b"
)
def d3_validate_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {
        "latitude": units.within(F.col("latitude"), -90, 90),
        "wave_height": units.positive(F.col("sea_surface_wave_significant_height")),
        "wave_direction": units.within(F.col("sea_surface_wave_to_direction"), -180, 180),
    }
    return units.range_report(derived.forecast(spark, sf_dir), rules)


# Sources and ingest


@query("SELECT lead_hours, realization, count(*) AS n, round(avg(x_wind), 6) AS mean FROM forecast WHERE model = 'gefs' AND lead_hours <= 12 GROUP BY ALL")
def a1_scan_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube written by model and scanned again; the model prunes folders, the hours row groups."""
    path = derived.shared_folder(spark)
    ingest.write_payloads(derived.forecast(spark, sf_dir), path)
    df = subset.horizon_prune(ingest.scan_forecast(spark, path, "gefs"), 12)
    return df.groupBy("lead_hours", "realization").agg(F.count("*").alias("n"), rnd(F.avg("x_wind")).alias("mean"))


_MODELS_SQL = "(VALUES ('gefs', 6), ('gfs', 6), ('cmcens', 12), ('fens', 6), ('ww3', 6), ('rtofs', 24)) m(model, freq)"
_CANDIDATES = f"""cand AS (
  SELECT as_of, model, make_timestamp(CAST((d + h // freq * freq * 3600 - i * freq * 3600) * 1000000 AS BIGINT)) AS candidate
  FROM (SELECT as_of, model, freq, i, CAST(epoch(date_trunc('day', as_of + INTERVAL 1 HOUR)) AS BIGINT) AS d, hour(as_of + INTERVAL 1 HOUR) AS h
        FROM (SELECT DISTINCT date_trunc('hour', CAST(ts AS TIMESTAMP)) AS as_of FROM events), {_MODELS_SQL}, range(10) r(i)))"""


def _as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("as_of")).distinct()


@query("SELECT r.model, freq AS freq_hours, count(*) AS n FROM runs r JOIN (VALUES ('gefs', 6), ('gfs', 6), ('cmcens', 12), ('rtofs', 24)) m(model, freq) ON r.model = m.model GROUP BY ALL")
def a2_model_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.runs(spark, sf_dir).join(F.broadcast(dims.model_dim(spark)), "model").groupBy("model", "freq_hours").agg(F.count("*").alias("n"))


@query(f"{CTE}, {_CANDIDATES} SELECT CAST(epoch(as_of) AS BIGINT) AS as_of, model, CAST(epoch(candidate) AS BIGINT) AS candidate FROM cand")
def a3_candidate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.candidate_runs(_as_of(spark, sf_dir)).select(F.unix_seconds("as_of").alias("as_of"), "model", F.unix_seconds("candidate").alias("candidate"))


@query(
    f"{CTE}, {_CANDIDATES} SELECT CAST(epoch(as_of) AS BIGINT) AS as_of, c.model, CAST(epoch(max(r.run_time)) AS BIGINT) AS run_time, CASE WHEN max(r.run_time) IS NULL THEN 'no run available' END AS error FROM cand c LEFT JOIN (SELECT DISTINCT model, run_time FROM runs) r ON r.model = c.model AND r.run_time = c.candidate GROUP BY as_of, c.model"
)
def a4_latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = runs.latest_run(derived.runs(spark, sf_dir), _as_of(spark, sf_dir))
    return got.select(F.unix_seconds("as_of").alias("as_of"), "model", F.unix_seconds("run_time").alias("run_time"), "error")


@query(
    f"{CTE}, {_CANDIDATES}, arrived AS (SELECT model, run_time, min(arrived_at) AS arrived_at FROM runs GROUP BY ALL) SELECT CAST(epoch(c.as_of) AS BIGINT) AS as_of, c.model, CAST(epoch(max(r.run_time)) AS BIGINT) AS run_time, CASE WHEN max(r.run_time) IS NULL THEN 'no run available' END AS error FROM cand c LEFT JOIN arrived r ON r.model = c.model AND r.run_time = c.candidate AND r.arrived_at <= c.as_of GROUP BY c.as_of, c.model"
)
def a4_latest_run_arrived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest run that had arrived at each hour: a run counts from its first arrival on."""
    got = runs.latest_run_arrived(derived.runs(spark, sf_dir), _as_of(spark, sf_dir))
    return got.select(F.unix_seconds("as_of").alias("as_of"), "model", F.unix_seconds("run_time").alias("run_time"), "error")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube as a source gives it: source names, kelvin, 0..360, labels from 5, times instead of hours, a level."""
    df = derived.forecast(spark, sf_dir)
    return df.select(
        "model", "run_time", (F.col("run_time") + F.make_dt_interval(hours=F.col("lead_hours"))).alias("valid_time"), (3 * F.col("realization") + 5).alias("ens"), "lat_idx", "lon_idx",
        F.col("latitude").alias("lat"), F.pmod("longitude", F.lit(360.0)).alias("lon"), F.col("x_wind").alias("ugrd10m"), F.col("y_wind").alias("vgrd10m"), F.col("air_temperature").alias("tmp2m"),
        F.lit(0).alias("lev"), F.lit("x").alias("unknown"),
    )


@query(
    "SELECT lead_hours, realization, lat_idx, lon_idx, latitude, longitude, x_wind, y_wind, round(air_temperature - 273.15, 6) AS air_temperature FROM forecast"
)
def a5_a11_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ingest.attach_units(ingest.rename_to_cf(ingest.squeeze_level(_raw(spark, sf_dir))))
    df = ingest.kelvin_to_celsius(ingest.missing_to_null(df, ["x_wind", "y_wind"]), "air_temperature")
    df = ingest.keep_recognised(ingest.normalize_longitude(ingest.add_lead_hours(ingest.zero_base_members(df))))
    return df.select("lead_hours", "realization", "lat_idx", "lon_idx", "latitude", "longitude", "x_wind", "y_wind", rnd("air_temperature").alias("air_temperature"))


@query(" UNION ALL ".join(f"SELECT {CELLS}, '{v}' AS variable, {v} AS value FROM forecast" for v in ("x_wind", "y_wind", "sea_water_x_velocity")))
def a13_export_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _wind(derived.forecast(spark, sf_dir))
    return ingest.export_slices(df, ["x_wind", "y_wind", "wind_speed", "wind_from_direction", "sea_water_x_velocity"]).select(*CELL, "variable", "value")


_BOX_LON = "(longitude >= 100 OR longitude <= -100)"


@query(f"SELECT {CELLS}, CASE WHEN lat_idx % 2 = 0 THEN longitude - 360 * floor(longitude / 360) ELSE longitude END AS longitude, false AS unsafe FROM forecast WHERE CASE WHEN lat_idx % 2 = 0 THEN {_BOX_LON} ELSE longitude BETWEEN -60 AND 60 END")
def a14_dateline_safe_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = derived.forecast(spark, sf_dir).where(f"CASE WHEN lat_idx % 2 = 0 THEN {_BOX_LON} ELSE longitude BETWEEN -60 AND 60 END")
    return ingest.dateline_safe_longitude(part, ["lat_idx", "lead_hours"]).select(*CELL, "longitude", "unsafe")


@query(
    " ".join(
        [
            "SELECT * FROM",
            " JOIN ".join(
                f"(SELECT lead_hours, realization, count(*) AS n_{s}, CAST(min({x}) * 1000 AS INT) AS first_{s}, CAST(max({x}) * 1000 AS INT) AS last_{s}, CAST(max(step) * 1000 AS INT) AS step_{s}, count(DISTINCT step) <= 1 AS regular_{s} FROM (SELECT *, round({x} - lag({x}) OVER (PARTITION BY lead_hours, realization ORDER BY {x}), 4) AS step FROM (SELECT DISTINCT lead_hours, realization, {x} FROM forecast)) GROUP BY lead_hours, realization) {s}"
                for s, x in (("lon", "longitude"), ("lat", "latitude"))
            ),
            "USING (lead_hours, realization)",
        ]
    )
)
def a15_grid_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.grid_description(derived.forecast(spark, sf_dir), ["lead_hours", "realization"])


_EXPORTED = {
    "air_pressure_at_sea_level": (2, "Pressure reduced to MSL", "Pa", "air_pressure_at_sea_level"),
    "air_temperature": (11, "Temperature", "K", "air_temperature"),
    "x_wind": (33, "u-component of wind", "m/s", "x_wind"),
    "y_wind": (34, "v-component of wind", "m/s", "y_wind / 1.94384449"),
    "sea_water_x_velocity": (49, "u-component of current", "m s-1", "sea_water_x_velocity"),
    "sea_water_y_velocity": (50, "v-component of current", "m s-1", "sea_water_y_velocity"),
    "sea_surface_wave_significant_height": (100, "Significant height of combined wind waves and swell", "m", "sea_surface_wave_significant_height / 3.2808399"),
    "sea_surface_wave_to_direction": (101, "Direction of wind waves", "Degree true", "sea_surface_wave_to_direction"),
}


@query(
    "SELECT variable, code, code_name, code_unit, level_type, level, error, count(*) AS n, round(avg(CASE WHEN error IS NULL THEN value END), 6) AS mean FROM ("
    + " UNION ALL ".join(
        f"SELECT '{v}' AS variable, {code} AS code, '{name}' AS code_name, '{unit}' AS code_unit, {'105' if v.endswith('_wind') else 'CAST(NULL AS INT)'} AS level_type, {'10' if v.endswith('_wind') else 'CAST(NULL AS INT)'} AS level, {x} AS value, CASE WHEN lead_hours = 18 THEN 'lead is no whole hour' {'WHEN lat_idx = 2 THEN ' + chr(39) + 'unit of another family' + chr(39) if v == 'x_wind' else ''} END AS error FROM forecast"
        for v, (code, name, unit, x) in _EXPORTED.items()
    )
    + ") GROUP BY ALL"
)
def a16_to_grib_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exported column: winds partly in knots, heights in feet, one hour that is no whole one, one row of the grid in a wrong unit."""
    df = ingest.kelvin_to_celsius(derived.forecast(spark, sf_dir), "air_temperature")
    slices = ingest.export_slices(df.withColumn("lead_hours", F.when(F.col("lead_hours") == 18, 18.5).otherwise(F.col("lead_hours"))), list(_EXPORTED))
    v = F.col("variable")
    unit = F.when(v == "y_wind", "knots").when(v == "sea_surface_wave_significant_height", "ft").when((v == "x_wind") & (F.col("lat_idx") == 2), "hPa")
    coded = ingest.to_grib_codes(slices.withColumn("unit", unit))
    return coded.groupBy("variable", "code", "code_name", "code_unit", "level_type", "level", "error").agg(F.count("*").alias("n"), rnd(F.avg("value")).alias("mean"))


@query("SELECT chunk, count(*) AS n, count(DISTINCT lon_idx) AS n_lon FROM (SELECT CASE WHEN longitude < 0 THEN 0 ELSE 1 END AS chunk, lon_idx FROM forecast) GROUP BY chunk")
def a17_concat_along(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = derived.forecast(spark, sf_dir)
    both = ingest.concat_along([df.where("longitude < 0"), df.where("longitude >= 0")], "chunk")
    return both.groupBy("chunk").agg(F.count("*").alias("n"), F.countDistinct("lon_idx").alias("n_lon"))


# Subsets


_AXIS = "(SELECT model, min_by({x}, {i}) AS {s}0, max(step) AS d{s}, CAST(count(*) AS INT) AS n_{s}, count(DISTINCT step) <= 1 AS uniform_{s} FROM (SELECT *, round({step}, 4) AS step FROM (SELECT *, lag({x}) OVER (PARTITION BY model ORDER BY {i}) AS before FROM (SELECT DISTINCT model, {i}, {x} FROM forecast))) GROUP BY model) {s}"


@query(
    f"SELECT *, abs(abs(dlon) * n_lon - 360) < 1e-3 AS lon_wraps FROM {_AXIS.format(s='lat', i='lat_idx', x='latitude', step=_norm('latitude - before'))} JOIN {_AXIS.format(s='lon', i='lon_idx', x='longitude', step=_norm('longitude - before'))} USING (model)"
)
def e1_grid_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subset.grid_spec(derived.forecast(spark, sf_dir))


_SNAP = """snap AS (
  SELECT *, lat_lo + ls * CAST(ceil((lat_hi0 - lat_lo) / ls) AS INT) AS lat_hi,
    CAST(((w_raw % 20) + 20) % 20 AS INT) AS lon_w, least(os * CAST(ceil(span0 / os) AS INT), 19) AS lon_span
  FROM (SELECT *, CAST(floor((s - lat0) / dlat + 1e-9) AS INT) AS lat_lo, CAST(ceil((n - lat0) / dlat - 1e-9) AS INT) AS lat_hi0,
      CAST(floor(x0 + 1e-9) AS INT) AS w_raw, CAST(ceil(x0 + box / dlon - floor(x0 + 1e-9) - 1e-9) AS INT) AS span0,
      greatest(1, coalesce(CAST(round_even(resolution / 12, 0) AS INT), 1)) AS ls, greatest(1, coalesce(CAST(round_even(resolution / 18, 0) AS INT), 1)) AS os
    FROM (SELECT r.*, lat0, dlat, n_lat, lon0, dlon, n_lon, (w - lon0 - 360 * floor((w - lon0) / 360)) / dlon AS x0, e - w - 360 * floor((e - w) / 360) AS box
          FROM requests r JOIN spec USING (model))))"""
_SNAP_ERR = "CASE WHEN lat_lo < 0 OR lat_hi >= n_lat THEN 'latitude outside the forecast' END"
_MET = f"""{_SNAP}, met AS (
  SELECT s.request_id, f.*, (f.lon_idx - s.lon_w + 20) % 20 AS lon_off
  FROM (SELECT *, unnest(hours) AS hr FROM snap WHERE kind = 'gridded' AND {_SNAP_ERR} IS NULL) s
  JOIN forecast f ON f.model = s.model AND f.lead_hours = s.hr
  WHERE f.lat_idx BETWEEN s.lat_lo AND s.lat_hi AND (f.lat_idx - s.lat_lo) % s.ls = 0
    AND (f.lon_idx - s.lon_w + 20) % 20 <= s.lon_span AND ((f.lon_idx - s.lon_w + 20) % 20) % s.os = 0)"""
_MET_SUM = "count(*) AS n, round(sum(x_wind), 4) + 0.0 AS x, min(lat_idx) AS lat_lo, max(lat_idx) AS lat_hi, max(lon_off) AS lon_off"


@query(f"{CTE}, {_SNAP} SELECT request_id, lat_lo, lat_hi, ls AS lat_stride, lon_w, lon_span, os AS lon_stride, {_SNAP_ERR} AS error FROM snap")
def e2_e3_snap_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = subset.grid_spec(derived.forecast(spark, sf_dir))
    got = subset.snap_bounds(derived.requests(spark, sf_dir), spec)
    return got.select("request_id", "lat_lo", "lat_hi", "lat_stride", "lon_w", "lon_span", "lon_stride", "error")


def _met(df: DataFrame) -> DataFrame:
    """Of cells whose members are summed up."""
    return df.groupBy("request_id", "lead_hours").agg(
        F.sum("n_members").alias("n"), rnd(F.sum("x_wind"), 4).alias("x"), F.min("lat_idx").alias("lat_lo"), F.max("lat_idx").alias("lat_hi"), F.max("lon_off").alias("lon_off")
    )


def _snapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    forecast = derived.forecast(spark, sf_dir)
    return forecast, subset.snap_bounds(derived.requests(spark, sf_dir).where("kind = 'gridded'"), subset.grid_spec(forecast))


@query(f"{CTE}, {_MET} SELECT request_id, lead_hours, {_MET_SUM} FROM met GROUP BY request_id, lead_hours")
def e4_e9_gridded_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    forecast, wanted = _snapped(spark, sf_dir)
    cells = subset.over_members(forecast, ["x_wind"])
    return subset.answered_once(wanted, subset.BOX, lambda r: _met(subset.gridded_subset(r, cells)))


@query(f"{CTE}, {_MET} SELECT request_id, lead_hours, {_MET_SUM} FROM met GROUP BY request_id, lead_hours")
def a12_e9_stored_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube written by run, bucket and tile, then cut out: the requests go to the cells' buckets."""
    path = derived.shared_folder(spark)
    name = path.rpartition("/")[2].replace("-", "_")
    store.write_runs(derived.forecast(spark, sf_dir), name, path, tile=2, buckets=8)
    stored = store.open_store(spark, name, path, tile=2)
    wanted = subset.snap_bounds(derived.requests(spark, sf_dir).where("kind = 'gridded'"), stored.spec).join(stored.index.select("model", "run_time"), "model")
    summed = replace(stored, cells=subset.over_members(stored.cells, ["x_wind"]))
    return subset.answered_once(wanted, subset.BOX, lambda r: _met(store.stored_subset(r, summed)))


@query(f"{CTE}, {_MET} SELECT request_id, lead_hours, {_MET_SUM} FROM met GROUP BY request_id, lead_hours")
def e9_gridded_subset_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    forecast, wanted = _snapped(spark, sf_dir)
    cells = subset.over_members(forecast, ["x_wind"])
    return subset.answered_once(wanted, subset.BOX, lambda r: _met(subset.gridded_subset_tiled(r, cells)))


@query("SELECT lead_hours, count(*) AS n, round(sum(y_wind), 4) + 0.0 AS y FROM forecast WHERE lead_hours <= 12 GROUP BY lead_hours")
def e6_horizon_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = subset.project_variables(subset.horizon_prune(derived.forecast(spark, sf_dir), 12), ["lead_hours"], ["y_wind"])
    return df.groupBy("lead_hours").agg(F.count("*").alias("n"), rnd(F.sum("y_wind"), 4).alias("y"))


@query("SELECT request_id, model, hr AS lead_hours, hr IN (SELECT DISTINCT lead_hours FROM forecast) AS available FROM (SELECT request_id, model, unnest(hours) AS hr FROM requests)")
def e7_select_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subset.select_hours(derived.requests(spark, sf_dir), derived.forecast(spark, sf_dir)).select("request_id", "model", "lead_hours", "available")


@query(
    f"""{CTE}, there AS (SELECT DISTINCT lead_hours FROM forecast), asked AS (SELECT request_id, unnest(list_transform(hours, lambda h: CAST(h + 12 * (request_id % 4) AS INT))) AS h FROM requests)
SELECT request_id, coalesce(list(h ORDER BY h) FILTER (h IN (SELECT lead_hours FROM there)), []) AS at_hours, coalesce(list(h ORDER BY h) FILTER (h NOT IN (SELECT lead_hours FROM there)), []) AS missing,
  CASE WHEN count(*) FILTER (h IN (SELECT lead_hours FROM there)) = 0 THEN 'none of the hours is in the forecast' END AS error FROM asked GROUP BY request_id"""
)
def e7_resolve_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours from an index of the runs: those there, those missing, and the error of requests that have none."""
    index = containers.forecast_index(derived.forecast(spark, sf_dir))
    asked = derived.requests(spark, sf_dir).withColumn("hours", F.transform("hours", lambda h: (h + 12 * (F.col("request_id") % 4)).cast("int")))
    return store.resolve_hours(asked.join(F.broadcast(index.select("model", "run_time")), "model"), index)


@query("SELECT request_id, (lat - lat0) / dlat BETWEEN 0 AND n_lat - 1 AS inside FROM requests JOIN spec USING (model) WHERE kind = 'spot'")
def e10_e11_point_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots = subset.point_to_domain(derived.requests(spark, sf_dir).where("kind = 'spot'"))
    return subset.point_in_range(spots, subset.grid_spec(derived.forecast(spark, sf_dir))).select("request_id", "inside")


_CORNERS = """corners AS (
  SELECT request_id, model, lat, lon, hours, CAST(y0 + a.a AS INT) AS lat_idx, CAST((x0 + b.b) % 20 AS INT) AS lon_idx,
    (CASE WHEN a.a = 0 THEN 1 - fy ELSE fy END) * (CASE WHEN b.b = 0 THEN 1 - fx ELSE fx END) AS weight
  FROM (SELECT request_id, model, lat, lon, hours, floor(y + 1e-9) AS y0, CASE WHEN y - floor(y + 1e-9) < 1e-9 THEN 0 ELSE y - floor(y + 1e-9) END AS fy,
               floor(x + 1e-9) AS x0, CASE WHEN x - floor(x + 1e-9) < 1e-9 THEN 0 ELSE x - floor(x + 1e-9) END AS fx
        FROM (SELECT r.*, (lat - lat0) / dlat AS y, (lon - lon0 - 360 * floor((lon - lon0) / 360)) / dlon AS x, n_lat FROM requests r JOIN spec USING (model) WHERE kind = 'spot')
        WHERE y BETWEEN 0 AND n_lat - 1), (VALUES (0), (1)) a(a), (VALUES (0), (1)) b(b))"""


@query(f"{CTE}, {_CORNERS} SELECT request_id, lat_idx, lon_idx, round(weight, 9) AS weight FROM corners WHERE weight > 0")
def e12_bilinear_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots = derived.requests(spark, sf_dir).where("kind = 'spot'")
    return subset.bilinear_weights(spots, subset.grid_spec(derived.forecast(spark, sf_dir))).select("request_id", "lat_idx", "lon_idx", rnd("weight", 9).alias("weight"))


_SPOT = f"""{_CORNERS}, spot AS (
  SELECT request_id, lead_hours, realization, sum(weight * x_wind) AS x_wind, sum(weight * y_wind) AS y_wind,
    CASE WHEN count(sea_water_x_velocity) = count(*) THEN sum(weight * sea_water_x_velocity) END AS current, any_value(hours) AS hours
  FROM corners JOIN forecast USING (model, lat_idx, lon_idx) WHERE weight > 0 GROUP BY request_id, lead_hours, realization)"""


@query(f"{CTE}, {_SPOT} SELECT request_id, lead_hours, realization, round(x_wind, 11) + 0.0 AS x_wind, round(y_wind, 11) + 0.0 AS y_wind, round(current, 11) + 0.0 AS current FROM spot")
def e13_spot_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    forecast = derived.forecast(spark, sf_dir)
    spots = derived.requests(spark, sf_dir).where("kind = 'spot'")
    spec = subset.grid_spec(forecast)

    def answer(r: DataFrame) -> DataFrame:
        got = subset.spot_interpolate(r, forecast, spec, ["x_wind", "y_wind", "sea_water_x_velocity"])
        return got.select("request_id", "lead_hours", "realization", rnd("x_wind", 11).alias("x_wind"), rnd("y_wind", 11).alias("y_wind"), rnd("sea_water_x_velocity", 11).alias("current"))

    return subset.answered_once(spots, subset.SPOT, answer, subset.members_and_hours())


@query(
    f"{CTE}, {_MET.replace('snap AS (', 'snap AS (', 1)}, {_SPOT} SELECT 'gridded' AS kind, request_id, lead_hours, count(*) AS n, round(sum(x_wind), 8) + 0.0 AS x FROM met GROUP BY ALL UNION ALL SELECT 'spot', request_id, lead_hours, count(*), round(sum(x_wind), 8) + 0.0 FROM spot WHERE list_contains(hours, lead_hours) GROUP BY ALL"
)
def e14_e15_answer_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    forecast = derived.forecast(spark, sf_dir)
    spec = subset.grid_spec(forecast)

    def answer(r: DataFrame) -> DataFrame:
        got = subset.answer_requests(r, forecast, spec, ["x_wind", "y_wind"])
        return got.groupBy("kind", "request_id", "lead_hours").agg(F.count("*").alias("n"), rnd(F.sum("x_wind"), 8).alias("x"))

    return subset.answered_once(derived.requests(spark, sf_dir), subset.ASKED, answer)


@query("SELECT request_id, CAST(greatest(0, least(round_even((lat - lat0) / dlat, 0), n_lat - 1)) AS INT) AS lat_idx, CAST(round_even((lon - lon0 - 360 * floor((lon - lon0) / 360)) / dlon, 0) % n_lon AS INT) AS lon_idx FROM requests JOIN spec USING (model)")
def e16_nearest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subset.nearest_cell(derived.requests(spark, sf_dir), subset.grid_spec(derived.forecast(spark, sf_dir))).select("request_id", "lat_idx", "lon_idx")


_TURN = "({x} - 360 * floor({x} / 360))"


@query(
    f"""{derived.UNEVEN_CTE}, bounds AS (
  SELECT request_id, greatest(1, coalesce(CAST(round_even(resolution / 11, 0) AS INT), 1)) AS ls, greatest(1, coalesce(CAST(round_even(resolution / 18.3125, 0) AS INT), 1)) AS os,
    (SELECT max(i) FROM lats WHERE x <= s) AS south, (SELECT min(i) FROM lats WHERE x >= n) AS north,
    coalesce((SELECT max(i) FROM lons WHERE x <= {_TURN.format(x='w')}), 19) AS west, coalesce((SELECT min(i) FROM lons WHERE x >= {_TURN.format(x='e')}), 0) AS east FROM requests),
ranges AS (SELECT *, least(south, north) AS lat_lo, least(south, north) + ls * CAST(ceil((greatest(south, north) - least(south, north)) / ls) AS INT) AS lat_hi FROM bounds)
SELECT request_id, lat_lo, lat_hi, ls AS lat_stride, west AS lon_w, least(os * CAST(ceil((east - west + 20) % 20 / os) AS INT), 19) AS lon_span, os AS lon_stride,
  CASE WHEN south IS NULL OR north IS NULL OR lat_hi > 14 THEN 'latitude outside the forecast' END AS error FROM ranges"""
)
def e2_snap_bounds_uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on a grid whose steps differ, by search."""
    got = axes.snap_bounds_on_axes(derived.requests(spark, sf_dir), derived.uneven(spark, sf_dir))
    return got.select("request_id", "lat_lo", "lat_hi", "lat_stride", "lon_w", "lon_span", "lon_stride", "error")


_UNEVEN_GAP = _norm("lon - o.x").replace("lon - o.x", "r.lon - o.x")


@query(
    f"{derived.UNEVEN_CTE} SELECT r.request_id, arg_min(a.i, (round(abs(r.lat - a.x), 9), a.i)) AS lat_idx, arg_min(o.i, (round(abs({_UNEVEN_GAP}), 9), o.i)) AS lon_idx FROM requests r, lats a, lons o GROUP BY r.request_id"
)
def e16_nearest_node_uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest node of a grid whose steps differ: an as-of join from both sides."""
    return axes.nearest_node(derived.requests(spark, sf_dir), derived.uneven(spark, sf_dir)).select("request_id", "lat_idx", "lon_idx")


@query(
    f"""{derived.UNEVEN_CTE}, spots AS (SELECT request_id, lat, {_TURN.format(x='lon')} AS lon FROM requests WHERE kind = 'spot'),
near AS (
  SELECT *, (SELECT max(x) FROM lats WHERE x <= lat) AS y0, (SELECT min(x) FROM lats WHERE x >= lat) AS y1,
    (SELECT max(x) FROM lons WHERE x <= lon) AS x0, coalesce((SELECT min(x) FROM lons WHERE x >= lon), 360) AS x1 FROM spots),
sides AS (
  SELECT request_id, y0 AS y, CASE WHEN y1 > y0 THEN (y1 - lat) / (y1 - y0) ELSE 1 END AS wt, 'y' AS d FROM near WHERE y1 IS NOT NULL AND y0 IS NOT NULL
  UNION ALL SELECT request_id, y1, (lat - y0) / (y1 - y0), 'y' FROM near WHERE y1 > y0
  UNION ALL SELECT request_id, x0, CASE WHEN x1 > x0 THEN (x1 - lon) / (x1 - x0) ELSE 1 END, 'x' FROM near
  UNION ALL SELECT request_id, x1 % 360, (lon - x0) / (x1 - x0), 'x' FROM near WHERE x1 > x0)
SELECT a.request_id, lead_hours, realization, round(sum(a.wt * b.wt * x_wind), 8) + 0.0 AS x_wind
FROM sides a JOIN sides b ON a.request_id = b.request_id AND a.d = 'y' AND b.d = 'x' AND a.wt > 0 AND b.wt > 0 JOIN uneven f ON f.latitude = a.y AND f.longitude = b.y
GROUP BY a.request_id, lead_hours, realization"""
)
def e13_spot_interpolate_uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spots between the nodes of a grid whose steps differ."""
    forecast = derived.uneven(spark, sf_dir)

    def answer(r: DataFrame) -> DataFrame:
        got = subset.interpolated(axes.bilinear_weights_on_axes(r, forecast), forecast, ["model", "lat_idx", "lon_idx"], ["x_wind"], few=subset.few_spots(r))
        return got.select("request_id", "lead_hours", "realization", rnd("x_wind", 8).alias("x_wind"))

    return subset.answered_once(derived.requests(spark, sf_dir).where("kind = 'spot'"), subset.SPOT, answer, subset.members_and_hours())


@query("SELECT lat_idx, lon_idx, realization, x_wind FROM forecast WHERE lead_hours = 24")
def e17_take_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subset.take_index(derived.forecast(spark, sf_dir), "lead_hours", -1, ["model", "realization"]).select("lat_idx", "lon_idx", "realization", "x_wind")


@query(
    f"{CTE}, {_MET} SELECT request_id, CASE WHEN count(DISTINCT (lead_hours, latitude)) = 1 THEN min(lead_hours) END AS lead_hours, CASE WHEN count(DISTINCT (lead_hours, latitude)) = 1 THEN min(latitude) END AS latitude, CASE WHEN count(DISTINCT (lead_hours, latitude)) > 1 THEN 'several values of lead_hours and latitude' END AS error FROM met GROUP BY request_id"
)
def e17_single_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where one hour and one latitude are required, requests with several are in error."""
    forecast, wanted = _snapped(spark, sf_dir)
    places = subset.over_members(forecast)
    return subset.answered_once(wanted, subset.BOX, lambda r: subset.single_value(subset.gridded_subset(r, places), ["lead_hours", "latitude"], ["request_id"]))


@query(
    f"{CTE}, {_MET} SELECT request_id, count(DISTINCT lead_hours) AS n_times, count(DISTINCT (lat_idx, lon_idx)) AS n_places, CASE WHEN count(DISTINCT (lat_idx, lon_idx)) = 1 THEN 'spot' WHEN count(DISTINCT lead_hours) = 1 THEN 'one_time' ELSE 'many_times' END AS kind FROM met GROUP BY request_id"
)
def e17_forecast_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    forecast, wanted = _snapped(spark, sf_dir)
    places = subset.over_members(forecast)
    return subset.answered_once(wanted, subset.BOX, lambda r: subset.forecast_kind(subset.gridded_subset(r, places)))


# Quantisation


@query(f"SELECT {CELLS}, {_bin('air_pressure_at_sea_level', dims.PRESSURE_EDGES)} AS air_pressure_at_sea_level_bin FROM forecast")
def q1_q7_quantize_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize.quantize_variable(derived.forecast(spark, sf_dir), "air_pressure_at_sea_level", dims.PRESSURE_EDGES).select(*CELL, "air_pressure_at_sea_level_bin")


_MID = quantize.midpoints(dims.WIND_EDGES)
_DIRMID = [math.pi, *quantize.midpoints(dims.DIRECTION_EDGES)[1:-1]]
_SB, _DB = _bin(_SPEED, dims.WIND_EDGES), f"({_bin(_FROM, dims.DIRECTION_EDGES)} % 16)"


@query(
    f"SELECT {CELLS}, sb AS wind_speed_bin, db AS wind_direction_bin, round({_edges(_MID)}[sb + 1], 6) AS wind_speed, round({_edges(_DIRMID)}[db + 1], 6) AS wind_direction FROM (SELECT {CELLS}, {_SB} AS sb, {_DB} AS db FROM forecast)"
)
def q2_q3_q4_q8_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quantize.quantize_velocity(derived.forecast(spark, sf_dir), "x_wind", "y_wind", "wind", dims.WIND_EDGES)
    df = quantize.decode_velocity(df, "wind", dims.WIND_EDGES)
    return df.select(*CELL, "wind_speed_bin", "wind_direction_bin", rnd("wind_speed").alias("wind_speed"), rnd("wind_direction").alias("wind_direction"))


@query("SELECT lead_hours, i AS nth, round(lo - eps + (hi - lo + 2 * eps) * i / 15, 6) AS edge FROM (SELECT lead_hours, min(x_wind) AS lo, max(x_wind) AS hi, greatest((max(x_wind) - min(x_wind)) * 0.001, 1e-6) AS eps FROM forecast GROUP BY lead_hours), range(16) r(i)")
def q5_auto_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quantize.auto_edges(derived.forecast(spark, sf_dir), "x_wind", ["lead_hours"])
    return got.select("lead_hours", F.posexplode("edges").alias("nth", "edge")).select("lead_hours", F.col("nth").cast("long").alias("nth"), rnd("edge").alias("edge"))


@query(
    "SELECT 'air_pressure_at_sea_level' AS variable, count(*) FILTER (air_pressure_at_sea_level < 97500) AS too_small, count(*) FILTER (air_pressure_at_sea_level >= 104000) AS too_large, count(air_pressure_at_sea_level) AS n FROM forecast UNION ALL SELECT 'sea_surface_wave_significant_height', count(*) FILTER (sea_surface_wave_significant_height < 0), count(*) FILTER (sea_surface_wave_significant_height >= 15), count(*) FROM forecast"
)
def q6_range_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize.range_audit(derived.forecast(spark, sf_dir), {"air_pressure_at_sea_level": dims.PRESSURE_EDGES, "sea_surface_wave_significant_height": dims.WAVE_EDGES})


_CS = "coalesce(sqrt(sea_water_x_velocity * sea_water_x_velocity + sea_water_y_velocity * sea_water_y_velocity), -1.0)"
_CD = f"coalesce({_normr('atan2(sea_water_x_velocity + 0.0, sea_water_y_velocity + 0.0)')}, 0.0)"
_CMID = quantize.midpoints(dims.MASKED_EDGES)


@query(
    f"SELECT {CELLS}, sb AS current_speed_bin, db AS current_direction_bin, CASE WHEN sb > 1 THEN round({_edges(_CMID)}[sb + 1], 6) END AS current_speed FROM (SELECT {CELLS}, least(15, {_bin(_CS, dims.MASKED_EDGES)}) AS sb, {_bin(_CD, dims.DIRECTION_EDGES)} % 16 AS db FROM forecast)"
)
def q9_masked_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quantize.quantize_masked_velocity(derived.forecast(spark, sf_dir), "sea_water_x_velocity", "sea_water_y_velocity", "current")
    return quantize.decode_masked_velocity(df, "current").select(*CELL, "current_speed_bin", "current_direction_bin", rnd("current_speed").alias("current_speed"))


_WMID = quantize.midpoints(dims.WAVE_EDGES)


@query(f"SELECT {CELLS}, CASE WHEN lat_idx % 3 = 0 THEN round({_edges(_WMID)}[{_bin('sea_surface_wave_significant_height', dims.WAVE_EDGES)} + 1], 6) END AS decoded FROM forecast")
def q10_masked_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, mask = derived.forecast(spark, sf_dir), F.col("lat_idx") % 3 == 0
    packed = quantize.masked_quantize(df, "sea_surface_wave_significant_height", dims.WAVE_EDGES, mask)
    return quantize.masked_expand(df.select(*CELL), packed, CELL, dims.WAVE_EDGES, mask).select(*CELL, rnd("decoded").alias("decoded"))


@query(f"SELECT {CELLS}, CAST(sea_water_x_velocity IS NULL AS INT) AS flag, round(round_even(x_wind, 1), 1) + 0.0 AS rounded FROM forecast")
def q11_q12_flags_and_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = derived.forecast(spark, sf_dir)
    return df.select(*CELL, quantize.quantize_flag(F.col("sea_water_x_velocity").isNull()).alias("flag"), rnd(quantize.round_to_digit(F.col("x_wind"), 1), 1).alias("rounded"))


@query(
    "SELECT model, realization, CAST(row_number() OVER w - 1 AS INT) AS nth, CAST(date_diff('day', DATE '1970-01-01', CAST(run_time AS DATE)) + 719163 AS INT) AS origin_day, CAST(CAST(epoch(run_time) AS BIGINT) % 86400 AS INT) AS origin_second, lead_hours - coalesce(lag(lead_hours) OVER w, 0) AS delta, lead_hours AS decoded FROM (SELECT DISTINCT model, realization, run_time, lead_hours FROM forecast) WINDOW w AS (PARTITION BY model, realization ORDER BY lead_hours)"
)
def q13_delta_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["model", "realization"]
    coded = quantize.delta_encode_time(derived.forecast(spark, sf_dir), by)
    along = Window.partitionBy(*by).orderBy("lead_hours")
    back = quantize.delta_decode_time(coded, by).withColumn("nth", F.row_number().over(along) - 1).select(*by, "nth", F.col("lead_hours").alias("decoded"))
    return coded.join(back, [*by, "nth"])


@query("SELECT lead_hours, CAST(count(DISTINCT realization) AS INT) AS n, true AS trivial FROM forecast GROUP BY lead_hours")
def q14_trivial_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize.trivial_axis(derived.forecast(spark, sf_dir), "realization", ["lead_hours"])


_HEX = "'0123456789ABCDEF'"
_PACK = f"""packs AS (
  SELECT lead_hours, realization, count(*) AS n, array_to_string(list(substr({_HEX}, b + 1, 1) ORDER BY lat_idx, lon_idx), '') AS d
  FROM (SELECT {CELLS}, {_bin('air_pressure_at_sea_level', dims.PRESSURE_EDGES)} AS b FROM forecast) GROUP BY lead_hours, realization)"""
_PACKED = "CASE WHEN n % 2 = 0 THEN d ELSE concat(substr(d, 1, n - 1), '0', substr(d, n, 1)) END"


def _packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quantize.quantize_variable(derived.forecast(spark, sf_dir), "air_pressure_at_sea_level", dims.PRESSURE_EDGES).withColumnRenamed("air_pressure_at_sea_level_bin", "bin")
    return quantize.pack_bins(df, ["lead_hours", "realization"], ["lat_idx", "lon_idx"])


@query(f"{CTE}, {_PACK} SELECT lead_hours, realization, CAST(n AS INT) AS n, {_PACKED} AS packed FROM packs")
def q15_pack_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packs(spark, sf_dir).select("lead_hours", "realization", "n", F.hex("packed").alias("packed"))


@query(f"{CTE}, {_PACK} SELECT lead_hours, realization, CAST(i AS INT) AS nth, strpos({_HEX}, substr(d, i + 1, 1)) - 1 AS bin FROM (SELECT *, unnest(range(n)) AS i FROM packs)")
def q16_unpack_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize.unpack_bins(_packs(spark, sf_dir), ["lead_hours", "realization"]).select("lead_hours", "realization", "nth", F.col("bin").cast("long").alias("bin"))


@query(
    f"{CTE}, {_PACK} SELECT lead_hours * 1000 + realization AS request_id, CAST(nth AS INT) AS nth, variable, CAST((n + 1) // 2 AS INT) AS size, CASE WHEN lead_hours = 6 THEN 'unknown variable' END AS error FROM packs, (VALUES (0, 'pressure'), (1, 'waveheight'), (2, 'wavedirection'), (-1, 'nonsense')) v(nth0, variable), LATERAL (SELECT CASE WHEN lead_hours = 6 THEN nth0 + 1 ELSE nth0 END AS nth) WHERE nth >= 0"
)
def q17_payload_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three variables given out of order; in one hour an unknown one as well."""
    names = F.when(F.col("lead_hours") == 6, F.array(*map(F.lit, ("wavedirection", "nonsense", "pressure", "waveheight")))).otherwise(F.array(*map(F.lit, ("waveheight", "wavedirection", "pressure"))))
    rows = _packs(spark, sf_dir).select((F.col("lead_hours") * 1000 + F.col("realization")).alias("request_id"), F.explode(names).alias("variable"), "packed")
    return quantize.read_manifest(quantize.payload_manifest(rows, dims.variable_dim(spark)))


_WDIR = _normr("radians(sea_surface_wave_to_direction)")


@query(f"SELECT {CELLS}, {_bin('sea_surface_wave_significant_height', dims.WAVE_EDGES)} AS height, {_bin(_WDIR, dims.DIRECTION_EDGES)} % 16 AS direction FROM forecast")
def q18_combined_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = derived.forecast(spark, sf_dir)
    df = df.withColumns(
        {
            "height": quantize.digitize(F.col("sea_surface_wave_significant_height"), dims.WAVE_EDGES),
            "direction": quantize.digitize_circular(angles.normalize(F.radians("sea_surface_wave_to_direction"), degrees=False), dims.DIRECTION_EDGES),
        }
    )
    return quantize.combined_variable(df, ["height", "direction"], "wave").select(*CELL, "wave.*")


@query(
    f"SELECT lead_hours, realization, 'wave' AS variable, CASE WHEN lead_hours = 12 OR lead_hours = 18 THEN NULL ELSE concat({{0}}, {{1}}) END AS packed, CASE lead_hours WHEN 12 THEN 'a part is missing' WHEN 18 THEN 'parts differ in size' END AS error FROM (SELECT lead_hours, realization, {_bin('sea_surface_wave_significant_height', dims.WAVE_EDGES)} AS h, {_bin(_WDIR, dims.DIRECTION_EDGES)} % 16 AS d, lat_idx, lon_idx FROM forecast) GROUP BY lead_hours, realization".format(
        *[f"array_to_string(list(substr({_HEX}, {b} + 1, 1) ORDER BY lat_idx, lon_idx), '')" for b in "hd"]
    )
)
def q18_combined_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height and direction side by side; one hour lacks a part, in one the parts differ in size."""
    df, by = derived.forecast(spark, sf_dir), ["lead_hours", "realization"]
    height = quantize.digitize(F.col("sea_surface_wave_significant_height"), dims.WAVE_EDGES)
    way = quantize.digitize_circular(angles.normalize(F.radians("sea_surface_wave_to_direction"), degrees=False), dims.DIRECTION_EDGES)
    cells = {"height": df.withColumn("bin", height), "direction": df.where("lead_hours <> 12 and (lead_hours <> 18 or lat_idx > 0)").withColumn("bin", way)}
    parts = [quantize.pack_bins(c, by, ["lat_idx", "lon_idx"]).withColumn("variable", F.lit(v)) for v, c in reversed(cells.items())]
    return quantize.combined_payload(parts[0].unionByName(parts[1]), by, ["height", "direction"], "wave").withColumn("packed", F.hex("packed"))


@query(f"SELECT lead_hours, round(max(abs({_normr(f'{_FROM} - {_edges(_DIRMID)}[{_DB} + 1]')})), 6) AS max_error FROM forecast GROUP BY lead_hours")
def q19_quantization_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quantize.quantize_velocity(derived.forecast(spark, sf_dir), "x_wind", "y_wind", "wind", dims.WIND_EDGES)
    df = quantize.decode_velocity(df, "wind", dims.WIND_EDGES).withColumn("true", angles.direction(F.col("x_wind"), F.col("y_wind")))
    return quantize.quantization_error(df, "true", "wind_direction", ["lead_hours"], circular=True).select("lead_hours", rnd("max_error").alias("max_error"))


@query(f"SELECT CASE WHEN sb BETWEEN 1 AND 13 THEN concat('F-', sb - 1) END AS force, count(*) AS n FROM (SELECT {_SB} AS sb FROM forecast) GROUP BY 1")
def q20_force_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _wind(derived.forecast(spark, sf_dir))
    return df.groupBy(quantize.force_label(quantize.digitize(F.col("wind_speed"), dims.WIND_EDGES)).alias("force")).agg(F.count("*").alias("n"))


@query(f"{CTE}, {_PACK} SELECT lead_hours, CAST(sum(n) AS BIGINT) AS n_values, CAST(sum((n + 1) // 2) AS BIGINT) AS n_bytes, round(sum(n) * 4 / sum((n + 1) // 2), 6) AS ratio FROM packs GROUP BY lead_hours")
def q21_compression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize.compression_report(_packs(spark, sf_dir), ["lead_hours"]).withColumn("ratio", rnd("ratio"))


# Ensembles and maps


@query(f"SELECT {CELLS}, {_SB} AS bin, CASE WHEN {_SB} = 0 THEN 'below the first bin' END AS error FROM forecast")
def g1_bin_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.bin_members(_wind(derived.forecast(spark, sf_dir)), "wind_speed", dims.WIND_EDGES).select(*CELL, "bin", "error")


def _probs(rows: str, value: str, by: str, edges: list[float]) -> str:
    top, n = repr(edges[-1]), len(edges) - 1
    return f"""SELECT {by}, i AS bin, round(count(*) FILTER (b = i) / nullif(count(*) FILTER (b BETWEEN 1 AND {n}), 0), 6) AS prob
    FROM (SELECT *, CASE WHEN {value} = {top}::DOUBLE THEN {n} WHEN {value} < {top}::DOUBLE THEN {_bin(value, edges)} END AS b FROM {rows}), (SELECT CAST(range AS INT) AS i FROM range(1, {n + 1})) GROUP BY {by}, i"""


@query(f"{CTE}, {_SPOT}, s AS (SELECT request_id, lead_hours, {_SPEED} AS speed FROM spot WHERE list_contains(hours, lead_hours)) {_probs('s', 'speed', 'request_id, lead_hours', dims.WIND_EDGES)}")
def g2_spot_force_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every spot request, the share of members in each wind force at each hour."""
    forecast = derived.forecast(spark, sf_dir)
    spots = derived.requests(spark, sf_dir).where("kind = 'spot'")
    spec = subset.grid_spec(forecast)

    def answer(r: DataFrame) -> DataFrame:
        at = _wind(subset.spot_subset(r, forecast, spec, ["x_wind", "y_wind"]))
        return ensemble.bin_probabilities(at, "wind_speed", dims.WIND_EDGES, ["request_id", "lead_hours"]).withColumn("prob", rnd("prob"))

    return subset.answered_once(spots, subset.SPOT, answer)


_EMB = "e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings)"
_EMB_EDGES = [-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]


@query(f"WITH {_EMB} {_probs('e', 'v', 'vec_id', _EMB_EDGES)}")
def g2_wide_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.explode("embedding").alias("v")).withColumn("v", F.col("v").cast("double"))
    return ensemble.bin_probabilities(df, "v", _EMB_EDGES, ["vec_id"]).withColumn("prob", rnd("prob"))


@query(
    f"SELECT lat_idx, lead_hours, greatest({_bin('lo - 2', dims.WIND_EDGES)}, 0) AS min_bin, CAST(least({_bin('hi + 1', dims.WIND_EDGES)}, n) AS INT) AS max_bin, least({_bin('hi + 2', dims.WIND_EDGES)}, 14) AS headroom, round(hi, 6) AS max_wind_speed FROM (SELECT lat_idx, lead_hours, min({_SPEED}) AS lo, max({_SPEED}) AS hi, count(*) AS n FROM forecast GROUP BY lat_idx, lead_hours)"
)
def g3_g4_g6_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, by = _wind(derived.forecast(spark, sf_dir)), ["lat_idx", "lead_hours"]
    out = ensemble.visible_bin_range(df, "wind_speed", dims.WIND_EDGES, by).join(ensemble.headroom_bin(df, "wind_speed", dims.WIND_EDGES, by).withColumnRenamed("max_bin", "headroom"), by)
    return out.join(ensemble.max_over_forecast(df, "wind_speed", by), by).withColumn("max_wind_speed", rnd("max_wind_speed"))


@query("SELECT lat_idx, lon_idx, count(*) AS n FROM forecast WHERE (lat_idx + lon_idx) % 7 <> 0 GROUP BY ALL")
def g5_drop_empty_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["lat_idx", "lon_idx", "lead_hours"]
    return ensemble.drop_empty_times(derived.forecast(spark, sf_dir), "sea_water_x_velocity", by).groupBy("lat_idx", "lon_idx").agg(F.count("*").alias("n"))


_BOXES = f"""{_MET}, lons AS (SELECT DISTINCT request_id, longitude AS lon FROM met),
gaps AS (SELECT request_id, lon, lon - coalesce(lag(lon) OVER (PARTITION BY request_id ORDER BY lon), max(lon) OVER (PARTITION BY request_id) - 360) AS gap FROM lons),
west AS (SELECT request_id, max_by(lon, gap * 1000 + lon) AS west, max_by({_norm('lon - gap')}, gap * 1000 + lon) AS east FROM gaps GROUP BY request_id),
lats AS (SELECT request_id, min(latitude) AS lo, max(latitude) AS hi, quantile_cont(DISTINCT latitude, 0.5) AS lat FROM met GROUP BY request_id),
offs AS (SELECT request_id, list_sort(list(lon - west - 360 * floor((lon - west) / 360))) AS l FROM lons JOIN west USING (request_id) GROUP BY request_id),
mid AS (SELECT request_id, (l[(len(l) + 1) // 2] + l[len(l) // 2 + 1]) / 2 AS off, l[len(l) // 2 + 1] - l[(len(l) + 1) // 2] AS apart FROM offs)"""


def _of_places(spark: SparkSession, sf_dir: str, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """answer(places of requests), for each box."""
    forecast, wanted = _snapped(spark, sf_dir)
    places = subset.over_members(forecast)
    return subset.answered_once(wanted, subset.BOX, lambda r: answer(subset.gridded_subset(r, places)))


@query(f"{CTE}, {_BOXES} SELECT request_id, round({_norm('west - 1')}, 6) AS west, round({_norm('east + 1')}, 6) AS east, lo - 1 AS south, hi + 1 AS north FROM west JOIN lats USING (request_id)")
def g7_bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _of_places(spark, sf_dir, lambda places: ensemble.bounding_box(places, ["request_id"], pad_degrees=1.0))
    return got.select("request_id", rnd("west").alias("west"), rnd("east").alias("east"), "south", "north")


@query(f"{CTE}, {_BOXES} SELECT request_id, CASE WHEN apart < 90 THEN round({_norm('west + off')}, 6) END AS lon, lat, CASE WHEN apart >= 90 THEN 'the centre is not defined' END AS error FROM west JOIN lats USING (request_id) JOIN mid USING (request_id)")
def g8_central_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_places(spark, sf_dir, lambda places: ensemble.central_point(places, ["request_id"])).select("request_id", rnd("lon").alias("lon"), "lat", "error")


@query(
    f"{CTE}, {_BOXES} SELECT request_id, round(2 * 2 * 6370997.0 * asin(sqrt(least(1.0, cos(radians(lat)) * cos(radians(lat)) * pow(sin(radians((east - west - 360 * floor((east - west) / 360)) / 2) / 2), 2)))), 3) AS width, round(2 * 6370997.0 * asin(sqrt(pow(sin(radians(hi - lo) / 2), 2))), 3) AS height FROM west JOIN lats USING (request_id)"
)
def g9_box_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_places(spark, sf_dir, lambda places: ensemble.box_size(places, ["request_id"])).select("request_id", rnd("width", 3).alias("width"), rnd("height", 3).alias("height"))


@query(f"SELECT lead_hours, median(step) AS step FROM (SELECT lead_hours, {_norm('latitude - before')} AS step FROM (SELECT *, lag(latitude) OVER (PARTITION BY lead_hours ORDER BY latitude) AS before FROM (SELECT DISTINCT lead_hours, latitude FROM forecast))) GROUP BY lead_hours")
def g10_grid_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.grid_step(derived.forecast(spark, sf_dir), ["lead_hours"])


@query(
    f"SELECT {CELLS}, CAST(row_number() OVER (PARTITION BY lead_hours, lat_idx, lon_idx ORDER BY speed, realization) - 1 AS INT) AS rank, round({_normr('dir + pi()')}, 6) AS shown_direction, NOT coalesce(speed > 0, false) AS calm FROM (SELECT {CELLS}, {_CS.replace('coalesce(', '').replace(', -1.0)', '')} AS speed, {_normr('atan2(sea_water_x_velocity + 0.0, sea_water_y_velocity + 0.0)')} AS dir FROM forecast WHERE sea_water_x_velocity IS NOT NULL)"
)
def g11_member_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = derived.forecast(spark, sf_dir).where("sea_water_x_velocity IS NOT NULL")
    df = angles.velocity_columns(df, "sea_water_x_velocity", "sea_water_y_velocity", "speed", "dir", "to")
    got = ensemble.member_rank(df, ["lead_hours", "lat_idx", "lon_idx"], "speed", "dir", stored="to")
    return got.select(*CELL, "rank", rnd("shown_direction").alias("shown_direction"), "calm")


@query(f"SELECT len(list_filter({_edges(dims.WIND_KNOTS)}, lambda q: q <= round({_SPEED} * 1.94384449, 6))) AS bin, count(*) AS n FROM forecast GROUP BY 1")
def g12_edges_in_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    knots = [round(e * units.factor("m/s", "knots"), 6) for e in dims.WIND_EDGES]
    speed = rnd(units.convert(F.col("wind_speed"), "m/s", "knots"))
    return _wind(derived.forecast(spark, sf_dir)).groupBy(quantize.digitize(speed, knots).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query(f"SELECT lead_hours, lat_idx, lon_idx, count(*) AS n, round(avg({_SPEED}), 6) AS mean, round(min({_SPEED}), 6) AS lowest, round(max({_SPEED}), 6) AS highest FROM forecast GROUP BY ALL")
def g13_cell_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ensemble.cell_summary(_wind(derived.forecast(spark, sf_dir)), "wind_speed", ["lead_hours", "lat_idx", "lon_idx"])
    return got.select("lead_hours", "lat_idx", "lon_idx", "n", *[rnd(c).alias(c) for c in ("mean", "lowest", "highest")])


# Requests from text

_LINES = r"""lines AS (
  SELECT msg_id, i - 1 AS line_no, trim(regexp_extract(line, '^\s*(send\s.+)\s*', 1)) AS text
  FROM (SELECT msg_id, unnest(string_split(lower(body), E'\n')) AS line, generate_subscripts(string_split(lower(body), E'\n'), 1) AS i FROM messages)
  WHERE regexp_matches(line, '^\s*send\s.+'))"""
_ROUTED = rf"""{_LINES}, bodies AS (
  SELECT *, array_to_string(list_filter(string_split_regex(text, '\s+')[2:], lambda t, j: len(list_filter(string_split_regex(text, '\s+')[2:j + 1], lambda q: contains(q, '='))) = 0), '') AS body,
         contains(text, '=') AS has_option FROM lines),
routed AS (
  SELECT *, CASE WHEN starts_with(body, 'spot:') THEN 'spot' ELSE 'gridded' END AS kind,
    CASE WHEN starts_with(body, 'spot:') THEN CASE WHEN len(string_split(body, ':')) > 2 THEN string_split(body, ':')[2] ELSE 'gefs' END WHEN contains(body, ':') THEN string_split(body, ':')[1] END AS asked,
    string_split_regex(string_split(body, ':')[-1], '[|/Ś]') AS f FROM bodies)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = rq.extract_request_lines(derived.messages(spark, sf_dir))
    return lines.withColumn("request_id", F.col("msg_id") * 10 + F.col("line_no"))


@query(f"{CTE}, {_LINES} SELECT msg_id, CAST(line_no AS INT) AS line_no, text FROM lines")
def b1_extract_request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rq.extract_request_lines(derived.messages(spark, sf_dir))


@query(f"{CTE}, {_ROUTED} SELECT msg_id, CAST(line_no AS INT) AS line_no, f[1] AS f0, f[2] AS f1, f[3] AS f2, f[4] AS f3 FROM routed")
def b2_split_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, body, _ = rq.split_command(F.col("text"))
    fields = rq.split_fields(F.element_at(F.split(body, ":"), -1), 4)
    return rq.extract_request_lines(derived.messages(spark, sf_dir)).select("msg_id", "line_no", *[f.alias(f"f{i}") for i, f in enumerate(fields)])


@query(
    f"{CTE}, {_ROUTED} SELECT msg_id * 10 + line_no AS request_id, kind, CASE asked WHEN 'gfsens' THEN 'gefs' WHEN 'fnens' THEN 'fens' WHEN 'nomodel' THEN NULL ELSE asked END AS model, CASE WHEN has_option THEN ['options ignored'] ELSE CAST([] AS VARCHAR[]) END AS warnings, CASE WHEN asked = 'nomodel' THEN 'unknown model' END AS error FROM routed"
)
def b3_b4_route_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rq.route_request(_lines(spark, sf_dir)).select("request_id", "kind", "model", "warnings", "error")


_NAMES = ", ".join(f"'{v}'" for v in ("time", "realization", "latitude", "longitude", "wind", "current", "temperature", "pressure", "waveheight", "wavedirection", "seatemperature", "wave"))
_NAMED = f"CASE WHEN {{x}} IN ({_NAMES}) THEN {{x}} WHEN {{x}} = 'press' THEN 'pressure' WHEN {{x}} = 'temp' THEN 'temperature' WHEN {{x}} = 'wvsig' THEN 'waveheight' END"
_FIND = f"coalesce({_NAMED.format(x='q')}, {_NAMED.format(x="regexp_replace(q, '[^a-z0-9]', '', 'g')")})"
_CORNER = "(CASE WHEN right(c, 1) IN ('s', 'w') THEN -1 ELSE 1 END) * TRY_CAST(regexp_extract(c, '^([+-]?[0-9.]+)[nsew]$', 1) AS DOUBLE)"
_LAST = "TRY_CAST(string_split({t}, '..')[-1] AS BIGINT)"
_FIRST = "TRY_CAST(string_split(t, '..')[1] AS BIGINT)"
_GAP = f"({_FIRST} - coalesce({_LAST.format(t='toks[i - 1]')}, 0))"
_HOURS_OF = f"""list_transform(toks, lambda t, i: CASE WHEN NOT contains(t, '..') THEN CASE WHEN {_FIRST} IS NOT NULL THEN [{_FIRST}] END
      WHEN len(string_split(t, '..')) = 2 AND {_GAP} > 0 AND {_LAST.format(t='t')} >= {_FIRST} AND ({_LAST.format(t='t')} - {_FIRST}) % nullif({_GAP}, 0) = 0
      THEN range({_FIRST}, {_LAST.format(t='t')} + 1, {_GAP}) END)"""
_PARSED = rf"""{_ROUTED}, fields AS (
  SELECT msg_id * 10 + line_no AS request_id, msg_id, text, kind, has_option, f, kind = 'spot' AS is_spot,
    CASE asked WHEN 'gfsens' THEN 'gefs' WHEN 'fnens' THEN 'fens' WHEN 'nomodel' THEN NULL ELSE asked END AS model,
    string_split(f[1], ',') AS corners, CASE WHEN kind = 'spot' THEN f[3] ELSE f[4] END AS names_text,
    CASE WHEN kind = 'spot' THEN coalesce(nullif(f[2], ''), '5,6') ELSE coalesce(nullif(f[3], ''), '24,48,72') END AS hours_text FROM routed),
parts AS (
  SELECT *, list_filter(list_transform(corners, lambda c: CASE WHEN right(c, 1) IN ('n', 's') THEN round({_CORNER}, 8) END), lambda x: x IS NOT NULL) AS lats,
    list_filter(list_transform(corners, lambda c: CASE WHEN right(c, 1) IN ('e', 'w') THEN round({_CORNER}, 8) END), lambda x: x IS NOT NULL) AS lons,
    string_split(regexp_replace(regexp_replace(hours_text, '\s+', '', 'g'), ',*\.\.+,*', '..', 'g'), ',') AS toks,
    TRY_CAST(string_split(hours_text, ',')[1] AS INT) AS days, TRY_CAST(string_split(hours_text, ',')[2] AS INT) AS gap,
    is_spot AND len(string_split(hours_text, ',')) = 2 AND NOT contains(hours_text, '..') AS two,
    CASE WHEN is_spot OR coalesce(f[2], '') IN ('', 'native') THEN NULL ELSE list_transform(string_split(f[2], ','), lambda x: TRY_CAST(x AS DOUBLE)) END AS steps,
    list_distinct(list_filter(list_transform(string_split(coalesce(names_text, ''), ','), lambda x: lower(trim(x))), lambda x: x <> '')) AS names FROM fields),
read AS (
  SELECT *, coalesce(two AND days > 0 AND gap > 0, false) AS pair, list_transform(lons, lambda x: round({_norm('x')}, 8)) AS around, {_HOURS_OF} AS runs,
    list_sort(list_distinct(list_filter(list_transform(names, lambda q: {_FIND}), lambda x: x IS NOT NULL))) AS found,
    list_sort(list_filter(names, lambda q: {_FIND} IS NULL)) AS unknown,
    CASE WHEN len(lats) <> CASE WHEN is_spot THEN 1 ELSE 2 END OR len(lons) <> CASE WHEN is_spot THEN 1 ELSE 2 END
           THEN CASE WHEN is_spot THEN 'expected 1 latitudes and 1 longitudes' ELSE 'expected 2 latitudes and 2 longitudes' END
         WHEN len(list_filter(lats, lambda x: x NOT BETWEEN -90 AND 90)) > 0 THEN 'latitude out of range'
         WHEN len(list_filter(lons, lambda x: x NOT BETWEEN -180 AND 360)) > 0 THEN 'longitude out of range'
         WHEN len(corners) <> CASE WHEN is_spot THEN 2 ELSE 4 END THEN CASE WHEN is_spot THEN 'expected two coordinates' ELSE 'expected four corners' END END AS place_error,
    len(steps) > 2 OR len(list_filter(steps, lambda x: x IS NULL)) > 0 AS bad_steps FROM parts),
typed AS (
  SELECT request_id, msg_id, text, kind, model,
    CASE WHEN NOT is_spot AND place_error IS NULL THEN list_max(lats) END AS n, CASE WHEN NOT is_spot AND place_error IS NULL THEN list_min(lats) END AS s,
    CASE WHEN NOT is_spot AND place_error IS NULL THEN CASE WHEN {_norm('around[1] - around[2]')} <= 0 THEN around[2] ELSE around[1] END END AS e,
    CASE WHEN NOT is_spot AND place_error IS NULL THEN CASE WHEN {_norm('around[1] - around[2]')} <= 0 THEN around[1] ELSE around[2] END END AS w,
    CASE WHEN is_spot AND place_error IS NULL THEN lats[1] END AS lat, CASE WHEN is_spot AND place_error IS NULL THEN around[1] END AS lon,
    CASE WHEN NOT coalesce(bad_steps, true) THEN list_max(list_transform(steps, lambda x: abs(x))) END AS resolution,
    CASE WHEN pair THEN CAST(range(0, 24 * days + 1, CASE WHEN gap > 0 THEN gap ELSE 1 END) AS INT[]) WHEN len(list_filter(runs, lambda x: x IS NULL)) = 0 THEN CAST(flatten(runs) AS INT[]) END AS hours,
    CASE WHEN len(found) > 0 THEN found WHEN len(names) = 0 THEN ['wind'] END AS variables,
    len(list_filter(f[5:], lambda x: x = 'image')) > 0 AS send_image,
    list_concat(list_filter([CASE WHEN has_option THEN 'options ignored' END,
      CASE WHEN NOT coalesce(bad_steps, true) AND len(list_distinct(steps)) > 1 THEN 'resolutions differ, the larger is used' END,
      CASE WHEN pair AND (gap < 3 OR days > 14) THEN 'very long or very fine forecast' END,
      CASE WHEN NOT is_spot AND coalesce(f[3], '') = '' THEN 'no hours given, 24,48,72 used' END], lambda x: x IS NOT NULL), list_transform(unknown, lambda u: concat('unknown variable ', u))) AS warnings,
    CASE WHEN model IS NULL THEN 'unknown model' ELSE coalesce(place_error,
      CASE WHEN NOT pair AND len(list_filter(runs, lambda x: x IS NULL)) > 0 THEN 'bad hours' END, CASE WHEN bad_steps THEN 'bad resolution' END,
      CASE WHEN len(found) = 0 AND len(names) > 0 THEN 'no known variable' END) END AS error FROM read)"""


@query(f"{CTE}, {_PARSED} SELECT * EXCLUDE (text) FROM typed")
def b5_b10_parse_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole parse, of whole messages; the faults of single fields are held against truth tables in the tests."""
    return rq.parse_requests(_lines(spark, sf_dir))


_KEYVALUE = """SELECT c_custkey AS msg_id, {concat} AS body FROM customer"""
_KV_SPARK = "concat('model=gfs\\narea: ', c_custkey % 40, 'n,10s,20w,30e\\ngrid;', c_custkey % 3, '\\nDays:', c_custkey % 5, '\\nhours=', c_custkey % 4 * 3, '\\nwind\\npressure')"


@query(
    "SELECT c_custkey AS msg_id, concat(c_custkey % 40, 'n,10s,20w,30e') AS domain, CAST(c_custkey % 3 AS VARCHAR) AS resolution, CASE WHEN c_custkey % 5 > 0 AND c_custkey % 4 > 0 THEN CAST(range(0, 24 * (c_custkey % 5) + 1, CASE WHEN c_custkey % 4 > 0 THEN 3 * (c_custkey % 4) ELSE 1 END) AS INT[]) END AS hours, 'pressure,wind' AS variables_text, 'gfs' AS model, 1 AS ignored FROM customer"
)
def b11_keyvalue_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _KEYVALUE.format(concat=_KV_SPARK).replace("FROM customer", "FROM {t}")
    return rq.keyvalue_requests(spark.sql(body, t=spark.read.parquet(f"{sf_dir}/customer.parquet")))


@query("SELECT c_custkey % 6 AS sort, count(*) AS n, CASE c_custkey % 6 WHEN 2 THEN 'unknown model' WHEN 3 THEN 'no request found' WHEN 4 THEN 'bad hours' WHEN 5 THEN 'latitude out of range' END AS error FROM customer WHERE c_custkey % 6 > 1 GROUP BY ALL")
def b12_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, lines = derived.messages(spark, sf_dir), _lines(spark, sf_dir)
    _, bad = rq.quarantine(rq.parse_requests(lines), messages, lines)
    return bad.groupBy((F.col("msg_id") % 6).alias("sort"), "error").agg(F.count("*").alias("n"))


@query("SELECT c_custkey % 6 AS sort, count(*) AS n, CASE c_custkey % 6 WHEN 2 THEN 'unknown model' WHEN 3 THEN 'no request found' WHEN 4 THEN 'bad hours' WHEN 5 THEN 'latitude out of range' END AS error FROM customer WHERE c_custkey % 6 > 1 GROUP BY ALL")
def b12_quarantine_every_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is rejected; messages of sorts 0 and 1 have good requests only, and hours of 0..144 are malformed."""
    messages, lines = derived.messages(spark, sf_dir), _lines(spark, sf_dir)
    _, bad = rq.quarantine(rq.parse_requests(lines), messages, lines)
    return bad.groupBy((F.col("msg_id") % 6).alias("sort"), "error").agg(F.count("*").alias("n"))


@query(
    "SELECT request_id, CASE WHEN kind = 'spot' THEN printf('spot gefs %6.2f,%6.2f %d-%d Hours', lat, lon, hours[1], hours[-1]) ELSE printf('gridded gefs %6.2f,%6.2f,%6.2f,%6.2f %d-%d Hours', n, s, e, w, hours[1], hours[-1]) END AS summary FROM requests"
)
def b13_request_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rq.request_summary(derived.requests(spark, sf_dir))


@query("SELECT model, variable, count(*) AS n FROM (SELECT DISTINCT model, run_time FROM forecast), (VALUES ('latitude'), ('longitude'), ('wind'), ('current'), ('temperature'), ('pressure'), ('waveheight'), ('wavedirection'), ('wave')) v(variable) GROUP BY ALL")
def b14_available_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rq.available_variables(derived.forecast(spark, sf_dir)).groupBy("model", "variable").agg(F.count("*").alias("n"))


@query(
    "SELECT model, CAST(epoch(run_time) AS BIGINT) + 3600 * lead_hours AS run_time, CASE lead_hours WHEN 0 THEN 'pressure' WHEN 6 THEN 'waveheight' END AS variable, CASE WHEN lead_hours = 12 THEN 'no variable' WHEN lead_hours > 12 THEN 'several variables' END AS error FROM (SELECT DISTINCT model, run_time, lead_hours FROM forecast)"
)
def b14_the_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hours as runs of which some have one variable, none or several."""
    df, hour = derived.forecast(spark, sf_dir), F.col("lead_hours")
    runs_of = df.select(
        "model", F.timestamp_seconds(F.unix_seconds(F.col("run_time").cast("timestamp")) + 3600 * hour).alias("run_time"), "latitude", "longitude",
        F.when((hour == 0) | (hour > 12), F.col("air_pressure_at_sea_level")).alias("air_pressure_at_sea_level"),
        F.when((hour == 6) | (hour > 12), F.col("sea_surface_wave_significant_height")).alias("sea_surface_wave_significant_height"),
    )
    return rq.the_variable(rq.available_variables(runs_of)).select("model", F.unix_seconds("run_time").alias("run_time"), "variable", "error")


@query("SELECT msg_id, CASE WHEN contains(sender, 'iridium') THEN 'zip' ELSE 'fcst' END AS extension, contains(sender, 'sailmail') AND strlen(body) > 50 AS rejected FROM messages")
def b15_delivery_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.messages(spark, sf_dir).select("msg_id", "sender", F.col("body").cast("binary").alias("payload"))
    return rq.delivery_policy(rows, limit=50).select("msg_id", "extension", "rejected")


_S1_CTE = f"WITH forecast AS ({derived.duck(derived.FORECAST)}), messages AS ({derived.duck(derived.MESSAGES)}), spec AS ({derived.SPEC})"
_S1_KEYS = "request_id, lead_hours, realization, lon_off, lat_idx"
_S1_ORDER = "ORDER BY lead_hours, realization, lon_off, lat_idx"


def _digits(b: str) -> str:
    return f"array_to_string(list(substr({_HEX}, {b} + 1, 1) {_S1_ORDER}), '')"


def _evened(d: str) -> str:
    return f"CASE WHEN length({d}) % 2 = 0 THEN {d} ELSE concat(substr({d}, 1, length({d}) - 1), '0', substr({d}, length({d}), 1)) END"


@query(rf"""{_S1_CTE}, {_PARSED},
requests AS (SELECT request_id, kind, model, n, s, e, w, lat, lon, resolution, hours, variables FROM typed WHERE error IS NULL AND model = 'gefs'),
{_MET}, {_CORNERS},
spot AS (
  SELECT request_id, lead_hours, realization, 0 AS lon_off, 0 AS lat_idx, sum(weight * x_wind) AS x_wind, sum(weight * y_wind) AS y_wind, sum(weight * air_pressure_at_sea_level) AS air_pressure_at_sea_level
  FROM corners JOIN forecast USING (model, lat_idx, lon_idx) WHERE weight > 0 AND list_contains(hours, lead_hours) GROUP BY ALL),
cells AS (
  SELECT {_S1_KEYS}, x_wind, y_wind, air_pressure_at_sea_level FROM met UNION ALL SELECT {_S1_KEYS}, x_wind, y_wind, air_pressure_at_sea_level FROM spot),
bins AS (SELECT c.*, {_SB} AS sb, {_DB} AS db, {_bin('air_pressure_at_sea_level', dims.PRESSURE_EDGES)} AS pb FROM cells c),
packs AS (SELECT request_id, {_digits('sb')} AS sd, {_digits('db')} AS dd, {_digits('pb')} AS pd FROM bins GROUP BY request_id),
answers AS (
  SELECT request_id, CASE WHEN list_contains(variables, 'wind') THEN concat({_evened('sd')}, {_evened('dd')}) END AS wind, CASE WHEN list_contains(variables, 'pressure') THEN {_evened('pd')} END AS pressure
  FROM packs JOIN requests USING (request_id))
SELECT concat(t.msg_id, '-', t.request_id - 10 * t.msg_id) AS request_id, t.msg_id, kind, t.model, hours, variables,
  CASE WHEN t.model = 'gefs' THEN CAST(1388556000 AS BIGINT) END AS run_time, CAST((length(coalesce(wind, '')) + length(coalesce(pressure, ''))) // 2 AS BIGINT) AS total_bytes, md5(wind) AS wind, md5(pressure) AS pressure,
  CASE WHEN t.error IS NOT NULL THEN t.error WHEN t.model <> 'gefs' THEN 'no run available' WHEN a.request_id IS NULL THEN 'nothing of the forecast fits the request' END AS error
FROM typed t LEFT JOIN answers a USING (request_id)
UNION ALL SELECT NULL, msg_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'no request found' FROM messages WHERE msg_id NOT IN (SELECT msg_id FROM typed)""")
def s1_answer_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream does with each batch, over all messages at once: typed, matched with the latest run, cut out, packed, listed."""
    messages = derived.messages(spark, sf_dir).withColumn("received_at", F.timestamp_seconds(F.lit(1388556000 + 7200) + F.col("msg_id") % 7200))
    forecast = derived.forecast(spark, sf_dir)
    got = answer_batch(messages, forecast.select("model", "run_time"), forecast, folder=derived.shared_folder(spark))
    packed = lambda v: F.md5(F.hex(F.try_element_at("payloads", F.lit(v))).cast("binary")).alias(v)
    total = F.when(F.col("request_id").isNotNull(), F.coalesce("total_bytes", F.lit(0))).alias("total_bytes")
    return got.select("request_id", "msg_id", "kind", "model", "hours", "variables", F.unix_seconds("run_time").alias("run_time"), total, packed("wind"), packed("pressure"), "error")
