"""Dimension tables: models, variables, aliases and export codes. A user adds a variable by adding a row."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from seagrid.sources.parameters import PARAMETERS

KNOT = 1.94384449  # knots in one metre a second

#: Model, hours between its runs, whether it is an ensemble, its variables.
MODELS = [
    ("gefs", 6, True, ["wind", "temperature", "pressure"]),
    ("gfs", 6, False, ["wind", "temperature", "pressure"]),
    ("cmcens", 12, True, ["wind", "temperature", "pressure"]),
    ("fens", 6, True, ["wind", "temperature", "pressure"]),
    ("ww3", 6, False, ["waveheight", "wavedirection"]),
    ("rtofs", 24, False, ["current", "seatemperature"]),
]
#: Other names of models.
MODEL_ALIASES = [("gfsens", "gefs"), ("fnens", "fens"), ("fnmocens", "fens")]

#: Names that sources use and the names of the conventions.
CF_NAMES = {
    "ugrd10m": "x_wind",
    "vgrd10m": "y_wind",
    "tmp2m": "air_temperature",
    "prmslmsl": "air_pressure_at_sea_level",
    "u_velocity": "sea_water_x_velocity",
    "v_velocity": "sea_water_y_velocity",
    "sst": "sea_surface_temperature",
    "htsgwsfc": "sea_surface_wave_significant_height",
    "dirpwsfc": "sea_surface_wave_to_direction",
    "lat": "latitude",
    "lon": "longitude",
    "ens": "realization",
}
#: Unit of each variable.
CF_UNITS = {
    "x_wind": "m/s",
    "y_wind": "m/s",
    "air_temperature": "degC",
    "air_pressure_at_sea_level": "Pa",
    "sea_water_x_velocity": "m/s",
    "sea_water_y_velocity": "m/s",
    "sea_surface_temperature": "degC",
    "sea_surface_wave_significant_height": "m",
    "sea_surface_wave_to_direction": "degrees",
}

#: Bin edges, speeds in knots.
WIND_KNOTS = [0.0, 1.0, 3.0, 6.0, 10.0, 16.0, 21.0, 27.0, 33.0, 40.0, 47.0, 55.0, 63.0, 75.0]
CURRENT_KNOTS = [0.0, 0.01, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0, 7.0]
PRESSURE_EDGES = [97500.0, 99000.0, 99750.0, 100500.0, 100700.0, 100850.0, 101000.0, 101150.0, 101350.0, 101600.0, 101900.0, 102150.0, 102500.0, 103100.0, 104000.0]
WAVE_EDGES = [0.0, 0.2, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 10.0, 15.0]
WIND_EDGES = [k / KNOT for k in WIND_KNOTS]
CURRENT_EDGES = [k / KNOT for k in CURRENT_KNOTS]
MASKED_EDGES = [-1.0, *CURRENT_EDGES]
DIRECTION_EDGES = [math.pi * (2 * i - 15) / 16 for i in range(16)]

#: Variable, kind, source columns, unit, bin edges, whether circular, decimal digits, order in a payload.
VARIABLES = [
    ("time", "time", ["lead_hours"], "hours", [], False, 0, 1),
    ("realization", "trivial", ["realization"], "1", [], False, 0, 2),
    ("latitude", "rounded", ["latitude"], "degrees_north", [], False, 3, 3),
    ("longitude", "rounded", ["longitude"], "degrees_east", [], False, 3, 4),
    ("wind", "velocity", ["x_wind", "y_wind"], "m/s", WIND_EDGES, False, 0, 5),
    ("current", "masked_velocity", ["sea_water_x_velocity", "sea_water_y_velocity"], "m/s", MASKED_EDGES, False, 0, 6),
    ("temperature", "rounded", ["air_temperature"], "degC", [], False, 0, 7),
    ("pressure", "scalar", ["air_pressure_at_sea_level"], "Pa", PRESSURE_EDGES, False, 0, 8),
    ("waveheight", "scalar", ["sea_surface_wave_significant_height"], "m", WAVE_EDGES, False, 0, 9),
    ("wavedirection", "circular", ["sea_surface_wave_to_direction"], "degrees", DIRECTION_EDGES, True, 0, 10),
    ("seatemperature", "rounded", ["sea_surface_temperature"], "degC", [], False, 0, 11),
    ("wave", "combined", ["sea_surface_wave_significant_height", "sea_surface_wave_to_direction"], "1", [], False, 0, 12),
]
#: Other names that requests use; the last has no variable behind it.
ALIASES = [("press", "pressure"), ("temp", "temperature"), ("wvsig", "waveheight"), ("precip", "precipitation")]
#: Export code of each column, and level type and level of those that have one.
EXPORTS = [
    ("air_pressure_at_sea_level", 2, None, None),
    ("air_temperature", 11, None, None),
    ("x_wind", 33, 105, 10),
    ("y_wind", 34, 105, 10),
    ("sea_water_x_velocity", 49, None, None),
    ("sea_water_y_velocity", 50, None, None),
    ("sea_surface_temperature", 80, None, None),
    ("sea_surface_wave_significant_height", 100, None, None),
    ("sea_surface_wave_to_direction", 101, None, None),
]


def model_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "model string, freq_hours int, is_ensemble boolean, variables array<string>")


def variable_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VARIABLES, "name string, kind string, source_cols array<string>, unit string, edges array<double>, wrap boolean, digits int, ord int")


def alias_rows() -> list[tuple[str, str]]:
    """(alias, variable) of all names a request may use; names without a variable are left out."""
    known = {v[0] for v in VARIABLES}
    return [a for a in ALIASES if a[1] in known] + [(v, v) for v in sorted(known)]


def alias_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(alias_rows(), "alias string, variable string")


def model_alias_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODEL_ALIASES + [(m[0], m[0]) for m in MODELS], "alias string, model string")


def export_dim(spark: SparkSession) -> DataFrame:
    """Rows (variable, code, level_type, level, code_name, code_unit)."""
    table = {code: (name, unit) for code, name, unit in PARAMETERS}
    return spark.createDataFrame([(*e, *table[e[1]]) for e in EXPORTS], "variable string, code int, level_type int, level int, code_name string, code_unit string")


def parameter_dim(spark: SparkSession) -> DataFrame:
    """The whole parameter table: rows (code, name, unit)."""
    return spark.createDataFrame(PARAMETERS, "code int, name string, unit string")
