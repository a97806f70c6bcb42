"""Unit conversion by factor within a family, in long and wide form, and range rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Family, unit, factor to the family's default, whether it is the default.
UNITS = [
    ("precipitation", "kg.m-2.s-1", 1.0, True),
    ("precipitation", "kg m-2 s-1", 1.0, False),
    ("precipitation", "mm/hr", 1 / 3600, False),
    ("length", "m", 1.0, True),
    ("length", "ft", 1 / 3.2808399, False),
    ("length", "nautical_mile", 6076 / 3.2808399, False),
    ("speed", "m/s", 1.0, True),
    ("speed", "m s-1", 1.0, False),
    ("speed", "knot", 1 / 1.94384449, False),
    ("speed", "knots", 1 / 1.94384449, False),
    ("speed", "mph", 0.868976242 / 1.94384449, False),
    ("longitude", "degrees_east", 1.0, True),
    ("longitude", "degrees_west", -1.0, False),
    ("latitude", "degrees_north", 1.0, True),
    ("latitude", "degrees_south", -1.0, False),
    ("pressure", "Pa", 1.0, True),
    ("pressure", "kg m-1 s-2", 1.0, False),
    ("pressure", "hPa", 100.0, False),
    ("pressure", "kPa", 1000.0, False),
    ("pressure", "atm", 101325.0, False),
    ("pressure", "bar", 100000.0, False),
    ("angle", "degrees", 1.0, True),
    ("angle", "deg", 1.0, False),
    ("angle", "radians", 57.29577951308232, False),
    ("angle", "rad", 57.29577951308232, False),
]


def unit_dim(spark: SparkSession) -> DataFrame:
    """Rows (family, unit, factor, is_default)."""
    return spark.createDataFrame(UNITS, "family string, unit string, factor double, is_default boolean")


def factor(unit: str, to: str) -> float:
    found = {u: (family, f) for family, u, f, _ in UNITS}
    if unit not in found or to not in found:
        raise ValueError(f"unknown unit: {unit if unit not in found else to}")
    if found[unit][0] != found[to][0]:
        raise ValueError(f"{unit} is not of the family of {to}")
    return found[unit][1] / found[to][1]


def convert(value: Column, unit: str, to: str) -> Column:
    """Wide form: all values of a column in one unit."""
    return value * factor(unit, to)


def convert_units(df: DataFrame, to: str, value: str = "value", unit: str = "unit") -> DataFrame:
    """Long form: each row has its own unit. Rows of an unknown unit or another family get an error and no value."""
    dim = unit_dim(df.sparkSession)
    target = dim.where(F.col("unit") == to).select(F.col("family").alias("to_family"), F.col("factor").alias("to_factor"))
    own = dim.select(F.col("unit").alias("own_unit"), F.col("family").alias("own_family"), F.col("factor").alias("own_factor"))
    met = df.join(F.broadcast(own), F.col(unit) == F.col("own_unit"), "left").crossJoin(F.broadcast(target))
    fits = F.col("own_family") == F.col("to_family")
    met = met.withColumn("converted", F.when(fits, F.col(value) * F.col("own_factor") / F.col("to_factor")))
    met = met.withColumn("error", F.when(F.col("own_family").isNull(), F.lit("unknown unit")).when(~fits, F.lit("another family")))
    return met.drop("own_unit", "own_family", "own_factor", "to_family", "to_factor")


def normalize_units(df: DataFrame, value: str = "value", unit: str = "unit") -> DataFrame:
    """Long form: every value in its family's default unit; rows of unknown units stay as they are."""
    dim = unit_dim(df.sparkSession)
    own = dim.select(F.col("unit").alias("own_unit"), "family", "factor")
    default = dim.where("is_default").select(F.col("family").alias("default_family"), F.col("unit").alias("default_unit"))
    met = df.join(F.broadcast(own), F.col(unit) == F.col("own_unit"), "left").join(F.broadcast(default), F.col("family") == F.col("default_family"), "left")
    met = met.withColumns({value: F.when(F.col("factor").isNull(), F.col(value)).otherwise(F.col(value) * F.col("factor")), unit: F.coalesce("default_unit", F.col(unit))})
    return met.drop("own_unit", "family", "factor", "default_family", "default_unit")


def range_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row (rule, n_bad, n_rows) for each rule; a rule holds where its column is true or null."""
    counts = df.agg(F.count("*").alias("n_rows"), *[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    return counts.unpivot("n_rows", list(rules), "rule", "n_bad").select("rule", "n_bad", "n_rows")


def positive(c: Column) -> Column:
    return c > 0


def within(c: Column, low: float, high: float) -> Column:
    return c.between(low, high)
