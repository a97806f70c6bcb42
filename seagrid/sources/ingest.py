"""From raw forecast tables to the cell table, and from cells to export slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seagrid.functions import angles
from seagrid.functions.units import unit_dim
from seagrid.sources.dims import CF_NAMES, CF_UNITS, export_dim

KEYS = ["model", "run_time", "valid_time", "lead_hours", "realization", "lat_idx", "lon_idx", "latitude", "longitude"]


def scan_forecast(spark: SparkSession, path: str, model: str | None = None, run_time=None, schema: StructType | None = None) -> DataFrame:
    """The cells under a path, lazily; model and run prune partitions."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if model is not None:
        df = df.where(F.col("model") == model)
    return df if run_time is None else df.where(F.col("run_time") == F.lit(run_time))


def rename_to_cf(df: DataFrame) -> DataFrame:
    """Source names become convention names, those that are present."""
    return df.withColumnsRenamed({k: v for k, v in CF_NAMES.items() if k in df.columns})


def attach_units(df: DataFrame) -> DataFrame:
    """The fixed unit of each known variable as column metadata."""
    for name in df.columns:
        if name in CF_UNITS:
            df = df.withMetadata(name, df.schema[name].metadata | {"units": CF_UNITS[name]})
    return df


def missing_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def kelvin_to_celsius(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column) - 273.15)


def zero_base_members(df: DataFrame, label: str = "realization") -> DataFrame:
    """Member labels become 0..k-1 in each run, numbered on the distinct labels only; rows without a label keep null."""
    run = Window.partitionBy("model", "run_time").orderBy(label)
    labels = df.select("model", "run_time", label).where(F.col(label).isNotNull()).distinct().withColumn("__member", (F.dense_rank().over(run) - 1).cast("int"))
    own, other = df.alias("own"), labels.alias("other")
    same = F.col(f"own.{label}") == F.col(f"other.{label}")
    for c in ("model", "run_time"):
        same &= F.col(f"own.{c}").eqNullSafe(F.col(f"other.{c}"))
    return own.join(other, same, "left").select(*[F.col("other.__member").alias(label) if c == label else F.col(f"own.{c}") for c in df.columns])


def add_lead_hours(df: DataFrame) -> DataFrame:
    """Hours since the run's first time; null where they are no whole number. Rows without a run time are a run of their own."""
    first = df.groupBy(F.col("model").alias("__model"), F.col("run_time").alias("__run")).agg(F.min("valid_time").alias("__first"))
    met = df.join(first, F.col("model").eqNullSafe(F.col("__model")) & F.col("run_time").eqNullSafe(F.col("__run")))
    seconds = F.unix_seconds(F.col("valid_time").cast("timestamp")) - F.unix_seconds(F.col("__first").cast("timestamp"))
    return met.withColumn("lead_hours", F.when(seconds % 3600 == 0, (seconds / 3600).cast("int"))).drop("__first", "__model", "__run")


def normalize_longitude(df: DataFrame, column: str = "longitude") -> DataFrame:
    return df.withColumn(column, angles.normalize(F.col(column)))


def keep_recognised(df: DataFrame) -> DataFrame:
    """Keys and known variables only."""
    return df.select(*[c for c in df.columns if c in KEYS or c in CF_UNITS])


def level_counts(df: DataFrame, column: str = "lev") -> DataFrame:
    """Rows (model, run_time, n_levels, squeezable)."""
    return df.groupBy("model", "run_time").agg(F.countDistinct(column).alias("n_levels")).withColumn("squeezable", F.col("n_levels") == 1)


def squeeze_level(df: DataFrame, column: str = "lev") -> DataFrame:
    """df without a level column of one value in each run; a run of several levels fails when its rows are read."""
    many = df.groupBy("model", "run_time").agg(F.min(column).alias("__lo"), F.max(column).alias("__hi")).where("__lo <> __hi")
    told = many.select(F.col("model").alias("__model"), F.col("run_time").alias("__run"), F.raise_error(F.concat(F.lit(f"{column} has several values in a run of "), F.coalesce("model", F.lit("no model")))).alias("__error"))
    met = df.join(F.broadcast(told), F.col("model").eqNullSafe(F.col("__model")) & F.col("run_time").eqNullSafe(F.col("__run")), "left")
    return met.where("__error is null").select(*[c for c in df.columns if c != column])


def concat_along(dfs: list[DataFrame], dim: str | None = None) -> DataFrame:
    """Chunks end to end; with `dim` the i-th chunk becomes value i of that new dimension."""
    out = None
    for i, df in enumerate(dfs):
        df = df if dim is None else df.withColumn(dim, F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def export_slices(df: DataFrame, variables: list[str]) -> DataFrame:
    """One row per cell and variable, derived speed and direction left out; nulls stay."""
    keys = [c for c in KEYS if c in df.columns]
    kept = [v for v in variables if v not in ("wind_speed", "wind_from_direction")]
    return df.select(*keys, *[F.col(v).cast("double").alias(v) for v in kept]).unpivot(keys, kept, "variable", "value")


def crosses_dateline(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by..., jumps): whether neighbouring longitudes jump by more than 180 degrees."""
    along = Window.partitionBy(*by).orderBy("longitude")
    gaps = df.select(*by, "longitude").distinct().withColumn("gap", F.col("longitude") - F.lag("longitude").over(along))
    return gaps.groupBy(*by).agg(F.coalesce(F.max("gap") > 180, F.lit(False)).alias("jumps"))


def dateline_safe_longitude(df: DataFrame, by: list[str]) -> DataFrame:
    """df with longitudes of slices that jump re-expressed on 0..360, and `unsafe` where they still jump."""
    first = crosses_dateline(df, by)
    out = df.join(first, by).withColumn("longitude", F.when(F.col("jumps"), F.pmod("longitude", F.lit(360.0))).otherwise(F.col("longitude"))).drop("jumps")
    still = crosses_dateline(out, by).withColumnRenamed("jumps", "unsafe")
    return out.join(still, by)


def grid_description(df: DataFrame, by: list[str]) -> DataFrame:
    """Per slice: counts of axis values, first and last in millidegrees, steps, and whether both axes are regular."""
    out = None
    for axis, short in (("longitude", "lon"), ("latitude", "lat")):
        along = Window.partitionBy(*by).orderBy(axis)
        steps = df.select(*by, axis).distinct().withColumn("step", F.round(F.col(axis) - F.lag(axis).over(along), 4))
        one = steps.groupBy(*by).agg(
            F.count("*").alias(f"n_{short}"),
            (F.min(axis) * 1000).cast("int").alias(f"first_{short}"),
            (F.max(axis) * 1000).cast("int").alias(f"last_{short}"),
            (F.max("step") * 1000).cast("int").alias(f"step_{short}"),
            (F.countDistinct("step") <= 1).alias(f"regular_{short}"),
        )
        out = one if out is None else out.join(one, by)
    return out


def to_grib_codes(slices: DataFrame) -> DataFrame:
    """Slices with parameter code, name, unit and level, values in the table's unit, and error.

    A row's unit is its column `unit` where slices have one, else the variable's own. Between units of one family values
    go by factor; degrees Celsius and kelvin by offset; other names are taken for the same unit. A lead that is no whole
    number of hours, or a unit of another family, is an error, and the value is null.
    """
    spark = slices.sparkSession
    met = slices.join(F.broadcast(export_dim(spark)), "variable")
    own = F.create_map(*[F.lit(x) for pair in CF_UNITS.items() for x in pair])
    unit = F.try_element_at(own, F.col("variable"))
    met = met.withColumn("unit", F.coalesce("unit", unit) if "unit" in slices.columns else unit)
    dim = unit_dim(spark)
    for name in ("unit", "code_unit"):
        side = dim.select(F.col("unit").alias(name), F.col("family").alias(f"{name}_family"), F.col("factor").alias(f"{name}_factor"))
        met = met.join(F.broadcast(side), name, "left")
    kelvin = (F.col("unit") == "degC") & (F.col("code_unit") == "K")
    foreign = F.coalesce(F.col("unit_family") != F.col("code_unit_family"), F.lit(False))
    error = F.when(foreign, F.lit("unit of another family"))
    if "lead_hours" in slices.columns:
        lead = F.col("lead_hours").cast("double")
        error = F.when(lead.isNull() | (lead != F.floor(lead)), F.lit("lead is no whole hour")).otherwise(error)
    factor = F.coalesce(F.col("unit_factor") / F.col("code_unit_factor"), F.lit(1.0))
    value = F.when(kelvin, F.col("value") + 273.15).otherwise(F.col("value") * factor)
    met = met.withColumn("error", error).withColumn("value", F.when(F.col("error").isNull(), value))
    return met.drop("unit_family", "unit_factor", "code_unit_family", "code_unit_factor")


def write_payloads(df: DataFrame, path: str) -> None:
    df.write.partitionBy("model").parquet(path)


def write_slices(slices: DataFrame, path: str) -> None:
    slices.repartition("variable", "lead_hours").write.partitionBy("variable", "lead_hours").parquet(path)
