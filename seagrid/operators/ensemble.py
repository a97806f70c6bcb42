"""Agreement of ensemble members per time and place, and the extents of maps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seagrid.functions import angles
from seagrid.operators.quantize import digitize


def bin_members(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """df with a column `bin`; a value below the first edge is an error in column `error`."""
    b = digitize(F.col(value), edges)
    return df.withColumn("bin", b).withColumn("error", F.when(b == 0, F.lit("below the first bin")))


def bin_probabilities(df: DataFrame, value: str, edges: list[float], by: list[str]) -> DataFrame:
    """Rows (by..., bin, prob): the share of valid members in each bin, bins without members included.

    Bins are closed on the left, the last also on the right; what is outside counts nowhere. A group
    without valid members has null probabilities.
    """
    n = len(edges) - 1
    v = F.col(value)
    b = F.when(v == edges[-1], n).when((v >= edges[0]) & (v < edges[-1]), digitize(v, edges))
    counted = df.groupBy(*by).agg(*[F.count_if(b == i).alias(str(i)) for i in range(1, n + 1)])
    valid = sum((F.col(str(i)) for i in range(2, n + 1)), F.col("1"))
    long = counted.select(*by, valid.alias("n_valid"), F.explode(F.array(*[F.struct(F.lit(i).alias("bin"), F.col(str(i)).alias("n")) for i in range(1, n + 1)])).alias("x"))
    return long.select(*by, F.col("x.bin").alias("bin"), (F.col("x.n") / F.nullif("n_valid", F.lit(0))).alias("prob"))


def visible_bin_range(df: DataFrame, value: str, edges: list[float], by: list[str]) -> DataFrame:
    """Rows (by..., min_bin, max_bin): a margin of bins around what occurs."""
    got = df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"))
    low = F.greatest(digitize(F.col("lo") - 2, edges), F.lit(0))
    return got.select(*by, low.alias("min_bin"), F.least(digitize(F.col("hi") + 1, edges), F.col("n")).cast("int").alias("max_bin"))


def headroom_bin(df: DataFrame, value: str, edges: list[float], by: list[str]) -> DataFrame:
    got = df.groupBy(*by).agg(F.max(value).alias("hi"))
    return got.select(*by, F.least(digitize(F.col("hi") + 2, edges), F.lit(len(edges))).alias("max_bin"))


def drop_empty_times(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """df without the times at which every cell is missing."""
    full = df.groupBy(*by).agg(F.count(value).alias("n")).where("n > 0").drop("n")
    return df.join(full, by, "left_semi")


def max_over_forecast(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.max(value).alias(f"max_{value}"))


def _west(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by..., west, east): the longitudes on both sides of the largest gap around the circle."""
    group = Window.partitionBy(*by)
    lons = df.select(*by, angles.normalize(F.col("longitude")).alias("lon")).distinct()
    lons = lons.withColumn("before", F.coalesce(F.lag("lon").over(group.orderBy("lon")), F.max("lon").over(group) - 360))
    lons = lons.withColumn("gap", F.col("lon") - F.col("before"))
    best = F.max_by(F.struct("lon", "before"), F.struct("gap", "lon"))
    return lons.groupBy(*by).agg(best.alias("x")).select(*by, F.col("x.lon").alias("west"), angles.normalize(F.col("x.before")).alias("east"))


def bounding_box(df: DataFrame, by: list[str], pad: float = 0.0, pad_degrees: float = 0.0) -> DataFrame:
    """Rows (by..., west, east, south, north), padded by a share of each side and by fixed degrees."""
    lats = df.groupBy(*by).agg(F.min("latitude").alias("lo"), F.max("latitude").alias("hi"))
    met = _west(df, by).join(lats, by)
    dx = F.pmod(F.col("east") - F.col("west"), F.lit(360.0)) * pad + pad_degrees
    dy = (F.col("hi") - F.col("lo")) * pad + pad_degrees
    return met.select(*by, angles.normalize(F.col("west") - dx).alias("west"), angles.normalize(F.col("east") + dx).alias("east"), (F.col("lo") - dy).alias("south"), (F.col("hi") + dy).alias("north"))


def central_point(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by..., lon, lat, error): the medians of the distinct longitudes, counted eastwards from the western one, and latitudes.

    The two central longitudes must be less than 90 degrees apart, else there is an error and no longitude.
    """
    lons = df.select(*by, angles.normalize(F.col("longitude")).alias("lon")).distinct().join(_west(df, by), by)
    off = F.sort_array(F.collect_list(F.pmod(F.col("lon") - F.col("west"), F.lit(360.0)))).alias("offs")  # as many as the grid has columns
    lon = lons.groupBy(*by).agg(off, F.first("west").alias("west"))
    n = F.size("offs")
    low, high = F.get("offs", F.floor((n - 1) / 2).cast("int")), F.get("offs", F.floor(n / 2).cast("int"))
    lat = df.select(*by, "latitude").distinct().groupBy(*by).agg(F.percentile("latitude", 0.5).alias("lat"))
    near = high - low < 90
    middle = F.when(near, angles.normalize(F.col("west") + (low + high) / 2))
    return lon.join(lat, by).select(*by, middle.alias("lon"), "lat", F.when(~near, F.lit("the centre is not defined")).alias("error"))


def box_size(df: DataFrame, by: list[str], pad: float = 0.0) -> DataFrame:
    """Rows (by..., width, height) in metres through the central point."""
    met = bounding_box(df, by).join(central_point(df, by), by)
    half = F.pmod(F.col("east") - F.col("west"), F.lit(360.0)) / 2
    width = 2 * angles.distance(F.lit(0.0), F.col("lat"), half, F.col("lat"))
    height = angles.distance(F.col("lon"), F.col("south"), F.col("lon"), F.col("north"))
    return met.select(*by, (width * (1 + 2 * pad)).alias("width"), (height * (1 + 2 * pad)).alias("height"))


def grid_step(df: DataFrame, by: list[str], axis: str = "latitude") -> DataFrame:
    """Rows (by..., step): the median circular step between neighbouring values."""
    along = Window.partitionBy(*by).orderBy(axis)
    steps = df.select(*by, axis).distinct().withColumn("step", angles.diff_lag(F.col(axis), along))
    return steps.groupBy(*by).agg(F.percentile("step", 0.5).alias("step"))


def member_rank(df: DataFrame, by: list[str], speed: str, angle: str, stored: str = "from") -> DataFrame:
    """df with rank (by speed, 0 the slowest), shown_direction (always `from`) and calm."""
    turn = angles.add(F.col(angle), F.lit(math.pi), degrees=False) if stored == "to" else F.col(angle)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(speed, "realization")) - 1
    return df.withColumns({"rank": rank, "shown_direction": turn, "calm": ~F.coalesce(F.col(speed) > 0, F.lit(False))})


def cell_summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Rows (by..., n, mean, lowest, highest) of the members of each cell."""
    v: Column = F.col(value)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("lowest"), F.max(v).alias("highest"))
