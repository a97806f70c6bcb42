"""Angle, vector and geodesic columns. Angles are half-open: 180 degrees is -180, pi is -pi."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Radius in metres of the sphere that distances are on.
EARTH = 6_370_997.0


def normalize(a: Column, degrees: bool = True) -> Column:
    half = 180.0 if degrees else math.pi
    return F.pmod(a + half, F.lit(2 * half)) - half


def diff(a: Column, b: Column, degrees: bool = True) -> Column:
    return normalize(a - b, degrees)


def add(a: Column, b: Column, degrees: bool = True) -> Column:
    return normalize(a + b, degrees)


def diff_lag(a: Column, along: WindowSpec, degrees: bool = True) -> Column:
    """Circular difference from the row before; null on the first row."""
    return diff(a, F.lag(a).over(along), degrees)


def sorted_circular(values: Column) -> Column:
    """An array of degrees in ascending order around the circle; meant for spans below 180 degrees."""
    return F.array_sort(values, lambda a, b: F.signum(diff(a, b)).cast("int"))


def distance(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """Metres along the great circle."""
    p0, p1 = F.radians(lat0), F.radians(lat1)
    h = F.pow(F.sin((p1 - p0) / 2), 2) + F.cos(p0) * F.cos(p1) * F.pow(F.sin(F.radians(lon1 - lon0) / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def magnitude(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def direction(u: Column, v: Column, orientation: str = "from") -> Column:
    """Radians from north of a vector's direction, or of where it comes from, in [-pi, pi)."""
    to = F.atan2(u + 0.0, v + 0.0)
    return normalize(to + (math.pi if orientation == "from" else 0.0), degrees=False)


def components(speed: Column, angle: Column, orientation: str = "from") -> tuple[Column, Column]:
    sign = -1.0 if orientation == "from" else 1.0
    return sign * speed * F.sin(angle), sign * speed * F.cos(angle)


def velocity_columns(df: DataFrame, u: str, v: str, speed: str, angle: str, orientation: str = "from") -> DataFrame:
    """df with components, speed and direction, whichever pair was missing derived from the other."""
    have = set(df.columns)
    if {u, v} <= have:
        return df.withColumns({speed: magnitude(F.col(u), F.col(v)), angle: direction(F.col(u), F.col(v), orientation)})
    if {speed, angle} <= have:
        x, y = components(F.col(speed), F.col(angle), orientation)
        return df.withColumns({u: x, v: y})
    raise ValueError(f"neither {u}, {v} nor {speed}, {angle} are there")


def disagreeing(df: DataFrame, u: str, v: str, speed: str, tolerance: float = 1.5e-4) -> DataFrame:
    """Rows whose stored speed is not that of their components; missing values agree with anything."""
    return df.where(F.abs(F.col(speed) - magnitude(F.col(u), F.col(v))) > tolerance)
