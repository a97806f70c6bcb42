"""Axes of any spacing: the nodes around a value, the nearest node, covering ranges and interpolation weights.

Index arithmetic needs even axes. Here the values and the nodes of an axis are merged in one sort, and each
value takes the last node from either side, as an as-of join does. A model's axis is cut into buckets of equal
width, into which the nearest nodes outside are carried, and values are salted, so that neither a model nor a part of
the axis with most of the values is one task's work. Nodes are few: each goes to every salt of its bucket.

A null or non-finite value, or one of a model without an axis, has no nodes around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seagrid.operators.subset import stride

BUCKETS = 16
SALTS = 8
_ALIKE = 9  # gaps that agree to so many digits are ties


def axis_values(forecast: DataFrame, value: str, idx: str) -> DataFrame:
    """Rows (model, idx, x): the nodes of an axis."""
    return forecast.select("model", F.col(idx).cast("int").alias("idx"), F.col(value).cast("double").alias("x")).distinct()


def axis_ends(axis: DataFrame, period: float | None = None) -> DataFrame:
    """One row per model: n, mean_step, and wraps: whether the step from the last node on to the first is no longer than the longest other."""
    step = F.col("x") - F.lag("x").over(Window.partitionBy("model").orderBy("idx"))
    steps = axis.where("x is not null").withColumn("step", F.pmod(step, F.lit(period)) if period else F.abs(step))
    got = steps.groupBy("model").agg(F.min_by("x", "idx").alias("first"), F.max_by("x", "idx").alias("last"), F.count("*").cast("int").alias("n"), F.max("step").alias("longest"), F.avg("step").alias("mean"))
    closing = F.pmod(F.col("first") - F.col("last"), F.lit(period)) if period else F.lit(None).cast("double")
    wraps = F.coalesce((F.col("n") > 1) & (closing <= F.col("longest") + 1e-3), F.lit(False))
    return got.select("model", "n", F.coalesce("mean", F.lit(0.0)).alias("mean_step"), wraps.alias("wraps"))


def _turned(axis: DataFrame, period: float | None) -> DataFrame:
    """Values in one turn; of nodes that coincide the first stays."""
    x = F.pmod("x", F.lit(period)) if period else F.col("x")
    return axis.where("x is not null").groupBy("model", x.alias("x")).agg(F.min("idx").alias("idx"))


def around(points: DataFrame, axis: DataFrame, at: str, period: float | None = None, buckets: int = BUCKETS, salts: int = SALTS) -> DataFrame:
    """points (with model and `at`) with lo_idx, lo_gap, hi_idx, hi_gap: the nodes at or below and at or above, and how far they are.

    With a period the axis is a circle. Beyond an end of any other axis there is no node on that side.
    """
    nodes = _turned(axis, period)
    ends = F.broadcast(nodes.groupBy("model").agg(F.min("x").alias("first"), F.max("x").alias("last")))  # one row a model
    width = (F.col("last") - F.col("first")) / buckets

    def bucket(x: Column) -> Column:
        return F.when(width > 0, F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor((x - F.col("first")) / width)))).otherwise(0).cast("int")

    node = F.struct("x", "idx")
    dealt = nodes.join(ends, "model").select("model", bucket(F.col("x")).alias("bucket"), node.alias("node"))
    own = dealt.groupBy("model", "bucket").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    every = nodes.select("model").distinct().select("model", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket")).join(own, ["model", "bucket"], "left")
    along, back, whole = Window.partitionBy("model").orderBy("bucket"), Window.partitionBy("model").orderBy(F.desc("bucket")), Window.partitionBy("model")
    before = F.max("most").over(along.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min("least").over(back.rowsBetween(Window.unboundedPreceding, -1))
    if period:
        shifted = lambda n, by: F.struct((n["x"] + by).alias("x"), n["idx"].alias("idx"))
        before = F.coalesce(before, shifted(F.max("most").over(whole), -period))
        after = F.coalesce(after, shifted(F.min("least").over(whole), period))
    carried = every.select("model", "bucket", before.alias("before"), after.alias("after")).select("model", "bucket", F.explode(F.array("before", "after")).alias("node")).where("node is not null")
    salted = dealt.unionByName(carried).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    value = F.col(at).cast("double")
    value = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.pmod(value, F.lit(period)) if period else value)
    row = F.struct(*points.columns)
    placed = points.select("model", row.alias("row"), value.alias("x"), F.pmod(F.xxhash64(*points.columns), F.lit(salts)).cast("int").alias("salt"))
    placed = placed.join(ends, "model", "left").select("model", F.coalesce(bucket(F.col("x")), F.lit(0)).alias("bucket"), "salt", "x", "row")
    none = F.lit(None)
    merged = salted.select("model", "bucket", "salt", F.col("node.x").alias("x"), none.cast(placed.schema["row"].dataType).alias("row"), "node").unionByName(
        placed.withColumn("node", none.cast("struct<x: double, idx: int>"))
    )
    of = Window.partitionBy("model", "bucket", "salt")
    is_row = F.col("row").isNotNull()
    up, down = (of.orderBy(c, is_row).rowsBetween(Window.unboundedPreceding, Window.currentRow) for c in (F.asc("x"), F.desc("x")))
    met = merged.withColumns({"lo": F.last("node", True).over(up), "hi": F.last("node", True).over(down)}).where(is_row)
    there = F.col("x").isNotNull()
    found = {"lo_idx": F.col("lo.idx"), "lo_gap": F.col("x") - F.col("lo.x"), "hi_idx": F.col("hi.idx"), "hi_gap": F.col("hi.x") - F.col("x")}
    return met.select("row.*", *[F.when(there, c).alias(k) for k, c in found.items()])


def nearest(points: DataFrame, axis: DataFrame, at: str, name: str, period: float | None = None, **kw) -> DataFrame:
    """points with the index of the nearest node in `name`; of two as near, the lower index."""
    met = around(points, axis, at, period, **kw)
    lo, hi = F.round("lo_gap", _ALIKE), F.round("hi_gap", _ALIKE)
    idx = F.when(F.col("hi_idx").isNull() | (lo < hi), F.col("lo_idx")).when(F.col("lo_idx").isNull() | (hi < lo), F.col("hi_idx")).otherwise(F.least("lo_idx", "hi_idx"))
    return met.select(*points.columns, idx.alias(name))


def nearest_node(points: DataFrame, forecast: DataFrame) -> DataFrame:
    """Points (model, lat, lon, ...) with lat_idx and lon_idx of the nearest node of any grid."""
    met = nearest(points, axis_values(forecast, "latitude", "lat_idx"), "lat", "lat_idx")
    return nearest(met, axis_values(forecast, "longitude", "lon_idx"), "lon", "lon_idx", 360.0)


def _past(n: Column) -> Column:
    """Whether a longitude lies past the last node and before the first, eastwards."""
    return (F.col("lo_idx") == n - 1) & (F.col("hi_idx") == 0) & (F.col("lo_gap") > 0)


def snap_bounds_on_axes(requests: DataFrame, forecast: DataFrame) -> DataFrame:
    """`subset.snap_bounds` for axes of any spacing, by search: the same columns and errors.

    Longitude indices count eastwards. A stride is counted in nodes by the mean step. A box whose sides are a whole turn apart
    takes the whole circle.
    """
    lats, lons = axis_values(forecast, "latitude", "lat_idx"), axis_values(forecast, "longitude", "lon_idx")
    ends = axis_ends(lats).select("model", F.col("n").alias("n_lat"), F.col("mean_step").alias("__dlat"))
    ends = ends.join(axis_ends(lons, 360.0).select("model", F.col("n").alias("n_lon"), F.col("mean_step").alias("__dlon"), F.col("wraps").alias("lon_wraps")), "model")
    met = requests.join(F.broadcast(ends), "model", "left")  # one row a model
    for at, axis, side, period in (("s", lats, "lo", None), ("n", lats, "hi", None), ("w", lons, "lo", 360.0), ("e", lons, "hi", 360.0)):
        kept = met.columns
        out = _past(F.col("n_lon")) if period else F.lit(False)
        met = around(met, axis, at, period).select(*kept, F.col(f"{side}_idx").alias(f"__{at}"), F.coalesce(out, F.lit(False)).alias(f"__{at}_out"))
    box = F.pmod(F.col("e") - F.col("w"), F.lit(360.0))
    steps = F.expr("pmod(__e - __w, n_lon)")
    # Sides a turn apart, or both between the same two nodes with the long way between them: the whole circle.
    whole = ((box == 0) & (F.col("e") != F.col("w"))) | ((box > 180) & (steps <= 1))
    met = met.withColumns(
        {
            "lat_stride": stride(F.col("resolution"), F.col("__dlat")),
            "lon_stride": stride(F.col("resolution"), F.col("__dlon")),
            "lat_lo": F.least("__s", "__n"),
            "lat_hi": F.greatest("__s", "__n"),
            "lon_w": F.col("__w"),
            "lon_span": F.when(whole, F.col("n_lon") - 1).otherwise(steps),
        }
    )
    met = met.withColumns({"lat_hi": F.expr("lat_lo + lat_stride * cast(ceil((lat_hi - lat_lo) / lat_stride) as int)"), "lon_span": F.expr("lon_stride * cast(ceil(lon_span / lon_stride) as int)")})
    inside = F.col("lon_wraps") | ~(F.col("__w_out") | F.col("__e_out")) & (F.col("lon_w") + F.col("lon_span") < F.col("n_lon"))
    reached = F.col("__s").isNotNull() & F.col("__n").isNotNull() & (F.col("lat_hi") < F.col("n_lat"))
    error = F.when(F.col("n_lat").isNull(), "no forecast").when(~reached, "latitude outside the forecast").when(~F.coalesce(inside, F.lit(False)), "longitude outside the forecast")
    met = met.withColumn("lon_span", F.when(F.col("lon_wraps"), F.least("lon_span", F.col("n_lon") - 1)).otherwise(F.col("lon_span")))
    return met.withColumn("error", error).drop(*[c for c in met.columns if c.startswith("__")])


def bilinear_weights_on_axes(requests: DataFrame, forecast: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """`subset.bilinear_weights` for axes of any spacing, by search; spots outside the forecast have no rows."""
    lons = axis_values(forecast, "longitude", "lon_idx")
    part = F.when(F.col("lo_gap") + F.col("hi_gap") > 0, F.col("lo_gap") / (F.col("lo_gap") + F.col("hi_gap"))).otherwise(0.0)
    pair = F.array(F.struct(F.col("lo_idx").alias("idx"), (1 - part).alias("wt")), F.struct(F.col("hi_idx").alias("idx"), part.alias("wt")))
    sides = F.filter(pair, lambda p: p["wt"] > 0)

    spots = requests.select("request_id", "model", "lat", "lon", *carry)
    keep = ["request_id", "model", "lon", *carry]
    met = around(spots, axis_values(forecast, "latitude", "lat_idx"), "lat").where("lo_idx is not null and hi_idx is not null").select(*keep, sides.alias("ys"))
    met = around(met, lons, "lon", 360.0).join(F.broadcast(axis_ends(lons, 360.0)), "model").where(F.col("lo_idx").isNotNull() & (F.col("wraps") | ~_past(F.col("n"))))
    rows = met.withColumn("xs", sides).select("request_id", "model", *carry, F.explode("ys").alias("a"), "xs").select("request_id", "model", *carry, "a", F.explode("xs").alias("b"))
    return rows.select("request_id", "model", F.col("a.idx").alias("lat_idx"), F.col("b.idx").alias("lon_idx"), (F.col("a.wt") * F.col("b.wt")).alias("weight"), *carry)
