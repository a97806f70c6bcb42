from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from seagrid.functions import angles, units
from seagrid.operators import quantize
from seagrid.sources import dims

PI = math.pi
DIFFS = [
    (180, 180, 0), (181, 181, 0), (-1, -1, 0), (180, -180, 0), (180, 0, -180), (0, 180, -180), (360, 180, -180), (361, 181, -180), (179, 0, 179),
    (0, 179, -179), (360, 181, 179), (1, 182, 179), (181, 179, 2), (179, 181, -2), (361, 359, 2), (-1, 1, -2),
]


def test_angle_differences(spark):
    df = spark.createDataFrame([(float(a), float(b), float(x)) for a, b, x in DIFFS], "a double, b double, x double")
    for a, b, x, got in df.select("a", "b", "x", angles.diff(F.col("a"), F.col("b"))).collect():
        assert got == pytest.approx(x, abs=1e-9), (a, b)
    got = spark.range(1).select(angles.diff(F.lit(PI - 0.1), F.lit(0.0), False), angles.diff(F.lit(PI - 0.1), F.lit(-PI + 0.1), False)).first()
    assert got[0] == pytest.approx(PI - 0.1) and got[1] == pytest.approx(-0.2)


def test_distances(spark):
    rows = [(0.0, 0.0, 1.0, 0.0, 111194.87), (0.0, 0.5, 0.0, -0.5, 111194.87), (0.0, 0.5, 0.0, 0.5, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, x double")
    for x, got in df.select("x", angles.distance(*map(F.col, "abcd"))).collect():
        assert got == pytest.approx(x, abs=0.05)


def test_vectors_both_ways(spark):
    rows = [(0.0, 1.0, 1.0, 0.0), (1.0, 0.0, 1.0, PI / 2), (-1.0, 0.0, 1.0, -PI / 2), (0.0, -1.0, 1.0, PI), (3.0, 4.0, 5.0, math.acos(0.8)), (0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "u double, v double, m double, d double")
    for way in ("to", "from"):
        turned = F.col("d") if way == "to" else angles.add(F.col("d"), F.lit(PI), False)
        u, v = angles.components(F.col("m"), turned, way)
        got = df.select("*", angles.magnitude(F.col("u"), F.col("v")).alias("gm"), angles.direction(F.col("u"), F.col("v"), way).alias("gd"), u.alias("gu"), v.alias("gv"), turned.alias("t"))
        for r in got.collect():
            assert r.gm == pytest.approx(r.m, abs=1e-9) and r.gu == pytest.approx(r.u, abs=1e-9) and r.gv == pytest.approx(r.v, abs=1e-9)
            assert abs((r.gd - r.t + PI) % (2 * PI) - PI) < 1e-9 and -PI <= r.gd < PI


def test_circular_sort_over_the_seam(spark):
    df = spark.createDataFrame([([-170.0, 170.0], [170.0, -170.0]), ([20.0, -10.0], [-10.0, 20.0]), ([350.0, 5.0], [350.0, 5.0])], "a array<double>, x array<double>")
    for x, got in df.select("x", angles.sorted_circular(F.col("a"))).collect():
        assert got == x


def test_velocity_columns_need_one_pair(spark):
    df = spark.createDataFrame([(3.0, 4.0)], "u double, v double")
    assert angles.velocity_columns(df, "u", "v", "s", "d").first()["s"] == 5.0
    with pytest.raises(ValueError):
        angles.velocity_columns(df.drop("v"), "u", "v", "s", "d")
    off = df.withColumn("s", F.lit(5.1))
    assert angles.disagreeing(off, "u", "v", "s").count() == 1


def test_unit_errors():
    assert units.factor("knots", "m/s") == pytest.approx(1 / 1.94384449)
    assert units.factor("hPa", "Pa") == 100 and units.factor("bar", "hPa") == 1000
    with pytest.raises(ValueError):
        units.factor("furlong", "m")
    with pytest.raises(ValueError):
        units.factor("m", "Pa")


@pytest.mark.parametrize("bits", [1, 2, 4])
@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 15, 16])
def test_pack_and_unpack(spark, bits, n):
    values = [(7 * i + 3) % (1 << bits) for i in range(n)]
    df = spark.createDataFrame([(0, i, b) for i, b in enumerate(values)], "k int, i int, bin int")
    packed = quantize.pack_bins(df, ["k"], ["i"], bits=bits)
    row = packed.first()
    assert row["n"] == n and len(row["packed"]) == -(-n * bits // 8)
    back = quantize.unpack_bins(packed, ["k"], bits=bits).orderBy("nth").collect()
    assert [r["bin"] for r in back] == values


def test_packed_bytes(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 1, 15), ("a", 2, 7), ("b", 0, 1), ("b", 1, 15), ("b", 2, 7), ("b", 3, 2), ("c", 0, 16)], "k string, i int, bin int")
    got = {r["k"]: r["packed"] and bytes(r["packed"]).hex() for r in quantize.pack_bins(df, ["k"], ["i"]).collect()}
    assert got == {"a": "1f07", "b": "1f72", "c": None}


def test_bins_and_midpoints(spark):
    edges = [0.0, 1.0, 3.0, 6.0]
    df = spark.createDataFrame([(-1.0, 0), (0.0, 1), (0.5, 1), (1.0, 2), (5.9, 3), (6.0, 4), (70.0, 4), (None, None)], "x double, b int")
    got = df.select("b", quantize.digitize(F.col("x"), edges), quantize.digitize_circular(F.col("x"), edges), quantize.digitize_by(F.col("x"), F.array(*[F.lit(e) for e in edges]))).collect()
    assert [r[0] for r in got] == [r[1] for r in got]
    assert [r[2] for r in got if r[0] is not None] == [r[0] % 4 for r in got if r[0] is not None]
    assert quantize.midpoints(edges) == [-0.5, 0.5, 2.0, 4.5, 6.5]
    with pytest.raises(ValueError):
        quantize.digitize(F.col("x"), [1.0, 1.0])


def test_second_pass_changes_nothing(spark):
    df = spark.range(2000).select((F.rand(1) * 80 - 40).alias("u"), (F.rand(2) * 80 - 40).alias("v"))
    one = quantize.decode_velocity(quantize.quantize_velocity(df, "u", "v", "w", dims.WIND_EDGES), "w", dims.WIND_EDGES)
    two = quantize.quantize_velocity(one.select("w_u", "w_v", F.col("w_speed_bin").alias("sb"), F.col("w_direction_bin").alias("db")), "w_u", "w_v", "w", dims.WIND_EDGES)
    assert two.where("sb <> w_speed_bin OR db <> w_direction_bin").count() == 0


def test_masked_current_keeps_missing(spark):
    df = spark.createDataFrame([(None, None), (0.0, 0.0), (9.0, 0.0)], "u double, v double")
    got = quantize.decode_masked_velocity(quantize.quantize_masked_velocity(df, "u", "v", "c"), "c").collect()
    assert got[0]["c_speed"] is None and got[0]["c_u"] is None
    assert got[1]["c_speed"] is not None and got[2]["c_speed_bin"] == 15 and got[2]["c_clamped"]
