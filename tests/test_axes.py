"""Searches on axes of any spacing against brute force, and runs by their arrival."""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from seagrid.operators import axes, runs, subset

POINTS = "id int, model string, x double, idx int, node string"
AXIS = "model string, idx int, x double"


def _nodes(spark, **models):
    return spark.createDataFrame([(m, i, float(x)) for m, xs in models.items() for i, x in enumerate(xs)], AXIS)


@pytest.mark.parametrize("buckets, salts", [(1, 1), (5, 3), (64, 2)])
def test_nodes_around_a_value(spark, buckets, salts):
    """Of two models, one axis descending, with columns of clashing names, repeated rows, ties, nulls and values past the ends."""
    rng = random.Random(buckets)
    up, down = sorted({rng.randint(-500, 500) / 4 for _ in range(60)}), [80.0, 5.0, 4.5, 4.0, -70.0]
    rows = [(i, rng.choice(["up", "down", "none"]), rng.choice([rng.uniform(-140, 140), rng.choice(up), rng.choice(down), 4.25]), 9, "n") for i in range(400)]
    rows += [(400, "up", None, 9, "n"), (401, "up", float("nan"), 9, "n"), (402, "down", float("inf"), 9, "n"), rows[0], rows[0]]
    got = axes.around(spark.createDataFrame(rows, POINTS), _nodes(spark, up=up, down=down), "x", buckets=buckets, salts=salts)
    got = [r.asDict() for r in got.collect()]
    assert len(got) == len(rows) and sorted(r["id"] for r in got) == sorted(r[0] for r in rows)
    for r in got:
        axis = {"up": up, "down": sorted(down), "none": []}[r["model"]]
        x, place = r["x"], {"up": up, "down": down, "none": []}[r["model"]].index
        fine = x is not None and abs(x) < 1e9
        lo = axis[bisect_right(axis, x) - 1] if fine and bisect_right(axis, x) else None
        hi = axis[bisect_left(axis, x)] if fine and bisect_left(axis, x) < len(axis) else None
        assert (r["lo_idx"], r["hi_idx"]) == tuple(None if v is None else place(v) for v in (lo, hi))
        assert r["lo_gap"] == (None if lo is None else pytest.approx(x - lo)) and r["hi_gap"] == (None if hi is None else pytest.approx(hi - x))


@pytest.mark.parametrize("period", [None, 360.0])
def test_nearest_is_the_least_difference(spark, period):
    rng = random.Random(8)
    values = {"a": [rng.uniform(-180, 180) for _ in range(25)], "one": [12.0], "b": [0.0, 10.0, 30.0, 350.0]}
    rows = [(i, rng.choice(list(values)), rng.choice([rng.uniform(-400, 400), 20.0, 5.0, 0.0, 180.0]), 0, "") for i in range(300)]
    axis = _nodes(spark, **values)
    got = axes.nearest(spark.createDataFrame(rows, POINTS), axis, "x", "found", period).collect()
    for r in got:
        def apart(v, x=r["x"]):
            d = abs(x - v)
            return round(min(d % 360, -d % 360) if period else d, 9)

        nodes = values[r["model"]]
        assert r["found"] == min(range(len(nodes)), key=lambda i: (apart(nodes[i]), i))
    plan = axes.nearest(spark.createDataFrame(rows, POINTS), axis, "x", "found", period)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def _grid(spark, lats, lons):
    rows = [("m", i, j, float(y), float(x), 100.0 * y + x) for i, y in enumerate(lats) for j, x in enumerate(lons)]
    return spark.createDataFrame(rows, "model string, lat_idx int, lon_idx int, latitude double, longitude double, v double").withColumns({"lead_hours": F.lit(0), "realization": F.lit(0)})


BOX = "request_id int, model string, s double, n double, w double, e double, resolution double"


def test_uneven_grids_are_errors_of_the_arithmetic_and_searched_on_axes(spark):
    grid = _grid(spark, [0, 1, 2, 5, 10], [0, 10, 30, 60])
    boxes = spark.createDataFrame([(1, "m", 1.0, 2.0, 10.0, 25.0, None), (2, "m", 1.5, 6.0, 10.0, 31.0, None), (3, "m", -1.0, 2.0, 10.0, 25.0, None), (4, "m", 1.0, 2.0, 50.0, 70.0, None), (5, "x", 1.0, 2.0, 50.0, 70.0, None)], BOX)
    spec = subset.grid_spec(grid)
    assert {r["request_id"]: r["error"] for r in subset.snap_bounds(boxes, spec).collect()} == {1: "uneven grid", 2: "uneven grid", 3: "uneven grid", 4: "uneven grid", 5: "no forecast"}
    got = {r["request_id"]: r for r in axes.snap_bounds_on_axes(boxes, grid).collect()}
    assert [(got[i]["lat_lo"], got[i]["lat_hi"], got[i]["lon_w"], got[i]["lon_span"], got[i]["error"]) for i in (1, 2)] == [(1, 2, 1, 1, None), (1, 4, 1, 2, None)]
    assert [got[i]["error"] for i in (3, 4, 5)] == ["latitude outside the forecast", "longitude outside the forecast", "no forecast"]
    spots = spark.createDataFrame([(1, "m", 1.5, 15.0)], "request_id int, model string, lat double, lon double")
    assert subset.nearest_cell(spots, spec).first()["lat_idx"] is None and not subset.point_in_range(spots, spec).first()["inside"]
    assert subset.gridded_subset(axes.snap_bounds_on_axes(boxes, grid).withColumn("hours", F.array(F.lit(0))), grid).where("request_id = 2").count() == 4 * 3


@pytest.mark.parametrize("lats, lons", [([3, 1, 0, -4], [-180, -90, 0, 80, 120]), ([-4, 0, 1, 3], [0, 80, 120, 180, 270]), ([-2, 0, 2], [350, 355, 0, 5])])
def test_boxes_cover_and_planes_are_interpolated(spark, lats, lons):
    rng = random.Random(4)
    grid, wraps = _grid(spark, lats, lons), len(lons) == 5
    boxes = []
    for i in range(80):
        s, w = rng.uniform(min(lats), max(lats)), rng.uniform(-180, 180) if wraps else rng.uniform(-9.9, 4.9)
        boxes.append((i, "m", s, rng.uniform(s, max(lats)), w, w + (rng.uniform(0, 359) if wraps else rng.uniform(0, 5 - w)), None))
    for r in axes.snap_bounds_on_axes(spark.createDataFrame(boxes, BOX), grid).collect():
        assert r["error"] is None
        ys = [lats[i] for i in range(r["lat_lo"], r["lat_hi"] + 1)]
        assert min(ys) == max(y for y in lats if y <= r["s"]) and max(ys) == min(y for y in lats if y >= r["n"])
        west = lons[r["lon_w"]]
        assert (r["w"] - west) % 360 == pytest.approx(min((r["w"] - x) % 360 for x in lons))
        width = (r["w"] - west) % 360 + r["e"] - r["w"]  # from the western node to the eastern side
        ends = sorted((x - west) % 360 for x in lons)
        assert r["lon_span"] == min(bisect_left(ends, width - 1e-9), len(lons) - 1)
    spots = [(i, "m", rng.uniform(min(lats), max(lats)), rng.uniform(-5, 4.9) if not wraps else rng.uniform(0, 79)) for i in range(40)] + [(99, "m", float(lats[1]), float(lons[1]))]
    table = spark.createDataFrame(spots, "request_id int, model string, lat double, lon double")
    found = {r["request_id"]: r for r in subset.interpolated(axes.bilinear_weights_on_axes(table, grid.withColumn("longitude", F.col("longitude"))), grid.withColumn("v", 100 * F.col("latitude") + F.pmod(F.col("longitude") + 20, F.lit(360.0))), ["model", "lat_idx", "lon_idx"], ["v"]).collect()}
    for i, _, y, x in spots:
        assert found[i]["v"] == pytest.approx(100 * y + (x + 20) % 360)


def test_the_whole_circle(spark):
    grid = _grid(spark, [0, 1], [0, 90, 180, 270])
    boxes = spark.createDataFrame([(1, "m", 0.0, 1.0, -180.0, 180.0, None), (2, "m", 0.0, 1.0, 0.0, 360.0, None), (3, "m", 0.0, 1.0, 90.0, 90.0, None), (4, "m", 0.0, 1.0, 20.0, 10.0, None)], BOX)
    for got in (subset.snap_bounds(boxes, subset.grid_spec(grid)), axes.snap_bounds_on_axes(boxes, grid)):
        assert {r["request_id"]: r["lon_span"] for r in got.collect()} == {1: 3, 2: 3, 3: 0, 4: 3}


def test_a_replay_sees_no_later_run(spark):
    rng, start = random.Random(2), datetime(2014, 3, 1)
    log = []
    for i in range(60):
        run = start + timedelta(hours=rng.choice([6, 6, 6, 5]) * i // 6 * 6)
        log.append((rng.choice(["gefs", "rtofs", "ww3"]), run, rng.choice([run + timedelta(hours=rng.randint(-8, 30)), None])))
    log += [("gefs", start + timedelta(hours=6), start + timedelta(hours=12)), ("gefs", start, start)]
    times = [start + timedelta(minutes=rng.randint(-100, 60 * 24 * 16)) for _ in range(50)] + [start + timedelta(hours=7)]
    made = spark.createDataFrame(log, "model string, run_time timestamp, arrived_at timestamp")
    asked = spark.createDataFrame([(t,) for t in times], "as_of timestamp")
    candidates = {(r["as_of"], r["model"], r["candidate"]) for r in runs.candidate_runs(asked, 4).collect()}
    got = runs.latest_run_arrived(made, asked, 4).collect()
    assert len(got) == 6 * len(set(times))
    for r in got:
        there = [run for m, run, at in log if m == r["model"] and at is not None and at <= r["as_of"] and (r["as_of"], m, run) in candidates]
        assert r["run_time"] == max(there, default=None) and (r["error"] is None) == bool(there)
    at_seven = {r["model"]: r["run_time"] for r in got if r["as_of"] == start + timedelta(hours=7)}
    assert at_seven["gefs"] == start
