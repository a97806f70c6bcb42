"""Containers are rebuilt to cells from their bytes alone; what is missing is marked, what is too large is refused."""

from __future__ import annotations

import random
import struct
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from seagrid.operators import containers, quantize, subset
from seagrid.plans import derived
from seagrid.sources.dims import PRESSURE_EDGES, VARIABLES, WAVE_EDGES
from seagrid.streaming.answers import answer_batch
from tests.oracle import SF

RUN = datetime(2014, 1, 2, 6)
HOURS, LATS, LONS, MEMBERS = [0, 6, 24], [10.0, 10.5, 11.0, 11.5], [-1.0, 0.0, 1.0, 2.0, 3.0], 2
CUBE = "model string, run_time timestamp, lead_hours int, realization int, lat_idx int, lon_idx int, latitude double, longitude double, x_wind double, y_wind double, air_temperature double, air_pressure_at_sea_level double, sea_surface_wave_significant_height double, sea_surface_wave_to_direction double"


def _cube(spark, hole=None):
    rng, rows = random.Random(6), []
    for h in HOURS:
        for m in range(MEMBERS):
            for i, y in enumerate(LATS):
                for j, x in enumerate(LONS):
                    wave = None if (i + j) % 3 == 0 else rng.uniform(0.1, 14)
                    values = [rng.uniform(-30, 30), rng.uniform(-30, 30), rng.uniform(-40, 40), rng.uniform(96000, 105000), wave, rng.uniform(0, 360)]
                    if (h, m, i, j) == (6, 1, 2, 2):
                        values[0], values[2] = None, 1e7
                    if (h, m, i, j) != hole:
                        rows.append(("gefs", RUN, h, m, i, j, y, x, *values))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, CUBE)


REQUESTS = "request_id string, kind string, model string, run_time timestamp, s double, n double, w double, e double, lat double, lon double, resolution double, hours array<int>, variables array<string>"


def _packed(spark, cube, rows, **kw):
    requests = subset.snap_bounds(spark.createDataFrame([(i, "spot" if la else "gridded", "gefs", RUN, *box, la, lo, res, hours, names) for i, box, la, lo, res, hours, names in rows], REQUESTS), subset.grid_spec(cube)).drop("error")
    axes = containers.request_axes(requests, containers.forecast_index(cube))
    names = ["x_wind", "y_wind", "air_temperature", "air_pressure_at_sea_level", "sea_surface_wave_significant_height", "sea_surface_wave_to_direction"]
    cells = subset.answer_requests(requests.select(*REQUESTS.replace(" string", "").replace(" double", "").replace(" timestamp", "").replace(" array<int>", "").replace(" array<string>", "").split(", ")), cube, subset.grid_spec(cube), names)
    return containers.containers(cells, axes, **kw)


def _read(raw):
    """A client in plain Python: {variable: (masked, bytes)}."""
    names, at, out = {v[7]: v[0] for v in VARIABLES}, 1, []
    assert raw[0] == containers.VERSION
    while at < len(raw):
        n = int.from_bytes(raw[at + 1 : at + 4])
        out.append((names[raw[at] % 128], raw[at] >= 128, raw[at + 4 : at + 4 + n]))
        at += 4 + n
    return out


BOX = (10.2, 11.4, -0.5, 1.5)
EVERY = ["wind", "temperature", "pressure", "waveheight", "wavedirection", "wave"]


@pytest.mark.parametrize("chunk", [32, 8192])
def test_cells_are_rebuilt_from_the_bytes(spark, chunk):
    cube = _cube(spark)
    none = (None,) * 4
    rows = [("box", BOX, None, None, None, [0, 6, 24, 48], EVERY), ("thin", (10.2, 11.0, -0.5, 1.5), None, None, 1.0, [24], ["pressure", "wind"]), ("spot", none, 10.25, 0.5, None, [6, 24], EVERY), ("more", BOX, None, None, None, [6], ["wave", "current"])]
    packed = _packed(spark, cube, rows, chunk=chunk).cache()
    got = {r["request_id"]: r for r in packed.collect()}
    assert {k: r["error"] for k, r in got.items()} == dict.fromkeys(got)
    entries = _read(bytes(got["box"]["container"]))
    assert [n for n, *_ in entries] == ["time", "realization", "latitude", "longitude", *EVERY]
    by = {n: raw for n, _, raw in entries}
    assert struct.unpack(">II3H", by["time"]) == (datetime.toordinal(RUN), 6 * 3600, 0, 6, 18)
    assert by["realization"] == b"\0\2" and struct.unpack(">4i", by["latitude"]) == (10000, 10500, 11000, 11500) and struct.unpack(">4i", by["longitude"]) == (-1000, 0, 1000, 2000)
    assert [n for n, masked, _ in entries if masked] == ["wind", "temperature", "waveheight", "wave"]
    assert got["box"]["missing"] == ["wind misses 1 values", "temperature misses 1 values", f"waveheight misses {6 * 6} values", f"wave misses {6 * 6} values"]
    assert set(got["box"]["payloads"]) == {"pressure", "wavedirection"} and got["more"]["missing"][-1] == "not in the forecast: current"

    cells = containers.read_cells(packed).collect()
    bins = cube.select("lead_hours", "realization", "latitude", "longitude", quantize.digitize(F.col("air_pressure_at_sea_level"), PRESSURE_EDGES).alias("p"), quantize.digitize(F.col("sea_surface_wave_significant_height"), WAVE_EDGES).alias("h"), F.bround("air_temperature").alias("t"), "x_wind")
    true = {(r["lead_hours"], r["realization"], r["latitude"], r["longitude"]): r for r in bins.collect()}
    seen = 0
    for r in cells:
        if r["request_id"] == "spot":
            assert (r["latitude"], r["longitude"]) == (10.25, 0.5) and r["lead_hours"] in (6, 24)
            continue
        want = true[r["lead_hours"], r["realization"], r["latitude"], r["longitude"]]
        seen += 1
        if r["variable"] == "pressure":
            assert r["bin"] == want["p"]
        if r["variable"] == "waveheight" or r["variable"] == "wave" and r["part"] == 0:
            assert r["bin"] == want["h"]
        if r["variable"] == "temperature":
            assert r["bin"] == (None if want["t"] > 32767 else want["t"])
        if r["variable"] == "wind":
            assert (r["bin"] is None) == (want["x_wind"] is None)
    n_box, n_thin = 3 * 2 * 4 * 4, 1 * 2 * 2 * 4
    assert seen == n_box * (2 + 1 + 1 + 1 + 1 + 2) + n_thin * (1 + 2) + 2 * 4 * 4 * 2
    assert sum(r["request_id"] == "spot" for r in cells) == 2 * 2 * 8
    zipped = packed.select("request_id", containers.deflated("container").alias("container"))
    assert {r["request_id"]: zlib.decompress(r["container"]) for r in zipped.collect()} == {k: bytes(r["container"]) for k, r in got.items()}


def test_what_cannot_be_packed_is_refused(spark):
    cube = _cube(spark, hole=(6, 1, 2, 2))
    rows = [("hole", BOX, None, None, None, [6], ["pressure"]), ("large", BOX, None, None, None, [0, 24], ["temperature"]), ("none", BOX, None, None, None, [12], ["pressure"]), ("absent", BOX, None, None, None, [0], ["current"]), ("fine", BOX, None, None, None, [0], ["pressure"])]
    packed = _packed(spark, cube, rows, limit=100)
    got = {r["request_id"]: (r["error"], r["container"] is None) for r in packed.collect()}
    assert got == {
        "hole": ("the cells do not fill the request's axes", True), "large": ("variable too large", True), "none": ("none of the hours is in the forecast", True),
        "absent": ("none of the variables is in the forecast", True), "fine": (None, False),
    }


def test_no_task_gathers_a_request(spark):
    """Above a piece's size only packed pieces meet: 300,000 cells of one request in pieces of 4,096."""
    cells = spark.range(300_000).select(F.lit("r").alias("request_id"), F.lit(0).alias("lead_hours"), F.lit(0).alias("realization"), (F.col("id") % 600).cast("int").alias("lat_idx"), F.expr("cast(id div 600 as int)").alias("lon_off"), (97000.0 + F.col("id") % 8000).alias("air_pressure_at_sea_level"))
    one = spark.createDataFrame([("r", "gridded", ["pressure"], RUN, [0], 1, [0.0] * 600, [0.0] * 500, 0, 1, 1, 300_000, None)], "request_id string, kind string, variables array<string>, run_time timestamp, at_hours array<int>, n_members int, ys array<double>, xs array<double>, y_first int, y_step int, x_step int, n_cells long, error string")
    got = containers.containers(cells, one, ["pressure"], chunk=4096)
    plan = got._jdf.queryExecution().executedPlan().toString()
    row = got.first()
    assert row["error"] is None and row["total_bytes"] == 150_000 and "Python" not in plan
    bins = [r["b"] for r in cells.orderBy("lon_off", "lat_idx").select(quantize.digitize(F.col("air_pressure_at_sea_level"), PRESSURE_EDGES).alias("b")).collect()]
    assert bytes(row["payloads"]["pressure"]).hex() == "".join(f"{b:x}" for b in bins)


def test_answers_keep_to_delivery_and_to_arrivals(spark):
    forecast = derived.forecast(spark, SF)
    body = "send gefs:10n,40n,20w,40e||0,6,12,18,24|wind,pressure,wave\nsend spot:gefs:10n,20w|0,6|wave\nsend gefs:10n,40n,20w,40e||96|wind"
    at = 1388556000 + 7200
    messages = spark.createDataFrame([(1, body, "a@sailmail.com"), (2, body, "a@iridium.example")], "msg_id int, body string, sender string").withColumn("received_at", F.timestamp_seconds(F.lit(at)))
    runs = forecast.select("model", "run_time").distinct()
    early, late = (runs.withColumn("arrived_at", F.timestamp_seconds(F.lit(t))) for t in (at - 7200, at + 60))
    got = {r["request_id"]: r for r in answer_batch(messages, early, forecast).collect()}
    assert {r["error"] for r in answer_batch(messages, late, forecast).collect()} == {"no run available"}
    assert got["1-0"]["extension"] == "fcst" and got["2-0"]["extension"] == "zip" and got["2-0"]["delivery_error"] is None
    for key in ("1-0", "1-1"):
        names = [n for n, *_ in _read(zlib.decompress(got[key]["container"]))]
        assert names[:4] == ["time", "realization", "latitude", "longitude"] and "wave" in names and got[key]["error"] is None
    assert got["1-2"]["reason"] == "none of the hours is in the forecast" and got["1-2"]["error"] == "nothing of the forecast fits the request" and got["1-2"]["container"] is None
    assert got["1-2"]["warnings"] == ["no forecast for hour 96"]
