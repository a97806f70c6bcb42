from __future__ import annotations

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from seagrid.operators import ensemble, runs, subset
from seagrid.operators.payloads import payloads, sent
from seagrid.plans import derived, queries
from seagrid.sources import ingest
from seagrid.streaming.answers import answer_batch, answer_stream
from tests.oracle import SF


def _axis(spark, first, step, n, lat0=-90.0, dlat=0.5, n_lat=361):
    rows = [("m", lat0, dlat, n_lat, first, step, n, abs(abs(step) * n - 360) < 1e-6)]
    return spark.createDataFrame(rows, "model string, lat0 double, dlat double, n_lat int, lon0 double, dlon double, n_lon int, lon_wraps boolean")


@pytest.mark.parametrize("first", [0.0, -180.0])
@pytest.mark.parametrize("dlat", [0.5, -0.5])
def test_boxes_cover_as_little_as_they_can(spark, first, dlat):
    rng = random.Random(3)
    boxes = []
    for i in range(200):
        s, w, width = rng.uniform(-89, 80), rng.uniform(-180, 180), rng.uniform(0.1, 170)
        e = (w + width + 180) % 360 - 180
        boxes.append((i, "m", s, s + rng.uniform(0, 9), w, e, None))
    df = spark.createDataFrame(boxes, "request_id int, model string, s double, n double, w double, e double, resolution double")
    lats = [(-90.0 if dlat > 0 else 90.0) + dlat * i for i in range(361)]
    lons = [first + 0.5 * i for i in range(720)]
    for r in subset.snap_bounds(df, _axis(spark, first, 0.5, 720, lats[0], dlat)).collect():
        assert r["error"] is None
        got = [lats[i] for i in range(r["lat_lo"], r["lat_hi"] + 1)]
        assert min(got) <= r["s"] < min(got) + 0.5 and max(got) - 0.5 < r["n"] <= max(got)
        offs = [(lons[(r["lon_w"] + o) % 720] - r["w"] + 180) % 360 - 180 for o in (0, r["lon_span"])]
        assert -0.5 < offs[0] <= 1e-9
        assert -1e-9 <= (lons[(r["lon_w"] + r["lon_span"]) % 720] - r["e"] + 180) % 360 - 180 < 0.5


def test_thinning_still_covers(spark):
    df = spark.createDataFrame([(1, "m", 10.0, 21.3, 170.0, -170.0, 2.0)], "request_id int, model string, s double, n double, w double, e double, resolution double")
    r = subset.snap_bounds(df, _axis(spark, 0.0, 0.5, 720)).first()
    assert r["lat_stride"] == 4 and (r["lat_hi"] - r["lat_lo"]) % 4 == 0 and -90 + 0.5 * r["lat_hi"] >= 21.3
    assert r["lon_span"] % 4 == 0 and r["lon_span"] * 0.5 >= 20


def test_box_past_the_edge_is_an_error(spark):
    df = spark.createDataFrame([(1, "m", 80.0, 95.0, 0.0, 1.0, None), (2, "x", 0.0, 1.0, 0.0, 1.0, None)], "request_id int, model string, s double, n double, w double, e double, resolution double")
    got = {r["request_id"]: r["error"] for r in subset.snap_bounds(df, _axis(spark, 0.0, 0.5, 720)).collect()}
    assert got == {1: "latitude outside the forecast", 2: "no forecast"}


def test_irregular_axis_is_seen(spark):
    rows = [("m", i, 0, float(i), 0.0) for i in range(5)] + [("m", 5, 0, 7.3, 0.0)] + [("m", 0, j, 0.0, 0.5 * j) for j in range(1, 4)]
    spec = subset.grid_spec(spark.createDataFrame(rows, "model string, lat_idx int, lon_idx int, latitude double, longitude double")).first()
    assert not spec["uniform_lat"] and spec["uniform_lon"] and not spec["lon_wraps"]


def test_interpolation_is_the_mean_at_centres_and_exact_on_nodes(spark):
    cells = [("m", 0, 0, i, j, float(10 * i + j), None if (i, j) == (1, 1) else 1.0) for i in range(3) for j in range(4)]
    df = spark.createDataFrame(cells, "model string, lead_hours int, realization int, lat_idx int, lon_idx int, x double, y double")
    spec = spark.createDataFrame([("m", 0.0, 1.0, 3, 0.0, 90.0, 4, True)], "model string, lat0 double, dlat double, n_lat int, lon0 double, dlon double, n_lon int, lon_wraps boolean")
    spots = spark.createDataFrame([(1, "m", 0.5, 45.0), (2, "m", 2.0, 90.0), (3, "m", 0.0, -45.0), (4, "m", 2.5, 0.0), (5, "m", 0.0, 90.0)], "request_id int, model string, lat double, lon double")
    got = {r["request_id"]: r for r in subset.spot_interpolate(spots, df, spec, ["x", "y"]).collect()}
    assert got[1]["x"] == pytest.approx(5.5) and got[1]["y"] is None
    assert got[2]["x"] == pytest.approx(21.0) and got[3]["x"] == pytest.approx(1.5)
    assert 4 not in got and got[5]["y"] == pytest.approx(1.0)
    around = subset.spot_interpolate(spots, df.withColumn("x", F.when(F.col("lon_idx") == 0, 350.0).otherwise(10.0)), spec, ["x"], circular=("x",))
    assert {r["request_id"]: r["x"] for r in around.collect()}[1] == pytest.approx(0.0, abs=1e-9)


def test_one_box_is_pushed_to_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    at = tempfile.mkdtemp(prefix="spark-")
    derived.forecast(spark, SF).write.parquet(f"{at}/cube")
    cube = spark.read.parquet(f"{at}/cube")
    for w, span in ((3, 5), (17, 6)):
        got = cube.where(subset.box_predicate(2, 8, w, span, 20, 2, 2))
        inside = {(w + o) % 20 for o in range(0, span + 1, 2)}
        assert got.count() == cube.where(F.col("lat_idx").isin(2, 4, 6, 8) & F.col("lon_idx").isin(*inside)).count() > 0
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(lat_idx,2)" in plan and f"GreaterThanOrEqual(lon_idx,{w})" in plan


def test_tiles_meet_the_same_cells(spark):
    forecast, wanted = queries._snapped(spark, SF)
    wanted = wanted.where("request_id % 7 = 1").cache()
    a = subset.gridded_subset(wanted, forecast, few=10_000)
    for tile in (1, 2, 8):
        b = subset.gridded_subset_tiled(wanted, forecast, tile)
        assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0
    plans = [subset.gridded_subset(wanted, forecast, few=n)._jdf.queryExecution().executedPlan().toString() for n in (10, 10_000)]
    assert "lat_tile" in plans[0] and "lat_tile" not in plans[1]


@pytest.mark.parametrize("tile, detail", [(1, 4), (2, 8), (1, 32)])
def test_tiles_of_several_sizes_cover_boxes_once(spark, tile, detail):
    rng, n_lat, n_lon = random.Random(detail), 90, 170
    rows = []
    for i in range(60):
        lo, span = rng.choice([0, rng.randint(0, n_lat - 1)]), rng.choice([0, n_lon - 1, rng.randint(0, n_lon - 1)])
        rows.append((i, lo, rng.choice([lo, n_lat - 1, rng.randint(lo, n_lat + 3)]), rng.randint(0, n_lon - 1), span, n_lat, n_lon, None))
    df = spark.createDataFrame(rows, "request_id int, lat_lo int, lat_hi int, lon_w int, lon_span int, n_lat int, n_lon int, error string")
    met: dict = {i: [] for i in range(60)}
    for r in subset.cover(df, tile, detail).collect():
        size = tile * subset.RATIO ** r["level"]
        for y in range(r["r0"], r["r1"] + 1):
            for x in range(r["c0"], r["c1"] + 1):
                met[r["request_id"]] += [(a, b) for a in range(y * size, min(y * size + size, n_lat)) for b in range(x * size, min(x * size + size, n_lon)) if r["side_w"] <= b <= r["side_e"]]
    for i, lo, hi, w, span, *_ in rows:
        want = {(a, b % n_lon) for a in range(lo, min(hi, n_lat - 1) + 1) for b in range(w, w + span + 1)}
        assert len(met[i]) == len(set(met[i])) and want <= set(met[i])
        if max(min(hi, n_lat - 1) - lo, span) < tile * detail and tile == 1:
            assert want == set(met[i])  # down to single nodes nothing else is met


def test_large_boxes_make_few_tiles(spark):
    rows = [(1, 0, 720, 100, 1439, 721, 1440, None), (2, 3, 717, 1001, 1001, 721, 1440, None), (3, 10, 20, 5, 10, 721, 1440, None)]
    df = spark.createDataFrame(rows, "request_id int, lat_lo int, lat_hi int, lon_w int, lon_span int, n_lat int, n_lon int, error string")
    n = {r["request_id"]: r["n"] for r in subset.cover(df).groupBy("request_id").agg(F.sum((F.col("r1") - F.col("r0") + 1) * (F.col("c1") - F.col("c0") + 1)).alias("n")).collect()}
    assert n[1] < 200 and n[2] < 500 and n[3] < 11 * 11


def test_plans_have_no_python_and_no_nested_loops(spark):
    at = tempfile.mkdtemp(prefix="spark-")
    for name, df in zip(("cube", "requests"), (derived.forecast(spark, SF), derived.requests(spark, SF)), strict=True):
        df.write.parquet(f"{at}/{name}")
    forecast = spark.read.parquet(f"{at}/cube")
    wanted = subset.snap_bounds(spark.read.parquet(f"{at}/requests"), subset.grid_spec(forecast))
    plan = subset.gridded_subset_tiled(wanted, forecast)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_boxes_around_the_seam(spark):
    rows = [("a", x, 0.0) for x in (170.0, 175.0, 180.0, -175.0, -170.0)] + [("b", float(x), float(y)) for x in range(115, 146) for y in (-8, 8)] + [("c", x, 0.0) for x in (350.0, 355.0, 0.0, 5.0)]
    df = spark.createDataFrame(rows, "k string, longitude double, latitude double")
    got = {r["k"]: r for r in ensemble.bounding_box(df, ["k"]).collect()}
    assert (got["a"]["west"], got["a"]["east"]) == (170.0, -170.0)
    assert (got["b"]["west"], got["b"]["east"], got["b"]["south"], got["b"]["north"]) == (115.0, 145.0, -8.0, 8.0)
    assert (got["c"]["west"], got["c"]["east"]) == (-10.0, 5.0)
    mid = {r["k"]: (r["lon"], r["lat"]) for r in ensemble.central_point(df, ["k"]).collect()}
    assert mid["a"] == (-180.0, 0.0) and mid["b"] == (130.0, 0.0)


def test_probabilities_close_the_last_bin(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 6.0), ("a", 7.0), ("a", -1.0), ("b", None)], "k string, x double")
    got = {(r["k"], r["bin"]): r["prob"] for r in ensemble.bin_probabilities(df, "x", [0.0, 1.0, 3.0, 6.0], ["k"]).collect()}
    assert [got["a", i] for i in (1, 2, 3)] == pytest.approx([1 / 3, 1 / 3, 1 / 3])
    assert [got["b", i] for i in (1, 2, 3)] == [None, None, None]


def test_candidates_step_back_within_the_day(spark):
    df = spark.sql("SELECT TIMESTAMP '2014-03-02 11:30:00' AS as_of")
    got = {}
    for r in runs.candidate_runs(df, 3).collect():
        got.setdefault(r["model"], []).append(str(r["candidate"])[:16])
    assert sorted(got["gefs"]) == ["2014-03-02 00:00", "2014-03-02 06:00", "2014-03-02 12:00"]
    assert sorted(got["rtofs"]) == ["2014-02-28 00:00", "2014-03-01 00:00", "2014-03-02 00:00"]


def test_levels_must_be_one(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 0, 2), ("b", 7, 3), (None, 1, 4)], "model string, lev int, x int").withColumn("run_time", F.lit(1))
    assert sorted(r["x"] for r in ingest.squeeze_level(df).collect()) == [1, 2, 3, 4] and ingest.squeeze_level(df).columns == ["model", "x", "run_time"]
    with pytest.raises(Exception, match="several values in a run of a"):
        ingest.squeeze_level(df.withColumn("lev", F.col("x"))).collect()


def test_rows_without_member_or_run_stay(spark):
    df = spark.createDataFrame([("a", 1, 5, 0), ("a", 1, 8, 3600), ("a", 1, None, 7200), ("a", None, 9, 3600)], "model string, run_time int, realization int, at int").withColumn("valid_time", F.timestamp_seconds("at"))
    assert sorted((str(r["run_time"]), r["realization"], r["at"]) for r in ingest.zero_base_members(df).where("realization is not null").collect()) == [("1", 0, 0), ("1", 1, 3600), ("None", 0, 3600)]
    assert ingest.zero_base_members(df).count() == 4 and ingest.zero_base_members(df).columns == df.columns
    assert sorted((r["at"], r["lead_hours"]) for r in ingest.add_lead_hours(df).collect()) == [(0, 0), (3600, 0), (3600, 1), (7200, 2)]


def test_payloads_and_slices_can_be_written(spark):
    at = tempfile.mkdtemp(prefix="spark-")
    cube = derived.forecast(spark, SF)
    ingest.write_slices(ingest.export_slices(cube, ["x_wind"]), f"{at}/slices")
    ingest.write_payloads(cube, f"{at}/cube")
    back = ingest.scan_forecast(spark, f"{at}/cube", "gefs")
    assert back.count() == cube.count() == spark.read.parquet(f"{at}/slices").count()
    assert "PartitionFilters: [isnotnull(model" in back._jdf.queryExecution().executedPlan().toString()


def test_stream_gives_what_the_batch_gives(spark):
    at = tempfile.mkdtemp(prefix="spark-")
    messages = derived.messages(spark, SF).withColumn("received_at", F.timestamp_seconds(F.lit(1388563200) + F.col("msg_id")))
    messages.repartition(3).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    forecast = derived.forecast(spark, SF).cache()
    answer_stream(stream, lambda: forecast.select("model", "run_time"), lambda: forecast, f"{at}/out", f"{at}/state").awaitTermination()
    got = spark.read.parquet(f"{at}/out").drop("batch_id").withColumn("payloads", F.array_sort(F.map_entries("payloads")))
    want = answer_batch(messages, forecast.select("model", "run_time"), forecast).withColumn("payloads", F.array_sort(F.map_entries("payloads"))).select(*got.columns)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0 and got.where("total_bytes > 0").count() > 0


def test_packed_cells_read_back(spark):
    """Bins and rounded values of an odd number of cells, in canonical order; a missing value leaves its variable out."""
    values = [(98000.0, 3.2, 1.0), (101000.0, -4.6, None), (105000.0, 20.5, 2.0)]
    rows = [("a", 6, 0, i, 0, *v) for i, v in enumerate(values)] + [("b", 6, 0, 0, 0, 98000.0, 1.0, 0.3)]
    cells = spark.createDataFrame(rows[::-1], "request_id string, lead_hours int, realization int, lon_off int, lat_idx int, air_pressure_at_sea_level double, air_temperature double, sea_surface_wave_significant_height double")
    requests = spark.createDataFrame([("a", ["pressure", "temperature", "waveheight"]), ("b", ["waveheight"]), ("c", ["pressure"])], "request_id string, variables array<string>")
    got = {(r["request_id"], r["variable"]): bytes(r["packed"]).hex() for r in payloads(cells, requests).collect()}
    assert got == {("a", "pressure"): "170f", ("a", "temperature"): "0003fffb0014", ("b", "waveheight"): "02"}
    assert payloads(cells, requests, ["current"]).count() == 0
    row = {r["request_id"]: r for r in sent(cells, requests).collect()}["a"]
    assert [(x["variable"], x["size"]) for x in row["entries"]] == [("temperature", 6), ("pressure", 2)] and row["total_bytes"] == 8 and set(row["payloads"]) == {"pressure", "temperature"}


def test_messages_without_a_request_are_rows_of_the_batch(spark):
    messages = spark.createDataFrame([(1, "Hello\nsend nomodel:1n,2n,3e,4e"), (2, "please help"), (3, None)], "msg_id int, body string").withColumn("received_at", F.timestamp_seconds(F.lit(1704200000)))
    got = {(r["msg_id"], r["request_id"], r["text"], r["error"]) for r in answer_batch(messages, derived.runs(spark, SF), derived.forecast(spark, SF)).collect()}
    assert got == {(1, "1-1", "send nomodel:1n,2n,3e,4e", "unknown model"), (2, None, "please help", "no request found"), (3, None, None, "no request found")}
