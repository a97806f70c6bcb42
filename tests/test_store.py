"""A stored forecast is read where it lies: pruned folders and row groups, no shuffle of cells, hours from the index."""

from __future__ import annotations

import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from seagrid.operators import subset
from seagrid.plans import derived, queries
from seagrid.sources import store
from tests.oracle import SF


@pytest.fixture(scope="module")
def stored(spark):
    path, name = "file://" + tempfile.mkdtemp(prefix="spark-"), f"cells_{uuid.uuid4().hex}"
    cube = derived.forecast(spark, SF)
    later = cube.withColumns({"run_time": F.expr("run_time + INTERVAL 6 HOURS"), "x_wind": F.col("x_wind") + 1}).where("lead_hours <= 12")
    store.write_runs(cube, name, path, tile=4, buckets=4)
    store.write_runs(later, name, path, tile=4, buckets=4)
    yield store.open_store(spark, name, path, tile=4)
    spark.sql(f"DROP TABLE {name}")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_folders_and_row_groups_are_pruned(spark, stored):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    got = store.scan_run(stored, "gefs", "2014-01-01 12:00:00").where(subset.box_predicate(2, 8, 3, 5, 20)).where("lead_hours = 6")
    plan = _plan(got)
    assert "run_dir" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0] and "GreaterThanOrEqual(lat_idx,2)" in plan and "EqualTo(lead_hours,6)" in plan
    assert got.count() == 7 * 6 and len(got.inputFiles()) < len(stored.cells.inputFiles())


def test_cells_are_not_shuffled(spark, stored):
    """Requests of both runs, from a file: a model or run that the optimizer knows to be one would leave the key, and the buckets."""
    at = "file://" + tempfile.mkdtemp(prefix="spark-") + "/requests"
    run = F.when(F.col("request_id") % 2 == 0, F.expr("TIMESTAMP '2014-01-01 12:00:00'")).otherwise(F.expr("TIMESTAMP '2014-01-01 06:00:00'"))
    subset.snap_bounds(derived.requests(spark, SF).where("kind = 'gridded'"), stored.spec).withColumn("run_time", run).write.parquet(at)
    wanted = spark.read.parquet(at)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = store.stored_subset(wanted, stored)
        plan = _plan(got)
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        want = subset.gridded_subset(wanted, stored.cells.drop("lat_tile", "lon_tile"))
        columns = ["request_id", "run_time", "lead_hours", "realization", "lat_idx", "lon_idx", "lon_off", "x_wind"]
        assert got.count() == want.count() > 0 and got.select(columns).exceptAll(want.select(columns)).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hours_come_from_the_index(spark, stored):
    runs = [("a", "2014-01-01 06:00:00", [24, 0, 99]), ("b", "2014-01-01 12:00:00", [24]), ("c", "2015-01-01 00:00:00", [0])]
    asked = spark.createDataFrame(runs, "request_id string, at string, hours array<int>").select("request_id", F.lit("gefs").alias("model"), F.col("at").cast("timestamp").alias("run_time"), "hours")
    got = store.resolve_hours(asked, stored.index)
    assert "cells" not in _plan(got)
    assert {r["request_id"]: (r["at_hours"], r["missing"], r["error"]) for r in got.collect()} == {"a": ([0, 24], [99], None), "b": ([], [24], "none of the hours is in the forecast"), "c": (None, [0], "no forecast")}


def test_answers_take_the_stored_tables(spark, stored):
    """With the stored grid and index no cell is read but for the join that answers."""
    from seagrid.streaming.answers import staged_requests

    messages = derived.messages(spark, SF).withColumn("received_at", F.timestamp_seconds(F.lit(1388556000 + 7200)))
    made = staged_requests(messages, stored.index.select("model", "run_time"), stored.spec)
    assert "cells" not in _plan(made) and made.where("error is null and place_error is null").count() > 0
    assert queries.QUERIES["a12_e9_stored_subset"] is not None
