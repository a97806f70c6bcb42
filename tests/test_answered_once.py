"""Requests that are alike are answered once, from cells whose members are summed up; every row of the answers is there."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seagrid.operators import subset
from seagrid.plans import derived

SF = "/root/testdata/sf0.001"


def _sizes(monkeypatch, spark, name, *operators):
    """How many requests and how many cells meet in a query."""
    met = []
    for operator in operators:
        module, name_of = operator

        def seen(requests, cells, *more, __of=getattr(module, name_of), **named):
            met.append((requests.count(), getattr(cells, "cells", cells).count()))
            return __of(requests, cells, *more, **named)

        monkeypatch.setattr(module, name_of, seen)
    rows = entry.queries()[name](spark, SF).count()
    return met[0], rows


def _boxes(spark):
    """How many gridded requests there are, and how many different ones."""
    asked = derived.requests(spark, SF).where("kind = 'gridded'")
    return asked.count(), asked.select("n", "s", "e", "w", "resolution", "hours").distinct().count()


NAMES = ["e4_e9_gridded_subset", "g7_bounding_box", "g8_central_point", "g9_box_size", "e17_forecast_kind", "e17_single_value"]


@pytest.fixture
def many(spark, monkeypatch):
    """Three times the customers, so that requests repeat."""
    real = derived.requests

    def repeated(spark, sf_dir):
        return real(spark, sf_dir).withColumn("request_id", F.explode(F.array(*[F.col("request_id") + i * 100_000 for i in range(3)])))

    monkeypatch.setattr(derived, "requests", repeated)


@pytest.mark.parametrize("name", NAMES)
def test_boxes_meet_places(spark, monkeypatch, many, name):
    n, different = _boxes(spark)
    (requests, cells), rows = _sizes(monkeypatch, spark, name, (subset, "gridded_subset"))
    assert n >= 3 * different and requests <= different
    assert cells == derived.forecast(spark, SF).select("lead_hours", "lat_idx", "lon_idx").distinct().count()
    assert rows % 3 == 0 and rows >= n / 2


def test_tiled_boxes_meet_places(spark, monkeypatch, many):
    _, different = _boxes(spark)
    (requests, cells), rows = _sizes(monkeypatch, spark, "e9_gridded_subset_tiled", (subset, "gridded_subset_tiled"))
    assert requests <= different and rows % 3 == 0
    assert cells == derived.forecast(spark, SF).select("lead_hours", "lat_idx", "lon_idx").distinct().count()


def test_answered_once_gives_every_request_its_rows(spark):
    rows = [(1, "m", 1.0, 2.0, [0, 6]), (2, "m", 1.0, 2.0, [0, 6]), (3, "m", None, 2.0, [0, 6]), (4, "m", None, 2.0, [0, 6]), (5, "m", 1.0, 2.0, [0]), (6, "m", 1.0, 2.0, None)]
    requests = spark.createDataFrame(rows, "request_id long, model string, lat double, lon double, hours array<int>")
    answered = []

    def answer(r):
        answered.extend(x["request_id"] for x in r.collect())
        return r.select("lat", "request_id", F.explode_outer("hours").alias("hour"))

    got = subset.answered_once(requests, subset.SPOT, answer)
    assert got.columns == ["lat", "request_id", "hour"]
    assert sorted(answered) == [1, 3, 5, 6]
    want = [(lat, i, h) for i, _, lat, _, hours in rows for h in hours or [None]]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_over_members_keeps_counts_and_sums(spark):
    cells = spark.createDataFrame([("m", 0, 0, 0, 1.0, 2.0, i, v) for i, v in enumerate([1.0, None, 2.5])] + [("m", 6, 0, 0, 1.0, 2.0, 0, None)], "model string, lead_hours int, lat_idx int, lon_idx int, latitude double, longitude double, realization int, x double")
    got = {r["lead_hours"]: (r["n_members"], r["x"]) for r in subset.over_members(cells, ["x"]).collect()}
    assert got == {0: (3, 3.5), 6: (1, None)}


def test_messages_that_ask_the_same_are_answered_once(spark, monkeypatch):
    from seagrid.streaming import answers

    body = "send gefs:10n,30n,60w,40w|native|24|wind"
    messages = spark.createDataFrame([(i, body if i < 5 else body.replace("24", "12")) for i in range(6)], "msg_id long, body string")
    messages = messages.withColumn("received_at", F.timestamp_seconds(F.lit(1388556000 + 7200)))
    met, real = [], answers.answer_requests
    monkeypatch.setattr(answers, "answer_requests", lambda requests, *more: met.append(requests.count()) or real(requests, *more))
    forecast = derived.forecast(spark, SF)
    got = answers.answer_batch(messages, forecast.select("model", "run_time"), forecast).select("msg_id", "error", "container").collect()
    assert met == [2]
    assert len(got) == 6 and {r["error"] for r in got} == {None}
    assert len({bytes(r["container"]) for r in got if r["msg_id"] < 5}) == 1 and len({bytes(r["container"]) for r in got}) == 2
