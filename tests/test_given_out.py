"""Interpolated spots: few spots leave the forecast where it is, and answers are given to those who ask the same from packed rows."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seagrid.operators import subset
from seagrid.plans import derived

SF = "/root/testdata/sf0.001"
NAMES = ["e13_spot_interpolate", "e13_spot_interpolate_uneven"]
BY_PLACE = r"hashpartitioning\((model#\w+, )?lat_idx"


@pytest.fixture
def no_broadcast(spark):
    """No join is broadcast but where it is asked for, as with tables that are large."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted(map(str, map(tuple, df.collect())))


@pytest.mark.parametrize("name", NAMES)
def test_forecast_stays_and_answers_are_joined_packed(spark, no_broadcast, name):
    plan = _plan(entry.queries()[name](spark, SF))
    assert not re.search(BY_PLACE, plan)  # neither cells nor corners are dealt by their place
    assert "hashpartitioning(request_id#" in plan and "__deal" in plan and plan.count("Generate explode(__askers") == 1
    joins = [x for x in plan.splitlines() if "Join" in x and "[request_id#" in x]
    assert joins and all("BroadcastHashJoin" in x for x in joins), joins


@pytest.mark.parametrize("name", NAMES)
def test_many_spots_are_shuffled(spark, no_broadcast, monkeypatch, name):
    monkeypatch.setattr(subset, "FEW_SPOTS", 3)
    monkeypatch.setattr(subset, "FEW_IDS", 3)
    df = entry.queries()[name](spark, SF)
    assert re.search(BY_PLACE, _plan(df))
    many = _rows(df)
    monkeypatch.undo()
    assert many == _rows(entry.queries()[name](spark, SF))


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_packed_answers_are_the_answers(spark, monkeypatch, few):
    """A spot that most ask for, one that nobody else does, one without answer, answers with nulls and with more and fewer rows than a pack."""
    monkeypatch.setattr(subset, "PACK", 7)
    monkeypatch.setattr(subset, "FEW_IDS", few)
    lat = F.when(F.col("request_id") < 300, 1.0).when(F.col("request_id") < 310, F.col("request_id").cast("double"))
    requests = spark.range(320).withColumnRenamed("id", "request_id").select("request_id", F.lit("m").alias("model"), lat.alias("lat"), F.lit(2.0).alias("lon"), F.array(F.lit(0)).alias("hours"))
    cells = spark.range(60).select((F.col("id") % 3 * 6).cast("int").alias("lead_hours"), F.when(F.col("id") >= 6, F.col("id")).alias("realization"), F.when(F.col("id") % 5 > 0, F.col("id") / 8).alias("x"))

    def answer(r):
        return r.where("lat is null or lat <> 305").join(cells.where("realization is null or realization < 50")).select("lead_hours", "request_id", "realization", (F.col("x") + F.coalesce("lat", F.lit(0))).alias("x"))

    plain = subset.answered_once(requests, subset.SPOT, answer)
    packed = subset.answered_once(requests, subset.SPOT, answer, subset.members_and_hours())
    assert packed.schema.simpleString() == plain.schema.simpleString() and packed.columns == plain.columns
    assert _rows(packed) == _rows(plain) and packed.count() == 319 * 50


@pytest.mark.parametrize("name", NAMES)
def test_every_spot_has_its_rows(spark, monkeypatch, name):
    """Three times the requests, three times the rows, each as before."""
    real = derived.requests
    once = _rows(entry.queries()[name](spark, SF))
    monkeypatch.setattr(derived, "requests", lambda *of: real(*of).withColumn("request_id", F.explode(F.array(*[F.col("request_id") + i * 100_000 for i in range(3)]))))
    thrice = entry.queries()[name](spark, SF).withColumn("request_id", F.col("request_id") % 100_000)
    assert _rows(thrice) == sorted(once * 3)
