"""Which run of a model to use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seagrid.sources.dims import model_dim


def _floored(time: Column) -> Column:
    """A time floored to a model's cadence within its day."""
    day = F.date_trunc("day", time)
    return day + F.make_dt_interval(hours=F.floor(F.hour(time) / F.col("freq_hours")).cast("int") * F.col("freq_hours"))


def _models_at(as_of: DataFrame) -> DataFrame:
    """Each distinct time of `as_of` with each model and its newest run that may be there."""
    models = model_dim(as_of.sparkSession).select("model", "freq_hours")
    met = as_of.select("as_of").distinct().crossJoin(F.broadcast(models))  # of the registry's few models
    return met.withColumn("newest", _floored(F.col("as_of").cast("timestamp") + F.expr("INTERVAL 1 HOUR")))


def candidate_runs(as_of: DataFrame, n: int = 10) -> DataFrame:
    """Rows (as_of, model, candidate) for each distinct time of `as_of`: the time an hour on, floored to the
    model's cadence within its day, and n - 1 steps back."""
    back = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("newest") - F.make_dt_interval(hours=(i * F.col("freq_hours")).cast("int")))
    return _models_at(as_of).select("as_of", "model", F.explode(back).alias("candidate"))


def latest_run(runs: DataFrame, as_of: DataFrame, n: int = 10) -> DataFrame:
    """Rows (as_of, model, run_time, error): the newest candidate among rows (model, run_time) of `runs`, whenever it arrived."""
    wanted = candidate_runs(as_of, n)
    there = runs.select("model", F.col("run_time").cast("timestamp").alias("candidate")).distinct()
    found = wanted.join(there, ["model", "candidate"], "left_semi").groupBy("as_of", "model").agg(F.max("candidate").alias("run_time"))
    every = wanted.select("as_of", "model").distinct().join(found, ["as_of", "model"], "left")
    return every.withColumn("error", F.when(F.col("run_time").isNull(), F.lit("no run available")))


def latest_run_arrived(runs: DataFrame, as_of: DataFrame, n: int = 10) -> DataFrame:
    """The same among runs that had arrived: rows (model, run_time, arrived_at) count from arrived_at on, so a replay sees no later run.

    A point-in-time join: arrivals and times are merged in one sort by model and day, and the newest run so far is carried
    forward, over days by one row a day. A run counts from its first arrival, and no earlier than an hour before its own time,
    when it becomes a candidate.
    """
    freq = F.broadcast(model_dim(as_of.sparkSession).select("model", "freq_hours"))
    run = F.col("run_time").cast("timestamp")
    known = runs.select("model", run.alias("run_time"), F.col("arrived_at").cast("timestamp").alias("arrived_at")).where("arrived_at is not null")
    known = known.groupBy("model", "run_time").agg(F.min("arrived_at").alias("arrived_at")).join(freq, "model").where(_floored(F.col("run_time")) == F.col("run_time"))
    seen = known.select("model", F.greatest("arrived_at", F.col("run_time") - F.expr("INTERVAL 1 HOUR")).alias("at"), "run_time", F.lit(False).alias("asked"))
    wanted = _models_at(as_of)
    asked = wanted.select("model", F.col("as_of").cast("timestamp").alias("at"), F.lit(None).cast("timestamp").alias("run_time"), F.lit(True).alias("asked"), "as_of", "freq_hours", "newest")
    both = seen.unionByName(asked, allowMissingColumns=True).withColumn("day", F.to_date("at"))
    so_far = Window.partitionBy("model").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = both.groupBy("model", "day").agg(F.max("run_time").alias("last")).select("model", "day", F.max("last").over(so_far).alias("carried"))
    in_day = Window.partitionBy("model", "day").orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("here", F.max("run_time").over(in_day)).where("asked").join(days, ["model", "day"]).withColumn("run_time", F.greatest("here", "carried"))
    oldest = F.col("newest") - F.make_dt_interval(hours=((n - 1) * F.col("freq_hours")).cast("int"))
    found = found.select("as_of", "model", F.when(F.col("run_time") >= oldest, F.col("run_time")).alias("run_time"))
    return found.withColumn("error", F.when(F.col("run_time").isNull(), F.lit("no run available")))
