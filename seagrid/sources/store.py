"""A stored forecast: cells laid out so that filters prune and requests join without moving them, and its small tables beside them.

    <path>/cells    folders by model and run; in each, BUCKETS buckets of (model, run_time, lead_hours, lat_tile, lon_tile), sorted by hour and tile
    <path>/index    `forecast_index` of each run, appended as runs are written
    <path>/grids    `grid_spec` of each run's model

A request side dealt to the same buckets meets the cells where they lie, as long as models and runs are columns: where the optimizer knows
that all requests are of one run, it leaves the run out of the join's key, and then moves the cells of that run's folder. Hours, members and axes are read from the index, which has a row
a run, and not from the cells. A run is written once; readers of the index see a run when all its cells are there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seagrid.operators.containers import forecast_index
from seagrid.operators.subset import grid_spec, lat_covers, lon_covers, lon_offset

TILE = 16
BUCKETS = 64
JOIN = ["model", "run_time", "lead_hours", "lat_tile", "lon_tile"]


def _tile(c: str, tile: int):
    return F.floor(F.col(c) / tile).cast("int")


@dataclass
class Stored:
    cells: DataFrame
    index: DataFrame
    spec: DataFrame
    tile: int


def write_runs(cells: DataFrame, name: str, path: str, tile: int = TILE, buckets: int = BUCKETS) -> None:
    """Append runs to the table `name` whose files are under path. Each bucket of a run is one file: rows are dealt to buckets before they are written."""
    laid = cells.withColumns({"lat_tile": _tile("lat_idx", tile), "lon_tile": _tile("lon_idx", tile), "model_dir": F.col("model"), "run_dir": F.date_format("run_time", "yyyyMMddHH")})
    writer = laid.repartition(buckets, *JOIN).write.mode("append").partitionBy("model_dir", "run_dir").bucketBy(buckets, *JOIN).sortBy("lead_hours", "lat_tile", "lon_tile")
    writer.format("parquet").option("path", f"{path}/cells").saveAsTable(name)
    grid_spec(cells).write.mode("append").parquet(f"{path}/grids")
    forecast_index(cells).write.mode("append").parquet(f"{path}/index")


def open_store(spark: SparkSession, name: str, path: str, tile: int = TILE) -> Stored:
    """A model's grid must be the same in all its runs."""
    grids = spark.read.parquet(f"{path}/grids").distinct()
    return Stored(spark.table(name), spark.read.parquet(f"{path}/index"), grids, tile)


def scan_run(stored: Stored, model: str, run_time=None) -> DataFrame:
    """The cells of a model or a run; both prune folders."""
    cells = stored.cells.where((F.col("model_dir") == model) & (F.col("model") == model))
    if run_time is not None:
        at = F.lit(run_time).cast("timestamp")
        cells = cells.where((F.col("run_dir") == F.date_format(at, "yyyyMMddHH")) & (F.col("run_time") == at))
    return cells


def stored_subset(requests: DataFrame, stored: Stored) -> DataFrame:
    """Cells of snapped requests (with model, run_time and hours), as `gridded_subset` gives them: only the requests are shuffled."""
    tile = stored.tile
    of = lambda c: F.floor(c / tile).cast("int")
    last = F.col("lon_w") + F.col("lon_span")
    seam = F.concat(F.sequence(of(F.col("lon_w")), of(F.col("n_lon") - 1)), F.sequence(F.lit(0), of(F.greatest(last - F.col("n_lon"), F.lit(0)))))
    lons = F.when(last < F.col("n_lon"), F.sequence(of(F.col("lon_w")), of(last))).otherwise(F.array_distinct(seam))
    lats = F.sequence(of(F.col("lat_lo")), of(F.least("lat_hi", F.col("n_lat") - 1)))
    keep = ["request_id", "model", "run_time", "lat_lo", "lat_hi", "lat_stride", "lon_w", "lon_span", "lon_stride", "n_lon"]
    wanted = requests.where("error is null").withColumn("lat_tile", F.explode(lats)).withColumn("lon_tile", F.explode(lons)).select(*keep, "lat_tile", "lon_tile", F.explode(F.array_distinct("hours")).alias("lead_hours"))
    met = stored.cells.join(wanted, JOIN).where(lat_covers() & lon_covers())
    own = [c for c in stored.cells.columns if c not in ("lat_tile", "lon_tile", "model_dir", "run_dir")]
    return met.select("request_id", *own, lon_offset().alias("lon_off"))


def resolve_hours(requests: DataFrame, index: DataFrame) -> DataFrame:
    """Rows (request_id, at_hours, missing, error) of requests (request_id, model, run_time, hours), from the index alone.

    Of the asked hours those that the run has, ascending, and those that it lacks; none at all is an error, as is a run that is not there.
    """
    met = requests.select("request_id", "model", "run_time", F.array_distinct("hours").alias("hours")).join(index.select("model", "run_time", "run_hours"), ["model", "run_time"], "left")
    at = F.array_sort(F.array_intersect("hours", "run_hours"))
    error = F.when(F.col("run_hours").isNull(), "no forecast").when(F.size(at) == 0, "none of the hours is in the forecast")
    return met.select("request_id", at.alias("at_hours"), F.array_sort(F.array_except("hours", F.coalesce("run_hours", F.array().cast("array<int>")))).alias("missing"), error.alias("error"))
