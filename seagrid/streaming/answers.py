"""Arriving messages answered by the batch operators, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seagrid.operators import containers
from seagrid.operators.payloads import source_columns
from seagrid.operators.requests import delivery_policy, extract_request_lines, parse_requests, quarantine
from seagrid.operators.runs import latest_run, latest_run_arrived
from seagrid.operators.subset import answer_requests, grid_spec, select_hours, snap_bounds

_ASKED = ["kind", "model", "run_time", "n", "s", "e", "w", "lat", "lon", "resolution", "hours", "variables"]
_SNAPPED = ["lat_lo", "lat_hi", "lat_stride", "lon_w", "lon_span", "lon_stride", "n_lat", "n_lon"]


def staged_requests(messages: DataFrame, runs: DataFrame, spec: DataFrame) -> DataFrame:
    """Typed requests of messages with their text, run and snapped box: all that is known of them before any cell is read.

    error is that of the parse or of the run; place_error that of the box on the grid. Of runs with arrived_at, those count that
    had arrived at the time of the message.
    """
    lines = extract_request_lines(messages).withColumn("request_id", F.concat_ws("-", "msg_id", "line_no"))
    requests = parse_requests(lines.select("request_id", "msg_id", "text"))
    times = messages.select("msg_id", F.date_trunc("hour", "received_at").alias("as_of"))
    find = latest_run_arrived if "arrived_at" in runs.columns else latest_run
    newest = find(runs, times.select("as_of")).withColumnRenamed("error", "run_error")
    met = requests.join(times, "msg_id").join(newest, ["as_of", "model"], "left").join(lines.select("request_id", "text"), "request_id")
    met = met.withColumn("known_error", F.coalesce("error", "run_error")).drop("run_error", "error")
    snapped = snap_bounds(met, spec).withColumnRenamed("error", "place_error").withColumnRenamed("known_error", "error")
    box = F.col("kind") == "gridded"
    return snapped.select(*[c for c in met.columns if c != "known_error"], "error", *_SNAPPED, F.when(box & F.col("error").isNull(), F.col("place_error")).alias("place_error"))


def answer_batch(messages: DataFrame, runs: DataFrame, forecast: DataFrame, spec: DataFrame | None = None, index: DataFrame | None = None, folder: str | None = None) -> DataFrame:
    """Answers to messages (msg_id, body, received_at and perhaps sender): one row per request, one for each message without a request.

    A request has its typed fields, its text, the latest run of its model at its time, and what is sent: `container`, deflated, from
    which a client rebuilds its cells (see `containers`), with `entries`, `payloads` (variable to packed bytes, of variables without
    missing values) and their total_bytes. What cannot be answered has an error instead, and `reason` says more. Hours that the run
    lacks, missing values and variables that the forecast lacks are warnings. With a sender, `extension` is that of the attachment,
    and a container too large for the sender is withheld with a delivery_error.

    spec and index are `grid_spec` and `forecast_index` of the forecast, or stored tables of them. The parsed requests are written
    to `folder` and read from there; without one they are cached, so that parsing is not repeated by every branch.
    """
    spec = grid_spec(forecast) if spec is None else spec
    index = containers.forecast_index(forecast) if index is None else index
    made = staged_requests(messages, runs, spec)
    if folder is None:
        staged = made.persist()
    else:
        made.write.mode("overwrite").parquet(folder)
        staged = messages.sparkSession.read.schema(made.schema).parquet(folder)
    good = staged.where("error is null").drop("error")
    # Requests that ask the same are answered once, under the smallest request_id of those alike; answers join their requests last.
    alike = good.groupBy(*_ASKED, *_SNAPPED, "place_error").agg(F.min("request_id").alias("request_id"))
    asked = [r[0] for r in good.select(F.explode("variables")).distinct().collect()]  # of the registry's few names

    axes = containers.request_axes(alike.where("place_error is null"), index)
    cells = answer_requests(alike.drop(*_SNAPPED, "place_error"), forecast, spec, source_columns(forecast, asked))
    packed = containers.containers(cells, axes, asked).withColumnRenamed("error", "no_container").withColumnRenamed("missing", "lacks")
    packed = packed.withColumn("sent", F.col("container").isNotNull()).withColumn("container", containers.deflated("container"))
    hours = index.select("model", "run_time", F.explode("run_hours").alias("lead_hours"))
    missing = select_hours(good, hours).where("not available").groupBy("request_id").agg(F.sort_array(F.collect_set("lead_hours")).alias("missing"))
    firsts = alike.select(F.col("request_id").alias("answer_id"), *[F.col(c).alias(f"__{c}") for c in _ASKED])
    whose = good.join(firsts, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in _ASKED]).select("request_id", "answer_id")
    met = staged.drop(*_SNAPPED).join(missing, "request_id", "left").join(whose, "request_id", "left").withColumn("answer_id", F.coalesce("answer_id", "request_id"))
    if "sender" in messages.columns:
        met = met.join(messages.select("msg_id", "sender"), "msg_id")
    met = met.join(packed.withColumnRenamed("request_id", "answer_id"), "answer_id", "left").drop("answer_id")
    nothing = F.when(~F.coalesce("sent", F.lit(False)), F.lit("nothing of the forecast fits the request"))
    none = F.array().cast("array<string>")
    lacks = F.transform(F.coalesce("missing", F.array().cast("array<int>")), lambda h: F.concat(F.lit("no forecast for hour "), h.cast("string")))
    met = met.withColumns({"reason": F.when(F.col("error").isNull(), F.coalesce("place_error", "no_container")), "warnings": F.concat("warnings", lacks, F.coalesce("lacks", none)), "error": F.coalesce("error", nothing)})
    met = met.drop("missing", "lacks", "place_error", "no_container", "sent")
    if "sender" in messages.columns:
        met = delivery_policy(met.withColumn("payload", F.col("container")))
        held = F.col("rejected") & F.col("container").isNotNull()
        met = met.withColumns({"delivery_error": F.when(held, F.lit("too large for the sender")), "container": F.when(~held, F.col("container"))}).drop("rejected", "payload", "sender")
    times = messages.select("msg_id", F.date_trunc("hour", "received_at").alias("as_of"))
    _, rejected = quarantine(staged.select("request_id", "msg_id", "error", "warnings"), messages, staged.select("request_id", "msg_id", "text"))
    return met.unionByName(rejected.where("request_id is null").join(times, "msg_id"), allowMissingColumns=True)


def answer_stream(
    messages: DataFrame, runs: Callable[[], DataFrame], forecast: Callable[[], DataFrame], path: str, checkpoint: str, index: Callable[[], tuple[DataFrame, DataFrame]] | None = None, **options
) -> StreamingQuery:
    """Start answering a stream. `runs` and `forecast` are called for each batch, so new runs count at once.

    `index` gives the stored grid_spec and forecast_index; without it both are worked out from the forecast in each batch. Answers are
    keyed by batch_id and request_id: each batch overwrites its own folder, so a batch that runs again leaves its answers once.
    The parsed requests of a batch stand in a folder of the same name with -requests.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        spec, known = index() if index else (None, None)
        staged = f"{path.rstrip('/')}-requests/batch_id={batch_id}"
        answer_batch(batch, runs(), forecast(), spec, known, staged).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return messages.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()
