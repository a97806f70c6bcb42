"""What is sent for each answered request: bins of every asked variable, packed in canonical order, with a manifest.

Binned variables take one hex digit a cell and part (a velocity has two parts, speed and direction),
rounded ones four, a signed integer of two bytes. A variable that misses a value, which only currents
may, is left out. A group is the cells of one request, which the manifest's limit on a variable bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seagrid.functions import angles
from seagrid.operators import quantize
from seagrid.sources.dims import DIRECTION_EDGES, MASKED_EDGES, VARIABLES, variable_dim

_MISSING = "?"
ORDER = ["lead_hours", "realization", "lon_off", "lat_idx"]


def source_columns(df: DataFrame, variables: list[str] | None = None) -> list[str]:
    """The columns of df from which variables, or some of them, are made."""
    kept = {c for v in VARIABLES if v[1] not in ("time", "trivial") and v[0] not in ("latitude", "longitude") and (variables is None or v[0] in variables) for c in v[2]}
    return [c for c in df.columns if c in kept]


def _measures(kind: str, columns: list[str]) -> list[Column]:
    """What is binned or rounded: one number for each part of a variable."""
    first, last = F.col(columns[0]), F.col(columns[-1])
    if kind == "velocity":
        return [angles.magnitude(first, last), angles.direction(first, last)]
    if kind == "masked_velocity":
        return [F.coalesce(angles.magnitude(first, last), F.lit(-1.0)), F.coalesce(angles.direction(first, last, "to"), F.lit(0.0))]
    if kind == "circular":
        return [angles.normalize(F.radians(first), degrees=False)]
    return [first] if kind in ("scalar", "rounded") else []


def _digits(kind: str, part: int, x: Column, edges: list[float]) -> tuple[Column, int]:
    """The hex digits of a part, and how many; a missing value has as many marks."""
    if kind == "rounded":
        text = F.lpad(F.hex(F.bround(x).cast("int").bitwiseAND(F.lit(0xFFFF)).cast("long")), 4, "0")
        return F.coalesce(text, F.lit(_MISSING * 4)), 4
    if part == 1 or kind == "circular":
        b = quantize.digitize_circular(x, DIRECTION_EDGES)
    else:
        b = quantize.digitize(x, MASKED_EDGES if kind == "masked_velocity" else edges)
        b = F.when(b > 15, 15).otherwise(b)
    return F.coalesce(F.substring(F.lit("0123456789ABCDEF"), b + 1, F.lit(1)), F.lit(_MISSING)), 1


def payloads(cells: DataFrame, requests: DataFrame, variables: list[str] | None = None) -> DataFrame:
    """Rows (request_id, variable, packed) from cells (request_id, lead_hours, realization, lon_off, lat_idx, columns) and requests (request_id, variables).

    A cell becomes one short text of the digits of all its parts, so that a request's cells are gathered and sorted once.
    `variables` names those that any request asks for; all by default.
    """
    have = set(source_columns(cells, variables))
    measures, texts, found, at = {}, [], [], 1
    for name, kind, columns, _, edges, *_ in VARIABLES:
        if not set(columns) <= have or variables is not None and name not in variables:
            continue
        parts = []
        for i, x in enumerate(_measures(kind, columns)):
            measures[f"{name}_{i}"] = x
            parts.append(_digits(kind, i, F.col(f"{name}_{i}"), edges))
        if parts:
            texts += [text for text, _ in parts]
            found.append((name, at, len(parts), parts[0][1]))
            at += sum(n for _, n in parts)
    if not found:
        return requests.select("request_id", F.lit("").alias("variable"), F.lit(None).cast("binary").alias("packed")).limit(0)
    # Measures are columns of their own, so that each is worked out once and not for every edge.
    measured = cells.select("request_id", *ORDER, *[x.alias(c) for c, x in measures.items()]).select("request_id", F.struct(*ORDER, F.concat(*texts).alias("text")).alias("cell"))
    rows = measured.groupBy("request_id").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    rows = rows.select("request_id", F.array_join("cells.text", "").alias("text"), F.size("cells").alias("n_cells")).join(requests.select("request_id", "variables"), "request_id")
    width = at - 1

    def packed(start: int, digits: int) -> Column:
        """The digits of one part of all cells; an odd last digit stands in the low half of its byte."""
        other, after = rf"(?s).{{{start - 1}}}(.{{{digits}}}).{{{width - start + 1 - digits}}}", "$1"
        text = F.col("text") if digits == width else F.regexp_replace("text", other, after)
        n = F.col("n_cells") * digits
        return F.when(n % 2 == 0, text).otherwise(F.concat(F.substring(text, F.lit(1), n - 1), F.lit("0"), F.substring(text, n, F.lit(1))))

    every = [F.struct(F.lit(name).alias("variable"), F.concat(*[packed(start + i * digits, digits) for i in range(n)]).alias("text")) for name, start, n, digits in found]
    asked = F.array(*[F.when(F.array_contains("variables", name), x) for (name, *_), x in zip(found, every, strict=True)])
    rows = rows.select("request_id", F.explode(F.array_compact(asked)).alias("x")).where(~F.contains("x.text", F.lit(_MISSING)))
    return rows.select("request_id", "x.variable", F.unhex("x.text").alias("packed"))


def sent(cells: DataFrame, requests: DataFrame, variables: list[str] | None = None) -> DataFrame:
    """Rows (request_id, version, entries, total_bytes, manifest_error, payloads) of each request with something to send."""
    manifest = quantize.payload_manifest(payloads(cells, requests, variables), variable_dim(cells.sparkSession), with_payloads=True)
    return manifest.withColumnRenamed("error", "manifest_error")
