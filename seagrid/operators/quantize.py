"""Few-bit bins of values, and packing of bins per request."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seagrid.functions import angles
from seagrid.sources.dims import DIRECTION_EDGES, MASKED_EDGES, WIND_KNOTS

_SMALL = 1e-6


def _array(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def digitize(value: Column, edges: list[float]) -> Column:
    """The number of edges at or below a value; null for null."""
    if any(b <= a for a, b in zip(edges, edges[1:], strict=False)):
        raise ValueError("edges must increase")
    # A sum of comparisons stays inside generated code, where a lambda over an array does not.
    return sum((F.when(value >= e, 1).otherwise(0) for e in edges[1:]), F.when(value >= edges[0], 1).when(value.isNull(), None).otherwise(0))


def digitize_circular(value: Column, edges: list[float]) -> Column:
    """As above around a circle: before the first edge and after the last is one bin, 0."""
    return F.pmod(digitize(value, edges), F.lit(len(edges)))


def midpoints(edges: list[float]) -> list[float]:
    """What each of the len(edges) + 1 bins is decoded to."""
    eps = max(0.5 * min(b - a for a, b in zip(edges, edges[1:], strict=False)), _SMALL)
    return [edges[0] - eps, *[(a + b) / 2 for a, b in zip(edges, edges[1:], strict=False)], edges[-1] + eps]


def undigitize(b: Column, edges: list[float]) -> Column:
    return F.get(_array(midpoints(edges)), b)


def undigitize_circular(b: Column, edges: list[float], wrap_value: float = math.pi) -> Column:
    return F.get(_array([wrap_value, *midpoints(edges)[1:-1]]), b)


def auto_edges(df: DataFrame, value: str, by: list[str], bits: int = 4) -> DataFrame:
    """Rows (by..., edges): 2**bits even edges from just below the least value to just above the greatest."""
    n = 1 << bits
    got = df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    eps = F.greatest((F.col("hi") - F.col("lo")) * 0.001, F.lit(_SMALL))
    got = got.select(*by, (F.col("lo") - eps).alias("a"), (F.col("hi") + eps).alias("b"))
    return got.select(*by, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("a") + (F.col("b") - F.col("a")) * i / (n - 1)).alias("edges"))


def digitize_by(value: Column, edges: Column) -> Column:
    """digitize() with the edges of each row."""
    return F.size(F.filter(edges, lambda e: e <= value))


def range_audit(df: DataFrame, columns: dict[str, list[float]]) -> DataFrame:
    """One row (variable, too_small, too_large, n) per column."""
    parts = [F.struct(F.lit(c).alias("variable"), F.count_if(digitize(F.col(c), e) == 0).alias("too_small"), F.count_if(F.col(c) >= e[-1]).alias("too_large"), F.count(c).alias("n")) for c, e in columns.items()]
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def quantize_variable(df: DataFrame, column: str, edges: list[float], unit_factor: float = 1.0) -> DataFrame:
    return df.withColumn(f"{column}_bin", digitize(F.col(column) * unit_factor, edges))


def quantize_velocity(df: DataFrame, u: str, v: str, name: str, edges: list[float], orientation: str = "from") -> DataFrame:
    """df with {name}_speed_bin and {name}_direction_bin."""
    speed, angle = angles.magnitude(F.col(u), F.col(v)), angles.direction(F.col(u), F.col(v), orientation)
    return df.withColumns({f"{name}_speed_bin": digitize(speed, edges), f"{name}_direction_bin": digitize_circular(angle, DIRECTION_EDGES)})


def decode_velocity(df: DataFrame, name: str, edges: list[float], orientation: str = "from") -> DataFrame:
    """df with {name}_speed, {name}_direction, {name}_u, {name}_v from the bins."""
    df = df.withColumns({f"{name}_speed": undigitize(F.col(f"{name}_speed_bin"), edges), f"{name}_direction": undigitize_circular(F.col(f"{name}_direction_bin"), DIRECTION_EDGES)})
    x, y = angles.components(F.col(f"{name}_speed"), F.col(f"{name}_direction"), orientation)
    return df.withColumns({f"{name}_u": x, f"{name}_v": y})


def quantize_masked_velocity(df: DataFrame, u: str, v: str, name: str, edges: list[float] | None = None, orientation: str = "to") -> DataFrame:
    """As quantize_velocity with missing values in an extra lowest bin, 1; the top is held at 15 for four bits."""
    edges = edges or MASKED_EDGES
    speed = F.coalesce(angles.magnitude(F.col(u), F.col(v)), F.lit(-1.0))
    angle = F.coalesce(angles.direction(F.col(u), F.col(v), orientation), F.lit(0.0))
    return df.withColumns({f"{name}_speed_bin": F.least(digitize(speed, edges), F.lit(15)), f"{name}_direction_bin": digitize_circular(angle, DIRECTION_EDGES), f"{name}_clamped": digitize(speed, edges) > 15})


def decode_masked_velocity(df: DataFrame, name: str, edges: list[float] | None = None, orientation: str = "to") -> DataFrame:
    out = decode_velocity(df, name, edges or MASKED_EDGES, orientation)
    there = F.col(f"{name}_speed_bin") > 1
    return out.withColumns({c: F.when(there, F.col(c)) for c in (f"{name}_speed", f"{name}_direction", f"{name}_u", f"{name}_v")})


def masked_quantize(df: DataFrame, value: str, edges: list[float], mask: Column) -> DataFrame:
    """The selected cells with their bins; the others are left out."""
    return df.where(mask).withColumn("bin", digitize(F.col(value), edges))


def masked_expand(cells: DataFrame, packed: DataFrame, keys: list[str], edges: list[float], mask: Column) -> DataFrame:
    """All cells with decoded values, null outside the same mask."""
    got = packed.select(*keys, undigitize(F.col("bin"), edges).alias("decoded"))
    return cells.join(got, keys, "left").withColumn("decoded", F.when(mask, F.col("decoded")))


def quantize_flag(flag: Column) -> Column:
    return flag.cast("int")


def round_to_digit(value: Column, digits: int) -> Column:
    """Half to even."""
    return F.bround(value * 10.0**digits) / 10.0**digits


def delta_encode_time(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by..., nth, origin_day, origin_second, delta): hour steps of each run's distinct times; the first counts from 0."""
    along = Window.partitionBy(*by).orderBy("lead_hours")
    times = df.select(*by, "run_time", "lead_hours").distinct()
    run = F.col("run_time").cast("timestamp")
    return times.select(
        *by,
        (F.row_number().over(along) - 1).alias("nth"),
        (F.datediff(run, F.lit("1970-01-01").cast("date")) + 719163).alias("origin_day"),
        (F.unix_seconds(run) - F.unix_seconds(F.date_trunc("day", run))).cast("int").alias("origin_second"),
        (F.col("lead_hours") - F.coalesce(F.lag("lead_hours").over(along), F.lit(0))).alias("delta"),
    )


def delta_decode_time(encoded: DataFrame, by: list[str]) -> DataFrame:
    along = Window.partitionBy(*by).orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.date_add(F.lit("1970-01-01").cast("date"), F.col("origin_day") - 719163).cast("timestamp") + F.make_dt_interval(secs=F.col("origin_second"))
    return encoded.select(*by, start.alias("run_time"), F.sum("delta").over(along).cast("int").alias("lead_hours"))


def trivial_axis(df: DataFrame, axis: str, by: list[str]) -> DataFrame:
    """Rows (by..., n, trivial): whether an axis is 0..n-1, n at most 32,767."""
    got = df.groupBy(*by).agg(F.countDistinct(axis).alias("n"), F.min(axis).alias("lo"), F.max(axis).alias("hi"))
    return got.select(*by, F.col("n").cast("int").alias("n"), ((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("n") <= 32767)).alias("trivial"))


def expand_axis(axes: DataFrame, axis: str) -> DataFrame:
    return axes.withColumn(axis, F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")


def pack_bins(df: DataFrame, by: list[str], order: list[str], b: str = "bin", bits: int = 4) -> DataFrame:
    """Rows (by..., n, packed): bins in order, 8 / bits to a byte, the first in the high bits.

    What is left over for the last byte sits in its low bits. A bin that needs more bits makes the
    payload null. A group is one variable of one request, whose size the manifest bounds.
    """
    per = 8 // bits
    got = df.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, b))), lambda x: x[b]).alias("bins"), F.max(b).alias("top"))
    n = F.size("bins")
    whole = F.slice("bins", 1, F.expr(f"cast(cardinality(bins) div {per} * {per} as int)"))
    tail = F.slice("bins", F.expr(f"cast(cardinality(bins) div {per} * {per} + 1 as int)"), per)
    if bits == 4:
        digits = F.array_join(F.transform("bins", lambda x: F.hex(x.cast("long"))), "")
        text = F.when(n % 2 == 0, digits).otherwise(F.concat(F.substring(digits, F.lit(1), n - 1), F.lit("0"), F.substring(digits, n, F.lit(1))))
    else:
        def byte(values: Column) -> Column:
            return F.lpad(F.hex(F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc * (1 << bits) + x)), 2, "0")

        starts = F.sequence(F.lit(0), F.size(whole) - per, F.lit(per))
        bytes_ = F.when(F.size(whole) > 0, F.transform(starts, lambda i: byte(F.slice("bins", i + 1, per)))).otherwise(F.array().cast("array<string>"))
        text = F.concat(F.array_join(bytes_, ""), F.when(F.size(tail) > 0, byte(tail)).otherwise(""))
    return got.select(*by, n.alias("n"), F.when(F.col("top") < (1 << bits), F.unhex(text)).alias("packed"))


def unpack_bins(df: DataFrame, by: list[str], bits: int = 4) -> DataFrame:
    """Rows (by..., nth, bin) of packed payloads with their numbers of values."""
    per = 8 // bits
    odd = F.col("n") % per
    place = F.col("nth")
    byte = F.conv(F.substring(F.hex("packed"), (F.expr(f"cast(nth div {per} as int)") * 2 + 1), F.lit(2)), 16, 10).cast("int")
    in_tail = (place >= F.col("n") - odd) & (odd > 0)
    shift = F.when(in_tail, (F.col("n") - 1 - place) * bits).otherwise((per - 1 - place % per) * bits)
    rows = df.where("n > 0").select(*by, "n", "packed", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("nth"))
    rows = rows.withColumns({"byte": byte, "shift": shift.cast("int")})
    return rows.select(*by, "nth", F.expr(f"shiftright(byte, shift) & {(1 << bits) - 1}").alias("bin"))


def payload_manifest(payloads: DataFrame, variables: DataFrame, version: int = 1, with_payloads: bool = False) -> DataFrame:
    """Rows (request_id, version, entries, total_bytes, error) from rows (request_id, variable, packed).

    Entries are in the registry's order; unknown variables and payloads over 2**24 bytes are errors. with_payloads adds
    `payloads`, a map from variable to packed bytes.
    """
    met = payloads.join(F.broadcast(variables.select(F.col("name").alias("variable"), "ord")), "variable", "left")
    size = F.octet_length("packed")
    got = met.groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.struct("ord", "variable", size.alias("size")))).alias("entries"),
        F.sum(size).alias("total_bytes"),
        F.max(F.when(F.col("ord").isNull(), "unknown variable").when(size > 1 << 24, "variable too large")).alias("error"),
        *([F.map_from_entries(F.collect_list(F.struct("variable", "packed"))).alias("payloads")] if with_payloads else []),
    )
    return got.select("request_id", F.lit(version).alias("version"), "entries", "total_bytes", "error", *(["payloads"] if with_payloads else []))


def read_manifest(manifest: DataFrame, version: int = 1) -> DataFrame:
    """Entries of manifests of a known version; others are errors."""
    error = F.coalesce("error", F.when(F.col("version") != version, F.lit("unknown version")))
    return manifest.select("request_id", F.posexplode("entries").alias("nth", "x"), error.alias("error")).select("request_id", "nth", "x.variable", "x.size", "error")


def combined_variable(df: DataFrame, parts: list[str], name: str = "combined") -> DataFrame:
    """Several quantised columns side by side, only where all or none are there."""
    same = F.size(F.array_distinct(F.array(*[F.col(p).isNull() for p in parts]))) == 1
    return df.withColumn(name, F.when(same, F.struct(*parts)))


def combined_payload(payloads: DataFrame, by: list[str], parts: list[str], name: str = "combined") -> DataFrame:
    """Rows (by..., variable, packed, error): the packed parts of rows (by..., variable, packed) side by side, in order.

    A missing part or parts of different sizes are an error, and nothing is packed.
    """
    place = F.array_position(F.array(*[F.lit(p) for p in parts]), F.col("variable"))
    got = payloads.where(F.col("variable").isin(parts)).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(place.alias("at"), F.hex("packed").alias("text")))).alias("parts"))
    texts = F.transform("parts", lambda p: p["text"])
    there = (F.size("parts") == len(parts)) & ~F.exists(texts, lambda t: t.isNull())
    alike = F.size(F.array_distinct(F.transform(texts, F.length))) == 1
    error = F.when(~there, F.lit("a part is missing")).when(~alike, F.lit("parts differ in size"))
    return got.select(*by, F.lit(name).alias("variable"), F.when(there & alike, F.unhex(F.array_join(texts, ""))).alias("packed"), error.alias("error"))


def quantization_error(df: DataFrame, value: str, decoded: str, by: list[str], circular: bool = False) -> DataFrame:
    """Rows (by..., max_error)."""
    error = F.abs(angles.diff(F.col(value), F.col(decoded), degrees=False)) if circular else F.abs(F.col(value) - F.col(decoded))
    return df.groupBy(*by).agg(F.max(error).alias("max_error"))


def force_label(b: Column) -> Column:
    """Names of the wind force bins, F-0 up; one fewer than edges."""
    return F.when(b.between(1, len(WIND_KNOTS) - 1), F.concat(F.lit("F-"), (b - 1).cast("string")))


def compression_report(packed: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by..., n_values, n_bytes, ratio) against four-byte floats."""
    got = packed.groupBy(*by).agg(F.sum("n").alias("n_values"), F.sum(F.octet_length("packed")).alias("n_bytes"))
    return got.withColumn("ratio", F.col("n_values") * 4 / F.col("n_bytes"))
