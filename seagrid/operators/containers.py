"""One container per request: its coordinates first, then the asked variables, so that a client needs nothing else.

Format, version 2, integers big-endian: the version (1 byte), then for each entry, in the registry's order, its number there (1 byte,
128 more if values are missing), its size (3 bytes) and as many bytes:

    time                  days since 0001-01-01 plus one (4 bytes) and seconds (4) of the run; of each hour its distance from the one before (2)
    realization           how many members, numbered from 0 (2)
    latitude, longitude   thousandths of a degree, signed, of each node (4 each); longitudes from the western edge on
    binned variables      half a byte a cell, the first in the high half, an odd last one in a low half; speeds before directions
    rounded variables     a signed integer of 2 bytes a cell
    wave                  the heights, then the directions

Cells follow each other by hour, member, longitude and latitude. A variable that misses values starts with a bit for each cell, the
first in the highest bit, and has only the cells whose bit is set.

A cell's place comes from the request's axes, which are known beforehand from the request and an index of the forecast, and so is the
size: requests above the limit are refused before any cell is gathered. Cells are gathered in pieces of `chunk` places, which a task holds
one at a time, and only a request's packed pieces meet, bounded by the limit.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from seagrid.functions import angles
from seagrid.operators import quantize
from seagrid.sources.dims import DIRECTION_EDGES, MASKED_EDGES, VARIABLES

VERSION = 2
CHUNK = 8192
LIMIT = 1 << 24  # bytes of a variable
_HEX = "0123456789ABCDEF"
_ORD = {v[0]: v[7] for v in VARIABLES}
_COORDINATES = ["time", "realization", "latitude", "longitude"]


def _u(c: Column, digits: int) -> Column:
    return F.lpad(F.hex(c.cast("long")), digits, "0")


def _signed(c: Column) -> Column:
    return _u(c.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)), 8)


def forecast_index(forecast: DataFrame) -> DataFrame:
    """One row per run: model, run_time, run_hours, n_members (null unless members are 0..n-1), lats, lons (by index).

    Small beside the cells: a stored forecast keeps it, so that no answer reads cells for it.
    """
    by_idx = lambda i, x: F.sort_array(F.collect_set(F.struct(F.col(i).alias("i"), F.col(x).alias("x"))))
    got = forecast.groupBy("model", "run_time").agg(
        F.sort_array(F.collect_set("lead_hours")).alias("run_hours"), F.size(F.collect_set("realization")).alias("n"), F.min("realization").alias("lo"), F.max("realization").alias("hi"),
        by_idx("lat_idx", "latitude").alias("ys"), by_idx("lon_idx", "longitude").alias("xs"),
    )
    trivial = (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("n") <= 32767)
    return got.select("model", "run_time", "run_hours", F.when(trivial, F.col("n")).cast("int").alias("n_members"), F.transform("ys", lambda v: v["x"]).alias("lats"), F.transform("xs", lambda v: v["x"]).alias("lons"))


def request_axes(requests: DataFrame, index: DataFrame) -> DataFrame:
    """Rows (request_id, kind, variables, run_time, at_hours, n_members, ys, xs, y_first, y_step, x_step, n_cells, error) of snapped boxes and of spots.

    requests has kind, model, run_time, hours, variables, the columns of snap_bounds (null for spots), lat and lon.
    """
    met = requests.join(index, ["model", "run_time"], "left")
    box = F.col("kind") == "gridded"
    hours = F.array_sort(F.array_intersect("hours", "run_hours"))
    ys = F.when(box, F.transform(F.sequence("lat_lo", "lat_hi", "lat_stride"), lambda i: F.get("lats", i))).otherwise(F.array("lat"))
    xs = F.when(box, F.transform(F.sequence(F.lit(0), "lon_span", "lon_stride"), lambda o: F.get("lons", (F.col("lon_w") + o) % F.size("lons")))).otherwise(F.array("lon"))
    met = met.withColumns({"at_hours": hours, "ys": ys, "xs": xs})
    met = met.withColumn("n_cells", F.size("at_hours").cast("long") * F.col("n_members") * F.size("ys") * F.size("xs"))
    error = F.when(F.col("run_hours").isNull(), "no forecast").when(F.size("at_hours") == 0, "none of the hours is in the forecast").when(F.col("n_members").isNull(), "members are not 0..n-1")
    one = F.lit(1)
    return met.select(
        "request_id", "kind", "variables", "run_time", "at_hours", "n_members", "ys", "xs", F.when(box, F.col("lat_lo")).otherwise(0).alias("y_first"),
        F.when(box, F.col("lat_stride")).otherwise(one).alias("y_step"), F.when(box, F.col("lon_stride")).otherwise(one).alias("x_step"), "n_cells", error.alias("error"),
    )


def _coordinates() -> list[Column]:
    """The entries of the four coordinates."""
    run, hours = F.col("run_time").cast("timestamp"), F.col("at_hours")
    day = F.datediff(run, F.lit("1970-01-01").cast("date")) + 719163
    steps = F.transform(hours, lambda h, i: _u(h - F.when(i > 0, F.get(hours, i - 1)).otherwise(0), 4))
    time = F.concat(_u(day, 8), _u(F.unix_seconds(run) - F.unix_seconds(F.date_trunc("day", run)), 8), F.array_join(steps, ""))
    nodes = lambda c: F.array_join(F.transform(c, lambda v: _signed(F.bround(v * 1000))), "")
    return [time, _u(F.col("n_members"), 4), nodes("ys"), nodes("xs")]


def _bins(kind: str, columns: list[str], edges: list[float]) -> list[tuple[Column, int]]:
    """What stands for a cell: (measure, digits) for each part; hexadecimal digits come from `_digits`."""
    first, last = F.col(columns[0]), F.col(columns[-1])
    if kind == "velocity":
        return [(angles.magnitude(first, last), 1), (angles.direction(first, last), 1)]
    if kind == "masked_velocity":
        return [(F.coalesce(angles.magnitude(first, last), F.lit(-1.0)), 1), (F.coalesce(angles.direction(first, last, "to"), F.lit(0.0)), 1)]
    if kind == "circular":
        return [(angles.normalize(F.radians(first), degrees=False), 1)]
    return [(first, 4 if kind == "rounded" else 1)] if kind in ("scalar", "rounded") else []


def _digits(kind: str, part: int, x: Column, edges: list[float]) -> Column:
    """Null for what cannot be sent: a missing value, or a rounded one beyond two bytes."""
    if kind == "rounded":
        whole = F.bround(x)
        return F.when(whole.between(-32768, 32767), _u(whole.cast("long").bitwiseAND(F.lit(0xFFFF)), 4))
    if part == 1 or kind == "circular":
        b = quantize.digitize_circular(x, DIRECTION_EDGES)
    else:
        b = F.least(quantize.digitize(x, MASKED_EDGES if kind == "masked_velocity" else edges), F.lit(15))
    return F.when(x.isNotNull() & ~F.isnan(x), F.substring(F.lit(_HEX), b + 1, F.lit(1)))


def parts_of(columns: list[str], variables: list[str] | None = None) -> dict[str, list[tuple[str, int]]]:
    """Of each variable that the columns allow, and that is among `variables`, the sources (variable, part) of its payload."""
    made = {v[0]: [(v[0], i) for i in range(len(_bins(v[1], v[2], v[4])))] for v in VARIABLES if set(v[2]) <= set(columns) and v[0] not in _COORDINATES}
    by_source = {tuple(v[2]): v[0] for v in VARIABLES if len(v[2]) == 1}
    for v in VARIABLES:
        if v[1] == "combined" and v[0] in made:
            made[v[0]] = [(by_source[(c,)], 0) for c in v[2]]
    return {name: parts for name, parts in made.items() if parts and (variables is None or name in variables)}


def _bit_bytes(bits: Column) -> Column:
    """Hexadecimal digits of a text of 0 and 1, filled up to whole bytes."""
    groups = F.sequence(F.lit(0), F.floor((F.length(bits) - 1) / 32).cast("int"))

    def group(i: Column) -> Column:
        some = F.substring(bits, i * 32 + 1, F.lit(32))
        n = F.ceil(F.length(some) / 8).cast("int")
        return F.lpad(F.conv(F.rpad(some, n * 8, F.lit("0")), 2, 16), n * 2, F.lit("0"))

    return F.array_join(F.transform(groups, group), "")


def _evened(digits: Column) -> Column:
    n = F.length(digits)
    return F.when(n % 2 == 0, digits).otherwise(F.concat(F.substring(digits, F.lit(1), n - 1), F.lit("0"), F.substring(digits, n, F.lit(1))))


def _field(name: str):
    return lambda x: x[name]


def containers(cells: DataFrame, axes: DataFrame, variables: list[str] | None = None, chunk: int = CHUNK, limit: int = LIMIT) -> DataFrame:
    """Rows (request_id, version, container, entries, payloads, total_bytes, missing, error) from cells (request_id, lead_hours, realization, lat_idx, lon_off, columns) and `request_axes`.

    entries are structs (ord, variable, size, masked); payloads maps the asked variables that miss nothing to their bytes, total_bytes
    counts those of all asked variables; missing lists warnings. A request without any of its variables, one whose
    variable is above the limit, and one whose cells do not fill its axes are errors without a container.
    """
    if chunk % 32:
        raise ValueError("chunk must be a multiple of 32")
    made = parts_of(cells.columns, variables)
    kinds = {v[0]: v for v in VARIABLES}
    singles = sorted({p for parts in made.values() for p in parts})
    bytes_of = {name: sum(_bins(kinds[v][1], kinds[v][2], kinds[v][4])[i][1] for v, i in parts) for name, parts in made.items()}
    asked = F.array_intersect("variables", F.array(*[F.lit(v) for v in made]) if made else F.array().cast("array<string>"))
    most = F.greatest(F.lit(0), *[F.when(F.array_contains("variables", name), n).otherwise(0) for name, n in bytes_of.items()]) if made else F.lit(0)
    error = F.coalesce("error", F.when(F.size(asked) == 0, "none of the variables is in the forecast"), F.when(F.col("n_cells") * most > 2 * limit, "variable too large"))
    axes = axes.withColumn("error", error)
    place_of = axes.where("error is null").select("request_id", "at_hours", "n_members", F.size("ys").alias("n_y"), F.size("xs").alias("n_x"), "y_first", "y_step", "x_step")

    met = cells.join(place_of, "request_id")
    nth = lambda c, step: F.expr(f"({c}) div {step}")
    hour = F.array_position("at_hours", F.col("lead_hours")) - 1
    place = ((hour * F.col("n_members") + F.col("realization")) * F.col("n_x") + nth("lon_off", "x_step")) * F.col("n_y") + nth("lat_idx - y_first", "y_step")
    measures, texts, there = {}, {}, {}
    for v, i in singles:
        _, kind, columns, _, edges, *_ = kinds[v]
        measures[f"__m_{v}_{i}"] = _bins(kind, columns, edges)[i][0]
        texts[f"__t_{v}_{i}"] = _digits(kind, i, F.col(f"__m_{v}_{i}"), edges)
    for name, parts in made.items():
        known = F.lit(True)
        for v, i in parts:
            known = known & F.col(f"__t_{v}_{i}").isNotNull()
        there[f"__b_{name}"] = F.when(known, "1").otherwise("0")
    met = met.select("request_id", place.alias("place"), *[m.alias(k) for k, m in measures.items()]).select("request_id", "place", *[t.alias(k) for k, t in texts.items()])
    cell = ["place", *there] + [f"__{name}_{k}" for name, parts in made.items() for k in range(len(parts))]
    met = met.withColumns(there).withColumns({f"__{name}_{k}": F.when(F.col(f"__b_{name}") == "1", F.col(f"__t_{v}_{i}")).otherwise("") for name, parts in made.items() for k, (v, i) in enumerate(parts)})
    pieces = met.groupBy("request_id", F.expr(f"place div {chunk}").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct(*cell))).alias("cells"))
    joined = {c: F.array_join(F.transform("cells", _field(c)), "") for c in cell[1:]}
    inside = F.size(F.array_distinct(F.transform("cells", lambda x: x["place"])))
    pieces = pieces.select("request_id", F.struct("chunk", F.size("cells").cast("long").alias("n"), inside.cast("long").alias("places"), *[t.alias(c) for c, t in joined.items()]).alias("piece"))
    whole = pieces.groupBy("request_id").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))  # of a size below the limit
    add = lambda c: F.aggregate("pieces", F.lit(0).cast("long"), lambda s, p: s + p[c])
    whole = whole.select("request_id", add("n").alias("n"), add("places").alias("places"), *[F.array_join(F.transform("pieces", _field(c)), "").alias(c) for c in joined])

    met = axes.join(whole, "request_id", "left")
    full = (F.col("n") == F.col("n_cells")) & (F.col("places") == F.col("n_cells"))
    met = met.withColumn("error", F.coalesce("error", F.when(~F.coalesce(full, F.lit(False)), "the cells do not fill the request's axes")))
    entries = [F.struct(F.lit(_ORD[n]).alias("ord"), F.lit(n).alias("variable"), F.lit(False).alias("masked"), x.alias("text")) for n, x in zip(_COORDINATES, _coordinates(), strict=True)]
    lacks = []
    for name, parts in made.items():
        bits = F.col(f"__b_{name}")
        n_missing = F.col("n") - F.length(F.replace(bits, F.lit("0"), F.lit("")))
        masked = n_missing > 0
        mask = F.when(masked, _bit_bytes(bits)).otherwise("")
        payload = F.concat(mask, *[_evened(F.col(f"__{name}_{k}")) for k in range(len(parts))])
        wanted = F.array_contains("variables", name)
        entries.append(F.when(wanted, F.struct(F.lit(_ORD[name]).alias("ord"), F.lit(name).alias("variable"), masked.alias("masked"), payload.alias("text"))))
        lacks.append(F.when(wanted & masked, F.concat(F.lit(f"{name} misses "), n_missing.cast("string"), F.lit(" values"))))
    lacks.append(F.when(F.size(F.array_except("variables", asked)) > 0, F.concat(F.lit("not in the forecast: "), F.array_join(F.array_except("variables", asked), ", "))))
    met = met.select("request_id", "error", F.when(F.col("error").isNull(), F.array_sort(F.array_compact(F.array(*entries)))).alias("e"), F.when(F.col("error").isNull(), F.array_compact(F.array(*lacks))).alias("missing"))
    size = lambda x: (F.length(x["text"]) / 2).cast("int")
    one = lambda x: F.concat(_u(x["ord"] + F.when(x["masked"], 128).otherwise(0), 2), _u(size(x), 6), x["text"])
    container = F.unhex(F.concat(_u(F.lit(VERSION), 2), F.array_join(F.transform("e", one), "")))
    listed = F.transform("e", lambda x: F.struct(x["ord"].alias("ord"), x["variable"].alias("variable"), size(x).alias("size"), x["masked"].alias("masked")))
    data = F.filter("e", lambda x: x["ord"] > len(_COORDINATES))
    payloads = F.map_from_entries(F.transform(F.filter(data, lambda x: ~x["masked"]), lambda x: F.struct(x["variable"].alias("variable"), F.unhex(x["text"]).alias("packed"))))
    total = F.aggregate(data, F.lit(0).cast("long"), lambda t, x: t + size(x))
    return met.select("request_id", F.lit(VERSION).alias("version"), container.alias("container"), listed.alias("entries"), payloads.alias("payloads"), total.alias("total_bytes"), "missing", "error")


@F.pandas_udf(BinaryType())
def deflated(raw: pd.Series) -> pd.Series:
    """Compressed as for the mail; the only Python here, on finished containers."""
    return raw.map(lambda x: None if x is None else zlib.compress(x, 9))


@F.pandas_udf(BinaryType())
def inflated(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: None if x is None else zlib.decompress(x))


def read_entries(answers: DataFrame) -> DataFrame:
    """Rows (request_id, variable, masked, text) of containers: each entry's bytes as hexadecimal digits; another version is an error."""
    text = F.hex("container")
    number = lambda a, n: F.conv(F.substring(text, a, F.lit(n)), 16, 10).cast("int")
    start = F.struct(F.lit(3).alias("at"), F.array().cast("array<struct<ord: int, masked: boolean, text: string>>").alias("out"))

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        n = number(at + 2, 6) * 2
        got = F.struct((number(at, 2) % 128).alias("ord"), (number(at, 2) >= 128).alias("masked"), F.substring(text, at + 8, n).alias("text"))
        more = at < F.length(text)
        return F.struct(F.when(more, at + 8 + n).otherwise(at).alias("at"), F.when(more, F.concat(s["out"], F.array(got))).otherwise(s["out"]).alias("out"))

    version = F.when(number(F.lit(1), 2) != VERSION, F.raise_error(F.lit("unknown version of a container")))
    steps = F.sequence(F.lit(1), F.lit(len(VARIABLES)))
    rows = answers.where("container is not null").select("request_id", F.coalesce(version.cast("int"), F.lit(0)).alias("v"), F.aggregate(steps, start, step, lambda s: s["out"]).alias("out"))
    names = F.create_map(*[F.lit(x) for n, o in _ORD.items() for x in (o, n)])
    rows = rows.where("v = 0").select("request_id", F.explode("out").alias("e"))
    return rows.select("request_id", F.element_at(names, F.col("e.ord")).alias("variable"), "e.masked", "e.text")


def read_cells(answers: DataFrame) -> DataFrame:
    """Rows (request_id, variable, part, lead_hours, realization, latitude, longitude, bin) of containers, from their bytes alone.

    bin is a bin or a rounded value, null where it is missing; part counts the parts of a velocity or of the wave.
    """
    rows = read_entries(answers)
    is_coordinate = F.col("variable").isin(_COORDINATES)
    own = rows.where(is_coordinate).groupBy("request_id").agg(*[F.max(F.when(F.col("variable") == c, F.col("text"))).alias(c) for c in _COORDINATES])

    def numbers(text: Column, start: int, digits: int) -> Column:
        n = ((F.length(text) - start) / digits).cast("int")
        every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(every, lambda i: F.conv(F.substring(text, i * digits + start + 1, F.lit(digits)), 16, 10).cast("long"))

    steps = numbers(F.col("time"), 16, 4)
    hours = F.transform(steps, lambda _, i: F.aggregate(F.slice(steps, F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, x: s + x).cast("int"))
    degrees = lambda c: F.transform(numbers(F.col(c), 0, 8), lambda v: F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v) / 1000.0)
    own = own.select("request_id", hours.alias("hours"), F.conv("realization", 16, 10).cast("int").alias("n_members"), degrees("latitude").alias("ys"), degrees("longitude").alias("xs"))
    own = own.withColumn("n", F.size("hours") * F.col("n_members") * F.size("ys") * F.size("xs"))
    kind = {v[0]: v[1] for v in VARIABLES}
    n_parts = F.when(F.col("variable").isin([v for v, k in kind.items() if k in ("velocity", "masked_velocity", "combined")]), 2).otherwise(1)
    wide = F.when(F.col("variable").isin([v for v, k in kind.items() if k == "rounded"]), 4).otherwise(1)
    data = rows.where(~is_coordinate).join(own, "request_id").withColumns({"n_parts": n_parts, "wide": wide})
    n_bits = F.when(F.col("masked"), F.ceil(F.col("n") / 8) * 2).otherwise(0).cast("int")
    data = data.withColumn("n_bits", n_bits).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("place"))
    nibble = F.conv(F.substring("text", F.floor(F.col("place") / 4).cast("int") + 1, F.lit(1)), 16, 10).cast("int")
    there = F.when(F.col("masked"), F.expr("shiftright(__nibble, 3 - place % 4) & 1")).otherwise(1)
    data = data.withColumn("__nibble", nibble).withColumn("there", there)
    upto = Window.partitionBy("request_id", "variable")
    data = data.withColumns({"k": F.sum("there").over(upto.orderBy("place")) - F.col("there"), "n_there": F.sum("there").over(upto)}).select("*", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"))
    one = F.col("n_there") * F.col("wide")
    odd = one % 2 == 1
    start = F.col("n_bits") + F.col("part") * (one + F.when(odd, 1).otherwise(0)) + F.col("k") * F.col("wide") + F.when(odd & (F.col("k") == F.col("n_there") - 1), 1).otherwise(0)
    raw = F.conv(F.substring("text", (start + 1).cast("int"), F.col("wide")), 16, 10).cast("int")
    value = F.when((F.col("wide") == 4) & (raw >= 1 << 15), raw - (1 << 16)).otherwise(raw)
    n_y, n_x = F.size("ys"), F.size("xs")
    nth = lambda over, n: F.floor(F.col("place") / over).cast("int") % n
    return data.select(
        "request_id", "variable", "part", F.get("hours", F.floor(F.col("place") / (n_y * n_x * F.col("n_members"))).cast("int")).alias("lead_hours"), nth(n_y * n_x, F.col("n_members")).alias("realization"),
        F.get("ys", F.col("place") % n_y).alias("latitude"), F.get("xs", nth(n_y, n_x)).alias("longitude"), F.when(F.col("there") == 1, value).alias("bin"),
    )
