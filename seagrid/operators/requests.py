"""From a log of text messages to a typed table of requests, set at a time and in native expressions.

Soft problems become entries of `warnings`, hard ones `error`; each request is judged alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seagrid.functions import angles
from seagrid.sources.dims import VARIABLES, alias_rows, model_alias_dim

SEPARATOR = "[|/Ś]"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)$"


def extract_request_lines(messages: DataFrame) -> DataFrame:
    """Rows (msg_id, line_no, text): the lines of each body, in lower case, that ask for something."""
    lines = messages.select("msg_id", F.posexplode(F.split(F.lower("body"), "\n")).alias("line_no", "line"))
    asked = F.regexp_extract("line", r"^\s*(send\s.+)\s*", 1)
    return lines.select("msg_id", "line_no", F.trim(asked).alias("text")).where("text <> ''")


def split_fields(text: Column, k: int) -> list[Column]:
    """The first k fields, blanks eaten; null where there are fewer."""
    parts = F.split(text, rf"\s*{SEPARATOR}\s*")
    return [F.trim(F.get(parts, F.lit(i))) for i in range(k)]


def split_command(text: Column) -> tuple[Column, Column, Column]:
    """(command, body, warning): the first blank parts them, blanks in the body go, and so do tokens from the
    first with `=` on, with a warning."""
    tokens = F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")
    command, rest = F.get(tokens, F.lit(0)), F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1)))
    option = F.array_position(F.transform(rest, lambda t: t.contains("=")), True)
    kept = F.when(option > 0, F.slice(rest, F.lit(1), (option - 1).cast("int"))).otherwise(rest)
    return command, F.array_join(kept, ""), F.when(option > 0, F.lit("options ignored"))


def route_request(lines: DataFrame) -> DataFrame:
    """Rows with kind, model, fields (array), warnings, error from rows (text).

    `model:fields` is a gridded request, `spot:[model:]fields` a spot request, gefs by default.
    """
    command, body, warning = split_command(F.col("text"))
    heads = F.split("body", ":")
    spot = F.element_at(heads, 1) == "spot"
    asked = F.when(spot, F.when(F.size(heads) > 2, F.element_at(heads, 2)).otherwise("gefs")).when(F.size(heads) > 1, F.element_at(heads, 1))
    rest = F.element_at(heads, -1)
    got = lines.withColumns({"command": command, "body": body, "warning": warning})
    got = got.withColumns({"kind": F.when(spot, "spot").otherwise("gridded"), "asked_model": asked, "fields": F.split(rest, rf"\s*{SEPARATOR}\s*")})
    got = got.join(F.broadcast(model_alias_dim(lines.sparkSession)), F.col("asked_model") == F.col("alias"), "left").drop("alias")
    error = F.when(F.col("command") != "send", "unknown command").when(F.col("model").isNull(), "unknown model")
    return got.withColumns({"warnings": F.array_compact(F.array("warning")), "error": error}).drop("warning", "command", "body")


def _corner(c: Column) -> tuple[Column, Column]:
    """(value, axis) of one corner such as 35n or -125e; south and west negate."""
    side = F.regexp_extract(c, r"^[+-]?[0-9.]+([nsew])$", 1)
    number = F.regexp_extract(c, r"^([+-]?[0-9.]+)[nsew]$", 1).try_cast("double")
    value = F.round(F.when(side.isin("s", "w"), -number).otherwise(number), 8)
    return value, F.when(side.isin("n", "s"), "lat").when(side.isin("e", "w"), "lon")


def _corners(text: Column) -> Column:
    def read(c: Column) -> Column:
        value, axis = _corner(c)
        return F.struct(value.alias("v"), axis.alias("axis"))

    return F.transform(F.split(text, ","), read)


def _of(corners: Column, axis: str) -> Column:
    return F.transform(F.filter(corners, lambda c: (c["axis"] == axis) & c["v"].isNotNull()), lambda c: c["v"])


def _bad(lats: Column, lons: Column, n: int) -> Column:
    return (
        F.when((F.size(lats) != n) | (F.size(lons) != n), f"expected {n} latitudes and {n} longitudes")
        .when(F.exists(lats, lambda v: ~v.between(-90, 90)), "latitude out of range")
        .when(F.exists(lons, lambda v: ~v.between(-180, 360)), "longitude out of range")
    )


def _domain_of(corners: Column) -> Column:
    lats, lons = F.array_sort(_of(corners, "lat")), angles.sorted_circular(F.transform(_of(corners, "lon"), lambda v: F.round(angles.normalize(v), 8)))
    error = F.coalesce(_bad(_of(corners, "lat"), _of(corners, "lon"), 2), F.when(F.size(corners) != 4, "expected four corners"))
    ok = error.isNull()
    pick = lambda a, i: F.when(ok, F.get(a, F.lit(i)))
    return F.struct(pick(lats, 1).alias("n"), pick(lats, 0).alias("s"), pick(lons, 1).alias("e"), pick(lons, 0).alias("w"), error.alias("error"))


def parse_domain(text: Column) -> Column:
    """struct (n, s, e, w, error) of a box given by four corners in any order."""
    return _domain_of(_corners(text))


def _location_of(corners: Column) -> Column:
    error = F.coalesce(_bad(_of(corners, "lat"), _of(corners, "lon"), 1), F.when(F.size(corners) != 2, "expected two coordinates"))
    lat, lon = F.get(_of(corners, "lat"), F.lit(0)), F.round(angles.normalize(F.get(_of(corners, "lon"), F.lit(0))), 8)
    return F.struct(F.when(error.isNull(), lat).alias("lat"), F.when(error.isNull(), lon).alias("lon"), error.alias("error"))


def parse_location(text: Column) -> Column:
    """struct (lat, lon, error) of one latitude and one longitude in either order."""
    return _location_of(_corners(text))


def expand_hours(text: Column) -> Column:
    """An array of hours from a list with ellipses, null if it is malformed.

    `a,b..c` goes on from b in steps of b - a to c, which the steps must meet; `b..c` first steps by b.
    """
    tidy = F.regexp_replace(F.regexp_replace(text, r"\s+", ""), r",*\.\.+,*", "..")
    state = "struct<prev:bigint,out:array<bigint>,bad:boolean>"

    def part(token: Column, nth: int) -> Column:
        return F.substring_index(token, "..", nth).try_cast("bigint")

    def read(token: Column) -> Column:
        dots = F.length(token) - F.length(F.replace(token, F.lit(".."), F.lit("")))
        return F.struct(part(token, 1).alias("first"), part(token, -1).alias("last"), dots.alias("dots"))

    def step(acc: Column, token: Column) -> Column:
        first, last = token["first"], token["last"]
        gap = first - acc["prev"]
        run = (token["dots"] == 2) & (gap > 0) & (last >= first) & ((last - first) % F.nullif(gap, F.lit(0)) == 0)
        one = F.when(token["dots"] == 0, F.array(first)).when(run, F.sequence(first, last, F.nullif(gap, F.lit(0))))
        broken = acc["bad"] | one.isNull() | first.isNull() | last.isNull()
        return F.struct(F.coalesce(last, F.lit(0)).alias("prev"), F.concat(acc["out"], F.coalesce(one, F.array().cast("array<bigint>"))).alias("out"), F.coalesce(broken, F.lit(True)).alias("bad")).cast(state)

    start = F.struct(F.lit(0).alias("prev"), F.array().cast("array<bigint>").alias("out"), F.lit(False).alias("bad")).cast(state)
    tokens = F.transform(F.split(tidy, ","), read)
    return F.aggregate(tokens, start, step, lambda got: F.when(~got["bad"], got["out"].cast("array<int>")))


def expand_days_interval(text: Column) -> tuple[Column, Column]:
    """(hours, warning) from `days,interval`, 5,6 by default; what is no such pair is read as a list of hours."""
    text = F.coalesce(F.nullif(text, F.lit("")), F.lit("5,6"))
    parts = F.split(text, ",")
    days, gap = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    pair = (F.size(parts) == 2) & days.isNotNull() & (gap > 0) & (days > 0) & ~text.contains("..")
    hours = F.when(F.coalesce(pair, F.lit(False)), F.sequence(F.lit(0), 24 * days, F.when(gap > 0, gap).otherwise(1))).otherwise(expand_hours(text))
    warning = F.when(F.coalesce(pair, F.lit(False)) & ((gap < 3) | (days > 14)), F.lit("very long or very fine forecast"))
    return hours, warning


def parse_resolution(text: Column) -> tuple[Column, Column, Column]:
    """(resolution, warning, error): null for `native` or blank, one number, or the larger of two."""
    parts = F.transform(F.split(text, ","), lambda p: p.try_cast("double"))
    native = text.isNull() | (text == "") | (text == "native")
    error = F.when(~native & ((F.size(parts) > 2) | F.exists(parts, lambda p: p.isNull())), F.lit("bad resolution"))
    value = F.when(~native & error.isNull(), F.array_max(F.transform(parts, lambda p: F.abs(p))))
    warning = F.when(~native & error.isNull() & (F.size(F.array_distinct(parts)) > 1), F.lit("resolutions differ, the larger is used"))
    return value, warning, error


def _names_met(text: Column) -> Column:
    """Array of structs (name, variable) of the names in a comma-separated list; the variable is null for an unknown one."""
    table = F.create_map(*[F.lit(x) for pair in alias_rows() for x in pair])
    names = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.lower(F.trim(x)))
    find = lambda x: F.coalesce(F.try_element_at(table, x), F.try_element_at(table, F.regexp_replace(x, r"[\W_]", "")))
    return F.transform(F.array_distinct(F.filter(names, lambda x: x != "")), lambda x: F.struct(x.alias("name"), find(x).alias("variable")))


def _resolved(met: Column) -> tuple[Column, Column, Column]:
    """(variables, unknown, error) of the names met."""
    found = F.sort_array(F.array_distinct(F.array_compact(F.transform(met, lambda x: x["variable"]))))
    unknown = F.sort_array(F.transform(F.filter(met, lambda x: x["variable"].isNull()), lambda x: x["name"]))
    none = F.size(found) == 0
    return F.when(~none, found).when(F.size(met) == 0, F.array(F.lit("wind"))), unknown, F.when(none & (F.size(met) > 0), F.lit("no known variable"))


def resolve_variables(requests: DataFrame, key: str = "request_id", text: str = "variables_text") -> DataFrame:
    """Rows (key, variables, unknown, error): the variables of a comma-separated list, by name or alias.

    Nothing asked means wind; unknown names are listed; nothing known is an error.
    """
    variables, unknown, error = _resolved(F.col("met"))
    return requests.select(key, _names_met(F.col(text)).alias("met")).select(key, variables.alias("variables"), unknown.alias("unknown"), error.alias("error"))


def parse_requests(lines: DataFrame) -> DataFrame:
    """Typed requests from rows (request_id, msg_id, text).

    request_id, msg_id, kind, model, n, s, e, w, lat, lon, resolution, hours, variables, send_image, warnings, error.
    Requests repeat, so each text is parsed once: the texts that differ are counted out in partial aggregation, and what they mean is
    joined back. The join is an ordinary one, which Spark turns into a broadcast where texts are few and splits where one is hot.
    """
    texts = lines.select("text").distinct().withColumns({"request_id": F.lit(0), "msg_id": F.lit(0)})
    meant = parse_lines(texts, "text").drop("request_id", "msg_id").withColumnRenamed("text", "__text")
    met = lines.select("request_id", "msg_id", "text").join(meant, F.col("text").eqNullSafe(F.col("__text")), "left")
    return met.drop("text", "__text")


def parse_lines(lines: DataFrame, *keep: str) -> DataFrame:
    """The same line by line, with some columns kept: a projection, without a shuffle."""
    field = lambda i: F.get("fields", F.lit(i))
    spot = F.col("kind") == "spot"
    value, r_warning, r_error = parse_resolution(field(1))
    hours, d_warning = expand_days_interval(field(1))
    grid_text = F.coalesce(F.nullif(field(2), F.lit("")), F.lit("24,48,72"))
    got = route_request(lines).withColumns({"corners": _corners(field(0)), "met": _names_met(F.when(spot, field(2)).otherwise(field(3)))})
    variables, unknown, v_error = _resolved(F.col("met"))
    got = got.withColumns(
        {
            "box": F.when(~spot, _domain_of(F.col("corners"))),
            "place": F.when(spot, _location_of(F.col("corners"))),
            "resolution": F.when(~spot, value),
            "hours": F.when(spot, hours).otherwise(expand_hours(grid_text)),
            "variables": variables,
            "unknown": F.transform(unknown, lambda u: F.concat(F.lit("unknown variable "), u)),
            "send_image": F.coalesce(F.exists(F.slice("fields", 4, F.greatest(F.size("fields"), F.lit(1))), lambda f: f == "image"), F.lit(False)),
            "more": F.array_compact(F.array(F.when(~spot, r_warning), F.when(spot, d_warning), F.when(~spot & (F.coalesce(field(2), F.lit("")) == ""), F.lit("no hours given, 24,48,72 used")))),
            "r_error": F.when(~spot, r_error),
            "v_error": v_error,
        }
    )
    error = F.coalesce(F.col("error"), F.when(spot, F.col("place.error")).otherwise(F.col("box.error")), F.when(F.col("hours").isNull(), F.lit("bad hours")), F.col("r_error"), F.col("v_error"))
    return got.select(
        "request_id", "msg_id", *keep, "kind", "model",
        *[F.col(f"box.{c}").alias(c) for c in "nsew"],
        *[F.col(f"place.{c}").alias(c) for c in ("lat", "lon")],
        "resolution", "hours", "variables", "send_image", F.concat("warnings", "more", "unknown").alias("warnings"), error.alias("error"),
    )


def keyvalue_requests(messages: DataFrame) -> DataFrame:
    """Rows (msg_id, domain, resolution, hours, variables_text, model, ignored): the format of one `key: value` a line.

    Lines without a separator are variables; keys other than those known are counted as ignored.
    """
    names = {"area": "domain", "domain": "domain", "resol": "resolution", "grid": "resolution", "resolution": "resolution", "days": "days", "hours": "hours"}
    lines = messages.select("msg_id", F.explode(F.split(F.lower("body"), "\n")).alias("line")).withColumn("line", F.trim("line")).where("line <> ''")
    parts = F.split("line", "[:=;]", 2)
    key = F.trim(F.element_at(parts, 1))
    known = F.coalesce(*[F.when(key == k, v) for k, v in names.items()], F.lit("ignored"))
    rows = lines.select("msg_id", F.when(F.size(parts) == 1, "variable").otherwise(known).alias("key"), F.when(F.size(parts) == 1, F.col("line")).otherwise(F.trim(F.element_at(parts, 2))).alias("value"))
    got = rows.groupBy("msg_id").pivot("key", ["domain", "resolution", "days", "hours", "variable", "ignored"]).agg(F.sort_array(F.collect_list("value")).alias("v"))
    one = lambda c: F.get(c, F.lit(0))
    days, gap = one("days").try_cast("int"), one("hours").try_cast("int")
    hours = F.when((days > 0) & (gap > 0), F.sequence(F.lit(0), F.when(days > 0, 24 * days).otherwise(0), F.when(gap > 0, gap).otherwise(1)))
    return got.select("msg_id", one("domain").alias("domain"), one("resolution").alias("resolution"), hours.alias("hours"), F.array_join("variable", ",").alias("variables_text"), F.lit("gfs").alias("model"), F.coalesce(F.size("ignored"), F.lit(0)).alias("ignored"))


def quarantine(requests: DataFrame, messages: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good requests, rejected): rejected rows have msg_id, request_id, text, error, warnings; so have messages without a request."""
    good = requests.where("error is null")
    bad = requests.where("error is not null").join(lines.select("request_id", "text"), "request_id").select("msg_id", "request_id", "text", "error", "warnings")
    silent = messages.join(lines.select("msg_id").distinct(), "msg_id", "left_anti")
    silent = silent.select("msg_id", F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"), F.col("body").alias("text"), F.lit("no request found").alias("error"), F.array().cast("array<string>").alias("warnings"))
    return good, bad.unionByName(silent)


def request_summary(requests: DataFrame) -> DataFrame:
    """Rows (request_id, summary)."""
    place = F.when(F.col("kind") == "spot", F.format_string("%6.2f,%6.2f", "lat", "lon")).otherwise(F.format_string("%6.2f,%6.2f,%6.2f,%6.2f", "n", "s", "e", "w"))
    return requests.select("request_id", F.format_string("%s %s %s %d-%d Hours", "kind", "model", place, F.array_min("hours"), F.array_max("hours")).alias("summary"))


def available_variables(forecast: DataFrame) -> DataFrame:
    """Rows (model, run_time, variable): variables all of whose source columns have values in the run."""
    own = set(forecast.columns)
    known = [(v[0], v[2]) for v in VARIABLES if set(v[2]) <= own and v[1] not in ("time", "trivial")]
    columns = sorted({c for _, cs in known for c in cs})
    got = forecast.groupBy("model", "run_time").agg(*[(F.count(c) > 0).alias(c) for c in columns])
    every = [F.when(F.forall(F.array(*[F.col(c) for c in cs]), lambda x: x), F.lit(v)) for v, cs in known]
    return got.select("model", "run_time", F.explode(F.array_compact(F.array(*every))).alias("variable"))


def the_variable(available: DataFrame) -> DataFrame:
    """Rows (model, run_time, variable, error): the one variable of each run besides its coordinates; several are an error."""
    own = F.when(~F.col("variable").isin("latitude", "longitude"), F.col("variable"))
    got = available.groupBy("model", "run_time").agg(F.min(own).alias("variable"), F.countDistinct(own).alias("n"))
    error = F.when(F.col("n") > 1, "several variables").when(F.col("n") == 0, "no variable")
    return got.select("model", "run_time", F.when(F.col("n") == 1, F.col("variable")).alias("variable"), error.alias("error"))


def delivery_policy(payloads: DataFrame, limit: int = 25_000) -> DataFrame:
    """payloads (sender, payload) with extension and rejected."""
    small = F.lower("sender").contains("sailmail") & (F.octet_length("payload") > limit)
    return payloads.withColumns({"extension": F.when(F.lower("sender").contains("iridium"), "zip").otherwise("fcst"), "rejected": F.coalesce(small, F.lit(False))})
