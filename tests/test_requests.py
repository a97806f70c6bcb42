from __future__ import annotations

from pyspark.sql import functions as F

from seagrid.operators import requests as rq

HOURS = [
    ("0,3...12,24", [0, 3, 6, 9, 12, 24]), ("0,3...,12,24", [0, 3, 6, 9, 12, 24]), ("0,3,...12,24", [0, 3, 6, 9, 12, 24]), ("0,3,...,12,24", [0, 3, 6, 9, 12, 24]),
    ("0, 3...12, 24", [0, 3, 6, 9, 12, 24]), ("0,12...72", [0, 12, 24, 36, 48, 60, 72]), ("6,12,18,24,36,48,72,96", [6, 12, 18, 24, 36, 48, 72, 96]),
    ("0,3...8", None), ("12,24,36...82,92", None), ("0..144", None), ("6..18", [6, 12, 18]), ("a,b", None),
]
DOMAINS = [
    ("10n,10s,10e,20e", (10.0, -10.0, 20.0, 10.0)), ("10s,10n,20e,10e", (10.0, -10.0, 20.0, 10.0)), ("10n,10s,10w,20e", (10.0, -10.0, 20.0, -10.0)),
    ("10n,20n,10w,20e", (20.0, 10.0, 20.0, -10.0)), ("10n,20n,170w,170e", (20.0, 10.0, -170.0, 170.0)), ("10n,20n,170e,170w", (20.0, 10.0, -170.0, 170.0)),
    ("10n,20n,190e,170e", (20.0, 10.0, -170.0, 170.0)), ("10n,20n,-125e,120w", (20.0, 10.0, -120.0, -125.0)),
    ("100n,10s,10e,20e", None), ("10#,10s,10e,20e", None), ("10e,10s,10e,20e", None), ("10n,10s,10n,20e", None), ("10n,10e", None), ("10n,10s,10e,400e", None), ("10n,10,10e,20e", None),
]
STEPS = list(range(0, 121, 3))
GRIDDED = [
    ("send gfs:14s,20s,154w,146w|0.5,0.5|0,3..120|wind", 0.5, STEPS),
    ("send gfs:14s,20s,154w,146w|0.5,0.5|0,3..120", 0.5, STEPS),
    ("send gfs:14s,20s,154w,146wś0.5,0.5".replace("ś", "Ś"), 0.5, [24, 48, 72]),
    ("send gfs:14s,20s,154w,146w", None, [24, 48, 72]),
    ("send gfs : 14s,20s,154w, 146w/  0.5, 0.5 |0, 3.. 120| wind,", 0.5, STEPS),
    ("send gfs : 14s,20s,154w, 146w/  0.5 |0, 3.. 120| wind,", 0.5, STEPS),
    ("send gfs : 14s,20s,154w, 146w/  native |0, 3.. 120| wind,", None, STEPS),
]
SPOTS = [
    ("send spot:20s,154w", -20.0, -154.0, list(range(0, 121, 6)), False),
    ("send spot:20s,154w|4,3", -20.0, -154.0, list(range(0, 97, 3)), False),
    ("send spot: 20s,154w |4 ,3", -20.0, -154.0, list(range(0, 97, 3)), False),
    ("send spot:20s,154w|4,3|wind|image", -20.0, -154.0, list(range(0, 97, 3)), True),
    ("send spot:26s,32.9e|0,3..180|wind", -26.0, 32.9, list(range(0, 181, 3)), False),
]


def _parsed(spark, texts):
    rows = [(i, i, t) for i, t in enumerate(texts)]
    return {r["request_id"]: r for r in rq.parse_requests(spark.createDataFrame(rows, "request_id int, msg_id int, text string")).collect()}


def test_hours(spark):
    df = spark.createDataFrame(HOURS, "t string, x array<int>")
    for t, x, got in df.select("t", "x", rq.expand_hours(F.col("t"))).collect():
        assert got == x, t


def test_domains(spark):
    df = spark.createDataFrame([(t,) for t, _ in DOMAINS], "t string")
    got = {r["t"]: r["d"] for r in df.select("t", rq.parse_domain(F.col("t")).alias("d")).collect()}
    for t, x in DOMAINS:
        if x is None:
            assert got[t]["error"] and got[t]["n"] is None, t
        else:
            assert got[t]["error"] is None and tuple(got[t])[:4] == x, t


def test_resolutions(spark):
    rows = [("0.5,0.5", 0.5, False), ("native", None, False), ("1.0,0.5", 1.0, False), ("2,2", 2.0, False), (None, None, False), ("", None, False), ("0.6,0.5,0.7", None, True), ("x", None, True)]
    df = spark.createDataFrame(rows, "t string, x double, bad boolean")
    value, _, error = rq.parse_resolution(F.col("t"))
    for t, x, bad, got, err in df.select("t", "x", "bad", value, error).collect():
        assert got == x and (err is not None) == bad, t


def test_variables(spark):
    rows = [(0, " wind "), (1, ""), (2, None), (3, "Wave_Height,doradodensity"), (4, "doradodensity"), (5, "press,temp,wind,wind")]
    got = {r["request_id"]: r for r in rq.resolve_variables(spark.createDataFrame(rows, "request_id int, variables_text string")).collect()}
    assert got[0]["variables"] == ["wind"] and got[1]["variables"] == ["wind"] and got[2]["variables"] == ["wind"]
    assert got[3]["variables"] == ["waveheight"] and got[3]["unknown"] == ["doradodensity"] and got[3]["error"] is None
    assert got[4]["variables"] is None and got[4]["error"]
    assert got[5]["variables"] == ["pressure", "temperature", "wind"]


def test_gridded_requests(spark):
    got = _parsed(spark, [t for t, *_ in GRIDDED])
    for i, (t, resolution, hours) in enumerate(GRIDDED):
        r = got[i]
        assert r["error"] is None, (t, r)
        assert (r["kind"], r["model"], r["n"], r["s"], r["w"], r["e"]) == ("gridded", "gfs", -14.0, -20.0, -154.0, -146.0), t
        assert r["resolution"] == resolution and r["hours"] == hours and r["variables"] == ["wind"], t


def test_spot_requests(spark):
    got = _parsed(spark, [t for t, *_ in SPOTS])
    for i, (t, lat, lon, hours, image) in enumerate(SPOTS):
        r = got[i]
        assert r["error"] is None, (t, r)
        assert (r["kind"], r["model"], r["lat"], r["lon"], r["send_image"]) == ("spot", "gefs", lat, lon, image), t
        assert r["hours"] == hours and r["variables"] == ["wind"], t


def test_faults_stay_with_their_request(spark):
    got = _parsed(spark, ["send gefs:100n,1n,1e,2e", "fetch gefs:1n,2n,1e,2e", "send abc:1n,2n,1e,2e", "send gefs:1n,2n,1e,2e|||wind opt=1 more", "send gfsens:1n,2n,1e,2e"])
    assert got[0]["error"] == "latitude out of range" and got[1]["error"] == "unknown command" and got[2]["error"] == "unknown model"
    assert got[3]["error"] is None and "options ignored" in got[3]["warnings"]
    assert got[4]["error"] is None and got[4]["model"] == "gefs"


def test_lines_and_quarantine(spark):
    messages = spark.createDataFrame([(1, "Hi\nSend gfs:1n,2n,1e,2e\n send spot:1n,1e\nbye"), (2, "nothing"), (3, None), (4, "send gfs:1n")], "msg_id int, body string")
    lines = rq.extract_request_lines(messages).withColumn("request_id", F.col("msg_id") * 10 + F.col("line_no"))
    assert sorted((r["msg_id"], r["text"]) for r in lines.collect()) == [(1, "send gfs:1n,2n,1e,2e"), (1, "send spot:1n,1e"), (4, "send gfs:1n")]
    good, bad = rq.quarantine(rq.parse_requests(lines), messages, lines)
    assert good.count() == 2
    assert sorted((r["msg_id"], r["error"]) for r in bad.collect()) == [(2, "no request found"), (3, "no request found"), (4, "expected 2 latitudes and 2 longitudes")]
