"""Event time: epoch detection, dates, carried time, resolution, age."""

import random
import time
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from tidelog.functions.timefmt import (detect_epoch, epoch_seconds, shapes_of, unmatched_shapes, wire_to_timestamp, with_parsed_date,
                                       zone_abbreviations)
from tidelog.operators.envelope import carry_forward, carry_time, now_column, resolve_time, two_passes
from tidelog.operators.filters import too_old


def test_epoch_detection(spark):
    cases = {
        "1545407742757": "1545407742.757",
        "1545407742757659": "1545407742.757659",
        "1542551942.94": "1542551942",
        "  1545407742": "1545407742",
        "20181206 04:02": "20181206",
        "123456": None,
        "abc": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r["v"]: r["w"] for r in df.select("v", detect_epoch(F.col("v")).alias("w")).collect()}
    assert got == cases
    r = spark.range(1).select(F.unix_micros(wire_to_timestamp(F.lit("1545407742.757659984"))).alias("us"),
                              epoch_seconds(F.lit("1545407742.9")).alias("s"), epoch_seconds(F.lit("soon")).alias("x"))
    assert r.first() == (1545407742757659, 1545407742, None)


def _parsed(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    return [r["s"] for r in with_parsed_date(df, F.col("v"), "p", **options).select("i", F.unix_seconds("p").alias("s")).orderBy("i").collect()]


def test_date_parse_with_zone(spark):
    assert _parsed(spark, ["2018-12-06 04:02:27", "Dec 21, 2018 10:55:42 EST", "junk", None, ""]) == [1544068947, 1545407742, None, None, None]
    forms = ["2018-12-06T04:02:27Z", "2018-12-06T06:02:27+02:00", "2018-12-06T04:02:27.757Z", "06/Dec/2018:04:02:27 +0000", "Dec  6 04:02:27 2018",
             "Thu Dec  6 04:02:27 2018", "Thu, 06 Dec 2018 04:02:27 +0000", "12/06/2018 04:02:27", "Thu, 6 Dec 2018 00:02:27 -0400 (AST)",
             "Thu Dec  6 04:02:27 UTC 2018", "06 December 2018 04:02:27", "20181206T040227Z", "Dec  6 04:02:27", "12/06/18 04:02:27", "12/6/2018 4:02:27 am",
             "2018-12-06 09:32:27+0530", "2018-12-05 23:02:27 -05"]
    assert _parsed(spark, forms, year=2018) == [1544068947] * len(forms)
    minutes = ["6 Dec 2018 4:02 AM", "Dec. 6, 2018 4:02AM", "December 6 2018 04:02", "20181206T0402", "Dec 6 04:02", "12/06/18 4:02 a.m.", "Dec 6 2018 3:02 PM PST"]
    assert _parsed(spark, minutes, year=2018) == [1544068920] * 6 + [1544137320]
    assert _parsed(spark, ["6 Dec 2018", "Dec 6 2018", "Dec 6, 2018", "2018-12-06", "12/06/18", "20181206", "2018/12/6"]) == [1544054400] * 7
    assert _parsed(spark, ["12/06/75 00:00", "12/06/67 00:00"], year=2018) == [187056000, 3090355200]
    assert spark.range(1).select(epoch_seconds(F.lit("1.5454077E9"))).first()[0] == 1545407700
    assert _parsed(spark, ["Dec 21, 2018 10:55:42 EST"], legacy_wall_clock=True) == [1545407742 - 5 * 3600]
    assert _parsed(spark, ["Dec 21, 2018 10:55:42 EST", "Dec 21, 2018 10:55:42 ABC"], zones={"ABC": "+01:00"}) == [None, 1545386142]


def test_zones_follow_the_date(spark):
    noon = {"2012-07-01 12:00:00 MSK": 8, "2020-07-01 12:00:00 MSK": 9, "2020-07-01 12:00:00 BST": 11, "2020-01-01 12:00:00 BST": 12,
            "2020-07-01 12:00:00 CET": 10, "2020-01-01 12:00:00 CET": 11, "2020-01-01 12:00:00 CEST": 11, "Jul 1 2020 12:00:00 PST": 19}
    got = _parsed(spark, list(noon))
    assert [x % 86400 // 3600 for x in got] == list(noon.values())
    # the hour that the clocks repeat, and one that they leave out
    assert _parsed(spark, ["2020-11-01 01:30:00 EDT", "2020-11-01 01:30:00 EST", "2020-03-08 02:30:00 EST"]) == [1604208600, 1604212200, 1583652600]


def test_zones_against_the_database(spark):
    rng = random.Random(5)
    texts, want = [], []
    for abbr in ("CET", "CEST", "BST", "EST", "EDT", "PST", "EET"):
        rules = zone_abbreviations()[abbr]
        for _ in range(40):
            wall = datetime(rng.randint(1975, 2030), rng.randint(1, 12), rng.randint(1, 28), rng.randint(4, 23), rng.randint(0, 59))
            zone = [r for r in rules if r[0] <= wall.year][-1][1]
            texts.append(f"{wall:%Y-%m-%d %H:%M:%S} {abbr}")
            want.append(int(wall.replace(tzinfo=ZoneInfo(zone)).timestamp()))
    assert _parsed(spark, texts) == want


def test_shapes_without_a_format(spark):
    texts = ["2020-02-30", "junk", "more junk", "2020-01-01", "5th of May", None, "2020-07-01 12:00:00 XYZ", "7th of May"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = sorted(map(tuple, unmatched_shapes(df, F.col("v")).collect()))
    assert got == [("0000-n-n", 1, "2020-02-30"), ("0000-n-n n:n:n A", 1, "2020-07-01 12:00:00 XYZ"), ("A", 1, "junk"), ("A A", 1, "more junk"),
                   ("nA A A", 2, "5th of May")]
    assert shapes_of("MMM d[ h:mm a]['T'H:mm:ss]") == ["A n", "A n n:n A", "A nAn:n:n"]


def _brute_carry(rows):
    last, out = {}, {}
    for src, seq, v in sorted(rows, key=lambda r: (r[0], r[1])):
        if v is not None:
            last[src] = v
        out[(src, seq)] = last.get(src)
    return out


def test_carry_forward_matches_window(spark):
    rng = random.Random(3)
    rows = []
    for src in ["a", "b", "hot"]:
        n = 400 if src == "hot" else 60
        seqs = rng.sample(range(5000), n)
        for s in seqs:
            rows.append((src, s, rng.choice([None, None, None, f"t{s}"])))
    df = spark.createDataFrame(rows, "source string, seq long, v string")
    exp = _brute_carry(rows)
    for width, levels in [(7, 1), (3, 2), (50, 2), (1 << 16, 2)]:
        got = carry_forward(df, "v", "source", "seq", out_col="c", width=width, levels=levels).collect()
        assert {(r["source"], r["seq"]): r["c"] for r in got} == exp, (width, levels)


def test_resolve_time_precedence(spark):
    df = spark.createDataFrame([
        ("24", {"lolol": "yes"}, None),          # envelope
        (None, {"time": "24"}, None),            # fields
        (None, {"x": "1"}, '{"msg": "m", "time": 24}'),  # event object
        (None, {"time": ""}, None),              # falsy -> now
        ("0", {"time": "5"}, None),              # given, whatever it is
        ("", {}, None),
        (None, {"time": "0"}, '{"time": 7}'),    # a text is a value
        (None, {}, '{"time": 0}'),
        (None, {}, '{"time": "0"}'),
        (None, {}, '{"time": null}'),
        (None, {}, '"plain"'),                   # nothing -> now
    ], "env string, fields map<string,string>, ev string")
    v, o = resolve_time(F.col("env"), F.col("fields"), F.parse_json(F.col("ev")), now_column(1000))
    got = [tuple(r) for r in df.select(v, o).collect()]
    assert got == [("24", "envelope"), ("24", "fields"), ("24", "event"), ("1000", "now"),
                   ("0", "envelope"), ("", "envelope"), ("0", "fields"), ("1000", "now"), ("0", "event"), ("1000", "now"), ("1000", "now")]


def test_age_boundary(spark):
    now = int(time.time())
    df = spark.createDataFrame([(now - 10000,), (now - 10001,), (now + 50,)], "t long")
    got = [r[0] for r in df.select(too_old(F.col("t"), F.lit(now), 10000)).collect()]
    assert got == [False, True, False]
    assert [r[0] for r in df.select(too_old(F.col("t"), F.lit(now), 0)).collect()] == [False] * 3


def test_two_passes_of_a_json_line(spark):
    rows = [("s", 0, '{"t": "1700000000", "who": "ann"}'), ("s", 1, '"t": "1700000005" {broken'), ("s", 2, '{"who": "bob"}'), ("s", 3, "{}"), ("s", 4, "[1]")]
    df = spark.createDataFrame(rows, "source string, seq long, event_text string")
    patterns = [("raw", r'"t": "(?P<t>\d+)"'), ("w:who", r"^(?P<name>\w)"), ("x:name", "(?P<again>.)")]
    got = carry_time(two_passes(df, patterns, "t", mode="fixpoint")).orderBy("seq").collect()
    assert [r["fields"] for r in got] == [{"name": "a", "again": "a"}, {}, {"name": "b", "again": "b"}, {}, {}]
    assert [r["time_wire"] for r in got] == ["1700000000"] + ["1700000005"] * 4
    assert [r["event_json"] is None for r in got] == [False, True, False, False, False]
    stop = two_passes(df, patterns, "t").orderBy("seq").collect()
    assert [r["fields"] for r in stop] == [{}] * 5 and stop[0]["time_wire"] == "1700000000"
