"""Payload, defaults, routes, masks, previews, endpoints."""

import json

from pyspark.sql import functions as F

from tidelog.functions.text import (mask_keep_last4, mask_secret, normalise_collector_url, normalise_file_target,
                                    preview, py_strip)
from tidelog.operators.payload import encode_payload
from tidelog.operators.routes import overlay_defaults, resolve_routes, route_events, routes_frame


def test_payload_members(spark):
    df = spark.createDataFrame([("disk full", '{"level": "warn", "time": 12.5}')], "t string, j string")
    p = encode_payload(F.lit("ops"), F.lit("syslog"), F.lit("/var/log/kern"), F.lit("node-3"),
                       F.create_map(F.lit("unit"), F.lit("sda")), F.lit("1545407742.757"), event_text=F.col("t"))
    got = json.loads(df.select(p).first()[0])
    assert got == {"event": "disk full", "source": "/var/log/kern", "fields": {"unit": "sda"},
                   "index": "ops", "sourcetype": "syslog", "time": 1545407742.757, "host": "node-3"}
    p2 = encode_payload(F.lit("ops"), F.lit("app"), F.lit("queue"), F.lit(None).cast("string"),
                        F.create_map().cast("map<string,string>"), F.lit(9), event_json=F.parse_json(F.col("j")))
    got = json.loads(df.select(p2).first()[0])
    assert got == {"index": "ops", "sourcetype": "app", "source": "queue", "host": None, "fields": {},
                   "time": 9, "event": {"level": "warn", "time": 12.5}}


def test_routes_fallback_and_skip(spark):
    routes = routes_frame(spark, [
        {"source": "/c", "endpoint": "https://old"},
        {"source": "/a", "endpoint": "https://x/", "token": "t-1"},
        {"source": "/b", "reader": "cmdlines"},
        {"source": "/c", "endpoint": "https://y", "index": "ix", "sourcetype": "st"},
    ])
    ok, skipped = resolve_routes(routes, {"endpoint": None, "token": "g-tok", "index": None, "host": "h"})
    got = {r["source"]: (r["endpoint"], r["token"], r["index"], r["sourcetype"]) for r in ok.collect()}
    assert got == {"/a": ("https://x", "t-1", "tmp", "tidelog:lines"), "/c": ("https://y", "g-tok", "ix", "st")}
    assert [r["source"] for r in skipped.collect()] == ["/b"]
    ev = spark.createDataFrame([("/a", 1), ("/b", 2), ("/zz", 3)], "source string, id long")
    routed, left_out = route_events(ev, routes, {"token": "g", "host": "h"})
    assert [r["id"] for r in routed.collect()] == [1]
    assert sorted((r["id"], r["reason"]) for r in left_out.collect()) == [(2, "incomplete route"), (3, "no route")]
    d = overlay_defaults(index=[F.lit(None).cast("string")], source=[F.lit("s")])
    assert spark.range(1).select(d["index"], d["source"], d["sourcetype"]).first() == ("main", "s", "json")


def test_text_helpers(spark):
    r = spark.range(1).select(
        mask_secret(F.lit("abcd-ef12")), mask_secret(F.lit(None).cast("string")),
        mask_keep_last4(F.lit("Token abcd-1234")), preview(F.lit("x" * 120)), preview(F.lit("y" * 90), "short"),
        normalise_collector_url(F.lit("https://h:8088/")), normalise_file_target(F.lit("file://out.json")),
        normalise_file_target(F.lit("file:///var/x.json")), py_strip(F.lit(" \t\x0b　 a b  \n"))).first()
    assert r[0] == "xxxx-xxxx" and r[1] == "None"
    assert r[2] == "xxxxxxxx-xxxx-xxxx-xxxx-xxxxxxxx1234"
    assert r[3] == "x" * 98 + " … " and r[4] == "y" * 79 + "…"
    assert r[5] == "https://h:8088" and r[6] == "/tmp/out.json" and r[7] == "/var/x.json"
    assert r[8] == "a b"


def test_envelopes_and_ascii(spark):
    """As a plain model of the merge and of json.dumps."""
    import json
    from tidelog.functions import jsonv
    events = ['{"event": "e", "host": "mine", "zz": 1, "aa": {"x": [null, "ü"]}}', '{"event": {"a": 1}, "time": 5, "fields": {"q": "1"}, "index": null}', '{"a": 1}', '"text"', "[1]",
              '{"event": null, "k\\"q": "𝄞"}', '{"event": "only"}', None, '{"\u00e9": "\u007f\u0080\uffff"}']
    base = {"index": "i", "sourcetype": "s", "source": "src", "host": "h", "fields": {"f": "\u00fc"}, "time": 7}
    df = spark.createDataFrame([(i, e) for i, e in enumerate(events)], "i int, e string").withColumn("j", jsonv.strict_parse_json(F.col("e")))

    def encoded(ascii):
        return encode_payload(F.lit("i"), F.lit("s"), F.lit("src"), F.lit("h"), F.create_map(F.lit("f"), F.lit("\u00fc")), F.lit(7), event_text=F.lit("line"),
                              event_json=F.col("j"), ascii=ascii)

    for r in df.select("i", encoded(False).alias("p"), encoded(True).alias("a")).collect():
        e = json.loads(events[r["i"]]) if events[r["i"]] else "line"
        want = dict(base)
        if isinstance(e, dict) and "event" in e:
            want |= {k: v for k, v in sorted(e.items()) if k != "event"}
            e = e["event"]
        want["event"] = e
        assert r["p"] == json.dumps(want, separators=(",", ":"), ensure_ascii=False)
        assert r["a"] == json.dumps(want, separators=(",", ":"))
