"""Streaming sources and state (O02, O24/O71 streaming, O80-O82); packets."""

import json
import os
import time
from datetime import datetime, timezone

from tidelog.operators.packets import key_parts, layer_shape, nested, normalise_packets, rewrite_keys
from tidelog.streaming.growing import GrowingFilesReader, stream_growing_lines
from tidelog.streaming.pipeline import drain, write_parquet


def _append(path, text):
    with open(path, "a") as fh:
        fh.write(text)


def test_growing_files_resume(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "logs")
    os.makedirs(d)
    a, b = os.path.join(d, "a.log"), os.path.join(d, "b.log")
    _append(a, "a1\na2\n")
    _append(b, "b1\nb2-half")
    out, ck = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck")

    def run():
        drain(write_parquet(stream_growing_lines(spark, d + "/*.log"), out, ck))
        return sorted((os.path.basename(r["source"]), r["pos"], r["event_text"])
                      for r in spark.read.parquet(out).collect())

    assert run() == [("a.log", 0, "a1"), ("a.log", 3, "a2"), ("b.log", 0, "b1")]
    _append(a, "a3\r\n")
    _append(b, "-done\n")
    assert run() == [("a.log", 0, "a1"), ("a.log", 3, "a2"), ("a.log", 6, "a3"), ("b.log", 0, "b1"),
                     ("b.log", 3, "b2-half-done")]


def test_names_nest_by_prefix():
    names = ["disk", "disk_sda_read", "disk_sda_write", "fan_rear_speed", "fan_rear_state", "fan", "load_avg", "up"]
    got = nested({n: n.upper() for n in names})
    assert got == {"disk": {"val": "DISK", "sda": {"read": "DISK_SDA_READ", "write": "DISK_SDA_WRITE"}},
                   "fan": {"val": "FAN", "rear": {"speed": "FAN_REAR_SPEED", "state": "FAN_REAR_STATE"}},
                   "load": {"avg": "LOAD_AVG"}, "up": "UP"}
    assert nested({"a": 1, "a_b": 2, "a_b_c": 3}) == {"a": {"val": 1, "b": {"val": 2, "c": 3}}}
    assert nested({"x_y_z": 1, "x_y_w": 2, "x_q": 3}) == {"x": {"y": {"z": 1, "w": 2}, "q": 3}}


def test_layer_shapes():
    keys = ("dns_dns_id", "dns_flags_dns_flags_rd", "dns_id", "text_dns", "dns_count")
    got = layer_shape("dns", keys, (None, None, None, ("n",), None), 10, dedup=False)
    assert got == {"id": (10,), "flags": {"rd": (11,)}, "id_": (12,), "text_dns": {"n": (13, "n")}, "count": (14,)}
    assert layer_shape("dns", ("dns_only",), (None,), 0) is None


def test_keys_of_shapes_equal_the_columns(spark):
    made = [("tcp", k) for k in ("tcp_flags_tcp_flags_syn", "tcp_tcp_port", "text_tcp_options", "text_tcp_option", "a_a_b", "x", "tcpx_tcpx_y", "tcp_a_b_tcp_a_b_c")]
    got = rewrite_keys(spark.createDataFrame(made, "layer string, orig string")).collect()
    for r in got:
        key, dissector, name = key_parts(r["layer"], r["orig"])
        assert (r["key"], r["dissector"], r["name"], r["split"]) == (key, dissector, name, name is not None)


def test_packet_with_objects_and_duplicates(spark):
    line = '{"timestamp":"7","layers":{"ip":{"ip_ip_src":"1","ip_ip_src":"2","ip_opt_ip_opt":null,"text_ip":{"a_b":"x","n":[1,"q]"]},"text_ip_more":5}}}'
    df = spark.createDataFrame([(line,), (line + " junk",), (line + "] junk",), ('{"timestamp":"1","layers":{}}',), (None,)], "event_text string")
    got = [json.loads(r["event"]) for r in normalise_packets(df).collect()]
    assert got == [{"ip": {"src": "2", "opt_ip": {"opt": None}, "text": {"ip": {"a": {"b": "x"}, "n": [1, "q]"], "more": 5}}}, "timestamp": "7"}]


def test_normalise_packet(spark):
    rec = {"timestamp": "1545407742757", "layers": {
        "frame": {"frame_frame_len": "74", "frame_frame_cap_len": "74"},
        "tcp": {"tcp_flags_tcp_flags_syn": "1", "tcp_tcp_flags": "0x002", "text_tcp_options": "mss",
                "tcp_options_mss_val": "1460"},
        "eth": {"eth_only": "x"}}}
    lines = [json.dumps(rec), '{"index": {"_index": "packets"}}', "42"]
    df = spark.createDataFrame([(x,) for x in lines], "event_text string")
    got = [json.loads(r["event"]) for r in normalise_packets(df).collect()]
    assert got == [{"frame": {"len": "74", "cap": {"len": "74"}},
                    "tcp": {"flags": "0x002", "options": {"text": "mss", "mss": {"val": "1460"}}},
                    "timestamp": "1545407742757"}]


def test_stream_equals_batch(spark):
    import __spark_entry__ as entry
    q = entry.queries()
    sf = "/root/testdata/sf0.001"
    for s_name, b_name in (("stream_carry", "carry_time"), ("stream_throttle", "throttle")):
        a = sorted(tuple(r) for r in q[s_name](spark, sf).collect())
        b = sorted(tuple(r) for r in q[b_name](spark, sf).collect())
        assert a == b, s_name


def test_read_packets_from_capture_file(spark, tmpdir_path):
    from tidelog.sources.text import read_packets
    p = os.path.join(tmpdir_path, "cap.json")
    rec = {"timestamp": "1", "layers": {"ip": {"ip_ip_src": "10.0.0.1", "text_ip_note": "x"}}}
    with open(p, "wb") as fh:
        fh.write(b'{"index": {"_index": "packets"}}\n' + json.dumps(rec).encode() + b"\n\xff\n")
    got = [json.loads(r["event"]) for r in read_packets(spark, p).collect()]
    assert got == [{"ip": {"src": "10.0.0.1", "text_ip": {"note": "x"}}, "timestamp": "1"}]


def test_capture_files_are_compressed_and_bounded(spark, tmpdir_path, monkeypatch):
    """What packet_files lands is a small part of its text, in files of bounded length, and all of it is read back."""
    import glob
    import gzip

    from tidelog.plans import q_end
    from tidelog.plans.q_packets import packet_lines, packet_nest
    monkeypatch.setattr(q_end, "_scratch", lambda spark: tmpdir_path + "/scratch")
    monkeypatch.setattr(q_end, "CAPTURE_LINES", 500, raising=False)
    spark.range(0, 3000, 1, 2).selectExpr(
        "id div 4 AS l_orderkey", "CAST(id % 4 + 1 AS int) AS l_linenumber", "id * 7919 % 20000 AS l_partkey", "id * 31 % 1000 AS l_suppkey",
        "CAST(id % 50 + 1 AS double) AS l_quantity", "timestamp_seconds(800000000 + id * 86400 % 200000000) AS l_shipdate").write.parquet(tmpdir_path + "/lineitem.parquet")
    spark.range(0, 750, 1, 1).selectExpr("id AS o_orderkey", "CASE WHEN id % 3 = 0 THEN 'P' ELSE 'O' END AS o_orderstatus",
                                         "timestamp_seconds(800000000 + id * 86400) AS o_orderdate").write.parquet(tmpdir_path + "/orders.parquet")
    text = [r["event_text"] for r in packet_lines(spark, tmpdir_path).collect()]
    got = q_end.packet_files(spark, tmpdir_path)
    files = glob.glob(tmpdir_path + "/scratch/in/part-*")
    assert sum(os.path.getsize(f) for f in files) * 5 < sum(len(t.encode()) + 1 for t in text)
    landed = [gzip.open(f, "rt", encoding="utf-8", newline="\n").read().split("\n")[:-1] for f in files]
    assert max(map(len, landed)) == 500 and sorted(sum(landed, [])) == sorted(text)
    events = sorted(r["event"] for r in packet_nest(spark, tmpdir_path).collect())
    assert sorted(r["event"] for r in got.collect()) == events and len(events) == 3000


def test_collector_sink_requeues(spark, tmpdir_path):
    from tidelog.sinks import CollectorSink, write_json_lines
    b = spark.createDataFrame([("e", "t", "ok-batch", "main"), ("e", "t", "bad-batch", "web")],
                              "endpoint string, token string, batch string, index string")
    sink = CollectorSink(lambda e, t, body: (500, "") if body.startswith("bad") else (200, ""),
                         os.path.join(tmpdir_path, "retry"))
    sink(b, 7)
    r = spark.read.parquet(os.path.join(tmpdir_path, "retry")).collect()
    assert [(x["batch"], x["batch_id"], x["outcome"]) for x in r] == [("bad-batch", 7, "server_error")]
    write_json_lines(b, os.path.join(tmpdir_path, "out"), column="batch", partition_by=["index"])
    assert sorted(x[0] for x in spark.read.text(os.path.join(tmpdir_path, "out")).collect()) == ["bad-batch",
                                                                                                  "ok-batch"]


def test_drain_past_its_limit_raises(spark, tmpdir_path):
    import pytest
    d = os.path.join(tmpdir_path, "many")
    os.makedirs(d)
    for i in range(40):
        _append(os.path.join(d, f"{i}.txt"), "x\n")
    from tidelog.sources.text import stream_lines
    q = write_parquet(stream_lines(spark, d, max_files_per_trigger=1), os.path.join(tmpdir_path, "o"), os.path.join(tmpdir_path, "c"))
    with pytest.raises(TimeoutError):
        drain(q, 0.2)
    assert not q.isActive


def test_growing_file_line_ends_splits_and_rewrites(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "g")
    os.makedirs(d)
    a = os.path.join(d, "a.log")
    with open(a, "wb") as fh:
        fh.write(b"x\ry\r\r\nz\n" + b"".join(b"line %d\r\n" % i for i in range(50)) + b"half\r")
    out, ck = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck")
    run = lambda: drain(write_parquet(stream_growing_lines(spark, d + "/*.log", split=7), out, ck))
    run()
    first = [r["event_text"] for r in spark.read.parquet(out).orderBy("pos").collect()]
    assert first == ["x", "y", "", "z"] + [f"line {i}" for i in range(50)]
    with open(a, "wb") as fh:                    # rewritten, and larger
        fh.write(b"".join(b"new %03d of the second writing\n" % i for i in range(60)))
    run()
    got = sorted(r["event_text"] for r in spark.read.parquet(out).collect())
    assert got == sorted(first + ["new %03d of the second writing" % i for i in range(60)])


def test_carried_time_of_unsorted_batch(spark, tmpdir_path):
    from pyspark.sql import functions as F

    from tidelog.streaming.state import stream_carry_time
    d = os.path.join(tmpdir_path, "u")
    os.makedirs(d)
    _append(os.path.join(d, "a.txt"), "s,5,50\ns,2,\ns,1,10\ns,4,\ns,3,30\ns,0,\n")
    p = F.split("value", ",")
    s = spark.readStream.text(d).select(p[0].alias("source"), p[1].cast("long").alias("seq"), F.nullif(p[2], F.lit("")).alias("time_wire"))
    s = s.withColumn("event_time", F.timestamp_seconds(F.col("time_wire").cast("long")))
    drain(write_parquet(stream_carry_time(s), os.path.join(tmpdir_path, "o2"), os.path.join(tmpdir_path, "c2")))
    got = spark.read.parquet(os.path.join(tmpdir_path, "o2")).orderBy("seq").select("time_wire", F.unix_seconds("event_time")).collect()
    assert [tuple(r) for r in got] == [(None, None), ("10", 10), ("10", 10), ("30", 30), ("30", 30), ("50", 50)]


def test_growing_file_truncated_restarts(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "t")
    os.makedirs(d)
    a = os.path.join(d, "a.log")
    _append(a, "one\ntwo\nthree\n")
    out, ck = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck")
    drain(write_parquet(stream_growing_lines(spark, d + "/*.log"), out, ck))
    with open(a, "w") as fh:          # truncated and rewritten shorter
        fh.write("new\n")
    drain(write_parquet(stream_growing_lines(spark, d + "/*.log"), out, ck))
    got = sorted((r["pos"], r["event_text"]) for r in spark.read.parquet(out).collect())
    assert got == [(0, "new"), (0, "one"), (4, "two"), (8, "three")]


def test_continuous_trigger(spark, tmpdir_path):
    from tidelog.sources.text import stream_lines
    d = os.path.join(tmpdir_path, "in")
    os.makedirs(d)
    _append(os.path.join(d, "x.txt"), "a\n\nb\n")
    out, ck = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck")
    from tidelog.operators.filters import blank_filter
    q = write_parquet(blank_filter(stream_lines(spark, d, max_files_per_trigger=1)), out, ck, mode="continuous",
                      interval_s=0.5)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r["event_text"] for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_is_packet_predicate(spark):
    from pyspark.sql import functions as F

    from tidelog.functions import jsonv
    from tidelog.operators.packets import is_packet
    lines = ['{"timestamp": "1", "layers": {}}', '{"index": {}}', '[1]', '42', '{"timestamp": "1"}']
    df = spark.createDataFrame([(x,) for x in lines], "t string")
    got = [r[0] for r in df.select(is_packet(jsonv.strict_parse_json(F.col("t")))).collect()]
    assert got == [True, False, False, False, False]


def test_rotation_loses_nothing(spark, tmpdir_path):
    """Renamed between offset and read, rotated with unread lines, rotated to a name that matches as well, deleted."""
    d = os.path.join(tmpdir_path, "logs")
    os.makedirs(d)
    log = os.path.join(d, "app.log")

    def texts(reader, start, end):
        return [(os.path.basename(p), pos, t) for part in reader.partitions(start, end) for p, pos, t in reader.read(part)]

    for pattern, name in (("/*.log", "app.log"), ("/app*", "app.log.1")):
        reader = GrowingFilesReader(d + pattern)
        _append(log, "one\ntwo\n")
        first = reader.latestOffset()
        parts = reader.partitions({}, first)
        os.rename(log, log + ".1")                                   # after the offset, before the read
        assert [t for part in parts for _, _, t in reader.read(part)] == ["one", "two"]
        assert [t for _, _, t in texts(reader, {}, first)] == ["one", "two"]
        _append(log + ".1", "three\n")                               # the writer still had it open
        _append(log, "new\n")
        second = reader.latestOffset()
        assert sorted(texts(reader, first, second)) == [("app.log", 0, "new"), (name, 8, "three")]
        assert texts(reader, second, reader.latestOffset()) == []
        os.remove(log)
        os.remove(log + ".1")
        assert texts(reader, second, reader.latestOffset()) == [] and texts(reader, first, second) == []
    old = {log: reader.latestOffset().get(log, [0, 0, ""])[:3]}      # an offset of an old checkpoint
    _append(log, "x\n")
    assert texts(reader, old, reader.latestOffset()) == [("app.log", 0, "x")]


def test_a_stream_outlives_rotation(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "logs")
    os.makedirs(d)
    log, out, ck = os.path.join(d, "app.log"), os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck")

    def run():
        drain(write_parquet(stream_growing_lines(spark, d + "/*.log"), out, ck))
        return sorted(r["event_text"] for r in spark.read.parquet(out).collect())

    _append(log, "a\nb\n")
    assert run() == ["a", "b"]
    _append(log, "c\n")
    os.rename(log, log + ".1")
    _append(log, "d\n")
    assert run() == ["a", "b", "c", "d"]
    os.remove(log)
    os.remove(log + ".1")
    _append(log, "e\n")
    assert run() == ["a", "b", "c", "d", "e"]


def test_rows_that_come_after_later_ones(spark, tmpdir_path):
    """Late rows within the bound are carried as in order, a quiet source is put out with the next rows of another one, later
    rows than the bound take the last time and don't set it."""
    from tidelog.streaming.state import stream_carry_late
    schema = "source string, seq long, time_wire string, event_time timestamp"
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def step(rows):
        made = [(s, n, w, None if w is None else datetime.fromtimestamp(int(w), timezone.utc)) for s, n, w in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(tmpdir_path + "/in")
        stream = spark.readStream.schema(schema).parquet(tmpdir_path + "/in")
        drain(write_parquet(stream_carry_late(stream, lateness=5, idle_ms=1), tmpdir_path + "/out", tmpdir_path + "/ckpt"))
        return sorted((r["source"], r["seq"], r["time_wire"], r["us"] // 10 ** 6) for r in spark.read.parquet(tmpdir_path + "/out")
                      .selectExpr("source", "seq", "time_wire", "unix_micros(event_time) AS us").collect() if r["us"] is not None)

    try:
        assert step([("a", 1, "10"), ("a", 4, "40"), ("a", 3, None)]) == []
        first = step([("a", 2, None), ("b", 1, "7"), ("a", 9, None), ("a", 6, "60")])
        assert first == [("a", 1, "10", 10), ("a", 2, "10", 10), ("a", 3, "10", 10), ("a", 4, "40", 40)]
        got = step([("b", 2, None), ("a", 20, "200"), ("a", 0, "1"), ("a", 2, None)])
        assert set(got) - set(first) == {("a", 0, "1", 1), ("a", 2, "40", 40), ("a", 6, "60", 60), ("a", 9, "60", 60)}
        time.sleep(0.1)
        last = step([("c", 1, "5")])
        assert set(last) - set(got) == {("a", 20, "200", 200), ("b", 1, "7", 7), ("b", 2, "7", 7)} and len(last) == 11
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_learnt_forms_equal_decoding(spark):
    """Lines that a form matches, and those it must not, give what decoding gives."""
    from tidelog.operators.packets import _ENCODE, _Regrouper

    def line(ts='"1"', a='"x"', b='"y"', more=""):
        return '{"timestamp": %s, "layers": {"ip": {"ip_ip_src": %s, "ip_ip_src": %s, "ip_opt_%%_ip_opt_%%": "p%%s", "text_ip": "t"}%s}}' % (ts, a, b, more)

    lines = [line(), line(b='"z"'), line('"2"', '"q"', '"é{}[],:"'), line(b='"a\\"b"'), line(b='"\\u0041"'), line(b='"a\tb"'), line(b='"\\ud83d\\ude00"'),
             line("2"), line('"#0"'), line("[1]"), line("null"), line(b="5"), line(b='["#1"]'), line(b='{"n": "v"}'), line(b='{"n": "w"}'), line(b='"#3"'),
             line(more=', "x": {}'), line(more=', "x": "s"'), " " + line(b='"u"') + "\n", line() + "x", line()[:-1], "42", '{"index": {}}', None, "", line(b='"' + "k" * 300 + '"')]
    one = _Regrouper(True)
    for text in lines * 3:
        assert one(text) == _Regrouper(True)(text), text
    assert len(one.forms) > 0 and _ENCODE("é") == '"é"'
    assert one.decoded(line(b='"only form"')) and one(line(b='"form"'))[1] == _Regrouper(True)(line(b='"form"'))[1]
    calls, decoded = [], one.decoded
    one.decoded = lambda text: calls.append(text) or decoded(text)
    for k in range(50):
        one(line(f'"{k}"', b=f'"v{k}"'))
    assert not calls


def test_valid_lines_stay_out_of_python(spark, tmpdir_path):
    """Only the bytes of invalid lines are sent to Python."""
    from tidelog.sources.text import read_command_output
    p = os.path.join(tmpdir_path, "out.txt")
    with open(p, "wb") as fh:
        fh.write(b"good \xc3\xa9\r\nbad \xff\xc3!\n\xef\xbf\xbd\xfe\n\n")
    df = read_command_output(spark, p)
    assert sorted(r["event_text"] for r in df.collect()) == ["", "bad !", "good é\r", "�"]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    sent = plan[plan.index("_decode_ignore("):].split("\n")[0]
    assert "CASE WHEN" in plan and "CASE WHEN" in sent or "_decode_ignore(pythonUDF" in sent or "_decode_ignore(_" in sent


def test_keys_whose_first_word_stands_again(spark):
    """The regex is only met by keys that hold their first word again; all are split as before."""
    keys = ["a_a_b", "_x__x_r", "____r", "a_b_a_b_c", "tcp_tcp", "tcp_tcp_", "x_a_x_a", "ab_a_b", "__a", "a", "", "_", "é_é_z", "a_a_a_a_b"]
    df = rewrite_keys(spark.createDataFrame([("a", k) for k in keys], "layer string, orig string"))
    assert {(r["orig"], r["key"], r["dissector"], r["name"], r["split"]) for r in df.collect()} == \
        {(k, *key_parts("a", k), key_parts("a", k)[2] is not None) for k in keys}
    assert "instr(" in df._jdf.queryExecution().optimizedPlan().toString()


def test_states_of_many_keys_over_restarts(spark, tmpdir_path):
    """Carried times and clocks of many keys, NULL among them, over three drains equal one ordered walk; a
    bucket of keys is one call, and a key without rows for long is forgotten while its neighbours stay."""
    import random

    from pyspark.sql import functions as F

    from tidelog.operators.throttle import throttle_sequential
    from tidelog.streaming import state
    rng = random.Random(3)
    rows = [(n, None if k == 7 else f"k{k}", str(n) if rng.random() < 0.3 else None, None if rng.random() < 0.1 else n * 1_000_000 + rng.randrange(10))
            for n, k in ((n, rng.randrange(60)) for n in range(900))]
    was, state.BUCKETS = state.BUCKETS, 5
    empty = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(empty, "false")       # with time-outs a drain would always have one more batch
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for k in range(3):
            made = rows[k * 300:k * 300 + 300]
            rng.shuffle(made)
            spark.createDataFrame(made, "n long, k string, w string, us long").write.mode("append").parquet(tmpdir_path + "/in")
            s = spark.readStream.schema("n long, k string, w string, us long").parquet(tmpdir_path + "/in")
            c = s.select("k", "n", F.col("w").alias("time_wire"), F.timestamp_seconds(F.when(F.col("n") % 5 != 0, F.col("w").cast("long"))).alias("event_time"))
            drain(write_parquet(state.stream_carry_time(c, "k", "n", timeout_ms=3_600_000), tmpdir_path + "/o1", tmpdir_path + "/c1"))
            drain(write_parquet(state.stream_throttle(s, "k", "us", 50, ["n"]), tmpdir_path + "/o2", tmpdir_path + "/c2"))
            short = state.stream_throttle(s.where(F.col("k").isNotNull()), "k", "us", 10 ** 6, ["n"], timeout_ms=1)
            drain(write_parquet(short, tmpdir_path + "/o3", tmpdir_path + "/c3"))
            time.sleep(0.1)
    finally:
        state.BUCKETS = was
        spark.conf.unset(empty)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    carried = {r["n"]: (r["time_wire"], r["s"]) for r in spark.read.parquet(tmpdir_path + "/o1").select("n", "time_wire", F.unix_seconds("event_time").alias("s")).collect()}
    kept = {r["n"]: r["kept"] for r in spark.read.parquet(tmpdir_path + "/o2").collect()}
    assert len(carried) == len(kept) == 900
    for k in {r[1] for r in rows}:
        mine, w = sorted((r for r in rows if r[1] == k), key=lambda r: r[0]), None
        for r in mine:
            w = r[2] or w
            assert carried[r[0]][0] == w
            if r[2] and r[0] % 5:
                assert carried[r[0]][1] == int(r[2])
        timed = [r for r in mine if r[3] is not None]
        assert [kept[r[0]] for r in timed] == throttle_sequential([r[3] for r in timed], 50_000_000)
        assert all(kept[r[0]] is None for r in mine if r[3] is None)
    short = [r for r in spark.read.parquet(tmpdir_path + "/o3").collect() if r["kept"]]
    assert len(short) >= len({r["k"] for r in short}) > 50
