"""Packing, delivery outcome, back-off, throttles."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidelog.operators.delivery import backoff, backoff_sequential, deliver, outcome
from tidelog.operators.metrics import size_measures
from tidelog.operators.packing import (assemble_batches, assign_chunk, chunk_summary, compose, pack_batches, pack_sequential,
                                       walk_chunks)
from tidelog.operators.throttle import message_tag, throttle, throttle_sequential


def _words(n=100, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) + f"{i:03}" for i in range(1, n + 1)]


def test_chunk_steps_equal_sequential():
    rng = random.Random(11)
    for _ in range(2000):
        n = rng.randint(1, 50)
        mx, sep = rng.choice([0, 1, 8, 20, 100]), rng.choice([0, 1, 2])
        sizes = [rng.choice([0, 1, 3, 6, 13, 40, 120]) for _ in range(n)]
        cuts = sorted(rng.sample(range(1, n), rng.randint(0, min(5, n - 1)))) if n > 1 else []
        bounds = [0] + cuts + [n]
        chunks = [np.array(sizes[a:b], dtype=np.int64) for a, b in zip(bounds, bounds[1:])]
        res = walk_chunks([chunk_summary(c, mx, sep) for c in chunks], mx)
        ids = np.concatenate([assign_chunk(c, t, b, mx, sep) for c, (t, b) in zip(chunks, res)])
        assert list(ids) == pack_sequential(sizes, mx, sep)
        cut = rng.randint(0, len(chunks))       # two blocks: composed, walked, and walked inside
        blocks = [[chunk_summary(c, mx, sep) for c in part] for part in (chunks[:cut], chunks[cut:]) if part]
        tops = walk_chunks([compose(b, mx) for b in blocks], mx)
        inner = [x for b, top in zip(blocks, tops) for x in walk_chunks(b, mx, *top)]
        assert inner == res


def test_pack_small_cases(spark):
    df = spark.createDataFrame([("g", i, w) for i, w in enumerate(["one", "two", "three"])], "g string, i long, p string")
    p = pack_batches(df.withColumn("n", F.length("p")).withColumn("c", F.lit(0)), ["g"], ["i"], "n", "c",
                     max_bytes=8, sep=" ")
    got = [r["batch"] for r in assemble_batches(p, ["g"], ["i"], "p").orderBy("batch_no").collect()]
    assert got == ["one two", "three"]


def test_pack_across_chunks(spark):
    words = _words()
    rows = [("q" if i % 3 else "r", i, w * (1 + i % 4)) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "g string, i long, p string").withColumn("n", F.octet_length("p"))
    for width in (1, 7, 1000):
        p = pack_batches(df.withColumn("c", F.floor(F.col("i") / width)), ["g"], ["i"], "n", "c", max_bytes=100)
        got = {(r["g"], r["i"]): r["batch_no"] for r in p.collect()}
        for g in ("q", "r"):
            mine = sorted((i, len(pv.encode())) for gg, i, pv in rows if gg == g)
            exp = pack_sequential([s for _, s in mine], 100, 1)
            assert [got[(g, i)] for i, _ in mine] == exp
        b = assemble_batches(p, ["g"], ["i"], "p").collect()
        assert all(r["bytes"] < 100 or r["items"] == 1 for r in b)
    m = size_measures(df.withColumn("payload", F.col("p")), ["g"]).collect()
    assert {r["g"]: r["bytes_with_sep"] - r["bytes"] for r in m} == {r["g"]: r["items"] - 1 for r in m}


def test_outcome_and_deliver(spark):
    df = spark.createDataFrame([(200,), (204,), (400,), (404,), (503,), (None,)], "s int")
    got = [r[0] for r in df.select(outcome(F.col("s"))).collect()]
    assert got == ["ok", "ok", "ok", "server_error", "server_error", "connection_error"]

    calls = []

    def send(endpoint, token, body):
        calls.append(body)
        if body == "down":
            raise ConnectionRefusedError("no answer")
        return 200, "{}"

    b = spark.createDataFrame([("e", "t", "x y"), ("e", "t", "down")], "endpoint string, token string, batch string")
    got = {r["batch"]: r["outcome"] for r in deliver(b, send).collect()}
    assert got == {"x y": "ok", "down": "connection_error"}


def test_failed_batches_come_first_in_the_next_step(spark, tmpdir_path):
    from tidelog.sinks import CollectorSink
    seen = tmpdir_path + "/seen"

    def collector(down):
        def send(endpoint, token, body):
            with open(seen, "a") as fh:
                fh.write(f"{token} {body}\n")
            if body in down:
                raise ConnectionRefusedError("no answer")
            return 200, "{}"
        return send

    def step(no, rows, down):
        df = spark.createDataFrame(rows, "endpoint string, token string, batch_no long, batch string")
        open(seen, "w").close()
        CollectorSink(collector(down), tmpdir_path + "/retry", ["batch_no"])(df, no)
        return {t: [x.split()[1] for x in open(seen) if x.startswith(t)] for t in ("s", "t")}

    new = [("e", "t", 0, "a"), ("e", "t", 1, "b"), ("e", "t", 2, "c"), ("e", "s", 0, "x")]
    assert step(0, new, {"b"}) == {"s": ["x"], "t": ["a", "b"]}
    for _ in range(2):      # a replayed step does the same
        assert step(1, [("e", "t", 0, "d"), ("e", "s", 0, "y")], {"c"}) == {"s": ["y"], "t": ["b", "c"]}
    assert step(2, [], set()) == {"s": [], "t": ["c", "d"]}
    assert step(3, [], set()) == {"s": [], "t": []}

    # what failed last is sent again without new input, and isn't sent twice
    def resend(down):
        open(seen, "w").close()
        left = CollectorSink(collector(down), tmpdir_path + "/retry", ["batch_no"]).resend(spark)
        return left, [x.split()[1] for x in open(seen)]

    assert resend(set()) == (0, [])
    assert step(4, [("e", "t", 0, "f"), ("e", "t", 1, "g"), ("e", "t", 2, "h")], {"g"})["t"] == ["f", "g"]
    assert resend({"h"}) == (1, ["g", "h"])
    assert resend({"h"}) == (1, ["h"])
    assert step(5, [("e", "t", 0, "i")], {"i"})["t"] == ["h", "i"]
    assert resend(set()) == (0, ["i"])
    assert resend(set()) == (0, []) and step(6, [], set())["t"] == []


def test_backoff_against_spec(spark):
    rng = random.Random(2)
    rows = []
    for g in range(5):
        for s in range(rng.randint(1, 120)):
            rows.append((g, s, rng.random() < (0.3 if g == 4 else 0.8)))
    df = spark.createDataFrame(rows, "g long, s long, ok boolean")
    got = {(r["g"], r["s"]): (r["action"], r["skip_steps"]) for r in backoff(df, ["g"], ["s"], "ok").collect()}
    for g in range(5):
        oks = [ok for gg, s, ok in sorted(rows) if gg == g]
        acts, skips = backoff_sequential(oks)
        assert [got[(g, s)] for s in range(len(oks))] == list(zip(acts, skips))


def test_throttle_every_second_kept(spark):
    df = spark.createDataFrame([("t", 1000.0 + 0.1 * i, i) for i in range(10)], "tag string, ts double, i long")
    got = [r["kept"] for r in throttle(df, "tag", "ts", 0.2, ["i"]).orderBy("i").collect()]
    assert got == [i % 2 == 0 for i in range(10)]


def test_throttle_against_spec(spark):
    rng = random.Random(9)
    rows = []
    for tag in ["a", "b", "c|x", "hot"]:
        t = 0.0
        for i in range(rng.randint(1, 200) if tag != "hot" else 1500):
            t += rng.choice([0.0, 0.05, 0.3, 1.0, 2.5])
            rows.append((tag, round(t, 6), i, rng.random() < 0.1))
    df = spark.createDataFrame(rows, "tag string, ts double, i long, failed boolean")
    for failed, parts in ((None, 8), ("failed", 8), ("failed", 23)):
        got = {(r["tag"], r["i"]): r["kept"]
               for r in throttle(df, "tag", "ts", 1.0, ["i"], failed_col=failed, partitions=parts).collect()}
        for tag in ["a", "b", "c|x", "hot"]:
            mine = sorted((t, i, f) for g, t, i, f in rows if g == tag)
            exp = throttle_sequential([t for t, _, _ in mine], 1.0, [f for _, _, f in mine] if failed else None)
            assert [got[(tag, i)] for _, i, _ in mine] == exp
    r = spark.range(1).select(message_tag(F.lit("disk %s"), F.lit("sda"))).first()[0]
    assert r == "disk %s|sda"


def test_null_groups_tags_times_and_sizes(spark):
    rows = [(g, i, p) for i, (g, p) in enumerate([("a", "xx"), (None, "yy"), (None, None), ("a", "z"), (None, "ww"), (None, "vvvv")])]
    df = spark.createDataFrame(rows, "g string, i long, p string").withColumn("n", F.octet_length("p")).withColumn("c", F.lit(0))
    got = {r["i"]: r["batch_no"] for r in pack_batches(df, ["g"], ["i"], "n", "c", max_bytes=7).collect()}
    assert got == dict([*zip((0, 3), pack_sequential([2, 1], 7, 1)), *zip((1, 2, 4, 5), pack_sequential([2, 0, 2, 4], 7, 1))])
    ids = spark.createDataFrame([(None, 0, 3), (5, 1, 3), (None, 2, 3)], "g long, i long, n int").withColumn("c", F.lit(0))
    assert sorted((r["g"] is None, r["batch_no"]) for r in pack_batches(ids, ["g"], ["i"], "n", "c", max_bytes=6).collect()) == [(False, 0), (True, 0), (True, 1)]
    ev = spark.createDataFrame([(None, 1.0, 0), (None, 1.5, 1), ("t", None, 2), (None, 2.0, 3), ("t", 5.0, 4), (None, None, 5)], "tag string, ts double, i long")
    got = {r["i"]: r["kept"] for r in throttle(ev, "tag", "ts", 1.0, ["i"]).collect()}
    assert got == {0: True, 1: False, 2: None, 3: True, 4: True, 5: None}


def test_throttle_chunk_steps_equal_sequential():
    from tidelog.operators.throttle import chunk_report, mark_kept, walk_reports
    rng = random.Random(4)
    for _ in range(2000):
        n, lim = rng.randint(1, 50), rng.choice([0, 1, 3, 10])
        t = sorted(rng.choice(range(80)) for _ in range(n))
        f = [rng.random() < 0.2 for _ in range(n)]
        cuts = sorted(rng.sample(range(1, n), rng.randint(0, min(5, n - 1)))) if n > 1 else []
        b = [0] + cuts + [n]
        chunks = [(np.array(t[x:y], dtype=np.int64), np.array(f[x:y], dtype=bool)) for x, y in zip(b, b[1:])]
        res = walk_reports([chunk_report(tt, ff, lim) for tt, ff in chunks], lim)
        got = np.concatenate([mark_kept(tt, ff, s, lim) for (tt, ff), (s, _) in zip(chunks, res)])
        assert list(got) == throttle_sequential(t, lim, f)


def test_observed_counters(spark):
    from pyspark.sql import Observation

    from tidelog.operators.metrics import observe_counters, source_counters
    df = spark.createDataFrame([("a", "queued"), ("a", "filtered"), ("b", "error"), ("b", "rejected"), ("b", "queued")],
                               "source string, status string")
    obs = Observation("counters")
    observe_counters(df, obs).write.format("noop").mode("overwrite").save()
    assert obs.get == {"events": 3, "queued": 2, "filtered": 1, "rejected": 1}
    got = {r["source"]: tuple(r)[1:] for r in source_counters(df).collect()}
    assert got == {"a": (2, 1, 1, 0, 0), "b": (1, 1, 0, 1, 1)}


def test_null_group_is_not_the_group_named_none(spark):
    from pyspark.sql import types as T
    from tidelog.operators.sequential import ordered_scan
    rows = [(g, i) for g in (None, "None", "nan", "") for i in range(3)]
    df = spark.createDataFrame(rows, "g string, i long")

    def count(seg, state):
        return {"n": range(state + 1, state + 1 + len(seg))}, state + len(seg)

    got = ordered_scan(df, ["g"], ["i"], [T.StructField("n", T.LongType())], count, lambda: 0, partitions=1).collect()
    assert sorted((str(type(r["g"])), r["g"] or "", r["i"], r["n"]) for r in got) == sorted((str(type(g)), g or "", i, i + 1) for g, i in rows)


def test_throttle_of_many_small_tags_and_hot_ones(spark):
    """Equal to the sequential rule over tags cut by partitions and batches; rows are dealt once and joined by no shuffle."""
    import numpy as np
    import pandas as pd

    from tidelog.operators.throttle import edge_runs, throttle, throttle_sequential
    rng = np.random.default_rng(5)
    rows = [(i, None if tag % 7 == 0 else "hot" if tag < 300 else f"t{tag}", None if i % 41 == 0 else float(at), bool(bad))
            for i, (tag, at, bad) in enumerate(zip(rng.integers(0, 900, 4000), rng.integers(0, 3000, 4000), rng.random(4000) < 0.2))]
    df = spark.createDataFrame(rows, "id long, tag string, at double, bad boolean")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for limit in (1, 40, 5000):
            out = throttle(df, "tag", "at", limit, order_cols=["id"], failed_col="bad", partitions=7)
            plan = out._jdf.queryExecution().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
            got = {r["id"]: r["kept"] for r in out.collect()}
            want = {i: None for i, _, at, _ in rows if at is None}
            for tag in {r[1] for r in rows}:
                mine = sorted((at, i, bad) for i, t, at, bad in rows if t == tag and at is not None)
                kept = throttle_sequential([m[0] for m in mine], limit, [m[2] for m in mine])
                want |= {i: bool(k) for (_, i, _), k in zip(mine, kept)}
            assert got == want, limit
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    made = pd.DataFrame({"g": [None, None, "a", "b", "b", "b"], "t": range(6), "f": [False] * 6})
    for cuts in ([], [1], [2], [3], [4], [5], [1, 2, 3, 4, 5]):
        parts = [made.iloc[a:b] for a, b in zip([0] + cuts, cuts + [6])]
        assert [(g, t.tolist(), h) for g, t, _, h in edge_runs(parts, "g", "t", "f")] == [(None, [0, 1], True), ("b", [3, 4, 5], False)]
        assert [(t.tolist(), h) for _, t, _, h in edge_runs([x.assign(g="x") for x in parts], "g", "t", "f")] == [([0, 1, 2, 3, 4, 5], True)]
