"""Line sources, fingerprints, change detection, manifest."""

import hashlib
import json
import os
import time

from pyspark.sql import functions as F

from tidelog.sources.inventory import (EMPTY_MD5, compact_manifest, detect_changes, file_inventory, head_fingerprint, load_manifest,
                                       python_fingerprint, save_manifest)
from tidelog.sources.text import read_command_output, read_json_lines, read_lines


def _write(path, data, mode="w"):
    with open(path, mode + ("b" if isinstance(data, bytes) else "")) as fh:
        fh.write(data)


def test_lines_in_order(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "a.log")
    _write(p, "north\neast\r\nsouth")
    got = [r["event_text"] for r in read_lines(spark, p).orderBy("seq").collect()]
    assert got == ["north", "east", "south"]
    q = os.path.join(tmpdir_path, "many.log")
    _write(q, "".join(f"line-{i}\n" for i in range(1000)))
    got = [r["event_text"] for r in read_lines(spark, q).orderBy("seq").collect()]
    assert got == [f"line-{i}" for i in range(1000)]


def test_command_output_bytes(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "cmd.out")
    _write(p, bytes([0x7F, 0x80]) + "naïve — text\r\n".encode() + b"ok\n")
    got = [r["event_text"] for r in read_command_output(spark, p).orderBy("seq").collect()]
    assert got == ["\x7fnaïve — text\r", "ok"]


def test_json_lines_rejects(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "j.log")
    _write(p, '{"a": 1}\n\n{"a": 2} junk\n[1, 2]\n')
    ok, bad = read_json_lines(spark, p)
    assert sorted(r["event_text"] for r in ok.collect()) == ['[1, 2]', '{"a": 1}']
    assert [r["preview"] for r in bad.collect()] == ['{"a": 2} junk']


def test_fingerprint(spark):
    df = spark.createDataFrame([("",), ("abc",), ("é" * 2000,)], "t string")
    got = [tuple(r) for r in df.select(*head_fingerprint(F.col("t"))).collect()]
    assert got[0] == (EMPTY_MD5, 0)
    assert got[1] == python_fingerprint("abc")
    assert got[2] == (hashlib.md5(("é" * 1024).encode()).hexdigest(), 1024)


def _manifest_rows(inv_rows, pos_of):
    return [(p, m, pos_of(p, s), s, hashlib.md5(h[:1024].encode()).hexdigest(), len(h[:1024]), time.time())
            for p, s, m, h in inv_rows]


def test_change_sequence(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "grow.log")
    _write(p, "one\ntwo\n")
    inv = file_inventory(spark, p).collect()
    assert inv[0]["head"] == "one\ntwo\n" and inv[0]["size"] == 8
    never = spark.createDataFrame([], "path string, mtime double, pos long, size long, sig_h string, sig_b int")
    first = detect_changes(file_inventory(spark, p), never).first()
    assert (first["change"], first["read_from"]) == ("grown", 0)
    rows = [(r["path"], r["size"], r["mtime"], r["head"]) for r in inv]
    man = spark.createDataFrame(_manifest_rows(rows, lambda p_, s: s),
                                "path string, mtime double, pos long, size long, sig_h string, sig_b int, saved_at double")
    assert detect_changes(file_inventory(spark, p), man).first()["change"] == "unchanged"
    time.sleep(0.05)
    _write(p, "three\n", "a")
    r = detect_changes(file_inventory(spark, p), man).first()
    assert (r["change"], r["read_from"]) == ("grown", 8)
    time.sleep(0.05)
    _write(p, "x\n")
    r = detect_changes(file_inventory(spark, p), man).first()
    assert (r["change"], r["read_from"]) == ("truncated", 0)
    _write(p, "ONE\ntwo\nthree\nfour\n")
    r = detect_changes(file_inventory(spark, p), man).first()
    assert (r["change"], r["read_from"]) == ("replaced", 0)
    os.remove(p)
    gone = spark.createDataFrame([], "path string, size long, mtime double, head string")
    r = detect_changes(gone, man).first()
    assert (r["change"], r["read_from"], r["size"]) == ("replaced", None, 0)


def test_manifest_round_trip(spark, tmpdir_path):
    m = os.path.join(tmpdir_path, "manifest")
    rows = [("/a", 1.0, 5, 5, "h", 3, 1.0), ("/a", 2.0, 9, 9, "h", 3, 2.0), ("/b", 1.0, 1, 1, "g", 1, 1.0)]
    df = spark.createDataFrame(rows, "path string, mtime double, pos long, size long, sig_h string, sig_b int, "
                                     "saved_at double")
    save_manifest(df, m)
    _write(os.path.join(m, "corrupt.json"), "{not json\n")
    got = {r["path"]: r["pos"] for r in load_manifest(spark, m).collect()}
    assert got == {"/a": 9, "/b": 1}
    assert json.loads(json.dumps(got)) == got


def test_command_json(spark, tmpdir_path):
    from tidelog.sources.text import read_command_json
    p = os.path.join(tmpdir_path, "cmd.json")
    _write(p, b'{"a": "x\xff"}\n' + b"not json\n" + b"\n")
    ok, bad = read_command_json(spark, p)
    assert [r["event_text"] for r in ok.collect()] == ['{"a": "x"}']
    assert [r["preview"] for r in bad.collect()] == ["not json"]


def test_manifest_compaction(spark, tmpdir_path):
    m = os.path.join(tmpdir_path, "m")
    schema = "path string, mtime double, pos long, size long, sig_h string, sig_b int, saved_at double"

    def save(at, **positions):
        save_manifest(spark.createDataFrame([(p, 1.0, n, n, "h", 1, at) for p, n in positions.items()], schema), m)

    def positions():
        return {r["path"]: r["pos"] for r in load_manifest(spark, m).collect()}

    assert positions() == {}
    compact_manifest(spark, m)                      # of nothing
    save(1.0, a=1, b=1)
    save(2.0, b=2)
    compact_manifest(spark, m)
    assert positions() == {"a": 1, "b": 2}
    save(3.0, c=3)
    os.makedirs(os.path.join(m, "snapshot-00000003"))                       # a compaction that broke off
    _write(os.path.join(m, "snapshot-00000003", "part-0"), "torn")
    save(4.0, a=4)
    assert positions() == {"a": 4, "b": 2, "c": 3}
    compact_manifest(spark, m)
    save(0.5, a=9)                                                          # an older save comes late
    assert positions() == {"a": 4, "b": 2, "c": 3}
    assert sorted(x for x in os.listdir(m) if not x.startswith(".")) == ["log-00000003", "log-00000004", "snapshot-00000002", "snapshot-00000003"]
