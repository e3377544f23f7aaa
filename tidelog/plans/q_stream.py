"""Streaming queries (O80-O82, O01 stream, O24/O71 with state, O64).

Each query lands data derived from the tables as text files in a fresh folder
under the session's checkpoint directory, runs a Structured Streaming query
over them as a one-shot drain (``availableNow``) in bounded micro-batches
(``maxFilesPerTrigger``), writes the result with the parquet file sink and
returns it as a batch DataFrame.  The results equal the batch queries, so the
batch oracles apply.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F


from ..functions.text import py_strip, split_lines
from ..functions.timefmt import with_field_time
from ..operators.extract import extract_fields
from ..operators.filters import is_blank
from ..session import ensure_checkpoint_dir
from ..streaming.pipeline import drain, write_parquet
from ..streaming.state import stream_carry_late, stream_carry_time, stream_throttle
from .q_delivery import events_with_gaps
from .q_time import LINE_PATTERNS, event_lines
from .registry import REGISTRY, query

STEPS = 4  # drains of a stream, each over the next span of the order key


def _scratch(spark) -> str:
    return ensure_checkpoint_dir(spark).rstrip("/") + "/tidelog-stream-" + uuid.uuid4().hex[:12]


def _drain_in_steps(spark, df, order_col: str, base: str, transform) -> None:
    """Land ``value`` lines span by span of ``order_col``, and drain the stream
    after each landing, from its checkpoint.  A span is written by many tasks, its rows
    out of order; the time between drains stands for a restart."""
    lo, hi = df.agg(F.min(order_col), F.max(order_col)).first()
    for k in range(STEPS if lo is not None else 0):
        cut = [lo + (hi + 1 - lo) * i // STEPS for i in (k, k + 1)]
        span = df.where((F.col(order_col) >= cut[0]) & (F.col(order_col) < cut[1]))
        span.repartition(F.xxhash64(order_col)).sortWithinPartitions(F.xxhash64(order_col)).select("value") \
            .write.mode("append").text(base + "/in")
        drain(write_parquet(transform(spark.readStream.format("text").load(base + "/in")), base + "/out", base + "/ckpt"))


@query("stream_lines", "O80 O81 O82 O01 O40 O64", oracle=REGISTRY["blank_filter"].oracle)
def stream_lines(spark, sf_dir):
    from .tables import table
    base = _scratch(spark)
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("pos", "raw"))
    rec = F.concat_ws("\t", F.col("doc_id").cast("string"), (F.col("pos") + 1).cast("string"), F.col("raw"))
    lines.select(rec.alias("value")).write.text(base + "/in")
    s = spark.readStream.format("text").option("maxFilesPerTrigger", 2).load(base + "/in")
    parts = F.split(F.col("value"), "\t", 3)
    s = s.select(parts[0].cast("bigint").alias("doc_id"), parts[1].cast("bigint").alias("line_no"),
                 py_strip(parts[2]).alias("line"))
    s = s.where(~is_blank(F.col("line")))
    drain(write_parquet(s, base + "/out", base + "/ckpt"))
    return spark.read.parquet(base + "/out")


@query("stream_carry", "O24(stream) O81 O82", oracle=REGISTRY["carry_time"].oracle)
def stream_carry(spark, sf_dir):
    base = _scratch(spark)
    ev = event_lines(spark, sf_dir)
    rec = F.concat_ws("\t", F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("event_text"))

    def carried(s):
        parts = F.split(F.col("value"), "\t", 3)
        s = s.select(F.concat(F.lit("user-"), parts[1]).alias("source"), parts[0].cast("bigint").alias("seq"),
                     parts[0].cast("bigint").alias("event_id"), parts[1].cast("bigint").alias("user_id"),
                     parts[2].alias("event_text"))
        s = with_field_time(extract_fields(s, LINE_PATTERNS), "ts")
        return stream_carry_time(s.select("source", "seq", "event_id", "user_id", "time_wire", "event_time"))

    _drain_in_steps(spark, ev.select("event_id", rec.alias("value")), "event_id", base, carried)
    out = spark.read.parquet(base + "/out")
    return out.select("event_id", "user_id", "time_wire", F.unix_seconds("event_time").alias("epoch_sec"))


LATE = 200   # how far a row may come behind a later one


@query("stream_carry_late", "O24(stream, late rows) O81 O82", oracle=REGISTRY["carry_time"].oracle.replace("SELECT event_id, user_id,", "SELECT event_id, user_id % 16 AS user,").replace("PARTITION BY user_id", "PARTITION BY user").replace("user_id % 16 AS user,\n       last", "user,\n       last"))
def stream_carry_late_q(spark, sf_dir):
    """Lines of 16 sources landed in two steps; every second row comes up to ``LATE`` rows late, so many come after later ones
    in another step.  A last line of each source, further on than rows can be late, tells that no more come."""
    base, empty = _scratch(spark), "spark.sql.streaming.noDataMicroBatches.enabled"
    ev = event_lines(spark, sf_dir)
    rec = F.concat_ws("\t", F.col("event_id").cast("string"), (F.col("user_id") % 16).cast("string"), F.col("event_text"))
    late = F.col("event_id") + F.when(F.col("event_id") % 2 == 0, F.pmod(F.xxhash64("event_id"), F.lit(LATE + 1))).otherwise(0)
    lines = ev.select(late.alias("lands"), rec.alias("value"))
    lo, hi = lines.agg(F.min("lands"), F.max("lands")).first()

    def step(df) -> None:
        df.write.mode("append").text(base + "/in")
        s = spark.readStream.format("text").load(base + "/in")
        parts = F.split(F.col("value"), "\t", 3)
        s = s.select(F.concat(F.lit("s"), parts[1]).alias("source"), parts[0].cast("bigint").alias("seq"), parts[2].alias("event_text"))
        s = with_field_time(extract_fields(s, LINE_PATTERNS), "ts").select("source", "seq", "time_wire", "event_time")
        spark.conf.set(empty, "false")   # see stream_carry_late
        try:
            drain(write_parquet(stream_carry_late(s, lateness=LATE), base + "/out", base + "/ckpt"))
        finally:
            spark.conf.unset(empty)

    for k in range(2 if lo is not None else 0):
        cut = [lo + (hi + 1 - lo) * i // 2 for i in (k, k + 1)]
        step(lines.where((F.col("lands") >= cut[0]) & (F.col("lands") < cut[1])).select("value").repartition(8))
    if lo is None:
        lo = hi = 0
    step(spark.range(16).select(F.concat_ws("\t", F.lit(str(hi + LATE + 1)), F.col("id").cast("string"), F.lit("end")).alias("value")))
    out = spark.read.parquet(base + "/out").where(F.col("seq") <= hi)
    return out.select(F.col("seq").alias("event_id"), F.substring("source", 2, 9).cast("bigint").alias("user"), "time_wire",
                      F.unix_seconds("event_time").alias("epoch_sec"))


@query("stream_throttle", "O71(stream) O81 O82", oracle=REGISTRY["throttle"].oracle)
def stream_throttle_q(spark, sf_dir):
    base = _scratch(spark)
    ev = events_with_gaps(spark, sf_dir)
    rec = F.concat_ws("\t", F.col("event_id").cast("string"), F.coalesce("user", F.lit("")),
                      F.coalesce(F.unix_micros("ts").cast("string"), F.lit("")))

    def throttled(s):
        parts = F.split(F.col("value"), "\t", 3)
        s = s.select(parts[0].cast("bigint").alias("event_id"), F.nullif(parts[1], F.lit("")).alias("tag"),
                     parts[2].try_cast("bigint").alias("t_us"))
        return stream_throttle(s, "tag", "t_us", 86_400, ["event_id"])

    _drain_in_steps(spark, ev.select("event_id", rec.alias("value")), "event_id", base, throttled)
    return spark.read.parquet(base + "/out").select("event_id", "tag", "kept")



def _local(path: str) -> str:
    """The path of a mounted folder without its scheme."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


@query("json_lines_files", "O01 O03 O30", oracle=r"""
SELECT event_id, json_extract_string(props, '$.k') AS k
FROM events
WHERE event_type <> 'error'
""")
def json_lines_files(spark, sf_dir):
    """Events landed as JSON-lines files (error rows cut, so invalid), read
    back with the line source and strict JSON decoding; rejects are dropped."""
    from ..sources.text import read_json_lines
    from .tables import table
    base = _scratch(spark)
    ev = table(spark, sf_dir, "events")
    body = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "props": '), F.col("props"),
                    F.lit("}"))
    line = F.when(F.col("event_type") == "error", F.expr("substring(props, 1, 3)")).otherwise(body)
    ev.select(line.alias("value")).write.text(base + "/in")
    ok, _rejects = read_json_lines(spark, base + "/in")
    return ok.select(F.variant_get("event_json", "$.id", "bigint").alias("event_id"),
                     F.variant_get("event_json", "$.props.k", "string").alias("k"))


@query("growing_lines", "O02 O81", oracle=r"""
SELECT doc_id, t.raw AS line FROM documents, unnest(string_split_regex(text, '\r\n|\r|\n')) AS t(raw)
""")
def growing_lines(spark, sf_dir):
    """Document lines landed as files in which the lines of a third of the documents each are parted by a line feed, a
    carriage return or both, and read by the growing-file source (byte offsets and head fingerprints as
    the stream offset) in one drain for each landing."""
    from ..streaming.growing import stream_growing_lines
    from .tables import table
    base = _scratch(spark)
    d = table(spark, sf_dir, "documents")
    lines = F.transform(split_lines(F.col("text")), lambda x: F.concat(F.col("doc_id").cast("string"), F.lit("\t"), x))
    for k, end in enumerate(("\n", "\r", "\r\n")):
        d.where(F.col("doc_id") % 3 == k).select(F.array_join(lines, end).alias("value")).write.mode("append").text(base + "/in")
        drain(write_parquet(stream_growing_lines(spark, _local(base) + "/in/*.txt"), base + "/out", base + "/ckpt"))
    parts = F.split(F.col("event_text"), "\t", 2)
    return spark.read.parquet(base + "/out").select(parts[0].cast("bigint").alias("doc_id"),
                                                    parts[1].alias("line"))
