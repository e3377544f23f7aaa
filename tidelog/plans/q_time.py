"""Queries for event time and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonv
from ..functions.text import py_strip, split_lines, PY_SPACE_CLASS
from ..functions.timefmt import detect_epoch, epoch_seconds, unmatched_shapes, with_field_time, with_parsed_date
from ..operators.envelope import carry_time, now_column, resolve_time
from ..operators.extract import extract_fields
from ..operators.filters import classify, is_blank, too_old
from ..operators.metrics import source_counters
from .registry import query
from .tables import events_ts_utc, table

# Fixed "now" of the repeatable queries: 2024-02-01 00:00:00 UTC.
NOW = 1_706_745_600
AGE_LIMIT = 1_000_000

LINE_PATTERNS = [("re_ts", r"^ts=(?P<ts>\d+)")]

WIRE_SQL = (r"regexp_extract({d}, '^\s*(\d{{7,10}})(\d*)', 1) || CASE WHEN regexp_extract({d}, "
            r"'^\s*(\d{{7,10}})(\d*)', 2) <> '' THEN '.' || regexp_extract({d}, '^\s*(\d{{7,10}})(\d*)', 2) "
            r"ELSE '' END")


def event_lines(spark, sf_dir):
    """Events as text lines, one source per user; ``error`` lines carry no time."""
    ev = events_ts_utc(table(spark, sf_dir, "events"))
    body = F.concat(F.lit("type="), F.col("event_type"), F.lit(" user="), F.col("user_id").cast("string"))
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("  at "), body)) \
        .otherwise(F.concat(F.lit("ts="), F.unix_micros("ts").cast("string"), F.lit(" "), body))
    return ev.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("source"),
                     F.col("event_id").alias("seq"), "event_id", "user_id", "event_type", "ts", "value",
                     "props", line.alias("event_text"))


@query("epoch_detect", "O21 O26", oracle=r"""
WITH r AS (
  SELECT event_id,
         CASE event_type
           WHEN 'view' THEN CAST(epoch_us(ts) // 1000000 AS VARCHAR)
           WHEN 'click' THEN CAST(epoch_us(ts) // 1000 AS VARCHAR)
           WHEN 'purchase' THEN CAST(epoch_us(ts) AS VARCHAR)
           WHEN 'signup' THEN ' ' || CAST(epoch_us(ts) // 1000000 AS VARCHAR) || '.5'
           ELSE strftime(ts, '%Y%m%d %H:%M') END AS s
  FROM events)
SELECT event_id, s AS rendered,
       CASE WHEN regexp_matches(s, '^\s*(\d{7,10})(\d*)') THEN """ + WIRE_SQL.format(d="s") + r""" END AS time_wire,
       CAST(split_part(CASE WHEN regexp_matches(s, '^\s*(\d{7,10})(\d*)') THEN """ + WIRE_SQL.format(d="s")
      + r""" END, '.', 1) AS BIGINT) AS epoch_sec
FROM r
""")
def epoch_detect(spark, sf_dir):
    ev = events_ts_utc(table(spark, sf_dir, "events"))
    us = F.unix_micros("ts")
    s = (F.when(F.col("event_type") == "view", F.floor(us / 1_000_000).cast("string"))
         .when(F.col("event_type") == "click", F.floor(us / 1_000).cast("string"))
         .when(F.col("event_type") == "purchase", us.cast("string"))
         .when(F.col("event_type") == "signup", F.concat(F.lit(" "), F.floor(us / 1_000_000).cast("string"), F.lit(".5")))
         .otherwise(F.date_format("ts", "yyyyMMdd HH:mm")))
    df = ev.select("event_id", s.alias("rendered"))
    wire = detect_epoch(F.col("rendered"))
    return df.select("event_id", "rendered", wire.alias("time_wire"), epoch_seconds(wire).alias("epoch_sec"))


# Forms of one instant (Python strftime of DuckDB, offset in hours east, the Spark pattern), dealt over the orders.
DATE_FORMS = [
    ("%Y-%m-%dT%H:%M:%SZ", 0, "yyyy-MM-dd'T'HH:mm:ss'Z'"), ("%Y-%m-%dT%H:%M:%S+02:00", 2, "yyyy-MM-dd'T'HH:mm:ss'+02:00'"),
    ("%Y-%m-%dT%H:%M:%S.250Z", 0, "yyyy-MM-dd'T'HH:mm:ss'.250Z'"), ("%d/%b/%Y:%H:%M:%S -0330", -3.5, "dd/MMM/yyyy:HH:mm:ss' -0330'"),
    ("%b %d %H:%M:%S %Y", 0, "MMM dd HH:mm:ss yyyy"), ("%a %b %d %H:%M:%S %Y", 0, "E MMM dd HH:mm:ss yyyy"),
    ("%a, %d %b %Y %H:%M:%S +0000", 0, "E, dd MMM yyyy HH:mm:ss' +0000'"), ("%Y-%m-%d %H:%M", 0, "yyyy-MM-dd HH:mm"),
    ("%m/%d/%Y %H:%M:%S", 0, "MM/dd/yyyy HH:mm:ss"), ("%Y-%m-%d %H:%M:%S,123", 0, "yyyy-MM-dd HH:mm:ss',123'"),
    ("%d %b %Y %I:%M %p", 0, "dd MMM yyyy hh:mm a"), ("%b %d %Y", 0, "MMM dd yyyy"), ("%a %b %d %H:%M:%S UTC %Y", 0, "E MMM dd HH:mm:ss' UTC 'yyyy"),
    ("%d %B %Y %H:%M:%S", 0, "dd MMMM yyyy HH:mm:ss"), ("%Y%m%dT%H%M%SZ", 0, "yyyyMMdd'T'HHmmss'Z'"), ("%m/%d/%y %H:%M:%S", 0, "MM/dd/yy HH:mm:ss"),
    ("%B %d, %Y %I:%M:%S %p", 0, "MMMM dd, yyyy hh:mm:ss a"), ("%b %d, %Y %H:%M:%S GMT", 0, "MMM dd, yyyy HH:mm:ss' GMT'"),
]
# Texts of zones whose offset depends on the date: day, abbreviation, hours east then; the time is a number of seconds.
ZONED_DAYS = [("2012-07-01", "MSK", 4), ("2020-07-01", "MSK", 3), ("2020-07-01", "BST", 1), ("2020-01-15", "BST", 0), ("2020-07-01", "CET", 2),
              ("2020-01-15", "CET", 1), ("2016-07-01", "EST", -4), ("2016-01-15", "EST", -5)]
# A text without a year, read in this one; texts without a format; how many forms there are.
NO_YEAR, ODD = 1999, ["no date", "on 3 May or 4", "31.12.98"]
_FORM_COUNT = len(DATE_FORMS) + len(ZONED_DAYS) + 1 + len(ODD)
_K = f"o_orderkey % {_FORM_COUNT}"
_Z0, _Y0 = len(DATE_FORMS), len(DATE_FORMS) + len(ZONED_DAYS)
_TEXT_SQL = " ".join(
    [f"WHEN {i} THEN strftime(o_orderdate, '{f}')" for i, (f, _, _) in enumerate(DATE_FORMS)]
    + [f"WHEN {_Z0 + i} THEN strftime(TIMESTAMP '{d}' + to_seconds(o_orderkey % 86400), '%Y-%m-%d %H:%M:%S') || ' {z}'" for i, (d, z, _) in enumerate(ZONED_DAYS)]
    + [f"WHEN {_Y0} THEN strftime(o_orderdate, '%b %d %H:%M:%S')"] + [f"WHEN {_Y0 + 1 + i} THEN '{t}'" for i, t in enumerate(ODD)])
_EPOCH_SQL = " ".join(
    [f"WHEN {i} THEN CAST(epoch(o_orderdate) AS BIGINT) - {int(h * 3600)}" for i, (_, h, _) in enumerate(DATE_FORMS)]
    + [f"WHEN {_Z0 + i} THEN CAST(epoch(TIMESTAMP '{d}') AS BIGINT) + o_orderkey % 86400 - {h * 3600}" for i, (d, _, h) in enumerate(ZONED_DAYS)]
    + [f"WHEN {_Y0} THEN CASE WHEN strftime(o_orderdate, '%m%d') <> '0229' THEN CAST(epoch(strptime('{NO_YEAR}' || strftime(o_orderdate, '%m%d%H%M%S'), '%Y%m%d%H%M%S')) AS BIGINT) END"])


def _date_texts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, form = F.col("o_orderkey") % _FORM_COUNT, F.lit(None).cast("string")
    seconds = (F.col("o_orderkey") % 86400).cast("bigint")
    for i, (_, _, f) in enumerate(DATE_FORMS):
        form = F.when(k == i, F.date_format("o_orderdate", f)).otherwise(form)
    for i, (day, zone, _) in enumerate(ZONED_DAYS):
        at = F.timestamp_seconds(F.unix_seconds(F.lit(day).cast("timestamp")) + seconds)
        form = F.when(k == _Z0 + i, F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit(f" {zone}"))).otherwise(form)
    form = F.when(k == _Y0, F.date_format("o_orderdate", "MMM dd HH:mm:ss")).otherwise(form)
    for i, t in enumerate(ODD):
        form = F.when(k == _Y0 + 1 + i, t).otherwise(form)
    return o.select("o_orderkey", form.alias("text"))


@query("date_parse", "O22 O23", oracle=f"""
WITH d AS (SELECT o_orderkey, CASE {_K} {_TEXT_SQL} END AS text, CASE {_K} {_EPOCH_SQL} END AS epoch_sec FROM orders)
SELECT *, epoch_sec IS NULL AS time_unparsed FROM d
""")
def date_parse(spark, sf_dir):
    d = with_parsed_date(_date_texts(spark, sf_dir), F.col("text"), "at", year=NO_YEAR)
    return d.select("o_orderkey", "text", F.unix_seconds("at").alias("epoch_sec"), F.col("at").isNull().alias("time_unparsed"))


@query("date_shapes", "O22 (the shapes that no format reads, with counts)", oracle=f"""
WITH d AS (SELECT CASE {_K} {_TEXT_SQL} END AS text, CASE {_K} {_EPOCH_SQL} END AS epoch_sec FROM orders)
SELECT regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z]+', 'A', 'g'), '[0-9]', '0', 'g'), '\\b00?\\b', 'n', 'g') AS shape,
       count(*) AS n, min(text) AS example FROM d WHERE epoch_sec IS NULL GROUP BY 1
""")
def date_shapes(spark, sf_dir):
    return unmatched_shapes(_date_texts(spark, sf_dir), F.col("text"), year=NO_YEAR)


def _line_times(spark, sf_dir):
    df = extract_fields(event_lines(spark, sf_dir), LINE_PATTERNS)
    return with_field_time(df, "ts")


@query("carry_time", "O24 O21 O27", oracle=r"""
WITH t AS (
  SELECT event_id, user_id,
         CASE WHEN event_type <> 'error' THEN """ + WIRE_SQL.format(d="CAST(epoch_us(ts) AS VARCHAR)") + r""" END AS wire
  FROM events)
SELECT event_id, user_id,
       last_value(wire IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS time_wire,
       CAST(split_part(last_value(wire IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '.', 1) AS BIGINT) AS epoch_sec
FROM t
""")
def carry_time_q(spark, sf_dir):
    df = carry_time(_line_times(spark, sf_dir), width=1024)
    return df.select("event_id", "user_id", "time_wire", F.unix_seconds("event_time").alias("epoch_sec"))


@query("resolve_time", "O25 O26 O27", oracle=r"""
SELECT event_id,
       CASE event_id % 10
         WHEN 0 THEN CAST(epoch_us(ts) // 1000000 AS BIGINT) WHEN 1 THEN 0 WHEN 2 THEN NULL WHEN 3 THEN NULL
         WHEN 4 THEN CAST(epoch_us(ts) // 1000000 AS BIGINT) WHEN 5 THEN 0 WHEN 6 THEN 1706745600
         WHEN 7 THEN CAST(epoch_us(ts) // 1000000 AS BIGINT) WHEN 8 THEN 1706745600 ELSE 1545407700 END AS epoch_sec,
       CASE WHEN event_id % 10 < 4 THEN 'envelope' WHEN event_id % 10 < 6 THEN 'fields'
            WHEN event_id % 10 IN (6, 8) THEN 'now' ELSE 'event' END AS origin
FROM events
""")
def resolve_time_q(spark, sf_dir):
    """Ten cases: envelope time as text, 0, empty and NULL; fields time, '0' and empty; event time as number, 0 and with an exponent."""
    ev = events_ts_utc(table(spark, sf_dir, "events"))
    secs, case = F.unix_seconds("ts").cast("string"), F.col("event_id") % 10
    env = F.when(case == 0, secs).when(case == 1, "0").when(case == 2, "")
    text = F.when(case == 4, F.concat(F.lit("time="), secs)).when(case == 5, "time=0").when(case == 6, "time=").otherwise("none")
    member = F.when(case == 7, secs).when(case == 8, "0").when(case == 9, "1.5454077e9")
    ev_json = F.when(case >= 7, F.parse_json(F.concat(F.lit('{"time": '), member, F.lit("}"))))
    df = ev.select("event_id", text.alias("event_text"), ev_json.alias("event_json"), env.alias("env_time"), (case < 4).alias("env_given"))
    df = extract_fields(df, [("t", r"time=(?P<time>\d*)")])
    value, origin = resolve_time(F.col("env_time"), F.col("fields"), F.col("event_json"), now_column(NOW), F.col("env_given"))
    return df.select("event_id", epoch_seconds(value).alias("epoch_sec"), origin.alias("origin"))


@query("blank_filter", "O40 O01(lines)", oracle=r"""
SELECT doc_id, line_no, line FROM (
  SELECT doc_id, t.i AS line_no,
         regexp_replace(t.raw, '^""" + PY_SPACE_CLASS + "+|" + PY_SPACE_CLASS + r"""+$', '', 'g') AS line
  FROM documents, unnest(string_split_regex(text, '\r\n|\r|\n')) WITH ORDINALITY AS t(raw, i))
WHERE line <> ''
""")
def blank_filter_q(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("pos", "raw"))
    out = lines.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("line_no"), py_strip(F.col("raw")).alias("line"))
    return out.where(~is_blank(F.col("line")))


@query("age_filter", "O41", oracle=r"""
SELECT event_id, 1706745600 - CAST(epoch_us(ts) // 1000000 AS BIGINT) AS age,
       CASE WHEN 1706745600 - CAST(epoch_us(ts) // 1000000 AS BIGINT) > 1000000 THEN 'filtered' ELSE 'queued' END
         AS status
FROM events
""")
def age_filter_q(spark, sf_dir):
    ev = events_ts_utc(table(spark, sf_dir, "events"))
    epoch = F.unix_seconds("ts")
    now = now_column(NOW)
    return ev.select("event_id", (now - epoch).alias("age"),
                     F.when(too_old(epoch, now, AGE_LIMIT), "filtered").otherwise("queued").alias("status"))


def _status_lines(spark, sf_dir):
    ev = events_ts_utc(table(spark, sf_dir, "events"))
    k = F.get_json_object("props", "$.k").cast("int")
    secs = F.unix_seconds("ts").cast("string")
    line = (F.when(k < 5, F.lit(" {} "))
            .when(k == 5, F.lit("  "))                    # a blank line is no event
            .when(F.col("event_type") == "error", F.expr("substring(props, 1, length(props) - 1)"))
            .when((F.col("event_type") == "signup") & (k >= 90), F.concat(F.lit('{"k": '), k.cast("string"),
                                                                           F.lit(', "time": "soon"}')))
            .otherwise(F.concat(F.lit('{"k": '), k.cast("string"), F.lit(', "time": '), secs, F.lit("}"))))
    return ev.select(F.col("event_type").alias("source"), F.col("event_id").alias("seq"), "event_id",
                     line.alias("event_text"))


@query("status_counts", "O42 O70 O40 O41 O25 O26 O30", oracle=r"""
WITH l AS (
  SELECT event_type AS source, event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
         CAST(epoch_us(ts) // 1000000 AS BIGINT) AS secs
  FROM events),
s AS (
  SELECT source,
         CASE WHEN k < 5 THEN 'filtered' WHEN k = 5 THEN 'none'
              WHEN source = 'error' THEN 'rejected'
              WHEN source = 'signup' AND k >= 90 THEN 'error'
              WHEN 1706745600 - secs > 1000000 THEN 'filtered'
              ELSE 'queued' END AS status
  FROM l)
SELECT source,
       CAST(count(*) FILTER (WHERE status <> 'error' AND status <> 'rejected') AS BIGINT) AS events,
       CAST(count(*) FILTER (WHERE status = 'queued') AS BIGINT) AS queued,
       CAST(count(*) FILTER (WHERE status = 'filtered') AS BIGINT) AS filtered,
       CAST(count(*) FILTER (WHERE status = 'rejected') AS BIGINT) AS rejected,
       CAST(count(*) FILTER (WHERE status = 'error') AS BIGINT) AS errors
FROM s WHERE status <> 'none' GROUP BY source
""")
def status_counts(spark, sf_dir):
    df = _status_lines(spark, sf_dir).where(~is_blank(F.col("event_text")))
    v = jsonv.strict_parse_json(F.col("event_text"))
    df = df.withColumn("event_json", v)
    empty = F.create_map().cast("map<string,string>")
    value, _ = resolve_time(F.lit(None).cast("string"), empty, F.col("event_json"), now_column(NOW))
    epoch = epoch_seconds(value)
    status, _ = classify(is_blank(None, F.col("event_json")), epoch, now_column(NOW), AGE_LIMIT,
                         rejected=F.col("event_json").isNull() & ~is_blank(F.col("event_text")))
    return source_counters(df.withColumn("status", status))
