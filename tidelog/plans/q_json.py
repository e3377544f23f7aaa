"""Queries for JSON decoding and extraction from objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonv
from ..functions.text import preview
from ..operators.envelope import carry_time, two_passes
from ..operators.extract import extract_fields
from .registry import query
from .tables import events_ts_utc, table

OBJECT_PATTERNS = [
    ("t:type", r"^(?P<kind>[a-z]+)$"),
    ("u:user", r"^(?P<user>\d)"),      # shadows the member 'user' for what follows
    ("u2:user", r"^(?P<ud>\d)$"),
    ("p:props", r"(?P<pk>k)"),         # an object, not a string: ends the chain
]

TWO_PASS_PATTERNS = [
    ("w", r'"at":\s*"(?P<ts>\d+)"'),
    ("t:type", r"^(?P<kind>\w+)$"),
    ("s:ts", r"^(?P<ts>\d+)$"),
    ("k:kind", r"(?P<end>.)$"),
]


def _micros(ts="ts"):
    return F.unix_micros(F.col(ts)).cast("string")


@query("json_fields", "O30 O14 O13 O15", oracle=r"""
WITH l AS (
  SELECT event_id,
         '{"type": "' || event_type || '", "user": '
           || CASE WHEN event_type = 'view' THEN CAST(user_id AS VARCHAR) ELSE '"' || user_id || '"' END
           || ', "props": ' || props || '}' AS line
  FROM events),
a AS (
  SELECT event_id, line,
         json_extract_string(line, '$.type') AS ty,
         json_type(line, '$.user') = 'VARCHAR' AS user_is_str,
         json_extract_string(line, '$.user') AS u
  FROM l),
b AS (
  SELECT *, regexp_matches(ty, '^([a-z]+)$') AS m1 FROM a),
c AS (
  SELECT *, m1 AND user_is_str AND regexp_matches(u, '^(\d)') AS m2,
         regexp_extract(u, '^(\d)', 1) AS u1 FROM b),
d AS (
  SELECT *, m2 AND regexp_matches(u1, '^(\d)$') AS m3 FROM c)
SELECT event_id,
       CASE WHEN m1 THEN ty END AS kind,
       CASE WHEN m2 THEN u1 END AS "user",
       CASE WHEN m3 THEN u1 END AS ud,
       CAST(CASE WHEN m1 THEN 1 ELSE 0 END + CASE WHEN m2 THEN 1 ELSE 0 END
            + CASE WHEN m3 THEN 1 ELSE 0 END AS BIGINT) AS n_fields
FROM d
""")
def json_fields(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    user = F.when(F.col("event_type") == "view", F.col("user_id").cast("string")) \
        .otherwise(F.concat(F.lit('"'), F.col("user_id").cast("string"), F.lit('"')))
    line = F.concat(F.lit('{"type": "'), F.col("event_type"), F.lit('", "user": '), user,
                    F.lit(', "props": '), F.col("props"), F.lit("}"))
    df = ev.select("event_id", jsonv.strict_parse_json(line).alias("event_json"))
    df = extract_fields(df, OBJECT_PATTERNS, text_col=None, json_col="event_json")
    f = F.col("fields")
    return df.select("event_id", F.element_at(f, F.lit("kind")).alias("kind"),
                     F.element_at(f, F.lit("user")).alias("user"), F.element_at(f, F.lit("ud")).alias("ud"),
                     F.size(f).cast("bigint").alias("n_fields"))


def _bad_lines(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    p = F.col("props")
    line = (F.when(F.col("event_type") == "error", F.expr("substring(props, 1, length(props) - 1)"))
            .when(F.col("event_type") == "signup", F.lit("  \t "))
            .when(F.col("event_type") == "click", F.concat(p, F.lit(" junk")))
            .when(F.col("event_type") == "purchase", F.concat(F.lit(" ["), p, F.lit("]\n")))
            .otherwise(p))
    return ev.select("event_id", line.alias("line"))


@query("bad_json", "O30 O57", oracle=r"""
WITH l AS (
  SELECT event_id,
         CASE WHEN event_type = 'error' THEN substr(props, 1, length(props) - 1)
              WHEN event_type = 'signup' THEN '  ' || chr(9) || ' '
              WHEN event_type = 'click' THEN props || ' junk'
              WHEN event_type = 'purchase' THEN ' [' || props || ']' || chr(10)
              ELSE props END AS line
  FROM events)
SELECT event_id,
       CASE WHEN trim(line, ' ' || chr(9) || chr(10)) = '' THEN 'blank'
            WHEN json_valid(trim(line, ' ' || chr(9) || chr(10))) THEN 'ok'
            ELSE 'invalid' END AS status,
       CASE WHEN json_valid(trim(line, ' ' || chr(9) || chr(10)))
            THEN json_extract_string(trim(line, ' ' || chr(9) || chr(10)), '$.k') END AS k,
       CASE WHEN NOT json_valid(trim(line, ' ' || chr(9) || chr(10))) AND trim(line, ' ' || chr(9) || chr(10)) <> ''
            THEN CASE WHEN length(trim(line, ' ' || chr(9) || chr(10))) > 80
                      THEN substr(trim(line, ' ' || chr(9) || chr(10)), 1, 79) || '…'
                      ELSE trim(line, ' ' || chr(9) || chr(10)) END END AS preview
FROM l
""")
def bad_json(spark, sf_dir):
    from ..functions.text import py_strip
    df = _bad_lines(spark, sf_dir)
    v = jsonv.strict_parse_json(F.col("line"))
    st = jsonv.json_status(F.col("line"))
    s = py_strip(F.col("line"))
    return df.select("event_id", st.alias("status"),
                     F.try_variant_get(v, "$.k", "string").alias("k"),
                     F.when(st == "invalid", preview(s, "short")).alias("preview"))


@query("json_two_pass", "O31 O24 O21 O30 O14", oracle=r"""
WITH l AS (
  SELECT event_id, user_id, event_type, CAST(epoch_us(ts) AS VARCHAR) AS us,
         CASE WHEN event_type = 'error' THEN '{"type": "error"}'
              WHEN event_type = 'signup' THEN '{"at": "' || epoch_us(ts) || '", "type": "signup"'
              WHEN event_type = 'view' THEN '{"at": "' || (epoch_us(ts) - 1000000) || '", "ts": "' || epoch_us(ts) || '", "type": "view"}'
              ELSE '{"at": "' || epoch_us(ts) || '", "type": "' || event_type || '"}' END AS line
  FROM events),
t AS (SELECT *, CASE WHEN event_type <> 'error' THEN left(us, 10) || '.' || substr(us, 11) END AS wire FROM l),
c AS (
  SELECT *, last_value(wire IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS time_wire
  FROM t)
SELECT event_id, user_id, time_wire, event_type AS kind, CASE WHEN event_type = 'view' THEN us END AS ts, right(event_type, 1) AS "end",
       CAST(CASE WHEN event_type = 'view' THEN 3 ELSE 2 END AS BIGINT) AS n_fields FROM c WHERE json_valid(line)
""")
def json_two_pass(spark, sf_dir):
    """Errors have no time, signups are broken JSON with a time that later lines take, views have another time as a member."""
    ev = events_ts_utc(table(spark, sf_dir, "events"))
    kind, at = F.col("event_type"), F.concat(F.lit('{"at": "'), _micros(), F.lit('", "type": "'), F.col("event_type"), F.lit('"'))
    earlier = (F.unix_micros("ts") - 1_000_000).cast("string")
    line = (F.when(kind == "error", F.lit('{"type": "error"}')).when(kind == "signup", at)
            .when(kind == "view", F.concat(F.lit('{"at": "'), earlier, F.lit('", "ts": "'), _micros(), F.lit('", "type": "view"}')))
            .otherwise(F.concat(at, F.lit("}"))))
    df = ev.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("source"),
                   F.col("event_id").alias("seq"), "event_id", "user_id", line.alias("event_text"))
    df = carry_time(two_passes(df, TWO_PASS_PATTERNS, "ts", mode="fixpoint"))
    found = [F.element_at("fields", F.lit(k)).alias(k) for k in ("kind", "ts", "end")]
    return df.where(F.col("event_json").isNotNull()).select("event_id", "user_id", "time_wire", *found, F.size("fields").cast("bigint").alias("n_fields"))
