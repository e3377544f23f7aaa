"""Queries for routing, defaults, masks, previews, endpoints and payloads
(O50-O53, O55-O57, O60)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import mask_keep_last4, mask_secret, normalise_collector_url, normalise_file_target, preview
from ..functions.timefmt import timestamp_to_wire
from ..operators.payload import encode_payload, json_string
from ..operators.routes import overlay_defaults, route_events, routes_frame
from .registry import query
from .tables import events_ts_utc, table

# Configuration of the repeatable routing queries: one route per event type.
ROUTES = [
    {"source": "view", "endpoint": "https://collector-a.example:8088/", "token": "tok-a-1234", "index": "web"},
    {"source": "click", "reader": "cmdlines", "sourcetype": "clicks"},
    {"source": "purchase", "endpoint": "https://collector-b.example:8088", "token": "tok-b-5678"},
    {"source": "signup", "endpoint": "https://collector-a.example:8088/", "token": "tok-a-1234", "index": "web",
     "sourcetype": "signups"},
    {"source": "error", "reader": "jsonlines"},
]
GLOBAL = {"endpoint": "https://collector-c.example:8088/", "token": None, "index": None, "sourcetype": None,
          "host": "ingest-1"}

ROUTES_SQL = """
  SELECT * FROM (VALUES
    ('view', 'https://collector-a.example:8088', 'tok-a-1234', 'web', 'tidelog:lines'),
    ('purchase', 'https://collector-b.example:8088', 'tok-b-5678', 'tmp', 'tidelog:lines'),
    ('signup', 'https://collector-a.example:8088', 'tok-a-1234', 'web', 'signups'))
    AS r(source, endpoint, token, "index", sourcetype)"""


def _routed(spark, sf_dir):
    ev = events_ts_utc(table(spark, sf_dir, "events"))
    ev = ev.select(F.col("event_type").alias("source"), "event_id", "user_id", "ts", "value")
    return route_events(ev, routes_frame(spark, ROUTES), GLOBAL)


def _routed_events(spark, sf_dir):
    return _routed(spark, sf_dir)[0]


@query("left_out_events", "O52", oracle="""
SELECT event_id, event_type AS source, 'incomplete route' AS reason FROM events WHERE event_type IN ('click', 'error')
""")
def left_out_events(spark, sf_dir):
    return _routed(spark, sf_dir)[1].select("event_id", "source", "reason")


@query("route_events", "O50 O51 O52 O53 O55", oracle=f"""
WITH r AS ({ROUTES_SQL})
SELECT e.event_id, r.endpoint, r."index" AS "index", r.sourcetype, 'user-' || e.user_id AS source,
       'ingest-1' AS host
FROM events e JOIN r ON e.event_type = r.source
""")
def route_events_q(spark, sf_dir):
    df = _routed_events(spark, sf_dir)
    d = overlay_defaults(index=[F.col("index")], sourcetype=[F.col("sourcetype")],
                         source=[F.concat(F.lit("user-"), F.col("user_id").cast("string"))], host=[F.col("host")])
    return df.select("event_id", "endpoint", d["index"].alias("index"), d["sourcetype"].alias("sourcetype"),
                     d["source"].alias("source"), d["host"].alias("host"))


@query("mask_secrets", "O56", oracle=r"""
SELECT c_custkey,
       regexp_replace(c_name, '[^-]', 'x', 'g') AS masked,
       'xxxxxxxx-xxxx-xxxx-xxxx-xxxxxxxx' || right(c_name, 4) AS masked_last4
FROM customer
""")
def mask_secrets(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", mask_secret(F.col("c_name")).alias("masked"),
                    mask_keep_last4(F.col("c_name")).alias("masked_last4"))


@query("preview", "O57", oracle="""
SELECT doc_id,
       CASE WHEN length(text) > 100 THEN substr(text, 1, 98) || ' … ' ELSE text END AS preview_long,
       CASE WHEN length(text) > 80 THEN substr(text, 1, 79) || '…' ELSE text END AS preview_short
FROM documents
""")
def preview_q(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", preview(F.col("text"), "long").alias("preview_long"),
                    preview(F.col("text"), "short").alias("preview_short"))


@query("endpoints", "O55", oracle=r"""
SELECT page_id,
       regexp_replace(url, '/$', '') AS collector,
       CASE WHEN starts_with(url, 'https')
            THEN '/var/spool/tidelog/' || regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1)
            ELSE '/' || regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1) END AS file_target
FROM pages
""")
def endpoints(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    rest = F.regexp_extract("url", r"^[a-z]+://[^/]+/(.*)$", 1)
    target = F.when(F.col("url").startswith("https"), F.concat(F.lit("file://"), rest)) \
        .otherwise(F.concat(F.lit("file:///"), rest))
    return p.select("page_id", normalise_collector_url(F.col("url")).alias("collector"),
                    normalise_file_target(target, "/var/spool/tidelog/").alias("file_target"))


@query("payloads", "O60 O50 O25 O73", oracle=f"""
WITH r AS ({ROUTES_SQL}),
e AS (
  SELECT e.event_id, e.user_id, e.event_type,
         (epoch_us(e.ts) // 1000000)::VARCHAR || CASE WHEN e.event_id % 4 = 0 THEN '' ELSE '.' || lpad((e.event_id % 1000)::VARCHAR, 3, '0') || '000' END AS secs,
         'type=' || e.event_type || ' value=' || CAST(e.value AS VARCHAR) || ' note=é"\\ 𝄞' AS line,
         r."index" AS idx, r.sourcetype
  FROM events e JOIN r ON e.event_type = r.source),
p AS (SELECT event_id, rtrim(json_object('index', idx, 'sourcetype', CASE WHEN event_id % 6 = 0 THEN NULL ELSE sourcetype END, 'source', 'user-' || user_id,
                   'host', CASE WHEN event_id % 3 = 0 THEN 'edge-' || user_id % 5 ELSE 'ingest-1' END, 'fields', json_object('kind', event_type))::VARCHAR, '}}')
             || '}},"time":' || CASE WHEN event_id % 3 = 0 THEN event_id::VARCHAR ELSE secs END
             || CASE WHEN event_id % 3 = 0 THEN ',"k' || user_id % 7 || '":[' || user_id || ',null],"ä":{{"b":"ö"}}' ELSE '' END
             || ',"event":' || CASE WHEN event_id % 3 = 1 THEN '{{"id":' || event_id || '}}' ELSE to_json(line)::VARCHAR END || '}}' AS payload
      FROM e),
a AS (SELECT *, array_to_string(list_transform(regexp_extract_all(payload, '(?s).'), lambda c: CASE WHEN unicode(c) < 127 THEN c
          WHEN unicode(c) < 65536 THEN printf('\\u%04x', unicode(c))
          ELSE printf('\\u%04x\\u%04x', 55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)) END), '') AS payload_ascii FROM p)
SELECT event_id, payload, payload_ascii, CAST(strlen(payload) AS BIGINT) AS payload_bytes, CAST(strlen(payload_ascii) AS BIGINT) AS ascii_bytes FROM a
""")
def payloads(spark, sf_dir):
    """A third of the events are lines, a third objects, a third envelopes: they have their own host, time, now and then no sourcetype, and
    members whose names come from the data."""
    df = _routed_events(spark, sf_dir)
    line = F.concat(F.lit("type="), F.col("source"), F.lit(" value="), F.col("value").cast("string"),
                    F.lit(' note=é"\\ 𝄞'))
    fields = F.create_map(F.lit("kind"), F.col("source"))
    fraction = F.when(F.col("event_id") % 4 == 0, 0).otherwise((F.col("event_id") % 1000) * 1000)  # three in four have a fraction
    wire = timestamp_to_wire(F.timestamp_micros(F.unix_seconds("ts") * 1_000_000 + fraction))
    number = F.col("event_id").cast("string")
    given = F.concat(F.lit('{"ä": {"b": "ö"}, "time": '), number, F.lit(', "host": "edge-'), (F.col("user_id") % 5).cast("string"), F.lit('", "k'),
                     (F.col("user_id") % 7).cast("string"), F.lit('": ['), F.col("user_id").cast("string"), F.lit(", null], "),
                     F.when(F.col("event_id") % 6 == 0, '"sourcetype": null, ').otherwise(""), F.lit('"event": '), json_string(F.col("line")), F.lit("}"))
    text = F.when(F.col("event_id") % 3 == 0, given).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"id": '), number, F.lit("}")))
    df = df.withColumn("line", line).withColumn("wire", wire)
    df = df.withColumn("event_json", F.parse_json(text))

    def encoded(ascii: bool):
        return encode_payload(F.col("index"), F.col("sourcetype"), F.concat(F.lit("user-"), F.col("user_id").cast("string")), F.col("host"), fields,
                              F.col("wire"), event_text=F.col("line"), event_json=F.col("event_json"), ascii=ascii)

    df = df.select("event_id", encoded(False).alias("payload"), encoded(True).alias("payload_ascii"))
    return df.select("*", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.octet_length("payload_ascii").cast("bigint").alias("ascii_bytes"))
