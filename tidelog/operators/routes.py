"""Routing metadata and defaults.

``routes`` is configuration: one row per source with optional ``endpoint``,
``token``, ``index``, ``sourcetype``, ``host``.  Per-source values fall back to
the global settings (first non-null wins), then per-field fix-ups: index
defaults to ``tmp``, sourcetype to the reader's default.  A route still lacking
endpoint, token or index is skipped (O52) and its events are left out.

A source has one route: of several, the last configured one counts.  Whether
the routes are broadcast is left to Spark's size estimate and AQE.
"""

from __future__ import annotations

import socket

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import mask_secret, normalise_collector_url

# Base payload members, reader default sourcetypes and the index fix-up.
BASE_PAYLOAD = {"index": "main", "sourcetype": "json", "source": "unknown"}
READER_SOURCETYPES = {"lines": "tidelog:lines", "cmdlines": "tidelog:cmdlines",
                      "jsonlines": "tidelog:lines", "cmdjson": "tidelog:cmdlines", "packets": "tidelog:cmdlines"}
DEFAULT_INDEX = "tmp"

ROUTE_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("reader", T.StringType()),
    T.StructField("endpoint", T.StringType()), T.StructField("token", T.StringType()),
    T.StructField("index", T.StringType()), T.StructField("sourcetype", T.StringType()),
    T.StructField("host", T.StringType()),
])


def routes_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Routes from configuration rows; a source that is given again replaces its route."""
    last = {r.get("source"): tuple(r.get(f.name) for f in ROUTE_SCHEMA.fields) for r in rows}
    return spark.createDataFrame(list(last.values()), ROUTE_SCHEMA)


def resolve_routes(routes: DataFrame, global_opts: dict) -> tuple[DataFrame, DataFrame]:
    """Apply global fallback and fix-ups; split into (usable, skipped)."""
    g = {k: global_opts.get(k) for k in ("endpoint", "token", "index", "sourcetype", "host")}
    reader_default = F.element_at(
        F.create_map(*[F.lit(x) for kv in READER_SOURCETYPES.items() for x in kv]),
        F.coalesce(F.col("reader"), F.lit("lines")))
    r = routes.select(
        "source",
        normalise_collector_url(F.coalesce(F.col("endpoint"), F.lit(g["endpoint"]))).alias("endpoint"),
        F.coalesce(F.col("token"), F.lit(g["token"])).alias("token"),
        F.coalesce(F.col("index"), F.lit(g["index"]), F.lit(DEFAULT_INDEX)).alias("index"),
        F.coalesce(F.col("sourcetype"), F.lit(g["sourcetype"]), reader_default,
                   F.lit("tidelog:lines")).alias("sourcetype"),
        F.coalesce(F.col("host"), F.lit(g["host"]), F.lit(socket.gethostname())).alias("host"))
    ok = F.col("endpoint").isNotNull() & (F.length("endpoint") > 0) & F.col("token").isNotNull() \
        & (F.length("token") > 0) & F.col("index").isNotNull()
    skipped = r.where(~ok).select("source", "endpoint", mask_secret(F.col("token")).alias("token_masked"), "index")
    return r.where(ok), skipped


def route_events(events: DataFrame, routes: DataFrame, global_opts: dict,
                 source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """``(routed, left_out)``: events with endpoint, token, index, sourcetype and
    host attached, and those of skipped or unknown sources with the ``reason``."""
    usable, skipped = resolve_routes(routes.dropDuplicates(["source"]), global_opts)
    usable = usable.withColumnRenamed("source", "__tl_route_source")
    known = skipped.select(F.col("source").alias("__tl_route_source"), F.lit("incomplete route").alias("reason"))
    routed = events.join(usable, events[source_col] == usable["__tl_route_source"], "inner").drop("__tl_route_source")
    rest = events.join(usable, events[source_col] == usable["__tl_route_source"], "left_anti")
    left_out = rest.join(known, rest[source_col] == known["__tl_route_source"], "left").drop("__tl_route_source") \
        .withColumn("reason", F.coalesce("reason", F.lit("no route")))
    return routed, left_out


def overlay_defaults(index=None, sourcetype=None, source=None, host=None):
    """Base < route (source base) < call arguments < envelope, by coalesce."""
    cols = {}
    for name, layers in (("index", index), ("sourcetype", sourcetype), ("source", source), ("host", host)):
        layers = [c for c in (layers or []) if c is not None]
        base = BASE_PAYLOAD.get(name)
        if name == "host":
            base = socket.gethostname()
        cols[name] = F.coalesce(*layers, F.lit(base)) if layers else F.lit(base)
    return cols
