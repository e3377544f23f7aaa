"""Envelope, carried time and time resolution.

``carry_forward`` is O24 in a form that survives one source holding a third of
all rows.  A plain ``last(ignorenulls).over(partitionBy(source).orderBy(seq))``
puts a whole source into one window task.  Instead:

1. rows are cut into chunks ``floor(seq / width)``;
2. each chunk reports its last non-null value (``max_by``, partially
   aggregated before its shuffle, so the report costs one small row per task
   and chunk);
3. the value entering a chunk is the last report of an earlier chunk: an as-of
   lookup solved by the same procedure on the (much smaller) report table,
   recursively, until it is small enough for a plain window;
4. the entering value is added to its chunk as a *seed* row ordered first, and
   one window over (source, chunk) fills every row: the big rows are shuffled
   and sorted once, with bounded work per window partition, and no join.

The result equals the plain window exactly; ``seq`` must be an integer order
key unique within a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonv
from ..functions.timefmt import detect_epoch, epoch_seconds, ts_epoch_seconds, wire_to_timestamp
from ..session import kept
from .extract import extract_fields

_P = "__tl_cf_"
DEFAULT_CHUNK = 1 << 16


def envelope(df: DataFrame, source: str = "source", text_col: str = "event_text",
             fields_col: str = "fields") -> DataFrame:
    """(event, source, fields) per line; ``fields`` is {} rather than NULL."""
    return df.withColumn(fields_col, F.coalesce(F.col(fields_col), F.create_map().cast("map<string,string>")))


def carry_forward(df: DataFrame, value_col: str, by: str, order: str, out_col: str | None = None,
                  width: int = DEFAULT_CHUNK, levels: int = 2) -> DataFrame:
    """``out_col`` = last non-null ``value_col`` at or before each row of ``by``
    in ``order`` (see module doc)."""
    out_col = out_col or value_col
    if levels <= 0:
        w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out_col, F.last(F.col(value_col), ignorenulls=True).over(w))
    ch, seed, cin, o2, v2 = (_P + s + str(levels) for s in ("ch", "seed", "cin", "o2", "v2"))
    d = df.withColumn(ch, F.floor(F.col(order) / F.lit(width)).cast("long"))
    report = d.groupBy(by, ch).agg(
        F.max_by(F.col(value_col), F.when(F.col(value_col).isNotNull(), F.col(order))).alias(v2))
    # As-of lookup: report rows sit at 2c+1, query rows at 2c; the carried value
    # at a query row is the last report of a chunk strictly before c.
    # Both rows come from one report row (one consumer of the report, so its
    # input is not derived twice).
    vtype = report.schema[v2].dataType
    pair = F.array(F.struct((F.col(ch) * 2 + 1).alias("o"), F.col(v2).alias("v")),
                   F.struct((F.col(ch) * 2).alias("o"), F.lit(None).cast(vtype).alias("v")))
    lookup = report.select(by, F.inline(pair)).select(by, F.col("o").alias(o2), F.col("v").alias(v2)) \
        .where((F.col(o2) % 2 == 0) | F.col(v2).isNotNull())
    lookup = carry_forward(lookup, v2, by, o2, out_col=v2, width=width, levels=levels - 1)
    seeds = lookup.where((F.col(o2) % 2 == 0) & F.col(v2).isNotNull()).select(
        by, (F.col(o2) / 2).cast("long").alias(ch), F.col(v2).alias(cin), F.lit(True).alias(seed))
    rows = d.withColumn(seed, F.lit(False)).withColumn(cin, F.lit(None).cast(vtype))
    u = rows.unionByName(seeds, allowMissingColumns=True)
    fill = F.coalesce(F.col(value_col), F.col(cin))
    w = Window.partitionBy(by, ch).orderBy(F.col(seed).desc(), F.col(order)) \
        .rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn(out_col, F.last(fill, ignorenulls=True).over(w))
    return u.where(~F.col(seed)).drop(ch, seed, cin)


def carry_time(df: DataFrame, by: str = "source", order: str = "seq", width: int = DEFAULT_CHUNK) -> DataFrame:
    """Rows without a parsed time take the last parsed time of their source.

    The input is kept in the checkpoint folder first: the chunks' reports and the rows both derive from it, and
    neither its extraction nor a scan that numbers its rows may run twice.

    Expects ``time_wire`` / ``event_time`` from the time parse; must run before
    any filter that drops rows (a dropped row still sets the carried time).  A
    row whose time text did not parse (``time_unparsed``) keeps no time: it is a
    reject, not a line without a time."""
    d = df.withColumn(_P + "t", F.when(F.col("time_wire").isNotNull(),
                                       F.struct(F.col("time_wire").alias("w"), F.col("event_time").alias("t"))))
    d = carry_forward(kept(d), _P + "t", by, order, width=width)
    if "time_unparsed" in df.columns:
        d = d.withColumn(_P + "t", F.when(~F.col("time_unparsed"), F.col(_P + "t")))
    return (d.withColumn("time_wire", F.col(_P + "t.w")).withColumn("event_time", F.col(_P + "t.t"))
            .drop(_P + "t"))


def two_passes(df: DataFrame, patterns, parse_time: str, *, text_col: str = "event_text", json_col: str = "event_json", mode: str = "stop") -> DataFrame:
    """A JSON line goes through its pattern set twice, as raw text and, where it is JSON, as an object.

    Adds ``json_col`` (NULL for a reject), ``fields`` (of the second pass alone), ``time_wire`` and ``event_time``: the time
    field of the second pass, else that of the first, which a reject has as well and so carries on to later lines.
    """
    def time_of(fields: str) -> Column:
        text = F.element_at(F.col(fields), F.lit(parse_time))
        return detect_epoch(F.when(F.length(text) > 0, text))

    raw, w1 = _P + "raw", _P + "w1"
    df = extract_fields(df, patterns, text_col=text_col, out_col=raw, mode=mode).withColumn(w1, time_of(raw))
    df = df.withColumn(json_col, jsonv.strict_parse_json(F.col(text_col)))
    df = extract_fields(df, patterns, text_col=None, json_col=json_col, mode=mode)
    df = df.withColumn("time_wire", F.coalesce(F.when(F.col(json_col).isNotNull(), time_of("fields")), F.col(w1)))
    return df.withColumn("event_time", wire_to_timestamp(F.col("time_wire"))).drop(raw, w1)


def resolve_time(env_time: Column, fields: Column, event_json: Column | None, now: Column,
                 env_given: Column | None = None) -> tuple[Column, Column]:
    """The payload time and where it came from, ``(value_text, origin)``.

    An envelope ``time`` that is given stays whatever it is (``env_given`` tells a
    given NULL from none; by default a value that is not NULL is given).  Else
    ``fields['time']`` if that key exists; else ``event.time`` if the event is an
    object; of these, NULL, an empty text and, for JSON values, zero, false and empty
    containers become ``now`` (the text ``'0'`` is a value)."""
    given = F.coalesce(env_time.isNotNull() if env_given is None else env_given, F.lit(False))
    has_field = F.coalesce(F.array_contains(F.map_keys(fields), F.lit("time")), F.lit(False))
    field = F.element_at(fields, F.lit("time"))
    event, usable = F.lit(None).cast("string"), F.lit(False)
    if event_json is not None:
        member = F.when(jsonv.is_object(event_json), F.try_variant_get(event_json, "$.time", "variant"))
        event = F.coalesce(F.try_variant_get(member, "$", "string"), F.to_json(member))
        is_text = F.schema_of_variant(member) == "STRING"
        usable = F.when(is_text, event != "").otherwise(
            ~event.isin("null", "false", "{}", "[]") & F.coalesce(event.try_cast("double") != 0, F.lit(True)))
    usable = F.coalesce(usable, F.lit(False))
    by_now = now.cast("string")
    value = F.when(given, env_time.cast("string")).when(has_field, F.when(field != "", field).otherwise(by_now)) \
        .when(usable, event).otherwise(by_now)
    origin = F.when(given, F.lit("envelope")).when(has_field, F.when(field != "", F.lit("fields")).otherwise(F.lit("now"))) \
        .when(usable, F.lit("event")).otherwise(F.lit("now"))
    return value, origin


def now_column(now: int | None) -> Column:
    """``now`` as epoch seconds: a fixed value (tests, repeatable queries) or the
    query's current timestamp."""
    return F.lit(now).cast("bigint") if now is not None else ts_epoch_seconds(F.current_timestamp())


__all__ = ["envelope", "carry_forward", "carry_time", "resolve_time", "now_column", "epoch_seconds"]
