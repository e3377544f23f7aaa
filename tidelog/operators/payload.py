"""Payload encoding.

One JSON object per event with members ``index, sourcetype, source, host,
fields, time, event`` in that order; nulls are written; ``time`` is the
number as detected (epoch seconds, with a fraction where there is one); ``event`` is a JSON string or, for decoded records, the JSON
value itself.  Compact separators and raw UTF-8 (the reference writes
``", "`` separators); with ``ascii`` all else is written as ``\\uXXXX``, as the reference does.  Sizes in packing are the
bytes of this text.

An event that is an object with a member ``event`` is an envelope (O50): that member is the event, its other members,
whatever their names, go to the payload, over the defaults of the same name; new ones come before ``event`` in the order of their names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.jsonv import bind

_OPTS = {"ignoreNullFields": "false"}


def json_string(c: Column) -> Column:
    """JSON text of a string value (quoted, escaped): ``{"s":X}`` minus the wrapper."""
    j = F.to_json(F.struct(c.alias("s")), _OPTS)
    return j.substr(F.lit(6), F.length(j) - 6)


def envelope_members(event_json: Column) -> Column:
    """The members of a decoded event that is an envelope (MAP<STRING,VARIANT>), NULL of any other."""
    members = F.try_variant_get(event_json, "$", "map<string,variant>")
    return F.when(F.map_contains_key(members, "event"), members)


def ascii_json(text: Column) -> Column:
    """JSON text with every character beyond ASCII as ``\\uXXXX`` (two of them for one beyond the basic plane)."""
    def escaped(run: Column) -> Column:
        return F.when(run.rlike(r"^[\x00-\x7E]"), run).otherwise(F.regexp_replace(F.lower(F.hex(F.encode(run, "UTF-16BE"))), "(.{4})", r"\\u$1"))
    runs = F.regexp_extract_all(text, F.lit(r"[\x00-\x7E]+|[^\x00-\x7E]+"), F.lit(0))
    return F.when(text.rlike(r"[^\x00-\x7E]"), F.array_join(F.transform(runs, escaped), "")).otherwise(text)


def _number(time: Column) -> Column:
    wire = time.cast("string")
    return F.when(wire.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$"), wire).otherwise(F.coalesce(time.try_cast("bigint").cast("string"), F.lit("null")))


def encode_payload(index: Column, sourcetype: Column, source: Column, host: Column, fields: Column,
                   time: Column, event_text: Column | None = None, event_json: Column | None = None, ascii: bool = False) -> Column:
    """Payload JSON text (see module doc)."""
    head = F.to_json(F.struct(index.alias("index"), sourcetype.alias("sourcetype"), source.alias("source"),
                              host.alias("host"), fields.alias("fields")), _OPTS)
    head = F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(',"time":'), _number(time))
    if event_json is None:
        text = F.concat(head, F.lit(',"event":'), json_string(event_text), F.lit("}"))
    else:
        own = {"index": json_string(index), "sourcetype": json_string(sourcetype), "source": json_string(source), "host": json_string(host),
               "fields": F.to_json(fields, _OPTS), "time": _number(time)}

        def merged(members: Column) -> Column:
            known = [F.concat(F.lit(f'"{k}":'), F.when(F.map_contains_key(members, k), F.coalesce(F.to_json(F.element_at(members, k)), F.lit("null")))
                              .otherwise(F.coalesce(v, F.lit("null")))) for k, v in own.items()]
            rest = F.to_json(F.map_filter(members, lambda k, _: ~k.isin("event", *own)), _OPTS)
            rest = F.when(F.length(rest) > 2, F.concat(F.lit(","), rest.substr(F.lit(2), F.length(rest) - 2))).otherwise("")
            return F.concat(F.lit("{"), F.concat_ws(",", *known), rest, F.lit(',"event":'),
                            F.coalesce(F.to_json(F.element_at(members, "event")), F.lit("null")), F.lit("}"))

        event = F.to_json(event_json) if event_text is None else F.coalesce(F.to_json(event_json), json_string(event_text))
        plain = F.concat(head, F.lit(',"event":'), F.coalesce(event, F.lit("null")), F.lit("}"))
        text = F.coalesce(bind(envelope_members(event_json), lambda m: F.when(m.isNotNull(), merged(m))), plain)
    return bind(text, ascii_json) if ascii else text
