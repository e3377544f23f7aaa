"""JSON decoding into VARIANT with Python's strictness, and member access."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import py_strip


def member_path(key: str) -> str:
    """Variant path of a top-level object member."""
    if key.replace("_", "a").isalnum() and not key[0].isdigit():
        return "$." + key
    return "$['" + key.replace("'", "\\'") + "']"


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once per row, however often ``fn``
    uses it (a one-element ``transform``: the lambda variable holds the value).
    Catalyst would otherwise copy a large expression into every use, including
    a filter pushed below the projection that defined it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def strict_parse_json(c: Column) -> Column:
    """Decode a stripped string as one JSON value; NULL when blank or invalid.

    ``try_parse_json`` alone accepts trailing junk (``{"a":1} junk``), so a
    value is accepted only if ``is_strict_json`` holds; then it is decoded
    into VARIANT.  Of duplicate keys the last one counts
    (``spark.sql.variant.allowDuplicateKeys``); ``NaN`` stays a reject (Python
    would take it).
    """
    return F.when(is_strict_json(c), F.try_parse_json(py_strip(c)))


def is_strict_json(c: Column) -> Column:
    """The stripped text is exactly one JSON value (Python's acceptance, no
    trailing junk).  ``try_parse_json`` alone accepts ``{"a":1} junk``, so the
    text must be the single element of ``[...]`` *and* the value of
    ``{"v": ...}``; one wrapper alone lets ``1] junk`` or ``1} junk`` through.
    Both checks use Jackson's streaming validation (``json_array_length``,
    ``json_object_keys``): nothing is built, and duplicate keys pass as in
    Python."""
    s = py_strip(c)
    one = F.json_array_length(F.concat(F.lit("["), s, F.lit("]"))) == 1
    obj = F.json_object_keys(F.concat(F.lit('{"v":'), s, F.lit("}"))).isNotNull()
    # Only a text with a ``]`` can close the first wrapper early; a blank one leaves it empty.
    return F.coalesce(one & (~c.contains("]") | obj), F.lit(False))


def json_status(c: Column) -> Column:
    """'blank' (nothing after strip), 'invalid' or 'ok'."""
    blank = F.coalesce(F.length(py_strip(c)) == 0, F.lit(True))
    return (F.when(blank, F.lit("blank"))
            .when(strict_parse_json(c).isNull(), F.lit("invalid"))
            .otherwise(F.lit("ok")))


def string_member(v: Column, key: str) -> Column:
    """Top-level member ``key`` if the value is an object holding a JSON string there."""
    m = F.try_variant_get(v, member_path(key), "variant")
    return F.when(F.schema_of_variant(m) == "STRING", F.variant_get(m, "$", "string"))


def has_member(v: Column, key: str) -> Column:
    return F.try_variant_get(v, member_path(key), "variant").isNotNull()


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def is_object_with(v: Column, *keys: str) -> Column:
    """The value is an object holding every member in ``keys`` (``v`` evaluated once)."""
    def test(x):
        cond = is_object(x)
        for k in keys:
            cond = cond & has_member(x, k)
        return cond
    return F.coalesce(bind(v, test), F.lit(False))
