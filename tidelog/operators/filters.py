"""Filters and status.

Rather than dropping rows, ``classify`` gives every row a ``status`` and a
``reason`` so that counters (O70) and rejects stay visible; ``queued`` keeps
the rows that go on.  Order of tests as in the reference: blank before age.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip

DEFAULT_AGE_LIMIT = 2_000_000  # seconds (about 23 days); 0 turns the filter off


def is_blank(event_text: Column | None = None, event_json: Column | None = None) -> Column:
    """Falsy event after stripping strings: '', NULL, 0, false, {}, []."""
    if event_json is not None:
        t = F.schema_of_variant(event_json)
        js = F.to_json(event_json)
        blank_json = (event_json.isNull() | F.is_variant_null(event_json)
                      | js.isin("{}", "[]", "0", "false", '""', "0.0")
                      | ((t == "STRING") & (F.length(py_strip(F.variant_get(event_json, "$", "string"))) == 0)))
        if event_text is None:
            return blank_json
        return F.when(event_json.isNotNull(), blank_json).otherwise(
            F.coalesce(F.length(py_strip(event_text)) == 0, F.lit(True)))
    return F.coalesce(F.length(py_strip(event_text)) == 0, F.lit(True))


def too_old(epoch: Column, now: Column, limit: int = DEFAULT_AGE_LIMIT) -> Column:
    """``int(now) - int(time) > limit`` (strict); ``limit=0`` is off; future is kept."""
    if not limit:
        return F.lit(False)
    return (now - epoch) > F.lit(limit)


def classify(blank: Column, epoch: Column, now: Column, limit: int = DEFAULT_AGE_LIMIT,
             rejected: Column | None = None, time_present: Column | None = None) -> tuple[Column, Column]:
    """``(status, reason)``: rejected / filtered (blank, too old) / error (bad
    time) / queued."""
    rejected = F.lit(False) if rejected is None else rejected
    bad_time = epoch.isNull() if time_present is None else (time_present & epoch.isNull())
    status = (F.when(rejected, F.lit("rejected"))
              .when(blank, F.lit("filtered"))
              .when(F.lit(bool(limit)) & bad_time, F.lit("error"))
              .when(F.coalesce(too_old(epoch, now, limit), F.lit(False)), F.lit("filtered"))
              .otherwise(F.lit("queued")))
    reason = (F.when(rejected, F.lit("invalid json"))
              .when(blank, F.lit("blank"))
              .when(F.lit(bool(limit)) & bad_time, F.lit("bad time"))
              .when(F.coalesce(too_old(epoch, now, limit), F.lit(False)), F.lit("too old")))
    return status, reason


def blank_filter(df: DataFrame, text_col: str = "event_text") -> DataFrame:
    return df.where(~is_blank(F.col(text_col)))


def age_filter(df: DataFrame, epoch_col: str, now: Column, limit: int = DEFAULT_AGE_LIMIT) -> DataFrame:
    return df.where(~F.coalesce(too_old(F.col(epoch_col), now, limit), F.lit(False)))
