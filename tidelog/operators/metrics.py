"""Per-source counters (O70) and size measures.

All are plain aggregations: partial (map-side) aggregation happens before the
shuffle, so a hot source costs one small partial row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def source_counters(df: DataFrame, source: str = "source", status: str = "status") -> DataFrame:
    """events (errors and reader rejects not counted, as in the reference),
    queued, filtered, rejected, errors per source."""
    s = F.col(status)
    return df.groupBy(source).agg(
        F.count_if(~s.isin("error", "rejected")).alias("events"),
        F.count_if(s == "queued").alias("queued"),
        F.count_if(s == "filtered").alias("filtered"),
        F.count_if(s == "rejected").alias("rejected"),
        F.count_if(s == "error").alias("errors"))


def size_measures(df: DataFrame, group_cols: list[str], payload: str = "payload", sep: str = " ") -> DataFrame:
    """count, bytes, bytes with separators (``bytes + max(0, n-1) * len(sep)``)."""
    n = F.count(F.lit(1))
    b = F.sum(F.octet_length(F.col(payload))).cast("bigint")
    sep_len = len(sep.encode("utf-8"))
    return df.groupBy(*group_cols).agg(
        n.alias("items"), b.alias("bytes"),
        (b + F.greatest(F.lit(0), n - 1) * F.lit(sep_len)).cast("bigint").alias("bytes_with_sep"))


def observe_counters(df: DataFrame, name, status: str = "status") -> DataFrame:
    """The same counters as observed metrics, without a separate aggregation
    job: per micro-batch on a stream (``name`` is a string; read them from the
    query's progress), or once on a batch (``name`` is an ``Observation``)."""
    s = F.col(status)
    return df.observe(name, F.count_if(~s.isin("error", "rejected")).alias("events"),
                      F.count_if(s == "queued").alias("queued"),
                      F.count_if(s == "filtered").alias("filtered"),
                      F.count_if(s == "rejected").alias("rejected"))

