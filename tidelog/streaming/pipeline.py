"""Run modes (O80-O82) and stream sinks.

* O80 continuous run: ``trigger(processingTime=step_interval)`` (0.5 s).
* O81 one-shot drain: ``trigger(availableNow=True)``: everything present is
  processed, in bounded micro-batches, then the query stops.
* O82 input bound per step: ``maxFilesPerTrigger`` / ``maxBytesPerTrigger`` on
  the source (a time-based bound has no exact counterpart).

Sinks write each micro-batch through ``foreachBatch`` (batch id + epoch make
the delivery key) or the built-in file sinks (exactly once with the sink's log).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

# Default step interval (seconds) of the continuous run.
STEP_INTERVAL_S = 0.5


def _trigger(writer, mode: str, interval_s: float):
    if mode == "drain":
        return writer.trigger(availableNow=True)
    if mode == "continuous":
        return writer.trigger(processingTime=f"{int(interval_s * 1000)} milliseconds")
    raise ValueError("mode is 'drain' or 'continuous'")


def write_parquet(df: DataFrame, path: str, checkpoint: str, mode: str = "drain",
                  interval_s: float = STEP_INTERVAL_S, partition_by: list[str] | None = None) -> StreamingQuery:
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    return _trigger(w, mode, interval_s).start()


def write_text(df: DataFrame, column: str, path: str, checkpoint: str, mode: str = "drain",
               interval_s: float = STEP_INTERVAL_S, partition_by: list[str] | None = None) -> StreamingQuery:
    """O64 as a stream: one line per payload or batch, partitioned by e.g. index."""
    cols = [column] + list(partition_by or [])
    w = df.select(*cols).writeStream.format("text").option("path", path) \
        .option("checkpointLocation", checkpoint).outputMode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    return _trigger(w, mode, interval_s).start()


def for_each_batch(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "drain",
                   interval_s: float = STEP_INTERVAL_S) -> StreamingQuery:
    """Per micro-batch batch operators (packing O62, delivery O65) on a stream."""
    w = df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    return _trigger(w, mode, interval_s).start()


def drain(query: StreamingQuery, timeout_s: float | None = None) -> None:
    """Wait for a one-shot drain to finish, however long it takes; raise its
    error if it failed.  With ``timeout_s``, a drain that takes longer is stopped
    and an error raised: its output is not whole."""
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"the drain took more than {timeout_s} s and was stopped; its output is not whole")
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
