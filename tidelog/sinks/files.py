"""The file sink.  Each payload (or packed batch) becomes one line of a
text file, partitioned by index; Spark's committer makes a job's output appear
whole or not at all, so a retried task never leaves half a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_json_lines(df: DataFrame, path: str, column: str = "payload", partition_by: list[str] | None = None,
                     mode: str = "append") -> None:
    cols = [column] + list(partition_by or [])
    w = df.select(*cols).write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.text(path)
