"""The HTTP collector sink.

Batches go to an injected ``send(endpoint, token, body) -> (status, reply)``
(a real client posts the body with the token header; ``token`` should be a key that
``send`` resolves, as unsent batches are written with it).  Two forms:
``deliver_batches`` records the outcome of every batch as a DataFrame (see
``operators.delivery.deliver``), and ``CollectorSink`` is a ``foreachBatch``
callable for a stream.  In each step it sends what the step before left unsent, then the
new batches, in order, up to a group's first failure; the rest is written to the
step's own folder of the retry table.  A replayed step reads the same folder and
overwrites its own, so no batch is queued twice; sending itself is at least once.

A stream without new data calls no sink, so what failed last would wait for more.  ``CollectorSink.resend`` sends it again
without input: call it from the loop that waits for the query, between steps (``query.processAllAvailable()``), and once after its end.
Each attempt is a folder of its own in the step's, and the last one that is whole counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.delivery import FAILED, SENT, deliver, deliver_in_order, is_transient, outcome

STEP = "batch_id"


def deliver_batches(batches: DataFrame, send, batch_col: str = "batch") -> DataFrame:
    out = deliver(batches, send, batch_col=batch_col)
    return out.withColumn("requeue", is_transient(F.col("outcome")))


class CollectorSink:
    """``order_cols`` order the batches of one step (none: any order); older steps come first."""

    def __init__(self, send, retry_path: str, order_cols: list[str] | None = None, batch_col: str = "batch"):
        self.send, self.retry_path, self.order_cols, self.batch_col = send, retry_path.rstrip("/"), list(order_cols or []), batch_col

    def _folder(self, step: int, attempt: int) -> str:
        return f"{self.retry_path}/step={step}/attempt={attempt}"

    def _numbers(self, spark, folder: str, name: str) -> list[int]:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [x.getPath().getName() for x in fs.listStatus(path)]
        return sorted(int(x.removeprefix(name)) for x in found if x.startswith(name))

    def _attempt(self, spark, step: int) -> int | None:
        """The last attempt of a step whose result was written to its end."""
        fs = spark._jvm.org.apache.hadoop.fs.Path(self.retry_path).getFileSystem(spark._jsc.hadoopConfiguration())
        whole = [n for n in self._numbers(spark, f"{self.retry_path}/step={step}", "attempt=")
                 if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(self._folder(step, n) + "/_SUCCESS"))]
        return max(whole, default=None)

    def unsent(self, spark, step: int, schema) -> DataFrame:
        """What a step left unsent; nothing where this sink did not run that step."""
        last = self._attempt(spark, step)
        return spark.createDataFrame([], schema) if last is None else spark.read.schema(schema).parquet(self._folder(step, last))

    def _flush(self, queue: DataFrame, step: int, attempt: int) -> None:
        res = deliver_in_order(queue, self.send, [STEP, *self.order_cols], self.batch_col)
        res.where(F.col("state") != SENT).withColumn("outcome", F.when(F.col("state") == FAILED, outcome(F.col("status")))) \
            .write.mode("overwrite").parquet(self._folder(step, attempt))

    def __call__(self, df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        new = df.withColumn(STEP, F.lit(batch_id).cast("long"))
        queue = self.unsent(spark, batch_id - 1, new.schema).unionByName(new)
        fs = spark._jvm.org.apache.hadoop.fs.Path(self.retry_path).getFileSystem(spark._jsc.hadoopConfiguration())
        for attempt in self._numbers(spark, f"{self.retry_path}/step={batch_id}", "attempt="):   # of a step that is replayed
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(self._folder(batch_id, attempt)), True)
        self._flush(queue, batch_id, 0)

    def resend(self, spark) -> int:
        """Send again, without new input, what the last step left unsent; how many batches are still unsent."""
        steps = self._numbers(spark, self.retry_path, "step=")
        last = self._attempt(spark, steps[-1]) if steps else None
        if last is None:
            return 0
        left = spark.read.parquet(self._folder(steps[-1], last))
        if left.isEmpty():
            return 0
        self._flush(left.drop("status", "reply", "state", "outcome"), steps[-1], last + 1)
        return spark.read.parquet(self._folder(steps[-1], last + 1)).count()
