"""Stateful streaming forms of O24 (carried time) and O71 (throttle).

``applyInPandasWithState`` over ``BUCKETS`` buckets of sources (or tags), as there may be millions of them and a call
for each costs far more than its rows: inside a micro-batch a bucket's rows are sorted by key and order, the
bucket's state holds each key's last parsed time (or throttle clock) across batches and restarts (checkpoint).
As in the reference the state is kept for ever unless ``timeout`` is given (``GroupStateTimeout.ProcessingTimeTimeout``:
a key idle that long is dropped).  A bucket's rows of one micro-batch are in one task: the trigger's input
bound (``maxFilesPerTrigger`` / ``maxBytesPerTrigger``) bounds them.

``stream_carry_late`` is O24 where rows may come after later ones, also in another micro-batch.  It runs on
``transformWithStateInPandas`` with the RocksDB store: a row waits in the state of its source until no row before it
is to be expected, and timers put out what still waits in a source that has gone quiet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: Groups that the keys of a stream are dealt to.
BUCKETS = 1024
_BUCKET, _KEY = "__tl_bucket", "__tl_key"


def _bucketed(df: DataFrame, by: str, held: list[T.StructField], schema: T.StructType, timeout_ms: int | None, fn) -> DataFrame:
    """Run ``fn(rows, keys, values) -> (frames, new values)`` for each bucket of ``by`` and micro-batch.

    ``_KEY`` of ``rows`` is the place of a row's key in ``keys``; ``values`` maps a key to what is held of it (one value
    for each field of ``held``)."""
    state_schema = T.StructType([T.StructField("keys", T.ArrayType(df.schema[by].dataType)), T.StructField("seen", T.ArrayType(T.LongType()))]
                                + [T.StructField(f.name, T.ArrayType(f.dataType)) for f in held])

    def save(state: GroupState, values: dict, seen: dict) -> None:
        if timeout_ms:
            now = state.getCurrentProcessingTimeMs()
            for key in [k for k, at in seen.items() if at + timeout_ms <= now]:
                values.pop(key, None)
                del seen[key]
        if values:
            state.update((list(values), [seen.get(k, 0) for k in values], *(list(column) for column in zip(*values.values()))))
            if timeout_ms:
                state.setTimeoutDuration(max(1, min(seen[k] for k in values) + timeout_ms - now))
        elif state.exists:
            state.remove()

    def run(_, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        values, seen = {}, {}
        if state.exists:
            keys, times, *columns = state.get
            values, seen = dict(zip(keys, zip(*columns))), dict(zip(keys, times))
        if state.hasTimedOut:
            save(state, values, seen)
            return
        pdf = pd.concat(list(pdfs), ignore_index=True)
        codes, found = pd.factorize(pdf[by], use_na_sentinel=False)
        pdf[_KEY] = codes
        names = [None if pd.isna(k) else k.item() if hasattr(k, "item") else k for k in found]
        frames, new = fn(pdf, names, values)
        values |= new
        if timeout_ms:
            now = state.getCurrentProcessingTimeMs()
            seen |= dict.fromkeys(names, now)
        save(state, values, seen)
        for frame in frames:
            yield frame[schema.names]

    mode = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return df.withColumn(_BUCKET, F.pmod(F.xxhash64(by), F.lit(BUCKETS))).groupBy(_BUCKET) \
        .applyInPandasWithState(run, schema, state_schema, "append", mode)


def _starts(codes: np.ndarray) -> np.ndarray:
    """Where the rows of each key begin, of rows sorted by key."""
    return np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])[:len(codes)])


def stream_carry_time(df: DataFrame, by: str = "source", order: str = "seq",
                      timeout_ms: int | None = None) -> DataFrame:
    """Streaming O24: ``time_wire`` / ``event_time`` of rows without a time take
    the last one of their source, across micro-batches."""
    held = [T.StructField("w", T.StringType()), T.StructField("t", T.LongType())]

    def carry(pdf: pd.DataFrame, names: list, values: dict):
        pdf = pdf.sort_values([_KEY, order], kind="stable").reset_index(drop=True)
        codes = pdf[_KEY].to_numpy()
        starts = _starts(codes)
        begin, here = np.repeat(starts, np.diff([*starts, len(pdf)])), np.arange(len(pdf))
        has = pdf["time_wire"].notna().to_numpy()
        micros = pdf["event_time"].to_numpy(dtype="datetime64[us]")
        wire = pdf["time_wire"].to_numpy(dtype=object)
        from_w = np.maximum.accumulate(np.where(has, here, -1))
        from_t = np.maximum.accumulate(np.where(has & ~np.isnat(micros), here, -1))
        new_w = np.where(from_w >= begin, wire[from_w], None)
        new_t = np.where(from_t >= begin, micros[from_t], np.datetime64("NaT", "us"))
        ends, new = [*starts[1:], len(pdf)], {}
        for a, b in zip(starts.tolist(), ends):
            name = names[codes[a]]
            last = values.get(name)
            if last is not None:
                until = a + int((from_w[a:b] < a).sum())     # rows before the first time of this batch
                new_w[a:until] = last[0]
                new_t[a:until] = np.datetime64("NaT" if last[1] is None else last[1], "us")
            if from_w[b - 1] >= a:
                new[name] = (new_w[b - 1], None if np.isnat(new_t[b - 1]) else int(new_t[b - 1].astype(np.int64)))
        return [pdf.assign(time_wire=new_w, event_time=new_t)], new

    return _bucketed(df, by, held, df.schema, timeout_ms, carry)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _CarryLate(StatefulProcessor):
    """Rows of one source: those up to ``lateness`` below the highest order key wait, the rest are put out in order."""

    def __init__(self, schema: T.StructType, order: str, lateness: int, idle_ms: int):
        self.schema, self.order, self.lateness, self.idle_ms = schema, order, lateness, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mark = handle.getValueState("mark", "top long, out long, w string, t timestamp")
        self.waiting = handle.getListState("waiting", self.schema)

    def _rows(self, frame: pd.DataFrame) -> list[tuple]:
        return [tuple(None if v is pd.NaT or v is None or v != v else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v
                      for v in row) for row in frame.itertuples(index=False, name=None)]

    def _put_out(self, rows: list[tuple], top: int, mark: tuple) -> list[tuple]:
        """Rows in order with carried times; a row below one that is out already takes the last time but doesn't set it."""
        _, out, w, t = mark
        names = self.schema.names
        at, aw, a_t = names.index(self.order), names.index("time_wire"), names.index("event_time")
        done = []
        for row in sorted(rows, key=lambda r: r[at]):
            row = list(row)
            if row[aw] is None:
                row[aw], row[a_t] = w, t
            elif out is None or row[at] >= out:
                w, t = row[aw], row[a_t]
            out = row[at] if out is None else max(out, row[at])
            done.append(tuple(row))
        self.mark.update((top, out, w, t))
        return done

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.schema.names).astype({f.name: "datetime64[us]" for f in self.schema if isinstance(f.dataType, T.TimestampType)}
                                                                    | {f.name: "Int64" for f in self.schema if isinstance(f.dataType, T.IntegralType)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = self.mark.get() if self.mark.exists() else (None, None, None, None)
        at = self.schema.names.index(self.order)
        new = [r for f in rows for r in self._rows(f[self.schema.names])]
        every = ([tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []) + new
        top = max(r[at] for r in new) if mark[0] is None else max(mark[0], max(r[at] for r in new))
        ready, wait = [], []
        for r in every:
            (ready if r[at] <= top - self.lateness else wait).append(r)
        done = self._put_out(ready, top, mark)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if wait:
            self.waiting.put(wait)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        else:
            self.waiting.clear()
        yield self._frame(done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = self.mark.get()
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        self.waiting.clear()
        yield self._frame(self._put_out(rows, mark[0], mark))

    def close(self) -> None:
        pass


def stream_carry_late(df: DataFrame, by: str = "source", order: str = "seq", *, lateness: int, idle_ms: int = 60_000) -> DataFrame:
    """Streaming O24 for rows that may come after later ones: equal to the batch form as long as, when a row comes, the
    highest ``order`` of its source is at most ``lateness`` above its own.

    A row is put out when a row ``lateness`` above it has come, or when its source has had no row for ``idle_ms``
    (told in the next micro-batch of any source).  The state of a source is its last time and the rows that wait, all
    within ``lateness`` of its highest.  A row that comes later than that is put out at once with the last time.
    Rows need a non-null ``order``.  A drain (``availableNow``) has to run with ``spark.sql.streaming.noDataMicroBatches.enabled``
    off: while timers are in use Spark always has one more batch without data to run, and the drain would not end.
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own = df.where(F.col(order).isNotNull())
    return own.groupBy(by).transformWithStateInPandas(_CarryLate(df.schema, order, lateness, idle_ms), df.schema, "Append", "ProcessingTime")


def stream_throttle(df: DataFrame, tag_col: str, micros_col: str, limit_s: float, order: list[str],
                    timeout_ms: int | None = None, failed_col: str | None = None) -> DataFrame:
    """Streaming O71: ``kept`` per row; the clock of each tag is the state.  A
    failed event sets no clock; one without a time gets ``kept`` NULL."""
    schema = T.StructType(list(df.schema.fields) + [T.StructField("kept", T.BooleanType())])
    limit = int(round(limit_s * 1_000_000))

    def keep(pdf: pd.DataFrame, names: list, values: dict):
        timed = pdf[micros_col].notna()
        untimed, pdf = pdf[~timed], pdf[timed].sort_values([_KEY, micros_col] + order, kind="stable")
        codes = pdf[_KEY].to_numpy()
        t = pdf[micros_col].to_numpy(dtype=np.int64).tolist()
        failed = pdf[failed_col].fillna(False).to_numpy(dtype=bool).tolist() if failed_col else [False] * len(t)
        starts, kept, new = _starts(codes).tolist(), [], {}
        for a, b in zip(starts, [*starts[1:], len(t)]):
            name = names[codes[a]]
            clock = values.get(name, (None,))[0]
            for at, bad in zip(t[a:b], failed[a:b]):
                ok = clock is None or at - clock >= limit
                kept.append(ok)
                if ok and not bad:
                    clock = at
            if clock is not None:
                new[name] = (clock,)
        return [pdf.assign(kept=kept)] + ([untimed.assign(kept=None)] if len(untimed) else []), new

    return _bucketed(df, tag_col, [T.StructField("clock", T.LongType())], schema, timeout_ms, keep)
