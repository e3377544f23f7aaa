"""Delivery outcome, back-off and the send step.

Outcome rule (O66): 2xx is ok and **400 counts as ok** (the collector refused
the data; it is not sent again); any other status is a server problem; no
response (connect/read failure) is a connection problem.  Connection and
server problems are transient: the batch is put back and the group backs off.

Back-off (O67): after a failed flush the group skips 2 steps, then 4, 8, ...
(no cap); a skipped step counts; a good flush resets.  A per-group ordered scan
(``sequential.ordered_scan``): runs of good steps are handled as a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sequential import ordered_scan

# Result codes of a send.
OK, CONNECTION, SERVER, DATA = "ok", "connection_error", "server_error", "data_error"

# States of a batch after a flush step.
SENT, FAILED, QUEUED = "sent", "failed", "queued"


def outcome(status: Column) -> Column:
    """HTTP status (NULL = no response) -> outcome."""
    return (F.when(status.isNull(), F.lit(CONNECTION))
            .when(status == 400, F.lit(OK))
            .when((status >= 200) & (status <= 299), F.lit(OK))
            .otherwise(F.lit(SERVER)))


def is_transient(out: Column) -> Column:
    return out.isin(CONNECTION, SERVER)


def backoff_sequential(oks) -> tuple[list[str], list[int]]:
    """Plain specification: action per step and the skip count after it."""
    n = c = 0
    actions, skips = [], []
    for ok in oks:
        if c < n:
            c += 1
            actions.append("skip")
        else:
            actions.append("send")
            if ok:
                n = c = 0
            else:
                n, c = (n * 2 if n > 0 else 2), 0
        skips.append(n)
    return actions, skips


def _backoff_step(ok_col: str):
    def step(seg: pd.DataFrame, st):
        n, c = st
        ok = seg[ok_col].fillna(False).to_numpy(dtype=bool)
        rows = len(ok)
        sent = np.zeros(rows, dtype=bool)
        skip_n = np.zeros(rows, dtype=np.int64)
        bad = np.flatnonzero(~ok)
        i = 0
        while i < rows:
            if c < n:
                k = min(n - c, rows - i)
                skip_n[i:i + k] = n
                c += k
                i += k
                continue
            sent[i] = True
            if ok[i]:
                j = bad[np.searchsorted(bad, i)] if np.searchsorted(bad, i) < len(bad) else rows
                sent[i:j] = True
                n = c = 0
                skip_n[i:j] = 0
                i = j
            else:
                n, c = (n * 2 if n > 0 else 2), 0
                skip_n[i] = n
                i += 1
        action = np.where(sent, "send", "skip")
        return {"action": action, "skip_steps": skip_n}, (n, c)
    return step


def backoff(df: DataFrame, group_cols: list[str], order_cols: list[str], ok_col: str) -> DataFrame:
    """Add ``action`` ('send' | 'skip') and ``skip_steps`` (steps to skip after
    this one) per flush step of each delivery group."""
    return ordered_scan(df, group_cols, order_cols,
                        [T.StructField("action", T.StringType()), T.StructField("skip_steps", T.LongType())],
                        _backoff_step(ok_col), lambda: (0, 0))


def settle(sent: DataFrame, group_cols: list[str], order_cols: list[str], status_col: str = "status", state_col: str = "state") -> DataFrame:
    """Add the state of each batch after one flush step, from the recorded statuses.

    A flush ends at the group's first transient failure: batches before it are ``sent``, it is
    ``failed``, and those after it stay ``queued`` whatever their status.  What isn't sent, in the same order,
    comes first in the next step.  A NULL group is a group of its own.  One pre-aggregated
    shuffle of the failures; a hot group is not gathered.
    """
    key = F.struct(*order_cols)
    first = sent.where(is_transient(outcome(F.col(status_col)))).groupBy(*group_cols).agg(F.min(key).alias("__tl_first")) \
        .withColumnsRenamed({c: f"__tl_g_{c}" for c in group_cols})
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__tl_g_{c}")) for c in group_cols])
    at = F.col("__tl_first")
    state = F.when(at.isNull() | (key < at), SENT).when(key == at, FAILED).otherwise(QUEUED)
    return sent.join(first, on, "left").withColumn(state_col, state).drop("__tl_first", *[f"__tl_g_{c}" for c in group_cols])


def deliver_in_order(batches: DataFrame, send: Callable[[str, str, str], tuple[int | None, str]], order_cols: list[str],
                     batch_col: str = "batch", endpoint_col: str = "endpoint", token_col: str = "token") -> DataFrame:
    """O65 with the flush rule: each (endpoint, token) group is sent in order and no more after its first transient
    failure.  Adds ``status``, ``reply`` and ``state``; order makes a group one task (a batch of rows is held)."""
    def step(seg: pd.DataFrame, stopped: bool):
        status, reply, state = [], [], []
        for e, t, b in zip(seg[endpoint_col], seg[token_col], seg[batch_col]):
            if stopped:
                code, text, now = None, None, QUEUED
            else:
                code, text = _attempt(send, e, t, b)
                stopped = code is None or not (code == 400 or 200 <= code <= 299)
                now = FAILED if stopped else SENT
            status.append(code)
            reply.append(text)
            state.append(now)
        return {"status": pd.array(status, dtype="Int32"), "reply": reply, "state": state}, stopped

    return ordered_scan(batches, [endpoint_col, token_col], order_cols, [
        T.StructField("status", T.IntegerType()), T.StructField("reply", T.StringType()), T.StructField("state", T.StringType())],
        step, lambda: False)


def _attempt(send: Callable[[str, str, str], tuple[int | None, str]], endpoint: str, token: str, body: str) -> tuple[int | None, str]:
    try:
        return send(endpoint, token, body)
    except OSError as problem:      # no connection, no answer
        return None, str(problem)


def deliver(batches: DataFrame, send: Callable[[str, str, str], tuple[int | None, str]],
            batch_col: str = "batch", endpoint_col: str = "endpoint", token_col: str = "token") -> DataFrame:
    """Send each batch with an injected ``send(endpoint, token, body) ->
    (status or None, reply)`` and record ``status``, ``reply``, ``outcome``.

    Runs in the executors (``mapInPandas``), one client per task; the function
    must be picklable.  Sending is at least once: re-running a failed task
    re-sends its batches, so a collector should de-duplicate on the batch key.
    """
    schema = T.StructType(list(batches.schema.fields) + [
        T.StructField("status", T.IntegerType()), T.StructField("reply", T.StringType())])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            res = [_attempt(send, e, t, b) for e, t, b in zip(pdf[endpoint_col], pdf[token_col], pdf[batch_col])]
            pdf = pdf.copy()
            pdf["status"] = pd.array([r[0] for r in res], dtype="Int32")
            pdf["reply"] = [r[1] for r in res]
            yield pdf

    out = batches.mapInPandas(run, schema)
    return out.withColumn("outcome", outcome(F.col("status")))
