"""Throttle (O71) and message throttle.

Per tag an event is kept when at least ``limit`` seconds passed since the last
*kept* event (``>=``); the first is kept; a kept event whose processing failed
does not start the clock.

The rule is greedy, and one tag may hold a third of all rows, so it runs
exactly and in parallel in three steps (as the packing does):

1. **Chunks.** ``repartitionByRange(tag, time)`` cuts the rows into bounded, sorted
   range partitions; a hot tag runs over many.  The input dealt so is checkpointed
   (reliably, lazily), so both passes below see the same partitions.
2. **Edge reports.**  All tags but the first and the last of a partition lie in it whole
   and need no other.  For the last, the clock at the partition's end is reported.  For
   the first, an entering clock ``L`` is older than its first time ``t0``, so its first
   kept event is one of those before ``t0 + limit`` (or the one after): the report
   has those candidates with their end clocks (from a successful kept event ``i``
   the next one is found by binary search, in a reverse pass).
3. **Walk and scan.**  Per tag, a walk over its reports fixes the clock that enters each
   partition, one value a partition; with it each partition is scanned once in order.
   Both passes go over Arrow batches of many tags (no call, frame or copy per
   tag).  Equal to the sequential rule (tested against it).

``throttle_scan`` keeps the single ordered scan (``sequential.ordered_scan``)
for comparison.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .sequential import key_segments, ordered_scan, run_starts

_T = "__tl_thr_t"


def throttle_sequential(times, limit: float, failed=None) -> list[bool]:
    """Plain specification of the rule."""
    out, clock = [], None
    for i, t in enumerate(times):
        ok = clock is None or t - clock >= limit
        out.append(ok)
        if ok and not (failed is not None and failed[i]):
            clock = t
    return out


def _step(limit: float, failed_col: str | None):
    def step(seg: pd.DataFrame, clock):
        t = seg[_T].to_numpy(dtype=np.int64)
        n = len(t)
        kept = np.zeros(n, dtype=bool)
        failed = seg[failed_col].fillna(False).to_numpy(dtype=bool) if failed_col else None
        i = 0
        while i < n:
            if clock is not None:
                i += int(np.searchsorted(t[i:], clock + limit, side="left"))
                if i >= n:
                    break
            kept[i] = True
            if failed is not None and failed[i]:
                i += 1
                # the clock did not move: the following events pass as well
                while i < n and failed[i]:
                    kept[i] = True
                    i += 1
                if i < n:
                    kept[i] = True
                    clock = t[i]
                    i += 1
                continue
            clock = t[i]
            i += 1
        return {"kept": kept}, clock
    return step


def throttle_scan(df: DataFrame, tag: Column | str, time_col: str, limit: float, order_cols: list[str] | None = None,
                  failed_col: str | None = None, tag_col: str = "tag") -> DataFrame:
    """Add ``kept BOOLEAN``.  ``time_col`` is a TIMESTAMP or epoch seconds;
    ``order_cols`` break ties of equal times (default: the time only).  Times
    are compared as integer microseconds, so the ``>=`` boundary is exact."""
    tcol = F.col(time_col)
    micros = F.unix_micros(tcol.cast("timestamp")) if dict(df.dtypes)[time_col].startswith("timestamp") \
        else (tcol.cast("decimal(20,6)") * F.lit(1_000_000)).cast("long")
    d = df.withColumn(tag_col, tag if isinstance(tag, Column) else F.col(tag)).withColumn(_T, micros)
    out = ordered_scan(d, [tag_col], [_T] + list(order_cols or []), [T.StructField("kept", T.BooleanType())],
                       _step(int(round(limit * 1_000_000)), failed_col), lambda: None)
    return out.drop(_T)


def message_tag(*parts: Column | str) -> Column:
    """The tag of a message throttle: its template parts joined by ``|``."""
    return F.concat_ws("|", *[F.col(p) if isinstance(p, str) else p for p in parts])


# --- exact parallel form ----------------------------------------------------

_NONE = -(1 << 62)          # "no clock yet" / "clock unchanged" marker


def chunk_tables(t: np.ndarray, failed: np.ndarray, limit: int):
    """Per chunk (times sorted): next successful index from each position,
    and the end clock for a successful kept event at each position."""
    n = len(t)
    jump = np.searchsorted(t, t + limit, side="left")   # first index with t >= t_i + limit
    jump = np.maximum(jump, np.arange(n) + 1)
    nextok, end = [n] * (n + 1), [0] * n
    for i, bad in zip(range(n - 1, -1, -1), failed[::-1].tolist()):
        nextok[i] = nextok[i + 1] if bad else i
    for i, j, at in zip(range(n - 1, -1, -1), jump[::-1].tolist(), t[::-1].tolist()):
        k = nextok[j]
        end[i] = at if k >= n else end[k]
    return np.array(nextok, dtype=np.int64), jump, np.array(end, dtype=np.int64)


def chunk_report(t: np.ndarray, failed: np.ndarray, limit: int):
    """Candidates an entering clock can lead to: thresholds ``t[:k]`` and, for
    each start 0..k, the end clock (``_NONE`` = the entering clock stays)."""
    n = len(t)
    nextok, _, end = chunk_tables(t, failed, limit)
    k = int(np.searchsorted(t, t[0] + limit, side="left")) if n else 0
    exits = []
    for s in range(k + 1):
        if s >= n:
            exits.append(_NONE)
        else:
            q = nextok[s]
            exits.append(int(end[q]) if q < n else _NONE)
    return t[:k].tolist(), exits


def walk_reports(reports, limit: int) -> list[tuple[int, int]]:
    """Per tag, chunks in order: ``(start index, entering clock)`` per chunk."""
    clock, out = _NONE, []
    for cand_t, exits in reports:
        s = 0 if clock == _NONE else int(np.searchsorted(np.asarray(cand_t, dtype=np.int64), clock + limit,
                                                          side="left"))
        out.append((s, clock))
        ex = exits[s]
        if ex != _NONE:
            clock = ex
    return out


def mark_kept(t: np.ndarray, failed: np.ndarray, start: int, limit: int) -> np.ndarray:
    """Kept flags of one chunk given the first index the entering clock allows."""
    n = len(t)
    kept = np.zeros(n, dtype=bool)
    i = start
    while i < n:
        kept[i] = True
        if failed[i]:
            i += 1                      # clock unchanged: the next event passes too
            continue
        i = max(i + 1, int(np.searchsorted(t, t[i] + limit, side="left")))
    return kept


def scan_kept(first: list[bool], t: list[int], failed: list[bool], limit: int, clock: int) -> tuple[list[bool], int]:
    """Kept flags of sorted rows of many tags, ``first`` where a tag begins, and the clock after them; ``clock``
    is the one that enters the first row, if that one goes on with a tag."""
    kept = []
    for new, at, bad in zip(first, t, failed):
        if new:
            clock = _NONE
        ok = clock == _NONE or at - clock >= limit
        kept.append(ok)
        if ok and not bad:
            clock = at
    return kept, clock


def edge_runs(batches, tag_col: str, time_col: str, failed_col: str):
    """The first and the last tag of sorted rows: ``(tag, times, failed, is the first)``, or the one where there is one tag."""
    held: list[pd.DataFrame] = []          # pieces of the tag that the rows so far end with
    is_first = True

    def run(pieces):
        seg = pd.concat(pieces, ignore_index=True)
        return seg[tag_col].iloc[0], seg[time_col].to_numpy(dtype=np.int64), seg[failed_col].to_numpy(dtype=bool), is_first

    for pdf in batches:
        if pdf.empty:
            continue
        starts = run_starts(pdf, [tag_col]).tolist()
        if held and _goes_on(held[-1], pdf, tag_col):
            starts = starts[1:]
            held.append(pdf.iloc[:starts[0]] if starts else pdf)
        if not starts:
            continue
        if not held and len(starts) > 1:
            held = [pdf.iloc[:starts[1]]]
        if held and is_first:
            yield run(held)
            is_first = False
        held = [pdf.iloc[starts[-1]:]]
    if held:
        yield run(held)


def _goes_on(before: pd.DataFrame, after: pd.DataFrame, tag_col: str) -> bool:
    """Whether the first row of ``after`` has the tag of the last row of ``before``."""
    return len(run_starts(pd.concat([before[[tag_col]].iloc[-1:], after[[tag_col]].iloc[:1]]), [tag_col])) == 1


def throttle(df: DataFrame, tag: Column | str, time_col: str, limit: float, order_cols: list[str] | None = None,
             failed_col: str | None = None, tag_col: str = "tag", partitions: int | None = None) -> DataFrame:
    """Add ``kept BOOLEAN`` (see module doc).  ``time_col`` is a TIMESTAMP or
    epoch seconds; ``order_cols`` break ties of equal times.  Times are compared
    as integer microseconds, so the ``>=`` boundary is exact.  A NULL tag is a tag
    of its own; an event without a time gets ``kept`` NULL and sets no clock."""
    order_cols = list(order_cols or [])
    tcol = F.col(time_col)
    micros = F.unix_micros(tcol.cast("timestamp")) if dict(df.dtypes)[time_col].startswith("timestamp") \
        else (tcol.cast("decimal(20,6)") * F.lit(1_000_000)).cast("long")
    lim = int(round(limit * 1_000_000))
    fcol = "__tl_thr_f"
    d = df.withColumn(tag_col, tag if isinstance(tag, Column) else F.col(tag)).withColumn(_T, micros) \
        .withColumn(fcol, F.coalesce(F.col(failed_col), F.lit(False)) if failed_col else F.lit(False))
    untimed = d.where(F.col(_T).isNull()).drop(_T, fcol).withColumn("kept", F.lit(None).cast("boolean"))
    d = d.where(F.col(_T).isNotNull())
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ch, clock, head = "__tl_thr_c", "__tl_thr_k", "__tl_thr_h"
    # The range bounds come from a sample; both passes must see the same partitions,
    # so the input dealt by them is one RDD: a reliable (not local) lazy checkpoint in
    # the session's checkpoint directory, which also cuts the lineage.
    ensure_checkpoint_dir(df.sparkSession)
    sort_cols = [ch, tag_col, _T] + order_cols
    d = d.repartitionByRange(parts, tag_col, _T, *order_cols).withColumn(ch, F.spark_partition_id()) \
        .sortWithinPartitions(*sort_cols).checkpoint(eager=False)

    rep_schema = T.StructType([d.schema[tag_col], T.StructField(ch, T.IntegerType()), T.StructField(head, T.BooleanType()),
                               T.StructField("cand_t", T.ArrayType(T.LongType())),
                               T.StructField("exits", T.ArrayType(T.LongType()))])

    def report(it):
        at = []

        def noted():
            for pdf in it:
                at[:] = at or pdf[ch].iloc[:1].tolist()
                yield pdf

        rows = []
        for tg, t, failed, is_first in edge_runs(noted(), tag_col, _T, fcol):
            cand_t, exits = chunk_report(t, failed, lim)
            rows.append((tg, at[0], is_first, cand_t, exits) if is_first else (tg, at[0], False, [], exits[:1]))
        if rows:
            yield pd.DataFrame(rows, columns=rep_schema.names)

    reports = d.select(tag_col, ch, _T, fcol).sortWithinPartitions(ch, tag_col, _T).mapInPandas(report, rep_schema)
    entry_schema = T.StructType([T.StructField(ch, T.IntegerType()), T.StructField(clock, T.LongType())])

    def walk(it):
        rows = []
        for seg in key_segments(it, [tag_col]):
            res = walk_reports(zip(seg["cand_t"], seg["exits"]), lim)
            rows.extend((c, r[1]) for c, h, r in zip(seg[ch], seg[head], res) if h and r[1] != _NONE)
        if rows:
            yield pd.DataFrame(rows, columns=entry_schema.names)

    # One clock a partition at most: small enough for every task to have all of them.
    entries = reports.repartition(parts, tag_col).sortWithinPartitions(tag_col, ch) \
        .mapInPandas(walk, entry_schema)
    out_schema = T.StructType([f for f in d.schema.fields if f.name not in (_T, fcol, ch)]
                              + [T.StructField("kept", T.BooleanType())])
    names = out_schema.names

    def scan(it):
        last, now = None, _NONE
        for pdf in it:
            if pdf.empty:
                continue
            first = np.zeros(len(pdf), dtype=bool)
            first[run_starts(pdf, [tag_col])] = True
            if last is None:                 # the partition's first tag may have begun before it
                first[0], now = False, pdf[clock].iloc[0]
                now = _NONE if pd.isna(now) else int(now)
            else:
                first[0] = not _goes_on(last, pdf, tag_col)
            kept, now = scan_kept(first.tolist(), pdf[_T].tolist(), pdf[fcol].tolist(), lim, now)
            last = pdf[[tag_col]].iloc[-1:]
            yield pdf.assign(kept=kept)[names]

    entered = d.join(F.broadcast(entries), ch, "left").sortWithinPartitions(*sort_cols)
    return entered.mapInPandas(scan, out_schema).unionByName(untimed)
