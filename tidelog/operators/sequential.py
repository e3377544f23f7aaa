"""Ordered per-group scans with carried state.

For greedy rules that read the previous *decision* (throttle, back-off), rows
are hash-partitioned by group, sorted by (group, order) inside each partition,
and a ``mapInPandas`` walks the Arrow batches carrying a small state from one
batch to the next.  Memory is bounded by one batch whatever the group size;
no group is ever collected.  Work inside a batch is vectorised where the rule
allows (the throttle jumps from kept event to kept event with a binary search).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def ordered_scan(df: DataFrame, group_cols: list[str], order_cols: list[str], out_fields: list[T.StructField],
                 step: Callable[[pd.DataFrame, object], tuple[dict, object]], init: Callable[[], object],
                 partitions: int | None = None) -> DataFrame:
    """Run ``step(group_rows, state) -> (new_columns, state)`` over each group's
    rows in order; a group split across Arrow batches keeps its state."""
    schema = T.StructType(list(df.schema.fields) + out_fields)
    parts = partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    d = df.repartition(int(parts), *group_cols).sortWithinPartitions(*group_cols, *order_cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur_key, state = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            starts_idx = run_starts(pdf, group_cols)
            idx = [int(i) for i in starts_idx] + [None]
            heads = pdf[group_cols].iloc[starts_idx]
            keys = [tuple(None if null else v for v, null in zip(*row)) for row in
                    zip(heads.itertuples(index=False, name=None), heads.isna().itertuples(index=False, name=None))]
            pieces = []
            for j, (a, b) in enumerate(zip(idx, idx[1:])):
                seg = pdf.iloc[a:] if b is None else pdf.iloc[a:b]
                k = keys[j]
                if k != cur_key:
                    cur_key, state = k, init()
                cols, state = step(seg, state)
                seg = seg.copy()
                for c, v in cols.items():
                    seg[c] = v
                pieces.append(seg)
            yield pd.concat(pieces, ignore_index=True)

    return d.mapInPandas(run, schema)


def run_starts(pdf: pd.DataFrame, key_cols: list[str]) -> np.ndarray:
    """Positions where the key differs from the row before (vectorised); NULLs are equal."""
    n = len(pdf)
    change = np.zeros(n, dtype=bool)
    if n:
        change[0] = True
    for c in key_cols:
        v, null = pdf[c].to_numpy(), pdf[c].isna().to_numpy()
        change[1:] |= (v[1:] != v[:-1]) & ~(null[1:] & null[:-1])
    return np.flatnonzero(change)


def key_segments(batches: Iterator[pd.DataFrame], key_cols: list[str]) -> Iterator[pd.DataFrame]:
    """Whole runs of equal keys from Arrow batches of a partition sorted by
    ``key_cols``; a run cut by a batch boundary is finished with the next batch.
    Used instead of ``applyInPandas`` where groups are many and small (one
    Python call per partition, not per group)."""
    held: list[pd.DataFrame] = []          # pieces of the last run, joined once
    for pdf in batches:
        if pdf.empty:
            continue
        bounds = list(run_starts(pdf, key_cols)) + [len(pdf)]
        if held:
            ends = pd.concat([held[-1][key_cols].iloc[-1:], pdf[key_cols].iloc[:1]])
            if len(run_starts(ends, key_cols)) > 1:
                yield pd.concat(held, ignore_index=True)
                held = []
        for a, b in zip(bounds, bounds[1:]):
            if a and held:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(pdf.iloc[a:b])
    if held:
        yield pd.concat(held, ignore_index=True)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` where NULL equals NULL; the key columns of ``left`` stay."""
    named = right.withColumnsRenamed({k: f"__tl_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(named[f"__tl_r_{k}"]) for k in keys])
    return left.join(named, on).drop(*[f"__tl_r_{k}" for k in keys])
