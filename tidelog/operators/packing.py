"""Size-bounded packing of payloads into batches.

The reference's rule is greedy and in order: the next item joins the open
batch while ``len(batch) + len(sep) + len(item) < max``; a first item too
large for that goes alone.  Greedy means sequential, and one delivery group
may hold a third of all rows, so the packing is computed in parallel and
*exactly* in three steps:

1. **Chunk scan** (per (group, chunk); a chunk is a bounded
   run of consecutive items given by the caller, e.g. ``floor(seq / W)``).
   With ``Q[k] = sum(size[:k]) + k*len(sep)``, a fresh batch starting at item
   ``i`` ends before ``next(i)`` (one ``searchsorted``).  A reverse pass gives,
   for every start ``i``, the state at the chunk end (bytes of the open batch)
   and the number of batches started.  Only the starts an incoming open batch
   can lead to matter: the first ``K`` items with ``Q[k]-Q[0] < max``.
2. **Tree of summaries** (K+1 numbers per chunk).  Summaries of consecutive
   chunks compose into one of the same form.  ``repartitionByRange`` cuts the summaries of a
   hot group into blocks; each block is composed by itself, a walk per group
   reads one composed summary a block, and a walk per block then gives the open
   batch and the last batch number that enter each chunk.
3. **Assign** (per (group, chunk) again, joined with the walk result): batch
   numbers per item.

Each pass is one ``mapInPandas`` per partition over sorted runs of equal keys
(chunks are many and small; a Python call per group would dominate).

Batch numbers are equal to a sequential run over the whole group; a Python worker
holds a chunk, or one block of summaries, at a time.  The blocks come from sampled range bounds, so the
summaries are one lazy reliable checkpoint that both walks read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .sequential import join_null_safe, key_segments

# The collector batch limit and the two separators.
DEFAULT_MAX_BYTES = 102_400
COLLECTOR_SEP = " "
FILE_SEP = "\n"

_S = "__tl_size"
_B = "__tl_block"
_EMPTY = -1


def pack_sequential(sizes, max_bytes: int, sep_len: int) -> list[int]:
    """Plain sequential packing; the specification the parallel form must equal."""
    out, bid, b = [], -1, _EMPTY
    for s in sizes:
        if b != _EMPTY and b + sep_len + s < max_bytes:
            b += sep_len + s
        else:
            bid += 1
            b = s if sep_len + s < max_bytes else _EMPTY
        out.append(bid)
    return out


SUMMARY_SCHEMA = T.StructType([
    T.StructField("n", T.LongType()),
    T.StructField("qlead", T.ArrayType(T.LongType())),
    T.StructField("end", T.ArrayType(T.LongType())),
    T.StructField("cnt", T.ArrayType(T.LongType())),
])


def _tables(sizes, max_bytes, sep_len):
    n = len(sizes)
    q = np.concatenate([[0], np.cumsum(sizes + sep_len)]).astype(np.int64)
    first_fits = sizes + sep_len < max_bytes
    m = np.searchsorted(q, q[:n] + max_bytes + sep_len, side="left")
    nxt = np.where(first_fits, np.maximum(m - 1, np.arange(n) + 1), np.arange(n) + 1)
    open_end = first_fits & (m - 1 >= n)
    nxt = np.minimum(nxt, n)
    end = np.empty(n + 1, dtype=np.int64)
    cnt = np.zeros(n + 1, dtype=np.int64)
    end[n] = _EMPTY
    for i in range(n - 1, -1, -1):
        if open_end[i]:
            end[i], cnt[i] = q[n] - q[i] - sep_len, 1
        else:
            k = nxt[i]
            end[i], cnt[i] = end[k], 1 + cnt[k]
    return q, nxt, end, cnt


def chunk_summary(sizes: np.ndarray, max_bytes: int, sep_len: int):
    """Step 1 for one chunk: ``(n, qlead, end, cnt)`` for the starts an open
    batch entering the chunk can lead to (at most ``max_bytes/(sep+1)+1``)."""
    q, _, end, cnt = _tables(sizes, max_bytes, sep_len)
    rel = q - q[0]
    k = min(int(np.searchsorted(rel[1:], max_bytes, side="left")), len(sizes))
    return len(sizes), rel[: k + 1].tolist(), end[: k + 1].tolist(), cnt[: k + 1].tolist()


def _entered(qlead: np.ndarray, e, max_bytes: int):
    """How many leading items of a chunk join an open batch of ``e`` bytes."""
    return np.where(np.equal(e, _EMPTY), 0, np.searchsorted(qlead[1:], max_bytes - np.asarray(e), side="left"))


def compose(summaries, max_bytes: int):
    """The summary of consecutive chunks taken as one."""
    n, q, end, cnt = 0, np.zeros(1, dtype=np.int64), np.full(1, _EMPTY, dtype=np.int64), np.zeros(1, dtype=np.int64)
    for n2, *lists in summaries:
        q2, end2, cnt2 = (np.asarray(x, dtype=np.int64) for x in lists)
        t = _entered(q2, end, max_bytes)
        through = t >= n2
        cnt = cnt + np.where(through, 0, cnt2[t])
        end = np.where(through, end + q2[-1], end2[t])
        if len(q) > n:          # an open batch may take all so far: starts in the new part matter too
            q = np.concatenate([q, q[n] + q2[1:]])
            k = int(np.searchsorted(q[1:], max_bytes, side="left"))
            q, end, cnt = q[:k + 1], np.concatenate([end, end2[1:]])[:k + 1], np.concatenate([cnt, cnt2[1:]])[:k + 1]
        n += n2
    return n, q.tolist(), end.tolist(), cnt.tolist()


def walk_chunks(summaries, max_bytes: int, open_bytes: int = _EMPTY, last_id: int = -1) -> list[tuple[int, int]]:
    """``(open_bytes, last_id)`` that enter each of consecutive chunks (or blocks of them)."""
    e, res = open_bytes, []
    for n, qlead, endv, cntv in summaries:
        res.append((e, last_id))
        qlead = np.asarray(qlead, dtype=np.int64)
        t = int(_entered(qlead, e, max_bytes))
        if t >= n:
            e = e + int(qlead[n])
        else:
            last_id += int(cntv[t])
            e = int(endv[t])
    return res


def assign_chunk(sizes: np.ndarray, open_bytes: int, base_id: int, max_bytes: int, sep_len: int) -> np.ndarray:
    """Step 3 for one chunk: batch numbers of its items."""
    n = len(sizes)
    q, nxt, _, _ = _tables(sizes, max_bytes, sep_len)
    join_n = int(_entered(q, open_bytes, max_bytes))
    ids = np.empty(n, dtype=np.int64)
    ids[: min(join_n, n)] = base_id
    i, bid = join_n, base_id
    while i < n:
        bid += 1
        k = int(nxt[i])
        ids[i:k] = bid
        i = k
    return ids


def pack_batches(df: DataFrame, group_cols: list[str], order_cols: list[str], size_col: str,
                 chunk_col: str, max_bytes: int = DEFAULT_MAX_BYTES, sep: str = COLLECTOR_SEP,
                 out_col: str = "batch_no") -> DataFrame:
    """Add ``out_col`` (0-based batch number within the group) to every item.

    ``chunk_col`` must be non-decreasing in ``order_cols`` within a group and
    keep chunks bounded (e.g. ``floor(seq / 65536)``).  A NULL group is a group of
    its own; a NULL size is that of an empty payload."""
    sep_len = len(sep.encode("utf-8"))
    keys = list(group_cols) + [chunk_col]
    order_only = [c for c in order_cols if c not in keys]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Chunks are many and small: each pass is one mapInPandas per partition over
    # runs of equal keys (sorted), not a Python call per group.
    items = df.withColumn(_S, F.coalesce(F.col(size_col).cast("long"), F.lit(0))).repartition(parts, *keys) \
        .sortWithinPartitions(*keys, *order_only)
    key_schema = [items.schema[k] for k in keys]
    sum_schema = T.StructType(key_schema + list(SUMMARY_SCHEMA.fields))

    def scan(it):
        rows = []
        for seg in key_segments(it, keys):
            n, qlead, endv, cntv = chunk_summary(seg[_S].to_numpy(dtype=np.int64), max_bytes, sep_len)
            rows.append([seg[c].iloc[0] for c in keys] + [n, qlead, endv, cntv])
        if rows:
            yield pd.DataFrame(rows, columns=sum_schema.names)

    ensure_checkpoint_dir(df.sparkSession)
    groups = list(group_cols)
    reports = items.select(*keys, *order_only, _S).mapInPandas(scan, sum_schema).repartitionByRange(parts, *keys) \
        .withColumn(_B, F.spark_partition_id()).checkpoint(eager=False)
    entry_fields = [T.StructField("open_bytes", T.LongType()), T.StructField("base_id", T.LongType())]
    block_schema = T.StructType([reports.schema[c] for c in [*groups, _B]] + list(SUMMARY_SCHEMA.fields))
    root_schema = T.StructType([reports.schema[c] for c in [*groups, _B]] + entry_fields)
    entry_schema = T.StructType(key_schema + entry_fields)

    def _summaries(seg):
        return zip(seg["n"], seg["qlead"], seg["end"], seg["cnt"])

    def composed(it):
        rows = [[seg[c].iloc[0] for c in [*groups, _B]] + list(compose(_summaries(seg), max_bytes)) for seg in key_segments(it, [*groups, _B])]
        if rows:
            yield pd.DataFrame(rows, columns=block_schema.names)

    def walk(by, names_, schema):
        def run(it):
            for seg in key_segments(it, by):
                start = (int(seg["open_bytes"].iloc[0]), int(seg["base_id"].iloc[0])) if "open_bytes" in seg else ()
                res = walk_chunks(_summaries(seg), max_bytes, *start)
                yield seg[names_].assign(open_bytes=[r[0] for r in res], base_id=[r[1] for r in res])[schema.names]
        return run

    blocks = reports.sortWithinPartitions(*groups, _B, chunk_col).mapInPandas(composed, block_schema)
    root = blocks.repartition(parts, *groups).sortWithinPartitions(*groups, _B).mapInPandas(walk(groups, [*groups, _B], root_schema), root_schema)
    entry = join_null_safe(reports, root, [*groups, _B]).sortWithinPartitions(*groups, _B, chunk_col) \
        .mapInPandas(walk([*groups, _B], keys, entry_schema), entry_schema)
    out_fields = [f for f in items.schema.fields if f.name != _S] + [T.StructField(out_col, T.LongType())]
    out_schema = T.StructType(out_fields)
    names = out_schema.names

    def assign(it):
        for seg in key_segments(it, keys):
            seg = seg.copy()
            seg[out_col] = assign_chunk(seg[_S].to_numpy(dtype=np.int64), int(seg["open_bytes"].iloc[0]),
                                        int(seg["base_id"].iloc[0]), max_bytes, sep_len)
            yield seg[names]

    joined = join_null_safe(items, entry, keys).sortWithinPartitions(*keys, *order_only)
    return joined.mapInPandas(assign, out_schema)


def assemble_batches(df: DataFrame, group_cols: list[str], order_cols: list[str], payload_col: str,
                     batch_col: str = "batch_no", sep: str = COLLECTOR_SEP) -> DataFrame:
    """One row per batch: the payloads joined by ``sep`` in order, bytes, items.
    A batch is below the byte limit by construction, so each group is small."""
    ordered = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order_cols], F.col(payload_col).alias("p"))))
    body = F.array_join(F.transform(ordered, lambda x: x["p"]), sep)
    return df.groupBy(*group_cols, batch_col).agg(body.alias("batch"), F.count(F.lit(1)).alias("items")) \
        .withColumn("bytes", F.octet_length("batch").cast("bigint"))


def flush_stats(batches: DataFrame, group_cols: list[str], ok_col: str | None = None) -> DataFrame:
    """Bytes and batch count per group (and whether all were delivered)."""
    aggs = [F.count(F.lit(1)).alias("batches"), F.sum("bytes").cast("bigint").alias("bytes"),
            F.sum("items").cast("bigint").alias("items")]
    if ok_col:
        aggs.append(F.bool_and(ok_col).alias("ok"))
    return batches.groupBy(*group_cols).agg(*aggs)


def single_event_batches(df: DataFrame, payload_col: str, batch_col: str = "batch") -> DataFrame:
    """No batching, one event per send: a projection.  The event's own keys
    are the batch's; ``batch``, ``items`` and ``bytes`` are as those of ``assemble_batches``."""
    return df.withColumn(batch_col, F.col(payload_col)).withColumn("items", F.lit(1).cast("bigint")) \
        .withColumn("bytes", F.octet_length(payload_col).cast("bigint"))
