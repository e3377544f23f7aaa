"""Embedding near-duplicates (operator 10): Euclidean p-stable hashing, then exact cosines.

Vectors are normalised; each of ``tables`` hash tables takes ``HASHES`` quantised
random projections ``floor((x . a + b) / WIDTH)``.  At cosine 0.93 two unit
vectors are ``sqrt(2 * 0.07)`` apart, which fixes the chance of an equal hash
(Datar et al. 2004), and so the number of tables for the wanted recall
(``tables_for``: 65 for 0.999).

Only vectors with equal labels meet (the label is part of a bucket's key).
Equal vectors of a label are one class.  Buckets with two classes or more are cut into
blocks of bounded size and verified in tasks by double-precision cosines, one
pair of blocks at a time; a pair counts only in the first table where it meets,
so no row is made for a pair.

Defined results: null, empty or zero vectors, those with null or non-finite
components, and those without a label or an id link with nothing (n_links 0; the
component is the id itself).  Vectors of different lengths don't meet.  Rows
that repeat a vec_id each get a row and count as copies.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed, kept_table, mix64, odd_numbers, runs
from .linking import block_members, local_components, summed_links

THRESHOLD = 0.93
DISTANCE = math.sqrt(2 - 2 * THRESHOLD)
WIDTH = 6 * DISTANCE
HASHES = 16
RECALL = 0.999
#: Vectors in a block.
BLOCK = 1000


def same_hash(distance: float, width: float) -> float:
    """Probability that two points at this distance share one quantised projection."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - math.sqrt(2 / math.pi) / t * (1 - math.exp(-t * t / 2))


def tables_for(distance: float, width: float, hashes: int, recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - same_hash(distance, width) ** hashes))


TABLES = tables_for(DISTANCE, WIDTH, HASHES, RECALL)


class Projections:
    """The random projections for vectors of one length; the same in every task."""

    def __init__(self, dims: int, tables: int, hashes: int, seed: int = 41):
        rng = np.random.default_rng([seed, dims])
        self.a = rng.standard_normal((dims, tables * hashes))
        self.b = rng.uniform(0, WIDTH, tables * hashes)
        self.shape = (tables, hashes)
        self.coef = odd_numbers(hashes, seed + 1)
        self.table = mix64(np.arange(1, tables + 1, dtype=np.uint64))

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """One int64 for each vector and table."""
        cell = np.floor((unit @ self.a + self.b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(unit), *self.shape)
        return mix64((cell * self.coef).sum(axis=2, dtype=np.uint64) + self.table).view(np.int64)


def _unit(v) -> np.ndarray | None:
    if v is None or not len(v):
        return None
    x = np.array([np.nan if c is None else c for c in v], dtype=np.float64)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    return x / top / np.linalg.norm(x / top) if top > 0 else None


def _bucketed(frames: Iterator[pd.DataFrame], tables: int, hashes: int) -> Iterator[pd.DataFrame]:
    made: dict[int, Projections] = {}
    for f in frames:
        units = [_unit(v) if k is not None and i is not None else None for v, k, i in zip(f["v"], f["label"], f["id"])]
        fps: list = [None] * len(f)
        buckets: list = [None] * len(f)
        for dims in {len(u) for u in units if u is not None}:
            where = [i for i, u in enumerate(units) if u is not None and len(u) == dims]
            p = made.setdefault(dims, Projections(dims, tables, hashes))
            label = hashed(f["label"].iloc[i].encode() for i in where)
            salt = mix64(label + np.uint64(dims)).view(np.int64)
            found = p.keys(np.stack([units[i] for i in where])) ^ salt[:, None]
            for i, row, s in zip(where, found, salt):
                buckets[i] = row
                fps[i] = hashlib.blake2b(units[i].tobytes(), key=int(s).to_bytes(8, "little", signed=True), digest_size=16).digest()
        yield pd.DataFrame({"id": f["id"], "fp": fps, "buckets": buckets, "unit": units})


def _verified(frames: Iterator[pd.DataFrame], tables: int, hashes: int, threshold: float) -> Iterator[pd.DataFrame]:
    made: dict[int, Projections] = {}
    held: list[pd.DataFrame] = []
    for g in runs(frames, ["cluster", "bi", "bj"]):
        x = np.stack(g["unit"])
        node, copies, block = (g[c].astype(np.int64) for c in ("id", "copies", "block"))
        same = g["bi"][0] == g["bj"][0]
        p = np.flatnonzero(block == g["bi"][0])
        q = p if same else np.flatnonzero(block == g["bj"][0])
        if not len(p) or not len(q):
            continue
        linked = x[p] @ x[q].T >= threshold
        if same:
            np.fill_diagonal(linked, False)
        i, j = np.nonzero(linked)
        if not len(i):
            continue
        keys = made.setdefault(x.shape[1], Projections(x.shape[1], tables, hashes)).keys(x)
        at = int(g["place"][0])  # the bucket's table
        for k in range(0, len(i), 65_536):
            a, b = i[k:k + 65_536], j[k:k + 65_536]
            met = (keys[p[a], :at] == keys[q[b], :at]).any(axis=1)
            linked[a[met], b[met]] = False
        r, c = local_components(linked, node[p], node[q])
        for side, total, low in [(p, linked @ copies[q], r)] + ([] if same else [(q, copies[p] @ linked, c)]):
            got = total > 0
            if got.any():
                held.append(pd.DataFrame({"id": node[side][got], "links": total[got], "low": low[got]}))
        if len(held) >= 500:
            yield pd.concat(held)
            held = []
    if held:
        yield pd.concat(held)


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD, tables: int = TABLES, hashes: int = HASHES) -> DataFrame:
    """One row for each input row: ``vec_id, n_links, component_id, kept``."""
    rows = vectors.select(F.col(id_col).cast("long").cast("string").alias("id"),  # pandas would make floats of longs with nulls
                          F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    seen = rows.mapInPandas(lambda fs: _bucketed(fs, tables, hashes), "id string, fp binary, buckets array<long>, unit array<double>")
    seen = kept_table(seen.withColumn("id", F.col("id").cast("long")))
    classes = kept_table(seen.filter("fp is not null").groupBy("fp").agg(
        F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("buckets").alias("buckets"), F.first("unit").alias("unit")))
    keys = classes.select(F.col("rep").alias("id"), "fp", "copies", F.posexplode("buckets").alias("place", "cluster"))
    shared = kept_table(keys.groupBy("cluster").agg(F.count("*").alias("n")).filter("n > 1").select("cluster"))
    met = keys.join(shared, "cluster").withColumn("weight", F.lit(1))
    dealt = block_members(met, BLOCK).drop("weight").join(classes.select("fp", "unit"), "fp") \
        .repartition("cluster", "bi", "bj").sortWithinPartitions("cluster", "bi", "bj", "id")
    found = summed_links(dealt.drop("fp").mapInPandas(lambda fs: _verified(fs, tables, hashes, threshold), "id long, links long, low long"))
    known = classes.select("fp", "rep", "copies").join(found, F.col("rep") == F.col("id"), "left").drop("id")
    out = seen.select("id", "fp").join(known, "fp", "left")
    return out.select(
        F.col("id").alias(id_col),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.coalesce("component", "rep", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "rep", "id"), F.lit(True)).alias("kept"))
