"""Links between rows that share buckets, found and counted without ever making
a row for each pair.

``bucket_edges`` ties the rows of a bucket to its smallest id, ``components``
joins edges to connected components, ``block_members`` cuts a group of any size
into blocks of bounded weight and deals out pairs of blocks, and the callers
verify one pair of blocks at a time in a task.  A hot bucket or group is thus
spread over many tasks.  What is summed up for a key is kept as a table before it
is joined back, as AQE splits a hot key only between two plain shuffles.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_table

EDGE = "a long, b long"


def bucket_edges(keys: DataFrame) -> DataFrame:
    """``keys(id, bucket)`` -> distinct edges ``(a, b)`` from each id to the smallest id of a bucket."""
    hubs = kept_table(keys.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("_last"))
                      .filter("hub < _last").select("bucket", "hub"))
    return keys.join(hubs, "bucket").filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(id, component)`` for each id in an edge; the component is its smallest id.

    Alternating large and small stars (Kiveris et al. 2014): each round ties
    nodes to the smallest id near them, with partial aggregates and joins that
    AQE can split; the number of rounds is logarithmic.  Each round is kept in
    the checkpoint folder.  Only a count and a sum come to the driver.
    """
    edges = kept_table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = kept_table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = kept_table(large)
        low = kept_table(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b") \
            .unionByName(low.select("a", F.col("m").alias("b")))
        edges = kept_table(small.distinct())
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")) \
        .unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def block_members(members: DataFrame, budget: int) -> DataFrame:
    """``members(cluster, id, weight, ...)`` -> the same rows with ``block`` and the pairs of blocks
    ``(bi, bj)`` they belong to; no block's expected weight is over ``budget``."""
    sizes = kept_table(members.groupBy("cluster").agg(F.ceil(F.sum("weight") / F.lit(float(budget))).cast("int").alias("_n")))
    return members.join(sizes, "cluster") \
        .withColumn("block", F.pmod(F.xxhash64(F.lit(5), "id"), F.col("_n").cast("long")).cast("int")) \
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))) \
        .withColumn("bi", F.least("block", "_o")).withColumn("bj", F.greatest("block", "_o")).drop("_o", "_n")


def local_components(linked: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id reached within a pair of blocks, for its rows and its columns."""
    top = np.iinfo(np.int64).max
    r, c = rows.copy(), cols.copy()
    while True:
        c2 = np.minimum(c, np.where(linked, r[:, None], top).min(axis=0, initial=top))
        r2 = np.minimum(r, np.where(linked, c2[None, :], top).min(axis=1, initial=top))
        if (c2 == c).all() and (r2 == r).all():
            return r, c
        r, c = r2, c2


def summed_links(found: DataFrame) -> DataFrame:
    """``found(id, links, low)`` of all blocks -> ``(id, links, component)``, one row for each linked id."""
    found = kept_table(found)
    parts = components(found.select(F.col("id").alias("a"), F.col("low").alias("b")))
    return found.groupBy("id").agg(F.sum("links").alias("links")).join(parts, "id", "left") \
        .select("id", "links", F.coalesce("component", "id").alias("component"))
