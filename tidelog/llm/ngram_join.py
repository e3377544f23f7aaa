"""N-gram Jaccard join (operator 2): MinHash banding, then exact verification.

Shingles are the 5-word windows of a text (words ``[^\\x20\\x09-\\x0D]+``, taken
as they are); a text of one to four words is one shingle.  Two texts are linked
when the Jaccard similarity of their shingle sets is at least 0.8, decided on
the full sets of 64-bit shingle hashes with integers.

1. One pass over the texts gives a fingerprint of the shingle set and one
   bucket id per band.  Rows and bands follow from the wanted recall
   (``bands_for``): 32 bands of 6 rows miss a pair at 0.8 with probability 6e-5.
2. Texts with equal sets are one class; one of its rows stands for it.
3. Classes that share a bucket are tied together; a group of any size is cut into
   blocks of bounded weight, and each task verifies one pair of blocks on the
   whole sets (read again from the text).  No row is made for a pair.
4. Links are summed with the classes' sizes; components give the class id.

Defined results: a null text, or one without words, links with nothing.  A null
doc_id takes no part (class_id null, n_links 0, kept).  Rows that repeat a
doc_id count as copies; should their texts differ they are documents of their own.
Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed, kept_table, mix64, odd_numbers, runs, unused, words
from .linking import block_members, bucket_edges, components, local_components, summed_links

SHINGLE = 5
THRESHOLD = (4, 5)  # at least 4/5
ROWS = 6
RECALL = 0.9999
#: Shingles in a block; a text counts as 400 at least, so that a block has 1,000 texts at most.
BLOCK = 400_000
LEAST = 400


def bands_for(similarity: float, rows: int, recall: float) -> int:
    """Bands of ``rows`` minima needed so that a pair at ``similarity`` meets with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows))


BANDS = bands_for(THRESHOLD[0] / THRESHOLD[1], ROWS, RECALL)


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text."""
    w = hashed(words(text))
    if not len(w):
        return w
    coef = odd_numbers(n, 11)
    k = max(1, len(w) - n + 1)
    h = np.zeros(k, dtype=np.uint64)
    for i in range(min(n, len(w))):
        h += w[i:i + k] * coef[i]
    return np.unique(mix64(h))


def _signed(frames: Iterator[pd.DataFrame], rows: int, bands: int) -> Iterator[pd.DataFrame]:
    a, b = odd_numbers(rows * bands, 23), odd_numbers(rows * bands, 29)
    coef = odd_numbers(rows, 31)
    band = mix64(np.arange(1, bands + 1, dtype=np.uint64))

    def buckets(sets: list[np.ndarray]) -> np.ndarray:
        x = np.concatenate(sets)
        starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
        out = np.zeros((len(sets), bands), dtype=np.uint64)
        for k in range(rows * bands):
            v = x * a[k]
            v += b[k]
            v >>= np.uint64(8)
            out[:, k // rows] += np.minimum.reduceat(v, starts) * coef[k % rows]
        return mix64(out + band).view(np.int64)

    for f in frames:
        fps, ns, sets, where = [None] * len(f), np.zeros(len(f), dtype=np.int64), [], []
        keys: list = [None] * len(f)

        def flush():
            if sets:
                for i, row in zip(where, buckets(sets)):
                    keys[i] = row
            sets.clear()
            where.clear()

        held = 0
        for i, t in enumerate(f["text"]):
            s = shingles(t)
            ns[i] = len(s)
            if len(s):
                fps[i] = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                sets.append(s)
                where.append(i)
                held += len(s)
                if held > 32_768:  # stays in the processor's cache
                    flush()
                    held = 0
        flush()
        yield pd.DataFrame({"id": f["id"], "key": f["key"], "fp": fps, "n": ns, "buckets": keys})


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set."""
    n, m = len(left), len(right)
    sets = left + right
    x = np.concatenate(sets)
    row = np.repeat(np.arange(n + m), [len(s) for s in sets])
    _, col, count = np.unique(x, return_inverse=True, return_counts=True)
    shared = count[col] > 1
    col, row = col[shared], row[shared]
    used, col = np.unique(col, return_inverse=True)
    out = np.zeros((n, m), dtype=np.float32)
    step = max(256, min(8192, 8_000_000 // (n + m)))
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    for lo in range(0, len(used), step):
        i, j = np.searchsorted(col, [lo, lo + step])
        flags = np.zeros((n + m, step), dtype=np.float32)
        flags[row[i:j], col[i:j] - lo] = 1
        out += flags[:n] @ flags[n:].T
    return out.astype(np.int64)


def _verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ids, links, lows, size = [], [], [], 0
    for g in runs(frames, ["cluster", "bi", "bj"]):
        once = list({key: i for i, key in enumerate(zip(g["id"].tolist(), g["fp"]))}.values())  # rows that repeat an id
        if len(once) < 2:
            continue
        g = {c: v[once] for c, v in g.items()}
        sets = [np.frombuffer(s, dtype=np.uint64) for s in g["shingles"]]
        n = np.array([len(s) for s in sets])
        node, copies, block = (g[c].astype(np.int64) for c in ("id", "copies", "block"))
        if g["bi"][0] == g["bj"][0]:
            p = q = np.arange(len(once))
        else:
            p, q = np.flatnonzero(block == g["bi"][0]), np.flatnonzero(block == g["bj"][0])
        if not len(p) or not len(q):
            continue
        both = _overlaps([sets[i] for i in p], [sets[i] for i in q])
        linked = both * THRESHOLD[1] >= (n[p][:, None] + n[q][None, :] - both) * THRESHOLD[0]
        if p is q:
            np.fill_diagonal(linked, False)
        r, c = local_components(linked, node[p], node[q])
        sides = [(p, linked @ copies[q], r)] if p is q else [(p, linked @ copies[q], r), (q, copies[p] @ linked, c)]
        for side, total, low in sides:
            got = total > 0
            ids.append(node[side][got])
            links.append(total[got])
            lows.append(low[got])
            size += int(got.sum())
        if size > 20_000:
            yield pd.DataFrame({"id": np.concatenate(ids), "links": np.concatenate(links), "low": np.concatenate(lows)})
            ids, links, lows, size = [], [], [], 0
    if size:
        yield pd.DataFrame({"id": np.concatenate(ids), "links": np.concatenate(links), "low": np.concatenate(lows)})


def _texts_to_sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        sets = [shingles(t) for t in f["text"]]
        same = [bool(len(s)) and hashlib.blake2b(s.tobytes(), digest_size=16).digest() == fp for s, fp in zip(sets, f["fp"])]
        out = f.drop(columns=["text"]).assign(shingles=[s.tobytes() for s in sets])
        yield out[same]


def _joined(docs: DataFrame, rows: int, bands: int) -> DataFrame:
    """``docs(id, text, key)`` -> ``(id, key, n, rep, copies, links, class_id, kept, first)``: ``first`` is true for the rows
    of the one shingle set of a class that holds its smallest id."""
    named = docs.withColumn("id", F.col("id").cast("string"))  # pandas would make floats of longs with nulls
    signed = named.mapInPandas(lambda fs: _signed(fs, rows, bands), "id string, key binary, fp binary, n long, buckets array<long>")
    signed = kept_table(signed.withColumn("id", F.col("id").cast("long")).withColumn("row", F.monotonically_increasing_id()))
    usable = signed.filter("fp is not null and id is not null")
    classes = kept_table(usable.groupBy("fp").agg(F.min("row").alias("node"), F.min("id").alias("rep"), F.count("*").alias("copies"),
                                                  F.first("n").alias("n"), F.first("buckets").alias("buckets")))
    keys = classes.select(F.col("node").alias("id"), F.explode("buckets").alias("bucket"))
    clusters = components(bucket_edges(keys))
    members = clusters.withColumnRenamed("component", "cluster").join(classes.withColumnRenamed("node", "id").drop("buckets"), "id") \
        .withColumn("weight", F.greatest("n", F.lit(LEAST)))
    placed = block_members(members.select("id", "fp", "copies", "cluster", "weight"), BLOCK).drop("weight")
    texts = members.select(F.col("id").alias("node"), "fp", F.col("rep").alias("id")).join(docs.select("id", "text"), "id")
    sets = texts.select(F.col("node").alias("id"), "fp", "text").mapInPandas(_texts_to_sets, "id long, fp binary, shingles binary")
    dealt = placed.join(sets, ["id", "fp"]).repartition("cluster", "bi", "bj").sortWithinPartitions("cluster", "bi", "bj", "id")
    found = summed_links(dealt.mapInPandas(_verified, "id long, links long, low long")).withColumnRenamed("id", "node")
    found = kept_table(found.join(classes.select("node", "rep"), "node"))
    least = found.groupBy("component").agg(F.min("rep").alias("class_id"), F.min(F.struct("rep", "node"))["node"].alias("first_node"))
    found = found.drop("rep").join(least, "component")
    known = classes.select("fp", "node", "rep", "copies").join(found, "node", "left")
    out = signed.select("id", "key", "fp", "n").join(known, "fp", "left")
    class_id = F.when(F.col("id").isNotNull(), F.coalesce("class_id", "rep", "id"))
    return out.select("id", "key", "n", "rep", "copies", "links", class_id.alias("class_id"), F.coalesce(F.col("id") == class_id, F.lit(True)).alias("kept"),
                      F.coalesce("first_node", "node").eqNullSafe(F.col("node")).alias("first"))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """One row for each input row: ``doc_id, class_id, copy_id, n_links, n_shingles, kept``.

    ``class_id`` is the smallest doc_id reachable by links (itself included),
    ``copy_id`` the smallest doc_id with an equal shingle set, ``n_links`` the
    number of other documents linked directly, copies included.
    """
    got = _joined(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.lit(None).cast("binary").alias("key")), rows, bands)
    return got.select(
        F.col("id").alias(id_col), "class_id",
        F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("copy_id"),
        F.when(F.col("id").isNotNull(), F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.col("n").alias("n_shingles"), "kept")


def one_of_each_class(docs: DataFrame, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """The rows of ``docs`` without the documents whose class has a smaller doc_id.

    A document is a doc_id with a text: rows that repeat both are one, rows that share an id with another
    text are judged by their own class.  Rows with a null doc_id stay.
    """
    key = unused(docs, "_text_key")
    text = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    named = docs.filter(F.col("doc_id").isNotNull()).withColumn(key, text)
    kept = _joined(named.select(F.col("doc_id").cast("long").alias("id"), "text", F.col(key).alias("key")), rows, bands) \
        .filter("kept and first").select(F.col("id").alias("doc_id"), F.col("key").alias(key)).distinct()
    named = named.join(kept, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
    return named.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))
