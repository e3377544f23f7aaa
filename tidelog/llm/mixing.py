"""Mixing sources to target weights by balanced sampling (operator 6).

Each source's target is its share of all words (weights 1, 2, 3, repeating, over the
sources in code-point order), at most 3 times its size, with the excess
reshared by weight.  A document is taken ``floor(target / size of source)`` times, and once
more with the fractional part as its inclusion probability.  The cube method (Deville
and Tille 2004) moves these probabilities through the null space of two
constraints, words and documents, until each chunk of a source has at most two
fractions left; those go on to the next round, and the last two of a source
are landed on the side that keeps its words nearest to the target.

A source of any size is spread over chunks of ``CHUNK`` documents on average, so no task holds a
source; each round leaves about 2 in ``CHUNK`` rows, so there are few rounds.
Random numbers follow from the rows alone: reruns agree.

Defined results: a null source is a source of its own, ordered last; null, empty or blank
texts have size 0 and are never taken; null ids and repeated rows are
documents as any other; an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, kept_table, runs, unused

MOST = 3
CHUNK = 4096
NEAR = 1e-9
LANDING_STEPS = 8


def flight(size: np.ndarray, pi: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase: probabilities moved to 0 or 1 with the sums of ``pi`` and of
    ``size * pi`` kept, but for two fractions at most."""
    pi = pi.astype(float).copy()
    size = size.astype(float)
    todo = np.flatnonzero((pi > NEAR) & (pi < 1 - NEAR))[::-1].tolist()
    draw = rng.random(len(todo) + 1).tolist()
    active: list[int] = []
    while True:
        while len(active) < 3 and todo:
            active.append(todo.pop())
        x = [size[i] for i in active]
        if len(active) == 3:
            v = [x[1] - x[2], x[2] - x[0], x[0] - x[1]]
            if not any(v):
                v = [1.0, -1.0, 0.0]
        elif len(active) == 2 and x[0] == x[1]:
            v = [1.0, -1.0]
        else:
            return pi
        up = min((1 - pi[i]) / d if d > 0 else -pi[i] / d for i, d in zip(active, v) if d)
        down = min(pi[i] / d if d > 0 else (pi[i] - 1) / d for i, d in zip(active, v) if d)
        step = up if draw.pop() * (up + down) < down else -down
        for i, d in zip(active, v):
            p = pi[i] + step * d
            pi[i] = 0.0 if p < NEAR else 1.0 if p > 1 - NEAR else p
        active = [i for i in active if 0.0 < pi[i] < 1.0]


def landing(size: np.ndarray, pi: np.ndarray, want: float) -> np.ndarray:
    """Landing phase: the few fractions left become 0 or 1, and while it brings the
    words nearer to ``want``, one document is exchanged for another, put in or left out."""
    size, pi = size.astype(float), pi.copy()
    left = np.flatnonzero((pi > 0) & (pi < 1))
    if len(left):
        rest = want - float(size @ np.where((pi > 0) & (pi < 1), 0.0, pi))
        pi[left] = min(product((0.0, 1.0), repeat=len(left)), key=lambda s: abs(float(size[left] @ np.array(s)) - rest))
    off = float(size @ pi) - want
    for _ in range(LANDING_STEPS):
        one = np.abs(off + (1 - 2 * pi) * size)
        moves = [(float(one.min()), (int(np.argmin(one)),))]
        ins, outs = np.flatnonzero(pi == 1), np.flatnonzero(pi == 0)
        if len(ins) and len(outs):
            ins = ins[np.argsort(size[ins], kind="stable")]
            at = np.searchsorted(size[ins], off + size[outs])
            for near in (np.clip(at, 0, len(ins) - 1), np.clip(at - 1, 0, len(ins) - 1)):
                gap = np.abs(off + size[outs] - size[ins[near]])
                k = int(np.argmin(gap))
                moves.append((float(gap[k]), (int(outs[k]), int(ins[near[k]]))))
        best, units = min(moves)
        if best >= abs(off) - 0.5:
            break
        off += sum((1 - 2 * pi[u]) * size[u] for u in units)
        for u in units:
            pi[u] = 1 - pi[u]
    return pi


def _flown(frames: Iterator[pd.DataFrame], turn: int) -> Iterator[pd.DataFrame]:
    for g in runs(frames, ["place", "chunk"]):
        order = np.lexsort((g["size"], g["row_key"], g["h"]))
        g = {c: v[order] for c, v in g.items()}
        rng = np.random.default_rng([17, turn, int(g["place"][0]), int(g["chunk"][0])])
        pi = flight(g["size"], g["pi"], rng)
        if g["chunks"][0] == 1:
            pi = landing(g["size"], pi, float(g["size"] @ g["pi"]))
        yield pd.DataFrame(g | {"pi": pi})


def targets(per: DataFrame) -> DataFrame:
    """``per(source, source_size, n)`` -> with ``place``, ``weight`` and ``target``.

    One row for each source; only sums come to the driver.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = kept_table(per.withColumn("place", place).withColumn("weight", (F.col("place") % 3 + 1).cast("double")))
    total, weights = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level = total / weights if weights else 0.0
    while True:
        full = MOST * F.col("source_size") < F.lit(level) * F.col("weight")
        capped, open_ = per.agg(F.coalesce(F.sum(F.when(full, MOST * F.col("source_size"))), F.lit(0)),
                                F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        now = (total - capped) / open_ if open_ else level
        if now <= level:
            break
        level = now
    most = (MOST * F.col("source_size")).cast("double")
    return per.withColumn("target", F.least(most, F.lit(level) * F.col("weight")))


#: Copies of a row that one task puts out.
PART = 1024


def row_key(id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
    """Rows equal in id, source and text have one key; they are interchangeable."""
    return F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col))


def second_key(id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
    """Another 64 bits: both keys together tell rows apart at any number of documents."""
    return F.xxhash64(F.lit("second"), F.col(text_col), F.col(source_col), F.col(id_col))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each document: ``doc_id, size, source_size, target, taken, copies, row_key, row_key2``."""
    rows = kept_table(docs.select(
        F.col(id_col), F.col(source_col).alias("source"), row_key(id_col, text_col, source_col).alias("row_key"),
        second_key(id_col, text_col, source_col).alias("row_key2"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    per = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + NEAR)
    per = kept_table(per.withColumn("whole", whole.cast("long"))
                     .withColumn("part", F.when(ratio - whole > NEAR, ratio - whole).otherwise(0.0)))
    known = rows.withColumnRenamed("source", "_s").join(per, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    base = [id_col, "row_key", "row_key2", "size", "source_size", "target", "whole", "place"]
    fixed = known.filter("part = 0 or size = 0").select(*base, F.lit(0.0).alias("pi"))
    left = known.filter("part > 0 and size > 0").select(*base, F.col("part").alias("pi"),
                                                        F.greatest(F.lit(1), F.ceil(F.col("n") / CHUNK)).cast("long").alias("chunks"))
    done, turn = [fixed], 0
    while True:
        dealt = left.withColumn("h", F.xxhash64(F.lit(turn), "row_key")).withColumn("chunk", F.expr("pmod(h, chunks)"))
        dealt = dealt.withColumn(id_col, F.col(id_col).cast("string"))
        flown = dealt.repartition("place", "chunk").sortWithinPartitions("place", "chunk") \
            .mapInPandas(lambda fs, t=turn: _flown(fs, t), dealt.schema)
        flown = kept_table(flown.withColumn(id_col, F.col(id_col).cast(docs.schema[id_col].dataType)).drop("h", "chunk", "chunks"))
        done.append(flown.filter("pi = 0 or pi = 1"))
        left = flown.filter("pi > 0 and pi < 1")
        counts = kept_table(left.groupBy("place").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / CHUNK)).cast("long").alias("chunks")))
        if counts.isEmpty():
            break
        left, turn = left.join(counts, "place"), turn + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = (F.col("whole") + F.col("pi").cast("long")).cast("long")
    return out.select(F.col(id_col), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "row_key", "row_key2")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.  Rows taken very often are put out in parts of
    ``PART`` copies by several tasks."""
    key, key2, copies, n = (unused(docs, x) for x in ("_key", "_key2", "_copies", "_n"))
    taken = mix(docs).groupBy(F.col("row_key").alias(key), F.col("row_key2").alias(key2)) \
        .agg(F.sum(F.when(F.col("size") > 0, F.col("copies")).otherwise(0)).alias(copies)).filter(F.col(copies) > 0)
    once = docs.withColumn(key, row_key()).withColumn(key2, second_key()).join(taken, [key, key2]).dropDuplicates([key, key2])
    parts = F.sequence(F.lit(0).cast("long"), F.col(copies) - 1, F.lit(PART).cast("long"))
    often = once.filter(F.col(copies) > PART).withColumn(n, F.explode(parts)).repartition(key, n) \
        .withColumn(copies, F.least(F.lit(PART).cast("long"), F.col(copies) - F.col(n)))
    out = once.filter(F.col(copies) <= PART).unionByName(often.drop(n))
    return out.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)
