"""Merkle dataset manifest with incremental witnesses.

Every row is a leaf: the digest of its length-prefixed columns.  The leaves of a
group (here a language) in ascending order form a binary tree: while several nodes remain, every two consecutive
ones become the digest of their concatenated hex digests, a last one without
a partner the digest of itself alone.  The groups' roots, in order, form the tree above.

``OpenTree`` takes digests one after the other.  It keeps one open subtree a level; each
open subtree holds the partial witnesses of the leaves under it, and when
its sibling is complete both sides' witnesses grow by the other's digest.  A task
appends one aligned block of ``2 ** BLOCK_BITS`` digests at a time, so it holds one block;
the blocks' roots are then appended as leaves of the next level, in blocks again, until
each group has one node, and the roots' witnesses extend those of the leaves below.  A group of any
size is spread over all tasks; nothing but the largest group's size comes to the driver.

A witness is a text of steps of 65 characters: ``L`` or ``R`` (the side of the sibling)
and its digest, or 65 dashes where the node had no sibling.

Defined results: a null column counts as ``-``; null groups and null ids come first; rows with one id
are ordered by their digest, repeated rows are leaves of their own (which of
them has which place doesn't matter, as their digests are equal); an empty table gives no
row; other columns are not read.  Texts of any length are hashed whole by the JVM.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import held_out, kept_table

#: Leaves of a block: what one task holds at a time, as a power of two.
BLOCK_BITS = 9
STEP = 65
ALONE = "-" * STEP
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**columns: Column) -> Column:
    """Digest of ``FIELDS``; a column given by name takes the place of the row's own."""
    return F.sha2(F.concat(*[encoded(columns.get(c, F.col(c))) for c in FIELDS]).cast("binary"), 256)


class OpenTree:
    """Appends digests from left to right; ``close`` gives the root and each leaf's witness in order."""

    def __init__(self) -> None:
        self.open: list[tuple[int, str, list[list[str]]]] = []   # height, digest, witnesses; heights fall from left to right

    def append(self, node: str) -> None:
        self._add(0, node, [[]])

    def _add(self, height: int, node: str, witnesses: list[list[str]]) -> None:
        while self.open and self.open[-1][0] == height:
            _, left, before = self.open.pop()
            for w in before:
                w.append("R" + node)
            for w in witnesses:
                w.append("L" + left)
            height, node, witnesses = height + 1, digest(left, node), before + witnesses
        self.open.append((height, node, witnesses))

    def _raise(self) -> None:
        height, node, witnesses = self.open.pop()
        for w in witnesses:
            w.append(ALONE)
        self._add(height + 1, digest(node), witnesses)

    def close(self, height: int | None = None) -> tuple[str, list[str]]:
        """Nodes without a partner go up alone until one is left, and it up to ``height`` where that is given."""
        while len(self.open) > 1 or (height is not None and self.open[0][0] < height):
            self._raise()
        _, root, witnesses = self.open[0]
        return root, ["".join(w) for w in witnesses]


def _blocks(frames: Iterable[pd.DataFrame], bits: int, carried: list[str]) -> Iterator[pd.DataFrame]:
    """Rows (grp, block, pos, n, node, carried) sorted by the first three -> the same with their block's root and their witness.
    A block is closed at its full height where the group has further blocks."""
    key, tree, held = None, None, []

    def closed() -> pd.DataFrame:
        root, witnesses = tree.close(bits if key[2] > 1 << bits else None)
        rows = held[0] if len(held) == 1 else pd.concat(held)
        return rows[["grp", "block", "pos", "n", "node", *carried]].assign(witness=witnesses, root=root)

    for f in frames:
        for part in _runs(f):
            grp, block, n = part["grp"].iat[0], part["block"].iat[0], part["n"].iat[0]
            if key != (grp, block, n):
                if key is not None:
                    yield closed()
                key, tree, held = (grp, block, n), OpenTree(), []
            held.append(part)
            for node in part["node"]:
                tree.append(node)
    if key is not None:
        yield closed()


def _runs(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Slices of neighbours with one group and block."""
    grp, block = f["grp"].to_numpy(), f["block"].to_numpy()
    cuts = np.flatnonzero((grp[1:] != grp[:-1]) | (block[1:] != block[:-1])) + 1
    edges = [0, *cuts.tolist(), len(f)] if len(f) else []
    for lo, hi in zip(edges, edges[1:]):
        yield f.iloc[lo:hi]


def climbed(nodes: DataFrame, largest: int, bits: int, carried: list[str]) -> list[DataFrame]:
    """``nodes(grp, pos, n, node, carried)``, places from 0 of n, n up to ``largest`` -> the kept levels, each with its nodes'
    witnesses up to the block's root; the blocks' roots are the next level's nodes, and in the last level every group has one block."""
    levels, kinds = [], dict(nodes.dtypes)
    while True:
        blocks = nodes.select("grp", F.shiftright("pos", bits).alias("block"), "pos", "n", "node", *carried)
        schema = "grp string, block long, pos long, n long, node string, " + "".join(f"{c} {kinds[c]}, " for c in carried) + "witness string, root string"
        levels.append(kept_table(blocks.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")
                                 .mapInPandas(lambda frames, carried=carried: _blocks(frames, bits, carried), schema)))
        if largest <= 1 << bits:
            return levels
        largest, carried = -(-largest >> bits), []
        nodes = levels[-1].filter(F.col("pos") == F.shiftleft("block", bits)).select(
            "grp", F.col("block").alias("pos"), F.ceil(F.col("n") / F.lit(float(1 << bits))).cast("long").alias("n"), F.col("root").alias("node"))


def extended(levels: list[DataFrame], top: DataFrame | None = None) -> DataFrame:
    """The first level with whole witnesses and the root they lead to: each level's witnesses are extended by those of its blocks' roots.
    ``top(grp, witness, root)`` extends those of the groups' roots (it meets up to one block's rows a group)."""
    out = levels[-1].withColumn("subroot", F.col("root"))
    if top is not None:
        above = top.select("grp", F.col("witness").alias("_up"), F.col("root").alias("_top"))
        out = out.join(above, "grp").withColumn("witness", F.concat("witness", "_up")).withColumn("root", F.col("_top")).drop("_up", "_top")
    for level in reversed(levels[:-1]):
        up = out.select("grp", F.col("pos").alias("block"), F.col("witness").alias("_up"), F.col("root").alias("_top"), "subroot")
        out = level.join(up, ["grp", "block"]).withColumn("witness", F.concat("witness", "_up")).withColumn("root", F.col("_top")).drop("_up", "_top")
    return out


def placed(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows(grp, ...)`` with ``pos``, their place from 0 in their group by ``order``, and ``n``, the group's rows; and the largest n.

    Rows are dealt by ranges of (grp, order) and sorted within them; a place is the rank in the range
    plus the group's rows in the ranges before.  The ranges are kept, as they follow from a sample.
    """
    chunked = kept_table(rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
                         .withColumn("_at", F.monotonically_increasing_id()).withColumn("_chunk", F.spark_partition_id()))
    chunks = chunked.groupBy("grp", "_chunk").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    group = Window.partitionBy("grp")
    chunks = kept_table(chunks.select("grp", "_chunk", "_first", F.sum("_n").over(group).alias("n"), F.coalesce(
        F.sum("_n").over(group.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")))
    return chunked.join(chunks, ["grp", "_chunk"]).withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")) \
        .drop("_at", "_chunk", "_first", "_before"), chunks.agg(F.max("n")).first()[0] or 0


def folded(node: Column, witness: Column) -> Column:
    """The root that a node and its witness lead to."""
    def step(acc, i):
        s = F.substring(witness, i * STEP + 1, F.lit(STEP))
        side, other = F.substring(s, 1, 1), F.substring(s, 2, STEP - 1)
        both = F.when(side == "L", F.concat(other, acc)).when(side == "R", F.concat(acc, other)).otherwise(acc)
        return F.sha2(both.cast("binary"), 256)
    steps = F.length(witness) / F.lit(STEP)
    places = F.when(steps > 0, F.sequence(F.lit(0), steps.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, node, step)


def siblings(witness: Column) -> Column:
    """The witness's digests, one after the other."""
    return F.regexp_replace(witness, "[LR-]", "")


def manifest(docs: DataFrame, *, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``(doc_id, grp, leaf, tampered, pos, witness, subroot, root)``: the whole witness of every row, up to ``root``.

    ``tampered`` is the leaf after one more was added to ``n_chars`` where 7 divides the crc32 of ``doc_id``
    (for checks of ``verified``), else the leaf itself.
    """
    grp = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    changed = F.when(held_out("doc_id", 7, 0), leaf_digest(n_chars=F.col("n_chars") + 1)).otherwise(F.col("leaf"))
    leaves = docs.select(*FIELDS, grp.alias("grp"), leaf_digest().alias("leaf")) \
        .select("doc_id", "grp", "leaf", changed.alias("tampered"), F.col("doc_id").cast("string").alias("id"), F.monotonically_increasing_id().alias("_row"))
    rows, largest = placed(kept_table(leaves), ["doc_id", "leaf", "_row"])
    levels = climbed(rows.withColumnRenamed("leaf", "node"), largest, block_bits, ["id", "tampered"])   # as text: pandas makes long numbers with nulls floats
    roots = levels[-1].filter("pos = 0").select(F.lit("").alias("grp"), F.col("grp").alias("member"), F.col("root").alias("node"))
    groups, many = placed(kept_table(roots), ["member"])
    above = extended(climbed(groups, many, block_bits, ["member"]))
    return extended(levels, above.select(F.col("member").alias("grp"), "witness", "root")) \
        .select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "grp", F.col("node").alias("leaf"), "tampered", "pos", "witness", "subroot", "root")


def verified_manifest(docs: DataFrame, **options) -> DataFrame:
    """Per row: its leaf, its group's root, the root, the digest of its proof, and what folding the (partly tampered) leaf gives."""
    m = manifest(docs, **options).select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("witness")).cast("binary"), 256).alias("proof_sha256"),
                              folded(F.col("tampered"), F.col("witness")).alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))
