"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import apply_job_conf, ensure_checkpoint_dir

#: A word is a run of characters other than ASCII white space; the same class in
#: Java's and DuckDB's regular expressions.  ``bytes.split()`` splits alike.
WORD = r"[^\x20\x09-\x0D]+"

#: Arrow batches are bounded by rows and by bytes, as texts may be very long.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
}


def job_conf(spark: SparkSession) -> None:
    apply_job_conf(spark)
    for k, v in ARROW_CONF.items():
        spark.conf.set(k, v)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def kept_table(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so that a
    lost executor costs neither the rows nor their lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo: the fixed folds of the contracts."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def spread(*cols, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    h = F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in cols])
    return F.pmod(h, F.lit(1 << 40)) / F.lit(float(1 << 40))


def mix64(h: np.ndarray) -> np.ndarray:
    """Bit mixing of uint64 (two multiply and shift rounds)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hashed(tokens: Iterable[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t) for t in tokens], dtype=np.uint64)


def runs(frames: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Groups of equal (non-null, integer) keys from a partition sorted by them, as
    columns; a group may span batches.  Callers bound the size of a group."""
    held: list[dict[str, np.ndarray]] = []
    last = None

    def whole() -> dict[str, np.ndarray]:
        return held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for f in frames:
        if not len(f):
            continue
        cols = {c: f[c].to_numpy() for c in f.columns}
        k = np.stack([cols[c] for c in keys], axis=1)
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        edges = [0, *cuts.tolist(), len(f)]
        for lo, hi in zip(edges, edges[1:]):
            key = tuple(k[lo].tolist())
            if held and key != last:
                yield whole()
                held = []
            held.append({c: v[lo:hi] for c, v in cols.items()})
            last = key
    if held:
        yield whole()
