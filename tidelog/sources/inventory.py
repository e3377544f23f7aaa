"""File inventory, head fingerprint, change detection, position manifest.

An *inventory* row describes a file as it is now: ``path, size, mtime`` and
``head`` (its first ``signature_chars`` characters).  A *manifest* row is what
was saved after the last read: ``path, mtime, pos, size, sig_h, sig_b`` (md5
of the first ``sig_b`` characters).  ``detect_changes`` joins the two (full
outer join on path; a missing file counts as all zeros) and says per file:

* ``truncated``: mtime newer and size smaller than saved -> read from 0;
* ``replaced``: the fingerprint of the saved length differs -> read from 0;
* ``grown``: size > 0, size > saved size, mtime >= saved mtime -> read from pos;
* ``unchanged``: nothing to read.

A file never seen has an all-zero manifest row, so it is ``grown`` from 0.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: md5 of the empty string (fingerprint of an empty head).
EMPTY_MD5 = "d41d8cd98f00b204e9800998ecf8427e"
SIGNATURE_CHARS = 1024

MANIFEST_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("mtime", T.DoubleType()),
    T.StructField("pos", T.LongType()), T.StructField("size", T.LongType()),
    T.StructField("sig_h", T.StringType()), T.StructField("sig_b", T.IntegerType()),
    T.StructField("saved_at", T.DoubleType()),
])


def head_fingerprint(text: Column, n: int | Column = SIGNATURE_CHARS) -> tuple[Column, Column]:
    """md5 hex of the first ``n`` characters and how many there were."""
    n = F.lit(n) if isinstance(n, int) else n
    head = F.coalesce(text, F.lit("")).substr(F.lit(1), n)
    return F.md5(head), F.length(head)


def _read_heads(paths: pd.Series, n: int) -> pd.Series:
    import pyarrow.fs as pafs
    out = []
    for p in paths:
        try:
            fs, rel = pafs.FileSystem.from_uri(p) if "://" in p else (pafs.LocalFileSystem(), p)
            with fs.open_input_stream(rel) as fh:
                raw = fh.read(4 * n + 4)
            txt = raw.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")[:n]
            out.append(txt)
        except (OSError, ValueError):
            out.append(None)
    return pd.Series(out)


def file_inventory(spark: SparkSession, paths, signature_chars: int = SIGNATURE_CHARS) -> DataFrame:
    """Listing of files with their head.  The listing is Spark's file index
    (``binaryFile`` without its content column); heads are read in the
    executors, a few KiB per file, with Arrow's file systems."""
    listing = spark.read.format("binaryFile").load(paths).select(
        F.col("path"), F.col("length").alias("size"),
        (F.unix_micros(F.col("modificationTime")) / F.lit(1e6)).alias("mtime"))

    @F.pandas_udf(T.StringType())
    def heads(p: pd.Series) -> pd.Series:
        return _read_heads(p.map(lambda x: x[5:] if x.startswith("file:") and not x.startswith("file://") else x),
                           signature_chars)

    return listing.withColumn("head", heads(F.col("path")))


def detect_changes(inventory: DataFrame, manifest: DataFrame) -> DataFrame:
    """O07 (see module doc): one row per path with ``change`` and ``read_from``."""
    inv = inventory.select("path", F.col("size").alias("cur_size"), F.col("mtime").alias("cur_mtime"), "head")
    man = manifest.select("path", "mtime", "pos", "size", "sig_h", "sig_b")
    j = inv.join(man, "path", "full_outer")
    cur_size = F.coalesce(F.col("cur_size"), F.lit(0))
    cur_mtime = F.coalesce(F.col("cur_mtime"), F.lit(0.0))
    s_size = F.coalesce(F.col("size"), F.lit(0))
    s_mtime = F.coalesce(F.col("mtime"), F.lit(0.0))
    s_b = F.coalesce(F.col("sig_b"), F.lit(0))
    s_h = F.coalesce(F.col("sig_h"), F.lit(EMPTY_MD5))
    cur_h = F.md5(F.coalesce(F.col("head"), F.lit("")).substr(F.lit(1), s_b))
    truncated = (cur_mtime > s_mtime) & (cur_size < s_size)
    replaced = cur_h != s_h
    after_reset_ready = cur_size > 0
    grown = (cur_size > 0) & (cur_size > s_size) & (cur_mtime >= s_mtime)
    change = (F.when(truncated, "truncated").when(replaced, "replaced").when(grown, "grown").otherwise("unchanged"))
    read_from = (F.when(truncated | replaced, F.when(after_reset_ready, F.lit(0)))
                 .when(grown, F.coalesce(F.col("pos"), F.lit(0))))
    return j.select("path", change.alias("change"), read_from.cast("bigint").alias("read_from"),
                    cur_size.cast("bigint").alias("size"))


def _generation(spark: SparkSession, path: str) -> int:
    """Number of the last snapshot that was written to its end (its ``_SUCCESS`` mark is there), 0 without one."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = [n for n in names if n.startswith("snapshot-") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return max((int(n.removeprefix("snapshot-")) for n in done), default=0)


def _log(path: str, generation: int) -> str:
    return f"{path}/log-{generation + 1:08d}"


def _snapshot(path: str, generation: int) -> str:
    return f"{path}/snapshot-{generation:08d}"


def save_manifest(df: DataFrame, path: str) -> None:
    """Append position rows (JSON lines, one per file and save) to the log after the last snapshot."""
    names = [f.name for f in MANIFEST_SCHEMA.fields]
    df.select(*names).write.mode("append").json(_log(path, _generation(df.sparkSession, path)))


def _saved(spark: SparkSession, path: str, generation: int) -> DataFrame:
    """Latest row per path of a snapshot and the log after it; corrupt rows of the log are ignored."""
    rows = spark.read.parquet(_snapshot(path, generation)) if generation else spark.createDataFrame([], MANIFEST_SCHEMA)
    log = spark._jvm.org.apache.hadoop.fs.Path(_log(path, generation))
    if log.getFileSystem(spark._jsc.hadoopConfiguration()).exists(log):
        schema = T.StructType(list(MANIFEST_SCHEMA.fields) + [T.StructField("_corrupt", T.StringType())])
        raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(_log(path, generation))
        rows = rows.unionByName(raw.where(F.col("_corrupt").isNull() & F.col("path").isNotNull()).drop("_corrupt"))
    rest = [f.name for f in MANIFEST_SCHEMA.fields if f.name != "path"]
    return rows.groupBy("path").agg(F.max_by(F.struct(*rest), F.col("saved_at")).alias("m")).select("path", "m.*")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Latest saved row per path, from the last snapshot and what was saved after it."""
    return _saved(spark, path, _generation(spark, path))


def compact_manifest(spark: SparkSession, path: str) -> None:
    """The latest rows as a new snapshot, after which the log starts anew.

    The switch is the snapshot's ``_SUCCESS`` mark, which its writer puts last: a load or save sees the old snapshot with
    its log, or the new one.  A compaction that broke off leaves a folder without the mark, which the next one
    overwrites.  One writer at a time saves or compacts.  The generation before stays for readers that have begun; older ones go.
    """
    last = _generation(spark, path)
    _saved(spark, path, last).write.mode("overwrite").parquet(_snapshot(path, last + 1))
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for old in ([_snapshot(path, last - 1), _log(path, last - 1)] if last > 1 else [_log(path, 0)] if last == 1 else []):
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(old), True)


def python_fingerprint(text: str, n: int = SIGNATURE_CHARS) -> tuple[str, int]:
    """Plain form of O08 for tests."""
    b = text[:n]
    return hashlib.md5(b.encode()).hexdigest(), len(b)
