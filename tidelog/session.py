"""Session helpers.

On a cluster the session comes from the launcher and already names a shared
``spark.checkpoint.dir``; we only read it.  Tests and the bench build a local
session and point the checkpoint directory at a fresh scratch folder, which is
the only place a directory of our own is chosen.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC session zone (all event times are instants),
# AQE for partition coalescing and skew splits, Arrow for the pandas paths; a generated
# method over 8,000 bytes is never compiled by the JVM, so such a stage runs in smaller ones.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tidelog",
                  extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = "16g"
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_job_conf(spark: SparkSession) -> None:
    """Set the SQL settings the operators assume on an existing session."""
    for k, v in BASE_CONF.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return bool(re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, as the cluster names it in
    ``spark.checkpoint.dir``; a fresh scratch folder only where none is named and the
    session is local (tests, bench).  Setting it again would nest a new folder
    in the old one, so that happens once."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tidelog-ckpt-", dir=os.environ.get("TIDELOG_SCRATCH", "/tmp"))
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once into the session's checkpoint folder and read from there, so that all that is derived from
    it sees the same rows, also after an executor is lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
