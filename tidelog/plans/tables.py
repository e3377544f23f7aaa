"""Reading the driver tables and shaping them as event inputs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def events_ts_utc(df: DataFrame) -> DataFrame:
    """``events.ts`` is TIMESTAMP_NTZ; read it as an instant of the session's zone, which is UTC."""
    return df.withColumn("ts", F.col("ts").cast("timestamp"))
