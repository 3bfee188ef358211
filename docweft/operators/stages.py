"""Tables between steps, in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def stage_dir(spark: SparkSession) -> str:
    """A new path in the shared folder; a local session without that setting gets its own folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/docweft/{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """The same rows, read from a table: plans behind it stay short, and lost executors repeat nothing before it."""
    path = f"{stage_dir(df.sparkSession)}/{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
