"""Durable scratch space: where lineage is cut and intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder path under the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``. Where that is unset, a session on one
    machine gets a local temporary folder and a cluster an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or _local_dir(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _local_dir(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="kindred-")


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder and cut its lineage."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(_local_dir(spark))
    return df.checkpoint()
