"""Intermediate results as tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkrank.errors import require


def staging_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, under a temporary one, on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        require(spark.sparkContext.master.startswith("local"), "a cluster without spark.checkpoint.dir")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written down and read again: computed once however often it is used, and safe from lost executors."""
    path = staging_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
