"""Temporary tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tidemill-")
    return f"{root.rstrip('/')}/tidemill/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table that is read back: a hop of a walk is computed once, and survives lost executors."""
    where = scratch(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
