"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes the table under ``spark.checkpoint.dir`` (a folder of its own where that is unset, as in tests) and reads it again."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="quillmill-")
    path = f"{base.rstrip('/')}/quillmill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
