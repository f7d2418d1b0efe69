"""A run's log as a stream: counters by status in event-time windows, and the ratio that ends a run early."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "page_id string, ts timestamp, status string, code string"


def read_log(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Events of a folder that run tasks append JSON lines to."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def progress(events: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """start, ok, fail, ratio of each window; events later than ``late`` are dropped with their window's state."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"))
    rows = rows.agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("fail"))
    return rows.select(F.col("w.start").alias("start"), "ok", "fail", F.round(F.col("fail") / F.greatest(F.lit(1), F.col("ok") + F.col("fail")), 6).alias("ratio"))


def should_abort(ok: int, fail: int, most: float, fail_fast: bool = False) -> bool:
    """Whether a run ends: any failure if failing fast, else a failure ratio above ``most``."""
    return fail > 0 and (fail_fast or fail / (ok + fail) > most)
