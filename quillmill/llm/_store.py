"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset (tests in one process), one made for this session.

    On a cluster an unset folder is an error: executors would write to disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = getattr(spark, "_quillmill_dir", None)
        if base is None:
            base = spark._quillmill_dir = "file://" + tempfile.mkdtemp(prefix="quillmill-")
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for one run's table; two runs never share one."""
    return f"{shared_dir(spark)}/quillmill/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes the table and reads it again: cuts lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._quillmill_path = path
    _written.append(table)
    return table


#: Tables written and not yet discarded, in order; ``settle`` discards from a mark on.
_written: list[DataFrame] = []


def mark() -> int:
    return len(_written)


def settle(df: DataFrame, name: str, since: int, *keep: DataFrame) -> DataFrame:
    """Saves df, then discards all tables saved since the mark but df and ``keep``, with their plans' shuffle files."""
    table = save(df, name)
    discard(*(t for t in _written[since:] if t is not table and all(t is not k for k in keep)))
    release(table)
    return table


def release(saved: DataFrame) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that are no longer referenced, such as those behind ``saved``."""
    gc.collect()
    saved.sparkSession._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Deletes saved tables that no later plan reads; tables that were derived from saved ones stay."""
    for table in tables:
        path = getattr(table, "_quillmill_path", None)
        _written[:] = [t for t in _written if t is not table]
        if path is not None:
            spark = table.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def conf_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
