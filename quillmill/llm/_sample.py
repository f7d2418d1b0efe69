"""Bounded samples of labelled rows, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1)).cast("int")


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, bound: int, seed: str) -> DataFrame:
    """doc_id, text, y of at most ``bound`` labelled rows outside the held-out remainder, least seeded hash first.

    Null ids and null labels are left out; an id that is labelled twice counts once (its larger label).
    """
    ids = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (remainder(F.col("doc_id"), modulus) != held))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
        .limit(bound)
    )
    # The sample has ``bound`` rows at most.
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
