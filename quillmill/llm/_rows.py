"""Rows of a documents table by their identity: doc_id (null is an id) and a hash of the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them where docs has such a column in whatever case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def key() -> Column:
    """The hash that stands for the text; a null text has one too."""
    return F.xxhash64("text")


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without the rows whose (doc_id, key) are in ``rows``, a written table; any other columns stay."""
    _id, _key = free(docs, "rows_id", "rows_key")
    rows = rows.select(F.col("doc_id").alias(_id), F.col("key").alias(_key)).distinct()
    return docs.join(rows, F.col("doc_id").eqNullSafe(F.col(_id)) & (key() == F.col(_key)), "left_anti")


def once(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """docs with one row of each (doc_id, key) in ``repeated``, a written table; other rows as they are."""
    if repeated.isEmpty():
        return docs
    _id, _key, own = free(docs, "rows_id", "rows_key", "rows_own")
    rows = repeated.select(F.col("doc_id").alias(_id), F.col("key").alias(_key)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(_id)) & (key() == F.col(_key))
    some = docs.withColumn(own, key()).join(rows, same, "left_semi").dropDuplicates(["doc_id", own]).drop(own)
    return docs.join(rows, same, "left_anti").unionByName(some)
