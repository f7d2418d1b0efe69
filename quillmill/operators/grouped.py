"""Many small groups in Python without a call for each: partitions arrive in order and groups are cut as they pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def per_group(df: DataFrame, key: str, order: list[str], run: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """run(rows of one key, in order) -> rows of ``schema``. A task holds one group at a time, beside an Arrow batch."""
    at = df.columns.index(key)

    def partition(batches):
        import pandas as pd

        names = [part.strip().split(" ")[0] for part in schema.split(",")]
        now, rows = None, []
        for pdf in batches:
            out = []
            for row in zip(*(pdf[c].tolist() for c in pdf.columns), strict=True):
                if rows and row[at] != now:
                    out += run(rows)
                    rows = []
                now = row[at]
                rows.append(row)
            if out:
                yield pd.DataFrame(out, columns=names)
        if rows and (out := run(rows)):
            yield pd.DataFrame(out, columns=names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(partition, schema)
