"""The flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources import tables as T


@query(
    """
    WITH x AS (
      SELECT lang, n_chars, len(string_split(text, chr(10))) AS n_lines FROM documents)
    SELECT lang, count(*) AS n_docs, CAST(sum(n_lines) AS BIGINT) AS n_lines,
           round(quantile_cont(n_lines, 0.05), 6) AS p05_lines,
           round(quantile_cont(n_lines, 0.50), 6) AS p50_lines,
           round(quantile_cont(n_lines, 0.95), 6) AS p95_lines,
           round(avg(n_chars), 6) AS mean_chars,
           round(count(*) / sum(count(*)) OVER (), 6) AS share
    FROM x GROUP BY lang
    """
)
def flagship_language_profile(spark, sf_dir):
    docs = T.read(spark, sf_dir, "documents")
    rows = docs.select("lang", "n_chars", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))
    profile = rows.groupBy("lang").agg(
        F.count("*").alias("n_docs"),
        F.sum("n_lines").alias("n_lines"),
        F.percentile("n_lines", F.lit([0.05, 0.5, 0.95])).alias("_p"),
        F.round(F.avg("n_chars"), 6).alias("mean_chars"),
    )
    total = profile.agg(F.sum("n_docs").alias("_all"))  # one row
    return profile.crossJoin(total).select(
        "lang", "n_docs", "n_lines",
        F.round(F.col("_p")[0], 6).alias("p05_lines"),
        F.round(F.col("_p")[1], 6).alias("p50_lines"),
        F.round(F.col("_p")[2], 6).alias("p95_lines"),
        "mean_chars", F.round(F.col("n_docs") / F.col("_all"), 6).alias("share"),
    )
