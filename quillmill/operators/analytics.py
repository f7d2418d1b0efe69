"""Summaries of a table's columns: numeric, categorical, joint, and observed against target shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import entropy_bits

UNKNOWN = "unknown"


def numeric_summary(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """A row for each column: count, mean, population std and variance, min, max and interpolated p05, p50, p95.

    One pass with partial aggregation; null and non-finite values are left out; an empty column has count 0.
    """
    pairs = [x for c in columns for x in (F.lit(c), F.col(c).cast("double"))]
    rows = df.select(F.explode(F.create_map(*pairs)).alias("field", "v"))
    good = F.when(~F.isnan("v") & ~F.col("v").isin(float("inf"), float("-inf")), F.col("v"))
    rows = rows.select("field", good.alias("v")).groupBy("field")
    r = lambda c: F.round(c, digits)
    rows = rows.agg(
        F.count("v").alias("n"), r(F.avg("v")).alias("mean"), r(F.stddev_pop("v")).alias("std"), r(F.var_pop("v")).alias("variance"),
        F.min("v").alias("min"), F.max("v").alias("max"), F.percentile("v", F.lit([0.05, 0.5, 0.95])).alias("_p"),
    )
    return rows.select("field", "n", "mean", "std", "variance", "min", "max", *(r(F.col("_p")[i]).alias(n) for i, n in enumerate(("p05", "p50", "p95"))))


def categorical_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, value, n, share; null is ``unknown``. All columns in one pass."""
    pairs = [x for c in columns for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)))]
    counts = df.select(F.explode(F.create_map(*pairs)).alias("field", "value")).groupBy("field", "value").agg(F.count("*").alias("n"))
    total = counts.groupBy("field").agg(F.sum("n").alias("_all"))
    return counts.join(total, "field").select("field", "value", "n", (F.col("n") / F.col("_all")).alias("share"))


def entropies(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """field, n, unique_values, entropy_bits, normalised_entropy (0 with one value)."""
    rows = categorical_counts(df, columns).groupBy("field")
    rows = rows.agg(F.sum("n").alias("n"), F.count("*").alias("unique_values"), entropy_bits(F.col("share")).alias("_e"))
    most = F.when(F.col("unique_values") > 1, F.col("_e") / F.log2(F.col("unique_values"))).otherwise(F.lit(0.0))
    return rows.select("field", "n", "unique_values", F.round("_e", digits).alias("entropy_bits"), F.round(most, digits).alias("normalised_entropy"))


def joint_counts(df: DataFrame, first: Column, second: Column) -> DataFrame:
    """pair, n: how often two fields' values meet."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(UNKNOWN))
    return df.select(F.concat(text(first), F.lit(" × "), text(second)).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def top(counts: DataFrame, k: int, key: str) -> DataFrame:
    """The k largest counts, ties by key: a top-k, never a full sort."""
    return counts.orderBy(F.desc("n"), key).limit(k)


def gaps(observed: DataFrame, target: DataFrame) -> DataFrame:
    """key, target, observed, gap (observed less target), abs_gap over the union of keys; a missing share is 0."""
    rows = target.join(observed, "key", "full_outer").select("key", F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("observed", F.lit(0.0)).alias("observed"))
    gap = F.round(F.col("observed") - F.col("target"), 6)
    return rows.select("key", F.round("target", 6).alias("target"), F.round("observed", 6).alias("observed"), gap.alias("gap"), F.abs(gap).alias("abs_gap"))


def recommend(gap_rows: DataFrame, rules: list[tuple[str, Column, Column]], facts: DataFrame, threshold: float = 0.15) -> DataFrame:
    """rule, detail: one row for each fact row that breaks a rule and each gap of at least ``threshold``, else one ``ok`` row."""
    found = gap_rows.where(F.col("abs_gap") >= threshold).select(F.lit("target_gap").alias("rule"), F.col("key").alias("detail"))
    for name, breaks, detail in rules:
        found = found.unionByName(facts.where(breaks).select(F.lit(name).alias("rule"), detail.cast("string").alias("detail")))
    some = found.agg(F.count("*").alias("_n"))
    ok = some.where("_n = 0").select(F.lit("ok").alias("rule"), F.lit("").alias("detail"))
    return found.unionByName(ok)


def normalise(df: DataFrame, key: str, weight: str) -> DataFrame:
    """key, share: weights over their sum; a negative weight or a sum that isn't positive raises."""
    total = df.agg(F.sum(F.when(F.col(weight) >= 0, F.col(weight)).otherwise(F.raise_error(F.lit("cfg/negative-weight")))).alias("_all"))
    checked = F.when(F.col("_all") > 0, F.col(weight) / F.col("_all")).otherwise(F.raise_error(F.lit("cfg/zero-sum-distribution")))
    return df.crossJoin(total).select(key, checked.alias("share"))


def unpivoted_distinct(df: DataFrame, columns: list[str]) -> DataFrame:
    """kind, value: the distinct non-blank values of several columns."""
    pairs = [x for c in columns for x in (F.lit(c), F.lower(F.trim(F.col(c).cast("string"))))]
    return df.select(F.explode(F.create_map(*pairs)).alias("kind", "value")).where("value <> ''").distinct()


def running_ratio(df: DataFrame, group: str, order: list[str], failed: Column) -> DataFrame:
    """Every row with its running failures, rows and failure ratio in its group."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    bad, seen = F.sum(failed.cast("long")).over(w), F.count("*").over(w)
    return df.withColumns({"failures": bad, "seen": seen, "ratio": F.round(bad / seen, 6)})
