"""Deterministic sampling: weighted picks and draws by a hash, the same whatever the partitioning or the retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cumulative(pool: DataFrame, weight: Column, order: list[str], group: list[str]) -> DataFrame:
    """The pool with _lo and _hi: each item's stretch of its group's running weight, and _all, the group's weight.

    Weights below 0 count as 0; if all of a group are 0, every item weighs 1.
    """
    every = Window.partitionBy(*group)
    running = every.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    pool = pool.withColumn("_w", F.greatest(weight, F.lit(0.0)))
    pool = pool.withColumn("_w", F.when(F.sum("_w").over(every) > 0, F.col("_w")).otherwise(F.lit(1.0)))
    return pool.withColumns({"_hi": F.sum("_w").over(running), "_all": F.sum("_w").over(every)}).withColumn("_lo", F.col("_hi") - F.col("_w"))


def first_above(draws: DataFrame, pool: DataFrame, item: str, group: str, per_bucket: int = 16) -> DataFrame:
    """draws (with ``u`` and the group) with the first item, by id, of their group whose running weight is above u times the group's.

    ``pool`` is a result of ``cumulative`` in the order of the items. A group's weight is cut into even buckets, a
    few items each; an item stands in all that its stretch touches, so a draw meets the items of one bucket only.
    """
    before = F.lag("_hi", 1, 0.0).over(Window.partitionBy(group).orderBy(item, "_hi"))
    sizes = pool.groupBy(group).agg(F.max("_all").alias("_sum"), F.ceil(F.count("*") / per_bucket).alias("_of"))
    bucket = lambda at: F.floor(at / F.col("_sum") * F.col("_of"))
    items = pool.select(group, item, "_hi", before.alias("_from")).where("_hi > _from").join(sizes, group)
    items = items.select(group, item, "_hi", F.explode(F.sequence(bucket(F.col("_from")), bucket(F.col("_hi")))).alias("_at"))
    draws = draws.join(sizes, group).withColumn("_x", F.col("u") * F.col("_sum")).withColumn("_at", bucket(F.col("_x"))).drop("_sum", "_of")
    found = draws.join(items, [group, "_at"]).where("_x < _hi")
    keys = [c for c in draws.columns if c not in ("_x", "_at")]
    return found.groupBy(*keys).agg(F.min(item).alias(item))


def draw_without_replacement(pool: DataFrame, weight: Column, u: Column, k: int, group: list[str], order: list[str]) -> DataFrame:
    """k items of each group by exponential keys -ln(u) / weight, least first; items of weight 0 are never drawn."""
    key = F.when(weight > 0, -F.log(F.greatest(u, F.lit(1e-300))) / weight)
    ranked = pool.withColumn("_k", key).where("_k is not null")
    return ranked.withColumn("pick", F.row_number().over(Window.partitionBy(*group).orderBy("_k", *order))).where(F.col("pick") <= k).drop("_k")


def fall_through(df: DataFrame, match: Column, group: list[str]) -> DataFrame:
    """The rows that match; all rows of a group in which none does."""
    df = df.withColumn("_m", match)
    return df.withColumn("_any", F.max("_m").over(Window.partitionBy(*group))).where(F.col("_m") | ~F.col("_any")).drop("_m", "_any")


def first_of(df: DataFrame, key: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key: keep-first deduplication."""
    names = [f"_k{i}" for i in range(len(key))]
    df = df.withColumns(dict(zip(names, key, strict=True)))
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*names).orderBy(*order))).where("_r = 1").drop("_r", *names)


def threshold_pick(u: Column, shares: list[tuple[str, float]]) -> Column:
    """The first name whose running share is above u (strictly); the last name takes what is left."""
    total, running, out = sum(s for _, s in shares), 0.0, None
    for name, share in shares[:-1]:
        running += share / total
        out = F.when(u < running, name) if out is None else out.when(u < running, name)
    return out.otherwise(shares[-1][0]) if out is not None else F.lit(shares[-1][0])


def dealt_splits(df: DataFrame, order: str, shares=(0.8, 0.1, 0.1), names=("train", "val", "test"), prefix: int = 4) -> DataFrame:
    """Contiguous splits over the sorted order: position / n below each running share.

    Positions are counted within the ids that share their first ``prefix`` characters and offset by the sizes of
    earlier prefixes, so only one row for each prefix is ever put in order in one place.
    """
    total = sum(shares) or 1.0
    shares = shares if sum(shares) > 0 else (0.8, 0.1, 0.1)
    rows = df.withColumn("_p", F.substring(order, 1, prefix))
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    inside = Window.partitionBy("_p").orderBy(order)
    rows = rows.join(offsets, "_p").withColumn("_i", F.col("_off") + F.row_number().over(inside) - 1)
    at = F.col("_i") / F.greatest(F.lit(1), F.col("_all"))
    first, second = shares[0] / total, shares[0] / total + shares[1] / total
    return rows.withColumn("split", F.when(at < first, names[0]).when(at < second, names[1]).otherwise(names[2])).drop("_p", "_off", "_all", "_i")
