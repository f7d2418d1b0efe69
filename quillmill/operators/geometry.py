"""Boxes on pages: overlap, nearest target, extent, rebuilding, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import overlap, parts_per_million, ratio


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + c) for c in ("x", "y", "w", "h"))


def area(w: Column, h: Column) -> Column:
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def overlapping_pairs(boxes: DataFrame, limit: float) -> DataFrame:
    """page, a, b, ratio of every two boxes of a page (a before b) that share over ``limit`` of the smaller one.

    An equi-join on the page: pairs are made within a page only.
    """
    cols = ("pos", "x", "y", "w", "h")
    a = boxes.select("page", *(F.col(c).alias(f"a_{c}") for c in cols))
    b = boxes.select("page", *(F.col(c).alias(f"b_{c}") for c in cols))
    least = F.least(F.greatest(area(F.col("a_w"), F.col("a_h")), F.lit(1)), F.greatest(area(F.col("b_w"), F.col("b_h")), F.lit(1)))
    shared = overlap(box("a_"), box("b_")) / least
    pairs = a.join(b, "page").where("a_pos < b_pos").withColumn("ratio", F.round(shared, 6))
    return pairs.where(F.col("ratio") > limit).select("page", F.col("a_pos").alias("a"), F.col("b_pos").alias("b"), "ratio")


def nearest(captions: DataFrame, targets: DataFrame) -> DataFrame:
    """page, caption, target, distance, allowed, ok: each caption's nearest target by centre distance, ties by position."""
    c = captions.select("page", *(F.col(k).alias(f"c_{k}") for k in ("pos", "x", "y", "w", "h")))
    t = targets.select("page", *(F.col(k).alias(f"t_{k}") for k in ("pos", "x", "y", "w", "h")))
    middle = lambda p, q: F.col(f"{p}") + F.col(f"{q}") / 2
    far = F.sqrt(F.pow(middle("c_x", "c_w") - middle("t_x", "t_w"), 2) + F.pow(middle("c_y", "c_h") - middle("t_y", "t_h"), 2))
    rows = c.join(t, "page").withColumn("_d", F.round(far, 6)).groupBy("page", "c_pos", "c_h")
    rows = rows.agg(F.min(F.struct("_d", "t_pos", "t_h")).alias("_m"))
    allowed = F.greatest(F.col("_m.t_h") * 1.35, F.col("c_h") * 8.0, F.lit(80.0))
    return rows.select("page", F.col("c_pos").alias("caption"), F.col("_m.t_pos").alias("target"), F.col("_m._d").alias("distance"), F.round(allowed, 6).alias("allowed"), (F.col("_m._d") <= allowed).alias("ok"))


def extent_ratio(boxes: DataFrame, page_area: int) -> DataFrame:
    """page, extent: the outer box of all valid boxes over the page's area, to six places."""
    valid = boxes.where("w > 0 and h > 0").groupBy("page")
    rows = valid.agg(F.min("x").alias("_a"), F.max(F.col("x") + F.col("w")).alias("_b"), F.min("y").alias("_c"), F.max(F.col("y") + F.col("h")).alias("_d"))
    return rows.select("page", parts_per_million((F.col("_b") - F.col("_a")) * (F.col("_d") - F.col("_c")), page_area).alias("extent"))


def rebuilt(boxes: DataFrame, group: list[str]) -> DataFrame:
    """The bounding box of each group's boxes."""
    rows = boxes.groupBy(*group).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("_r"), F.max(F.col("y") + F.col("h")).alias("_b"), F.count("*").alias("n"))
    return rows.select(*group, "x", "y", (F.col("_r") - F.col("x")).alias("w"), (F.col("_b") - F.col("y")).alias("h"), "n")


def band_variance(boxes: DataFrame, height: int, width: int, bands: int = 8) -> DataFrame:
    """page, variance: population variance of the ink share of horizontal bands, boxes as ink.

    A box's ink is split over the bands that it crosses; bands without ink count as 0.
    """
    size = height // bands
    band = F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band")
    top = F.col("band") * size
    end = F.when(F.col("band") == bands - 1, F.lit(height)).otherwise(top + size)
    rows = boxes.select("page", "x", "y", "w", "h", band)
    tall = F.greatest(F.lit(0), F.least(F.col("y") + F.col("h"), end) - F.greatest(F.col("y"), top))
    rows = rows.select("page", "band", (tall * F.col("w") / ((end - top) * width)).alias("_ink")).groupBy("page", "band").agg(F.sum("_ink").alias("_ink"))
    return rows.groupBy("page").agg(F.round(F.var_pop("_ink"), 6).alias("variance"))


def coverage(lines: DataFrame, masks: DataFrame) -> DataFrame:
    """page, pos, covered: the share of each line's box that mask boxes (taken as apart) cover, 1 at most."""
    a = lines.select("page", *(F.col(c).alias(f"a_{c}") for c in ("pos", "x", "y", "w", "h")))
    b = masks.select("page", *(F.col(c).alias(f"b_{c}") for c in ("x", "y", "w", "h")))
    rows = a.join(b, "page", "left").groupBy("page", "a_pos", "a_w", "a_h").agg(F.sum(F.coalesce(overlap(box("a_"), box("b_")), F.lit(0))).alias("_s"))
    return rows.select("page", F.col("a_pos").alias("pos"), F.round(F.least(F.lit(1.0), ratio(F.col("_s"), area(F.col("a_w"), F.col("a_h")))), 6).alias("covered"))
