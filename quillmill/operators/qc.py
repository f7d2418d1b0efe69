"""The chain of page rules: the first that fails names the page's error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import inside_page
from .geometry import box, overlapping_pairs

#: The rules that ``first_failure`` applies, in order; a name left out of ``rules`` is not in the plan at all.
RULES = ("outside", "coverage", "small", "overlap", "title")


def chain(rules: list[tuple[str, Column]]) -> Column:
    """The code of the first rule whose condition holds; null if none does. A null condition holds not."""
    return F.coalesce(*(F.when(fails, F.lit(code)) for code, fails in rules)) if rules else F.lit(None).cast("string")


def first_failure(boxes: DataFrame, width: int, height: int, rules=RULES, least_extent: float = 0.008, most_overlap: float = 0.35, title_at: float = 0.28) -> DataFrame:
    """page, code. One aggregation of the boxes; the overlap join is made only if its rule is on."""
    pages = boxes.groupBy("page").agg(
        F.bool_or(~inside_page(*box(), width, height)).alias("_outside"),
        F.bool_or((F.col("w") < 4) | (F.col("h") < 4)).alias("_small"),
        F.bool_or((F.col("kind") == "title") & (F.col("y") > title_at * height)).alias("_low"),
        ((F.max(F.col("x") + F.col("w")) - F.min("x")) * (F.max(F.col("y") + F.col("h")) - F.min("y")) / float(width * height)).alias("_extent"),
    )
    if "overlap" in rules:
        pairs = overlapping_pairs(boxes.where("kind <> 'caption'"), most_overlap).select("page").distinct().withColumn("_overlap", F.lit(True))
        pages = pages.join(pairs, "page", "left")
    conditions = {
        "outside": ("qc/bbox-outside-page", F.col("_outside")),
        "coverage": ("qc/visual-coverage-too-low", F.col("_extent") < least_extent),
        "small": ("qc/invalid-line-bbox", F.col("_small")),
        "overlap": ("qc/block-overlap-too-high", F.col("_overlap") if "overlap" in rules else None),
        "title": ("qc/title-too-low", F.col("_low")),
    }
    return pages.select("page", chain([conditions[r] for r in RULES if r in rules]).alias("code"))
