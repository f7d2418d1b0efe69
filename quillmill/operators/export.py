"""Export shapes and sinks: COCO images and annotations, split files, segmentation counts, run manifests."""

from __future__ import annotations

import datetime
import json
import os
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Semantic classes of block types, and COCO category ids. Other types have no class.
SEMANTIC = {
    "paragraph": "plain_text", "title": "plain_text", "caption": "plain_text", "header": "plain_text", "footer": "plain_text", "text": "plain_text",
    "table": "table", "equation": "math", "math": "math", "latex": "math", "figure": "figure", "auto_figure": "figure",
}
CATEGORIES = {"plain_text": 1, "table": 2, "math": 3, "figure": 4}


def semantic(kind: Column) -> Column:
    return F.get(F.array(F.element_at(F.create_map(*(F.lit(x) for p in SEMANTIC.items() for x in p)), kind)), F.lit(0))


def coco_images(splits: DataFrame, pages: DataFrame) -> DataFrame:
    """split, image_id, page_id, file_name, width, height: ids count all of a split's pages from 1, also those without a page row."""
    ids = splits.withColumn("image_id", F.row_number().over(Window.partitionBy("split").orderBy("page_id")).cast("long"))
    return ids.join(pages, "page_id").select("split", "image_id", "page_id", F.concat("page_id", F.lit(".png")).alias("file_name"), "width", "height")


def coco_annotations(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """split, id, image_id, category_id, area, bbox: ids count from 1 in each split, in order of image and block."""
    rows = images.select("split", "image_id", "page_id").join(blocks, "page_id").withColumn("_c", semantic(F.col("kind")))
    rows = rows.where("_c is not null and w > 0 and h > 0")
    category = F.element_at(F.create_map(*(F.lit(x) for p in CATEGORIES.items() for x in p)), F.col("_c"))
    number = F.row_number().over(Window.partitionBy("split").orderBy("image_id", "pos")).cast("long")
    bbox = F.array(*(F.col(c).cast("double") for c in ("x", "y", "w", "h")))
    return rows.select("split", number.alias("id"), "image_id", category.alias("category_id"), (F.col("w") * F.col("h")).cast("double").alias("area"), bbox.alias("bbox"))


def copied_and_missing(splits: DataFrame, files: DataFrame) -> DataFrame:
    """split, copied, missing: how many of each split's pages have a file."""
    rows = splits.join(files.select("page_id").distinct().withColumn("_f", F.lit(True)), "page_id", "left")
    return rows.groupBy("split").agg(F.count("_f").alias("copied"), F.count_if(F.col("_f").isNull()).alias("missing"))


def write_text(path: str, text: str) -> None:
    """Writes a small driver-side file by way of a temporary one and a rename."""
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as out:
        out.write(text)
        out.flush()
        os.fsync(out.fileno())
    os.replace(temporary, path)


def write_native(pages: DataFrame, path: str) -> None:
    """Pages as Parquet, a folder for each split."""
    pages.write.mode("overwrite").partitionBy("split").parquet(path)


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, in as many files as there are partitions."""
    df.write.mode("overwrite").json(path)


#: The keys that a run manifest must have.
MANIFEST_KEYS = ("run_id", "version", "seed", "pages", "ok", "fail", "splits", "density", "scale", "recovered", "fallback", "targets", "started", "ended")


def manifest(facts: dict) -> str:
    """The manifest's JSON; a missing key raises."""
    facts = {"version": datetime.datetime.now(datetime.timezone.utc).strftime("%Y%m%d-%H%M%S")} | facts
    missing = [k for k in MANIFEST_KEYS if k not in facts]
    if missing:
        raise ValueError(f"manifest lacks {', '.join(missing)}")
    return json.dumps(facts, indent=2, ensure_ascii=False, default=str)


WRITERS = {"native": write_native, "lines": write_lines}


def export(df: DataFrame, target: str, path: str) -> dict:
    """Writes to a known target; another name is skipped, with the reason."""
    if target not in WRITERS:
        return {"target": target, "skipped": True, "reason": "unsupported-export-target"}
    WRITERS[target](df, path)
    return {"target": target, "skipped": False, "path": path}
