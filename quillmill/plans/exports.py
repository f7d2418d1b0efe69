"""Export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import export as E
from ..functions import numbers as N
from ..registry import query
from ..sources import tables as T
from .sampling import _SPLIT, _splits

_PAGE_ROWS = "page_rows AS (SELECT lpad(CAST(page_id AS VARCHAR), CAST(greatest(6, length(CAST(page_id AS VARCHAR))) AS INTEGER), '0') AS page_id, 600 + page_id % 3 AS width, 800 AS height FROM pages)"
_IMAGES = f"""{_SPLIT}, {_PAGE_ROWS}, ids AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY page_id) AS image_id FROM splits),
images AS (SELECT split, image_id, page_id, page_id || '.png' AS file_name, width, height FROM ids JOIN page_rows USING (page_id))"""


def _pages(spark, sf_dir):
    rows = T.read(spark, sf_dir, "pages")
    return rows.select(N.padded(F.col("page_id")).alias("page_id"), (600 + F.col("page_id") % 3).alias("width"), F.lit(800).alias("height"))


def _images(spark, sf_dir):
    return E.coco_images(_splits(spark, sf_dir), _pages(spark, sf_dir))


@query(f"WITH {_IMAGES} SELECT * FROM images")
def coco_images(spark, sf_dir):
    return _images(spark, sf_dir)


@query(
    f"""WITH {_IMAGES}, {T.HTML_BLOCKS}, b AS (SELECT lpad(CAST(page_id AS VARCHAR), CAST(greatest(6, length(CAST(page_id AS VARCHAR))) AS INTEGER), '0') AS page_id, pos, kind, 40 AS x, 30 * pos AS y, 500 AS w, 20 + pos % 7 AS h FROM html_blocks WHERE kind <> 'list')
    SELECT split, row_number() OVER (PARTITION BY split ORDER BY image_id, pos) AS id, image_id, 1 AS category_id, CAST(w * h AS DOUBLE) AS area,
    concat_ws(',', CAST(x AS VARCHAR), CAST(y AS VARCHAR), CAST(w AS VARCHAR), CAST(h AS VARCHAR)) AS bbox FROM images JOIN b USING (page_id)"""
)
def coco_annotations(spark, sf_dir):
    blocks = T.html_blocks(spark, sf_dir).select(
        N.padded(F.col("page_id")).alias("page_id"), "pos", "kind", F.lit(40).alias("x"), (30 * F.col("pos")).alias("y"), F.lit(500).alias("w"), (20 + F.col("pos") % 7).alias("h")
    )
    rows = E.coco_annotations(_images(spark, sf_dir), blocks)
    return rows.withColumn("bbox", F.concat_ws(",", F.transform("bbox", lambda x: x.cast("long").cast("string"))))


@query(f"WITH {_SPLIT}, {_PAGE_ROWS} SELECT split, count(r.page_id) AS copied, count(*) - count(r.page_id) AS missing FROM splits s LEFT JOIN page_rows r ON s.page_id = r.page_id GROUP BY split")
def segmentation_manifest(spark, sf_dir):
    return E.copied_and_missing(_splits(spark, sf_dir), _pages(spark, sf_dir))
