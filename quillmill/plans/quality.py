"""Quality-control queries: order, reading flow, page rules, and the chain whose first failure wins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbers as N
from ..operators import geometry as G, qc
from ..registry import query
from ..sources import tables as T

W, H = T.PAGE_W, T.PAGE_H


@query(f"WITH {T.CONV_LINES}, r AS (SELECT page, ord, row_number() OVER (PARTITION BY page ORDER BY ord) - 1 AS i FROM conv_lines) SELECT page, count(*) AS lines, bool_and(ord = i) AS contiguous FROM r GROUP BY page")
def line_order_contiguous(spark, sf_dir):
    """n distinct orders from 0 to n - 1 are contiguous: one aggregation, no window."""
    rows = T.conv_lines(spark, sf_dir).groupBy("page")
    ok = (F.min("ord") == 0) & (F.max("ord") == F.count("*") - 1) & (F.countDistinct("ord") == F.count("*"))
    return rows.agg(F.count("*").alias("lines"), ok.alias("contiguous"))


@query(
    f"""WITH {T.CONV_LINES}, j AS (SELECT page, y + 12 < lag(y) OVER (PARTITION BY page ORDER BY ord) AS jump FROM conv_lines)
    SELECT page, count(*) AS n, count(*) FILTER (jump) AS jumps, CASE WHEN count(*) < 4 THEN 0 ELSE greatest(4, count(*) // 6) END AS allowed,
    count(*) FILTER (jump) > CASE WHEN count(*) < 4 THEN 0 ELSE greatest(4, count(*) // 6) END AS suspicious FROM j GROUP BY page"""
)
def reading_order_jumps(spark, sf_dir):
    back = F.col("y") + 12 < F.lag("y").over(Window.partitionBy("page").orderBy("ord"))
    rows = T.conv_lines(spark, sf_dir).withColumn("jump", back).groupBy("page").agg(F.count("*").alias("n"), F.count_if("jump").alias("jumps"))
    allowed = F.when(F.col("n") < 4, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(4).cast("long"), F.expr("n div 6")))
    return rows.select("page", "n", "jumps", allowed.alias("allowed"), (F.col("jumps") > allowed).alias("suspicious"))


@query(f"WITH {T.BOXES} SELECT page, bool_or(kind = 'title' AND y > 0.28 * {H}) AS title_too_low FROM boxes GROUP BY page")
def title_position(spark, sf_dir):
    low = (F.col("kind") == "title") & (F.col("y") > 0.28 * H)
    return T.boxes(spark, sf_dir).groupBy("page").agg(F.bool_or(low).alias("title_too_low"))


@query(f"WITH {T.HTML_BLOCKS}, k AS (SELECT page_id, list(DISTINCT kind) AS kinds FROM html_blocks GROUP BY 1) SELECT page_id, list_contains(kinds, 'title') AS has_title, list_contains(kinds, 'title') AND (list_contains(kinds, 'paragraph') OR list_contains(kinds, 'list')) AS academic_ok FROM k")
def page_family_rules(spark, sf_dir):
    has = lambda k: F.array_contains("kinds", k)
    rows = T.html_blocks(spark, sf_dir).groupBy("page_id").agg(F.collect_set("kind").alias("kinds"))
    return rows.select("page_id", has("title").alias("has_title"), (has("title") & (has("paragraph") | has("list"))).alias("academic_ok"))


@query(f"WITH {T.HTML_BLOCKS} SELECT page_id, bool_and(kind IN ('title', 'paragraph', 'list', 'caption', 'header', 'footer')) AS text_only, bool_and(kind = 'table') AS table_only, count(*) AS blocks FROM html_blocks GROUP BY 1")
def content_purity(spark, sf_dir):
    text = F.col("kind").isin("title", "paragraph", "list", "caption", "header", "footer")
    return T.html_blocks(spark, sf_dir).groupBy("page_id").agg(F.bool_and(text).alias("text_only"), F.bool_and(F.col("kind") == "table").alias("table_only"), F.count("*").alias("blocks"))


@query(f"WITH {T.BOXES} SELECT round(avg(CASE WHEN x + w <= {W} AND y + h <= {H} THEN 1.0 ELSE 0.0 END), 6) AS valid_ratio, count(*) AS boxes FROM boxes")
def bbox_validity(spark, sf_dir):
    ok = N.inside_page(*G.box(), W, H)
    return T.boxes(spark, sf_dir).agg(F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 6).alias("valid_ratio"), F.count("*").alias("boxes"))


@query(
    f"""WITH {T.BOXES}, p AS (
      SELECT page, bool_or(NOT (x + w <= {W} AND y + h <= {H})) AS outside, bool_or(w < 4 OR h < 4) AS small, bool_or(kind = 'title' AND y > 0.28 * {H}) AS low,
             (max(x + w) - min(x)) * (max(y + h) - min(y)) / {W * H}.0 AS extent FROM boxes GROUP BY page),
    o AS (SELECT a.page, max(greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) / least(a.w * a.h, b.w * b.h)) AS r
      FROM boxes a JOIN boxes b ON a.page = b.page AND a.pos < b.pos WHERE a.kind <> 'caption' AND b.kind <> 'caption' GROUP BY 1)
    SELECT p.page, CASE WHEN outside THEN 'qc/bbox-outside-page' WHEN extent < 0.008 THEN 'qc/visual-coverage-too-low' WHEN small THEN 'qc/invalid-line-bbox'
      WHEN round(coalesce(r, 0), 6) > 0.35 THEN 'qc/block-overlap-too-high' WHEN low THEN 'qc/title-too-low' END AS code FROM p LEFT JOIN o ON p.page = o.page"""
)
def qc_first_failure(spark, sf_dir):
    """Each page's first failing rule; rules that are switched off never enter the plan."""
    return qc.first_failure(T.boxes(spark, sf_dir), W, H)


@query(f"WITH {T.BOXES}, c AS (SELECT kind, count(*) AS n FROM boxes GROUP BY kind) SELECT kind, n, CASE WHEN kind IN ('title', 'paragraph', 'caption') THEN 'plain_text' WHEN kind = 'table' THEN 'table' WHEN kind = 'figure' THEN 'figure' END AS semantic FROM c")
def label_semantic_map(spark, sf_dir):
    from ..operators.export import semantic

    return T.boxes(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n")).withColumn("semantic", semantic(F.col("kind")))
