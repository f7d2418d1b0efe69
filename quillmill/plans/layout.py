"""Layout arithmetic: boxes, page sizes, thresholds, placement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import generation, geometry as G, raster
from ..registry import query
from ..sources import tables as T

W, H = T.PAGE_W, T.PAGE_H


@query(f"WITH {T.BOXES} SELECT page, pos, w > 0 AND h > 0 AND x >= 0 AND y >= 0 AND x < {W} AND y < {H} AND x + w <= {W} AND y + h <= {H} AS inside FROM boxes")
def bbox_inside_page(spark, sf_dir):
    return T.boxes(spark, sf_dir).select("page", "pos", N.inside_page(*G.box(), W, H).alias("inside"))


@query(f"WITH {T.BOXES} SELECT page, min(pos) AS first_failure FROM boxes WHERE NOT (x + w <= {W} AND y + h <= {H}) GROUP BY page")
def bbox_first_failure(spark, sf_dir):
    bad = T.boxes(spark, sf_dir).where(~N.inside_page(*G.box(), W, H))
    return bad.groupBy("page").agg(F.min("pos").alias("first_failure"))


@query(f"WITH {T.BOXES} SELECT page, CAST(((max(x + w) - min(x)) * (max(y + h) - min(y)) * 2000000 + {W * H}) // {2 * W * H} AS DOUBLE) / 1000000 AS extent FROM boxes WHERE w > 0 AND h > 0 GROUP BY page")
def bbox_extent_ratio(spark, sf_dir):
    return G.extent_ratio(T.boxes(spark, sf_dir), W * H)


@query(f"WITH {T.BOXES} SELECT page, bool_or(w < 4 OR h < 4) AS too_small FROM boxes GROUP BY page")
def line_bbox_min(spark, sf_dir):
    return T.boxes(spark, sf_dir).groupBy("page").agg(F.bool_or((F.col("w") < 4) | (F.col("h") < 4)).alias("too_small"))


_PAIRS = f"""{T.BOXES}, pairs AS (
  SELECT a.page, a.pos AS a, b.pos AS b,
    round(greatest(0, least(a.x + greatest(a.w, 1), b.x + greatest(b.w, 1)) - greatest(a.x, b.x)) * greatest(0, least(a.y + greatest(a.h, 1), b.y + greatest(b.h, 1)) - greatest(a.y, b.y))
      / least(greatest(a.w * a.h, 1), greatest(b.w * b.h, 1)), 6) AS ratio
  FROM boxes a JOIN boxes b ON a.page = b.page AND a.pos < b.pos WHERE a.kind <> 'caption' AND b.kind <> 'caption')"""


@query(f"WITH {_PAIRS} SELECT * FROM pairs WHERE ratio > 0.2")
def block_overlap_pairs(spark, sf_dir):
    return G.overlapping_pairs(T.boxes(spark, sf_dir).where("kind <> 'caption'"), 0.2)


@query(
    f"""WITH {T.BOXES}, d AS (
      SELECT c.page, c.pos AS caption, c.h AS ch, t.pos AS target, t.h AS th,
             round(sqrt(power(c.x + c.w / 2.0 - t.x - t.w / 2.0, 2) + power(c.y + c.h / 2.0 - t.y - t.h / 2.0, 2)), 6) AS distance
      FROM boxes c JOIN boxes t ON c.page = t.page WHERE c.kind = 'caption' AND t.kind IN ('figure', 'table')),
    r AS (SELECT *, row_number() OVER (PARTITION BY page, caption ORDER BY distance, target) AS k FROM d)
    SELECT page, caption, target, distance, round(greatest(th * 1.35, ch * 8.0, 80.0), 6) AS allowed, distance <= greatest(th * 1.35, ch * 8.0, 80.0) AS ok FROM r WHERE k = 1"""
)
def caption_nearest(spark, sf_dir):
    boxes = T.boxes(spark, sf_dir)
    return G.nearest(boxes.where("kind = 'caption'"), boxes.where("kind in ('figure', 'table')"))


@query(f"WITH {T.BOXES} SELECT page, kind, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS n FROM boxes GROUP BY page, kind")
def block_bbox_rebuild(spark, sf_dir):
    return G.rebuilt(T.boxes(spark, sf_dir), ["page", "kind"])


@query(
    f"""WITH {T.BOXES}, b AS (SELECT *, unnest(range(8)) AS band FROM boxes),
    i AS (SELECT page, band, sum(greatest(0, least(y + h, band * {H // 8} + {H // 8}) - greatest(y, band * {H // 8})) * w / {H // 8 * W}.0) AS ink FROM b GROUP BY 1, 2)
    SELECT page, round(var_pop(ink), 6) AS variance FROM i GROUP BY page"""
)
def band_variance(spark, sf_dir):
    return G.band_variance(T.boxes(spark, sf_dir), H, W)


@query(
    f"""WITH {T.BOXES}, s AS (
      SELECT a.page, a.pos, a.w, a.h, sum(coalesce(greatest(0, least(a.x + greatest(a.w, 1), b.x + greatest(b.w, 1)) - greatest(a.x, b.x)) * greatest(0, least(a.y + greatest(a.h, 1), b.y + greatest(b.h, 1)) - greatest(a.y, b.y)), 0)) AS s
      FROM (SELECT * FROM boxes WHERE kind = 'paragraph') a LEFT JOIN (SELECT * FROM boxes WHERE kind = 'figure') b ON a.page = b.page GROUP BY 1, 2, 3, 4)
    SELECT page, pos, round(least(1.0, CASE WHEN w * h > 0 THEN s / (w * h) ELSE 0 END), 6) AS covered FROM s"""
)
def mask_bbox_hit(spark, sf_dir):
    boxes = T.boxes(spark, sf_dir)
    return G.coverage(boxes.where("kind = 'paragraph'"), boxes.where("kind = 'figure'"))


#: Page sizes in inches.
SIZES = [
    ("A3", 11.69, 16.54), ("A4", 8.27, 11.69), ("A5", 5.83, 8.27), ("A6", 4.13, 5.83), ("B4", 9.84, 13.90), ("B5", 6.93, 9.84), ("letter", 8.5, 11.0),
    ("legal", 8.5, 14.0), ("tabloid", 11.0, 17.0), ("executive", 7.25, 10.5), ("statement", 5.5, 8.5), ("folio", 8.5, 13.0), ("receipt", 3.15, 8.0), ("square", 8.0, 8.0),
]


@query(
    "SELECT name, dpi, CAST(round_even(w * dpi, 0) AS BIGINT) AS w, CAST(round_even(h * dpi, 0) AS BIGINT) AS h FROM (VALUES "
    + ", ".join(f"('{n}', CAST({w} AS DOUBLE), CAST({h} AS DOUBLE))" for n, w, h in SIZES)
    + ") AS s(name, w, h), (VALUES (200), (300)) AS d(dpi)"
)
def page_size_px(spark, sf_dir):
    """Pixels of each named size: half-even rounding of inches times resolution."""
    rows = spark.createDataFrame(SIZES, "name string, w double, h double").withColumn("dpi", F.explode(F.array(F.lit(200), F.lit(300))))
    px = lambda c: F.bround(F.col(c) * F.col("dpi")).cast("long").alias(c)
    return rows.select("name", "dpi", px("w"), px("h"))


_CLAMP = [(1, "50", "0.5"), (2, "150", "-1"), (3, "bad", None), (4, None, "2"), (5, "-3", "0.25")]


@query(
    "SELECT id, least(greatest(coalesce(try_cast(pct AS DOUBLE), 35.0), 0.0), 100.0) AS pct, least(greatest(coalesce(try_cast(x AS DOUBLE), 0.0), 0.0), 1.0) AS x FROM (VALUES "
    + ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in _CLAMP)
    + ") AS t(id, pct, x)"
)
def template_clamp(spark, sf_dir):
    rows = spark.createDataFrame(_CLAMP, "id int, pct string, x string")
    return rows.select("id", N.to_percent(F.col("pct"), 35.0).alias("pct"), N.clamp(F.coalesce(F.col("x").try_cast("double"), F.lit(0.0)), 0.0, 1.0).alias("x"))


@query(
    f"""WITH {T.PAGES}, t AS (SELECT page_id, n_chars, line_count, CASE WHEN n_chars >= 4000 THEN 'dense' WHEN n_chars >= 600 THEN 'normal' ELSE 'sparse' END AS density, doc_id % 3 = 0 AS has_equation, doc_id % 5 = 0 AS has_table FROM doc_pages)
    SELECT page_id, density,
      round(CASE density WHEN 'sparse' THEN 0.00035 WHEN 'dense' THEN 0.00110 ELSE 0.00075 END * CASE WHEN has_equation THEN 0.55 ELSE 1 END * CASE WHEN has_table THEN 1.15 ELSE 1 END, 9) AS min_content,
      round(CASE density WHEN 'sparse' THEN 0.0040 WHEN 'dense' THEN 0.0120 ELSE 0.0080 END * CASE WHEN has_equation THEN 0.90 ELSE 1 END * CASE WHEN has_table THEN 1.10 ELSE 1 END, 9) AS min_extent FROM t"""
)
def visual_thresholds(spark, sf_dir):
    rows = T.doc_pages(spark, sf_dir)
    density = F.when(F.col("n_chars") >= 4000, "dense").when(F.col("n_chars") >= 600, "normal").otherwise("sparse")
    by = lambda **v: F.element_at(F.create_map(*(F.lit(x) for k in v.items() for x in k)), F.col("density"))
    factor = lambda when, f: F.when(when, f).otherwise(1.0)
    equation, table = F.col("doc_id") % 3 == 0, F.col("doc_id") % 5 == 0
    return rows.withColumn("density", density).select(
        "page_id", "density",
        F.round(by(sparse=0.00035, normal=0.00075, dense=0.00110) * factor(equation, 0.55) * factor(table, 1.15), 9).alias("min_content"),
        F.round(by(sparse=0.0040, normal=0.0080, dense=0.0120) * factor(equation, 0.90) * factor(table, 1.10), 9).alias("min_extent"),
    )


#: Density ranges (ink share) and their floors.
RANGES = {"sparse": (0.002, 0.04), "normal": (0.03, 0.14), "dense": (0.10, 0.35), "mixed": (0.02, 0.20)}
FLOORS = {"sparse": 0.0008, "normal": 0.0150, "dense": 0.0600, "mixed": 0.0120}


@query(
    f"""WITH {T.PAGES}, r AS (SELECT * FROM (VALUES {", ".join(f"('{k}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({FLOORS[k]} AS DOUBLE))" for k, (a, b) in RANGES.items())}) AS v(density, lo, hi, floor)),
    p AS (SELECT page_id, (doc_id % 10) / 20.0 AS excluded, doc_id % 2 = 0 AS fig, doc_id % 5 = 0 AS tbl, doc_id % 3 = 0 AS eq, CASE doc_id % 4 WHEN 0 THEN 'sparse' WHEN 1 THEN 'normal' WHEN 2 THEN 'dense' ELSE 'mixed' END AS density FROM doc_pages),
    a AS (SELECT page_id, p.density, greatest(floor, lo * greatest(0.55, 1 - 0.8 * excluded) * CASE WHEN fig THEN 0.75 ELSE 1 END * CASE WHEN tbl THEN 0.85 ELSE 1 END * CASE WHEN eq THEN 0.85 ELSE 1 END) AS lo, hi FROM p JOIN r USING (density))
    SELECT page_id, density, round(lo, 9) AS lo, round(least(1.0, greatest(lo + 1e-6, hi)), 9) AS hi FROM a"""
)
def density_adjust(spark, sf_dir):
    """Density bounds that allow for excluded area, figures, tables and equations, not under a floor."""
    names = list(RANGES)
    rows = T.doc_pages(spark, sf_dir).withColumn("density", F.element_at(F.array(*(F.lit(n) for n in names)), (F.col("doc_id") % 4 + 1).cast("int")))
    at = lambda values: F.element_at(F.create_map(*(F.lit(x) for n in names for x in (n, values[n]))), F.col("density"))
    scale = lambda n, f: F.when(F.col("doc_id") % n == 0, f).otherwise(1.0)
    lo = at({n: r[0] for n, r in RANGES.items()}) * F.greatest(F.lit(0.55), 1 - 0.8 * (F.col("doc_id") % 10) / 20.0) * scale(2, 0.75) * scale(5, 0.85) * scale(3, 0.85)
    lo = F.greatest(at(FLOORS), lo)
    return rows.select("page_id", "density", F.round(lo, 9).alias("lo"), F.round(F.least(F.lit(1.0), F.greatest(lo + 1e-6, at({n: r[1] for n, r in RANGES.items()}))), 9).alias("hi"))


_INK = "least(0.4, n_chars / 40000.0)"


@query(
    f"""WITH {T.PAGES}, r AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{k}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for i, (k, (a, b)) in enumerate(RANGES.items()))}) AS v(i, name, lo, hi)),
    c AS (SELECT doc_id, page_id, i, name, abs({_INK} - (lo + hi) / 2) AS d FROM doc_pages, r WHERE {_INK} BETWEEN greatest(0, lo - 0.005) AND least(1, hi + 0.005)),
    b AS (SELECT doc_id, page_id, name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d, i) AS k FROM c) WHERE k = 1)
    SELECT p.page_id, b.name AS bucket FROM doc_pages p LEFT JOIN b ON p.doc_id = b.doc_id"""
)
def density_bucket(spark, sf_dir):
    """The range that accepts the ink share, with a margin, and whose middle is nearest."""
    ink = F.least(F.lit(0.4), F.col("n_chars") / 40000.0)
    ranges = F.array(*(F.when(ink.between(max(0, a - 0.005), min(1, b + 0.005)), F.struct(F.abs(ink - (a + b) / 2).alias("d"), F.lit(i).alias("i"), F.lit(k).alias("name"))) for i, (k, (a, b)) in enumerate(RANGES.items())))
    return T.doc_pages(spark, sf_dir).select("page_id", F.array_min(ranges)["name"].alias("bucket"))


@query("SELECT DISTINCT p_size, least(100.0, p_size * 2.0) AS pct, CASE WHEN p_size * 2.0 <= 50 THEN floor(24 * p_size * 2.0 / 50) ELSE floor(24 + 40 * (p_size * 2.0 - 50) / 50) END AS gap_px, CAST(12 + floor(84 * p_size * 2.0 / 100) AS BIGINT) AS attempts, round(3 * p_size * 2.0 / 100, 6) AS spacing FROM part WHERE p_size <= 50")
def percent_maps(spark, sf_dir):
    """Interface percents as layout parameters: piecewise gap, search attempts, spacing."""
    pct = F.col("p_size") * 2.0
    gap = F.when(pct <= 50, F.floor(24 * pct / 50)).otherwise(F.floor(24 + 40 * (pct - 50) / 50)).cast("double")
    rows = T.read(spark, sf_dir, "part").where("p_size <= 50").select("p_size").distinct()
    return rows.select("p_size", F.least(F.lit(100.0), pct).alias("pct"), gap.alias("gap_px"), (12 + F.floor(84 * pct / 100)).cast("long").alias("attempts"), F.round(3 * pct / 100, 6).alias("spacing"))


@query()
def block_placement(spark, sf_dir):
    return generation.place(T.doc_pages(spark, sf_dir).select("page_id", "line_count", "doc_id"))


@query()
def occupancy_pack(spark, sf_dir):
    return generation.pack(T.boxes(spark, sf_dir), W, H)


@query()
def line_rebalance(spark, sf_dir):
    return generation.rebalance(T.boxes(spark, sf_dir), target=20)


@query()
def retry_rounds(spark, sf_dir):
    return generation.retry_until_valid(T.doc_pages(spark, sf_dir).select("page_id"), max_tries=4)


@query()
def raster_density(spark, sf_dir):
    return raster.density(T.boxes(spark, sf_dir), W, H)
