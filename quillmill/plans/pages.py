"""Queries on boxes, blocks and settings of pages: clamping, warps, metadata, gates, sizes, percent maps."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbers as N
from ..functions import pages as P
from ..registry import query
from ..sources import tables as T

W, H = T.PAGE_W, T.PAGE_H


@query(
    f"""WITH {T.BOXES}, s AS (SELECT page, pos, x * 2 - 200 AS x, y * 2 - 300 AS y, w - 20 AS w, h - 5 AS h FROM boxes),
    c AS (SELECT *, greatest(0, least({W - 1}, x)) AS x0, greatest(0, least({H - 1}, y)) AS y0 FROM s)
    SELECT page, pos, x0, y0, least({W}, x0 + greatest(1, w)) AS x1, least({H}, y0 + greatest(1, h)) AS y1 FROM c"""
)
def clamped_boxes(spark, sf_dir):
    """Boxes that reach out of the page, or have no width, as corners inside it."""
    x, y, w, h = F.col("x") * 2 - 200, F.col("y") * 2 - 300, F.col("w") - 20, F.col("h") - 5
    corners = P.clamped(x, y, w, h, W, H)
    return T.boxes(spark, sf_dir).select("page", "pos", *(c.cast("long").alias(n) for c, n in zip(corners, ("x0", "y0", "x1", "y1"), strict=True)))


_M = ((1.0, 0.125, -20.0), (-0.0625, 1.0, 10.0), (0.0, 0.0, 1.0))
_CORNERS = ", ".join(f"{_M[r][0]} * ({px}) + {_M[r][1]} * ({py}) + {_M[r][2]} AS {'xy'[r]}{i}" for r in (0, 1) for i, (px, py) in enumerate((("x", "y"), ("x + w", "y"), ("x + w", "y + h"), ("x", "y + h"))))


@query(
    f"""WITH {T.BOXES}, c AS (SELECT page, pos, {_CORNERS} FROM (SELECT page, pos, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h FROM boxes)),
    e AS (SELECT page, pos, least(x0, x1, x2, x3) AS l, greatest(x0, x1, x2, x3) AS r, least(y0, y1, y2, y3) AS t, greatest(y0, y1, y2, y3) AS b FROM c),
    p AS (SELECT page, pos, greatest(0, least({W - 1}, CAST(trunc(l) AS BIGINT))) AS x, greatest(0, least({H - 1}, CAST(trunc(t) AS BIGINT))) AS y, CAST(trunc(r - l) AS BIGINT) AS w, CAST(trunc(b - t) AS BIGINT) AS h FROM e),
    k AS (SELECT page, pos, x, y, greatest(0, least(w, {W} - x)) AS w, greatest(0, least(h, {H} - y)) AS h FROM p)
    SELECT page, row_number() OVER (PARTITION BY page ORDER BY pos) - 1 AS line, x, y, w, h FROM k WHERE w * h >= 25"""
)
def warped_lines(spark, sf_dir):
    """Lines after a geometric transform: boxes around their corners, tiny ones dropped, the others numbered again."""
    number = lambda c: F.col(c).cast("double")
    moved = P.warped(number("x"), number("y"), number("w"), number("h"), _M, W, H)
    rows = T.boxes(spark, sf_dir).select("page", "pos", *(c.cast("long").alias(n) for c, n in zip(moved, ("x", "y", "w", "h"), strict=True))).where("w * h >= 25")
    line = F.row_number().over(Window.partitionBy("page").orderBy("pos")).cast("long") - 1
    return rows.select("page", line.alias("line"), "x", "y", "w", "h")


_COUNTS = {"table_block_count": "table", "figure_block_count": "figure", "equation_block_count": "list", "math_line_count": "caption"}


@query(
    f"""WITH {T.BOXES}, c AS (SELECT page, {", ".join(f"count(*) FILTER (kind = '{k}') AS {n}" for n, k in _COUNTS.items())}, sum(w * h) FILTER (kind IN ('list', 'caption') AND w > 60) AS ink FROM boxes GROUP BY page)
    SELECT page, {", ".join(_COUNTS)}, coalesce(ink, 0)::BIGINT AS mask_math_nonzero, math_line_count > 0 OR equation_block_count > 0 AS has_equation_layout,
    (math_line_count > 0 OR equation_block_count > 0) AND coalesce(ink, 0) > 0 AS has_equation, math_line_count > 0 AND coalesce(ink, 0) > 0 AS has_math_line,
    table_block_count > 0 AS has_table, figure_block_count > 0 AS has_figure FROM c"""
)
def metadata_sync(spark, sf_dir):
    """A page's flags from its blocks, lines and ink: has_equation after rendering, has_math_line after augmentation."""
    rows = T.boxes(spark, sf_dir).groupBy("page")
    ink = F.coalesce(F.sum(F.when(F.col("kind").isin("list", "caption") & (F.col("w") > 60), F.col("w") * F.col("h"))), F.lit(0))
    rows = rows.agg(*(F.count_if(F.col("kind") == k).alias(n) for n, k in _COUNTS.items()), ink.alias("mask_math_nonzero"))
    layout = (F.col("math_line_count") > 0) | (F.col("equation_block_count") > 0)
    inked = F.col("mask_math_nonzero") > 0
    return rows.select(
        "page", *_COUNTS, "mask_math_nonzero", layout.alias("has_equation_layout"), (layout & inked).alias("has_equation"),
        ((F.col("math_line_count") > 0) & inked).alias("has_math_line"), (F.col("table_block_count") > 0).alias("has_table"), (F.col("figure_block_count") > 0).alias("has_figure"),
    )


@query(
    """SELECT doc_id, tb, ta, mb, ma, eq, ta * 1.0 / greatest(1, tb) >= 0.72 AND (NOT eq OR CASE WHEN mb = 0 THEN 1.0 ELSE ma * 1.0 / mb END >= 0.82) AS ok FROM (
      SELECT doc_id, n_chars AS tb, n_chars * (60 + doc_id % 41) // 100 AS ta, doc_id % 5 * 100 AS mb, doc_id % 5 * (70 + doc_id % 31) AS ma, doc_id % 3 = 0 AS eq FROM documents)"""
)
def quality_gate(spark, sf_dir):
    """Whether enough ink is left of each page, from areas before and after."""
    rows = T.read(spark, sf_dir, "documents").selectExpr("doc_id", "n_chars AS tb", "n_chars * (60 + doc_id % 41) div 100 AS ta", "doc_id % 5 * 100 AS mb", "doc_id % 5 * (70 + doc_id % 31) AS ma", "doc_id % 3 = 0 AS eq")
    return rows.withColumn("ok", P.quality_gate(*(F.col(c) for c in ("tb", "ta", "mb", "ma", "eq"))))


@query("SELECT doc_id, profile, dpi, coalesce(profile = 'dpi200' AND dpi <> 200 OR coalesce(profile, 'dpi300') = 'dpi300' AND dpi <> 300, false) AS mismatch FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'dpi200' WHEN 1 THEN 'dpi300' WHEN 2 THEN 'lowres' END AS profile, 100 * (1 + doc_id % 3) AS dpi FROM documents)")
def scale_dpi_match(spark, sf_dir):
    profile = F.when(F.col("doc_id") % 4 == 0, "dpi200").when(F.col("doc_id") % 4 == 1, "dpi300").when(F.col("doc_id") % 4 == 2, "lowres")
    rows = T.read(spark, sf_dir, "documents").select("doc_id", profile.alias("profile"), (100 * (1 + F.col("doc_id") % 3)).alias("dpi"))
    return rows.withColumn("mismatch", P.scale_mismatch(F.col("profile"), F.col("dpi")))


@query(f"WITH {T.BOXES} SELECT page, pos, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN kind = 'title' THEN 0 WHEN kind IN ('table', 'figure', 'equation') THEN 1 ELSE 2 END, y, x, pos) - 1 AS global_order FROM boxes")
def block_priority_order(spark, sf_dir):
    """Blocks of a page by priority, then from top and left, numbered from 0."""
    order = Window.partitionBy("page").orderBy(P.priority(F.col("kind")), "y", "x", "pos")
    return T.boxes(spark, sf_dir).select("page", "pos", (F.row_number().over(order).cast("long") - 1).alias("global_order"))


def _density_sql(name: str) -> str:
    a, b, c = P.DENSITY_AT[name]
    return f"CASE WHEN p <= 50 THEN {a} + ({b} - {a}) * (p / 50) ELSE {b} + ({c} - {b}) * ((p - 50) / 50) END"


_TOTAL = " + ".join(_density_sql(k) for k in P.DENSITY_AT)


@query(f"SELECT p_partkey, {', '.join(f'round(CAST({_density_sql(k)} AS DOUBLE) / CAST({_TOTAL} AS DOUBLE), 4) AS {k}' for k in P.DENSITY_AT)} FROM (SELECT p_partkey, CAST(greatest(0, least(100, p_size * 3 - 10)) AS DOUBLE) AS p FROM part)")
def density_percent_shares(spark, sf_dir):
    found = P.density_shares((F.col("p_size") * 3 - 10).cast("string"))
    return T.read(spark, sf_dir, "part").select("p_partkey", *(c.alias(k) for k, c in found.items()))


_CLIPPED = "greatest(0.0, least(100.0, CAST({} AS DOUBLE)))"


@query(
    f"""SELECT p_partkey, round(CASE WHEN s <= 0 THEN 60.0 ELSE a / s * 100 END, 4) AS text, round(CASE WHEN s <= 0 THEN 25.0 ELSE b / s * 100 END, 4) AS "table", round(CASE WHEN s <= 0 THEN 15.0 ELSE c / s * 100 END, 4) AS latex,
    CASE WHEN n IN ('readable', 'large', 'easy') THEN 14 WHEN n IN ('hard', 'dense') THEN 7 WHEN n IN ('compact', 'small') THEN 8 ELSE 10 END AS min_px,
    CASE WHEN n IN ('readable', 'large', 'easy') THEN 22 WHEN n IN ('hard', 'dense') THEN 13 WHEN n IN ('compact', 'small') THEN 14 ELSE 18 END AS max_px
    FROM (SELECT *, a + b + c AS s FROM (SELECT p_partkey, {_CLIPPED.format("p_size % 11 * 12 - 30")} AS a, {_CLIPPED.format("p_size % 7 * 10 - 20")} AS b, {_CLIPPED.format("p_size % 5 * 30 - 30")} AS c,
      CASE p_size % 5 WHEN 0 THEN 'readable' WHEN 1 THEN 'hard' WHEN 2 THEN 'small' WHEN 3 THEN 'other' END AS n FROM part))"""
)
def content_mix_and_fonts(spark, sf_dir):
    """Normalised content percentages, and the range of a named font profile."""
    size = F.col("p_size")
    mix = P.content_mix(*(c.cast("string") for c in (size % 11 * 12 - 30, size % 7 * 10 - 20, size % 5 * 30 - 30)))
    profile = F.when(size % 5 == 0, " Readable ").when(size % 5 == 1, "HARD").when(size % 5 == 2, "small").when(size % 5 == 3, "other")
    return T.read(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for c, n in zip(mix, ("text", "table", "latex"), strict=True)), P.font_range(profile).alias("r")).select("p_partkey", "text", "table", "latex", "r.*")


_U, _V = (N.uniform_sql(s, "doc_id") for s in ("points", "points-2"))


@query(
    f"""SELECT doc_id, round(pt, 6) AS points, greatest(10, CASE doc_id % 3 WHEN 0 THEN CAST(trunc(base * CAST(0.92 AS DOUBLE)) AS INTEGER) WHEN 1 THEN CAST(trunc(base * CAST(0.96 AS DOUBLE)) AS INTEGER) ELSE base END) AS line_height FROM (
      SELECT doc_id, pt, CAST(trunc(CAST(trunc(pt * (300 / 72.0::DOUBLE)) AS INTEGER) * CAST(CASE doc_id % 4 WHEN 0 THEN 1.15 WHEN 1 THEN 1.80 ELSE 1.40 END AS DOUBLE)) AS INTEGER) AS base FROM (
        SELECT doc_id, CAST(CASE WHEN u < 0.05 THEN 2.0 + v * 6 WHEN u < 0.70 THEN 9.0 + floor(v * 6) * 0.5 WHEN u < 0.90 THEN 12.0 + v * 8 ELSE 21.0 + v * 27 END AS DOUBLE) AS pt FROM (SELECT doc_id, {_U} AS u, {_V} AS v FROM documents)))"""
)
def line_heights(spark, sf_dir):
    """A seeded font size for each document and the height of its lines at 300 dpi."""
    i = F.col("doc_id")
    rows = T.read(spark, sf_dir, "documents").select("doc_id", P.base_points(N.uniform("points", i), N.uniform("points-2", i)).alias("pt"))
    density = F.when(i % 4 == 0, "dense").when(i % 4 == 1, "sparse").otherwise("normal")
    family = F.when(i % 3 == 0, "notes").when(i % 3 == 1, "worksheet").otherwise("report")
    return rows.select("doc_id", F.round("pt", 6).alias("points"), P.line_height(F.col("pt"), F.lit(300), density, family).alias("line_height"))


@query(f"SELECT doc_id, CAST(CASE doc_id % 3 WHEN 0 THEN 120 + floor(u * 51) WHEN 1 THEN 60 + floor(u * 60) ELSE floor(u * 60) END AS INTEGER) AS gray FROM (SELECT doc_id, {N.uniform_sql('gray', 'doc_id')} AS u FROM documents)")
def contrast_grays(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 3 == 0, "low").when(F.col("doc_id") % 3 == 1, "medium").otherwise("high")
    return T.read(spark, sf_dir, "documents").select("doc_id", P.contrast_gray(kind, N.uniform("gray", F.col("doc_id"))).alias("gray"))


@query(
    """SELECT l_orderkey AS page, l_linenumber AS line, CASE WHEN fill <= 0.000001 THEN greatest(1, w) ELSE greatest(8, CAST(round(greatest(1, w) * greatest(lo, least(hi, sqrt(0.35 / greatest(0.000001, fill))))) AS BIGINT)) END AS w, count(*) AS n FROM (
      SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity) AS BIGINT) * 3 AS w, l_partkey % 10 / CAST(10 AS DOUBLE) AS fill, CASE l_suppkey % 4 WHEN 0 THEN 0.72 WHEN 1 THEN 0.88 WHEN 2 THEN 0.96 ELSE 0.80 END AS lo, CASE l_suppkey % 4 WHEN 0 THEN 1.06 WHEN 1 THEN 1.34 WHEN 2 THEN 1.58 ELSE 1.20 END AS hi FROM lineitem) GROUP BY 1, 2, 3"""
)
def scaled_blocks(spark, sf_dir):
    """Widths on the way to a fill of 0.35, within the limits of each whitespace strategy."""
    strategy = F.when(F.col("l_suppkey") % 4 == 0, "airy").when(F.col("l_suppkey") % 4 == 1, "Compact").when(F.col("l_suppkey") % 4 == 2, " packed").otherwise("other")
    width = P.scaled_side(F.floor("l_quantity").cast("long") * 3, (F.col("l_partkey") % 10) / 10, F.lit(0.35), strategy)
    rows = T.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), width.alias("w"))
    return rows.groupBy("page", "line", "w").agg(F.count("*").alias("n"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS ops FROM conversations WHERE role <> '' GROUP BY conv_id")
def augment_ops(spark, sf_dir):
    """The operations of a trace in order, joined."""
    rows = T.conv_lines(spark, sf_dir).groupBy(F.col("page").alias("conv_id")).agg(F.array_sort(F.collect_list(F.struct("ord", "role"))).alias("t"))
    return rows.select("conv_id", P.flattened(F.transform("t", lambda x: x["role"])).alias("ops")).where("ops <> ''")


@query("""SELECT source, '{' || string_agg('"' || lang || '":' || n, ',' ORDER BY lang) || '}' AS histogram FROM (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2) GROUP BY source""")
def histogram_json(spark, sf_dir):
    """Counts of languages of each source as JSON with sorted keys."""
    rows = T.read(spark, sf_dir, "documents").where("lang is not null").groupBy("source", "lang").agg(F.count("*").alias("n"))
    rows = rows.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("lang", "n"))).alias("h"))
    return rows.select("source", F.to_json(F.map_from_entries("h")).alias("histogram"))


@query("SELECT k AS name, round(coalesce(n, 0) / (SELECT count(*) FROM documents WHERE lang IS NOT NULL), 6) AS share FROM (VALUES ('de'), ('en'), ('xx')) AS v(k) LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) ON k = lang")
def shares_of_keys(spark, sf_dir):
    """A distribution normalised over all its values and then asked for some keys; missing ones are 0."""
    rows = T.read(spark, sf_dir, "documents").where("lang is not null").groupBy("lang").agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n").alias("total"))  # one row
    keys = spark.createDataFrame([("de",), ("en",), ("xx",)], "name string")
    found = keys.join(rows, F.col("name") == F.col("lang"), "left").crossJoin(F.broadcast(total))
    return found.select("name", F.round(F.coalesce("n", F.lit(0)) / F.col("total"), 6).alias("share"))


_DOUBLED = r"\\frac{a}{b} + \\sqrt{x} \\unknown \alpha \\mid"


@query(rf"""SELECT s_suppkey, replace(replace(replace(s_name || '{_DOUBLED}', '\\frac', '\frac'), '\\sqrt', '\sqrt'), '\\mid', '\mid') AS expr FROM supplier""")
def latex_collapse(spark, sf_dir):
    return T.read(spark, sf_dir, "supplier").select("s_suppkey", P.collapsed(F.concat("s_name", F.lit(_DOUBLED))).alias("expr"))
