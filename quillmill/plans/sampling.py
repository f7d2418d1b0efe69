"""Bank preparation, splits and deterministic sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbers as N
from ..operators import sampling as S
from ..registry import query
from ..sources import tables as T

_SPLIT = f"""{T.PAGES}, pages1 AS (SELECT DISTINCT page_id FROM doc_pages),
splits AS (
  SELECT page_id, CASE WHEN i / n < 0.8 THEN 'train' WHEN i / n < 0.8 + 0.1 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT page_id, CAST(row_number() OVER (ORDER BY page_id) - 1 AS DOUBLE) AS i, CAST(count(*) OVER () AS DOUBLE) AS n FROM pages1))"""


def _splits(spark, sf_dir):
    return S.dealt_splits(T.read(spark, sf_dir, "documents").select(N.padded(F.col("doc_id")).alias("page_id")), "page_id")


@query(f"WITH {_SPLIT} SELECT page_id, split FROM splits")
def split_assignment(spark, sf_dir):
    return _splits(spark, sf_dir)


@query(f"WITH {_SPLIT} SELECT split, count(*) AS pages FROM splits GROUP BY split")
def split_counts(spark, sf_dir):
    return _splits(spark, sf_dir).groupBy("split").agg(F.count("*").alias("pages"))


@query(f"WITH {T.BANK}, m AS (SELECT *, lang = 'Brand#13' AS ok FROM bank), a AS (SELECT *, bool_or(ok) OVER (PARTITION BY script) AS any_ok FROM m) SELECT item, script, lang FROM a WHERE ok OR NOT any_ok")
def filter_fallthrough(spark, sf_dir):
    return S.fall_through(T.bank(spark, sf_dir), F.col("lang") == "Brand#13", ["script"]).select("item", "script", "lang")


@query(
    f"""WITH {T.BANK}, a AS (SELECT *, alphabet = 'Brand#2' AS ok FROM bank), a1 AS (SELECT item, lang, script FROM (SELECT *, bool_or(ok) OVER () AS any_ok FROM a) WHERE ok OR NOT any_ok),
    b AS (SELECT * FROM (SELECT *, bool_or(lang = 'Brand#99') OVER () AS any_ok FROM a1) WHERE lang = 'Brand#99' OR NOT any_ok),
    c AS (SELECT item, lang, script, bool_or(script = (SELECT min(script) FROM b)) OVER () AS any_ok2 FROM b)
    SELECT item, lang, script FROM c WHERE script = (SELECT min(script) FROM b) OR NOT any_ok2"""
)
def policy_narrowing(spark, sf_dir):
    """Each step keeps the matching rows unless there are none: existence is one small aggregate, not a global window."""
    rows = T.bank(spark, sf_dir)
    for name, value in (("alphabet", "Brand#2"), ("lang", "Brand#99")):
        found = rows.agg(F.coalesce(F.bool_or(F.col(name) == value), F.lit(False)).alias("_found"))  # one row
        rows = rows.crossJoin(F.broadcast(found)).where((F.col(name) == value) | ~F.col("_found")).drop("_found")
    least = rows.agg(F.min("script").alias("_least"))  # one row; the least script always matches
    rows = rows.crossJoin(F.broadcast(least)).where(F.col("script") == F.col("_least"))
    return rows.select("item", "lang", "script")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY trim(text), lower(lang)")
def bank_dedupe(spark, sf_dir):
    """Keep-first by content; the text itself is hashed before the shuffle (128 bits), never moved."""
    docs = T.read(spark, sf_dir, "documents").select("doc_id", F.md5(F.trim("text")).alias("k"), F.lower("lang").alias("l"))
    return docs.groupBy("k", "l").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query(f"WITH {T.BANK} SELECT kind, value FROM (SELECT 'lang' AS kind, lower(trim(lang)) AS value FROM bank UNION SELECT 'script', lower(trim(script)) FROM bank UNION SELECT 'alphabet', lower(trim(alphabet)) FROM bank) WHERE value <> ''")
def label_registry(spark, sf_dir):
    from ..operators.analytics import unpivoted_distinct

    return unpivoted_distinct(T.bank(spark, sf_dir), ["lang", "script", "alphabet"])


@query(f"WITH {T.BANK} SELECT count(*) AS items, count(DISTINCT text) AS texts, count(DISTINCT lang) AS langs, count(DISTINCT (text, lang, script)) AS unique_items FROM bank")
def bank_counts(spark, sf_dir):
    return T.bank(spark, sf_dir).agg(F.count("*").alias("items"), F.countDistinct("text").alias("texts"), F.countDistinct("lang").alias("langs"), F.countDistinct("text", "lang", "script").alias("unique_items"))


_RAW = [(1, "1", "2.5"), (2, " No ", "-3"), (3, None, ""), (4, "off", "bad"), (5, "", None), (6, "TRUE", "1e2"), (7, "false", "0")]
_RAW_SQL = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in _RAW)


@query(
    f"""SELECT id, coalesce(lower(trim(enabled)) NOT IN ('0', 'false', 'no', 'off', ''), true) AS enabled,
    greatest(0.0, coalesce(try_cast(weight AS DOUBLE), 1.0)) AS weight FROM (VALUES {_RAW_SQL}) AS t(id, enabled, weight)"""
)
def enabled_weight_parse(spark, sf_dir):
    raw = spark.createDataFrame(_RAW, "id int, enabled string, weight string")
    return raw.select("id", N.to_enabled(F.col("enabled")).alias("enabled"), N.to_weight(F.col("weight")).alias("weight"))


_STRETCH = f"""{T.BANK}, run AS (SELECT item, script, sum(weight) OVER (PARTITION BY script ORDER BY item) AS hi, weight, sum(weight) OVER (PARTITION BY script) AS total FROM bank)"""


@query(
    f"""WITH {_STRETCH}, u AS (SELECT c_custkey, {N.uniform_sql("pick", "c_custkey")} AS u FROM customer),
    kinds AS (SELECT script, row_number() OVER (ORDER BY script) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT script FROM bank))
    SELECT c_custkey, script, min(item) AS item FROM u JOIN kinds ON c_custkey % n = k JOIN run USING (script) WHERE u * total < hi GROUP BY 1, 2"""
)
def weighted_pick(spark, sf_dir):
    """Each customer draws one item of its script by weight: the first whose running weight is above the draw."""
    pool = S.cumulative(T.bank(spark, sf_dir), F.col("weight"), ["item"], ["script"])
    kinds = T.bank(spark, sf_dir).select("script").distinct().withColumns({"k": F.row_number().over(Window.orderBy(F.asc_nulls_last("script"))) - 1})  # few distinct scripts
    draws = T.read(spark, sf_dir, "customer").select("c_custkey", N.uniform("pick", F.col("c_custkey")).alias("u"))
    draws = draws.crossJoin(F.broadcast(kinds.agg(F.count("*").alias("n")))).withColumn("k", F.col("c_custkey") % F.when(F.col("n") > 0, F.col("n")))
    draws = draws.join(kinds, "k").select("c_custkey", "script", "u")
    return S.first_above(draws, pool, "item", "script").select("c_custkey", "script", "item")


@query(
    f"""WITH {T.BANK}, k AS (SELECT item, script, row_number() OVER (PARTITION BY script ORDER BY -ln(greatest({N.uniform_sql("wor", "item")}, 1e-300)) / weight, item) AS pick FROM bank WHERE weight > 0)
    SELECT item, script, pick FROM k WHERE pick <= 3"""
)
def weighted_sample_wor(spark, sf_dir):
    pool = T.bank(spark, sf_dir)
    drawn = S.draw_without_replacement(pool, F.col("weight"), N.uniform("wor", F.col("item")), 3, ["script"], ["item"])
    return drawn.select("item", "script", F.col("pick").cast("long").alias("pick"))


@query(f"WITH {T.BANK}, {T.DOC_LINES}, pool AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS i, count(*) OVER () AS n FROM bank) SELECT doc_id, line, item FROM doc_lines JOIN pool ON (doc_id * 31 + line) % n = i")
def sequential_cursor(spark, sf_dir):
    """Line k takes pool item k mod n; the pool's positions come from sorted ids."""
    pool = T.bank(spark, sf_dir).agg(F.array_sort(F.collect_list("item")).alias("items"))  # the bank is one bounded array
    at = ((F.col("doc_id") * 31 + F.col("line")) % F.size("items")).cast("int")
    return T.doc_lines(spark, sf_dir).crossJoin(F.broadcast(pool)).select("doc_id", "line", F.get("items", at).alias("item"))


@query(f"WITH {T.DOC_LINES}, u AS (SELECT doc_id, line, {N.uniform_sql('mode', 'doc_id', 'line')} AS u FROM doc_lines) SELECT doc_id, line, CASE WHEN u < 0.1 THEN 'chars' WHEN u < 0.1 + 0.3 THEN 'words' ELSE 'sentences' END AS mode FROM u")
def text_mode_pick(spark, sf_dir):
    u = N.uniform("mode", F.col("doc_id"), F.col("line"))
    return T.doc_lines(spark, sf_dir).select("doc_id", "line", S.threshold_pick(u, [("chars", 0.1), ("words", 0.3), ("sentences", 0.6)]).alias("mode"))


_OPS = [("gaussian", 0.30), ("speckle", 0.35), ("scratches", 0.22), ("blobs", 0.26), ("illumination", 0.24), ("banding", 0.20), ("salt", 0.12)]


@query(
    "WITH p AS (SELECT doc_id, "
    + ", ".join(f"{N.uniform_sql(op, 'doc_id')} < {p} AS {op}" for op, p in _OPS)
    + f", {N.uniform_sql('edge', 'doc_id')} < 0.25 AS edge, {N.uniform_sql('elastic', 'doc_id')} < 0.20 AS elastic, {N.uniform_sql('capture', 'doc_id')} < 0.30 AS capture FROM documents) SELECT doc_id, "
    + ", ".join(op for op, _ in _OPS)
    + ", edge, elastic AND NOT edge AS elastic, capture, NOT capture AS geometry FROM p"
)
def augment_plan(spark, sf_dir):
    """Independent draws for each operation; edge erasure excludes elastic, capture excludes geometry."""
    draw = lambda op, p: N.uniform(op, F.col("doc_id")) < p
    edge, capture = draw("edge", 0.25), draw("capture", 0.30)
    return T.read(spark, sf_dir, "documents").select(
        "doc_id", *(draw(op, p).alias(op) for op, p in _OPS), edge.alias("edge"), (draw("elastic", 0.20) & ~edge).alias("elastic"), capture.alias("capture"), (~capture).alias("geometry")
    )


@query(
    f"WITH u AS (SELECT doc_id, {N.uniform_sql('family', 'doc_id')} AS a, {N.uniform_sql('columns', 'doc_id')} AS b FROM documents) SELECT doc_id, CASE WHEN a < 0.34 THEN 'book' WHEN a < 0.34 + 0.20 THEN 'academic' WHEN a < 0.34 + 0.20 + 0.18 THEN 'report' WHEN a < 0.34 + 0.20 + 0.18 + 0.14 THEN 'worksheet' ELSE 'notes' END AS family, CASE WHEN a < 0.34 + 0.20 AND a >= 0.34 THEN CASE WHEN b < 0.7 THEN 2 ELSE 1 END ELSE 1 END AS columns FROM u"
)
def page_traits(spark, sf_dir):
    family = S.threshold_pick(N.uniform("family", F.col("doc_id")), [("book", 0.34), ("academic", 0.20), ("report", 0.18), ("worksheet", 0.14), ("notes", 0.14)])
    rows = T.read(spark, sf_dir, "documents").select("doc_id", family.alias("family"))
    return rows.withColumn("columns", F.when(F.col("family") == "academic", F.when(N.uniform("columns", F.col("doc_id")) < 0.7, 2).otherwise(1)).otherwise(1))


@query(
    """WITH g AS (SELECT o_orderkey, 2 + o_orderkey % 4 AS n_rows, 2 + o_custkey % 3 AS n_cols FROM orders),
    c AS (SELECT *, unnest(range(n_rows)) AS r FROM g), d AS (SELECT *, unnest(range(n_cols)) AS c FROM c)
    SELECT o_orderkey, r, c, r * 240 // n_rows AS y, c * 360 // n_cols AS x, (r + 1) * 240 // n_rows - r * 240 // n_rows AS h, (c + 1) * 360 // n_cols - c * 360 // n_cols AS w FROM d"""
)
def table_grid_uniform(spark, sf_dir):
    """Cells of even tables: edges are rounded running sums, so that the last edge is exact."""
    g = T.read(spark, sf_dir, "orders").select("o_orderkey", (2 + F.col("o_orderkey") % 4).alias("n_rows"), (2 + F.col("o_custkey") % 3).alias("n_cols"))
    g = g.withColumn("r", F.explode(F.expr("sequence(0L, n_rows - 1)"))).withColumn("c", F.explode(F.expr("sequence(0L, n_cols - 1)")))
    return g.selectExpr("o_orderkey", "r", "c", "r * 240 div n_rows AS y", "c * 360 div n_cols AS x", "(r + 1) * 240 div n_rows - r * 240 div n_rows AS h", "(c + 1) * 360 div n_cols - c * 360 div n_cols AS w")
