"""Views of the given tables in the shapes that document operators work on, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbers as N

#: Pixels of the page that boxes lie on.
PAGE_W, PAGE_H = 600, 800
KINDS = ("title", "paragraph", "list", "table", "figure", "caption")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BOX_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

BOXES = f"""boxes AS (
  SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_BOX_ORDER)}) AS pos,
         l_partkey % 500 AS x, (l_partkey * 7 + l_suppkey * 13) % 700 AS y,
         10 + CAST(floor(l_quantity) AS BIGINT) * 3 AS w, 3 + l_suppkey % 40 AS h,
         CASE l_partkey % 6 WHEN 0 THEN 'title' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'list' WHEN 3 THEN 'table' WHEN 4 THEN 'figure' ELSE 'caption' END AS kind
  FROM lineitem)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, pos, x, y, w, h, kind: the lines of an order as boxes of a page."""
    rows = read(spark, sf_dir, "lineitem")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_BOX_ORDER)).cast("long")
    kind = F.element_at(F.array(*(F.lit(k) for k in KINDS)), (F.col("l_partkey") % 6 + 1).cast("int"))
    return rows.select(
        F.col("l_orderkey").alias("page"), pos.alias("pos"), (F.col("l_partkey") % 500).alias("x"), ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 13) % 700).alias("y"),
        (10 + F.floor("l_quantity").cast("long") * 3).alias("w"), (3 + F.col("l_suppkey") % 40).alias("h"), kind.alias("kind"),
    )


DOC_LINES = """doc_lines AS (
  SELECT doc_id, lang, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS text FROM documents)"""


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, line (from 0), text."""
    return read(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("line", "text")).withColumn("line", F.col("line").cast("long"))


CONV_LINES = "conv_lines AS (SELECT conv_id AS page, turn AS ord, role, text, length(text) AS y FROM conversations)"


def conv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, ord, role, text, y: the turns of a conversation as lines of a page."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("ord"), "role", "text", F.length("text").cast("long").alias("y"))


HTML_BLOCKS = """html_raw AS (
  SELECT page_id, string_split_regex(html, '<(h1|p|li|footer)[^>]*>') AS parts, regexp_extract_all(html, '<(h1|p|li|footer)[^>]*>', 1) AS tags FROM pages),
html_blocks AS (
  SELECT page_id, unnest(range(len(tags))) AS pos,
         unnest(list_transform(tags, lambda x: CASE x WHEN 'h1' THEN 'title' WHEN 'p' THEN 'paragraph' WHEN 'li' THEN 'list' ELSE 'footer' END)) AS kind
  FROM html_raw)"""


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, pos, kind: the block tags of a raw page in order."""
    tags = F.regexp_extract_all("html", F.lit("<(h1|p|li|footer)[^>]*>"), F.lit(1))
    kind = F.when(F.col("tag") == "h1", "title").when(F.col("tag") == "p", "paragraph").when(F.col("tag") == "li", "list").otherwise("footer")
    return read(spark, sf_dir, "pages").select("page_id", F.posexplode(tags).alias("pos", "tag")).select("page_id", F.col("pos").cast("long").alias("pos"), kind.alias("kind"))


BANK = """bank AS (
  SELECT p_partkey AS item, p_name AS text, p_brand AS lang, p_type AS script, substr(p_brand, 1, 7) AS alphabet, p_retailprice AS weight FROM part)"""


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, text, lang, script, alphabet, weight: parts as a content bank."""
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item"), F.col("p_name").alias("text"), F.col("p_brand").alias("lang"), F.col("p_type").alias("script"),
        F.substring("p_brand", 1, 7).alias("alphabet"), F.col("p_retailprice").alias("weight"),
    )


PAGES = """doc_pages AS (
  SELECT lpad(CAST(d.doc_id AS VARCHAR), CAST(greatest(6, length(CAST(d.doc_id AS VARCHAR))) AS INTEGER), '0') AS page_id, d.doc_id, d.lang, d.source, d.n_chars, len(string_split(d.text, chr(10))) AS line_count, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id (six digits), doc_id, lang, source, n_chars, line_count, quality, toxic."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.size(F.split("text", "\n", -1)).cast("long").alias("line_count"))
    rows = docs.join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select(N.padded(F.col("doc_id")).alias("page_id"), "doc_id", "lang", "source", "n_chars", "line_count", "quality", "toxic")
