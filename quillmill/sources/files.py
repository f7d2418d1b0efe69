"""File sources: content banks, annotations, split lists, region templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import clamp, to_enabled, to_weight

_ITEM = ("lang", "script", "alphabet_profile", "weight", "category", "enabled")


def _items(spark: SparkSession, paths: str | list[str], text: str) -> DataFrame:
    # All columns are read by name as strings and coerced below: bad values become defaults, never failures.
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(paths)
    names = {c.lstrip("﻿").strip(): c for c in raw.columns}
    if text not in names:
        raise ValueError(f"content bank lacks the column {text}")
    col = lambda n: F.col(f"`{names[n]}`") if n in names else F.lit(None).cast("string")
    known = lambda n, d: F.coalesce(F.nullif(F.trim(col(n)), F.lit("")), F.lit(d)).alias(n)
    rows = raw.withColumn("_from", F.col("_metadata.file_name"))
    rows = rows.where((F.coalesce(F.trim(col(text)), F.lit("")) != "") & to_enabled(col("enabled")))
    return rows.select(F.trim(col(text)).alias("text"), known("lang", "unknown"), known("script", "unknown"), known("alphabet_profile", "unknown"), to_weight(col("weight")).alias("weight"), known("category", "general"), F.col("_from").alias("source"))


def read_words(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Bank words: blank and disabled rows go, bad weights are 1, labels have defaults; ``source`` is the file's name."""
    return _items(spark, paths, "word")


def read_sentences(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Bank sentences, by the same rules; they have no source and are not deduplicated."""
    return _items(spark, paths, "text").drop("source")


BOX = T.ArrayType(T.IntegerType())
ANNOTATION = T.StructType(
    [
        T.StructField("page_id", T.StringType()),
        T.StructField("size", T.StructType([T.StructField(n, T.IntegerType()) for n in ("w", "h", "dpi")])),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
        T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("block_id", T.IntegerType()), T.StructField("block_type", T.StringType()), T.StructField("bbox", BOX)]))),
        T.StructField("lines", T.ArrayType(T.StructType([T.StructField("line_id", T.IntegerType()), T.StructField("block_id", T.IntegerType()), T.StructField("line_type", T.StringType()), T.StructField("global_line_order", T.IntegerType()), T.StructField("bbox", BOX), T.StructField("gt_text", T.StringType()), T.StructField("gt_script", T.StringType())]))),
        T.StructField("_corrupt", T.StringType()),
    ]
)


def read_annotations(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each annotation file; a file that can't be parsed is a row with ``error`` and its name as page_id."""
    reader = spark.read.schema(ANNOTATION).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    rows = reader.json(f"{folder}/*.json").withColumn("_file", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))
    return rows.withColumn("page_id", F.coalesce("page_id", "_file")).withColumn("error", F.when(F.col("_corrupt").isNotNull(), "unreadable")).drop("_corrupt", "_file")


def annotation_features(annotations: DataFrame) -> DataFrame:
    """Flat feature rows: sizes, counts, area ratios, dominant script (first seen at a tie); error rows keep only id and error."""
    area = F.greatest(F.lit(1), F.col("size.w") * F.col("size.h"))
    count = lambda kind: F.size(F.filter("blocks", lambda b: b["block_type"] == kind))
    box_area = lambda b: F.when(F.size(b) >= 4, F.greatest(F.lit(0), F.get(b, F.lit(2))) * F.greatest(F.lit(0), F.get(b, F.lit(3)))).otherwise(0)
    share = lambda kind: F.aggregate(F.filter("blocks", lambda b: b["block_type"] == kind), F.lit(0).cast("long"), lambda s, b: s + box_area(b["bbox"])) / area
    scripts = F.filter(F.transform("lines", lambda x: x["gt_script"]), lambda s: s.isNotNull())
    counts = F.transform(F.array_distinct(scripts), lambda s: F.struct(F.size(F.filter(scripts, lambda t: t == s)).alias("n"), (-F.array_position(scripts, s)).alias("first"), s.alias("script")))
    ok = F.col("error").isNull()
    value = lambda c: F.when(ok, c)
    return annotations.select(
        "page_id", value(F.col("size.w")).alias("page_w"), value(F.col("size.h")).alias("page_h"), value(F.size("lines")).alias("line_count"), value(F.size("blocks")).alias("block_count"),
        value(count("table")).alias("table_block_count"), value(count("figure")).alias("figure_block_count"), value(F.round(share("table"), 6)).alias("table_area_ratio"), value(F.round(share("figure"), 6)).alias("figure_area_ratio"),
        value(F.coalesce(F.array_max(counts)["script"], F.lit("unknown"))).alias("dominant_script"), "error",
    )


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_splits(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, split of train.txt, val.txt and test.txt; blank lines go, a missing file has no rows."""
    out = spark.createDataFrame([], "page_id string, split string")
    for name in ("train", "val", "test"):
        if _exists(spark, f"{folder}/{name}.txt"):
            rows = spark.read.text(f"{folder}/{name}.txt").select(F.trim("value").alias("page_id"), F.lit(name).alias("split"))
            out = out.unionByName(rows.where("page_id <> ''"))
    return out


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Region templates: the separator (``;``, ``,`` or tab) is the header's most frequent; a leading ``sep=`` line goes.

    x, y, w and h are clamped to 0..1, bad values are 0.
    """
    lines = spark.read.text(path).limit(2).collect()
    head = lines[0].value if lines else ""
    skip = head.lower().startswith("sep=")
    header = lines[1].value if skip and len(lines) > 1 else head
    separator = max(";,\t", key=header.count)
    raw = spark.read.text(path).where(~F.lower("value").startswith("sep=") & (F.col("value") != header))
    names = [n.strip().lstrip("﻿") for n in header.split(separator)]
    cells = F.split("value", "\\" + separator if separator == ";" else separator, -1)
    rows = raw.select(*(F.trim(F.get(cells, F.lit(i))).alias(n) for i, n in enumerate(names)))
    return rows.select(*(clamp(F.coalesce(F.col(n).try_cast("double"), F.lit(0.0)), 0.0, 1.0).alias(n) if n in ("x", "y", "w", "h") else F.col(n) for n in names))
