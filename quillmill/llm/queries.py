"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fingerprint, language, licenses, lines, mixing, neardup, quality, secretscan, sql, toxicity
from ._sample import remainder
from ._store import shared_dir


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.fit(docs, _read(spark, sf_dir, "labels"))
    held = (remainder(F.col("doc_id"), 5) == 0).alias("held_out")
    return quality.score(docs, model, threshold=0.3).select("doc_id", held, "score", "predicted")


def op2_toxicity_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    held = (remainder(F.col("doc_id"), 3) == 1).alias("held_out")
    spans = F.concat_ws(",", F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"]))).alias("offending")
    return toxicity.score(docs, model, threshold=0.7).select("doc_id", held, "score", "predicted", "n_sentences", spans)


def op3_scaled_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare(_read(spark, sf_dir, "documents"))


def op4_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = licenses.scan(docs, licenses.fit(docs))
    families = F.array_sort(F.array_distinct(F.transform("findings", lambda x: x["family"])))
    spans = F.concat_ws(",", F.transform("findings", lambda x: F.concat_ws(":", x["family"], x["start"], x["end"])))
    return found.select(
        "doc_id", "n_paragraphs", F.size("findings").cast("long").alias("n_findings"), F.concat_ws(",", families).alias("families"), spans.alias("spans")
    )


def op5_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), window=10)
    digest = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return marks.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"))


def op6_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One ledger for each input folder: blobs and rules that an earlier run has scanned are not scanned again.
    ledger = f"{shared_dir(spark)}/quillmill/secrets-ledger-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    paths, rows = secretscan.scan(_read(spark, sf_dir, "documents"), ledger)
    found = secretscan.join_paths(paths, rows)
    listed = lambda of: F.concat_ws(",", F.transform(of, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    base = F.filter("found", lambda x: x["kind"].isin(*secretscan.BASE))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in secretscan.BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    return lines.dedup(docs.select("doc_id", "text", n_lines.alias("n_lines"))).select(
        "doc_id", "n_lines", F.size("_removed").cast("long").alias("n_removed"), F.concat_ws(",", F.col("_removed").cast("array<string>")).alias("removed"),
        F.sha2("text", 256).alias("kept_sha256"), F.col("_emptied").alias("emptied"),
    )


def op8_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = neardup.group(_read(spark, sf_dir, "documents"), words=3, percent=85).drop("key")
    return groups.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op9_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held = (remainder(F.col("doc_id"), 4) == 2).alias("held_out")
    return language.predict(docs, language.learn(docs)).select("doc_id", held, "lang_pred", "score")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return mixing.mix(docs, F.array("source")).select(
        "doc_id", "size", F.col("source_sizes")[0].alias("source_size"), F.col("source_targets")[0].alias("target"), "taken"
    )


QUERIES = {f.__name__: f for f in (op1_quality_trees, op2_toxicity_bags, op3_scaled_sketches, op4_license_paragraphs, op5_positional_index, op6_blob_ledger, op7_fuzzy_lines, op8_minhash_groups, op9_rank_order_language, op10_source_mixing)}
#: The others have no SQL: fitted models, sketches, SimHash and seeded selection. Tests compare them with brute force.
SQL = {"op5_positional_index": sql.DECONTAMINATION, "op6_blob_ledger": sql.SECRETS, "op8_minhash_groups": sql.GROUPS}
