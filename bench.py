"""Times the headline queries on one machine; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

#: One query of each kind of work: scans, aggregations, joins, windows, exploded text, sampling, exports.
HEADLINE = (
    "flagship_language_profile", "numeric_summary", "categorical_summary", "joint_coverage_top20", "target_vs_observed",
    "split_assignment", "bank_dedupe", "weighted_pick", "weighted_sample_wor", "table_grid_uniform", "script_histogram",
    "ocr_noise_guard", "gt_page_text", "block_overlap_pairs", "caption_nearest", "mask_bbox_hit", "qc_first_failure",
    "running_fail_ratio", "layout_signature", "coco_annotations",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from quillmill import catalogue

    seconds = {}
    catalogue.QUERIES[HEADLINE[0]](spark, sf_dir).collect()  # starts the session's code
    for name in HEADLINE:
        began = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
