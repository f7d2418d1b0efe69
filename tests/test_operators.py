"""Edge cases of operators, sources and sinks."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.functions import numbers as N
from quillmill.functions import text as X
from quillmill.operators import analytics, export, qc, raster, sampling
from quillmill.sources import files
from quillmill.streaming import run_log


def test_numeric_summary_of_nothing_and_of_non_finite(spark):
    rows = spark.createDataFrame([(float("nan"), 1.0), (float("inf"), None), (None, None)], "a double, b double")
    got = {r.field: r for r in analytics.numeric_summary(rows, ["a", "b"]).collect()}
    assert (got["a"].n, got["a"].mean, got["b"].n, got["b"].std, got["b"].p95) == (0, None, 1, 0.0, 1.0)


def test_null_categories_are_unknown(spark):
    rows = spark.createDataFrame([("x",), (None,), (None,)], "k string")
    assert {(r.value, r.n) for r in analytics.categorical_counts(rows, ["k"]).collect()} == {("x", 1), ("unknown", 2)}


@pytest.mark.parametrize("weights", [[(1, -1.0)], [(1, 0.0)]])
def test_bad_distributions_raise(spark, weights):
    with pytest.raises(Exception, match="cfg/"):
        analytics.normalise(spark.createDataFrame(weights, "k int, w double"), "k", "w").collect()


def test_ok_row_when_no_rule_breaks(spark):
    gaps = spark.createDataFrame([("a", 0.1)], "key string, abs_gap double")
    facts = spark.createDataFrame([(10,)], "n int")
    got = analytics.recommend(gaps, [("few", F.col("n") < 5, F.col("n"))], facts).collect()
    assert [(r.rule, r.detail) for r in got] == [("ok", "")]


def test_draws_leave_out_zero_weights_and_do_not_repeat(spark):
    pool = spark.createDataFrame([(i, "g", float(i % 3)) for i in range(30)], "i int, g string, w double")
    got = sampling.draw_without_replacement(pool, F.col("w"), N.uniform("t", F.col("i")), 5, ["g"], ["i"]).collect()
    assert len({r.i for r in got}) == 5 and all(r.w > 0 for r in got)


def test_all_zero_weights_are_even(spark):
    pool = spark.createDataFrame([(1, 0.0), (2, -5.0)], "i int, w double").withColumn("g", F.lit(1))
    assert [r._hi for r in sampling.cumulative(pool, F.col("w"), ["i"], ["g"]).orderBy("i").collect()] == [1.0, 2.0]


def test_uniform_does_not_depend_on_partitions(spark):
    rows = lambda n: spark.range(50).repartition(n).select("id", N.uniform("s", F.col("id")).alias("u"))
    a, b = sorted(rows(1).collect()), sorted(rows(7).collect())
    assert a == b and all(0 <= r.u < 1 for r in a)


def test_rules_that_are_off_are_not_in_the_plan(spark):
    boxes = spark.createDataFrame([(1, 1, 590, 0, 50, 9, "list"), (2, 1, 0, 700, 300, 50, "title")], "page int, pos int, x int, y int, w int, h int, kind string")
    got = lambda rules: {r.page: r.code for r in qc.first_failure(boxes, 600, 800, rules).collect()}
    assert got(qc.RULES) == {1: "qc/bbox-outside-page", 2: "qc/title-too-low"}
    assert got(("coverage", "small")) == {1: "qc/visual-coverage-too-low", 2: None}


def test_guards_take_nulls(spark):
    rows = spark.createDataFrame([(None,), ("",), ("ok text",)], "t string")
    got = rows.select(X.has_tofu(F.col("t")).alias("a"), X.code_tokens(F.col("t")).alias("b"), X.is_noisy(F.col("t")).alias("c"), X.latex_sanitise(F.col("t")).alias("d")).collect()
    assert [tuple(r) for r in got] == [(False, 0, True, None), (False, 0, True, None), (False, 0, False, "ok text")]


def test_bank_scan(spark, tmp_path):
    (tmp_path / "words.csv").write_text("﻿word,lang,script,alphabet_profile,weight,category,enabled\ncat,en,latin,basic,2.5,noun,1\n ,en,latin,basic,1,noun,1\ndog,,,,bad,,\nowl,en,latin,basic,-3,noun,off\n")
    got = {r.text: (r.lang, r.weight, r.category, r.source) for r in files.read_words(spark, str(tmp_path / "words.csv")).collect()}
    assert got == {"cat": ("en", 2.5, "noun", "words.csv"), "dog": ("unknown", 1.0, "general", "words.csv")}
    (tmp_path / "text.csv").write_text("text\nx\n")
    with pytest.raises(ValueError, match="word"):
        files.read_words(spark, str(tmp_path / "text.csv"))


def test_annotation_scan_keeps_unreadable_files(spark, tmp_path):
    good = {"page_id": "p1", "size": {"w": 200, "h": 100, "dpi": 300}, "blocks": [{"block_id": 0, "block_type": "table", "bbox": [0, 0, 20, 10]}], "lines": [{"line_id": 0, "gt_script": "ru"}, {"line_id": 1, "gt_script": "latin"}]}
    (tmp_path / "p1.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "p2.json").write_text("{ not json")
    got = {r.page_id: r for r in files.annotation_features(files.read_annotations(spark, str(tmp_path))).collect()}
    assert (got["p1"].line_count, got["p1"].table_area_ratio, got["p1"].dominant_script, got["p1"].error) == (2, 0.01, "ru", None)
    assert (got["p2"].line_count, got["p2"].error) == (None, "unreadable")


def test_split_and_template_scans(spark, tmp_path):
    (tmp_path / "train.txt").write_text("000001\n\n 000002 \n")
    assert sorted(tuple(r) for r in files.read_splits(spark, str(tmp_path)).collect()) == [("000001", "train"), ("000002", "train")]
    (tmp_path / "t.csv").write_text("sep=;\nname;x;y;w;h\na;0.5;2;bad;-1\n")
    assert [tuple(r) for r in files.read_templates(spark, str(tmp_path / "t.csv")).collect()] == [("a", 0.5, 1.0, 0.0, 0.0)]


def test_sinks(spark, tmp_path):
    pages = spark.createDataFrame([("1", "train"), ("2", "val")], "page_id string, split string")
    assert export.export(pages, "native", str(tmp_path / "n"))["skipped"] is False
    assert spark.read.parquet(str(tmp_path / "n")).count() == 2
    assert export.export(pages, "tar", str(tmp_path / "t")) == {"target": "tar", "skipped": True, "reason": "unsupported-export-target"}
    export.write_text(str(tmp_path / "d" / "a.txt"), "ä\n")
    assert (tmp_path / "d" / "a.txt").read_text() == "ä\n"
    with pytest.raises(ValueError, match="seed"):
        export.manifest({"run_id": "r"})


def test_png_round_trip():
    page = raster.mask([(1, 1, 2, 2)], 4, 3)
    assert raster.is_binary(page) and not raster.is_binary(page + 1)
    data = raster.png(page)
    assert struct.unpack(">II", data[16:24]) == (4, 3)
    body = zlib.decompress(data[data.index(b"IDAT") + 4 : data.index(b"IEND") - 8])
    assert (np.frombuffer(body, dtype=np.uint8).reshape(3, 5)[:, 1:] == page).all()
    with pytest.raises(TypeError):
        raster.png(page.astype(float))
    with pytest.raises(ValueError):
        raster.png(np.zeros((2, 2, 2), dtype=np.uint8))


def test_run_log_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("a", "2026-01-01T00:00:01", "ok"), ("b", "2026-01-01T00:00:02", "fail"), ("c", "2026-01-01T00:02:02", "ok")]
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"page_id": p, "ts": t, "status": s}) for p, t, s in rows))
    query = run_log.progress(run_log.read_log(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(60)
    assert sorted((r.ok, r.fail, r.ratio) for r in spark.table("progress").collect()) == [(1, 0, 0.0), (1, 1, 0.5)]
    assert run_log.should_abort(1, 1, 0.4) and not run_log.should_abort(9, 1, 0.4) and run_log.should_abort(9, 1, 0.4, True)


def test_every_block_is_placed(spark):
    from quillmill.operators import generation

    pages = spark.createDataFrame([(i, n) for i in range(60) for n in [1 + i % 30]], "page_id long, line_count long")
    rows = generation.place(pages).collect()
    assert len(rows) == sum(min(12, 1 + i % 30) for i in range(60))
    assert all(20 <= r.h and r.y + r.h <= 800 - 48 for r in rows) and any(r.shrunk for r in rows)


def test_every_box_is_packed(spark):
    from quillmill.operators import generation

    boxes = [(1, i, 0, 0, 200, 200) for i in range(40)] + [(2, 0, 500, 700, 900, 50), (2, 1, 10, 10, 20, 20)]
    rows = generation.pack(spark.createDataFrame(boxes, "page long, pos long, x long, y long, w long, h long"), 600, 800).collect()
    assert sorted((r.page, r.pos) for r in rows) == [b[:2] for b in boxes]
    assert all(r.x >= 0 and r.x + r.w <= 600 and r.y >= 0 and r.y + r.h <= 800 for r in rows if r.w < 600)
    assert sum(r.overlaps for r in rows if r.page == 1) >= 40 - 12 and not any(r.overlaps for r in rows if r.page == 2 and r.pos == 0)


def test_queries_keep_their_boxes(spark, sf):
    from quillmill import catalogue
    from quillmill.sources import tables as T

    assert catalogue.QUERIES["occupancy_pack"](spark, sf).count() == T.boxes(spark, sf).count()
    planned = T.doc_pages(spark, sf).selectExpr("sum(least(12, greatest(1, line_count))) AS n").first().n
    assert catalogue.QUERIES["block_placement"](spark, sf).count() == planned


def test_first_above_equals_a_scan_of_all_items_and_meets_few(spark):
    rng = np.random.default_rng(4)
    rows = [(g, i, float(w)) for g in "ab" for i, w in enumerate([1e6, *rng.exponential(1, 300), 0.0, -2.0, *rng.exponential(50, 300)])] + [("c", 1, 0.0), ("c", 2, 0.0)]
    draws = [(k, "abc"[k % 3], float(u)) for k, u in enumerate([0.0, 0.0, 0.0, *rng.random(600), *(1 - rng.random(600) / 1e3)])]
    pool = sampling.cumulative(spark.createDataFrame(rows, "g string, i int, w double"), F.col("w"), ["i"], ["g"]).cache()
    made = sampling.first_above(spark.createDataFrame(draws, "id int, g string, u double"), pool, "i", "g")
    got = {r.id: r.i for r in made.collect()}
    ordered = sorted(map(tuple, pool.select("g", "i", "_hi", "_all").collect()))
    assert got == {k: next(i for g, i, hi, total in ordered if g == group and u * total < hi) for k, group, u in draws}


def test_ink_shares_equal_masks_and_need_no_page_of_pixels():
    rng = np.random.default_rng(6)
    kinds = ["title", "table", "figure", "caption", "footer"]
    for n in (0, 1, 5, 40):
        boxes = [(*(int(v) for v in rng.integers((-20, -20, -5, -5), (70, 90, 40, 40))), kinds[rng.integers(5)]) for _ in range(n)]
        pick = lambda *names: [b[:4] for b in boxes if b[4] in names]  # noqa: B023, E731
        text, other = raster.mask(pick("title", "caption"), 60, 80) > 0, raster.mask(pick("table"), 60, 80) > 0
        figures = raster.mask([(x - 3, y - 3, w + 6, h + 6) for x, y, w, h in pick("figure")], 60, 80) > 0
        full = (text.sum() / 4800, (text | other).sum() / 4800, figures.sum() / 4800, (text & ~figures).sum() / max(1, (~figures).sum()))
        assert raster.ink_shares(boxes, 60, 80, 3) == tuple(round(float(v), 6) for v in full)
    assert raster.ink_shares([(0, 0, 10**8, 10**9, "list")], 10**9, 10**9, 6) == (0.1, 0.1, 0.0, 0.1)


def test_density_of_pages_in_batches_equals_each_page(spark):
    rng = np.random.default_rng(8)
    kinds = ["title", "table", "figure", "caption", "footer"]
    rows = [(page, k, *(int(v) for v in rng.integers((-20, -20, -5, -5), (70, 90, 40, 40))), kinds[rng.integers(5)]) for page in range(60) for k in range(1 + page % 20)]
    got = raster.density(spark.createDataFrame(rows, "page long, pos long, x long, y long, w long, h long, kind string"), 60, 80, 3)
    want = {page: raster.ink_shares([r[2:] for r in rows if r[0] == page], 60, 80, 3) for page in range(60)}
    for size in (10000, 7):  # a page may be cut by the end of a batch
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        assert {r.page: tuple(r)[1:] for r in got.collect()} == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
