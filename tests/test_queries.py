"""Every query with SQL gives the SQL's rows; the others hold their invariants."""

import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from quillmill import catalogue


#: The scale at which results are compared with SQL outside the tests, too.
COMPARED = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{COMPARED}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, COMPARED)
    columns = sorted(df.columns)
    wanted = duck.sql(catalogue.SQL[name])
    assert columns == sorted(wanted.columns)
    at = [wanted.columns.index(c) for c in columns]
    expected = sorted(([plain(r[i]) for i in at] for r in wanted.fetchall()), key=repr)
    assert sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr) == expected


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() == 4


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_placed_blocks_stay_inside_and_apart(spark, sf):
    rows = catalogue.QUERIES["block_placement"](spark, sf).collect()
    assert rows and all(r.x >= 0 and r.y >= 0 and r.x + r.w <= 600 and r.y + r.h <= 800 for r in rows)
    columns = {}
    for r in sorted(rows, key=lambda r: (r.page_id, r.column_no, r.y)):
        before = columns.get((r.page_id, r.column_no), 0)
        assert r.y >= before
        columns[r.page_id, r.column_no] = r.y + r.h


def test_packed_boxes_do_not_overlap(spark, sf):
    pages = {}
    for r in catalogue.QUERIES["occupancy_pack"](spark, sf).collect():
        pages.setdefault(r.page, []).append(r)
    for boxes in pages.values():
        for i, a in enumerate(boxes):
            assert a.x + a.w <= 600 and a.y + a.h <= 800
            assert all(a.x + a.w <= b.x or b.x + b.w <= a.x or a.y + a.h <= b.y or b.y + b.h <= a.y for b in boxes[:i])


def test_rebalanced_lines_reach_the_target_or_their_limits(spark, sf):
    totals = {}
    for r in catalogue.QUERIES["line_rebalance"](spark, sf).collect():
        assert r.lines >= 1
        totals[r.page] = totals.get(r.page, 0) + r.lines
    assert all(t <= 20 for t in totals.values())


def test_retry_rounds_settle_every_page_once(spark, sf):
    rows = catalogue.QUERIES["retry_rounds"](spark, sf).collect()
    assert len({r.page_id for r in rows}) == len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all((r.attempt == 4) == (r.status == "fallback") for r in rows)


def test_raster_density_within_bounds(spark, sf):
    for r in catalogue.QUERIES["raster_density"](spark, sf).collect():
        assert 0 <= r.text_ratio <= r.content_ratio <= 1 and 0 <= r.excluded <= 1
