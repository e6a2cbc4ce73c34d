"""Blocks of pages are made and clustered with one exchange: fixtures against their SQL, plans, polygons of any number of points."""

import re

import pytest

from papyra.operators import cells, geometry, layout, table
from papyra.plans import fixtures, queries

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\(([a-z_]+)#", df._jdf.queryExecution().executedPlan().toString())


def from_sql(spark, folder, name):
    sql = fixtures.SQL[name].replace("{fmt}", fixtures._FMT["spark"]).replace("{agg_text}", fixtures._AGG["spark"])
    return spark.sql(sql, **{n: from_sql(spark, folder, n) if n in fixtures.SQL else fixtures.frame(spark, folder, n) for n in fixtures._names(sql)})


@pytest.mark.parametrize("lines", [None, 2500])
def test_blocks_equal_their_sql(spark, tmp_path, lines):
    """Also for a document of so many lines that the rows below the table stand between them."""
    folder = SF
    if lines:
        folder = str(tmp_path)
        line = spark.read.parquet(f"{SF}/lineitem.parquet").orderBy("l_orderkey", "l_linenumber").limit(1).drop("l_linenumber")
        line.crossJoin(spark.range(1, lines).selectExpr("cast(id as int) as l_linenumber")).write.parquet(f"{folder}/lineitem.parquet")
        spark.read.parquet(f"{SF}/part.parquet").write.parquet(f"{folder}/part.parquet")
    for name in ("fx_blocks", "fx_pages_of"):
        got, want = fixtures.frame(spark, folder, name), from_sql(spark, folder, name)
        assert got.dtypes == want.dtypes
        if lines and name == "fx_blocks":
            # SQL leaves the order of a row below the table and the first cell of line 1000 and on open.
            got, want = (f.where("not (page = 2 and abs(ordinal - 7950) < 100)") for f in (got, want))
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("name", ["row_cluster", "row_text", "widest_row", "region_counts", "table_advanced", "document_structure", "column_bounds", "remark_positional", "evidence_cells", "assign_column"])
def test_pages_are_dealt_once(spark, name):
    """Lines are dealt by order; nothing as large as the blocks is dealt after that."""
    assert set(exchanges(queries.QUERIES[name](spark, SF))) == {"l_orderkey"}



@pytest.mark.parametrize("name", ["table_simple", "layout_text", "header_hits", "table_body", "header_row", "row_classify", "header_template8", "header_keyset", "header_merge"])
def test_rows_of_pages_are_dealt_once(spark, name):
    """Also where rows are counted in the end, of which a row a kind and task is dealt."""
    assert set(exchanges(queries.QUERIES[name](spark, SF))) == {"l_orderkey"} | ({"row_type"} if name == "table_simple" else set())


@pytest.mark.parametrize("name", ["post_process", "needs_review", "evidence_contains", "extract_remark", "doc_confidence"])
def test_documents_are_dealt_once(spark, name):
    """Orders are dealt by key before their texts are made; lines and fields then meet without another exchange."""
    assert set(exchanges(queries.QUERIES[name](spark, SF.replace("0.001", "0.01")))) == {"o_orderkey"}


def test_geometry_of_any_polygon(spark):
    """Four points need no arrays; more points, and points without a coordinate, give the same as the plain definition."""
    some = [[[0.0, 1.0], [4.0, 1.0], [4.0, 3.0], [0.0, 3.5]], [[0.0, 1.0], [4.0, 1.0], [4.0, 3.0], [0.0, 3.5], [9.0, -2.0]], [[1.0, 1.0]] * 3, [[1.0], [2.0, 2.0], [3.0, 3.0], [4.0, 4.0]], [None, [2.0, 2.0], [3.0, 3.0], [4.0, 4.0]], None]
    got = geometry.with_geometry(spark.createDataFrame(list(enumerate(some)), "k int, bbox array<array<double>>")).orderBy("k").drop("bbox")
    # k, x_min, x_max, y_min, y_max, x_center, y_center, width, height
    assert [tuple(r) for r in got.collect()] == [
        (0, 0.0, 4.0, 1.0, 3.5, 2.0, 2.125, 4.0, 2.5), (1, 0.0, 9.0, -2.0, 3.5, 3.4, 1.3, 9.0, 5.5), (2, *[None] * 8),
        (3, 1.0, 4.0, 2.0, 4.0, 2.5, None, 3.0, 2.0), (4, 2.0, 4.0, 2.0, 4.0, None, None, 2.0, 2.0), (5, *[None] * 8),
    ]


def test_row_numbers_equal_row_clusters(spark):
    """The fold over Arrow batches against the fold of SQL's arrays: jitter, vertical blocks, centres and heights that are null, batches that cut pages."""
    import random

    r = random.Random(7)
    rows = []
    for doc in range(60):
        spread = r.choice([0, 3, 14, 40])
        for k in range(r.choice([1, 5, 40, 200])):
            x, y, h = r.randrange(8) * 100.0, k // 6 * r.choice([30, 40]) + r.random() * spread, r.choice([20.0, 24.0, 0.0])
            tall = doc % 3 == 0 and r.random() < 0.04
            text, wide, h = ("件件 件", 20.0, 150.0) if tall else (f"t{k}", 80.0, h)
            rows.append((doc // 2, doc % 2, k, text, x, x + wide, y, y + h, x + wide / 2, None if doc % 7 == 1 and k % 9 == 0 else y + h / 2, wide, None if r.random() < 0.05 else h))
    frame = spark.createDataFrame(rows, "doc_id long, page int, ordinal long, text string, x_min double, x_max double, y_min double, y_max double, x_center double, y_center double, width double, height double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        for some in (frame, frame.drop("text")):
            got, want = geometry.row_numbers(some), geometry.row_clusters(some)
            assert got.columns == want.columns and got.dtypes == want.dtypes
            got, want = (sorted(map(str, f.collect())) for f in (got, want))
            assert got == want
            assert len(got) > len(rows) or "text" not in some.columns
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_normalized_boxes_are_dealt_by_document(spark):
    """Blocks meet their page's size where their lines were dealt; a page without a size takes the first page's."""
    assert set(exchanges(queries.QUERIES["bbox_normalized"](spark, SF))) == {"l_orderkey"}
    blocks = spark.createDataFrame([(1, 1, 0, [[10.0, 20.0]]), (1, 3, 0, [[10.0, 20.0]]), (1, None, 0, [[10.0, 20.0]]), (2, 1, 0, [[1.0, 1.0]]), (3, 1, 0, [[1.0, 1.0]])], "doc_id long, page int, ordinal long, bbox array<array<double>>")
    pages = spark.createDataFrame([(1, 1, 100, 200), (1, 2, 1, 1), (2, 1, 0, 5)], "doc_id long, page int, width int, height int")
    got = geometry.normalized_boxes(blocks, pages).orderBy("doc_id", "page").select("doc_id", "page", "bbox_norm")
    assert [tuple(r) for r in got.collect()] == [(1, None, [[0.1, 0.1]]), (1, 1, [[0.1, 0.1]]), (1, 3, [[0.1, 0.1]]), (2, 1, None), (3, 1, None)]


@pytest.mark.parametrize("name", ["blocks_in_table", "layout_rule_based"])
def test_regions_are_dealt_by_document(spark, name):
    assert set(exchanges(queries.QUERIES[name](spark, SF))) == {"l_orderkey"}


def test_blocks_take_the_first_region_that_holds_them(spark):
    """Of overlapping regions the smallest ordinal; pages without regions, and regions without an ordinal, hold nothing."""
    blocks = spark.createDataFrame([(1, 1, 0, 5.0, 5.0), (1, 1, 1, 15.0, 5.0), (1, 1, 2, 99.0, 5.0), (1, 2, 0, 5.0, 5.0), (2, 1, 0, 5.0, 5.0)], "doc_id long, page int, ordinal long, x_center double, y_center double")
    regions = spark.createDataFrame([(1, 1, 3, 0.0, 0.0, 20.0, 9.0), (1, 1, 1, 0.0, 0.0, 10.0, 5.0), (1, 2, None, 0.0, 0.0, 9.0, 9.0)], "doc_id long, page int, ordinal int, x1 double, y1 double, x2 double, y2 double")
    got = layout.blocks_in_regions(blocks, regions).select("doc_id", "page", "ordinal", "region_ordinal", "in_table").orderBy("doc_id", "page", "ordinal").collect()
    assert [tuple(r) for r in got] == [(1, 1, 0, 1, True), (1, 1, 1, 3, True), (1, 1, 2, None, False), (1, 2, 0, None, False), (2, 1, 0, None, False)]


@pytest.mark.parametrize("name", ["table_advanced", "document_structure", "column_bounds", "row_cluster_vertical"])
def test_tables_gather_no_blocks(spark, name):
    """Rows and tables are worked out over Arrow batches: no page is gathered into SQL's arrays, or unfolded and gathered again."""
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("ArrowEvalPython") == 1


@pytest.fixture(scope="module")
def odd_pages(spark):
    """Pages with headers of all kinds and without, vertical blocks, jitter, texts and heights that are null, overlapping and empty spans."""
    import random

    r = random.Random(11)
    heads = ["项目名称", "规格型号", "单位", "单", "位", "数 量", "单价", "金额", "税率", "税额", "件", "品名", " 金额 ", "", None, "kg", "Name", "个", "名称"]
    words = ["小计", "价税合计", "备注", "开票人", "a", "B c", "", None, "项目名称 金额", "数量", "12.50", "税额 规格", "单位", "kg"]
    rows = []
    for doc in range(160):
        spread, start, k = r.choice([0, 3, 14, 40]), r.choice([0, 0, 1, 9]), 0
        lines = r.choice([1, 4, 12, 30])
        for line in range(lines):
            head = line == start and doc % 3
            for _ in range(r.choice([1, 3, 8, 10])):
                x, y, h = r.randrange(10) * 45.0 + r.random(), line * r.choice([30, 40]) + r.random() * spread, r.choice([20.0, 24.0, 0.0])
                tall = doc % 4 == 0 and r.random() < 0.05
                text = r.choice(heads) if head else r.choice(words)
                wide = r.choice([0.0, 30.0, 80.0, 300.0])
                if tall:
                    text, wide, h = r.choice(["件件 件", "个件个件", "件 件 个"]), 20.0, 150.0
                rows.append((doc // 2, doc % 2, k, text, x, x + wide, y, y + h, x + wide / 2, None if doc % 7 == 1 and k % 9 == 0 else y + h / 2, wide, None if r.random() < 0.05 else h))
                k += 1
    r.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, page int, ordinal long, text string, x_min double, x_max double, y_min double, y_max double, x_center double, y_center double, width double, height double").cache()


@pytest.mark.parametrize("batch", ["10000", "37"])
@pytest.mark.parametrize("kind", ["rows", "columns", "items", "cells"])
def test_pages_in_arrow_equal_their_sql(spark, odd_pages, kind, batch):
    clusters = geometry.row_clusters(odd_pages)
    want = {"rows": geometry.row_texts, "columns": table.adaptive_columns, "items": table.advanced_table, "cells": lambda c: table.document_structure(table.advanced_table(c))}[kind](clusters)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = getattr(table, f"page_{kind}")(odd_pages)
        assert sorted(got.columns) == sorted(want.columns)
        got, want = (sorted(str(tuple(r)) for r in f.select(*sorted(f.columns)).collect()) for f in (got, want))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len(got) > 300


def test_nearest_column_in_parts(spark, odd_pages, monkeypatch):
    """Columns are compared in parts of a batch, whatever their size."""
    import pyarrow as pa

    some = odd_pages.where("doc_id < 20").sort("doc_id", "page", "y_center", "ordinal").toPandas()
    columns = [pa.array(some[c], from_pandas=True) for c in ("y_center", "x_center", "height", "text", "x_min", "x_max")]
    columns = [pa.array(some.groupby(["doc_id", "page"]).cumcount() + 1), *columns[:3], pa.nulls(len(some)), *columns[3:]]
    whole = cells._Pages(columns).nearest
    monkeypatch.setattr(cells, "_PAIRS", 7)
    assert (cells._Pages(columns).nearest == whole).all()
