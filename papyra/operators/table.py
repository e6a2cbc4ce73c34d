"""Tables: header rows, column names and ranges, row classes, cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import HEADERS, KEY_HEADERS, NOT_HEADERS, SIMPLE_HEADER_WORDS, UNIT_CHARACTERS
from ..functions.text import contains_any, header_matches, header_name, hits, row_class, simple_row_class
from . import cells
from .geometry import PAGE, in_order, nearest_column, over_pages, projection_runs, with_parts


def header_scores(rows: DataFrame) -> DataFrame:
    """rows with matches: standard headers in the text, one less (not under 0) if it holds a data value."""
    n = header_matches(F.col("row_text"))
    return rows.withColumn("matches", F.when(contains_any(F.col("row_text"), NOT_HEADERS), F.greatest(n - 1, F.lit(0))).otherwise(n))


def header_row(rows: DataFrame, first_rows: int = 8, least: int = 3) -> DataFrame:
    """Per page the row with most matches among the first rows, the first of equals, if it has enough."""
    best = header_scores(rows.where(F.col("row_index") < first_rows)).groupBy(*PAGE).agg(F.max(F.struct("matches", (-F.col("row_index")).alias("neg"))).alias("b"))
    return best.where(F.col("b.matches") >= least).select(*PAGE, (-F.col("b.neg")).alias("row_index"), F.col("b.matches").alias("matches"))


def simple_header_row(rows: DataFrame) -> DataFrame:
    """Per page the first of the first five rows with two header words."""
    return rows.where((F.col("row_index") < 5) & (hits(F.col("row_text"), SIMPLE_HEADER_WORDS) >= 2)).groupBy(*PAGE).agg(F.min("row_index").alias("row_index"))


def widest_row(rows: DataFrame) -> DataFrame:
    """Per page the row with most items, the first of equals."""
    return rows.groupBy(*PAGE).agg(F.min(F.struct((-F.col("n_items")).alias("k"), "row_index")).alias("b")).select(*PAGE, F.col("b.row_index").alias("row_index"), (-F.col("b.k")).alias("n_items"))


def named_headers(items: Column) -> Column:
    """Array (name, x_center, x_min, x_max) of a header row's sorted items (c, pos, t, a, b); see header_items."""
    kind = "array<struct<name:string,c:double,a:double,b:double>>"
    spellings = [v for variants in HEADERS.values() for v in variants]

    def entry(name: Column, c: Column, a: Column, b: Column) -> Column:
        return F.array(F.struct(name.alias("name"), c.alias("c"), a.alias("a"), b.alias("b")))

    start = F.struct(F.array().cast(kind).alias("out"), F.lit(False).alias("skip"), F.lit(0).alias("i"))

    def step(s: Column, x: Column) -> Column:
        following = F.get(items, s["i"] + 1)
        single = F.length(x["t"]) == 1
        merges = single & following.isNotNull() & (F.length(following["t"]) == 1) & (following["a"] - x["b"] < 50)
        known = reduce(lambda p, q: p | q, [F.lit(v).contains(x["t"]) for v in spellings])
        found = (
            F.when(s["skip"] | x["t"].isin(*NOT_HEADERS), F.array().cast(kind))
            .when(merges, entry(header_name(F.concat(x["t"], following["t"])), (x["a"] + following["b"]) / 2, x["a"], following["b"]))
            .when(x["t"] == "位", entry(F.lit("单位"), x["c"], x["a"], x["b"]))
            .when(single & (x["t"].isin(*UNIT_CHARACTERS) | ~known), F.array().cast(kind))
            .otherwise(entry(header_name(x["t"]), x["c"], x["a"], x["b"]))
        )
        return F.struct(F.concat(s["out"], found).alias("out"), (~s["skip"] & ~x["t"].isin(*NOT_HEADERS) & F.coalesce(merges, F.lit(False))).alias("skip"), (s["i"] + 1).alias("i"))

    return F.aggregate(items, start, step, lambda s: s["out"])


def _header_item(x) -> Column:
    return F.struct(((x("x_min") + x("x_max")) / 2).alias("c"), x("pos").alias("pos"), F.trim(x("text")).alias("t"), x("x_min").cast("double").alias("a"), x("x_max").cast("double").alias("b"))


def header_items(items: DataFrame) -> DataFrame:
    """Named columns of header-row items (pos, text, x_min, x_max): page, column, name, x_center, x_min, x_max.

    Data values are skipped; two neighbouring single characters less than 50 apart become one name; a lone 位 means
    单位; other lone characters count only if a spelling holds them. A header row is one small array a page.
    """
    rows = items.groupBy(*PAGE).agg(F.sort_array(F.collect_list(_header_item(F.col))).alias("items"))
    merged = rows.select(*PAGE, F.posexplode(named_headers(F.col("items"))).alias("pos", "n"))
    return merged.select(*PAGE, "pos", F.col("n.name").alias("name"), F.col("n.c").alias("x_center"), F.col("n.a").alias("x_min"), F.col("n.b").alias("x_max"))


def with_template(named: Column) -> Column:
    """named (name, c, a, b) with the eight standard headers if two key names but under eight columns were seen."""
    lo, hi = F.array_min(F.transform(named, lambda x: x["a"])), F.array_max(F.transform(named, lambda x: x["b"]))
    fits = (F.size(F.array_intersect(F.transform(named, lambda x: x["name"]), F.array(*map(F.lit, KEY_HEADERS)))) >= 2) & (F.size(named) < 8)
    wide = (hi - lo) / 8
    standard = F.transform(F.array(*map(F.lit, HEADERS)), lambda name, k: F.struct(name.alias("name"), k.alias("k"), F.try_element_at(F.filter(named, lambda x: x["name"] == name), F.lit(-1)).alias("own")))
    filled = F.transform(standard, lambda s: F.struct(s["name"].alias("name"), F.coalesce(s["own"]["c"], lo + (s["k"] + 0.5) * wide).alias("c"), F.coalesce(s["own"]["a"], lo + s["k"] * wide).alias("a"), F.coalesce(s["own"]["b"], lo + (s["k"] + 1) * wide).alias("b")))
    return F.when(fits, filled).otherwise(named)


def template_headers(named: DataFrame) -> DataFrame:
    """Headers with two key names but under eight columns become the eight standard ones, evenly placed where not seen."""
    seen = F.sort_array(F.collect_list(F.struct("pos", "name", "x_center", "x_min", "x_max")))
    page = named.groupBy(*PAGE).agg(F.transform(seen, lambda x: F.struct(x["name"].alias("name"), x["x_center"].cast("double").alias("c"), x["x_min"].cast("double").alias("a"), x["x_max"].cast("double").alias("b"))).alias("seen"))
    each = page.select(*PAGE, F.posexplode(with_template(F.col("seen"))).alias("pos", "n"))
    return each.select(*PAGE, "pos", F.col("n.name").alias("name"), F.col("n.c").alias("x_center"), F.col("n.a").alias("x_min"), F.col("n.b").alias("x_max"))


def header_bounds(named: Column) -> Column:
    """Column ranges from one page's headers (name, c, a, b): midpoints to the neighbours; the first starts 50 before, the last ends 100 behind."""

    def bounds(x: Column, k: Column) -> Column:
        before, after = F.get(named, k - 1)["c"], F.get(named, k + 1)["c"]
        left = F.when(before.isNull(), F.greatest(F.lit(0.0), x["a"] - 50)).otherwise((before + x["c"]) / 2)
        right = F.when(after.isNull(), x["b"] + 100).otherwise((x["c"] + after) / 2)
        return F.struct(k.alias("column_index"), x["name"].alias("name"), left.alias("left"), right.alias("right"))

    return F.transform(named, bounds)


def rows_with_items(clustered: DataFrame) -> DataFrame:
    """row_texts with the row's whole items by pos: everything a page's table needs, in one grouping by page and row."""
    rows = clustered.groupBy(*PAGE, "row_index").agg(in_order(clustered, ("pos",), _item_columns(clustered), "item").alias("items"))
    return rows.withColumns({"row_text": F.array_join(F.transform("items", lambda x: x["item"]["text"]), " "), "n_items": F.size("items").cast("long")})


def _unpacked(rows: DataFrame, kept: tuple[str, ...], item_columns: list[str]) -> DataFrame:
    each = rows.select(*PAGE, "row_index", *kept, F.explode("items").alias("_x"))
    return each.select(*PAGE, *(F.col("_x.item")[c].alias(c) for c in item_columns), "row_index", F.col("_x.pos").alias("pos"), *kept)


def _item_columns(clustered: DataFrame) -> list[str]:
    return [c for c in clustered.columns if c not in (*PAGE, "row_index", "pos")]


def simple_table(clustered: DataFrame) -> DataFrame:
    """items with row_type, column_index, column_name: columns of the header row or of the widest row; header items have column -1."""
    rows, w = rows_with_items(clustered), Window.partitionBy(*PAGE)
    is_header = (F.col("row_index") < 5) & (hits(F.col("row_text"), SIMPLE_HEADER_WORDS) >= 2)
    rows = rows.withColumn("_h", F.when(is_header, F.col("row_index")))
    rows = rows.withColumns({"_head": F.min("_h").over(w), "_wide": F.min(F.struct(-F.col("n_items"), "row_index")).over(w)["row_index"]})
    named = F.col("_head").isNotNull()
    own = F.transform("items", lambda x: F.struct(x["pos"].cast("int").alias("column_index"), F.when(named, F.trim(x["item"]["text"])).otherwise(F.lit("")).alias("name"), x["item"]["x_min"].alias("left"), x["item"]["x_max"].alias("right")))
    basis = F.when(F.col("row_index") == F.coalesce("_head", "_wide"), own)
    rows = rows.withColumns({"_columns": F.max(basis).over(w), "row_type": F.when(F.col("row_index") == F.col("_head"), F.lit("header")).otherwise(simple_row_class(F.col("row_text")))})
    out = _unpacked(rows, ("row_type", "_columns"), _item_columns(clustered))
    return _placed(out, F.col("row_type") == "header")


def _placed(items: DataFrame, outside: Column) -> DataFrame:
    """items with column_index and column_name from their page's _columns; -1 and no name for those outside."""
    found = items.withColumn("_near", nearest_column(F.col("_columns"), F.col("x_center")))
    index = F.when(outside, F.lit(-1)).otherwise(F.coalesce(F.col("_near.i"), F.lit(-1)))
    return found.withColumns({"column_index": index, "column_name": F.when(outside, F.lit("")).otherwise(F.coalesce(F.col("_near.name"), F.lit("")))}).drop("_columns", "_near")


def segment(texts: DataFrame) -> DataFrame:
    """Rows with row_type and in_body: behind the last header, before the first total or footer, and data."""
    typed = texts.withColumn("row_type", row_class(F.col("row_text")))
    w = Window.partitionBy(*PAGE)
    start = F.coalesce(F.max(F.when(F.col("row_type") == "header", F.col("row_index"))).over(w), F.lit(-1))
    end = F.coalesce(F.min(F.when(F.col("row_type").isin("total", "footer"), F.col("row_index"))).over(w), F.lit(1 << 30))
    return typed.withColumn("in_body", (F.col("row_type") == "data") & (F.col("row_index") > start) & (F.col("row_index") < end))


def region_counts(segmented: DataFrame) -> DataFrame:
    return segmented.groupBy(*PAGE).agg(F.count_if("in_body").alias("body_rows"), *(F.count_if(F.col("row_type") == k).alias(f"{k}_rows") for k in ("subtotal", "total", "footer")))


def _with_columns(rows: DataFrame) -> DataFrame:
    """rows_with_items with their page's _columns: from the header row, else from the projection, else from the widest row.

    Windows over the page, whose partitioning the rows have; nothing is joined.
    """
    w = Window.partitionBy(*PAGE)
    scored = header_scores(rows).withColumn("_score", F.when((F.col("row_index") < 8) & (F.col("matches") >= 3), F.struct("matches", -F.col("row_index"))))
    best = scored.withColumns({"_best": F.max("_score").over(w), "_wide": F.min(F.struct(-F.col("n_items"), "row_index")).over(w)["row_index"]})
    item = lambda x: {"pos": x["pos"], "text": x["item"]["text"], "x_min": x["item"]["x_min"], "x_max": x["item"]["x_max"]}.get
    head = F.when(F.col("_score") == F.col("_best"), F.sort_array(F.transform("items", lambda x: _header_item(item(x)))))
    wide = F.when(F.col("row_index") == F.col("_wide"), F.transform("items", lambda x: F.struct(x["pos"].cast("int").alias("column_index"), F.lit("").alias("name"), x["item"]["x_min"].alias("left"), x["item"]["x_max"].alias("right"))))
    found = best.withColumns({"_head": head, "_widest": wide}).withColumn("_named", F.when(F.col("_head").isNotNull(), named_headers(F.col("_head"))))
    found = found.withColumn("_full", with_template(F.col("_named"))).withColumn("_bounds", header_bounds(F.col("_full")))
    page = found.withColumns({"_bounds": F.max("_bounds").over(w), "_widest": F.max("_widest").over(w)}).withColumn("_rest", F.coalesce(F.size("_bounds"), F.lit(0)) <= 0)
    # Only pages without a header row gather the spans of their blocks.
    spans = F.when(F.col("_rest"), F.transform("items", lambda x: F.struct(x["item"]["x_min"].cast("int").alias("lo"), x["item"]["x_max"].cast("int").alias("hi"))))
    page = page.withColumn("_spans", F.collect_list(spans).over(w))
    runs = F.transform(projection_runs(F.flatten("_spans")), lambda r: F.struct(r["column_index"].alias("column_index"), F.lit("").alias("name"), r["first"].cast("double").alias("left"), r["last"].cast("double").alias("right")))
    page = page.withColumn("_runs", F.when(F.col("_rest"), runs))
    chosen = F.when(~F.col("_rest"), F.col("_bounds")).when(F.size("_runs") > 0, F.col("_runs")).otherwise(F.col("_widest"))
    return page.withColumn("_columns", chosen).select(*rows.columns, "_columns")


def adaptive_columns(clustered: DataFrame) -> DataFrame:
    """column_index, name, left, right a page: from the header row, else from the projection, else from the widest row."""
    rows = _with_columns(rows_with_items(clustered)).where("row_index = 0")
    return rows.select(*PAGE, F.inline("_columns"))


def advanced_table(clustered: DataFrame) -> DataFrame:
    """items with row_type, in_body, column_index, column_name by adaptive columns and the segmenter."""
    rows = segment(_with_columns(rows_with_items(clustered)))
    return _placed(_unpacked(rows, ("row_type", "in_body", "_columns"), _item_columns(clustered)), F.lit(False))


def document_structure(table: DataFrame) -> DataFrame:
    """Per row and column key (name, or col_i): the texts joined by a space."""
    key = F.when(F.col("column_name") != "", F.col("column_name")).otherwise(F.concat(F.lit("col_"), F.col("column_index").cast("string")))
    return table.where("column_index >= 0").groupBy(*PAGE, "row_index", key.alias("column_key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("cell"))


_TABLE = {"text": "string", "x_min": "double", "x_max": "double"}


def page_columns(blocks: DataFrame) -> DataFrame:
    """adaptive_columns of blocks whose rows aren't told yet, over Arrow batches of whole pages (see cells); as geometry.row_numbers, for callers that group no more by page."""
    return over_pages(blocks, cells.bounds, cells.COLUMN, _TABLE).select(*PAGE, F.inline("_r"))


def page_items(blocks: DataFrame) -> DataFrame:
    """advanced_table of blocks whose rows aren't told yet, in the same way."""
    each = over_pages(blocks, cells.placed, cells.ITEM, _TABLE)
    rest = [c for c in each.columns if c not in (*PAGE, "_r")]
    each = each.select(*PAGE, *rest, F.explode("_r").alias("_x"))
    new = ("row_index", "pos", "row_type", "in_body", "column_index", "column_name")
    return each.select(*PAGE, *with_parts(rest, F.col("_x.part")), *(F.col(f"_x.{c}").alias(c) for c in new))


def page_cells(blocks: DataFrame) -> DataFrame:
    """document_structure of the advanced table of blocks whose rows aren't told yet, in the same way."""
    return over_pages(blocks, cells.cells, cells.CELL, _TABLE).select(*PAGE, F.inline("_r"))


def page_rows(blocks: DataFrame) -> DataFrame:
    """geometry.row_texts of blocks whose rows aren't told yet, in the same way."""
    return over_pages(blocks, cells.rows, cells.ROW, _TABLE).select(*PAGE, F.inline("_r"))
