"""Layout regions, reading order, label maps, template match, field merge."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import DETECTOR_CLASSES, FOOTER_WORDS, STRUCTURE_LABELS, TABLE_WORDS, VERTICAL_MARKERS
from ..functions.remark import merge_remarks
from ..functions.text import contains_any, first_of
from .geometry import PAGE, meets
from .templates import matched


def rule_based_regions(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """table, header and footer regions of each page by height bands and words: region_type, ordinal, bounds, confidence, orientation."""
    sizes = pages.select(*PAGE, F.col("width").alias("_w"), F.col("height").alias("_h")).where("_h > 0")
    j = meets(blocks, sizes)
    ratio, text = F.col("y_center") / F.col("_h"), F.col("text")
    bands = [("table", ratio.between(0.2, 0.85) | contains_any(text, TABLE_WORDS), 0.8), ("header", ratio < 0.2, 0.7), ("footer", (ratio > 0.8) | contains_any(text, FOOTER_WORDS), 0.7)]
    fits = j.withColumns({f"_{name}": fit for name, fit, _ in bands}).withColumn("orientation", F.when(F.col("_h") > F.col("_w"), "portrait").otherwise("landscape"))
    sides = [("x1", F.min, "x_min"), ("y1", F.min, "y_min"), ("x2", F.max, "x_max"), ("y2", F.max, "y_max")]
    # All bands of a page in one row, so that no block is copied.
    page = fits.groupBy(*PAGE, "orientation").agg(*(F.count_if(f"_{name}").alias(f"_{name}") for name, _, _ in bands), *(side(F.when(F.col(f"_{name}"), F.col(c))).alias(f"_{name}_{k}") for name, _, _ in bands for k, side, c in sides))
    kinds = [F.when(F.col(f"_{name}") > 0, F.struct(F.lit(k).alias("ordinal"), F.lit(name).alias("region_type"), F.lit(c).alias("confidence"), *(F.col(f"_{name}_{s}").alias(s) for s, _, _ in sides))) for k, (name, _, c) in enumerate(bands)]
    each = page.select(*PAGE, "orientation", F.inline(F.array_compact(F.array(*kinds))))
    return each.select(*PAGE, "ordinal", "region_type", "confidence", "orientation", *(s for s, _, _ in sides))


def reading_order(regions: DataFrame) -> DataFrame:
    """regions with reading_position, by y, x and their own order."""
    return regions.withColumn("reading_position", F.row_number().over(Window.partitionBy(*PAGE).orderBy("y1", "x1", "ordinal")) - 1)


def structure_label(label):
    """The region type of a structure model's label; text if it is missing, unknown if it is another."""
    known = F.create_map(*map(F.lit, chain.from_iterable(STRUCTURE_LABELS.items())))
    return F.coalesce(F.try_element_at(known, F.lower(F.coalesce(label, F.lit("text")))), F.lit("unknown"))


def detector_label(number):
    known = F.create_map(*map(F.lit, chain.from_iterable(DETECTOR_CLASSES.items())))
    return F.coalesce(F.try_element_at(known, number), F.lit("unknown"))


def detector_regions(boxes: DataFrame) -> DataFrame:
    """Regions of detector boxes (xyxy array<double>, cls int, conf double), with width and height."""
    x1, y1, x2, y2 = (F.col("xyxy")[k] for k in range(4))
    return boxes.withColumns({"region_type": detector_label(F.col("cls")), "x1": x1, "y1": y1, "x2": x2, "y2": y2, "width": x2 - x1, "height": y2 - y1, "confidence": F.col("conf")}).drop("xyxy", "cls", "conf")


def blocks_in_regions(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """blocks with in_table and the ordinal of the first region that holds their centre."""
    each = F.struct("ordinal", "x1", "y1", "x2", "y2")
    page = regions.groupBy(*PAGE).agg(F.sort_array(F.collect_list(each)).alias("_regions"))
    # A page's regions reach its blocks once, so blocks are neither dealt again nor joined with themselves.
    j = meets(blocks, page, how="left")
    holds = lambda r: r["ordinal"].isNotNull() & F.col("x_center").between(r["x1"], r["x2"]) & F.col("y_center").between(r["y1"], r["y2"])
    first = F.get(F.filter("_regions", holds), F.lit(0))["ordinal"]
    return j.withColumn("region_ordinal", first).drop("_regions").withColumn("in_table", F.col("region_ordinal").isNotNull())


def vertical_regions(blocks: DataFrame, least_ratio: float = 2.0) -> DataFrame:
    """Blocks at least twice as high as wide that hold a marker, also with white space inside: region_type buyer, seller or remark."""
    solid = F.regexp_replace("text", r"(?U)\s+", "")
    kind = first_of([(contains_any(solid, [m.replace(" ", "") for m in markers]), F.lit(name)) for name, markers in VERTICAL_MARKERS.items()], F.lit(None).cast("string"))
    tall = (F.col("width") > 0) & (F.col("height") > 0) & (F.col("height") >= F.col("width") * least_ratio)
    return blocks.where(tall).withColumn("region_type", kind).where("region_type is not null").withColumns({c: F.col(s).cast("int") for c, s in (("x", "x_min"), ("y", "y_min"), ("w", "width"), ("h", "height"))})


def match_templates(docs: DataFrame, templates: DataFrame, form: str | None = None) -> DataFrame:
    """The first template, by ordinal, whose key stands in the text.

    form: a pattern that every key matches as a whole wherever it stands in a text. With it the texts' candidates meet
    the keys in an equi-join; without it all keys are searched at once (see templates).
    """
    if form:
        found = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("full_text", F.lit(f"({form})"), F.lit(1)))).alias("supplier_key"))
        hit = found.join(templates, "supplier_key")
        return hit.groupBy("doc_id").agg(F.min_by("supplier_key", "ordinal").alias("supplier_key"), F.min("ordinal").alias("ordinal"))
    best = matched(docs, templates).groupBy("doc_id").agg(F.min("hit").alias("hit"))
    return best.select("doc_id", F.col("hit.supplier_key").alias("supplier_key"), F.col("hit.ordinal").cast(dict(templates.dtypes)["ordinal"]).alias("ordinal"))


def bounding_boxes(blocks: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """The union of the blocks' bounds: x1, y1, x2, y2."""
    return blocks.groupBy(*keys).agg(F.min("x_min").alias("x1"), F.min("y_min").alias("y1"), F.max("x_max").alias("x2"), F.max("y_max").alias("y2"))


def cell_grid(cells: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """n_rows, n_cols of cell boxes: their distinct tops and left edges."""
    return cells.groupBy(*keys).agg(F.count_distinct("y_min").alias("n_rows"), F.count_distinct("x_min").alias("n_cols"))


def primary_tables(tables: DataFrame) -> DataFrame:
    """Each document's first table: that of its smallest page, there the first."""
    order = F.struct("page", *(["ordinal"] if "ordinal" in tables.columns else []))
    columns = [c for c in tables.columns if c != "doc_id"]
    return tables.groupBy("doc_id").agg(F.min_by(F.struct(*columns), order).alias("_t")).select("doc_id", *(F.col("_t")[c].alias(c) for c in columns))


def structure_regions(items: DataFrame) -> DataFrame:
    """Regions of a structure model's items (doc_id, ordinal, type, box array<double>, score, html, cells
    array<array<double>>, lines array<struct<text>>): tables have their HTML and the number of distinct tops and left
    edges of their cells, texts their lines; a missing box is four zeros, a missing score 0."""
    kind = structure_label(F.col("type"))
    box = [F.coalesce(F.get("box", F.lit(k)), F.lit(0.0)).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))]
    distinct = lambda k: F.size(F.array_distinct(F.transform("cells", lambda c: F.get(c, F.lit(k)))))
    sized = (F.col("region_type") == "table") & (F.size("cells") > 0)
    content = F.array_join(F.transform("lines", lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    typed = items.select("doc_id", "ordinal", kind.alias("region_type"), *box, F.coalesce("score", F.lit(0.0)).alias("confidence"), "html", "cells", "lines")
    return typed.select(
        "doc_id", "ordinal", "region_type", "x1", "y1", "x2", "y2", "confidence", F.when(F.col("region_type") == "table", F.col("html")).alias("table_html"),
        F.when(sized, distinct(1)).alias("n_rows"), F.when(sized, distinct(0)).alias("n_cols"), F.when((F.col("region_type") == "text") & F.col("lines").isNotNull(), content).otherwise("").alias("content"),
    )


def merge_fields(original: DataFrame, vertical: DataFrame) -> DataFrame:
    """doc_id, field_key, value, source, confidence of both: vertical values where the original is missing, empty or under 0.7; remarks are merged."""
    o = original.select("doc_id", "field_key", F.col("value").alias("ov"), F.col("confidence").alias("oc"), F.col("source").alias("os"))
    v = vertical.where(F.col("value") != "").select("doc_id", "field_key", F.col("value").alias("vv"))
    j = o.join(v, ["doc_id", "field_key"], "full")
    remark = (F.col("field_key") == "remark") & F.col("ov").isNotNull() & F.col("vv").isNotNull()
    merged = merge_remarks(F.col("ov"), F.col("vv"))
    conf = F.coalesce("oc", F.lit(0.0))
    replace = F.col("vv").isNotNull() & ~remark & (F.col("ov").isNull() | (F.col("ov") == "") | (conf < 0.7))
    changed = remark & (merged != F.col("ov"))
    pick = lambda a, b, c: F.when(changed, a).when(replace, b).otherwise(c)
    return j.select("doc_id", "field_key", pick(merged, F.col("vv"), F.col("ov")).alias("value"), pick(F.lit("MERGED"), F.lit("VERTICAL_OCR"), F.col("os")).alias("source"), pick(F.greatest(conf, F.lit(0.85)), F.lit(0.85), F.col("oc")).alias("confidence"))
