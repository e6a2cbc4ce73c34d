"""Model output to blocks, pages, tables; HTML tables to cells; envelopes."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMPTY_BOX = [[0.0, 0.0]] * 4


def _points(polygon: Column, flat: bool) -> Column:
    """The first four points of a polygon, given as points or as numbers x1, y1, x2, ...; four zeros under four entries."""
    zero = F.array(*[F.array(F.lit(0.0), F.lit(0.0))] * 4)
    if flat:
        pairs = F.sequence(F.lit(0), F.least(F.size(polygon), F.lit(8)) - 2, F.lit(2))
        points = F.transform(pairs, lambda k: F.array(F.get(polygon, k).cast("double"), F.get(polygon, k + 1).cast("double")))
    else:
        points = F.transform(F.slice(polygon, 1, 4), lambda p: F.array(F.get(p, F.lit(0)).cast("double"), F.get(p, F.lit(1)).cast("double")))
    return F.when(F.size(polygon) >= 4, points).otherwise(zero)


def blocks_from_model(pages: DataFrame) -> DataFrame:
    """A block for each non-blank recognised text of model pages (rec_texts, rec_scores, dt_polys, rec_polys in parallel).

    A missing score is 0, a missing polygon four zeros; rec_polys serve where dt_polys is null or not there. Polygons are
    arrays of points, or flat arrays of numbers. line_index is the position.
    """
    places = [c for c in ("dt_polys", "rec_polys") if c in pages.columns]
    rows = pages.select("doc_id", "page", F.posexplode("rec_texts").alias("line_index", "text"), "rec_scores", *places).where(F.trim("text") != "")
    kinds = dict(rows.dtypes)
    boxes = [F.when(F.col(c).isNotNull(), _points(F.get(c, "line_index"), kinds[c].count("array") == 2)) for c in places]
    box = F.coalesce(*boxes, F.array(*[F.array(F.lit(0.0), F.lit(0.0))] * 4))
    return rows.select("doc_id", "page", "line_index", "text", F.coalesce(F.get("rec_scores", "line_index"), F.lit(0.0)).alias("confidence"), box.alias("bbox"))


def mean_confidence(blocks: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The mean confidence of each document's blocks; 0 where no block has one."""
    return blocks.groupBy(*keys).agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))


def _ordered_text(rows: DataFrame, order: list[str]) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "t"))), lambda x: x["t"]), "\n")


def structure_blocks(regions: DataFrame) -> DataFrame:
    """Blocks of the text regions of a structure model (doc_id, region, type, lines array<struct<text,confidence,bbox>>,
    html); line_index starts anew in each region."""
    lines = regions.where("type = 'text'").select("doc_id", "region", F.posexplode("lines").alias("line_index", "l"))
    return lines.select("doc_id", "region", "line_index", F.coalesce("l.text", F.lit("")).alias("text"), F.coalesce("l.confidence", F.lit(0.0)).alias("confidence"), "l.bbox")


def structure_documents(regions: DataFrame) -> DataFrame:
    """doc_id, full_text, overall_confidence: lines of text regions, and the HTML of tables between marks, in order."""
    lines = structure_blocks(regions).select("doc_id", "region", "line_index", F.col("text").alias("t"), "confidence")
    marked = F.concat(F.lit("[TABLE]\n"), "html", F.lit("\n[/TABLE]"))
    tables = regions.where("type = 'table' and html <> ''").select("doc_id", "region", F.lit(0).alias("line_index"), marked.alias("t"), F.lit(None).cast("double").alias("confidence"))
    both = lines.unionByName(tables)
    return both.groupBy("doc_id").agg(_ordered_text(both, ["region", "line_index"]).alias("full_text"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("overall_confidence"))


def table_mode_blocks(regions: DataFrame) -> DataFrame:
    """Blocks of a table recogniser's regions (as structure_blocks, and box array<double>): lines of text regions, and the
    cells of tables on an equal grid; line_index runs through the document."""
    lines = structure_blocks(regions).withColumn("k", F.col("line_index").cast("long"))
    tables = regions.where("type = 'table' and html <> ''")
    keys = ("doc_id", "region")
    cells = html_cells(tables, keys)
    bounds = tables.select(*keys, *(F.col("box")[k].alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))))
    grid = cells_to_blocks(cells, bounds, keys)
    corners = [("x_min", "y_min"), ("x_max", "y_min"), ("x_max", "y_max"), ("x_min", "y_max")]
    boxed = grid.select(*keys, F.col("line_index").cast("long").alias("k"), "text", "confidence", F.array(*(F.array(x, y) for x, y in corners)).alias("bbox"))
    both = lines.select(*keys, "k", "text", "confidence", "bbox").unionByName(boxed)
    return both.withColumn("line_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("region", "k")) - 1).drop("k")


def table_mode_documents(regions: DataFrame) -> DataFrame:
    """doc_id, full_text, overall_confidence, n_tables: text lines and the text of tables in order of their regions."""
    keys = ("doc_id", "region")
    tables = regions.where("type = 'table' and html <> ''")
    texts = table_text(html_cells(tables, keys), keys).select(*keys, F.lit(0).alias("line_index"), F.col("table_text").alias("t"))
    both = structure_blocks(regions).select(*keys, "line_index", F.col("text").alias("t")).unionByName(texts)
    words = both.groupBy("doc_id").agg(_ordered_text(both, ["region", "line_index"]).alias("full_text"))
    counts = tables.groupBy("doc_id").agg(F.count("*").alias("n_tables"))
    joined = words.join(mean_confidence(table_mode_blocks(regions)), "doc_id", "left").join(counts, "doc_id", "left")
    return joined.select("doc_id", "full_text", F.coalesce("confidence", F.lit(0.0)).alias("overall_confidence"), F.coalesce("n_tables", F.lit(0)).alias("n_tables"))


def structured_json(fields: DataFrame, promoted: dict[str, str]) -> DataFrame:
    """doc_id, structured: JSON of a document's fields and confidences (four decimals), and of those promoted to names of
    their own where they have a value. promoted: field name to its name in the JSON."""
    pairs = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_name", c))))
    doc = fields.groupBy("doc_id", "doc_type").agg(pairs(F.col("value")).alias("f"), pairs(F.round("confidence", 4).alias("c")).alias("c"))
    own = [F.try_element_at(F.col("f"), F.lit(name)).alias(shown) for name, shown in promoted.items()]
    return doc.select("doc_id", F.to_json(F.struct(F.col("doc_type").alias("docType"), F.col("f").alias("fields"), F.col("c").alias("fieldConfidences"), *own)).alias("structured"))


def merge_pages(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks with a line index that runs through the document; per document its text with page banners, and confidence weighted by block counts."""
    page = blocks.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "text"))), lambda x: x["text"]), "\n").alias("t"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifted = blocks.join(page.select("doc_id", "page", before.alias("_before")), ["doc_id", "page"]).withColumn("line_index", F.col("line_index") + F.col("_before")).drop("_before")
    banner = F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: F.concat(F.lit("--- Page "), x["page"].cast("string"), F.lit(" ---\n"), x["t"]))
    docs = page.groupBy("doc_id").agg(F.array_join(banner, "\n").alias("full_text"), F.count("*").alias("page_count"), (F.sum(F.col("c") * F.col("n")) / F.sum("n")).alias("overall_confidence"))
    return shifted, docs


class _Cells(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[tuple[str, bool]]] = []
        self.row: list[tuple[str, bool]] | None = None
        self.cell: list[str] | None = None
        self.heads = False

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.row = []
        elif tag in ("td", "th"):
            self.cell, self.heads = [], tag == "th"

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None and self.row is not None:
            self.row.append(("".join(self.cell).strip(), self.heads))
            self.cell = None
        elif tag == "tr" and self.row is not None:
            if self.row:
                self.rows.append(self.row)
            self.row = None


def table_rows(html: str) -> tuple[list[str], list[list[str]]]:
    """Headers and rows: all th texts are headers and stay in their rows; without any, the first row is taken out as headers."""
    parser = _Cells()
    parser.feed(html or "")
    headers = [text for row in parser.rows for text, head in row if head]
    rows = [[text for text, _ in row] for row in parser.rows]
    if not headers and rows:
        return rows[0], rows[1:]
    return headers, rows


#: Cells of a batch that html_cells gives.
_CELLS = 50_000


def html_cells(tables: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, kind, row_index, col_index, text of each header (row -1) and cell, in Arrow batches; a table without cells has no row."""
    given = tables.select(*keys, "html")
    schema = T.StructType([*given.schema.fields[:-1], *(T.StructField(c, t) for c, t in (("kind", T.StringType()), ("row_index", T.IntegerType()), ("col_index", T.IntegerType()), ("text", T.StringType())))])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []

            def flush(batch=batch, at=at, found=found) -> pa.RecordBatch:
                rows = pa.array(at, pa.int64())
                columns = [pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)]
                at.clear(), found.clear()
                return pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[:-1]), *columns], names=schema.names)

            for k, html in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                headers, rows = table_rows(html)
                found += [("header", -1, j, text) for j, text in enumerate(headers)]
                found += [("cell", i, j, text) for i, row in enumerate(rows) for j, text in enumerate(row)]
                at += [k] * (len(found) - len(at))
                if len(found) > _CELLS:
                    yield flush()
            if found:
                yield flush()

    return given.mapInArrow(cells, schema)


def table_text(cells: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Headers joined by bars, a rule of 40 dashes, then rows."""
    line = cells.groupBy(*keys, "kind", "row_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_index", "text"))), lambda x: x["text"]), " | ").alias("line"))
    shown = line.withColumn("line", F.when(F.col("kind") == "header", F.concat("line", F.lit("\n" + "-" * 40))).otherwise(F.col("line")))
    return shown.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "line"))), lambda x: x["line"]), "\n").alias("table_text"))


def cells_to_blocks(cells: DataFrame, regions: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Non-empty cells as blocks of an equal grid over the region (x1, y1, x2, y2), confidence 0.95."""
    body = cells.where("kind = 'cell'")
    size = body.groupBy(*keys).agg((F.max("row_index") + 1).alias("n_rows"), (F.max("col_index") + 1).alias("n_cols"))
    j = body.join(size, list(keys)).join(regions, list(keys))
    w, h = (F.col("x2") - F.col("x1")) / F.col("n_cols"), (F.col("y2") - F.col("y1")) / F.col("n_rows")
    left, top = F.col("x1") + F.col("col_index") * w, F.col("y1") + F.col("row_index") * h
    right, bottom = F.col("x1") + (F.col("col_index") + 1) * w, F.col("y1") + (F.col("row_index") + 1) * h
    placed = j.where("text <> ''").select(*keys, "row_index", "col_index", "text", F.lit(0.95).alias("confidence"), left.alias("x_min"), top.alias("y_min"), right.alias("x_max"), bottom.alias("y_max"))
    return placed.withColumn("line_index", F.row_number().over(Window.partitionBy(*keys).orderBy("row_index", "col_index")) - 1)


def content_hash(content, exact: bool = False):
    """md5 of up to 1 MiB; of the first 64 KiB and the size beyond, unless exact: then of everything."""
    if exact:
        return F.md5(content)
    size = F.octet_length(content)
    return F.when(size <= 1 << 20, F.md5(content)).otherwise(F.md5(F.concat(F.substring(content, 1, 1 << 16), F.encode(size.cast("string"), "UTF-8"))))


def result_envelope(results: DataFrame) -> DataFrame:
    """Flat string messages of results (task_id, error, needs_review, overall_confidence, ts_millis, text): status and JSON payload."""
    status = F.when(F.col("error").isNotNull(), "FAILED").when(F.col("needs_review"), "NEED_REVIEW").otherwise("SUCCESS")
    payload = F.when(F.col("error").isNull(), F.to_json(F.struct(F.col("text"), F.lit(1).alias("pageCount"))))
    return results.select("task_id", status.alias("status"), F.col("ts_millis").cast("string").alias("timestamp"), payload.alias("ocr_result"), F.when(F.col("error").isNull(), F.lower(F.col("needs_review").cast("string"))).alias("needs_review"), "error")


def cache_lookup(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files (content_key) with the first cached result of their content (content_key, cached_at, result) and `hit`.

    Keys are unique in the lookup side after one aggregation, so a file never multiplies.
    """
    known = cache.groupBy("content_key").agg(F.min_by("result", "cached_at").alias("result"))
    return files.join(known, "content_key", "left").withColumn("hit", F.col("result").isNotNull())


def evidence_envelope(results: DataFrame) -> DataFrame:
    """Messages of evidence results (task_id, doc_id, error, evidence map or struct, ts_millis, duration_ms): the flat one
    for the stream, and the callback's address and JSON body. An empty evidence map is left out of the message."""
    ok = F.col("error").isNull()
    shown = F.to_json("evidence")
    message = F.create_map(*[x for k, v in {
        "taskId": F.col("task_id"), "taskType": F.lit("EVIDENCE_ENRICH"), "docId": F.col("doc_id").cast("string"), "status": F.when(ok, "SUCCESS").otherwise("FAILED"),
        "timestamp": F.col("ts_millis").cast("string"), "durationMs": F.col("duration_ms").cast("string"), "evidenceMap": F.when(shown != "{}", shown), "error": F.nullif("error", F.lit("")),
    }.items() for x in (F.lit(k), v)])
    common = [F.col("task_id").alias("taskId"), F.lit("EVIDENCE_ENRICH").alias("taskType"), F.col("doc_id").cast("string").alias("docId")]
    body = F.when(ok, F.to_json(F.struct(*common, F.col("evidence").alias("evidenceMap"), F.col("duration_ms").alias("durationMs"))))
    body = body.otherwise(F.to_json(F.struct(*common, F.coalesce(F.nullif("error", F.lit("")), F.lit("Unknown error")).alias("errorMessage"))))
    return results.select("task_id", F.map_filter(message, lambda k, v: v.isNotNull()).alias("message"), F.when(ok, "/callback/success").otherwise("/callback/failed").alias("endpoint"), body.alias("body"))


def progress_event(tasks: DataFrame) -> DataFrame:
    """Progress messages of tasks (task_id, progress, note, ts_millis): flat strings; percentages stay within 0 and 100."""
    percent = F.least(F.greatest(F.col("progress").cast("int"), F.lit(0)), F.lit(100)).cast("string")
    return tasks.select("task_id", F.lit("PROGRESS").alias("status"), percent.alias("progress"), F.coalesce("note", F.lit("")).alias("message"), F.col("ts_millis").cast("string").alias("timestamp"))
