"""Block geometry, rows, columns, projections, vertical splits.

Blocks are rows (doc_id, page, ordinal, text, confidence, bbox array<array<double>> of four points).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import reading

PAGE = ("doc_id", "page")


def meets(frame: DataFrame, other: DataFrame, keys: tuple[str, ...] = PAGE, how: str = "inner", also: Column | None = None) -> DataFrame:
    """A join by the keys, of which only the first deals rows out: frames that are dealt by document stay where they are. Pairs of equal keys are asked `also`."""
    moved = other.withColumnsRenamed({k: f"_other_{k}" for k in keys})
    first, *rest = [(F.col(k), F.col(f"_other_{k}")) for k in keys]
    same = first[0] == first[1]
    for a, b in rest:
        # As a range, which is no key of the exchange.
        same = same & (a <= b) & (a >= b)
    return frame.join(moved, same if also is None else same & also, how).drop(*(f"_other_{k}" for k in keys))


def with_geometry(blocks: DataFrame) -> DataFrame:
    """x_min, x_max, y_min, y_max, x_center, y_center (means of the points), width, height; polygons under four points have nulls."""
    whole, four = F.size("bbox") >= 4, F.size("bbox") == 4
    xs, ys = F.transform("bbox", lambda p: F.get(p, F.lit(0))), F.transform("bbox", lambda p: F.get(p, F.lit(1)))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b) / F.size(c)
    # Four points, as most have, need no arrays.
    x, y = ([F.get(F.get("bbox", F.lit(k)), F.lit(axis)) for k in range(4)] for axis in (0, 1))
    of = lambda few, many: F.when(four, few).otherwise(many)
    centre = lambda p: (F.lit(0.0) + p[0] + p[1] + p[2] + p[3]) / 4
    columns = {
        "x_min": of(F.least(*x), F.array_min(xs)), "x_max": of(F.greatest(*x), F.array_max(xs)), "y_min": of(F.least(*y), F.array_min(ys)), "y_max": of(F.greatest(*y), F.array_max(ys)),
        "x_center": of(centre(x), mean(xs)), "y_center": of(centre(y), mean(ys)),
    }
    out = blocks.withColumns({k: F.when(whole, v) for k, v in columns.items()})
    return out.withColumns({"width": F.col("x_max") - F.col("x_min"), "height": F.col("y_max") - F.col("y_min")})


def rects(blocks: DataFrame) -> DataFrame:
    """blocks with rect array<int>: bounds cut to integers, zeros under four points."""
    g = with_geometry(blocks)
    bounds = F.array(*(F.col(c).cast("int") for c in ("x_min", "y_min", "x_max", "y_max")))
    return g.withColumn("rect", F.when(F.size("bbox") >= 4, bounds).otherwise(F.array(*[F.lit(0)] * 4)))


def normalized_boxes(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """blocks with bbox_norm: points divided by their page's size, or by the document's first page's; null without a size. Both sides are dealt by document alone."""
    own = pages.select("doc_id", "page", F.col("width").alias("_w"), F.col("height").alias("_h"))
    first = pages.groupBy("doc_id").agg(F.min_by(F.struct("width", "height"), "page").alias("_first"))
    j = meets(meets(blocks, own, how="left"), first, ("doc_id",), "left")
    w, h = F.coalesce("_w", "_first.width"), F.coalesce("_h", "_first.height")
    scaled = F.transform("bbox", lambda p: F.array(p[0] / w, p[1] / h))
    return j.withColumn("bbox_norm", F.when((w > 0) & (h > 0), scaled)).drop("_w", "_h", "_first")


def upper_median(blocks: DataFrame, column: str = "height") -> DataFrame:
    """Per page the element at floor(n/2) of the sorted values."""
    ranked = blocks.withColumn("_k", F.row_number().over(Window.partitionBy(*PAGE).orderBy(column)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*PAGE)))
    return ranked.where(F.col("_k") == F.floor(F.col("_n") / 2)).select(*PAGE, F.col(column).alias("median"))


def in_order(frame: DataFrame, keys: tuple[str, ...], columns: list[str], name: str) -> Column:
    """Aggregate: an array of (keys, a struct of the columns as name) sorted by the keys, which have no nulls."""
    listed = F.collect_list(F.struct(*keys, F.struct(*columns).alias(name)))
    if not any("map<" in kind or "variant" in kind for _, kind in frame.dtypes):
        return F.sort_array(listed)
    # Maps have no order of their own.
    first = lambda x: F.struct(*(x[k].alias(k) for k in keys))
    return F.array_sort(listed, lambda x, y: F.when(first(x) < first(y), -1).when(first(x) > first(y), 1).otherwise(0))


_SPLIT = ("text", "x_min", "x_max", "y_min", "y_max", "width", "height")


def _let(value: Column, body) -> Column:
    """body of value, evaluated once: a column that a lambda captures would be worked out for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _page_items(blocks: DataFrame) -> tuple[DataFrame, list[str]]:
    """A row a page: items, its blocks with geometry as structs (y_center, ordinal, _block), sorted; and _block's columns."""
    g = with_geometry(blocks) if "x_center" not in blocks.columns else blocks
    g = g.where("x_center is not null")
    rest = [c for c in g.columns if c not in PAGE]
    return g.groupBy(*PAGE).agg(in_order(g, ("y_center", "ordinal"), rest, "_block").alias("items")), rest


def _split_items(items: Column, rest: list[str]) -> Column:
    """A page's items in which vertical blocks are replaced by their parts; see vertical_split."""

    def split(page: Column) -> Column:
        median = page["median"]

        def tall(x: Column) -> Column:
            b = x["_block"]
            solid = F.replace(b["text"], F.lit(" "), F.lit(""))
            high = (b["height"] > median * 2.5) & (b["height"] > b["width"] * 2) & (F.length(b["text"]) > 2)
            return F.coalesce(high & (F.size(F.array_distinct(F.split(solid, ""))) <= 2), F.lit(False))

        others = F.filter(items, lambda x: ~tall(x))

        def parts(x: Column) -> Column:
            b = x["_block"]
            middle = (b["x_min"] + b["x_max"]) / 2
            beside = F.filter(others, lambda y: y["y_center"].between(b["y_min"] - median, b["y_max"] + median) & (F.abs(y["_block"]["x_center"] - middle) >= median * 2))
            far = lambda s, y: (F.size(s) == 0) | (y["y_center"] - F.element_at(s, -1) > median * 0.4)
            rows = F.aggregate(beside, F.array().cast("array<double>"), lambda s, y: F.when(far(s, y), F.concat(s, F.array(y["y_center"]))).otherwise(s))
            chars = F.split(F.replace(b["text"], F.lit(" "), F.lit("")), "")
            # The commonest character, the first of equals.
            counts = F.transform(F.array_distinct(chars), lambda c: F.named_struct(F.lit("n"), F.size(F.filter(chars, lambda x: x == c)), F.lit("p"), -F.array_position(chars, c), F.lit("c"), c))

            def placed(y: Column) -> Column:
                anchored = F.size(y) > 0
                step = (b["y_max"] - b["y_min"]) / F.size(chars)
                centers = F.when(anchored, y).otherwise(F.transform(chars, lambda c, k: b["y_min"] + (k + 0.5) * step))
                half = F.when(anchored, median).otherwise(step) / 2

                def part(c: Column, k: Column) -> Column:
                    low, high = c - half, c + half
                    text = F.when(anchored, F.array_max(counts)["c"]).otherwise(F.get(chars, k))
                    new = {"text": text, "ordinal": F.lit(reading.PARTS) + b["ordinal"] * (1 << 16) + k, "y_center": c, "y_min": low, "y_max": high, "x_center": middle, "width": b["x_max"] - b["x_min"], "height": half * 2}
                    new["bbox"] = F.array(F.array(b["x_min"], low), F.array(b["x_max"], low), F.array(b["x_max"], high), F.array(b["x_min"], high))
                    fields = [(new[c2] if c2 in new else b[c2]).alias(c2) for c2 in rest]
                    return F.struct(c.alias("y_center"), new["ordinal"].alias("ordinal"), F.struct(*fields).alias("_block"))

                return F.transform(centers, part)

            return _let(rows, placed)

        first = lambda x: F.struct(x["y_center"].alias("y"), x["ordinal"].alias("o"))
        mixed = F.array_sort(F.concat(others, F.flatten(F.transform(F.filter(items, tall), parts))), lambda x, y: F.when(first(x) < first(y), -1).when(first(x) > first(y), 1).otherwise(0))
        return F.when(F.exists(items, tall), mixed).otherwise(items)

    heights = F.array_sort(F.transform(items, lambda x: x["_block"]["height"]))
    return _let(F.struct(F.get(heights, F.floor(F.size(items) / 2).cast("int")).alias("median")), split)


def vertical_split(blocks: DataFrame) -> DataFrame:
    """blocks in which a page's vertical ones (see vertical_blocks) are replaced by one block for each anchor row.

    Anchor rows are the y centres, more than 0.4 upper median heights apart, of blocks at its height that stand two
    medians or more beside it; each gets the commonest character, a median high. Without any, the characters are spread
    evenly. Parts keep the other columns of their block; their ordinals follow those of all whole blocks. Everything is
    worked out on a page's sorted array, so one grouping by page does for this and for row_clusters.
    """
    pages, rest = _page_items(blocks)
    each = pages.select(*PAGE, F.explode(_split_items(F.col("items"), rest)).alias("_x"))
    return each.select(*PAGE, *(F.col("_x._block")[c].alias(c) for c in rest))


def _tall_shape(b) -> Column:
    """What tells a vertical block without its page: higher than twice its width, over two characters of at most two kinds."""
    kinds = F.size(F.array_distinct(F.split(F.replace(b("text"), F.lit(" "), F.lit("")), "")))
    return F.coalesce((b("height") > b("width") * 2) & (F.length(b("text")) > 2) & (kinds <= 2), F.lit(False))


def row_clusters(blocks: DataFrame) -> DataFrame:
    """blocks with row_index and pos: rows by the running mean of y centres, items by x.

    A page's blocks, in order of (y_center, ordinal), join the current row while within max(half the mean positive height, 5)
    of its mean, which moves with each. A block farther than that from the one before it is farther from any mean of those
    before it, so it always starts a row: windows cut the page into islands there. An island no higher than the
    limit is a row; in others the mean is folded, which keeps row starts alone. So islands, not pages, are the unit of
    memory; only a page with a vertical block, whose parts belong to rows all over it, is one island (where the columns for
    it are there). One exchange, by page.
    """
    g = with_geometry(blocks) if "x_center" not in blocks.columns else blocks
    g = g.where("x_center is not null")
    rest = [c for c in g.columns if c not in PAGE]
    vertical = all(c in rest for c in _SPLIT)
    reading = Window.partitionBy(*PAGE).orderBy("y_center", "ordinal")
    whole = reading.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # A mean in reading order, so that it is the same sum however often it is worked out.
    high = F.when(F.col("height") > 0, F.col("height")) if "height" in rest else F.lit(None).cast("double")
    mean = F.coalesce(F.sum(high).over(whole) / F.nullif(F.count(high).over(whole), F.lit(0)), F.lit(20.0))
    tall = F.max(_tall_shape(F.col)).over(whole) if vertical else F.lit(False)
    marked = g.withColumns({"_near": F.greatest(mean * 0.5, F.lit(5.0)), "_before": F.lag("y_center").over(reading), "_tall": tall})
    opens = (~F.col("_tall") & (F.col("y_center") - F.col("_before") > F.col("_near"))).cast("int")
    marked = marked.withColumn("_island", F.coalesce(F.sum(F.coalesce(opens, F.lit(0))).over(reading), F.lit(0)))
    plain = not any("map<" in kind or "variant" in kind for _, kind in blocks.dtypes)
    # By x within the island, which is all that one that is a row needs; _k and _p are for the others.
    zero = F.lit(0)
    item = F.struct(F.col("x_center").alias("x"), F.col("y_center").alias("y"), F.col("ordinal").alias("o"), zero.alias("k"), zero.alias("p"), F.struct(*rest).alias("_block"))
    by_x = F.sort_array(F.collect_list(item)) if plain else F.array_sort(F.collect_list(item), _before(("x", "y", "o")))
    sums = [F.first(c).alias(c) for c in ("_near", "_tall")]
    islands = marked.groupBy(*PAGE, "_island").agg(by_x.alias("items"), (F.max("y_center") - F.min("y_center")).alias("_high"), *sums)
    low = ~F.col("_tall") & (F.col("_high") <= F.col("_near"))
    parted = islands.withColumn("items", F.when(low, F.col("items")).otherwise(_let(F.struct("items", "_near", "_tall"), lambda i: _parted(i, rest, vertical, plain))))
    before = Window.partitionBy(*PAGE).orderBy("_island").rowsBetween(Window.unboundedPreceding, -1)
    counted = parted.withColumns({"_first": F.coalesce(F.sum(F.element_at("items", -1)["k"] + 1).over(before), zero), "_low": low})
    each = counted.select(*PAGE, "_first", "_low", F.posexplode("items").alias("_at", "_x"))
    pos = F.when(F.col("_low"), F.col("_at")).otherwise(F.col("_x.p"))
    return each.select(*PAGE, *(F.col("_x._block")[c].alias(c) for c in rest), (F.col("_first") + F.col("_x.k")).cast("int").alias("row_index"), pos.alias("pos"))


def _before(keys: tuple[str, ...]):
    """A comparison of structs by some of their fields."""
    first = lambda x: F.struct(*(x[k].alias(k) for k in keys))
    return lambda x, y: F.when(first(x) < first(y), -1).when(first(x) > first(y), 1).otherwise(0)


def _parted(island: Column, rest: list[str], vertical: bool, plain: bool) -> Column:
    """An island's items row by row, with their row k and place p; vertical blocks are split first, the mean height is then the parts' too."""
    moved = F.transform(island["items"], lambda x: F.struct(x["y"].alias("y_center"), x["o"].alias("ordinal"), x["_block"].alias("_block")))
    by_y = F.sort_array(moved) if plain else F.array_sort(moved, _before(("y_center", "ordinal")))
    if vertical:
        by_y = _let(by_y, lambda items: F.when(island["_tall"], _split_items(items, rest)).otherwise(items))

    def near(items: Column) -> Column:
        high = F.transform(F.filter(items, lambda x: x["_block"]["height"] > 0), lambda x: x["_block"]["height"])
        mean = F.coalesce(F.aggregate(high, F.lit(0.0), lambda a, h: a + h) / F.nullif(F.size(high), F.lit(0)), F.lit(20.0))
        return F.when(island["_tall"], F.greatest(mean * 0.5, F.lit(5.0))).otherwise(island["_near"])

    start = F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("starts"))

    def rows(page: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            joins = (s["n"] > 0) & (F.abs(x["y_center"] - s["total"] / F.greatest(s["n"], F.lit(1))) <= page["near"])
            total, n = F.when(joins, s["total"]).otherwise(F.lit(0.0)), F.when(joins, s["n"]).otherwise(F.lit(0))
            return F.struct((s["k"] + 1).alias("k"), (total + x["y_center"]).alias("total"), (n + 1).alias("n"), F.when(joins, s["starts"]).otherwise(F.concat(s["starts"], F.array(s["k"]))).alias("starts"))

        def row(starts: Column, a: Column, r: Column) -> Column:
            some = F.slice(page["items"], a + 1, F.coalesce(F.get(starts, r + 1), F.size(page["items"])) - a)
            keyed = F.transform(some, lambda x: F.struct(x["_block"]["x_center"].alias("x"), x["y_center"].alias("y"), x["ordinal"].alias("o"), x["_block"].alias("_block")))
            ordered = F.sort_array(keyed) if plain else F.array_sort(keyed, _before(("x", "y", "o")))
            return F.transform(ordered, lambda x, p: F.struct(x["x"].alias("x"), x["y"].alias("y"), x["o"].alias("o"), r.alias("k"), p.alias("p"), x["_block"].alias("_block")))

        cut = lambda starts: F.flatten(F.transform(starts, lambda a, r: row(starts, a, r)))
        return _let(F.aggregate(page["items"], start, step, lambda s: s["starts"]), cut)

    height = near if vertical else lambda items: island["_near"]
    return _let(by_y, lambda items: _let(F.struct(items.alias("items"), height(items).alias("near")), rows))


def over_pages(blocks: DataFrame, f, result: str, more: dict[str, str] | None = None) -> DataFrame:
    """blocks with _r: what f says of each over Arrow batches of whole pages in reading order, the columns `more` (with their types) included."""
    g = with_geometry(blocks) if "x_center" not in blocks.columns else blocks
    g = g.where("x_center is not null")
    double = lambda c: F.col(c).cast("double").alias(c)
    tall = F.lit(None).cast("struct<solid:string>")
    if all(c in g.columns for c in _SPLIT):
        # Told before blocks are sorted; texts of blocks that aren't high need not be made for it.
        g = g.withColumn("_text", F.when(F.col("height") > F.col("width") * 2, F.col("text")))
        shape = _tall_shape(lambda c: F.col("_text" if c == "text" else c))
        tall = F.when(shape, F.struct(F.replace("_text", F.lit(" "), F.lit("")).alias("solid"), F.col("ordinal").cast("long").alias("ordinal"), *map(double, ("x_min", "x_max", "y_min", "y_max"))))
    height = F.col("height").cast("double") if "height" in g.columns else F.lit(None).cast("double")
    # Not deterministic, so that no filter on its rows moves below it and takes blocks from their page.
    called = F.arrow_udf(f, result).asNondeterministic()
    ordered = g.withColumn("_tall", tall).withColumn("_k", F.row_number().over(Window.partitionBy(*PAGE).orderBy("y_center", "ordinal")))
    return ordered.withColumn("_r", called("_k", double("y_center"), double("x_center"), height, "_tall", *(F.col(c).cast(t) for c, t in (more or {}).items()))).drop("_k", "_tall", "_text")


def with_parts(rest: list[str], p: Column) -> list[Column]:
    """The columns `rest` of blocks, or of the part p in place of one."""
    new = {c: p[c] for c in ("text", "ordinal", "x_center", "y_center", "y_min", "y_max", "width", "height")}
    new["bbox"] = F.array(F.array("x_min", p["y_min"]), F.array("x_max", p["y_min"]), F.array("x_max", p["y_max"]), F.array("x_min", p["y_max"]))
    return [F.when(p.isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rest]


def row_numbers(blocks: DataFrame) -> DataFrame:
    """row_clusters for callers that group no more by page: a window numbers a page's blocks in reading order, the fold runs over
    Arrow batches of whole pages, of which it takes numbers alone (see reading).

    That takes less time, but Spark forgets how rows are dealt where Python evaluates a column, so a grouping by page
    behind it deals all blocks again. A page's numbers are the unit of memory.
    """
    each = over_pages(blocks, reading.number, reading.RESULT)
    rest = [c for c in each.columns if c not in (*PAGE, "_r")]
    if not all(c in rest for c in _SPLIT):
        return each.select(*PAGE, *rest, F.col("_r.row_index").alias("row_index"), F.col("_r.pos").alias("pos"))
    each = each.select(*PAGE, *rest, "_r.row_index", "_r.pos", F.explode_outer("_r.parts").alias("_p"))
    part, p = F.col("_p").isNotNull(), F.col("_p")
    return each.select(*PAGE, *with_parts(rest, p), *(F.when(part, p[c]).otherwise(F.col(c)).alias(c) for c in ("row_index", "pos")))


def bottom_half(blocks: DataFrame) -> DataFrame:
    """The lower half of each page's blocks by (y_min, ordinal), the middle one included."""
    w = Window.partitionBy(*PAGE)
    ranked = blocks.withColumns({"_k": F.row_number().over(w.orderBy("y_min", "ordinal")), "_n": F.count("*").over(w)})
    return ranked.where("_k > floor(_n / 2)").drop("_k", "_n")


def row_texts(clustered: DataFrame) -> DataFrame:
    """Per row: text (items joined by a space), n_items, y_min, y_max over centres."""
    items = F.sort_array(F.collect_list(F.struct("pos", "text")))
    return clustered.groupBy(*PAGE, "row_index").agg(F.array_join(F.transform(items, lambda x: x["text"]), " ").alias("row_text"), F.count("*").alias("n_items"), F.min("y_center").alias("row_y_min"), F.max("y_center").alias("row_y_max"))


def layout_text(rows: DataFrame) -> DataFrame:
    """Per document its non-empty row texts by line; pages have a banner if there are several."""
    pages = rows.where(F.trim("row_text") != "").groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "row_text"))), lambda x: x["row_text"]), "\n").alias("page_text"))
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "page_text"))).alias("p"))
    banner = F.transform("p", lambda x: F.concat(F.lit("--- Page "), x["page"].cast("string"), F.lit(" ---\n"), x["page_text"]))
    return docs.select("doc_id", F.when(F.size("p") > 1, F.array_join(banner, "\n")).otherwise(F.col("p")[0]["page_text"]).alias("layout_text"))


def nearest_column(columns: Column, x: Column) -> Column:
    """Of an array of columns (column_index, name, left, right) the struct (o, d, i, name) of the nearest centre among those whose range, widened by half its width, holds x; else of all."""

    def rank(c: Column) -> Column:
        slack = (c["right"] - c["left"]) * 0.5
        return F.struct((~x.between(c["left"] - slack, c["right"] + slack)).alias("o"), F.abs(x - (c["left"] + c["right"]) / 2).alias("d"), c["column_index"].alias("i"), c["name"].alias("name"))

    return F.array_min(F.transform(columns, rank))


def assign_columns(items: DataFrame, columns: DataFrame) -> DataFrame:
    """items with column_index: the nearest centre among columns whose range, widened by half its width, holds x; else the nearest of all; -1 on pages without columns."""
    each = F.struct(F.col("column_index").cast("int").alias("column_index"), F.lit("").alias("name"), "left", "right")
    c = columns.groupBy(*PAGE).agg(F.collect_list(each).alias("_columns"))
    joined = meets(items, c, how="left")
    return joined.withColumn("column_index", F.coalesce(nearest_column(F.col("_columns"), F.col("x_center"))["i"], F.lit(-1))).drop("_columns")


def coverage(blocks: DataFrame, low: str = "x_min", high: str = "x_max") -> DataFrame:
    """Per page the steps (at, until, n) between neighbouring ends of blocks that n of them cover; stretches that none covers are absent.

    A sweep: each block is a rise and a fall, equal ones are summed before they are dealt, and a window sums them along the
    page. So a page costs its blocks' ends, however long they are.
    """
    lo, hi = F.col(low).cast("int"), F.col(high).cast("int")
    turn = lambda at, d: F.struct(at.alias("at"), F.lit(d).alias("d"))
    turns = blocks.where(hi > lo).select(*PAGE, F.inline(F.array(turn(lo, 1), turn(hi, -1)))).groupBy(*PAGE, "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*PAGE).orderBy("at")
    steps = turns.withColumns({"until": F.lead("at").over(w), "n": F.sum("d").over(w)})
    return steps.where("n > 0").select(*PAGE, "at", "until", "n")


def projection(blocks: DataFrame, low: str = "x_min", high: str = "x_max") -> DataFrame:
    """Per page and integer position: how many blocks cover it, ends excluded. Positions that none covers are absent."""
    return coverage(blocks, low, high).select(*PAGE, F.explode(F.sequence(F.col("at"), F.col("until") - 1)).alias("at"), "n")


def _until(steps: DataFrame) -> DataFrame:
    return steps if "until" in steps.columns else steps.withColumn("until", F.col("at") + 1)


def projection_columns(steps: DataFrame, ratio: float = 0.3) -> DataFrame:
    """Maximal runs above ratio times the page's maximum, of coverage's steps or projection's positions: column_index, first, last (excluded; the run that ends the page stops one earlier)."""
    page = Window.partitionBy(*PAGE)
    high = _until(steps).withColumns({"_max": F.max("n").over(page), "_end": F.max("until").over(page) - 1}).where(F.col("n") > F.col("_max") * ratio)
    w = page.orderBy("at")
    opens = F.coalesce(F.lag("until").over(w) != F.col("at"), F.lit(True))
    runs = high.withColumn("_opens", opens.cast("int")).withColumn("_run", F.sum("_opens").over(w)).groupBy(*PAGE, "_run")
    ends = runs.agg(F.min("at").alias("first"), F.least(F.max("until"), F.max("_end")).alias("last"))
    return ends.select(*PAGE, (F.col("_run") - 1).cast("int").alias("column_index"), "first", "last")


def projection_runs(spans: Column, ratio: float = 0.3) -> Column:
    """projection_columns of one page's array of spans (lo, hi): an array of (column_index, first, last).

    Two sweeps over the sorted ends, for the maximum and for the runs; what they carry is numbers and the runs so far.
    """
    kept = F.filter(spans, lambda s: s["hi"] > s["lo"])
    turn = lambda at, d: F.struct(at.cast("int").alias("at"), F.lit(d).alias("d"))
    turns = F.sort_array(F.flatten(F.transform(kept, lambda s: F.array(turn(s["lo"], 1), turn(s["hi"], -1)))))
    nothing = F.lit(None).cast("int")

    def highest(turns: Column) -> Column:
        start = F.struct(nothing.alias("at"), F.lit(0).alias("n"), F.lit(0).alias("most"))
        # A level stands once all turns at its place are in.
        step = lambda s, t: F.struct(t["at"].alias("at"), (s["n"] + t["d"]).alias("n"), F.when(s["at"] != t["at"], F.greatest(s["most"], s["n"])).otherwise(s["most"]).alias("most"))
        return F.aggregate(turns, start, step, lambda s: s["most"])

    def runs(page: Column) -> Column:
        kind = "array<struct<column_index:int,first:int,last:int>>"

        def settled(s: Column) -> Column:
            on = F.coalesce(s["at"].isNotNull() & (s["n"] > page["most"] * ratio), F.lit(False))
            run = F.struct(F.size(s["out"]).alias("column_index"), s["first"].alias("first"), F.least(s["at"], page["end"] - 1).alias("last"))
            return F.struct(on.alias("on"), F.when(on & ~s["on"], s["at"]).otherwise(s["first"]).alias("first"), F.when(s["on"] & ~on, F.concat(s["out"], F.array(run))).otherwise(s["out"]).alias("out"))

        def step(s: Column, t: Column) -> Column:
            there = F.struct(s["on"].alias("on"), s["first"].alias("first"), s["out"].alias("out"))
            now = F.when(s["at"] != t["at"], settled(s)).otherwise(there)
            return F.struct(t["at"].alias("at"), (s["n"] + t["d"]).alias("n"), now["on"].alias("on"), now["first"].alias("first"), now["out"].alias("out"))

        start = F.struct(nothing.alias("at"), F.lit(0).alias("n"), F.lit(False).alias("on"), nothing.alias("first"), F.array().cast(kind).alias("out"))
        return F.aggregate(page["turns"], start, step, lambda s: settled(s)["out"])

    return _let(turns, lambda t: _let(F.struct(t.alias("turns"), highest(t).alias("most"), F.try_element_at(t, F.lit(-1))["at"].alias("end")), runs))


def row_gaps(steps: DataFrame, least: int = 5) -> DataFrame:
    """Centres of stretches of at least `least` empty positions that ink follows, of coverage's steps or projection's positions; the margin before the first ink counts."""
    w = Window.partitionBy(*PAGE).orderBy("at")
    gaps = _until(steps).withColumn("_from", F.coalesce(F.lag("until").over(w), F.lit(0))).where(F.col("at") - F.col("_from") >= least)
    return gaps.select(*PAGE, F.floor((F.col("_from") + F.col("at")) / 2).cast("int").alias("gap_center"))


def vertical_blocks(blocks: DataFrame) -> DataFrame:
    """Tall blocks of one or two different characters: higher than 2.5 medians and twice their width, over two characters."""
    medians = upper_median(blocks)
    kinds = F.size(F.array_distinct(F.split(F.replace("text", F.lit(" "), F.lit("")), "")))
    tall = (F.col("height") > F.col("median") * 2.5) & (F.col("height") > F.col("width") * 2) & (F.length("text") > 2)
    return blocks.join(medians, list(PAGE)).where(tall & (kinds <= 2))
