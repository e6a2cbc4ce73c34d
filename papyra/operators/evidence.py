"""Where field values stand on the page: strategies in order, each only for fields that none before has placed.

Fields are rows (doc_id, field_key, field_value), blocks (doc_id, ordinal, text) with their polygon `bbox`, or with x_min,
x_max, y_min, y_max, x_center and y_center. A document's fields and blocks meet once: blocks get their normalised texts,
their neighbours in reading order and the next total word before the join, so a pair of field and block tells by itself
which strategies it fits, and all strategies are ranked in one grouping. Everything is dealt by doc_id, one exchange
for either side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import FIELD_NORMALIZERS, TOTAL_WORDS
from ..functions.similarity import ratio
from ..functions.text import contains_any, first_of, norm_amount, norm_check_code, norm_date, norm_default, norm_invoice_no, strip
from .geometry import meets

_OWN = {"invoice_no": norm_invoice_no, "amount": norm_amount, "date": norm_date, "check_code": norm_check_code}
RESULT = ("doc_id", "field_key", "normalized", "ordinal", "snippet", "bbox", "confidence", "match_type")
STRATEGIES = ("context", "exact", "contains", "fuzzy", "adjacent")
_KEY = ("field_key", "normalized")


def normalized(key: Column, value: Column) -> Column:
    """A field's value by its own normaliser, or without white space in lower case."""
    keys = {n: [k for k, m in FIELD_NORMALIZERS.items() if m == n] for n in dict.fromkeys(FIELD_NORMALIZERS.values())}
    return first_of([(key.isin(*k), _OWN[n](value)) for n, k in keys.items()], norm_default(value))


def _fields(fields: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return fields.where(strip(F.col("field_value")) != "").select(*keys, "field_key", normalized(F.col("field_key"), F.col("field_value")).alias("normalized"))


def _plain(c: Column) -> Column:
    """Lower case in which a letter doesn't depend on those behind it: a sigma that ends a text stands inside a run of texts."""
    return F.replace(c, F.lit("ς"), F.lit("σ"))


def _located(blocks: DataFrame) -> DataFrame:
    """blocks with ends (least and greatest x and y of all points), rect (the ends as integers; zeros under four points) and centres."""
    if "bbox" in blocks.columns:
        points = F.filter("bbox", lambda p: F.size(p) >= 2)
        axis = [F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])]
        mean = lambda c: F.coalesce(F.aggregate(c, F.lit(0.0), lambda a, b: a + b) / F.nullif(F.size(c), F.lit(0)), F.lit(0.0))
        # Four whole points, as most have, need no arrays.
        corner = [F.get("bbox", F.lit(k)) for k in range(4)]
        four = (F.size("bbox") == 4) & reduce(lambda p, q: p & q, [F.coalesce(F.size(p) >= 2, F.lit(False)) for p in corner])
        own = [[F.get(p, F.lit(k)) for p in corner] for k in (0, 1)]
        of = lambda few, many: F.when(four, few).otherwise(many)
        ends = {f"{c}{n}": of(few(*own[k]), many(axis[k])) for n, few, many in ((1, F.least, F.array_min), (2, F.greatest, F.array_max)) for k, c in enumerate("xy")}
        centre = [of(F.coalesce((F.lit(0.0) + p[0] + p[1] + p[2] + p[3]) / 4, F.lit(0.0)), mean(c)) for p, c in zip(own, axis, strict=True)]
        out = blocks.withColumns({"ends": F.struct(*(v.alias(k) for k, v in ends.items())), "_whole": F.size("bbox") >= 4, "cx": centre[0], "cy": centre[1]})
    else:
        out = blocks.withColumns({"ends": F.struct(F.col("x_min").alias("x1"), F.col("y_min").alias("y1"), F.col("x_max").alias("x2"), F.col("y_max").alias("y2")), "_whole": F.lit(True), "cx": F.col("x_center"), "cy": F.col("y_center")})
    return out.withColumn("rect", F.when(F.col("_whole"), _rect(F.col("ends"))).otherwise(F.array(*[F.lit(0)] * 4)))


def _rect(ends: Column) -> Column:
    """[x1, y1, x2, y2], cut to integers; zeros without points."""
    return F.array(*(F.coalesce(ends[c].cast("int"), F.lit(0)) for c in ("x1", "y1", "x2", "y2")))


def _near(gap: float) -> list[Column]:
    """Whether b1, b2 and b3 continue the run of neighbours that begins with b0."""

    def near(a: str, b: str) -> Column:
        r, s = F.col(f"{a}.rect"), F.col(f"{b}.rect")
        beside, below = F.abs(s[0] - r[2]), F.abs(s[1] - r[3])
        return F.when(F.abs(F.col(f"{a}.cy") - F.col(f"{b}.cy")) < 30, beside).otherwise(below) <= gap

    each = [F.coalesce(near(f"b{k - 1}", f"b{k}"), F.lit(False)) for k in (1, 2, 3)]
    return [each[0], each[0] & each[1], each[0] & each[1] & each[2]]


def _run(value: Column) -> Column:
    """The first run of two to four neighbouring blocks, b0 being the first, whose text is the value: text, rect. Only those of its length are put together."""
    cases = []
    for k in (1, 2, 3):
        some = range(k + 1)
        text = F.concat(*(F.coalesce(F.col(f"b{m}.text"), F.lit("")) for m in some))
        side = lambda f, c: f(*(F.col(f"b{m}.ends.{c}") for m in some))  # noqa: E731, B023
        ends = F.struct(*(side(F.least if c.endswith("1") else F.greatest, c).alias(c) for c in ("x1", "y1", "x2", "y2")))
        fits = F.coalesce((F.length(value) == F.col(f"long{k}")) & (norm_default(text) == value), F.lit(False))
        cases.append(F.when(fits, F.struct(text.alias("text"), _rect(ends).alias("rect"))))
    return F.get(F.array_compact(F.array(*cases)), F.lit(0))


def _prepared(blocks: DataFrame, keys: tuple[str, ...], strategies: tuple[str, ...], gap: float) -> DataFrame:
    """A row a block: what each strategy asks of it, worked out before fields meet it. All windows read a document in one order."""
    out = _located(blocks).drop("bbox").withColumn("solid", norm_default(F.coalesce("text", F.lit(""))))
    kept, columns = [*keys, "ordinal", "text", "rect", "cy", "solid"], {}
    if "contains" in strategies:
        columns |= {"as_date": norm_date(F.col("text")), "as_code": norm_check_code(F.col("text"))}
    reading = Window.partitionBy(*keys).orderBy("cy", "cx", "ordinal")
    windows = {}
    if "context" in strategies:
        out = out.withColumn("_word", F.when(contains_any(F.lower("text"), TOTAL_WORDS), F.col("cy")))
        windows["_above"] = F.last("_word", ignorenulls=True).over(reading.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        windows["_below"] = F.expr(f"lead(_word) ignore nulls over (partition by {', '.join(f'`{k}`' for k in keys)} order by cy, cx, ordinal)")
        columns |= {"gap": F.least(F.col("cy") - F.col("_above"), F.col("_below") - F.col("cy")), "as_amount": norm_amount(F.coalesce("text", F.lit("")))}
    if "adjacent" in strategies:
        out = out.withColumn("b0", F.struct("text", "rect", "ends", "cy", F.length("solid").alias("n")))
        windows |= {"i": F.row_number().over(reading), **{f"b{k}": F.lead("b0", k).over(reading) for k in (1, 2, 3)}}
        kept += ["i", "b0", "b1", "b2", "b3"]
        columns |= {"plain": _plain(F.col("solid"))} | {f"long{k}": F.when(fits, sum((F.col(f"b{m}.n") for m in range(1, k + 1)), F.col("b0.n"))) for k, fits in enumerate(_near(gap), 1)}
    return (out.withColumns(windows) if windows else out).select(*kept, *(v.alias(k) for k, v in columns.items()))


def match(fields: DataFrame, blocks: DataFrame, strategies: tuple[str, ...] = STRATEGIES, least: float = 0.85, gap: float = 50.0, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """RESULT of each field that one of the strategies places, by the first that does. bbox is [x1, y1, x2, y2].

    context: a total amount's block of that amount; of several the one nearest to a total word within 50, else the lowest.
    exact: the first block whose text is the value. contains: the first that holds it, of four characters (two for party
    names); dates and check codes also by their own form, of four characters. fuzzy: the most similar block of half to twice
    the length. adjacent: two to four blocks, neighbours in reading order and no farther apart than `gap`, whose texts end
    to end are the value; the bbox is of all their points. The first is the one of the smallest ordinal.
    keys: what a document is, as doc_id and page for pages on their own; the result has them all.
    """
    key, value = F.col("field_key"), F.col("normalized")
    own_keys = (*keys, *_KEY)
    nothing = F.lit(False)
    # What a field asks is told before it meets blocks, too.
    asked = {"total": key == "totalAmount", "date": key == "invoiceDate", "code": key == "checkCode", "n": F.length(value), "within": F.length(value) >= F.when(key.isin("buyerName", "sellerName"), 2).otherwise(4), "plain": _plain(value)}
    wanted = _fields(fields, keys).withColumns({f"value_{k}": v for k, v in asked.items()})
    n, m = F.col("value_n"), F.length("solid")
    own = nothing
    if "contains" in strategies:
        own = (F.col("value_date") & (F.col("as_date") == value)) | (F.col("value_code") & (F.col("as_code") == value))
    fits = {
        "context": F.col("value_total") & (F.col("as_amount") == value) if "context" in strategies else nothing,
        "exact": F.col("solid") == value if "exact" in strategies else nothing,
        "contains": F.col("value_within") & (F.col("solid").contains(value) | F.coalesce(own, nothing)) if "contains" in strategies else nothing,
        # 2 * min / (n + m) bounds the similarity.
        "fuzzy": (n >= F.greatest(m, F.lit(1)) * 0.5) & (n <= F.greatest(m, F.lit(1)) * 2) & (2 * F.least(n, m) >= (n + m) * least) if "fuzzy" in strategies else nothing,
    }
    early = first_of([(fits[s], F.lit(k)) for k, s in enumerate(STRATEGIES[:3])], F.lit(None).cast("int"))
    run, long = F.lit(None).cast("struct<text:string,rect:array<int>>"), nothing
    if "adjacent" in strategies:
        run, long = _run(value), F.coalesce(n.isin(*(F.col(f"long{k}") for k in (1, 2, 3))) & F.startswith("value_plain", F.col("plain")), nothing)
    # Pages first, as they are the cheapest to tell; runs by their length and first block, as each pair of field and block is asked.
    pairs = meets(_prepared(blocks, keys, strategies, gap), wanted, keys, also=early.isNotNull() | fits["fuzzy"] | long)
    told = pairs.withColumns({"early": early, "like": fits["fuzzy"]})
    # Similarity and runs are worked out for the fields that the first three leave.
    field = Window.partitionBy(*own_keys)
    told = told.withColumns({"_first": F.min("early").over(field), "_n": F.sum((F.col("early") == 0).cast("int")).over(field)})
    told = told.withColumn("run", F.when(F.col("_first").isNull(), run)).where("early = _first or (_first is null and (like or run is not null))")
    told = told.withColumn("r", ratio(F.when(F.col("like") & F.col("_first").isNull(), value), F.col("solid"), least) if "fuzzy" in strategies else F.lit(None).cast("double"))

    def found(kind: int, order: tuple, confidence: Column, ordinal="ordinal", text=F.col("text"), rect=F.col("rect")) -> Column:  # noqa: B008
        return F.struct(F.lit(kind).alias("kind"), order[0].cast("int").alias("o1"), order[1].cast("double").alias("o2"), F.col(ordinal).alias("ordinal"), text.alias("snippet"), rect.alias("bbox"), confidence.cast("double").alias("confidence"))

    zero = F.lit(0)
    cases = []
    if "context" in strategies:
        close = F.coalesce(F.col("gap") < 50, nothing)
        sure = F.when(F.col("_n") == 1, 0.9).when(close, 0.95).otherwise(0.8)
        cases.append(F.when(F.col("early") == 0, found(0, (~close, F.when(close, F.col("gap")).otherwise(-F.col("cy"))), sure)))
    cases += [F.when(F.col("early") == k, found(k, (zero, zero), F.lit(c))) for k, c in ((1, 1.0), (2, 0.9))]
    cases.append(F.when(F.col("r").isNotNull() & (F.col("r") > 0), found(3, (zero, -F.col("r")), F.col("r"))))
    if "adjacent" in strategies:
        cases.append(F.when(F.col("run").isNotNull() & F.col("_first").isNull(), found(4, (zero, F.col("i")), F.lit(0.85), text=F.col("run.text"), rect=F.col("run.rect"))))
    best = told.select(*own_keys, F.array_min(F.array_compact(F.array(*cases))).alias("m")).groupBy(*own_keys).agg(F.min("m").alias("m")).where("m is not null")
    names = F.array(*(F.lit(s) for s in STRATEGIES))
    return best.select(*own_keys, F.col("m.ordinal").alias("ordinal"), F.col("m.snippet").alias("snippet"), F.col("m.bbox").alias("bbox"), F.col("m.confidence").alias("confidence"), F.get(names, F.col("m.kind")).alias("match_type"))


def context(fields: DataFrame, blocks: DataFrame) -> DataFrame:
    return match(fields, blocks, ("context",))


def exact(fields: DataFrame, blocks: DataFrame) -> DataFrame:
    return match(fields, blocks, ("exact",))


def contains(fields: DataFrame, blocks: DataFrame) -> DataFrame:
    return match(fields, blocks, ("contains",))


def fuzzy(fields: DataFrame, blocks: DataFrame, least: float = 0.85) -> DataFrame:
    return match(fields, blocks, ("fuzzy",), least=least)


def adjacent(fields: DataFrame, blocks: DataFrame, gap: float = 50.0) -> DataFrame:
    return match(fields, blocks, ("adjacent",), gap=gap)


def cascade(fields: DataFrame, blocks: DataFrame) -> DataFrame:
    return match(fields, blocks)
