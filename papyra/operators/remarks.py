"""Remarks of documents from their text and, where it names none, from the place of their blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.remark import finished, raw_remark, remark_parts
from ..functions.text import FLAGS, strip

#: Units that the text behind a lone label may stand below it, and the confidence of a remark that the text names.
NEAR, CONFIDENCE = 50.0, 0.7


def positional_remark(blocks: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, part, confidence: what stands beside the first label in the lower half of a document's blocks.

    Blocks go by (y_min, ordinal). A label's own block counts if it holds more than the label, else the next block if its
    top is less than NEAR away; a label with neither is passed over.
    """
    whole = Window.partitionBy(*keys)
    w = whole.orderBy("y_min", "ordinal")
    after = F.struct("text", "confidence", "y_min")
    placed = blocks.select(*keys, "ordinal", "text", "confidence", "y_min").withColumns({"k": F.row_number().over(w), "n": F.count("*").over(whole), "next": F.lead(after).over(w)})
    label = F.replace("text", F.lit(" "), F.lit("")).contains("备注") | F.col("text").rlike(FLAGS + r"备\s*注")
    rest = F.regexp_replace("text", FLAGS + r"^.*?备\s*注[：:]?\s*", "")
    near = F.abs(F.col("next.y_min") - F.col("y_min")) < NEAR
    found = F.when(F.length(rest) > 1, F.struct(strip(rest).alias("part"), F.col("confidence").alias("confidence")))
    found = F.coalesce(found, F.when(near, F.struct(strip(F.col("next.text")).alias("part"), F.col("next.confidence").alias("confidence"))))
    lower = placed.where((F.col("k") > F.floor(F.col("n") / 2)) & label).select(*keys, "k", found.alias("f")).where("f is not null")
    return lower.groupBy(*keys).agg(F.min_by("f", "k").alias("f")).select(*keys, "f.part", "f.confidence")


def extract_remark(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, remark, confidence of documents that have one: the labelled parts of the text, each once; without any, the
    positional part; without that, what follows the label."""
    named = docs.select("doc_id", remark_parts(F.col("full_text")).alias("parts"), raw_remark(F.col("full_text")).alias("raw"))
    beside = positional_remark(blocks)
    joined = named.join(beside, "doc_id", "left")
    own = F.size("parts") > 0
    parts = F.when(own, F.col("parts")).when(F.col("part").isNotNull(), F.array("part")).otherwise(F.array().cast("array<string>"))
    confidence = F.when(~own & F.col("part").isNotNull(), F.col("confidence")).otherwise(F.lit(CONFIDENCE))
    return joined.select("doc_id", F.coalesce(finished(parts), "raw").alias("remark"), confidence.alias("confidence")).where("remark is not null")
