"""Readers and writers of the engine's tables: messages, blocks, rules, raw files, results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_SCHEMA = "doc_id bigint, page int, ordinal bigint, text string, confidence double, bbox array<array<double>>"
MESSAGE_SCHEMA = "message_id string, data map<string,string>"
RULE_SCHEMA = "id string, rule_type string, pattern string, replacement string, doc_type string, field_name string, priority int, is_enabled boolean, ordinal int"


def blocks(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).format(kind).load(path)


def rules(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Rules of unknown type are left out, as a catalogue with one bad entry still loads."""
    return spark.read.schema(RULE_SCHEMA).format(kind).load(path).where(F.col("rule_type").isin("regex", "dict", "template", "fuzzy", "normalize", "validate"))


def message_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """New message files (JSON lines) in the order of their arrival; offsets are the query's checkpoint."""
    return spark.readStream.schema(MESSAGE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def files(spark: SparkSession, path: str, recognise: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Images and documents as binary rows; `recognise` turns them into model pages (rec_texts, rec_scores, dt_polys)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return recognise(raw) if recognise else raw


def write_results(envelopes: DataFrame, path: str, mode: str = "append") -> None:
    envelopes.write.mode(mode).json(path)


def clear(spark: SparkSession, path: str, kind: str = "parquet") -> int:
    """Empties a table, as of dead letters; how many rows it had. Its schema stays."""
    table = spark.read.format(kind).load(path)
    count, schema = table.count(), table.schema
    spark.createDataFrame([], schema).write.mode("overwrite").format(kind).save(path)
    return count
