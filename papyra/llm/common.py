"""Helpers shared by the training-data operators: Arrow mapping, work folders, connected components."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step handles; longer texts are steps of their own.
STEP_BYTES = 1 << 20


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder that the session names; /tmp/checkpoints where a local session names none."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/checkpoints"
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/papyra/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it back: the lineage ends there, whichever executor is lost."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a table of the shared folder that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def _release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives free memory back to the system at its end: Python workers stay for later tasks and stages."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _release()

    return held


def arrow_map(df: DataFrame, step: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow of a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from step(batch)

    return df.mapInArrow(freed(run), schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = min(max(end, start + 1), rows)
        yield start, end
        start = end


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def ranked(df: DataFrame, group: str, order: tuple[str, ...], name: str, running: str | None = None) -> DataFrame:
    """df, written to the shared folder, with _index long (a row's place in its group by order, from 0) and _size long
    (the group's rows); with running, a long column without nulls, also _before (its sum over earlier rows of the group)
    and _whole (over the group). Nulls of group are one group.

    Rows are dealt by ranges of (group, order), equal rows by their place in the input, so that a group of any size
    spreads; a row's place is its place among its partition's rows plus the counts of earlier partitions, of which there
    is one row for each group of a partition.
    """
    spread = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [group, *order, "_tie"]
    rows = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    if running:
        schema = T.StructType([*rows.schema.fields, T.StructField("_sum", T.LongType())])

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for b in batches:
                ends = total + np.cumsum(np.asarray(b.column(b.schema.get_field_index(running)), np.int64))
                values = np.concatenate(([total], ends[:-1])) if len(ends) else ends
                total = int(ends[-1]) if len(ends) else total
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.int64())], names=[*b.schema.names, "_sum"])

        rows = rows.mapInArrow(freed(summed), schema)
    table = stored(rows.withColumn("_m", F.monotonically_increasing_id()), name).withColumn("_part", F.shiftright("_m", 33))
    sums = [F.min("_sum").alias("_sum0"), F.sum(running).alias("_all")] if running else []
    parts = table.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_of")).agg(F.min("_m").alias("_m0"), F.count("*").alias("_n"), *sums)
    whole = Window.partitionBy("_group")
    earlier = whole.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"_offset": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "_size": F.sum("_n").over(whole)})
    if running:
        parts = parts.withColumns({"_offset_sum": F.coalesce(F.sum("_all").over(earlier), F.lit(0)), "_whole": F.sum("_all").over(whole)})
    j = table.join(parts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    extra = [(F.col("_sum") - F.col("_sum0") + F.col("_offset_sum")).alias("_before"), "_whole"] if running else []
    return j.select(*df.columns, (F.col("_m") - F.col("_m0") + F.col("_offset")).alias("_index"), "_size", *extra)


def numbered(df: DataFrame, name: str, number: str) -> DataFrame:
    """df, written to the shared folder, with dense numbers from 0; the offsets of its partitions are a row a partition."""
    table = stored(df.withColumn("_m", F.monotonically_increasing_id()), name).withColumn("_part", F.shiftright("_m", 33))
    parts = table.groupBy(F.col("_part").alias("_of")).count()
    before = Window.partitionBy(F.lit(0)).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_of", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    j = table.join(F.broadcast(offsets), F.col("_part") == F.col("_of"))
    return j.select(*df.columns, (F.col("_m") - F.shiftleft("_part", 33) + F.col("_offset")).alias(number))


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges (a, b of one ordered type): rows (id, component), component the smallest id reachable.

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
    Beyond", 2014) until no edge changes; each lowers labels or leaves all as they are, so it ends. Each step groups
    by node with partial aggregation, its joins are plain equi-joins that adaptive execution can split, and each round
    is a table in the shared folder that goes once the next is written. Empty edges give no rows.
    """
    spark = edges.sparkSession

    def written(df: DataFrame) -> tuple[DataFrame, str]:
        path = work_folder(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    now, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).distinct()
        before = path
        now, path = written(small)
        dropped(spark, before)
        figures = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first())
        if figures == seen:
            break
        seen = figures
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
