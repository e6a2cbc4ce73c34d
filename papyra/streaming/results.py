"""A sink of results with two-phase commit: each result once in the table, however often its batch is written.

Tasks write their rows to files of fresh names; the driver's commit names those of a batch in one manifest, which is what makes
them part of the table. A batch that is written again, as after a stop between this commit and the query's own, finds its
manifest and drops its new files. Rows also go to a callback, if there is one, at least once; a row has arrived if either took
it, so a task fails only if its file can't be written and a callback has failed as well. The folder must be one that
all executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    """A task's file (none if only the callback took its rows), its rows, and the rows that the callback didn't take."""

    file: str | None
    rows: int
    missed: int


class ResultWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, post: Callable[[dict], None] | None):
        self.path, self.post = path.rstrip("/"), post

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = self._store()
        name, rows, missed, error, out = f"{uuid.uuid4().hex}.parquet", 0, 0, None, None
        for batch in iterator:
            rows += len(batch)
            if error is None:
                try:
                    if out is None:
                        store.create_dir(f"{root}/data", recursive=True)
                        out = pq.ParquetWriter(f"{root}/data/{name}", batch.schema, filesystem=store)
                    out.write_batch(batch)
                except OSError as e:
                    error = e
            if self.post is not None:
                for row in batch.to_pylist():
                    try:
                        self.post(row)
                    except Exception:
                        missed += 1
        if out is not None and error is None:
            try:
                out.close()
            except OSError as e:
                error = e
        if error is not None and (self.post is None or missed):
            raise error
        return Written(name if out is not None and error is None else None, rows, missed)

    def _drop(self, messages: list[Written | None]) -> None:
        store, root = self._store()
        for m in messages:
            if m is not None and m.file and store.get_file_info(f"{root}/data/{m.file}").type != fs.FileType.NotFound:
                store.delete_file(f"{root}/data/{m.file}")

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        store, root = self._store()
        store.create_dir(f"{root}/committed", recursive=True)
        manifest = f"{root}/committed/{batchId:012}.json"
        if store.get_file_info(manifest).type != fs.FileType.NotFound:
            self._drop(messages)
            return
        taken = [m for m in messages if m is not None]
        body = {"batch": batchId, "files": [m.file for m in taken if m.file], "rows": sum(m.rows for m in taken), "missed": sum(m.missed for m in taken)}
        unnamed = f"{root}/committed/.{uuid.uuid4().hex}"
        with store.open_output_stream(unnamed) as out:
            out.write(json.dumps(body).encode())
        store.move(unnamed, manifest)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self._drop(messages)


def register(spark: SparkSession, post: Callable[[dict], None] | None = None, name: str = "results") -> str:
    """Makes the sink known as a format; post takes a row as a dict and raises if it couldn't be delivered."""

    class Results(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def streamWriter(self, schema, overwrite: bool) -> ResultWriter:  # noqa: N802
            return ResultWriter(self.options["path"], post)

    spark.dataSource.register(Results)
    return name


def committed(spark: SparkSession, path: str) -> DataFrame:
    """A row a batch: batch, files, rows, missed."""
    return spark.read.schema("batch bigint, files array<string>, rows bigint, missed bigint").json(f"{path.rstrip('/')}/committed")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The results of all committed batches. The files' names are listed on the driver, as those of any table are."""
    names = [r.file for r in committed(spark, path).select(F.explode("files").alias("file")).toLocalIterator()]
    return spark.read.schema(schema).parquet(*(f"{path.rstrip('/')}/data/{n}" for n in names)) if names else spark.createDataFrame([], schema)
