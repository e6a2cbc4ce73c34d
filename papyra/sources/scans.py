"""Files of pages, read and recognised page by page in tasks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages of a file that one task reads.
RUN = 8
_PAGES = "task_id string, page int, width double, height double, rec_texts array<string>, rec_scores array<double>, dt_polys array<array<array<double>>>, error_class string, error string"
_TYPES = pa.schema([("task_id", pa.string()), ("page", pa.int32()), ("width", pa.float64()), ("height", pa.float64()), ("rec_texts", pa.list_(pa.string())), ("rec_scores", pa.list_(pa.float64())),
                    ("dt_polys", pa.list_(pa.list_(pa.list_(pa.float64())))), ("error_class", pa.string()), ("error", pa.string())])


class TaskCancelled(Exception):
    """The task's token is there."""


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _there(path: str) -> bool:
    where, own = _at(path)
    return where.get_file_info(own).type == fs.FileType.File


def read(path: str | None) -> bytes:
    """A file's bytes, from any file system that Arrow knows; FileNotFoundError if there is none."""
    if not path or not _there(path):
        raise FileNotFoundError(f"no such file: {path}")
    where, own = _at(path)
    with where.open_input_stream(own) as file:
        return file.read()


def _token(folder: str, task_id: str) -> str:
    return f"{folder}/{quote(task_id, safe='')}"


def cancel(folder: str, task_id: str) -> None:
    """Leaves a task's token in a folder that all executors see: its pages that aren't recognised yet stay so."""
    where, own = _at(_token(folder, task_id))
    where.create_dir(own.rsplit("/", 1)[0])
    where.open_output_stream(own).close()


def single(content: bytes) -> Sequence[bytes]:
    """A file that is one page, as an image is."""
    return [content]


def scan(
    tasks: DataFrame,
    recognise: Callable[[bytes], dict],
    open_pages: Callable[[bytes], Sequence[bytes]] = single,
    cancelled: str | None = None,
    seconds: float = 300.0,
    run: int = RUN,
) -> DataFrame:
    """task_id, page (from 1), width, height, rec_texts, rec_scores, dt_polys, error_class, error: a row for each page of each task.

    tasks: task_id, file_path, or task_id, content. open_pages gives a file's pages, which it may make as they are asked for;
    recognise gives a page's rec_texts, rec_scores, dt_polys, width and height. A file is dealt in runs of pages, so that a
    long one goes to several tasks, each of which opens it and holds a page at a time. Between pages a task looks for its
    token in the folder `cancelled` and at the time its run took. A file that is missing, can't be opened or can't be
    recognised, a token and lack of time end the run by a row with error_class and error, the page where it stopped (null
    before the first). A file without pages is a row without page and error. Rows are costly: write them before `pages` and
    `outcomes` read them.
    """
    inline = "content" in tasks.columns
    source = "content" if inline else "file_path"

    def opened(value) -> Sequence[bytes]:
        return open_pages((value or b"") if inline else read(value))

    counts = pa.schema([("task_id", pa.string()), (source, pa.binary() if inline else pa.string()), ("n_pages", pa.int32()), ("error_class", pa.string()), ("error", pa.string())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = [task, value, 0, None, None]
                try:
                    if cancelled and _there(_token(cancelled, task)):
                        raise TaskCancelled("cancelled before it began")
                    row[2] = len(opened(value))
                except Exception as error:
                    row[1], row[3], row[4] = None, type(error).__name__, str(error)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, counts, strict=True)], schema=counts)

    def work(task: str, value, first: int, last: int) -> Iterator[pa.RecordBatch]:
        begun, page = time.monotonic(), None
        try:
            found = opened(value)
            for page in range(first, last + 1):
                if cancelled and _there(_token(cancelled, task)):
                    raise TaskCancelled("cancelled between pages")
                if time.monotonic() - begun > seconds:
                    raise TimeoutError(f"over {seconds:g} seconds")
                yield one(task, page, recognise(found[page - 1]))
        except Exception as error:
            yield one(task, page, {"error_class": type(error).__name__, "error": str(error)})

    def one(task: str, page: int | None, found: dict) -> pa.RecordBatch:
        row = {**found, "task_id": task, "page": page}
        return pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in _TYPES], schema=_TYPES)

    kind = "binary" if inline else "string"
    files = tasks.select(F.col("task_id").cast("string").alias("task_id"), F.col(source).cast(kind).alias(source))
    counted = files.mapInArrow(count, f"task_id string, {source} {kind}, n_pages int, error_class string, error string")
    # One row a run, and one of its own for what has no page, so that files are opened once to be counted.
    starts = F.when(F.col("n_pages") > 0, F.sequence(F.lit(1), F.col("n_pages"), F.lit(run))).otherwise(F.array(F.lit(0)))
    runs = counted.withColumn("first", F.explode(starts)).withColumn("last", F.least(F.col("first") + run - 1, F.col("n_pages")))
    dealt = runs.repartition("task_id", "first").select("task_id", source, "first", "last", "error_class", "error")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task, value, first, last, *error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first:
                    yield from work(task, value, first, last)
                else:
                    yield one(task, None, dict(zip(("error_class", "error"), error, strict=True)))

    return dealt.mapInArrow(each, _PAGES)


def outcomes(scanned: DataFrame) -> DataFrame:
    """task_id, status (done, failed, cancelled), page_count, error_class, error: a row for each task; of several errors, the first page's.

    error_class is what `tasks.failure_route` reads: a missing file isn't tried again.
    """
    failed = F.col("error_class").isNotNull()
    first = F.min(F.when(failed, F.struct("page", "error_class", "error")))
    each = scanned.groupBy("task_id").agg(first.alias("e"), F.count_if(F.col("page").isNotNull() & ~failed).cast("int").alias("page_count"))
    status = F.when(F.col("e").isNull(), "done").when(F.col("e.error_class") == TaskCancelled.__name__, "cancelled").otherwise("failed")
    return each.select("task_id", status.alias("status"), "page_count", "e.error_class", "e.error")


def pages(scanned: DataFrame) -> DataFrame:
    """Pages of the tasks that are done, for `ingest.blocks_from_model`: a task that failed or was cancelled has no result."""
    done = outcomes(scanned).where("status = 'done'").select("task_id")
    return scanned.where("page is not null").join(done, "task_id", "left_semi").drop("error_class", "error")
