"""Files read page by page."""

import pytest

from papyra.operators.ingest import blocks_from_model, merge_pages
from papyra.operators.tasks import failure_route
from papyra.sources import scans


def _lines(page: bytes) -> dict:
    if page == b"broken":
        raise ValueError("can't be read")
    words = page.decode().split()
    return {"rec_texts": words, "rec_scores": [0.5] * len(words), "dt_polys": [[[1.0, 2.0]] * 4] * len(words), "width": 3.0, "height": 4.0}


def _open(content: bytes) -> list[bytes]:
    return content.split(b"|") if content else []


@pytest.mark.parametrize("run", [1, 2, 100])
def test_pages_of_files(spark, tmp_path, run):
    from pyspark.sql import functions as F

    files = {"a": "one two|three", "long": "|".join(f"p{k}" for k in range(7)), "none": "", "bad": "fine|broken|rest", "stopped": "x|y"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    rows = [(name, f"file://{tmp_path}/{name}" if name == "a" else f"{tmp_path}/{name}") for name in files]
    rows += [("missing", f"{tmp_path}/nowhere"), ("folder", str(tmp_path)), ("blank", ""), ("null", None)]
    scans.cancel(f"{tmp_path}/tokens", "stopped")
    tasks = spark.createDataFrame(rows, "task_id string, file_path string")
    scans.scan(tasks, _lines, _open, f"{tmp_path}/tokens", run=run).write.parquet(f"{tmp_path}/scanned")
    scanned = spark.read.parquet(f"{tmp_path}/scanned")
    ended = {r.task_id: r for r in scans.outcomes(scanned).collect()}
    assert {k: (r.status, r.error_class) for k, r in ended.items()} == {
        "a": ("done", None), "long": ("done", None), "none": ("done", None), "bad": ("failed", "ValueError"), "stopped": ("cancelled", "TaskCancelled"),
    } | {k: ("failed", "FileNotFoundError") for k in ("missing", "folder", "blank", "null")}
    assert ended["a"].page_count == 2 and ended["long"].page_count == 7 and ended["none"].page_count == 0
    sent = failure_route(scans.outcomes(scanned).where("status = 'failed'").withColumn("retry", F.lit(0)))
    assert {r.task_id: r.outcome for r in sent.collect()} == {"bad": "retry"} | dict.fromkeys(("missing", "folder", "blank", "null"), "dlq")
    blocks, documents = merge_pages(blocks_from_model(scans.pages(scanned).withColumnRenamed("task_id", "doc_id")))
    assert [(r.page, r.line_index, r.text) for r in blocks.where("doc_id = 'a'").orderBy("line_index").collect()] == [(1, 0, "one"), (1, 1, "two"), (2, 2, "three")]
    whole = {r.doc_id: r.full_text for r in documents.collect()}
    assert set(whole) == {"a", "long"} and whole["a"] == "--- Page 1 ---\none\ntwo\n--- Page 2 ---\nthree"


def test_scan_stops_between_pages(spark, tmp_path):
    """A token that comes while a file is read, and a lack of time, keep the pages behind from being recognised."""
    folder = f"{tmp_path}/tokens"

    def slow(page: bytes) -> dict:
        import time

        if page == b"p1":
            scans.cancel(folder, "t/1")
        time.sleep(0.2)
        return {"rec_texts": [page.decode()]}

    tasks = spark.createDataFrame([("t/1", bytearray(b"p0|p1|p2|p3"))], "task_id string, content binary")
    ends = sorted(scans.scan(tasks, slow, _open, folder).collect(), key=lambda r: r.page)
    assert [(r.page, r.error_class) for r in ends] == [(1, None), (2, None), (3, "TaskCancelled")]
    late = sorted(scans.scan(tasks, slow, _open, seconds=0.3).collect(), key=lambda r: r.page)
    assert [(r.page, r.error_class) for r in late] == [(1, None), (2, None), (3, "TimeoutError")]


def test_scan_of_nothing(spark):
    empty = spark.createDataFrame([], "task_id string, file_path string")
    assert scans.scan(empty, _lines).count() == 0
