"""Streams: the committed sink, results in state, rules that change, progress."""

import glob
import json
import os
import time

import pytest

from papyra.operators.rules import RULE_SCHEMA
from papyra.sources.rule_cache import RuleCache
from papyra.streaming import answers, live, results
from papyra.streaming.task_stream import run_batches

RESULT = "task_id string, body string"


@pytest.fixture(autouse=True)
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def add(folder, rows, name=None):
    """A file of JSON rows that appears at once."""
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name or len(os.listdir(folder))}.json"
    with open(f"{folder}/.part", "w") as f:
        f.write("\n".join(map(json.dumps, rows)))
    os.rename(f"{folder}/.part", path)


def start(stream, form, path, checkpoint):
    return stream.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def test_results_are_committed_once(spark, tmp_path):
    """A query that stops between the sink's commit and its own writes the batch again; the table has it once."""
    form, out, cp = results.register(spark), f"file://{tmp_path}/out", f"{tmp_path}/cp"
    for k in range(3):
        add(f"{tmp_path}/in", [{"task_id": f"t{k}{i}", "body": "x"} for i in range(4)])
    stream = spark.readStream.schema(RESULT).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    start(stream, form, out, cp).awaitTermination()
    want = sorted(f"t{k}{i}" for k in range(3) for i in range(4))
    assert sorted(r.task_id for r in results.read(spark, out, RESULT).collect()) == want
    for name in (f"{cp}/commits/2", f"{cp}/commits/.2.crc"):
        if os.path.exists(name):
            os.remove(name)
    start(stream, form, out, cp).awaitTermination()
    assert sorted(r.task_id for r in results.read(spark, out, RESULT).collect()) == want
    files = {f for r in results.committed(spark, out).collect() for f in r.files}
    assert {os.path.basename(f) for f in glob.glob(f"{tmp_path}/out/data/*.parquet")} == files


def test_a_result_has_arrived_if_either_took_it(spark, tmp_path):
    """A callback that fails is counted; a file that can't be written is an error only if the callback fails too."""
    log = f"{tmp_path}/posted"

    def post(row):
        if row["body"] == "refused":
            raise OSError("refused")
        with open(log, "a") as f:
            f.write(row["task_id"] + "\n")

    add(f"{tmp_path}/in", [{"task_id": "a", "body": "x"}, {"task_id": "b", "body": "refused"}])
    stream = spark.readStream.schema(RESULT).json(f"{tmp_path}/in")
    form = results.register(spark, post, "results_posted")
    start(stream, form, f"file://{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.task_id for r in results.read(spark, f"file://{tmp_path}/out", RESULT).collect()) == ["a", "b"]
    assert open(log).read().split() == ["a"] and [r.missed for r in results.committed(spark, f"file://{tmp_path}/out").collect()] == [1]
    with open(f"{tmp_path}/closed", "w"):
        pass  # a file where the folder should be
    writer = results.ResultWriter(f"file://{tmp_path}/closed", post)
    import pyarrow as pa

    batch = lambda body: iter([pa.RecordBatch.from_pylist([{"task_id": "c", "body": body}])])
    assert writer.write(batch("x")) == results.Written(None, 1, 0)
    with pytest.raises(OSError):
        writer.write(batch("refused"))


def test_answers_from_state(spark, tmp_path):
    """Known results answer, new ones from then on; an empty one is none; after its time to live a result is gone."""
    asked, made = f"{tmp_path}/asked", f"{tmp_path}/made"
    os.makedirs(made)
    add(asked, [{"content": "old", "task_id": "1"}, {"content": "new", "task_id": "2"}])
    requests = spark.readStream.schema("content string, task_id string").json(asked)
    done = spark.readStream.schema("content string, body string").json(made)
    known = spark.createDataFrame([("old", "O"), ("void", "")], "content string, body string")
    out = answers.answers(requests, done, known, ttl=20_000)
    query = out.writeStream.format("memory").queryName("answered").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="100 milliseconds").start()

    def told(*tasks):
        """The answers to these tasks; timers make batches without end, so the query is never idle."""
        until = time.time() + 60
        while time.time() < until and query.isActive:
            got = {r.task_id: (r.hit, r.body) for r in spark.table("answered").collect() if r.task_id in tasks}
            if len(got) == len(tasks):
                return got
            time.sleep(0.2)
        raise AssertionError(query.exception())

    try:
        assert told("1", "2") == {"1": (True, "O"), "2": (False, None)}
        add(made, [{"content": "new", "body": "N"}, {"content": "void", "body": ""}])
        add(asked, [{"content": "mark", "task_id": "m"}])
        told("m")
        time.sleep(1.5)
        add(asked, [{"content": "new", "task_id": "3"}, {"content": "void", "task_id": "4"}, {"content": "new", "task_id": "5"}])
        assert told("3", "4", "5") == {"3": (True, "N"), "4": (False, None), "5": (True, "N")}
        time.sleep(20)
        add(asked, [{"content": "new", "task_id": "6"}, {"content": "old", "task_id": "7"}])
        assert told("6", "7") == {"6": (False, None), "7": (False, None)}
    finally:
        query.stop()


def test_rules_that_change_while_a_stream_runs(spark, tmp_path):
    """A rule that is added between two batches works in the second only, and the rows say by which rules."""
    own = [("own1", "dict", "a", "b", "ALL", None, 1, True, 0)]
    now = [0.0]
    cache = RuleCache(spark, lambda session: session.createDataFrame(own, RULE_SCHEMA), ttl=10.0, clock=lambda: now[0])
    schema = "doc_id long, doc_type string, field_name string, value string"
    os.makedirs(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    sink = lambda out, n: out.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}")
    for k in range(2):
        add(f"{tmp_path}/in", [{"doc_id": k, "doc_type": "INVOICE", "field_name": "f", "value": "a c"}])
        run_batches(stream, live.correcting(cache), sink, f"{tmp_path}/cp", typed=lambda values: values).awaitTermination()
        own.append(("own2", "dict", "c", "d", "ALL", None, 1, True, 1))
        now[0] += 11.0
    got = {r.doc_id: r for r in spark.read.parquet(*(f"{tmp_path}/out/{k}" for k in range(2))).collect()}
    assert (got[0].value, [e.rule_id for e in got[0].applied]) == ("b c", ["own1"])
    assert (got[1].value, [e.rule_id for e in got[1].applied]) == ("b d", ["own1", "own2"])
    assert got[0].rules_version.startswith("1-") and got[1].rules_version.startswith("2-")


def test_progress_of_a_query(spark, tmp_path):
    """Each micro-batch of a running query sends its counts; what sending raises stops nothing."""
    for k in range(2):
        add(f"{tmp_path}/in", [{"task_id": f"{k}{i}", "body": "x" * i} for i in range(5)])
    sent = []

    def send(event):
        sent.append(event)
        raise OSError("no receiver")

    listener = live.Progress(send, "tasks", total=10)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(RESULT).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
        from pyspark.sql import functions as F

        watched = live.observed(stream, "tasks", empty=F.col("body") == "")
        query = watched.writeStream.format("noop").queryName("extraction").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        until = time.time() + 20
        while time.time() < until and len(sent) < 3:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert [(e["taskId"], e["progress"], e["message"]) for e in sent[:2]] == [("extraction", "50", "rows 5, empty 1"), ("extraction", "100", "rows 5, empty 1")]
    assert sent[2]["progress"] == "100" and sent[2]["message"] == "ended after 10 rows" and isinstance(listener.error, OSError)
