"""The task life cycle as Structured Streaming.

`run_batches` runs the caller's work on each micro-batch. `run_tasks` keeps each task in state and executes it by itself:
a failed one is tried again by a processing-time timer once its backoff has passed, until MAX_RETRY; then it is a dead
letter. `retries` only follows the attempts that another system makes. Nothing is fed back into the source. A consumer
group is a checkpoint folder (`ensure_group`, `destroy_group`).
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.tasks import MAX_RETRY, RETRY_BASE, RETRY_CAP, parse, route

ATTEMPT = "task_id string, message_id string, failed boolean, error string"
TRANSITION = "task_id string, state string, executions int, error string"
#: Milliseconds for which an ended task is remembered, so that its message's redelivery does nothing.
REMEMBER = 24 * 3600 * 1000


class TaskCancelled(RuntimeError):
    """The work was cancelled, or took longer than its time."""


def parsed(messages: DataFrame) -> DataFrame:
    """Typed and routed messages of a batch or a stream; those without a task id are dropped."""
    return route(parse(messages)).where("route <> 'drop'")


def ensure_group(spark: SparkSession, path: str) -> bool:
    """Makes a consumer group, the checkpoint folder that a query reads from the start with; False if it is there already."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return not files.exists(where) and files.mkdirs(where)


def destroy_group(spark: SparkSession, path: str) -> bool:
    """Forgets a consumer group: the next query starts from the first message. False if there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cancellable(spark: SparkSession, work: Callable[[], object], seconds: float, cancelled: threading.Event | None = None):
    """work's result; its Spark jobs are cancelled, and TaskCancelled raised, after so many seconds or once `cancelled` is set."""
    tag, context, done = f"papyra-{uuid.uuid4().hex}", spark.sparkContext, threading.Event()
    stop = cancelled or threading.Event()
    late = threading.Timer(seconds, stop.set)

    def watch() -> None:
        while not done.wait(0.05):
            if stop.is_set():
                context.cancelJobsWithTag(tag)

    if stop.is_set():
        raise TaskCancelled("cancelled before it began")
    context.addJobTag(tag)
    late.start()
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        out = work()
    except Exception as error:
        if stop.is_set():
            raise TaskCancelled("cancelled, or over its time") from error
        raise
    finally:
        done.set()
        late.cancel()
        context.removeJobTag(tag)
    if stop.is_set():
        raise TaskCancelled("cancelled, or over its time")
    return out


def either(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A sink that hands each batch to all sinks; it has arrived if one took it, else the last error is raised."""

    def send(batch: DataFrame, number: int) -> None:
        errors = []
        for sink in sinks:
            try:
                sink(batch, number)
            except Exception as error:
                errors.append(error)
        if sinks and len(errors) == len(sinks):
            raise errors[-1]

    return send


def run_batches(messages: DataFrame, work: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, failed: Callable[[DataFrame, int, str], None] | None = None, typed: Callable[[DataFrame], DataFrame] = parsed):
    """Runs work on each micro-batch, whose rows `typed` makes tasks, and hands its result with the batch's number to an idempotent sink.

    A batch counts as acknowledged once the sink has returned, so delivery is at least once. If work or sink fails, the
    batch's tasks go with the error's text to `failed`; without it the query ends with the error.
    """

    def each(batch: DataFrame, number: int) -> None:
        tasks = typed(batch)
        try:
            sink(work(tasks), number)
        except Exception as error:
            if failed is None:
                raise
            failed(tasks, number, f"{type(error).__name__}: {error}")

    return messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RetryMachine(StatefulProcessor):
    """State of each task: executions so far, and whether it has ended; forgotten `remember` milliseconds after its last attempt, if given."""

    def __init__(self, remember: int | None):
        self.remember = remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "executions int, ended boolean", self.remember)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, ended = self.seen.get() if self.seen.exists() else (0, False)
        for frame in rows:
            if ended or frame.empty:
                continue
            executions = np.arange(n + 1, n + 1 + len(frame))
            state = np.where(~frame["failed"].to_numpy(bool), "done", np.where(executions > MAX_RETRY, "dlq", "retry"))
            last = np.flatnonzero(state != "retry")[:1]  # what comes behind the end of a task changes nothing
            ended, upto = bool(len(last)), last[0] + 1 if len(last) else len(frame)
            n = int(executions[upto - 1])
            yield pd.DataFrame({"task_id": key[0], "state": state[:upto], "executions": executions[:upto], "error": frame["error"].iloc[:upto].to_numpy()})
        self.seen.update((n, ended))

    def close(self) -> None:
        pass


class TaskMachine(StatefulProcessor):
    """Executes each task, and again by a timer after a failure's backoff; what has ended is forgotten after `remember`."""

    def __init__(self, work: Callable[[dict], None], permanent: tuple[type[Exception], ...], base: float, remember: int):
        self.work, self.permanent, self.base, self.remember = work, permanent, base, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", "data string, executions int, ended boolean", self.remember)

    def _execute(self, key, data: str, n: int, now: int) -> pd.DataFrame:
        error = None
        try:
            self.work(json.loads(data))
            state = "done"
        except self.permanent as e:
            state, error = "dlq", str(e)
        except Exception as e:
            state, error = "dlq" if n + 1 > MAX_RETRY else "retry", str(e)
        if state == "retry":
            self.handle.registerTimer(now + int(1000 * min(self.base * 2**n, RETRY_CAP)))
        self.task.update((data, n + 1, state != "retry"))
        return pd.DataFrame({"task_id": [key[0]], "state": [state], "executions": [n + 1], "error": [error]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A message of a task that is known, ended or waiting, is a redelivery.
        first = next((data for frame in rows for data in frame["data"]), None)
        if first is not None and not self.task.exists():
            yield self._execute(key, first, 0, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.task.exists():
            data, n, ended = self.task.get()
            if not ended:
                yield self._execute(key, data, n, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def run_tasks(messages: DataFrame, work: Callable[[dict], None], permanent: tuple[type[Exception], ...] = (FileNotFoundError,), base: float = RETRY_BASE, remember: int = REMEMBER) -> DataFrame:
    """Transitions (retry, done, dlq) of a stream of messages whose tasks are executed by work(data), on the executors.

    A failure waits for min(base * 2**retry, 300) seconds, at most MAX_RETRY times; errors of the permanent kinds are dead
    letters at once. Delivery is at least once, so work must bear repetition. Needs the RocksDB state store and a
    processing-time trigger.
    """
    tasks = parsed(messages).select("task_id", F.to_json("data").alias("data"))
    machine = TaskMachine(work, permanent, base, remember)
    return tasks.groupBy("task_id").transformWithStateInPandas(machine, outputStructType=TRANSITION, outputMode="Append", timeMode="ProcessingTime")


def retries(attempts: DataFrame, remember: int | None = None) -> DataFrame:
    """Transitions (retry, done, dlq) of a stream of attempts (task_id, failed, error); needs the RocksDB state store.

    With `remember`, a task is forgotten so many milliseconds after its last attempt, and one that comes later is a task's
    first. State is then bounded by what comes in that time; the query needs a processing-time trigger, as it doesn't end by
    itself. Without, state grows with the tasks.
    """
    mode = "None" if remember is None else "ProcessingTime"
    return attempts.groupBy("task_id").transformWithStateInPandas(RetryMachine(remember), outputStructType=TRANSITION, outputMode="Append", timeMode=mode)


def latest(transitions: DataFrame) -> DataFrame:
    """The last transition of each task: the batch view of the stream's output."""
    return transitions.groupBy("task_id").agg(F.max(F.struct("executions", "state")).alias("m")).select("task_id", F.col("m.executions").alias("executions"), F.col("m.state").alias("state"))
