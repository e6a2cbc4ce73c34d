"""Results kept in a stream's state: requests for content that is known are answered there."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ANSWER = "content string, task_id string, hit boolean, body string"
#: Milliseconds that a result stays.
TTL = 3600 * 1000


class Kept(StatefulProcessor):
    """The result of one content: set by rows with a body, asked for by rows with a task; gone after its time to live."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.result = handle.getValueState("result", "body string", self.ttl)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N803
        for body in initialState["body"]:
            if body:
                self.result.update((body,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        asked: list[str] = []
        for frame in rows:
            for task, body in zip(frame["task_id"], frame["body"], strict=True):
                if body:
                    self.result.update((body,))
                elif task is not None:
                    asked.append(task)
        body = self.result.get()[0] if self.result.exists() else None
        if asked:
            # Plain objects: what is written takes no columns that pandas keeps in chunks.
            yield pd.DataFrame({"content": [key[0]] * len(asked), "task_id": asked, "hit": [body is not None] * len(asked), "body": [body] * len(asked)}, dtype=object)

    def close(self) -> None:
        pass


def answers(requests: DataFrame, results: DataFrame, known: DataFrame | None = None, ttl: int = TTL) -> DataFrame:
    """ANSWER for each of a stream of requests (content, task_id): whether its content has a result, and which.

    results (content, body) is a stream of what has been worked out; known, a table of the same columns, fills the state
    when the query first starts. Results of a batch count for its requests; an empty one is none. Needs the RocksDB state
    store and a processing-time trigger.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    nothing = lambda c: F.lit(None).cast("string").alias(c)
    both = requests.select(text("content"), text("task_id"), nothing("body")).unionByName(results.select(text("content"), nothing("task_id"), text("body")))
    start = known.select(text("content"), text("body")).groupBy("content") if known is not None else None
    return both.groupBy("content").transformWithStateInPandas(Kept(ttl), outputStructType=ANSWER, outputMode="Append", timeMode="ProcessingTime", initialState=start)
