"""What changes, and what is told, while a stream runs: rules that are read again, and progress."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.rules import apply_rules
from ..sources.rule_cache import RuleCache


def correcting(cache: RuleCache, kind: Column | None = None) -> Callable[[DataFrame], DataFrame]:
    """Work for run_batches: each micro-batch is corrected by the rules that hold when it starts, and says which did.

    Rules are read again once they are older than the cache's time to live; applied has the rules of each change, and
    rules_version is the version that the cache gave the rules, which changes if any of them does.
    """

    def work(values: DataFrame) -> DataFrame:
        rules = cache.rules()
        return apply_rules(values, rules, kind).withColumn("rules_version", F.lit(cache.version))

    return work


def observed(stream: DataFrame, name: str, **counts: Column) -> DataFrame:
    """The stream with counts of its rows, and of those for which a condition holds, for Progress."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(k) for k, c in counts.items()))


class Progress(StreamingQueryListener):
    """Sends a progress message after each micro-batch of the queries that observe `name`: strings, as the sinks take them.

    Percentages are of `total` rows, over all batches; without a total they stay 0 until the query ends, which is 100. What
    send raises is kept in `error` and stops nothing.
    """

    def __init__(self, send: Callable[[dict[str, str]], None], name: str, total: int | None = None):
        self.send, self.name, self.total = send, name, total
        self.seen: dict[str, int] = {}
        self.error: Exception | None = None

    def _tell(self, task: str, percent: int, message: str) -> None:
        try:
            self.send({"taskId": task, "status": "PROGRESS", "progress": str(min(max(percent, 0), 100)), "message": message, "timestamp": str(int(time.time() * 1000))})
        except Exception as error:
            self.error = error

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.seen.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        metrics = event.progress.observedMetrics.get(self.name)
        if metrics is None:
            return
        counts = metrics.asDict()
        key = str(event.progress.id)
        self.seen[key] = self.seen.get(key, 0) + counts["rows"]
        percent = 100 * self.seen[key] // self.total if self.total else 0
        self._tell(event.progress.name or key, percent, ", ".join(f"{k} {v}" for k, v in counts.items()))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        rows = self.seen.pop(str(event.id), None)
        if rows is not None and event.exception is None:
            self._tell(str(event.id), 100, f"ended after {rows} rows")
