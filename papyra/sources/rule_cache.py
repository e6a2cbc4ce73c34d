"""Rules that are read again once they are older than their time to live."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import builtin_rules, union_rules

TTL_SECONDS = 300.0


class RuleCache:
    """Built-in rules and those that `load` reads, kept for ttl seconds.

    The loaded rules are a catalogue: they are persisted, not collected. If reading fails, the rules before stay in use,
    or the built-in ones alone.
    """

    def __init__(self, spark: SparkSession, load: Callable[[SparkSession], DataFrame], ttl: float = TTL_SECONDS, clock: Callable[[], float] = time.monotonic):
        self.spark, self.load, self.ttl, self.clock = spark, load, ttl, clock
        self.loaded: DataFrame | None = None
        self.read_at: float | None = None
        self.version = "0-0"

    @staticmethod
    def _version(loaded: DataFrame) -> str:
        """The number of rules and the sum of their hashes: another one if any rule is."""
        r = loaded.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*loaded.columns).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        return f"{r.n}-{int(r.h):x}"

    def _read(self) -> None:
        try:
            new = self.load(self.spark).persist()
            new.count()  # a source that can't be read fails here, not in the caller's query
        except Exception:
            new = None
        if new is not None:
            if self.loaded is not None:
                self.loaded.unpersist()
            self.loaded = new
            self.version = self._version(new)
        self.read_at = self.clock()

    def rules(self) -> DataFrame:
        """The rules that hold now; `version` is that of the loaded ones."""
        if self.read_at is None or self.clock() - self.read_at >= self.ttl:
            self._read()
        own = builtin_rules(self.spark)
        return own if self.loaded is None else union_rules(own, self.loaded.select(*own.columns))

    def refresh(self) -> int:
        """Reads the rules anew, whatever their age; how many there are, the built-in ones included."""
        self.read_at = None
        if self.loaded is not None:
            self.loaded.unpersist()
            self.loaded, self.version = None, "0-0"
        return self.rules().count()
