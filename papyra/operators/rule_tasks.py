"""Correction rules from a table of any size, applied in tasks of their own.

Values and rules are dealt by scope (document type and field), a scope of many values over several tasks, and sorted so
that a task meets a scope's rules before its values, which then pass as a stream: it holds the rules of one scope. There
each pattern is compiled once, and a value is searched only for rules whose required text it holds: one automaton over the
texts that a match can't be without finds them in one pass over the value, however many rules there are.

Rules of over HELD_BYTES are held by no task: distinct values meet those whose required texts they hold in an equi-join (see
anchors), and take the first that changes them. What it made of a value looks for the rules behind it in a further round, so
there are as many rounds as the longest chain of changes has. Only rules without a required text, which every value has to
try, are still sent to tasks.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import anchors

#: Values that a task of one scope takes.
TASK_VALUES = 200_000
#: Bytes of rules (patterns, replacements, and RULE_BYTES a rule) that tasks hold at most.
HELD_BYTES, RULE_BYTES = 16 << 20, 200
_LOG = "array<struct<rule_id:string,before:string,after:string>>"
_ENTRY = pa.struct([("rule_id", pa.string()), ("before", pa.string()), ("after", pa.string())])


def required_text(pattern: str) -> str | None:
    """A text that every match of a pattern holds: its longest run of plain characters outside of choices and repeats; None if there is none."""
    runs, now = [""], ""
    try:
        parsed = re._parser.parse(pattern)  # noqa: SLF001
    except (re.error, AttributeError, RecursionError, OverflowError):
        return None
    if parsed.state.flags & (re.IGNORECASE | re.VERBOSE):
        return None
    for op, value in parsed:
        if str(op) == "LITERAL":
            now += chr(value)
        elif str(op) != "AT":
            runs.append(now)
            now = ""
    return max((*runs, now), key=len) or None


def folded(text: str) -> str:
    """Equal texts for what compares equal in any case; the dotless and the dotted i count as i."""
    return text.replace("ı", "i").replace("İ", "i").casefold()


#: How a rule's required text is sought: there is none, as it stands, in any case.
ALWAYS, EXACT, ANY_CASE = range(3)


@lru_cache(4096)
def made(kind: str, pattern: str | None, replacement: str) -> tuple[Callable[[str], str], int, str | None] | None:
    """A rule's step, how its required text is sought, and that text; None for a rule that never changes anything."""
    if pattern is None:
        return None
    if kind == "dict":
        return (lambda v: v.replace(pattern, replacement)), EXACT if pattern else ALWAYS, pattern or None
    if kind not in ("regex", "normalize", "fuzzy"):
        return None
    try:
        compiled = re.compile(re.escape(pattern), re.IGNORECASE) if kind == "fuzzy" else re.compile(pattern)
        compiled.sub(replacement, "")
    except (re.error, IndexError, RecursionError, OverflowError):
        return None
    text = folded(pattern) if kind == "fuzzy" else required_text(pattern)
    how = ANY_CASE if kind == "fuzzy" else EXACT
    return (lambda v: compiled.sub(replacement, v)), how if text else ALWAYS, text or None


class RuleSet:
    """A scope's rules in order: rows of rule_id, rule_type, pattern, replacement."""

    def __init__(self, rules: list[dict]):
        self.ids: list[str] = []
        self.steps: list[Callable[[str], str]] = []
        self.always: list[int] = []
        self.exact, self.any_case = ahocorasick.Automaton(), ahocorasick.Automaton()
        for r in rules:
            if (found := made(r["rule_type"], r["pattern"], r["replacement"] or "")) is None:
                continue
            step, how, text = found
            k = len(self.steps)
            self.ids.append(r["rule_id"])
            self.steps.append(step)
            if how == ALWAYS:
                self.always.append(k)
            else:
                automaton = self.exact if how == EXACT else self.any_case
                automaton.add_word(text, [*automaton.get(text, []), k])
        for automaton in (self.exact, self.any_case):
            if len(automaton):
                automaton.make_automaton()

    def _sought(self, value: str, behind: int) -> list[int]:
        """The rules behind one whose required text the value holds, as a heap."""
        out = {k for k in self.always if k > behind}
        for automaton, text in ((self.exact, value), (self.any_case, folded(value) if len(self.any_case) else "")):
            if len(automaton):
                out.update(k for _, found in automaton.iter(text) for k in found if k > behind)
        return sorted(out)

    def apply(self, value: str | None) -> tuple[str | None, list[dict]]:
        """The corrected value, and an entry for each change. A rule whose replacement fails changes nothing."""
        log: list[dict] = []
        if not value:
            return value, log
        turns = self._sought(value, -1)
        # What became empty changes no more.
        while turns and value:
            k = heapq.heappop(turns)
            try:
                new = self.steps[k](value)
            except (re.error, IndexError):
                continue
            if new != value:
                log.append({"rule_id": self.ids[k], "before": value, "after": new})
                value = new
                turns = self._sought(value, k)
        return value, log


def _scopes(each: DataFrame, task_values: int) -> DataFrame:
    return each.groupBy("_type", "_field").agg((F.floor(F.count("*") / task_values) + 1).cast("int").alias("_tasks"))


def _dealt(each: DataFrame, scopes: DataFrame) -> DataFrame:
    """each with the _task of its scope that its _hash names."""
    met = each.join(scopes.withColumnsRenamed({"_type": "_t", "_field": "_f"}), F.col("_type").eqNullSafe(F.col("_t")) & F.col("_field").eqNullSafe(F.col("_f")))
    return met.withColumn("_task", F.pmod("_hash", "_tasks").cast("int")).drop("_t", "_f", "_hash", "_tasks")


def _sent(scopes: DataFrame, rules: DataFrame) -> DataFrame:
    """rules (_of, _for and others) for each task of each scope that they hold in."""
    met = scopes.withColumn("_of", F.explode(F.array_distinct(F.array("_type", F.lit("ALL"))))).join(rules, "_of").where(F.col("_for").isNull() | (F.col("_for") == F.col("_field")))
    return met.withColumn("_task", F.explode(F.sequence(F.lit(0), F.col("_tasks") - 1))).drop("_of", "_for", "_tasks")


_KEY = ("_type", "_field", "_task")


def apply_table(values: DataFrame, rules: DataFrame, kind: Column, task_values: int = TASK_VALUES, held_bytes: int = HELD_BYTES) -> DataFrame:
    """values with `value` corrected by the rules (RULE_SCHEMA) of their scope and `applied`, an entry for each change.

    values may lack field_name: then only rules of every field hold. A null value has no changes.
    """
    named = F.col("field_name") if "field_name" in values.columns else F.lit(None).cast("string")
    enabled = rules.where("is_enabled")
    length = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    size = enabled.agg(F.sum(length("pattern") + length("replacement") + RULE_BYTES).alias("n")).first().n or 0
    return (_held if size <= held_bytes else _met)(values, enabled, kind, named, task_values)


def _held(values: DataFrame, rules: DataFrame, kind: Column, named: Column, task_values: int) -> DataFrame:
    """apply_table by tasks that hold the rules of a scope."""
    whole = F.struct(*values.columns)
    each = values.select(kind.alias("_type"), named.alias("_field"), F.xxhash64("value", F.spark_partition_id()).alias("_hash"), whole.alias("_row"), F.col("value").alias("_value"))
    scopes = _scopes(each, task_values)
    dealt = _dealt(each, scopes).select(*_KEY, F.lit(1).alias("_kind"), F.lit(0).alias("_turn"), F.lit(None).cast("struct<rule_id:string,rule_type:string,pattern:string,replacement:string>").alias("_rule"), "_row", "_value")
    one = rules.select(F.col("doc_type").alias("_of"), F.col("field_name").alias("_for"), "priority", "ordinal", F.struct(F.col("id").alias("rule_id"), "rule_type", "pattern", "replacement").alias("_rule"))
    turn = F.row_number().over(Window.partitionBy(*_KEY).orderBy("priority", "ordinal"))
    met = _sent(scopes, one).withColumn("_turn", turn)
    sent = met.select(*_KEY, F.lit(0).alias("_kind"), "_turn", "_rule", F.lit(None).cast(dealt.schema["_row"].dataType).alias("_row"), F.lit(None).cast("string").alias("_value"))
    mixed = dealt.unionByName(sent).repartition(*_KEY).sortWithinPartitions(*_KEY, "_kind", "_turn")
    schema = T.StructType([mixed.schema["_row"], T.StructField("_new", T.StringType()), T.StructField("_log", T._parse_datatype_string(_LOG))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope, held, ready = None, [], None  # of one task of one scope: rules, then values
        for b in batches:
            column = {n: b.column(k) for k, n in enumerate(b.schema.names)}
            keys = list(zip(*(column[k].to_pylist() for k in (*_KEY, "_kind")), strict=True))
            texts, some = column["_value"].to_pylist(), column["_rule"]
            at, new, log = [], [], []
            for k, (*of, is_value) in enumerate(keys):
                if scope != of:
                    scope, held, ready = of, [], None
                if not is_value:
                    held.append(some[k].as_py())
                    continue
                ready = ready or RuleSet(held)
                value, entries = ready.apply(texts[k])
                at.append(k)
                new.append(value)
                log.append(entries)
            rows = column["_row"].take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows, pa.array(new, pa.string()), pa.array(log, pa.list_(_ENTRY))], names=["_row", "_new", "_log"])

    out = mixed.select(*_KEY, "_kind", "_rule", "_row", "_value").mapInArrow(run, schema)
    own = [F.col("_new").alias(c) if c == "value" else F.col("_row")[c].alias(c) for c in values.columns]
    return out.select(*own, F.col("_log").alias("applied"))


def _stored(df: DataFrame) -> DataFrame:
    """df written once below spark.checkpoint.dir and read back; where no such folder is named, executors keep it."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        return df.localCheckpoint()
    path = f"{base.rstrip('/')}/papyra/rules-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_TURN = "struct<priority:bigint,ordinal:bigint,n:bigint>"
_RULE = "struct<priority:bigint,ordinal:bigint,n:bigint,rule_id:string,rule_type:string,pattern:string,replacement:string>"
_OPEN = f"_type string, _field string, _value string, _now string, _behind {_TURN}, _log {_LOG}"


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rules (_of, _for, _rule) that may change anything, with how their required text is sought and the text, the key."""
    for b in batches:
        found = [made(r["rule_type"], r["pattern"], r["replacement"] or "") for r in b.column(2).to_pylist()]
        at = pa.array([k for k, f in enumerate(found) if f], pa.int64())
        how, key = pa.array([f[1] for f in found if f], pa.int32()), pa.array([f[2] for f in found if f], pa.string())
        yield pa.RecordBatch.from_arrays([*b.take(at).columns, how, key], names=[*b.schema.names, "_how", "key"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each value twice: its text as it stands, and folded."""
    for b in batches:
        now = b.column(b.schema.get_field_index("_now"))
        for how, text in ((EXACT, now), (ANY_CASE, pa.array([folded(v) for v in now.to_pylist()], pa.string()))):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([how] * len(b), pa.int32()), text], names=[*b.schema.names, "_sought", "text"])


def _turn(r: dict) -> tuple:
    """A rule's place: by priority and ordinal, null first, and a number of its own."""
    return (r["priority"] is not None, r["priority"] or 0, r["ordinal"] is not None, r["ordinal"] or 0, r["n"])


def _first_change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of values (_OPEN, _some: the rules whose texts they hold) those that change by a rule, the first behind _behind."""
    names = ("_type", "_field", "_value", "_now", "_behind", "_log")
    kind = pa.schema([*((n, pa.string()) for n in names[:4]), ("_behind", pa.struct([(n, pa.int64()) for n in ("priority", "ordinal", "n")])), ("_log", pa.list_(_ENTRY))])
    scope, held, ordered = None, [], True  # rules of one task of one scope that every value tries
    for b in batches:
        out = []
        for row in b.to_pylist():
            if scope != (of := tuple(row.get(k) for k in _KEY)):
                scope, held, ordered = of, [], True
            if row.get("_kind") == 0:
                held.append(row["_rule"])
                ordered = False
                continue
            if not ordered:
                held.sort(key=_turn)
                ordered = True
            now, behind = row["_now"], _turn(row["_behind"]) if row["_behind"] else None
            for r in heapq.merge(held, sorted(row["_some"] or (), key=_turn), key=_turn):
                if behind is not None and _turn(r) <= behind:
                    continue
                try:
                    new = made(r["rule_type"], r["pattern"], r["replacement"] or "")[0](now)
                except (re.error, IndexError):
                    continue
                if new != now:
                    entry = {"rule_id": r["rule_id"], "before": now, "after": new}
                    out.append({**{n: row[n] for n in names[:3]}, "_now": new, "_behind": {n: r[n] for n in ("priority", "ordinal", "n")}, "_log": [*(row["_log"] or ()), entry]})
                    break
        yield pa.RecordBatch.from_pylist(out, kind)


def _met(values: DataFrame, rules: DataFrame, kind: Column, named: Column, task_values: int) -> DataFrame:
    """apply_table by rounds of joins; no task holds rules but those that every value tries."""
    context = values.sparkSession.sparkContext
    long = lambda c: F.col(c).cast("long").alias(c)
    rule = F.struct(long("priority"), long("ordinal"), F.monotonically_increasing_id().alias("n"), F.col("id").alias("rule_id"), "rule_type", "pattern", "replacement")
    keyed = _stored(rules.select(F.col("doc_type").alias("_of"), F.col("field_name").alias("_for"), rule.alias("_rule")).mapInArrow(_keyed, f"_of string, _for string, _rule {_RULE}, _how int, key string"))
    always = keyed.where(F.col("_how") == ALWAYS).select("_of", "_for", "_rule")
    tried = not always.isEmpty()
    ready = _stored(anchors.anchored(keyed.where(F.col("_how") != ALWAYS).select("key", "_how", "_of", "_for", "_rule")))
    found = context.broadcast(anchors.filtered(ready))
    own = ["_type", "_field", "_value"]
    once = values.select(kind.alias("_type"), named.alias("_field"), F.col("value").alias("_value")).where("_value <> ''").distinct()
    now, rounds = once.select(*own, F.col("_value").alias("_now"), F.lit(None).cast(_TURN).alias("_behind"), F.array().cast(_LOG).alias("_log")), []
    while True:
        here = (F.col("_of").isin("ALL") | (F.col("_of") == F.col("_type"))) & (F.col("_for").isNull() | (F.col("_for") == F.col("_field")))
        hits = anchors.meeting(now.mapInArrow(_texts, f"{_OPEN}, _sought int, text string"), ready, found).where((F.col("_how") == F.col("_sought")) & here).select(*now.columns, "_rule")
        if tried:
            hits = hits.unionByName(now.withColumn("_rule", F.lit(None).cast(_RULE)))
        some = hits.groupBy(*own).agg(*(F.first(c).alias(c) for c in ("_now", "_behind", "_log")), F.collect_list("_rule").alias("_some"))
        if tried:
            scopes = _scopes(now, task_values)
            dealt = _dealt(some.withColumn("_hash", F.xxhash64("_value")), scopes).withColumns({"_kind": F.lit(1), "_rule": F.lit(None).cast(_RULE)})
            sent = _sent(scopes, always).withColumn("_kind", F.lit(0))
            some = dealt.unionByName(sent, allowMissingColumns=True).repartition(*_KEY).sortWithinPartitions(*_KEY, "_kind")
        changed = _stored(some.mapInArrow(_first_change, _OPEN))
        if changed.isEmpty():
            break
        rounds.append(changed)
        now = changed.where("_now <> ''")
    empty = F.array().cast(_LOG)
    if not rounds:
        return values.withColumn("applied", empty)
    last = rounds[0]
    if len(rounds) > 1:
        numbered = [r.withColumn("_round", F.lit(k)) for k, r in enumerate(rounds)]
        for more in numbered[1:]:
            numbered[0] = numbered[0].unionByName(more)
        last = numbered[0].groupBy(*own).agg(F.max_by(F.struct("_now", "_log"), "_round").alias("_last")).select(*own, "_last.*")
    ends = last.select(*(F.col(c).alias(f"{c}_of") for c in own), "_now", "_log")
    each = values.withColumns({"_type": kind, "_field": named})
    joined = each.join(ends, F.col("_type").eqNullSafe(F.col("_type_of")) & F.col("_field").eqNullSafe(F.col("_field_of")) & (F.col("value") == F.col("_value_of")), "left")
    return joined.select(*(F.coalesce("_now", c).alias(c) if c == "value" else c for c in values.columns), F.coalesce("_log", empty).alias("applied"))
