"""The task life cycle over message tables (message_id, data map<string,string>, ...), and keyed logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_RETRY, RETRY_BASE, RETRY_CAP, STALE_MILLIS = 3, 2, 300, 60_000


def _key(*names: str, default: str = "") -> Column:
    """The first non-empty of several spellings; the default only where the last one is missing."""
    d = F.col("data")
    values = [F.nullif(F.try_element_at(d, F.lit(n)), F.lit("")) for n in names[:-1]]
    return F.coalesce(*values, F.try_element_at(d, F.lit(names[-1])), F.lit(default))


def parse(messages: DataFrame) -> DataFrame:
    """Typed columns of messages; numbers that can't be read are null, for the dead-letter route."""
    return messages.select(
        "message_id", "data",
        _key("taskId", "task_id").alias("task_id"), _key("taskType", "task_type", default="FULL_PAGE").alias("task_type"), _key("docId", "doc_id").alias("doc_id"),
        _key("filePath", "file_path", "image_path").alias("file_path"), _key("docType", "doc_type", default="AUTO").alias("doc_type"),
        F.expr("try_cast(coalesce(nullif(data['retry'], ''), '0') as int)").alias("retry"), F.expr("try_cast(coalesce(nullif(data['createdAt'], ''), data['created_at'], '0') as bigint)").alias("created_at"),
    )


def route(tasks: DataFrame) -> DataFrame:
    """drop without a task id, dlq with unreadable numbers, else evidence or full_page."""
    return tasks.withColumn("route", F.when(F.col("task_id") == "", "drop").when(F.col("retry").isNull() | F.col("created_at").isNull(), "dlq").when(F.col("task_type") == "EVIDENCE_ENRICH", "evidence").otherwise("full_page"))


def table_mode(tasks: DataFrame, enabled: bool = True, kinds: tuple[str, ...] = ("INVOICE", "AUTO")) -> DataFrame:
    """tasks with table_mode: full pages of these document types go to the table recogniser first, if it is enabled."""
    return tasks.withColumn("table_mode", F.lit(enabled) & F.col("doc_type").isin(*kinds))


def submit(files: DataFrame, now: Column, callback: str = "", extra: Column | None = None) -> DataFrame:
    """files (task_id, file_path; optional file_name, doc_type, prefer_mode, callback_url) with `data`, the message of each
    task: the file's name is the last part of its path unless given, other keys have defaults, extra ones win."""

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), default) if name in files.columns else default

    entries = {
        "taskId": F.col("task_id"),
        "filePath": F.col("file_path"),
        "fileName": given("file_name", F.element_at(F.split("file_path", "/"), -1)),
        "docType": given("doc_type", F.lit("AUTO")),
        "preferMode": given("prefer_mode", F.lit("auto")),
        "retry": F.lit("0"),
        "createdAt": now.cast("string"),
        "callbackUrl": given("callback_url", F.lit(callback)),
    }
    data = F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)])
    if extra is not None:
        data = F.map_concat(F.map_filter(data, lambda k, v: ~F.map_contains_key(extra, k)), extra)
    return files.withColumn("data", data)


def submit_generic(rows: DataFrame, task_type: str, payload: list[str], now: Column) -> DataFrame:
    """rows (task_id, ...) with `data`: the payload's columns are flattened into it, nested ones as JSON, others as text."""
    nested = {f.name for f in rows.schema if f.dataType.typeName() in ("struct", "array", "map")}
    flat = {c: F.to_json(c) if c in nested else F.col(c).cast("string") for c in payload}
    entries = {"taskId": F.col("task_id"), "taskType": F.lit(task_type), "retry": F.lit("0"), "createdAt": now.cast("string")} | flat
    return rows.withColumn("data", F.map_filter(F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull()))


def json_fields(column: Column, names: list[str]) -> Column:
    """struct of a JSON object's fields as text; null where the object or the field is missing."""
    parsed = F.from_json(column, "map<string,string>")
    return F.struct(*(F.try_element_at(parsed, F.lit(n)).alias(n) for n in names))


def failure_route(failures: DataFrame) -> DataFrame:
    """Missing files go to the dead letters at once; others are tried again, up to MAX_RETRY times."""
    return failures.withColumn("outcome", F.when(F.col("error_class") == "FileNotFoundError", "dlq").when(F.col("retry") < MAX_RETRY, "retry").otherwise("dlq"))


def backoff(retry: Column) -> Column:
    """Whole seconds before attempt retry: 2 * 2**retry, 300 at most."""
    return F.least(F.lit(RETRY_BASE).cast("double") * F.pow(F.lit(2.0), retry), F.lit(float(RETRY_CAP))).cast("int")


def put(data: Column, entries: dict[str, Column]) -> Column:
    """data with keys set; later keys win."""
    old = F.map_filter(data, lambda k, v: ~k.isin(*entries))
    return F.map_concat(old, F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)]))


def retry_payload(failures: DataFrame, now: Column) -> DataFrame:
    """The data of the next attempt: retry + 1, the error's first 500 characters, and when it is due."""
    due = now + F.lit(1000) * backoff(F.col("retry"))
    return failures.withColumn("data", put(F.col("data"), {"retry": (F.col("retry") + 1).cast("string"), "lastError": F.left("error", F.lit(500)), "delayUntil": due.cast("string")}))


def dlq_payload(failures: DataFrame, now: Column) -> DataFrame:
    return failures.withColumn("data", put(F.col("data"), {"dlqTime": now.cast("string"), "originalId": F.col("message_id").cast("string"), "error": F.left("error", F.lit(1000))}))


def reprocess(dead: DataFrame, reset: bool = True) -> DataFrame:
    """Dead letters as new messages: without the letter's keys, from retry 0 if reset."""
    kept = F.map_filter("data", lambda k, v: ~k.isin("dlqTime", "originalId", "error", "lastError"))
    return dead.withColumn("data", put(kept, {"retry": F.lit("0")}) if reset else kept)


def retry_or_dlq(attempts: DataFrame) -> DataFrame:
    """Fold of a task's attempts (task_id, seq, failed): executions until the first success or MAX_RETRY + 1, and how it ended."""
    w = Window.partitionBy("task_id").orderBy("seq")
    n = attempts.withColumn("k", F.row_number().over(w)).where(F.col("k") <= MAX_RETRY + 1)
    done = n.groupBy("task_id").agg(F.min(F.when(~F.col("failed"), F.col("k"))).alias("ok"), F.max("k").alias("last"))
    state = F.when(F.col("ok").isNotNull(), "done").when(F.col("last") > MAX_RETRY, "dlq").otherwise("pending")
    return done.select("task_id", F.coalesce("ok", "last").alias("executions"), state.alias("state"))


def pending(delivered: DataFrame, acknowledged: DataFrame) -> DataFrame:
    return delivered.join(acknowledged.select("message_id").distinct(), "message_id", "left_anti")


def stale(delivered: DataFrame, acknowledged: DataFrame, now: Column, idle: int = STALE_MILLIS) -> DataFrame:
    """Messages without acknowledgement whose last delivery is at least `idle` milliseconds old."""
    last = delivered.groupBy("message_id").agg(F.max("delivered_at").alias("delivered_at"))
    return pending(last, acknowledged).where(now - F.col("delivered_at") >= idle)


def trim(stream: DataFrame, most: int) -> DataFrame:
    """The last `most` messages."""
    return stream.orderBy(F.col("message_id").desc()).limit(most)


def append(stream: DataFrame, new: DataFrame, most: int) -> DataFrame:
    """The stream with new messages behind it, of which the last `most` stay."""
    return trim(stream.unionByName(new), most)


def next_messages(stream: DataFrame, delivered: DataFrame, count: int) -> DataFrame:
    """The first `count` messages that nobody has been given yet: one read of a consumer group."""
    return pending(stream, delivered).orderBy("message_id").limit(count)


def clear_dead(dead: DataFrame) -> DataFrame:
    """cleared, left: how many dead letters go when all are removed. readers.clear empties their table."""
    return dead.agg(F.count("*").alias("cleared")).withColumn("left", F.lit(0).cast("long"))


def batch_summary(outcomes: DataFrame) -> DataFrame:
    """total, succeeded, failed, success (no failure) of rows with failed boolean; an empty batch is a success."""
    failed = F.coalesce(F.col("failed"), F.lit(False))
    counts = outcomes.agg(F.count("*").alias("total"), F.count_if(failed).alias("_f"))
    return counts.select("total", (F.col("total") - F.col("_f")).alias("succeeded"), F.col("_f").alias("failed"), (F.col("_f") == 0).alias("success"))


def request_metrics(requests: DataFrame) -> DataFrame:
    """requests, cache_hits, cache_misses, mean_duration (0 without any) of rows with cached boolean and duration."""
    return requests.agg(F.count("*").alias("requests"), F.count_if("cached").alias("cache_hits"), F.count_if(~F.col("cached")).alias("cache_misses"), F.coalesce(F.avg("duration"), F.lit(0.0)).alias("mean_duration"))


def stream_stats(stream: DataFrame) -> DataFrame:
    """length, first_id, last_id, pending, dead, consumers of messages with consumer, acknowledged and dead."""
    return stream.agg(
        F.count("*").alias("length"), F.min("message_id").alias("first_id"), F.max("message_id").alias("last_id"),
        F.count_if(~F.col("acknowledged")).alias("pending"), F.count_if("dead").alias("dead"), F.count_distinct("consumer").alias("consumers"),
    )


def consumer_stats(stream: DataFrame) -> DataFrame:
    """Per consumer: messages handled, pending and the last one."""
    return stream.groupBy("consumer").agg(F.count("*").alias("handled"), F.count_if(~F.col("acknowledged")).alias("pending"), F.max("message_id").alias("last_id"))


def counters(log: DataFrame) -> DataFrame:
    """key, counter: the sum of each key's steps (delta)."""
    return log.groupBy("key").agg(F.sum("delta").alias("counter"))


def members(log: DataFrame) -> DataFrame:
    """key, members: the distinct values added to each key's set, sorted."""
    return log.groupBy("key").agg(F.array_sort(F.collect_set("value")).alias("members"))


def last_values(log: DataFrame) -> DataFrame:
    return log.groupBy("key").agg(F.max(F.struct("ts", "seq", "value")).alias("m")).select("key", F.col("m.value").alias("value"))


def unexpired(log: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Keys whose last write is younger than the time to live."""
    return log.groupBy("key").agg(F.max("ts").alias("ts")).where(F.col("ts") + F.make_interval(secs=F.lit(ttl_seconds)) > now)


def metrics_text(metrics: DataFrame) -> DataFrame:
    """name, HELP / TYPE / value lines."""
    return metrics.select("name", F.concat(F.lit("# HELP "), "name", F.lit(" "), "help", F.lit("\n# TYPE "), "name", F.lit(" "), "kind", F.lit("\n"), "name", F.lit(" "), F.col("value").cast("string")).alias("metric"))
