"""The engine's queries against DuckDB, and traced micro cases."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()

from papyra.registry import ORACLE_SQL, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = sorted(str(tuple(r)) for r in df.select(*(f"`{c}`" for c in sorted(df.columns))).collect())
    if name not in ORACLE_SQL:
        assert got
        return
    columns = sorted(duck.sql(ORACLE_SQL[name]).columns)
    assert columns == sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted(map(str, duck.sql(f"select {quoted} from ({ORACLE_SQL[name]})").fetchall()))
    spark.catalog.clearCache()


def test_row_cluster_traced(spark):
    from papyra.operators.geometry import row_clusters

    rows = [(1, 1, k, float(y), 10.0, 0.0) for k, y in enumerate((10, 11, 30, 31.5, 60))]
    frame = spark.createDataFrame(rows, "doc_id long, page int, ordinal long, y_center double, height double, x_center double")
    assert [r.row_index for r in row_clusters(frame).orderBy("ordinal").collect()] == [0, 0, 1, 1, 2]
    at_limit = spark.createDataFrame([(1, 1, 0, 0.0, 10.0, 0.0), (1, 1, 1, 5.0, 10.0, 1.0), (1, 1, 2, 7.6, 10.0, 1.0)], "doc_id long, page int, ordinal long, y_center double, height double, x_center double")
    assert [r.row_index for r in row_clusters(at_limit).orderBy("ordinal").collect()] == [0, 0, 1]


def test_cluster_keeps_unordered_columns(spark):
    from papyra.operators.geometry import row_clusters

    rows = [(1, 1, k, float(y), 10.0, 0.0, {"k": k}) for k, y in enumerate((31, 10, 11))]
    frame = spark.createDataFrame(rows, "doc_id long, page int, ordinal long, y_center double, height double, x_center double, more map<string,int>")
    assert [(r.row_index, r.more["k"]) for r in row_clusters(frame).orderBy("ordinal").collect()] == [(1, 0), (0, 1), (0, 2)]


def test_projection_runs_equal_the_histogram(spark):
    import random

    from pyspark.sql import functions as F

    from papyra.operators import geometry

    random.seed(5)
    rows = [(d, 1, lo, lo + random.randint(0, 30)) for d in range(12) for lo in (random.randint(0, 200) for _ in range(d * 2))]
    spans = spark.createDataFrame(rows, "doc_id long, page int, x_min int, x_max int")
    swept = spans.groupBy("doc_id", "page").agg(F.collect_list(F.struct(F.col("x_min").alias("lo"), F.col("x_max").alias("hi"))).alias("s")).select("doc_id", "page", F.inline(geometry.projection_runs(F.col("s"))))
    for steps in (geometry.projection(spans), geometry.coverage(spans)):
        want = geometry.projection_columns(steps)
        assert sorted(map(tuple, swept.collect())) == sorted(map(tuple, want.select(swept.columns).collect()))
    gaps = [sorted(map(tuple, geometry.row_gaps(steps).collect())) for steps in (geometry.projection(spans), geometry.coverage(spans))]
    assert gaps[0] == gaps[1]
    # Against pixels, page by page.
    pixels = {}
    for d, _, lo, hi in rows:
        for at in range(lo, hi):
            pixels.setdefault(d, {}).setdefault(at, 0)
            pixels[d][at] += 1
    runs = []
    for d, n in pixels.items():
        high = sorted(at for at in n if n[at] > max(n.values()) * 0.3)
        first = [at for at in high if at - 1 not in high]
        last = [at + 1 if at != max(n) else at for at in high if at + 1 not in high]
        runs += [(d, 1, k, a, b) for k, (a, b) in enumerate(zip(first, last, strict=True))]
    assert sorted(map(tuple, swept.collect())) == sorted(runs)


def test_many_edges_of_one_page(spark):
    """A page of 200,000 edges: a sweep carries runs, not levels."""
    from pyspark.sql import functions as F

    from papyra.operators import geometry

    spans = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page"), (F.col("id") * 20).alias("x_min"), (F.col("id") * 20 + F.when(F.col("id") % 1000 == 0, 25).otherwise(20)).alias("x_max"))
    one = spans.groupBy("doc_id", "page").agg(F.collect_list(F.struct(F.col("x_min").alias("lo"), F.col("x_max").alias("hi"))).alias("s"))
    assert [tuple(r) for r in one.select(F.inline(geometry.projection_runs(F.col("s"), 0.6))).collect()][:2] == [(0, 20, 25), (1, 20_020, 20_025)]
    assert geometry.projection_columns(geometry.coverage(spans), 0.6).count() == 100


def test_rows_of_a_large_page(spark):
    """A page of a million blocks in islands of ten: no array is longer."""
    from pyspark.sql import functions as F

    from papyra.operators.geometry import row_clusters

    n = 1_000_000
    page = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page"), F.col("id").alias("ordinal"), (F.floor(F.col("id") / 10) * 40.0 + F.col("id") % 7).alias("y_center"), (F.col("id") * 7 % 10 * 50.0).alias("x_center"), F.lit(20.0).alias("height"))
    got = row_clusters(page).agg(F.count("*").alias("n"), F.count_if((F.col("row_index") != F.floor(F.col("ordinal") / 10)) | (F.col("pos") != F.col("ordinal") * 7 % 10)).alias("wrong")).first()
    assert (got.n, got.wrong) == (n, 0)


def test_rows_of_any_island(spark):
    """Islands against the running mean folded over the whole page; vertical blocks and unordered columns too."""
    import random

    from papyra.operators.geometry import row_clusters

    rng = random.Random(7)
    rows = []
    for d in range(40):
        high = rng.choice([30, 200, 2000])
        rows += [(d, 1, k, rng.choice([rng.uniform(0, high), round(rng.uniform(0, high) / 8) * 8.0]), rng.choice([8.0, 12.0, 0.0, 30.0]), rng.choice([0.0, 50.0, 100.0])) for k in range(rng.randint(1, 60))]
    want = {}
    for d in range(40):
        page = sorted((r for r in rows if r[0] == d), key=lambda r: (r[3], r[2]))
        heights = [r[4] for r in page if r[4] > 0]
        near = max((sum(heights) / len(heights) if heights else 20.0) * 0.5, 5.0)
        cut = []
        for r in page:
            if cut and abs(r[3] - sum(x[3] for x in cut[-1]) / len(cut[-1])) <= near:
                cut[-1].append(r)
            else:
                cut.append([r])
        for k, row in enumerate(cut):
            want |= {(d, r[2]): (k, p) for p, r in enumerate(sorted(row, key=lambda r: (r[5], r[3], r[2])))}
    frame = spark.createDataFrame(rows, "doc_id long, page int, ordinal long, y_center double, height double, x_center double")
    for more in (frame, frame.selectExpr("*", "map('k', ordinal) as m")):
        assert {(r.doc_id, r.ordinal): (r.row_index, r.pos) for r in row_clusters(more).collect()} == want


def test_columns_without_header(spark):
    """Without a header row the projection gives the columns; without ink, the widest row's points."""
    from papyra.operators.geometry import row_clusters
    from papyra.operators.table import adaptive_columns, advanced_table, simple_table

    rows = [(1, 1, 4 * r + c, "x", 50.0 * c, 50.0 * c + 20, 50.0 * c + 10, 40.0 * r, 20.0) for r in range(3) for c in range(3)]
    rows += [(2, 1, c, "x", 50.0 * c, 50.0 * c, 50.0 * c, 40.0, 20.0) for c in range(2)]
    frame = spark.createDataFrame(rows, "doc_id long, page int, ordinal long, text string, x_min double, x_max double, x_center double, y_center double, height double")
    got = sorted(map(tuple, adaptive_columns(row_clusters(frame)).collect()))
    assert got == [(1, 1, 0, "", 0.0, 20.0), (1, 1, 1, "", 50.0, 70.0), (1, 1, 2, "", 100.0, 119.0), (2, 1, 0, "", 0.0, 0.0), (2, 1, 1, "", 50.0, 50.0)]
    for build in (advanced_table, simple_table):
        assert all(r.column_index == r.x_center // 50 and r.column_name == "" for r in build(row_clusters(frame)).collect())


def test_rules_traced(spark):
    from papyra.operators.rules import apply_rules
    from papyra.plans.queries import built_in

    rows = [(1, "INVOICE", "amount", "1O2O3"), (2, "INVOICE", "invoice_date", "2024年3月5日"), (3, "INVOICE", "seller", " x "), (4, "INVOICE", "amount", "12 ,345")]
    got = {r.doc_id: r for r in apply_rules(spark.createDataFrame(rows, "doc_id long, doc_type string, field_name string, value string"), built_in()).collect()}
    assert (got[1].value, len(got[1].applied)) == ("10203", 1)
    assert [got[k].value for k in (2, 3, 4)] == ["2024-3-5", "x", "12,345"]


def test_text_traced(spark):
    from pyspark.sql import functions as F

    from papyra.functions import remark, text

    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert value(text.norm_amount(F.lit("1.2.3"))) == "1.23"
    assert value(text.norm_date(F.lit("2025-12-23"))) == value(text.norm_date(F.lit("025年12月23日"))) == "1223"
    assert value(text.doc_type(F.lit("发票 合同"))) == "INVOICE"
    assert value(text.row_class(F.lit("价税合计 1"))) == "total" and value(text.simple_row_class(F.lit("价税合计 1"))) == "subtotal"
    assert value(text.first_match(F.lit("a note here"), (r"No[.:\s]*([A-Za-z0-9]+)",))) == "te"
    assert value(remark.merge_remarks(F.lit("号码：12345 账期：202504"), F.lit("账期：202504、202505"))) == "号码：12345; 账期：202504、202505"
    assert value(remark.merge_remarks(F.lit(""), F.lit("x"))) == "x"


def test_html_and_model(spark):
    from papyra.operators.ingest import table_rows

    assert table_rows("<table><tr><td>a</td></tr><tr><td>b</td><td>c</td></tr></table>") == (["a"], [["b", "c"]])
    assert table_rows("<table><tr><th>h</th></tr><tr><td> b </td></tr></table>") == (["h"], [["h"], ["b"]])
    assert table_rows("") == ([], [])


def test_html_cells_keep_their_keys(spark, monkeypatch):
    from papyra.operators import ingest

    rows = [(f"k{i}", i, "".join(f"<tr><td>{i}</td><td>{j}</td></tr>" for j in range(i))) for i in range(30)] + [("null", None, None)]
    tables = spark.createDataFrame(rows, "name string, n long, html string")
    for most in (1, 50_000):
        monkeypatch.setattr(ingest, "_CELLS", most)
        got = {tuple(r) for r in ingest.html_cells(tables, ("name", "n")).collect()}
        want = {(f"k{i}", i, "header", -1, c, t) for i in range(1, 30) for c, t in enumerate((str(i), "0"))}
        assert got == want | {(f"k{i}", i, "cell", j - 1, c, t) for i in range(30) for j in range(1, i) for c, t in enumerate((str(i), str(j)))}


def test_html_tables_in_pages_counts_cells(spark, tmp_path):
    rows = [(1, "u", "<p>none</p>"), (2, "u", "<p>x</p><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>"), (3, "u", "<table></table>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["html_tables_in_pages"](spark, str(tmp_path)).collect()
    assert {r.page_id: r.n_cells for r in got} == {2: 6, 3: 0}


def test_page_merge_weighs_blocks(spark):
    from papyra.operators.ingest import merge_pages

    rows = [(1, 1, k, "a", 0.5) for k in range(2)] + [(1, 2, k, "b", 1.0) for k in range(8)]
    blocks, docs = merge_pages(spark.createDataFrame(rows, "doc_id long, page int, line_index int, text string, confidence double"))
    assert docs.first().overall_confidence == pytest.approx(0.9)
    assert sorted(r.line_index for r in blocks.collect()) == list(range(10))


def test_failures(spark):
    from papyra.operators.tasks import failure_route, parse

    rows = [("1", {"taskId": "", "task_id": "b", "retry": "2"}), ("2", {"taskId": "a", "retry": "x"})]
    got = {r.message_id: r for r in parse(spark.createDataFrame(rows, "message_id string, data map<string,string>")).collect()}
    assert got["1"].task_id == "b" and got["1"].task_type == "FULL_PAGE" and got["2"].retry is None
    f = spark.createDataFrame([(1, "E", 2), (2, "E", 3), (3, "FileNotFoundError", 0)], "id int, error_class string, retry int")
    assert [r.outcome for r in failure_route(f).orderBy("id").collect()] == ["retry", "dlq", "dlq"]


def test_stream_equals_batch(spark, tmp_path):
    from papyra.operators.tasks import retry_or_dlq
    from papyra.streaming import task_stream

    rows = [(f"t{k % 7}", str(k), k % 3 > 0, "boom" if k % 3 else None) for k in range(30)]
    spark.createDataFrame(rows, task_stream.ATTEMPT).coalesce(1).write.json(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(task_stream.ATTEMPT).json(f"{tmp_path}/in")
    query = task_stream.retries(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.task_id, r.executions, {"retry": "pending"}.get(r.state, r.state)) for r in task_stream.latest(spark.read.parquet(f"{tmp_path}/out")).collect()}
    attempts = spark.createDataFrame([(a, int(b), c) for a, b, c, _ in rows], "task_id string, seq int, failed boolean")
    assert got == {(r.task_id, r.executions, r.state) for r in retry_or_dlq(attempts).collect()}


@pytest.mark.parametrize("remember,executions", [(3_600_000, [1, 2]), (1, [1, 1])])
def test_attempts_are_forgotten(spark, tmp_path, remember, executions):
    import time

    from papyra.streaming import task_stream

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(task_stream.ATTEMPT).json(f"{tmp_path}/in")
    transitions = task_stream.retries(stream, remember).coalesce(1)
    query = transitions.writeStream.format("memory").queryName(f"seen_{remember}").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="0 seconds").start()
    try:
        for k in range(2):
            spark.createDataFrame([("t", str(k), True, "boom")], task_stream.ATTEMPT).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
            until = time.time() + 60
            while spark.table(f"seen_{remember}").count() <= k and time.time() < until:
                time.sleep(0.3)
    finally:
        query.stop()
    assert sorted(r.executions for r in spark.table(f"seen_{remember}").collect()) == executions


def test_message_batches(spark, tmp_path):
    from papyra.sources.readers import message_stream
    from papyra.streaming.task_stream import run_batches

    spark.createDataFrame([("1", {"taskId": "a"}), ("2", {"taskId": ""})], "message_id string, data map<string,string>").coalesce(1).write.json(f"{tmp_path}/in")
    run_batches(message_stream(spark, f"{tmp_path}/in"), lambda b: b.select("task_id"), lambda out, n: out.write.mode("overwrite").json(f"{tmp_path}/out/{n}"), f"{tmp_path}/cp").awaitTermination()
    assert [r.task_id for r in spark.read.json(f"{tmp_path}/out/*").collect()] == ["a"]


def test_failing_batches_go_to_their_handler(spark, tmp_path):
    from papyra.sources.readers import message_stream
    from papyra.streaming.task_stream import either, run_batches

    spark.createDataFrame([("1", {"taskId": "a"})], "message_id string, data map<string,string>").coalesce(1).write.json(f"{tmp_path}/in")

    def broken(batch, number):
        raise OSError("no sink")

    dead, taken = [], []
    run_batches(message_stream(spark, f"{tmp_path}/in"), lambda b: b, broken, f"{tmp_path}/cp", lambda b, n, e: dead.append(([r.task_id for r in b.collect()], e))).awaitTermination()
    assert dead == [(["a"], "OSError: no sink")]
    run_batches(message_stream(spark, f"{tmp_path}/in"), lambda b: b, either(broken, lambda b, n: taken.append(b.count())), f"{tmp_path}/cp2").awaitTermination()
    assert taken == [1]
    with pytest.raises(OSError):
        either(broken)(None, 0)


def test_tasks_are_tried_again(spark, tmp_path):
    import time

    from papyra.sources.readers import message_stream
    from papyra.streaming import task_stream

    names = ["good", "flaky", "bad", "gone"]
    spark.createDataFrame([(n, {"taskId": n}) for n in names], "message_id string, data map<string,string>").coalesce(1).write.json(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = str(tmp_path)

    def work(data):
        import os

        name = data["taskId"]
        count = len([f for f in os.listdir(folder) if f.startswith(f"try-{name}-")])
        open(f"{folder}/try-{name}-{count}", "w").close()
        if name == "gone":
            raise FileNotFoundError(name)
        if name == "bad" or (name == "flaky" and count < 2):
            raise ValueError(name)

    stream = task_stream.run_tasks(message_stream(spark, f"{tmp_path}/in"), work, base=0.01)
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="0 seconds").start()
    want = {"good": (1, "done"), "flaky": (3, "done"), "bad": (4, "dlq"), "gone": (1, "dlq")}
    got, until = {}, time.time() + 90
    while got != want and time.time() < until:
        time.sleep(1)
        try:
            got = {r.task_id: (r.executions, r.state) for r in task_stream.latest(spark.read.schema(task_stream.TRANSITION).parquet(f"{tmp_path}/out")).collect()}
        except Exception:  # nothing written yet
            continue
    query.stop()
    assert got == want


def test_work_can_be_cancelled(spark):
    import threading
    import time

    from pyspark.sql import functions as F

    from papyra.streaming.task_stream import TaskCancelled, cancellable

    @F.udf("long")
    def slow(x):
        time.sleep(30)
        return x

    assert cancellable(spark, lambda: spark.range(3).count(), 60) == 3
    began = time.time()
    with pytest.raises(TaskCancelled):
        cancellable(spark, lambda: spark.range(1).select(slow("id")).collect(), 0.5)
    assert time.time() - began < 25
    stop = threading.Event()
    stop.set()
    with pytest.raises(TaskCancelled):
        cancellable(spark, lambda: spark.range(1).count(), 60, stop)


def test_consumer_groups(spark, tmp_path):
    from papyra.streaming.task_stream import destroy_group, ensure_group

    path = f"file://{tmp_path}/group"
    assert [ensure_group(spark, path), ensure_group(spark, path), destroy_group(spark, path), destroy_group(spark, path)] == [True, False, True, False]


def test_rule_cache(spark):
    from papyra.operators.rules import RULE_SCHEMA
    from papyra.sources.rule_cache import RuleCache

    reads, now = [], [0.0]

    def load(session):
        reads.append(now[0])
        if len(reads) == 3:
            raise OSError("no rules")
        return session.createDataFrame([(f"own{k}", "dict", "a", "b", "ALL", None, 1, True, k) for k in range(len(reads))], RULE_SCHEMA)

    cache = RuleCache(spark, load, clock=lambda: now[0])
    assert cache.rules().count() == 7 and cache.rules().count() == 7 and reads == [0.0]
    now[0] = 300.0
    assert cache.rules().count() == 8
    now[0] = 600.0  # reading fails: the rules before stay
    assert cache.rules().count() == 8 and len(reads) == 3
    assert cache.refresh() == 10


def test_readers(spark, tmp_path):
    import json

    from pyspark.sql import functions as F

    from papyra.operators.ingest import blocks_from_model
    from papyra.sources import readers

    with open(f"{tmp_path}/rules.json", "w") as file:
        for k, kind in enumerate(("regex", "magic", "dict")):
            file.write(json.dumps({"id": f"r{k}", "rule_type": kind, "pattern": "a", "doc_type": "ALL", "priority": k, "is_enabled": True, "ordinal": k}) + "\n")
    assert sorted(r.id for r in readers.rules(spark, f"{tmp_path}/rules.json").collect()) == ["r0", "r2"]
    (tmp_path / "scans").mkdir()
    (tmp_path / "scans" / "a.png").write_bytes(b"one two")

    def recognise(raw):
        words = F.split(F.decode("content", "UTF-8"), " ")
        box = F.array(*[F.array(F.lit(1.0), F.lit(2.0))] * 4)
        return raw.select(F.lit(1).alias("doc_id"), F.lit(1).alias("page"), words.alias("rec_texts"), F.transform(words, lambda w: F.lit(0.5)).alias("rec_scores"), F.transform(words, lambda w: box).alias("dt_polys"))

    assert [r.text for r in blocks_from_model(readers.files(spark, f"{tmp_path}/scans", recognise)).orderBy("line_index").collect()] == ["one", "two"]
    spark.range(4).write.parquet(f"{tmp_path}/dead")
    assert readers.clear(spark, f"{tmp_path}/dead") == 4 and readers.clear(spark, f"{tmp_path}/dead") == 0


def test_vertical_split_without_anchors(spark):
    """Without blocks beside it, a vertical block's characters are spread evenly; the commonest character is the first of equals."""
    from papyra.operators.geometry import vertical_split, with_geometry

    box = lambda x1, y1, x2, y2: [[x1, y1], [x2, y1], [x2, y2], [x1, y2]]
    rows = [(1, 1, 0, "a b ab", 0.5, box(0.0, 0.0, 10.0, 100.0)), (1, 1, 1, "x", 0.5, box(0.0, 200.0, 10.0, 210.0)), (1, 1, 2, "y", 0.5, box(0.0, 300.0, 10.0, 310.0))]
    rows += [(2, 1, 0, "bab a", 0.5, box(0.0, 0.0, 10.0, 100.0)), (2, 1, 1, "x", 0.5, box(90.0, 20.0, 99.0, 30.0)), (2, 1, 2, "y", 0.5, box(90.0, 60.0, 99.0, 70.0))]
    frame = with_geometry(spark.createDataFrame(rows, "doc_id long, page int, ordinal long, text string, confidence double, bbox array<array<double>>"))
    got = [(r.text, r.y_center, r.height) for r in vertical_split(frame).where("doc_id = 1").orderBy("y_center").collect()]
    assert got == [("a", 12.5, 25.0), ("b", 37.5, 25.0), ("a", 62.5, 25.0), ("b", 87.5, 25.0), ("x", 205.0, 10.0), ("y", 305.0, 10.0)]
    got = [(r.text, r.y_center, r.height) for r in vertical_split(frame).where("doc_id = 2 and x_min = 0").orderBy("y_center").collect()]
    assert got == [("b", 25.0, 10.0), ("b", 65.0, 10.0)]


def test_post_process_without_blocks_needs_review(spark):
    from papyra.operators.rules import post_process
    from papyra.plans.queries import built_in

    docs = spark.createDataFrame([(1, "发票号码：12345678"), (2, None), (3, "nothing")], "doc_id long, full_text string")
    blocks = spark.createDataFrame([], "doc_id long, line_index int, text string, confidence double")
    got = {r.field_name: (r.confidence, r.needs_review) for r in post_process(docs, blocks, built_in()).collect()}
    assert got == {"invoice_no": (0.0, True), "remark": (0.0, True)}
