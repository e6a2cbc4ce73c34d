"""Business documents, page blocks and task messages made from the star schema, in SQL that Spark and DuckDB share.

{fmt} is the one function with two names. Every fixture is a SELECT over the driver's tables and earlier fixtures.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CELL = """case c.col when 0 then p_name when 1 then p_type when 2 then '件' when 3 then cast(cast(l_quantity as int) as string) when 4 then concat(cast(l_partkey as string), '.50')
            when 5 then {fmt}('%.2f', l_extendedprice) when 6 then concat(cast(cast(round(l_tax * 100) as int) as string), '%') else {fmt}('%.2f', l_extendedprice) end"""
SQL = {
    "fx_docs": """
        select o_orderkey as doc_id,
          case o_orderkey % 4 when 0 then 'INVOICE' when 1 then 'CONTRACT' when 2 then 'EXPENSE' else 'UNKNOWN' end as expected,
          case o_orderkey % 4
            when 0 then concat('增值税电子发票', chr(10), '发票号码：', {fmt}('%08d', o_orderkey), chr(10),
              '开票日期：', cast(year(o_orderdate) as string), '年', cast(month(o_orderdate) as string), '月', cast(day(o_orderdate) as string), '日', chr(10),
              '销售方：名称：', replace(c_name, '#', ''), ' ', chr(10), '税额：¥', {fmt}('%.2f', o_totalprice), chr(10),
              '价税合计（小写）：¥', {fmt}('%.2f', o_totalprice), chr(10),
              case when o_orderkey % 3 = 0 then concat('备注：号码：', cast(o_custkey + 13800000000 as string), ' 账期：202504,202505') else '备注 无' end)
            when 1 then concat('购销协议 合同编号：HT-', cast(o_orderkey as string), chr(10), '甲方：', replace(c_name, '#', ''), ' ', chr(10),
              '签订日期：', cast(year(o_orderdate) as string), '/', cast(month(o_orderdate) as string), '/', cast(day(o_orderdate) as string), chr(10),
              '合同金额：¥', case when o_orderkey % 7 = 0 then concat(cast(o_orderkey % 90 + 10 as string), ',,', {fmt}('%03d', o_custkey % 1000), '.00') else {fmt}('%.2f', o_totalprice) end)
            when 2 then concat('Expense claim', chr(10), 'Date: ', {fmt}('%04d', year(o_orderdate)), '-', {fmt}('%02d', month(o_orderdate)), '-', {fmt}('%02d', day(o_orderdate)), chr(10),
              'Vendor: ', replace(c_name, '#', ''), chr(10), 'Total: $', {fmt}('%.2f', o_totalprice))
            else concat('Plain letter about order ', cast(o_orderkey as string), chr(10), 'Kind regards, ', replace(c_name, '#', '')) end as full_text
        from {orders} join {customer} on o_custkey = c_custkey""",
    "fx_amounts": """
        select o_orderkey as doc_id, 'amount' as field_name, 'INVOICE' as doc_type,
          case o_orderkey % 3 when 0 then replace({fmt}('%.2f', o_totalprice), '0', 'O') when 1 then replace({fmt}('%.2f', o_totalprice), '1', 'l') else replace({fmt}('%.2f', o_totalprice), '5', 'S') end as value
        from {orders}""",
    "fx_lines": """
        select l_orderkey as doc_id, p_name, p_type, l_partkey, l_quantity, l_extendedprice, l_tax,
          row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as rn
        from {lineitem} join {part} on l_partkey = p_partkey""",
    "fx_cells": f"""
        select doc_id, case when rn > 8 then 2 else 1 end as page, rn, c.col,
          {_CELL} as text,
          cast(40 + 150 * c.col as double) as x_min, cast(140 + 150 * c.col as double) as x_max,
          cast(120 + 40 * rn + (l_partkey * 7 + c.col * 3) % 5 as double) as y_min
        from {{fx_lines}} cross join (values (0), (1), (2), (3), (4), (5), (6), (7)) as c(col)""",
    "fx_pages_of": """select doc_id, page, max(rn) as last_rn from {fx_cells} group by doc_id, page""",
    "fx_blocks": """
        select doc_id, page, cast(row_number() over (partition by doc_id, page order by rn, col) - 1 as bigint) as ordinal, text,
          cast(100 - (doc_id + rn + col) % 40 as double) / cast(100 as double) as confidence, x_min, x_max, y_min, y_min + 24 as y_max,
          (x_min + x_max) / 2 as x_center, y_min + 12 as y_center, x_max - x_min as width, cast(24 as double) as height
        from (select doc_id, page, rn, col, text, x_min, x_max, y_min from {fx_cells}
          union all select doc_id, page, 0, h.col, h.name, cast(40 + 150 * h.col as double), cast(140 + 150 * h.col as double), cast(80 as double)
            from {fx_pages_of} cross join (values (0, '项目名称'), (1, '规格型号'), (2, '单位'), (3, '数量'), (4, '单价'), (5, '金额'), (6, '税率'), (7, '税额')) as h(col, name)
          union all select doc_id, page, 1000 + f.k, 0, f.name, cast(40 as double), cast(400 as double), cast(120 + 40 * (last_rn + 1 + f.k) as double)
            from {fx_pages_of} cross join (values (0, '小计 100'), (1, '价税合计（小写） 200'), (2, '备注 开票人 张三')) as f(k, name)) u""",
    "fx_page_sizes": """select doc_id, page, 1300 as width, cast(400 + 40 * last_rn as int) as height from {fx_pages_of}""",
    "fx_rows": """
        select doc_id, page, cast(row_index as int) as row_index, row_text, n_items from (
          select doc_id, page, dense_rank() over (partition by doc_id, page order by band) - 1 as row_index, row_text, n_items from (
            select doc_id, page, floor((y_center - 80) / 40) as band, count(*) as n_items, {agg_text} as row_text from {fx_blocks} group by doc_id, page, floor((y_center - 80) / 40)) r) q""",
    "fx_tasks": """
        select event_id as message_id, user_id, concat('t-', cast(user_id as string)) as tid, event_type, case when event_type = 'purchase' then 'EVIDENCE_ENRICH' else 'FULL_PAGE' end as kind,
          cast(event_id % 5 as int) as retry, event_type = 'error' as failed, value, ts, case when event_id % 50 = 0 then '' else concat('t-', cast(user_id as string)) end as task_id, event_id % 2 = 0 as camel
        from {events}""",
}
TABLES = ("orders", "customer", "lineitem", "part", "events", "documents", "nation", "region", "pages")
_FMT = {"spark": "format_string", "duckdb": "printf"}
_AGG = {"spark": "array_join(transform(array_sort(collect_list(struct(x_center, ordinal, text))), x -> x.text), ' ')", "duckdb": "string_agg(text, ' ' order by x_center, ordinal)"}


def _names(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\{([a-z_]+)\}", sql)) if n not in ("fmt", "agg_text")]


#: Fixtures that are written already: (folder of the tables, name) to path.
BUILT: dict[tuple[str, str], str] = {}


def build(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Writes all fixtures once, so that queries read them instead of working them out: for measurements."""
    for name in SQL:
        frame(spark, sf_dir, name).write.parquet(f"{folder}/{name}")
        BUILT[sf_dir, name] = f"{folder}/{name}"


#: Lines or documents of a partition, about eleven blocks a line: what later steps sort by page stays in memory.
PARTITION_LINES = 50_000
_FIRST = ("项目名称", "规格型号", "单位", "数量", "单价", "金额", "税率", "税额")
_LAST = ("小计 100", "价税合计（小写） 200", "备注 开票人 张三")


def _parts(spark: SparkSession, rows: int) -> int:
    """Partitions of about PARTITION_LINES rows; of few rows no more than the session's number."""
    return max(rows // PARTITION_LINES + 1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 5_000 + 1))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_docs dealt by document before their texts are made, so that lines and fields of a document meet where they are."""
    if (sf_dir, "fx_docs") in BUILT:
        return frame(spark, sf_dir, "fx_docs")
    orders, customer = frame(spark, sf_dir, "orders"), frame(spark, sf_dir, "customer")
    met = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "c_name")
    select, _ = SQL["fx_docs"].split("from {orders}")
    return spark.sql(select.replace("{fmt}", _FMT["spark"]) + "from {met}", met=met.repartition(_parts(spark, orders.count()), "o_orderkey"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_lines with page, first_rn and last_rn of the page, dealt by document; nothing later need be dealt again."""
    lines = frame(spark, sf_dir, "lineitem")
    met = lines.join(frame(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).repartition(_parts(spark, lines.count()), "l_orderkey")
    order = "l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
    w = Window.partitionBy("l_orderkey").orderBy(*order)
    rn, n = F.row_number().over(w), F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("int")
    numbered = met.select(F.col("l_orderkey").alias("doc_id"), "p_name", "p_type", "l_partkey", "l_quantity", "l_extendedprice", "l_tax", rn.alias("rn"), n.alias("n"))
    first = F.col("rn") <= 8
    return numbered.select("*", F.when(first, 1).otherwise(2).alias("page"), F.when(first, 1).otherwise(9).alias("first_rn"), F.when(first, F.least("n", F.lit(8))).otherwise(F.col("n")).alias("last_rn"))


def _pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where("rn = last_rn").select("doc_id", "page", "last_rn")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of SQL's fx_blocks from one pass over the lines: a page's first line brings the header cells, its last one the rows below the table.

    Blocks are never dealt or sorted. Ordinals follow from a line's number: header cells are row 0 and the rows below
    1000 and on, so those stand before lines of their number or above.
    """
    codes = lambda *runs: F.array(*(F.lit(k) for r in runs for k in r))
    cells, heads, feet = range(8), range(8, 16), range(16, 19)
    opens, ends = F.col("rn") == F.col("first_rn"), F.col("rn") == F.col("last_rn")
    made = F.when(opens & ends, codes(cells, heads, feet)).when(opens, codes(cells, heads)).when(ends, codes(cells, feet)).otherwise(codes(cells))
    each = _lines(spark, sf_dir).select("*", F.explode(made).alias("code"))
    code, rn, first = F.col("code"), F.col("rn"), F.col("first_rn")
    of = lambda cell, head, foot: F.when(code < 8, cell).when(code < 16, head).otherwise(foot)
    foot = code - 16
    before = F.greatest(F.least(F.col("last_rn"), foot + 999) - first + 1, F.lit(0))
    past = F.least(F.greatest(rn - 999, F.lit(0)), F.lit(3))
    each = each.withColumns({"row": of(rn, F.lit(0), foot + 1000), "col": of(code, code - 8, F.lit(0))})
    name = lambda names, k: F.get(F.array(*map(F.lit, names)), k)
    cell = F.expr(_CELL.replace("c.col", "col").replace("{fmt}", _FMT["spark"]))
    top = of(120 + 40 * rn + (F.col("l_partkey") * 7 + code * 3) % 5, F.lit(80), 120 + 40 * (F.col("last_rn") + 1 + foot)).cast("double")
    each = each.select(
        "doc_id", "page", of(8 + 8 * (rn - first) + code + past, code - 8, 8 + 8 * before + foot).cast("bigint").alias("ordinal"), of(cell, name(_FIRST, code - 8), name(_LAST, foot)).alias("text"),
        ((100 - (F.col("doc_id") + F.col("row") + F.col("col")) % 40).cast("double") / 100.0).alias("confidence"), (40 + 150 * F.col("col")).cast("double").alias("x_min"),
        of((140 + 150 * F.col("col")), (140 + 150 * F.col("col")), F.lit(400)).cast("double").alias("x_max"), top.alias("y_min"),
    )
    high = F.lit(24.0)
    return each.select("*", (F.col("y_min") + 24).alias("y_max"), ((F.col("x_min") + F.col("x_max")) / 2).alias("x_center"), (F.col("y_min") + 12).alias("y_center"), (F.col("x_max") - F.col("x_min")).alias("width"), high.alias("height"))


#: Fixtures of which Spark makes the rows of the SQL in its own way.
_DEALT = {"fx_blocks": _blocks, "fx_pages_of": _pages_of}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a fixture and all it stands on, as a DataFrame."""
    if (sf_dir, name) in BUILT:
        return spark.read.parquet(BUILT[sf_dir, name])
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in _DEALT:
        return _DEALT[name](spark, sf_dir)
    sql = SQL[name].replace("{fmt}", _FMT["spark"]).replace("{agg_text}", _AGG["spark"])
    return spark.sql(sql, **{n: frame(spark, sf_dir, n) for n in _names(sql)})


def duck(sql: str) -> str:
    """DuckDB SQL over fixtures named {fx_...}: they become common table expressions."""
    needed: dict[str, str] = {}

    def need(text: str) -> str:
        for n in _names(text):
            if n in SQL and n not in needed:
                body = need(SQL[n])
                needed[n] = body
        return re.sub(r"\{([a-z_]+)\}", lambda m: _FMT["duckdb"] if m[1] == "fmt" else _AGG["duckdb"] if m[1] == "agg_text" else m[1], text)

    main = need(sql)
    if not needed:
        return main
    head = ",\n".join(f"{n} as ({body})" for n, body in needed.items())
    recursive = main.lstrip().lower().startswith("with recursive")
    if recursive:
        return f"with recursive {head},\n" + main.lstrip()[len("with recursive") :]
    return f"with {head},\n" + main.lstrip()[len("with") :] if main.lstrip().lower().startswith("with ") else f"with {head}\n{main}"
