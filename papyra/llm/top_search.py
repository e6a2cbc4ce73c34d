"""Exact top-k search by integer inner product, pruned a block of documents at a time.

Vectors are scaled to integers; a component is a term, its value the weight. Vectors are put in order by their heaviest
terms and cut into blocks of consecutive ones. A block is a row: its vectors (the forward index), the maximum and the
minimum of each term, its smallest id. A query's bound of a block is the sum over terms of its weight times the maximum (the
minimum for negative weights), which no score in the block exceeds.

1. Each query's few best blocks by bound, from the table of maxima alone, are scored: its k-th result there is a first
   threshold, below its true one.
2. Queries are dealt into groups, blocks into chunks. A block goes to a group if its bound reaches the threshold of a query
   of the group; all others stay where they are.
3. Each (group, chunk) is a task of its own of bounded size: per query the blocks follow each other by falling bound, are
   scored against the forward index, raise the k-th result, and end when the next bound is below it. A bound that equals
   the k-th score counts as long as the block's smallest id is below the k-th id, as ties go to smaller ids.
4. A query's results of its chunks, k each at most, are ranked.

Only the table of maxima (a row a block) meets every query; groups visit it by chunks, so no task holds it whole. Where
blocks can't be told apart by their bounds, as vectors without clusters, nothing is pruned and every query meets all
vectors by blocks: exact, and in proportion to queries times vectors.

Defined results: vectors that are null or hold null or non-finite components take no part; a shorter vector counts as if
zeros followed, an empty one scores 0; rows of equal vec_id are rows of their own, so one may be the other's result; a
null vec_id is no query, and as a result comes after all others; further columns are left out. Products are exact: by
double precision where the sums stay under 2^53, else by whole numbers of any length; a score beyond 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, freed, numbered, stored

#: Vectors of a block and bytes that it may take; blocks of a chunk; queries of a group; blocks that a query tries first.
BLOCK, BLOCK_BYTES, CHUNK, GROUP, FIRST = 128, 1 << 17, 64, 1024, 2
_EXACT = float(1 << 53)
_NO_ID = np.iinfo(np.int64).max
_RESULT = "query long, query_id long, row long, vec_id long, score long"
_FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def packed(x: np.ndarray) -> bytes:
    """Whole numbers, as int16 if all fit, behind a byte that says so."""
    small = not x.size or np.abs(x).max() < 1 << 15
    return (b"\x02" + x.astype(np.int16).tobytes()) if small else (b"\x08" + x.astype(np.float64).tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int16 if raw[0] == 2 else np.float64, offset=1).astype(np.float64)


def matrix(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for o, r in zip(out, rows, strict=True):
        o[: len(r)] = r
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exactly: float64 where no sum can pass 2^53, else whole numbers of any length."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < _EXACT:
        return a @ b.T
    whole = lambda x: np.array([[int(v) for v in r] for r in x], object)
    return whole(a) @ whole(b).T


def bounds(queries: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    return products(np.maximum(queries, 0), most) + products(np.minimum(queries, 0), least)


class Best:
    """The k best of each query: scores falling, ids rising among equals, rows beside them."""

    def __init__(self, rows: np.ndarray, k: int, least: np.ndarray | None = None, least_id: np.ndarray | None = None):
        n = len(rows)
        self.rows, self.k = rows, k
        self.score = np.full((n, k), -np.inf, object if least is not None and least.dtype == object else np.float64)
        self.id, self.row = np.full((n, k), _NO_ID), np.full((n, k), -1, np.int64)
        self.floor = np.full(n, -np.inf) if least is None else least
        self.floor_id = np.full(n, _NO_ID) if least_id is None else least_id

    def wanted(self, bound: np.ndarray, first_id: np.ndarray) -> np.ndarray:
        """Whether a block of that bound and smallest id can hold a better result than the k-th, or one as good as the floor."""
        kth, kth_id = self.score[:, -1], self.id[:, -1]
        above = (bound > kth) | ((bound == kth) & (first_id < kth_id))
        return above & ((bound > self.floor) | ((bound == self.floor) & (first_id <= self.floor_id)))

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Takes in the scores of the queries `at` with the block's vectors."""
        scores = np.where(self.rows[at][:, None] == rows, -np.inf, scores)
        if scores.dtype == object:
            self.score = self.score.astype(object)
        s = np.concatenate([self.score[at], scores], 1)
        i = np.concatenate([self.id[at], np.broadcast_to(ids, scores.shape)], 1)
        r = np.concatenate([self.row[at], np.where(self.rows[at][:, None] == rows, -1, rows)], 1)
        if s.dtype == object:
            order = np.array([sorted(range(s.shape[1]), key=lambda c: (-a[c], b[c], d[c] < 0))[: self.k] for a, b, d in zip(s, i, r, strict=True)])
        else:
            order = np.lexsort((i, -s))[:, : self.k]
        self.score[at], self.id[at], self.row[at] = (np.take_along_axis(x, order, 1) for x in (s, i, r))

    def found(self, ids: list[int], floor: bool) -> pa.RecordBatch:
        q, c = np.nonzero(self.row >= 0)
        if floor:
            s = self.score[q, c]
            kept = (s > self.floor[q]) | ((s == self.floor[q]) & (self.id[q, c] <= self.floor_id[q]))
            q, c = q[kept], c[kept]
        names = np.asarray(ids, np.int64)[q]
        found = [None if i == _NO_ID else int(i) for i in self.id[q, c]]
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (self.rows[q], names, self.row[q, c], found, [int(s) for s in self.score[q, c]])], schema=_FOUND)


def scaled(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """Rows (row, vec_id, v, order) of the vectors that take part: v the packed whole numbers floor(scale * x), order their heaviest terms."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = batch.column(2)
        values = np.asarray(column.values.cast(pa.float64()).fill_null(float("nan")), np.float64)
        offsets, present = np.asarray(column.offsets), np.asarray(column.is_valid())
        out: list[tuple] = []
        for k in np.flatnonzero(present):
            x = values[offsets[k] : offsets[k + 1]]
            if np.isfinite(x).all():
                with np.errstate(over="raise"):
                    x = np.floor(x * scale)
                heavy = np.argsort(-np.abs(x), kind="stable")[:3]
                out.append((int(k), packed(x), [int(t) * 2 + (x[t] < 0) for t in heavy]))
        kept = pa.array([o[0] for o in out], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.list_(pa.int64()))], names=["row", "vec_id", "v", "order"])

    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return arrow_map(rows, run, "row long, vec_id long, v binary, order array<bigint>")


def _packs(rows: DataFrame, most: int) -> DataFrame:
    """Rows (row, vec_id, v), as they follow in their partition, in packs of `most` at most: rows, ids, vectors, most, least, first_id."""
    schema = "rows array<bigint>, ids array<bigint>, vectors array<binary>, most binary, least binary, first_id long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.int64())

        def pack(held: list[tuple]) -> pa.RecordBatch:
            numbers = [unpacked(v) for _, _, v in held]
            m = matrix(numbers, max(map(len, numbers)))
            first = min(_NO_ID if i is None else i for _, i, _ in held)
            row = ([r for r, _, _ in held], [i for _, i, _ in held], [v for _, _, v in held], packed(m.max(0)), packed(m.min(0)), first)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["rows", "ids", "vectors", "most", "least", "first_id"])

        held, size = [], 0
        for b in batches:
            for one in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (len(held) == most or size + len(one[2]) > BLOCK_BYTES):
                    yield pack(held)
                    held, size = [], 0
                held.append(one)
                size += len(one[2])
        if held:
            yield pack(held)

    return rows.select("row", "vec_id", "v").mapInArrow(freed(run), schema)


def _group(batch_rows: list[dict], width: int = 0) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Matrix, row numbers and ids of the queries of groups."""
    vectors = [unpacked(v) for g in batch_rows for v in g["vectors"]]
    return matrix(vectors, max([width, *map(len, vectors)])), np.array([r for g in batch_rows for r in g["rows"]], np.int64), [i for g in batch_rows for i in g["ids"]]


def _summary(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sides = [[unpacked(v) for v in table.column(c).to_pylist()] for c in ("most", "least")]
    width = max([width, *(len(v) for side in sides for v in side)])
    return matrix(sides[0], width), matrix(sides[1], width), np.array(table.column("first_id").to_pylist(), np.int64)


def _widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def search(vectors: DataFrame, asked: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest of each row for which `asked` (a column of vec_id) holds, among all other rows."""
    spark = vectors.sparkSession
    clean = stored(scaled(vectors, scale), "search-vectors")
    order = [F.get("order", F.lit(t)) for t in range(3)]
    near = clean.repartitionByRange(*order, "vec_id", "row").sortWithinPartitions(*order, "vec_id", "row")
    blocks = stored(numbered(_packs(near, BLOCK), "search-blocks", "block").withColumn("chunk", F.expr(f"block div {CHUNK}")), "search-chunks")
    sought = clean.where(asked)
    groups = stored(numbered(_packs(sought.repartitionByRange(*order, "vec_id", "row").sortWithinPartitions(*order, "vec_id", "row"), GROUP), "search-queries", "group"), "search-groups")
    summary = blocks.select("block", "chunk", "most", "least", "first_id")
    # Every group meets every part of the table of maxima.
    last_block, last_group = blocks.agg(F.max("block")).first()[0], groups.agg(F.max("group")).first()[0]
    if last_block is None or last_group is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    part = CHUNK * 64
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long")))
    parts = summary.select("block", "most", "least", "first_id", F.expr(f"block div {part}").alias("part"), upto(last_group).alias("group"))
    visits = lambda g: g.withColumn("part", upto(last_block // part))

    def first(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """The FIRST blocks of each query by bound, among those of a part."""
        out: dict[str, list] = {"query": [], "query_id": [], "v": [], "bound": [], "block": []}
        if left.num_rows and right.num_rows:
            most, least, _ = _summary(right, 0)
            names = np.array(right.column("block").to_pylist())
            for g in left.to_pylist():
                q, rows, ids = _group([g], most.shape[1])
                b = bounds(q, _widened(most, q.shape[1]), _widened(least, q.shape[1])).astype(np.float64)
                top = np.argsort(-b, axis=1, kind="stable")[:, :FIRST]
                for x, (r, i, v) in enumerate(zip(rows.tolist(), ids, g["vectors"], strict=True)):
                    for c in top[x]:
                        for name, value in zip(out, (r, i, v, float(b[x, c]), int(names[c])), strict=True):
                            out[name].append(value)
        return pa.table({"query": pa.array(out["query"], pa.int64()), "query_id": pa.array(out["query_id"], pa.int64()), "v": pa.array(out["v"], pa.binary()), "bound": pa.array(out["bound"], pa.float64()), "block": pa.array(out["block"], pa.int64())})

    tries = visits(groups.select("group", "rows", "ids", "vectors")).groupBy("group", "part").cogroup(parts.groupBy("group", "part")).applyInArrow(first, "query long, query_id long, v binary, bound double, block long")
    best = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    tries = tries.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= FIRST)

    def tried(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for one in batch.to_pylist():
            q, m = unpacked(one["v"]), [unpacked(v) for v in one["vectors"]]
            width = max([len(q), *map(len, m)])
            found = Best(np.array([one["query"]]), k)
            ids = np.array([_NO_ID if i is None else i for i in one["ids"]], np.int64)
            found.add(np.array([0]), products(matrix([q], width), matrix(m, width)), ids, np.array(one["rows"], np.int64))
            yield found.found([one["query_id"]], False)

    seeds = arrow_map(tries.select("query", "query_id", "v", "block").join(blocks.select("block", "rows", "ids", "vectors"), "block").select("query", "query_id", "v", "rows", "ids", "vectors"), tried, _RESULT)
    ranks = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    floors = seeds.withColumn("_k", F.row_number().over(ranks)).where(F.col("_k") == k).select("query", F.col("score").alias("floor"), F.coalesce("vec_id", F.lit(_NO_ID)).alias("floor_id"))
    # Each group's thresholds beside its queries: a list of GROUP at most.
    each = groups.select("group", F.posexplode("rows").alias("_at", "query")).join(floors, "query", "left")
    lists = each.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("_at", "floor", "floor_id"))).alias("f"))
    known = groups.join(lists, "group").select("group", "rows", "ids", "vectors", F.col("f.floor").alias("floors"), F.col("f.floor_id").alias("floor_ids"))
    known = stored(known, "search-floors")
    def thresholds(g: dict, rows: np.ndarray) -> Best:
        floor = np.array([-np.inf if f is None else float(f) for f in g["floors"]])
        if any(f is not None and abs(f) >= _EXACT for f in g["floors"]):
            floor = np.array([-np.inf if f is None else f for f in g["floors"]], object)
        return Best(rows, k, floor, np.array([_NO_ID if f is None else f for f in g["floor_ids"]], np.int64))

    def reaching(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """The blocks whose bound reaches the threshold of a query of the group."""
        out: list[tuple[int, int]] = []
        if left.num_rows and right.num_rows:
            most, least, first_id = _summary(right, 0)
            names = np.array(right.column("block").to_pylist())
            for g in left.to_pylist():
                q, rows, _ = _group([g], most.shape[1])
                b, now = bounds(q, _widened(most, q.shape[1]), _widened(least, q.shape[1])), thresholds(g, rows)
                wanted = np.zeros(len(names), bool)
                for c in range(len(names)):
                    wanted[c] = now.wanted(b[:, c], np.broadcast_to(first_id[c], len(rows))).any()
                out += [(g["group"], int(n)) for n in names[wanted]]
        return pa.table({"group": pa.array([o[0] for o in out], pa.int64()), "block": pa.array([o[1] for o in out], pa.int64())})

    pairs = stored(visits(known).groupBy("group", "part").cogroup(parts.groupBy("group", "part")).applyInArrow(reaching, "group long, block long"), "search-pairs")
    sent = pairs.join(blocks, "block").select("group", "chunk", "block", "rows", "ids", "vectors", "most", "least", "first_id")
    met = pairs.join(blocks.select("block", "chunk"), "block").select("group", "chunk").distinct()
    # Both sides of a cogroup need columns of their own.
    asking = known.join(met.withColumnRenamed("group", "_of"), F.col("group") == F.col("_of")).withColumn("at", F.col("chunk").alias("at")).drop("chunk", "_of")

    def scored(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """Blocks by falling bound for each query of the group, until the bounds fall below its k-th result."""
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        g = left.to_pylist()[0]
        most, least, first_id = _summary(right, 0)
        q, rows, ids = _group([g], most.shape[1])
        most, least = _widened(most, q.shape[1]), _widened(least, q.shape[1])
        blocks_here = right.select(["rows", "ids", "vectors"]).to_pylist()
        opened: dict[int, tuple] = {}
        b, best = bounds(q, most, least), thresholds(g, rows)
        order = np.argsort(-b.astype(np.float64), axis=1, kind="stable")
        at, going = np.arange(len(q)), np.ones(len(q), bool)
        for step in range(b.shape[1]):
            now = order[:, step]
            # Bounds of blocks that are beyond 2^53 are compared exactly, but put in order by their nearest doubles.
            going &= (b[at, now] >= np.maximum(best.score[:, -1], best.floor)) | (b.dtype == object)
            wanted = going & best.wanted(b[at, now], first_id[now])
            if not going.any():
                break
            for c in np.unique(now[wanted]):
                if c not in opened:
                    one = blocks_here[c]
                    opened[c] = (matrix([unpacked(v) for v in one["vectors"]], q.shape[1]), np.array([_NO_ID if i is None else i for i in one["ids"]], np.int64), np.array(one["rows"], np.int64))
                m, names, numbers = opened[c]
                who = np.flatnonzero(wanted & (now == c))
                best.add(who, products(q[who], m), names, numbers)
        return pa.Table.from_batches([best.found(ids, True)])

    results = asking.groupBy("group", "at").cogroup(sent.groupBy("group", "chunk")).applyInArrow(scored, _RESULT)
    ranked = results.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
