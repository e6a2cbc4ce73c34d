"""Embedding near-dedup: an exact metric range join under cosine.

Vectors are normalised, so cosine >= c means a distance of at most r = sqrt(2 - 2c). Pivots partition them: a
vector's home cell is that of its nearest pivot. If x is at home in cell i and y in cell h, the triangle inequality
puts every point within r of y no farther beyond the bisector of the two pivots than r, so y must be taken to cell i
only if (d(y,i)^2 - d(y,h)^2) / (2 d(i,h)) <= r. Of a pair of cells, only the lower-numbered compares it. Cells with
more than `block` vectors are dealt into blocks by hash; each block holds its own vectors and streams its visitors,
so memory is bounded whatever the cell. Blocks count links and send one edge a vector with links, never pairs; equal
vectors are one vector with a multiplicity throughout.

Pivots come from a bounded sample (SAMPLE times as many vectors, those with the smallest hashes) by farthest-first
choice; they affect speed alone. There is one for each `block` vectors, from LEAST_PIVOTS to MOST_PIVOTS, so cells keep
their size as the input grows; what goes to or comes from the driver is in proportion to them. Where vectors have no
clusters, as in high dimensions, bounds exclude little and the join compares all pairs of blocks: exact, and quadratic in
the input, with each vector sent to about N / (2 * block) blocks.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors
of different lengths don't link; rows of equal vec_id each have a row, and count each other as copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, components, freed, numbered, stored

LEAST_PIVOTS, MOST_PIVOTS, SAMPLE, BLOCK = 16, 1024, 4, 4096


def unit_rows(raw: list[bytes]) -> np.ndarray:
    """Vectors of one length, as float64 of norm 1; scaled first, so that no square overflows."""
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def linked(left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of unit rows reach the cosine; what is within rounding of it is worked out again, exactly summed."""
    c = left @ right.T
    out = c >= least
    close = np.abs(c - least) < 1e-12
    if close.any():
        for i, j in zip(*np.nonzero(close), strict=True):
            out[i, j] = cosine(left[i], right[j]) >= least
    return out


def _valid(vectors: pa.Array) -> list[bytes | None]:
    """Components as float64 bytes; None where a vector links with nothing. -0.0 counts as 0.0."""
    out: list[bytes | None] = []
    values = vectors.values
    whole = np.asarray(values.cast(pa.float64()).fill_null(float("nan")), np.float64) + 0.0
    offsets = np.asarray(vectors.offsets)
    present = np.asarray(vectors.is_valid())
    for i in range(len(vectors)):
        x = whole[offsets[i] : offsets[i + 1]]
        out.append(x.tobytes() if present[i] and len(x) and np.isfinite(x).all() and x.any() else None)
    return out


def _farthest(sample: np.ndarray, n: int) -> np.ndarray:
    chosen = [0]
    far = 2 - 2 * sample @ sample[0]
    while len(chosen) < min(n, len(sample)) and far.max() > 1e-9:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, 2 - 2 * sample @ sample[chosen[-1]])
    return sample[chosen]


class Cells:
    """Home cells of unit vectors, and the lower-numbered cells that they visit."""

    def __init__(self, pivots: np.ndarray, least: float):
        self.pivots = pivots
        self.radius = math.sqrt(max(2 - 2 * least, 0.0)) + 1e-9
        self.apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0)) + np.eye(len(pivots))

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home cell of each row, and a mask (rows, cells) of its home and the cells before it that its ball reaches."""
        near = x @ self.pivots.T
        home = near.argmax(1)
        beyond = (near[np.arange(len(x)), home][:, None] - near) / self.apart[home]
        reach = beyond <= self.radius
        reach &= np.arange(len(self.pivots)) <= home[:, None]
        return home, reach


def pivot_count(vectors: int, block: int = BLOCK) -> int:
    return min(max(-(-vectors // block), LEAST_PIVOTS), MOST_PIVOTS)


def range_join(vectors: DataFrame, least: float = 0.9, block: int = BLOCK, pivots: int | None = None) -> DataFrame:
    """vec_id, n_links long, component_id long, kept boolean: a row for each row of vectors."""
    spark = vectors.sparkSession

    def clean(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw = _valid(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["vec_id", "v"])

    rows = arrow_map(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")), clean, "vec_id long, v binary")
    keyed = stored(rows.withColumn("key", F.sha2("v", 256)), "vectors")
    good = keyed.where("v is not null")
    # One row a distinct vector; ids are its own, whatever the ids of its rows.
    distinct = good.groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    distinct = numbered(distinct.withColumn("width", (F.length("v") / 8).cast("int")), "vectors-distinct", "node")
    pivots = pivots or pivot_count(distinct.count(), block)
    sample = distinct.orderBy(F.xxhash64("key"), "key").limit(SAMPLE * max(pivots, 512)).select("v").toPandas()["v"]  # bounded by the pivots
    by_width: dict[int, list[bytes]] = {}
    for v in sample:
        by_width.setdefault(len(v) // 8, []).append(bytes(v))
    cells = {w: Cells(_farthest(unit_rows(raw), pivots), least) for w, raw in by_width.items()}

    def home(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, widths = batch.column(1).to_pylist(), np.asarray(batch.column(2))
        homes, visits = np.zeros(len(raw), np.int32), [[0]] * len(raw)
        for w in np.unique(widths):
            if (own := cells.get(int(w))) is not None:
                at = np.flatnonzero(widths == w)
                h, reach = own.home(unit_rows([raw[i] for i in at]))
                homes[at] = h
                for i, r in zip(at, reach, strict=True):
                    visits[i] = np.flatnonzero(r).tolist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(homes, pa.int32()), pa.array(visits, pa.list_(pa.int32()))], names=["node", "width", "home", "visits"])

    housed = arrow_map(distinct.select("node", "v", "width"), home, "node long, width int, home int, visits array<int>")
    placed = stored(distinct.select("node", "v", "copies").join(housed, "node"), "vectors-cells")
    sizes = placed.groupBy("width", "home").count().collect()  # a row a pivot and vector length
    blocks: dict[tuple[int, int], tuple[int, int]] = {}
    total = 0
    for r in sorted(sizes, key=lambda r: (r.width, r.home)):
        n = -(-r["count"] // block)
        blocks[r.width, r.home] = (total, n)
        total += n
    ranges = spark.createDataFrame([(w, c, at, n) for (w, c), (at, n) in blocks.items()] or [(0, 0, 0, 0)], "width int, cell int, first int, n int")
    own_block = lambda first, n: F.col(first) + F.pmod(F.col("node"), F.greatest(F.col(n), F.lit(1))).cast("int")
    homes = F.broadcast(ranges)  # a row a cell, of which there are at most MOST_PIVOTS a vector length
    own = placed.join(homes.select("width", F.col("cell").alias("home"), F.col("first").alias("home_first"), F.col("n").alias("home_n")), ["width", "home"]).withColumn("mine", own_block("home_first", "home_n"))
    visits = own.withColumn("cell", F.explode("visits")).join(homes, ["width", "cell"])
    visits = visits.withColumn("block", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1))).where("block <= mine")
    dealt = visits.select("block", (F.col("block") != F.col("mine")).cast("int").alias("guest"), "node", "copies", "v")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total)
    dealt = dealt.repartition(parts, "block").sortWithinPartitions("block", "guest")
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("least", pa.int64())])

    class Block:
        """The vectors of a block, their link counts, and labels that join what guests link."""

        def __init__(self, first: int):
            self.number, self.own, self.v, self.copies = first, [], [], []
            self.x = None

        def open(self) -> None:
            self.x, self.ids, self.weights = unit_rows(self.v), np.array(self.own), np.array(self.copies, np.int64)
            self.links, self.labels = np.zeros(len(self.ids), np.int64), self.ids.copy()
            self.v, self.moves = [], [np.zeros((2, 0), np.int64)]
            for a in range(0, len(self.ids), 2048):
                hit = linked(self.x, self.x[a : a + 2048], least)
                hit[np.arange(a, min(a + 2048, len(self.ids))), np.arange(hit.shape[1])] = False
                self.links += hit @ self.weights[a : a + 2048]
                self.join(hit, self.labels[a : a + 2048].copy())

        def join(self, hit: np.ndarray, guests: np.ndarray) -> np.ndarray:
            """Labels of the guests after all that they link share the smallest."""
            rows, columns = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
            if not len(rows):
                return guests
            part, top = hit[np.ix_(rows, columns)], np.iinfo(np.int64).max
            while True:
                mine = np.where(part, self.labels[rows][:, None], top).min(0)
                guests[columns] = np.minimum(guests[columns], mine)
                new = np.minimum(self.labels[rows], np.where(part, guests[columns][None, :], top).min(1))
                old = self.labels[rows]
                moved = new != old
                if not moved.any():
                    return guests
                # What else has an old label is linked to the new one.
                self.moves.append(np.unique(np.stack([old[moved], new[moved]]), axis=1))
                self.labels[rows] = new

        def visit(self, ids: list, raw: list, weights: list) -> pa.RecordBatch | None:
            if not len(self.ids):
                return None
            hit = linked(self.x, unit_rows(raw), least)
            columns = np.flatnonzero(hit.any(0))
            if not len(columns):
                return None
            hit = hit[:, columns]
            self.links += hit @ np.array(weights, np.int64)[columns]
            nodes = np.array(ids)[columns]
            labels = self.join(hit, nodes.copy())
            return batch_of(schema, nodes, self.weights @ hit, labels)

        def close(self) -> pa.RecordBatch:
            old, new = np.unique(np.concatenate(self.moves, axis=1), axis=1)
            return batch_of(schema, np.concatenate([self.ids, old]), np.concatenate([self.links, np.zeros(len(old), np.int64)]), np.concatenate([self.labels, new]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Block | None = None
        for whole in batches:
            for a in range(0, len(whole), 1024):
                piece = whole.slice(a, 1024)
                numbers, guests = np.asarray(piece.column(0)), np.asarray(piece.column(1))
                cut = [0, *(np.flatnonzero((np.diff(numbers) != 0) | (np.diff(guests) != 0)) + 1).tolist(), len(piece)]
                for s, e in zip(cut, cut[1:], strict=False):
                    if s == e:
                        continue
                    ids, copies, raw = (piece.column(k).slice(s, e - s).to_pylist() for k in (2, 3, 4))
                    if now is None or now.number != numbers[s]:
                        if now is not None:
                            if now.x is None:
                                now.open()
                            yield now.close()
                        now = Block(int(numbers[s]))
                    if not guests[s]:
                        now.own += ids
                        now.v += raw
                        now.copies += copies
                        continue
                    if now.x is None:
                        now.open() if now.own else setattr(now, "ids", ())
                    if (out := now.visit(ids, raw, copies)) is not None:
                        yield out
        if now is not None and (now.x is not None or now.own):
            if now.x is None:
                now.open()
            yield now.close()

    found = stored(dealt.mapInArrow(freed(compare), "node long, links long, least long"), "vectors-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")), "vectors")
    nodes = distinct.select("node", "key", "id", "copies").join(links, "node", "left").join(joined.withColumnRenamed("id", "node"), "node", "left")
    nodes = nodes.withColumn("component", F.coalesce("component", "node"))
    smallest = nodes.groupBy("component").agg(F.min("id").alias("component_id"))
    nodes = nodes.join(smallest, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = keyed.select("vec_id", "key").join(nodes, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
