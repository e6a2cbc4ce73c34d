"""Many texts in many texts, by joins: a text that holds a key holds the key's anchor, a piece of it of a length from few.

Anchors' hashes are in a filter of bits, bounded in size, that goes to every task; texts send only the places that pass it,
and meet the keys by hash in an equi-join. A hash or a bit that is shared by chance costs a row, as what met is compared
whole; nothing is lost. So work grows with texts and keys, not with their product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Bits of the filter a key, of which it sets two, and bytes of it at most (fuller filters let more places through).
KEY_BITS, MOST_FILTER = 64, 64 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def windows(data: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hashes of all windows of so many bytes) for the powers of two up to most: a window is the pair of its halves."""
    h, size = _mixed(data.astype(np.uint64) + np.uint64(1)), 1
    while len(h) and size <= most:
        yield size, h
        if len(h) <= size:
            return
        with np.errstate(over="ignore"):
            h = _mixed(h[:-size] * _PRIME + h[size:] + np.uint64(size))
        size *= 2


def _bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings, one behind another, and where each begins (and the last ends)."""
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    a = a.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each key (key, ...) its first and last pieces of the largest power of two of bytes that it has."""
    for b in batches:
        data, at = _bytes(b.column(0))
        size = np.diff(at)
        length = 1 << np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)
        first, last = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
        for n, h in windows(data, int(length.max(initial=1))):
            of = np.flatnonzero((length == n) & (size > 0))
            first[of], last[of] = h[at[of]], h[at[of + 1] - n]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(length), pa.array(first.view(np.int64)), pa.array(last.view(np.int64))], names=[*b.schema.names, "length", "first", "last"])


def anchored(keys: DataFrame) -> DataFrame:
    """keys (key, which isn't empty, and others) with length and anchor: of its first and last piece the one that fewer keys have."""
    names = ", ".join(f"`{c}` {t}" for c, t in keys.dtypes)
    both = keys.mapInArrow(_pieces, f"{names}, length long, first long, last long")
    counts = both.select(F.explode(F.array("first", "last")).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    met = both.join(counts.withColumnsRenamed({"h": "first", "n": "_n"}), "first").join(counts.withColumnsRenamed({"h": "last", "n": "_m"}), "last")
    return met.select(*keys.columns, "length", F.when(F.col("_n") < F.col("_m"), F.col("first")).otherwise(F.col("last")).alias("anchor"))


class Filter:
    """The anchors' lengths and the bits of their hashes."""

    def __init__(self, lengths: list[int], bits: np.ndarray):
        self.lengths, self.bits, self.mask = lengths, bits, np.uint64(len(bits) * 8 - 1)

    def _set(self, h: np.ndarray) -> np.ndarray:
        slot = h & self.mask
        return (self.bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def places(self, a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of the places in an array of strings that pass, each once a row."""
        data, at = _bytes(a)
        rows, found = [], []
        for n, h in windows(data, max(self.lengths, default=0)):
            if n not in self.lengths:
                continue
            some = np.flatnonzero(self._set(h))
            some = some[self._set(h[some] >> np.uint64(32))]
            row = np.searchsorted(at, some, "right") - 1
            inside = some + n <= at[row + 1]
            rows.append(row[inside])
            found.append(h[some[inside]].view(np.int64))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(found)]), axis=1)
        return pairs[0], pairs[1]


def filtered(keys: DataFrame, most: int = MOST_FILTER) -> Filter:
    """The filter of anchored keys: their set bits come to the driver, as bytes of at most `most` in all."""
    lengths = [r.length for r in keys.select("length").distinct().collect()]
    wanted = max(keys.count() * KEY_BITS // 8, 1 << 10)
    size = 1 << min((wanted - 1).bit_length(), most.bit_length() - 1)
    both = F.explode(F.array("anchor", F.shiftrightunsigned("anchor", 32)))
    part, page = F.col("h").bitwiseAND(F.lit(size * 8 - 1)), 1 << 18
    pages = keys.select(both.alias("h")).select(F.shiftrightunsigned(part, 18).alias("p"), part.bitwiseAND(F.lit(page - 1)).cast("int").alias("b")).distinct()

    def pack(batch: pa.Table) -> pa.Table:
        bits = np.zeros(page, np.uint8)
        bits[batch.column("b").to_numpy()] = 1
        return pa.table({"p": batch.column("p").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(size, np.uint8)
    for r in pages.groupBy("p").applyInArrow(pack, "p long, bits binary").toLocalIterator():
        some = np.frombuffer(r.bits, np.uint8)
        here = out[r.p * (page // 8) : (r.p + 1) * (page // 8)]
        here |= some[: len(here)]
    return Filter(lengths, out)


def met(texts: DataFrame, keys: DataFrame, most: int = MOST_FILTER) -> DataFrame:
    """texts (text and others) with each key (key and others) that stands in them, once a pair."""
    ready = anchored(keys)
    return meeting(texts, ready, texts.sparkSession.sparkContext.broadcast(filtered(ready, most)))


def meeting(texts: DataFrame, ready: DataFrame, found: Broadcast) -> DataFrame:
    """met with anchored keys and their broadcast filter."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, anchor = found.value.places(b.column(b.schema.get_field_index("text")))
            taken = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(anchor)], names=[*b.schema.names, "anchor"])

    names = ", ".join(f"`{c}` {t}" for c, t in texts.dtypes)
    sent = texts.where("text is not null").mapInArrow(places, f"{names}, anchor long")
    return sent.join(ready.drop("length"), "anchor").where(F.col("text").contains(F.col("key"))).drop("anchor")
