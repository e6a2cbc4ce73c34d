"""Document fingerprints by context-triggered piecewise hashing.

A hash rolls over seven bytes; where it plus one is a multiple of the block size 3*2^k, a piece ends. Each piece's
hash gives one of 64 characters. A document has the smallest block size that gives at most 64 pieces, or half of it
where these are under 32 (then whatever follows the 63rd limit is one piece, so that a text of one stretch repeated has
a signature too), and its fingerprint is "block:signature:signature at twice the block".
Fingerprints are compared at equal block sizes: 1 - (insertions + deletions) / (both lengths), 0 where no run of seven
characters (or of the shorter signature, if that is shorter) is common. Equal fingerprints have 1.

Defined results: a null text is an empty text; empty texts have the fingerprint "3::"; the next document of several rows
with one doc_id goes by text hash and text; a single row is its own next document; an empty table gives no rows; further
columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import STEP_BYTES, batch_of, freed, stored
from .kernel import byte_sums, mix, range_hash

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW, PIECES, RUN = 7, 64, 7
_ROLL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)


def _limits(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of possible pieces, and the largest k for which each is one."""
    n = len(data)
    rolled = np.zeros(n, np.uint32)
    table = _ROLL[data]
    factor = 1
    for k in range(WINDOW):
        rolled[k:] += table[: max(n - k, 0)] * np.uint32(factor)
        factor = factor * 0x9E3779B1 & 0xFFFFFFFF
    rolled ^= rolled >> np.uint32(15)
    rolled *= np.uint32(0x2C1B3C6D)
    rolled ^= rolled >> np.uint32(13)
    rolled += np.uint32(1)
    at = np.flatnonzero((rolled % np.uint32(3) == 0))
    at = at[at - offsets[np.searchsorted(offsets, at, "right") - 1] >= WINDOW - 1]
    third = rolled[at] // np.uint32(3)
    low = third & (~third + np.uint32(1))
    level = np.where(third == 0, 31, np.log2(np.maximum(low, 1)).astype(np.int64))
    return at + 1, level


def fingerprint_rows(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, str, str]]:
    """(block size, signature, signature at twice the block size) of each row."""
    rows = len(offsets) - 1
    if not len(data):
        return [(3, "", "")] * rows
    ends, levels = _limits(data, offsets)
    sums = byte_sums(data)
    cut = np.searchsorted(ends, offsets, "right")  # an end at a row's start is the row before's
    out = []
    plans, starts, stops = [], [], []
    for i in range(rows):
        a, b = int(offsets[i]), int(offsets[i + 1])
        if a == b:
            plans.append((3, 0, 0))
            continue
        own, level = ends[cut[i] : cut[i + 1]], levels[cut[i] : cut[i + 1]]
        inside = own < b
        own, level = own[inside], level[inside]
        counts = np.bincount(level, minlength=32)[::-1].cumsum()[::-1]  # limits at block 3*2^k
        k = int(np.argmax(counts <= PIECES - 1)) if (counts <= PIECES - 1).any() else 30
        k -= k > 0 and counts[k] + 1 < PIECES // 2
        sizes = []
        for j in (k, k + 1):
            limits = own[level >= j][: PIECES - 1]
            starts.append(np.concatenate([[a], limits]))
            stops.append(np.concatenate([limits, [b]]))
            sizes.append(len(limits) + 1)
        plans.append((3 << k, *sizes))
    if starts:
        hashes = range_hash(sums, np.concatenate(starts).astype(np.int64), np.concatenate(stops).astype(np.int64)) >> np.uint64(58)
        letters = np.frombuffer(LETTERS.encode(), np.uint8)[hashes.astype(np.int64)].tobytes().decode()
    at = 0
    for size, first, second in plans:
        out.append((size, letters[at : at + first] if first else "", letters[at + first : at + first + second] if first else ""))
        at += first + second
    return out


_CODE = np.full(128, 0, np.int64)
_CODE[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(64)


def _matrix(signatures: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in signatures], np.int64)
    out = np.full((len(signatures), PIECES), -1, np.int64)
    flat = _CODE[np.frombuffer("".join(signatures).encode(), np.uint8)]
    out[np.arange(PIECES) < sizes[:, None]] = flat
    return out, sizes


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Likeness of signatures, pair by pair; 0 where one is empty and the other isn't, or no run is common."""
    a, n = _matrix(left)
    b, m = _matrix(right)
    rows = np.arange(len(a))
    # Longest common subsequence, bit by bit in parallel (Hyyro 2004): a bit of a 64-bit word a character of a.
    masks = np.zeros((len(a), 65), np.uint64)
    for i in range(PIECES):
        masks[rows, a[:, i]] |= np.uint64(1 << i)
    masks[:, 64] = 0
    v = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for j in range(PIECES):
            u = v & np.where(b[:, j] >= 0, masks[rows, b[:, j]], np.uint64(0))
            v = (v + u) | (v - u)
    inside = np.where(n == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1))
    common = np.bitwise_count(~v & inside).astype(np.int64)
    total = np.maximum(n + m, 1)
    out = 1 - (n + m - 2 * common) / total
    # The longest common run must have seven characters, or all of the shorter.
    need = np.minimum(np.minimum(n, m), RUN)
    longest = np.zeros(len(a), np.int64)
    run = np.zeros((len(a), PIECES), np.int8)
    for j in range(int(m.max(initial=0))):
        same = (a == b[:, j : j + 1]) & (b[:, j : j + 1] >= 0)
        shifted = np.zeros_like(run)
        shifted[:, 1:] = run[:, :-1]
        run = np.where(same, shifted + 1, 0).astype(np.int8)
        longest = np.maximum(longest, run.max(1))
    out[(longest < need) | ((need == 0) & (n + m > 0))] = 0
    out[(n == 0) & (m == 0)] = 1
    return out


def compare(left: list[tuple[int, str, str]], right: list[tuple[int, str, str]]) -> np.ndarray:
    """Likeness of fingerprints, pair by pair, from 0 to 1."""
    out = np.zeros(len(left))
    jobs: list[tuple[int, str, str]] = []
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        if x == y:
            out[i] = 1
        elif x[0] == y[0]:
            jobs += [(i, x[1], y[1]), (i, x[2], y[2])]
        elif x[0] == 2 * y[0]:
            jobs.append((i, x[1], y[2]))
        elif y[0] == 2 * x[0]:
            jobs.append((i, x[2], y[1]))
    if jobs:
        rows, a, b = zip(*jobs, strict=True)
        np.maximum.at(out, np.array(rows), likeness(list(a), list(b)))
    return out


def text_of(fingerprint: tuple[int, str, str]) -> str:
    return ":".join(map(str, fingerprint))


def fingerprints(texts: list[str]) -> list[tuple[int, str, str]]:
    out, at = [], 0
    parts = [t.encode() for t in texts]
    while at < len(parts):
        end, size = at, 0
        while end < len(parts) and (end == at or size + len(parts[end]) <= STEP_BYTES):
            size += len(parts[end])
            end += 1
        out += fingerprint_rows(np.frombuffer(b"".join(parts[at:end]), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts[at:end]])]).astype(np.int64))
        at = end
    return out


def edited(text: str, other: str) -> str:
    """text, its last floor(n/2) code points replaced by as many first ones of other, or by all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def edit_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness, in the ring of descending doc_id (null last).

    Texts are dealt by ranges of doc_id and sorted; each has its successor behind it. The first and last text of each
    task, two a task, come along in the output and are paired afterwards.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    down = F.col("doc_id").desc_nulls_last()
    dealt = rows.repartitionByRange(parts, down, "h").sortWithinPartitions(down, "h", "text").withColumn("part", F.spark_partition_id()).select("doc_id", "text", "part")
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part int, at int, text string"

    def result(ids: list, texts: list[str], id_type) -> tuple[pa.Schema, list]:
        """Rows for all but the last text."""
        prints, changed = fingerprints(texts), [edited(x, y) for x, y in zip(texts, texts[1:], strict=False)]
        other = fingerprints(changed)
        schema = pa.schema([("doc_id", id_type), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("at", pa.int32()), ("text", pa.string())])
        n = len(changed)
        values = [ids[:n], [len(t) for t in texts[:n]], [hashlib.sha256(t.encode()).hexdigest() for t in changed], [text_of(p) for p in prints[:n]], [text_of(p) for p in other], compare(prints[:-1], other), compare(prints[:-1], prints[1:])]
        return schema, values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size, part, id_type = 0, None, None

        def out() -> pa.RecordBatch:
            schema, values = result(ids, texts, id_type)
            return batch_of(schema, *values, *[[None] * len(values[0])] * 3)

        def end(at: int) -> pa.RecordBatch:
            schema, _ = result([], [""], id_type)
            return batch_of(schema, [ids[-at]], *[[None]] * 6, [part], [at], [texts[-at]])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if part is None:
                    part, id_type = batch.column(2)[0].as_py(), batch.schema.field(0).type
                    yield end(0)
                if size > STEP_BYTES and len(ids) > 1:
                    yield out()
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
        if len(ids) > 1:
            yield out()
        if ids:
            yield end(1)

    made = stored(dealt.mapInArrow(freed(run), columns), "fingerprints")
    # Two rows a task: the last of each with the first of the next task, and of the last with the first.
    ends = made.where("part is not null").select("doc_id", "part", "at", "text")
    first = ends.where("at = 0").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    # The window orders the tasks' numbers alone; texts meet by them.
    follows = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy()))
    last = ends.where("at = 1")
    last = last.join(last.select("part", follows.alias("next_part")), "part")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                one = batch.slice(k, 1)
                schema, values = result(one.column(0).to_pylist() * 2, [one.column(1)[0].as_py(), one.column(2)[0].as_py()], batch.schema.field(0).type)
                yield batch_of(schema, *values, [None], [None], [None])

    closing = last.join(first, "next_part").select("doc_id", "text", "next_text").mapInArrow(freed(close), columns)
    return made.where("part is null").unionByName(closing).drop("part", "at", "text")
