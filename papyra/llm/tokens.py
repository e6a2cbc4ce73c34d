"""Token ids in a byte-aligned binary format, and back.

Documents are tokenised by the tokenizers library in ascending order of doc_id (null first). Texts split into the
pre-tokens of the GPT-2 pattern in numpy, distinct pre-tokens go to the library once and are kept; a text with an
added token's string, or with a character outside the ranges below, goes to the library as a whole.

Ids are replaced by their ranks in the frequency order of the whole corpus (ties by id), and ranks are coded in one
to four bytes: two bits a rank in separate control bytes, four ranks each, say how many. A file is a table of blocks
in the shared folder, written and committed by Spark, which any executor can redo; a block is

    magic "PAPYTOK1", uint32 documents, uint64 ids, then for each document a uint32 count, then the control bytes,
    then the data bytes (little-endian)

beside its documents' ids, its place and the ids before it in its part. The rank table is written with it.

Defined results: null and empty texts have the end id alone; rows of equal doc_id are documents of their own, in the
order of their texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, freed, steps, text_bytes, work_folder
from .kernel import prefix_sums, range_hash
from .slots import Slots

MAGIC = b"PAPYTOK1"
#: Code points whose classes all Unicode versions since 6.0 agree on and that numpy splits; others go to the library.
_KNOWN = ((0x0, 0x530), (0x5D0, 0x5EB), (0x1E00, 0x1F00), (0x2000, 0x2065), (0x20A0, 0x20BA), (0x2100, 0x218A), (0x2190, 0x23F4), (0x3000, 0x3100), (0x4E00, 0x9FCC), (0xAC00, 0xD7A4))
_SPACES = (*range(0x9, 0xE), 0x20, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_LETTER, _NUMBER, _OTHER, _SPACE, _STRANGE = range(5)


def _classes() -> np.ndarray:
    import unicodedata

    out = np.full(0x110000, _STRANGE, np.uint8)
    for a, b in _KNOWN:
        for c in range(a, b):
            kind = unicodedata.category(chr(c))
            if kind != "Cn":
                out[c] = _LETTER if kind[0] == "L" else _NUMBER if kind[0] == "N" else _OTHER
    out[list(_SPACES)] = _SPACE
    return out


def pretoken_starts(points: np.ndarray, kinds: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in texts end to end, by the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ ; firsts: where texts start.
    """
    n = len(points)
    border = np.zeros(n + 1, bool)
    border[firsts] = True
    border[n] = True
    start = border[:n].copy()
    start[1:] |= kinds[1:] != kinds[:-1]
    space = kinds == _SPACE
    # The last of white space before something else: a token by itself, or the front of what follows if it is " ".
    last = space.copy()
    last[:-1] &= ~space[1:]
    last &= ~border[1:]
    start |= last
    at = np.flatnonzero(last & (points == 32))
    start[at + 1] = False
    # An apostrophe alone, without a space in front, takes s t m d re ve ll that follow.
    quote = np.flatnonzero((points == 39) & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kinds[quote + 1] == _LETTER) & ~border[quote + 1]]
    if len(quote):
        one = np.isin(points[quote + 1], [ord(c) for c in "stmd"])
        second = np.minimum(quote + 2, n - 1)
        inside = (quote + 2 < n) & ~border[quote + 2 - (quote + 2 > n)]
        pair = points[quote + 1].astype(np.int64) << 32 | points[second]
        two = ~one & inside & np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])
        start[quote[one | two] + 1] = False
        rest = quote[one | two] + np.where(one, 2, 3)[one | two]
        start[rest[(rest < n)]] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of texts by the tokenizers library, with a cache of pre-tokens."""

    def __init__(self, description: bytes):
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(description.decode())
        spec = json.loads(description)
        pre = spec["pre_tokenizer"] or {}
        self.splits = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec["normalizer"] and spec["model"]["type"] == "BPE"
        self.added = [t["content"] for t in spec["added_tokens"]]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.shown = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.kinds = _classes()
        self.cache = Slots()

    def _whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each row's first id."""
        rows = len(offsets) - 1
        raw = data.tobytes()
        text = raw.decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        heads = (data & 0xC0) != 0x80
        chars = np.concatenate([[0], np.cumsum(heads)])[offsets] if len(data) else np.zeros(rows + 1, np.int64)
        kinds = self.kinds[points]
        odd = np.zeros(rows, bool)
        strange = np.flatnonzero(kinds == _STRANGE)
        odd[np.searchsorted(chars, strange, "right") - 1] = True
        if any(a in text for a in self.added):
            for i in range(rows):
                odd[i] |= any(a in text[chars[i] : chars[i + 1]] for a in self.added)
        if not self.splits:
            odd[:] = True
        if len(points):
            starts = pretoken_starts(points, kinds, chars[:-1][np.diff(chars) > 0])
            ends = np.append(starts[1:], len(points))
            keys, at, inverse = np.unique(range_hash(prefix_sums((points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)), starts, ends), return_index=True, return_inverse=True)
            if self.cache.full():
                self.cache.clear()
            slots = self.cache.find(keys)
            new = np.flatnonzero(slots < 0)
            if len(new):
                tokenize, shown = self.library.model.tokenize, self.shown
                ids = [[t.id for t in tokenize(text[starts[k] : ends[k]].encode().decode("latin-1").translate(shown))] for k in at[new].tolist()]
                slots[new] = self.cache.add(keys[new], np.array([len(x) for x in ids], np.int32), np.array([i for x in ids for i in x], np.int32))
            flat, counts = self.cache.gather(slots[inverse])
            cut = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, chars)]
        else:
            flat, cut = np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        if odd.any():
            parts = [np.array(self._whole(text[chars[i] : chars[i + 1]]), np.int32) if odd[i] else flat[cut[i] : cut[i + 1]] for i in range(rows)]
            flat, cut = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return flat, cut


_encoders: dict[str, Encoder] = {}


def encoder(description: bytes) -> Encoder:
    name = hashlib.sha256(description).hexdigest()
    if name not in _encoders:
        _encoders[name] = Encoder(description)
    return _encoders[name]


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks under 2**32."""
    ranks = ranks.astype("<u4")
    sizes = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = sizes - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < sizes[:, None]].tobytes()


#: Byte counts of the four ranks of each control byte.
SIZES = np.stack([(np.arange(256) >> s & 3) + 1 for s in (0, 2, 4, 6)], 1).astype(np.int64)


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks again: byte counts by table look-up, values by gathering at their running sums."""
    sizes = SIZES[np.frombuffer(control, np.uint8)].ravel()[:n]
    starts = np.cumsum(sizes) - sizes
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    out = raw[starts].astype(np.uint32)
    for k in range(1, int(sizes.max(initial=1))):
        more = np.flatnonzero(sizes > k)
        out[more] |= raw[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def block(counts: np.ndarray, ranks: np.ndarray) -> bytes:
    return b"".join([MAGIC, np.uint32(len(counts)).tobytes(), np.uint64(len(ranks)).tobytes(), counts.astype("<u4").tobytes(), *pack(ranks)])


def read_block(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Counts of ids by document, and all ranks."""
    if raw[:8] != MAGIC:
        raise ValueError("no token block")
    documents, n = int(np.frombuffer(raw, "<u4", 1, 8)[0]), int(np.frombuffer(raw, "<u8", 1, 12)[0])
    at = 20 + 4 * documents
    end = at + -(-n // 4)
    return np.frombuffer(raw, "<u4", documents, 20).astype(np.int64), unpack(raw[at:end], raw[end:], n)


@dataclass(frozen=True)
class Files:
    """Where a corpus's token files are."""

    blocks: str
    ranks: str


def _narrow(limit: int):
    return np.dtype("<u2") if limit <= 1 << 16 else np.dtype("<u4")


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> Files:
    """Tokenises docs and writes the files, in ascending order of doc_id; the end id follows each document."""
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as file:
        raw = file.read()
    shared = spark.sparkContext.broadcast(raw)
    library = encoder(raw).library
    limit = max(library.get_vocab_size(), end_id + 1)
    narrow = _narrow(limit)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())
    unit = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("ids", pa.binary()), ("tally", pa.binary())])

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seq, part = encoder(shared.value), 0, None
        tally = np.zeros(limit, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            part = batch.column(2)[0].as_py()
            data, offsets = text_bytes(batch.column(1))
            for a, b in steps(offsets):
                flat, cut = own.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                flat = np.insert(flat, cut[1:], end_id)
                counts = np.diff(cut) + 1
                tally += np.bincount(flat, minlength=limit)
                yield batch_of(unit, [part], [seq], [batch.column(0).slice(a, b - a).to_pylist()], [counts], [flat.astype(narrow).tobytes()], [None])
                seq += 1
        if part is not None:
            yield batch_of(unit, [part], [-1], [[]], [[]], [b""], [tally.tobytes()])

    first = work_folder(spark, "token-ids")
    # Each part is one task and one file; its units are in order.
    ordered.mapInArrow(freed(tokenise), "part int, seq long, doc_ids array<long>, counts array<int>, ids binary, tally binary").write.option("compression", "zstd").parquet(first)
    units = spark.read.parquet(first)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(limit, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x, np.int64)
        ids = np.flatnonzero(total)
        yield batch_of(pa.schema([("id", pa.int64()), ("n", pa.int64())]), ids, total[ids])

    tallies = units.where("tally is not null").select("tally").mapInArrow(freed(spread), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    got = tallies.toPandas()  # a row a vocabulary entry at most
    order = np.lexsort((got["id"], -got["n"]))
    by_rank = got["id"].to_numpy()[order]
    rank_of = np.zeros(limit, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    ranks = work_folder(spark, "token-ranks")
    spark.createDataFrame(pa.table({"id": by_rank, "n": got["n"].to_numpy()[order], "rank": np.arange(len(by_rank))})).coalesce(1).write.parquet(ranks)
    table = spark.sparkContext.broadcast(rank_of)  # as long as the vocabulary
    final = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("block", pa.binary())])

    def write(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in range(len(batch)):
            one = batch.slice(row, 1)
            counts = np.asarray(one.column(3).flatten())
            ids = np.frombuffer(one.column(4)[0].as_py(), narrow)
            yield batch_of(final, one.column(0), one.column(1), one.column(2), [len(ids)], [block(counts, table.value[ids])])

    blocks = work_folder(spark, "token-blocks")
    arrow_map(units.where("seq >= 0").select("part", "seq", "doc_ids", "counts", "ids"), write, "part int, seq long, doc_ids array<long>, n_ids long, block binary").write.option("compression", "zstd").parquet(blocks)
    return Files(blocks, ranks)


def read_tokens(spark, files: Files, ids: bool = True) -> DataFrame:
    """doc_id, start long (ids of all documents before), n_tokens long, ids_crc32 long, and with ids the ids as array<int>, from the files."""
    ranks = spark.read.parquet(files.ranks).toPandas()  # as long as the vocabulary
    by_rank = np.zeros(max(len(ranks), 1), np.uint32)
    by_rank[ranks["rank"]] = ranks["id"]
    table = spark.sparkContext.broadcast(by_rank)
    blocks = spark.read.parquet(files.blocks)
    totals = blocks.groupBy("part", "seq").agg(F.sum("n_ids").alias("n"))
    parts = totals.groupBy("part").agg(F.sum("n").alias("n"))
    before_part = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")  # a row a part
    before_unit = totals.withColumn("own", F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if ids else [])])

    def read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in range(len(batch)):
            one = batch.slice(row, 1)
            counts, found = read_block(one.column("block")[0].as_py())
            flat = table.value[found].astype("<u4")
            cut = np.concatenate([[0], np.cumsum(counts)])
            crcs = [zlib.crc32(flat[cut[i] : cut[i + 1]]) for i in range(len(counts))]
            n = len(counts)
            yield batch_of(schema, one.column("doc_ids").flatten(), np.repeat(one.column("part")[0].as_py(), n), np.repeat(one.column("seq")[0].as_py(), n), cut[:-1], counts, crcs, *([pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(flat.astype(np.int32)))] if ids else []))

    out = arrow_map(blocks.select("part", "seq", "doc_ids", "block"), read, "doc_id long, part int, seq long, local long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)
    placed = out.join(before_unit.join(before_part, "part"), ["part", "seq"])
    return placed.select("doc_id", (F.col("before") + F.col("own") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))
