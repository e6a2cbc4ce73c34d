"""Suffix-array dedup: removes bytes covered by a string of `length` bytes that also starts elsewhere.

1. Anchors. Every window of `length` bytes has the smallest hash of its substrings of GRAM bytes as its anchor (the
   rightmost of equals), so equal windows have equal anchors at equal offsets. One exchange of compact arrays finds
   the anchors that stand more than once; windows of other anchors can't repeat. Each window has one anchor, so each
   is looked at once.
2. Shards. Of one row a distinct text, the stretch of text that an anchor's windows cover goes to the shard of the
   anchor's hash. Stretches that are equal where they are cut out are repeated as a whole: their spans are known at once,
   and one of them goes on without places, for others to be compared with. An anchor of more than HOT bytes of distinct
   stretches isn't sorted: each window has half of what the anchor leaves of it on one side, and goes to the shard of
   those bytes and the anchor in the next round (`split`). Equal windows go the same way, so this is exact, and in the
   last round (the anchor is the whole window by then) nothing but equal windows is left. So no task holds more than
   SHARD + HOT bytes of stretches, whatever the corpus. Stretches of an anchor in more than COMMON places, as the exchange
   counts them, are dealt by their bytes and only split, and so are in later rounds those of a key with more than COMMON
   stretches, so that a common passage isn't one task's.
3. Induced sorting. A shard's stretches are suffix-sorted by induction with disk-backed queues that carry common
   prefixes (`suffix_order`); `memory` bounds what a task holds of that, so a shard may be far larger.
4. Windows that have `length` bytes in common with a neighbour, by the carried values, are repeated. Their spans return
   to the documents.

Texts that stand in several rows are repeated as a whole if they have `length` bytes; one row of them serves as a
source. Defined results: a null text is empty; texts under `length` bytes lose nothing; rows of equal doc_id are
documents of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, freed, steps, stored, text_bytes
from .kernel import byte_sums, range_hash
from .shingle_join import _MANY, FLUSH, Sender, by_flush, exchange, grouped
from .suffix_order import MEMORY, suffix_order

GRAM = 160
#: Bytes of stretches that are sorted together (a single anchor's may be HOT).
SHARD, HOT = 2_000_000, 4_000_000
#: Places, in later rounds stretches, from which those of an anchor are split by many tasks.
COMMON = 1000
_PLACE = np.dtype([("sig", "V16"), ("at", "<i8")])
_ANCHOR = np.dtype([("sig", "S16"), ("at", "<u4"), ("first", "<u4"), ("last", "<u4"), ("common", "?")])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first window start, last window start) of each anchor, in order of place."""
    n = len(data)
    grams = n - gram + 1
    width = length - gram + 1
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if n < length:
        return none
    at = np.arange(grams)
    hashes = range_hash(byte_sums(data), at, at + gram)
    # The high bits of the hash, then the distance from the end: the smallest is the rightmost of the smallest hashes.
    bits = max(int(grams).bit_length(), 1)
    keys = (hashes >> np.uint64(bits) << np.uint64(bits)) | (grams - 1 - at).astype(np.uint64)
    # Smallest of each `width` neighbours, from running minima of blocks, forwards and backwards.
    blocks = -(-grams // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:grams] = keys
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(back[:windows], ahead[width - 1 : width - 1 + windows])
    starts = np.arange(windows)
    inside = starts + length <= offsets[np.searchsorted(offsets, starts, "right")] if len(offsets) > 2 else np.ones(windows, bool)
    starts = starts[inside]
    if not len(starts):
        return none
    place = grams - 1 - (least[inside] & np.uint64((1 << bits) - 1)).astype(np.int64)
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    return place[first], hashes[place[first]], starts[first], starts[last]


def repeated_windows(stretches: list[bytes], windows: list[int], length: int, memory: int = MEMORY) -> list[np.ndarray]:
    """For each stretch, which of its first windows (so many starts) stand in the stretches more than once."""
    sizes = np.array([len(s) for s in stretches], np.int64)
    offsets = np.cumsum(sizes + 1) - sizes - 1
    text = np.frombuffer(b"\0".join(stretches) + b"\0", np.uint8).astype(np.int32) + 2
    text[offsets + sizes] = 1  # between stretches: a symbol below all bytes
    order, common = suffix_order(text, length, memory)
    start, hit = np.zeros(len(text) + 1, bool), np.zeros(len(text) + 1, bool)
    counts = np.array(windows, np.int64)
    start[np.repeat(offsets - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())] = True
    before, least = -1, 0  # the window before, and what all since have in common
    for a in range(0, len(order), memory):
        places, shared = np.asarray(order[a : a + memory]), np.asarray(common[a : a + memory])
        at = np.flatnonzero(start[places])
        if not len(at):
            least = min(least, int(shared.min()))
            continue
        mins = np.minimum.reduceat(shared[: at[-1] + 1], np.append(0, at[:-1] + 1))
        mins[0] = min(mins[0], least)
        same = mins >= length
        own, ahead = places[at], np.append(before, places[at[:-1]])
        hit[own[same]] = hit[ahead[same]] = True
        before, least = int(own[-1]), int(shared[at[-1] + 1 :].min(initial=length))
    return [hit[o : o + w] for o, w in zip(offsets.tolist(), windows, strict=True)]


def spans(hit: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte spans that repeated windows cover: (start, end) of maximal runs, from the stretch's start."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length)
    return list(zip(at[np.append(0, cut + 1)].tolist(), (at[np.append(cut, len(at) - 1)] + length).tolist(), strict=True))


def merged(parts: np.ndarray) -> np.ndarray:
    """Union of spans (start, end): maximal runs, adjacent ones joined."""
    parts = parts[np.argsort(parts[:, 0], kind="stable")]
    upto = np.maximum.accumulate(parts[:, 1])
    new = np.append(True, parts[1:, 0] > upto[:-1])
    return np.stack([parts[new, 0], upto[np.append(np.flatnonzero(new)[1:] - 1, len(parts) - 1)]], 1)


def wider(known: int, length: int) -> int:
    """Bytes that windows of a stretch are known to hold once it is split."""
    return known + -(-(length - known) // 2)


def split(key: int, body: bytes, at: int, known: int, length: int) -> list[tuple[int, bytes, int, int]]:
    """(key, body, at, start in the stretch) of the stretches that a stretch's windows are dealt to: those that reach half
    of what the known bytes leave of a window to their left, by these bytes, and the others by as many to their right.
    at: where the `known` bytes start that all windows of the stretch hold."""
    step = wider(known, length) - known
    last = len(body) - length
    out = []
    for side, a, b, block in ((b"l", 0, min(last, at - step), (at - step, at + known)), (b"r", max(0, at - step + 1), last, (at, at + known + step))):
        if a <= b:
            mark = hashlib.blake2b(key.to_bytes(8, "little", signed=True) + side + body[block[0] : block[1]], digest_size=8).digest()
            out.append((int.from_bytes(mark, "little", signed=True), body[a : b + length], block[0] - a, a))
    return out


def _signed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("sig", F.unhex(F.md5("text")))


def repeated_anchors(docs: DataFrame, length: int, receivers: int, most: int = COMMON) -> DataFrame:
    """sig, places array<struct<at,first,last,common>> of the anchors of each text that stand more than once in the table;
    common: in more than `most` places."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender(receivers, owners=True)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            sigs = np.array(batch.column(1).to_pylist(), "S16") if len(batch) else np.zeros(0, "S16")
            for a, b in steps(offsets):
                cut = offsets[a : b + 1] - offsets[a]
                place, hashes, first, last = anchors(data[offsets[a] : offsets[b]], cut, length)
                row = np.searchsorted(cut, first, "right") - 1
                meta = np.zeros(len(place), _ANCHOR)
                meta["sig"] = sigs[a:b][row]
                meta["at"], meta["first"], meta["last"] = place - cut[row], first - cut[row], last - cut[row]
                out.add(hashes, np.ones(len(hashes), np.int64), meta)
                if out.size > FLUSH:
                    yield from out.flush()
        yield from out.flush()

    def count(keys: np.ndarray, uids: np.ndarray, holders: np.ndarray, cut: np.ndarray, run: np.ndarray) -> Iterator[tuple]:
        """Answers the places whose anchor stands elsewhere, and anchors of several places in a flush by hash, if common."""
        many = holders & _MANY > 0
        total = np.add.reduceat(np.where(many, holders & ~_MANY, 1).astype(np.int64), cut[:-1])[run] if len(keys) else np.zeros(0, np.int64)
        common = total > most
        give = np.where(many, common, total > 1)
        yield from by_flush(uids[give], holders[give], common[give], np.where(many, keys, 0)[give].astype(np.uint64))

    place = pa.struct([("at", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("common", pa.bool_())])
    schema = pa.schema([("sig", pa.binary()), ("places", pa.list_(place))])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (meta, *beside), answers in grouped(batches):
            meta = np.frombuffer(meta, _ANCHOR).copy()
            known, numbers, held = (np.frombuffer(x, t) for x, t in zip(beside, (np.uint64, np.uint32, np.uint32), strict=True))
            ends = np.cumsum(numbers, dtype=np.int64)
            again = np.zeros(len(meta), bool)
            again[held] = True
            for who, common, keys, *_ in answers:
                who, common, keys = np.frombuffer(who, np.uint32), np.frombuffer(common, bool), np.frombuffer(keys, np.uint64)
                many = who & _MANY > 0
                again[who[~many]] = True
                meta["common"][who[~many]] = common[~many]
                for k in np.searchsorted(known, keys[many]).tolist():
                    meta["common"][held[ends[k] - numbers[k] : ends[k]]] = True
            found = meta[again]
            if not len(found):
                continue
            # Rows of equal texts in one flush follow their own order of places; a text's places are sorted and distinct.
            found = np.unique(found)
            cut = np.append(np.flatnonzero(np.append(True, found["sig"][1:] != found["sig"][:-1])), len(found))
            columns = [*(pa.array(found[c].astype(np.int64)) for c in ("at", "first", "last")), pa.array(found["common"])]
            inner = pa.StructArray.from_arrays(columns, fields=list(place))
            sigs = [found["sig"][k].ljust(16, b"\0") for k in cut[:-1]]
            whole = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), inner)
            for k in range(0, len(sigs), 1000):
                yield batch_of(schema, sigs[k : k + 1000], whole.slice(k, 1000))

    return exchange(docs.select("text", "sig"), send, count, settle, "sig binary, places array<struct<at:long,first:long,last:long,common:boolean>>", receivers)


def in_shards(pieces: DataFrame, receivers: int) -> DataFrame:
    """Stretches by anchor, and those that are only split by their bytes, so that equal ones meet."""
    key = F.when(F.col("common"), F.xxhash64("anchor", "body")).otherwise(F.col("anchor"))
    return pieces.repartition(receivers, key).sortWithinPartitions("anchor")


def suffix_dedup(docs: DataFrame, length: int = 400, hot: int = HOT, memory: int = MEMORY, common: int = COMMON) -> DataFrame:
    """doc_id, text, n_bytes, n_removed, n_spans long, kept binary, spans array<struct<start,end>>: a row for each row of docs.

    hot: bytes of distinct stretches from which an anchor is split; memory: items that sorting a shard holds; common: places
    from which an anchor's stretches are split by many tasks.
    """
    spark = docs.sparkSession
    receivers = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    signed = _signed(docs)
    texts = signed.groupBy("sig").agg(F.count("*").alias("copies"), F.min("doc_id").alias("one"))
    found = repeated_anchors(signed, length, receivers, common)
    # A text's copies may be in several map tasks: any one's places are the same text's, but each may know others as repeated.
    lists = found.groupBy("sig").agg(F.collect_set("places").alias("lists"))
    # One list, as most have, is in order and distinct already; several are merged by sorting, without comparing all pairs.
    merge = F.transform(F.array(F.sort_array(F.flatten("lists"))), lambda p: F.filter(p, lambda x, k: (k == 0) | (x["at"] != F.get(p, k - 1)["at"])))
    places = lists.select("sig", F.when(F.size("lists") == 1, F.get("lists", F.lit(0))).otherwise(F.get(merge, F.lit(0))).alias("places"))
    known = stored(texts.join(places, "sig", "left").where("copies > 1 or places is not null"), "suffix-anchors")
    sources = known.where("places is not null").select(F.col("sig").alias("_sig"), F.col("one").alias("_one"), "places")
    rows = signed.join(sources, F.col("sig") == F.col("_sig")).where(F.col("doc_id").eqNullSafe(F.col("_one"))).select("sig", "text", "places")
    stretch = pa.schema([("anchor", pa.int64()), ("at", pa.int32()), ("known", pa.int32()), ("body", pa.binary()), ("several", pa.bool_()), ("places", pa.binary())])
    dealt = pa.schema([*stretch, ("common", pa.bool_())])
    out_schema = pa.schema([("sig", pa.binary()), ("spans", pa.binary()), *stretch])

    def mark(given: dict[bytes, list], places: bytes, found: list[tuple[int, int]]) -> None:
        """Adds spans of a stretch, from its start, to those of the texts that hold it."""
        for k in range(0, len(places), 24):
            start = int.from_bytes(places[k + 16 : k + 24], "little")
            given.setdefault(places[k : k + 16], []).extend((start + s, start + e) for s, e in found)

    def union(found: list) -> bytes:
        return merged(np.array(found, np.int64).reshape(-1, 2)).tobytes()

    class Stretches:
        """Stretches by key; of equal ones one goes on, as one of several, and their spans are given to `given`."""

        def __init__(self, given: dict[bytes, list]):
            self.found: dict[tuple[int, bytes], list] = {}
            self.given, self.size = given, 0

        def add(self, key: int, body: bytes, at: int, known: int, several: bool, places: bytes) -> None:
            own = self.found.get((key, body))
            if own is None:
                self.found[key, body] = [at, known, several, places]
                self.size += len(body) + len(places)
                return
            if not own[2]:
                mark(self.given, own[3], [(0, len(body))])
                own[2:] = True, b""
            mark(self.given, places, [(0, len(body))])
            self.size += len(places)

        def flush(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
            items = list(self.found.items())
            self.found, self.size = {}, 0
            for k in range(0, len(items), 2000):
                part = items[k : k + 2000]
                columns = ([a for (a, _), _ in part], [v[0] for _, v in part], [v[1] for _, v in part], [b for (_, b), _ in part], [v[2] for _, v in part], [v[3] for _, v in part])
                yield batch_of(schema, *[[None] * len(part)] * (len(schema) - len(columns)), *columns)

    def cut_out(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Stretches, and, without a body, the spans of texts that are known already, dealt by text."""
        given: dict[bytes, list] = {}
        found = {False: Stretches(given), True: Stretches(given)}

        def flush() -> Iterator[pa.RecordBatch]:
            for often, some in found.items():
                for b in some.flush(stretch):
                    yield batch_of(dealt, *b.columns, [often] * len(b))
            items = list(given.items())
            given.clear()
            for k in range(0, len(items), 2000):
                part = items[k : k + 2000]
                none = [None] * len(part)
                yield batch_of(dealt, [int.from_bytes(s[:8], "little", signed=True) for s, _ in part], none, none, none, none, [s + union(v) for s, v in part], [False] * len(part))

        for sig, text, spots in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode()
            at = np.array([p["at"] for p in spots], np.int64)
            hashes = range_hash(byte_sums(np.frombuffer(raw, np.uint8)), at, at + GRAM).view(np.int64).tolist()
            for h, p in zip(hashes, spots, strict=True):
                found[p["common"]].add(h, raw[p["first"] : p["last"] + length], p["at"] - p["first"], GRAM, False, sig + p["first"].to_bytes(8, "little"))
            if sum(some.size for some in found.values()) > 4 * SHARD:
                yield from flush()
        yield from flush()

    def sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans of the stretches' places, and the stretches of hot and of common anchors, split."""
        bodies: dict[tuple[int, bytes], list] = {}  # stretches that wait for their shard, and whether they are several, and places
        group: dict[bytes, list] = {}
        out: dict[bytes, list] = {}
        later = Stretches(out)
        size = own_size = 0
        anchor, splitting = None, False

        def flush() -> Iterator[pa.RecordBatch]:
            items = list(out.items())
            out.clear()
            for k in range(0, len(items), 2000):
                part = items[k : k + 2000]
                yield batch_of(out_schema, [s for s, _ in part], [union(v) for _, v in part], *[[None] * len(part)] * len(stretch))

        def give(places: list[bytes], found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            for part in places if found else []:
                mark(out, part, found)
                if len(out) > 20_000:
                    yield from flush()

        def sort() -> Iterator[pa.RecordBatch]:
            texts = [b for _, b in bodies]
            for (body, (several, *places)), hit in zip(((b, v) for (_, b), v in bodies.items()), repeated_windows(texts, [len(b) - length + 1 for b in texts], length, memory), strict=True):
                yield from give(places, [(0, len(body))] if several else spans(hit, length))
            bodies.clear()

        def defer(key: int, body: bytes, at: int, known: int, several: bool, places: list[bytes]) -> Iterator[pa.RecordBatch]:
            """What is known to be repeated is given now; the parts go on, as one of several, without places."""
            if several:
                yield from give(places, [(0, len(body))])
            for mine, part, place, start in split(key, body, at, known, length):
                moved = np.frombuffer(b"" if several else b"".join(places), _PLACE).copy()
                moved["at"] += start
                later.add(mine, part, place, wider(known, length), several, moved.tobytes())
            if later.size > 4 * SHARD:
                yield from later.flush(out_schema)
            if len(out) > 20_000:
                yield from flush()

        def settle_group() -> Iterator[pa.RecordBatch]:
            """Stretches that are alone need no sorting; the others wait for their shard."""
            nonlocal size, own_size, splitting
            if len(group) == 1:
                body, (_, _, several, *places) = next(iter(group.items()))
                if several:
                    yield from give(places, [(0, len(body))])
            elif group:
                bodies.update({(anchor, b): v[2:] for b, v in group.items()})
                size += own_size
            group.clear()
            own_size, splitting = 0, False
            if size > SHARD:
                yield from sort()
                size = 0

        for batch in batches:
            for own, at, known, body, several, places, often in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if body is None:
                    out.setdefault(places[:16], []).extend(np.frombuffer(places, np.int64, offset=16).reshape(-1, 2).tolist())
                    if len(out) > 20_000:
                        yield from flush()
                    continue
                if often:
                    yield from defer(own, body, at, known, several, [places])
                    continue
                if own != anchor:
                    yield from settle_group()
                    anchor = own
                if splitting:
                    yield from defer(anchor, body, at, known, several, [places])
                    continue
                held = group.get(body)
                if held is None:
                    held = group[body] = [at, known, several]
                    own_size += len(body)
                else:
                    held[2] = True
                if places:
                    held.append(places)
                if own_size > hot and len(group) > 1 and known < length:
                    for b, (a, k, s, *parts) in group.items():
                        yield from defer(anchor, b, a, k, s, parts)
                    group.clear()
                    own_size, splitting = 0, True
        yield from settle_group()
        if bodies:
            yield from sort()
        yield from later.flush(out_schema)
        yield from flush()

    columns = "anchor long, at int, known int, body binary, several boolean, places binary"
    pieces, found_spans = arrow_map(rows, cut_out, f"{columns}, common boolean"), None
    while True:
        done = stored(in_shards(pieces, receivers).mapInArrow(freed(sort_shards), f"sig binary, spans binary, {columns}"), "suffix-spans")
        spans_of = done.where("sig is not null").select("sig", "spans")
        found_spans = spans_of if found_spans is None else found_spans.unionByName(spans_of)
        pieces = done.where("anchor is not null").select(*stretch.names)
        if pieces.isEmpty():
            break
        # At most one key for each `common` stretches.
        often = pieces.where(F.col("known") < length).groupBy("anchor").count().where(F.col("count") > common).select("anchor", F.lit(True).alias("often"))
        pieces = pieces.join(F.broadcast(often), "anchor", "left").select(*stretch.names, F.coalesce("often", F.lit(False)).alias("common"))
    by_text = found_spans.groupBy("sig").agg(F.collect_list("spans").alias("spans"))
    marks = known.select("sig", "copies").join(by_text, "sig", "left").where("copies > 1 or spans is not null")
    joined = signed.join(marks.withColumnRenamed("sig", "_sig"), F.col("sig") == F.col("_sig"), "left").select("doc_id", "text", "copies", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def remove(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", batch.schema.field(0).type), ("text", pa.string()), *((c, pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), ("kept", pa.binary()), ("spans", pa.list_(span))])
        columns: list[list] = [[] for _ in range(5)]
        for text, copies, parts in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            raw = text.encode()
            if copies and copies > 1 and len(raw) >= length:
                gone = np.array([[0, len(raw)]])
            elif parts and len(flat := np.concatenate([np.frombuffer(p, np.int64) for p in parts])):
                gone = merged(flat.reshape(-1, 2))
            else:
                gone = np.zeros((0, 2), np.int64)
            edges = [0, *gone.ravel().tolist(), len(raw)]
            kept = b"".join(raw[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
            for column, value in zip(columns, (len(raw), len(raw) - len(kept), len(gone), kept, [{"start": s, "end": e} for s, e in gone.tolist()]), strict=True):
                column.append(value)
        yield batch_of(schema, batch.column(0), batch.column(1), *columns)

    return arrow_map(joined, remove, f"doc_id {kind}, text string, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>")
