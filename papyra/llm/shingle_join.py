"""N-gram Jaccard join: exact links between documents by the sets of their word shingles, by a prefix tree.

Two sets link when 100 * |intersection| >= 80 * |union| (the threshold is a parameter). So a linked set misses at
most floor(n/5) of its n shingles in its partner, which narrows the work in exact steps:

1. Of shingles whose hash falls into a fixed quarter, those that only one set of the corpus holds are found by one
   exchange of compact arrays. A set survives unless more than floor(n/5) of its own are such.
2. Survivors (one of equal sets) exchange all their shingles and learn how many survivors hold each. Sets with more
   than floor(n/5) shingles of their own drop out. The others order theirs by that frequency, rarest first (ties by
   hash), the same order for all; two linked sets share one of their first floor(n/5) + 1 (prefix filter). A shingle
   that many sets of a flush hold travels once, with their number, so no shingle gathers its holders in one task.
3. Sets that share a prefix shingle are brought together: the connected groups of that relation hold every link. In
   a group, sets stand in a prefix tree, each path being a set in the global order. A set enters the tree at the nodes
   that hold one of its prefix shingles and goes down from there; the overlap of a path is worked out once a node and
   shared by all sets below it. It leaves a subtree where the overlap so far and the shingles that remain can't reach
   the threshold, where sizes exclude it, or where all is of its own class already; nodes are kept by class, so that a
   class which it has joined is passed over at once. Larger groups than GROUP shingles are dealt into blocks, and each
   pair of blocks is a task.
4. Links inside a group form classes at once; with blocks, a connected-components run joins them.

Shingles are 64-bit hashes, sets are told apart by 128. Links aren't compared word by word: an overlap is overstated
only if two shingles of the two sets agree in 64 bits, for sets of a thousand shingles one pair in 10^13.

The exchanges answer by number of flush and document, so a redone task must see its rows in the same order: docs is a
table, and rows that come from a join are sorted first.

Defined results: a text without words has no shingles and links with nothing; a null doc_id is no document's component
id unless all ids of its class are null; equal rows are equal documents; further columns are left out, whatever their
names; an empty table gives no rows; a text of any length is one set, whose shingles one task holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, components, freed, steps, stored, text_bytes
from .kernel import mix, shingle_sets

#: Shingles that a map task gathers before it passes them on, and that a group holds in one task.
FLUSH, GROUP = 2_000_000, 3_000_000
#: Parts at most of a receiver's share of the hashes, of which it holds one at a time, and shingles a message has at least
#: in a full flush: with many receivers, shares are small enough undivided.
FINE, MESSAGE = 16, 4096
_U = np.uint64
#: Marks the number of holders in place of a holder.
_MANY = np.uint32(1 << 31)
_WIRE = "r int, part int, uid long, a binary, b binary, c binary, d binary"
_WIRE_SCHEMA = pa.schema([("r", pa.int32()), ("part", pa.int32()), ("uid", pa.int64()), *((c, pa.binary()) for c in "abcd")])


def allowed(n, percent: int):
    """Shingles that a set of n may hold beyond a partner's."""
    return n * (100 - percent) // 100


def signatures(hashes: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; a set without shingles has zeros."""
    out = []
    for k in (1, 2):
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(hashes ^ _U(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)), dtype=_U)])
        n = np.diff(cut)
        out.append(np.where(n > 0, mix(sums[cut[1:]] - sums[cut[:-1]] + n.astype(_U)), _U(0)))
    return out[0], out[1]


def _wire(r: int, part: int, uid: int, *arrays: np.ndarray) -> tuple:
    return (r, part, uid, *(x.tobytes() for x in arrays), *[b""] * (4 - len(arrays)))


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), 64):
        yield batch_of(_WIRE_SCHEMA, *map(list, zip(*rows[a : a + 64], strict=True)))


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of equal sorted keys, with the end; each entry's run."""
    new = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    return np.append(np.flatnonzero(new), len(keys)), np.cumsum(new) - 1


class Sender:
    """Gathers the sets of a map task; flushes send each receiver its shingles and who holds them.

    A shingle that several documents of a flush hold is sent once, with their number. Those documents are credited on
    the spot, or with owners their list waits beside the flush's metadata.
    """

    def __init__(self, receivers: int, owners: bool = False):
        self.receivers, self.with_owners, self.seq = receivers, owners, 0
        self.fine = min(max(FLUSH // (receivers * MESSAGE), 1), FINE)
        self.clear()

    def clear(self) -> None:
        self.hashes, self.owners, self.meta, self.documents, self.size = [], [], [], 0, 0

    def add(self, hashes: np.ndarray, counts: np.ndarray, meta: np.ndarray) -> None:
        self.owners.append(np.repeat(np.arange(len(counts), dtype=np.uint32) + np.uint32(self.documents), counts))
        self.hashes.append(hashes)
        self.meta.append(meta)
        self.documents += len(counts)
        self.size += len(hashes)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.documents:
            return
        uid = TaskContext.get().partitionId() << 24 | self.seq
        self.seq += 1
        hashes, owners, meta = np.concatenate(self.hashes), np.concatenate(self.owners), np.concatenate(self.meta)
        self.clear()
        order = np.argsort(hashes, kind="stable")
        hashes, owners = hashes[order], owners[order]
        del order
        cut, run = runs_of(hashes)
        counts, keys = np.diff(cut), hashes[cut[:-1]]
        several = counts > 1
        held = owners[several[run]]
        beside = (keys[several], counts[several].astype(np.uint32), held) if self.with_owners else (np.bincount(held, minlength=len(meta)).astype(np.uint32),)
        holders = np.where(several, _MANY | counts.astype(np.uint32), owners[cut[:-1]])
        del hashes, owners, run
        yield from _rows([_wire(uid % self.receivers, -1, uid, meta, *beside)])
        parts = self.receivers * self.fine
        of = ((keys >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
        cut, _ = runs_of(of)
        rows = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            part = int(of[a])
            # The high bits of sorted keys compress well by themselves.
            own = keys[a:b]
            rows.append(_wire(part // self.fine, part, uid, own.astype(np.uint32), (own >> _U(32)).astype(np.uint16), (own >> _U(48)).astype(np.uint16), holders[a:b]))
            if len(rows) == 1024:
                yield from _rows(rows)
                rows = []
        yield from _rows(rows)


def received(batches: Iterator[pa.RecordBatch], answer: Callable) -> Iterator[pa.RecordBatch]:
    """Rows of a receiver, sorted by part: metadata passes, and each part's shingles meet. answer gets their sorted keys,
    uids, holders, and runs, and gives an iterator of (uid, arrays)."""
    now, held, rows = None, [], []

    def settle() -> Iterator[tuple]:
        keys = np.concatenate([np.frombuffer(a, np.uint32).astype(_U) | np.frombuffer(b, np.uint16).astype(_U) << _U(32) | np.frombuffer(c, np.uint16).astype(_U) << _U(48) for _, a, b, c, _ in held])
        holders = np.concatenate([np.frombuffer(d, np.uint32) for *_, d in held])
        uids = np.repeat(np.array([u for u, *_ in held], np.int64), [len(d) // 4 for *_, d in held])
        held.clear()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        for uid, *arrays in answer(keys, uids[order], holders[order], *runs_of(keys)):
            yield _wire(0, now, uid, *arrays)

    for batch in batches:
        for _, part, uid, a, b, c, d in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if part < 0:
                yield from _rows([(0, part, uid, a, b, c, d)])
                continue
            if part != now and held:
                rows += settle()
                if len(rows) > 1024:
                    yield from _rows(rows)
                    rows = []
            now = part
            held.append((uid, a, b, c, d))
    if held:
        rows += settle()
    yield from _rows(rows)


def by_flush(uids: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """(uid, arrays) of each uid."""
    order = np.argsort(uids, kind="stable")
    uids = uids[order]
    cut, _ = runs_of(uids)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(uids[a]), *(x[order[a:b]] for x in arrays)


def exchange(rows: DataFrame, send: Callable, answer: Callable, settle: Callable, schema: str, receivers: int) -> DataFrame:
    """send's flushes to the receivers of their shingles, the receivers' answers back to the flushes, which settle."""
    sent = rows.mapInArrow(freed(send), _WIRE).repartition(receivers, "r").sortWithinPartitions("part")
    answered = sent.mapInArrow(freed(lambda batches: received(batches, answer)), _WIRE)
    return answered.repartition(receivers, "uid").sortWithinPartitions("uid", "part").mapInArrow(freed(settle), schema)


def present(keys: np.ndarray, uids: np.ndarray, holders: np.ndarray, cut: np.ndarray, run: np.ndarray) -> Iterator[tuple]:
    """Answers the documents whose shingle another one holds, with the number of such shingles."""
    marked = holders & _MANY > 0
    shared = np.diff(cut) > 1
    shared[run[marked]] = True
    give = shared[run] & ~marked
    for uid, who in by_flush(uids[give], holders[give]):
        yield uid, *(x.astype(np.uint32) for x in np.unique(who, return_counts=True))


_META = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<i4"), ("k", "<i4"), ("s1", "<u8"), ("s2", "<u8"), ("h", "<i8")])


def _meta(ids: pa.Array, n: np.ndarray, k: np.ndarray, s1: np.ndarray, s2: np.ndarray, h: np.ndarray | int = 0) -> np.ndarray:
    out = np.zeros(len(n), _META)
    out["id"], out["null"] = np.asarray(ids.fill_null(0)), np.asarray(ids.is_null())
    out["n"], out["k"], out["s1"], out["s2"], out["h"] = n, k, s1, s2, h
    return out


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The metadata of each flush and the answers of all receivers, of batches sorted by uid and part."""
    now, beside, answers = None, None, []
    for batch in batches:
        for _, part, uid, *arrays in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if uid != now:
                if now is not None:
                    yield beside, answers
                now, beside, answers = uid, None, []
            if part < 0:
                beside = arrays
            else:
                answers.append(arrays)
    if now is not None:
        yield beside, answers


def document_sets(docs: DataFrame, size: int, percent: int, receivers: int) -> DataFrame:
    """doc_id, n, s1, s2 (the set's signature), text_hash (xxhash64 of the text), survives: step 1."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender(receivers)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in steps(offsets):
                hashes, cut = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                s1, s2 = signatures(hashes, cut)
                picked = hashes & _U(3) == 0
                k = np.diff(np.concatenate([[0], np.cumsum(picked)])[cut])
                out.add(hashes[picked], k, _meta(batch.column(0).slice(a, b - a), np.diff(cut), k, s1, s2, np.asarray(batch.column(2))[a:b]))
                if out.size > FLUSH:
                    yield from out.flush()
        yield from out.flush()

    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("text_hash", pa.int64()), ("survives", pa.bool_())])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (meta, local, *_), answers in grouped(batches):
            meta, credits = np.frombuffer(meta, _META), np.frombuffer(local, np.uint32).astype(np.int64)
            for a, b, _, _ in answers:
                credits[np.frombuffer(a, np.uint32)] += np.frombuffer(b, np.uint32)
            n, k = meta["n"].astype(np.int64), meta["k"].astype(np.int64)
            survives = (n > 0) & (credits >= k - allowed(n, percent))
            for a in range(0, len(meta), 10_000):
                m = meta[a : a + 10_000]
                yield batch_of(schema, pa.array(m["id"], mask=m["null"].astype(bool)), m["n"].astype(np.int64), m["s1"].copy().view(np.int64), m["s2"].copy().view(np.int64), m["h"].copy(), survives[a : a + 10_000])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    return exchange(rows, send, present, settle, "doc_id long, n long, s1 long, s2 long, text_hash long, survives boolean", receivers)


def ordered_sets(docs: DataFrame, survivors: DataFrame, size: int, percent: int, receivers: int) -> DataFrame:
    """s1, s2, n int, shared binary (uint64 shingles that other survivors hold, rarest first), times binary (uint32, by how
    many), prefix array<long>: step 2."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender(receivers, owners=True)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            w1, w2 = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            for a, b in steps(offsets):
                hashes, cut = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                s1, s2 = signatures(hashes, cut)
                mine = (s1.view(np.int64) == w1[a:b]) & (s2.view(np.int64) == w2[a:b])  # other rows may have the same doc_id
                n = np.diff(cut)
                hashes = hashes[np.repeat(mine, n)]
                out.add(hashes, n[mine], _meta(batch.column(0).slice(a, b - a).filter(pa.array(mine)), n[mine], n[mine], s1[mine], s2[mine]))
                if out.size > FLUSH:
                    yield from out.flush()
        yield from out.flush()

    def count(keys: np.ndarray, uids: np.ndarray, holders: np.ndarray, cut: np.ndarray, run: np.ndarray) -> Iterator[tuple]:
        many = holders & _MANY > 0
        total = np.add.reduceat(np.where(many, holders & ~_MANY, 1).astype(np.int64), cut[:-1]) if len(keys) else np.zeros(0, np.int64)
        times = np.minimum(total, (1 << 32) - 1).astype(np.uint32)[run]
        give = times > 1
        yield from by_flush(uids[give], holders[give], keys[give], times[give])

    schema = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("n", pa.int32()), ("shared", pa.binary()), ("times", pa.binary()), ("prefix", pa.list_(pa.int64()))])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (meta, *beside), answers in grouped(batches):
            if not answers:
                continue
            meta = np.frombuffer(meta, _META)
            owners, keys, times = (np.concatenate([np.frombuffer(x[k], t) for x in answers]) for k, t in ((0, np.uint32), (1, _U), (2, np.uint32)))
            # Shingles with several holders in this flush: the answer is theirs, each.
            known, numbers, held = (np.frombuffer(x, t) for x, t in zip(beside, (_U, np.uint32, np.uint32), strict=True))
            many = owners & _MANY > 0
            at = np.searchsorted(known, keys[many])
            n = numbers[at].astype(np.int64)
            first = np.cumsum(numbers, dtype=np.int64)[at] - n
            spread = held[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
            owners, keys, times = np.concatenate([owners[~many], spread]), np.concatenate([keys[~many], np.repeat(keys[many], n)]), np.concatenate([times[~many], np.repeat(times[many], n)])
            order = np.lexsort((keys, times, owners))
            owners, keys, times = owners[order], keys[order], times[order]
            cut = np.searchsorted(owners, np.arange(len(meta) + 1))
            columns: tuple[list, ...] = ([], [], [], [], [], [])
            for i in range(len(meta)):
                n, spare = int(meta["n"][i]), int(allowed(int(meta["n"][i]), percent))
                own = keys[cut[i] : cut[i + 1]]
                if len(own) < n - spare or not n:
                    continue
                prefix = own[: spare + 1 - (n - len(own))]
                for column, value in zip(columns, (int(meta["s1"][i].astype(np.int64)), int(meta["s2"][i].astype(np.int64)), n, own.tobytes(), times[cut[i] : cut[i + 1]].tobytes(), prefix.view(np.int64)), strict=True):
                    column.append(value)
                if len(columns[0]) == 1000:
                    yield batch_of(schema, *columns)
                    columns = ([], [], [], [], [], [])
            if columns[0]:
                yield batch_of(schema, *columns)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(survivors.select(F.col("doc_id").alias("_id"), "s1", "s2"), F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "text", "s1", "s2")
    rows = rows.sortWithinPartitions("doc_id", "s1", "s2", F.xxhash64("text"), "text")
    return exchange(rows, send, count, assemble, "s1 long, s2 long, n int, shared binary, times binary, prefix array<long>", receivers)


class PrefixTree:
    """Sets as paths of increasing numbers; nodes hold stretches of a path that no set leaves.

    edge: a node's numbers; low, high: the smallest and largest set at or below it; rest: the most numbers that any path
    has after the node; ends: the set that ends there.
    """

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.parent, self.edge, self.start = [-1], [np.zeros(0, np.int64)], [0]
        leaf = [0] * len(sets)
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i8").tobytes())
        stack: list[tuple[int, int]] = [(0, 0)]  # node, depth at its end
        before = np.zeros(0, np.int64)
        for i in order:
            own = sets[i]
            m = min(len(own), len(before))
            differ = np.flatnonzero(own[:m] != before[:m])
            common = int(differ[0]) if len(differ) else m
            while stack[-1][1] > common:
                node, _ = stack.pop()
                start = stack[-1][1]
                if start < common:  # the new path leaves inside this node: split it
                    upper = self._add(self.parent[node], self.edge[node][: common - start], start)
                    self.edge[node], self.start[node] = self.edge[node][common - start :], common
                    self.parent[node] = upper
                    stack.append((upper, common))
                    break
            if common < len(own):
                stack.append((self._add(stack[-1][0], own[common:], common), len(own)))
            leaf[i] = stack[-1][0]
            before = own
        n = len(self.parent)
        self.children: list[list[int]] = [[] for _ in range(n)]
        for node in range(1, n):
            self.children[self.parent[node]].append(node)
        self.ends: list[list[int]] = [[] for _ in range(n)]
        self.low, self.high, self.rest = [1 << 60] * n, [0] * n, [0] * n
        #: A set at or below the node, if all there are of its class as far as is known.
        self.alike: list[int] = [-1] * n
        for i, at in enumerate(leaf):
            self.ends[at].append(i)
        for node in self.bottom_up():
            below = self.children[node]
            own = [sizes[i] for i in self.ends[node]]
            self.low[node] = min([*own, *(self.low[c] for c in below)], default=1 << 60)
            self.high[node] = max([*own, *(self.high[c] for c in below)], default=0)
            self.rest[node] = max((len(self.edge[c]) + self.rest[c] for c in below), default=0)
            if not below and len(self.ends[node]) == 1:
                self.alike[node] = self.ends[node][0]

    def _add(self, parent: int, edge: np.ndarray, start: int) -> int:
        self.parent.append(parent)
        self.edge.append(edge)
        self.start.append(start)
        return len(self.parent) - 1

    def bottom_up(self) -> list[int]:
        out, at = [0], 0
        while at < len(out):
            out += self.children[out[at]]
            at += 1
        return out[::-1]


class Probe:
    """Classes of sets by links, found by walking a prefix tree."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int], prefixes: list[int], percent: int, colour: list[int] | None):
        self.sets, self.sizes, self.prefixes, self.percent, self.colour = sets, sizes, prefixes, percent, colour
        self.roots = list(range(len(sets)))
        self.tree = PrefixTree(sets, sizes)
        # Where each number stands among some set's prefix: nodes, by the class of all that is below them, -1 if mixed.
        self.places: dict[int, dict[int, list[int]]] = {}
        reach = [0] * len(self.tree.parent)
        for node in self.tree.bottom_up():
            reach[node] = max([*(prefixes[i] for i in self.tree.ends[node]), *(reach[c] for c in self.tree.children[node])], default=0)
            for number in self.tree.edge[node][: max(reach[node] - self.tree.start[node], 0)].tolist():
                self.places.setdefault(number, {}).setdefault(self.tree.alike[node], []).append(node)
        self.mask = np.zeros(max((int(s[-1]) for s in sets if len(s)), default=-1) + 1, bool)

    def find(self, x: int) -> int:
        roots = self.roots
        while roots[x] != x:
            roots[x] = roots[roots[x]]
            x = roots[x]
        return x

    def entries(self, number: int, i: int) -> Iterator[int]:
        """Nodes that hold the number, without those of i's class, also if it joins theirs meanwhile."""
        groups = self.places.get(number)
        if not groups:
            return
        for key in list(groups):
            nodes = groups.pop(key, None)
            if nodes is None:
                continue
            if key < 0:
                mixed = []
                for node in nodes:
                    if (one := self.tree.alike[node]) >= 0:
                        groups.setdefault(self.find(one), []).append(node)
                    else:
                        mixed.append(node)
                if mixed:
                    groups[-1] = mixed
                yield from mixed
                continue
            root = self.find(key)
            if root in groups and len(groups[root]) > len(nodes):
                groups[root] += nodes
            else:
                nodes += groups.pop(root, [])
                groups[root] = nodes
            for node in nodes:
                if self.find(i) == self.find(root):
                    break
                yield node

    def walk(self, i: int) -> None:
        """Joins i with the sets, not smaller than it, that it links."""
        tree, own, n, percent = self.tree, self.sets[i], self.sizes[i], self.percent
        self.mask[own] = True
        seen: dict[int, int] = {0: 0}  # overlap of the path down to a node; -1 where no set below can link
        walked: set[int] = set()

        def overlap(node: int) -> int:
            path = []
            while node not in seen:
                path.append(node)
                node = tree.parent[node]
            have = seen[node]
            for node in reversed(path):
                if have >= 0:
                    edge = tree.edge[node]
                    have += int(np.count_nonzero(self.mask[edge]))
                    ahead = min(tree.rest[node], len(own) - int(np.searchsorted(own, edge[-1], "right")))
                    # 100 * o >= percent * (n + m - o), with all that may come, for the smallest set below.
                    if (100 + percent) * (have + ahead) < percent * (n + max(tree.low[node], n)) or tree.high[node] < n or 100 * n < percent * tree.low[node]:
                        have = -1
                seen[node] = have
            return have

        for number in own[: self.prefixes[i]].tolist():
            for entry in self.entries(number, i):
                stack = [entry]
                while stack:
                    node = stack.pop()
                    if node < 0:  # all below is done: is it of one class now?
                        node = -node
                        parts = {self.find(j) for j in tree.ends[node]} | {self.find(tree.alike[c]) if tree.alike[c] >= 0 else -1 for c in tree.children[node]}
                        if len(parts) == 1 and -1 not in parts:
                            tree.alike[node] = parts.pop()
                        continue
                    one = tree.alike[node]
                    if node in walked or (one >= 0 and self.find(one) == self.find(i)):
                        continue
                    walked.add(node)
                    have = overlap(node)
                    if have < 0:
                        continue
                    for j in tree.ends[node]:
                        if j != i and self.sizes[j] >= n and not (self.colour and self.colour[i] == self.colour[j]) and (100 + percent) * have >= percent * (n + self.sizes[j]):
                            a, b = self.find(i), self.find(j)
                            self.roots[max(a, b)] = min(a, b)
                    if tree.children[node]:
                        stack.append(-node)
                        stack += tree.children[node]
        self.mask[own] = False


def join_group(sets: list[np.ndarray], sizes: list[int], prefixes: list[int], percent: int, colour: list[int] | None = None) -> list[int]:
    """Root of each set's class by links among sets; prefixes: how many first numbers of each are its prefix.

    Where colours are given, sets of one colour needn't be compared: another task does it.
    """
    probe = Probe(sets, sizes, prefixes, percent, colour)
    for i in sorted(range(len(sets)), key=sizes.__getitem__, reverse=True):
        probe.walk(i)
    return [probe.find(i) for i in range(len(sets))]


def shingle_classes(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles long, component_id long, text_hash long, kept boolean: a row for each row of docs.

    kept: sets without shingles, and of each class the first by (doc_id, null last; text_hash).
    """
    spark = docs.sparkSession
    receivers = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sets = stored(document_sets(docs, size, percent, receivers), "shingle-sets")
    survivors = sets.where("survives").groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"))
    # Nodes are numbered as they are written: a number is one set's, though rows of equal doc_id may bring a set twice.
    ordered = stored(ordered_sets(docs, survivors, size, percent, receivers).withColumn("node", F.monotonically_increasing_id()), "shingle-order")
    held = ordered.select("node", F.explode("prefix").alias("shingle"))
    least = held.groupBy("shingle").agg(F.min("node").alias("m"), F.count("*").alias("times")).where("times > 1").drop("times")
    least = stored(least, "shingle-least")  # a table, so that adaptive execution may split the join of a hot shingle
    groups = components(held.join(least, "shingle").select(F.col("node").alias("a"), F.col("m").alias("b")), "shingle-groups").select(F.col("id").alias("node"), F.col("component").alias("grp"))
    members = stored(ordered.join(groups, "node"), "shingle-members")
    blocks = members.groupBy("grp").agg(F.ceil(F.sum(F.length("shared")) / F.lit(8 * GROUP)).cast("int").alias("blocks"))
    dealt = members.join(blocks, "grp").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    # With one block a group is one task; else a set goes to each pair of blocks that holds its own.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("grp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "blocks", "node", "n", "shared", "times", F.size("prefix").alias("p"))
    dealt = dealt.repartition(receivers, "grp", "x", "y").sortWithinPartitions("grp", "x", "y", "node")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("whole", pa.bool_())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != now:
                    if rows:
                        yield from verified(rows)
                    now, rows = row[:3], []
                rows.append(row)
        if rows:
            yield from verified(rows)

    def verified(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(rows) == 1:
            return
        keys = [np.frombuffer(r[7], _U) for r in rows]
        values, at, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        times = np.concatenate([np.frombuffer(r[8], np.uint32) for r in rows])[at]
        # Numbers in the global order, so each set is in order as it comes.
        place = np.empty(len(values), np.int64)
        place[np.lexsort((values, times))] = np.arange(len(values))
        cut = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        numbers = [place[inverse[a:b]] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        colour = [r[3] for r in rows] if rows[0][1] != rows[0][2] else None
        roots = join_group(numbers, [r[6] for r in rows], [r[9] for r in rows], percent, colour)
        yield batch_of(schema, [r[5] for r in rows], [rows[k][5] for k in roots], [rows[0][4] == 1] * len(rows))

    links = stored(dealt.mapInArrow(freed(join), "a long, b long, whole boolean").where("a <> b"), "shingle-links")
    whole = links.where("whole").select(F.col("a").alias("node"), F.col("b").alias("class"))
    classes = whole.unionByName(whole.select(F.col("class").alias("node"), "class").distinct())
    if links.where("not whole").limit(1).count():
        classes = classes.unionByName(components(links.where("not whole").select("a", "b"), "shingle-classes").select(F.col("id").alias("node"), F.col("component").alias("class")))
    of_set = ordered.select("s1", "s2", "node").join(classes, "node").groupBy("s1", "s2").agg(F.min("class").alias("class"))
    # The first document of each set, then of each class of sets; documents meet them last, by set, in a join that
    # adaptive execution can split. Sets without shingles have no class; a null doc_id has one only through its set.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash"))
    alone = sets.where("n > 0").groupBy("s1", "s2").agg(first.alias("first"))
    joined = stored(alone.join(of_set, ["s1", "s2"], "left"), "shingle-sets-first")
    together = joined.where("class is not null").groupBy("class").agg(F.min("first").alias("top"))
    tops = stored(joined.join(together, "class", "left").select("s1", "s2", F.coalesce("top", "first").alias("first")), "shingle-firsts")
    placed = sets.join(tops, ["s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id"))
    kept = (F.col("n") == 0) | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")))
    return placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "text_hash", kept.alias("kept"))
