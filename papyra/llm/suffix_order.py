"""External induced sorting of suffixes with their common prefixes.

The algorithm is that of Bingmann, Fischer and Osipov ("Inducing Suffix and LCP Arrays in External Memory", 2013), a
batch at a time in numpy. LMS substrings are sorted by induction and named; the suffixes of the string of names are
sorted by recursion, or by doubling once it fits in memory; the order of all suffixes is induced from that of the LMS
suffixes. A priority queue of (symbol, place, common prefix) pops symbols in order and first in, first out; all tuples of
a symbol pass their predecessors on together. The common prefix of two neighbours of a bucket is one more than the
smallest among what was popped between their sources, and comes from the names of the recursion at the bottom.

Queues spill sorted runs beyond `memory` tuples, and the text, types, runs, names and results are memory-mapped beyond
as many items, in a folder of the task's own that goes with it. What stays in memory is in proportion to `memory`, but
for a batch, which is the tuples of one symbol, and the counts of a level's different symbols.

Order and common prefixes count up to `depth` symbols.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Items that a task holds in memory.
MEMORY = 8_000_000


class Space:
    """Arrays in memory, or in files of the folder if they have more than `memory` items."""

    def __init__(self, folder: str, memory: int):
        self.folder, self.memory = folder, memory

    def array(self, n: int, kind) -> np.ndarray:
        if n <= self.memory:
            return np.zeros(n, kind)
        with tempfile.NamedTemporaryFile(dir=self.folder) as file:
            return np.memmap(file, kind, "w+", shape=(n,))

    def pieces(self, n: int) -> list[tuple[int, int]]:
        step = max(self.memory, 1)
        return [(a, min(a + step, n)) for a in range(0, n, step)]


class Queue:
    """A priority queue of (symbol, place, common prefix); equal symbols come out in the order in which they came."""

    def __init__(self, space: Space):
        self.space, self.held, self.parts, self.runs = space, 0, {}, []

    def push(self, symbols: np.ndarray, tuples: np.ndarray) -> None:
        if not len(symbols):
            return
        order = np.argsort(symbols, kind="stable")
        symbols, tuples = symbols[order], tuples[:, order]
        cut = np.append(np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1])), len(symbols))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            self.parts.setdefault(int(symbols[a]), []).append(tuples[:, a:b])
        self.held += len(symbols)
        if self.held > self.space.memory:
            self.spill()

    def spill(self) -> None:
        """What is held becomes a sorted run on disk."""
        names = sorted(self.parts)
        sizes = [sum(p.shape[1] for p in self.parts[s]) for s in names]
        with tempfile.NamedTemporaryFile(dir=self.space.folder) as file:
            run = np.memmap(file, np.int64, "w+", shape=(2, self.held))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        for s, a in zip(names, starts.tolist(), strict=False):
            for p in self.parts[s]:
                run[:, a : a + p.shape[1]] = p
                a += p.shape[1]
        self.runs.append((np.array(names), starts, run))
        self.parts, self.held = {}, 0

    def pop(self, symbol: int) -> np.ndarray | None:
        """All tuples of a symbol that are there now, (place, common prefix) by rows."""
        found = []
        for k, (names, starts, run) in enumerate(self.runs):
            at = int(np.searchsorted(names, symbol))
            if at < len(names) and names[at] == symbol and starts[at + 1] > starts[at]:
                found.append(np.array(run[:, starts[at] : starts[at + 1]]))
                self.runs[k] = (np.delete(names, at), np.delete(starts, at), run) if at == 0 else (names[:at], starts[: at + 1], run) if at == len(names) - 1 else (np.delete(names, at), starts, run)
        parts = self.parts.pop(symbol, [])
        self.held -= sum(p.shape[1] for p in parts)
        found += parts
        return np.concatenate(found, axis=1) if found else None


class Least:
    """Smallest values of ranges of an array, by a table of powers of two."""

    def __init__(self, values: np.ndarray, space: Space | None = None):
        self.levels = [values]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            if space is None:
                self.levels.append(np.minimum(last[:-step], last[step:]))
                continue
            row = space.array(len(last) - step, last.dtype)
            for a, b in space.pieces(len(row)):
                row[a:b] = np.minimum(last[a:b], last[a + step : b + step])
            self.levels.append(row)

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of first to last, both included."""
        out = np.zeros(len(first), self.levels[0].dtype)
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.levels[k]
            out[at] = np.minimum(row[first[at]], row[last[at] - (1 << int(k)) + 1])
        return out


class Text:
    """A text of symbols that ends with its only 0, with types, runs of equal symbols, and LMS places."""

    def __init__(self, text: np.ndarray, space: Space):
        n = len(text)
        self.text, self.space = text, space
        self.small, self.end = space.array(n, bool), space.array(n, np.int64)
        places = []
        after_end, after_small, later = n - 1, True, None
        for a, b in reversed(space.pieces(n)):
            t = np.asarray(text[a : min(b + 1, n)])
            own = t[: b - a]
            last = np.flatnonzero(own[: len(t) - 1] != t[1:]) if b < n else np.append(np.flatnonzero(own[:-1] != own[1:]), b - a - 1)
            rising = np.append(t, 0)[last + 1] > own[last]
            if b == n:
                rising[-1] = True
            open_ = not len(last) or last[-1] != b - a - 1
            ends = np.append(last + a, after_end) if open_ else last + a
            kinds = np.append(rising, after_small) if open_ else rising
            counts = np.diff(np.append(-1, np.append(last, b - a - 1) if open_ else last))
            self.end[a:b], self.small[a:b] = np.repeat(ends, counts), np.repeat(kinds, counts)
            after_end, after_small = int(self.end[a]), bool(self.small[a])
            small = np.append(self.small[a:b], [] if later is None else [later]).astype(bool)
            places.append(np.flatnonzero(small[1:] & ~small[:-1]) + a + 1)
            later = bool(self.small[a])
        self.lms = space.array(sum(map(len, places)), np.int64)
        at = 0
        for p in reversed(places):
            self.lms[at : at + len(p)] = p
            at += len(p)

    def run(self, at: int) -> int:
        return int(self.end[at]) - at + 1


def _carry(lcp: np.ndarray, taken: np.ndarray, symbols: np.ndarray, tail: dict[int, int], known: set[int], depth: int) -> np.ndarray:
    """Common prefixes of what a batch induces with what is before it in its bucket.

    lcp: of the batch, each with what was popped before it; taken: which of the batch induce, and their symbols. tail:
    for symbols that this bucket induced already, the smallest common prefix popped since; known: symbols induced ever.
    """
    order = np.argsort(symbols, kind="stable")
    at, of = taken[order], symbols[order]
    new = np.append(True, of[1:] != of[:-1])
    out = np.zeros(len(at), np.int64)
    follow = np.flatnonzero(~new)
    if len(follow):
        out[follow] = Least(lcp).of(at[follow - 1] + 1, at[follow]) + 1
    so_far = np.minimum.accumulate(lcp)
    heads = np.flatnonzero(new)
    for k, s, j in zip(heads.tolist(), of[heads].tolist(), at[heads].tolist(), strict=True):
        out[k] = (min(tail[s], int(so_far[j])) if s in tail else 0) + 1 if s in known else 0
    least = int(so_far[-1])
    for s in tail:
        tail[s] = min(tail[s], least)
    backward = np.minimum.accumulate(lcp[::-1])[::-1]
    last = np.append(heads[1:], len(at)) - 1
    for s, j in zip(of[last].tolist(), at[last].tolist(), strict=True):
        tail[s] = int(backward[j + 1]) if j + 1 < len(lcp) else depth
        known.add(s)
    result = np.zeros(len(at), np.int64)
    result[order] = np.minimum(out, depth)
    return result


def induce(t: Text, seeds: np.ndarray, lcps: np.ndarray | None, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and their common prefixes with the one before, from the LMS suffixes in theirs.

    Without lcps, seeds are in any order within a symbol, and common prefixes mean nothing.
    """
    text, small, space = t.text, t.small, t.space
    n = len(text)
    size = max(int(text[a:b].max()) for a, b in space.pieces(n)) + 1
    counts = np.zeros((2, size), np.int64)
    for a, b in space.pieces(n):
        for kind in (0, 1):
            counts[kind] += np.bincount(np.asarray(text[a:b])[np.asarray(small[a:b]) == kind], minlength=size)
    alphabet = np.flatnonzero(counts.sum(0)).tolist()
    starts = np.concatenate([[0], np.cumsum(counts.sum(0))])
    heads, waiting = np.zeros(size, np.int64), Queue(space)
    for a, b in space.pieces(len(seeds)):
        of = np.asarray(text[seeds[a:b]])
        heads += np.bincount(of, minlength=size)
        if lcps is None:
            waiting.push(of, np.stack([seeds[a:b], np.zeros(b - a, np.int64)]))
    cut = np.concatenate([[0], np.cumsum(heads)])
    order, lcp = space.array(n, np.int64), space.array(n, np.int32)

    def passed(queue: Queue, batch: np.ndarray, kind: bool, tail: dict, known: set) -> None:
        before = batch[0] - 1
        taken = np.flatnonzero(before >= 0)
        taken = taken[np.asarray(small[before[taken]]) == kind]
        if len(taken):
            found = before[taken]
            symbols = np.asarray(text[found])
            common = _carry(batch[1], taken, symbols, tail, known, depth) if lcps is not None else np.zeros(len(taken), np.int64)
            queue.push(symbols, np.stack([found, common]))
        elif lcps is not None and tail:
            least = int(batch[1].min())
            for s in tail:
                tail[s] = min(tail[s], least)

    left, known = Queue(space), set()
    for c in alphabet:
        tail: dict[int, int] = {}
        at = int(starts[c])
        while (batch := left.pop(c)) is not None:
            order[at : at + batch.shape[1]], lcp[at : at + batch.shape[1]] = batch
            at += batch.shape[1]
            passed(left, batch, False, tail, known)
        if cut[c] < cut[c + 1]:
            if lcps is None:
                batch = waiting.pop(c)
            else:
                batch = np.stack([seeds[cut[c] : cut[c + 1]], lcps[cut[c] : cut[c + 1]]]).astype(np.int64)
                # The last suffix c..cx with x under c and the first c..cy with y over c share the shorter run of c.
                batch[1, 0] = min(t.run(int(order[at - 1])), t.run(int(batch[0, 0])), depth) if at > starts[c] else 0
            passed(left, batch, False, tail, known)
    right, known = Queue(space), set()
    right.push(np.zeros(1, np.int64), np.array([[n - 1], [0]]))
    for c in reversed(alphabet):
        tail = {}
        first, middle, at = int(starts[c]), int(starts[c] + counts[0, c]), int(starts[c + 1])
        while (batch := right.pop(c)) is not None:
            m = batch.shape[1]
            order[at - m : at] = batch[0, ::-1]
            # Each comes with what it has in common with the next larger one.
            up = np.minimum(batch[1, ::-1], depth)
            if at < starts[c + 1]:
                lcp[at - m + 1 : at + 1] = up
            else:
                lcp[at - m + 1 : at] = up[:-1]
            at -= m
            passed(right, batch, True, tail, known)
        if middle < starts[c + 1]:
            lcp[middle] = min(t.run(int(order[middle - 1])), t.run(int(order[middle])), depth) if middle > first else 0
        if middle > first:
            for b in range(middle, first, -space.memory):
                a = max(b - space.memory, first)
                down = np.array(lcp[a + 1 : b + 1], np.int64) if b < n else np.append(lcp[a + 1 : b], 0).astype(np.int64)
                if b == middle and middle == starts[c + 1]:
                    down[-1] = 0
                passed(right, np.stack([np.array(order[a:b])[::-1], down[::-1]]), True, tail, known)
    return order, lcp


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Symbols that pairs of places have in common, `most` at most."""
    out = np.zeros(len(a), np.int64)
    open_ = np.flatnonzero(most > 0)
    while len(open_):
        same = np.asarray(text[a[open_] + out[open_]]) == np.asarray(text[b[open_] + out[open_]])
        open_ = open_[same]
        out[open_] += 1
        open_ = open_[out[open_] < most[open_]]
    return out


def _doubled(names: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of names in order, up to depth, and their common prefixes, by doubling: the case that fits in memory."""
    ranks = [np.unique(names, return_inverse=True)[1].astype(np.int64)]
    reach = 1
    while ranks[-1].max() + 1 < len(names) and reach < depth:
        second = np.zeros(len(names), np.int64)
        second[:-reach] = ranks[-1][reach:] + 1
        ranks.append(np.unique(ranks[-1] * (len(names) + 1) + second, return_inverse=True)[1])
        reach *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b, common = order[:-1], order[1:], np.zeros(max(len(order) - 1, 0), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        # Ranks of 2**k names are equal also where both end; nothing is equal behind an end.
        while True:
            x, y = a + common, b + common
            inside = np.flatnonzero((np.maximum(x, y) + (1 << k) <= len(names)) & (common < depth))
            inside = inside[ranks[k][x[inside]] == ranks[k][y[inside]]]
            common[inside] += 1 << k
            if k < len(ranks) - 1 or not len(inside):
                break
    return order, np.append(0, np.minimum(common, depth))


class Names:
    """Names of LMS substrings in their order: by number of substring; sizes, and what each has in common with the name before."""

    def __init__(self, t: Text, order: np.ndarray, depth: int):
        lms, space = t.lms, t.space
        # Each substring ends with the next one's first symbol; the last is the 0 alone.
        stop = lambda k: np.where(k + 1 < len(lms), lms[np.minimum(k + 1, len(lms) - 1)], len(t.text) - 1) + 1
        self.of = space.array(len(lms), np.int64)
        self.sizes, self.near, self.count = space.array(len(lms), np.int64), space.array(len(lms), np.int32), 0
        before = None
        for a, b in space.pieces(len(order)):
            part = np.asarray(order[a:b])
            part = part[np.asarray(t.small[part]) & (part > 0)]
            part = part[~np.asarray(t.small[part - 1])]
            if not len(part):
                continue
            index = np.searchsorted(lms, part)
            size = stop(index) - part
            ahead, far = np.append(part[0] if before is None else before[0], part[:-1]), np.append(size[0] if before is None else before[1], size[:-1])
            common = _common(t.text, ahead, part, np.minimum(np.minimum(size, far), depth))
            # Equal, or equal as far as depth asks.
            new = (common < depth) & ((size != far) | (common < size))
            new[0] |= before is None
            number = self.count - 1 + np.cumsum(new)
            self.of[index] = number
            fresh = number[new]
            self.sizes[fresh], self.near[fresh] = size[new], common[new]
            self.count = int(number[-1]) + 1
            before = (int(part[-1]), int(size[-1]))


def ordered_suffixes(text: np.ndarray, depth: int, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a text that ends with its only 0 in the order of their first `depth` symbols, and the common prefix of
    each with the one before, `depth` at most."""
    t = Text(text, space)
    lms, n = t.lms, len(t.lms)
    if n <= 1:
        return induce(t, lms, np.zeros(n, np.int64), depth)
    names = Names(t, induce(t, lms, None, depth)[0], depth)
    # An LMS substring advances by two symbols at least, so half the depth in names is the depth in symbols.
    inner, shared = space.array(n, np.int64), space.array(n, np.int32)
    if names.count == n:
        for a, b in space.pieces(n):
            inner[names.of[a:b]] = np.arange(a, b)
    elif n <= space.memory:
        inner, shared = _doubled(np.asarray(names.of), depth // 2 + 1)
    else:
        below = space.array(n + 1, np.int64)
        for a, b in space.pieces(n):
            below[a:b] = names.of[a:b] + 1
        # The 0 behind all comes first, and has nothing in common with the next.
        inner, shared = (x[1:] for x in ordered_suffixes(below, depth // 2 + 1, space))
    seeds, common = space.array(n, np.int64), space.array(n, np.int32)
    least = Least(names.near[: names.count], space)
    for a, b in space.pieces(n):
        seeds[a:b] = lms[inner[a:b]]
        first = max(a, 1)
        i, j, k = inner[first - 1 : b - 1], inner[first:b], np.asarray(shared[first:b], np.int64)
        if not len(j):
            continue
        x, y = i + k, j + k
        inside = np.maximum(x, y) < n
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        p, q, m, o = lms[x], lms[y], names.of[x], names.of[y]
        r = np.zeros(len(i), np.int64)
        at = np.flatnonzero(inside & (m != o))
        if len(at):
            r[at] = least.of(np.minimum(m[at], o[at]) + 1, np.maximum(m[at], o[at]))
            # One that is the front of the other goes on with a run of its last symbol, which the two have in common.
            at = at[r[at] >= np.minimum(names.sizes[m[at]], names.sizes[o[at]])]
            u, v = p[at] + r[at] - 1, q[at] + r[at] - 1
            r[at] += np.minimum(t.end[u] - u, t.end[v] - v)
        common[first:b] = np.minimum(p - lms[i] + r, depth)
    return induce(t, seeds, common, depth)


def suffix_order(text: np.ndarray, depth: int, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of text (symbols from 1; a 0 is put behind) in the order of their first `depth` symbols, and the common
    prefix of each with the one before. Both are in memory, or mapped from files that are unlinked already."""
    with tempfile.TemporaryDirectory() as folder:
        space = Space(folder, memory)
        whole = space.array(len(text) + 1, np.int32)
        whole[:-1] = text
        if len(whole) == 1:
            return np.zeros(1, np.int64), np.zeros(1, np.int32)
        return ordered_suffixes(whole, depth, space)
