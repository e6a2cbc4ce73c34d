"""Rows of a page's blocks: the fold of the running mean over Arrow batches of whole pages, vertical blocks split first."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Parts of a vertical block are numbered from here, so that they follow all whole blocks.
PARTS = 1 << 40
PART = "struct<text:string,ordinal:bigint,x_center:double,y_center:double,y_min:double,y_max:double,width:double,height:double,row_index:int,pos:int>"
RESULT = f"struct<row_index:int,pos:int,parts:array<{PART}>>"
_SIDES = ("x_center", "y_center", "y_min", "y_max", "width", "height")
_PART = pa.struct([("text", pa.string()), ("ordinal", pa.int64()), *((c, pa.float64()) for c in _SIDES), ("row_index", pa.int32()), ("pos", pa.int32())])
#: Islands that are folded side by side; fewer are folded one by one.
_FEW = 8


def _starts(y: np.ndarray, near: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where rows start in the islands first..end: a block joins while within near of the row's running mean."""
    out = np.zeros(len(y), bool)
    total, n, at = np.zeros(len(first)), np.zeros(len(first)), first.copy()
    while len(at) >= _FEW:
        v = y[at]
        joins = (n > 0) & (np.abs(v - total / np.maximum(n, 1)) <= near)
        out[at] = ~joins
        total, n, at = np.where(joins, total, 0.0) + v, np.where(joins, n, 0) + 1, at + 1
        more = at < end
        if not more.all():
            total, n, at, end, near = total[more], n[more], at[more], end[more], near[more]
    for t, c, a, e, limit in zip(total.tolist(), n.tolist(), at.tolist(), end.tolist(), near.tolist(), strict=True):
        for k, v in enumerate(y[a:e].tolist(), a):
            if c and abs(v - t / c) <= limit:
                t, c = t + v, c + 1
            else:
                out[k], t, c = True, v, 1
    return out


def _numbered(y: np.ndarray, absent: np.ndarray, x: np.ndarray, h: np.ndarray, opens: np.ndarray, islands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """row_index and pos of the blocks of whole pages in reading order; opens says where pages start, absent where y is null.

    Pages are cut into islands first, as in geometry.row_clusters, where islands says so: not those that hold vertical shapes.
    """
    page = np.cumsum(opens) - 1
    positive = h > 0
    # Sums in reading order, one after another.
    sums, counts = np.bincount(page, np.where(positive, h, 0.0)), np.bincount(page, positive)
    near = np.maximum(np.where(counts > 0, sums / np.maximum(counts, 1), 20.0) * 0.5, 5.0)[page]
    gap = np.zeros(len(y), bool)
    gap[1:] = islands[1:] & ~(y[1:] - y[:-1] <= near[1:]) & ~absent[1:] & ~absent[:-1]
    cut = opens | gap
    first = np.flatnonzero(cut)
    end = np.append(first[1:], len(y))
    # Sorted, so an island's last block is its lowest.
    low = islands[first] & (y[end - 1] - np.fmin.reduceat(y, first) <= near[first])
    high = ~low
    starts = cut | _starts(y, near[first[high]], first[high], end[high]) if high.any() else cut
    row = np.cumsum(starts) - 1
    order = np.lexsort((x, row))
    at = np.flatnonzero(starts)
    pos = np.empty(len(y), np.int64)
    pos[order] = np.arange(len(y)) - at[row]
    return row - row[np.flatnonzero(opens)][page], pos


class Items(NamedTuple):
    """What stands on a batch's pages, in reading order: blocks, and parts in place of vertical ones."""

    block: np.ndarray
    part: np.ndarray  # of parts; -1 for blocks
    page: np.ndarray
    row: np.ndarray
    pos: np.ndarray
    x: np.ndarray
    y: np.ndarray
    parts: dict[str, list]


def numbers(a: pa.Array) -> np.ndarray:
    return a.fill_null(float("nan")).to_numpy(zero_copy_only=False)


def _split(shapes: np.ndarray, page: np.ndarray, opens: np.ndarray, y: np.ndarray, x: np.ndarray, h: np.ndarray, tall: pa.Array) -> dict[str, list]:
    """The parts of vertical blocks, as columns with the block of each; shapes are the blocks that look vertical."""
    out: dict[str, list] = {c: [] for c in ("block", "text", "ordinal", *_SIDES)}
    first = np.append(np.flatnonzero(opens), len(y))
    some = tall.take(pa.array(shapes))
    t = {c: some.field(c).to_pylist() for c in ("solid", "ordinal", "x_min", "x_max", "y_min", "y_max")}
    cuts = np.append(np.flatnonzero(np.append(True, np.diff(page[shapes]) > 0)), len(shapes))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        a, b = first[page[shapes[i]]], first[page[shapes[i]] + 1]
        high, ys, xs = h[a:b], y[a:b], x[a:b]
        # As SQL sorts: what isn't a number, or null, last.
        median = np.partition(high, (b - a) // 2)[(b - a) // 2]
        vertical = [n for n in range(i, j) if h[shapes[n]] > median * 2.5]
        others = np.ones(b - a, bool)
        others[shapes[vertical] - a] = False
        for n in vertical:
            low, top, middle, width = t["y_min"][n], t["y_max"][n], (t["x_min"][n] + t["x_max"][n]) / 2, t["x_max"][n] - t["x_min"][n]
            beside = others & (ys >= low - median) & (ys <= top + median) & (np.abs(xs - middle) >= median * 2)
            centers: list[float] = []
            for v in ys[beside].tolist():
                if not centers or v - centers[-1] > median * 0.4:
                    centers.append(v)
            solid = t["solid"][n]
            step = (top - low) / max(len(solid), 1)
            half = float(median if centers else step) / 2
            if centers:
                # The commonest character, the first of equals.
                texts = [max(dict.fromkeys(solid), key=solid.count, default="")] * len(centers)
            else:
                texts = list(solid) or [""]
                centers = [low + (k + 0.5) * step for k in range(len(texts))]
            many = len(centers)
            out["block"] += [int(shapes[n])] * many
            out["text"] += texts
            out["ordinal"] += range(PARTS + t["ordinal"][n] * (1 << 16), PARTS + t["ordinal"][n] * (1 << 16) + many)
            out["x_center"] += [middle] * many
            out["y_center"] += centers
            out["y_min"] += [c - half for c in centers]
            out["y_max"] += [c + half for c in centers]
            out["width"] += [width] * many
            out["height"] += [half * 2] * many
    return out


def items(columns: list[pa.Array]) -> Items:
    """The items of whole pages, of the columns that number takes."""
    k, y, x, h, tall = columns
    opens, absent = k.to_numpy(zero_copy_only=False) == 1, y.is_null().to_numpy(zero_copy_only=False)
    y, x, h = numbers(y), numbers(x), numbers(h)
    page, block = np.cumsum(opens) - 1, np.arange(len(y))
    if tall.null_count == len(tall):
        row, pos = _numbered(y, absent, x, h, opens, np.ones(len(y), bool))
        return Items(block, np.full(len(y), -1), page, row, pos, x, y, {})
    shapes = np.flatnonzero(tall.is_valid().to_numpy(zero_copy_only=False))
    parts = _split(shapes, page, opens, y, x, h, tall)
    of = np.array(parts["block"], np.int64)
    whole = np.ones(len(y), bool)
    whole[of] = False
    at = block[whole]
    both = lambda a, c: np.concatenate([a[at], np.array(parts[c], a.dtype)])
    place, part = both(block, "ordinal"), np.concatenate([np.full(len(at), -1), np.arange(len(of))])
    block = both(block, "block")
    y, x, h = both(y, "y_center"), both(x, "x_center"), both(h, "height")
    absent = np.concatenate([absent[at], np.zeros(len(of), bool)])
    order = np.lexsort((place, part >= 0, np.where(absent, 0.0, y), ~absent, page[block]))
    block, part, y, x, h, absent = (a[order] for a in (block, part, y, x, h, absent))
    islands = ~np.isin(np.arange(page[-1] + 1), page[shapes])
    page = page[block]
    opens = np.append(True, np.diff(page) > 0)
    row, pos = _numbered(y, absent, x, h, opens, islands[page])
    return Items(block, part, page, row, pos, x, y, parts)


def listed(block: np.ndarray, blocks: int, values: pa.Array) -> pa.Array:
    """For each block the list of its values; block says whose each is."""
    offsets = np.zeros(blocks + 1, np.int32)
    np.cumsum(np.bincount(block, minlength=blocks), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values if (np.diff(block) >= 0).all() else values.take(pa.array(np.argsort(block, kind="stable"))))


def _whole(columns: list[pa.Array]) -> pa.Array:
    found, n = items(columns), len(columns[0])
    plain = found.part < 0
    row, pos, none = np.zeros(n, np.int32), np.zeros(n, np.int32), np.ones(n, bool)
    at = found.block[plain]
    row[at], pos[at], none[at] = found.row[plain], found.pos[plain], False
    parts = pa.nulls(n, pa.list_(_PART))
    if found.parts:
        own = np.flatnonzero(~plain)
        own = own[np.argsort(found.part[own])]
        fields = {c: pa.array(v, _PART.field(c).type) for c, v in found.parts.items() if c != "block"}
        fields |= {"row_index": pa.array(found.row[own].astype(np.int32)), "pos": pa.array(found.pos[own].astype(np.int32))}
        parts = listed(found.block[own], n, pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))
    return pa.StructArray.from_arrays([pa.array(row, mask=none), pa.array(pos, mask=none), parts], names=["row_index", "pos", "parts"])


def on_pages(batches: Iterator[tuple[pa.Array, ...]], f: Callable[[list[pa.Array]], pa.Array]) -> Iterator[pa.Array]:
    """f of batches of whole pages. Pages are cut where numbers start again; the last of a batch waits for the next."""
    held: list[list[pa.Array]] = []
    for columns in batches:
        first = np.flatnonzero(columns[0].to_numpy(zero_copy_only=False) == 1)
        if not len(first):
            held.append(list(columns))
            continue
        last = int(first[-1])
        whole = [*held, [c.slice(0, last) for c in columns]]
        held = [[c.slice(last) for c in columns]]
        if sum(len(w[0]) for w in whole):
            yield f([pa.concat_arrays(c) for c in zip(*whole, strict=True)])
    if held:
        yield f([pa.concat_arrays(c) for c in zip(*held, strict=True)])


def number(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """RESULT for rows (number on the page, y_center, x_center, height, what tells a vertical block) in reading order."""
    yield from on_pages(batches, _whole)
