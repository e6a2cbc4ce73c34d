"""Rows and tables over Arrow batches of whole pages: row texts and kinds, the page's columns, and which of them items belong to.

The same as row_texts, adaptive_columns, advanced_table and document_structure say in SQL's arrays. Each function takes what
reading.number takes, then text, x_min and x_max, and gives a list for each block: Spark explodes it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..catalog import HEADERS, KEY_HEADERS, NOT_HEADERS, ROW_WORDS, UNIT_CHARACTERS
from .reading import Items, items, listed, numbers, on_pages

_SIDES = ("x_center", "y_center", "y_min", "y_max", "width", "height")
ROW = "array<struct<row_index:int,row_text:string,n_items:bigint,row_y_min:double,row_y_max:double>>"
COLUMN = "array<struct<column_index:int,name:string,left:double,right:double>>"
CELL = "array<struct<row_index:int,column_key:string,cell:string>>"
ITEM = f"array<struct<row_index:int,pos:int,row_type:string,in_body:boolean,column_index:int,column_name:string,part:struct<text:string,ordinal:bigint,{','.join(f'{c}:double' for c in _SIDES)}>>>"
_KINDS = ("header", "total", "subtotal", "footer", "data")
_WORDS = [re.sub(" ", "", w.lower()) for w in chain(*HEADERS.values(), *ROW_WORDS.values())]
#: Pairs of an item and a column that are compared at once.
_PAIRS = 1 << 20


def _holds(texts: pa.Array, words) -> np.ndarray:
    return pc.match_substring_regex(texts, "|".join(map(re.escape, words))).to_numpy(zero_copy_only=False)


def _values(a: pa.Array) -> tuple:
    """As to_pylist, which takes its time, each value made once."""
    a = a.dictionary_encode()
    values = [*a.dictionary.to_pylist(), None]
    return tuple(values[k] for k in a.indices.fill_null(len(values) - 1).to_numpy().tolist())


def _squeezed(text: str) -> str:
    return text.lower().replace(" ", "")


def _name(text: str | None) -> str | None:
    """The first standard name of which the text holds a spelling; the text itself otherwise."""
    low = _squeezed(text or "")
    return next((name for name, spellings in HEADERS.items() if any(_squeezed(v) in low for v in spellings)), text)


def _named(row: list[tuple]) -> list[tuple]:
    """(name, centre, left, right) of a header row's (centre, place, text, left, right); see table.header_items."""
    out, skip = [], False
    for i, (c, _, t, a, b) in enumerate(row):
        if skip or t in NOT_HEADERS:
            skip = False
            continue
        _, _, t2, a2, b2 = row[i + 1] if i + 1 < len(row) else (None,) * 5
        single = t is not None and len(t) == 1
        if single and t2 is not None and len(t2) == 1 and a2 is not None and b is not None and a2 - b < 50:
            out.append((_name(t + t2), None if a is None or b2 is None else (a + b2) / 2, a, b2))
            skip = True
        elif t == "位":
            out.append(("单位", c, a, b))
        elif not (single and (t in UNIT_CHARACTERS or not any(t in v for v in chain(*HEADERS.values())))):
            out.append((_name(t), c, a, b))
    return out


def _full(named: list[tuple]) -> list[tuple]:
    """named, or the eight standard headers; see table.with_template."""
    if len(named) >= 8 or len({n[0] for n in named} & set(KEY_HEADERS)) < 2:
        return named
    lo, hi = min((n[2] for n in named if n[2] is not None), default=None), max((n[3] for n in named if n[3] is not None), default=None)
    wide = None if lo is None or hi is None else (hi - lo) / 8
    own, out = {n[0]: n for n in named}, []
    for k, name in enumerate(HEADERS):
        standard = (None,) * 3 if wide is None else (lo + (k + 0.5) * wide, lo + k * wide, lo + (k + 1) * wide)
        out.append((name, *(s if v is None else v for v, s in zip(own.get(name, (None,) * 4)[1:], standard, strict=True))))
    return out


def _columns(names: list, left: list, right: list) -> tuple:
    """A page's columns: names, ends, keys, and for each the first column of its key."""
    keys = [name or f"col_{k}" for k, name in enumerate(names)]
    first: dict[str, int] = {}
    return names, left, right, keys, [first.setdefault(key, k) for k, key in enumerate(keys)]


@lru_cache(maxsize=4096)
def _header_columns(texts: tuple, left: tuple, right: tuple) -> tuple | None:
    """The columns that a header row names; none if it names none."""
    row = [(None if a is None or b is None else (a + b) / 2, pos, t if t is None else t.strip(" "), a, b) for pos, (t, a, b) in enumerate(zip(texts, left, right, strict=True))]
    rank = lambda v: (v is not None, v != v, v)
    full = _full(_named(sorted(row, key=lambda r: (rank(r[0]), r[1]))))
    if not full:
        return None
    lefts, rights = [], []
    for k, (_, c, a, b) in enumerate(full):
        before, after = full[k - 1][1] if k else None, full[k + 1][1] if k + 1 < len(full) else None
        mid = lambda p, q: None if p is None or q is None else (p + q) / 2
        lefts.append(mid(before, c) if before is not None else 0.0 if a is None else max(0.0, a - 50))
        rights.append(mid(c, after) if after is not None else None if b is None else b + 100)
    return _columns([f[0] for f in full], lefts, rights)


def _projected(left: np.ndarray, right: np.ndarray) -> tuple | None:
    """The columns of a page's projection (see geometry.projection_runs); none if nothing covers it."""
    some = ~np.isnan(left) & ~np.isnan(right)
    lo, hi = np.trunc(left[some]), np.trunc(right[some])
    lo, hi = lo[hi > lo], hi[hi > lo]
    if not len(lo):
        return None
    at, back = np.unique(np.concatenate([lo, hi]), return_inverse=True)
    level = np.cumsum(np.bincount(back, np.repeat([1.0, -1.0], len(lo))))
    on = level > level.max() * 0.3
    edge = np.diff(on.astype(np.int8), prepend=0)
    first, last = at[edge == 1].tolist(), np.minimum(at[edge == -1], at[-1] - 1).tolist()
    return _columns([""] * len(first), first, last)


class _Pages:
    """A batch's items row by row, and what follows from them; what isn't asked for isn't worked out."""

    def __init__(self, columns: list[pa.Array]):
        found, text, left, right = items(columns[:5]), *columns[5:]
        self.blocks, self.parts = len(text), found.parts
        start = np.append(True, (np.diff(found.page) > 0) | (np.diff(found.row) != 0))
        row = np.cumsum(start) - 1
        order = np.empty(len(row), np.int64)
        order[np.flatnonzero(start)[row] + found.pos] = np.arange(len(row))
        self.items = Items(*(a[order] for a in found[:-1]), found.parts)
        #: Each item's row in the batch, where rows start, and each row's page and number.
        self.row, self.first = row, np.flatnonzero(start)
        self.page, self.index = self.items.page[self.first], self.items.row[self.first]
        at = pa.array(self.items.block)
        self.text, self.left, self.right = text.take(at), left.take(at), right.take(at)
        if found.parts:
            # Parts have texts of their own, and their block's ends.
            place = np.where(self.items.part < 0, np.arange(len(row)), len(row) + self.items.part)
            self.text = pa.concat_arrays([self.text, pa.array(found.parts["text"], self.text.type)]).take(pa.array(place))
        self.n = np.diff(np.append(self.first, len(row)))
        self.page_first = np.flatnonzero(np.append(True, np.diff(self.page) > 0))

    def joined(self, texts: pa.Array, first: np.ndarray) -> pa.Array:
        """Texts joined by a space, in groups that begin at first; nulls are left out."""
        offsets = np.append(0, np.cumsum(np.add.reduceat(texts.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), first)))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), texts.drop_null()), " ")

    @cached_property
    def texts(self) -> pa.Array:
        return self.joined(self.text, self.first)

    @cached_property
    def told(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows whose text holds any word that tells something, and the kind and matches of their text. Texts that occur more than once are looked at once."""
        low = pc.utf8_lower(self.texts)
        some = np.flatnonzero(_holds(pc.replace_substring(low, " ", ""), _WORDS))
        texts = low.take(pa.array(some)).dictionary_encode()
        back, raw = texts.indices.to_numpy(), self.texts.take(pa.array(some))
        low, squeezed = texts.dictionary, pc.replace_substring(texts.dictionary, " ", "")
        header = sum(_holds(low, [w]).astype(np.int8) for w in ROW_WORDS["header"]) >= 2
        kind = np.select([header, *(_holds(low, ROW_WORDS[k]) for k in _KINDS[1:4])], range(4), 4)
        n = sum(_holds(squeezed, map(_squeezed, spellings)).astype(np.int64) for spellings in HEADERS.values())
        return some, kind[back], np.where(_holds(raw, NOT_HEADERS), np.maximum(n[back] - 1, 0), n[back])

    @cached_property
    def kind(self) -> np.ndarray:
        """Each row's place in _KINDS."""
        out = np.full(len(self.index), 4)
        out[self.told[0]] = self.told[1]
        return out

    @cached_property
    def body(self) -> np.ndarray:
        of = lambda kinds, other: np.where(np.isin(self.kind, kinds), self.index, other)
        start, end = np.maximum.reduceat(of([0], -1), self.page_first)[self.page], np.minimum.reduceat(of([1, 3], 1 << 30), self.page_first)[self.page]
        return (self.kind == 4) & (self.index > start) & (self.index < end)

    @cached_property
    def heads(self) -> np.ndarray:
        """The header rows: of a page's first eight the one with most matches, three at least, the first of equals."""
        at, _, n = self.told
        score = np.full(len(self.index), -1)
        score[at] = np.where((self.index[at] < 8) & (n >= 3), n * 8 + 7 - self.index[at], -1)
        return np.flatnonzero((score >= 0) & (score == np.maximum.reduceat(score, self.page_first)[self.page]))

    @cached_property
    def columns(self) -> list[tuple]:
        """Each page's columns: from its header row, else from the projection, else from the widest row."""
        out: list[tuple | None] = [None] * len(self.page_first)
        ends = np.append(self.first, len(self.row)).tolist()
        spans = [(ends[r], ends[r + 1]) for r in self.heads.tolist()]
        at = pa.array(np.concatenate([np.arange(a, b) for a, b in spans] or [np.zeros(0, np.int64)]))
        texts, left, right = (_values(c.take(at)) for c in (self.text, self.left, self.right))
        k = 0
        for p, (a, b) in zip(self.page[self.heads].tolist(), spans, strict=True):
            n = k + b - a
            out[p] = _header_columns(texts[k:n], left[k:n], right[k:n])
            k = n
        some = [p for p, c in enumerate(out) if c is None]
        if some:
            bounds, x_min, x_max = np.append(self.page_first, len(self.page)), numbers(self.left), numbers(self.right)
            for p in some:
                a, b = bounds[p], bounds[p + 1]
                wide = a + int(np.argmax(self.n[a:b]))
                out[p] = _projected(x_min[ends[a] : ends[b]], x_max[ends[a] : ends[b]]) or _columns([""] * int(self.n[wide]), *(c[ends[wide] : ends[wide + 1]].to_pylist() for c in (self.left, self.right)))
        return out

    @cached_property
    def offsets(self) -> np.ndarray:
        """Where each page's columns start among all."""
        return np.append(0, np.cumsum([len(c[0]) for c in self.columns]))

    def flat(self, k: int) -> list:
        return list(chain.from_iterable(c[k] for c in self.columns))

    @cached_property
    def nearest(self) -> np.ndarray:
        """Each item's column, a place among all: the nearest centre of those whose range, widened by half its width, holds it; else of all."""
        x, page = self.items.x, self.items.page
        out = np.empty(len(x), np.int64)
        # Pages of the same header have the same columns: they are compared together.
        same: dict[int, int] = {}
        group = np.array([same.setdefault(id(c), len(same)) for c in self.columns])[page]
        order = np.argsort(group, kind="stable") if len(same) > 1 else np.arange(len(x))
        ends = np.cumsum(np.bincount(group, minlength=len(same))).tolist()
        kinds = {same[id(c)]: c for c in self.columns}
        for g, (a, end) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            left, right = (np.array(c, float) for c in kinds[g][1:3])
            centre, slack = (left + right) / 2, (right - left) * 0.5
            low, high, none = left - slack, right + slack, np.isnan(centre)
            many = max(1, _PAIRS // len(centre))
            while a < end:
                at = order[a : min(a + many, end)]
                v = x[at, None]
                far, near = np.abs(v - centre), (v >= low) & (v <= high)
                if none.any():
                    # A column without ends comes before all others, as in SQL.
                    far[:, none], near[:, none] = -np.inf, True
                far[~near & near.any(1)[:, None]] = np.inf
                out[at] = far.argmin(1)
                a += len(at)
        return self.offsets[page] + out


def _rows(columns: list[pa.Array]) -> pa.Array:
    p = _Pages(columns)
    y = p.items.y
    side = lambda f: pa.array(f.reduceat(y, p.first), from_pandas=True)
    values = {"row_index": pa.array(p.index.astype(np.int32)), "row_text": p.texts, "n_items": pa.array(p.n.astype(np.int64)), "row_y_min": side(np.fmin), "row_y_max": side(np.fmax)}
    return listed(p.items.block[p.first], p.blocks, pa.StructArray.from_arrays(list(values.values()), names=list(values)))


def _bounds(columns: list[pa.Array]) -> pa.Array:
    p = _Pages(columns)
    n = np.diff(p.offsets)
    index = np.arange(p.offsets[-1]) - np.repeat(p.offsets[:-1], n)
    values = {"column_index": pa.array(index.astype(np.int32)), "name": pa.array(p.flat(0), pa.string()), "left": pa.array(p.flat(1), pa.float64()), "right": pa.array(p.flat(2), pa.float64())}
    # With the first block of each page.
    return listed(np.repeat(p.items.block[p.first[p.page_first]], n), p.blocks, pa.StructArray.from_arrays(list(values.values()), names=list(values)))


def _cells(columns: list[pa.Array]) -> pa.Array:
    p = _Pages(columns)
    column = p.nearest
    key = p.offsets[p.items.page] + np.array(p.flat(4), np.int64)[column]
    order = np.lexsort((key, p.row))
    row, key = p.row[order], key[order]
    first = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(key) != 0)))
    values = {"row_index": pa.array(p.index[row[first]].astype(np.int32)), "column_key": pa.array(p.flat(3), pa.string()).take(pa.array(key[first])), "cell": p.joined(p.text.take(pa.array(order)), first)}
    return listed(p.items.block[order[first]], p.blocks, pa.StructArray.from_arrays(list(values.values()), names=list(values)))


def _placed(columns: list[pa.Array]) -> pa.Array:
    p = _Pages(columns)
    column, part = p.nearest, p.items.part
    values = {"row_index": pa.array(p.items.row.astype(np.int32)), "pos": pa.array(p.items.pos.astype(np.int32)), "row_type": pa.array(_KINDS).take(pa.array(p.kind[p.row])), "in_body": pa.array(p.body[p.row])}
    values["column_index"] = pa.array((column - p.offsets[p.items.page]).astype(np.int32))
    values["column_name"] = pa.array([name or "" for name in p.flat(0)], pa.string()).take(pa.array(column))
    fields = [("text", pa.string()), ("ordinal", pa.int64()), *((c, pa.float64()) for c in _SIDES)]
    some = [pa.array(p.parts.get(c, []), t) for c, t in fields]
    at = pa.array(part, mask=part < 0)
    values["part"] = pa.StructArray.from_arrays(some, names=[c for c, _ in fields]).take(at) if p.parts else pa.nulls(len(part), pa.struct(fields))
    return listed(p.items.block, p.blocks, pa.StructArray.from_arrays(list(values.values()), names=list(values)))


def rows(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """ROW: texts of rows."""
    yield from on_pages(batches, _rows)


def bounds(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """COLUMN: a page's columns."""
    yield from on_pages(batches, _bounds)


def cells(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """CELL: the texts of each row and column."""
    yield from on_pages(batches, _cells)


def placed(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """ITEM: each item's row, what kind that is, and its column."""
    yield from on_pages(batches, _placed)
