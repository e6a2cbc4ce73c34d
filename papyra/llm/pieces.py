"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding works as the library does: the best-scored pair of neighbouring symbols merges first, the leftmost of
equals, until no pair makes a piece. A text falls into segments that no piece spans (a piece has the space mark only
in front); distinct segments are encoded once and kept. All segments of a batch run their agendas together in numpy,
one merge of each a round; segments of more than LONG symbols have a heap of their own.

Every new segment that can stand alone is checked against the sentencepiece library, and so is one whole document of
each step; where they differ, the library's ids are taken for that segment or step. Decoding is the library's.

Defined results: null and empty texts have no ids and decode to the empty text.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, batch_of, steps, text_bytes
from .kernel import byte_sums, range_hash
from .slots import Slots

LONG = 48
_NONE = np.int32(1 << 30)
_MARK = "▁"


class Codec:
    """Encoder and decoder of one model, with its cache of segments."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = proto.ModelProto()
        spec.ParseFromString(model)
        normal = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces or not spec.trainer_spec.byte_fallback or any(p.type in (4, 5) for p in spec.pieces) or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a merge-type vocabulary with byte fallback, the identity normaliser and no user-defined pieces is asked for")
        self.prefix = normal.add_dummy_prefix
        pieces = {p.piece: (i, p.score) for i, p in enumerate(spec.pieces) if p.type == 1}
        if any(_MARK in p.lstrip(_MARK) for p in pieces):
            raise ValueError("a piece has the space mark inside")
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == 6}
        # Symbols are piece ids; single characters that are no piece, but may be part of one, have ids after them.
        extra = sorted({c for p in pieces for c in p} - pieces.keys())
        self.symbol = {p: i for p, (i, _) in pieces.items()} | {c: len(spec.pieces) + k for k, c in enumerate(extra)}
        self.limit = len(spec.pieces)
        self.extra = {self.limit + k: c for k, c in enumerate(extra)}
        self.breaks_lines = not any("\n" in p for p in pieces)
        ranks = {s: k for k, s in enumerate(sorted({s for _, s in pieces.values()}, reverse=True))}
        pairs = {}
        for piece, (i, s) in pieces.items():
            for k in range(1, len(piece)):
                if (left := self.symbol.get(piece[:k])) is not None and (right := self.symbol.get(piece[k:])) is not None:
                    pairs[left << 20 | right] = (ranks[s], i)
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k][0] for k in self.pair_keys.tolist()], np.int32)
        self.pair_ids = np.array([pairs[k][1] for k in self.pair_keys.tolist()], np.int32)
        points = np.full(0x110000, -1, np.int32)
        for p, i in self.symbol.items():
            if len(p) == 1:
                points[ord(p)] = i
        self.points = points
        self.cache = Slots()
        self.names = [str(i) for i in range(self.limit)]
        self.checked = self.differed = 0

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        hit = (self.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(hit, self.pair_ranks[at], _NONE), self.pair_ids[at]

    def _agenda_rows(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of symbols, -2 after the end; the same after all merges. Each round merges the best pair of each row."""
        out = symbols.copy()
        rows, now = np.arange(len(symbols)), symbols.copy()
        ranks, _ = self._rank(now[:, :-1], now[:, 1:])
        while True:
            best = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(now), np.int64)
            open_ = ranks[np.arange(len(now)), best] < _NONE if ranks.shape[1] else np.zeros(len(now), bool)
            if not open_.all():
                out[rows[~open_], : now.shape[1]] = now[~open_]
                out[rows[~open_], now.shape[1] :] = -2
                rows, now, ranks, best = rows[open_], now[open_], ranks[open_], best[open_]
            if not len(rows):
                return out
            line = np.arange(len(now))
            _, merged = self._rank(now[line, best], now[line, best + 1])
            width = now.shape[1] - 1
            shift = np.arange(width)[None, :] + (np.arange(width)[None, :] > best[:, None])
            now = np.take_along_axis(now, shift, 1)
            now[line, best] = merged
            # The pair in front of the new symbol and the one behind it have other ranks; later ones move by one.
            place = np.arange(width - 1)[None, :]
            ranks = np.take_along_axis(ranks, place + (place > best[:, None]), 1) if width > 1 else np.zeros((len(now), 0), np.int32)
            if width > 1:
                for d in (-1, 0):
                    at = best + d
                    good = (at >= 0) & (at < width - 1)
                    k = np.flatnonzero(good)
                    ranks[k, at[k]] = self._rank(now[k, at[k]], now[k, at[k] + 1])[0]

    def _agenda_heap(self, symbols: list[int]) -> list[int]:
        """The same for one long row, by a heap of pairs over a linked list."""
        n = len(symbols)
        before, after, sym = list(range(-1, n - 1)), [*range(1, n), -1], list(symbols)
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and sym[a] >= 0 and sym[b] >= 0 and (found := self.pairs.get(sym[a] << 20 | sym[b])):
                heapq.heappush(heap, (found[0], a, b, sym[a], sym[b]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, left, right = heapq.heappop(heap)
            if sym[a] != left or sym[b] != right or after[a] != b:
                continue
            sym[a], sym[b] = self.pairs[left << 20 | right][1], -3
            after[a] = after[b]
            if after[a] >= 0:
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [s for s in sym if s != -3]

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        """Ids of segments whose spaces are marks already."""
        out: list[list[int]] = [[]] * len(segments)
        order = sorted(range(len(segments)), key=lambda i: len(segments[i]))
        sizes = np.array([len(segments[i]) for i in order], np.int64)
        codes = self.points[np.frombuffer("".join([segments[i] for i in order]).encode("utf-32-le"), np.uint32)]
        at = start = 0
        while at < len(order):
            size = int(sizes[at])
            end = at + 1 if size > LONG else int(np.searchsorted(sizes, size, "right"))
            block = codes[start : start + size * (end - at)].reshape(end - at, size)
            merged = np.array([self._agenda_heap(block[0].tolist())], np.int32) if size > LONG else self._agenda_rows(block) if size else block
            counts = (merged != -2).sum(1).tolist()
            strange = ((merged == -1) | (merged >= self.limit)).any(1).tolist()
            for i, row, n, bytes_too in zip(order[at:end], merged.tolist(), counts, strange, strict=True):
                out[i] = self._with_bytes(segments[i], row[:n]) if bytes_too else row[:n]
            start += size * (end - at)
            at = end
        return out

    def _with_bytes(self, segment: str, row: list[int]) -> list[int]:
        """Ids of a row in which characters that are no piece become their bytes."""
        unknown = iter([c for c in segment if c not in self.symbol])
        ids: list[int] = []
        for s in row:
            if s == -1 or s >= self.limit:
                ids += [self.byte_ids[b] for b in (next(unknown) if s == -1 else self.extra[s]).encode()]
            else:
                ids.append(s)
        return ids

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each row's first id."""
        rows = len(offsets) - 1
        raw = data.tobytes()
        if _MARK.encode() in raw:
            parts = [raw[offsets[i] : offsets[i + 1]].replace(_MARK.encode(), b" ") for i in range(rows)]
            data = np.frombuffer(b"".join(parts), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        full = np.diff(offsets) > 0
        if self.prefix:
            data = np.insert(data, offsets[:-1][full], 32)
            offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        space = data == 32
        first = space.copy()
        first[1:] &= ~space[:-1]
        if self.breaks_lines:
            line = data == 10
            first |= line
            first[1:] |= line[:-1]
        first[offsets[:-1][full]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(data))
        keys, at, inverse = np.unique(range_hash(byte_sums(data), starts, ends), return_index=True, return_inverse=True)
        if self.cache.full():
            self.cache.clear()
        slots = self.cache.find(keys)
        new = np.flatnonzero(slots < 0)
        if len(new):
            whole = data.tobytes()
            texts = [whole[starts[k] : ends[k]].decode().replace(" ", _MARK) for k in at[new].tolist()]
            ids = self._checked(texts, self.encode_segments(texts))
            slots[new] = self.cache.add(keys[new], np.array([len(x) for x in ids], np.int32), np.array([i for x in ids for i in x], np.int32))
        flat, counts = self.cache.gather(slots[inverse])
        return flat, np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, offsets)]

    def _checked(self, texts: list[str], ids: list[list[int]]) -> list[list[int]]:
        if not self.prefix:
            return ids
        alone = [k for k, t in enumerate(texts) if t[0] == _MARK and len(t) > 1]
        for k, right in zip(alone, self.library.encode([texts[k][1:] for k in alone], num_threads=1), strict=True):
            self.checked += 1
            if ids[k] != right:
                ids[k] = right
                self.differed += 1
        return ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        flat, cut = self.encode_bytes(data, offsets)
        return [flat[cut[i] : cut[i + 1]].tolist() for i in range(len(texts))]


_codecs: dict[str, Codec] = {}


def codec(model: bytes) -> Codec:
    """One codec a worker and model."""
    name = hashlib.sha256(model).hexdigest()
    if name not in _codecs:
        _codecs[name] = Codec(model)
    return _codecs[name]


def encode_documents(docs: DataFrame, model_path: str, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens long, ids_sha256, decoded_sha256 string, decoded string, and with ids the ids as array<int>.

    The model file is read on the driver and broadcast; its size is that of the vocabulary.
    """
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def step(batch):
        own = codec(model.value)
        schema = pa.schema([("doc_id", batch.schema.field(0).type), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *([("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if ids else [])])
        data, offsets = text_bytes(batch.column(1))
        for a, b in steps(offsets):
            part, cut_bytes = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            flat, id_cut = own.encode_bytes(part, cut_bytes)
            probe = int(np.argmax(np.diff(cut_bytes) > 0))
            if own.library.encode(part[cut_bytes[probe] : cut_bytes[probe + 1]].tobytes().decode(), num_threads=1) != flat[id_cut[probe] : id_cut[probe + 1]].tolist():
                own.differed += 1
                lists = own.library.encode([part[cut_bytes[i] : cut_bytes[i + 1]].tobytes().decode() for i in range(b - a)], num_threads=1)
                flat, id_cut = np.array([i for x in lists for i in x], np.int32), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            else:
                lists = [flat[id_cut[i] : id_cut[i + 1]].tolist() for i in range(b - a)]
            digests = [hashlib.sha256(",".join(map(own.names.__getitem__, x)).encode()).hexdigest() for x in lists]
            decoded = own.library.decode(lists, num_threads=1) if lists else []
            del lists
            more = [pa.ListArray.from_arrays(pa.array(id_cut.astype(np.int32)), pa.array(flat, pa.int32())), decoded] if ids else []
            yield batch_of(schema, batch.column(0).slice(a, b - a), np.diff(id_cut), digests, [hashlib.sha256(x.encode()).hexdigest() for x in decoded], *more)

    out = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * ids
    return arrow_map(docs.select("doc_id", "text"), step, out)
