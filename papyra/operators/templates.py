"""Which template a text belongs to: the first whose key stands in it, for catalogues of any size.

All keys are searched at once. A catalogue of up to MOST_BYTES of keys goes to every task as an automaton over them, so texts
stay where they are. Keys of a larger one meet the texts that hold a piece of them in an equi-join (see anchors).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors

#: Bytes of keys that go to every task.
MOST_BYTES = 8 << 20


class Keys:
    """Keys with their places in the catalogue; the first place counts."""

    def __init__(self, pairs: Iterable[tuple[str, int]]):
        self.automaton, self.empty = ahocorasick.Automaton(), None
        for key, place in pairs:
            if key:
                self.automaton.add_word(key, min((place, key), self.automaton.get(key, (place, key))))
            elif key is not None:
                self.empty = min((place, key), self.empty or (place, key))
        if len(self.automaton):
            self.automaton.make_automaton()

    def first(self, text: str | None) -> tuple[int, str] | None:
        """(place, key) of the first key, by place, that stands in the text."""
        if text is None:
            return None
        found = (hit for _, hit in self.automaton.iter(text)) if len(self.automaton) else ()
        return min([*found, *([self.empty] if self.empty else [])], default=None)


_HIT = pa.struct([("ordinal", pa.int64()), ("supplier_key", pa.string())])


def _found(keys: Keys, texts: list[str | None]) -> pa.Array:
    return pa.array([None if h is None else {"ordinal": h[0], "supplier_key": h[1]} for h in map(keys.first, texts)], _HIT)


def matched(docs: DataFrame, templates: DataFrame, most_bytes: int = MOST_BYTES, most_filter: int = anchors.MOST_FILTER) -> DataFrame:
    """(doc_id, hit struct<ordinal, supplier_key>) of docs (doc_id, full_text): rows with a hit, one or more a document."""
    keys = templates.where("supplier_key is not null").groupBy("supplier_key").agg(F.min("ordinal").cast("long").alias("ordinal"))
    size = F.sum(F.octet_length("supplier_key") + 64)
    total = keys.agg(size.alias("n")).first().n or 0
    texts = docs.select("doc_id", F.col("full_text").cast("string").alias("text"))
    out = f"doc_id {dict(texts.dtypes)['doc_id']}, hit struct<ordinal:bigint,supplier_key:string>"
    if total <= most_bytes:
        pairs = [(r.supplier_key, r.ordinal) for r in keys.collect()]  # most_bytes at most

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready = Keys(pairs)
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), _found(ready, b.column(1).to_pylist())], names=["doc_id", "hit"])

        return texts.mapInArrow(search, out).where("hit is not null")
    some = keys.where("supplier_key <> ''").select(F.col("supplier_key").alias("key"), "ordinal")
    hits = anchors.met(texts, some, most_filter).select("doc_id", F.struct("ordinal", F.col("key").alias("supplier_key")).alias("hit"))
    # An empty key stands in every text.
    empty = keys.where("supplier_key = ''").select(F.struct("ordinal", "supplier_key").alias("hit"))
    return hits.unionByName(texts.where("text is not null").select("doc_id").crossJoin(F.broadcast(empty)))
