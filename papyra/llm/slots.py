"""A cache from 64-bit keys to slots with pooled values, for pieces of text that recur."""

from __future__ import annotations

import numpy as np

#: Bytes of arrays from which a cache starts anew before it takes more.
MOST_BYTES = 48 << 20


class Slots:
    """Sorted keys with slot numbers: a large run, and a recent one that is merged into it now and then."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
        self.slots = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.size = 0
        self.starts, self.counts = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.pool, self.used = np.zeros(4096, np.int32), 0

    def full(self) -> bool:
        return sum(x.nbytes for x in (*self.keys, *self.slots, self.starts, self.counts, self.pool)) > MOST_BYTES

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of distinct keys; -1 where missing."""
        out = np.full(len(keys), -1, np.int64)
        for own, slots in zip(self.keys, self.slots, strict=True):
            if len(own):
                at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                hit = own[at] == keys
                out[hit] = slots[at[hit]]
        return out

    def add(self, keys: np.ndarray, counts: np.ndarray, values: np.ndarray) -> np.ndarray:
        """New keys (sorted) with their values end to end; their slots."""
        n, slots = len(keys), np.arange(self.size, self.size + len(keys))
        while self.size + n > len(self.starts):
            self.starts, self.counts = np.concatenate([self.starts, np.zeros_like(self.starts)]), np.concatenate([self.counts, np.zeros_like(self.counts)])
        while self.used + len(values) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.counts[slots] = counts
        self.starts[slots] = self.used + np.cumsum(counts) - counts
        self.pool[self.used : self.used + len(values)] = values
        self.used += len(values)
        self.size += n
        self._merge(1, keys, slots)
        if len(self.keys[1]) > 65_536:
            self._merge(0, self.keys[1], self.slots[1])
            self.keys[1], self.slots[1] = self.keys[1][:0], self.slots[1][:0]
        return slots

    def _merge(self, run: int, keys: np.ndarray, slots: np.ndarray) -> None:
        keys, slots = np.concatenate([self.keys[run], keys]), np.concatenate([self.slots[run], slots])
        order = np.argsort(keys, kind="stable")
        self.keys[run], self.slots[run] = keys[order], slots[order]

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the slots end to end, and their counts."""
        counts = self.counts[slots].astype(np.int64)
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.starts[slots] - ends + counts, counts) + np.arange(total)], counts
