"""Quality classifier: histogram gradient-boosted trees over document statistics.

Defined results: null and empty texts have the score of an all-zero row; texts of any length count whole; repeated rows
and rows of equal or null doc_id are each scored; an empty table gives no rows; columns that aren't kept are left out.

The statistics come from the text alone. A bounded, documented sample of labelled rows trains the trees on the
driver; each tree is complete, so it is three arrays and numpy descends one level for all rows at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, steps, text_bytes
from .kernel import shingle_sets, word_hashes

#: Labelled rows that train at most, taken in the order of a hash of their id.
MOST_ROWS = 20_000
FEATURES = (
    "log_bytes", "upper", "lower", "digit", "space", "newline", "punctuation", "non_ascii", "exclaim", "bar", "stop", "comma", "other_ascii", "slash_at", "brackets",
    "byte_entropy", "upper_of_letters", "log_words", "word_bytes", "distinct_words", "top_word", "distinct_pairs", "distinct_fives", "log_lines", "line_bytes", "distinct_lines", "short_lines", "stops_per_line", "bars_per_word", "exclaims_per_word",
)


def _classes() -> np.ndarray:
    """(256, 14): the byte classes that are counted."""
    sets = [range(65, 91), range(97, 123), range(48, 58), b" \t\r\x0b\x0c", b"\n", b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", range(128, 256), b"!", b"|", b".", b",", bytes(range(9)) + bytes(range(14, 32)), b"/@", b"<>{}[]()"]
    out = np.zeros((256, len(sets)))
    for k, members in enumerate(sets):
        out[list(members), k] = 1
    return out


_CLASSES = _classes()


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; an empty text has zeros."""
    rows = len(offsets) - 1
    sizes = np.diff(offsets)
    counts = np.stack([np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256) for i in range(rows)]) if rows else np.zeros((0, 256))
    named = counts @ _CLASSES
    per = np.maximum(sizes, 1)[:, None]
    share = counts / per
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    w, first = word_hashes(data, offsets)
    n_words = np.diff(first)
    _, fives = shingle_sets(data, offsets)
    more = np.zeros((rows, 7))
    for i in range(rows):
        own = w[first[i] : first[i + 1]]
        if len(own):
            _, c = np.unique(own, return_counts=True)
            more[i, 0], more[i, 1] = len(c) / len(own), c.max() / len(own)
            more[i, 2] = len(np.unique(own[:-1] * np.uint64(3) + own[1:])) / max(len(own) - 1, 1)
        start, end = offsets[i], offsets[i + 1]
        lines = data[start:end].tobytes().split(b"\n")
        more[i, 3], more[i, 4] = len(lines), len(set(lines)) / len(lines)
        more[i, 5] = sum(len(x) < 25 for x in lines) / len(lines)
        more[i, 6] = sum(x[-1:] in b".!?" and x != b"" for x in lines) / len(lines)
    letters = np.maximum(named[:, 0] + named[:, 1] + named[:, 6], 1)
    per_word = np.maximum(n_words, 1)
    columns = [np.log1p(sizes), *(named / per).T, entropy, named[:, 0] / letters, np.log1p(n_words), (sizes - named[:, 3] - named[:, 4]) / per_word, more[:, 0], more[:, 1], more[:, 2], np.diff(fives) / np.maximum(n_words - 4, 1), np.log1p(more[:, 3]), np.log1p(sizes / np.maximum(more[:, 3], 1)), more[:, 4], more[:, 5], more[:, 6], named[:, 8] / per_word, named[:, 7] / per_word]
    out = np.stack(columns, 1)
    out[sizes == 0] = 0
    return out


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: node k's children are 2k+1 and 2k+2; right where feature > threshold."""

    base: float
    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray  # the same
    leaf: np.ndarray  # (trees, 2**depth)

    def margin(self, x: np.ndarray) -> np.ndarray:
        depth = self.leaf.shape[1].bit_length() - 1
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss. Each level's gradient histograms are one bincount a feature over (node, bin).

    Without rows, or with labels of one kind, it gives no splits and the base rate (smoothed by one row of each kind).
    """
    positive = float(y.sum())
    base = float(np.log((positive + 1) / (len(y) - positive + 1)))
    if len(y) == 0 or positive in (0, len(y)):
        return Trees(base, np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)))
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    codes = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(width)], 1)  # code > k means x > edges[k]
    found = []
    total = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            nodes, first = 2**level, 2**level - 1
            best = np.full(nodes, 1e-9)
            cut = np.full((nodes, 2), -1)
            for j in range(width):
                key = node * bins + codes[:, j]
                gs = np.bincount(key, g, nodes * bins).reshape(nodes, bins).cumsum(1)
                hs = np.bincount(key, h, nodes * bins).reshape(nodes, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least) | (ht - hs < least)] = 0
                at = gain[:, : len(edges[j])].argmax(1) if len(edges[j]) else np.zeros(nodes, np.int64)
                value = gain[np.arange(nodes), at] if len(edges[j]) else np.zeros(nodes)
                better = value > best
                best[better] = value[better]
                cut[better, 0], cut[better, 1] = j, at[better]
            split = cut[:, 0] >= 0
            feature[first : first + nodes][split] = cut[split, 0]
            threshold[first : first + nodes][split] = [edges[j][k] for j, k in cut[split]]
            mine = cut[node]
            node = 2 * node + ((mine[:, 0] >= 0) & (codes[np.arange(len(y)), np.maximum(mine[:, 0], 0)] > mine[:, 1]))
        leaf = -rate * np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + ridge)
        total += leaf[node]
        found.append((feature, threshold, leaf))
    return Trees(base, *(np.stack(x) for x in zip(*found, strict=True)))


_ROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _matrix(batch: pa.RecordBatch):
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
    for a, b in steps(offsets):
        yield a, b, features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def held_out(doc_id: F.Column | str = "doc_id"):
    """True where crc32 of the id as text leaves 1 modulo 3; such rows never train. A null id is held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Trees:
    """Trees from labelled documents that are not held out.

    A document with several labels counts with its smallest. At most most_rows labelled ids train: those with
    the smallest hashes, so the sample is the same whatever the partitions. Of rows of equal doc_id one trains, that with
    the smallest features. A null label or text of null id doesn't train; no labels at all give a constant score.
    """
    sample = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    size = len(FEATURES)
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("x", pa.list_(pa.float64()))])

    def step(batch):
        for a, b, x in _matrix(batch):
            rows = batch.slice(a, b - a)
            yield batch_of(schema, rows.column("doc_id").cast(pa.int64()), rows.column("quality").cast(pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * size), pa.array(x.ravel())))

    # The sample has at most most_rows rows, whatever the input: it is broadcast.
    rows = arrow_map(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), step, "doc_id long, quality int, x array<double>")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("r")).select("doc_id", "r.quality", "r.x")
    got = one.toArrow().sort_by([("doc_id", "ascending")])  # most_rows rows at most
    x = np.asarray(got.column("x").combine_chunks().flatten()).reshape(-1, size)
    return fit(x, (np.asarray(got.column("quality")) > 0).astype(float))


def score(docs: DataFrame, model: Trees, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score in 0 to 1, and the columns of keep. Null and empty texts have the score of an all-zero row."""
    kinds = {f.name: f for f in docs.schema}
    schema_sql = ", ".join([*(f"`{c}` {kinds[c].dataType.simpleString()}" for c in ("doc_id", *keep)), "score double"])

    def step(batch):
        for a, b, x in _matrix(batch):
            rows = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("doc_id", *keep)), pa.array(model.score(x))], names=["doc_id", *keep, "score"])

    return arrow_map(docs.select("doc_id", "text", *(c for c in keep if c != "text")), step, schema_sql)
