"""The Merkle manifest, the prefix trie and the top-k search against plain Python."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.llm import merkle, prefix_trie, top_search
from papyra.llm.common import numbered, ranked


def H(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


# ---------------------------------------------------------------- places
def test_ranked_and_numbered(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([None, *range(9)]), k % 5) for k in range(400)]
    frame = spark.createDataFrame(rows, "g string, x long, w long").repartition(7)
    got = ranked(frame, "g", ("x",), "test-ranked", running="w").collect()
    for g in ("a", "b", None):
        of = sorted((r for r in got if r.g == g), key=lambda r: r._index)
        assert [r._index for r in of] == list(range(len(of))) and {r._size for r in of} == {len(of)}
        assert [r.x for r in of] == sorted((r.x for r in of), key=lambda x: (x is not None, x or 0))
        assert [r._before for r in of] == [sum(r.w for r in of[:k]) for k in range(len(of))] and {r._whole for r in of} == {sum(r.w for r in of)}
    assert sorted(((r.g, r.x, r.w) for r in got), key=str) == sorted(rows, key=str)
    assert sorted(r.n for r in numbered(frame, "test-numbered", "n").collect()) == list(range(400))
    assert ranked(frame.limit(0), "g", ("x",), "test-ranked").count() == 0


# ---------------------------------------------------------------- 11
def proofs(rows, arity=2):
    """(doc_id, leaf, subroot, root, proof digest, folded root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H("".join(map(field, r)))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([H("".join(levels[-1][i : i + arity])) for i in range(0, len(levels[-1]), arity)])
        return levels

    def beside(levels, i):
        for level in levels[:-1]:
            start = i // arity * arity
            yield level[start:i], level[i + 1 : start + arity]
            i //= arity

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            path = [*beside(trees[g], i), *beside(top, k)]
            tampered = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf((*r[:3], r[3] + 1, r[4])) if tampered else leaf(r)
            for left, right in path:
                now = H("".join(left) + now + "".join(right))
            yield r[0], leaf(r), trees[g][-1][0], top[-1][0], H("".join("".join(a + b) for a, b in path)), now, now == top[-1][0]


def manifest_of(frame, arity, levels):
    chars = F.col("n_chars").cast("long")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, chars + 1).otherwise(chars)
    return merkle.verified(merkle.manifest(frame, changed={"n_chars": tampered}, arity=arity, levels=levels), arity=arity)


def leaves():
    rng = random.Random(4)
    rows = [(k, rng.choice(["web", None, ""]), rng.choice(["en"] * 6 + ["de", "fr", None]), rng.choice([None, 5, 2**31 - 1]), rng.choice([None, "", "é€\n", "x" * 300_000 if k == 3 else "words"])) for k in range(300)]
    rows += [(400, "web", "once", 1, "alone"), (None, "web", "en", 1, "no id"), (-8, None, "", None, None)]
    return rows + [rows[5]] * 9 + [(7, "other", "en", 2, "same id")] * 2


@pytest.mark.parametrize(("arity", "levels"), [(2, 10), (2, 2), (3, 2), (5, 1)])
def test_manifest(spark, arity, levels):
    rows = leaves()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars int, text string, leaf string, `index` int")
    got = [tuple(r) for r in manifest_of(frame, arity, levels).collect()]
    assert sorted(got, key=str) == sorted(proofs(rows, arity), key=str)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 3


@pytest.mark.parametrize("count", [0, 1, 2, 3])
def test_manifest_of_few(spark, count):
    rows = [(k, "s", "en", 1, "t") for k in range(count)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")
    assert sorted(map(tuple, manifest_of(frame, 2, 10).collect())) == sorted(proofs(rows))


def test_other_fields_and_groups(spark):
    """The general interface: any fields, groups and order; proofs of a table that hasn't changed hold."""
    frame = spark.range(50).select((F.col("id") % 3).alias("shard"), F.col("id").alias("n"), F.lit("x").alias("body"))
    out = merkle.verified(merkle.manifest(frame, group="shard", order="n", fields=("n", "body")), "n").collect()
    assert len(out) == 50 and all(r.verified for r in out) and len({r.subroot for r in out}) == 3 and len({r.root for r in out}) == 1


def test_cells_stay_small(spark):
    """No key of a lookup is asked for by more than a cell's leaves, however large the group."""
    frame = spark.range(3000).select(F.lit("t").alias("tree"), F.col("id").alias("index"), F.lit(3000).cast("long").alias("count"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    inputs, nodes, tops = merkle.build(frame, 2, 4)
    assert [x.count() for x in inputs] == [3000, 188, 12] and tops.count() == 1
    for x, n in zip(inputs, nodes, strict=True):
        assert n.groupBy("tree", "cell").count().agg(F.max("count")).first()[0] <= 31
        assert merkle.siblings(x, n, 2, 4).agg(F.max(F.size("path"))).first()[0] == 4


# ---------------------------------------------------------------- 12
def nodes_of(rows):
    told = lambda r, x: hashlib.sha256(f"{len((r or '').encode())}:{r or ''}{x or ''}".encode()).digest()
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append(((t is not None, t or 0, told(r, x)), (r or "", x or "")))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    whole = {c: own.get(c - int(math.fmod(c, 100)), [])[: heads[c]] + own[c][heads[c] :] for c in own}
    members = {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        children = [x for x in below if len(x) == len(k) + 1]
        childless = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below) for x in below)
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(k))
        yield min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children), childless, saved, H(ends)


def trie_of(frame):
    conv = F.col("conv")
    turns = prefix_trie.turns_of(frame)
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(turns, base=conv - conv % 100, head=F.crc32(conv.cast("string")) % 6, most=5))


def talks():
    rng = random.Random(3)
    rows = []
    for c in [*range(95, 125), -5, -100, -101, 250, 205, 301]:
        for t in range(rng.choice([1, 2, 3, 7, 12, 33])):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "bot", None]), rng.choice(["x", "yy", None, "é€𝄞", ""]) if rng.random() < 0.3 else "x"))
    return rows + rows[:4] + [(None, 1, "user", "nobody's"), (400, 0, "user", "w" * 200_000)]


def test_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = talks()
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn int, role string, text string, depth string")
    got = [tuple(r) for r in trie_of(frame).collect()]
    assert sorted(got, key=str) == sorted(nodes_of(rows), key=str)
    assert max(r[1] for r in got) > 32 and any(r[3] > 5 and r[1] > 0 for r in got)


def test_trie_with_turnless_conversations_and_none(spark):
    """A conversation whose turns all give way to an absent one has no turns; a table without conversations has no nodes."""
    rows = [(c, 0, "user", "hello") for c in range(201, 240)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = [tuple(r) for r in trie_of(frame).collect()]
    assert sorted(got, key=str) == sorted(nodes_of(rows), key=str)
    assert next(r for r in got if r[1] == 0)[7] != H("")
    assert trie_of(frame.limit(0)).count() == 0


@pytest.mark.parametrize("count", [1, 2, 3, 7, 8, 100])
def test_prefixes_by_doubling(spark, count):
    """Names of prefixes are those of equal sequences, for every depth; conversations that differ late share them until there."""
    talk = {0: "a" * count, 1: "a" * (count - 1) + "b", 2: "ab" * count, 3: "a"}
    rows = [(c, at, x.encode()) for c, s in talk.items() for at, x in enumerate(s)]
    got = {(r.conv, r.depth): r.name for r in prefix_trie.prefixes(spark.createDataFrame(rows, "conv long, at long, digest binary")).collect()}
    assert set(got) == {(c, d) for c, s in talk.items() for d in range(1, len(s) + 1)}
    for c, d in got:
        for e in talk:
            if (e, d) in got:
                assert (got[c, d] == got[e, d]) == (talk[c][:d] == talk[e][:d])


# ---------------------------------------------------------------- 13
def highest(rows, k=5):
    good = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for n, i, v in good:
        if i is not None and i % 50 == 0:
            others = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), j is None, j or 0, j) for m, j, w in good if m != n), key=lambda t: t[:3])
            yield from ((i, r, x[3], -x[0]) for r, x in enumerate(others[:k], 1))


def clustered(n=700):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = []
    for i in range(n):
        v = [x + rng.gauss(0, 0.05) for x in rng.choice(centres)]
        odd = [None, [], [1.0, None], [float("nan")] * 8, [float("inf")] * 8, v[:3], [0.0] * 8, rows[0][1] if rows else v]
        rows.append((rng.choice([i, i, i, None, i // 50 * 50]), v if rng.random() < 0.8 else rng.choice(odd)))
    return rows + [(50 * i, rows[1][1]) for i in range(40)]


@pytest.mark.parametrize(("block", "chunk", "group"), [(128, 64, 1024), (8, 2, 4)])
def test_search(spark, monkeypatch, block, chunk, group):
    for name, value in (("BLOCK", block), ("CHUNK", chunk), ("GROUP", group)):
        monkeypatch.setattr(top_search, name, value)
    rows = clustered()
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = [tuple(r) for r in top_search.search(frame, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got, key=str) == sorted(highest(rows), key=str)


def test_search_of_large_numbers_and_few_rows(spark):
    """Sums beyond 2^53 stay exact; with fewer candidates than k all come; a score beyond 64 bits is an error."""
    rng = random.Random(6)
    large = [(i, [rng.choice([5e6, -3e6, 2.5, 7e5]) * rng.random() for _ in range(3)]) for i in range(120)]
    for rows in (large, large[:3], large[:1], []):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = [tuple(r) for r in top_search.search(frame, F.col("vec_id") % 50 == 0).collect()]
        assert sorted(got, key=str) == sorted(highest(rows), key=str)
    frame = spark.createDataFrame([(0, [1e12]), (1, [1e12])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        top_search.search(frame, F.col("vec_id") % 50 == 0).collect()


def test_bounds_hold_and_prune():
    """No score passes its block's bound; with clusters most blocks are never scored."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(64, 16)) * 256
    x = np.floor(np.concatenate([c + rng.normal(size=(32, 16)) * 8 for c in centres]))
    blocks = x.reshape(64, 32, 16)
    b = top_search.bounds(x, blocks.max(1), blocks.min(1))
    scores = (x @ x.T).reshape(len(x), 64, 32)
    assert (scores.max(2) <= b).all()
    kth = np.sort(x @ x.T, axis=1)[:, -6]
    assert (b >= kth[:, None]).sum(1).mean() < 8
