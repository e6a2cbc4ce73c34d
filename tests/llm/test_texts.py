"""Text operators against brute force on small tables with nulls, empties, long texts, ties and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from papyra.llm import fingerprints, licenses, line_dedup, mixing, pieces, quality, shingle_join, suffix_dedup, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, copies int, n int"


def corpus(seed=0, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(1, 7)))
    long = " ".join(word() for _ in range(3000))
    passage = " ".join(word() for _ in range(90))
    texts = [None, "", " ", "one two", "One  TWO", "a b c d e", "é 日本 ▁ x<|endoftext|>y", "\n\n", long, long + " tail", long[5:]]
    for _ in range(n):
        t = " ".join(word() for _ in range(rnd.randrange(1, 200)))
        if rnd.random() < 0.4:
            w = t.split(" ")
            w.insert(rnd.randrange(len(w) + 1), passage)
            t = " ".join(w)
        texts.append(t)
        if rnd.random() < 0.4:
            w = t.split(" ")
            for _ in range(rnd.randrange(0, 1 + len(w) // 30)):
                w[rnd.randrange(len(w))] = word()
            texts.append(" ".join(w))
        if rnd.random() < 0.2:
            texts.append(t)
    return [(i, t, "en", rnd.choice(["b", "a", "é", None]), len(t or ""), 1, 2, 3) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k=5):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def classes(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def jaccard_classes(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, classes(sets, linked), linked


def test_shingle_join(spark, docs, rows, empty, monkeypatch):
    sets, label, linked = jaccard_classes(rows)
    assert len(linked) > 10
    got = shingle_join.shingle_classes(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), label[i]) for i in sets}
    kept = Counter(r.component_id for r in got if r.kept and r.n_shingles)
    assert set(kept.values()) == {1}
    assert shingle_join.shingle_classes(empty).count() == 0
    # Groups dealt into blocks give the same classes.
    monkeypatch.setattr(shingle_join, "GROUP", 500)
    assert {r.doc_id: r.component_id for r in shingle_join.shingle_classes(docs).collect()} == label


def test_shingle_join_holds_many_of_a_shingle(spark, monkeypatch):
    """A shingle of many sets in a flush travels once; small flushes, rows of one id with several texts, another order of
    rows and long texts give the same classes."""
    rnd = random.Random(19)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(70):
        w = list(base)
        for _ in range(rnd.randrange(0, 9)):
            w[rnd.randrange(60)] = f"x{rnd.randrange(500)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"v{rnd.randrange(5000)}" for _ in range(9000))] * 2
    texts.append(texts[-1] + " more words than the other")
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[60]), (4, "other words of an id that is there already")]
    numbered = [(k, t) for k, (_, t) in enumerate(rows)]
    _, label, linked = jaccard_classes(numbered)
    assert len(linked) > 60 and len(set(label.values())) > 5
    least = {}
    for k, c in label.items():
        least[c] = min(least.get(c, 1 << 60), rows[k][0])
    want = sorted((rows[k][0], least[c]) for k, c in label.items())
    for flush in (2_000_000, 300):
        monkeypatch.setattr(shingle_join, "FLUSH", flush)
        for parts in (1, 4):
            frame = spark.createDataFrame(rows[::-1] if parts == 4 else rows, "doc_id long, text string").repartition(parts)
            assert sorted((r.doc_id, r.component_id) for r in shingle_join.shingle_classes(frame).collect()) == want


def test_shingle_join_null_and_repeated_ids(spark):
    t = " ".join(f"w{k}" for k in range(40))
    frame = spark.createDataFrame([(None, t), (None, t), (7, t), (7, t), (3, t + " x"), (None, "alone by itself")], "doc_id long, text string")
    got = shingle_join.shingle_classes(frame).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 3), (-1, 3), (3, 3), (7, 3), (7, 3)]


def test_prefix_tree_join_random():
    import numpy as np

    rnd = random.Random(5)
    for _ in range(60):
        base = [sorted(rnd.sample(range(80), rnd.randrange(1, 40))) for _ in range(4)]
        sets = [np.array(sorted({x if rnd.random() > 0.06 else rnd.randrange(80) for x in rnd.choice(base)})) for _ in range(25)]
        sizes = [len(s) for s in sets]
        prefixes = [shingle_join.allowed(n, 80) + 1 for n in sizes]
        linked = [(i, j) for i in range(25) for j in range(i) if 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))]
        assert shingle_join.join_group(sets, sizes, prefixes, 80) == list(classes(range(25), linked).values())


def test_fingerprints(spark, docs, rows, empty):
    ring = sorted(rows, key=lambda r: -r[0])
    got = {r.doc_id: r for r in fingerprints.edit_pairs(docs).collect()}
    assert len(got) == len(rows)
    for k, r in enumerate(ring):
        text, other = r[1] or "", ring[(k + 1) % len(ring)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + other[:half]
        g = got[r[0]]
        assert (g.n_chars, g.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert [g.fingerprint, g.edited_fingerprint] == [fingerprints.text_of(fingerprints.fingerprints([t])[0]) for t in (text, changed)]
        assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
    long = [r for r in got.values() if r.n_chars > 300]
    assert sum(r.near_edited for r in long) / len(long) > 0.45
    assert fingerprints.edit_pairs(empty).count() == 0
    one = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    assert fingerprints.edit_pairs(one).first().near_next == 1.0


def naive_signature(raw, k):
    """Pieces of a text at block size 3 * 2**k: ends where the rolling hash of the last seven bytes plus one is a multiple of it."""
    from papyra.llm.fingerprints import _ROLL, LETTERS, PIECES, WINDOW
    from papyra.llm.kernel import byte_sums, range_hash
    import numpy as np

    ends = []
    for at in range(WINDOW - 1, len(raw)):
        h, factor = 0, 1
        for j in range(WINDOW):
            h = (h + int(_ROLL[raw[at - j]]) * factor) & 0xFFFFFFFF
            factor = factor * 0x9E3779B1 & 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x2C1B3C6D & 0xFFFFFFFF
        h ^= h >> 13
        if (h + 1) % (3 << k) == 0 and at + 1 < len(raw):
            ends.append(at + 1)
    limits = [0, *ends[: PIECES - 1], len(raw)]
    sums = byte_sums(np.frombuffer(raw, np.uint8))
    letters = [LETTERS[int(range_hash(sums, np.array([a]), np.array([b]))[0] >> np.uint64(58))] for a, b in zip(limits, limits[1:])]
    return len(ends), "".join(letters)


def naive_likeness(left, right):
    """Likeness of two fingerprints from their texts, by dynamic programming."""
    if left == right:
        return 1.0
    (a, *x), (b, *y) = (f.split(":") for f in (left, right))
    pairs = [(x[0], y[0]), (x[1], y[1])] if a == b else [(x[0], y[1])] if int(a) == 2 * int(b) else [(x[1], y[0])] if int(b) == 2 * int(a) else []

    def one(s, t):
        lcs = [0] * (len(t) + 1)
        for u in s:
            before = 0
            for j, v in enumerate(t, 1):
                before, lcs[j] = lcs[j], before + 1 if u == v else max(lcs[j], lcs[j - 1])
        m = min(7, len(s), len(t))
        if not s or not t:
            return float(s == t)
        return 2 * lcs[-1] / (len(s) + len(t)) if any(s[i : i + m] in t for i in range(len(s) - m + 1)) else 0.0

    return max((one(s, t) for s, t in pairs), default=0.0)


def test_fingerprints_one_by_one(spark):
    """Signatures piece by piece and likenesses by dynamic programming, with tied and null ids."""
    rnd = random.Random(21)
    texts = ["".join(rnd.choice("abcde \n") for _ in range(rnd.randrange(0, 900))) for _ in range(14)] + [None, "", "short", "same line\n" * 130]
    texts += [texts[0], texts[3] + " tail"]
    rows = [(None if i == 5 else i // 2 * 2 if i in (8, 9) else i, t) for i, t in enumerate(texts)]
    got = fingerprints.edit_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    known = {}
    for t in texts:
        raw = (t or "").encode()
        if not raw:
            known[t or ""] = "3::"
            continue
        k = next(k for k in range(31) if naive_signature(raw, k)[0] <= fingerprints.PIECES - 1)
        k -= k > 0 and naive_signature(raw, k)[0] + 1 < fingerprints.PIECES // 2
        known[t] = f"{3 << k}:{naive_signature(raw, k)[1]}:{naive_signature(raw, k + 1)[1]}"
    own = Counter((r.doc_id, r.fingerprint) for r in got)
    assert own == Counter((i, known[t or ""]) for i, t in rows)
    ring = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    order = {r[0]: k for k, r in enumerate(ring)}
    for r in got:
        assert r.near_edited == pytest.approx(naive_likeness(r.fingerprint, r.edited_fingerprint))
        if r.doc_id in (None, 8, 10) or Counter(i for i, _ in rows)[r.doc_id] > 1:
            continue  # what follows a tied id is either of its rows
        after = ring[order[r.doc_id] + 1] if order[r.doc_id] + 1 < len(ring) else next(x for x in rows if x[0] is None)
        if Counter(i for i, _ in rows)[after[0]] == 1:
            assert r.near_next == pytest.approx(naive_likeness(r.fingerprint, known[after[1] or ""]))


def test_fingerprints_of_repeated_lines():
    """A text of one stretch repeated keeps a signature, and half of it edited away leaves a likeness."""
    for times in (64, 130, 1000):
        text = "the same line stands here again\n" * times
        other = "".join(random.Random(times).choice("abcdefgh \n") for _ in range(len(text)))
        changed = fingerprints.edited(text, other)
        first, second = fingerprints.fingerprints([text, changed])
        assert len(first[1]) >= fingerprints.PIECES // 2
        assert fingerprints.compare([first], [second])[0] > 0.25


def test_likeness_is_indel_distance():
    rnd = random.Random(2)
    for _ in range(50):
        a, b = ("".join(rnd.choice("ABC") for _ in range(rnd.randrange(0, 65))) for _ in range(2))
        lcs = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, lcs[j] = lcs[j], before + 1 if x == y else max(lcs[j], lcs[j - 1])
        m = min(7, len(a), len(b))
        common = any(a[i : i + m] in b for i in range(len(a) - m + 1)) and (m > 0 or a == b)
        want = (2 * lcs[-1] / (len(a) + len(b)) if a or b else 1.0) if common else 0.0
        assert fingerprints.likeness([a], [b])[0] == pytest.approx(want)


def removed_by_brute_force(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((len(x), sum(gone), len([p for p in bytes(gone).split(b"\0") if p]), bytes(b for b, g in zip(x, gone, strict=True) if not g)))
    return out


def test_suffix_dedup(spark, docs, rows, empty):
    want = removed_by_brute_force([r[1] for r in rows], 400)
    assert sum(0 < n < size for size, n, _, _ in want) > 3
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == {r[0]: w for r, w in zip(rows, want, strict=True)}
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    # One repeat inside a document, and periodic text.
    frame = spark.createDataFrame([(1, "x" * 401), (2, "ab" * 300), (None, "y" * 400), (4, "é" * 300)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(frame).collect()}
    assert got == {1: 401, 2: 600, None: 0, 4: 600}


def hot_rows(length=400):
    """One passage under the length that many documents hold in different surroundings, some of them alike."""
    rnd = random.Random(11)
    letters = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    out = []
    for passage in (letters(170), letters(290), letters(length - 1), letters(length + 30)):
        near = letters(250)
        for k in range(45):
            before, after = letters(rnd.randrange(0, 500)), letters(rnd.randrange(0, 500))
            if k % 5 == 0:
                before += near[rnd.randrange(0, 250) :]
            if k % 7 == 0:
                after = near[: rnd.randrange(0, 250)] + after
            out.append((len(out), before + passage + after))
    return out


def test_suffix_dedup_splits_hot_anchors(spark, monkeypatch):
    rows = hot_rows()
    want = {i: w for (i, _), w in zip(rows, removed_by_brute_force([t for _, t in rows], 400), strict=True)}
    assert 10 < sum(n > 0 for _, n, _, _ in want.values()) < len(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    rounds = []
    keep = suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "stored", lambda df, name: rounds.append(name) or keep(df, name))
    for hot in (1, 3000, 10_000):
        rounds.clear()
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(frame, hot=hot).collect()}
        assert got == want
        assert rounds.count("suffix-spans") > (2 if hot < 10_000 else 1)


def test_suffix_dedup_deals_common_anchors_evenly(spark, monkeypatch):
    rows = hot_rows()
    rows += [(len(rows) + k, f"{k:>5}" + rows[3][1][:450] * 2) for k in range(60)] + [(500, "z" * 3000), (None, "q" * 150 + rows[3][1] + "q")]
    want = Counter((i, *w) for (i, _), w in zip(rows, removed_by_brute_force([t for _, t in rows], 400), strict=True))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    dealt = []
    keep = suffix_dedup.in_shards
    monkeypatch.setattr(suffix_dedup, "in_shards", lambda pieces, n: dealt.append(pieces) or keep(pieces, n))
    for common in (1_000_000, 20, 1):
        for hot in (suffix_dedup.HOT, 2000):
            dealt.clear()
            out = suffix_dedup.suffix_dedup(frame, hot=hot, common=common)
            assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()) == want
        most = []
        for pieces in dealt:
            stretches = [r for r in pieces.collect() if r.body is not None]
            # Equal stretches leave a task once: no row has two places.
            assert stretches and all(len(r.places) == (0 if r.several else 24) for r in stretches)
            most.append(max(Counter(r.anchor for r in stretches if not r.common and r.known < 400).values(), default=0))
        # A passage below the length, in 45 documents, is one task's, unless it is split by others before.
        assert max(most) >= 45 if common > 45 else max(most) <= common


def test_split_sends_equal_windows_alike():
    rnd = random.Random(12)
    for _ in range(200):
        length, known = 40, rnd.randrange(8, 41)
        body = bytes(rnd.randrange(97, 100) for _ in range(rnd.randrange(length, 2 * length - known + 1)))
        last = len(body) - length
        at = rnd.randrange(last, length - known + 1)
        parts = suffix_dedup.split(5, body, at, known, length)
        windows = [start + k for _, part, _, start in parts for k in range(len(part) - length + 1)]
        assert sorted(windows) == list(range(last + 1))
        now = known + -(-(length - known) // 2)
        for key, part, place, start in parts:
            # A window that stands alone gets the same key, and all windows hold the bytes at the new place.
            for k in range(len(part) - length + 1):
                assert k <= place and place + now <= k + length
                alone = suffix_dedup.split(5, part[k : k + length], at - start - k, known, length)
                assert [(x[0], x[2]) for x in alone] == [(key, place - k)]


def common_prefix(x, i, j):
    k = 0
    while max(i, j) + k < len(x) and x[i + k] == x[j + k]:
        k += 1
    return k


@pytest.mark.parametrize("memory", [1 << 40, 40, 7])
def test_suffix_order_random(memory):
    """Order and common prefixes, up to any depth, also with queues and texts on disk and names sorted by recursion."""
    import numpy as np

    from papyra.llm.suffix_order import suffix_order

    rnd = random.Random(3)
    for turn in range(150):
        kinds = rnd.choice([1, 2, 3, 27])
        x = [rnd.randrange(1, kinds + 1) for _ in range(rnd.randrange(0, 150))]
        if turn % 3 == 0:
            x = (x * 3)[:200]
        y = [*x, 0]
        order, common = suffix_order(np.array(x, np.int32), len(y), memory)
        assert list(order) == sorted(range(len(y)), key=lambda i: y[i:])
        assert list(common) == [0] + [common_prefix(y, i, j) for i, j in zip(order, order[1:])]
        depth = rnd.randrange(1, 12)
        order, common = suffix_order(np.array(x, np.int32), depth, memory)
        assert sorted(order) == list(range(len(y))) and all(y[i : i + depth] <= y[j : j + depth] for i, j in zip(order, order[1:]))
        assert list(common) == [0] + [min(depth, common_prefix(y, i, j)) for i, j in zip(order, order[1:])]


def test_shard_larger_than_memory(monkeypatch):
    """A shard of some 30 KB with 500 items of memory: queues spill, names recurse, and repeats are those of brute force."""
    from papyra.llm import suffix_order

    rnd = random.Random(31)
    passage = bytes(rnd.randrange(97, 123) for _ in range(90))
    stretches = [bytes(rnd.randrange(97, 123) for _ in range(rnd.randrange(40, 400))) for _ in range(100)]
    stretches = [s[: len(s) // 2] + passage[k % 50 :] + s[len(s) // 2 :] if k % 3 == 0 else s for k, s in enumerate(stretches)] + [b"ab" * 60, b"\0" * 80]
    spills = []
    keep = suffix_order.Queue.spill
    monkeypatch.setattr(suffix_order.Queue, "spill", lambda self: spills.append(self.held) or keep(self))
    windows = [len(s) - 40 + 1 for s in stretches]
    got = suffix_dedup.repeated_windows(stretches, windows, 40, memory=500)
    times = Counter(s[k : k + 40] for s in stretches for k in range(len(s) - 39))
    assert [list(h) for h in got] == [[times[s[k : k + 40]] > 1 for k in range(len(s) - 39)] for s in stretches]
    assert len(spills) > 20 and max(spills) <= 500 + max(map(len, stretches)) * 30


def test_suffix_dedup_with_little_memory(spark):
    """Repeated and null doc_ids, NUL bytes, and sorting with hardly any memory."""
    rnd = random.Random(8)
    letters = lambda n: "".join(rnd.choice("abcd\0") for _ in range(n))
    shared = letters(700)
    rows = [(k // 2 if k < 20 else None, letters(rnd.randrange(0, 300)) + (shared[: rnd.randrange(350, 700)] if k % 2 else "") + letters(rnd.randrange(0, 300))) for k in range(26)]
    want = removed_by_brute_force([t for _, t in rows], 400)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(frame, memory=300).collect()]
    assert sorted(map(repr, got)) == sorted(repr((i, *w)) for (i, _), w in zip(rows, want, strict=True))


def test_token_files(spark, docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    start = 0
    got = {r.doc_id: r for r in tokens.read_tokens(spark, tokens.write_tokens(docs, path)).collect()}
    for r in sorted(rows):
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 0]
        g = got[r[0]]
        assert (g.start, g.n_tokens, g.ids) == (start, len(ids), ids)
        assert g.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        start += len(ids)
    assert tokens.read_tokens(spark, tokens.write_tokens(empty, path)).count() == 0


def test_pack_round_trip():
    import numpy as np

    for n in (0, 1, 3, 4, 1001):
        ranks = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64) >> np.random.default_rng(n + 1).integers(0, 32, n, dtype=np.uint64)
        counts, back = tokens.read_block(tokens.block(np.array([n]), ranks))
        assert counts.tolist() == [n] and (back == ranks).all()


def test_pretokens_follow_the_library():
    import public_tokenizers
    from papyra.llm.common import text_bytes
    import pyarrow as pa

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as file:
        encoder = tokens.Encoder(file.read())
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(" ab\n▁é日.'xsztrevlmd'12 🎉\t½\x85 ") for _ in range(rnd.randrange(0, 30))) for _ in range(3000)]
    flat, cut = encoder.encode(*text_bytes(pa.array(texts)))
    assert [flat[cut[i] : cut[i + 1]].tolist() for i in range(len(texts))] == [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]


def test_sentencepiece(spark, docs, rows, empty):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in pieces.encode_documents(docs, path).collect():
        ids = library.encode(rows[r.doc_id][1] or "")
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.encode_documents(empty, path).count() == 0


def test_agenda_alone_equals_the_library():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as file:
        codec = pieces.Codec(file.read())
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(" ab\n▁é日.'xyzthe<>|🎉\t") for _ in range(rnd.randrange(0, 120))) for _ in range(1500)] + ["x" * 300, "abc" * 100, "▁▁ a"]
    assert codec.encode(texts) == library.encode(texts)
    assert codec.checked and not codec.differed


def test_licenses(spark, docs, empty):
    texts = ["No CC BY-NC here; cc by. Cc-By", "GENERAL public license\nall rights\nreserved", None, "", "ccby cc byx", "Released under the MIT license today\nnothing"]
    frame = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in licenses.scan(frame).collect()}
    for i, t in enumerate(texts):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = sorted(k for p in licenses.PHRASES.values() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        base = sorted(label for label, p in licenses.PHRASES.items() if any(w[k : k + len(p.split())] == p.split() for k in range(len(w))))
        g = got[i]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == (len(w), len(places), places[0] if places else None, places[-1] if places else None, ",".join(base))
        assert set(base) <= set(g.labels.split(",")) | {""} and 0 <= g.score <= 1
    assert "mit" in got[5].labels and got[2].score == 0
    assert licenses.scan(empty).count() == 0


def test_license_join_is_exact():
    rnd = random.Random(4)
    vocabulary = [bytes([97 + k]) for k in range(20)]
    for _ in range(100):
        known = [(f"t{k}", frozenset(rnd.sample(vocabulary, rnd.randrange(1, 10)))) for k in range(5)]
        join = licenses.Join(known, {w: rnd.randrange(5) for w in vocabulary}, 0.8)
        block = frozenset(rnd.sample(vocabulary, rnd.randrange(0, 15)))
        assert join.probe(block) == {label: len(w & block) / len(w) for label, w in known if len(w & block) >= 0.8 * len(w) - 1e-9}


def test_license_windows(spark, tmp_path):
    from papyra.llm import queries

    mit = " ".join(licenses.TEMPLATES["mit"][1].split())
    w = mit.split(" ")
    wrapped = "\n".join("# " + " ".join(w[k : k + 6]) for k in range(0, len(w), 6))
    prose = [f"word{k}" for k in range(60)]
    texts = [
        "code\n" + wrapped + "\nmore code",
        " ".join(["all", *prose, "rights", *prose, "reserved"]),
        " ".join([*prose, "All rights reserved.", *prose]),
        " ".join(x for k in range(len(w)) for x in (w[k], *prose[:3])),
        "a\n\n" + "\n".join(w) + "\n" + " ".join(prose) + "\nAll\nrights\nreserved\n" + " ".join(prose) + "\n" + mit,
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(frame).collect()}
    found = {i: [(b.line, b.label, b.containment) for b in r.blocks] for i, r in got.items()}
    assert found == {0: [(1, "mit", 1.0)], 1: [], 2: [(0, "all-rights-reserved", 1.0)], 3: [], 4: [(2, "mit", 1.0), (3 + len(w), "all-rights-reserved", 1.0), (7 + len(w), "mit", 1.0)]}
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    labels = {r.doc_id: (r.labels, r.score) for r in queries.op7_license_scan(spark, str(tmp_path)).collect()}
    assert labels[0] == ("mit", 1.0) and labels[1] == ("", 0.0)


def test_license_labels_tell_licenses_apart(spark):
    """Other licences' lines have no label; wrapped and commented notices have theirs."""
    wrap = lambda t: "\n".join(" * " + " ".join(t.split()[k : k + 9]) for k in range(0, len(t.split()), 9))
    gpl2 = licenses.TEMPLATES["gpl-3.0"][1].replace("version 3", "version 2")
    cases = {
        "Released under the BSD License.": "", "Released under the Apache License": "", "Licensed under the Mozilla Public License, version 2.0.": "", "Licensed under CC BY 4.0.": "",
        "all the rights we reserved are listed": "", "This work is licensed under a Creative Commons Attribution 4.0 International License": "", wrap(gpl2): "gpl-2.0",
        "Released under the MIT License.": "mit", "licensed under cc by-nc 4.0": "cc-by-nc-4.0", "ALL RIGHTS RESERVED": "all-rights-reserved",
    }
    cases |= {wrap(t): label for label, notices in licenses.TEMPLATES.items() for t in notices}
    cases |= {wrap(licenses.TEMPLATES["bsd"][0].replace("this list of conditions", "the list")): "bsd", "": ""}
    frame = spark.createDataFrame(list(enumerate(cases)) * 2 + [(None, "Released under the MIT License.\n" + "x " * 200_000)], "doc_id long, text string")
    got = licenses.scan(frame).collect()
    for r in got:
        own = {label for label in r.labels.split(",") if label and label not in r.base_labels.split(",")}
        want = "mit" if r.doc_id is None else list(cases.values())[r.doc_id]
        assert want in own if want else not own, (r.doc_id, r.labels)
    assert len(got) == 2 * len(cases) + 1


def test_license_order_and_rivals(spark):
    """Words in another order are no notice, a short notice may miss as many pairs as a long one, and of near notices only the own label holds."""
    cases = {
        "reserved: all rights": set(), "License: under the MIT released": set(), "version 2.0 Apache licensed the license under": set(), "the license is released under MIT": set(),
        "This work was licensed under a Creative Commons Attribution NonCommercial 4.0 International License": {"cc-by-nc-4.0"},
        "licensed under the Apache License version 2.0": {"apache-2.0"}, "Licensed under the Apache License, Version 1.1": set(), "SPDX-License-Identifier: MIT": {"mit"},
        "// SPDX-License-Identifier: GPL-3.0-or-later": {"gpl-3.0"}, "SPDX-License-Identifier: LGPL-3.0": {"lgpl-3.0"}, "SPDX-License-Identifier: CC-BY-NC-SA-4.0": set(), "SPDX-License-Identifier: BSD-4-Clause": set(),
        "SPDX-License-Identifier: CC-BY-4.0": set(), "SPDX-License-Identifier: Zlib": set(),
    } | {notice: {label} for label, notices in licenses.TEMPLATES.items() for notice in notices}
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: {b.label for b in r.blocks} for r in licenses.scan(frame).collect()}
    assert {t: got[i] for i, t in enumerate(cases)} == cases
    with pytest.raises(ValueError):
        licenses.scan(frame, templates={"one": ("word",)})


def test_license_windows_are_exact():
    rnd = random.Random(13)
    vocabulary = [bytes([97 + k]) for k in range(14)]
    for _ in range(300):
        known = [(f"t{k}", frozenset(rnd.sample(vocabulary, rnd.randrange(1, 8)))) for k in range(4)]
        join = licenses.Join(known, {x: rnd.randrange(5) for x in vocabulary}, 0.8)
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 60))]
        want = {}
        for (label, sought), width in zip(known, join.windows, strict=True):
            most = max((len(sought & set(words[k : k + width])) / len(sought) for k in range(len(words))), default=0)
            if most >= 0.8 - 1e-9:
                want[label] = most
        got = {}
        for k, label, c in join.blocks(words):
            got[label] = max(got.get(label, 0), c)
            width, sought = next((x, y) for x, (name, y) in zip(join.windows, known, strict=True) if name == label)
            assert len(sought & set(words[k : k + width])) / len(sought) >= c
        assert got == want


def test_quality(spark, docs, rows, empty):
    rnd = random.Random(9)
    good = [(1000 + i, " ".join(f"word{rnd.randrange(500)}" for _ in range(rnd.randrange(20, 90))) + ".") for i in range(150)]
    bad = [(2000 + i, "!! ".join(f"BUY{rnd.randrange(9)}" for _ in range(rnd.randrange(20, 90)))) for i in range(150)]
    frame = spark.createDataFrame([*good, *bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 2000), 0) for i, _ in [*good, *bad]] + [(1000, None, 0), (None, 1, 0), (1001, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(frame, labels)
    got = quality.score(frame, model).withColumn("held", quality.held_out()).collect()
    held = [r for r in got if r.held]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum((r.score >= 0.5) == (r.doc_id < 2000) for r in held) > 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in quality.score(docs, model).collect())
    assert quality.score(empty, model).count() == 0
    constant = quality.train(empty, labels.limit(0))
    assert {r.score for r in quality.score(docs, constant).collect()} == {0.5}


def naive_features(text):
    """FEATURES of one text, one by one."""
    import math

    raw = (text or "").encode()
    n = len(raw)
    if not n:
        return [0.0] * len(quality.FEATURES)
    share = lambda keep: sum(map(keep, raw)) / n
    chars = lambda s: lambda b: b in s
    words = [w.lower() for w in re.split(rb"[\x20\x09-\x0d]+", raw) if w]
    counts, lines = Counter(raw), raw.split(b"\n")
    signs = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    upper, lower, high = (sum(map(keep, raw)) for keep in (lambda b: 65 <= b <= 90, lambda b: 97 <= b <= 122, lambda b: b >= 128))
    times = Counter(words)
    pairs = len({(a, b) for a, b in zip(words, words[1:])}) / max(len(words) - 1, 1)
    fives = len({tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}) if words else 0
    spaces = sum(b in b" \t\r\x0b\x0c\n" for b in raw)
    out = [math.log1p(n), upper / n, lower / n, share(lambda b: 48 <= b <= 57), share(chars(b" \t\r\x0b\x0c")), share(chars(b"\n")), share(chars(signs)), high / n]
    out += [share(chars(b"!")), share(chars(b"|")), share(chars(b".")), share(chars(b",")), share(lambda b: b < 9 or 14 <= b < 32), share(chars(b"/@")), share(chars(b"<>{}[]()"))]
    out += [-sum(c / n * math.log2(c / n) for c in counts.values()), upper / max(upper + lower + high, 1), math.log1p(len(words)), (n - spaces) / max(len(words), 1)]
    out += [len(times) / max(len(words), 1), max(times.values(), default=0) / max(len(words), 1), pairs, fives / max(len(words) - 4, 1)]
    out += [math.log1p(len(lines)), math.log1p(n / len(lines)), len(set(lines)) / len(lines), sum(len(x) < 25 for x in lines) / len(lines), sum(x[-1:] in (b".", b"!", b"?") for x in lines) / len(lines)]
    return [*out, raw.count(b"|") / max(len(words), 1), raw.count(b"!") / max(len(words), 1)]


def test_quality_features_one_by_one(rows):
    import numpy as np
    import pyarrow as pa

    from papyra.llm.common import text_bytes

    texts = [r[1] for r in rows] + ["A.\nB! c|d\n\n/x@y <z>", "One two one TWO three", "\x01\x02 é"]
    got = quality.features(*text_bytes(pa.array(texts)))
    for text, x in zip(texts, got, strict=True):
        want = naive_features(text)
        assert np.allclose(x, want), (text, [(f, a, b) for f, a, b in zip(quality.FEATURES, x, want, strict=True) if abs(a - b) > 1e-8])


def test_quality_trees_one_by_one():
    """The flattened traversal gives what walking each tree node by node gives."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    model = quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float), trees=12, depth=3)

    def walk(row):
        total = model.base
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.score(x), [walk(r) for r in x])
    assert ((model.score(x) > 0.5) == (x[:, 0] + x[:, 1] * x[:, 2] > 0)).mean() > 0.8


def test_quality_bounds_repeated_ids(spark, monkeypatch):
    """Rows of one id train once, however many there are; each is scored."""
    seen = []
    keep = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(y)) or keep(x, y))
    free = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    frame = spark.createDataFrame([(i, f"text {i} {k}") for i in free[:10] for k in range(50)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in free], "doc_id long, quality int, toxic int")
    assert quality.score(frame, quality.train(frame, labels)).count() == 501
    assert seen == [10]


def test_quality_learns_nothing_from_held_out_labels(spark):
    frame = spark.createDataFrame([(i, "A" * (i % 7) + " text") for i in range(100)], "doc_id long, text string")
    labels = lambda flip: spark.createDataFrame([(i, (i % 2) ^ (flip and zlib.crc32(str(i).encode()) % 3 == 1), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    a, b = (sorted((r.doc_id, r.score) for r in quality.score(frame, quality.train(frame, labels(f))).collect()) for f in (False, True))
    assert a == b


def test_mixing(spark, docs, rows, empty):
    got = mixing.mix(docs).collect()
    size = {r[0]: len([w for w in re.split("[\x20\x09-\x0d]+", r[1] or "") if w]) for r in rows}
    total = Counter()
    for r in rows:
        total[r[3]] += size[r[0]]
    order = sorted((s for s in total if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in total if s is None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    goal, open_, capped = 1.5 * sum(total.values()), set(order), {}
    while True:
        level = (goal - sum(capped.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > 2 * total[s]}
        if not over:
            break
        capped |= {s: 2.0 * total[s] for s in over}
        open_ -= over
    target = capped | {s: level * weights[s] for s in open_}
    taken = Counter()
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], total[r.source]) and r.target == pytest.approx(target[r.source])
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(size.values())
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(7)).collect())
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("most", [1.5, 4.0])
def test_mixing_rates(spark, most):
    """Rates are exp(l * size / mean size) of one l a source, up to `most`, and meet the targets, beyond e as below it."""
    import math

    rows = [(k, "ab"[k % 2], " ".join(["w"] * (1 + k * 7 % 40))) for k in range(300)] + [(1000 + k, "c", "w " * 900) for k in range(3)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), most=most).collect()
    for source in "abc":
        of = [r for r in got if r.source == source]
        mean, target = sum(r.size for r in of) / len(of), of[0].target
        assert sum(r.rate * r.size for r in of) == pytest.approx(target, rel=1e-6) and max(r.rate for r in of) <= most + 1e-12
        assert abs(sum(r.taken for r in of) - target) <= 2 * max(r.size for r in of)
        # Bisection for the multiplier, by itself.
        low, high = -50.0, 50.0
        for _ in range(200):
            l = (low + high) / 2
            low, high = (l, high) if sum(r.size * min(most, math.exp(min(l * r.size / mean, 50))) for r in of) < target else (low, l)
        if target < most * of[0].source_size:
            assert [r.rate for r in of] == pytest.approx([min(most, math.exp(min(low * r.size / mean, 50))) for r in of], rel=1e-5)
    assert most < math.e or max(r.rate for r in got) > 3


def test_line_dedup(spark, empty):
    shared = "\n".join(f"shared line {k}" for k in range(60))
    texts = [shared, "own a\nown b\n" + shared, None, "", "x", shared + "\n" + shared, "a\nb"]
    frame = spark.createDataFrame([(i, t, "keep", 9) for i, t in enumerate(texts)], "doc_id long, text string, n_lines string, _x int")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame).collect()}
    assert got[0].text == shared and got[0].removed_lines == 0
    assert got[2].text is None and got[2].n_lines == 0 and got[3].text == "" and got[3].n_lines == 1
    assert got[1].removed_lines > 0 and got[1].text.startswith("own a\nown b") and got[4].text == "x"
    assert got[5].removed_lines > 60
    assert got[1]._x == 9
    # What stays is in order; nothing but whole lines goes.
    for i, t in enumerate(texts):
        if t is not None:
            kept = iter(t.split("\n"))
            assert got[i].text == "" or all(any(x == y for y in kept) for x in got[i].text.split("\n"))
            assert got[i].n_lines - got[i].removed_lines == (len(got[i].text.split("\n")) if got[i].removed_lines < got[i].n_lines else 0)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_brute_force(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(6)
    blocks = ["\n".join(f"{rnd.randrange(40)} line" for _ in range(rnd.randrange(2, 9))) for _ in range(6)]
    rows = [(i, "\n".join(rnd.choice([*blocks, f"lone {i}"]) for _ in range(rnd.randrange(1, 6)))) for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    cut = {r.doc_id: r.c for r in frame.select("doc_id", line_dedup.chunks(F.col("text"), 3).alias("c")).collect()}
    assert all("\n".join(x.body for x in cut[i]) == t for i, t in rows)
    seen, want = set(), {}
    for i, _ in rows:
        kept = []
        for x in cut[i]:
            if x.n < 2 or x.body not in seen:
                kept.append(x.body)
            seen.add(x.body)
        want[i] = "\n".join(kept)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(frame).collect()} == want


def passages_by_brute_force(rows):
    """rows (id, text): (kept text, lines removed), by all pairs of neighbouring lines; rows of an id count as one document."""
    rank = lambda i: (1 << 63) if i is None else i
    first = {}
    for i, t in rows:
        x = (t or "").split("\n")
        for p in zip(x, x[1:]):
            first[p] = min(first.get(p, rank(i)), rank(i))
    out = []
    for i, t in rows:
        if t is None:
            out.append((None, 0))
            continue
        x, gone, seen = t.split("\n"), set(), set()
        for k, p in enumerate(zip(x, x[1:])):
            if first[p] != rank(i) or p in seen:
                gone |= {k, k + 1}
            seen.add(p)
        out.append(("\n".join(v for k, v in enumerate(x) if k not in gone), len(gone)))
    return out


def test_passages_brute_force(spark, empty):
    rnd = random.Random(7)
    blocks = ["\n".join(f"{rnd.randrange(400)} line" for _ in range(n)) for n in (2, 2, 3, 3, 4, 7, 9)]
    rows = [(i, "\n".join(rnd.choice([*blocks, f"lone {i} {rnd.random()}", "common"]) for _ in range(rnd.randrange(1, 8)))) for i in range(80)]
    rows += [(90, None), (91, ""), (92, "x"), (93, "a\na\na\na"), (94, "a\na"), (None, blocks[6]), (None, "own\ntwo\nown\ntwo"), (5, rows[5][1]), (5, blocks[5])]
    frame = spark.createDataFrame([(i, t, 9, "z") for i, t in rows], "doc_id long, text string, _x int, n_lines string").repartition(3)
    got = line_dedup.dedup_passages(frame)
    assert got.columns == ["doc_id", "text", "_x", "n_lines", "removed_lines", "removed_chunks"]
    got = got.collect()
    want = [(i, *w, len(t.split("\n")) if t is not None else 0) for (i, t), w in zip(rows, passages_by_brute_force(rows), strict=True)]
    assert sorted(map(repr, ((r.doc_id, r.text, r.removed_lines, r.n_lines) for r in got))) == sorted(map(repr, want))
    # A passage of two lines between foreign ones goes whole, which chunk limits may cut or exempt; the first place stays.
    two = spark.createDataFrame([(k, f"before {k}\np one\np two\nafter {k}") for k in range(40)], "doc_id long, text string")
    assert {r.doc_id: (r.text, r.removed_chunks) for r in line_dedup.dedup_passages(two).collect()} == {k: (f"before {k}\nafter {k}", 1) if k else (f"before {k}\np one\np two\nafter {k}", 0) for k in range(40)}
    assert line_dedup.dedup_passages(empty).count() == 0


def test_line_chunks_one_by_one(spark):
    """Limits line by line in Python, from hashes alone; text put in front shifts them; the passages don't depend on them."""
    from pyspark.sql import functions as F

    rnd = random.Random(8)
    lines = [[f"{rnd.randrange(60)} line" for _ in range(n)] for n in (0, 1, 2, 3, 40, 90)]
    lines.append(["put", "in", "front", *lines[-1]])
    frame = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.c for r in frame.select("doc_id", line_dedup._line_chunks(F.col("text"), 3, True).alias("c")).collect()}
    known = sorted({v for x in lines for v in x} | {""})
    line_hash = {r.v: r.h for r in spark.createDataFrame([(v,) for v in known], "v string").select("v", F.xxhash64("v").alias("h")).collect()}
    pairs = sorted({(line_hash[a], line_hash[b]) for x in lines for a, b in zip(x, x[1:])})
    hit = {(r.a, r.b): r.h % 3 == 0 for r in spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    for i, x in enumerate(lines):
        x = x or [""]
        h = [line_hash[v] for v in x]
        ends = [k for k in range(2, len(x)) if hit[h[k - 2], h[k - 1]] and not (k > 2 and hit[h[k - 3], h[k - 2]])]
        limits = [0, *ends, len(x)]
        want = [(a, h[a:b], h[b] if b < len(h) else None, "\n".join(x[a:b])) for a, b in zip(limits, limits[1:]) if b - a > 1]
        assert [(c.s, c.h, c.next, c.body) for c in got[i]] == want
    assert {c.body for c in got[5][1:]} <= {c.body for c in got[6]}
    rows = [(i, "\n".join(rnd.choice(lines)[rnd.randrange(3) :] + [f"own {i}"] + rnd.choice(lines))) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: kept for (i, _), (kept, _) in zip(rows, passages_by_brute_force(rows), strict=True)}
    for modulus in (1, 2, 1000):
        assert {r.doc_id: r.text for r in line_dedup.dedup_passages(frame, modulus).collect()} == want


def test_lines_that_share_a_hash(spark, monkeypatch):
    """With a hash of seven values most lines share theirs: pairs and chunks are still told apart by their bytes."""
    from pyspark.sql import functions as F

    rnd = random.Random(17)
    blocks = ["\n".join(f"{rnd.randrange(400)} line" for _ in range(n)) for n in (2, 3, 4, 7)]
    rows = [(i, "\n".join(rnd.choice([*blocks, f"lone {i} {rnd.random()}", "common"]) for _ in range(rnd.randrange(1, 8)))) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(line_dedup, "_hash", lambda x: F.pmod(F.xxhash64(x), F.lit(7)))
    want = {i: kept for (i, _), (kept, _) in zip(rows, passages_by_brute_force(rows), strict=True)}
    assert {r.doc_id: r.text for r in line_dedup.dedup_passages(frame).collect()} == want
    cut = {r.doc_id: r.c for r in frame.select("doc_id", line_dedup.chunks(F.col("text"), 3).alias("c")).collect()}
    seen, want = set(), {}
    for i, _ in rows:
        kept = []
        for x in cut[i]:
            if x.n < 2 or x.body not in seen:
                kept.append(x.body)
            seen.add(x.body)
        want[i] = "\n".join(kept)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(frame).collect()} == want


def test_queries_remove_whole_passages(spark, tmp_path):
    import corpus_pipeline
    from papyra.llm import queries

    rows = [(k, f"before {k}\np one\np two\nafter {k}", "en", "s", 30) for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_line_dedup(spark, str(tmp_path)).collect()
    assert {(r.n_lines, r.removed_lines, r.removed_chunks) for r in got if r.doc_id} == {(4, 2, 1)}
    stage = corpus_pipeline.line_stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    assert {r.text for r in stage if r.doc_id == 7} == {"before 7\nafter 7"}
