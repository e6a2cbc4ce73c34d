"""The embedding join and connected components against brute force; the pipeline stage by stage."""

import math
import random

import numpy as np
import pytest

from papyra.llm import embedding_join
from papyra.llm.common import components

from .test_texts import classes, corpus, jaccard_classes


def vectors(seed=1, n=150, width=8):
    rng = np.random.default_rng(seed)
    out = [None, [], [0.0] * width, [float("nan")] + [1.0] * (width - 1), [float("inf")] * width, [1.0, None] + [1.0] * (width - 2), [1.0, 2.0]]
    for _ in range(n):
        v = rng.normal(size=width)
        out.append((v * rng.uniform(0.1, 9)).tolist())
        for _ in range(rng.integers(0, 3)):
            out.append((v + rng.normal(size=width) * 0.12).tolist())
        if rng.random() < 0.2:
            out.append(list(out[-1]))
    out.append([-0.0 if k else 1e200 for k in range(width)])
    return [(i, v) for i, v in enumerate(out)]


@pytest.mark.parametrize("block", [4096, 16])
def test_range_join(spark, block):
    rows = vectors()
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, kept string, copies int")
    good = {i: np.array(v) / max(map(abs, v)) for i, v in rows if v and None not in v and all(map(math.isfinite, v)) and any(v)}
    linked = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and float(good[a] @ good[b] / math.sqrt((good[a] @ good[a]) * (good[b] @ good[b]))) >= 0.9]
    label = classes([i for i, _ in rows], linked)
    links = {i: sum(i in p for p in linked) for i, _ in rows}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_join.range_join(frame, block=block, pivots=5).collect()}
    assert len(linked) > 50
    assert got == {i: (links[i], label[i], label[i] == i) for i, _ in rows}


def test_pivots_follow_the_input():
    assert [embedding_join.pivot_count(n) for n in (0, 10_000, 4096 * 50, 10**9)] == [16, 16, 50, 1024]
    # With a pivot in each cluster a vector goes to hardly any cell but its own; with fewer, to many of those there are.
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(200, 32)) * 4
    x = np.concatenate([c + rng.normal(size=(20, 32)) * 0.1 for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean = {}
    for n in (16, 64, 200):
        _, reach = embedding_join.Cells(embedding_join._farthest(x, n), 0.9).home(x)
        assert reach.sum(1).min() == 1
        mean[n] = reach.sum(1).mean()
    assert mean[200] < 2 < mean[16] < mean[64], mean


def test_range_join_empty(spark):
    assert embedding_join.range_join(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(50)] + [(k, k + 1) for k in range(100, 160)] + [(200, k) for k in range(201, 240)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {i: m for i, m in classes(nodes, [e for e in edges if e[0] != e[1]]).items()}
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    rows = corpus(seed=8, n=25)
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, copies int, n int"
    spark.createDataFrame(rows, schema).drop("size", "copies", "n").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "line_dedup", "shingle_join", "mixing", "sentencepiece"]
    assert stages["quality_classifier"](spark, docs, str(tmp_path)).count() == len(rows)
    assert stages["line_dedup"](spark, docs, str(tmp_path)).columns == docs.columns
    _, label, _ = jaccard_classes(rows)
    kept = sorted(r.doc_id for r in stages["shingle_join"](spark, docs, str(tmp_path)).collect())
    assert kept == sorted(i for i in label if label[i] == i)
    from papyra.llm.mixing import mix

    want = sorted(r.doc_id for r in mix(docs).collect() for _ in range(r.copies))
    assert sorted(r.doc_id for r in stages["mixing"](spark, docs, str(tmp_path)).collect()) == want
    assert pipeline.run(spark, str(tmp_path)).count() > 0


def passages_left(rows):
    from .test_texts import passages_by_brute_force

    return [kept for kept, _ in passages_by_brute_force(rows)]


def test_pipeline_equals_brute_force(spark, tmp_path):
    """The whole run against plain Python, stage by stage: rejected rows, extra columns, nulls, equal rows."""
    import hashlib
    from collections import Counter

    import corpus_pipeline as pipeline
    import public_tokenizers
    import sentencepiece

    from papyra.llm import mixing, quality

    rnd = random.Random(14)
    rows = corpus(seed=9, n=20)
    good = [(5000 + k, "\n".join(" ".join(f"word{rnd.randrange(300)}" for _ in range(9)) + "." for _ in range(rnd.randrange(2, 9))), "en", rnd.choice("ab"), 0) for k in range(90)]
    bad = [(6000 + k, "!! ".join(f"BUY{rnd.randrange(9)}" for _ in range(rnd.randrange(20, 60))), "en", "a", 0) for k in range(90)]
    shared = "\n".join(f"a common line number {k} of this notice." for k in range(3))
    good[:12] = [(i, f"{t}\n{shared}" if i % 2 else f"{shared}\n{t}", *rest) for i, t, *rest in good[:12]]
    good.append((None, good[20][1] + " tail", "en", None, 0))
    good.append(good[30])
    table = [(*r[:5], "x", 7) for r in [*rows, *good, *bad]]
    frame = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, score string, copies int")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], int(r[0] < 6000), 0) for r in [*good, *bad] if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pipeline.run(spark, str(tmp_path)).collect()]

    # 8: what the trees, walked one by one, score under a half goes.
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    from .test_texts import naive_features

    now = [r for r in table if model.score(np.array([naive_features(r[1])]))[0] >= 0.5]
    assert 80 < len(now) < len(table) - 60
    # 10: repeated passages go.
    kept = passages_left([(r[0], r[1]) for r in now])
    now = [(r[0], t, r[2], r[3]) for r, t in zip(now, kept, strict=True)]
    assert sum(a[1] != b[1] for a, b in zip(now, [r for r in table if model.score(np.array([naive_features(r[1])]))[0] >= 0.5], strict=True)) > 5
    # 1: one document of each class, the first by id (null last); equal rows once; without words all stay.
    from .test_texts import shingles

    sets = [shingles(r[1]) for r in now]
    linked = [(a, b) for a in range(len(now)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = classes(range(len(now)), linked)
    groups = {}
    for k, r in enumerate(now):
        groups.setdefault(label[k] if sets[k] else ("empty", repr(r)), []).append(r)
    first = lambda r: (r[0] is None, r[0] or 0)
    now = [min(g, key=first) for g in groups.values()]
    assert len(now) < len(label)
    # 9: sources' taken words come near their targets; copies as the operator gives them on this stage's input.
    stage = spark.createDataFrame([(r[0], r[1], r[3]) for r in now], "doc_id long, text string, source string")
    copies = {(r.doc_id, r.size): r.copies for r in mixing.mix(stage).collect()}
    size = lambda t: len([w for w in __import__("re").split("[\x20\x09-\x0d]+", t or "") if w])
    assert all(0 <= c <= 2 for c in copies.values())
    now = [r for r in now for _ in range(copies[r[0], size(r[1])])]
    # 6: ids and text of the library.
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = [library.encode(r[1] or "") for r in now]
    assert Counter(got) == Counter((r[0], len(x), sha(",".join(map(str, x))), sha(library.decode(x))) for r, x in zip(now, ids, strict=True))


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
