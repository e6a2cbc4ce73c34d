"""Template search against plain Python."""

import random

import pytest

from papyra.operators.layout import match_templates
from papyra.operators.templates import Keys, matched


@pytest.mark.parametrize(("most", "task"), [(8 << 20, 256 << 20), (700, 200)])
def test_first_template_in_order(spark, most, task):
    """Overlapping, repeated and null keys and texts; a catalogue in every task, or cut into shards over several tasks."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abÄ") for _ in range(n))
    keys = [(word(rng.randint(2, 6)), k) for k in rng.sample(range(1000), 60)] + [(None, 0)]
    texts = [(k, rng.choice([None, "", word(rng.randint(0, 25))])) for k in range(200)]
    docs = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, full_text string, ordinal int")
    templates = spark.createDataFrame(keys, "supplier_key string, ordinal int")
    want = {d: min((o, k) for k, o in keys if k and k in t) for d, t in texts if t and any(k and k in t for k, _ in keys)}
    hits = {}
    for r in matched(docs, templates, most, task).collect():
        hits[r.doc_id] = min(hits.get(r.doc_id, (9999, "")), (r.hit.ordinal, r.hit.supplier_key))
    assert hits == want and len(want) > 50
    if most > 1 << 20:
        assert {r.doc_id: (r.ordinal, r.supplier_key) for r in match_templates(docs, templates).collect()} == want
        plan = match_templates(docs, templates)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_key_and_no_keys(spark):
    assert Keys([("", 5), ("ab", 3)]).first("xaby") == (3, "ab") and Keys([("", 5), ("ab", 9)]).first("ab") == (5, "")
    assert Keys([]).first("x") is None and Keys([("a", 1)]).first(None) is None
    docs = spark.createDataFrame([(1, "x")], "doc_id long, full_text string")
    assert match_templates(docs, spark.createDataFrame([], "supplier_key string, ordinal int")).count() == 0


def test_a_text_meets_few_of_many_keys(spark):
    """Keys of a large catalogue meet texts by pieces; each text once went to every shard of them."""
    from papyra.operators import anchors

    keys = spark.range(3000).selectExpr("concat('Customer', lpad(cast(id as string), 9, '0')) as key", "id as ordinal")
    texts = spark.range(500).selectExpr("id as doc_id", "concat('von Ä Customer', lpad(cast(id * 7 as string), 9, '0'), ' an') as text")
    met = anchors.met(texts, keys)
    assert {(r.doc_id, r.ordinal) for r in met.collect()} == {(k, k * 7) for k in range(500) if k * 7 < 3000}
    ready = anchors.anchored(keys)
    # Last pieces tell keys apart that begin alike, and few places of a text pass.
    assert ready.select("anchor").distinct().count() == 3000
    found = anchors.filtered(ready)
    rows, _ = found.places(texts.toArrow().column("text").combine_chunks())
    assert 429 <= len(rows) < 600
