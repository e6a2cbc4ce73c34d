"""Evidence matching and similarity against plain Python that follows the rules one field at a time."""

import difflib
import random
import re

import numpy as np
import pytest

from papyra.functions import similarity
from papyra.operators import evidence


# ---------------------------------------------------------------- similarity
def strings(seed=1):
    rng = random.Random(seed)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    for _ in range(1500):
        letters = rng.choice(["ab", "abc", "abcdefghij0123456789", "é€汉字𝄞ab"])
        x = list(word(rng.randint(0, 30), letters))
        y = x[:]
        for _ in range(rng.randint(0, 6)):
            if y:
                y[rng.randrange(len(y))] = rng.choice(letters)
        yield "".join(x), "".join(y) if rng.random() < 0.6 else word(rng.randint(0, 30), letters)
    for _ in range(40):
        letters = rng.choice(["ab", "abcdefghij 0123456789", "é€汉字ab xyzuv"])
        x = word(rng.randint(150, 450), letters)
        yield x, x[: rng.randint(0, 100)] + word(rng.randint(60, 250), letters) + x[100 : rng.randint(100, 400)]
    yield from [("", ""), ("", "a"), ("a", ""), ("x" * 300, "x" * 250), ("\ud800a", "\ud800a")]


@pytest.mark.parametrize("cells", [1 << 20, 64])
def test_ratios_equal_the_usual_definition(monkeypatch, cells):
    """Frequent characters of long right texts included, whatever is batched together."""
    monkeypatch.setattr(similarity, "CELLS", cells)
    a, b = zip(*strings(), strict=True)
    want = [difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)]
    assert similarity.ratios(list(a), list(b)).tolist() == want
    least = similarity.ratios(list(a), list(b), 0.85)
    assert [None if np.isnan(r) else r for r in least] == [w if w >= 0.85 else None for w in want]
    assert (similarity.matched(list(a), list(b)) <= similarity.common_characters(list(a), list(b))).all()


def test_ratio_of_columns(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([("abcd", "bcde"), (None, "x"), ("x", None), ("ab", "xy")], "a string, b string")
    assert [r.r for r in frame.select(similarity.ratio(F.col("a"), F.col("b"), 0.5).alias("r")).collect()] == [0.75, None, None, None]


# ---------------------------------------------------------------- evidence
def solid(text):
    return re.sub(r"\s+", "", text or "").lower()


def amount(text):
    first, dot, rest = re.sub(r"[^\d.]", "", text or "").partition(".")
    return first + dot + rest.replace(".", "")


def own(key, text):
    digits = re.sub(r"\D", "", text or "")
    if key == "invoiceNo":
        return digits
    if key in ("totalAmount", "taxAmount", "amount"):
        return amount(text)
    if key == "invoiceDate":
        return digits[-4:]
    return re.sub(r"[^a-zA-Z0-9]", "", text or "").lower() if key == "checkCode" else solid(text)


def rect(points):
    return [int(min(p[0] for p in points)), int(min(p[1] for p in points)), int(max(p[0] for p in points)), int(max(p[1] for p in points))] if points else [0, 0, 0, 0]


def corners(box):
    return rect(box) if len(box) >= 4 else [0, 0, 0, 0]


def middle(box, k):
    return sum(p[k] for p in box) / len(box) if box else 0


def place(key, value, page):
    """(type, first block, text, box, confidence) of a field on a page: a list of (text, polygon)."""
    v = own(key, value)
    single = lambda kind, k, c: (kind, k, page[k][0], corners(page[k][1]), c)
    if key == "totalAmount" and (same := [k for k, (t, _) in enumerate(page) if amount(t) == v]):
        words = [middle(b, 1) for t, b in page if any(w in (t or "").lower() for w in ("合计", "小写"))]
        gaps = [(abs(middle(page[k][1], 1) - w), k) for k in same for w in words]
        if len(same) == 1:
            return single("context", same[0], 0.9)
        if gaps and min(gaps)[0] < 50:
            return single("context", min(gaps)[1], 0.95)
        return single("context", max(same, key=lambda k: (middle(page[k][1], 1), -k)), 0.8)
    for k, (t, _) in enumerate(page):
        if solid(t) == v:
            return single("exact", k, 1.0)
    if len(v) >= (2 if key in ("buyerName", "sellerName") else 4):
        for k, (t, _) in enumerate(page):
            if v in solid(t) or key in ("invoiceDate", "checkCode") and own(key, t) == v:
                return single("contains", k, 0.9)
    likes = [(difflib.SequenceMatcher(None, v, solid(t)).ratio(), -k) for k, (t, _) in enumerate(page) if 0.5 <= len(v) / max(len(solid(t)), 1) <= 2]
    if likes and max(likes)[0] >= 0.85:
        return single("fuzzy", -max(likes)[1], max(likes)[0])
    order = sorted(range(len(page)), key=lambda k: (middle(page[k][1], 1), middle(page[k][1], 0), k))
    for i in range(len(order)):
        for j in range(i + 1, min(i + 4, len(order))):
            some = [page[k] for k in order[i : j + 1]]
            for (_, p), (_, q) in zip(some, some[1:], strict=False):
                line = abs(middle(p, 1) - middle(q, 1)) < 30
                if abs(corners(q)[0] - corners(p)[2]) > 50 if line else abs(corners(q)[1] - corners(p)[3]) > 50:
                    break
            else:
                text = "".join(t or "" for t, _ in some)
                if solid(text) == v:
                    return "adjacent", order[i], text, rect([x for _, b in some for x in b]), 0.85
    return None


def pages(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcAB 1") for _ in range(n))
    for d in range(50):
        page = []
        for _ in range(rng.randint(0, 9)):
            x, y = rng.choice([0.0, 40.5, 60.0, 110.0, 500.7]), rng.choice([0.0, 3.25, 40.0, 80.0, 200.9])
            w, h = rng.choice([30.0, 48.0, 300.0]), rng.choice([20.0, 24.4])
            box = [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]
            box = rng.choice([box, box, box, box[:2], [], [*box, [x + 5, y + h + 9]]])
            total = rng.choice(["12.50", "¥12.5.0 合计", "合计", "小写 7"])
            page.append((rng.choice([word(rng.randint(1, 9)), word(rng.randint(1, 9)), total, "No: 12-34-56", "2025年12月23日", None, " "]), box))
        texts = [t or "" for t, _ in page] or ["z"]
        k = rng.randrange(len(texts))
        fields = {
            "totalAmount": rng.choice(["12.50", "9", "n/a"]), "invoiceDate": "2025-12-23", "checkCode": rng.choice(["123456", "no123456"]), "invoiceNo": rng.choice(["5", texts[k] + "1"]),
            "buyerName": texts[k][1:3] or "q", "whole": texts[k].upper(), "part": texts[k][1:], "near": texts[k][:-1] + "x", "run": "".join(texts[k : k + rng.randint(2, 4)]), "none": "zzzzzzz", "blank": rng.choice([" ", "\t\n", ""]),
        }
        yield d, page, fields


def frames(spark, told):
    fields = [(d, k, v) for d, _, f in told for k, v in f.items()]
    blocks = [(d, k, t, b) for d, page, _ in told for k, (t, b) in enumerate(page)]
    return spark.createDataFrame([*fields, (0, "null", None)], "doc_id long, field_key string, field_value string"), spark.createDataFrame(blocks, "doc_id long, ordinal long, text string, bbox array<array<double>>")


@pytest.mark.parametrize("seed", [1, 2])
def test_cascade_equals_brute_force(spark, seed):
    told = list(pages(seed))
    want = {(d, k): place(k, v, page) for d, page, f in told for k, v in f.items() if v.strip()}
    got = evidence.cascade(*frames(spark, told)).collect()
    assert {(r.doc_id, r.field_key): (r.match_type, r.ordinal, r.snippet, r.bbox, r.confidence) for r in got} == {k: v for k, v in want.items() if v}
    assert len(got) == sum(v is not None for v in want.values()) and {r.match_type for r in got} == set(evidence.STRATEGIES)


def test_probes(spark):
    """Gaps have no sign, merged texts no space, check codes are equal, merged boxes are of all blocks."""
    box = lambda x, y: [[x, y], [x + 100.0, y], [x + 100.0, y + 20.0], [x, y + 20.0]]
    told = [
        (1, [("ABCD", box(500.0, 0.0)), ("EFGH", box(0.0, 5.0))], {"f": "abcdefgh"}),
        (2, [("AB CD", box(0.0, 0.0)), ("EFGH", box(120.0, 5.0))], {"f": "abcdefgh"}),
        (3, [("No: 12-34-56", box(0.0, 0.0))], {"checkCode": "123456"}),
        (4, [("12-34-56", box(0.0, 0.0))], {"checkCode": "123456"}),
    ]
    got = {r.doc_id: r for r in evidence.cascade(*frames(spark, told)).collect()}
    assert set(got) == {2, 4} and got[4].match_type == "contains"
    assert (got[2].match_type, got[2].snippet, got[2].bbox) == ("adjacent", "AB CDEFGH", [0, 0, 220, 25])


def test_three_exchanges(spark):
    told = list(pages(3))
    plan = evidence.cascade(*frames(spark, told))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3


def test_blocks_are_read_in_one_order(spark):
    """Words before and behind a block come from one order of the page, and what a pair of field and block is asked stays small enough to be compiled."""
    from papyra.plans import queries

    plan = queries.QUERIES["evidence_cells"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "DESC NULLS LAST" not in plan and len(re.findall(r"Sort \[doc_id#\d+L ASC NULLS FIRST, page#\d+ ASC NULLS FIRST, cy#", plan)) == 1
    join = next(line for line in plan.splitlines() if "SortMergeJoin [doc_id#" in line or "BroadcastHashJoin [doc_id#" in line)
    assert "regexp_replace" not in join and "lambdafunction" not in join


def test_located_polygons(spark):
    """Four whole points need no arrays; points without two coordinates don't count, a coordinate that is null has no part in the ends."""
    some = [[[0.0, 1.0], [4.0, 1.0], [4.0, 3.0], [0.0, 3.5]], [[0.0, 1.0], [4.0, 1.0], [4.0, 3.0], [0.0, 3.5], [9.0, -2.0]], [[1.0], [2.0, 2.0], [3.0, 3.0], [4.0, 4.0]], [None, [2.0, 2.0], [3.0, 3.0], [4.0, 4.0]], [[None, 1.0], [2.0, 2.0], [3.0, 3.0], [4.0, 4.0]], [[1.0, 2.0]] * 3, [], None]
    got = evidence._located(spark.createDataFrame(list(enumerate(some)), "k int, bbox array<array<double>>")).orderBy("k").select("ends.*", "cx", "cy", "rect")
    assert [tuple(r) for r in got.collect()] == [
        (0.0, 1.0, 4.0, 3.5, 2.0, 2.125, [0, 1, 4, 3]), (0.0, -2.0, 9.0, 3.5, 3.4, 1.3, [0, -2, 9, 3]), (2.0, 2.0, 4.0, 4.0, 3.0, 3.0, [2, 2, 4, 4]), (2.0, 2.0, 4.0, 4.0, 3.0, 3.0, [2, 2, 4, 4]),
        (2.0, 1.0, 4.0, 4.0, 0.0, 2.5, [2, 1, 4, 4]), (1.0, 2.0, 1.0, 2.0, 1.0, 2.0, [0, 0, 0, 0]), (None, None, None, None, 0.0, 0.0, [0, 0, 0, 0]), (None, None, None, None, 0.0, 0.0, [0, 0, 0, 0]),
    ]


def test_runs_of_letters_that_depend_on_their_place(spark):
    """A sigma at the end of a block is not the last of the run's text."""
    blocks = spark.createDataFrame([(1, 0, "ΑΣ", 0.0), (1, 1, "Α", 100.0), (1, 2, "Β", 200.0)], "doc_id long, ordinal long, text string, x_min double")
    blocks = blocks.selectExpr("*", "x_min + 90 as x_max", "0d as y_min", "20d as y_max", "x_min + 45 as x_center", "10d as y_center")
    fields = spark.createDataFrame([(1, "a", "ΑΣΑ"), (1, "b", "ασ αβ"), (1, "c", "αα"), (1, "d", "αβ")], "doc_id long, field_key string, field_value string")
    got = evidence.adjacent(fields, blocks).orderBy("field_key").collect()
    assert [(r.field_key, r.ordinal, r.snippet, r.bbox) for r in got] == [("a", 0, "ΑΣΑ", [0, 0, 190, 20]), ("b", 0, "ΑΣΑΒ", [0, 0, 290, 20]), ("d", 1, "ΑΒ", [100, 0, 290, 20])]
