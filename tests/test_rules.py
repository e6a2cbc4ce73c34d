"""Rules as expressions and in tasks against plain Python."""

import random
import re

import pytest

from papyra.operators.rule_tasks import RuleSet, apply_table, folded, required_text
from papyra.operators.rules import MOST_RULES, RULE_SCHEMA, apply_rules

NAMES = [f.split()[0] for f in RULE_SCHEMA.split(", ")]


def plain(value, rules, kind, name):
    log = []
    for r in sorted(rules, key=lambda r: r["priority"]):
        if not value or not r["is_enabled"] or r["doc_type"] not in (kind, "ALL") or r["field_name"] not in (None, name):
            continue
        try:
            if r["rule_type"] in ("regex", "normalize"):
                new = re.sub(r["pattern"], r["replacement"] or "", value)
            elif r["rule_type"] == "dict":
                new = value.replace(r["pattern"], r["replacement"] or "")
            elif r["rule_type"] == "fuzzy":
                new = re.sub(re.escape(r["pattern"]), r["replacement"] or "", value, flags=re.IGNORECASE)
            else:
                continue
        except (re.error, IndexError):
            continue
        if new != value:
            log.append((r["id"], value, new))
            value = new
    return value, log


def catalogue(n, seed=1):
    rng = random.Random(seed)
    patterns = {"regex": [r"(\d)[oO](\d)", "a+b", "(ab|ba)c", "^x", "b$", r"(?i)ABC", "(", "aab", r"c\s*a", "[ab]c", "ca{2}b"], "normalize": [r"\s+", "bb"], "dict": ["ab", "bc", "caa", "x", ""], "fuzzy": ["AB", "cB", "é", "a.b"], "template": ["a"], "validate": ["b"]}
    for k in range(n):
        kind = rng.choice(list(patterns))
        yield dict(id=f"r{k}", rule_type=kind, pattern=rng.choice(patterns[kind]), replacement=rng.choice([None, "", "z", "ba", r"\1" if kind == "regex" else "q", "$0"]), doc_type=rng.choice(["ALL", "A", "B"]), field_name=rng.choice([None, None, "f", "g"]), priority=rng.choice([1, 2, 3]), is_enabled=rng.random() < 0.9, ordinal=k)


@pytest.mark.parametrize("tasks", [200_000, 3])
def test_rules_in_tasks(spark, tasks):
    """Scopes dealt to one task or several, against one value after the other; null and empty values and rules that don't work."""
    from pyspark.sql import functions as F

    rng = random.Random(2)
    rules = list(catalogue(40))
    values = [(k, rng.choice(["A", "B", "C", None]), rng.choice(["f", "g", None]), rng.choice([None, "", *("".join(rng.choice("abcxÉ 1o") for _ in range(9)) for _ in range(9))]), {"k": k}) for k in range(300)]
    frame = spark.createDataFrame(values, "doc_id long, doc_type string, field_name string, value string, applied map<string,int>").withColumnRenamed("applied", "more")
    table = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rules], RULE_SCHEMA)
    got = {r.doc_id: (r.value, [tuple(e) for e in r.applied], r.more["k"]) for r in apply_table(frame, table, F.col("doc_type"), tasks).collect()}
    assert got == {k: (*plain(v, rules, t, f), k) for k, t, f, v, _ in values}
    assert sum(len(x[1]) for x in got.values()) > 100


def test_expression_and_tasks_agree(spark):
    """Whether rules are a short list, a long one or a table, with a column field_name or without."""
    rules = [r for r in catalogue(60, 3) if r["pattern"] != "(?i)ABC"]
    rng = random.Random(4)
    rows = [(k, rng.choice(["A", "B"]), "".join(rng.choice("abcx 1o") for _ in range(8))) for k in range(200)]
    values = spark.createDataFrame(rows, "doc_id long, doc_type string, value string")
    more = [dict(rules[0], id=f"m{k}", doc_type="Z", ordinal=1000 + k) for k in range(MOST_RULES)]
    told = lambda df: sorted((r.doc_id, r.value, [tuple(e) for e in r.applied]) for r in df.collect())
    want = sorted((k, *plain(v, rules, t, None)) for k, t, v in rows)
    table = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rules], RULE_SCHEMA)
    assert told(apply_rules(values, rules[:20])) == sorted((k, *plain(v, rules[:20], t, None)) for k, t, v in rows)
    assert told(apply_rules(values, table)) == told(apply_rules(values, rules + more)) == want


def test_required_text():
    assert [required_text(p) for p in ("abc", "a+bcd?", "(ab|cd)", r"\d+", "(?i)abc", "ab.cde", "(", "^abc$")] == ["abc", "bc", None, None, None, "cde", None, "abc"]
    assert folded("ıİSſK") == "iissk"
    rng = random.Random(5)
    for _ in range(300):
        pattern = "".join(rng.choice(["a", "b", "c", "a?", "b+", "[ab]", ".", "(a|b)", r"\w", "(?:bc)", "^", "c{2}"]) for _ in range(5))
        text = required_text(pattern)
        value = "".join(rng.choice("abc") for _ in range(12))
        assert not text or not re.search(pattern, value) or text in value


def test_many_rules_are_one_search():
    """Ten thousand rules: a value meets only those whose text it holds, also after a change."""
    rules = [dict(rule_id=f"r{k}", rule_type="dict", pattern=f"<{k}>", replacement=f"<{k + 1}>" if k % 10 else "end") for k in range(1, 10_001)]
    ready = RuleSet(rules)
    value, log = ready.apply("see <15>")
    assert value == "see end" and [e["rule_id"] for e in log] == [f"r{k}" for k in range(15, 21)]
    assert len(ready._sought("see <15>", -1)) == 1


@pytest.mark.parametrize("empty", [False, True])
def test_rules_by_rounds(spark, empty):
    """A catalogue that no task holds meets its values by joins: the same values and logs, with rules that every value tries or without."""
    from pyspark.sql import functions as F

    rng = random.Random(6)
    rules = [r for r in catalogue(25, 7) if empty or r["pattern"] not in ("", r"(\d)[oO](\d)", "[ab]c", r"\s+", "(ab|ba)c", "(?i)ABC")]
    rules += [dict(rules[0], id=f"c{k}", rule_type="dict", pattern=f"<{k}>", replacement=f"<{k + 1}>", doc_type="ALL", field_name=None, is_enabled=True, priority=4, ordinal=100 + k) for k in range(3)]
    rules += [dict(rules[-1], id="gone", pattern="xyz", replacement="", ordinal=200), dict(rules[-1], id="behind", rule_type="regex", pattern="q*", replacement="after", ordinal=201)][: 1 + empty]
    texts = [None, "", "xyz", "see <0>", *("".join(rng.choice("abcxÉ 1o") for _ in range(9)) for _ in range(30))]
    values = [(k, rng.choice(["A", "B", "C", None]), rng.choice(["f", "g", None]), texts[k % len(texts)], {"k": k}) for k in range(120)]
    frame = spark.createDataFrame(values, "doc_id long, doc_type string, field_name string, value string, more map<string,int>")
    table = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rules], RULE_SCHEMA)
    frames = [apply_table(frame, table, F.col("doc_type"), 30, held) for held in (0, 1 << 20)]
    rounds, held = ({r.doc_id: (r.value, [tuple(e) for e in r.applied], r.more["k"]) for r in f.collect()} for f in frames)
    want = {k: (*plain(v, rules, t, f), k) for k, t, f, v, _ in values}
    assert rounds == want and held == want
    assert max(len(x[1]) for x in want.values()) > 2 and any(x[0] == "" and x[1] for x in want.values())
