"""Remarks and party fields of invoices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import MERGED_REMARK, PARTY_ADDRESS, PARTY_BANK, PARTY_CODES, PARTY_NAMES, RAW_REMARK, REGION_REMARK, TEXT_REMARK
from .text import FLAGS, collapse_cjk, first_of, let, strip

_PUNCTUATION = r"^[;；：:，,。.、\s]+$"


def _found(text: Column, pattern: str, flags: str = FLAGS) -> Column:
    return F.when(text.rlike(flags + pattern), F.regexp_extract(text, flags + pattern, 1))


def _solid(c: Column) -> Column:
    """null where empty or punctuation only."""
    return F.when((c != "") & ~c.rlike(FLAGS + _PUNCTUATION), c)


def _period(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, FLAGS + r"[,，\s]+", "、"), "^、+|、+$", "")


def _labelled(parts: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(value.isNotNull(), F.concat(F.lit(f"{name}："), value)) for name, value in parts.items())))


def _joined(parts: dict[str, Column]) -> Column:
    return F.array_join(_labelled(parts), "; ")


def distinct_parts(parts: Column) -> Column:
    """Parts that differ in more than colons, semicolons and white space from all before them."""

    def first(keyed: Column) -> Column:
        keys = F.transform(keyed, lambda x: x["key"])
        return F.transform(F.filter(keyed, lambda x, k: F.array_position(keys, x["key"]) == k + 1), lambda x: x["part"])

    return let(F.transform(parts, lambda p: F.struct(p.alias("part"), F.regexp_replace(p, FLAGS + r"[：:;\s]", "").alias("key"))), first)


def finished(parts: Column) -> Column:
    """A remark of its distinct parts; null if nothing of more than one character is left."""
    built = F.regexp_replace(F.array_join(distinct_parts(parts), "; "), FLAGS + r"^[;；\s]+|[;；\s]+$", "")
    return let(built, lambda x: F.when(F.length(x) > 1, x))


def _parts(text: Column) -> Column:
    dot_all = "(?s)" + FLAGS
    found = {name: F.coalesce(*(_found(text, p, dot_all if name in ("收款人", "复核人") else FLAGS) for p in patterns)) for name, patterns in TEXT_REMARK.items()}
    cleaned = {"账期": _period, "人工备注": lambda c: let(strip(c), _solid), "收款人": lambda c: let(c, _solid), "复核人": lambda c: let(c, _solid)}

    def labelled(name: str) -> Column:
        value = cleaned[name](found[name]) if name in cleaned else found[name]
        return let(value, lambda v: F.when(v.isNotNull(), F.concat(F.lit(f"{name}："), v)))

    return F.array_compact(F.array(*map(labelled, found)))


def _raw(text: Column) -> Column:
    raw = F.regexp_replace(strip(_found(text, RAW_REMARK, "(?s)" + FLAGS)), FLAGS + r"\s+", " ")
    return let(raw, lambda x: F.when(F.length(x) > 1, x))


def remark_parts(full_text: Column) -> Column:
    """The labelled parts that a whole text names, in order."""
    return let(collapse_cjk(full_text), _parts)


def raw_remark(full_text: Column) -> Column:
    """What follows the remark's label, in one line; null if it has no more than one character."""
    return let(collapse_cjk(full_text), _raw)


def text_remark(full_text: Column) -> Column:
    """The remark of a whole text by its labelled parts, or else what follows the label; null if neither is there."""
    return let(collapse_cjk(full_text), lambda t: F.coalesce(finished(_parts(t)), _raw(t)))


def region_remark(text: Column) -> Column:
    """The remark of a region's text: its labelled parts, or the text without its label's characters."""
    clean = F.regexp_replace(strip(text), FLAGS + r"\s+", " ")
    parts = {name: _found(clean, p) for name, p in REGION_REMARK.items()}
    parts["账期"], parts["人工备注"] = _period(parts["账期"]), _solid(strip(parts["人工备注"]))
    built = _joined(parts)
    bare = F.regexp_replace(F.regexp_replace(clean, FLAGS + r"^[备注\s]+|[备注\s]+$", ""), FLAGS + r"\s+[备注]\s+", " ")
    return F.when(F.length(text) > 0, F.when(built != "", built).otherwise(_solid(bare)))


def _merge_parts(text: Column) -> dict[str, Column]:
    parts = {name: _found(text, p) for name, p in MERGED_REMARK.items()}
    return parts | {"账期": _period(parts["账期"]), "人工备注": strip(parts["人工备注"])}


def merge_remarks(original: Column, vertical: Column) -> Column:
    """Two remarks as one: of each part the longer value (the original of equals), or else the longer text."""
    mine, other = F.coalesce(original, F.lit("")), F.coalesce(vertical, F.lit(""))
    a, b = _merge_parts(mine), _merge_parts(other)
    kept = {}
    for name in MERGED_REMARK:
        x, y = F.nullif(a[name], F.lit("")), F.nullif(b[name], F.lit(""))
        kept[name] = F.when(x.isNull() | (F.length(y) > F.length(x)), y).otherwise(x)
    built = _joined(kept)
    longer = F.when(F.length(mine) >= F.length(other), mine).otherwise(other)
    return first_of([(mine == "", other), (other == "", mine), (built != "", built)], longer)


def party_fields(text: Column) -> Column:
    """struct<name, tax_no, address_phone, bank_account> of a party's text; null where not found."""
    clean = collapse_cjk(text)
    lines = "(?sm)" + FLAGS
    names = []
    for p in PARTY_NAMES:
        name = F.regexp_replace(F.regexp_replace(_found(clean, p, lines), FLAGS + r"\s+", ""), "[：:，,。.]+$", "")
        names.append(F.when(F.length(name) >= 2, name))
    codes = []
    for p in PARTY_CODES:
        code = F.upper(_found(clean, p))
        codes.append(F.when(~code.rlike(r"^1[3-9]\d{9}$"), code))
    spaced = lambda c: F.regexp_replace(strip(c), FLAGS + r"\s+", " ")
    address = spaced(_found(clean, PARTY_ADDRESS, "(?s)" + FLAGS))
    bank = spaced(_found(clean, PARTY_BANK, "(?s)" + FLAGS))
    return F.struct(F.coalesce(*names).alias("name"), F.coalesce(*codes).alias("tax_no"), address.alias("address_phone"), bank.alias("bank_account"))
