"""Column functions over strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import DOC_TYPES, HEADERS, ROW_WORDS

#: Unicode classes, case folding, and line ends as "\n" only.
FLAGS, FLAGS_CI = "(?Ud)", "(?iUud)"


def java_replacement(replacement: str | None) -> str:
    r"""A \1-style replacement for Java: groups become $1, other $ and \ are literal."""
    return re.sub(r"\\(\d)|([$\\])", lambda m: f"${m[1]}" if m[1] else "\\" + m[2], replacement or "")


def let(value: Column, body) -> Column:
    """body of value, evaluated once: what stands in it more than once, or in a lambda, would be worked out as often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, FLAGS + r"^\s+|\s+\z", "")


def collapse_cjk(c: Column) -> Column:
    """Without white space between Chinese characters."""
    return F.regexp_replace(c, FLAGS + r"(?<=[\u4e00-\u9fff])\s+(?=[\u4e00-\u9fff])", "")


def norm_default(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, FLAGS + r"\s+", ""))


def norm_invoice_no(c: Column) -> Column:
    return F.regexp_replace(c, FLAGS + r"\D+", "")


def norm_amount(c: Column) -> Column:
    """Digits and the first dot."""
    kept = F.regexp_replace(c, FLAGS + r"[^\d.]+", "")
    parts = F.split(kept, r"\.", -1)
    return F.when(F.length(kept) - F.length(F.replace(kept, F.lit("."), F.lit(""))) > 1, F.concat(parts[0], F.lit("."), F.array_join(F.slice(parts, 2, F.size(parts)), ""))).otherwise(kept)


def norm_date(c: Column) -> Column:
    """The last four digits: month and day of a padded date."""
    digits = norm_invoice_no(c)
    return F.when(F.length(digits) >= 4, F.right(digits, F.lit(4))).otherwise(digits)


def norm_check_code(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^a-zA-Z0-9]+", ""))


def contains_any(c: Column, words) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | c.contains(word)
    return out


def hits(c: Column, words) -> Column:
    """How many of the words a text holds."""
    return sum((c.contains(w).cast("int") for w in words), F.lit(0))


def first_of(cases: list[tuple[Column, Column]], other: Column) -> Column:
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return other if out is None else out.otherwise(other)


def doc_type(text: Column, families: dict | None = None) -> Column:
    """Family of a text by keywords, the first that fits; UNKNOWN otherwise."""
    low = F.lower(text)
    return first_of([(contains_any(low, words), F.lit(name)) for name, words in (families or DOC_TYPES).items()], F.lit("UNKNOWN"))


def row_class(text: Column, words: dict | None = None) -> Column:
    """header (two words or more), total, subtotal, footer or data."""
    w, low = words or ROW_WORDS, F.lower(text)
    return first_of([(hits(low, w["header"]) >= 2, F.lit("header")), *((contains_any(low, w[k]), F.lit(k)) for k in ("total", "subtotal", "footer"))], F.lit("data"))


def simple_row_class(text: Column) -> Column:
    """As the simple table tells rows: subtotal words come first, so a grand total is a subtotal."""
    low = F.lower(text)
    return first_of([(contains_any(low, ("合计", "小计")), F.lit("subtotal")), (contains_any(low, ("价税合计", "总计")), F.lit("total")), (contains_any(low, ("备注", "开票人")), F.lit("footer"))], F.lit("data"))


def squeezed(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit(" "), F.lit(""))


def header_name(text: Column, headers: dict | None = None) -> Column:
    """The first standard name of which the text holds a spelling; the text itself otherwise."""
    low = squeezed(text)
    return first_of([(contains_any(low, [v.lower().replace(" ", "") for v in variants]), F.lit(name)) for name, variants in (headers or HEADERS).items()], text)


def header_matches(text: Column, headers: dict | None = None) -> Column:
    low = squeezed(text)
    return sum((contains_any(low, [v.lower().replace(" ", "") for v in variants]).cast("int") for variants in (headers or HEADERS).values()), F.lit(0))


def first_match(text: Column, patterns) -> Column:
    """Group 1 of the first pattern that is found, stripped; null if none is. A match with an empty group counts.

    A pattern is searched once: all its matches' groups, of which the first counts, are null if there is no match.
    """
    return F.coalesce(*(strip(F.get(F.regexp_extract_all(text, F.lit(FLAGS_CI + p), F.lit(1)), F.lit(0))) for p in patterns), F.lit(None).cast("string"))


def number(c: Column) -> Column:
    """Two decimals."""
    return F.format_string("%.2f", c)
