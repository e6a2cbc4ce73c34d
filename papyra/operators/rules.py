"""Correction rules: scope, order, application with an audit log, review."""

from __future__ import annotations

import re

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import BUILTIN_RULES, FIELD_PATTERNS
from ..functions.remark import text_remark
from ..functions.text import FLAGS, doc_type, first_match, first_of, java_replacement
from .rule_tasks import apply_table

RULE_SCHEMA = "id string, rule_type string, pattern string, replacement string, doc_type string, field_name string, priority int, is_enabled boolean, ordinal int"
#: Rules that become one expression at most; more are dealt to tasks.
MOST_RULES = 1000


def builtin_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, True, k) for k, r in enumerate(BUILTIN_RULES)], RULE_SCHEMA)


def union_rules(*sources: DataFrame) -> DataFrame:
    """All rules of all sources, duplicates kept."""
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other)
    return out


def remove(rules: DataFrame, rule_id: str) -> DataFrame:
    """All rules but those of the id."""
    return rules.where(~F.col("id").eqNullSafe(F.lit(rule_id)))


def applicable(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules of each value: enabled, of its type or ALL, of its field or of every field; turn is their order, from 0.

    A value looks for its own type and for ALL, so this is an equi-join whatever the number of rules.
    """
    r = rules.where("is_enabled").select(F.col("id").alias("rule_id"), "rule_type", "priority", "ordinal", F.col("doc_type").alias("_type"), F.col("field_name").alias("_field"))
    sought = values.withColumn("_type", F.explode(F.array_distinct(F.array("doc_type", F.lit("ALL")))))
    met = sought.join(r, "_type").where(F.col("_field").isNull() | (F.col("_field") == F.col("field_name"))).drop("_type", "_field")
    own = [c for c in values.columns]
    turn = F.row_number().over(Window.partitionBy(*own).orderBy("priority", "ordinal")) - 1
    return met.select(*own, "rule_id", "rule_type", "priority", "ordinal", turn.alias("turn"))


def works(spark: SparkSession, rule: dict) -> bool:
    """Whether a rule's pattern compiles and its replacement names only groups that the pattern has."""
    if rule["rule_type"] not in ("regex", "normalize"):
        return True
    try:
        pattern = spark.sparkContext._jvm.java.util.regex.Pattern.compile(FLAGS + rule["pattern"])
    except (Py4JError, PySparkException):
        return False
    return max((int(g) for g in re.findall(r"\\(\d)", rule["replacement"] or "")), default=0) <= pattern.matcher("").groupCount()


def apply_rule(value: Column, rule_type: str, pattern: str, replacement: str | None) -> Column:
    """One rule: regex and normalize replace matches, dict a literal, fuzzy a literal in any case; others change nothing."""
    if rule_type in ("regex", "normalize"):
        return F.regexp_replace(value, FLAGS + pattern, java_replacement(replacement))
    if rule_type == "dict":
        # An empty text stands between all characters.
        literal = java_replacement((replacement or "").replace("\\", "\\\\"))
        return F.replace(value, F.lit(pattern), F.lit(replacement or "")) if pattern else F.regexp_replace(value, "", literal)
    if rule_type == "fuzzy":
        return F.regexp_replace(value, "(?iu)\\Q" + pattern + "\\E", java_replacement((replacement or "").replace("\\", "\\\\")))
    return value


def _step(rule: dict, fits: Column):
    """One rule's turn on struct<v, log>."""

    def turn(s: Column) -> Column:
        new = apply_rule(s["v"], rule["rule_type"], rule["pattern"], rule["replacement"])
        entry = F.struct(F.lit(rule["id"]).alias("rule_id"), s["v"].alias("before"), new.alias("after"))
        changed = fits & (s["v"] != "") & (new != s["v"])
        return F.struct(F.when(changed, new).otherwise(s["v"]).alias("v"), F.when(changed, F.concat(s["log"], F.array(entry))).otherwise(s["log"]).alias("log"))

    return turn


def apply_rules(values: DataFrame, rules: list | DataFrame, types: Column | None = None) -> DataFrame:
    """values with `value` corrected and `applied` array<struct<rule_id, before, after>>, an entry for each change.

    A rule that doesn't work changes nothing. A list of up to MOST_RULES rules becomes one expression: no join, no
    shuffle. A longer list, or a table of rules of any size, is dealt to tasks by scope; see rule_tasks. Both give the same
    values, and neither needs field_name: without it only rules of every field hold.
    """
    kind = F.col("doc_type") if types is None else types
    if isinstance(rules, DataFrame):
        return apply_table(values, rules, kind)
    if len(rules) > MOST_RULES:
        names = [f.split()[0] for f in RULE_SCHEMA.split(", ")]
        return apply_table(values, values.sparkSession.createDataFrame([tuple(r[n] for n in names) for r in rules], RULE_SCHEMA), kind)
    named = F.col("field_name") if "field_name" in values.columns else F.lit(None).cast("string")
    sound = [r for r in rules if r["is_enabled"] and works(values.sparkSession, r)]
    state = F.struct(F.col("value").alias("v"), F.array().cast(_LOG).alias("log"))
    for r in sorted(sound, key=lambda r: (r["priority"], r["ordinal"])):
        fits = F.lit(True)
        if r["doc_type"] != "ALL":
            fits = fits & (kind == r["doc_type"])
        if r["field_name"] is not None:
            fits = fits & (named == r["field_name"])
        state = F.get(F.transform(F.array(state), _step(r, fits)), F.lit(0))
    return values.withColumn("_rules", state).withColumn("value", F.col("_rules.v")).withColumn("applied", F.col("_rules.log")).drop("_rules")


_LOG = "array<struct<rule_id:string,before:string,after:string>>"


def extract_fields(docs: DataFrame, patterns: dict | None = None, remark: bool = True) -> DataFrame:
    """doc_id, doc_type, field_name, value of each field found; a document without fields has no row.

    All of a document's fields come from one pass over its text: a map of the patterns of its type.
    """
    catalogue = patterns or FIELD_PATTERNS
    kind = F.col("doc_type") if "doc_type" in docs.columns else doc_type(F.col("full_text"))
    typed = docs.select("doc_id", "full_text", kind.alias("doc_type"))

    def pairs(name: str) -> Column:
        found = [F.struct(F.lit(f).alias("field_name"), first_match(F.col("full_text"), p).alias("value")) for f, p in catalogue[name].items()]
        if remark and name == "INVOICE":
            found.append(F.struct(F.lit("remark").alias("field_name"), text_remark(F.col("full_text")).alias("value")))
        return F.array(*found)

    empty = F.array().cast("array<struct<field_name:string,value:string>>")
    fields = first_of([(F.col("doc_type") == name, pairs(name)) for name in catalogue], empty)
    return typed.select("doc_id", "doc_type", F.inline(fields)).where("value <> ''")


def value_confidence(fields: DataFrame, blocks: DataFrame, overall: bool = False) -> DataFrame:
    """fields with `confidence`: of the first block that holds the value, else of the first that shares a word, else 0.7.

    A document without blocks has 0. overall: also overall_confidence, the mean of all blocks of the document.
    """
    low = F.lower(F.col("value"))
    words = lambda c: F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    # Both sides are lower-cased and split once, before they meet.
    text = F.lower("text")
    there = blocks.select("doc_id", text.alias("_text"), words(text).alias("_words"), F.col("confidence").alias("_c"), F.col("line_index").cast("long").alias("_line"))
    joined = fields.withColumns({"_low": low, "_own": words(low)}).join(there, "doc_id", "left")
    place = F.struct(F.col("_line").alias("o"), F.col("_c").alias("c"))
    inside = F.when(F.col("_text").contains(F.col("_low")), place)
    shares = F.when(F.arrays_overlap("_own", "_words"), place)
    keys = fields.columns
    out = joined.groupBy(*keys).agg(F.min(inside).alias("_inside"), F.min(shares).alias("_shares"), F.count("_text").alias("_n"), F.avg("_c").alias("overall_confidence"))
    value = F.when(F.col("_n") == 0, F.lit(0.0)).otherwise(F.coalesce("_inside.c", "_shares.c", F.lit(0.7)))
    return out.select(*keys, value.alias("confidence"), *(["overall_confidence"] if overall else []))


def review(fields: DataFrame, overall: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, low_fields (sorted), needs_review: a low field, or an overall confidence below the threshold."""
    low = fields.where(F.col("confidence") < threshold).groupBy("doc_id").agg(F.array_sort(F.collect_list("field_name")).alias("low_fields"))
    out = overall.join(low, "doc_id", "left")
    return out.select("doc_id", F.coalesce("low_fields", F.array().cast("array<string>")).alias("low_fields"), ((F.col("overall_confidence") < threshold) | F.col("low_fields").isNotNull()).alias("needs_review"))


def post_process(docs: DataFrame, blocks: DataFrame, rules: list, threshold: float = 0.8, remark: bool = True) -> DataFrame:
    """doc_id, doc_type, field_name, value, confidence, n_changes, needs_review: fields extracted, corrected and reviewed.

    Confidences belong to the values before correction. Fields meet their document's blocks once, by doc_id; the means of
    all its blocks and the low fields of the document are taken from the same rows. A document without blocks needs
    review.
    """
    fields = value_confidence(extract_fields(docs, remark=remark), blocks, overall=True)
    doc = Window.partitionBy("doc_id")
    low = F.max((F.col("confidence") < threshold) | (F.coalesce("overall_confidence", F.lit(0.0)) < threshold)).over(doc)
    fixed = apply_rules(fields.withColumn("needs_review", low), rules)
    return fixed.select("doc_id", "doc_type", "field_name", "value", "confidence", F.size("applied").alias("n_changes"), "needs_review")
