"""Mixing sources to target weights by entropy balancing.

Sources in code point order (null last) weigh 5, 2, 1, repeating. They share `share` times all sizes; a target stops
at `most` times its source's size and the excess goes to the others by weight. The document rates r minimise the sum
of r*log(r) - r under 0 <= r <= most and, for each source, sum(r * size) = target. By duality r = min(most,
exp(l * size / mean size)) with one multiplier l a source, which distributed Newton iterations find: each is one
aggregation of the counts by (source, size), on which rates alone depend. Systematic rounding along (source, size)
then turns rates into whole copies, so a source misses its target by about one document.

All sums are of integers or decimals, so reruns agree whatever the order of rows. Defined results: a null text has
size 0; a document of size 0 has rate 1; rows of equal doc_id are documents of their own; an empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WEIGHTS = (5, 2, 1)
#: A multiplier known to this moves no document's rate by more than rounding.
NARROW = 1e-12
_UNIT = 1 << 20
_EXACT = "decimal(28,6)"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running(df: DataFrame, group: list[str], order: list[str], value: str, out: str, name: str) -> DataFrame:
    """df with the sum of a long column over the rows of a group up to each row, in that order, this one included.

    Rows are dealt by range, so a large group spreads over many tasks; each task's part of a group starts from the
    sums of the parts before it, of which there is one a task and group.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = stored(df.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()), name)
    sums = dealt.groupBy(*group, "_part").agg(F.sum(value).alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    within = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(before, ["_part", *group]).withColumn(out, F.col("_before") + F.sum(value).over(within)).drop("_part", "_before")


def targets(sizes: DataFrame, share: float, most: float) -> DataFrame:
    """skey, source_size, n, target of each source."""
    sums = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).withColumn("one", F.lit(1).cast("long"))
    ranked = running(sums.withColumn("all", F.lit(0)), ["all"], ["skey"], "one", "place", "mix-sources")
    weigh = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("place") - 1, F.lit(len(WEIGHTS))).cast("int") + 1)
    named = stored(ranked.select("skey", "source_size", "n", weigh.cast("double").alias("weight")), "mix-weights")
    total = share * (named.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        capped = F.col("weight") * level >= most * F.col("source_size")
        n, held, free = named.agg(F.count_if(capped), F.coalesce(F.sum(F.when(capped, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))).first()
        if n == full or not free:
            break
        full, level = n, (total - most * held) / free
    return named.withColumn("target", F.least(F.col("weight") * level, most * F.col("source_size")) if free else most * F.col("source_size"))


def balance(sizes: DataFrame, goals: DataFrame, most: float, newton: int = 30, near: float = 1e-9) -> DataFrame:
    """skey, scale, multiplier of each source; null where the rate is `most` throughout.

    Goes on until every source is within `near` of its target, or its multiplier's bracket within NARROW. After `newton`
    rounds all steps halve the bracket, so that there is an end.
    """
    counts = stored(sizes.where("size > 0").groupBy("skey", "size").agg(F.count("*").alias("n")), "mix-counts")
    state = stored(
        goals.where((F.col("source_size") > 0) & (F.col("target") < most * F.col("source_size"))).select(
            "skey", "target", (F.col("source_size") / F.col("n")).alias("scale"), F.lit(0.0).alias("l"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), F.lit(1.0).alias("off")
        ),
        "mix-state",
    )
    turn = 0
    while True:
        x = F.col("l") * F.col("size") / F.col("scale")
        mass = F.col("n") * F.col("size") * F.exp(F.least(x, F.lit(math.log(most))))
        slope = F.when(x < math.log(most), mass * F.col("size") / F.col("scale")).otherwise(0.0)
        sums = counts.join(state, "skey").groupBy("skey").agg(F.sum(mass.cast(_EXACT)).cast("double").alias("mass"), F.sum(slope.cast(_EXACT)).cast("double").alias("slope"))
        low, high = F.when(F.col("mass") < F.col("target"), F.col("l")).otherwise(F.col("low")), F.when(F.col("mass") >= F.col("target"), F.col("l")).otherwise(F.col("high"))
        # Newton's step for log(mass) = log(target); halving where it would leave the bracket.
        step = F.col("l") - (F.log(F.col("mass")) - F.log(F.col("target"))) * F.col("mass") / F.nullif(F.col("slope"), F.lit(0.0))
        moved = state.join(sums, "skey").select("skey", "target", "scale", low.alias("low"), high.alias("high"), step.alias("step"), F.abs(F.col("mass") / F.col("target") - 1).alias("off"), "l")
        inside = (F.col("step") > F.col("low")) & (F.col("step") < F.col("high")) & F.lit(turn < newton)
        state = stored(moved.select("skey", "target", "scale", F.when(F.col("off") < near, F.col("l")).when(inside, F.col("step")).otherwise((F.col("low") + F.col("high")) / 2).alias("l"), "low", "high", "off"), "mix-state")
        if not state.where((F.col("off") >= near) & (F.col("high") - F.col("low") > NARROW)).limit(1).count():
            break
        turn += 1
    return state.select("skey", "scale", F.col("l").alias("multiplier"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, source, size long, source_size long, target double, rate double, copies int, taken long: a row for each row of docs."""
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    sizes = stored(docs.select("doc_id", "source", key.alias("skey"), word_count(F.col("text")).alias("size")), "mix-sizes")
    goals = stored(targets(sizes, share, most), "mix-goals")
    found = goals.join(balance(sizes, goals, most), "skey", "left").select("skey", "source_size", "target", "scale", "multiplier")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("multiplier").isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.col("multiplier") * F.col("size") / F.col("scale"), F.lit(math.log(most))))))
    rated = sizes.join(found, "skey").withColumn("rate", rate).withColumn("units", F.round(F.col("rate") * _UNIT).cast("long")).withColumn("h", F.xxhash64("doc_id"))
    summed = running(rated, ["skey"], ["size", "h", "doc_id"], "units", "upto", "mix-rates")
    whole = lambda x: F.floor((x + _UNIT // 2) / F.lit(_UNIT))
    copies = (whole(F.col("upto")) - whole(F.col("upto") - F.col("units"))).cast("int")
    return summed.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))
