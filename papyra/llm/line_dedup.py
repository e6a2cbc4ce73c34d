"""Line dedup with built-in functions only, by content-defined chunks of lines.

A text is split at newlines and every line hashed. A rolling hash over the hashes of two neighbouring lines ends a chunk
wherever it is 0 modulo `modulus` and wasn't at the line before, so chunk limits depend on nearby lines alone, shift
along with inserted text, and leave chunks of two lines or more (but for a last line).

`dedup_passages` removes every passage of two lines or more that stands at another place already. First whole chunks: a
chunk that stands in a document with a smaller id too goes at once, with one row a chunk in the exchange. Then what
chunk limits cut: neighbouring lines of the chunks that are left, and those across limits, are pairs. A passage is
repeated where its pairs are, so a line goes if one of its pairs isn't at the pair's first place: in the document with
the smallest id, there the first. A chunk that went holds no first place, so its pairs needn't be asked. The first place
of every line stays, as its pairs can't be elsewhere before. Lines are told apart by their bytes: hashes (64 bits) stand
for them as long as each is one line's, found by grouping the lines themselves; where two lines share a hash, chunks and
pairs with it are compared by their bytes. No passage is missed, whatever its surroundings; n_lines, removed_lines and
removed_chunks (runs of neighbouring lines that went) are added.

`dedup_lines` stops after the chunks, and compares these by their whole bytes: chunks of at least `least_lines` lines that
stand in the table more than once are removed but for one place, the document with the smallest id, there the first.

Defined results of both: a null text stays null and has no lines; an empty text is one empty line; rows of equal
doc_id count as one document, of which each row keeps its first place; rows of null doc_id count as one document after
all others. Further columns of the input come through unchanged; `n_lines`, `removed_lines` and `removed_chunks` are
replaced if the input has such columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

_LAST = (1 << 63) - 1


def _hash(text: Column) -> Column:
    return F.xxhash64(text)


def _let(value: Column, body) -> Column:
    """body of value, evaluated once: a column that a lambda captures would be worked out for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _limits(h: Column, modulus: int) -> Column:
    """Pairs (s, e) of the chunks of lines with these hashes: lines s to e - 1, from 0."""
    hit = lambda i: (i > 1) & (F.pmod(F.xxhash64(F.get(h, i - 2), F.get(h, i - 1)), F.lit(modulus)) == 0)
    ends = F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: (i == F.size(h)) | (hit(i) & ~hit(i - 1)))
    return _let(ends, lambda e: F.arrays_zip(F.concat(F.array(F.lit(0)), F.slice(e, 1, F.size(e) - 1)).alias("s"), e.alias("e")))


def chunks(text: Column, modulus: int) -> Column:
    """array<struct<h long, n int, body string>> of a text's chunks in order."""

    def cut(lines: Column) -> Column:
        piece = lambda p: _let(F.array_join(F.slice(lines, p["s"] + 1, p["e"] - p["s"]), "\n"), lambda b: F.struct(_hash(b).alias("h"), (p["e"] - p["s"]).alias("n"), b.alias("body")))
        return F.transform(_let(F.transform(lines, _hash), lambda h: _limits(h, modulus)), piece)

    return _let(F.split(text, "\n", -1), cut)


def dedup_lines(docs: DataFrame, modulus: int = 3, least_lines: int = 2) -> DataFrame:
    """docs with `text` without repeated chunks, and n_lines, removed_lines int, removed_chunks int."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    cut = chunks(F.col("text"), modulus)
    pieces = docs.select(key.alias("d"), F.inline(cut)).where(F.col("n") >= least_lines)
    places = pieces.groupBy("d", "h", "body").agg(F.count("*").alias("own"))
    repeated = places.groupBy("h", "body").agg(F.sum("own").alias("times"), F.min("d").alias("first")).where("times > 1").drop("times")
    # One row a document and chunk; those that keep their only place need no mark.
    marks = places.join(repeated, ["h", "body"]).where("own > 1 or d <> first")
    marks = marks.groupBy("d").agg(F.collect_list(F.when(F.col("d") != F.col("first"), F.col("body"))).alias("gone"), F.collect_list(F.when(F.col("d") == F.col("first"), F.col("body"))).alias("once"))
    joined = docs.withColumn("_ld_d", key).join(marks.select(F.col("d").alias("_ld_d"), F.struct("gone", "once").alias("_ld_m")), "_ld_d", "left")

    def sift(all_chunks: Column) -> Column:
        marked = F.col("_ld_m")

        def lookup(m: Column) -> Column:
            bodies = F.transform(all_chunks, lambda c: c["body"])

            def kept(b: Column) -> Column:
                return F.filter(all_chunks, lambda c, i: ~((c["n"] >= least_lines) & (F.array_contains(m["gone"], c["body"]) | (F.array_contains(m["once"], c["body"]) & (F.array_position(b, c["body"]) < i + 1)))))

            return _let(bodies, kept)

        return F.when(marked.isNull(), all_chunks).otherwise(_let(marked, lookup))

    lines = F.coalesce(F.size(F.split(F.col("text"), "\n", -1)), F.lit(0))
    untouched = F.col("_ld_m").isNull() | F.col("text").isNull()
    result = F.when(untouched, F.struct(F.col("text").alias("text"), F.lit(0).alias("removed_lines"), F.lit(0).alias("removed_chunks"))).otherwise(
        _let(
            cut,
            lambda c: _let(
                sift(c),
                lambda k: F.struct(
                    F.array_join(F.transform(k, lambda x: x["body"]), "\n").alias("text"),
                    (F.aggregate(c, F.lit(0), lambda s, x: s + x["n"]) - F.aggregate(k, F.lit(0), lambda s, x: s + x["n"])).alias("removed_lines"),
                    (F.size(c) - F.size(k)).alias("removed_chunks"),
                ),
            ),
        )
    )
    own = [c for c in docs.columns if c not in ("text", "n_lines", "removed_lines", "removed_chunks")]
    out = joined.select(*(F.col(f"`{c}`") for c in own), F.when(F.col("text").isNull(), F.lit(0)).otherwise(lines).alias("n_lines"), result.alias("_ld_r"))
    return out.select(*(F.col(f"`{c}`") if c != "text" else F.col("_ld_r.text").alias("text") for c in docs.columns if c == "text" or c in own), "n_lines", F.col("_ld_r.removed_lines"), F.col("_ld_r.removed_chunks"))


def _line_chunks(text: Column, modulus: int, bodies: bool) -> Column:
    """array<struct<s int, h array<long>, next long, body string>>: chunks of two lines or more, of the lines from s on.

    next: the hash of the line behind, null at the end; body: the lines, if asked for.
    """

    def cut(lines: Column) -> Column:
        def named(h: Column) -> Column:
            def piece(p: Column) -> Column:
                body = [F.array_join(F.slice(lines, p["s"] + 1, p["e"] - p["s"]), "\n").alias("body")] if bodies else []
                return F.struct(p["s"].alias("s"), F.slice(h, p["s"] + 1, p["e"] - p["s"]).alias("h"), F.get(h, p["e"]).alias("next"), *body)

            return F.transform(F.filter(_limits(h, modulus), lambda p: p["e"] - p["s"] > 1), piece)

        return _let(F.transform(lines, _hash), named)

    return _let(F.split(text, "\n", -1), cut)


def _repeated_pairs(pairs: DataFrame, pair: list[str]) -> DataFrame:
    """d, t, m: the places i, in order, of a document's pairs that aren't the first of their kind."""
    repeated = pairs.groupBy(*pair).agg(F.count("*").alias("times"), F.min("d").alias("first")).where("times > 1").drop("times")
    # Later places of the first document go as well: its places are sorted, and all but the first of equal pairs marked.
    marks = pairs.join(repeated, pair).groupBy("d", "t").agg(
        F.collect_set(F.when(F.col("d") != F.col("first"), F.col("i"))).alias("gone"),
        F.collect_set(F.when(F.col("d") == F.col("first"), F.struct(*pair, "i"))).alias("own"),
    )
    alike = lambda x, y: reduce(lambda p, q: p & q, [x[c] == y[c] for c in pair])
    again = _let(F.array_sort("own"), lambda own: F.filter(own, lambda x, k: (k > 0) & alike(F.get(own, k - 1), x)))
    return marks.select("d", "t", F.array_sort(F.concat("gone", F.transform(again, lambda x: x["i"]))).alias("m"))


def dedup_passages(docs: DataFrame, modulus: int = 3) -> DataFrame:
    """docs with `text` without repeated passages of two lines or more, and n_lines, removed_lines, removed_chunks int."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    # Rows of equal id are told apart by their text: places are positions in it.
    body = F.unhex(F.md5(F.col("text")))
    split = F.split(F.col("text"), "\n", -1)
    lines = docs.select(F.explode(split).alias("line")).select(_hash(F.col("line")).alias("h"), "line").distinct()
    shared = stored(lines.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1").select("h"), "lines-shared")
    apart = shared.isEmpty()
    # Chunks: those of a later document than their first go whole.
    kind = ["h"] if apart else ["h", "body"]
    pieces = docs.select(key.alias("d"), body.alias("t"), F.inline(_line_chunks(F.col("text"), modulus, not apart)))
    repeated = pieces.groupBy(*kind).agg(F.count("*").alias("times"), F.min("d").alias("first")).where("times > 1").drop("times")
    again = F.coalesce(F.col("d") != F.col("first"), F.lit(False))
    found = stored(pieces.join(repeated, kind, "left").select("d", "t", "s", "h", "next", again.alias("again")), "lines-chunks")
    inner = F.sequence(F.col("s"), F.col("s") + F.size("h") - 2)
    whole = found.where("again").groupBy("d", "t").agg(F.flatten(F.collect_set(inner)).alias("m"))
    # Pairs: of the chunks that are left, and of a chunk's last line with the next.
    run = F.when(F.col("next").isNull(), F.col("h")).otherwise(F.concat("h", F.array("next")))
    run = F.when(F.col("again"), F.slice(run, F.size("h"), F.size(run) - F.size("h") + 1)).otherwise(run)
    base = F.when(F.col("again"), F.col("s") + F.size("h") - 1).otherwise(F.col("s"))
    neighbours = _let(run, lambda h: F.arrays_zip(F.slice(h, F.lit(1), F.size(h) - 1).alias("a"), F.slice(h, F.lit(2), F.size(h) - 1).alias("b")))
    pairs = found.select("d", "t", base.alias("base"), F.posexplode(neighbours).alias("k", "p")).select("d", "t", (F.col("base") + F.col("k")).alias("i"), "p.a", "p.b")
    if apart:
        marks = _repeated_pairs(pairs, ["a", "b"])
    else:
        for side in ("a", "b"):
            pairs = pairs.join(shared.select(F.col("h").alias(side), F.lit(True).alias(f"_{side}")), side, "left")
        odd = F.coalesce("_a", "_b", F.lit(False))
        told = docs.select(key.alias("d"), body.alias("t"), split.alias("whole")).distinct()
        bytes_of = pairs.where(odd).join(told, ["d", "t"]).select("d", "t", "i", F.get("whole", F.col("i")).alias("a"), F.get("whole", F.col("i") + 1).alias("b"))
        marks = _repeated_pairs(pairs.where(~odd), ["a", "b"]).unionByName(_repeated_pairs(bytes_of, ["a", "b"]))
    marks = marks.unionByName(whole).groupBy("d", "t").agg(F.array_sort(F.flatten(F.collect_list("m"))).alias("m"))
    marks = marks.select(F.col("d").alias("_ld_d"), F.col("t").alias("_ld_t"), F.col("m").alias("_ld_m")).where("size(_ld_m) > 0")
    joined = docs.withColumns({"_ld_d": key, "_ld_t": body}).join(marks, ["_ld_d", "_ld_t"], "left")

    def sift(whole: Column) -> Column:
        def left(gone: Column) -> Column:
            # Pair i covers lines i and i + 1: what stays lies between a pair's end and the next pair.
            start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(gone, k - 1) + 2)
            end = lambda k: F.when(k == F.size(gone), F.size(whole)).otherwise(F.get(gone, k))
            kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda k: F.slice(whole, start(k) + 1, F.greatest(end(k) - start(k), F.lit(0)))))
            runs = F.size(F.filter(gone, lambda x, k: (k == 0) | (x > F.get(gone, k - 1) + 2)))
            return _let(kept, lambda x: F.struct(F.array_join(x, "\n").alias("text"), (F.size(whole) - F.size(x)).alias("removed_lines"), runs.alias("removed_chunks")))

        return _let(F.col("_ld_m"), left)

    result = F.when(F.col("_ld_m").isNull(), F.struct(F.col("text").alias("text"), F.lit(0).alias("removed_lines"), F.lit(0).alias("removed_chunks"))).otherwise(_let(split, sift))
    own = [c for c in docs.columns if c not in ("n_lines", "removed_lines", "removed_chunks")]
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(split))
    out = joined.select(*(F.col(f"`{c}`") for c in own if c != "text"), n_lines.alias("n_lines"), result.alias("_ld_r"))
    return out.select(*(F.col("_ld_r.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in own), "n_lines", "_ld_r.removed_lines", "_ld_r.removed_chunks")
