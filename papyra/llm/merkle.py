"""Merkle dataset manifest with proofs by coordinate lookup.

A leaf is the digest of a row's fields. The leaves of a group (here: a language), in order, are folded by runs of
`arity` until one is left, its subroot; subroots, ordered by group, are folded likewise to the root. Nodes are a table of
coordinates (tree, tier, cell, level, place). To prove a leaf, the coordinates of its siblings are worked out from its
index and its group's size alone, exploded to rows, joined with the node table, put in order, concatenated and folded.

How it keeps to bounded tasks at any size: a tier is `levels` levels of the tree, and a cell the subtree of one node at
a tier's top, so a cell has at most arity ** levels leaves (1,024). Cells are folded on their own, and each round of
the build is a tier, not a level: 5 * 10^10 rows take four. A node near the root is a sibling of a large part of the
group, which would be a hot key in one join; as lookups stay within a cell and a cell's own path is looked up once, in
the tier above, no key is asked for by more than a cell's leaves. Requests and nodes are dealt by cell, so that what is
exploded meets its nodes and is put in order without another exchange. Texts stay where they are scanned.

Defined results: a null field counts as `-`; nulls of the group are a group, the first; rows of one order value follow
each other by their leaves' digests, so equal rows may change places, which no column shows; a group of one row has its
leaf as subroot; a table without rows has no rows; further columns are left out. The row whose order value is null comes
first in its group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freed, ranked, stored

#: Levels of a tier: a cell has arity ** levels leaves.
LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_DIGEST = "digest binary"


def field_text(c: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:` and the value."""
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field_text, fields)), 256)


def _powers(arity: int) -> list[int]:
    out = [1]
    while out[-1] * arity < 1 << 62:
        out.append(out[-1] * arity)
    return out


def height(count: Column, arity: int) -> Column:
    """Levels above `count` leaves until one node is left."""
    return F.size(F.filter(F.array(*(F.lit(p).cast("long") for p in _powers(arity))), lambda p: p < count))


def _cell(df: DataFrame, arity: int, levels: int) -> DataFrame:
    """df (tree, index, count) with cell, place in it, the cell's leaves and the levels that are folded in this tier."""
    width = arity**levels
    return df.withColumns({
        "cell": F.expr(f"index div {width}"),
        "place": (F.col("index") % width).cast("int"),
        "here": F.least(F.lit(width), F.col("count") - F.expr(f"index div {width}") * width).cast("int"),
        "steps": F.least(F.lit(levels), height(F.col("count"), arity)),
    })


def _folded(cells: DataFrame, arity: int) -> DataFrame:
    """Nodes (tree, cell, count, level, place, top, digest) of cells (tree, cell, count, steps, digests in order)."""
    schema = pa.schema([("tree", pa.string()), ("cell", pa.int64()), ("count", pa.int64()), ("level", pa.int32()), ("place", pa.int32()), ("top", pa.bool_()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), 64):
                out = [[] for _ in schema]
                for tree, cell, count, steps, now in zip(*(c.to_pylist() for c in b.slice(k, 64).columns), strict=True):
                    for level in range(steps + 1):
                        for column, values in zip(out, ([tree] * len(now), [cell] * len(now), [count] * len(now), [level] * len(now), range(len(now)), [level == steps] * len(now), now), strict=True):
                            column.extend(values)
                        text = [d.hex().encode() for d in now]
                        now = [hashlib.sha256(b"".join(text[i : i + arity])).digest() for i in range(0, len(text), arity)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return cells.mapInArrow(freed(run), f"tree string, cell long, count long, level int, place int, top boolean, {_DIGEST}")


def build(leaves: DataFrame, arity: int = 2, levels: int = LEVELS) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Of leaves (tree, index, count, digest; a written table): each tier's leaves, each tier's nodes, and the tops (tree, tier, digest)."""
    inputs, nodes, tops = [], [], []
    now, most = leaves, leaves.agg(F.max("count")).first()[0] or 0
    while True:
        cells = _cell(now, arity, levels).groupBy("tree", "cell", "count", "steps").agg(F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("d"))
        table = stored(_folded(cells.select("tree", "cell", "count", "steps", F.transform("d", lambda x: x["digest"]).alias("digests")), arity), "merkle-nodes")
        inputs.append(now)
        nodes.append(table)
        width = arity**levels
        up = table.where("top").select("tree", F.col("cell").alias("index"), F.expr(f"(count - 1) div {width} + 1").alias("count"), "digest")
        tops.append(up.where("count = 1").select("tree", F.lit(len(nodes) - 1).alias("tier"), "digest"))
        most = -(-most // width)
        if most <= 1:
            break
        now = up.where("count > 1")
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return inputs, nodes, out


def _slots(arity: int, levels: int) -> Column:
    """Own place in the run of each level of the tier, for rows of _cell."""
    return F.transform(_levels(), lambda j: _up(F.col("place"), j, arity, levels) % arity)


def _levels() -> Column:
    return F.when(F.col("steps") > 0, F.sequence(F.lit(0), F.col("steps") - 1)).otherwise(F.array().cast("array<int>"))


def _up(x: Column, j: Column, arity: int, levels: int) -> Column:
    """x div arity ** j."""
    return F.floor(x / F.get(F.array(*(F.lit(arity**k) for k in range(levels + 1))), j)).cast("int")


def siblings(leaves: DataFrame, nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """(tree, cell, place, path) of leaves (tree, index, count) with levels in this tier: for each level the arity - 1
    siblings from left to right, null where the last run is shorter.

    Each leaf explodes the coordinates of its siblings; these rows meet the nodes in an equi-join and are put in order.
    """
    # ceil(here / arity ** j) nodes stand at level j of the cell.
    wide = lambda j: _up(F.col("here") - 1, j, arity, levels) + 1

    def asked(j: Column) -> Column:
        own = _up(F.col("place"), j, arity, levels)
        first = F.floor(own / arity).cast("int") * arity
        at = lambda k: F.when(first + k < own, first + k).otherwise(first + k + 1)
        return F.transform(F.sequence(F.lit(0), F.lit(arity - 2)), lambda k: F.struct(j.alias("level"), k.alias("k"), F.when(at(k) < wide(j), at(k)).alias("at")))

    rows = _cell(leaves, arity, levels).select("tree", "cell", "place", F.explode(F.flatten(F.transform(_levels(), asked))).alias("_c"))
    asking = rows.select("tree", "cell", "place", F.col("_c.level").alias("level"), F.col("_c.at").alias("at"), F.col("_c.k").alias("k"))
    known = nodes.where("not top").select("tree", "cell", "level", F.col("place").alias("at"), "digest")
    found = asking.join(known, ["tree", "cell", "level", "at"], "left")
    entries = F.sort_array(F.collect_list(F.struct("level", "k", "digest")))
    return found.groupBy("tree", "cell", "place").agg(F.transform(entries, lambda x: F.lower(F.hex(x["digest"]))).alias("path"))


def fold(leaf: Column, path: Column, slots: Column, arity: int = 2) -> Column:
    """The root that a leaf's digest (hex) gives with its path; see siblings."""
    steps = F.transform(slots, lambda s, j: F.struct(s.alias("s"), F.slice(path, j * (arity - 1) + 1, arity - 1).alias("p")))

    def step(acc: Column, x: Column) -> Column:
        left = F.array_join(F.slice(x["p"], F.lit(1), x["s"]), "")
        right = F.array_join(F.slice(x["p"], x["s"] + 1, F.lit(arity - 1)), "")
        return F.sha2(F.concat(left, acc, right), 256)

    return F.aggregate(steps, leaf, step)


def _paths(inputs: list[DataFrame], nodes: list[DataFrame], ends: DataFrame, arity: int, levels: int, payload: tuple[str, ...]) -> DataFrame:
    """The first tier's leaves (tree, payload) with whole paths and slots, and what ends has for their tree.

    ends: tree, tier (its last), path and slots beyond its top, and further columns. From the last tier down, a cell's
    path is its top's in the tier above; a tree's last tier has one cell, whose path is the one beyond the top.
    """
    extra = [c for c in ends.columns if c not in ("tree", "tier")]
    above = None
    for tier in range(len(nodes) - 1, -1, -1):
        last = ends.where(F.col("tier") == tier).select("tree", F.lit(0).cast("long").alias("cell"), *(F.col(c).alias(f"_{c}") for c in extra))
        above = last if above is None else above.unionByName(last)
        own = payload if tier == 0 else ("index",)
        leaves = _cell(inputs[tier], arity, levels).select("tree", "cell", "place", _slots(arity, levels).alias("slots"), *own).join(above, ["tree", "cell"])
        found = leaves.join(siblings(inputs[tier], nodes[tier], arity, levels), ["tree", "cell", "place"], "left")
        path = F.concat(F.coalesce("path", F.array().cast("array<string>")), "_path")
        joined = found.select("tree", *own, path.alias("path"), F.concat("slots", "_slots").alias("slots"), *(F.col(f"_{c}").alias(c) for c in extra if c not in ("path", "slots")))
        if tier:
            above = stored(joined.select("tree", F.col("index").alias("cell"), *(F.col(c).alias(f"_{c}") for c in extra)), "merkle-paths")
    return joined


def manifest(rows: DataFrame, group: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, changed: dict[str, Column] | None = None, arity: int = 2, levels: int = LEVELS) -> DataFrame:
    """A row for each of rows: order, group, leaf, presented (the leaf of the row as presented), subroot, root, path (the
    siblings' digests in order, null where a run is short) and slots.

    changed replaces fields of the rows as they are presented for proof: the leaf of a row as it is now, while subroots,
    root and siblings are of the rows as they were.
    """
    tree = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    now = [(changed or {}).get(c, F.col(c)) for c in fields]
    digests = rows.select(tree.alias("tree"), F.col(order).alias("key"), F.unhex(leaf_digest(*map(F.col, fields))).alias("digest"), F.unhex(leaf_digest(*now)).alias("presented"))
    placed = ranked(digests, "tree", ("key", "digest"), "merkle-leaves").withColumnsRenamed({"_index": "index", "_size": "count"})
    leaves = stored(placed, "merkle-placed")
    inputs, nodes, tops = build(leaves.select("tree", "key", "index", "count", "digest", "presented"), arity, levels)
    tops = stored(tops, "merkle-subroots")
    # The subroots are the leaves of a tree of their own.
    second = ranked(tops.select(F.lit("").alias("root"), "tree", "tier", "digest"), "root", ("tree",), "merkle-groups")
    roots = stored(second.select(F.col("root").alias("tree"), F.col("tree").alias("of"), "tier", F.col("_index").alias("index"), F.col("_size").alias("count"), "digest"), "merkle-roots")
    top_inputs, top_nodes, top = build(roots, arity, levels)
    nothing = [F.array().cast("array<string>").alias("path"), F.array().cast("array<int>").alias("slots")]
    begins = top.select("tree", "tier", *nothing, F.lower(F.hex("digest")).alias("root"))
    ends = stored(_paths(top_inputs, top_nodes, begins, arity, levels, ("of", "tier", "digest")).select(F.col("of").alias("tree"), "tier", "path", "slots", "root", F.lower(F.hex("digest")).alias("subroot")), "merkle-ends")
    out = _paths(inputs, nodes, ends, arity, levels, ("key", "digest", "presented"))
    named = F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30))
    return out.select(F.col("key").alias(order), named.alias(group), F.lower(F.hex("digest")).alias("leaf"), F.lower(F.hex("presented")).alias("presented"), "subroot", "root", "path", "slots")


def verified(proofs: DataFrame, order: str = "doc_id", arity: int = 2) -> DataFrame:
    """order, leaf, subroot, root, proof_sha256, folded_root, verified of manifest's rows."""
    folded = proofs.withColumn("folded_root", fold(F.col("presented"), F.col("path"), F.col("slots"), arity))
    return folded.select(order, "leaf", "subroot", "root", F.sha2(F.array_join("path", ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
