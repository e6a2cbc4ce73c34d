"""Conversation prefix trie by prefix doubling.

Every distinct sequence of the first d turns of a conversation is a node. Turns get dense numbers; then blocks of two, four,
eight ... turns do, each round by pairing neighbouring blocks of half the length and numbering the distinct pairs. A prefix
of d turns is the sequence of blocks that the binary digits of d name, longest first, each of which starts at a multiple of
its own length: prefixes with r digits set get their numbers from those with r - 1 by one more block. So a longest
conversation of n turns takes about 2 log2(n) rounds, and none is ever one row, one group or one task. Then prefixes of one
number and depth are grouped.

Sums over subtrees need no walk: a conversation is the smallest member of its nodes from some depth t on and of none above,
so the nodes below v are, each once, the turns from t on of v's members. With S(c, d) the code points of the first d turns
of c, what v's subtree saves is the sum of S(c, t - 1) - S(c, d - 1) over its members with t > d, and its childless nodes
are its members that are the smallest to end in one.

Hot groups: numbers come from distinct pairs, which are aggregated before the exchange; their joins have one row a pair on
one side, so that adaptive execution can split a pair that many conversations share. The ids of conversations that end in
one node are put in order by ranges and written as pieces there; only pieces meet, as a stream, in the node's digest.

Defined results: turns go by turn (null first), equal ones by the digest of role and text, so repeated turns stay; null role
or text is empty; turns are equal if the SHA-256 of role's length, role and text is; rows without conv_id belong to no
conversation; further columns are left out; a table without conversations has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freed, numbered, ranked, stored

#: Ids of a piece of a node's endings; digests read pieces, not ids.
PIECE = 512
_EMPTY = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """Rows (conv, at, size, whole, digest, chars, before): each turn's place, the turns and code points of its conversation, the code points before it."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    placed = ranked(rows, "conv", ("turn", "digest"), "trie-turns", running="chars")
    return placed.select("conv", F.col("_index").alias("at"), F.col("_size").alias("size"), F.col("_whole").alias("whole"), "digest", "chars", F.col("_before").alias("before"))


def rebuilt(turns: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """turns_of's rows with each conversation's first `head` turns (a column of conv, `most` at most) taken from conversation
    `base` (all of its if it has fewer, none if there is none); its own turns after its first `head` follow.

    Rows as turns_of gives them; a conversation without turns has one row whose at, digest, chars and before are null.
    """
    counts = [F.sum(F.when(F.col("at") < k, F.col("chars"))).alias(f"_{k}") for k in range(1, most + 1)]
    each = turns.groupBy("conv").agg(F.max("size").alias("size"), F.max("whole").alias("whole"), *counts)
    sums = F.array(F.lit(0).cast("long"), *(F.coalesce(F.col(f"_{k}"), F.lit(0)) for k in range(1, most + 1)))
    each = stored(each.select("conv", "size", "whole", sums.alias("sums"), base.alias("base"), head.cast("int").alias("head")), "trie-heads")
    other = each.select(F.col("conv").alias("_conv"), F.col("size").alias("_size"), F.col("sums").alias("_sums"))
    taken = F.least(F.col("head").cast("long"), F.coalesce("_size", F.lit(0)))
    own = F.get("sums", F.col("head"))
    plan = each.join(other, F.col("base") == F.col("_conv"), "left").select(
        "conv", "base", "head",
        (taken + F.greatest(F.col("size") - F.col("head"), F.lit(0))).alias("size"),
        (taken - F.col("head")).alias("shift"),
        (F.coalesce(F.get("_sums", taken.cast("int")), F.lit(0)) - own).alias("more"),
        (F.coalesce(F.get("_sums", taken.cast("int")), F.lit(0)) + F.col("whole") - own).alias("whole"),
    )
    plan = stored(plan, "trie-plan")
    rows = turns.select("conv", "at", "digest", "chars", "before")
    after = rows.join(plan, "conv").where("at >= head").select("conv", (F.col("at") + F.col("shift")).alias("at"), "size", "whole", "digest", "chars", (F.col("before") + F.col("more")).alias("before"))
    first = rows.where(F.col("at") < most).withColumnRenamed("conv", "base").join(plan, "base").where("at < head").select("conv", "at", "size", "whole", "digest", "chars", "before")
    none = plan.where("size = 0").select("conv", F.lit(None).cast("long").alias("at"), "size", "whole", F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("chars"), F.lit(None).cast("long").alias("before"))
    return first.unionByName(after).unionByName(none)


def _named(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows with name, the dense number of their key among the distinct keys."""
    return rows.join(numbered(rows.select(*key).distinct(), "trie-names", "name"), key)


def _most_digits(longest: int) -> int:
    """The most binary digits set in any number up to longest."""
    return (longest + 1).bit_length() - 1


def prefixes(turns: DataFrame) -> DataFrame:
    """Rows (conv, depth, name) of turns (conv, at, digest): equal sequences of one depth, and only they, have equal names."""
    longest = (turns.agg(F.max("at")).first()[0] or 0) + 1
    level = stored(_named(turns.select("conv", F.col("at").alias("j"), "digest"), ["digest"]).select("conv", "j", "name"), "trie-blocks")
    levels = [level]
    for _ in range(longest.bit_length() - 1):
        side = lambda k: F.max(F.when(F.col("j") % 2 == k, F.col("name")))
        pairs = level.groupBy("conv", F.expr("j div 2").alias("j")).agg(side(0).alias("a"), side(1).alias("b")).where("a is not null and b is not null")
        level = stored(_named(pairs, ["a", "b"]).select("conv", "j", "name"), "trie-blocks")
        levels.append(level)
    # The block (level k, place j even) ends the prefix of (j + 1) << k turns, and no other does.
    ends = [x.where("j % 2 = 0").select("conv", F.expr(f"shiftleft(j, {k})").alias("start"), F.expr(f"shiftleft(j + 1, {k})").alias("depth"), F.bit_count("j").alias("digits"), F.col("name").alias("b")) for k, x in enumerate(levels)]
    blocks = reduce(DataFrame.unionByName, ends)
    now = blocks.where("digits = 0").select("conv", "depth", F.col("b").alias("name"))
    out = [now]
    for digits in range(1, _most_digits(longest)):
        before = now.select("conv", F.col("depth").alias("start"), F.col("name").alias("a"))
        pairs = blocks.where(F.col("digits") == digits).join(before, ["conv", "start"]).select("conv", "depth", "a", "b")
        now = stored(_named(pairs, ["depth", "a", "b"]).select("conv", "depth", "name"), "trie-prefixes")
        out.append(now)
    return reduce(DataFrame.unionByName, out)


def _endings(rows: DataFrame) -> DataFrame:
    """(depth, name, ends_sha256) of rows (depth, name, conv): the digest of each node's conv ids, ascending, joined by commas."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            depth, name, conv = (c.to_pylist() for c in b.columns)
            out: list[tuple] = []
            for key, at in groupby(range(len(conv)), key=lambda i: (depth[i], name[i])):
                ids = [conv[i] for i in at]
                out += [(*key, ids[k], ",".join(map(str, ids[k : k + PIECE]))) for k in range(0, len(ids), PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["depth", "name", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for b in batches:
            out: list[tuple] = []
            for d, n, ids in zip(*(b.column(c).to_pylist() for c in ("depth", "name", "ids")), strict=True):
                if (d, n) == now:
                    digest.update(b",")
                else:
                    out += [(*now, digest.hexdigest())] if now else []
                    now, digest = (d, n), hashlib.sha256()
                digest.update(ids.encode())
            yield rows_of(out)
        yield rows_of([(*now, digest.hexdigest())] if now else [])

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["depth", "name", "ends_sha256"])

    ordered = rows.select("depth", "name", "conv").repartitionByRange("depth", "name", "conv").sortWithinPartitions("depth", "name", "conv")
    packed = ordered.mapInArrow(freed(pieces), "depth long, name long, first long, ids string")
    return packed.repartition("depth", "name").sortWithinPartitions("depth", "name", "first").mapInArrow(freed(digests), "depth long, name long, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """A row for each node of turns (as turns_of or rebuilt gives them): conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256. A node's sequence is the first `depth` turns of its conv_id."""
    turns = stored(turns, "trie-rebuilt")
    there = turns.where("at is not null")
    named = prefixes(there)
    facts = there.select("conv", (F.col("at") + 1).alias("depth"), "chars", "before", (F.col("at") + 1 == F.col("size")).alias("last"))
    each = stored(turns.groupBy("conv").agg(F.max("size").alias("size"), F.max("whole").alias("whole")), "trie-conversations")
    zero = F.lit(0).cast("long")
    root = each.select("conv", zero.alias("depth"), zero.alias("name"), zero.alias("before"), (F.col("size") == 0).alias("last"))
    members = stored(named.join(facts, ["conv", "depth"]).select("conv", "depth", "name", "before", "last").unionByName(root), "trie-members")
    ended = F.sum(F.col("last").cast("long"))
    nodes = stored(members.groupBy("depth", "name").agg(F.min("conv").alias("rep"), (F.count("*") == ended).alias("leaf")), "trie-nodes")
    # From which depth on a conversation is the smallest member of its nodes, and the smallest member of the node above.
    since = nodes.groupBy(F.col("rep").alias("conv")).agg(F.min("depth").alias("since"), F.max("leaf").alias("leaf"))
    since = stored(since, "trie-since")
    above = since.where("since > 0").select("conv", (F.col("since") - 1).alias("depth")).join(members, ["conv", "depth"]).select("conv", "depth", "name")
    above = above.join(nodes.select("depth", "name", "rep"), ["depth", "name"]).select("conv", F.col("rep").alias("above"))
    here = since.join(members.select("conv", F.col("depth").alias("since"), "before"), ["conv", "since"]).join(above, "conv", "left")
    here = here.select("conv", "since", "leaf", "before", "above")
    known = each.join(here, "conv", "left").select("conv", "since", "above", F.coalesce("leaf", F.lit(False)).cast("long").alias("leaf"), F.coalesce("before", "whole").alias("until"))
    j = members.join(stored(known, "trie-known"), "conv")
    saved = F.sum(F.when(F.col("since").isNull() | (F.col("since") > F.col("depth")), F.col("until") - F.col("before")).otherwise(0))
    grouped = j.groupBy("depth", "name").agg(F.min(F.struct("conv", "since", "above")).alias("m"), F.count("*").alias("n_convs"), F.sum("leaf").alias("n_leaves"), saved.alias("saved_tokens"))
    parent = F.when(F.col("depth") > F.col("m.since"), F.col("m.conv")).otherwise(F.col("m.above"))
    grouped = stored(grouped.select("depth", "name", F.col("m.conv").alias("conv_id"), parent.alias("parent_conv_id"), "n_convs", "n_leaves", "saved_tokens"), "trie-grouped")
    children = grouped.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    out = grouped.join(_endings(members.where("last")), ["depth", "name"], "left").join(children, ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
