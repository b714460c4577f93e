"""Prefix trie of conversations by collapsing whole sequences.

Every conversation is a sequence of turns; a node of the trie is a distinct prefix. Equal
sequences are first grouped into one weighted sequence with the list of the conversations that
end there, so a dialogue that a third of all conversations share is walked once. Sequences
that are proper prefixes of others go by an anti-join; the rest are the leaves. Then the
prefixes of the weighted sequences are aggregated into nodes.

* A prefix is known by its length and two 64-bit keys: the exclusive or of the hashes of
  (position, 128-bit digest of role and text) of its turns. Keys of parts of a conversation thus
  combine by the same operation, so long conversations are cut into slices: no conversation, and
  no node, is gathered in one task.
* A node is owned by its smallest conversation. On a sequence's path the nodes it owns are the
  deepest ones, so a sum over a subtree is the sum, over the sequences through the node, of all
  that they own, less what the owner has above the node: two aggregates, and no walk by depth.
* The list of conversations that end at a node is made in chunks; where its hash is asked for,
  the chunks are fed to it in order, one at a time.

Order of turns: by ``turn``, null first, then role, then the md5 of the text; rows that are equal
in all of these are separate turns. Null roles and texts are empty. Rows without a
conversation id belong to no conversation and are left out. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxmill.llm.common import stage

KEY = ["depth", "ka", "kb"]
SLICE = ["conv_id", "part"]
#: Part of the turns that come from another conversation, before all own parts.
HEAD = -1
MOST_HEAD, STRIDE = 8, 5
#: Conversations in one chunk of a list of ends.
CHUNK = 4096


def ordered(conversations: DataFrame) -> DataFrame:
    """Staged rows (conv_id, part, idx, dig, bytes): turns in order, by part, then idx.

    Sorting by ranges gives all partitions about as many rows whatever a conversation's share;
    a part is a range, and a conversation's rows in a part are consecutive.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.md5(text.cast("binary")).alias("sum"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(" "), role, text).cast("binary")).alias("dig"),
        F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("sum").asc(), F.col("row").asc()]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return stage(dealt.select("conv_id", F.expr("CAST(at >> 33 AS INT)").alias("part"), F.expr(f"at & {(1 << 33) - 1}").alias("idx"), "dig", "bytes"))


def ranked(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slices (conv_id, part, first, n, before) and conversations (conv_id, n) of ordered turns."""
    slices = turns.groupBy(*SLICE).agg(F.min("idx").alias("first"), F.count("*").alias("n"))
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    slices = stage(slices.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    return slices, slices.groupBy("conv_id").agg(F.sum("n").alias("n"))


def head_size(conv_id: Column) -> Column:
    """Turns that a conversation takes from the first of its five, by the crc32 of its id."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (MOST_HEAD + 1)).cast("int")


def hashed(depth: Column, dig: Column) -> list[Column]:
    """The two hashes of a turn at a depth; those of the root are 0."""
    return [F.when(depth > 0, F.xxhash64(*first, dig, depth)).otherwise(F.lit(0)).cast("long") for first in ((), (F.lit(1),))]


def plain(conversations: DataFrame) -> DataFrame:
    """Steps of the conversations as they are, see :func:`rebuilt`."""
    turns = ordered(conversations)
    slices, known = ranked(turns)
    own = turns.join(slices, SLICE).select(*SLICE, (F.col("before") + F.col("idx") - F.col("first") + 1).alias("depth"), "dig", "bytes")
    return _with_roots(own, known)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Steps (conv_id, part, depth, dig, bytes, a, b) of the rebuilt conversations.

    Conversation c has the first h turns of c - c % 5, then its own after its first h. Depth
    0 is the root, which every conversation has.
    """
    turns = ordered(conversations)
    slices, known = ranked(turns)
    rank = F.col("before") + F.col("idx") - F.col("first") + 1
    near = slices.where(F.col("before") < MOST_HEAD)
    heads = turns.join(near, SLICE).withColumn("rank", rank).where(F.col("rank") <= MOST_HEAD)
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("rank", "dig", "bytes"))).alias("head"))
    first = F.col("conv_id") - F.col("conv_id") % STRIDE
    based = known.select("conv_id", first.alias("base"), head_size(F.col("conv_id")).alias("h")).join(heads, "base", "left")
    based = stage(based.select("conv_id", "h", F.expr("coalesce(slice(head, 1, h), array())").alias("head")))
    taken = based.select("conv_id", F.lit(HEAD).alias("part"), F.explode("head").alias("t"))
    taken = taken.select(*SLICE, F.col("t.rank").alias("depth"), F.col("t.dig").alias("dig"), F.col("t.bytes").alias("bytes"))
    placed = slices.join(based.select("conv_id", "h", F.size("head").alias("taken")), "conv_id").where(F.col("before") + F.col("n") > F.col("h"))
    own = turns.join(placed, SLICE).withColumn("rank", rank).where(F.col("rank") > F.col("h"))
    own = own.select(*SLICE, (F.col("taken") + F.col("rank") - F.col("h")).alias("depth"), "dig", "bytes")
    return _with_roots(taken.unionByName(own), known)


def _with_roots(steps: DataFrame, known: DataFrame) -> DataFrame:
    roots = known.select("conv_id", F.lit(HEAD).alias("part"), F.lit(0).cast("long").alias("depth"), F.lit("").alias("dig"), F.lit(0).cast("long").alias("bytes"))
    a, b = hashed(F.col("depth"), F.col("dig"))
    return stage(steps.unionByName(roots).select("*", a.alias("a"), b.alias("b")))


def carried(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged slices (conv_id, part, ca, cb), the keys before each slice, and whole sequences (conv_id, depth, ka, kb)."""
    sums = steps.groupBy(*SLICE).agg(F.expr("bit_xor(a)").alias("a"), F.expr("bit_xor(b)").alias("b"), F.max("depth").alias("depth"))
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = stage(sums.select("*", *[F.expr(f"bit_xor({c})").over(earlier).alias(f"_{c}") for c in "ab"]))
    whole = sums.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.expr("bit_xor(a)").alias("ka"), F.expr("bit_xor(b)").alias("kb"))
    return sums.select(*SLICE, *[F.coalesce(f"_{c}", F.lit(0)).alias(f"c{c}") for c in "ab"]), whole


def collapsed(whole: DataFrame) -> DataFrame:
    """Weighted sequences (depth, ka, kb, conv_id, weight): equal ones as one row, by their smallest conversation."""
    return whole.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"))


def ends(whole: DataFrame) -> DataFrame:
    """Lists of the conversations that end at a node, in chunks (depth, ka, kb, from, ids): decimal, ascending, joined by commas.

    Chunks have at most ``CHUNK`` ids and follow each other by ``from``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            key, listed = None, []
            for *now, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key or len(listed) == CHUNK:
                    if listed:
                        rows.append((*key, listed[0], ",".join(map(str, listed))))
                    key, listed = now, []
                listed.append(conv)
            if listed:
                rows.append((*key, listed[0], ",".join(map(str, listed))))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*rows))[:4] or [()] * 4] + [pa.array([r[4] for r in rows], pa.string())], [*KEY, "from", "ids"])

    order = [*KEY, "conv_id"]
    dealt = whole.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "depth long, ka long, kb long, `from` long, ids string")


def ends_hashes(whole: DataFrame) -> DataFrame:
    """Rows (depth, ka, kb, ends_sha256): SHA-256 of each whole list, fed chunk by chunk, so a list is never in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            rows = []
            for *now, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key:
                    if state:
                        rows.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield made(rows)
        if state:
            yield made([(*key, state.hexdigest())])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if k == 3 else pa.int64()) for k in range(4)], [*KEY, "ends_sha256"])

    dealt = ends(whole).repartition(*KEY).sortWithinPartitions(*KEY, "from")
    return dealt.mapInArrow(run, "depth long, ka long, kb long, ends_sha256 string")


def nodes(steps: DataFrame) -> DataFrame:
    """The trie of ``steps`` as rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``saved_tokens`` counts bytes: over the node's subtree, each node's conversations but one
    times the bytes of its last text. ``conv_id`` is the node's smallest conversation.
    """
    before, whole = carried(steps)
    whole = stage(whole)
    once = stage(collapsed(whole))
    # Paths of the weighted sequences only: keys of the prefixes, slice by slice.
    owners = once.select("conv_id", "weight", F.col("depth").alias("whole"))
    slices = stage(before.join(owners, "conv_id"))
    running = W.partitionBy(*SLICE).orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    path = steps.join(slices, SLICE).select(
        *SLICE, "depth", "bytes", "weight", "whole", "a", "b",
        *[F.col(f"c{c}").bitwiseXOR(F.expr(f"bit_xor({c})").over(running)).alias(f"k{c}") for c in "ab"],
    )
    path = stage(path.select(*SLICE, *KEY, "bytes", "weight", "whole", F.expr("ka ^ a").alias("pa"), F.expr("kb ^ b").alias("pb")))

    owner = F.min(F.struct("conv_id", "part", "bytes", "pa", "pb")).alias("o")
    found = path.groupBy(*KEY).agg(F.sum("weight").alias("n_convs"), owner)
    found = stage(found.select(*KEY, "n_convs", "o.*", ((F.col("n_convs") - 1) * F.col("o.bytes")).alias("cost")))

    inner = path.where("depth < whole").select(*KEY).distinct()
    leaves = once.join(inner, KEY, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    owned = found.groupBy("conv_id").agg(F.sum("cost").alias("owned"))
    each = once.select("conv_id").join(owned, "conv_id", "left").join(leaves, "conv_id", "left")
    each = slices.select(*SLICE).join(each.select("conv_id", F.coalesce("owned", F.lit(0)).alias("owned"), F.coalesce("leaf", F.lit(0)).alias("leaf")), "conv_id")
    through = path.select(*SLICE, *KEY).join(each, SLICE).groupBy(*KEY).agg(F.sum("owned").alias("owned"), F.sum("leaf").alias("n_leaves"))

    # What an owner has above a node, slice by slice.
    by_slice = found.groupBy(*SLICE).agg(F.sum("cost").alias("cost"))
    parts = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    by_slice = by_slice.select(*SLICE, F.coalesce(F.sum("cost").over(parts), F.lit(0)).alias("_carry"))
    inside = W.partitionBy(*SLICE).orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    above = F.col("_carry") + F.coalesce(F.sum("cost").over(inside), F.lit(0))
    listed = found.join(by_slice, SLICE).select(*KEY, "conv_id", "n_convs", "pa", "pb", above.alias("above"))

    children = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count("*").alias("n_children"))
    full = listed.join(through, KEY).join(children, KEY, "left").join(ends_hashes(whole), KEY, "left")
    parent = found.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    return full.join(parent, ["depth", "pa", "pb"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
        (F.col("owned") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
