"""The trie of conversation prefixes, by cutting depths in half, and totals of its subtrees.

A node of depth d stands for one sequence of d first turns. Sequences are cut at
half their depth: the prefix up to the cut gets a name, the upper half is a trie
over names, and the lower halves are a forest of tries that hang below the cut
names. Both halves are cut again in the same way, so after log2(depth) rounds
every prefix has a name, and all parts of a round are made at the same time.
Totals go the same way back: forests of one level are complete before they are
grafted on the nodes above their cut.

Names are SHA-256 digests of what they stand for, so equal prefixes get equal
names wherever they lie. No conversation, node or level is ever in one task as a
whole: long conversations are cut into stretches of ``STRETCH`` turns whose names
are the turns of the next round up, members of a node are laid out by range, and
totals are summed before they move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitflow.llm.common import by_batch, text_of
from admitflow.operators.totals import running_totals
from admitflow.session import cut_lineage

# Turns of one conversation that a task names at once.
STRETCH = 256
# Ids of one node's members that a row of the digest's input holds at most.
IDS = 4096
NO_IDS = hashlib.sha256(b"").hexdigest()


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id long, pos long, name binary, n_bytes long): each turn with its place in its conversation, from 0.

    Turns are ordered by ``turn``, null first; turns of equal number by the digest
    of role and text. Null roles and texts count as empty. Repeated rows are
    repeated turns. Rows without a ``conv_id`` belong to no conversation and are
    left out. Other columns are not read. Positions are running totals over
    ranges of (conversation, turn, digest), so a conversation of any length
    spreads over the tasks.
    """
    role, text = text_of("role"), text_of("text")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("name"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    counted = rows.groupBy("conv_id", "turn", "name", "n_bytes").agg(F.count(F.lit(1)).alias("_n"))
    laid_out = counted.repartitionByRange("conv_id", "turn", "name").withColumn("_range", F.spark_partition_id())
    placed = running_totals(cut_lineage(laid_out, "turns"), ["conv_id"], ["turn", "name"], ["_n"], "_range", inclusive=False)
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    return placed.withColumn("_copy", copies).select("conv_id", (F.col("_n_run") + F.col("_copy")).alias("pos"), "name", "n_bytes")


def opening_length(conv_id: Column) -> Column:
    """How many turns a conversation takes over: the crc32 of its decimal id, modulo 9."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(9))


def with_shared_openings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations in groups of five ids that begin alike, and (conv_id, length) of every conversation.

    Conversation c gets the first h turns of conversation c - c % 5 (all if there
    are fewer, none if it is absent) and then its own turns after its first h; h is
    ``opening_length(c)``, 8 at most. A conversation may come out without turns.
    """
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_own"))
    bases = sizes.select(F.col("conv_id").alias("_base"), F.col("_own").alias("_there"))
    convs = (
        sizes.withColumns({"_h": opening_length(F.col("conv_id")), "_base": F.col("conv_id") - F.col("conv_id") % 5})
        .join(bases, "_base", "left")
        .withColumn("_taken", F.least("_h", F.coalesce("_there", F.lit(0))))
        .select("conv_id", "_base", "_h", "_taken", (F.col("_taken") + F.greatest(F.col("_own") - F.col("_h"), F.lit(0))).alias("length"))
    )
    convs = cut_lineage(convs, "rebuilt-convs")
    head = turns.where("pos < 8").withColumnRenamed("conv_id", "_base")
    opening = head.join(convs, "_base").where("pos < _taken").select("conv_id", "pos", "name", "n_bytes")
    own = turns.join(convs, "conv_id").where("pos >= _h").select("conv_id", (F.col("pos") - F.col("_h") + F.col("_taken")).alias("pos"), "name", "n_bytes")
    return opening.unionByName(own), convs.select("conv_id", "length")


def _below(cut: Column, name: Column) -> Column:
    """The name of what lies below a cut, seen from above it. The first byte tells such names from those of turns."""
    return F.unhex(F.sha2(F.concat(F.unhex(F.lit("01")), cut, name), 256))


def halved(names: list[bytes]) -> list[bytes]:
    """Names of all prefixes of a stretch: its halves are named apart, then the lower one below the name of the upper one."""
    names, half = list(names), 1
    while half < len(names):
        for start in range(half, len(names), 2 * half):
            cut = b"\x01" + names[start - 1]
            for i in range(start, min(start + half, len(names))):
                names[i] = hashlib.sha256(cut + names[i]).digest()
        half *= 2
    return names


def prefix_names(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, name) with ``name`` standing for all turns up to ``pos`` instead of that one alone.

    Stretches are named by themselves; their whole names are a conversation
    ``STRETCH`` times shorter, named in the same way, below whose prefixes they go.
    """
    stretch = F.floor(F.col("pos") / STRETCH).alias("stretch")
    listed = turns.groupBy("conv_id", stretch).agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("turns"))

    def make():
        def step(c):
            return {k: c[k] for k in ("conv_id", "stretch")} | {"names": [halved([t["name"] for t in turns]) for turns in c["turns"]]}

        return step

    inside = cut_lineage(by_batch(listed, "conv_id long, stretch long, names array<binary>", make), "stretches")
    each = inside.select("conv_id", "stretch", F.posexplode("names").alias("_i", "name"))
    each = each.select("conv_id", "stretch", (F.col("stretch") * STRETCH + F.col("_i")).alias("pos"), "name")
    if inside.where("stretch > 0").isEmpty():
        return each.drop("stretch")
    whole = inside.select("conv_id", F.col("stretch").alias("pos"), F.element_at("names", -1).alias("name"))
    above = prefix_names(whole).select("conv_id", (F.col("pos") + 1).alias("stretch"), F.col("name").alias("_cut"))
    named = F.when(F.col("_cut").isNull(), F.col("name")).otherwise(_below(F.col("_cut"), F.col("name")))
    return each.join(above, ["conv_id", "stretch"], "left").select("conv_id", "pos", named.alias("name"))


def members(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes, and which node each conversation passes at each depth.

    Nodes: (conv_id, depth, n_convs, n_bytes); ``conv_id`` is the smallest member,
    which with the depth names the node. Paths: (conv_id, depth, node). The members
    of a node are laid out by range, so one with all conversations spreads over
    the tasks; one row per range and node is joined back.
    """
    prefixes = prefix_names(turns).join(turns.select("conv_id", "pos", "n_bytes"), ["conv_id", "pos"])
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("name"), F.lit(0).cast("long").alias("n_bytes"))
    rows = prefixes.select("conv_id", (F.col("pos") + 1).alias("depth"), "name", "n_bytes").unionByName(root)
    laid_out = rows.repartitionByRange("depth", "name", "conv_id").withColumn("_range", F.spark_partition_id())
    laid_out = cut_lineage(laid_out, "prefixes")
    parts = laid_out.groupBy("depth", "name", "_range").agg(
        F.min("conv_id").alias("_least"), F.count(F.lit(1)).alias("_n"), F.max("n_bytes").alias("_bytes")
    )
    parts = cut_lineage(parts, "prefix-parts")
    nodes = parts.groupBy("depth", "name").agg(F.min("_least").alias("node"), F.sum("_n").alias("n_convs"), F.max("_bytes").alias("n_bytes"))
    of_part = parts.select("depth", "name", "_range").join(nodes.select("depth", "name", "node"), ["depth", "name"])
    paths = laid_out.join(of_part, ["depth", "name", "_range"]).select("conv_id", "depth", "node")
    return (
        cut_lineage(nodes.select(F.col("node").alias("conv_id"), "depth", "n_convs", "n_bytes"), "nodes"),
        cut_lineage(paths, "paths"),
    )


def with_parents(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Add ``parent_conv_id``: the node that the smallest member passes one turn earlier; null for the root."""
    up = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent_conv_id"))
    return nodes.join(up, ["conv_id", "depth"], "left")


def subtree_totals(values: DataFrame, paths: DataFrame, sums: list[str]) -> DataFrame:
    """Sums over each node's subtree, from (conv_id, depth, parent_conv_id, *sums) with each node's own values.

    In round k the nodes at odd multiples of 2^k are the roots of the lower
    forests: their totals already cover the 2^k depths below. They are summed by
    parent and grafted on the 2^k nodes that lie above it on the parent's path. A
    round moves at most as many rows as there are turns; there are log2(depth).
    """
    totals = values
    deepest = values.agg(F.max("depth")).first()[0] or 0
    for k in range(int(deepest).bit_length()):
        half = 1 << k
        lower = totals.where(F.col("depth") % (2 * half) == half)
        grafts = lower.groupBy(F.col("parent_conv_id").alias("conv_id"), "depth").agg(*(F.sum(c).alias(c) for c in sums))
        above = F.explode(F.sequence(F.col("depth") - half, F.col("depth") - 1))
        onto = grafts.select("conv_id", above.alias("depth"), *sums).join(paths, ["conv_id", "depth"])
        onto = onto.groupBy(F.col("node").alias("conv_id"), "depth").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
        grown = {c: F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0)) for c in sums}
        totals = totals.join(onto, ["conv_id", "depth"], "left").withColumns(grown).select(*values.columns)
        totals = cut_lineage(totals, f"grafted-{k}")
    return totals


def digests_of_ids(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) from (conv_id, depth, member): SHA-256 of the members' decimal ids, ascending, comma-joined.

    Ids are first joined in stretches of at most ``IDS``. A digest is by definition
    one pass over its text; the last step streams the stretches in order and holds
    one at a time.
    """
    stretch = F.floor(F.col("member") / IDS).alias("stretch")
    listed = ends.groupBy("conv_id", "depth", stretch).agg(F.sort_array(F.collect_list("member")).alias("ids"))
    listed = listed.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))
    ordered = listed.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "stretch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            keys, hashes = [], []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids"))):
                if key == at:
                    digest.update(b",")
                elif at is not None:
                    keys.append(at)
                    hashes.append(digest.hexdigest())
                if key != at:
                    at, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            yield pack(keys, hashes)
        if at is not None:
            yield pack([at], [digest.hexdigest()])

    def pack(keys: list[list[int]], hashes: list[str]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string())
        columns = ([k[0] for k in keys], [k[1] for k in keys], hashes)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["conv_id", "depth", "ends_sha256"])

    return ordered.mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of the given sequences; an empty table of conversations has no root.

    ``turns``: (conv_id, pos, name, n_bytes) as of ``turns_in_order``; ``convs``:
    (conv_id, length) of every conversation, those without turns too. Columns:
    conv_id (the smallest member), depth, parent_conv_id, n_convs (members),
    n_children, n_leaves and saved_tokens (over the subtree: childless nodes, and
    bytes of each node's last text times its members but one), ends_sha256 (of the
    ids that end at the node).
    """
    nodes, paths = members(turns, convs)
    nodes = cut_lineage(with_parents(nodes, paths), "nodes-parents")
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    own = nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = own.withColumns(
        {"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes")}
    )
    totals = subtree_totals(cut_lineage(own, "own-values"), paths, ["n_leaves", "saved_tokens"])
    last = convs.select("conv_id", F.col("length").alias("depth"))
    ends = paths.join(last, ["conv_id", "depth"]).select(F.col("node").alias("conv_id"), "depth", F.col("conv_id").alias("member"))
    done = totals.join(digests_of_ids(ends), ["conv_id", "depth"], "left")
    return done.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"),
    )
