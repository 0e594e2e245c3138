"""A prefix trie of conversations, from mergeable partial tries.

A turn becomes the MD5 of its role and text, and its words. Rows are sorted by conversation and turn over ranges, so that a conversation
of any length is spread over tasks, and a running polynomial hash (127 bits) names each prefix; what a range lacks of a
conversation that began in an earlier one is a number and a hash, put in afterwards. Tasks combine their prefixes to partial node tables,
which are merged by hash in two steps: members are summed, the smallest one wins, and the lists of conversations that end at a node
are joined in pieces by ranges of ids.

A node is known by its smallest member and depth, and that member's own path holds all its ancestors. So the rollup goes up by
doubling: after round k a node holds the sums of all nodes less than 2^k below it, and sends them 2^k up; a trie of
depth d takes log2(d) rounds, and no row is joined by a hot key.

Defined results: a null role or text is empty, a null turn comes first, rows of one turn number come in order of the hash of role and text, and each
is a turn; rows without a conv_id belong to no conversation and are left out; an empty table has no nodes, not even a root;
texts are taken whole; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, drop, staged, tidied

#: The modulus and base of the polynomial hash.
PRIME = (1 << 127) - 1
BASE = 0x6C62272E07BB014262B821756295C58D % PRIME
ROOT = bytes(16)
#: Nodes that a task gathers before it gives them out; partial tables are merged within so many groups first.
LOCAL, GROUPS = 200_000, 32
#: Ids of a piece of an end list lie in a range of 2^PIECE.
PIECE = 12


def turn_keys(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, key, words``: what the trie needs of a turn; texts go no further."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.where(F.col("conv_id").isNotNull())
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, key, words, prefix`` of ``conv_id, turn, key, words``: the place of each turn from 1, and the hash of all up to it. Staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, pos, value, power = None, 0, 0, 1
        for b in batches:
            at, hashes = [], []
            for own, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if own != conv:
                    conv, pos, value, power = own, 0, 0, 1
                pos, power = pos + 1, power * BASE % PRIME
                value = (value + (int.from_bytes(key, "big") + 1) * power) % PRIME
                at.append(pos)
                hashes.append(value.to_bytes(16, "big"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.int64()), b.column(1), b.column(2), pa.array(hashes, pa.binary()), b.column(3)], ["conv_id", "pos", "key", "words", "prefix", "part"])

    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key")]
    sorted_ = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "key", "words", F.spark_partition_id().alias("part"))
    parts = staged(sorted_.mapInArrow(tidied(run), "conv_id long, pos long, key binary, words long, prefix binary, part int"), "trie-ranges")
    late = _begun_before(parts)
    if not late:
        return parts.drop("part")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, hashes = [], []
            for conv, pos, prefix, part in zip(*(b.column(i).to_pylist() for i in (0, 1, 4, 5)), strict=True):
                n, value = late.get((conv, part), (0, 0))
                at.append(n + pos)
                hashes.append(((value + pow(BASE, n, PRIME) * int.from_bytes(prefix, "big")) % PRIME).to_bytes(16, "big") if n else prefix)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.int64()), b.column(2), b.column(3), pa.array(hashes, pa.binary())], ["conv_id", "pos", "key", "words", "prefix"])

    out = staged(parts.mapInArrow(tidied(settle), "conv_id long, pos long, key binary, words long, prefix binary"), "trie-prefixes")
    drop(parts)
    return out


def _begun_before(parts: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    """Of each range whose first conversation began in an earlier one: the turns before, and their hash. A few entries a range at most."""
    spans = parts.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last")).orderBy("part").collect()
    split = sorted({b["first"] for a, b in zip(spans, spans[1:]) if a["last"] == b["first"]})
    if not split:
        return {}
    names = parts.sparkSession.createDataFrame([(x,) for x in split], "conv_id long")
    ends = parts.join(F.broadcast(names), "conv_id").groupBy("conv_id", "part").agg(F.max("pos").alias("pos"), F.max_by("prefix", "pos").alias("prefix"))
    out: dict[tuple[int, int], tuple[int, int]] = {}
    conv, n, value = None, 0, 0
    for r in ends.orderBy("conv_id", "part").collect():
        if r["conv_id"] != conv:
            conv, n, value = r["conv_id"], 0, 0
        if n:
            out[conv, r["part"]] = (n, value)
        value = (value + pow(BASE, n, PRIME) * int.from_bytes(r["prefix"], "big")) % PRIME
        n += r["pos"]
    return out


def partial_tries(paths: DataFrame) -> DataFrame:
    """``prefix, depth, n_convs, conv_id, words``: the nodes of each task's rows, combined."""
    names = ["prefix", "depth", "n_convs", "conv_id", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def given() -> pa.RecordBatch:
            out = [pa.array(held, pa.binary()), *[pa.array([x[i] for x in held.values()], pa.int64()) for i in range(4)]]
            held.clear()
            return pa.RecordBatch.from_arrays(out, names)

        for b in batches:
            for conv, depth, words, prefix in zip(*(c.to_pylist() for c in b.columns), strict=True):
                node = held.setdefault(prefix, [depth, 0, conv, words])
                node[1] += 1
                node[2] = min(node[2], conv)
            if len(held) >= LOCAL:
                yield given()
        yield given()

    return paths.select("conv_id", "pos", "words", "prefix").mapInArrow(tidied(run), "prefix binary, depth long, n_convs long, conv_id long, words long")


def merged(tables: DataFrame) -> DataFrame:
    """One row for each node: partial tables meet within groups of tasks first, then all of them."""
    sums = (F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"))
    near = tables.withColumn("near", F.spark_partition_id() % GROUPS).groupBy("prefix", "depth", "near").agg(*sums)
    return near.groupBy("prefix", "depth").agg(*sums)


def end_hashes(ends: DataFrame) -> DataFrame:
    """``prefix, ends_sha256`` of ``prefix, conv_id``: the hash of a node's ids in order, joined by commas.

    Ids meet in pieces of bounded ranges; a node's pieces then pass through one task in order, as the hash asks for, and aren't held.
    """
    piece = F.shiftright("conv_id", PIECE).alias("piece")
    pieces = ends.groupBy("prefix", piece).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, hashlib.sha256()
        for b in batches:
            prefixes_, hashes = [], []
            for prefix, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if prefix != now:
                    if now is not None:
                        prefixes_.append(now)
                        hashes.append(sha.hexdigest())
                    now, sha = prefix, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(",".join(map(str, ids)).encode())
            yield pa.RecordBatch.from_arrays([pa.array(prefixes_, pa.binary()), pa.array(hashes, pa.string())], ["prefix", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()])], ["prefix", "ends_sha256"])

    ordered = pieces.repartition("prefix").sortWithinPartitions("prefix", "piece").select("prefix", "ids")
    return ordered.mapInArrow(tidied(run), "prefix binary, ends_sha256 string")


def _rolled_up(nodes: DataFrame, steps: DataFrame, root: int, height: int) -> DataFrame:
    """``conv_id, depth, n_leaves, saved_tokens`` summed over subtrees; ``steps`` has the owner of each conversation's node at each depth."""
    state = nodes.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    state, step = staged(state, "trie-sums"), 1
    sums = (F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    while step <= height:
        top = state.where(F.col("depth") == step).select(F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), "n_leaves", "saved_tokens")
        sent = state.where(F.col("depth") > step).withColumn("depth", F.col("depth") - step).join(steps, ["conv_id", "depth"])
        sent = sent.select(F.col("owner").alias("conv_id"), "depth", "n_leaves", "saved_tokens")
        state, old = staged(state.unionByName(top).unionByName(sent).groupBy("conv_id", "depth").agg(*sums), "trie-sums"), state
        drop(old)
        step *= 2
    return state


def trie(turns: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """A row for each node of ``conv_id, turn, key, words``; ``members`` has the ids of all conversations, those without turns too.

    ``conv_id`` (the smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    """
    paths = prefixes(turns)
    last = paths.groupBy("conv_id").agg(F.max("pos").alias("depth"), F.max_by("prefix", "pos").alias("prefix"))
    if members is not None:
        last = members.select("conv_id").distinct().join(last, "conv_id", "left")
    last = staged(last.select("conv_id", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("prefix", F.lit(ROOT)).alias("prefix")), "trie-ends")
    n, root, height = last.agg(F.count(F.lit(1)), F.min("conv_id"), F.max("depth")).first()
    spark = turns.sparkSession
    top = spark.createDataFrame([(ROOT, 0, n, root, 0)] if n else [], "prefix binary, depth long, n_convs long, conv_id long, words long")
    found = staged(merged(partial_tries(paths)), "trie-nodes")
    owners = found.select("prefix", F.col("conv_id").alias("owner"))
    steps = staged(paths.select("conv_id", F.col("pos").alias("depth"), "prefix").join(owners, "prefix").select("conv_id", "depth", "owner"), "trie-steps")
    above = steps.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent_conv_id"))
    parent = F.when(F.col("depth") == 1, F.lit(root)).otherwise(F.col("parent_conv_id")).alias("parent_conv_id")
    nodes = found.unionByName(top).join(above, ["conv_id", "depth"], "left").select("prefix", "conv_id", "depth", parent, "n_convs", "words")
    nodes = staged(nodes, "trie-parents")
    children = nodes.where(F.col("depth") > 0).groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = staged(nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-children")
    sums = _rolled_up(nodes, steps, root, height or 0)
    ends = end_hashes(last.select("prefix", "conv_id"))
    out = nodes.join(sums, ["conv_id", "depth"]).join(ends, "prefix", "left")
    sha = F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha.alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """`trie` of ``conv_id, turn, role, text`` as they are."""
    return trie(turn_keys(conversations))


def heads_shared(conversations: DataFrame, block: int, most: int, heads: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the heads of others: turns for `trie`, and the ids of all conversations.

    A conversation takes its first ``heads`` turns (a column of ``conv_id``, at most ``most``) from the one whose id is its own less the
    remainder by ``block``, which is rounded towards zero for ids below zero.
    """
    placed = prefixes(turn_keys(conversations)).select("conv_id", "pos", "key", "words")
    base = F.col("conv_id") - F.col("conv_id") % block
    sizes = staged(placed.groupBy("conv_id").agg(F.max("pos").alias("n")), "trie-sizes")
    of_base = sizes.where(base == F.col("conv_id")).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = sizes.select("conv_id", base.alias("base"), heads.alias("h")).join(of_base, "base", "left")
    convs = staged(convs.withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))), "trie-convs")
    first = placed.where((F.col("pos") <= most) & (base == F.col("conv_id"))).withColumnRenamed("conv_id", "base")
    first = first.join(convs.select("conv_id", "base", "h"), "base").where(F.col("pos") <= F.col("h")).select("conv_id", F.col("pos").alias("turn"), "key", "words")
    own = placed.where(F.col("pos") > heads).join(convs.select("conv_id", (F.col("taken") - F.col("h")).alias("moved")), "conv_id")
    own = own.select("conv_id", (F.col("pos") + F.col("moved")).alias("turn"), "key", "words")
    return first.unionByName(own), sizes.select("conv_id")
