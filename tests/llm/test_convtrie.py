"""The prefix trie of conversations against a plain one."""

from __future__ import annotations

import hashlib
import os
import random
from collections import defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from marquetry.llm import convtrie
from marquetry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def key(role, text):
    return hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()


def conversations(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            out[conv].append((turn is not None, turn or 0, key(role, text), (role or "", text or "")))
    return {c: [x[3] for x in sorted(t)] for c, t in out.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))  # as SQL does it
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def plain(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    below = defaultdict(list)
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    children = {p: sum(len(x) == len(p) + 1 for x in below[p]) for p in members}
    saved = {p: (len(m) - 1) * (len(p[-1][1].encode().split()) if p else 0) for p, m in members.items()}
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        leaves = sum(not children[x] for x in below[p])
        out.append((min(m), len(p), parent, len(m), children[p], leaves, sum(saved[x] for x in below[p]), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def random_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        size = rng.choice((0, 1, 2, 3, 4, 4, 9))
        rows += [(c, t, rng.choice(("user", "assistant")), rng.choice(("hi", "hi there", "no more words", ""))) for t in range(size)]
    rng.shuffle(rows)
    return rows


ODD = [
    *[(c, t, "user", f"text number {t}") for c in (5, 6, 7) for t in range(4)],
    (8, None, None, None),
    (8, None, "user", "second of none"),
    (8, 3, "user", "same turn a"),
    (8, 3, "user", "same turn b"),
    (8, 3, "user", "same turn b"),
    (None, 1, "user", "no conversation"),
    (20, 0, "", ""),
    (21, 0, None, ""),
    (22, 0, "a", "b"),
    (23, 0, "ab", ""),
    (24, 0, "", "ab"),
    (25, -5, "user", "x" * 200_000),
    (-7, 0, "user", "below zero"),
    (2**40, 0, "user", "far away"),
    *[(31, t, "user", "again") for t in range(300)],
    *[(33, t, "user", "again") for t in range(301)],
    *[(34, t, "user", "again" if t != 150 else "else") for t in range(300)],
    *random_rows(3, 60),
]


def frame(spark, rows, parts=5):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clash = ("key", "pos", "words", "prefix", "part", "depth", "base", "h", "owner", "n")
    return df.select("*", *[F.lit("clash").alias(c) for c in clash]).repartition(parts)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_as_they_are(spark):
    assert rows_of(convtrie.conversation_trie(frame(spark, ODD))) == plain(conversations(ODD))


def test_rebuilt(spark):
    turns, members = convtrie.heads_shared(frame(spark, ODD), 20, 3, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4)
    assert rows_of(convtrie.trie(turns, members)) == plain(rebuilt(conversations(ODD)))


def test_one_conversation_over_many_ranges(spark):
    rows = [(1, t, "user", f"t{t}") for t in range(700)] + [(2, t, "user", f"t{t}") for t in range(650)] + [(0, 0, "user", "t0")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = convtrie.prefixes(convtrie.turn_keys(frame(spark, rows, 7)))
        assert [tuple(r) for r in placed.groupBy("conv_id").agg(F.max("pos"), F.countDistinct("pos")).orderBy("conv_id").collect()] == [(0, 1, 1), (1, 700, 700), (2, 650, 650)]
        assert placed.select("prefix").distinct().count() == 700
        got = rows_of(convtrie.conversation_trie(frame(spark, rows, 7)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain(conversations(rows))


def test_end_lists_in_pieces(spark):
    """Ids of a node in order of numbers, over several pieces."""
    ids = [*range(0, 20_000, 3), -1, -5000, 10**12]
    df = spark.createDataFrame([(bytes(16), i) for i in ids], "prefix binary, conv_id long").repartition(6)
    got = convtrie.end_hashes(df).collect()
    assert [r["ends_sha256"] for r in got] == [hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()]


def test_empty(spark):
    assert convtrie.conversation_trie(frame(spark, [], 1)).count() == 0


def test_query(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op13_prefix_trie"](spark, SF)) == plain(rebuilt(conversations(rows)))
