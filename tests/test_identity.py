"""Records replayed in rounds over the cluster against one after another."""

from __future__ import annotations

import random

import pandas as pd
import pytest

from marquetry.operators import identity
from marquetry.store import cut

SCHEMA = "seq long, media_kind string, pos int, source string, source_id string"
SOURCES = ("anilist", "jikan", "kitsu", "tvmaze")


def graph(seed, n, names, most=3, unlike=False):
    """Records with ids that few names make meet again and again."""
    rng, rows = random.Random(seed), []
    for seq in range(n):
        picked = [(rng.choice(SOURCES), str(rng.randrange(names))) for _ in range(rng.randint(1, most))]
        picked = list(dict.fromkeys(picked))
        rows += [(seq * 3, "anime" if not unlike or rng.random() < 0.8 else "manga", pos, s, i) for pos, (s, i) in enumerate(picked)]
    return rows


def plain(rows):
    df = pd.DataFrame(rows, columns=["seq", "media_kind", "pos", "source", "source_id"])
    return sorted((int(r.seq), None if pd.isna(r.media_id) else int(r.media_id), r.status) for r in identity._replay(df).itertuples())


def rounds_of(spark, rows, **more):
    df = cut(spark.createDataFrame(rows, SCHEMA).repartition(3))
    out = identity.in_rounds(df.join(identity.components(df), "seq"), **more)
    return sorted((tuple(r) for r in out.collect()), key=lambda r: r[0])


@pytest.mark.parametrize(("seed", "n", "names", "most"), [(1, 60, 12, 3), (2, 80, 40, 2), (3, 40, 3, 4)])
def test_random_graphs(spark, seed, n, names, most):
    rows = graph(seed, n, names, most)
    assert rounds_of(spark, rows) == plain(rows)


def test_an_id_that_all_share(spark):
    """One component around a hot id takes as many rounds as there are sources, not as there are records."""
    rng, rows = random.Random(7), []
    for seq in range(3000):
        rows.append((seq, "anime", 0, "imdb", "unknown"))
        if seq % 3:
            rows.append((seq, "anime", 1, rng.choice(SOURCES), str(rng.randrange(40))))
    assert rounds_of(spark, rows, rounds=9) == plain(rows)


def test_long_chains_are_ended_by_tasks(spark):
    """Each record depends on the one before: after the rounds the rest is replayed with what is owned by then."""
    rows = []
    for seq in range(60):
        rows += [(seq, "anime", 0, ("anilist", "jikan")[seq % 2], f"x{seq // 2}"), (seq, "anime", 1, ("jikan", "anilist")[seq % 2], f"x{(seq + 1) // 2}")]
    assert rounds_of(spark, rows, rounds=3) == plain(rows)


def test_large_components_go_in_rounds(spark, monkeypatch):
    rows = graph(9, 50, 30, 2, unlike=True)
    df = cut(spark.createDataFrame(rows, SCHEMA))
    one = sorted(tuple(r) for r in identity.replay(df, identity.components(df)).select("seq", "status").collect())
    monkeypatch.setattr(identity, "SMALL", 3)
    two = sorted(tuple(r) for r in identity.replay(df, identity.components(df)).select("seq", "status").collect())
    assert one == two


def test_records_that_meet_nobody(spark):
    """`placed` looks together only at records that share an id or have two of a source."""
    rows = [(1, "anime", 0, "imdb", "a"), (2, "manga", 0, "imdb", "a"), (3, "anime", 0, "imdb", "b"), (3, "anime", 1, "imdb", "c"), (4, "anime", 0, "kitsu", "d"), (5, "anime", 0, "kitsu", "d")]
    got = sorted(tuple(r) for r in identity.placed(spark.createDataFrame(rows, SCHEMA)).select("seq", "media_id", "status").collect())
    assert got == [(1, 1, "inserted"), (2, 2, "inserted"), (3, None, "duplicate_source"), (4, 4, "inserted"), (5, 4, "updated")]


def test_small_components_share_a_task(spark):
    """Many components are replayed in one pass of a task, over batches that end within them; none is a call of its own."""
    rows, per_batch = [], spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in range(40):
        rows += [(k * 300 + seq, kind, pos, s, f"{k}-{i}") for seq, kind, pos, s, i in graph(k, 30, 8, 3, unlike=True)]
    df = cut(spark.createDataFrame(rows, SCHEMA).repartition(3))
    out = identity.replay(df, cut(identity.components(df)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
    try:
        for n in ("1", "7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            assert sorted((tuple(r) for r in out.select("seq", "media_id", "status").collect()), key=lambda r: r[0]) == plain(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", per_batch)


def test_components_need_few_rounds(spark):
    """Pointers jump to their ends within a round, so a chain of any length is one round; ids without a kind meet as others do."""
    chain = [(seq, "anime", pos, "imdb", str(seq + pos)) for seq in range(300) for pos in (0, 1)]
    rows = [*chain, (900, None, 0, "imdb", "x"), (901, None, 0, "imdb", "x"), (902, None, 0, "imdb", "y"), (903, "anime", 0, None, None), (904, "anime", 0, None, None)]
    got = {r["seq"]: r["component"] for r in identity.components(spark.createDataFrame(rows, SCHEMA), max_rounds=2).collect()}
    assert got == {seq: 0 for seq in range(300)} | {900: 900, 901: 900, 902: 902, 903: 903, 904: 903}
    with pytest.raises(RuntimeError):
        identity.components(spark.createDataFrame(rows, SCHEMA), max_rounds=0)
