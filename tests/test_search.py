from __future__ import annotations

import math

import pytest

from marquetry.operators import search as S

ROWS = [
    (1, "anime", "TV", "Monster", ["Naoki Urasawa's Monster"], "A surgeon hunts a serial killer across Europe"),
    (2, "show", None, "The Office", [], "Paper"),
    (3, "movie", "movie", "The Office Space", [], None),
    (4, "show", None, "Dark", [], "time"),
    (5, "movie", None, "Dark City", [], "night"),
    (6, "anime", "MOVIE", "Mönster II", [], "m"),
]


@pytest.fixture(scope="module")
def media(spark):
    return spark.createDataFrame(ROWS, "media_id long, media_kind string, format string, title_display string, aliases array<string>, synopsis string").cache()


def ids(df):
    return [r["media_id"] for r in df.collect()]


@pytest.mark.parametrize(
    ("query", "options", "want"),
    [
        ("serial killer europe", S.SearchOptions(limit=10, media_kind="anime"), [1]),
        ("office", S.SearchOptions(media_kind="movie"), [3]),
        ("office", S.SearchOptions(media_kind="show"), [2]),
        ("dark", S.SearchOptions(), [4, 5]),
        ("Mönster", S.SearchOptions(format="tv"), [1]),
        ("monster", S.SearchOptions(format="movie"), [6]),
        ("m", S.SearchOptions(), [6]),
        ("dark", S.SearchOptions(limit=0), [4]),
        ("dark", S.SearchOptions(offset=1), [5]),
        ("dark nothing", S.SearchOptions(), []),
    ],
)
def test_search(media, query, options, want):
    assert ids(S.search(media, query, options)) == want


def test_empty_query(media):
    with pytest.raises(S.EmptyQuery):
        S.search(media, "  !!! ")


def test_expression():
    assert S.match_expression("Serial killer x") == "serial* killer* x"


def test_score_by_hand(media):
    n, avg = 6, (1 + 3 + 8 + 3 + 3 + 2 + 3 + 3) / 6
    got = {r["media_id"]: r["score"] for r in S.bm25(media, "dark").collect()}
    idf = math.log((n - 2 + 0.5) / 2.5)
    dl = {4: 2, 5: 3}
    avg = sum(len(t.split()) for t in ("Monster Naoki Urasawa s Monster A surgeon hunts a serial killer across Europe", "The Office Paper", "The Office Space", "Dark time", "Dark City night", "Monster II m")) / n
    for k, d in dl.items():
        assert got[k] == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * d / avg)))


def test_postings_agree(media):
    a = {r["media_id"]: round(r["score"], 12) for r in S.bm25(media, "dark").collect()}
    b = {r["media_id"]: round(r["score"], 12) for r in S.bm25_from_postings(S.postings(media), S.postings_stats(media), "dark").collect()}
    assert a == b


def test_tokens_are_counted_without_a_shuffle(spark, media, tmp_path):
    """Rows of one key count together, null keys too; with keys of their own no token moves."""
    plan = S.postings(media)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    rows = spark.createDataFrame([*ROWS, (4, "show", None, "dark DARK night", [], None), (None, "show", None, "a b a", [], ""), (None, "x", None, "b", [], None), (9, "x", None, None, [], "?")], media.schema)
    want: dict[tuple, int] = {}
    for r in S.index_rows(rows).select("media_id", "_tokens").collect():
        for x in r["_tokens"]:
            want[r["media_id"], x] = want.get((r["media_id"], x), 0) + 1
    got = S.postings(rows).collect()
    assert len(got) == len(want) and {(r["media_id"], r["token"]): r["tf"] for r in got} == want
    assert {r["dl"] for r in got if r["media_id"] == 1} == {13} and {r["dl"] for r in got if r["media_id"] == 4} <= {2, 3}


def test_stored_index_is_made_without_shuffling_its_directory(spark, media):
    """The directory of postings that lie in order has the greatest ratio of each block, and terms count rows by prefix."""
    from marquetry.operators import blocks
    from marquetry.store import cut

    rows = cut(blocks.tokenised(media))
    plain = blocks.build(rows)
    index = blocks.build(rows, stored=lambda p: cut(p.repartitionByRange(2, "token", "block").sortWithinPartitions("token", "block")))
    assert "Exchange" not in index.directory._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    greatest = lambda d: {(r[0], r[1]): (round(r[2], 12), r[3]) for r in d.groupBy("token", "block").agg({"ratio": "max", "n": "sum"}).select("token", "block", "max(ratio)", "sum(n)").collect()}
    assert greatest(index.directory) == greatest(plain.directory)
    want: dict[str, int] = {}
    for r in rows.select("_tokens").collect():
        for t in {x[:i] for x in r[0] for i in range(2, min(len(x), 12) + 1)} | {x for x in r[0] if len(x) == 1}:
            want[t] = want.get(t, 0) + 1
    assert {r["term"]: r["n"] for r in index.terms.collect()} == want


def test_filtered_page_reads_only_blocks_with_passing_rows(spark, monkeypatch):
    """Rows that pass are few and in blocks of lower bounds: the first blocks must hold enough of them, so that others are left out."""
    from marquetry.operators import blocks

    rows = [(i * 1024, "a", "rare" if i % 25 == 24 else "often", ["dark"] * (1 + i % 40) + ["x"] * (40 - i % 40)) for i in range(1000)]
    index = blocks.build(spark.createDataFrame(rows, "media_id long, media_kind string, format string, _tokens array<string>"))
    read, ranked = [], blocks._ranked
    monkeypatch.setattr(blocks, "_ranked", lambda i, t, a, r, b: read.append(b if isinstance(b, list) else [x[0] for x in b.select("block").collect()]) or ranked(i, t, a, r, b))
    got = ids(blocks.search(index, "dark", S.SearchOptions(limit=3, format="RARE")))
    tf = {r[0]: r[3].count("dark") for r in rows if r[2] == "rare"}
    assert got == sorted(tf, key=lambda k: (-tf[k], k))[:3]
    assert sum(map(len, read)) <= len(tf)


def test_index_of_dealt_rows_is_made_where_they_are_read(spark):
    """Postings and directory of rows that lie by ranges of ids move nothing, and are those of the plain index."""
    import random

    from pyspark.sql import functions as F

    from marquetry.operators import blocks
    from marquetry.store import cut

    rng, words = random.Random(3), ["the", "then", "\u00e9t\u00e9", "\U0001d51e\U0001d51f", "a", "abcdefghijklmnop", "abcdefghijklmxyz"]
    rows = [(i * 37 - 4000, "a", None, [rng.choice(words) for _ in range(rng.choice((0, 1, 5, 60)))]) for i in range(400)]
    df = spark.createDataFrame(rows, "media_id long, media_kind string, format string, _tokens array<string>").withColumn("_dl", F.size("_tokens"))
    lying = cut(blocks.dealt(df))
    index, plain = blocks.build(lying, near=True), blocks.build(df)
    for t in (index.postings, index.directory):
        plan = t._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
        assert "Exchange" not in plan and "MapInArrow" in plan
    columns = ["token", "media_id", "tf", "dl", "block"]
    assert sorted(map(tuple, index.postings.select(columns).collect())) == sorted(map(tuple, plain.postings.select(columns).collect()))
    greatest = lambda d: {(r[0], r[1]): (round(r[2], 12), r[3]) for r in d.groupBy("token", "block").agg({"ratio": "max", "n": "sum"}).select("token", "block", "max(ratio)", "sum(n)").collect()}
    assert greatest(index.directory) == greatest(plain.directory)
    # The 400 rows are of 15 ranges, each in one batch, so no block is named twice.
    assert index.directory.count() == plain.directory.count()
    want: dict[str, int] = {}
    for r in rows:
        for t in {x[:i] for x in r[3] for i in range(2, min(len(x), 12) + 1)} | {x for x in r[3] if len(x) == 1}:
            want[t] = want.get(t, 0) + 1
    assert {r["term"]: r["n"] for r in index.terms.collect()} == want


def test_packed_rows_have_the_tokens_of_spark(spark, monkeypatch):
    """Words that tasks tell are those of Spark's expressions in every script, rows are packed in pieces, and the index of these is the plain one."""
    from pyspark.sql import functions as F

    from marquetry.functions.scalars import word_text
    from marquetry.operators import blocks
    from marquetry.store import cut

    plain = [chr(c) for c in (*range(1, 0x250), *range(0x2000, 0x2070))]
    texts = [None, "", " - ", "\n\n", "a\nb\tc", "L'Été à Zürich—naïve’s", "İstanbul İx été ǡ", "Οδός 漢字 हिन مَدُ", "\U0001d51e\U0001d51f \U0001f600 x²½ ªº µm straße", "�­ x‍y"]
    texts += ["".join(plain), " ".join(plain), *["a" + c + "b" + c + "é" for c in plain], *[f"漢{c}z{c}" for c in plain]]
    rows = [(i * 31 - 900, "a", None, t, [t, None, "Alias É"] if i % 3 else None, t if i % 2 else None) for i, t in enumerate(texts)]
    media = spark.createDataFrame(rows, "media_id long, media_kind string, format string, title_display string, aliases array<string>, synopsis string")
    one = media.select("media_id", S.tokens(F.col("title_display")).alias("t"), word_text(F.col("title_display")).alias("w")).orderBy("media_id").collect()
    row, words = S.words_of([r["w"] for r in one])
    got: list[list[str]] = [[] for _ in one]
    for i, w in zip(row, words.to_pylist(), strict=True):
        got[i].append(w)
    assert got == [r["t"] for r in one]
    monkeypatch.setattr(blocks, "PACKED", 500)
    lists = cut(blocks.packed(blocks.worded(blocks.dealt(media))))
    assert lists.count() > 16
    index, want = blocks.build(lists, near=True), blocks.build(cut(blocks.tokenised(media)))
    for name in ("postings", "rows", "terms", "totals"):
        a, b = getattr(index, name), getattr(want, name)
        assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect())), name
    greatest = lambda d: {(r[0], r[1]): (round(r[2], 12), r[3]) for r in d.groupBy("token", "block").agg({"ratio": "max", "n": "sum"}).select("token", "block", "max(ratio)", "sum(n)").collect()}
    assert greatest(index.directory) == greatest(want.directory)
    assert {r["term"]: r["n"] for r in blocks.counted(lists.limit(0)).collect()} == {}
