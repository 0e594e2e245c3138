from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marquetry.functions import scalars as S
from marquetry.functions import scoring


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("value", "want"),
    [("Naoki Urasawa's MÖNSTER-2!", "naoki urasawa s mÖnster 2"), ("  ", ""), (None, None), ("a　b", "a b")],
)
def test_normalize_for_lookup(spark, value, want):
    assert one(spark, value, S.normalize_for_lookup) == want


@pytest.mark.parametrize(
    ("fn", "value", "want"),
    [
        (S.strip_html, "<p>a<br>b <b>c</b></p>", "a\nb c"),
        (S.strip_html, "<P>a</P>", "<P>a</P>"),
        (S.year_of, "2008-01-20", 2008),
        (S.year_of, "bad", None),
        (S.year_of, None, None),
        (S.marked_int, "\\N", None),
        (S.marked_int, "", None),
        (S.marked_int, "12x", None),
        (S.marked_int, "12", 12),
        (S.payload_hash, '{"é":1}', "8"),
        (S.parse_kind, "ANIME", "anime"),
        (S.title_type_kind, "tvMovie", "movie"),
        (S.title_type_kind, "tvSpecial", "show"),
        (S.title_type_kind, "tvEpisode", None),
        (S.lower_ascii, "ÀB", "Àb"),
        (S.upper_ascii, "àb", "àB"),
        (S.trim_space, "\t x  ", "x"),
        (S.fold, "MÖnster", "monster"),
        (S.first_search_token, "a of Dark City", "Dark"),
        (S.first_search_token, "a b", "a b"),
        (S.adult_rating, "R+ - Mild Nudity", True),
        (S.adult_rating, None, False),
    ],
)
def test_scalar(spark, fn, value, want):
    assert one(spark, value, fn) == want


@pytest.mark.parametrize("value", ["tvshow", "film", "Anime"])
def test_unknown_kinds_are_errors(spark, value):
    with pytest.raises(Exception, match="unknown media kind"):
        one(spark, value, S.parse_kind)


@pytest.mark.parametrize(("value", "want"), [("{}", True), ("[1,2]", True), ("null", True), ("1", True), ("1,2", False), ("", False), ("{", False), ('{"a":1}}', False), (None, False)])
def test_is_json(spark, value, want):
    assert one(spark, value, S.is_json) is want


def test_normalize_aliases(spark):
    assert one(spark, [" A ", "a", "", "B"], S.normalize_aliases, "array<string>") == ["A", "B"]


def test_scores_of_two_records(spark):
    """Scores of a record with all five parts, by hand."""
    row = spark.createDataFrame([("anilist", "Monster", 74, "https://x/large.webp")], "s string, t string, n int, u string").select(
        scoring.score_text(F.col("s"), F.col("t"), F.lit(1.0)).total.alias("text"),
        scoring.score_text(F.col("s"), F.col("t"), F.lit(1.0)).reason.alias("reason"),
        scoring.score_int(F.col("s"), F.col("n"), F.lit(1.0)).total.alias("int"),
        scoring.score_cover(F.col("s"), F.col("u"), F.lit(1.0), F.lit(None).cast("double")).total.alias("cover"),
        scoring.score_bool(F.col("s"), F.lit(False), F.lit(1.0)).total.alias("bool"),
    ).first()
    assert row["text"] == pytest.approx(0.225 + 0.05 * 0.2 + 0.2 * 0.35 + 0.2)
    assert row["reason"] == "provider=0.225, completeness=0.010, quality=0.070, consistency=0.200"
    assert row["int"] == pytest.approx(0.225 + 0.2 + 0.3 + 0.25)
    assert row["cover"] == pytest.approx(0.18 + (20 / 240) * 0.1 + 0.45 + 0.15)
    assert row["bool"] == pytest.approx(0.27 + 0.2 + 0.35)


def test_tokens_of_all_scripts(spark):
    """As the full-text index of SQLite cuts and folds, where its tables know the letter."""
    import sqlite3
    import unicodedata

    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("SQLite has no full-text search here")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    words = ["ΟΔΟΣ Άνθρωπος", "Йод ёлка", "Tiếng Việt Đường", "ñandú É é x̅y", "हिन्दी", "ſtraße µm ĿL", "İstanbul", "ǡ ǟ ǽ ǿ", "が が", "العَرَبِيَّة"]
    words += [f"a{chr(c)}b" for c in range(0xC0, 0x250)] + [f"a{chr(c)}b" for c in range(0x1E00, 0x1F00)] + [f"a{chr(c)}b" for c in range(0x300, 0x370)]
    words += [f"{chr(c)}" for c in range(0x370, 0x528) if unicodedata.category(chr(c))[0] == "L" and c != 0x37F]
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(words)))
    want: dict = {i: [] for i in range(len(words))}
    for doc, term in con.execute("SELECT doc, term FROM v ORDER BY doc, offset"):
        want[doc].append(term)
    got = spark.createDataFrame(list(enumerate(words)), "i int, s string").select("i", S.tokens(F.col("s")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in got} == want
    from marquetry.operators.search import query_terms

    assert all(query_terms(w) == list(dict.fromkeys(want[i])) for i, w in enumerate(words) if want[i])


def test_pages_read_their_own_parts(spark, tmp_path):
    from marquetry.operators.lookups import numbered_page, paged

    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.col("id").alias("v"))
    table = paged(rows, "k", str(tmp_path / "paged"), per_part=100)
    for number, size in ((1, 10), (7, 33), (3, 250), (100, 10), (101, 10), (0, 0), (1, 5000)):
        assert table.page(number, size).collect() == numbered_page(rows, "k", number, size).collect()
    assert len(table.parts) == 10
    plan = table.page(100, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and f"= {table.parts[-1][0]})]" in plan  # the last part's files only
    assert paged(rows.limit(0), "k", str(tmp_path / "none")).page(1, 5).count() == 0


def test_a_text_is_looked_at_once_for_its_quality(spark):
    """Bounds name their value several times: the text's length and marks are found before, and scores stay what they were."""
    from pyspark.sql import functions as F

    from marquetry.functions.scoring import text_completeness, text_quality

    texts = [None, "", " 　", "a", "x" * 300, " " + "é" * 700 + "\n", "a\nb<i>", "<", " b\n" + "c" * 100]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(1)
    scores = [text_completeness(F.col("t")).alias("c"), text_quality(F.col("t"), True).alias("q"), text_quality(F.col("t"), False).alias("p")]
    df = rows.select("i", *scores)
    assert str(scores[1]).count("char_length(") == 1 and str(scores[1]).count("contains(") == 5 and str(scores[0]).count("char_length(") == 1
    within = lambda x, low: min(max(x, low), 1.0)
    for r in df.collect():
        t = texts[r["i"]]
        if t is None:
            assert (r["c"], r["q"], r["p"]) == (None, None, None)
            continue
        t = t.strip()
        marks = (0.10 if "\n" in t else 0.0, 0.15 if "<" in t or ">" in t else 0.0)
        want = [0.0 if t == "" else within(within(len(t) / by, low) + marks[0] - marks[1], 0.0) for by, low in ((600.0, 0.15), (80.0, 0.20))]
        assert (r["c"], r["q"], r["p"]) == (within(len(t) / 240.0, 0.05), *want)
