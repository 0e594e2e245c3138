from __future__ import annotations

import random

import pytest

from marquetry.operators import episodes, identity, merge
from marquetry.schemas import CANONICAL_EPISODE, CANONICAL_MEDIA
from pyspark.sql import functions as F
from pyspark.sql import types as T


def media_row(seq, source, source_id, entity=1, **values):
    ids = values.pop("ids", [(source, source_id)])
    row = {f.name: ([] if f.dataType.typeName() == "array" else None) for f in CANONICAL_MEDIA}
    row |= {"media_kind": "anime", "title_display": "Monster", "nsfw": False, "external_ids": [(s, i, None) for s, i in ids], "source_payloads": [(source, source_id, None, None, values.pop("raw", "{}"))]}
    row |= values
    return (entity, seq, *[row[f.name] for f in CANONICAL_MEDIA])


def media_frame(spark, rows):
    schema = T.StructType([T.StructField("entity", T.LongType()), T.StructField("seq", T.LongType()), *CANONICAL_MEDIA])
    return spark.createDataFrame(rows, schema)


def test_two_sources(spark):
    a = media_row(1, "anilist", "19", provider_rating=0.55, genres=["Mystery", "Thriller"], tags=["Psychological"], aliases=["Naoki Urasawa's Monster"], episodes=74, synopsis="short", ids=[("anilist", "19"), ("myanimelist", "19")])
    b = media_row(2, "jikan", "19", provider_rating=0.79, genres=["Suspense", "thriller"], tags=["Adult Cast"], aliases=["Monster"], synopsis="long " * 60, episodes=74, ids=[("jikan", "19"), ("myanimelist", "19")])
    df = media_frame(spark, [a, b])
    m = merge.merge_fields(df).first()
    assert m["title_display"]["source"] == "anilist"
    assert m["synopsis"]["source"] == "jikan"
    assert m["provider_rating"] == 0.79
    assert m["title_native"] is None
    assert merge.list_union(df, "genres").first()["genres"] == ["Mystery", "Thriller", "Suspense"]
    assert merge.list_union(df, "tags").first()["tags"] == ["Psychological", "Adult Cast"]
    assert {(r.source, r.source_id) for r in merge.external_ids(df).collect()} == {("anilist", "19"), ("myanimelist", "19"), ("jikan", "19")}
    assert {r.normalized_alias for r in merge.aliases(df).collect()} == {"naoki urasawa s monster", "monster"}
    assert "title_native" not in {r.field_name for r in merge.provenance_rows(merge.merge_fields(df)).collect()}


def test_ties_go_to_the_later_record(spark):
    rows = [media_row(s, "kitsu", str(s), title_display=t) for s, t in ((1, "Alpha"), (2, "Gamma"))]
    assert merge.merge_fields(media_frame(spark, rows)).first()["title_display"]["value"] == "Gamma"


def test_merge_equals_a_fold(spark):
    """One after another, replacing a winner whose score is no higher, gives what one aggregation gives."""
    r = random.Random(7)
    sources = ["anilist", "jikan", "kitsu", "tvmaze", "imdb"]
    rows = [media_row(i, r.choice(sources), str(i), entity=r.randrange(6), title_display="x" * r.randrange(1, 90), synopsis=r.choice([None, "y" * r.randrange(1, 700)]), episodes=r.choice([None, 0, 1, 12])) for i in range(120)]
    df = media_frame(spark, rows)
    merged = {m["entity"]: m for m in merge.merge_fields(df).collect()}
    scored = df.withColumn("_o", merge.origin()["source"]).withColumn("_b", merge.consistency_of_record())
    for f in ("title_display", "synopsis", "episodes"):
        won = {}
        for row in scored.select("entity", "seq", f, merge.scored(f, F.col("_o"), F.col("_b")).total.alias("s")).orderBy("seq").collect():
            if row[f] is not None and (row["entity"] not in won or row["s"] >= won[row["entity"]][0]):
                won[row["entity"]] = (row["s"], row[f])
        for e, m in merged.items():
            assert (m[f] and m[f]["value"]) == (won[e][1] if e in won else None)


def test_payloads_keep_the_last(spark):
    rows = [media_row(1, "kitsu", "1", raw='{"v":1}'), media_row(2, "kitsu", "1", raw='{"v":22}')]
    got = merge.payloads(media_frame(spark, rows)).first()
    assert (got["raw_json"], got["payload_hash"]) == ('{"v":22}', "8")


def episode_frame(spark, rows):
    full = []
    for seq, r in enumerate(rows):
        base = {f.name: None for f in CANONICAL_EPISODE} | {"media_kind": "anime"} | r
        full.append((1, seq, *[base[f.name] for f in CANONICAL_EPISODE]))
    return spark.createDataFrame(full, T.StructType([T.StructField("media_id", T.LongType()), T.StructField("seq", T.LongType()), *CANONICAL_EPISODE])).withColumn("titles_json", F.col("raw_titles_json"))


KITSU = {"source": "kitsu", "source_id": "kitsu-5", "episode_number": 5, "title_display": "K", "synopsis": "K", "runtime_minutes": 24, "air_date": "2024-01-01"}
JIKAN = {"source": "jikan", "source_id": "mal-5", "absolute_number": 5, "episode_number": 5, "title_display": "J", "air_date": "2024-01-02"}


def test_effective_number_merge(spark):
    got = episodes.merge_effective(episode_frame(spark, [KITSU, JIKAN])).collect()
    assert len(got) == 1
    e = got[0]
    assert (e["source"], e["source_id"], e["absolute_number"], e["title_display"], e["synopsis"], e["runtime_minutes"], e["air_date"]) == ("jikan", "mal-5", 5, "J", "K", 24, "2024-01-02")


def test_effective_merge_drops_rows_without_numbers(spark):
    got = episodes.merge_effective(episode_frame(spark, [{"source": "jikan", "source_id": "a"}, {"source": "kitsu", "source_id": "b", "episode_number": 2}])).collect()
    assert [e["number"] for e in got] == [2]


def test_absolute_numbers_come_before_episode_numbers(spark):
    got = episodes.merge_effective(episode_frame(spark, [{"source": "kitsu", "source_id": "a", "absolute_number": 13, "episode_number": 1}, {"source": "jikan", "source_id": "b", "absolute_number": 13, "episode_number": 13}])).collect()
    assert [(e["number"], e["source"]) for e in got] == [(13, "jikan")]


def test_catalog_merge_takes_numbers_from_the_lowest_rank(spark):
    rows = [JIKAN | {"season_number": None}, KITSU | {"absolute_number": 5, "season_number": 1, "raw_titles_json": "{}"}]
    got = episodes.merge_catalog(episode_frame(spark, rows)).collect()
    assert len(got) == 1
    e = got[0]
    assert (e["title_display"], e["season_number"], e["titles_json"], e["episode_key"]) == ("J", 1, "{}", "abs:5")


def test_rows_without_numbers_share_a_group(spark):
    got = episodes.merge_catalog(episode_frame(spark, [{"source": "kitsu", "source_id": "a"}, {"source": "jikan", "source_id": "b"}])).collect()
    assert [e["episode_key"] for e in got] == ["se:0:0"]


def test_candidates(spark):
    ids = spark.createDataFrame([(1, "anime", "anilist", "1", 0), (1, "anime", "myanimelist", "19", 1), (1, "anime", "jikan", "19", 2), (1, "anime", "kitsu", "42", 3)], "media_id long, media_kind string, source string, source_id string, pos int")
    got = episodes.candidates(ids, episodes.candidate_rules(spark)).orderBy("pos").collect()
    assert [(r["source"], r["source_id"]) for r in got] == [("jikan", "19"), ("kitsu", "42")]


def ids_frame(spark, rows):
    return spark.createDataFrame(rows, "seq long, media_kind string, pos int, source string, source_id string")


def test_replay(spark):
    rows = [
        (1, "show", 0, "imdb", "tt1"), (1, "show", 1, "tvmaze", "500"),
        (2, "movie", 0, "imdb", "tt1"),  # another kind: another media
        (3, "show", 0, "imdb", "tt2"),
        (4, "show", 0, "imdb", "tt1"), (4, "show", 1, "imdb", "tt2"),  # bridges two
        (5, "show", 0, "tvmaze", "500"), (5, "show", 1, "imdb", "tt9"),  # a second id of a source
        (6, "show", 0, "tvmaze", "500"), (6, "show", 1, "jikan", "7"),
    ]
    ids = ids_frame(spark, rows)
    got = {r["seq"]: (r["media_id"], r["status"]) for r in identity.replay(ids, identity.components(ids)).collect()}
    assert got == {1: (1, "inserted"), 2: (2, "inserted"), 3: (3, "inserted"), 4: (None, "conflict"), 5: (None, "duplicate_source"), 6: (1, "updated")}


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    r = random.Random(seed)
    rows = [(i, "anime", p, f"s{p}", str(r.randrange(60))) for i in range(70) for p in range(r.randrange(1, 3))]
    parent = list(range(70))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = {}
    for i, k, _, s, v in rows:
        j = seen.setdefault((k, s, v), i)
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    got = {x["seq"]: x["component"] for x in identity.components(ids_frame(spark, rows)).collect()}
    assert got == {i: find(i) for i in range(70)}


@pytest.mark.parametrize("seed", range(4))
def test_replay_equals_one_record_after_another(spark, seed):
    """Random ids, with and without conflicts: settled components and replayed ones give what a plain loop gives."""
    r = random.Random(seed)
    rows, most = [], (25, 60, 200, 400)[seed]
    for i in range(80):
        kind = r.choice(("anime", "show"))
        for p in range(r.randrange(1, 4)):
            rows.append((i, kind, p, f"s{r.randrange(3)}", str(r.randrange(most))))
    owner, held, want = {}, {}, {}
    for i in range(80):
        ids = list(dict.fromkeys((k, s, v) for q, k, _, s, v in rows if q == i))
        found = [owner[x] for x in ids if x in owner]
        media = found[0] if found else i
        own = dict(held.get(media, {}))
        status = "conflict" if len(set(found)) > 1 else "updated" if found else "inserted"
        if status != "conflict" and any(own.setdefault(s, v) != v for _, s, v in ids):
            status = "duplicate_source"
        want[i] = (media if status in ("inserted", "updated") else None, status)
        if want[i][0] is not None:
            owner.update(dict.fromkeys(ids, media))
            held[media] = own
    ids = ids_frame(spark, rows)
    component = identity.components(ids)
    got = {x["seq"]: (x["media_id"], x["status"]) for x in identity.replay(ids, component).collect()}
    assert got == want
    sizes = {x["component"]: x["n_rows"] for x in identity.large_components(component, 3).collect()}
    assert all(n > 3 for n in sizes.values()) and (seed > 1 or sizes)


def test_merge_is_hashed_and_moves_no_text(spark):
    """The aggregation that meets all records has numbers only."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, 1)], "entity long, seq long").withColumns({f: F.lit(None).cast("string") for f in merge.TEXT_FIELDS + merge.IMAGE_FIELDS})
    rows = rows.withColumns({f: F.lit(None).cast("int") for f in merge.INT_FIELDS}).withColumn("nsfw", F.lit(True)).withColumn("provider_rating", F.lit(0.5)).withColumn("media_kind", F.lit("anime"))
    ids = "array<struct<source:string,source_id:string>>"
    rows = rows.withColumn("external_ids", F.array().cast(ids)).withColumn("source_payloads", F.array().cast(ids))
    plan = merge.merge_fields(rows)._jdf.queryExecution().sparkPlan().toString()
    first = plan[plan.rindex("HashAggregate(keys=[entity"):]
    assert "SortAggregate" not in first and "partial_max" in first and "reason" not in first


def test_merge_scores_records_once(spark):
    """Records are read twice, to be scored and for what winners have; standings go along with an entity's first record."""
    plan = merge.merge_fields(media_frame(spark, [media_row(1, "anilist", "19")]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2
