from __future__ import annotations

import gzip
import json

import pytest

from marquetry.sources import dumps, paged, payloads, registry

BASICS = """tconst\ttitleType\tprimaryTitle\toriginalTitle\tisAdult\tstartYear\tendYear\truntimeMinutes\tgenres
tt1\tmovie\tA "quoted\tÀ\t1\t2001\t\\N\t90\tDrama,Crime
tt2\ttvSeries\tShow\tShow\t0\t\\N\t\\N\t\\N\t\\N
tt3\ttvEpisode\tPilot\t\\N\t0\t2008\t\\N\t58\t\\N
tt4\tshort\tShort\t\\N\t0\t2008\t\\N\t5\t\\N
tt5\tmovie\tToo short
tt6\tmovie\t\\N\t\\N\t0\t2008\t\\N\t5\t\\N
"""
RATINGS = "tconst\taverageRating\tnumVotes\ntt1\t9.5\t10\ntt2\tbad\t1\n"
EPISODES = "tconst\tparentTconst\tseasonNumber\tepisodeNumber\ntt3\ttt2\t1\t\\N\ntt9\ttt8\t1\t1\n"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    base = tmp_path_factory.mktemp("dumps")
    out = []
    for name, text in (("basics", BASICS), ("ratings", RATINGS), ("episode", EPISODES)):
        path = base / f"title.{name}.tsv.gz"
        path.write_bytes(gzip.compress(text.encode()))
        out.append(str(path))
    return out


def test_titles(spark, files):
    got = {r["external_ids"][0]["source_id"]: r for r in dumps.canonical_titles(dumps.titles(spark, files[0]), dumps.ratings(spark, files[1])).collect()}
    assert set(got) == {"tt1", "tt2"}
    a, b = got["tt1"], got["tt2"]
    assert (a["media_kind"], a["title_display"], a["aliases"], a["genres"], a["provider_rating"], a["nsfw"], a["episodes"]) == ("movie", "À", ["À"], ["Drama", "Crime"], 0.95, True, 90)
    assert (b["media_kind"], b["provider_rating"], b["season"], b["aliases"], b["genres"]) == ("show", None, None, [], [])
    assert json.loads(a["source_payloads"][0]["raw_json"])["primaryTitle"] == 'A "quoted'


def test_episodes_of_parents(spark, files):
    parents = spark.createDataFrame([("tt2",)], "parentTconst string")
    got = dumps.canonical_episodes(dumps.basics(spark, files[0]), dumps.episode_links(spark, files[2]), parents)
    rows = got.collect()
    assert [(r["source_id"], r["season_number"], r["episode_number"], r["air_date"]) for r in rows] == [("tt3", 1, None, "2008")]
    ids = spark.createDataFrame([(7, "show", "imdb", "tt2")], "media_id long, media_kind string, source string, source_id string")
    assert dumps.with_media(got, ids).first()["media_id"] == 7
    assert dumps.canonical_episodes(dumps.basics(spark, files[0]), dumps.episode_links(spark, files[2]), parents, strict=True).count() == 0


def raw(spark, *items):
    return spark.createDataFrame([(json.dumps(i),) for i in items], "raw_json string")


def test_graph_media(spark):
    item = {"id": 19, "idMal": 20, "title": {"romaji": "R", "native": "N"}, "synonyms": ["x"], "season": "SPRING", "averageScore": 110, "coverImage": {"large": "l", "medium": "m"}, "tags": [{"name": "t"}], "siteUrl": "u", "updatedAt": 5}
    rows = payloads.graph_media(raw(spark, item, {"id": 1, "title": {}}), "anime").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["title_display"], r["season"], r["provider_rating"], r["cover_image"], r["tags"], r["nsfw"], r["genres"]) == ("R", "spring", 1.0, "l", ["t"], False, [])
    assert [(x["source"], x["source_id"], x["url"]) for x in r["external_ids"]] == [("anilist", "19", "u"), ("myanimelist", "20", None)]


def test_rest_media(spark):
    item = {"mal_id": 5, "url": "u", "title": "T", "title_english": "E", "titles": [{"type": "x", "title": "A"}], "title_synonyms": ["S"], "score": 7.9, "rating": "Rx - Hentai", "images": {"jpg": {"image_url": "i"}}, "themes": [{"name": "th"}], "demographics": [{"name": "d"}]}
    r = payloads.rest_media(raw(spark, item), "manga").first()
    assert (r["title_display"], r["aliases"], r["tags"], r["nsfw"], r["cover_image"]) == ("E", ["A", "S", "T"], ["th", "d"], True, "i")
    assert r["provider_rating"] == pytest.approx(0.79)
    e = payloads.rest_entries(raw(spark, {"mal_id": 9, "url": "u", "name": "N", "type": "manga"})).first()
    assert (e["media_kind"], e["title_display"], e["external_ids"][0]["source"]) == ("manga", "N", "myanimelist")
    p = payloads.rest_episodes(raw(spark, {"mal_id": 3, "title_japanese": "J"})).first()
    assert (p["absolute_number"], p["episode_number"], p["title_display"], p["title_original"]) == (3, None, "J", "J")


def test_api_media(spark):
    item = {"id": "42", "type": "anime", "attributes": {"titles": {"en": "E", "ja_jp": "J"}, "abbreviatedTitles": ["Ab"], "description": "D", "startDate": "1999-05-01", "averageRating": "82.5", "ageRating": "R18", "posterImage": {"small": "s", "tiny": "t"}}, "relationships": {"categories": {"data": [{"id": "2", "type": "categories"}, {"id": "1", "type": "categories"}]}, "mappings": {"data": [{"id": "7", "type": "mappings"}]}}}
    included = [{"type": "categories", "id": "1", "attributes": {"title": "One"}}, {"type": "categories", "id": "2", "attributes": {"title": "Two"}}, {"type": "mappings", "id": "7", "attributes": {"externalSite": "MyAnimeList/anime", "externalId": "19"}}]
    df = spark.createDataFrame([(json.dumps(item), json.dumps(included))], "raw_json string, included_json string")
    r = payloads.api_media(df, "show").first()
    assert (r["title_display"], r["synopsis"], r["season_year"], r["nsfw"], r["cover_image"], r["tags"], r["aliases"]) == ("E", "D", 1999, True, "s", ["Two", "One"], ["Ab", "E", "J"])
    assert r["provider_rating"] == pytest.approx(0.825)
    assert [(x["source"], x["source_id"], x["url"]) for x in r["external_ids"]] == [("kitsu", "42", "https://kitsu.io/anime"), ("myanimelist", "19", None)]
    e = payloads.api_episodes(raw(spark, {"id": "9", "attributes": {"titles": {"en_jp": "x"}, "number": 2, "relativeNumber": 14, "seasonNumber": 1}}), "anime").first()
    assert (e["absolute_number"], e["episode_number"], e["title_display"], json.loads(e["raw_titles_json"])) == (14, 2, "x", {"en": None, "en_jp": "x", "ja_jp": None})


def test_shows(spark):
    item = {"id": 169, "url": "u", "name": " Breaking ", "summary": "<p>a<br/>b</p>", "premiered": "2008-01-20", "rating": {"average": 9.5}, "webChannel": {"country": {"code": "US"}}, "externals": {"imdb": "tt0903747"}, "image": {"medium": "m"}}
    rows = payloads.shows(raw(spark, item, {"id": 1, "name": "  "})).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["title_display"], r["synopsis"], r["season_year"], r["country_of_origin"], r["cover_image"]) == ("Breaking", "a\nb", 2008, "US", "m")
    assert [(x["source"], x["url"]) for x in r["external_ids"]] == [("tvmaze", "u"), ("imdb", "https://www.imdb.com/title/tt0903747")]
    e = payloads.show_episodes(raw(spark, {"id": 1, "name": "P", "season": 1, "number": 2, "summary": "<b>x</b>"})).first()
    assert (e["season_number"], e["episode_number"], e["absolute_number"], e["synopsis"]) == (1, 2, None, "x")


def pages_of_three(number: int, size: int):
    """Seven items in pages of ``size``."""
    items = [json.dumps({"n": i}) for i in range(7)][(number - 1) * size : number * size]
    return items, number * size < 7


def test_paged_source(spark):
    paged.register(spark)
    read = spark.read.format("marquetry_pages").option("fetch", "tests.test_sources:pages_of_three").option("source", "imdb").option("page_size", 3)
    assert read.load().count() == 7
    assert read.option("max_pages", 2).load().count() == 6
    assert {(r["page"], r["pos"]) for r in read.option("start_page", 3).option("max_pages", 1).load().collect()} == {(3, 0)}


def test_retry_waits_and_gives_up():
    waits, calls = [], []

    def busy(times):
        def call():
            calls.append(1)
            if len(calls) <= times:
                raise paged.TooManyRequests(4 if len(calls) == 1 else None)
            return "ok"

        return call

    assert paged.retried(busy(2), sleep=waits.append) == "ok"
    assert waits == [5, 4.0]
    calls.clear()
    with pytest.raises(paged.TooManyRequests):
        paged.retried(busy(9), sleep=waits.append)
    assert len(calls) == 4


def test_page_sizes():
    assert [paged.page_size(n, "kitsu") for n in (0, 7, 50)] == [1, 7, 20]
    assert paged.page_offset(3, 20) == 40


def test_union_of(spark):
    def fail():
        raise OSError("down")

    rows, errors = registry.union_of({"a": lambda: spark.range(2), "b": fail})
    assert rows.count() == 2 and set(errors) == {"b"}
    with pytest.raises(registry.AllFailed):
        registry.union_of({"b": fail})
    r = registry.Registry().register("x", lambda n: spark.range(n))
    assert r.read("x", n=3).count() == 3 and list(r) == ["x"]
