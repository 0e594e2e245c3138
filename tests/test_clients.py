"""Requests of the paged sources, over recorded answers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from marquetry.sources import clients
from marquetry.sources.clients import ApiSource, Client, Failed, GraphSource, Request, Response, RestSource, ShowSource
from marquetry.sources.paged import TooManyRequests
from marquetry.sources.remote import NotSupported, Remote
from marquetry.streaming.sync import DEFAULT_ORDER, generate_database, sync_database


class Recorded:
    """Answers by path (and page), in order; keeps what was asked."""

    def __init__(self, answers: dict) -> None:
        self.answers, self.asked = answers, []

    def __call__(self, request: Request) -> Response:
        self.asked.append(request)
        path = request.url.split("//", 1)[1].partition("/")[2]
        found = self.answers[path]
        found = found(request) if callable(found) else found
        if isinstance(found, list) and found and isinstance(found[0], Response):
            return found.pop(0)
        return found if isinstance(found, Response) else Response(200, json.dumps(found))


def client(name, answers, **more):
    waits = []
    return Client(name, Recorded(answers), sleep=waits.append, **more), waits


GRAPH = {"id": 1, "idMal": 11, "title": {"romaji": "R", "english": "E"}, "siteUrl": "https://anilist.co/anime/1", "genres": ["Drama"]}


def graph(request):
    asked = json.loads(request.body)
    v, query = asked["variables"], asked["query"]
    if "recommendations" in query:
        return {"data": {"Media": {"recommendations": {"edges": [{"node": {"mediaRecommendation": GRAPH}}, {"node": {"mediaRecommendation": None}}, None]}}}}
    if "relations" in query:
        return {"data": {"Media": {"relations": {"edges": [{"node": GRAPH}]}}}}
    if "Media(" in query:
        return {"data": {"Media": GRAPH}} if v["id"] == 1 else {"errors": [{"message": "Not Found.", "status": 404}], "data": {"Media": None}}
    if v["page"] > 2:
        return {"errors": [{"message": "Page must be between 1 and 100"}]}
    return {"data": {"Page": {"pageInfo": {"hasNextPage": v["page"] < 2}, "media": [GRAPH | {"id": v["page"]}]}}}


def test_graph_source():
    own, waits = client("anilist", {"": graph})
    s = GraphSource(own)
    assert [json.loads(x)["id"] for x in clients.all_pages(s, "anime")] == [1, 2] and waits == [0.7]
    first = json.loads(own.transport.asked[0].body)["variables"]
    assert first == {"page": 1, "size": 50, "type": "ANIME", "sort": ["ID"]}
    assert s.page("manga", 3, 500) == ([], False) and json.loads(own.transport.asked[-1].body)["variables"]["size"] == 50
    assert json.loads(s.search("anime", " word ", limit=99)[0])["id"] == 1 and json.loads(own.transport.asked[-1].body)["variables"]["search"] == "word"
    n = len(own.transport.asked)
    assert s.search("anime", "  ") == [] and len(own.transport.asked) == n
    assert len(s.one("anime", "1")) == 1 and s.one("anime", "2") == []
    assert len(s.recommendations("anime", "1")) == 1 and len(s.related("anime", "1")) == 1 and len(s.trending("anime")) == 1
    with pytest.raises(ValueError, match="numbers"):
        s.one("anime", "x1")
    with pytest.raises(NotSupported):
        s.episodes("anime", "1")
    bad, _ = client("anilist", {"": {"errors": [{"message": "Invalid token"}]}})
    with pytest.raises(Failed, match="Invalid token"):
        GraphSource(bad).page("anime", 1, 5)


def test_waits_and_errors():
    limited = {"anime": [Response(429, "", 3.0), Response(429, ""), Response(200, '{"data": [], "pagination": {}}')]}
    own, waits = client("jikan", limited, address="https://other.example/", proxy="http://proxy:1", timeout=9.0)
    assert RestSource(own).page("anime", 1, 25) == ([], False) and waits == [4.0, 4.0]
    asked = own.transport.asked[0]
    assert (asked.url, asked.proxy, asked.timeout) == ("https://other.example/anime", "http://proxy:1", 9.0)
    assert dict(asked.params) == {"page": "1", "limit": "25", "sfw": "false"}
    always, _ = client("jikan", {"v4/anime": lambda r: Response(429, "")})
    with pytest.raises(TooManyRequests):
        RestSource(always).page("anime", 1, 25)
    down, _ = client("jikan", {"v4/anime": Response(500, "oops")})
    with pytest.raises(Failed, match="500: oops"):
        RestSource(down).page("anime", 1, 25)


def test_rest_source():
    item = {"mal_id": 5, "title": "T", "url": "u"}
    answers = {
        "v4/anime": lambda r: {"data": [item], "pagination": {"has_next_page": dict(r.params)["page"] == "1"}}, "v4/top/manga": {"data": [item]}, "v4/anime/5": {"data": item},
        "v4/anime/6": Response(404, ""), "v4/anime/5/recommendations": {"data": [{"entry": item}, {"entry": None}]}, "v4/anime/5/relations": {"data": [{"entry": [item, item]}, {"entry": [item]}]},
        "v4/anime/5/episodes": lambda r: {"data": [{"mal_id": int(dict(r.params)["page"])}], "pagination": {"has_next_page": dict(r.params)["page"] != "3"}},
    }
    own, waits = client("jikan", answers)
    s = RestSource(own)
    assert len(list(clients.all_pages(s, "show"))) == 2 and waits == [1.1]
    assert len(s.trending("movie")) == 1 and len(s.one("anime", "5")) == 1 and s.one("anime", "6") == []
    assert len(s.recommendations("anime", "5")) == 1 and len(s.related("anime", "5")) == 3
    assert [json.loads(x)["mal_id"] for x in s.episodes("anime", "5")] == [1, 2, 3] and waits == [1.1] * 3
    assert s.episodes("manga", "5") == []


def sideloaded(number):
    refs = {"categories": {"data": [{"type": "categories", "id": "7"}]}, "mappings": {"data": [{"type": "mappings", "id": "9"}]}}
    item = {"id": str(number), "type": "anime", "attributes": {"canonicalTitle": f"K{number}"}, "relationships": refs}
    more = [{"type": "categories", "id": "7", "attributes": {"title": "Cat"}}, {"type": "categories", "id": "8", "attributes": {"title": "No"}}]
    more.append({"type": "mappings", "id": "9", "attributes": {"externalSite": "myanimelist/anime", "externalId": "99"}})
    return item, more


def api(request):
    at = int(dict(request.params).get("page[offset]", 0))
    item, more = sideloaded(at // 20 + 1)
    return {"data": [item], "included": more, "links": {"next": "n"} if at == 0 else {}}


def test_api_source(spark):
    item, more = sideloaded(4)
    own, waits = client("kitsu", {"api/edge/anime": api, "api/edge/anime/4": {"data": item, "included": more}, "api/edge/anime/5": Response(404, ""), "api/edge/anime/4/episodes": {"data": [{"id": "1", "attributes": {"number": 1}}]}, "api/edge/trending/anime": {"data": [item]}})
    s = ApiSource(own)
    texts = list(clients.all_pages(s, "anime"))
    assert [json.loads(x)["data"]["id"] for x in texts] == ["1", "2"] and waits == [0.9]
    assert dict(own.transport.asked[1].params) == {"page[limit]": "20", "page[offset]": "20", "sort": "id", "include": "categories,mappings"}
    assert [x["id"] for x in json.loads(texts[0])["included"]] == ["7", "9"]
    assert s.one("anime", "5") == [] and len(s.trending("anime")) == 1 and len(s.episodes("anime", "4")) == 1
    row = clients.remote(spark, "kitsu", own).by_id("anime", "4").first()
    assert (row["title_display"], row["tags"], [(x["source"], x["source_id"]) for x in row["external_ids"]]) == ("K4", ["Cat"], [("kitsu", "4"), ("myanimelist", "99")])


SHOWS = [{"id": i, "url": f"u{i}", "name": f"Show {i}", "externals": {"imdb": f"tt{i}"}} for i in range(3)]


def shows(request):
    page = int(dict(request.params)["page"])
    return SHOWS[2 * page : 2 * page + 2] if page < 2 else Response(404, "")


def test_show_source(spark):
    own, waits = client("tvmaze", {"shows": shows, "search/shows": [{"show": SHOWS[1]}, {"show": SHOWS[2]}], "shows/1": SHOWS[1], "shows/9": Response(404, ""), "shows/1/episodes": [{"id": 3, "name": "One", "season": 1, "number": 1}]})
    s = ShowSource(own)
    assert len(list(clients.all_pages(s, "show"))) == 3 and waits == [0.5, 0.5]
    assert len(s.search("show", "x", limit=1)) == 1 and s.one("show", "9") == [] and s.episodes("anime", "1") == []
    remote = Remote().with_source(clients.remote(spark, "tvmaze", own))
    assert [r["title_display"] for r in remote.show("tvmaze").search("show").collect()] == ["Show 1", "Show 2"]
    assert remote.show("tvmaze").by_id("1").first()["title_display"] == "Show 1" and remote.show("tvmaze").by_id("9").count() == 0
    assert remote.show("tvmaze").episodes("1").first()["episode_number"] == 1
    with pytest.raises(NotSupported):
        remote.show("tvmaze").recommendations("1")


def test_sync_of_all_sources(spark, tmp_path):
    """The fixed order; what a dump and a source share is merged; a second sync updates."""
    source = ShowSource(client("tvmaze", {"shows": shows})[0])
    dump = clients.PROJECTIONS["tvmaze"](clients.frame(spark, [json.dumps(SHOWS[0] | {"id": 77, "externals": {"imdb": "tt5"}})]), "show").drop("seq")
    catalog, report = generate_database(spark, str(tmp_path / "c"), {"tvmaze": source}, dump)
    assert [(o.source, o.media_kind, o.fetched_pages, o.upserted) for o in report.outcomes] == [("tvmaze", "show", 2, 3), ("imdb", "show", 1, 1), ("imdb", "movie", 1, 0)]
    assert catalog.media().count() == 4
    state = catalog.table("sync_state").where(F.col("source") == "tvmaze").first()
    assert (state["page"], state["last_error"]) == (1, None)
    again = sync_database(spark, str(tmp_path / "c"), {"tvmaze": source})
    assert again.upserted == 1 and catalog.media().count() == 4  # from the cursor on: the last page
    assert len(DEFAULT_ORDER) == 9


def found_by(total):
    """A search of many hits, as each source pages them."""

    def answer(request):
        if request.body:
            v = json.loads(request.body)["variables"]
            at, size = (v["page"] - 1) * v["size"], v["size"]
            return {"data": {"Page": {"pageInfo": {"hasNextPage": at + size < total}, "media": [GRAPH | {"id": i} for i in range(at, min(at + size, total))]}}}
        p = dict(request.params)
        if "q" in p and "page" in p:
            at, size = (int(p["page"]) - 1) * int(p["limit"]), int(p["limit"])
            return {"data": [{"mal_id": i, "title": f"T{i}"} for i in range(at, min(at + size, total))]}
        if "page[limit]" in p:
            at, size = int(p.get("page[offset]", 0)), int(p["page[limit]"])
            items = [{"id": str(i), "type": "anime", "attributes": {"canonicalTitle": f"K{i}", "number": i}} for i in range(at, min(at + size, total))]
            return {"data": items, "links": {"next": "n"} if at + size < total else {}}
        return [{"show": {"id": i, "name": f"S{i}"}} for i in range(min(int(p["limit"]), total))]

    return answer


@pytest.mark.parametrize(
    ("name", "kind", "path", "interval"),
    [("anilist", "anime", "", 0.7), ("jikan", "anime", "v4/anime", 1.1), ("kitsu", "anime", "api/edge/anime", 0.9), ("tvmaze", "show", "search/shows", 0.5)],
)
def test_search_gives_the_page_that_is_asked_for(spark, name, kind, path, interval):
    own, waits = client(name, {path: found_by(120)})
    ids = lambda limit, offset: [x["source_id"] for r in Remote().with_source(clients.remote(spark, name, own)).collection(name, kind).search("q", options(limit, offset)).collect() for x in r["external_ids"] if x["source"] in (name, "jikan")]

    def options(limit, offset):
        from marquetry.operators.search import SearchOptions

        return SearchOptions(limit=limit, offset=offset)

    assert ids(50, 0) == list(map(str, range(50)))
    assert waits == ([] if name in ("anilist", "tvmaze") else [interval] * (-(-50 // clients.LIMITS[name].page_size) - 1))
    assert ids(20, 20) == list(map(str, range(20, 40)))
    assert ids(7, 45) == list(map(str, range(45, 52)))
    assert ids(50, 100) == list(map(str, range(100, 120)))
    assert ids(5, 500) == []


def test_all_episodes_are_read():
    own, waits = client("kitsu", {"api/edge/anime/4/episodes": found_by(47)})
    s = ApiSource(own)
    assert [json.loads(x)["id"] for x in s.episodes("anime", "4")] == list(map(str, range(47))) and waits == [0.9, 0.9]
    assert len(s.episodes("anime", "4", first_page_only=True)) == 20
