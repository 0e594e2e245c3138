"""The example over recorded answers, from pages to exported documents."""

from __future__ import annotations

import gzip
import json
import os

from examples.catalog_from_pages import run
from marquetry.sources import clients
from marquetry.sources.clients import Client, Request, Response


def transport(request: Request) -> Response:
    """Two sources that share an item by the ids they name, and one of shows."""
    params, path = dict(request.params), request.url.split("//", 1)[1].partition("/")[2]
    if path == "v4/anime" and params.get("page") == "1":
        return Response(200, json.dumps({"data": [{"mal_id": 7, "title": "Winter River", "type": "TV", "url": "j/7"}, {"mal_id": 8, "title": "Summer Road", "type": "TV", "url": "j/8"}], "pagination": {"has_next_page": False}}))
    if path == "v4/anime/7/episodes":
        return Response(200, json.dumps({"data": [{"mal_id": 1, "title": "One"}, {"mal_id": 2, "title": "Two"}], "pagination": {"has_next_page": False}}))
    if path == "v4/anime/8/episodes":
        return Response(500, "down")
    if path == "api/edge/anime":
        item = {"id": "70", "type": "anime", "attributes": {"canonicalTitle": "Winter River", "synopsis": "A river in winter."}, "relationships": {"mappings": {"data": [{"type": "mappings", "id": "m"}]}}}
        mapping = {"type": "mappings", "id": "m", "attributes": {"externalSite": "myanimelist/anime", "externalId": "7"}}
        return Response(200, json.dumps({"data": [item], "included": [mapping], "links": {}}))
    if path == "shows":
        return Response(200, json.dumps([{"id": 1, "name": "Winter Show", "externals": {}}])) if params.get("page") == "0" else Response(404, "")
    if path == "shows/1/episodes":
        return Response(200, json.dumps([{"id": 5, "name": "Pilot", "season": 1, "number": 1}]))
    return Response(404, "")


def test_example(spark, tmp_path):
    folder = str(tmp_path / "recorded")
    keep = clients.recording(folder, transport)
    own = {name: kind(Client(name, keep, sleep=lambda s: None)) for name, kind in clients.SOURCES.items()}
    for name, kind in (("jikan", "anime"), ("jikan", "manga"), ("kitsu", "anime"), ("kitsu", "manga"), ("tvmaze", "show")):
        list(clients.all_pages(own[name], kind))
    for name, kind, i in (("jikan", "anime", "7"), ("kitsu", "anime", "70"), ("tvmaze", "show", "1")):
        own[name].episodes(kind, i)
    done = run(spark, folder, str(tmp_path / "out"), "winter")
    assert done["synced"]["jikan:anime"] == 2 and done["synced"]["kitsu:anime"] == 1 and done["synced"]["tvmaze:show"] == 1
    assert done["media"] == 3 and done["of_several_sources"] >= 1 and done["episodes"] == 3 and done["exported"] == 3
    assert {t for _, t in done["found"]} == {"Winter River", "Winter Show"}
    names = [f for f in os.listdir(tmp_path / "out" / "documents") if f.endswith(".gz")]
    rows = [json.loads(x) for f in names for x in gzip.open(tmp_path / "out" / "documents" / f, "rt")]
    assert {r["title_display"]: len(r["episode_list"]) for r in rows} == {"Winter River": 2, "Summer Road": 0, "Winter Show": 1}
