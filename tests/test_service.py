"""The catalog over GraphQL and HTTP."""

from __future__ import annotations

import json
import threading
from urllib.request import Request, urlopen

import pytest

from marquetry.service import BadQuery, Parser, Service, serve
from marquetry.sources.clients import ShowSource

from .test_clients import SHOWS, client, shows


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    answers = {"shows": shows, "search/shows": [{"show": SHOWS[1]}, {"show": SHOWS[2]}], "shows/1": SHOWS[1]}
    from marquetry.sources.clients import Response

    answers["shows/9"] = Response(404, "")
    out = Service(spark, str(tmp_path_factory.mktemp("service") / "c"), {"tvmaze": ShowSource(client("tvmaze", answers)[0])})
    got = out.execute("mutation { generateDatabase(maxPages: 0) { totalUpsertedRecords outcomes { source mediaKind fetchedPages } } }")
    assert got == {"data": {"generateDatabase": {"totalUpsertedRecords": 2, "outcomes": [{"source": "TVMAZE", "mediaKind": "SHOW", "fetchedPages": 1}]}}}
    return out


def test_parser():
    kind, fields = Parser('query Q($a: [Int!] = [1]) { x: f(a: $a, b: {c: "d\\"e", e: [1, -2.5, true]}, k: ANIME) { g h { i } } # end\n }').operation()
    f = fields[0]
    assert (kind, f.alias, f.name, [x.name for x in f.fields], f.fields[1].fields[0].name) == ("query", "x", "f", ["g", "h"], "i")
    assert f.arguments == {"a": "a", "b": {"c": 'd"e', "e": [1, -2.5, True]}, "k": "ANIME"}
    for bad in ("{", "{ f(a) }", "subscription { f }", "{ f(a: ) }", "{ 1 }", "{ f ? }"):
        with pytest.raises(BadQuery):
            Parser(bad).operation()


def test_queries(service):
    ask = lambda q, **v: service.execute(q, v)
    one = "id name mediaKind nsfw aliases externalIds { source sourceId } fieldProvenance { fieldName score }"
    got = ask(f'query($i: String!) {{ health mediaByExternalId(source: TVMAZE, sourceId: $i) {{ {one} }} }}', i="1")["data"]
    media = got["mediaByExternalId"]
    assert got["health"] == "ok" and (media["name"], media["mediaKind"], media["nsfw"]) == ("Show 1", "SHOW", False)
    assert {x["source"] for x in media["externalIds"]} == {"TVMAZE", "IMDB"} and media["fieldProvenance"]
    assert ask(f"{{ media(id: {media['id']}) {{ titleDisplay }} none: media(id: 99) {{ id }} }}") == {"data": {"media": {"titleDisplay": "Show 1"}, "none": None}}
    hits = ask('{ search(query: "show", options: {limit: 0, mediaKind: SHOW}) { mediaId name score } }')["data"]["search"]
    assert len(hits) == 1 and hits[0]["score"] > 0
    assert ask('{ syncState(source: TVMAZE, scope: "show") { source page mode } other: syncState(source: IMDB, scope: "all") { page } }') == {"data": {"syncState": {"source": "TVMAZE", "page": 0, "mode": "FULL"}, "other": None}}


def test_remote_and_errors(service):
    got = service.execute('{ remoteSearch(source: TVMAZE, query: "show", options: {limit: 1}) { id name } remoteMedia(source: TVMAZE, sourceId: "1", mediaKind: SHOW) { titleDisplay } none: remoteMedia(source: TVMAZE, sourceId: "9", mediaKind: SHOW) { id } }')
    assert got == {"data": {"remoteSearch": [{"id": -1, "name": "Show 1"}], "remoteMedia": {"titleDisplay": "Show 1"}, "none": None}}
    bad = service.execute('{ health remoteSearch(source: IMDB, query: "x") { id } media(id: 0) { nothing } unknown }')
    assert bad["data"] == {"health": "ok", "remoteSearch": None, "media": None, "unknown": None}
    assert [e["path"] for e in bad["errors"]] == [["remoteSearch"], ["media"], ["unknown"]]
    assert "data" not in service.execute("{ health")


def test_sync_of_one_source(service):
    got = service.execute("mutation { syncDatabase(input: {source: TVMAZE, mediaKind: SHOW}) { totalUpsertedRecords outcomes { lastPage } } }")
    assert got["data"]["syncDatabase"]["outcomes"] == [{"lastPage": 1}]
    assert "errors" in service.execute("mutation { syncDatabase(input: {source: MYANIMELIST}) { totalUpsertedRecords } }")


def test_routes(service):
    assert service.respond("GET", "/healthz") == (200, "ok")
    assert service.respond("POST", "/graphql", "no")[0] == 400 and service.respond("GET", "/x")[0] == 404
    server = serve(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        assert urlopen(f"{base}/healthz").read() == b"ok"
        assert json.loads(urlopen(Request(f"{base}/graphql", json.dumps({"query": "{ health }"}).encode())).read()) == {"data": {"health": "ok"}}
    finally:
        server.shutdown()
        server.server_close()
