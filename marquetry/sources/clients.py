"""Requests of the four paged sources, over a transport that is given.

A transport takes a `Request` and gives a `Response`; `http_transport` is one over the network, tests give one of
recorded pages. A client knows its source's address, proxy and timeout, waits when the source asks to, and takes a missing page or
item for none. What a source gives are JSON texts, one an item, which `marquetry.sources.payloads` projects.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from urllib.error import HTTPError
from urllib.parse import urlencode
from urllib.request import ProxyHandler, build_opener
from urllib.request import Request as UrlRequest

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.sources import payloads
from marquetry.sources.paged import LIMITS, TooManyRequests, page_offset, page_size, retried
from marquetry.sources.payloads import LISTS
from marquetry.sources.remote import NotSupported, RemoteSource

# Where the sources are, and how long an answer may take.
ADDRESSES = {"anilist": "https://graphql.anilist.co", "jikan": "https://api.jikan.moe/v4", "kitsu": "https://kitsu.io/api/edge", "tvmaze": "https://api.tvmaze.com"}
TIMEOUT = 30.0
#: Hits of a trending list, and of a search without a limit.
TRENDING, HITS = 50, 20


@dataclass(frozen=True)
class Request:
    url: str
    params: tuple[tuple[str, str], ...] = ()
    body: str | None = None
    timeout: float = TIMEOUT
    proxy: str | None = None


@dataclass(frozen=True)
class Response:
    status: int
    text: str
    retry_after: float | None = None


Transport = Callable[[Request], Response]


class Failed(OSError):
    """A source's answer that is an error."""


def http_transport(request: Request) -> Response:
    """Over the network: a body is posted as JSON."""
    url = request.url + (f"?{urlencode(request.params)}" if request.params else "")
    opener = build_opener(ProxyHandler({"http": request.proxy, "https": request.proxy} if request.proxy else None))
    own = UrlRequest(url, request.body.encode() if request.body else None, {"Accept": "application/json", "Content-Type": "application/json"})
    try:
        with opener.open(own, timeout=request.timeout) as answer:
            return Response(answer.status, answer.read().decode())
    except HTTPError as e:
        after = e.headers.get("Retry-After")
        return Response(e.code, e.read().decode(errors="replace"), float(after) if after and after.isdigit() else None)


def _file_of(folder: str, request: Request) -> Path:
    asked = json.dumps([request.url, sorted(request.params), request.body])
    return Path(folder) / f"{hashlib.sha1(asked.encode()).hexdigest()}.json"


def recording(folder: str, transport: Transport = http_transport) -> Transport:
    """Asks another transport and keeps each answer as a file."""

    def ask(request: Request) -> Response:
        answer = transport(request)
        Path(folder).mkdir(parents=True, exist_ok=True)
        _file_of(folder, request).write_text(json.dumps({"url": request.url, "status": answer.status, "text": answer.text}))
        return answer

    return ask


def recorded(folder: str) -> Transport:
    """Answers from files that `recording` has kept, which whoever asks must see; what wasn't asked then isn't there."""

    def ask(request: Request) -> Response:
        own = _file_of(folder, request)
        if not own.exists():
            return Response(404, "")
        kept = json.loads(own.read_text())
        return Response(kept["status"], kept["text"])

    return ask


@dataclass(frozen=True)
class Client:
    """``replaced`` by `dataclasses.replace`: another address, a proxy, a timeout."""

    source: str
    transport: Transport = http_transport
    address: str | None = None
    proxy: str | None = None
    timeout: float = TIMEOUT
    retries: int = 3
    sleep: Callable[[float], None] = field(default=time.sleep, compare=False)

    def ask(self, path: str = "", params: dict[str, object] | None = None, body: dict | None = None) -> dict | list | None:
        """The answer's JSON; None where there is no such thing."""
        base = (self.address or ADDRESSES[self.source]).rstrip("/")
        request = Request(base + path, tuple((k, str(v)) for k, v in (params or {}).items()), json.dumps(body) if body else None, self.timeout, self.proxy)

        def once() -> Response:
            answer = self.transport(request)
            if answer.status == 429:
                raise TooManyRequests(answer.retry_after)
            return answer

        answer = retried(once, self.retries, sleep=self.sleep)
        if answer.status == 404:
            return None
        if answer.status >= 400:
            raise Failed(f"{self.source} answered {answer.status}: {answer.text[:200]}")
        return json.loads(answer.text)


def _texts(items: list | None) -> list[str]:
    return [json.dumps(x, ensure_ascii=False) for x in items or () if x is not None]


def _number(source: str, source_id: str) -> int:
    try:
        return int(source_id)
    except ValueError:
        raise ValueError(f"{source} has no id {source_id}: its ids are numbers") from None


class Source:
    """What a source answers. Lists are JSON texts; a page comes with whether another follows."""

    name: str

    def __init__(self, client: Client | None = None) -> None:
        self.client = client or Client(self.name)

    def page(self, kind: str, number: int, size: int) -> tuple[list[str], bool]:
        raise NotSupported(f"{self.name} has no pages")

    def search(self, kind: str, query: str, limit: int = HITS, page: int = 1) -> list[str]:
        """Nothing for an empty query, which isn't sent."""
        return self._search(kind, query.strip(), page_size(limit, self.name), page) if query.strip() else []

    #: Whether a search has pages; else its one answer has all hits.
    SEARCH_PAGES = True

    def hits(self, kind: str, query: str, limit: int = HITS, offset: int = 0) -> list[str]:
        """``limit`` hits of a search from ``offset`` on, over as many pages as they take, with the source's interval between them."""
        query, limit, offset = query.strip(), max(limit, 1), max(offset, 0)
        if not query:
            return []
        if not self.SEARCH_PAGES:
            return self._search(kind, query, offset + limit, 1)[offset : offset + limit]
        size = page_size(limit, self.name)
        page, skip = divmod(offset, size)
        out: list[str] = []
        while True:
            page += 1
            found = self._search(kind, query, size, page)
            out += found
            if len(found) < size or len(out) >= skip + limit:
                return out[skip : skip + limit]
            self.client.sleep(LIMITS[self.name].interval)

    def _search(self, kind: str, query: str, size: int, page: int) -> list[str]:
        raise NotSupported(f"{self.name} has no search")

    def one(self, kind: str, source_id: str) -> list[str]:
        raise NotSupported(f"{self.name} has no lookup")

    def trending(self, kind: str) -> list[str]:
        raise NotSupported(f"{self.name} has no trending list")

    def recommendations(self, kind: str, source_id: str) -> list[str]:
        raise NotSupported(f"{self.name} has no recommendations")

    def related(self, kind: str, source_id: str) -> list[str]:
        raise NotSupported(f"{self.name} has no related items")

    def episodes(self, kind: str, source_id: str) -> list[str]:
        raise NotSupported(f"{self.name} has no episodes")

    def pages(self, kind: str) -> Callable[[int, int], tuple[list[str], bool]]:
        """Pages of a kind, as a sync asks for them."""
        return lambda number, size: self.page(kind, number, size)


class GraphSource(Source):
    name = "anilist"
    #: What the projection reads of an item.
    FIELDS = " ".join(
        (
            "id idMal siteUrl updatedAt isAdult averageScore", "title { romaji english native } synonyms description(asHtml: false)",
            "format status season seasonYear episodes chapters volumes countryOfOrigin", "genres tags { name } bannerImage coverImage { medium large extraLarge }",
        )
    )
    LAST = "Page must be between"

    def _ask(self, arguments: str, selection: str, **variables: object) -> dict | None:
        answer = self.client.ask(body={"query": f"query ({arguments}) {{ {selection} }}", "variables": variables})
        errors = [e.get("message", "") for e in (answer or {}).get("errors") or ()]
        if any(self.LAST in e for e in errors) or any(e.get("status") == 404 for e in (answer or {}).get("errors") or ()):
            return None  # beyond the last page, or no such item
        if errors:
            raise Failed(f"{self.name}: {'; '.join(errors)}")
        return (answer or {}).get("data")

    def _page(self, kind: str, number: int, size: int, **more: object) -> tuple[list[str], bool]:
        filters = "type: $type, sort: $sort" + (", search: $search" if "search" in more else "")
        arguments = "$page: Int, $size: Int, $type: MediaType, $sort: [MediaSort]" + (", $search: String" if "search" in more else "")
        selection = f"Page(page: $page, perPage: $size) {{ pageInfo {{ hasNextPage }} media({filters}) {{ {self.FIELDS} }} }}"
        data = self._ask(arguments, selection, page=number, size=size, type=LISTS[kind].upper(), **more)
        found = (data or {}).get("Page") or {}
        return _texts(found.get("media")), bool((found.get("pageInfo") or {}).get("hasNextPage"))

    def page(self, kind: str, number: int, size: int) -> tuple[list[str], bool]:
        return self._page(kind, number, page_size(size, self.name), sort=["ID"])

    def _search(self, kind: str, query: str, size: int, page: int) -> list[str]:
        return self._page(kind, page, size, sort=["SEARCH_MATCH"], search=query)[0]

    def trending(self, kind: str) -> list[str]:
        return self._page(kind, 1, TRENDING, sort=["TRENDING_DESC"])[0]

    def _item(self, kind: str, source_id: str, selection: str) -> dict:
        data = self._ask("$id: Int, $type: MediaType", f"Media(id: $id, type: $type) {{ {selection} }}", id=_number(self.name, source_id), type=LISTS[kind].upper())
        return (data or {}).get("Media") or {}

    def one(self, kind: str, source_id: str) -> list[str]:
        return _texts([self._item(kind, source_id, self.FIELDS) or None])

    def recommendations(self, kind: str, source_id: str) -> list[str]:
        found = self._item(kind, source_id, f"recommendations {{ edges {{ node {{ mediaRecommendation {{ {self.FIELDS} }} }} }} }}").get("recommendations") or {}
        return _texts([((e or {}).get("node") or {}).get("mediaRecommendation") for e in found.get("edges") or ()])

    def related(self, kind: str, source_id: str) -> list[str]:
        found = self._item(kind, source_id, f"relations {{ edges {{ node {{ {self.FIELDS} }} }} }}").get("relations") or {}
        return _texts([(e or {}).get("node") for e in found.get("edges") or ()])


class RestSource(Source):
    name = "jikan"

    def _data(self, path: str, **params: object) -> tuple[object, dict]:
        answer = self.client.ask(path, params) or {}
        return answer.get("data"), answer.get("pagination") or {}

    def page(self, kind: str, number: int, size: int) -> tuple[list[str], bool]:
        items, pages = self._data(f"/{LISTS[kind]}", page=number, limit=page_size(size, self.name), sfw="false")
        return _texts(items), bool(pages.get("has_next_page"))

    def _search(self, kind: str, query: str, size: int, page: int) -> list[str]:
        return _texts(self._data(f"/{LISTS[kind]}", q=query, limit=size, page=page, sfw="false")[0])

    def one(self, kind: str, source_id: str) -> list[str]:
        return _texts([self._data(f"/{LISTS[kind]}/{_number(self.name, source_id)}")[0]])

    def trending(self, kind: str) -> list[str]:
        return _texts(self._data(f"/top/{LISTS[kind]}", sfw="false")[0])

    def recommendations(self, kind: str, source_id: str) -> list[str]:
        found = self._data(f"/{LISTS[kind]}/{_number(self.name, source_id)}/recommendations")[0]
        return _texts([(e or {}).get("entry") for e in found or ()])

    def related(self, kind: str, source_id: str) -> list[str]:
        found = self._data(f"/{LISTS[kind]}/{_number(self.name, source_id)}/relations")[0]
        return _texts([e for group in found or () for e in group.get("entry") or ()])

    def episodes(self, kind: str, source_id: str) -> list[str]:
        """All pages, with the source's interval between them; other kinds than anime have none."""
        if kind != "anime":
            return []
        out, number = [], 1
        while True:
            items, pages = self._data(f"/anime/{_number(self.name, source_id)}/episodes", page=number)
            out += _texts(items)
            if not items or not pages.get("has_next_page"):
                return out
            number += 1
            self.client.sleep(LIMITS[self.name].interval)


class ApiSource(Source):
    """Its items come with the resources that the answer sideloads: ``{"data": ..., "included": [...]}``."""

    name = "kitsu"
    WITH = {"include": "categories,mappings"}

    @staticmethod
    def _split(answer: dict | None) -> list[dict]:
        data = (answer or {}).get("data") or []
        by_id = {(r.get("type"), r.get("id")): r for r in reversed((answer or {}).get("included") or ())}
        out = []
        for item in data if isinstance(data, list) else [data]:
            refs = [(r.get("type"), r.get("id")) for part in (item.get("relationships") or {}).values() for r in _as_list((part or {}).get("data"))]
            out.append({"data": item, "included": [by_id[r] for r in dict.fromkeys(refs) if r in by_id]})
        return out

    def page(self, kind: str, number: int, size: int) -> tuple[list[str], bool]:
        size = page_size(size, self.name)
        answer = self.client.ask(f"/{LISTS[kind]}", {"page[limit]": size, "page[offset]": page_offset(number, size), "sort": "id", **self.WITH})
        return _texts(self._split(answer)), bool(((answer or {}).get("links") or {}).get("next"))

    def _search(self, kind: str, query: str, size: int, page: int) -> list[str]:
        params = {"filter[text]": query, "page[limit]": size, "page[offset]": page_offset(page, size), **self.WITH}
        return _texts(self._split(self.client.ask(f"/{LISTS[kind]}", params)))

    def one(self, kind: str, source_id: str) -> list[str]:
        return _texts(self._split(self.client.ask(f"/{LISTS[kind]}/{source_id}", self.WITH)))

    def trending(self, kind: str) -> list[str]:
        return _texts(self._split(self.client.ask(f"/trending/{LISTS[kind]}")))

    def episodes(self, kind: str, source_id: str, first_page_only: bool = False) -> list[str]:
        """All pages, with the source's interval between them, or the first twenty."""
        size, out = LIMITS[self.name].page_size, []
        while True:
            answer = self.client.ask(f"/{LISTS[kind]}/{source_id}/episodes", {"page[limit]": size, **({"page[offset]": len(out)} if out else {})}) or {}
            found = _texts(answer.get("data"))
            out += found
            if first_page_only or not found or not (answer.get("links") or {}).get("next"):
                return out
            self.client.sleep(LIMITS[self.name].interval)


def _as_list(x: object) -> list:
    return x if isinstance(x, list) else [] if x is None else [x]


class ShowSource(Source):
    name = "tvmaze"
    SEARCH_PAGES = False

    def page(self, kind: str, number: int, size: int) -> tuple[list[str], bool]:
        """Pages are as large as the source makes them, and end where one is missing or empty."""
        items = self.client.ask("/shows", {"page": number})
        return _texts(items), bool(items)

    def _search(self, kind: str, query: str, size: int, page: int) -> list[str]:
        found = self.client.ask("/search/shows", {"q": query, "limit": size}) or []
        return _texts([(x or {}).get("show") for x in found])[:size]

    def one(self, kind: str, source_id: str) -> list[str]:
        return _texts([self.client.ask(f"/shows/{source_id}")])

    def trending(self, kind: str) -> list[str]:
        return _texts(self.client.ask("/shows", {"page": 0}))[:TRENDING]

    def episodes(self, kind: str, source_id: str) -> list[str]:
        return _texts(self.client.ask(f"/shows/{source_id}/episodes")) if kind == "show" else []


#: Kinds of items that each source has.
LISTS_OF = {"anilist": ("anime", "manga"), "jikan": ("anime", "manga"), "kitsu": ("anime", "manga"), "tvmaze": ("show",)}
SOURCES: dict[str, type[Source]] = {c.name: c for c in (GraphSource, RestSource, ApiSource, ShowSource)}


def with_included(rows: DataFrame) -> DataFrame:
    """Rows of a sideloading source: ``raw_json`` is the item, ``included_json`` what came with it."""
    part = lambda name: F.get_json_object("raw_json", f"$.{name}")
    return rows.withColumn("included_json", part("included")).withColumn("raw_json", part("data"))


#: Canonical rows of a source's items, and of its episodes.
PROJECTIONS: dict[str, Callable[[DataFrame, str], DataFrame]] = {
    "anilist": payloads.graph_media,
    "jikan": payloads.rest_media,
    "kitsu": lambda rows, kind: payloads.api_media(with_included(rows), kind),
    "tvmaze": lambda rows, kind: payloads.shows(rows),
}
EPISODES: dict[str, Callable[[DataFrame, str], DataFrame]] = {
    "jikan": lambda rows, kind: payloads.rest_episodes(rows),
    "kitsu": payloads.api_episodes,
    "tvmaze": lambda rows, kind: payloads.show_episodes(rows),
}


def frame(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "seq long, raw_json string")


def remote(spark: SparkSession, name: str, client: Client | None = None) -> RemoteSource:
    """The source as a set of readers of canonical rows."""
    own, project = SOURCES[name](client), PROJECTIONS[name]

    def entries(rows: DataFrame, kind: str | None) -> DataFrame:
        return payloads.rest_entries(rows, kind) if name == "jikan" else project(rows, kind)

    def reader(texts: Callable[..., list[str]], project: Callable[[DataFrame, str], DataFrame]) -> Callable[..., DataFrame]:
        return lambda kind, *more: project(frame(spark, texts(kind, *more)), kind).drop("seq")

    def has(what: str) -> bool:
        return getattr(type(own), what) is not getattr(Source, what)

    parts = {"search": project, "hits": project, "by_id": project, "trending": project, "recommendations": entries, "related": lambda r, k: entries(r, None if name == "jikan" else k)}
    calls = {"search": own.search, "hits": own.hits, "by_id": own.one, "trending": own.trending, "recommendations": own.recommendations, "related": own.related}
    methods = {"search": "_search", "hits": "_search", "by_id": "one"}
    readers = {k: reader(calls[k], p) for k, p in parts.items() if has(methods.get(k, k))}
    if name in EPISODES:
        readers["episodes"] = reader(own.episodes, EPISODES[name])
    return RemoteSource(name, **readers)


def all_pages(source: Source, kind: str, most: int | None = None) -> Iterator[str]:
    """Items of all pages, with the source's interval between them."""
    limits = LIMITS[source.name]
    number = limits.first_page
    while (limits.last_page is None or number <= limits.last_page) and (most is None or number < limits.first_page + most):
        items, more = source.page(kind, number, limits.page_size)
        yield from items
        if not items or not more:
            return
        number += 1
        source.client.sleep(limits.interval)
