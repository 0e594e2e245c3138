"""The catalog over GraphQL: a small parser of queries, resolvers over `Catalog`, `Sync` and the remote sources, and HTTP routes.

A query's selection decides which columns and tables are read. Names are in camel case and values of domains in upper
case; what isn't found is null; limits below one are one and offsets below zero are zero. `Service.respond` answers a request without a
server; `serve` puts it behind the standard library's.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.api import Catalog
from marquetry.operators.search import SearchOptions
from marquetry.schemas import MEDIA, MEDIA_KINDS
from marquetry.sources import clients
from marquetry.sources.clients import Source
from marquetry.streaming.sync import Sync, SyncReport, SyncRequest

_TOKEN = re.compile(r'\s*(?:#[^\n]*\s*)*(\.\.\.|"(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|[A-Za-z_]\w*|[{}()\[\]:!=$,])')


class BadQuery(ValueError):
    """A query that can't be read, or names what isn't there."""


@dataclass
class Field:
    name: str
    alias: str
    arguments: dict = field(default_factory=dict)
    fields: list[Field] = field(default_factory=list)


class _Variable(str):
    pass


class Parser:
    """Operations with variables, arguments, aliases and nested selections; no fragments or directives."""

    def __init__(self, text: str) -> None:
        self.tokens, at, text = [], 0, text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise BadQuery(f"unreadable at: {text[at : at + 20]}")
            if m[1] != ",":
                self.tokens.append(m[1])
            at = m.end()
        self.tokens.append("")
        self.at = 0

    def next(self, wanted: str | None = None) -> str:
        token = self.tokens[self.at]
        if wanted is not None and token != wanted:
            raise BadQuery(f"expected {wanted}, found {token or 'the end'}")
        self.at += 1
        return token

    def here(self, token: str) -> bool:
        return self.tokens[self.at] == token

    def operation(self) -> tuple[str, list[Field]]:
        kind = "query"
        if not self.here("{"):
            kind = self.next()
            if kind not in ("query", "mutation"):
                raise BadQuery(f"unknown operation: {kind}")
            while not self.here("{"):  # its name, and the types of variables
                if not self.next():
                    raise BadQuery("an operation without a selection")
        return kind, self.selection()

    def selection(self) -> list[Field]:
        self.next("{")
        out = []
        while not self.here("}"):
            name = alias = self.next()
            if not re.fullmatch(r"[A-Za-z_]\w*", name):
                raise BadQuery(f"no field: {name or 'the end'}")
            if self.here(":"):
                self.next()
                name = self.next()
            one = Field(name, alias)
            if self.here("("):
                self.next()
                while not self.here(")"):
                    key = self.next()
                    self.next(":")
                    one.arguments[key] = self.value()
                self.next()
            if self.here("{"):
                one.fields = self.selection()
            out.append(one)
        self.next()
        return out

    def value(self) -> object:
        token = self.next()
        if token == "$":
            return _Variable(self.next())
        if token == "[":
            out = []
            while not self.here("]"):
                out.append(self.value())
            self.next()
            return out
        if token == "{":
            pairs = {}
            while not self.here("}"):
                key = self.next()
                self.next(":")
                pairs[key] = self.value()
            self.next()
            return pairs
        if token[:1] == '"' or re.match(r"-?\d", token) or token in ("true", "false", "null"):
            return json.loads(token)
        if not re.fullmatch(r"[A-Za-z_]\w*", token):
            raise BadQuery(f"no value: {token or 'the end'}")
        return token  # of a domain


def bound(value: object, variables: dict) -> object:
    if isinstance(value, _Variable):
        return variables.get(value)
    if isinstance(value, dict):
        return {k: bound(v, variables) for k, v in value.items()}
    return [bound(v, variables) for v in value] if isinstance(value, list) else value


def snake(name: str) -> str:
    return re.sub(r"[A-Z]", lambda m: "_" + m[0].lower(), name)


#: Columns whose values are of a domain.
_DOMAINS = ("media_kind", "source", "mode")
#: Lists of a media's own tables: name, table, order, columns.
_LISTS = {
    "external_ids": ("media_external_id", "source", ("source", "source_id", "url")),
    "source_payloads": ("source_record", "source", ("source", "source_id", "url", "remote_updated_at", "raw_json")),
    "field_provenance": ("field_provenance", "field_name", ("field_name", "source", "source_id", "score", "reason", "updated_at")),
}


def shaped(row: dict, fields: list[Field]) -> dict:
    """The selected fields of a row."""
    out = {}
    for f in fields:
        name = snake(f.name)
        if f.name == "__typename" or name not in row:
            raise BadQuery(f"no field {f.name}")
        v = row[name]
        if isinstance(v, list) and f.fields:
            v = [shaped(x.asDict() if hasattr(x, "asDict") else x, f.fields) for x in v]
        elif name in _DOMAINS and isinstance(v, str):
            v = v.upper()
        out[f.alias] = v if v is None or isinstance(v, (bool, int, float, str, list)) else str(v)
    return out


class Service:
    """``sources`` are the ones that may be asked and synced; a dump's canonical rows are synced as one more."""

    def __init__(self, spark: SparkSession, path: str, sources: dict[str, Source] | None = None, dump: DataFrame | None = None) -> None:
        self.spark, self.catalog, self.dump = spark, Catalog(spark, path), dump
        self.sources = sources if sources is not None else {n: c() for n, c in clients.SOURCES.items()}

    # Queries

    def health(self, fields: list[Field]) -> str:
        return "ok"

    def _media(self, rows: DataFrame, fields: list[Field]) -> dict | None:
        """Of the media's tables only those are read that the selection names."""
        wanted = {snake(f.name) for f in fields}
        columns = [c for c in MEDIA.names if c in wanted - {"id", "name"}]
        title = ["title_display"] if "name" in wanted and "title_display" not in columns else []
        found = rows.select("media_id", *columns, *title).first()
        if found is None:
            return None
        own = found.asDict() | {"id": found["media_id"], "name": found["title_display"] if "name" in wanted else None}
        of = F.col("media_id") == found["media_id"]
        for name in wanted & set(_LISTS):
            table, order, names = _LISTS[name]
            own[name] = self.catalog.table(table).where(of).orderBy(order).select(*names).collect()
        if "aliases" in wanted:
            own["aliases"] = [r[0] for r in self.catalog.table("media_alias").where(of).orderBy("alias").select("alias").collect()]
        return shaped(own, fields)

    def media(self, fields: list[Field], id: int) -> dict | None:  # noqa: A002  the argument's name
        return self._media(self.catalog.get(int(id)), fields)

    def media_by_external_id(self, fields: list[Field], source: str, source_id: str, media_kind: str | None = None) -> dict | None:
        return self._media(self.catalog.by_external_id(source.lower(), source_id, media_kind and media_kind.lower()), fields)

    @staticmethod
    def options(given: dict | None) -> SearchOptions:
        given = given or {}
        kind, most, skip = given.get("mediaKind"), given.get("limit"), given.get("offset")
        default = SearchOptions()
        return SearchOptions(default.limit if most is None else max(most, 1), max(skip or 0, 0), kind and kind.lower(), given.get("format"))

    def search(self, fields: list[Field], query: str, options: dict | None = None) -> list[dict]:
        hits = self.catalog.search(query, self.options(options))
        return [shaped(r.asDict() | {"name": r["title_display"]}, fields) for r in hits.collect()]

    def sync_state(self, fields: list[Field], source: str, scope: str) -> dict | None:
        found = Sync(self.catalog).state(source.lower(), scope)
        return found and shaped(found, fields)

    def _source(self, name: str) -> Source:
        if name.lower() not in self.sources:
            raise BadQuery(f"{name} can't be asked directly")
        return self.sources[name.lower()]

    def _remote_rows(self, rows: DataFrame, fields: list[Field]) -> list[dict]:
        """Rows that no catalog has are numbered -1."""
        empty = {"id": -1, "field_provenance": []}
        return [shaped(r.asDict() | empty | {"name": r["title_display"]}, fields) for r in rows.collect()]

    def remote_search(self, fields: list[Field], source: str, query: str, options: dict | None = None) -> list[dict]:
        own, o = self._source(source), self.options(options)
        kind = o.media_kind or ("show" if own.name == "tvmaze" else "anime")
        found = clients.remote(self.spark, own.name, own.client).hits(kind, query, o.limit, o.offset)
        if o.format is not None:
            found = found.where(F.upper(F.coalesce("format", F.lit(""))) == o.format.upper())
        return self._remote_rows(found, fields)

    def remote_media(self, fields: list[Field], source: str, source_id: str, media_kind: str) -> dict | None:
        own = self._source(source)
        if media_kind.lower() not in MEDIA_KINDS:
            raise BadQuery(f"unknown media kind: {media_kind}")
        found = self._remote_rows(clients.remote(self.spark, own.name, own.client).by_id(media_kind.lower(), source_id), fields)
        return found[0] if found else None

    # Mutations

    @staticmethod
    def _report(report: SyncReport, fields: list[Field]) -> dict:
        outcomes = [{"source": o.source, "media_kind": o.media_kind, "fetched_pages": o.fetched_pages, "upserted_records": o.upserted, "last_page": o.last_page} for o in report.outcomes]
        return shaped({"total_upserted_records": report.upserted, "outcomes": outcomes}, fields)

    def generate_database(self, fields: list[Field], max_pages: int | None = None) -> dict:
        more = {} if max_pages is None else {"max_pages": max(max_pages, 1)}
        return self._report(Sync(self.catalog).sync_default_sources(self.sources, self.dump, **more), fields)

    def sync_database(self, fields: list[Field], input: dict | None = None) -> dict:  # noqa: A002
        given = input or {}
        more = {k: max(given[c], 1) for c, k in (("pageSize", "page_size"), ("maxPages", "max_pages")) if given.get(c) is not None}
        if not given.get("source"):
            return self._report(Sync(self.catalog).sync_default_sources(self.sources, self.dump, **{k: v for k, v in more.items() if k == "max_pages"}), fields)
        own, kind = self._source(given["source"]), given.get("mediaKind")
        kind = kind and kind.lower()
        project = clients.PROJECTIONS[own.name]
        fallback = kind or ("show" if own.name == "tvmaze" else "anime")
        outcome = Sync(self.catalog).run(own.name, own.pages(fallback), lambda rows: project(rows, fallback), SyncRequest(own.name, kind, **more))
        return self._report(SyncReport([outcome]), fields)

    QUERIES = {"health": health, "media": media, "mediaByExternalId": media_by_external_id, "search": search, "syncState": sync_state, "remoteSearch": remote_search, "remoteMedia": remote_media}
    MUTATIONS = {"generateDatabase": generate_database, "syncDatabase": sync_database}

    def execute(self, query: str, variables: dict | None = None) -> dict:
        """``data``, and ``errors`` of the fields that failed; a query that can't be read has errors only."""
        try:
            kind, fields = Parser(query).operation()
        except BadQuery as e:
            return {"errors": [{"message": str(e)}]}
        data, errors = {}, []
        for f in fields:
            try:
                known = self.QUERIES if kind == "query" else self.MUTATIONS
                if f.name not in known:
                    raise BadQuery(f"no field {f.name}")
                arguments = {snake(k): v for k, v in bound(f.arguments, variables or {}).items()}
                data[f.alias] = known[f.name](self, f.fields, **arguments)
            except Exception as e:  # noqa: BLE001  a field's failure is its own
                data[f.alias] = None
                errors.append({"message": str(e).split("\n")[0], "path": [f.alias]})
        return {"data": data} | ({"errors": errors} if errors else {})

    def respond(self, method: str, path: str, body: str = "") -> tuple[int, dict | str]:
        if method == "GET" and path == "/healthz":
            return 200, "ok"
        if method == "POST" and path in ("/", "/graphql"):
            try:
                asked = json.loads(body)
                return 200, self.execute(asked["query"], asked.get("variables"))
            except (ValueError, KeyError, TypeError):
                return 400, {"errors": [{"message": "a JSON object with a query is wanted"}]}
        return 404, {"errors": [{"message": f"nothing at {path}"}]}


def serve(service: Service, address: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that isn't started yet: ``serve(...).serve_forever()``."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, answer = service.respond(self.command, self.path, self.rfile.read(size).decode())
            text = (answer if isinstance(answer, str) else json.dumps(answer)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain" if isinstance(answer, str) else "application/json")
            self.send_header("Content-Length", str(len(text)))
            self.end_headers()
            self.wfile.write(text)

        do_GET = do_POST = _answer

        def log_message(self, *_: object) -> None:
            """Nothing is logged."""

    return ThreadingHTTPServer((address, port), Handler)
