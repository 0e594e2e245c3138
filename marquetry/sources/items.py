"""Items of a source as a table whose filters become the source's own requests.

``spark.read.format("marquetry_items").option("source", "tvmaze").load()`` has a row for each item. Filters on ``kind`` and
``source_id`` become lookups of those items, ``title`` with a text in it becomes the source's search, read page by page to its end;
without either all pages of the kinds are read. Spark applies every filter again to what comes back. Python data sources
get filters where ``spark.sql.python.filterPushdown.enabled`` is true, which `register` sets.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import product

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains

from marquetry.sources.clients import LISTS_OF, SOURCES, Client, Source, all_pages, http_transport
from marquetry.sources.paged import resolve

#: Where an item has its id and its titles, the first that is there.
_PLACES = {
    "anilist": ("id", ("title.romaji", "title.english", "title.native")),
    "jikan": ("mal_id", ("title", "name")),
    "kitsu": ("data.id", ("data.attributes.canonicalTitle", "data.attributes.titles.en", "data.attributes.titles.en_jp")),
    "tvmaze": ("id", ("name",)),
}
#: Hits of a search that are asked for at most, as a source may find any number.
MOST = 10_000


def _at(item: object, path: str) -> object:
    for part in path.split("."):
        item = item.get(part) if isinstance(item, dict) else None
    return item


class _Request(InputPartition):
    """A lookup, a search, or all pages of a kind; nothing without a kind."""

    def __init__(self, kind: str | None, source_id: str | None = None, query: str | None = None) -> None:
        self.kind, self.source_id, self.query = kind, source_id, query


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.name = options["source"]
        self.transport, self.address = options.get("transport"), options.get("address")
        own = options.get("kinds")
        self.kinds = [k for k in (own.split(",") if own else LISTS_OF[self.name])]
        self.ids: list[str] | None = None
        self.query: str | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            column = getattr(f, "attribute", None)
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is not None and column == ("kind",):
                self.kinds = [k for k in self.kinds if k in values]
            elif values is not None and column == ("source_id",):
                self.ids = [i for i in (self.ids or values) if i in values and i is not None]
            elif isinstance(f, StringContains) and column == ("title",) and f.value.strip():
                self.query = self.query or f.value
            yield f  # Spark applies it again

    def partitions(self) -> list[InputPartition]:
        if self.ids is not None:
            out = [_Request(k, i) for k, i in product(self.kinds, dict.fromkeys(self.ids))]
        else:
            out = [_Request(k, query=self.query) for k in self.kinds]
        return out or [_Request(None)]

    def _source(self) -> Source:
        return SOURCES[self.name](Client(self.name, resolve(self.transport) if self.transport else http_transport, self.address))

    def read(self, partition: _Request) -> Iterator[tuple]:
        if partition.kind is None:
            return
        source = self._source()
        if partition.source_id is not None:
            texts: Iterable[str] = source.one(partition.kind, partition.source_id)
        elif partition.query is not None:
            texts = source.hits(partition.kind, partition.query, MOST)
        else:
            texts = all_pages(source, partition.kind)
        own, titles = _PLACES[self.name]
        for text in texts:
            item = json.loads(text)
            title = next((t for t in (_at(item, p) for p in titles) if t is not None), None)
            source_id = _at(item, own)
            yield (self.name, partition.kind, None if source_id is None else str(source_id), title, text)


class ItemSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "marquetry_items"

    def schema(self) -> str:
        return "source string, kind string, source_id string, title string, raw_json string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ItemSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
