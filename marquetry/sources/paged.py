"""Paged sources as Spark data sources.

A fetch function (a module's function, named ``module:function``) gives the items of a page as JSON texts
and whether there are more; a partition reads one page, or one after another with the source's interval
between them. Pages are also a stream, whose offset is the next page; its batches are read by many tasks, which keep
the interval together.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from marquetry.sources.pacing import Lanes, Pace

Fetch = Callable[[int, int], tuple[list[str], bool]]
#: Pages of a stream that doesn't say where it ends.
AHEAD = 8


@dataclass(frozen=True)
class Limits:
    """Seconds between pages, rows of a page at most, the first page, and the last one that may be asked for."""

    interval: float
    page_size: int
    first_page: int = 1
    last_page: int | None = None


# What each source allows.
LIMITS = {
    "anilist": Limits(0.7, 50, last_page=100),
    "jikan": Limits(1.1, 25),
    "kitsu": Limits(0.9, 20),
    "tvmaze": Limits(0.5, 250, first_page=0),
    "imdb": Limits(0.0, 500),
}


class TooManyRequests(OSError):
    """The source asks to wait; ``after`` is the seconds it names."""

    def __init__(self, after: float | None = None) -> None:
        super().__init__("too many requests")
        self.after = after


def page_size(wanted: int, source: str) -> int:
    return max(1, min(wanted, LIMITS[source].page_size))


def page_offset(page: int, size: int) -> int:
    return max(0, page - 1) * size


def retried(call: Callable[[], object], retries: int = 3, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep):
    """Calls again after TooManyRequests: after what the source names and a second, else after a time that doubles."""
    for left in range(retries, -1, -1):
        try:
            return call()
        except TooManyRequests as e:
            if not left:
                raise
            sleep(wait if e.after is None else e.after + 1)
            wait *= 2


def resolve(name: str) -> Fetch:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class _Page(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class _Turns(InputPartition):
    """The pages of a task, and its lane among those that share the source's interval."""

    def __init__(self, pages: range, lanes: Lanes, lane: int) -> None:
        self.pages, self.lanes, self.lane = pages, lanes, lane


class _Options:
    def __init__(self, options: dict) -> None:
        self.source = options.get("source", "imdb")
        limits = LIMITS[self.source]
        self.fetch, self.size = options["fetch"], page_size(int(options.get("page_size", 50)), self.source)
        self.first = int(options.get("start_page", limits.first_page))
        self.max_pages = int(options.get("max_pages", 0)) or None
        self.last = limits.last_page
        self.interval = float(options.get("interval", limits.interval))

    def page(self, number: int) -> tuple[list[str], bool]:
        items, more = retried(lambda: resolve(self.fetch)(number, self.size))
        return items, more and bool(items)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.o = _Options(options)

    def partitions(self) -> list[InputPartition]:
        """One partition if only the source knows where pages end; of a stated number each page is one."""
        if self.o.max_pages and not self.o.interval:
            return [_Page(p, p) for p in range(self.o.first, self.o.first + self.o.max_pages)]
        last = self.o.first + self.o.max_pages - 1 if self.o.max_pages else 1 << 30
        return [_Page(self.o.first, last)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        for number in range(partition.first, partition.last + 1):
            if self.o.last and number > self.o.last:
                return
            items, more = self.o.page(number)
            for i, item in enumerate(items):
                yield (self.o.source, number, i, item)
            if not more or number == partition.last:
                return
            time.sleep(self.o.interval)


class _StreamReader(DataSourceStreamReader):
    """Pages between offsets, read in tasks. The offset is the next page; where the stream ends for now is an option, ``end_page``,
    else ``max_pages``, else AHEAD pages. A page behind which there is none is followed by a row without an item at place -1."""

    def __init__(self, options: dict) -> None:
        self.o = _Options(options)
        self.end = int(options.get("end_page", self.o.first + (self.o.max_pages or AHEAD)))
        self.tasks = int(options.get("tasks", 4))

    def initialOffset(self) -> dict:
        return {"page": self.o.first}

    def latestOffset(self) -> dict:
        return {"page": max(self.o.first, min(self.end, (self.o.last or self.end) + 1))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Pages are dealt in turn, so that tasks go through them side by side."""
        pages = range(start["page"], end["page"])
        lanes = Lanes(time.time(), self.o.interval, max(1, min(self.tasks, len(pages))))
        return [_Turns(pages[i :: lanes.lanes], lanes, i) for i in range(lanes.lanes)] if pages else []

    def read(self, partition: _Turns) -> Iterator[tuple]:
        pace = Pace(partition.lanes, partition.lane)
        for number in partition.pages:
            pace.wait()
            items, more = self.o.page(number)
            for i, item in enumerate(items):
                yield (self.o.source, number, i, item)
            if not more:
                yield (self.o.source, number, -1, None)
                return

    def commit(self, end: dict) -> None:
        """Nothing is kept here: a batch is done when the catalog's log names it."""


class PagedSource(DataSource):
    """``spark.read.format("marquetry_pages").option("fetch", "module:function").option("source", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "marquetry_pages"

    def schema(self) -> str:
        return "source string, page int, pos int, raw_json string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802  Spark's name
        return _StreamReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(PagedSource)

