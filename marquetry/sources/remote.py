"""Sources queried directly, without a catalog.

A source is a set of readers that give canonical rows; what it lacks is an error that names it. Collections
scope a source to a kind and format. Episodes of many items are fetched in the executors, each item on its own:
one that fails leaves its error and no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquetry.functions.scalars import upper_ascii
from marquetry.operators import episodes
from marquetry.operators.search import SearchOptions, title_contains
from marquetry.sources.paged import retried
from marquetry.sources.pacing import Lanes, Pace
from marquetry.sources.registry import union_of
from marquetry.store import cut, drop_cuts

Reader = Callable[..., DataFrame]
#: Raw JSON texts of an item's episodes, by its id.
FetchItem = Callable[[str], list[str]]


class NotSupported(NotImplementedError):
    """A source that lacks an operation."""


@dataclass(frozen=True)
class RemoteSource:
    """``items(kind)`` gives all rows of a kind; the other readers are for what a source answers itself.

    ``hits(kind, query, limit, offset)`` is a search that knows its page; ``search(kind, query)`` gives what it gives.
    """

    name: str
    items: Reader | None = None
    search: Reader | None = None
    hits: Reader | None = None
    by_id: Reader | None = None
    trending: Reader | None = None
    recommendations: Reader | None = None
    related: Reader | None = None
    episodes: Reader | None = None

    def need(self, what: str) -> Reader:
        reader = getattr(self, what)
        if reader is None:
            raise NotSupported(f"{self.name} has no {what}")
        return reader


@dataclass(frozen=True)
class RemoteCollection:
    """One kind of a source, perhaps of one format."""

    source: RemoteSource
    kind: str
    format: str | None = None

    def search(self, query: str, options: SearchOptions = SearchOptions()) -> DataFrame:
        """The source's own search, else titles that have the query, in order of ids.

        Offset and limit come before the filter by format, as a source doesn't know that.
        """
        options = replace(options, format=self.format or options.format)
        if not query.strip():
            return self.source.need("items")(self.kind).limit(0)
        if self.source.hits is not None:
            found = self.source.hits(self.kind, query, max(options.limit, 1), max(options.offset, 0))
        elif self.source.search is not None:
            found = self.source.search(self.kind, query).offset(max(options.offset, 0)).limit(max(options.limit, 1))
        else:
            rows = self.source.need("items")(self.kind).withColumn("_id", F.col("external_ids")[0]["source_id"])
            found = title_contains(rows, query, max(options.offset, 0) + max(options.limit, 1), "_id").offset(max(options.offset, 0)).drop("_id")
        return self._of_format(found, options.format)

    @staticmethod
    def _of_format(rows: DataFrame, format: str | None) -> DataFrame:
        return rows if format is None else rows.where(upper_ascii(F.coalesce("format", F.lit(""))) == format.upper())

    def by_id(self, source_id: str) -> DataFrame:
        """The item with an id, or no row."""
        if self.source.by_id is not None:
            found = self.source.by_id(self.kind, source_id)
        else:
            own = F.exists("external_ids", lambda x: (x["source"] == self.source.name) & (x["source_id"] == source_id))
            found = self.source.need("items")(self.kind).where(own).limit(1)
        return self._of_format(found.where(F.col("media_kind") == self.kind), self.format)

    def trending(self) -> DataFrame:
        return self.source.need("trending")(self.kind)

    def recommendations(self, source_id: str) -> DataFrame:
        return self.source.need("recommendations")(self.kind, source_id)

    def related(self, source_id: str) -> DataFrame:
        return self.source.need("related")(self.kind, source_id)

    def episodes(self, source_id: str) -> DataFrame:
        return self.source.need("episodes")(self.kind, source_id)


@dataclass(frozen=True)
class Remote:
    """Several sources; those that fail are left out unless all do."""

    sources: dict[str, RemoteSource] = field(default_factory=dict)

    def with_source(self, source: RemoteSource) -> Remote:
        """Adds or replaces a source."""
        return Remote(self.sources | {source.name: source})

    def collection(self, source: str, kind: str, format: str | None = None) -> RemoteCollection:
        return RemoteCollection(self.sources[source], kind, format)

    def anime(self, source: str) -> RemoteCollection:
        return self.collection(source, "anime")

    def manga(self, source: str) -> RemoteCollection:
        return self.collection(source, "manga")

    def movie(self, source: str) -> RemoteCollection:
        return self.collection(source, "anime", "MOVIE")

    def show(self, source: str) -> RemoteCollection:
        return self.collection(source, "show")

    def tv_movie(self, source: str) -> RemoteCollection:
        return self.collection(source, "movie")

    def search(self, kind: str, query: str, options: SearchOptions = SearchOptions()) -> tuple[DataFrame, dict[str, Exception]]:
        """Hits of all sources one after another, and the errors of those that failed."""
        return union_of({n: (lambda n=n: self.collection(n, kind).search(query, options)) for n in self.sources})

    def episodes(self, kind: str, candidates: list[tuple[str, str]]) -> tuple[DataFrame, dict[str, Exception]]:
        """Episodes from each candidate's source (source, id), and errors by ``source:id``."""
        return union_of({f"{s}:{i}": (lambda s=s, i=i: self.collection(s, kind).episodes(i)) for s, i in candidates})

    def merged_episodes(self, kind: str, candidates: list[tuple[str, str]]) -> DataFrame:
        """Episodes of all candidates by effective number; rows of later candidates count as later."""
        frames = {f"{s}:{i}": (lambda s=s, i=i, k=k: self.collection(s, kind).episodes(i).withColumn("seq", F.lit(k).cast("long"))) for k, (s, i) in enumerate(candidates)}
        rows, _ = union_of(frames)
        return episodes.merge_effective(rows).orderBy("number")


_FETCHED = "media_id long, source string, source_id string, pos long, raw_json string, error string"


def fetch_each(targets: DataFrame, fetch: FetchItem, interval: float = 0.0, retries: int = 3, tasks: int | None = None, start: float | None = None) -> DataFrame:
    """``media_id, source, source_id, pos, raw_json, error`` for targets ``media_id, source, source_id``.

    Each target is fetched in an executor; a failure is a row with its error, so that others go on. A source that wants an
    interval between calls is asked by ``tasks`` tasks that keep it together (see `marquetry.sources.pacing`); one that asks to wait is asked again.
    """
    lanes = tasks or targets.sparkSession.sparkContext.defaultParallelism
    pace = Lanes(time.time() if start is None else start, interval, lanes)
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Pace] = {}
        for b in batches:
            for media, source, source_id, lane in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own.setdefault(lane, Pace(pace, lane)).wait()
                try:
                    rows = [(media, source, source_id, i, x, None) for i, x in enumerate(retried(lambda i=source_id: fetch(i), retries))]
                except Exception as e:  # noqa: BLE001  whatever goes wrong with one item
                    rows = [(media, source, source_id, 0, None, str(e))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in _FETCHED.split(", ")])

    lane = F.pmod(F.xxhash64("media_id", "source", "source_id"), F.lit(lanes)).cast("int").alias("lane") if "lane" not in targets.columns else F.col("lane")
    targets = targets.select("media_id", "source", "source_id", lane)
    targets = targets.repartitionById(lanes, F.col("lane")) if interval else targets
    return targets.mapInArrow(run, _FETCHED)


def fetch_in_rounds(targets: DataFrame, fetch: FetchItem, interval: float, folder: str, tasks: int | None = None, each: int = 200, retries: int = 3) -> DataFrame:
    """`fetch_each` in rounds of ``each`` targets a task, written to ``folder`` round by round.

    What a round has fetched survives whatever comes later: a lost task repeats its part of one round, and a call that finds rounds of the
    same targets in the folder goes on behind them.
    """
    spark = targets.sparkSession
    lanes = tasks or spark.sparkContext.defaultParallelism
    order = Window.partitionBy("lane").orderBy("source", "source_id", "media_id")
    numbered = targets.select("media_id", "source", "source_id").distinct()
    numbered = numbered.withColumn("lane", F.pmod(F.xxhash64("media_id", "source", "source_id"), F.lit(lanes)).cast("int"))
    numbered = cut(numbered.withColumn("round", F.floor((F.row_number().over(order) - 1) / each).cast("int")))
    last = numbered.agg(F.max("round")).first()[0]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for i in range(-1 if last is None else last + 1):
        if not store.exists(path(f"{folder}/round={i}/_SUCCESS")):
            fetch_each(numbered.where(F.col("round") == i), fetch, interval, retries, lanes).write.mode("overwrite").parquet(f"{folder}/round={i}")
    drop_cuts(numbered)
    if last is None:
        return spark.createDataFrame([], _FETCHED)
    return spark.read.schema(f"{_FETCHED}, round int").parquet(folder).drop("round")
