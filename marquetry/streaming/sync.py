"""Sync: paged ingestion that can be resumed, page by page or as a stream.

Pages are gathered to batches of BATCH items, and a batch becomes visible with the number of its last page as the cursor. A run
starts at the page that is asked for, else at the cursor, else at the source's first page; so the last page is
read twice, which a keyed merge forgives.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.api import Catalog
from marquetry.schemas import SYNC_MODES, SYNC_STATE
from marquetry.sources.clients import PROJECTIONS, Source
from marquetry.sources.paged import AHEAD, LIMITS, page_size, retried
from marquetry.sources.paged import register as register_pages
from marquetry.sources.remote import FetchItem, fetch_in_rounds
from marquetry.store import cut, cuts, scratch_path

#: Items that are merged at once: a merge reads what the catalog has of them, so it isn't done for every page.
BATCH = 2000
# What a sync of all sources asks for, in an order that decides ties.
DEFAULT_ORDER = (
    ("anilist", "anime"), ("jikan", "anime"), ("kitsu", "anime"), ("anilist", "manga"), ("jikan", "manga"), ("kitsu", "manga"),
    ("tvmaze", "show"), ("imdb", "show"), ("imdb", "movie"),
)

Project = Callable[[DataFrame], DataFrame]
FetchPage = Callable[[int, int], tuple[list[str], bool]]


class SourceMismatch(ValueError):
    """A request names another source than the one it is given to."""


@dataclass(frozen=True)
class SyncRequest:
    source: str
    media_kind: str | None = None
    mode: str = "full"
    page_size: int = 50
    max_pages: int | None = None
    start_page: int | None = None

    @property
    def scope(self) -> str:
        return self.media_kind or "all"


@dataclass(frozen=True)
class SyncOutcome:
    source: str
    media_kind: str | None
    fetched_pages: int
    upserted: int
    last_page: int | None


@dataclass(frozen=True)
class SyncReport:
    outcomes: list[SyncOutcome] = field(default_factory=list)

    @property
    def upserted(self) -> int:
        return sum(o.upserted for o in self.outcomes)


class Sync:
    """``project`` makes canonical records of rows with ``seq`` and ``raw_json``, and keeps ``seq``."""

    def __init__(self, catalog: Catalog, sleep: Callable[[float], None] = time.sleep, paced: bool = True) -> None:
        """``sleep`` waits between pages; executors keep to the sources' intervals if ``paced``."""
        self.catalog, self.sleep, self.paced = catalog, sleep, paced

    def state(self, source: str, scope: str) -> dict | None:
        row = self.catalog.table("sync_state").where((F.col("source") == source) & (F.col("scope") == scope)).first()
        return row.asDict() if row else None

    def state_row(self, request: SyncRequest, page: int | None, error: str | None = None) -> DataFrame:
        """An error, or an empty first page, keeps the cursor that was there."""
        if request.mode not in SYNC_MODES:
            raise ValueError(f"unknown sync mode: {request.mode}")
        old = self.state(request.source, request.scope) or {}
        page = old.get("page") if page is None else page
        done = old.get("last_success_at") if error else str(int(time.time()))
        return self.catalog.spark.createDataFrame([(request.source, request.scope, page, done, error, page, request.mode)], SYNC_STATE)

    def save(self, request: SyncRequest, page: int | None, error: str | None = None) -> None:
        self.catalog.store.merge({"sync_state": self.state_row(request, page, error)})

    def next_seq(self) -> int:
        """The first arrival number that no batch has used: the pointer names it after the last colon."""
        last = (self.catalog.store.pointer().get("batch") or "").rpartition(":")[2]
        if last.isdigit():
            return int(last)
        return (self.catalog.media().agg(F.max("media_id")).first()[0] or -1) + 1

    def run(self, source: str, fetch: FetchPage, project: Project, request: SyncRequest) -> SyncOutcome:
        if source != request.source:
            raise SourceMismatch(f"the request is for {request.source}, the source is {source}")
        limits, size = LIMITS[source], page_size(request.page_size, source)
        old = self.state(source, request.scope) or {}
        page = next(p for p in (request.start_page, old.get("page"), limits.first_page) if p is not None)
        pages = upserted = 0
        last: int | None = None
        waiting: list[str] = []

        def store() -> int:
            """What waits becomes one batch, with the cursor."""
            done = self.ingest(waiting, project, {"sync_state": self.state_row(request, last)}) if waiting else 0
            waiting.clear()
            return done

        try:
            while (request.max_pages is None or pages < request.max_pages) and (limits.last_page is None or page <= limits.last_page):
                try:
                    items, more = retried(lambda: fetch(page, size), sleep=self.sleep)
                except Exception:
                    upserted += store()  # the pages before stay
                    raise
                if not items:
                    break
                waiting += items
                pages, last = pages + 1, page
                if len(waiting) >= BATCH:
                    upserted += store()
                if not more:
                    break
                page += 1
                self.sleep(limits.interval)
            upserted += store()
            if not pages:
                self.save(request, None)
        except Exception as e:
            self.save(request, None, str(e))
            raise
        return SyncOutcome(source, request.media_kind, pages, upserted, last)

    def ingest(self, items: list[str], project: Project, also: dict[str, DataFrame] | None = None) -> int:
        base = self.next_seq()
        rows = self.catalog.spark.createDataFrame([(base + i, x) for i, x in enumerate(items)], "seq long, raw_json string")
        done = self.catalog.ingest(project(rows), f"seq:{base + len(items)}", also)
        return done.inserted + done.updated

    def sync_source(self, source: Source, kind: str, **request: object) -> SyncOutcome:
        """A source's pages of one kind."""
        return self.run(source.name, source.pages(kind), lambda rows: PROJECTIONS[source.name](rows, kind), SyncRequest(source.name, kind, **request))

    def sync_dump(self, kind: str, rows: DataFrame, source: str = "imdb") -> SyncOutcome:
        """Canonical rows of a whole dump, in one batch."""
        request, base = SyncRequest(source, kind), self.next_seq()
        rows = cut(rows.where(F.col("media_kind") == kind).withColumn("seq", F.monotonically_increasing_id() + base))
        upto = (rows.agg(F.max("seq")).first()[0] or base - 1) + 1
        done = self.catalog.ingest(rows, f"seq:{upto}", {"sync_state": self.state_row(request, 1)})
        return SyncOutcome(source, kind, 1, done.inserted + done.updated, 1)

    def sync_default_sources(self, sources: dict[str, Source], dump: DataFrame | None = None, **request: object) -> SyncReport:
        """All sources that are given, and a dump's rows, in the fixed order."""
        out = []
        for name, kind in DEFAULT_ORDER:
            if name in sources:
                out.append(self.sync_source(sources[name], kind, **request))
            elif name == "imdb" and dump is not None:
                out.append(self.sync_dump(kind, dump))
        return SyncReport(out)

    def run_all(self, jobs: Iterable[tuple[str, FetchPage, Project, SyncRequest]]) -> SyncReport:
        """Sources in the given order, which decides ties."""
        return SyncReport([self.run(*j) for j in jobs])

    def enrich_episodes(self, fetch: dict[str, FetchItem], project: dict[str, Project]) -> DataFrame:
        """Fetches episodes of the whole catalog from the sources given, and gives back the targets that failed.

        Targets are the catalog's candidates; they are fetched in the executors and merged in one batch.
        """
        failed, rows = [], []
        targets = self.catalog.episode_candidates()
        for i, source in enumerate(fetch):
            folder = scratch_path(self.catalog.spark, f"episodes-{source}")
            got = fetch_in_rounds(targets.where(F.col("source") == source), fetch[source], LIMITS[source].interval if self.paced else 0.0, folder)
            failed.append(got.where("error IS NOT NULL").select("media_id", "source", "source_id", "error"))
            # Sources come in order; within an item its own order decides.
            numbered = got.where("raw_json IS NOT NULL").withColumn("seq", F.lit(i << 48).cast("long") + F.col("pos"))
            for_media = numbered.select(F.struct("media_id", "seq").alias("seq"), "raw_json")
            rows.append(project[source](for_media).withColumn("media_id", F.col("seq.media_id")).withColumn("seq", F.col("seq.seq")))
        if rows:
            self.catalog.ingest_episodes(reduce(DataFrame.unionByName, rows))
        return reduce(DataFrame.unionByName, failed) if failed else targets.select("media_id", "source", "source_id", F.lit("").alias("error")).limit(0)

    def stream(self, pages: DataFrame, project: Project, checkpoint: str, request: SyncRequest | None = None, seen: dict | None = None):
        """Ingests a stream of pages (``source, page, pos, raw_json``) up to what is there now, a batch at a time.

        A batch becomes visible with the cursor of ``request`` in one commit, whose name tells a batch that is run again, so that it is left
        out. ``seen`` gets what there was: pages, the last of them, upserted records, and whether the source has ended.
        """
        seen = {} if seen is None else seen

        def upsert(batch: DataFrame, number: int) -> None:
            with cuts():
                batch = cut(batch)
                item = F.col("pos") >= 0
                of = lambda f, c: f(F.when(item, F.col(c)))
                pages_of = [of(F.min, "page").alias("first"), of(F.max, "page").alias("last"), of(F.countDistinct, "page").alias("pages")]
                own = batch.agg(*pages_of, of(F.max, "pos").alias("pos"), F.coalesce(F.bool_or(~item), F.lit(False)).alias("ended")).first()
                seen["ended"] = seen.get("ended", False) or own["ended"]
                named, done = self.catalog.store.pointer().get("batch") or "", f"stream-{checkpoint}-"
                if own["first"] is None or named.startswith(done) and int(named.removeprefix(done).partition(":")[0]) >= number:
                    return
                base, size = self.next_seq(), own["pos"] + 1  # places on pages that are less full stay free
                seq = (F.lit(base) + (F.col("page") - own["first"]) * size + F.col("pos")).cast("long").alias("seq")
                also = {"sync_state": self.state_row(request, own["last"])} if request else {}
                upto = base + (own["last"] - own["first"] + 1) * size
                out = self.catalog.ingest(project(batch.where(item).select(seq, "raw_json")), f"{done}{number}:{upto}", also)
                seen.update({"pages": seen.get("pages", 0) + own["pages"], "last": own["last"], "upserted": seen.get("upserted", 0) + out.inserted + out.updated})

        return pages.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def stream_source(self, fetch: str, project: Project, request: SyncRequest, folder: str, ahead: int = AHEAD, tasks: int = 4, interval: float | None = None) -> SyncOutcome:
        """A sync whose pages are read in tasks, ``ahead`` of them a batch; ``fetch`` is ``module:function``. The driver holds no item.

        A run has a checkpoint of its own in ``folder``. One that was killed goes on where it was, without a page lost or read into the catalog
        twice; when the source has ended, the next run starts at the cursor, so the last page is read again for what has been added to it.
        """
        limits = LIMITS[request.source]
        store, path = self.catalog.store._fs, self.catalog.store._path
        files = {s.getPath().getName() for s in store.listStatus(path(folder))} if store.exists(path(folder)) else set()
        numbers = sorted(int(f[4:]) for f in files if f.startswith("run-"))
        run = numbers[-1] if numbers and f"done-{numbers[-1]}" not in files else (numbers[-1] + 1 if numbers else 0)
        own = f"{folder}/run-{run}"
        marks = sorted(tuple(map(int, s.getPath().getName().split("-")[1:])) for s in store.listStatus(path(own)) if s.getPath().getName().startswith("pages-")) if store.exists(path(own)) else []
        if marks:
            first, end = marks[-1]
        else:
            old = self.state(request.source, request.scope) or {}
            first = end = next(p for p in (request.start_page, old.get("page"), limits.first_page) if p is not None)
        ends = [1 << 31 if request.max_pages is None else first + request.max_pages, 1 << 31 if limits.last_page is None else limits.last_page + 1]
        upto = min(ends)
        seen: dict = {}
        again = bool(marks)  # what was planned last may not be done
        register_pages(self.catalog.spark)
        try:
            while (again or end < upto) and not seen.get("ended"):
                end = end if again else min(end + ahead, upto)
                again = False
                store.mkdirs(path(f"{own}/pages-{first}-{end}"))
                options = {"fetch": fetch, "source": request.source, "page_size": request.page_size, "start_page": first, "end_page": end, "tasks": tasks}
                options |= {} if interval is None else {"interval": interval}
                pages = self.catalog.spark.readStream.format("marquetry_pages").options(**options).load()
                self.stream(pages, project, f"{own}/checkpoint", request, seen).awaitTermination()
            if "last" not in seen:
                self.save(request, None)
        except Exception as e:
            self.save(request, None, str(e).split("\n")[0])
            raise
        store.mkdirs(path(f"{folder}/done-{run}"))
        return SyncOutcome(request.source, request.media_kind, seen.get("pages", 0), seen.get("upserted", 0), seen.get("last"))


def sync_database(spark: SparkSession, path: str, sources: dict[str, Source], dump: DataFrame | None = None, **request: object) -> SyncReport:
    """Opens or makes the catalog at ``path`` and syncs all sources into it."""
    return Sync(Catalog(spark, path)).sync_default_sources(sources, dump, **request)


def generate_database(spark: SparkSession, path: str, sources: dict[str, Source], dump: DataFrame | None = None, **request: object) -> tuple[Catalog, SyncReport]:
    """As `sync_database`; gives the catalog too."""
    catalog = Catalog(spark, path)
    return catalog, Sync(catalog).sync_default_sources(sources, dump, **request)
