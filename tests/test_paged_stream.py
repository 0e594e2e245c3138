"""The page stream, pushed filters, and pacing over several tasks."""

from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from marquetry.api import Catalog
from marquetry.sources import items, payloads
from marquetry.sources.clients import Response
from marquetry.sources.pacing import Lanes, Pace
from marquetry.sources.remote import fetch_each, fetch_in_rounds
from marquetry.streaming.sync import Sync, SyncRequest

PAGES = 11


def show(i):
    return json.dumps({"id": i, "name": f"Show {i}", "type": str(os.getpid()), "externals": {}})


def fetch(number, size):
    """Pages 0 to 10 of three shows, the last of two."""
    return [show(3 * number + i) for i in range(2 if number == PAGES - 1 else 3)] if number < PAGES else [], number < PAGES - 1


GROWN = "/tmp/marquetry-test-grown"


def growing(number, size):
    """As `fetch`, with one page more once a file is there."""
    last = PAGES - 1 + os.path.exists(GROWN)
    return [show(3 * number + i) for i in range(3)] if number <= last else [], number < last


REQUEST = SyncRequest("tvmaze", "show")


@pytest.fixture()
def sync(spark, tmp_path):
    return Sync(Catalog(spark, str(tmp_path / "catalog")), lambda s: None)


def ids(catalog):
    return sorted(int(r["source_id"]) for r in catalog.table("media_external_id").where("source = 'tvmaze'").select("source_id").collect())


def test_pages_are_read_in_tasks(sync, tmp_path):
    out = sync.stream_source("tests.test_paged_stream:fetch", payloads.shows, REQUEST, str(tmp_path / "runs"), ahead=4, tasks=3, interval=0)
    assert (out.fetched_pages, out.upserted, out.last_page) == (PAGES, 32, PAGES - 1)
    assert ids(sync.catalog) == list(range(32)) and sync.state("tvmaze", "show")["page"] == PAGES - 1
    assert str(os.getpid()) not in {r["format"] for r in sync.catalog.media().select("format").distinct().collect()}  # the driver asked for none
    again = sync.stream_source("tests.test_paged_stream:fetch", payloads.shows, REQUEST, str(tmp_path / "runs"), ahead=4, interval=0)
    assert (again.fetched_pages, again.last_page) == (1, PAGES - 1)  # the last page, for what has been added


def test_a_killed_run_goes_on(sync, tmp_path, monkeypatch):
    """Killed before a batch is in the catalog, and after that but before the stream knows."""
    ingest, calls = sync.catalog.ingest, []

    def dies(before):
        def run(rows, batch, also):
            calls.append(batch)
            if len(calls) == 2:
                if not before:
                    ingest(rows, batch, also)
                raise OSError("killed")
            return ingest(rows, batch, also)

        return run

    for before in (True, False):
        own = Sync(Catalog(sync.catalog.spark, str(tmp_path / f"catalog-{before}")), lambda s: None)
        ingest = own.catalog.ingest
        calls.clear()
        monkeypatch.setattr(own.catalog, "ingest", dies(before))
        run = lambda own=own, before=before: own.stream_source("tests.test_paged_stream:fetch", payloads.shows, REQUEST, str(tmp_path / f"runs-{before}"), ahead=4, interval=0)
        with pytest.raises(Exception, match="killed"):
            run()
        assert "killed" in own.state("tvmaze", "show")["last_error"] or own.state("tvmaze", "show")["last_error"]
        run()
        assert ids(own.catalog) == list(range(32)) and own.catalog.media().count() == 32
        assert len(calls) == (4 if before else 3)  # a batch that is in the catalog isn't taken again
        assert own.state("tvmaze", "show")["last_error"] is None


def test_pages_that_grow(sync, tmp_path):
    if os.path.exists(GROWN):
        os.remove(GROWN)
    run = lambda: sync.stream_source("tests.test_paged_stream:growing", payloads.shows, REQUEST, str(tmp_path / "runs"), ahead=5, interval=0)
    run()
    open(GROWN, "w").close()
    try:
        out = run()
    finally:
        os.remove(GROWN)
    assert (out.fetched_pages, out.last_page) == (2, PAGES) and ids(sync.catalog) == list(range(36))


def test_limits_of_a_run(sync, tmp_path):
    out = sync.stream_source("tests.test_paged_stream:fetch", payloads.shows, SyncRequest("tvmaze", "show", max_pages=3, start_page=2), str(tmp_path / "runs"), ahead=2, interval=0)
    assert (out.fetched_pages, out.last_page) == (3, 4) and ids(sync.catalog) == list(range(6, 15))


# Pushed filters


def transport(request):
    """Shows named by what they were asked with."""
    path = request.url.split("tvmaze.com", 1)[1]
    if path == "/search/shows":
        return Response(200, json.dumps([{"show": {"id": 70 + i, "name": f"{path} {dict(request.params)['q']} {i}"}} for i in range(3)]))
    if path == "/shows":
        page = int(dict(request.params)["page"])
        return Response(200, json.dumps([{"id": 10 * page + i, "name": f"page {page}"} for i in range(2)])) if page < 2 else Response(404, "")
    return Response(404, "") if path.endswith("/9") else Response(200, json.dumps({"id": int(path.rsplit("/", 1)[1]), "name": path}))


@pytest.fixture(scope="module")
def table(spark):
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    items.register(spark)
    yield lambda: spark.read.format("marquetry_items").options(source="tvmaze", transport="tests.test_paged_stream:transport").load()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_an_id_is_a_lookup(table):
    found = table().where("kind = 'show' AND source_id = '5'")
    assert [(r["source_id"], r["title"]) for r in found.collect()] == [("5", "/shows/5")]
    assert "Filter" in found._jdf.queryExecution().executedPlan().toString()  # Spark checks again
    assert sorted(r["title"] for r in table().where(F.col("source_id").isin("5", "6", "9")).collect()) == ["/shows/5", "/shows/6"]
    assert table().where("kind = 'anime' AND source_id = '5'").count() == 0


def test_a_title_is_a_search(table):
    found = table().where(F.col("title").contains("dragon"))
    assert [r["title"] for r in found.collect()] == [f"/search/shows dragon {i}" for i in range(3)]
    assert found.where(F.col("title").endswith("1")).count() == 1


def test_no_filter_reads_all_pages(table, monkeypatch):
    assert sorted(r["source_id"] for r in table().collect()) == ["0", "1", "10", "11"]


# Pacing


def test_lanes_never_share_a_slot():
    lanes = Lanes(100.0, 0.5, 3)
    slots = sorted(lanes.slot(lane, after) for lane in range(3) for after in (99, 100.2, 101.6, 103.1))
    assert all(abs((s - 100) / 0.5 % 1) < 1e-9 for s in slots)
    for lane in range(3):
        now, used = [100.0], []
        pace = Pace(lanes, lane, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
        for _ in range(4):
            pace.wait()
            used.append(now[0])
        assert {round((u - 100) / 0.5) % 3 for u in used} == {lane} and len(set(used)) == 4


STAMPS = "/tmp/marquetry-test-stamps"


def stamped(source_id):
    with open(STAMPS, "a") as f:
        f.write(f"{time.time()}\n")
    if source_id == "13":
        raise OSError("down")
    return [source_id]


def test_tasks_keep_the_interval_together(spark):
    """Four tasks: as many calls as the interval allows, and never two within it."""
    open(STAMPS, "w").close()
    targets = spark.createDataFrame([(i, "jikan", str(i)) for i in range(48)], "media_id long, source string, source_id string")
    out = fetch_each(targets, stamped, interval=0.1, tasks=4).collect()
    assert sorted(r["source_id"] for r in out) == sorted(map(str, range(48))) and [r["error"] for r in out if r["source_id"] == "13"] == ["down"]
    stamps = sorted(float(x) for x in open(STAMPS))
    gaps = [b - a for a, b in zip(stamps, stamps[1:])]
    assert min(gaps) > 0.05  # a call may be late by what a task takes, not early
    lanes = len({round((s - stamps[0]) / 0.1) % 4 for s in stamps})
    assert lanes == 4 and stamps[-1] - stamps[0] < 48 * 0.1 * 2


def test_rounds_survive(spark, tmp_path):
    """What has been fetched isn't asked for again."""
    targets = spark.createDataFrame([(i, "jikan", str(i)) for i in range(20)], "media_id long, source string, source_id string")
    open(STAMPS, "w").close()
    folder = str(tmp_path / "rounds")
    out = fetch_in_rounds(targets, stamped, 0.0, folder, tasks=2, each=4)
    assert out.count() == 20 and len(open(STAMPS).readlines()) == 20
    rounds = sorted(f for f in os.listdir(folder) if f.startswith("round"))
    assert len(rounds) >= 3
    for f in os.listdir(f"{folder}/{rounds[-1]}"):
        os.remove(f"{folder}/{rounds[-1]}/{f}")
    again = fetch_in_rounds(targets.repartition(3), stamped, 0.0, folder, tasks=2, each=4)
    assert sorted(r["source_id"] for r in again.collect()) == sorted(map(str, range(20)))
    assert 20 < len(open(STAMPS).readlines()) <= 28
    assert fetch_in_rounds(targets.limit(0), stamped, 0.0, str(tmp_path / "none")).count() == 0
