from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from marquetry.api import Catalog
from marquetry.operators.search import SearchOptions
from marquetry.schemas import TABLES
from marquetry.sources import paged, payloads
from marquetry.store import DELTAS, Store
from marquetry.streaming.sync import SourceMismatch, Sync, SyncRequest

SHOWS = [{"id": i, "url": f"u{i}", "name": f"Show {i}", "externals": {"imdb": f"tt{i}"}, "rating": {"average": 5.0 + i / 10}, "genres": ["Drama"]} for i in range(5)]


def fetch(number: int, size: int):
    """Two shows a page, pages from 0."""
    items = [json.dumps(s) for s in SHOWS[number * 2 : number * 2 + 2]]
    return items, number < 2


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "catalog"))


def records(spark, base, *items):
    return payloads.shows(spark.createDataFrame([(base + i, json.dumps(x)) for i, x in enumerate(items)], "seq long, raw_json string"))


def test_ingest_merges_by_shared_ids(spark, catalog):
    first = catalog.ingest(records(spark, 0, SHOWS[1], SHOWS[2]))
    assert (first.inserted, first.updated) == (2, 0)
    again = catalog.ingest(records(spark, 10, SHOWS[1] | {"name": "Show one, much longer", "genres": ["Crime", "drama"], "rating": {"average": 9.9}}))
    assert (again.inserted, again.updated) == (0, 1)
    one = catalog.by_external_id("imdb", "tt1").first()
    assert (one["title_display"], one["genres"], one["provider_rating"], one["media_id"]) == ("Show one, much longer", ["Drama", "Crime"], 0.99, 0)
    assert catalog.media().count() == 2
    assert {r["field_name"] for r in catalog.children(0)["provenance"].collect()} == {"title_display", "nsfw"}
    assert [r["media_id"] for r in catalog.show.search("longer", SearchOptions()).collect()] == [0]
    assert catalog.movie.search("longer").count() == 0


def test_rejects(spark, catalog):
    catalog.ingest(records(spark, 0, SHOWS[1], SHOWS[2]))
    bridging = SHOWS[1] | {"externals": {"imdb": "tt2"}}
    none = records(spark, 5, SHOWS[3]).withColumn("external_ids", F.slice("external_ids", 1, 0))
    got = catalog.ingest(records(spark, 4, bridging).unionByName(none))
    assert {(r["seq"], r["reason"]) for r in got.rejected.collect()} == {(4, "conflict"), (5, "no external id")}
    assert catalog.media().count() == 2


def test_an_id_of_two_kinds(spark, catalog):
    rows = records(spark, 0, SHOWS[1]).unionByName(records(spark, 1, SHOWS[1]).withColumn("media_kind", F.lit("movie")))
    catalog.ingest(rows)
    assert catalog.media().count() == 2
    assert catalog.by_external_id("imdb", "tt1", "movie").first()["media_id"] == 1
    with pytest.raises(Exception, match="several media"):
        catalog.by_external_id("imdb", "tt1").collect()
    assert catalog.resolve("imdb", "tt1").first()["media_kind"] == "show"


def test_episodes_and_documents(spark, catalog, tmp_path):
    catalog.ingest(records(spark, 0, SHOWS[1], SHOWS[2]))
    rows = spark.createDataFrame([(json.dumps({"id": i, "name": f"E{i}", "season": 1, "number": 3 - i}), i) for i in range(2)], "raw_json string, seq long")
    eps = payloads.show_episodes(rows).withColumn("media_id", F.lit(0).cast("long"))
    catalog.ingest_episodes(eps)
    catalog.ingest_episodes(eps.withColumn("title_display", F.concat("title_display", F.lit("!"))).withColumn("seq", F.col("seq") + 10))
    assert [(r["episode_number"], r["title_display"]) for r in catalog.episodes_for(0).collect()] == [(2, "E1!"), (3, "E0!")]
    assert catalog.source_episodes_for(0).count() == 2
    assert catalog.episode_by_season(0, 1, 3).count() == 1 and catalog.episode_by_absolute(0, 99).count() == 0
    docs = {r["media_id"]: len(r["episode_list"]) for r in catalog.documents().collect()}
    assert docs == {0: 2, 1: 0}
    assert len(catalog.document_by_external_id("imdb", "tt1").first()["episode_list"]) == 2
    catalog.export(str(tmp_path / "export"))
    assert {len(r["episode_list"]) for r in spark.read.json(str(tmp_path / "export")).collect()} == {0, 2}
    assert catalog.sql("SELECT count(*) AS n FROM episode").first()["n"] == 2
    assert {(r["source"], r["source_id"]) for r in catalog.episode_candidates(0).collect()} == {("tvmaze", "1")}


def test_sync_pages_resumes_and_repeats(catalog):
    waits = []
    sync = Sync(catalog, waits.append)
    request = SyncRequest("tvmaze", "show", max_pages=2)
    out = sync.run("tvmaze", fetch, payloads.shows, request)
    assert (out.fetched_pages, out.upserted, out.last_page) == (2, 4, 1)
    assert sync.state("tvmaze", "show")["page"] == 1 and waits == [0.5, 0.5]
    rest = sync.run("tvmaze", fetch, payloads.shows, SyncRequest("tvmaze", "show"))
    assert (rest.fetched_pages, rest.last_page) == (2, 2)  # the last page again, then the next
    assert catalog.media().count() == 5
    with pytest.raises(SourceMismatch):
        sync.run("imdb", fetch, payloads.shows, request)


def test_sync_keeps_errors(catalog):
    sync = Sync(catalog, lambda s: None)

    def broken(number, size):
        if number:
            raise OSError("down")
        return fetch(number, size)

    with pytest.raises(OSError):
        sync.run("tvmaze", broken, payloads.shows, SyncRequest("tvmaze"))
    state = sync.state("tvmaze", "all")
    assert (state["page"], state["last_error"]) == (0, "down")


def test_stream(spark, catalog, tmp_path):
    paged.register(spark)
    pages = spark.readStream.format("marquetry_pages").option("fetch", "tests.test_catalog:fetch").option("source", "tvmaze").option("interval", 0).load()
    sync = Sync(catalog)
    for _ in range(4):  # a simple reader has a page a run
        sync.stream(pages, payloads.shows, str(tmp_path / "checkpoint")).awaitTermination()
    assert catalog.media().count() == 5


def test_old_versions_can_go(spark, catalog):
    catalog.ingest(records(spark, 0, SHOWS[1]))
    catalog.ingest(records(spark, 1, SHOWS[2]))
    assert len(catalog.store.pointer()["tables"]["media"]["deltas"]) == 2
    assert catalog.store.vacuum() == 0
    catalog.store.compact("media")
    assert catalog.store.pointer()["tables"]["media"]["deltas"] == []
    assert catalog.store.vacuum() == 2
    assert catalog.media().count() == 2


def test_the_last_delta_of_an_owner_counts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    row = lambda i, page: spark.createDataFrame([(f"s{i}", "all", page, None, None, page, "full")], TABLES["sync_state"])
    store.write({"sync_state": row(0, 1).unionByName(row(1, 1))})
    for n in range(2, 5):
        store.merge({"sync_state": row(n % 2, n)})
    assert {(r["source"], r["page"]) for r in store.read("sync_state").collect()} == {("s0", 4), ("s1", 3)}
    for n in range(5, 20):
        store.merge({"sync_state": row(2, n)})
    assert len(store.pointer()["tables"]["sync_state"]["deltas"]) < DELTAS
    assert {(r["source"], r["page"]) for r in store.read("sync_state").collect()} == {("s0", 4), ("s1", 3), ("s2", 19)}


def test_search_uses_the_stored_index(spark, catalog):
    """Postings follow each merge, and give the ranks that the texts themselves give."""
    from marquetry.operators import search as text

    catalog.ingest(records(spark, 0, *SHOWS))
    catalog.ingest(records(spark, 10, SHOWS[1] | {"name": "Another and much longer name", "summary": "of a show"}))
    names = catalog.table("media_alias").groupBy("media_id").agg(F.collect_list("alias").alias("aliases"))
    rows = catalog.media().join(names, "media_id", "left")
    for query in ("show", "sho", "another", "name lon", "3", "nothing"):
        want = [(r["media_id"], pytest.approx(r["score"])) for r in text.search(rows, query).collect()]
        assert [(r["media_id"], r["score"]) for r in catalog.search(query).collect()] == want
    assert [r["media_id"] for r in catalog.search("show", SearchOptions(limit=2, offset=1)).collect()] == [r["media_id"] for r in text.search(rows, "show").collect()][1:3]
    catalog.store.write({"search_posting": catalog.table("search_posting").limit(0)})
    assert catalog.search("show").count() == 0
    catalog.reindex()
    assert catalog.search("show").count() == 5


def test_writers_take_turns(spark, catalog):
    """A batch that was worked out on older tables is refused, and one that finds every number taken waits, then fails."""
    from marquetry.store import Busy, Changed

    generation = catalog.store.generation()
    catalog.ingest(records(spark, 0, SHOWS[1]))
    assert catalog.store.generation() > generation
    with pytest.raises(Changed):
        catalog.store.merge({"search_row": catalog.table("search_row")}, expected=generation)
    other = Store(spark, catalog.store.path, busy=0.2)
    other._publish = lambda entry: False  # others take every number
    with pytest.raises(Busy):
        other.merge({"search_row": catalog.table("search_row")})
    del other._publish
    other.merge({"search_row": catalog.table("search_row")})
    assert catalog.media().count() == 1
