from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from marquetry.api import Catalog
from marquetry.migrations import import_tables, migrate
from marquetry.operators.search import SearchOptions
from marquetry.schemas import TABLES
from marquetry.sources import payloads
from marquetry.sources.registry import AllFailed
from marquetry.sources.remote import NotSupported, Remote, RemoteSource, fetch_each
from marquetry.store import Store
from marquetry.streaming.sync import Sync

from .test_catalog import SHOWS, records


def rows(spark, *items):
    return spark.createDataFrame([(json.dumps(x),) for x in items], "raw_json string")


@pytest.fixture(scope="module")
def remote(spark):
    def show_episodes(kind, source_id):
        if source_id == "bad":
            raise OSError("down")
        return payloads.show_episodes(rows(spark, {"id": 1, "name": "J", "season": 1, "number": 1, "airdate": "2024-01-02"}))

    def list_episodes(kind, source_id):
        return payloads.api_episodes(rows(spark, {"id": "5", "attributes": {"titles": {"en": "K"}, "number": 1, "synopsis": "K", "runtime": 24}}), kind)

    shows = RemoteSource("tvmaze", items=lambda kind: payloads.shows(rows(spark, *SHOWS)), episodes=show_episodes)
    return Remote().with_source(shows).with_source(RemoteSource("kitsu", episodes=list_episodes, search=lambda kind, q: payloads.shows(rows(spark, {"id": 77, "name": f"found {q}"}))))


def names(df):
    return sorted(r["title_display"] for r in df.collect())


def test_collection(remote):
    c = remote.show("tvmaze")
    assert names(c.search("SHOW", SearchOptions(limit=2, offset=1))) == ["Show 1", "Show 2"]
    assert c.search(" ").count() == 0
    assert names(c.by_id("3")) == ["Show 3"] and c.by_id("99").count() == 0
    with pytest.raises(NotSupported, match="tvmaze has no trending"):
        c.trending()


def test_search_over_all_sources(remote):
    found, errors = remote.search("show", "show 4")
    assert names(found) == ["Show 4", "found show 4"] and not errors


def test_episodes_from_candidates(remote):
    got = remote.merged_episodes("show", [("kitsu", "42"), ("tvmaze", "19"), ("tvmaze", "bad")]).collect()
    assert [(r["number"], r["source"], r["title_display"], r["synopsis"], r["runtime_minutes"]) for r in got] == [(1, "tvmaze", "J", "K", 24)]
    _, errors = remote.episodes("show", [("kitsu", "42"), ("tvmaze", "bad")])
    assert set(errors) == {"tvmaze:bad"}
    with pytest.raises(AllFailed):
        remote.episodes("show", [("tvmaze", "bad")])


def fetch_one(source_id: str) -> list[str]:
    if source_id == "2":
        raise OSError("no such show")
    return [json.dumps({"id": int(source_id) * 10 + i, "name": f"E{i}", "season": 1, "number": i}) for i in (1, 2)]


def test_fetch_each(spark):
    targets = spark.createDataFrame([(1, "tvmaze", "1"), (2, "tvmaze", "2")], "media_id long, source string, source_id string")
    got = fetch_each(targets, fetch_one).collect()
    assert [(r["media_id"], r["error"]) for r in got if r["error"]] == [(2, "no such show")]
    assert sum(r["raw_json"] is not None for r in got) == 2


def test_enrich_episodes(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    catalog.ingest(records(spark, 0, SHOWS[1], SHOWS[2]))
    failed = Sync(catalog, paced=False).enrich_episodes({"tvmaze": fetch_one}, {"tvmaze": payloads.show_episodes})
    assert [(r["source_id"], r["error"]) for r in failed.collect()] == [("2", "no such show")]
    assert [(r["episode_number"], r["title_display"]) for r in catalog.episodes_for(0).collect()] == [(1, "E1"), (2, "E2")]


def test_migration_from_the_first_version(spark, tmp_path):
    media = spark.createDataFrame([(1, "anime", "A"), (2, "manga", "B")], "media_id long, media_kind string, title_display string")
    ids = spark.createDataFrame([(1, "jikan", "5", None), (2, "jikan", "5", None), (1, "kitsu", "7", "u"), (9, "kitsu", "8", "u")], "media_id long, source string, source_id string, url string")
    payload = spark.createDataFrame([(1, "jikan", "5", "{}")], "media_id long, source string, source_id string, raw_json string")
    old = {"media": media, "media_external_id": ids, "source_record": payload, "media_alias": spark.createDataFrame([], TABLES["media_alias"])}
    new = migrate(old, 1)
    assert {n: df.columns for n, df in new.items()} == {n: s.names for n, s in TABLES.items()}
    assert {(r["media_id"], r["media_kind"], r["source"]) for r in new["media_external_id"].collect()} == {(1, "anime", "jikan"), (2, "manga", "jikan"), (1, "anime", "kitsu")}
    assert new["media"].where("cover_image IS NULL").count() == 2
    store = Store(spark, str(tmp_path / "store"))
    import_tables(store, old, 1)
    assert store.read("media").count() == 2 and store.read("episode").count() == 0


def test_episodes_of_version_five_are_dropped(spark):
    media = spark.createDataFrame([(1, "anime", "A")], "media_id long, media_kind string, title_display string")
    old = spark.createDataFrame([(1, 3)], "media_id long, episode_number int")
    assert migrate({"media": media, "episode": old}, 5)["episode"].count() == 0
    with pytest.raises(ValueError, match="no schema version 7"):
        migrate({"media": media}, 7)


def test_field_selection_reads_only_what_is_asked(spark, tmp_path):
    """Columns that a query doesn't name don't reach the scan."""
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    catalog.ingest(records(spark, 0, SHOWS[1]))
    plan = catalog.media().select("media_id", "title_display").where(F.col("media_kind") == "show")._jdf.queryExecution().executedPlan().toString()
    assert "synopsis" not in plan and "PushedFilters: [IsNotNull(media_kind), EqualTo(media_kind,show)]" in plan
