"""The catalog: ingest records and episodes, look them up, and search, over versioned Parquet tables.

A batch of records is one job: identity is resolved for all of them, fields are merged by one aggregation, and
new versions of all tables become visible at once. A media's id is the arrival number of its first record.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.functions import scalars as S
from marquetry.operators import blocks, episodes, identity, merge, validate
from marquetry.operators import search as text
from marquetry.operators.lookups import first_matching_kind, unique_media
from marquetry.operators.search import SearchOptions
from marquetry.schemas import EPISODE_SOURCE_RECORD
from marquetry.store import Changed, Store, cut, cuts

#: How often a batch is worked out again when another writer came between, and hits that are looked up by their ids.
ATTEMPTS, LISTED = 3, 1000


@dataclass(frozen=True)
class Ingested:
    """Counts of a batch, and the records that weren't taken with their reasons."""

    inserted: int
    updated: int
    rejected: DataFrame


class Collection:
    """The media of one kind, perhaps of one format."""

    def __init__(self, catalog: Catalog, kind: str, format: str | None = None) -> None:
        self.catalog, self.kind, self.format = catalog, kind, format

    def rows(self) -> DataFrame:
        out = self.catalog.media().where(F.col("media_kind") == self.kind)
        return out if self.format is None else out.where(S.equal_ignoring_case(F.col("format"), F.lit(self.format)))

    def search(self, query: str, options: SearchOptions = SearchOptions()) -> DataFrame:
        return self.catalog.search(query, replace(options, media_kind=self.kind, format=self.format or options.format))

    def get(self, media_id: int) -> DataFrame:
        return self.rows().where(F.col("media_id") == media_id)

    def by_external_id(self, source: str, source_id: str) -> DataFrame:
        ids = self.catalog.table("media_external_id").where((F.col("media_kind") == self.kind) & (F.col("source") == source) & (F.col("source_id") == source_id))
        return self.rows().join(ids.select("media_id"), "media_id", "left_semi")


class Catalog:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.store = spark, Store(spark, path)
        self.anime = Collection(self, "anime")
        self.manga = Collection(self, "manga")
        self.movie = Collection(self, "anime", "MOVIE")
        self.show = Collection(self, "show")
        self.tv_movie = Collection(self, "movie")

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def sql(self, query: str) -> DataFrame:
        """A query over all tables, by their names."""
        for name in ("media", "media_alias", "media_external_id", "source_record", "field_provenance", "sync_state", "episode", "episode_source_record"):
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(query)

    # Records

    def ingest(self, records: DataFrame, batch: str | None = None, also: dict[str, DataFrame] | None = None) -> Ingested:
        """Merges canonical records that have a unique ``seq``, later than those of any batch before, in its order.

        Rows of other tables that belong to the batch (``also``) become visible with it. What it writes on the way is dropped at
        the end, but for the records that weren't taken.
        """
        with cuts() as made:
            valid, invalid = validate.parted(cut(validate.judged(records)))
            for attempt in range(ATTEMPTS):
                try:
                    counts, refused = self._ingest(valid, batch, also or {})
                    break
                except Changed:
                    if attempt == ATTEMPTS - 1:
                        raise
            rejected = cut(invalid.unionByName(refused.select(*invalid.columns)))
            if rejected.isEmpty():
                rejected = self.spark.createDataFrame([], rejected.schema)
            made[:] = [m for m in made if m is not rejected]
        return Ingested(counts.get("inserted", 0), counts.get("updated", 0), rejected)

    def _ingest(self, valid: DataFrame, batch: str | None, also: dict[str, DataFrame]) -> tuple[dict[str, int], DataFrame]:
        entry = self.store.pointer()
        ids = identity.exploded_ids(valid)
        stored = self.store.read("media_external_id", entry)
        keys = cut(ids.select("media_kind", "source", "source_id").distinct())
        met = stored.join(keys, ["media_kind", "source", "source_id"], "left_semi").select("media_id").distinct()
        known = stored.join(met, "media_id", "left_semi").select(F.col("media_id").alias("seq"), "media_kind", F.lit(-1).alias("pos"), "source", "source_id")
        placed = cut(identity.placed(cut(known.unionByName(ids))).join(valid.select("seq"), "seq", "left_semi"))
        taken = cut(valid.join(placed.where("media_id IS NOT NULL").select("seq", "media_id"), "seq"))
        refused = valid.join(placed.where("media_id IS NULL").select("seq", F.col("status").alias("reason")), "seq")
        counts = {r["status"]: r["n"] for r in placed.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        self._write_media(taken, batch, entry, also, {"media_external_id": keys})
        return counts, refused

    def _write_media(self, taken: DataFrame, batch: str | None, entry: dict, also: dict[str, DataFrame], reads: dict[str, DataFrame]) -> None:
        touched = cut(taken.select("media_id").distinct())
        old = cut(self.store.read("media", entry).join(touched, "media_id", "left_semi"))
        old_alias = cut(self.store.read("media_alias", entry).join(touched, "media_id", "left_semi"))
        provenance = self.store.read("field_provenance", entry).join(touched, "media_id", "left_semi")
        merged = cut(merge.upsert_fields(old, provenance, taken))
        rows = merge.media_rows(merged, "media_id")
        for name in ("genres", "tags"):
            kept = old.select("media_id", F.lit(-1).cast("long").alias("seq"), name)
            lists = merge.list_union(kept.unionByName(taken.select("media_id", "seq", name)), name, "media_id")
            rows = rows.join(lists, "media_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
        rows, alias = cut(rows.select(*old.columns)), cut(self._aliases(taken, old_alias))
        new_ids = merge.external_ids(taken, "media_id").select("media_id", "media_kind", "source", "source_id", "url")
        payload = merge.payloads(taken, "media_id").select("media_id", "media_kind", "source", "source_id", "url", "remote_updated_at", F.current_timestamp().alias("fetched_at"), "raw_json", "payload_hash")
        key = ["source", "media_kind", "source_id"]
        self.store.merge(
            {
                "media": rows,
                "media_alias": alias,
                **self._index(self._tokens(rows, alias), self._tokens(old, old_alias)),
                "media_external_id": merge.last_wins(new_ids, key, "media_id"),
                "source_record": merge.last_wins(payload, key, "media_id"),
                "field_provenance": merge.provenance_rows(merged, "media_id").withColumn("updated_at", F.current_timestamp()),
                **also,
            },
            batch,
            entry["generation"],
            reads,
        )

    def delete(self, media_ids: DataFrame) -> None:
        """Deletes media (``media_id``) with all their children and index rows, at once."""
        with cuts():
            entry = self.store.pointer()
            keys = cut(media_ids.select(F.col("media_id").cast("long").alias("media_id")).distinct())
            old = self._tokens(*[self.store.read(t, entry).join(keys, "media_id", "left_semi") for t in ("media", "media_alias")])
            sums = {name: rows for name, rows in self._index(old.limit(0), old).items() if name in ("search_term", "search_total")}
            self.store.delete("media", keys, sums, entry["generation"])

    @staticmethod
    def _aliases(taken: DataFrame, old: DataFrame) -> DataFrame:
        kept = old.groupBy("media_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "alias"))), lambda x: x["alias"]).alias("aliases"))
        rows = kept.select("media_id", F.lit(-1).cast("long").alias("seq"), "aliases").unionByName(taken.select("media_id", "seq", "aliases"))
        return merge.aliases(rows, "media_id").select("media_id", "alias", "normalized_alias", F.col("place.seq").alias("seq"))

    # Episodes

    def ingest_episodes(self, rows: DataFrame) -> None:
        """Episodes of media (``media_id`` and ``seq`` beside the canonical columns); merges those of the media anew."""
        new = rows.withColumn("titles_json", F.col("raw_titles_json")).withColumn("fetched_at", F.current_timestamp())
        new = episodes.back_references(new.withColumn("titles_json", S.json_or_null(F.col("titles_json"))).withColumn("raw_json", S.json_or_null(F.col("raw_json"))))
        new = merge.last_wins(new.select(*EPISODE_SOURCE_RECORD.names), ["source", "source_id", "media_id"], "seq")
        with cuts():
            new = cut(new)
            entry, touched = self.store.pointer(), new.select("media_id").distinct()
            stored = self.store.read("episode_source_record", entry).join(touched, "media_id", "left_semi")
            sources = merge.keyed_upsert(stored, new, ["source", "source_id", "media_id"])
            self.store.merge({"episode_source_record": new, "episode": episodes.merge_catalog(sources)}, expected=entry["generation"])

    def episodes_for(self, media_id: int) -> DataFrame:
        return episodes.in_order(self.table("episode").where(F.col("media_id") == media_id))

    def source_episodes_for(self, media_id: int) -> DataFrame:
        return episodes.source_order(self.table("episode_source_record").where(F.col("media_id") == media_id))

    def episode_by_absolute(self, media_id: int, number: int) -> DataFrame:
        return episodes.by_absolute(self.table("episode"), media_id, number)

    def episode_by_season(self, media_id: int, season: int, number: int) -> DataFrame:
        return episodes.by_season(self.table("episode"), media_id, season, number)

    def episodes_by_external_id(self, source: str, source_id: str) -> DataFrame:
        return self.table("episode").join(self.resolve(source, source_id).select("media_id"), "media_id", "left_semi")

    def episode_candidates(self, media_id: int | None = None) -> DataFrame:
        """Sources and ids to fetch episodes from."""
        ids = self.table("media_external_id")
        if media_id is not None:
            ids = ids.where(F.col("media_id") == media_id)
        return episodes.candidates(ids.withColumn("pos", F.lit(0)), episodes.candidate_rules(self.spark))

    # Lookups

    def media(self) -> DataFrame:
        return self.table("media")

    def get(self, media_id: int) -> DataFrame:
        return self.media().where(F.col("media_id") == media_id)

    def by_external_id(self, source: str, source_id: str, kind: str | None = None) -> DataFrame:
        """The media with an id; without a kind an id of several media is an error."""
        ids = self.table("media_external_id")
        if kind is not None:
            ids = ids.where(F.col("media_kind") == kind)
        return self.media().join(unique_media(ids, source, source_id), "media_id", "left_semi")

    def resolve(self, source: str, source_id: str) -> DataFrame:
        """The media with an id, an anime if there is one, else a show."""
        ids = self.table("media_external_id").where(F.col("source") == source)
        return first_matching_kind(ids, "source_id", source_id, ("anime", "show"), "media_id")

    def children(self, media_id: int) -> dict[str, DataFrame]:
        of = lambda t, *order: self.table(t).where(F.col("media_id") == media_id).orderBy(*order)
        return {"aliases": of("media_alias", "alias"), "external_ids": of("media_external_id", "source"), "source_records": of("source_record", "source"), "provenance": of("field_provenance", "field_name")}

    def documents(self) -> DataFrame:
        """Each media with its episodes as a list."""
        return episodes.document(self.media(), self.table("episode"))

    def document(self, media_id: int) -> DataFrame:
        of = F.col("media_id") == media_id
        return episodes.document(self.media().where(of), self.table("episode").where(of))

    def document_by_external_id(self, source: str, source_id: str) -> DataFrame:
        found = self.resolve(source, source_id).select("media_id")
        return episodes.document(self.media().join(found, "media_id", "left_semi"), self.table("episode").join(found, "media_id", "left_semi"))

    @staticmethod
    def _tokens(media: DataFrame, alias: DataFrame) -> DataFrame:
        names = alias.groupBy("media_id").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
        texts = media.select("media_id", "media_kind", "format", *[f for f in text.FIELDS if f != "aliases"])
        return cut(blocks.packed(blocks.worded(blocks.dealt(texts.join(names, "media_id", "left")))))

    @staticmethod
    def _index(new: DataFrame, old: DataFrame) -> dict[str, DataFrame]:
        """Rows of the index's tables for media as they are now; sums lose what the old ones had."""
        batch, index = F.lit(uuid.uuid4().hex).alias("batch"), blocks.build(new, near=True)
        minus = lambda rows, names: rows.select(*[(-F.col(c)).alias(c) if c in names else F.col(c) for c in rows.columns])
        sizes = old.select(F.inline("rows"))
        totals = index.totals.unionByName(minus(sizes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("tokens")), ("n", "tokens")))
        terms = index.terms.unionByName(minus(blocks.counted(old), ("n",))).groupBy("term").agg(F.sum("n").alias("n")).where("n <> 0")
        return {
            "search_posting": index.postings,
            "search_row": index.rows,
            "search_block": index.directory.select(batch, "*"),
            "search_term": terms.select(batch, "*"),
            "search_total": totals.agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).select(batch, "*"),
        }

    def reindex(self) -> None:
        """Makes the search index anew, as for tables that were written without one."""
        entry = self.store.pointer()
        with cuts():
            new = self._tokens(self.store.read("media", entry), self.store.read("media_alias", entry))
            media = self.store.read("media", entry).select("media_id")
            self.store.write(self._index(new, new.limit(0)), expected=entry["generation"], reads={"media": media})

    def index(self) -> blocks.Index | None:
        """The stored index of one generation, if there is one."""
        entry = self.store.pointer()
        names = ("search_posting", "search_row", "search_block", "search_term", "search_total")
        return blocks.Index(*[self.store.read(n, entry) for n in names]) if set(names) <= set(entry["tables"]) else None

    def search(self, query: str, options: SearchOptions = SearchOptions()) -> DataFrame:
        """``media_id, media_kind, title_display, synopsis, score`` of the best hits.

        Ranks are worked out from the stored index, block by block; texts are read for the hits of the page only. Media that were
        written without an index are searched by their texts; `reindex` makes one.
        """
        text.query_terms(query)
        index, media = self.index(), self.media().select("media_id", "media_kind", "title_display", "synopsis")
        if index is None:
            names = self.table("media_alias").groupBy("media_id").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
            return text.search(self.media().join(names, "media_id", "left"), query, options)
        hits = blocks.search(index, query, options).select("media_id", "score")
        if options.limit <= LISTED:
            rows = [tuple(r) for r in hits.collect()]  # a page
            hits = self.spark.createDataFrame(rows, "media_id long, score double")
            media = media.where(F.col("media_id").isin([r[0] for r in rows]))
        return hits.join(media, "media_id").select(*media.columns, "score").orderBy(F.desc("score"), "media_id")

    def export(self, path: str) -> None:
        """Gzipped JSON lines of all documents; the list of episodes has a column of its own, beside their number."""
        self.documents().write.option("compression", "gzip").json(path)
