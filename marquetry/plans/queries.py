"""Queries over the driver's tables, each through the operators it shows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.api import Catalog
from marquetry.functions import scalars as S
from marquetry.functions import scoring
from marquetry.operators import blocks, episodes, identity, merge, validate
from marquetry.operators import search as text
from marquetry.operators.lookups import Paged, first_matching_kind, limited_then_filtered, paged, unique_media
from marquetry.operators.search import SearchOptions
from marquetry.plans.views import as_records, episode_rows, id_rows, media, records, stored_ids, table
from marquetry.store import cut, scratch_path
from marquetry.streaming.replay import file_stream, replay_events
from marquetry.streaming.winners import winners_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

FIELDS = ("title_display", "synopsis")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


#: Search indexes that this driver has made, by session and folder.
_INDEXES: dict[tuple[str, str], blocks.Index] = {}


#: Tables in order of ids, likewise.
_PAGED: dict[tuple[str, str], Paged] = {}


def _index(spark: SparkSession, sf_dir: str) -> blocks.Index:
    """The stored index of a folder's documents; the first query that needs it makes it."""
    own = (spark.sparkContext.applicationId, sf_dir)
    if own not in _INDEXES:
        dealt = lambda rows, *order: cut(rows.repartitionByRange(*order).sortWithinPartitions(*order))
        index = blocks.build(cut(blocks.tokenised(media(spark, sf_dir), fields=FIELDS)), stored=lambda rows: dealt(rows, "token", "block"))
        each = {"postings": lambda rows: rows, "directory": lambda rows: cut(rows.sortWithinPartitions("token")), "terms": lambda rows: dealt(rows, "term")}
        _INDEXES[own] = index.map(lambda name, rows: each.get(name, cut)(rows))
    return _INDEXES[own]


def _hits(options: SearchOptions, words: str = "the of") -> Callable[[SparkSession, str], DataFrame]:
    """A page ranked from the stored index; titles are read for its rows only."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = blocks.search(_index(spark, sf_dir), words, options).select("media_id", F.round("score", 9).alias("score"))
        return hits.join(media(spark, sf_dir).select("media_id", "media_kind", "title_display"), "media_id").select("media_id", "media_kind", "title_display", "score")

    return run


QUERIES["bm25_search"] = _hits(SearchOptions())
QUERIES["bm25_search_kind"] = _hits(SearchOptions(media_kind="fr"), "ea")
QUERIES["bm25_search_format"] = _hits(SearchOptions(format="SRC3"))
QUERIES["bm25_search_kind_format"] = _hits(SearchOptions(media_kind="en", format="Src1"))
QUERIES["bm25_search_page2"] = _hits(SearchOptions(limit=10, offset=10))


@query
def bm25_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.bm25(media(spark, sf_dir), "Éa the", fields=FIELDS).select("media_id", F.round("score", 9).alias("score"))


@query
def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media(spark, sf_dir)
    hits = text.bm25_from_postings(text.postings(rows, fields=FIELDS), text.postings_stats(rows, fields=FIELDS), "ea the")
    return hits.select("media_id", F.round("score", 9).alias("score"))


@query
def token_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.postings(media(spark, sf_dir), fields=FIELDS).select("media_id", "token", "tf", "dl")


def _winners(fields: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = merge.merge_fields(records(spark, sf_dir), fields=fields, reasons=False)
        cols = [c for f in fields for c in (F.col(f"{f}.value").alias(f), F.round(f"{f}.score", 6).alias(f"{f}_score"), F.col(f"{f}.source").alias(f"{f}_source"))]
        return m.select("entity", *cols)

    return run


QUERIES["scored_merge_text"] = _winners(("title_display", "title_english", "synopsis"))
QUERIES["scored_merge_int"] = _winners(("season_year", "episodes"))
QUERIES["scored_merge_cover"] = _winners(("cover_image",))
QUERIES["scored_merge_bool"] = _winners(("nsfw",))


@query
def merge_rating_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_fields(records(spark, sf_dir), fields=(), reasons=False).select("entity", "provider_rating")


@query
def merge_first_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_fields(records(spark, sf_dir), fields=(), reasons=False).select("entity", "media_kind")


@query
def merge_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merge.provenance_rows(merge.merge_fields(records(spark, sf_dir), values=False, reasons=False))
    return rows.select("entity", "field_name", "source", "source_id", F.round("score", 6).alias("score"))


@query
def merge_upsert_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows first, then the rest: the same winners as one merge of all."""
    rows = records(spark, sf_dir)
    first = merge.merge_fields(rows.where("seq % 5 < 3"))
    stored, kept = merge.media_rows(first).withColumnRenamed("entity", "media_id"), merge.provenance_rows(first).withColumnRenamed("entity", "media_id")
    both = merge.upsert_fields(stored, kept, rows.where("seq % 5 >= 3").withColumnRenamed("entity", "media_id"))
    return both.select(F.col("media_id").alias("entity"), "media_kind", "provider_rating", F.col("synopsis.value").alias("synopsis"), F.round("synopsis.score", 6).alias("synopsis_score"), F.col("episodes.value").alias("episodes"), F.col("nsfw.value").alias("nsfw"))


@query
def ordered_ci_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.list_union(records(spark, sf_dir), "aliases").select("entity", F.array_join("aliases", "|").alias("aliases"))


@query
def alias_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.aliases(records(spark, sf_dir)).select("entity", "alias", "normalized_alias")


@query
def external_id_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "props")
    return merge.first_wins(e, ["user_id", "event_type"], "event_id")


@query
def payload_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "props")
    return merge.last_wins(e, ["user_id", "event_type"], "event_id")


@query
def merged_external_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.external_ids(records(spark, sf_dir)).select("entity", "media_kind", "source", "source_id")


@query
def merged_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.payloads(records(spark, sf_dir)).select("entity", "source", "source_id", "raw_json", "payload_hash")


@query
def upsert_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events: odd ones and all views come in, the others are there, so keys are old, new, and both."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "props")
    comes = (F.col("event_id") % 2 == 1) & (F.col("event_type") != "click") | (F.col("event_type") == "view")
    old, new = (merge.last_wins(e.where(w), ["user_id", "event_type"], "event_id") for w in (~comes, comes))
    return merge.keyed_upsert(old, new, ["user_id", "event_type"])


@query
def replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = lines.where("l_orderkey % 10 = 0 AND l_linenumber <= 2").withColumn("l_quantity", F.col("l_quantity") + 1)
    return merge.replace_children(lines, new, "l_orderkey")


@query
def episode_merge_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = episodes.merge_catalog(episode_rows(spark, sf_dir))
    return out.select("media_id", "episode_key", "season_number", "episode_number", "absolute_number", "title_display", "titles_json", "synopsis", "air_date", "runtime_minutes")


@query
def episode_merge_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = episodes.merge_effective(episode_rows(spark, sf_dir), "media_id")
    return out.select("media_id", "number", "source", "source_id", "episode_number", "absolute_number", "title_display", "synopsis", "air_date", "runtime_minutes")


@query
def episode_back_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.back_references(episode_rows(spark, sf_dir)).select("media_id", "source", "source_id", "episode_key")


@query
def episode_lookup_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.by_absolute(episodes.merge_catalog(episode_rows(spark, sf_dir)), 7, 5).select("media_id", "episode_key", "title_display")


@query
def episode_lookup_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.by_season(episodes.merge_catalog(episode_rows(spark, sf_dir)), 1, 1, 2).select("media_id", "episode_key", "title_display")


@query
def episode_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = episodes.in_order(episodes.merge_catalog(episode_rows(spark, sf_dir)).where("media_id = 7"))
    return out.select("episode_key", "season_number", "episode_number", "absolute_number")


@query
def source_episode_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.source_order(episode_rows(spark, sf_dir).where("media_id = 7")).select("source", "source_id", "absolute_number")


@query
def document_nest(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("media_id")).distinct()
    n = F.col("turn").cast("int")
    many = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("media_id"), F.lit(1).alias("season_number"), n.alias("episode_number"), F.lit(None).cast("int").alias("absolute_number"), "role")
    out = episodes.document(one, many)
    return out.select("media_id", F.size("episode_list").alias("n_episodes"), F.array_join(F.transform("episode_list", lambda e: F.concat(e["episode_number"].cast("string"), F.lit(":"), e["role"])), ",").alias("episodes"))


@query
def media_children_nest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    lines = merge.nest(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("p")), "l_orderkey", "l_linenumber", "p", "parts")
    out = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
    return out.select("o_orderkey", "o_orderstatus", F.coalesce(F.array_join("parts", ","), F.lit("")).alias("parts"))


@query
def identity_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.resolve(id_rows(spark, sf_dir), stored_ids(spark, sf_dir))


@query
def identity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.conflicts(id_rows(spark, sf_dir), stored_ids(spark, sf_dir))


@query
def identity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.components(id_rows(spark, sf_dir))


@query
def identity_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = id_rows(spark, sf_dir)
    return identity.replay(ids, identity.components(ids))


@query
def ambiguous_external_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.ambiguous(stored_ids(spark, sf_dir))


@query
def second_source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.second_ids(stored_ids(spark, sf_dir))


@query
def left_join_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, r = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(r, "doc_id", "left").select("doc_id", S.rating(F.col("quality") * 7 + F.col("n_chars") % 5, 10).alias("provider_rating"))


@query
def semi_join_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return lines.join(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey", "left_semi")


@query
def hash_join_episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey").select("l_orderkey", "l_linenumber", "p_partkey", "p_name", S.positive(F.col("p_size") - 25).alias("size_over"))


@query
def json_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("s_suppkey"))
    return e.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey").select("event_id", "s_suppkey", "s_name")


@query
def included_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in order against sideloaded rows: the first match of each, the order of references kept."""
    refs = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("pos"), F.col("l_suppkey").alias("s_suppkey"))
    found = refs.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    return merge.nest(found, "l_orderkey", "pos", "s_name", "names").select("l_orderkey", F.array_join("names", ",").alias("names"))


@query
def coalesced_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of even numbers against those of odd ones."""
    rows = episode_rows(spark, sf_dir)
    a, b = rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1")
    out = a.alias("a").join(b.alias("b"), (F.col("a.media_id") == F.col("b.media_id")) & episodes.same_numbers("a", "b"))
    return out.select(F.col("a.seq").alias("a_seq"), F.col("b.seq").alias("b_seq"))


@query
def multi_source_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id")
    out = e.agg(F.countDistinct("event_type").alias("n_sources"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("sources"))
    return out.where("n_sources >= 2")


@query
def rows_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("lang").alias("n_kinds"))


@query
def rows_with_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("props").contains("1")).alias("n_ones"), F.countDistinct("user_id").alias("n_entities"), F.sum(S.payload_hash(F.col("props")).cast("long")).alias("n_bytes"))


@query
def distinct_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("media_id")).distinct().orderBy("media_id")


@query
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(spark, sf_dir).where("media_id = 42").select("media_id", "media_kind", "title_display")


@query
def unique_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique_media(stored_ids(spark, sf_dir), "anilist", "a6")


@query
def kind_fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media(spark, sf_dir).withColumn("source_id", (F.col("media_id") % 100).cast("string"))
    return first_matching_kind(rows, "source_id", "17", ("es", "en"), "media_id").select("media_id", "media_kind")


@query
def collection_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media(spark, sf_dir)
    return rows.where((F.col("media_kind") == "en") & S.equal_ignoring_case(F.col("format"), F.lit("SRC7"))).select("media_id", "format")


@query
def paged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a table that is kept in order, by the directory of its parts; the first query that needs it writes it."""
    own = (spark.sparkContext.applicationId, sf_dir)
    if own not in _PAGED:
        _PAGED[own] = paged(media(spark, sf_dir).select("media_id", "media_kind"), "media_id", scratch_path(spark, "paged"))
    return _PAGED[own].page(3, 50)


@query
def limit_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limited_then_filtered(media(spark, sf_dir), "media_id", 50, S.equal_ignoring_case(F.col("format"), F.lit("SRC1"))).select("media_id", "format")


@query
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.title_contains(table(spark, sf_dir, "part"), "RE", 25, "p_partkey", "p_name").select("p_partkey", "p_name")


@query
def trending_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"))
    return out.orderBy(F.desc("quantity"), "l_partkey").limit(50)


@query
def recommendations_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of an item's edges; null nodes are dropped."""
    lines = table(spark, sf_dir, "lineitem")
    edges = lines.groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_linenumber") > 1, F.col("l_partkey"))).alias("edges"))
    return edges.select("l_orderkey", F.explode("edges").alias("node")).where("node IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("n"))


@query
def related_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of related items, flattened."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sort_array(F.collect_list("l_partkey")).alias("entry"))
    groups = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_returnflag", "entry"))).alias("relations"))
    flat = F.flatten(F.transform("relations", lambda g: g["entry"]))
    return groups.select("l_orderkey", F.array_join(flat, ",").alias("related"))


@query
def kind_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ("movie", "tvMovie", "video", "tvSeries", "tvMiniSeries", "tvSpecial", "tvEpisode", "short"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", S.title_type_kind(kinds).alias("kind")).where("kind IS NOT NULL")


@query
def adult_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.element_at(F.array(*map(F.lit, ("Rx - Hentai", "R+ - Mild Nudity", "G", "PG-13", "R - 17+"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", S.adult_rating(F.when(F.col("p_partkey") % 11 != 0, marks)).alias("nsfw"))


@query
def canonical_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    english, romaji, native = F.when(i % 3 == 0, F.col("text")), F.when(i % 3 == 1, F.col("lang")), F.col("source")
    return d.select("doc_id", F.coalesce(english, romaji, native).alias("title_display"), S.lower_ascii(F.upper("source")).alias("season"), S.year_of(F.concat(F.lit(1950) + i % 70, F.lit("-01-20"))).alias("season_year"), F.concat(F.lit("https://www.imdb.com/title/tt"), i.cast("string")).alias("url"), F.to_json(F.struct("doc_id", "lang")).alias("raw_json"))


@query
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", S.strip_html(F.col("html")).alias("synopsis"))


@query
def normalize_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.normalize_for_lookup(F.col("text")).alias("normalized"))


@query
def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(scoring.text_completeness(v), 6).alias("completeness"), F.round(scoring.text_quality(v, True), 6).alias("synopsis_quality"), F.round(scoring.text_quality(v, False), 6).alias("title_quality"))


@query
def cover_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.round(scoring.cover_quality(F.concat(F.col("url"), F.when(F.col("page_id") % 2 == 0, ".webp").otherwise("/Extra"))), 6).alias("quality"))


@query
def consistency_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("seq", F.round(scoring.consistency_of_record(), 6).alias("bonus"))


@query
def source_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episode_rows(spark, sf_dir).groupBy("source").agg(F.max(scoring.source_weight(F.col("source"))).alias("weight"), F.max(scoring.episode_rank(F.col("source"))).alias("rank"))


@query
def year_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.year_of(F.when(F.col("o_orderkey") % 9 == 0, "bad").otherwise(day)).alias("year"))


@query
def null_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    raw = F.when(i % 4 == 0, "\\N").when(i % 4 == 1, "").when(i % 4 == 2, F.concat(i.cast("string"), F.lit("x"))).otherwise(i.cast("string"))
    return table(spark, sf_dir, "events").select("event_id", S.marked_null(raw).alias("text_value"), S.marked_int(raw).alias("int_value"), S.positive(F.coalesce(S.marked_int(raw), F.lit(0))).alias("positive_value"))


@query
def payload_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.payload_hash(F.col("text")).alias("payload_hash"))


@query
def first_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.first_search_token(F.col("text")).alias("token"))


@query
def alias_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.array(F.concat(F.lit(" "), F.col("p_brand"), F.lit(" ")), F.lower("p_brand"), F.lit(""), F.col("p_type"), F.upper("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(S.normalize_aliases(raw), " ").alias("aliases"))


@query
def union_skip_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all sources one after another; a source that fails is left out."""
    from marquetry.sources.registry import union_of

    e = table(spark, sf_dir, "events").select("event_id", "event_type")

    def fail() -> DataFrame:
        raise OSError("this source is down")

    found, _ = union_of({"click": lambda: e.where("event_type = 'click'"), "down": fail, "view": lambda: e.where("event_type = 'view'")})
    return found


@query
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = episode_rows(spark, sf_dir).select("media_id", "media_kind", "source", (F.col("seq") % 20).cast("string").alias("source_id"), F.col("seq").alias("pos"))
    return episodes.candidates(rows, episodes.candidate_rules(spark))


@query
def validate_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.outside_domain(table(spark, sf_dir, "events"), "event_type", ("click", "view", "purchase")).select("event_id", "event_type")


@query
def validate_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.repeated_keys(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"])


@query
def validate_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props")).alias("raw"))
    return validate.invalid_json(rows, "raw")


@query
def validate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).withColumn("external_ids", F.when(F.col("seq") % 17 == 0, F.slice("external_ids", 1, 0)).otherwise(F.col("external_ids")))
    return validate.split_valid(rows)[1].select("seq", "reason")


@query
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return validate.surviving(lines, table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0"), "o_orderkey")


@query
def orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return validate.orphans(lines, table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0"), "o_orderkey")


@query
def migration_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children copied with a column of their parent; of equal keys the first stays."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return merge.first_wins(o.join(c, "o_custkey"), ["segment", "o_orderpriority", "o_custkey"], "o_orderkey")


@query
def sync_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and records of a paged run over each source."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("upserted"))
    return e.select("event_type", "upserted", F.ceil(F.col("upserted") / 50).alias("fetched_pages"))


@query
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay_events(spark, sf_dir, "events.parquet")


@query
def stream_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream of files; the winners that are held as state, as provenance."""
    rows = winners_of(as_records(file_stream(spark, sf_dir, "documents.parquet"), table(spark, sf_dir, "labels")))
    return rows.select("entity", "field_name", "source", "source_id", F.round("score", 6).alias("score"))


def _shared_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records of one kind that share the ids of `id_rows`."""
    of = lambda source, letter, i: F.struct(F.lit(source).alias("source"), F.concat(F.lit(letter), F.floor(i).cast("string")).alias("source_id"), F.lit(None).cast("string").alias("url"))
    ids = F.array(of("anilist", "a", F.col("seq") / 2), F.when(F.col("seq") % 5 != 0, of("jikan", "j", (F.col("seq") + 1) / 2)))
    rows = records(spark, sf_dir).drop("entity", "source").withColumn("media_kind", F.lit("anime")).withColumn("external_ids", F.array_compact(ids))
    return rows.withColumn("genres", F.array("format")).withColumn("tags", F.array().cast("array<string>"))


def _catalog(spark: SparkSession, sf_dir: str, *until: int) -> Catalog:
    """A new catalog that takes all records, in batches that end before these parts of a hundred of the ids."""
    catalog, rows = Catalog(spark, scratch_path(spark, "catalog")), _shared_records(spark, sf_dir)
    last, low = rows.agg(F.max("seq")).first()[0] + 1, 0
    for part in (*until, 100):
        high = last * part // 100
        catalog.ingest(rows.where((F.col("seq") >= low) & (F.col("seq") < high)), f"seq:{high}")
        low = high
    return catalog


@query
def catalog_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches through identity, merge and store: the media there are then."""
    out = _catalog(spark, sf_dir, 40).media()
    return out.select("media_id", "title_display", "title_english", F.md5("synopsis").alias("synopsis"), "season_year", "episodes", "provider_rating", "nsfw")


@query
def catalog_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External ids that are left when every third media is deleted with all its children."""
    catalog = _catalog(spark, sf_dir)
    catalog.delete(catalog.media().where("media_id % 3 = 0"))
    return catalog.table("media_external_id").select("media_id", "source", "source_id")
