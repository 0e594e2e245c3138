r"""Delimited dumps: tab-separated, a header line, ``\N`` for null, no quoting.

A gzip file can't be split, so its rows are dealt out after reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquetry.functions import scalars as S
from marquetry.schemas import BASICS, EPISODES, RATINGS

SOURCE = "imdb"
TITLE_URL = "https://www.imdb.com/title/"


def read_rows(spark: SparkSession, path: str, schema: T.StructType, least: int | None = None, deal: bool = True) -> DataFrame:
    """Rows with ``least`` fields or more (all of the schema's by default); shorter ones, and the header, are dropped."""
    lines = spark.read.text(path)
    if deal and path.endswith(".gz"):
        lines = lines.repartition(spark.sparkContext.defaultParallelism)
    parts = F.split("value", "\t")
    rows = lines.select(parts.alias("p")).where((F.size("p") >= (least or len(schema))) & (F.get("p", F.lit(0)) != schema.fields[0].name))
    return rows.select(*[F.get("p", F.lit(i)).alias(f.name) for i, f in enumerate(schema)])


def basics(spark: SparkSession, path: str) -> DataFrame:
    """Titles of known types with a primary title, typed; ``kind`` is the media kind."""
    rows = read_rows(spark, path, BASICS)
    out = rows.select(
        "tconst",
        "titleType",
        S.title_type_kind(F.col("titleType")).alias("kind"),
        S.marked_null(F.col("primaryTitle")).alias("primaryTitle"),
        S.marked_null(F.col("originalTitle")).alias("originalTitle"),
        (F.col("isAdult") == "1").alias("isAdult"),
        S.marked_int(F.col("startYear")).alias("startYear"),
        S.marked_int(F.col("endYear")).alias("endYear"),
        S.marked_int(F.col("runtimeMinutes")).alias("runtimeMinutes"),
        F.coalesce(F.split(S.marked_null(F.col("genres")), ","), F.array().cast("array<string>")).alias("genres"),
    )
    return out.where("primaryTitle IS NOT NULL")


def titles(spark: SparkSession, path: str) -> DataFrame:
    return basics(spark, path).where("kind IS NOT NULL")


def ratings(spark: SparkSession, path: str) -> DataFrame:
    rows = read_rows(spark, path, RATINGS, 2).select("tconst", S.marked_null(F.col("averageRating")).try_cast("double").alias("averageRating"))
    return rows.where("averageRating IS NOT NULL").groupBy("tconst").agg(F.max("averageRating").alias("averageRating"))


def episode_links(spark: SparkSession, path: str) -> DataFrame:
    rows = read_rows(spark, path, EPISODES)
    number = lambda c: F.coalesce(S.marked_int(F.col(c)), F.lit(0)).alias(c)
    return rows.select("tconst", "parentTconst", number("seasonNumber"), number("episodeNumber"))


def _url(tconst: Column) -> Column:
    return F.concat(F.lit(TITLE_URL), tconst)


def canonical_titles(rows: DataFrame, rated: DataFrame) -> DataFrame:
    """Titles with their ratings as canonical records; an unrated title stays."""
    none = lambda t: F.lit(None).cast(t)
    joined = rows.join(rated, "tconst", "left")
    differs = F.col("originalTitle").isNotNull() & (F.col("originalTitle") != F.col("primaryTitle"))
    payload = F.to_json(F.struct("tconst", "titleType", "primaryTitle", "isAdult", "startYear", "endYear", "runtimeMinutes"), {"ignoreNullFields": "false"})
    ids = F.struct(F.lit(SOURCE).alias("source"), F.col("tconst").alias("source_id"), _url(F.col("tconst")).alias("url"))
    return joined.select(
        F.col("kind").alias("media_kind"),
        F.coalesce("originalTitle", "primaryTitle").alias("title_display"),
        none("string").alias("title_romaji"),
        F.col("originalTitle").alias("title_english"),
        none("string").alias("title_native"),
        none("string").alias("synopsis"),
        F.col("titleType").alias("format"),
        none("string").alias("status"),
        F.col("startYear").cast("string").alias("season"),
        F.col("startYear").alias("season_year"),
        F.col("runtimeMinutes").alias("episodes"),
        none("int").alias("chapters"),
        none("int").alias("volumes"),
        none("string").alias("country_of_origin"),
        none("string").alias("cover_image"),
        none("string").alias("banner_image"),
        S.rating(F.col("averageRating"), 10).alias("provider_rating"),
        F.col("isAdult").alias("nsfw"),
        F.when(differs, F.array("originalTitle")).otherwise(F.array().cast("array<string>")).alias("aliases"),
        "genres",
        F.array().cast("array<string>").alias("tags"),
        F.array(ids).alias("external_ids"),
        F.array(F.struct(F.lit(SOURCE).alias("source"), F.col("tconst").alias("source_id"), _url(F.col("tconst")).alias("url"), none("string").alias("remote_updated_at"), payload.alias("raw_json"))).alias("source_payloads"),
    )


def canonical_episodes(rows: DataFrame, links: DataFrame, parents: DataFrame, strict: bool = False) -> DataFrame:
    """Episodes of the parents (``parentTconst``), joined to their titles.

    ``strict`` keeps only titles of known types, which leaves hardly any episode, as their own type isn't one.
    """
    rows = rows.where("kind IS NOT NULL") if strict else rows
    none = lambda t: F.lit(None).cast(t)
    near = links.join(parents.select("parentTconst").distinct(), "parentTconst", "left_semi")
    joined = rows.join(near, "tconst")
    payload = F.to_json(F.struct("tconst", "parentTconst", "seasonNumber", "episodeNumber", "primaryTitle", "originalTitle", "startYear", "runtimeMinutes"), {"ignoreNullFields": "false"})
    return joined.select(
        F.lit(SOURCE).alias("source"),
        F.col("tconst").alias("source_id"),
        F.lit("show").alias("media_kind"),
        S.positive(F.col("seasonNumber")).alias("season_number"),
        S.positive(F.col("episodeNumber")).alias("episode_number"),
        none("int").alias("absolute_number"),
        F.col("primaryTitle").alias("title_display"),
        F.col("originalTitle").alias("title_original"),
        none("string").alias("synopsis"),
        F.col("startYear").cast("string").alias("air_date"),
        F.col("runtimeMinutes").alias("runtime_minutes"),
        none("string").alias("thumbnail_url"),
        none("string").alias("raw_titles_json"),
        payload.alias("raw_json"),
    )


def with_media(episodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Episodes with the media of the parent that their payload names."""
    keyed = episodes.withColumn("source_parent", F.get_json_object("raw_json", "$.parentTconst"))
    owners = ids.where(F.col("source") == SOURCE).select("media_id", F.col("source_id").alias("source_parent"), "media_kind")
    return keyed.join(owners, ["media_kind", "source_parent"]).drop("source_parent")
