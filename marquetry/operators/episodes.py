"""Episodes: grouping by number, reduction by source rank, lookups, candidates, and nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.functions.scoring import episode_rank

NUMBERS = ("season_number", "episode_number", "absolute_number")
DETAILS = ("title_display", "title_original", "synopsis", "air_date", "runtime_minutes", "thumbnail_url")


def catalog_key() -> Column:
    """``abs:N`` where there is an absolute number, else ``se:S:E`` with 0 for what is missing."""
    absolute = F.concat(F.lit("abs:"), F.col("absolute_number").cast("string"))
    text = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    return F.when(F.col("absolute_number").isNotNull(), absolute).otherwise(F.concat(F.lit("se:"), text("season_number"), F.lit(":"), text("episode_number")))


def effective_number() -> Column:
    return F.coalesce(F.col("absolute_number"), F.col("episode_number"))


def _best(field: str, seq: str, name: str | None = None) -> Column:
    """The value that isn't null of the highest rank, the later of equal ones."""
    return F.max(F.when(F.col(field).isNotNull(), F.struct("_rank", F.col(seq), F.col(field).alias("v"))))["v"].alias(name or field)


def merge_catalog(rows: DataFrame, media: str = "media_id", seq: str = "seq") -> DataFrame:
    """Episodes by media and catalog key.

    Details come from the highest rank that has them; numbers and the titles' JSON come from the row of the
    lowest rank, the earliest of equal ones.
    """
    ranked = rows.withColumn("_rank", episode_rank(F.col("source"))).withColumn("episode_key", catalog_key())
    low = F.min(F.struct("_rank", F.col(seq), F.struct(*NUMBERS, F.col("titles_json")).alias("v"))).alias("_low")
    out = ranked.groupBy(media, "episode_key").agg(low, *[_best(f, seq) for f in DETAILS])
    return out.select(media, "episode_key", *[F.col(f"_low.v.{n}").alias(n) for n in NUMBERS], "title_display", "title_original", F.col("_low.v.titles_json").alias("titles_json"), *DETAILS[2:])


def merge_effective(rows: DataFrame, media: str | None = None, seq: str = "seq") -> DataFrame:
    """Episodes by effective number, rows without one dropped; identity and details come from the highest rank."""
    keys = ([media] if media else []) + ["number"]
    ranked = rows.withColumn("_rank", episode_rank(F.col("source"))).withColumn("number", effective_number()).where(F.col("number").isNotNull())
    top = F.max(F.struct("_rank", F.col(seq), F.struct("source", "source_id", "media_kind").alias("v"))).alias("_top")
    out = ranked.groupBy(*keys).agg(top, *[_best(f, seq) for f in (*NUMBERS, *DETAILS, "raw_titles_json")])
    return out.select(*keys, "_top.v.*", *NUMBERS, *DETAILS, "raw_titles_json")


def back_references(rows: DataFrame, media: str = "media_id") -> DataFrame:
    """Each source row with the key of the episode it went into."""
    return rows.withColumn("episode_key", catalog_key())


def same_numbers(a: str, b: str) -> Column:
    """Equal numbers, a missing one counting as 0."""
    zero = lambda t, c: F.coalesce(F.col(f"{t}.{c}"), F.lit(0))
    out = F.lit(True)
    for n in NUMBERS:
        out = out & (zero(a, n) == zero(b, n))
    return out


def in_order(episodes: DataFrame) -> DataFrame:
    return episodes.orderBy(*[F.coalesce(F.col(n), F.lit(0)) for n in NUMBERS])


def source_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("source", F.col("absolute_number").asc_nulls_first())


def by_absolute(episodes: DataFrame, media_id: int, number: int) -> DataFrame:
    return episodes.where((F.col("media_id") == media_id) & (F.col("absolute_number") == number))


def by_season(episodes: DataFrame, media_id: int, season: int, number: int) -> DataFrame:
    return episodes.where((F.col("media_id") == media_id) & (F.col("season_number") == season) & (F.col("episode_number") == number))


# Which external id leads to which source's episodes, by media kind.
CANDIDATE_RULES = (
    ("anime", "jikan", "jikan"),
    ("anime", "myanimelist", "jikan"),
    ("anime", "kitsu", "kitsu"),
    ("show", "tvmaze", "tvmaze"),
)


def candidate_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CANDIDATE_RULES, "media_kind string, source string, target string")


def candidates(ids: DataFrame, rules: DataFrame, media: str = "media_id", order: str = "pos") -> DataFrame:
    """Source and id to fetch episodes from, once for each media, with the place of the first id that leads there."""
    led = ids.join(rules, ["media_kind", "source"])
    return led.groupBy(media, F.col("target").alias("source"), "source_id").agg(F.min(order).alias(order))


def document(media: DataFrame, episodes: DataFrame, key: str = "media_id") -> DataFrame:
    """Each media row with its episodes as ``episode_list`` in order, empty without any; ``episodes`` stays their number."""
    rest = [c for c in episodes.columns if c != key]
    order = F.struct(*[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in NUMBERS])
    packed = F.sort_array(F.collect_list(F.struct(order.alias("o"), F.struct(*rest).alias("e"))))
    listed = episodes.groupBy(key).agg(F.transform(packed, lambda x: x["e"]).alias("episode_list"))
    kind = listed.schema["episode_list"].dataType
    return media.join(listed, key, "left").withColumn("episode_list", F.coalesce("episode_list", F.array().cast(kind)))
