"""Views that give the driver's tables the shape of catalog inputs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BY_TURN = ("anilist", "jikan", "kitsu", "tvmaze", "imdb")
_BY_EVENT = {"click": "anilist", "error": "jikan", "purchase": "kitsu", "signup": "tvmaze", "view": "imdb"}


def source_by_turn(doc_id: str = "doc_id") -> Column:
    turn = (F.col(doc_id) % len(_BY_TURN)).cast("int")
    return F.element_at(F.array(*map(F.lit, _BY_TURN)), turn + 1)


def entity_of(doc_id: str = "doc_id") -> Column:
    return F.floor(F.col(doc_id) / len(_BY_TURN)).cast("long")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as canonical records: each entity is seen by all sources one after another."""
    return as_records(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def as_records(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The same of a table or a stream of documents."""
    d = documents.join(labels, "doc_id", "left")
    i, source = F.col("doc_id"), source_by_turn()
    title = F.when(i % 7 != 0, F.substring("text", 1, 60))
    ids = F.struct(source.alias("source"), i.cast("string").alias("source_id"), F.lit(None).cast("string").alias("url"))
    return d.select(
        entity_of().alias("entity"),
        i.alias("seq"),
        source.alias("source"),
        F.col("lang").alias("media_kind"),
        title.alias("title_display"),
        F.when(i % 4 == 0, F.substring("text", 5, 30)).alias("title_romaji"),
        F.when(i % 3 == 0, title).alias("title_english"),
        F.lit(None).cast("string").alias("title_native"),
        F.when(i % 11 != 0, F.col("text")).alias("synopsis"),
        F.col("source").alias("format"),
        F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("string").alias("season"),
        F.when(i % 5 != 0, (F.col("n_chars") % 4).cast("int")).alias("episodes"),
        F.when(i % 6 != 0, (F.lit(1990) + F.col("n_chars") % 35).cast("int")).alias("season_year"),
        F.lit(None).cast("int").alias("chapters"),
        F.lit(None).cast("int").alias("volumes"),
        F.lit(None).cast("string").alias("country_of_origin"),
        F.when(i % 13 != 0, F.concat(F.when(i % 2 == 0, "https://").otherwise("http://"), F.lit("img.example.com/"), F.when(i % 3 == 0, "Large/").otherwise("small/"), i.cast("string"), F.when(i % 5 == 0, ".webp").otherwise(".jpg"))).alias("cover_image"),
        F.lit(None).cast("string").alias("banner_image"),
        F.col("quality").cast("double").alias("provider_rating"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("nsfw"),
        F.array(F.substring("text", 1, 12), F.col("source"), F.upper("source")).alias("aliases"),
        F.array(ids).alias("external_ids"),
        F.array(F.struct(source.alias("source"), i.cast("string").alias("source_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("remote_updated_at"), F.concat(F.lit('{"n":'), F.col("n_chars").cast("string"), F.lit("}")).alias("raw_json"))).alias("source_payloads"),
    )


RECORDS_SQL = """
cand AS (
  SELECT doc_id // 5 AS entity, doc_id AS seq, ['anilist','jikan','kitsu','tvmaze','imdb'][doc_id % 5 + 1] AS src,
         lang AS media_kind, source AS format, text AS full_text, n_chars,
         CASE WHEN doc_id % 7 <> 0 THEN substr(text, 1, 60) END AS title_display,
         CASE WHEN doc_id % 4 = 0 THEN substr(text, 5, 30) END AS title_romaji,
         CASE WHEN doc_id % 3 = 0 AND doc_id % 7 <> 0 THEN substr(text, 1, 60) END AS title_english,
         CASE WHEN doc_id % 11 <> 0 THEN text END AS synopsis,
         CASE WHEN doc_id % 5 <> 0 THEN (n_chars % 4)::INT END AS episodes,
         CASE WHEN doc_id % 6 <> 0 THEN (1990 + n_chars % 35)::INT END AS season_year,
         CASE WHEN doc_id % 13 <> 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'https://' ELSE 'http://' END || 'img.example.com/'
              || CASE WHEN doc_id % 3 = 0 THEN 'Large/' ELSE 'small/' END || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.webp' ELSE '.jpg' END END AS cover_image,
         quality::DOUBLE AS provider_rating, coalesce(toxic, 0) = 1 AS nsfw
  FROM documents LEFT JOIN labels USING (doc_id)),
c AS (SELECT *, CASE src WHEN 'anilist' THEN 0.90::DOUBLE WHEN 'jikan' THEN 0.76::DOUBLE WHEN 'kitsu' THEN 0.78::DOUBLE WHEN 'tvmaze' THEN 0.82::DOUBLE ELSE 0.85::DOUBLE END AS weight,
             0.2::DOUBLE * ((title_english IS NOT NULL)::INT + (title_romaji IS NOT NULL)::INT + (synopsis IS NOT NULL)::INT + (cover_image IS NOT NULL)::INT + 1) AS bonus FROM cand)
"""


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as merged media rows."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("media_id"), F.col("lang").alias("media_kind"), F.col("source").alias("format"), F.substring("text", 1, 60).alias("title_display"), F.col("text").alias("synopsis"))


def episode_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as episodes of users, numbered by day or by hour."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    source = F.create_map(*[F.lit(x) for kv in _BY_EVENT.items() for x in kv])[F.col("event_type")]
    none = F.lit(None).cast("string")
    return e.select(
        F.col("user_id").alias("media_id"),
        i.alias("seq"),
        source.alias("source"),
        i.cast("string").alias("source_id"),
        F.lit("anime").alias("media_kind"),
        F.lit(1).alias("season_number"),
        F.when(i % 5 != 0, F.hour("ts")).alias("episode_number"),
        F.when(i % 3 != 0, F.dayofmonth("ts")).alias("absolute_number"),
        F.when(i % 2 == 0, F.concat(F.lit("t"), i.cast("string"))).alias("title_display"),
        none.alias("title_original"),
        F.when(i % 7 != 0, F.col("props")).alias("synopsis"),
        F.date_format("ts", "yyyy-MM-dd").alias("air_date"),
        F.when(i % 4 != 0, F.floor("value").cast("int")).alias("runtime_minutes"),
        none.alias("thumbnail_url"),
        F.col("props").alias("titles_json"),
        F.col("props").alias("raw_titles_json"),
    )


EPISODES_SQL = """
ep AS (SELECT user_id AS media_id, event_id AS seq, MAP {'click':'anilist','error':'jikan','purchase':'kitsu','signup':'tvmaze','view':'imdb'}[event_type] AS source,
              MAP {'click':5,'error':3,'purchase':2,'signup':4,'view':5}[event_type] AS rank, event_id::VARCHAR AS source_id, 1 AS season_number,
              CASE WHEN event_id % 5 <> 0 THEN hour(ts)::INT END AS episode_number, CASE WHEN event_id % 3 <> 0 THEN day(ts)::INT END AS absolute_number,
              CASE WHEN event_id % 2 = 0 THEN 't' || event_id END AS title_display, CASE WHEN event_id % 7 <> 0 THEN props END AS synopsis,
              strftime(ts, '%Y-%m-%d') AS air_date, CASE WHEN event_id % 4 <> 0 THEN floor(value)::INT END AS runtime_minutes, props AS titles_json
       FROM events)
"""


def id_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External ids of documents: chains of up to five records share ids pair by pair."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.lit("anime").alias("media_kind"))
    a = d.select("seq", "media_kind", F.lit(0).alias("pos"), F.lit("anilist").alias("source"), F.concat(F.lit("a"), F.floor(F.col("seq") / 2).cast("string")).alias("source_id"))
    b = d.where(F.col("seq") % 5 != 0).select("seq", "media_kind", F.lit(1).alias("pos"), F.lit("jikan").alias("source"), F.concat(F.lit("j"), F.floor((F.col("seq") + 1) / 2).cast("string")).alias("source_id"))
    return a.unionByName(b)


IDS_SQL = """
ids AS (SELECT doc_id AS seq, 0 AS pos, 'anilist' AS source, 'a' || (doc_id // 2) AS source_id FROM documents
        UNION ALL SELECT doc_id, 1, 'jikan', 'j' || ((doc_id + 1) // 2) FROM documents WHERE doc_id % 5 <> 0)
"""


def stored_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the first halves of chains, each the property of its record's pair."""
    ids = id_rows(spark, sf_dir).where(F.col("seq") % 4 < 2)
    return ids.select((F.floor(F.col("seq") / 3)).cast("long").alias("media_id"), "media_kind", "source", "source_id").distinct()


STORED_SQL = "stored AS (SELECT DISTINCT (seq // 3)::BIGINT AS media_id, source, source_id FROM ids WHERE seq % 4 < 2)"
