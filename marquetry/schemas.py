"""Schemas of the catalog's tables and inputs, and the closed domains of their columns."""

from __future__ import annotations

from pyspark.sql import types as T

# The domains that results must use.
MEDIA_KINDS = ("anime", "manga", "show", "movie")
SOURCES = ("anilist", "myanimelist", "jikan", "kitsu", "tvmaze", "imdb")
SYNC_MODES = ("full", "incremental")

SCHEMA_VERSION = 6

EXTERNAL_ID = "struct<source:string,source_id:string,url:string>"
SOURCE_PAYLOAD = "struct<source:string,source_id:string,url:string,remote_updated_at:string,raw_json:string>"
PROVENANCE = "struct<field_name:string,source:string,source_id:string,score:double,reason:string,updated_at:string>"


_TYPES = {"string": T.StringType, "long": T.LongType, "int": T.IntegerType, "double": T.DoubleType, "boolean": T.BooleanType, "timestamp": T.TimestampType}


def _split(text: str) -> list[str]:
    """Parts between commas that aren't inside angle brackets."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _type(text: str) -> T.DataType:
    if text.startswith("array<"):
        return T.ArrayType(_type(text[6:-1]))
    if text.startswith("struct<"):
        return T.StructType([T.StructField(n, _type(t)) for n, _, t in (x.partition(":") for x in _split(text[7:-1]))])
    return _TYPES[text]()


def _of(ddl: str) -> T.StructType:
    """A schema from its columns; unlike Spark's own parser this needs no session."""
    fields = []
    for column in _split(ddl):
        name, _, kind = column.partition(" ")
        fields.append(T.StructField(name, _type(kind.removesuffix(" not null")), not kind.endswith(" not null")))
    return T.StructType(fields)


CANONICAL_MEDIA = _of(
    "media_kind string not null, title_display string not null, title_romaji string, title_english string, title_native string, "
    "synopsis string, format string, status string, season string, season_year int, episodes int, chapters int, volumes int, "
    "country_of_origin string, cover_image string, banner_image string, provider_rating double, nsfw boolean not null, "
    "aliases array<string>, genres array<string>, tags array<string>, "
    f"external_ids array<{EXTERNAL_ID}>, source_payloads array<{SOURCE_PAYLOAD}>"
)
CANONICAL_EPISODE = _of(
    "source string, source_id string, media_kind string, season_number int, episode_number int, absolute_number int, "
    "title_display string, title_original string, synopsis string, air_date string, runtime_minutes int, thumbnail_url string, "
    "raw_titles_json string, raw_json string"
)
MEDIA = _of(
    "media_id long, media_kind string, title_display string, title_romaji string, title_english string, title_native string, "
    "synopsis string, format string, status string, season string, season_year int, episodes int, chapters int, volumes int, "
    "country_of_origin string, cover_image string, banner_image string, provider_rating double, nsfw boolean, "
    "genres array<string>, tags array<string>"
)
MEDIA_ALIAS = _of("media_id long, alias string, normalized_alias string, seq long")
MEDIA_EXTERNAL_ID = _of("media_id long, media_kind string, source string, source_id string, url string")
SOURCE_RECORD = _of("media_id long, media_kind string, source string, source_id string, url string, remote_updated_at string, fetched_at timestamp, raw_json string, payload_hash string")
FIELD_PROVENANCE = _of("media_id long, field_name string, source string, source_id string, score double, reason string, updated_at timestamp")
EPISODE_SOURCE_RECORD = _of(
    "media_id long, source string, source_id string, media_kind string, season_number int, episode_number int, absolute_number int, "
    "title_display string, title_original string, titles_json string, synopsis string, air_date string, runtime_minutes int, "
    "thumbnail_url string, raw_json string, fetched_at timestamp, seq long, episode_key string"
)
EPISODE = _of(
    "media_id long, episode_key string, season_number int, episode_number int, absolute_number int, title_display string, "
    "title_original string, titles_json string, synopsis string, air_date string, runtime_minutes int, thumbnail_url string"
)
SYNC_STATE = _of("source string, scope string, page int, last_success_at string, last_error string, last_page int, mode string")
SEARCH_POSTING = _of("token string, media_id long, tf long, dl int, block long")
SEARCH_ROW = _of("media_id long, media_kind string, format string, dl int")
# Of these each batch adds rows, which are summed, or of which the greatest counts.
SEARCH_BLOCK = _of("batch string, token string, block long, ratio double, avg double, n long")
SEARCH_TERM = _of("batch string, term string, n long")
SEARCH_TOTAL = _of("batch string, n long, tokens long")

TABLES: dict[str, T.StructType] = {
    "media": MEDIA,
    "media_alias": MEDIA_ALIAS,
    "media_external_id": MEDIA_EXTERNAL_ID,
    "source_record": SOURCE_RECORD,
    "field_provenance": FIELD_PROVENANCE,
    "sync_state": SYNC_STATE,
    "episode": EPISODE,
    "episode_source_record": EPISODE_SOURCE_RECORD,
    "search_posting": SEARCH_POSTING,
    "search_row": SEARCH_ROW,
    "search_block": SEARCH_BLOCK,
    "search_term": SEARCH_TERM,
    "search_total": SEARCH_TOTAL,
}

BASICS = _of("tconst string, titleType string, primaryTitle string, originalTitle string, isAdult string, startYear string, endYear string, runtimeMinutes string, genres string")
RATINGS = _of("tconst string, averageRating string, numVotes string")
EPISODES = _of("tconst string, parentTconst string, seasonNumber string, episodeNumber string")
