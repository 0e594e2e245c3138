"""Projections of sources' JSON payloads to canonical records.

Each function takes a DataFrame with a string column ``raw_json``, one item each, and gives canonical rows;
items without a usable title are dropped. All parsing is by explicit schemas inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquetry.functions import scalars as S
from marquetry.schemas import CANONICAL_EPISODE, CANONICAL_MEDIA

IMAGES = "original string, large string, medium string, small string, tiny string"
NAMED = "array<struct<name:string>>"

GRAPH_MEDIA = (
    "id long, idMal long, title struct<romaji:string,english:string,native:string>, synonyms array<string>, description string, format string, "
    "status string, episodes int, chapters int, volumes int, countryOfOrigin string, season string, seasonYear int, genres array<string>, "
    "averageScore double, updatedAt long, siteUrl string, isAdult boolean, bannerImage string, "
    f"coverImage struct<medium:string,large:string,extraLarge:string>, tags {NAMED}"
)
REST_MEDIA = (
    "mal_id long, url string, title string, title_english string, title_japanese string, title_synonyms array<string>, "
    "titles array<struct<type:string,title:string>>, synopsis string, type string, status string, episodes int, chapters int, volumes int, "
    "season string, year int, score double, rating string, images struct<jpg:struct<image_url:string,large_image_url:string>>, "
    f"trailer struct<images:struct<maximum_image_url:string>>, genres {NAMED}, themes {NAMED}, demographics {NAMED}"
)
REST_ENTRY = "mal_id long, url string, title string, name string, type string, images struct<jpg:struct<image_url:string,large_image_url:string>>"
REST_EPISODE = "mal_id long, url string, title string, title_japanese string, title_english string, title_romanji string, aired string"
REFS = "struct<data:array<struct<id:string,type:string>>>"
API_MEDIA = (
    "id string, type string, attributes struct<canonicalTitle:string,titles:struct<en:string,en_jp:string,ja_jp:string>,abbreviatedTitles:array<string>,"
    "synopsis:string,description:string,subtype:string,status:string,startDate:string,episodeCount:int,chapterCount:int,volumeCount:int,"
    f"posterImage:struct<{IMAGES.replace(' string', ':string')}>,coverImage:struct<{IMAGES.replace(' string', ':string')}>,averageRating:string,nsfw:boolean,ageRating:string,updatedAt:string>, "
    f"relationships struct<categories:{REFS},mappings:{REFS}>"
).replace(", large:", ",large:").replace(", medium:", ",medium:").replace(", small:", ",small:").replace(", tiny:", ",tiny:")
API_INCLUDED = "array<struct<type:string,id:string,attributes:struct<title:string,externalSite:string,externalId:string>>>"
API_EPISODE = (
    "id string, attributes struct<titles:struct<en:string,en_jp:string,ja_jp:string>,description:string,synopsis:string,number:int,relativeNumber:int,"
    "airdate:string,runtime:int,seasonNumber:int,thumbnail:struct<original:string,small:string>>"
)
SHOW = (
    "id long, url string, name string, genres array<string>, status string, summary string, premiered string, image struct<medium:string,original:string>, "
    "rating struct<average:double>, network struct<country:struct<code:string>>, webChannel struct<country:struct<code:string>>, externals struct<imdb:string>, updated long"
)
SHOW_EPISODE = "id long, url string, name string, season int, number int, airdate string, runtime int, image struct<medium:string,original:string>, summary string"

# Which list of a two-list source a kind is in.
LISTS = {"anime": "anime", "show": "anime", "manga": "manga", "movie": "manga"}


def _kept(rows: DataFrame) -> list[str]:
    """The arrival number goes through a projection if rows have one."""
    return [c for c in ("seq",) if c in rows.columns]


def _parsed(rows: DataFrame, schema: str) -> DataFrame:
    more = _kept(rows)
    return rows.select(*more, "raw_json", F.from_json("raw_json", schema).alias("j")).where("j IS NOT NULL").select(*more, "raw_json", "j.*")


def _ids(*pairs: tuple[str, Column, Column]) -> Column:
    """External ids in order; one without an id is left out."""
    each = [F.when(i.isNotNull(), F.struct(F.lit(s).alias("source"), i.cast("string").alias("source_id"), u.cast("string").alias("url"))) for s, i, u in pairs]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def _payload(source: str, source_id: Column, url: Column, updated: Column | None = None, raw: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.array(F.struct(F.lit(source).alias("source"), source_id.cast("string").alias("source_id"), url.cast("string").alias("url"), (none if updated is None else updated.cast("string")).alias("remote_updated_at"), (none if raw is None else raw).alias("raw_json")))


def _texts(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _present(c: Column) -> Column:
    return F.filter(_texts(c), lambda x: x.isNotNull())


def _canonical(rows: DataFrame, schema, **values: Column | str) -> DataFrame:
    """All columns of ``schema``; those not given are null, or empty lists."""
    cols = []
    for f in schema:
        given = values.get(f.name)
        c = F.lit(given) if isinstance(given, str) else given
        if c is None:
            c = F.array() if f.dataType.typeName() == "array" else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return rows.select(*_kept(rows), *cols)


def graph_media(rows: DataFrame, kind: str) -> DataFrame:
    r = _parsed(rows, GRAPH_MEDIA)
    none = F.lit(None)
    title = F.coalesce("title.english", "title.romaji", "title.native")
    return _canonical(
        r.where(title.isNotNull()),
        CANONICAL_MEDIA,
        media_kind=kind,
        title_display=title,
        title_romaji=F.col("title.romaji"),
        title_english=F.col("title.english"),
        title_native=F.col("title.native"),
        synopsis=F.col("description"),
        format=F.col("format"),
        status=F.col("status"),
        season=S.lower_ascii(F.col("season")),
        season_year=F.col("seasonYear"),
        episodes=F.col("episodes"),
        chapters=F.col("chapters"),
        volumes=F.col("volumes"),
        country_of_origin=F.col("countryOfOrigin"),
        cover_image=F.coalesce("coverImage.extraLarge", "coverImage.large", "coverImage.medium"),
        banner_image=F.col("bannerImage"),
        provider_rating=S.rating(F.col("averageScore"), 100),
        nsfw=F.coalesce("isAdult", F.lit(False)),
        aliases=_texts(F.col("synonyms")),
        genres=_texts(F.col("genres")),
        tags=_texts(F.col("tags.name")),
        external_ids=_ids(("anilist", F.col("id"), F.col("siteUrl")), ("myanimelist", F.col("idMal"), none)),
        source_payloads=_payload("anilist", F.col("id"), F.col("siteUrl"), F.col("updatedAt"), F.col("raw_json")),
    )


def rest_media(rows: DataFrame, kind: str) -> DataFrame:
    r = _parsed(rows, REST_MEDIA)
    title = F.coalesce("title_english", "title", "title_japanese")
    own = F.when(F.col("title").isNotNull(), F.array("title"))
    return _canonical(
        r.where(title.isNotNull()),
        CANONICAL_MEDIA,
        media_kind=kind,
        title_display=title,
        title_romaji=F.col("title"),
        title_english=F.col("title_english"),
        title_native=F.col("title_japanese"),
        synopsis=F.col("synopsis"),
        format=F.col("type"),
        status=F.col("status"),
        season=F.col("season"),
        season_year=F.col("year"),
        episodes=F.col("episodes"),
        chapters=F.col("chapters"),
        volumes=F.col("volumes"),
        cover_image=F.coalesce("images.jpg.large_image_url", "images.jpg.image_url"),
        banner_image=F.col("trailer.images.maximum_image_url"),
        provider_rating=S.rating(F.col("score"), 10),
        nsfw=S.adult_rating(F.col("rating")),
        aliases=F.concat(_present(F.col("titles.title")), _texts(F.col("title_synonyms")), _texts(own)),
        genres=_texts(F.col("genres.name")),
        tags=F.concat(_texts(F.col("themes.name")), _texts(F.col("demographics.name"))),
        external_ids=_ids(("jikan", F.col("mal_id"), F.col("url")), ("myanimelist", F.col("mal_id"), F.col("url"))),
        source_payloads=_payload("jikan", F.col("mal_id"), F.col("url"), raw=F.col("raw_json")),
    )


def rest_entries(rows: DataFrame, kind: str | None = None) -> DataFrame:
    """Recommended or related entries, which have little but an id; without a kind the entry's own type tells manga from anime."""
    r = _parsed(rows, REST_ENTRY)
    name = F.coalesce("title", "name")
    own = F.when(F.col("type") == "manga", "manga").otherwise("anime")
    return _canonical(
        r.where(name.isNotNull()),
        CANONICAL_MEDIA,
        media_kind=kind or own,
        title_display=name,
        title_romaji=name,
        cover_image=F.coalesce("images.jpg.large_image_url", "images.jpg.image_url"),
        nsfw=F.lit(False),
        external_ids=_ids(("myanimelist", F.col("mal_id"), F.col("url"))),
        source_payloads=_payload("jikan", F.col("mal_id"), F.col("url")),
    )


def rest_episodes(rows: DataFrame) -> DataFrame:
    r = _parsed(rows, REST_EPISODE)
    return _canonical(
        r,
        CANONICAL_EPISODE,
        source="jikan",
        source_id=F.col("mal_id"),
        media_kind="anime",
        absolute_number=F.col("mal_id"),
        title_display=F.coalesce("title", "title_english", "title_japanese"),
        title_original=F.col("title_japanese"),
        air_date=F.col("aired"),
        raw_json=F.col("raw_json"),
    )


def _sideloaded(refs: Column, included: Column, kind: str) -> Column:
    """What the references name among the sideloaded resources, in the references' order; the first of equal ones."""
    wanted = F.filter(F.coalesce(refs, F.array().cast("array<struct<id:string,type:string>>")), lambda r: r["type"] == kind)
    found = F.transform(wanted, lambda r: F.get(F.filter(included, lambda x: (x["id"] == r["id"]) & (x["type"] == kind)), F.lit(0))["attributes"])
    return F.filter(found, lambda x: x.isNotNull())


def _best_image(name: str) -> Column:
    return F.coalesce(*[F.col(f"{name}.{s}") for s in ("original", "large", "medium", "small", "tiny")])


def api_media(rows: DataFrame, kind: str) -> DataFrame:
    """Resources with ``included_json``, the response's sideloaded resources. Of several ids of the other list the first stays."""
    r = rows.select(*_kept(rows), "raw_json", F.from_json("raw_json", API_MEDIA).alias("j"), F.coalesce(F.from_json("included_json", API_INCLUDED), F.from_json(F.lit("[]"), API_INCLUDED)).alias("inc"))
    r = r.where("j IS NOT NULL").select(*_kept(rows), "raw_json", "inc", "j.id", "j.relationships", "j.attributes.*")
    title = F.coalesce("canonicalTitle", "titles.en", "titles.en_jp", "titles.ja_jp")
    tags = F.filter(F.transform(_sideloaded(F.col("relationships.categories.data"), F.col("inc"), "categories"), lambda a: a["title"]), lambda t: t.isNotNull())
    others = F.filter(_sideloaded(F.col("relationships.mappings.data"), F.col("inc"), "mappings"), lambda a: a["externalId"].isNotNull() & S.lower_ascii(a["externalSite"]).contains("myanimelist"))
    url = F.lit(f"https://kitsu.io/{LISTS[kind]}")
    return _canonical(
        r.where(title.isNotNull()),
        CANONICAL_MEDIA,
        media_kind=kind,
        title_display=title,
        title_romaji=F.col("titles.en_jp"),
        title_english=F.col("titles.en"),
        title_native=F.col("titles.ja_jp"),
        synopsis=F.coalesce("synopsis", "description"),
        format=F.col("subtype"),
        status=F.col("status"),
        season_year=S.year_of(F.col("startDate")),
        episodes=F.col("episodeCount"),
        chapters=F.col("chapterCount"),
        volumes=F.col("volumeCount"),
        cover_image=_best_image("posterImage"),
        banner_image=_best_image("coverImage"),
        provider_rating=S.rating(F.col("averageRating").try_cast("double"), 100),
        nsfw=F.coalesce("nsfw", F.lit(False)) | F.coalesce(F.col("ageRating") == "R18", F.lit(False)),
        aliases=F.concat(_texts(F.col("abbreviatedTitles")), F.filter(F.array("titles.en", "titles.en_jp", "titles.ja_jp"), lambda x: x.isNotNull())),
        tags=tags,
        external_ids=_ids(("kitsu", F.col("id"), url), ("myanimelist", F.get(others, F.lit(0))["externalId"], F.lit(None))),
        source_payloads=_payload("kitsu", F.col("id"), url, F.col("updatedAt"), F.col("raw_json")),
    )


def api_episodes(rows: DataFrame, kind: str) -> DataFrame:
    r = rows.select(*_kept(rows), "raw_json", F.from_json("raw_json", API_EPISODE).alias("j")).where("j IS NOT NULL").select(*_kept(rows), "raw_json", "j.id", "j.attributes.*")
    return _canonical(
        r,
        CANONICAL_EPISODE,
        source="kitsu",
        source_id=F.col("id"),
        media_kind=kind,
        season_number=F.col("seasonNumber"),
        episode_number=F.col("number"),
        absolute_number=F.col("relativeNumber"),
        title_display=F.coalesce("titles.en", "titles.en_jp"),
        title_original=F.col("titles.ja_jp"),
        synopsis=F.coalesce("synopsis", "description"),
        air_date=F.col("airdate"),
        runtime_minutes=F.col("runtime"),
        thumbnail_url=F.coalesce("thumbnail.original", "thumbnail.small"),
        raw_titles_json=F.to_json("titles", {"ignoreNullFields": "false"}),
        raw_json=F.col("raw_json"),
    )


def shows(rows: DataFrame) -> DataFrame:
    r = _parsed(rows, SHOW).withColumn("name", S.trim_space(F.col("name")))
    imdb = F.col("externals.imdb")
    return _canonical(
        r.where("name <> ''"),
        CANONICAL_MEDIA,
        media_kind="show",
        title_display=F.col("name"),
        synopsis=S.strip_html(F.col("summary")),
        status=F.col("status"),
        season_year=S.year_of(F.col("premiered")),
        country_of_origin=F.when(F.col("network.country").isNotNull(), F.col("network.country.code")).otherwise(F.col("webChannel.country.code")),
        cover_image=F.coalesce("image.original", "image.medium"),
        provider_rating=S.rating(F.col("rating.average"), 10),
        nsfw=F.lit(False),
        genres=_texts(F.col("genres")),
        external_ids=_ids(("tvmaze", F.col("id"), F.col("url")), ("imdb", imdb, F.concat(F.lit("https://www.imdb.com/title/"), imdb))),
        source_payloads=_payload("tvmaze", F.col("id"), F.col("url"), F.col("updated"), F.col("raw_json")),
    )


def show_episodes(rows: DataFrame) -> DataFrame:
    r = _parsed(rows, SHOW_EPISODE)
    return _canonical(
        r,
        CANONICAL_EPISODE,
        source="tvmaze",
        source_id=F.col("id"),
        media_kind="show",
        season_number=F.col("season"),
        episode_number=F.col("number"),
        title_display=F.col("name"),
        synopsis=S.strip_html(F.col("summary")),
        air_date=F.col("airdate"),
        runtime_minutes=F.col("runtime"),
        thumbnail_url=F.coalesce("image.original", "image.medium"),
        raw_json=F.col("raw_json"),
    )
