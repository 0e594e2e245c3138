"""Stored tables of older schema versions, brought to the current one a step at a time.

A step takes the tables by name and gives those of the next version; each is a rewrite of DataFrames, so
children stay when their parents' table is copied.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.operators.merge import first_wins
from marquetry.schemas import SCHEMA_VERSION, TABLES
from marquetry.store import Store

Tables = dict[str, DataFrame]
KEY = ("source", "media_kind", "source_id")


def add_columns(df: DataFrame, **kinds: str) -> DataFrame:
    """The columns that aren't there yet, as nulls."""
    return df.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in kinds.items() if name not in df.columns])


def with_kind(children: DataFrame, media: DataFrame) -> DataFrame:
    """Children with the kind of their media; orphans go, and of equal keys the first media stays."""
    joined = children.drop("media_kind").join(media.select("media_id", "media_kind"), "media_id")
    return first_wins(joined, KEY, "media_id")


def add_images(tables: Tables) -> Tables:
    """Version 1 to 2: images and a rating."""
    return tables | {"media": add_columns(tables["media"], cover_image="string", banner_image="string", provider_rating="double")}


def key_by_kind(tables: Tables) -> Tables:
    """Version 2 to 3: ids and payloads are keyed by kind as well; provenance is kept."""
    media = tables["media"]
    out = {name: with_kind(tables[name], media) for name in ("media_external_id", "source_record")}
    return tables | out | {"field_provenance": tables.get("field_provenance", _empty(media, "field_provenance"))}


def widen_kinds(tables: Tables) -> Tables:
    """Version 3 to 4: more kinds are allowed; nothing that is stored changes."""
    return tables


def add_episodes(tables: Tables) -> Tables:
    """Version 4 to 5: a table of episodes by source."""
    return tables | {"episode": tables.get("episode", _empty(tables["media"], "episode"))}


def split_episodes(tables: Tables) -> Tables:
    """Version 5 to 6: merged episodes and their source rows are kept apart; episodes of version 5 are dropped."""
    return tables | {"episode": _empty(tables["media"], "episode"), "episode_source_record": _empty(tables["media"], "episode_source_record")}


STEPS: dict[int, Callable[[Tables], Tables]] = {1: add_images, 2: key_by_kind, 3: widen_kinds, 4: add_episodes, 5: split_episodes}


def _empty(like: DataFrame, name: str) -> DataFrame:
    return like.sparkSession.createDataFrame([], TABLES[name])


def migrate(tables: Tables, version: int) -> Tables:
    """Tables of a version as those of the current one; a table that lacks is empty, and so is a column that lacks."""
    if version > SCHEMA_VERSION or version < 1:
        raise ValueError(f"no schema version {version}")
    for v in range(version, SCHEMA_VERSION):
        tables = STEPS[v](tables)
    spark: SparkSession = tables["media"].sparkSession
    out = {}
    for name, schema in TABLES.items():
        df = tables.get(name, spark.createDataFrame([], schema))
        df = add_columns(df, **{f.name: f.dataType.simpleString() for f in schema})
        out[name] = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    return out


def import_tables(store: Store, tables: Tables, version: int) -> None:
    """Writes migrated tables as one version of a store."""
    store.write(migrate(tables, version))
