"""Checks that take the place of constraints: each gives the rows that break a rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquetry.functions.scalars import is_json, trim_space
from marquetry.schemas import MEDIA_KINDS

REASON = "reason"


def outside_domain(rows: DataFrame, column: str, values: Sequence[str] = MEDIA_KINDS) -> DataFrame:
    return rows.where(~F.coalesce(F.col(column).isin(*values), F.lit(False)))


def repeated_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def invalid_json(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull() & ~is_json(F.col(column)))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_anti")


def surviving(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parents still exist: a cascading delete."""
    return children.join(parents.select(key), key, "left_semi")


def record_fault() -> Column:
    """Why a record can't be taken, or null."""
    return F.when(F.coalesce(trim_space(F.col("title_display")), F.lit("")) == "", "title_display is empty").when(F.coalesce(F.size("external_ids"), F.lit(0)) < 1, "no external id")


def judged(records: DataFrame) -> DataFrame:
    """Records with the reason why they can't be taken, null if they can."""
    return records.withColumn(REASON, record_fault())


def split_valid(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that can be taken, and the others with a reason."""
    return parted(judged(records))


def parted(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of `judged` records, which may have been written before."""
    return judged.where(F.col(REASON).isNull()).drop(REASON), judged.where(F.col(REASON).isNotNull())


def second_ids(ids: DataFrame) -> DataFrame:
    """Media with several ids of one source."""
    return ids.groupBy("media_id", "source").agg(F.countDistinct("source_id").alias("n_ids")).where(F.col("n_ids") > 1)
