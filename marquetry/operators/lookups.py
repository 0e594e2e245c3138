"""Lookups: by unique id, by the first kind that has it, by page, and with a limit before the filter."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Ambiguous(ValueError):
    """An id that belongs to several media."""


def unique_media(ids: DataFrame, source: str, source_id: str) -> DataFrame:
    """The media that an id belongs to; with several, reading it is an error."""
    found = ids.where((F.col("source") == source) & (F.col("source_id") == source_id)).select("media_id").distinct()
    both = found.agg(F.min("media_id").alias("media_id"), F.count(F.lit(1)).alias("n")).where("n > 0")
    several = F.raise_error(F.lit(f"{source}:{source_id} belongs to several media")).cast("long")
    return both.select(F.when(F.col("n") == 1, F.col("media_id")).otherwise(several).alias("media_id"))


def first_matching_kind(rows: DataFrame, column: str, value: str, kinds: Sequence[str], order: str) -> DataFrame:
    """The row with a value, of the first kind that has one."""
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col("media_kind"))
    return rows.where((F.col(column) == value) & F.col("media_kind").isin(*kinds)).orderBy(place, order).limit(1)


def numbered_page(rows: DataFrame, order: str, page: int, size: int) -> DataFrame:
    """Page ``page`` (from 1) of ``size`` rows in order; both are at least 1."""
    page, size = max(page, 1), max(size, 1)
    return rows.orderBy(order).offset((page - 1) * size).limit(size)


@dataclass(frozen=True)
class Paged:
    """A table in order, written in parts by range, and how many rows stand before each part; a page reads its own parts only."""

    rows: DataFrame
    order: str
    parts: tuple[tuple[int, int, int], ...]

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number`` (from 1) of ``size`` rows; both are at least 1."""
        number, size = max(number, 1), max(size, 1)
        first = (number - 1) * size
        own = [(part, before) for part, before, n in self.parts if before < first + size and before + n > first]
        if not own:
            return self.rows.limit(0).drop("part")
        rows = self.rows.where(F.col("part").isin([part for part, _ in own])).drop("part")
        return rows.orderBy(self.order).offset(first - own[0][1]).limit(size)


def paged(rows: DataFrame, order: str, folder: str, per_part: int | None = None) -> Paged:
    """Writes ``rows`` to ``folder`` for `Paged`: sorted over the cluster once, a folder for each range of some ``per_part`` rows."""
    spark = rows.sparkSession
    parts = max(1, -(-rows.count() // per_part)) if per_part else int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("part", F.spark_partition_id())
    ranged.write.partitionBy("part").parquet(folder)
    out = spark.read.schema(ranged.schema).parquet(folder)
    before, found = 0, []
    for r in out.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # a row a part
        found.append((r["part"], before, r["n"]))
        before += r["n"]
    return Paged(out, order, tuple(found))


def limited_then_filtered(rows: DataFrame, order: str, limit: int, keep: Column) -> DataFrame:
    """Rows of the first ``limit`` that pass: the limit comes first on purpose."""
    return rows.orderBy(order).limit(limit).where(keep)

