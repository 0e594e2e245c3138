"""Scored field merge: candidates of an entity are aggregated to one record with its provenance.

Folding records one after another, where a candidate replaces the winner if its score is no lower, ends
with the greatest (score, arrival) among the values that aren't null. So a merge is one aggregation of maxima of
numbers that hold both: it is hashed, it combines before the shuffle, and neither texts nor the printed
reasons of losers move. The records that won something are then looked up by entity and arrival.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquetry.functions.scalars import let, lower_ascii, normalize_for_lookup, payload_hash, trim_space
from marquetry.functions.scoring import UNSCORED, Scored, consistency_of_record, score_bool, score_cover, score_int, score_text

TEXT_FIELDS = ("title_display", "title_romaji", "title_english", "title_native", "synopsis", "format", "status", "season", "country_of_origin")
INT_FIELDS = ("season_year", "episodes", "chapters", "volumes")
IMAGE_FIELDS = ("cover_image", "banner_image")
BOOL_FIELDS = ("nsfw",)
FIELDS = TEXT_FIELDS + INT_FIELDS + IMAGE_FIELDS + BOOL_FIELDS


def origin() -> Column:
    """Source and id of a record: those of its first payload, else of its first external id."""
    none = F.struct(F.lit("anilist").alias("source"), F.lit("unknown").alias("source_id"))
    of = lambda c: F.get(F.transform(c, lambda x: F.struct(x["source"].alias("source"), x["source_id"].alias("source_id"))), F.lit(0))
    return F.coalesce(of(F.col("source_payloads")), of(F.col("external_ids")), none)


def scored(field: str, source: Column, bonus: Column) -> Scored:
    value = F.col(field)
    if field in TEXT_FIELDS:
        return score_text(source, value, bonus, field == "synopsis")
    if field in INT_FIELDS:
        return score_int(source, value, bonus)
    if field in IMAGE_FIELDS:
        return score_cover(source, value, bonus, F.col("provider_rating"))
    return score_bool(source, value, bonus)


_SCALE, _ROOM = float(1 << 60), 1 << 64


def _whole(x: int) -> Column:
    return F.lit(Decimal(x)).cast("decimal(20,0)")


def standing(value: Column, score: Column, seq: Column) -> Column:
    """Score and arrival as one number in their order; null values have none.

    A score below 4 times 2 to the 60th is a whole number that fits a long, and exact from 2 to the -8th up.
    """
    high = (score * F.lit(_SCALE)).cast("long").cast("decimal(19,0)") * _whole(_ROOM)
    return F.when(value.isNotNull(), (high + seq.cast("decimal(20,0)") + _whole(_ROOM // 2)).cast("decimal(38,0)"))


def arrival(number: Column) -> Column:
    return (F.pmod(number, _whole(_ROOM)) - _whole(_ROOM // 2)).cast("long")


def score_of(number: Column) -> Column:
    """The score that a standing holds."""
    high = (number - F.pmod(number, _whole(_ROOM))) / _whole(_ROOM)
    return high.cast("long").cast("double") / F.lit(_SCALE)


def merge_fields(records: DataFrame, entity: str = "entity", seq: str = "seq", fields: Sequence[str] = FIELDS, values: bool = True, reasons: bool = True) -> DataFrame:
    """One row for each entity: ``media_kind``, ``provider_rating``, and a struct of score, arrival, value and origin for each field.

    ``seq`` is unique within an entity. Scores are worked out once, in the first aggregate, and go along with the entity's first record. Winners, one a field at most,
    are looked up and gathered as they are, so nothing is sorted; without ``values`` and ``reasons`` no text is read for that.
    """
    rows = records.withColumn("_origin", origin()).withColumn("_bonus", consistency_of_record())
    parts = {f: scored(f, F.col("_origin.source"), F.col("_bonus")) for f in fields}
    best = rows.groupBy(entity).agg(
        F.min(seq).alias("_first"), F.max("provider_rating").alias("provider_rating"), *[F.max(standing(F.col(f), parts[f].total, F.col(seq))).alias(f"_at_{f}") for f in fields]
    )
    # Which records won which fields, as bits; the last bit is for the first record, of which the kind is, and which takes the standings along.
    standings = F.struct("provider_rating", *[f"_at_{f}" for f in fields]).alias("_best")
    by = best.select(entity, standings, F.array(*[arrival(F.col(f"_at_{f}")) for f in fields], F.col("_first").cast("long")).alias("_by"))
    won = by.select(entity, "_best", "_by", F.explode(F.array_distinct(F.array_compact("_by"))).alias(seq))
    bits = [F.when(F.get("_by", F.lit(i)) == F.col(seq), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(len(fields) + 1)]
    won = won.select(entity, seq, reduce(Column.bitwiseOR, bits).alias("_won"), F.when(F.col(seq) == F.get("_by", F.lit(len(fields))), F.col("_best")).alias("_best"))
    found = rows.join(won, [entity, seq])
    has = lambda bits, i: bits.bitwiseAND(F.lit(1 << i).cast("long")) != 0
    own = [F.col("_won").alias("won"), F.col("_best").alias("best"), F.col("media_kind").alias("kind"), F.col("_origin.source").alias("source"), F.col("_origin.source_id").alias("source_id")]
    own += [F.when(has(F.col("_won"), i), F.col(f)).alias(f"v_{f}") for i, f in enumerate(fields) if values]
    own += [F.when(has(F.col("_won"), i), parts[f].reason).alias(f"r_{f}") for i, f in enumerate(fields) if reasons]
    lists = found.groupBy(entity).agg(F.collect_list(F.struct(*own)).alias("_w"))
    winner = lambda i: F.get(F.filter("_w", lambda x: has(x["won"], i)), F.lit(0))
    lists = lists.withColumn("_one", winner(len(fields))).select(entity, "_w", F.col("_one.kind").alias("media_kind"), "_one.best.*")
    out = [F.col("media_kind"), F.col("provider_rating")]

    def of_field(f: str) -> Callable[[Column], Column]:
        def one(w: Column) -> Column:
            more = [w[f"v_{f}"].alias("value")] if values else []
            more += [w["source"].alias("source"), w["source_id"].alias("source_id")] + ([w[f"r_{f}"].alias("reason")] if reasons else [])
            return F.struct(score_of(F.col(f"_at_{f}")).alias("score"), arrival(F.col(f"_at_{f}")).alias("seq"), *more)

        return one

    out += [F.when(F.col(f"_at_{f}").isNotNull(), let(winner(i), of_field(f))).alias(f) for i, f in enumerate(fields)]
    return lists.select(entity, *out)


def media_rows(merged: DataFrame, entity: str = "entity") -> DataFrame:
    return merged.select(entity, "media_kind", *[F.col(f"{f}.value").alias(f) for f in FIELDS], "provider_rating")


def provenance_rows(merged: DataFrame, entity: str = "entity") -> DataFrame:
    """A row for each entity and field that has a winner; of a merge without reasons they are null."""
    each = []
    for f in FIELDS:
        reason = F.col(f"{f}.reason") if "reason" in merged.schema[f].dataType.names else F.lit(None).cast("string")
        each.append(F.struct(F.lit(f).alias("field_name"), F.col(f"{f}.source").alias("source"), F.col(f"{f}.source_id").alias("source_id"), F.col(f"{f}.score").alias("score"), reason.alias("reason")))
    out = merged.select(entity, F.explode(F.array(*each)).alias("p")).where(F.col("p.source").isNotNull())
    return out.select(entity, "p.*")


def ordered_union(rows: DataFrame, keys: Sequence[str], value: str, *order: str) -> DataFrame:
    """Distinct values of each key ignoring ASCII case: ``value`` in its first spelling, and ``place`` of that."""
    place = F.struct(*order)
    first = rows.where(F.col(value).isNotNull()).groupBy(*keys, lower_ascii(F.col(value)).alias("_k"))
    return first.agg(F.min(F.struct(place.alias("place"), F.col(value).alias("v"))).alias("m")).select(*keys, F.col("m.v").alias(value), F.col("m.place").alias("place"))


def list_union(records: DataFrame, column: str, entity: str = "entity", seq: str = "seq") -> DataFrame:
    """``entity`` and the ordered distinct union of a list column over its records."""
    each = records.select(entity, seq, F.posexplode(column).alias("pos", "v"))
    return nest(ordered_union(each, [entity], "v", seq, "pos"), entity, "place", "v", column)


def nest(rows: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """1:N values as a list in order."""
    packed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return rows.groupBy(key).agg(F.transform(packed, lambda x: x["v"]).alias(name))


def first_wins(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The first row of each key: insert, or ignore."""
    return _one(rows, keys, F.min, order)


def last_wins(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The last row of each key: insert, or replace."""
    return _one(rows, keys, F.max, order)


def _one(rows: DataFrame, keys: Sequence[str], pick, order: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    packed = F.struct(F.struct(*order).alias("o"), F.struct(*rest).alias("r"))
    return rows.groupBy(*keys).agg(pick(packed).alias("m")).select(*keys, *[F.col(f"m.r.{c}").alias(c) for c in rest]).select(*rows.columns)


def external_ids(records: DataFrame, entity: str = "entity", seq: str = "seq") -> DataFrame:
    """Union of external ids; the first of each source and id stays."""
    each = records.select(entity, "media_kind", seq, F.posexplode("external_ids").alias("pos", "x")).select(entity, "media_kind", seq, "pos", "x.*")
    return first_wins(each, [entity, "source", "source_id"], seq, "pos")


def payloads(records: DataFrame, entity: str = "entity", seq: str = "seq") -> DataFrame:
    """Union of payloads; the last of each source and id stays, in the place of the first."""
    each = records.select(entity, "media_kind", seq, F.posexplode("source_payloads").alias("pos", "x")).select(entity, "media_kind", seq, "pos", "x.*")
    rest = [c for c in each.columns if c not in (entity, "source", "source_id", seq, "pos")]
    out = each.groupBy(entity, "source", "source_id").agg(
        F.max(F.struct(F.struct(seq, "pos").alias("o"), F.struct(*rest).alias("r"))).alias("last"), F.min(F.struct(seq, "pos")).alias("place")
    )
    return out.select(entity, "source", "source_id", *[F.col(f"last.r.{c}").alias(c) for c in rest], "place", payload_hash(F.col("last.r.raw_json")).alias("payload_hash"))


def aliases(records: DataFrame, entity: str = "entity", seq: str = "seq") -> DataFrame:
    """Trimmed aliases, distinct ignoring case, with their lookup form; of equal forms the first stays."""
    each = records.select(entity, seq, F.posexplode("aliases").alias("pos", "alias")).withColumn("alias", trim_space(F.col("alias"))).where(F.col("alias") != "")
    union = ordered_union(each, [entity], "alias", seq, "pos").withColumn("normalized_alias", normalize_for_lookup(F.col("alias")))
    return first_wins(union, [entity, "normalized_alias"], "place")


def keyed_upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both; an incoming row replaces that of its key. Both sides have unique keys and the same columns."""
    rest = [c for c in existing.columns if c not in keys]
    old = existing.select(*keys, F.struct(*rest).alias("_old"))
    new = incoming.select(*keys, F.struct(*rest).alias("_new"))
    both = old.join(new, list(keys), "full_outer").withColumn("_row", F.coalesce("_new", "_old"))
    return both.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*existing.columns)


def replace_children(existing: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """All children of the parents that ``incoming`` names are replaced by its rows."""
    return existing.join(incoming.select(parent).distinct(), parent, "left_anti").unionByName(incoming)


def upsert_fields(existing: DataFrame, provenance: DataFrame, records: DataFrame, entity: str = "media_id", seq: str = "seq") -> DataFrame:
    """Merges incoming records into stored rows: as `merge_fields`, where a stored value has the score it was
    stored with, UNSCORED if it has none, and came before any record."""
    new = merge_fields(records, entity, seq)
    kept = provenance.groupBy(entity).agg(F.map_from_entries(F.collect_list(F.struct("field_name", F.struct("score", "source", "source_id", "reason")))).alias("_p"))
    old = existing.join(kept, entity, "left")
    aggs = []
    for f in FIELDS:
        p = F.col("_p")[f]
        s = F.struct(F.coalesce(p["score"], F.lit(UNSCORED)).alias("score"), F.lit(-1).cast("long").alias("seq"), F.col(f).alias("value"), p["source"].alias("source"), p["source_id"].alias("source_id"), p["reason"].alias("reason"))
        aggs.append(F.when(F.col(f).isNotNull(), s).alias(f"_old_{f}"))
    old = old.select(entity, F.col("media_kind").alias("_kind"), F.col("provider_rating").alias("_rating"), *aggs)
    both = old.join(new, entity, "full_outer")
    picked = [F.greatest(F.col(f"_old_{f}"), F.col(f)).alias(f) for f in FIELDS]
    return both.select(entity, F.coalesce("_kind", "media_kind").alias("media_kind"), F.greatest("_rating", "provider_rating").alias("provider_rating"), *picked)
