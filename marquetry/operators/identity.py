"""Identity: which records describe the same item, by external ids shared within a media kind."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquetry.store import cut, drop_cuts


def exploded_ids(records: DataFrame, seq: str = "seq") -> DataFrame:
    """``seq, media_kind, pos, source, source_id``: a row for each external id of each record."""
    return records.select(seq, "media_kind", F.posexplode("external_ids").alias("pos", "x")).select(seq, "media_kind", "pos", "x.source", "x.source_id")


def resolve(ids: DataFrame, stored: DataFrame, seq: str = "seq") -> DataFrame:
    """The stored media of each record: the one that the first of its ids, in list order, belongs to."""
    met = ids.join(stored.select("media_id", "media_kind", "source", "source_id"), ["media_kind", "source", "source_id"])
    return met.groupBy(seq).agg(F.min(F.struct("pos", "media_id")).alias("m")).select(seq, F.col("m.media_id").alias("media_id"))


def conflicts(ids: DataFrame, stored: DataFrame, seq: str = "seq") -> DataFrame:
    """Records whose ids belong to several media, with how many."""
    met = ids.join(stored.select("media_id", "media_kind", "source", "source_id"), ["media_kind", "source", "source_id"])
    return met.groupBy(seq).agg(F.countDistinct("media_id").alias("n_media")).where(F.col("n_media") > 1)


def ambiguous(stored: DataFrame) -> DataFrame:
    """Source ids that belong to several media when the kind isn't given."""
    return stored.groupBy("source", "source_id").agg(F.countDistinct("media_id").alias("n_media")).where(F.col("n_media") > 1)


def components(ids: DataFrame, seq: str = "seq", max_rounds: int = 50) -> DataFrame:
    """``seq, component``: records that a chain of shared ids connects; the component is the least seq.

    Each record is tied to the least one that has one of its ids, so of ids nothing is left but pairs of numbers. In a round a node points to its
    least neighbour, pointers jump until all point to an end, and the pairs of ends that are still apart go on: there are ever fewer. All are plain minima that
    combine before the shuffle, so a hot id is no burden. Lineage is cut each round.
    """
    links = cut(ids.select(F.col(seq).alias("r"), F.struct("source_id", "source", "media_kind").alias("k")))
    least = links.groupBy("k").agg(F.min("r").alias("m"))
    pairs, passes = cut(links.join(least, "k").where("r <> m").select("r", "m").distinct()), []
    for _ in range(max_rounds):
        if pairs.isEmpty():
            break
        both = pairs.select(F.col("r").alias("x"), F.col("m").alias("y")).unionByName(pairs.select(F.col("m").alias("x"), F.col("r").alias("y")))
        near = cut(both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("label")))
        moved = True
        while moved:
            jump = near.select(F.col("x").alias("label"), F.col("label").alias("far"))
            new = cut(near.select("x", "label").join(jump, "label").select("x", F.col("far").alias("label"), (F.col("far") != F.col("label")).alias("moved")))
            drop_cuts(near)
            near, moved = new, not new.where("moved").isEmpty()
        passes.append(near.select("x", "label"))
        ends = near.select(F.col("x").alias("r"), F.col("label").alias("a")), near.select(F.col("x").alias("m"), F.col("label").alias("b"))
        left = cut(pairs.join(ends[0], "r").join(ends[1], "m").where("a <> b").select(F.col("a").alias("r"), F.col("b").alias("m")).distinct())
        drop_cuts(pairs)
        pairs = left
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = links.select("r", F.col("r").alias("label")).distinct()
    for p in passes:
        out = out.join(p.select(F.col("x").alias("label"), F.col("label").alias("to")), "label", "left").select("r", F.coalesce("to", "label").alias("label"))
    out = cut(out)
    drop_cuts(links)
    return out.select(F.col("r").alias(seq), F.col("label").alias("component"))


_REPLAYED = "seq long, media_id long, status string"
#: Records of a component up to which it is replayed by one task; larger ones are decided in rounds over the cluster.
SMALL, ROUNDS = 10_000, 40


def _decided(seq: int, ids: list[tuple], owner: dict[tuple, int], sources: dict[int, dict[str, str]]) -> tuple[int, int | None, str]:
    """What becomes of a component's next record; ``owner`` and ``sources``, which ids are whose and which each media has, take it up."""
    ids = list(dict.fromkeys(ids))
    found = [owner[i] for i in ids if i in owner]
    media = found[0] if found else int(seq)
    held = dict(sources.get(media, {}))
    status = "conflict" if len(set(found)) > 1 else "updated" if found else "inserted"
    if status != "conflict":
        for _, s, i in ids:
            if held.setdefault(s, i) != i:
                status = "duplicate_source"
    if status not in ("inserted", "updated"):
        return int(seq), None, status
    owner.update(dict.fromkeys(ids, media))
    sources[media] = held
    return int(seq), media, status


def _in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`_replay` of all components of a task, whose rows come in order of component, seq and pos; only one component is held at a time."""
    owner: dict[tuple, int] = {}
    sources: dict[int, dict[str, str]] = {}
    last, ids = None, []
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["seq", "media_id", "status"])
    for b in batches:
        out = []
        for component, seq, *key in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if last != (component, seq):
                if last is not None:
                    out.append(_decided(last[1], ids, owner, sources))
                if last is not None and last[0] != component:
                    owner, sources = {}, {}
                last, ids = (component, seq), []
            ids.append(tuple(key))
        if out:
            yield made(out)
    if last is not None:
        yield made([_decided(last[1], ids, owner, sources)])


def _replayed(rows: DataFrame) -> DataFrame:
    """Small components one after another within a task: a call for each would cost far more than what it does."""
    rows = rows.select("component", F.col("seq").cast("long").alias("seq"), "media_kind", "source", "source_id", "pos")
    dealt = rows.repartition("component").sortWithinPartitions("component", "seq", "pos")
    return dealt.drop("pos").mapInArrow(_in_turn, _REPLAYED)


def _replay(rows: pd.DataFrame) -> pd.DataFrame:
    """Records of a component one after another; rows with a media but no status of their own say which ids are taken already."""
    owner: dict[tuple, int] = {}
    sources: dict[int, dict[str, str]] = {}
    out = []
    if "media_id" in rows:
        held_now = rows[rows["media_id"].notna()]
        for kind, source, source_id, media in zip(held_now.media_kind, held_now.source, held_now.source_id, held_now.media_id, strict=True):
            owner[kind, source, source_id] = int(media)
            sources.setdefault(int(media), {})[source] = source_id
        rows = rows[rows["media_id"].isna()]
    for seq, own in rows.sort_values(["seq", "pos"]).groupby("seq", sort=False):
        out.append(_decided(seq, list(zip(own.media_kind, own.source, own.source_id, strict=True)), owner, sources))
    return pd.DataFrame(out, columns=["seq", "media_id", "status"]).astype({"media_id": "Int64"})


def in_rounds(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """What `_replay` gives, of all components at once: in a round every record is decided that nothing undecided can change any more.

    Owners of ids never change, so a record whose ids have two owners is a conflict, and one whose ids all have one is an update. A record that
    would give its media a second id of a source is doomed: it is refused, as a conflict if an earlier record may yet take one of its free
    ids, else as a duplicate. What is left would take free ids. It may if it is the earliest of these for each of its free
    ids and for its media: whoever could come before it would have to be earlier on one of them. A media takes an id of each source at most, so however many
    records share it, it is settled after as many rounds as there are sources. Chains that are longer than ``rounds`` are ended by `_replay`.
    """
    key = ["media_kind", "source", "source_id"]
    left = cut(rows.select("seq", "component", *key).distinct())
    double = left.groupBy("seq", "source").agg((F.count(F.lit(1)) > 1).alias("double")).groupBy("seq").agg(F.bool_or("double").alias("double"))
    left = cut(left.join(double, "seq"))
    owners: DataFrame | None = None
    decided: list[DataFrame] = []
    for _ in range(rounds):
        found = left.withColumn("media", F.lit(None).cast("long"))
        if owners is not None:  # a doomed record may see an id taken by a later one, which doesn't count for it
            found = left.join(owners.select(*key, "media", "by"), key, "left").withColumn("media", F.when(F.col("by") < F.col("seq"), F.col("media"))).drop("by")
        several = F.min("media") != F.max("media")
        media = found.groupBy("seq").agg(F.min("media").alias("own"), several.alias("several"), F.bool_and(F.col("media").isNotNull()).alias("all_owned"))
        found = cut(found.join(media.withColumn("several", F.coalesce("several", F.lit(False))), "seq"))
        clash = found.select("seq", F.lit(False).alias("clash")).limit(0)
        if owners is not None:
            held = owners.select(F.col("media").alias("own"), "source", F.col("source_id").alias("held_id"), "by")
            clash = found.where(~F.col("several")).join(held, ["own", "source"]).where((F.col("held_id") != F.col("source_id")) & (F.col("by") < F.col("seq")))
            clash = clash.select("seq", F.lit(True).alias("clash")).distinct()
        found = cut(found.join(clash, "seq", "left").withColumn("doomed", F.col("double") | F.coalesce("clash", F.lit(False))))
        live = found.where(~F.col("several") & ~F.col("doomed") & ~F.col("all_owned"))
        free = F.col("media").isNull()
        first_of_id = live.where(free).groupBy(*key).agg(F.min("seq").alias("first_of_id"))
        first_of_media = live.where(F.col("own").isNotNull()).groupBy("own").agg(F.min("seq").alias("first_of_media"))
        open_ = found.where(~F.col("several") & ~F.col("all_owned")).join(first_of_id, key, "left").join(first_of_media, "own", "left")
        none_before = ~free | F.col("first_of_id").isNull() | (F.col("first_of_id") >= F.col("seq"))
        turn = F.col("own").isNull() | (F.col("first_of_media") == F.col("seq"))
        ready = open_.groupBy("seq").agg(
            F.bool_and(none_before).alias("free_of_others"), F.bool_and(turn).alias("turn"), F.first("doomed").alias("doomed"), F.first("own").alias("own")
        )
        ready = ready.where(F.col("free_of_others") & (F.col("doomed") | F.coalesce("turn", F.lit(False))))
        status = F.when(F.col("doomed"), "duplicate_source").when(F.col("own").isNull(), "inserted").otherwise("updated").alias("status")
        by_turn = ready.select("seq", F.when(~F.col("doomed"), F.coalesce("own", "seq")).alias("media_id"), status)
        status = F.when(F.col("several"), "conflict").otherwise("updated").alias("status")
        at_once = found.where(F.col("several") | F.col("all_owned")).select("seq", F.when(~F.col("several"), F.col("own")).alias("media_id"), status).distinct()
        now = cut(at_once.unionByName(by_turn))
        decided.append(now)
        taken = found.where(free).join(now.where("media_id IS NOT NULL").select("seq", "media_id"), "seq").select("component", *key, F.col("media_id").alias("media"), F.col("seq").alias("by")).distinct()
        before = [t for t in (owners, left, found) if t is not None]
        owners = cut(taken if owners is None else owners.unionByName(taken))
        left = cut(left.join(now, "seq", "left_anti"))
        drop_cuts(*before)
        if left.isEmpty():
            break
    out = reduce(DataFrame.unionByName, decided).select(F.col("seq").cast("long").alias("seq"), "media_id", "status")
    if left.isEmpty():
        return out
    rest = left.select("seq", "component", *key, F.lit(0).alias("pos"), F.lit(None).cast("long").alias("media_id"))
    known = owners.join(left.select("component").distinct(), "component", "left_semi")
    known = known.select(F.lit(-1).cast("long").alias("seq"), "component", *key, F.lit(0).alias("pos"), F.col("media").alias("media_id"))
    return out.unionByName(rest.unionByName(known).groupBy("component").applyInPandas(_replay, _REPLAYED))


def settled(rows: DataFrame) -> DataFrame:
    """``component`` of those where no record can be refused, from ``seq, component, media_kind, source, source_id``.

    There each record but the first has an id that an earlier one has, and each source has one id: then every
    record finds the same media. All of it is minima and sums, which combine before the shuffle.
    """
    key = ["media_kind", "source", "source_id"]
    first = rows.groupBy("component", *key).agg(F.min("seq").alias("first"))
    one_id = first.groupBy("component", "source").agg((F.min("source_id") == F.max("source_id")).alias("one"))
    one_id = one_id.groupBy("component").agg(F.bool_and("one").alias("one"))
    fresh = rows.join(first, ["component", *key]).groupBy("component", "seq").agg(F.min("first").alias("first"))
    fresh = fresh.groupBy("component").agg(F.count_if(F.col("first") == F.col("seq")).alias("starts"))
    return fresh.join(one_id, "component").where("one AND starts = 1").select("component")


def large_components(component: DataFrame, rows: int = 10_000) -> DataFrame:
    """``component, n_rows`` of those with more records than that: an id that stands for nothing, as "unknown", makes such."""
    return component.groupBy("component").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > rows)


def replay(ids: DataFrame, component: DataFrame) -> DataFrame:
    """Records one after another within each component, as if upserted in order of ``seq``.

    A record that bridges two media is a conflict; one that would give a media a second id of a source is
    rejected as well; neither changes what follows. Components can't affect each other. Those that are settled
    need no replay: their media is that of their least record. Of the others small ones are replayed by tasks that have many each, large ones in rounds.
    """
    rows = ids.join(component, "seq").select("seq", "component", "media_kind", "pos", "source", "source_id")
    calm = cut(settled(rows))
    quiet = component.join(rows.select("seq").distinct(), "seq", "left_semi").join(calm, "component")
    status = F.when(F.col("seq") == F.col("component"), "inserted").otherwise("updated")
    quiet = quiet.select(F.col("seq").cast("long").alias("seq"), F.col("component").cast("long").alias("media_id"), status.alias("status"))
    rest = cut(rows.join(calm, "component", "left_anti"))
    large = cut(large_components(rest.select("seq", "component").distinct(), SMALL).select("component"))
    if large.isEmpty():
        return quiet.unionByName(_replayed(rest))
    small = _replayed(rest.join(large, "component", "left_anti"))
    return quiet.unionByName(small).unionByName(in_rounds(rest.join(large, "component", "left_semi")))


def placed(ids: DataFrame, seq: str = "seq") -> DataFrame:
    """``seq, media_id, status`` of records by their ids: what `components` and `replay` give.

    A record whose ids no other record has, one of each source, is a media of its own; only the others are looked at together.
    """
    key = ["media_kind", "source", "source_id"]
    shared = ids.groupBy(*key).agg((F.min(seq) != F.max(seq)).alias("shared")).where("shared").select(*key)
    double = ids.groupBy(seq, "source").agg((F.min("source_id") != F.max("source_id")).alias("double")).where("double").select(seq)
    tied = cut(ids.join(shared, key, "left_semi").select(seq).union(double).distinct())
    one = F.col(seq).cast("long")
    alone = ids.join(tied, seq, "left_anti").select(one.alias("seq"), one.alias("media_id"), F.lit("inserted").alias("status")).distinct()
    if tied.isEmpty():
        return alone
    among = cut(ids.join(tied, seq, "left_semi"))
    return alone.unionByName(replay(among, components(among, seq)))
