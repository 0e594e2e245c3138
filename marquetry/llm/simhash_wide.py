"""Near copies by SimHash with an exact check: fingerprints find pairs of texts, their sets of shingles decide.

Two texts are a link if the Jaccard similarity of their distinct shingles of five words, told apart by 64 bits
of hash, is 0.8 or more. Each set has a SimHash fingerprint, and multi-index hashing, as in `simhash`, finds those at two bits or fewer:
the sets of such texts are compared first. Fingerprints can't tell all pairs of that similarity, so what they leave apart goes on to
a prefix filter, which misses none: all shingles have one order,
those that are common in a sample last, the others by hash, and sets of that similarity share a shingle among the
first fifth of each. How many shingles are left behind a common one bounds the similarity too, and so do sketches of the sets, whose
bits can't differ in more places than the sets: small ones at first, then such that grow with the set. They drop nearly
all other pairs before whole sets are compared.
Within a bucket each text is then held against the one before it and the first one, in a large bucket against some more, unless
fingerprints have connected them, which connects nearly all copies at little cost; then all pairs of a bucket whose texts are still in different components are held
against each other. So the components are those of all pairs of texts, whatever their order.

A bucket with very many rows is cut up by a hash of its members, and the first of each part are then held
against one another in the same way at first; the second round takes all of them.

Rows are told apart by doc_id and a 64-bit hash of the text, so rows that share an id, or have none, are texts of their own.
Defined results: null and wordless texts form one class; of a group that row stays which has the least doc_id, one without an
id only if all are; among rows of that id the one with the least hash of its text; of rows equal in both any one; an
empty table gives an empty result; columns with other names pass through `representatives` untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import drop, small_batches, staged, tidied
from .components import connected_components
from .linededup import as_bytes

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
#: A bucket of HOT * SAMPLE rows or more is hot; it is cut into PARTS. Of every SAMPLE-th text, shingles in OFTEN or more are common.
HOT, SAMPLE, PARTS = 4000, 16, 64
OFTEN, LISTED = 3, 1 << 20
#: Members of a bucket whose pairs are listed before their sketches are looked at.
SMALL = 64
#: How many before it a text of a larger bucket is first held against: a group where every tenth pair is near hangs together by these.
FAR = 16
#: Longs of a small odd sketch; a large one has two bits or more for each shingle.
SKETCH = 16
#: Sets of shingles sent from Python at once.
SETS = 100

_SET = ("d0", "d1")


def _shingles(words: list[bytes], shingle: int) -> list[bytes]:
    return [b" ".join(s) for s in zip(*(words[i:] for i in range(shingle)), strict=False)] if len(words) >= shingle else [b" ".join(words)] if words else []


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of the distinct shingles, in rising order."""
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in _shingles(text.lower().split(), shingle)], np.uint64))


def common_shingles(docs: DataFrame, shingle: int = SHINGLE, sample: int = SAMPLE) -> np.ndarray:
    """Hashes of shingles that many of every ``sample``-th text hold, at most LISTED. They only order shingles: any list gives the same links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in as_bytes(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(t, shingle).view(np.int64))], ["key"])

    some = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(sample)) == 0).select(F.col("text").cast("string"))
    often = some.mapInArrow(tidied(run), "key long").groupBy("key").count().where(F.col("count") >= OFTEN)
    keys = often.orderBy(F.desc("count"), "key").limit(LISTED).select("key").toArrow().column(0).to_numpy()
    return np.sort(keys.astype(np.int64).view(np.uint64))


def prefix_of(hashes: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first of the hashes, common ones last: two sets of that similarity share one of these."""
    late = np.zeros(len(hashes), bool)
    if len(common):
        late = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
    ordered = np.concatenate((hashes[~late], hashes[late]))
    return ordered[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-6) + 1]


def odd_sketch(hashes: np.ndarray, longs: int = SKETCH) -> np.ndarray:
    """A bit is set if an odd number of hashes fall on it: two sketches differ in no more bits than their sets in members."""
    odd = np.bincount((hashes & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def large_sketch(hashes: np.ndarray) -> np.ndarray:
    return odd_sketch(hashes, max(SKETCH, 1 << max(0, (2 * len(hashes) - 1).bit_length() - 6)))


def differing(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two sketches differ; the longer is folded to the other's length, which keeps what they promise."""
    if len(a) < len(b):
        a, b = b, a
    bits = np.bitwise_xor.reduce(a.reshape(-1, len(b)), 0) ^ b
    return int(np.bitwise_count(bits.view(np.uint64)).sum(dtype=np.int64))


def signatures(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, sample: int = SAMPLE) -> DataFrame:
    """``id`` of the row; 128 bits ``d0, d1`` that only equal sets of shingles share; their number ``n``, SimHash ``fp``, ``prefix`` and odd ``sketch``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(common_shingles(docs, shingle, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, sizes, fps, prefixes, sketches = [], [], [], [], []
            for t in as_bytes(b.column(1)):
                hashes = shingle_hashes(t, shingle)
                digests.append(xxhash.xxh128_digest(hashes.tobytes(), SEED))
                sizes.append(len(hashes))
                fps.append(simhash.majority(hashes.astype(">u8").tobytes()))
                sketches.append(odd_sketch(hashes))
                prefixes.append(prefix_of(hashes, shared.value, similarity).view(np.int64))
            d = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            fp = np.frombuffer(b"".join(fps), ">i8").astype(np.int64)
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int64), *prefixes]))
            sketch = pa.ListArray.from_arrays(np.arange(len(sizes) + 1, dtype=np.int32) * SKETCH, np.concatenate([np.zeros(0, np.int64), *sketches]))
            columns = [b.column(0), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(sizes, pa.int64()), pa.array(fp), prefix, sketch]
            yield pa.RecordBatch.from_arrays(columns, ["id", *_SET, "n", "fp", "prefix", "sketch"])

    out = docs.select(row_id(docs).alias("id"), F.col("text").cast("string").alias("text"))
    kind = out.schema["id"].dataType.simpleString()
    return out.mapInArrow(tidied(run), f"id {kind}, d0 long, d1 long, n long, fp long, prefix array<long>, sketch array<long>")


def row_id(docs: DataFrame) -> Column:
    """What tells rows apart, in their order."""
    doc_id = docs["doc_id"].cast("long")
    return F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("tie"))


def alike(classes: DataFrame) -> DataFrame:
    """``node, other`` (the lesser): classes whose fingerprints multi-index hashing links, by the first of each fingerprint."""
    firsts = staged(classes.groupBy("fp").agg(F.min("node").alias("first")), "wide-fingerprints")
    same = classes.select("node", "fp").join(firsts, "fp").where("node <> first").select("node", F.col("first").alias("other"))
    side = lambda fp, first: firsts.select(F.col("fp").alias(fp), F.col("first").alias(first))
    near = simhash.links(firsts.select("fp")).join(side("u", "a"), "u").join(side("v", "b"), "v")
    return same.unionByName(near.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))).distinct()


def still_apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs ``node, other`` that ``roots`` leaves in different components."""
    of = lambda node, root: roots.select(F.col("node").alias(node), F.col("root").alias(root))
    both = pairs.join(of("node", "_a"), "node", "left").join(of("other", "_b"), "other", "left")
    return both.where(F.coalesce("_a", "node") != F.coalesce("_b", "other")).select("node", "other")


def filed(classes: DataFrame) -> DataFrame:
    """``key, node, place, size``: each class under the shingles of its prefix, where another is too, and how many are.

    ``place`` is the number of the class's shingles in the upper 32 bits and the key's place among them in the lower.
    """
    rows = classes.select("node", "n", F.posexplode("prefix").alias("at", "key"))
    rows = rows.select("key", "node", F.shiftleft("n", 32).bitwiseOR(F.col("at").cast("long")).alias("place"))
    return rows.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("size > 1")


def _may(a: str, b: str, similarity: float) -> Column:
    """Whether texts whose first common shingle is at those places can be that similar."""
    n = lambda c: F.shiftright(c, 32)
    left = lambda c: n(c) - F.col(c).bitwiseAND(F.lit((1 << 32) - 1))
    return F.least(left(a), left(b)) >= similarity / (1 + similarity) * (n(a) + n(b)) - 1e-6


def _met(rows: DataFrame, *keys: str) -> DataFrame:
    """Each node of a bucket with the one before it and the first; in a large bucket with FAR before it."""
    order = Window.partitionBy(*keys).orderBy("node")
    me = F.struct("node", "place")
    rows = rows.select("node", "place", "large", F.first(me).over(order).alias("b0"), *[F.lag(me, k).over(order).alias(f"b{k}") for k in range(1, FAR + 1)])
    before = F.array("b0", "b1", *[F.when(F.col("large"), F.col(f"b{k}")) for k in range(2, FAR + 1)])
    rows = rows.select("node", "place", F.explode(before).alias("by")).where("by IS NOT NULL")
    return rows.select("node", "place", F.col("by.node").alias("other"), F.col("by.place").alias("place2")).where("node <> other")


def candidates(buckets: DataFrame, similarity: float = SIMILARITY, hot: int = HOT, sample: int = SAMPLE, parts: int = PARTS, small: int = SMALL) -> DataFrame:
    """``node, other`` (the lesser): neighbours in their buckets."""
    part = F.when(F.col("size") >= hot * sample, F.pmod(F.xxhash64("node", F.lit(1)), F.lit(parts)).cast("int")).otherwise(-1)
    rows = buckets.select("key", "node", "place", part.alias("part"), (F.col("size") > small).alias("large"))
    first = rows.where("part >= 0").groupBy("key", "part").agg(F.min(F.struct("node", "place")).alias("f")).select("key", "f.*", F.lit(False).alias("large"))
    return _met(rows, "key", "part").unionByName(_met(first, "key")).where(_may("place", "place2", similarity)).select("node", "other").distinct()


def _apart(a: str, b: str) -> Column:
    """Bits in which two small sketches differ."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH)), F.lit(0))


def sketched(pairs: DataFrame, classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs ``node, other`` whose sketches don't rule the similarity out; it loses none that has it."""
    side = lambda x, node: classes.select(F.col("node").alias(node), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(x))
    both = pairs.join(side("a", "node"), "node").join(side("b", "other"), "other")
    return both.where(_apart("a", "b") <= (1 - similarity) / (1 + similarity) * (F.col("n_a") + F.col("n_b")) + 1e-6).select("node", "other").distinct()


def sets_of(docs: DataFrame, nodes: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``node, shingles`` (distinct hashes) of the documents that ``nodes`` (``node, id``) names."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SETS):
                part = b.slice(at, SETS)
                sets = [shingle_hashes(t, shingle).view(np.int64) for t in as_bytes(part.column(1))]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, np.concatenate(sets))], ["node", "shingles"])

    # Null ids never meet in a join, so they go as 0, which their own flag tells from an id.
    plain = lambda c: [c["none"].alias("none"), F.coalesce(c["doc_id"], F.lit(0)).alias("of"), c["tie"].alias("tie")]
    texts = docs.select(row_id(docs).alias("id"), F.col("text").cast("string").alias("text")).select(*plain(F.col("id")), "text")
    return texts.join(nodes.select("node", *plain(F.col("id"))), ["none", "of", "tie"]).select("node", "text").mapInArrow(tidied(run), "node long, shingles array<long>")


def sketched_again(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """As `sketched`, by large sketches of the ``sets``."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [large_sketch(x.values.to_numpy(zero_copy_only=False).view(np.uint64)) for x in b.column(1)]
            n = pa.array([len(x) for x in b.column(1)], pa.int64())
            ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), n, pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int64), *own]))], ["node", "n", "sketch"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(2).to_numpy() + b.column(4).to_numpy()
            a, c = ([x.values.to_numpy(zero_copy_only=False) for x in b.column(i)] for i in (3, 5))
            apart = np.array([differing(x, y) for x, y in zip(a, c, strict=True)], np.int64)
            keep = pa.array(apart <= (1 - similarity) / (1 + similarity) * sizes + 1e-6)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["node", "other"])

    large = staged(sets.mapInArrow(tidied(sketch), "node long, n long, sketch array<long>"), "large-sketches")
    side = lambda x, node: large.select(F.col("node").alias(node), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(x))
    both = pairs.join(side("a", "node"), "node").join(side("b", "other"), "other").select("node", "other", "n_a", "a", "n_b", "b")
    out = staged(both.mapInArrow(tidied(near), "node long, other long"), "nearer-candidates")
    drop(large)
    return out


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("node").unionByName(pairs.select(F.col("other").alias("node"))).distinct()


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``u, v``: those of the pairs ``node, other`` whose sets of shingles have that Jaccard similarity."""
    wanted = staged(classes.select("node", "id").join(_ends(pairs), "node"), "wanted-sets")
    sets = staged(sets_of(docs, wanted, shingle), "shingle-sets")
    pairs = sketched_again(pairs, sets, similarity)
    few = sets.join(staged(_ends(pairs), "compared-sets"), "node", "left_semi")
    side = lambda a, node: few.select(F.col("node").alias(node), F.col("shingles").alias(a))
    both = pairs.join(side("a", "node"), "node").join(side("b", "other"), "other")
    common = F.size(F.array_intersect("a", "b"))
    both = both.select("node", "other", common.alias("common"), (F.size("a") + F.size("b")).alias("sizes"))
    near = both.where(F.col("common") >= similarity * (F.col("sizes") - F.col("common")) - 1e-9)
    out = staged(near.select(F.col("node").alias("u"), F.col("other").alias("v")).distinct(), "links")
    drop(sets, wanted, pairs)
    return out


def _pairs_of(rows: DataFrame, similarity: float, *more: str) -> DataFrame:
    """``node, other``: members of a bucket in different components that may be that similar; with ``more`` by their sketches too."""
    side = lambda x: rows.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("root", "node", "place", *more)])
    may = (F.col("node_a") > F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & _may("place_a", "place_b", similarity)
    if more:
        n = F.shiftright("place_a", 32) + F.shiftright("place_b", 32)
        may = may & (_apart("sketch_a", "sketch_b") <= (1 - similarity) / (1 + similarity) * n + 1e-6)
    a, b = side("a").alias("a"), side("b").alias("b")
    return a.join(b, (F.col("a.key") == F.col("b.key")) & may).select(F.col("node_a").alias("node"), F.col("node_b").alias("other"))


def remaining(buckets: DataFrame, roots: DataFrame, done: DataFrame, classes: DataFrame, similarity: float = SIMILARITY, small: int = SMALL) -> DataFrame:
    """``node, other`` (the lesser): all pairs of a bucket that ``roots`` leaves in different components, but those done.

    In a bucket of over ``small`` members sketches decide in the join, so that only pairs that may be near come out of it.
    """
    rows = staged(buckets.join(roots, "node", "left").select("key", "node", "place", "size", F.coalesce("root", "node").alias("root")), "rooted")
    mixed = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    rows = rows.join(staged(mixed, "mixed-buckets"), "key", "left_semi")
    large = rows.where(F.col("size") > small).join(classes.select("node", "sketch"), "node")
    pairs = _pairs_of(rows.where(F.col("size") <= small), similarity).unionByName(_pairs_of(large, similarity, "sketch")).distinct()
    out = staged(pairs.join(done, ["node", "other"], "left_anti"), "other-pairs")
    drop(rows)
    return out


def grouped(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, **hot: int) -> DataFrame:
    """``id, stays`` of each row: what tells it apart, and that of the row that stays for its group."""
    each = staged(signatures(docs, shingle, similarity, hot.get("sample", SAMPLE)), "shingle-prefixes")
    one = each.groupBy(*_SET).agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.first("prefix").alias("prefix"))
    one = staged(one.withColumn("node", F.monotonically_increasing_id()), "shingle-sets-once")  # once written, numbers stand
    ids = staged(each.select("id", *_SET), "row-sets")
    drop(each)
    buckets = staged(filed(one), "buckets")
    classes = staged(one.drop("prefix"), "shingle-classes")
    drop(one)
    alikes = staged(alike(classes), "simhash-candidates")
    first = staged(sketched(alikes, classes, similarity), "simhash-near")
    links = verified(first, docs, classes, shingle, similarity)
    pairs = staged(still_apart(candidates(buckets, similarity, **hot), connected_components(links)).join(alikes, ["node", "other"], "left_anti"), "candidates")
    near = staged(sketched(pairs, classes, similarity), "near-candidates")
    links = links.unionByName(verified(near, docs, classes, shingle, similarity))
    done = alikes.unionByName(pairs)
    others = remaining(buckets, connected_components(links), done, classes, similarity, hot.get("small", SMALL))
    drop(buckets, alikes, first, pairs, near)
    more = staged(sketched(others, classes, similarity), "other-candidates")
    roots = connected_components(links.unionByName(verified(more, docs, classes, shingle, similarity)))
    rooted = staged(classes.join(roots, "node", "left").select(*_SET, "id", F.coalesce("root", "node").alias("root")), "rooted-classes")
    drop(classes, others, more)
    least = staged(rooted.groupBy("root").agg(F.min("id").alias("stays")), "group-least")
    members = staged(rooted.join(least, "root").select(*_SET, "stays"), "wide-members")
    return ids.join(members, list(_SET)).select("id", "stays")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, **hot: int) -> DataFrame:
    """``doc_id, component_id`` of each row; the id is the least doc_id that links reach."""
    return grouped(docs, shingle, similarity, **hot).select("id.doc_id", F.col("stays.doc_id").alias("component_id"))


def representatives(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, **hot: int) -> DataFrame:
    """One row of each group, with all its columns."""
    found = staged(grouped(docs, shingle, similarity, **hot), "groups")
    plain = lambda c: [c["none"].alias("_none"), F.coalesce(c["doc_id"], F.lit(0)).alias("_of"), c["tie"].alias("_tie")]
    lost = staged(found.where(~F.col("id").eqNullSafe(F.col("stays"))).select(*plain(F.col("id"))).distinct(), "lost-rows")
    again = found.where(F.col("id").eqNullSafe(F.col("stays"))).groupBy("id").count().where("count > 1").select(*plain(F.col("id")))
    again = staged(again, "equal-rows")
    key = ["_none", "_of", "_tie"]
    kept = docs.select(row_id(docs).alias("_id"), F.struct(*docs.columns).alias("_row")).select("_row", *plain(F.col("_id"))).join(lost, key, "left_anti")
    if again.isEmpty():
        return kept.select("_row.*")
    once = kept.join(again, key, "left_semi").groupBy(*key).agg(F.first("_row").alias("_row"))
    return kept.join(again, key, "left_anti").select("_row.*").unionByName(once.select("_row.*"))
