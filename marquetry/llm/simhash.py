"""SimHash near-dedup by multi-index hashing.

A fingerprint's 64 bits are cut into segments, and each segment has a table of the fingerprints by its value. Two
fingerprints at RADIUS bits or fewer have a segment where they differ in RADIUS // segments bits at most; better, in one of
the first RADIUS % segments + 1 segments they do, or else in one bit less in another (Norouzi, Punjani and Fleet, 2012). So a
fingerprint enumerates that Hamming ball in each segment and fetches the table's matches, and the complete distance
decides each pair. Of two values only the one with the higher differing bit set asks for the other.

Near copies share segments, so a bucket of a table can grow with the data. Fingerprints of buckets with over HOT members are
linked another way, which is exact too: each is filed under itself and the 64 fingerprints one bit away. Two at
two bits or fewer meet under the one between them, a key holds at most 65 fingerprints, any two of which are linked, and so a
chain through each key does for all its pairs.

Defined results: null and wordless texts have fingerprint zero and link like any other; rows with equal
fingerprints form one class, whatever their ids; a null doc_id is never a component's id unless there is no other; an empty
table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, staged, tidied
from .components import connected_components
from .linededup import as_bytes

SHINGLE = 3
SEED = 42
RADIUS = 2
SEGMENTS = 2
#: Members of a bucket that are all held against those who ask for it.
HOT = 100
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> bytes:
    """Eight bytes, highest bit first: a bit is set if over half of the shingles' XXH64 have it.

    bytes.lower knows A-Z only and bytes.split the six blanks only.
    """
    words = text.lower().split()
    if not words:
        return bytes(8)
    if len(words) < shingle:
        return xxhash.xxh64_digest(b" ".join(words), SEED)
    return majority(b"".join(xxhash.xxh64_digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)), strict=False)))


def majority(hashes: bytes) -> bytes:
    """The bits that over half of the hashes, of eight bytes each, have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8 * BLOCK):
        ones += np.unpackbits(np.frombuffer(hashes[at : at + 8 * BLOCK], np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return np.packbits(16 * ones > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (a signed long) of each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, shingle) for t in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.frombuffer(b"".join(fps), ">i8").astype(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def balls(segments: int = SEGMENTS, radius: int = RADIUS) -> list[tuple[int, list[int]]]:
    """For each segment that is searched, its bits as a mask, and the sets of up to its radius of them as masks."""
    edge = [64 * i // segments for i in range(segments + 1)]
    out = []
    for s, (low, high) in enumerate(zip(edge, edge[1:], strict=False)):
        own = radius // segments - (s > radius % segments)
        flips = [sum(1 << bit for bit in c) for k in range(own + 1) for c in combinations(range(low, high), k)]
        if own >= 0:
            out.append((sum(1 << bit for bit in range(low, high)), flips))
    return out


def probes(fps: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """``fp, segment, key, flipped``: the values that each fingerprint asks for; its own, unflipped, is where it lies in the table."""
    rows = []
    for s, (mask, flips) in enumerate(balls(segments)):
        own = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        for flip in flips:
            top = F.lit(_signed(1 << (flip.bit_length() - 1))) if flip else F.lit(0).cast("long")
            asked = F.struct(F.lit(s).cast("byte").alias("segment"), own.bitwiseXOR(F.lit(_signed(flip))).alias("key"), F.lit(flip > 0).alias("flipped"))
            rows.append(asked if not flip else F.when(own.bitwiseAND(top) != 0, asked))
    asked = fps.select("fp", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("p"))
    return asked.select("fp", "p.*")


def _apart() -> Column:
    return F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))


def candidates(met: DataFrame, hot: int = HOT) -> DataFrame:
    """``fp, other``: pairs that meet in buckets of ``hot`` members or fewer; their distances are open."""
    table = met.where(~F.col("flipped") & (F.col("n") <= hot)).select("segment", "key", F.col("fp").alias("other"))
    asking = met.where(F.col("n") <= hot).select("segment", "key", "fp", "flipped")
    return asking.join(table, ["segment", "key"]).where(F.col("flipped") | (F.col("other") < F.col("fp"))).select("fp", "other")


def neighbours(fps: DataFrame) -> DataFrame:
    """``fp, other``: chains through the keys of whole fingerprints that a bit or none is flipped in."""
    flips = F.array(*[F.lit(_signed(m)).cast("long") for m in [0, *(1 << bit for bit in range(64))]])
    filed = fps.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("key"))
    before = F.lag("fp").over(Window.partitionBy("key").orderBy("fp"))
    return filed.select("fp", before.alias("other")).where(F.col("other").isNotNull())


def links(fps: DataFrame, segments: int = SEGMENTS, hot: int = HOT) -> DataFrame:
    """Edges ``u, v`` between distinct fingerprints at RADIUS bits or fewer; they connect all that such pairs connect."""
    asked = probes(fps, segments)
    sizes = asked.where(~F.col("flipped")).groupBy("segment", "key").agg(F.count(F.lit(1)).alias("n"))
    # A bucket of one that nobody else asks for is met by its own fingerprint only.
    met = staged(asked.join(sizes, ["segment", "key"]).select("fp", "segment", "key", "flipped", "n"), "simhash-met")
    pairs = candidates(met, hot)
    crowded = met.where(F.col("n") > hot).select("fp").distinct()
    near = pairs.where(_apart() <= RADIUS).unionByName(neighbours(crowded).where(_apart() <= RADIUS))
    return near.select(F.col("fp").alias("u"), F.col("other").alias("v"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, component_id`` of each row; the id is the least doc_id that links reach."""
    each = staged(fingerprints(docs, shingle), "simhash")
    classes = staged(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    roots = connected_components(links(classes))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = staged(rooted.select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = staged(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least")
    members = staged(rooted.join(least, "root").select("fp", "component_id"), "simhash-members")
    return each.join(members, "fp").select("doc_id", "fp", "component_id")
