"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and bucket of a document's hash; where the running sum of a source crosses
its budget lies the boundary bucket, and only that bucket is split again, three times in all. What is
left is one threshold for each source, so the final filter compares a hash and nothing is sorted by it.

Defined results: a null text has size 0; a null source is a source of its own, last in order; rows that
share an id share a hash and so a fate, and rows without one share that of the empty text; sources without words get
a target of 0; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged

#: Weights go round by rank of the source; all of them share SHARE times all sizes; none may exceed CAP times its own.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
#: Bits of each level of buckets, and levels.
BITS, LEVELS = 12, 3
#: Sources that one task puts in order.
FEW = 10_000


def mix_hash(doc_id: Column) -> Column:
    """The first 36 bits of the id's MD5."""
    hexed = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, BITS * LEVELS // 4)
    return F.conv(hexed, 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """A row for each source: its size, target, whole passes over it, and the rest of its budget.

    The excess over a cap is shared again by weight until no source is above: with sources in order of
    cap over weight, those filled form a prefix, so running sums give the level at once.
    """
    per = staged(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    ranked, _ = _in_order(per, [F.col("source").asc_nulls_last()], {"rank": F.lit(1).cast("long")}, "mix-ranks")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", "rank", weight.alias("w"), (F.col("source_size") * F.lit(CAP)).alias("cap"))
    sums = {"caps": F.col("cap"), "weights": F.col("w"), "words": F.col("source_size").cast("double")}
    run, total = _in_order(ranked, [F.col("cap") / F.col("w"), F.col("rank")], sums, "mix-caps")
    left = F.lit(total["words"]) * F.lit(SHARE) - F.col("caps")
    run = run.select("*", (left / (F.lit(total["weights"]) - F.col("weights"))).alias("level"))
    run = run.select("source", "source_size", "cap", "w", "level", (F.col("level") * F.col("w") >= F.col("cap")).alias("full"))
    level = run.agg(F.max(F.when(~F.col("full"), F.col("level")))).first()[0]
    return run.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.lit(level).cast("double") * F.col("w")).alias("target"))


def _in_order(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> tuple[DataFrame, dict[str, float]]:
    """``df`` with each sum over the rows before, and the sums of all.

    Up to FEW rows are summed by one task. More are sorted over the cluster by ranges; only the sums of whole ranges, one row a partition,
    meet in one task then. Sums are of whole numbers or in the same order, so both ways agree.
    """
    if df.limit(FEW + 1).count() <= FEW:
        ahead = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        total = df.agg(*[F.sum(c).alias(k) for k, c in sums.items()]).first().asDict()
        return df.select("*", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(k) for k, c in sums.items()]), {k: v or 0.0 for k, v in total.items()}
    parts = staged(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)
    each = parts.groupBy("part").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = each.select(F.col("part").alias("of"), *[F.sum(k).over(before).alias(f"ahead_{k}") for k in sums])
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.select("*", *[F.sum(c).over(own).alias(f"own_{k}") for k, c in sums.items()]).join(ahead, F.col("part") == F.col("of"))
    zero = F.lit(0)
    out = out.select(*df.columns, *[(F.coalesce(f"own_{k}", zero) + F.coalesce(f"ahead_{k}", zero)).alias(k) for k in sums])
    return out, {k: v or 0.0 for k, v in each.agg(*[F.sum(k).alias(k) for k in sums]).first().asDict().items()}


def thresholds(sizes: DataFrame, aims: DataFrame) -> DataFrame:
    """Adds to each source its ``passes`` and ``threshold``: documents below it are taken once more."""
    share = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    state = aims.select("source", "source_size", "target", F.floor(share).alias("passes"))
    budget = F.col("target") - F.col("passes") * F.col("source_size")
    state = state.select("*", budget.alias("budget"), F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        down = BITS * (LEVELS - 1 - level)
        st = staged(state, "mix-level")
        parts = sizes.alias("d").join(st.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.shiftright("bits", down + BITS) == F.col("prefix")))
        sums = parts.groupBy("s.source", "s.budget", F.shiftright("bits", down).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        over = sums.withColumn("upto", upto).where(F.col("upto") > F.col("budget"))
        edge = over.groupBy("source").agg(F.min(F.struct("bucket", "words", "upto")).alias("edge"))
        joined = st.alias("s").join(edge.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")), "left")
        spent = F.coalesce(F.col("edge.upto") - F.col("edge.words"), F.lit(0))
        prefix, words = F.coalesce(F.col("edge.bucket"), F.lit(-1).cast("long")), F.coalesce(F.col("edge.words"), F.lit(0))
        state = joined.select("s.source", "source_size", "target", "passes", (F.col("budget") - spent).alias("budget"), prefix.alias("prefix"), words.alias("words"))
    nearer = F.when((F.col("prefix") >= 0) & (F.col("words") - F.col("budget") < F.col("budget")), 1).otherwise(0)
    return state.select("source", "source_size", "target", "passes", (F.col("prefix") + nearer).alias("threshold"))


def budgets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Narrow rows ``doc_id, source, size, bits``, and a row for each source with its target and threshold, both staged."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = staged(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), mix_hash(F.col(id_col)).alias("bits")), "mix-sizes")
    return sizes, staged(thresholds(sizes, targets(sizes)), "mix-thresholds")


def copies() -> Column:
    """How often a row is taken, by its ``bits`` and its source's threshold."""
    return (F.col("passes") + F.when(F.col("bits") < F.col("threshold"), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of each row."""
    sizes, cut = budgets(docs, id_col, text_col, source_col)
    out = sizes.alias("d").join(cut.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    return out.select("doc_id", "d.source", "size", "source_size", "target", copies().alias("copies"), (F.col("size") * copies()).cast("long").alias("taken"))


def take(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``copies``; texts meet the sources' thresholds and aren't shuffled by id."""
    _, cut = budgets(docs)
    cut = cut.select(F.col("source").alias("of"), "passes", "threshold")
    out = docs.withColumn("bits", mix_hash(F.col("doc_id"))).join(cut, F.col("source").eqNullSafe(F.col("of")))
    return out.select(*docs.columns, copies().alias("copies")).where(F.col("copies") > 0)
