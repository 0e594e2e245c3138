"""A stored search index in blocks, and ranked search that skips the blocks that can't matter.

A block holds the rows of near ids and of about one length, so that rows which one term scores alike lie together. The directory has
for each token and block its greatest number of occurrences by length. A search sums these to bounds of whole blocks, ranks the
rows of the most promising ones, and then reads of the others only those whose bound reaches the last place of the page. How
many rows a term or prefix occurs in, and how long rows are, is kept as sums of rows that each batch adds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquetry.functions.scalars import word_text
from marquetry.operators.search import B, FIELDS, K1, LEAST_IDF, SearchOptions, batched, counted_runs, filtered, index_rows, matches, page, query_terms, runs_of, token_counts, words_of

#: Ids of a block lie in a range of 2^SPAN, and lengths within a fourth root of two.
SPAN, TIERS = 10, 4
_ROOM = 1 << 44
#: Bytes of text of the rows that are packed together, if they are several; a token counts as eight.
PACKED = 8 << 20
#: Terms of up to so many characters are counted by prefix; longer ones are counted when they are asked for.
PREFIX = 12
#: Blocks that are read first; where rows are filtered, so many for each wanted row if that is more.
FIRST, FIRST_OF = 16, 4


@dataclass(frozen=True)
class Index:
    """``postings`` (token, key, tf, dl, block), ``rows`` (key, kind, format, dl), ``directory`` (token, block, ratio, avg, n), ``terms`` (term, n), ``totals`` (n, tokens)."""

    postings: DataFrame
    rows: DataFrame
    directory: DataFrame
    terms: DataFrame
    totals: DataFrame
    key: str = "media_id"

    def map(self, change) -> Index:
        """``change`` of each table, by its name."""
        return Index(*[change(f.name, getattr(self, f.name)) for f in fields(self)[:-1]], self.key)


def block_of(key: Column, dl: Column) -> Column:
    tier = F.floor(F.log2(dl + F.lit(1.0)) * TIERS).cast("long")
    return tier * F.lit(_ROOM) + F.pmod(F.shiftright(key.cast("long"), SPAN), F.lit(_ROOM))


def impact(tf: Column, dl: Column, avg: Column) -> Column:
    """What a term adds to a score, but for its rarity."""
    tf = tf.cast("double")
    return (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / avg))


def ratio(tf: Column, dl: Column, avg: Column) -> Column:
    """Occurrences by length. Those of the tokens of a prefix add up, and an impact is (K1 + 1) r / (r + 1)."""
    return tf.cast("double") / (K1 * (1 - B + B * dl / avg))


def tokenised(media: DataFrame, key: str = "media_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``key, media_kind, format, _tokens, _dl``: what an index is made of, to be written once."""
    return index_rows(media, key, fields).select(key, "media_kind", "format", "_tokens", F.size("_tokens").alias("_dl"))


def dealt(media: DataFrame, key: str = "media_id") -> DataFrame:
    """Rows in order of ids, with all of a range of 2^SPAN in one task: rows of a block then lie near one another."""
    return media.repartition(F.shiftright(F.col(key).cast("long"), SPAN)).sortWithinPartitions(key)


def worded(media: DataFrame, key: str = "media_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``key, media_kind, format, _text``: texts that `packed` cuts into the tokens that `tokenised` has."""
    return media.select(key, "media_kind", "format", F.concat_ws(" ", *[word_text(F.array_join(f, " ") if media.schema[f].dataType.typeName() == "array" else F.col(f)) for f in fields]).alias("_text"))


def _length(rows: DataFrame) -> Column:
    return F.col("_dl") if "_dl" in rows.columns else F.size("_tokens")


def _sorted(row: np.ndarray, token: np.ndarray, tf: np.ndarray, tokens: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StringArray]:
    """What `runs_of` gives, with the tokens in order."""
    order = pc.array_sort_indices(tokens)
    rank = np.empty(len(tokens), np.int64)
    rank[order.to_numpy()] = np.arange(len(tokens))
    return row, rank[token], tf, tokens.take(order)


def _prefixes(row: np.ndarray, token: np.ndarray, tokens: pa.StringArray) -> Iterator[tuple[pa.StringArray, np.ndarray]]:
    """Prefixes of each length, and in how many rows each occurs; of runs of tokens that are in order."""
    # In order of rows and tokens equal prefixes are neighbours, so nothing is sorted for each length.
    each = np.sort(row * max(len(tokens), 1) + token)
    row, token = each // max(len(tokens), 1), each % max(len(tokens), 1)
    lengths = pc.utf8_length(tokens).to_numpy(zero_copy_only=False)
    for size in range(1, PREFIX + 1):
        has = lengths == 1 if size == 1 else lengths >= size
        if not has.any():
            continue
        terms = pc.utf8_slice_codeunits(tokens.filter(pa.array(has)), 0, size)
        first = np.ones(len(terms), bool)
        first[1:] = pc.not_equal(terms[1:], terms[:-1]).to_numpy(zero_copy_only=False)
        place = np.zeros(len(tokens), np.int64)
        place[has] = np.cumsum(first) - 1
        at = has[token]
        own, term = row[at], place[token[at]]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (term[1:] != term[:-1])
        yield terms.filter(pa.array(first)), np.bincount(term[new], minlength=int(first.sum())).astype(np.int64)


def counted(rows: DataFrame) -> DataFrame:
    """``term, n``: rows that each prefix occurs in, or token of one character; a batch of rows is counted before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, token, _, tokens = _sorted(*runs_of(b.column(0)))
            for terms, n in _prefixes(row, token, tokens):
                yield pa.RecordBatch.from_arrays([terms, pa.array(n)], ["term", "n"])

    if "terms" in rows.columns:
        each = rows.select(F.inline(F.arrays_zip("terms", "n"))).toDF("term", "n")
    else:
        each = batched(rows).select("_tokens").mapInArrow(run, "term string, n long")
    return each.groupBy("term").agg(F.sum("n").alias("n"))


def packed(rows: DataFrame, key: str = "media_id") -> DataFrame:
    """`worded` or `tokenised` rows as they are counted: a row for each batch of them, to be written once and read for each table of the index.

    ``rows`` has keys, kinds, formats and lengths, ``tokens`` the distinct tokens in order. Of each token in each row ``row`` and ``token``
    are the places in these, and ``tf`` says how often it occurs. ``terms`` and ``n`` are what `counted` adds up.
    """
    kind, text = rows.schema[key].dataType.simpleString(), "_text" if "_text" in rows.columns else "_tokens"

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        if text == "_text":
            row, found = words_of(b.column(3).to_pylist())
            sizes = np.bincount(row, minlength=b.num_rows)
        else:
            sizes, found = pc.list_value_length(b.column(3)).fill_null(0).to_numpy(zero_copy_only=False), b.column(3).flatten()
            row = np.repeat(np.arange(b.num_rows), sizes)
        row, token, tf, tokens = _sorted(*counted_runs(row, found))
        terms, n = zip(*_prefixes(row, token, tokens)) if len(row) else ((), ())
        own = pa.StructArray.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sizes.astype(np.int32))], [key, "media_kind", "format", "dl"])
        parts = [own, tokens, *[pa.array(x.astype(np.int32)) for x in (row, token, tf)], pa.concat_arrays(terms) if terms else pa.array([], pa.string()), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64))]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in parts], ["rows", "tokens", "row", "token", "tf", "terms", "n"])

    def sizes_of(b: pa.RecordBatch) -> np.ndarray:
        sizes = pc.binary_length(b.column(3)) if text == "_text" else pc.multiply(pc.list_value_length(b.column(3)), 8)
        return sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)

    def pieces(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pa.Table.from_batches(held).combine_chunks().to_batches():
            piece = np.cumsum(sizes_of(b)) // PACKED
            starts = [0, *(np.flatnonzero(np.diff(piece)) + 1), b.num_rows]
            yield from (one(b.slice(low, high - low)) for low, high in zip(starts, starts[1:]) if low < high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += int(sizes_of(b).sum())
            if size >= PACKED:
                yield from pieces(held)
                held, size = [], 0
        if held:
            yield from pieces(held)

    schema = f"rows array<struct<`{key}`: {kind}, media_kind: string, format: string, dl: int>>, tokens array<string>, row array<int>, token array<int>, tf array<int>, terms array<string>, n array<long>"
    return batched(rows).select(key, "media_kind", "format", text).mapInArrow(run, schema)


def _in_place(postings: DataFrame) -> DataFrame:
    """The directory of postings that lie in order of token and block, without a shuffle.

    A block that is read by two tasks, or in two batches, has several rows, of which the greatest counts, as with those of several writes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            token, block = b.column(0).dictionary_encode().indices.to_numpy(), b.column(1).to_numpy()
            new = np.ones(b.num_rows, bool)
            new[1:] = (token[1:] != token[:-1]) | (block[1:] != block[:-1])
            at = np.flatnonzero(new)
            first = b.take(pa.array(at))
            most = np.maximum.reduceat(b.column(2).to_numpy(), at) if len(at) else np.zeros(0)
            n = np.diff(np.append(at, b.num_rows)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([first.column(0), first.column(1), pa.array(most), first.column(3), pa.array(n)], ["token", "block", "ratio", "avg", "n"])

    rows = postings.select("token", "block", ratio(F.col("tf"), F.col("dl"), F.col("avg")).alias("ratio"), "avg")
    return batched(rows).mapInArrow(run, "token string, block long, ratio double, avg double, n long")


def _where_read(rows: DataFrame, avg: Column, key: str) -> tuple[DataFrame, DataFrame]:
    """Postings and directory of `packed` rows, each made of a batch of them at once, in order of token and block, without a shuffle.

    A block that several batches have has several rows in the directory, of which the greatest counts, as with those of several writes. Writing
    postings in order is quick, as it has but batches to merge.
    """

    def in_order(b: pa.RecordBatch) -> Iterator[tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]]:
        for i in range(b.num_rows):
            of = lambda name: b.column(name)[i].values  # noqa: B023,E731
            row, token = of("row").to_numpy(), of("token").to_numpy()
            block = of("block").to_numpy()[row]
            at = np.lexsort((block, token))
            yield of("tokens"), row[at], token[at], of("tf").to_numpy()[at], block[at], of("key"), of("dl")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tokens, row, token, tf, block, keys, dl in in_order(b):
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays([tokens.take(pa.array(token)), keys.take(of), pa.array(tf.astype(np.int64)), dl.take(of), pa.array(block)], ["token", key, "tf", "dl", "block"])

    def greatest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            avg = b.column("avg")[0].as_py() if b.num_rows else 1.0
            for tokens, row, token, tf, block, _, dl in in_order(b):
                new = np.ones(len(row), bool)
                new[1:] = (token[1:] != token[:-1]) | (block[1:] != block[:-1])
                at = np.flatnonzero(new)
                by = K1 * (1 - B + B * dl.to_numpy() / avg)
                most = np.maximum.reduceat(tf / by[row], at) if len(at) else np.zeros(0)
                n = np.diff(np.append(at, len(row))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([tokens.take(pa.array(token[at])), pa.array(block[at]), pa.array(most), pa.array(np.full(len(at), avg)), pa.array(n)], ["token", "block", "ratio", "avg", "n"])

    kind = rows.schema["rows"].dataType.elementType[key].dataType.simpleString()
    each = rows.select("tokens", "row", "token", "tf", F.transform("rows", lambda r: block_of(r[key], r["dl"])).alias("block"), F.col(f"rows.{key}").alias("key"), F.col("rows.dl").alias("dl"))
    return (
        each.mapInArrow(listed, f"token string, `{key}` {kind}, tf long, dl int, block long"),
        each.withColumn("avg", avg).mapInArrow(greatest, "token string, block long, ratio double, avg double, n long"),
    )


def build(rows: DataFrame, key: str = "media_id", stored: Callable[[DataFrame], DataFrame] | None = None, near: bool = False) -> Index:
    """The index of `tokenised` rows, which are read several times.

    ``stored`` may write the postings in order of token and block and read them again: then the directory is made of them as they lie.
    ``near`` says that rows have keys of their own and lie as `dealt` puts them: then both are made where they are read. Such rows may be `packed`.
    """
    if near:
        lists = rows if "terms" in rows.columns else packed(rows, key)
        rows = lists.select(F.inline("rows")).withColumnRenamed("dl", "_dl")
    dl = _length(rows)
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(dl), F.lit(0)).cast("long").alias("tokens"))
    avg = totals.select(F.greatest(F.col("tokens") / F.greatest("n", F.lit(1)), F.lit(1.0))).scalar()
    if near:
        postings, directory = _where_read(lists, avg, key)
    else:
        postings = token_counts(rows, key).withColumn("block", block_of(F.col(key), F.col("dl")))
        postings = stored(postings) if stored else postings
    if stored and not near:
        directory = _in_place(postings.withColumn("avg", avg))
    elif not near:
        directory = postings.withColumn("avg", avg).groupBy("token", "block").agg(F.max(ratio(F.col("tf"), F.col("dl"), F.col("avg"))).alias("ratio"), F.first("avg").alias("avg"), F.count(F.lit(1)).alias("n"))
    return Index(postings, rows.select(key, "media_kind", "format", dl.alias("dl")), directory, counted(lists if near else rows), totals, key)


def _near(terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | ((F.col("token") >= t) & (F.col("token") < t + "\U0010ffff") if len(t) > 1 else F.col("token") == t)
    return out


def _statistics(index: Index, terms: list[str]) -> tuple[float, float, list[int]]:
    """How many rows there are, their mean length, and in how many each term occurs: a few numbers."""
    own = index.totals.agg(F.sum("n"), F.sum("tokens")).first()
    n, tokens = own[0] or 0, own[1] or 0
    found = {r["term"]: r["n"] for r in index.terms.where(F.col("term").isin(terms)).groupBy("term").agg(F.sum("n").alias("n")).collect()}
    for t in terms:
        if len(t) > PREFIX:
            found[t] = index.postings.where(_near([t])).agg(F.countDistinct(index.key)).first()[0]
    return n, tokens / n if n else 1.0, [found.get(t, 0) for t in terms]


def _rarity(n: float, found: int) -> float:
    idf = math.log((n - found + 0.5) / (found + 0.5))
    return idf if idf > 0 else LEAST_IDF


def bounds(index: Index, terms: list[str], avg: float, rarity: list[float]) -> DataFrame:
    """``block, bound`` of the blocks that have all terms: no row of a block scores higher.

    Ratios of the tokens of a prefix add up; where rows have grown since a directory was written, ratios have grown by as
    much at most.
    """
    now = F.col("ratio") * F.greatest(F.lit(1.0), F.lit(avg) / F.col("avg"))
    each = index.directory.where(_near(terms)).groupBy("token", "block").agg(F.max(now).alias("ratio"))
    sums = [F.sum(F.when(matches(F.col("token"), t), F.col("ratio"))).alias(f"_r{i}") for i, t in enumerate(terms)]
    blocks = each.groupBy("block").agg(*sums).where(" AND ".join(f"_r{i} > 0" for i in range(len(terms))))
    bound = F.lit(0.0)
    for i, r in enumerate(rarity):
        bound = bound + F.lit(r) * (K1 + 1) * F.col(f"_r{i}") / (F.col(f"_r{i}") + 1)
    return blocks.select("block", bound.alias("bound"))


def _ranked(index: Index, terms: list[str], avg: float, rarity: list[float], blocks: list[int] | DataFrame) -> DataFrame:
    rows = index.postings.where(_near(terms))
    rows = rows.join(blocks.select("block"), "block", "left_semi") if isinstance(blocks, DataFrame) else rows.where(F.col("block").isin(blocks))
    tf = [F.sum(F.when(matches(F.col("token"), t), F.col("tf")).otherwise(0)).alias(f"_tf{i}") for i, t in enumerate(terms)]
    hits = rows.groupBy(index.key).agg(F.first("dl").alias("_dl"), *tf).where(" AND ".join(f"_tf{i} > 0" for i in range(len(terms))))
    score = F.lit(0.0)
    for i, r in enumerate(rarity):
        score = score + F.lit(r) * impact(F.col(f"_tf{i}"), F.col("_dl"), F.lit(avg))
    return hits.select(index.key, score.alias("score"))


def _passing(index: Index, options: SearchOptions) -> DataFrame:
    """``block`` of those with a row that passes the filters; a key's rows may be of several lengths, so all of its blocks."""
    passes = filtered(index.rows.select(index.key, "media_kind", "format"), options).select(index.key).distinct()
    return index.rows.join(passes, index.key, "left_semi").select(block_of(F.col(index.key), F.col("dl")).alias("block")).distinct()


def search(index: Index, query: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    """``key, media_kind, score`` of the page of the best rows that have all terms and pass the filters."""
    terms = query_terms(query)
    n, avg, found = _statistics(index, terms)
    rarity = [_rarity(n, f) for f in found]
    kinds = index.rows.select(index.key, "media_kind", "format")
    wanted = max(options.offset, 0) + max(options.limit, 1)
    if not all(found):
        return kinds.limit(0).select(index.key, "media_kind", F.lit(0.0).alias("score"))
    blocks, n_first = bounds(index, terms, avg, rarity), FIRST
    if options.media_kind is not None or options.format is not None:
        blocks, n_first = blocks.join(_passing(index, options), "block", "left_semi"), max(FIRST, FIRST_OF * wanted)
    first = [r[0] for r in blocks.orderBy(F.desc("bound"), "block").limit(n_first).collect()]
    top = filtered(_ranked(index, terms, avg, rarity, first).join(kinds, index.key), options)
    last = top.orderBy(F.desc("score"), index.key).offset(wanted - 1).limit(1).select("score").first()
    more = blocks.where(~F.col("block").isin(first))
    # A hair below, as bounds and scores are added in different orders.
    more = more.where(F.col("bound") >= last[0] * (1 - 1e-9)) if last else more
    rest = filtered(_ranked(index, terms, avg, rarity, more).join(kinds, index.key), options)
    return page(top.unionByName(rest), options, index.key).select(index.key, "media_kind", "score")
