"""Ranked text search: BM25 over title, aliases and synopsis; every term must occur, longer ones as prefixes."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquetry.functions.scalars import fold_text, folding, lower_ascii, tokens, upper_ascii
from marquetry.store import cut

# Fixed values of the ranking.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
FIELDS = ("title_display", "aliases", "synopsis")
#: Rows whose tokens are counted at once; Spark bounds their bytes.
BATCH = 1000
#: Of texts in these characters a task tells words and folds letters as `tokens` does; scripts beyond them are left to Spark's expressions.
_PLAIN = (*range(0x250), *range(0x2000, 0x2070))


class EmptyQuery(ValueError):
    """A query without a letter or digit."""


@dataclass(frozen=True)
class SearchOptions:
    limit: int = 20
    offset: int = 0
    media_kind: str | None = None
    format: str | None = None


def query_terms(query: str) -> list[str]:
    """Folded terms of a query, each once."""
    out = list(dict.fromkeys(t for t in re.split(r"[\W_]+", fold_text(query)) if t))
    if not out:
        raise EmptyQuery("the query has no term")
    return out


def match_expression(query: str) -> str:
    """The query as text: terms that are longer than a character match as prefixes, and all must match."""
    return " ".join(t + "*" if len(t) > 1 else t for t in query_terms(query))


def matches(token: Column, term: str) -> Column:
    return token.startswith(term) if len(term) > 1 else token == term


def index_rows(media: DataFrame, key: str = "media_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Each row's tokens over all fields; a list of aliases is joined by blanks."""
    parts = []
    for f in fields:
        is_list = media.schema[f].dataType.typeName() == "array"
        parts.append(tokens(F.array_join(f, " ") if is_list else F.col(f)))
    return media.select("*", F.concat(*parts).alias("_tokens"))


def ranked(media: DataFrame, query: str, key: str = "media_id", fields: tuple[str, ...] = FIELDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns to keep, and ``score`` of the rows that have all terms; higher is better.

    Statistics are those of the whole table whatever is filtered later. Texts are cut into tokens once: what is counted
    in each row is written, and both the sums and the scores are read from that.
    """
    terms = query_terms(query)
    count = lambda t: F.size(F.filter("_tokens", lambda x: matches(x, t)))
    rows = index_rows(media, key, fields).select(key, *keep, F.size("_tokens").alias("_dl"), *[count(t).alias(f"_tf{i}") for i, t in enumerate(terms)])
    rows = cut(rows)
    sums = [F.count_if(F.col(f"_tf{i}") > 0).alias(f"n{i}") for i in range(len(terms))]
    stats = rows.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("_dl").alias("avg"), *sums).alias("s"))
    found = rows.where(" AND ".join(f"_tf{i} > 0" for i in range(len(terms)))).withColumn("_s", stats.scalar())
    return found.select(key, *keep, score_of(len(terms)).alias("score"))


def bm25(media: DataFrame, query: str, key: str = "media_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Rows that have all terms, with ``score``."""
    return media.join(ranked(media, query, key, fields), key).select(*media.columns, "score")


def score_of(n_terms: int) -> Column:
    total = F.lit(0.0)
    for i in range(n_terms):
        n = F.col(f"_s.n{i}").cast("double")
        idf = F.log((F.col("_s.n") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        tf = F.col(f"_tf{i}").cast("double")
        total = total + idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("_dl") / F.col("_s.avg")))
    return total


def runs_of(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StringArray]:
    """Of a batch of lists: the row, the place of the token among the distinct ones, and the count of each token of each row; and those tokens."""
    return counted_runs(np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten())


def counted_runs(row: np.ndarray, tokens: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StringArray]:
    """The same of all tokens one after another and the row of each."""
    found = tokens.dictionary_encode()
    many = max(len(found.dictionary), 1)
    each, tf = np.unique(row * many + found.indices.to_numpy(), return_counts=True)
    return each // many, each % many, tf, found.dictionary


@cache
def _plain() -> dict[int, str | None]:
    """What plain characters become: a letter or digit its fold, a blank what stands between words."""
    table, marks = folding()
    out: dict[int, str | None] = {}
    for code in _PLAIN:
        to = table.get(chr(code), chr(code))
        out[code] = None if to in marks else to if unicodedata.category(to)[0] in "LN" else " "
    return out


def words_of(texts: list[str]) -> tuple[np.ndarray, pa.StringArray]:
    """The row of each word of these `word_text`s, and all words one after another."""
    table = _plain()
    data = np.frombuffer("".join(t.translate(table) + "\n" for t in texts).encode(), np.uint8)
    word = data > 0x20
    edge = np.diff(word.view(np.int8), prepend=np.int8(0))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(stops - starts, out=offsets[1:])
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[word]))
    return np.searchsorted(np.flatnonzero(data == 0x0A), starts), found


def batched(rows: DataFrame) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    return rows


def token_counts(rows: DataFrame, key: str = "media_id") -> DataFrame:
    """``token, key, tf, dl`` of rows with ``_tokens``; rows that share a key count together, and ``dl`` is that of one of them.

    A row's tokens are counted where the row is read, so nothing is shuffled but the tokens of rows that share a key.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, token, tf, tokens_ = runs_of(b.column(1))
            sizes = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int32)
            yield pa.RecordBatch.from_arrays([tokens_.take(pa.array(token)), b.column(0).take(pa.array(row)), pa.array(tf.astype(np.int64)), pa.array(sizes[row])], ["token", key, "tf", "dl"])

    each = lambda r: batched(r).select(key, "_tokens").mapInArrow(run, f"token string, `{key}` {kind}, tf long, dl int")
    again = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(key).alias("_key"))
    if again.isEmpty():
        return each(rows)
    marked = rows.join(again, rows[key].eqNullSafe(again["_key"]), "left_anti"), rows.join(again, rows[key].eqNullSafe(again["_key"]), "left_semi")
    together = each(marked[1]).groupBy("token", key).agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
    return each(marked[0]).unionByName(together)


def postings(media: DataFrame, key: str = "media_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``token, key, tf, dl``: an index to be stored in order of tokens, where a term's range prunes files."""
    return token_counts(index_rows(media, key, fields).select(key, "_tokens"), key)


def postings_stats(media: DataFrame, key: str = "media_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    return index_rows(media, key, fields).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("_tokens")).alias("avg"))


def bm25_from_postings(index: DataFrame, stats: DataFrame, query: str, key: str = "media_id") -> DataFrame:
    """``key, score`` from a stored index: only the tokens in the terms' ranges are read."""
    terms = query_terms(query)
    ranges = [(F.col("token") >= t) & (F.col("token") < t + "\U0010ffff") if len(t) > 1 else F.col("token") == t for t in terms]
    near = ranges[0]
    for r in ranges[1:]:
        near = near | r
    hits = index.where(near).groupBy(key).agg(F.first("dl").alias("_dl"), *[F.sum(F.when(matches(F.col("token"), t), F.col("tf")).otherwise(0)).alias(f"_tf{i}") for i, t in enumerate(terms)])
    seen = hits.agg(*[F.count_if(F.col(f"_tf{i}") > 0).alias(f"n{i}") for i in range(len(terms))])
    sums = seen.select(F.struct("*")).scalar(), stats.select(F.struct("n", "avg")).scalar()
    hits = hits.where(" AND ".join(f"_tf{i} > 0" for i in range(len(terms)))).withColumns({"_a": sums[0], "_b": sums[1]})
    hits = hits.withColumn("_s", F.struct(F.col("_a.*"), F.col("_b.*")))
    return hits.select(key, score_of(len(terms)).alias("score"))


def filtered(hits: DataFrame, options: SearchOptions) -> DataFrame:
    """By kind, and by format ignoring ASCII case, null being the empty text."""
    if options.media_kind is not None:
        hits = hits.where(F.col("media_kind") == options.media_kind)
    if options.format is not None:
        wanted = upper_ascii(F.lit(options.format))
        hits = hits.where(upper_ascii(F.coalesce(F.col("format"), F.lit(""))) == wanted)
    return hits


def page(hits: DataFrame, options: SearchOptions, key: str = "media_id") -> DataFrame:
    """In order of score, then key; a limit below one is one."""
    return hits.orderBy(F.desc("score"), F.asc(key)).offset(max(options.offset, 0)).limit(max(options.limit, 1))


def search(media: DataFrame, query: str, options: SearchOptions = SearchOptions(), key: str = "media_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``key, media_kind, title_display, synopsis, score`` of the best hits."""
    hits = page(filtered(ranked(media, query, key, fields, ("media_kind", "format")), options), options, key).select(key, "score")
    return hits.join(media, key).select(key, "media_kind", "title_display", "synopsis", "score").orderBy(F.desc("score"), F.asc(key))


def title_contains(rows: DataFrame, query: str, limit: int, order: str, title: str = "title_display") -> DataFrame:
    """Titles with the query in them, ASCII case ignored, the first in ``order``; an empty query finds nothing."""
    if not query.strip():
        return rows.limit(0)
    return rows.where(lower_ascii(F.col(title)).contains(lower_ascii(F.lit(query)))).orderBy(order).limit(limit)
