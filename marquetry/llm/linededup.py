"""Line dedup: explode normalised lines, hash, count documents by hash, drop, and reassemble by position.

A line's key is the line without blanks at its ends and with A-Z lower-cased. Keys of ``min_chars`` code
points or more that ``min_docs`` documents hold lose their lines in all but the largest doc_id.

Defined results: a null or empty text is one empty line; rows that repeat a doc_id count as one document, and all of
them keep the line if theirs is the largest id; a row without a doc_id doesn't count, never drops a line and
never keeps one; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, small_batches, staged, tidied

MIN_CHARS = 20
MIN_DOCS = 3


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The 128-bit hash of a line's key, or None if the key is short. bytes.strip and bytes.lower know ASCII only."""
    key = line.strip(b" \t\n\x0b\x0c\r").lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh128_digest(key)


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``h, doc_id``, once for each long line key of a document."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = [], []
            for doc, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                own = {k for x in text.split(b"\n") if (k := line_key(x, min_chars))}
                keys += own
                ids += [doc] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["h", "doc_id"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(explode), "h binary, doc_id long")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, text`` (the kept lines), ``n_lines, n_dropped`` of each row, and ``row``, a struct of the columns to carry."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), carried(carry))
    lines = line_hashes(docs.select("doc_id", "text"), min_chars)
    # Rows of an id count once. By id and line first: a hot line is spread over its ids, and summed before it meets itself.
    common = lines.distinct().groupBy("h").agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    common = staged(common.select("h", "keeper"), "common-lines")  # a staged side lets a hot line's rows be split
    lost = lines.join(common, "h").where(F.col("doc_id") != F.col("keeper"))  # ids that repeat give their drops twice
    drops = lost.groupBy("doc_id").agg(F.collect_set("h").alias("drops"))

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, gone = [], [], []
            for text, drop in zip(as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                lines = text.split(b"\n")
                drop = set(drop or ())
                kept = [x for x in lines if line_key(x, min_chars) not in drop] if drop else lines
                texts.append(b"\n".join(kept))
                counts.append(len(lines))
                gone.append(len(lines) - len(kept))
            columns = [b.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), b.column(3)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_lines", "n_dropped", "row"])

    out = f"doc_id long, text string, n_lines long, n_dropped long, row {docs.schema['row'].dataType.simpleString()}"
    return docs.join(drops, "doc_id", "left").select("doc_id", "text", "drops", "row").mapInArrow(tidied(reassemble), out)


def digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()
