"""Suffix-array dedup of long byte strings by prefix-free parsing.

Two parsings follow one another. In the cluster, a ``gram``-byte string is a trigger if its rolling hash is the
least among those in some ``length``-byte window, so every string of ``length`` bytes holds one, and equal
strings hold the same one at the same place. The starts that share a trigger form a phrase with it. Phrases
make a dictionary: of equal ones the first stays, and the others lie wholly in repeated strings. Only a
trigger with several distinct phrases, found where copies begin, end or were edited, needs a closer look.
Those phrases' texts are highly repetitive, and blocks of them are parsed again, into the phrases of a
`PrefixFreeParse`: the suffix arrays of its dictionary and of its parse combine into the order of all suffixes
of the block. Suffixes that share ``length`` bytes stand together in that order; the first of such a class over all blocks
stays, and what the others cover goes. Each block files one row of each phrase or class, so no key gathers
more rows than there are blocks.

Defined results: a null text is empty; a text shorter than ``length`` loses nothing; a null doc_id comes after
all others; rows of equal doc_ids, or of none, are documents of their own, in order of a 64-bit hash of their texts;
of rows equal in doc_id and text one is the document and the others, if of ``length`` bytes, go whole; bytes
removed may split a character; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged, tidied
from .linededup import as_bytes

LENGTH = 100
GRAM = 36
#: Bytes of text whose triggers are sought at once; phrases of a block; bytes of a dictionary block.
PIECE = 1 << 20
BLOCK = 400_000
DICTIONARY = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_OTHER = 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, base & _MASK, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of substrings of up to ``n`` bytes of text, by sums of powers modulo 2**64."""

    def __init__(self, n: int, base: int = _BASE) -> None:
        self.up, self.down = _powers(n, base), _powers(n, pow(base, -1, 1 << 64))

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start])

    def grams(self, sums: np.ndarray, gram: int) -> np.ndarray:
        n = len(sums) - gram
        return mix((sums[gram:] - sums[:n]) * self.down[:n])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def phrases(data: np.ndarray, rolling: Rolling, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``trigger hash, phrase hash, first start, starts`` of the phrases of a text of ``length`` bytes or more."""
    sums = rolling.sums(data)
    grams = rolling.grams(sums, gram)
    width = length - gram + 1
    low = (grams & np.uint64(_MASK ^ 0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    least, have = low, 1
    while have * 2 <= width:
        least, have = np.minimum(least[:-have], least[have:]), have * 2
    least = np.minimum(least[: len(low) - width + 1], least[width - have :][: len(low) - width + 1])
    chosen = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    count = np.diff(np.append(first, len(chosen)))
    return grams[chosen[first]].view(np.int64), rolling.spans(sums, first, first + count + length - 1).view(np.int64), first, count


def ranks_to(rank: np.ndarray, left: np.ndarray, done: int, depth: int) -> np.ndarray:
    """Ranks of suffixes by ``depth`` symbols or more, from ranks (1 and up) by the first ``done``; ``left`` symbols stand before an end.

    Prefix doubling: an end is less than any symbol, and equal rank means equal symbols.
    """
    while done < depth:
        at = np.arange(len(rank)) + done
        nxt = np.where(left > done, rank[np.minimum(at, len(rank) - 1)], 0)
        rank, done = _dense((rank << np.int64(32)) | nxt), done * 2
    return rank


def _dense(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    s = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.concatenate(([1], s[1:] != s[:-1])))
    return out


class PrefixFreeParse:
    """Dictionary and parse of stretches of bytes that lie one after another, and the order of their suffixes to ``depth`` bytes.

    A phrase runs from a trigger (or a stretch's start) to the end of the next trigger (or the stretch's end), so
    suffixes of phrases that are longer than a trigger are prefix-free. A suffix of a stretch is a suffix of a phrase and what
    the parse has behind it: the first one's rank in the dictionary, then the second one's in the parse, give its place.
    """

    WINDOW, ONE_IN = 8, 32

    def __init__(self, data: np.ndarray, base: np.ndarray, size: np.ndarray, depth: int) -> None:
        self.cuts, ends = self._cuts(data, base, size)
        raw = data.tobytes()
        own = [raw[a:z] for a, z in zip(self.cuts.tolist(), ends.tolist(), strict=True)]
        self.dictionary = sorted(set(own))
        number = {p: i for i, p in enumerate(self.dictionary)}
        self.parse = np.fromiter((number[p] for p in own), np.int64, len(own))
        sizes = np.fromiter(map(len, self.dictionary), np.int64, len(self.dictionary))
        self.begins = np.cumsum(sizes) - sizes
        self.phrase_rank = self._dictionary_ranks(sizes, depth)
        stretch = np.searchsorted(base, self.cuts, "right") - 1
        first = np.searchsorted(self.cuts, base)
        self.behind = np.append(first[1:], len(own))[stretch] - np.arange(len(own))
        self.parse_rank = ranks_to(self.parse + 1, self.behind, 1, depth)

    def _cuts(self, data: np.ndarray, base: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.WINDOW
        key = np.zeros(max(0, len(data) - w + 1), np.uint64)
        for i in range(w):
            key = (key << np.uint64(8)) | data[i : i + len(key)].astype(np.uint64)
        hit = np.flatnonzero(mix(key) & np.uint64(self.ONE_IN - 1) == 0)
        of = np.searchsorted(base, hit, "right") - 1
        hit = hit[hit + w <= (base + size)[of]]
        cuts = np.union1d(base, hit)
        of = np.searchsorted(base, cuts, "right") - 1
        ends = (base + size)[of]
        inner = np.append(of[1:] == of[:-1], False)
        ends[inner] = cuts[1:][inner[:-1]] + w
        return cuts, ends

    def _dictionary_ranks(self, sizes: np.ndarray, depth: int) -> np.ndarray:
        text = np.frombuffer(b"".join(self.dictionary), np.uint8)
        left = np.repeat(self.begins + sizes, sizes) - np.arange(len(text))
        key, padded = np.zeros(len(text), np.int64), np.concatenate((text, np.zeros(7, np.uint8)))
        for i in range(7):  # nine bits a byte: 0 is an end
            key = (key << np.int64(9)) | np.where(left > i, padded[i : i + len(text)].astype(np.int64) + 1, 0)
        return ranks_to(_dense(key), left, 7, depth)

    def order_keys(self, at: np.ndarray) -> np.ndarray:
        """Numbers in the order of the suffixes at those places."""
        j = np.searchsorted(self.cuts, at, "right") - 1
        own = self.phrase_rank[self.begins[self.parse[j]] + at - self.cuts[j]]
        nxt = np.where(self.behind[j] > 1, self.parse_rank[np.minimum(j + 1, len(self.parse) - 1)], 0)
        return (own << np.int64(32)) | nxt


def suffix_classes(data: np.ndarray, base: np.ndarray, size: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The places ``at`` (in rising order) in the order of their suffixes, and where in it a class of equal ``length`` bytes begins."""
    keys = PrefixFreeParse(data, base, size, length).order_keys(at)
    order = np.argsort(keys, kind="stable")
    new = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    near = np.flatnonzero(new)[1:]
    for a in range(0, len(near), 1 << 14):  # neighbours may differ only beyond the length
        k = near[a : a + (1 << 14)]
        new[k] = (view[at[order[k]]] != view[at[order[k - 1]]]).any(1)
    return order, new


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans as maximal runs in order; spans that touch join."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def _merged_by(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `merged`, row by row."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    edges = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    parts = [merged(start[a:b], end[a:b]) for a, b in zip(edges, np.append(edges[1:], len(row)), strict=True)]
    return np.repeat(row[edges], [len(p[0]) for p in parts]), np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


_PLACE = "doc long, tie long, start long, n long"
_FILED = f"h long, c long, {_PLACE}"


class _Rows:
    """The rows of a block, numbered in their order: by ``doc``, then ``tie``."""

    def __init__(self, ids: list[tuple[int, int]]) -> None:
        doc, tie = np.array([x[0] for x in ids], np.int64), np.array([x[1] for x in ids], np.int64)
        order = np.lexsort((tie, doc))
        self.doc, self.tie = doc[order], tie[order]
        new = np.ones(len(ids), bool)
        new[1:] = (self.doc[1:] != self.doc[:-1]) | (self.tie[1:] != self.tie[:-1])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
        self.number = np.empty(len(ids), np.int64)
        self.number[order] = lead  # equal rows have one number

    def filed(self, h: np.ndarray, c: np.ndarray, row: np.ndarray, start: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(h):
            yield _batch((h, c, self.doc[row], self.tie[row], start, n))

    def known(self, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Spans that a block has found itself (n < 0); any hash will do to deal them out."""
        row, start, end = _merged_by(row, start, end)
        spread = mix((self.doc[row] * 31 + start).view(np.uint64)).view(np.int64)
        yield from self.filed(spread, np.zeros(len(row), np.int64), row, start, start - end)


def _batch(cols: tuple[np.ndarray, ...], schema: str = _FILED) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], [x.split()[0] for x in schema.split(", ")])


def _file_phrases(length: int, gram: int):
    """One row for each phrase of a block, and the spans of those that repeat it there."""

    def flush(ids: list, held: list) -> Iterator[pa.RecordBatch]:
        rows = _Rows(ids)
        h, c, no, start, n = map(np.concatenate, zip(*held, strict=True))
        row = rows.number[no]
        order = np.lexsort((start, row, c, h))
        h, c, row, start, n = (x[order] for x in (h, c, row, start, n))
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
        lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        rest = (row != row[lead]) | (start != start[lead])
        yield from rows.filed(h[new], c[new], row[new], start[new], n[new])
        yield from rows.known(row[rest], start[rest], start[rest] + n[rest] + length - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, ids, held, n_held = Rolling(PIECE + length), [], [], 0
        for b in batches:
            for doc, tie, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), strict=True):
                data = np.frombuffer(text, np.uint8)
                for at in range(0, len(data) - length + 1, PIECE):
                    if n_held >= BLOCK:
                        yield from flush(ids, held)
                        ids, held, n_held = [], [], 0
                    h, c, start, n = phrases(data[at : at + PIECE + length - 1], rolling, length, gram)
                    held.append((h, c, np.full(len(h), len(ids)), start + at, n))
                    ids.append((doc, tie))
                    n_held += len(h)
        if held:
            yield from flush(ids, held)

    return run


def _resolve(length: int, close: bool):
    """Of rows in order of their keys: spans to remove (n < 0), and with ``close`` the rows of triggers with several phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key and place of the last row that was the first of its key, and whether it was given out
        for b in batches:
            h, c, doc, tie, start, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            spans = n < 0
            out = [(doc[spans], tie[spans], start[spans], n[spans])]
            h, c, doc, tie, start, n = (x[~spans] for x in (h, c, doc, tie, start, n))
            if last is not None:  # it stands before the others, so that they meet it
                h, c, doc, tie, start, n = (np.concatenate(([x], y)) for x, y in zip(last[0], (h, c, doc, tie, start, n), strict=True))
            if len(h):
                new_h = np.concatenate(([True], h[1:] != h[:-1]))
                new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
                lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
                rest = (doc != doc[lead]) | (tie != tie[lead]) | (start != start[lead])
                out.append((doc[rest], tie[rest], start[rest], -(n[rest] + length - 1)))
                one = np.flatnonzero(new)
                near = np.zeros(len(one), bool)
                if close:
                    near = ~new_h[one]
                    near[:-1] |= near[1:]
                    given = near.copy()
                    if last is not None and last[1]:
                        near[0], given[0] = True, False
                    k = one[given]
                    out.append((doc[k], tie[k], start[k], n[k]))
                k = one[-1]
                last = tuple(x[k] for x in (h, c, doc, tie, start, n)), bool(near[-1])
            cols = tuple(map(np.concatenate, zip(*out, strict=True)))
            if len(cols[0]):
                yield _batch(cols, _PLACE)

    return run


def _close_look(length: int):
    """The classes of suffixes of a block of phrases; ``places`` are a document's (start, n) of such phrases."""
    n_most = DICTIONARY + 3 * length

    def flush(held: list, hashes: list[Rolling]) -> Iterator[pa.RecordBatch]:
        rows = _Rows([x[1] for x in held])
        order = np.lexsort(([x[2] for x in held], rows.number))
        held, number = [held[i] for i in order.tolist()], rows.number[order]
        data = np.frombuffer(b"".join(x[0] for x in held), np.uint8)
        size = np.array([len(x[0]) for x in held])
        base = np.cumsum(size) - size
        n = size - length + 1
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(base, n) + inner
        start, row = np.repeat(np.array([x[2] for x in held]), n) + inner, np.repeat(number, n)
        by, new = suffix_classes(data, base, size, at, length)
        edges = np.flatnonzero(new)
        one = np.minimum.reduceat(by, edges)  # places are in order of rows and starts
        lead = np.repeat(one, np.diff(np.append(edges, len(by))))
        rest = by[(row[by] != row[lead]) | (start[by] != start[lead])]
        g, c = (r.spans(r.sums(data), at[one], at[one] + length).view(np.int64) for r in hashes)
        yield from rows.filed(g, c, row[one], start[one], np.ones(len(one), np.int64))
        yield from rows.known(row[rest], start[rest], start[rest] + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = [Rolling(n_most), Rolling(n_most, _OTHER)]
        held, size = [], 0
        for b in batches:
            for doc, tie, text, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), b.column(3).to_pylist(), strict=True):
                for p in places:
                    held.append((text[p["start"] : p["start"] + p["n"] + length - 1], (doc, tie), p["start"]))
                    size += len(held[-1][0])
                    if size >= DICTIONARY:
                        yield from flush(held, hashes)
                        held, size = [], 0
        if held:
            yield from flush(held, hashes)

    return run


def _sorted_by_key(filed: DataFrame) -> DataFrame:
    return filed.repartition("h").sortWithinPartitions("h", "c", "doc", "tie", "start")


def _identified(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``doc_id, doc, tie, text``, and whether a tie is needed: whether an id is null or repeated. Without need it is 0."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id IS NULL OR n > 1")
    ties = not odd.isEmpty()
    tie = F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull()) if ties else F.lit(0).cast("long")
    return docs.select("doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), tie.alias("tie"), "text"), ties


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc, tie, start, n`` of rows ``doc, tie, text``: spans of -n bytes that repeat earlier ones; they may overlap."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc", "tie", "text")
    found = staged(_sorted_by_key(docs.mapInArrow(tidied(_file_phrases(length, gram)), _FILED)).mapInArrow(tidied(_resolve(length, True)), _PLACE), "spans-phrases")
    near = found.where("n > 0").groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "n")).alias("places"))
    strings = docs.join(near, ["doc", "tie"]).select("doc", "tie", "text", "places").mapInArrow(tidied(_close_look(length)), _FILED)
    more = staged(_sorted_by_key(strings).mapInArrow(tidied(_resolve(length, False)), _PLACE), "spans-strings")
    return found.where("n < 0").unionByName(more)


_OUT = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept, sizes, gone, runs = [], [], [], []
        for text, own in zip(as_bytes(b.column(3)), b.column(4), strict=True):
            own = own.values if own.is_valid else None
            s, n = (own.field(i).to_numpy() for i in (0, 1)) if own is not None else (np.zeros(0, int),) * 2
            start, end = merged(s, s - n)
            edge = np.concatenate(([0], np.stack((start, end), 1).ravel(), [len(text)]))
            kept.append(b"".join(text[a:z] for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)))
            sizes.append(len(text))
            gone.append(int((end - start).sum()))
            runs.append(len(start))
        counts = (pa.array(x, pa.int64()) for x in (sizes, gone, runs))
        names = ["doc", "tie", *(x.split()[0] for x in _OUT.split(", "))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(kept, pa.binary()), *counts], names)


def dedup_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, kept`` (binary), ``n_bytes, n_removed, n_spans`` of each row."""
    docs, ties = _identified(docs)
    spans = repeated_spans(docs, length, gram).groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    out = docs.join(spans, ["doc", "tie"], "left").select("doc", "tie", "doc_id", "text", "spans").mapInArrow(tidied(_cut), f"doc long, tie long, {_OUT}")
    names = [x.split()[0] for x in _OUT.split(", ")]
    if not ties:
        return out.select(names)
    # Of equal rows one is the document, and the others go whole.
    sized = docs.select("doc_id", "doc", "tie", F.octet_length("text").cast("long").alias("n_bytes")).where(F.col("n_bytes") >= length)
    again = staged(sized.groupBy("doc_id", "doc", "tie", "n_bytes").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "equal-rows")
    keys = again.select("doc", "tie")
    one = out.join(keys, ["doc", "tie"], "left_semi").groupBy("doc", "tie").agg(*[F.first(c).alias(c) for c in names])
    hundreds = again.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil((F.col("m") - 1) / 1000))).alias("k"))
    upto = F.least(F.lit(1000).cast("long"), F.col("m") - 1 - (F.col("k") - 1) * 1000)
    rest = hundreds.where(upto > 0).select("*", F.explode(F.sequence(F.lit(1).cast("long"), upto)).alias("i"))
    rest = rest.select("doc_id", F.lit(b"").alias("kept"), "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"))
    return out.join(keys, ["doc", "tie"], "left_anti").select(names).unionByName(one.select(names)).unionByName(rest)
