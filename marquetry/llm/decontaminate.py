"""Benchmark decontamination: an FM-index of each shard of training text, searched backwards for benchmark windows.

A shard is SHARD words of documents as a sequence of word numbers; a text that goes on beyond it is continued in the next, which
overlaps it by a window. Words that no window of the block has are
only separators, and runs too short for any window are left out; what remains gets a suffix array by prefix
doubling, its Burrows-Wheeler transform, and a wavelet tree over that. All windows are searched backwards at
once by wavelet ranks; their rows walk back to the next sampled suffix position, which locates them.

Benchmark windows come in blocks of bounded size, one after another through the driver into files of the shared folder. Workers
hold one block at a time, and take a group of documents through all blocks in one pass.

Defined results: null texts and items have no words; an item shorter than a window is one window; equal
windows of several items count for each, and items without an id are one item; a null doc_id is kept as it is; repeated rows
are judged one by one; empty tables give no hits; other columns are left out.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytespans import Rolling, merged
from .common import carried, filesystem, fresh_path, small_batches, tidied
from .linededup import as_bytes

WINDOW = 10
#: Windows of a block; words of a shard; bytes of texts searched together and of a tokeniser's piece; distance of sampled suffixes.
BLOCK = 100_000
SHARD = 400_000
GROUP = 2 << 20
PIECE = 1 << 19
SAMPLE = 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: 0-9, a-z and all of code points above U+007F.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, end`` (bytes) and ``hash`` of the words of a text."""
    data = _LOWER[np.frombuffer(text, np.uint8)]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _IN_WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):  # pieces end with words, so that sums stay short
        upto = max(at + 1, int(np.searchsorted(end, start[at] + PIECE, "right")))
        a, z = int(start[at]), int(end[upto - 1])
        r = _rolling(z - a)
        out[at:upto] = r.spans(r.sums(data[a:z]), start[at:upto] - a, end[at:upto] - a)
        at = upto
    return start, end, out


_CACHE: list[Rolling] = []


def _rolling(n: int) -> Rolling:
    if n > PIECE:
        return Rolling(n)
    if not _CACHE:
        _CACHE.append(Rolling(PIECE))
    return _CACHE[0]


class Patterns:
    """A block of windows: a vocabulary by hash, windows as word numbers from 2 up, and the items of each."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[str]]) -> None:
        vocabulary = sorted({w for k in windows for w in k})
        hashes = np.array([words_of(w)[2][0] for w in vocabulary], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.words = hashes[order], [vocabulary[i] for i in order]
        number = {w: i + 2 for i, w in enumerate(self.words)}
        self.lengths = np.array([len(k) for k in windows])
        self.codes = np.zeros((len(windows), int(self.lengths.max())), np.int64)
        for i, k in enumerate(windows):
            self.codes[i, : len(k)] = [number[w] for w in k]
        names = sorted({x for v in windows.values() for x in v})
        place = {x: i for i, x in enumerate(names)}
        self.names = names
        self.items = [np.array([place[x] for x in v]) for v in windows.values()]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers; 1 for words that no window has."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 2, 1)


def item_windows(rows: Iterable, window: int = WINDOW) -> Iterator[tuple[tuple[bytes, ...], str]]:
    for item, text in rows:
        data = (text or "").encode()
        start, end, _ = words_of(data)
        data = bytes(_LOWER[np.frombuffer(data, np.uint8)])
        words = [data[a:z] for a, z in zip(start.tolist(), end.tolist(), strict=True)]
        for i in range(max(1, len(words) - window + 1) if words else 0):
            yield tuple(words[i : i + window]), "" if item is None else str(item)


def pattern_blocks(rows: Iterable, window: int = WINDOW, block: int = BLOCK) -> Iterator[Patterns]:
    held: dict[tuple[bytes, ...], list[str]] = {}
    for k, item in item_windows(rows, window):
        own = held.setdefault(k, [])
        if not own or own[-1] != item:
            own.append(item)
        if len(held) >= block:
            yield Patterns(held)
            held = {}
    if held:
        yield Patterns(held)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order, by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    head = np.concatenate(([True], s[order][1:] != s[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    k = 1
    while True:
        tied = ~head
        tied[:-1] |= tied[1:]
        rows = np.flatnonzero(tied)
        if not len(rows):
            return order
        own = order[rows]
        nxt = own + k
        key = (rank[own] << np.int64(32)) | np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        key, own = key[by], own[by]
        order[rows] = own
        new = np.concatenate(([True], key[1:] != key[:-1]))
        head[rows] = new
        rank[own] = np.maximum.accumulate(np.where(new, rows, 0))
        k *= 2


class FMIndex:
    """Backward search and locate over a sequence of numbers below ``sigma`` whose last is 0 and stands nowhere else."""

    def __init__(self, s: np.ndarray, sigma: int, sample: int = SAMPLE) -> None:
        order = suffix_array(s)
        self.bwt = s[order - 1]
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=sigma))))
        self.sampled = order % sample == 0
        self.sample_rank = np.cumsum(self.sampled) - self.sampled
        self.samples = order[self.sampled]
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        x = self.bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (x >> level) & 1
            ones = np.zeros(len(x) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(x) - int(ones[-1]))
            x = np.concatenate((x[bit == 0], x[bit == 1]))
        self.first = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            up = ones[i]
            i = np.where((c >> (self.levels - 1 - k)) & 1, zeros + up, i - up)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``c`` stands before row ``i`` of the transform."""
        return self._walk(c, i) - self.first[c]

    def search(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows ``low`` to ``high`` of suffixes that begin with each pattern."""
        rows = np.arange(len(codes))
        last = codes[rows, lengths - 1]
        low, high = self.counts[last].copy(), self.counts[last + 1].copy()
        for back in range(2, codes.shape[1] + 1):
            live = np.flatnonzero((high > low) & (lengths >= back))
            c = codes[live, lengths[live] - back]
            low[live] = self.counts[c] + self.rank(c, low[live])
            high[live] = self.counts[c] + self.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: each walks back until a sampled suffix."""
        out, steps, live = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(live):
            found = self.sampled[rows[live]]
            out[live[found]] = self.samples[self.sample_rank[rows[live[found]]]] + steps
            live = live[~found]
            c = self.bwt[rows[live]]
            rows[live] = self.counts[c] + self.rank(c, rows[live])
            steps += 1
        return out


def occurrences(p: Patterns, numbers: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``pattern, word`` of every occurrence in a shard of word numbers; ``breaks`` are where documents begin."""
    known = np.zeros(len(numbers) + 2, np.int8)
    known[1:-1] = numbers > 1
    edge = known[1:] != known[:-1]
    edge[breaks] |= known[1:][breaks] & known[:-1][breaks] > 0
    cut = np.flatnonzero(edge)
    start = cut[:-1][known[1:][cut[:-1]] > 0] if len(cut) else cut
    end = cut[1:][known[1:][cut[:-1]] > 0] if len(cut) else cut
    long = end - start >= p.lengths.min()
    start, size = start[long], (end - start)[long] + 1  # each run and one separator
    none = np.zeros(0, np.int64)
    if not len(start):
        return none, none
    first = np.cumsum(size) - size
    origin = np.arange(size.sum()) + np.repeat(start - first, size)
    s = np.append(numbers[np.minimum(origin, len(numbers) - 1)], 0)
    s[first + size - 1] = 1
    index = FMIndex(s, len(p.hashes) + 2)
    low, high = index.search(p.codes, p.lengths)
    found = np.flatnonzero(high > low)
    if not len(found):
        return none, none
    n = high[found] - low[found]
    rows = np.arange(n.sum()) + np.repeat(low[found] - (np.cumsum(n) - n), n)
    return np.repeat(found, n), origin[index.locate(rows)]


class Found:
    """What a text has: the words it was cut into, the items found, and spans of hit words by their numbers."""

    def __init__(self, text: bytes) -> None:
        self.text = text
        self.start, self.end, self.hashes = words_of(text)
        self.items: set[str] = set()
        self.first, self.last = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, p: Patterns, patterns: np.ndarray, words: np.ndarray) -> None:
        """Occurrences of a block's patterns at those words, each held against the text itself."""
        low = bytes(_LOWER[np.frombuffer(self.text, np.uint8)])
        held = lambda k, a: all(low[self.start[a + j] : self.end[a + j]] == p.words[c - 2] for j, c in enumerate(p.codes[k, : p.lengths[k]].tolist()))
        same = [held(k, a) for k, a in zip(patterns.tolist(), words.tolist(), strict=True)]
        patterns, words = patterns[same], words[same]
        self.items.update(p.names[x] for k in np.unique(patterns) for x in p.items[k])
        self.first, self.last = merged(np.append(self.first, words), np.append(self.last, words + p.lengths[patterns]))

    def spans(self) -> list[dict]:
        """first and last number words, start and end bytes; last and end are exclusive."""
        return [{"first": a, "last": z, "start": int(self.start[a]), "end": int(self.end[z - 1])} for a, z in zip(self.first.tolist(), self.last.tolist(), strict=True)]


def search_block(p: Patterns, each: list[Found], shard: int = SHARD) -> None:
    """Adds to the texts what the block's windows find, shard by shard."""
    sizes = np.array([len(f.hashes) for f in each])
    base = np.cumsum(sizes) - sizes
    hashes = np.concatenate([f.hashes for f in each]) if each else np.zeros(0, np.uint64)
    breaks, over = base[sizes > 0], int(p.lengths.max()) - 1
    for at in range(0, len(hashes), shard):
        part = p.numbers(hashes[at : at + shard + over])
        pattern, word = occurrences(p, part, breaks[(breaks >= at) & (breaks < at + len(part))] - at)
        own = word < shard  # what begins in the overlap is the next shard's
        pattern, word = pattern[own], word[own] + at
        doc = np.searchsorted(base, word, "right") - 1
        for d in np.unique(doc).tolist():
            each[d].add(p, pattern[doc == d], word[doc == d] - base[d])


_SPANS = "array<struct<first:long,last:long,start:long,end:long>>"
_ARROW = pa.list_(pa.struct([(k, pa.int64()) for k in ("first", "last", "start", "end")]))
#: The block that this worker has read last.
_BLOCK: dict[str, Patterns] = {}


def write_blocks(benchmark: DataFrame, window: int, block: int) -> list[str]:
    """Files of windows in the shared folder; the driver holds one block at a time."""
    folder, out = fresh_path(benchmark.sparkSession, "windows"), []
    for p in pattern_blocks(((r[0], r[1]) for r in benchmark.select("item_id", "text").toLocalIterator()), window, block):
        fs, root = filesystem(folder)
        fs.create_dir(root)
        out.append(f"{folder}/{len(out)}")
        with fs.open_output_stream(f"{root}/{len(out) - 1}", compression=None) as f:
            f.write(pickle.dumps(p))
    return out


def read_block(path: str) -> Patterns:
    if path not in _BLOCK:
        _BLOCK.clear()
        fs, own = filesystem(path)
        with fs.open_input_stream(own, compression=None) as f:
            _BLOCK[path] = pickle.loads(f.read())
    return _BLOCK[path]


def _searched(paths: list[str], shard: int, output: Callable[[list[Found]], list[pa.Array]], names: list[str]):
    """A map over batches of ``doc_id, text, row``: rows of a group go through all blocks, and ``output`` makes columns of them."""
    group = GROUP if len(paths) <= 1 else 4 * GROUP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(1))
            at = 0
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and (size < group or upto == at):
                    size += len(texts[upto])
                    upto += 1
                found = [Found(t) for t in texts[at:upto]]
                for path in paths:
                    search_block(read_block(path), found, shard)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, upto - at), *output(found), b.column(2).slice(at, upto - at)], names)
                at = upto

    return tidied(run)


def _source(docs: DataFrame, carry: Sequence[str]) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), carried(carry))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK, shard: int = SHARD, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, items, spans, n_words`` of each row; ``row`` has the columns to carry."""

    def output(found: list[Found]) -> list[pa.Array]:
        items = pa.array([sorted(f.items) for f in found], pa.list_(pa.string()))
        return [items, pa.array([f.spans() for f in found], _ARROW), pa.array([len(f.hashes) for f in found], pa.int64())]

    source = _source(docs, carry)
    schema = f"doc_id long, items array<string>, spans {_SPANS}, n_words long, row {source.schema['row'].dataType.simpleString()}"
    return source.mapInArrow(_searched(write_blocks(benchmark, window, block), shard, output, ["doc_id", "items", "spans", "n_words", "row"]), schema)


def cut_spans(text: bytes, spans: list[dict]) -> bytes:
    """A text without the bytes of its spans; what stood around each stays apart by a line feed."""
    kept, at = [], 0
    for s in spans:
        kept.append(text[at : s["start"]])
        at = s["end"]
    return b"\n".join((*kept, text[at:])) if spans else text


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, text`` with all benchmark passages cut out, ``n_hit``, and ``row`` with the columns to carry."""

    def output(found: list[Found]) -> list[pa.Array]:
        texts = pa.array([cut_spans(f.text, f.spans()) for f in found], pa.binary()).cast(pa.string())
        return [texts, pa.array([int((f.last - f.first).sum()) for f in found], pa.int64())]

    source = _source(docs, carry)
    schema = f"doc_id long, text string, n_hit long, row {source.schema['row'].dataType.simpleString()}"
    return source.mapInArrow(_searched(write_blocks(benchmark, window, block), SHARD, output, ["doc_id", "text", "n_hit", "row"]), schema)
