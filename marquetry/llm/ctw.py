"""LM scoring by context-tree weighting over bytes.

A byte is eight binary decisions, each with a context tree of its own over the DEPTH bytes before: its root
stands for all training bytes, its children for the last byte, theirs for the last two, and so on. Every node holds a
Krichevsky-Trofimov estimate of the training bytes in its context, and the mixture over all depths follows from the nodes'
evidence: weight of a node = Pe / 2 over Pw, with Pw = (Pe + product of its children's Pw) / 2. The trained model is
then frozen, and a text's score is the sum of log10 probabilities of its bytes and of an end mark (0xFF,
which UTF-8 never has); minus that over log10(2) and the bytes is the code length per byte.

The tree is a table of contexts with their bytes, as many as the corpus has, and stays in the cluster. Texts come in
units of UNIT bytes. A unit lists its distinct contexts with bytes once, with how often its training texts have them; these meet in
groups that share the last two bytes, where everything from the third level down is weighted; the evidence of the
groups goes up to the two levels above, which are small. What a context gives its byte goes back to the units that
listed it, and there the texts are scored. The unigram score of words takes the same way: a unit lists its words.

Defined results: a null text is empty: it has the end token and the end mark; a null doc_id falls in a fold
like the empty text; with nothing to train on every bit has probability 1/2; repeated rows count and are
scored one by one; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of, drop, small_batches, staged, tidied
from .linededup import as_bytes

#: Bytes of context. A key is a context, its last byte highest, and a byte: 8 * (DEPTH + 1) bits of a long.
DEPTH = 4
END = 0xFF
#: Bytes of text in a unit; positions looked at together; the end token, which no word equals.
UNIT = 16 << 20
PIECE = 1 << 20
END_TOKEN = b" "
#: What a group shares, in bits of a key from the right, and keys of a group that are weighted together.
_GROUP = 8 * (DEPTH - 1)
SLICE = 1 << 16


class Positions:
    """The bytes and end marks of a unit's texts, each with the bytes before it; before a text stand zeros."""

    def __init__(self, texts: list[bytes]) -> None:
        pad = bytes(DEPTH)
        self.sizes = np.array([len(t) + DEPTH + 1 for t in texts], np.int64)
        self.data = np.frombuffer(b"".join(x for t in texts for x in (pad, t, bytes([END]))), np.uint8)
        self.start = np.cumsum(self.sizes) - self.sizes

    def pieces(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Texts by number, and the keys at their places, a piece at a time; the zeros before texts are no places."""
        for at in range(DEPTH, len(self.data), PIECE):
            end = min(at + PIECE, len(self.data))
            keys = np.zeros(end - at, np.int64)
            for back in (*range(1, DEPTH + 1), 0):
                keys <<= 8
                keys |= self.data[at - back : end - back]
            low, high = np.searchsorted(self.start, (at, end - 1), "right") - 1
            edges = np.concatenate(([at], self.start[low + 1 : high + 1], [end]))
            text = np.repeat(np.arange(low, high + 1), np.diff(edges))
            real = np.ones(end - at, bool)
            starts = self.start[max(low, 0) : high + 1]
            for i in range(DEPTH):
                own = starts + i - at
                real[own[(own >= 0) & (own < end - at)]] = False
            yield text[real], keys[real]

    def counted(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in order, and how often the texts to train on have them."""
        each = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for text, keys in self.pieces():
            keys = np.sort((keys << 1) | train[text])  # sorting numbers alone is much faster than sorting places
            first = _firsts(keys >> 1)
            each.append((keys[first] >> 1, np.add.reduceat(keys & 1, first) if len(first) else keys))
        return _sums(*map(np.concatenate, zip(*each, strict=True)))

    def totals(self, keys: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """The sum of each text's logs; ``keys`` has all that the texts have, in order."""
        out = np.zeros(len(self.start))
        for text, own in self.pieces():
            if not len(text):
                continue
            base, width = int(text[0]), int(text[-1] - text[0] + 1).bit_length()
            both = np.sort((own << width) | (text - base))  # a piece has fewer texts than bits are left
            own = both >> width
            first = _firsts(own)
            each = np.repeat(logs[np.searchsorted(keys, own[first])], np.diff(np.append(first, len(own))))
            sums = np.bincount(both & ((1 << width) - 1), each)
            out[base : base + len(sums)] += sums
        return out


def _firsts(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = _firsts(keys)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def _lgammas(first: float, n: int = 1 << 16) -> np.ndarray:
    """lgamma of first, first + 1, ...: exact sums of logarithms from the first on."""
    return math.lgamma(first) + np.concatenate(([0.0], np.cumsum(np.log(first + np.arange(n - 1)))))


_HALVES, _WHOLES = _lgammas(0.5), _lgammas(1.0)


def lgamma(n: np.ndarray, first: float) -> np.ndarray:
    """lgamma(n + first) of whole numbers, first being 0.5 or 1: from a table, beyond it by Stirling's series."""
    table = _HALVES if first == 0.5 else _WHOLES
    out = table[np.minimum(n, len(table) - 1).astype(np.int64)]
    large = n >= len(table)
    if large.any():
        out[large] = _stirling(n[large] + first)
    return out


def kt(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of that many zeros and ones."""
    return lgamma(zero, 0.5) + lgamma(one, 0.5) - np.log(np.pi) - lgamma(zero + one, 1.0)


def weighted(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log Pw of nodes from their own log Pe and the sum of their children's log Pw, and the weight of their own estimate."""
    pw = np.logaddexp(own, below) - np.log(2)
    return pw, np.exp(own - np.log(2) - pw)


def estimate(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The probability of a one."""
    return (one + 0.5) / (zero + one + 1)


_BACK = np.arange(7, -1, -1)


def _mixture(keys: np.ndarray, n: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct keys that come with all others of their contexts of ``top`` bytes: the probability of a one at the eight decisions of
    each key's byte, mixed from the deepest contexts up to those; and their decisions with zeros, ones and log Pw."""
    byte = keys[:, None] & 255
    node, bit = (1 << (7 - _BACK)) | (byte >> (_BACK + 1)), (byte >> _BACK) & 1
    weight = np.repeat(n.astype(np.float64), 8)
    levels: list[tuple] = []
    for depth in range(DEPTH, top - 1, -1):
        ids, where = np.unique((((keys >> (8 * (DEPTH + 1 - depth)))[:, None] << 8) | node).ravel(), return_inverse=True)
        both = np.bincount(where, weight, len(ids))
        one = np.bincount(where, weight * bit.ravel(), len(ids))
        zero = both - one
        if levels:
            was, pw = levels[-1][0], levels[-1][1]
            rest = np.bincount(np.searchsorted(ids, ((was >> 16) << 8) | (was & 255)), pw, len(ids))
            pw, own = weighted(kt(zero, one), rest)
        else:
            pw, own = kt(zero, one), np.ones(len(ids))
        levels.append((ids, pw, own, zero, one, where))
    p = np.full(len(weight), 0.5)
    for _, _, own, zero, one, where in levels:
        p = own[where] * estimate(zero, one)[where] + (1 - own[where]) * p
    ids, pw, _, zero, one, _ = levels[-1]
    return p.reshape(-1, 8), ids & 255, zero, one, pw


def _whole_contexts(ordered: np.ndarray) -> Iterator[slice]:
    """Ordered keys in pieces of some SLICE that part no context of three bytes; such a context has 2^16 keys at most."""
    firsts = np.append(_firsts(ordered >> (8 * (DEPTH - 2))), len(ordered))
    at = 0
    while at < len(ordered):
        end = int(firsts[max(np.searchsorted(firsts, at + SLICE, "right") - 1, np.searchsorted(firsts, at, "right"))])
        yield slice(at, end)
        at = end


def group_mixture(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a group's distinct keys: the mixed probability of a one at the eight decisions of each key's byte, from the
    group's own node down; and the decisions that node has, with zeros, ones and log Pw.

    Contexts of three bytes are weighted piece by piece, and only sums of their evidence are kept, so a group takes some 100 bytes a key.
    """
    order = np.argsort(keys)
    p, seen, zero, one, below = np.empty((len(keys), 8)), *np.zeros((4, 256))
    ordered = keys[order]
    pieces = list(_whole_contexts(ordered))
    for own in pieces:
        p[order[own]], decision, z, o, pw = _mixture(ordered[own], n[order[own]], 3)
        for total, part in ((seen, None), (zero, z), (one, o), (below, pw)):
            total += np.bincount(decision, part, 256)
    pw, own_weight = weighted(kt(zero, one), below)
    at_node = own_weight * estimate(zero, one)
    for own in pieces:
        byte = ordered[own, None] & 255
        node = (1 << (7 - _BACK)) | (byte >> (_BACK + 1))
        p[order[own]] = at_node[node] + (1 - own_weight[node]) * p[order[own]]
    decision = np.flatnonzero(seen)
    return p, decision, zero[decision], one[decision], pw[decision]


#: ``place`` is a word's or a document's number in its unit, and of a key the key itself.
_LISTED = "unit long, kind int, place long, n long, token binary, doc_id long, held_out boolean, text binary"
_TOKEN, _KEY, _DOC = 0, 1, 2
_ROWS = 50_000


def _fields(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _batch(schema: str, n: int, /, **columns: object) -> pa.RecordBatch:
    """Columns that aren't given are null."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    arrays = [pa.array(columns[k], kinds[t]) if k in columns else pa.nulls(n, kinds[t]) for k, t in (x.split() for x in schema.split(", "))]
    return pa.RecordBatch.from_arrays(arrays, _fields(schema))


def words_of(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END_TOKEN]


def _units(held_fold: int):
    """Rows of units: their words and keys with training counts, and their documents in order."""

    def flush(docs: list[tuple]) -> Iterator[pa.RecordBatch]:
        unit, seen, train = uuid.uuid4().int >> 65, {}, Counter()
        for _, held, text in docs:
            words = words_of(text)
            seen.update(dict.fromkeys(words))
            if not held:
                train.update(words)
        token = list(seen)
        counts = np.fromiter(map(train.get, token, repeat(0)), np.int64, len(token))
        keys, times = Positions([d[2] for d in docs]).counted(np.array([not d[1] for d in docs]))
        for kind, places, n_of in ((_TOKEN, np.arange(len(token)), counts), (_KEY, keys, times)):
            for at in range(0, len(places), _ROWS):
                own, n = slice(at, at + _ROWS), len(places[at : at + _ROWS])
                more = {"token": token[own]} if kind == _TOKEN else {}
                yield _batch(_LISTED, n, unit=np.full(n, unit), kind=np.full(n, kind, np.int32), place=places[own], n=n_of[own], **more)
        n = len(docs)
        ids, held, texts = zip(*docs, strict=True)
        yield _batch(_LISTED, n, unit=np.full(n, unit), kind=np.full(n, _DOC, np.int32), place=np.arange(n), doc_id=ids, held_out=held, text=texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for doc, fold, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), strict=True):
                if held and size + len(text) > UNIT:
                    yield from flush(held)
                    held, size = [], 0
                held.append((doc, fold == held_fold, text))
                size += len(text)
        if held:
            yield from flush(held)

    return tidied(run)


_MIXED = "key long, p binary, last int, decision int, zero double, one double, pw double"


def _mix_groups(group: pa.Table) -> pa.Table:
    """Rows of keys with their mixtures, and rows of the group's evidence."""
    keys, n = group.column("key").to_numpy(), group.column("n").to_numpy()
    p, decision, zero, one, pw = group_mixture(keys, n)
    m, last = len(decision), int(keys[0]) >> (8 * DEPTH)
    batches, none = [_batch(_MIXED, m, last=[last] * m, decision=decision, zero=zero, one=one, pw=pw)], _batch(_MIXED, min(_ROWS, len(keys)))
    for at in range(0, len(keys), _ROWS):  # batches share the columns that they have none of, and the mixtures' memory
        own = p[at : at + _ROWS]
        size = len(own)
        offsets = pa.array(np.arange(0, 64 * size + 1, 64, dtype=np.int32))
        packed = pa.BinaryArray.from_buffers(pa.binary(), size, [None, offsets.buffers()[1], pa.py_buffer(own)])
        columns = [pa.array(keys[at : at + _ROWS]), packed, *(none.column(i).slice(0, size) for i in range(2, none.num_columns))]
        batches.append(pa.RecordBatch.from_arrays(columns, none.schema.names))
    return pa.Table.from_batches(batches)


def top_levels(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """``shift, scale`` by last byte and decision: the whole mixture is shift + scale * that of the group below.

    ``rows`` are the sums of the groups' evidence by last byte and decision.
    """
    last, decision = (np.array([r[c] for r in rows], np.int64) for c in ("last", "decision"))
    zero, one, below = (np.array([r[c] for r in rows], np.float64) for c in ("zero", "one", "pw"))
    pw, own = weighted(kt(zero, one), below)
    z, o, all_below = (np.bincount(decision, x, 256) for x in (zero, one, pw))
    _, root = weighted(kt(z, o), all_below)
    at_root = estimate(z, o)
    shift, scale = np.zeros((256, 256)), np.ones((256, 256))
    shift[last, decision] = root[decision] * at_root[decision] + (1 - root[decision]) * own * estimate(zero, one)
    scale[last, decision] = (1 - root[decision]) * (1 - own)
    return shift, scale


def key_logs(units: DataFrame) -> DataFrame:
    """``key, log``: log10 of the probability of a key's byte in its context, for all keys that are listed."""
    spark = units.sparkSession
    counts = units.where(F.col("kind") == _KEY).groupBy(F.col("place").alias("key")).agg(F.sum("n").alias("n"))
    counts = counts.select(F.shiftright("key", _GROUP).alias("last2"), "key", "n")
    mixed = staged(counts.groupBy("last2").applyInArrow(_mix_groups, _MIXED), "ctw-mixed")
    tops = mixed.where("key IS NULL").groupBy("last", "decision").agg(*[F.sum(c).alias(c) for c in ("zero", "one", "pw")])
    shared = spark.sparkContext.broadcast(top_levels(tops.collect()))  # 256 last bytes by 255 decisions at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, scale = shared.value
        for b in batches:
            keys = b.column(0).to_numpy()
            p = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float64).reshape(-1, 8)
            byte, last = keys[:, None] & 255, (keys >> (8 * DEPTH))[:, None]
            node, bit = (1 << (7 - _BACK)) | (byte >> (_BACK + 1)), (byte >> _BACK) & 1
            one = np.clip(shift[last, node] + scale[last, node] * p, 1e-12, 1 - 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.log10(np.where(bit, one, 1 - one)).sum(1))], ["key", "log"])

    return mixed.where("key IS NOT NULL").select("key", "p").mapInArrow(tidied(run), "key long, log double")


def _scored(total: int, distinct: int):
    floor = np.log10(total + distinct + 1)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        docs = docs.sort_by("place")
        texts = as_bytes(docs.column("text"))
        kind, place, value = (found.column(c).to_numpy() for c in ("kind", "place", "value"))
        (at, counts), (keys, logs) = ((place[kind == k], value[kind == k]) for k in (_TOKEN, _KEY))
        counts = counts[np.argsort(at)]
        known, parts = counts > 0, np.log10(counts + 1.0) - floor
        seen, sizes, n_known, base = {}, [], [], []
        each = [words_of(t) for t in texts]
        for words in each:
            seen.update(dict.fromkeys(words))  # words are numbered in the order in which the unit listed them
        number = dict(zip(seen, range(len(seen)), strict=True))
        for words in each:
            ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            sizes.append(len(ids))
            n_known.append(int(known[ids].sum()))
            base.append(float(parts[ids].sum()))
        order = np.argsort(keys)
        score, n = Positions(texts).totals(keys[order], logs[order]), docs.num_rows
        columns = [docs.column("doc_id"), docs.column("held_out"), *(pa.array(x, pa.int64()) for x in (sizes, n_known, [total] * n))]
        return pa.Table.from_arrays([*columns, pa.array(base, pa.float64()), pa.array(score)], names)

    return run


def score(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row; learns outside fold ``held``."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    fold = crc_of(F.col("doc_id")) % folds
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("fold"), F.col("text").cast("string").alias("text"))
    units = staged(source.mapInArrow(_units(held), _LISTED), "units")
    tokens = units.where(F.col("kind") == _TOKEN).select("unit", "kind", "token", "place", "n")
    counts = staged(tokens.groupBy("token").agg(F.sum("n").alias("c")), "token-counts")
    total, distinct = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    logs = staged(key_logs(units), "key-logs")
    back = [F.col("unit").alias("of"), "kind", "place"]
    of_tokens = staged(tokens.join(counts, "token").select(*back, F.col("c").cast("double").alias("value")), "unit-counts")
    drop(counts)
    of_keys = units.where(F.col("kind") == _KEY).join(logs, F.col("place") == F.col("key")).select(*back, F.col("log").alias("value"))
    of_keys = staged(of_keys, "unit-logs")
    each = units.where(F.col("kind") == _DOC).select("unit", "place", "doc_id", "held_out", "text")
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return each.groupBy("unit").cogroup(of_tokens.unionByName(of_keys).groupBy("of")).applyInArrow(_scored(total, distinct), out)
