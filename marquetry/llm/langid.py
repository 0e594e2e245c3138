"""Language ID by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text answers how far a text matches
the sample. A text is parsed into longest matches, and the language that needs the fewest phrases wins,
each phrase priced at the logarithm of its sample's size.

Texts are parsed in stretches of SEGMENT symbols, all stretches of a batch and all languages a symbol at a time. A stretch
must begin in the state in which the one before it ended; that is guessed from the last symbols before it, and stretches whose guess
was wrong are parsed again until none is, so the phrases are those of the whole text, parsed from its first symbol.

Symbols are lower-cased letters; every run of other characters is one blank. The sample has at most ROWS rows of a
language, in order of a hash of the id, where a row of more than STRETCH characters stands as its stretches of that length, each as likely
as any other row: so long rows are learned from by their length, and an automaton has ROWS * STRETCH symbols at most. Tasks build the automata,
one language at a time, and the driver gets their tables only. They are sparse, so they take some 50 bytes a symbol of the samples whatever the alphabets. Languages
are taken to be a bounded set, as ISO codes are: the model grows with their number.

Defined results: a null text, one without a letter, and any text where nothing was learned is ``und`` with
score 0; ties go to the first language in order; a lang of null is not learned, the empty text is a language as any other; a null
doc_id has a fold as the empty text has; repeated rows are judged one by one, and equal ones are learned once; an
empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, crc_of, small_batches, staged, tidied

UNKNOWN = "und"
ROWS = 24
#: Characters of a labelled row that are learned together.
STRETCH = 20_000
SEGMENT = 4096
#: Symbols before a stretch from which its first state is guessed, and rounds of guesses before a text is parsed by itself.
RUN_IN, ROUNDS = 256, 4
#: Code points of a batch that are parsed at once.
CHARS = 2 << 20

_TARGET = (1 << 32) - 1


def suffix_automaton(sequence: list[int]) -> list[dict[int, int]]:
    """Ways on by symbol from each state of the automaton of all substrings; state 0 is the start."""
    link, length, nexts = [-1], [0], [{}]
    last = 0
    for c in sequence:
        cur = len(link)
        link.append(0)
        length.append(length[last] + 1)
        nexts.append({})
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                nexts.append(dict(nexts[q]))
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nexts


def displaced(nexts: list[dict[int, int]], symbols: int) -> tuple[np.ndarray, int]:
    """The ways on laid over each other in one row, and the number of the start.

    A state's number is where its own row begins. The cell ``number + symbol`` holds the state that it belongs to
    in its upper 32 bits and the state to go to in its lower ones; -1 is free. Rows with many ways are laid first.
    """
    size = 2 * sum(map(len, nexts)) + 16
    taken, numbers, number = bytearray(size + symbols), set(), [0] * len(nexts)
    place = random.Random(len(nexts))
    for i in sorted(range(len(nexts)), key=lambda i: -len(nexts[i])):
        own = list(nexts[i])
        while True:
            at = int(place.random() * size)
            if at not in numbers and not any(taken[at + c] for c in own):
                break
        numbers.add(at)
        number[i] = at
        for c in own:
            taken[at + c] = 1
    table = np.full(size + symbols, -1, np.int64)
    for i, own in enumerate(nexts):
        for c, to in own.items():
            table[number[i] + c] = number[i] << 32 | number[to]
    return table, number[0]


@dataclass
class Model:
    """``symbol`` numbers every code point: 0 a blank, 1 a letter that no sample has, from 2 letters of samples.

    ``first`` is where each language goes from its start by each symbol; ``dead`` is a state with no way on.
    """

    langs: list[str]
    symbol: np.ndarray
    table: np.ndarray
    first: np.ndarray
    dead: int
    price: np.ndarray


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def blanks_once(symbols: np.ndarray) -> np.ndarray:
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    return symbols[keep]


def letters_of(text: str) -> set[str]:
    return {c for c in text.lower() if c.isalpha()}


def numbered(letters: list[str]) -> np.ndarray:
    """The symbol of every code point, of letters in order."""
    number = {c: i + 2 for i, c in enumerate(letters)}
    symbol = np.zeros(0x110000, np.int32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            symbol[i] = number.get(low if len(low) == 1 else c, 1)
    return symbol


def automaton(texts: list[str], symbol: np.ndarray, width: int) -> tuple[np.ndarray, int, int]:
    """Table and start of the automaton of a language's texts, and how many symbols they have."""
    taken = [x for t in texts for x in (0, *blanks_once(symbol[code_points(t)]).tolist())]
    return *displaced(suffix_automaton(taken), width), len(taken)


def _joined(parts: list[tuple[str, np.ndarray, int, int]], symbol: np.ndarray, width: int) -> Model:
    """One table of all languages' automata, in order of languages."""
    tables, starts, price, base = [], [], [], 0
    for _, table, start, taken in parts:
        tables.append(np.where(table < 0, -1, table + (base << 32 | base)))
        starts.append(start + base)
        price.append(np.log2(max(4, taken)))
        base += len(table)
    table = np.concatenate([*tables, np.full(width, -1, np.int64)])
    row = table[np.array(starts)[:, None] + np.arange(width)]
    first = np.where(row >> 32 == np.array(starts)[:, None], row & _TARGET, base)
    return Model([p[0] for p in parts], symbol, table, first, base, np.array(price))


def build(samples: dict[str, list[str]]) -> Model | None:
    """A model of a few texts by language, on the driver."""
    samples = {k: v for k, v in sorted(samples.items()) if any(letters_of(t) for t in v)}
    if not samples:
        return None
    letters = sorted({c for v in samples.values() for t in v for c in letters_of(t)})
    symbol, width = numbered(letters), len(letters) + 2
    return _joined([(k, *automaton(v, symbol, width)) for k, v in samples.items()], symbol, width)


def learned(samples: DataFrame) -> Model | None:
    """The model of `sampled` rows: a task builds the automaton of a language, and sends its table."""
    spark = samples.sparkSession

    def alphabet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[str] = set()
        for b in batches:
            for t in b.column(0).to_pylist():
                found |= letters_of(t)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["letter"])

    letters = sorted(r[0] for r in samples.select("text").mapInArrow(alphabet, "letter string").distinct().collect())  # of all alphabets
    if not letters:
        return None
    symbol, width = numbered(letters), len(letters) + 2
    shared = spark.sparkContext.broadcast(symbol)

    def one(rows: pa.Table) -> pa.Table:
        texts = [t for _, t in sorted(zip((tuple(k.values()) for k in rows["key"].to_pylist()), rows["text"].to_pylist(), strict=True))]
        none = not any(letters_of(t) for t in texts)
        table, start, taken = (np.zeros(0, np.int64), 0, 0) if none else automaton(texts, shared.value, width)
        return pa.table({"lang": rows["lang"][:1], "start": [start], "taken": [taken], "cells": pa.array([table.tobytes()], pa.binary())})

    made = samples.groupBy("lang").applyInArrow(one, "lang string, start long, taken long, cells binary")
    parts = [(r["lang"], np.frombuffer(r["cells"], np.int64), r["start"], r["taken"]) for r in made.toLocalIterator() if r["taken"]]
    return _joined(sorted(parts, key=lambda p: p[0]), symbol, width)


def phrases(model: Model, symbols: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that each language begins in each stretch of ``symbols``, entered in that state, and the state in which it ends.

    All are languages by stretches. A symbol that a sample lacks is a phrase of its own.
    """
    order = np.argsort(-size, kind="stable")
    start, size, state = start[order], size[order], state[:, order]
    count = np.zeros(state.shape, np.int32)
    live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1 if len(size) else 0), "right")
    for t, k in enumerate(live.tolist()):
        s = symbols[start[:k] + t]
        own = state[:, :k]
        cell = model.table.take(own + s)
        miss = cell >> 32 != own
        count[:, :k] += miss
        cell &= _TARGET
        np.copyto(cell, model.first.take(s, axis=1), where=miss)
        state[:, :k] = cell
    counts, states = np.empty_like(count), np.empty_like(state)
    counts[:, order], states[:, order] = count, state
    return counts, states


def _by_itself(model: Model, symbols: list[int], states: list[int]) -> list[int]:
    """Phrases begun in the rest of a text, symbol by symbol."""
    table, out = model.table, []
    for own, first in zip(states, model.first.tolist(), strict=True):
        n = 0
        for s in symbols:
            cell = int(table[own + s])
            if cell >> 32 == own:
                own = cell & _TARGET
            else:
                own, n = first[s], n + 1
        out.append(n)
    return out


def counts_by_language(model: Model, each: list[np.ndarray]) -> np.ndarray:
    """Phrases of each sequence of symbols by language: sequences by languages."""
    sizes = np.array([len(e) for e in each], np.int64)
    symbols = np.concatenate(each).astype(np.int64) if each else np.zeros(0, np.int64)
    parts = -(-sizes // SEGMENT)
    doc = np.repeat(np.arange(len(each)), parts)
    inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(np.cumsum(sizes) - sizes, parts)
    start = begin + inner * SEGMENT
    size = np.minimum(SEGMENT, begin + np.repeat(sizes, parts) - start)
    state = np.full((len(model.langs), len(doc)), model.dead, np.int64)
    later = np.flatnonzero(inner > 0)
    run_in = np.full(len(later), min(RUN_IN, SEGMENT))
    state[:, later] = phrases(model, symbols, start[later] - run_in, run_in, state[:, later])[1]
    count, end = phrases(model, symbols, start, size, state)
    for _ in range(ROUNDS):
        wrong = later[(end[:, later - 1] != state[:, later]).any(0)]
        if not len(wrong):
            break
        state[:, wrong] = end[:, wrong - 1]
        count[:, wrong], end[:, wrong] = phrases(model, symbols, start[wrong], size[wrong], state[:, wrong])
    wrong = later[(end[:, later - 1] != state[:, later]).any(0)]
    total = np.zeros((len(each), len(model.langs)), np.int64)
    for d in np.unique(doc[wrong]).tolist():  # as in texts of one long period, which the guesses never meet
        at = int(wrong[np.searchsorted(doc[wrong], d)])
        count[:, (doc == d) & (np.arange(len(doc)) >= at)] = 0
        total[d] += _by_itself(model, symbols[start[at] : begin[at] + sizes[d]].tolist(), end[:, at - 1].tolist())
    np.add.at(total, doc, count.T)
    return total


def bits_by_language(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bits for each text by language (texts by languages), and whether a text has a letter."""
    each = [blanks_once(model.symbol[code_points(t)]) for t in texts]
    letters = np.array([bool((e > 0).any()) for e in each], bool)
    return counts_by_language(model, each) * model.price, letters


def sampled(docs: DataFrame, learn: Column, rows: int = ROWS, stretch: int = STRETCH) -> DataFrame:
    """``lang, key, text``: labelled rows, or stretches of long ones, at most ``rows`` of each language. Staged."""
    usable = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    parts = F.greatest(F.ceil(F.char_length("text") / stretch), F.lit(1)).cast("int")
    usable = usable.select("lang", "doc_id", "text", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    own = F.when(F.col("part") == 0, F.xxhash64("doc_id")).otherwise(F.xxhash64("doc_id", "part"))
    key = [own, F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), F.xxhash64("text"), F.col("part")]
    usable = usable.select("lang", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)]).alias("key"), "text")
    order = F.dense_rank().over(Window.partitionBy("lang").orderBy("key"))
    picked = usable.select("lang", "key", order.alias("n")).where(F.col("n") <= rows).select("lang", "key").distinct()
    # The few that are picked are read again with their texts: the table's size decides whether it is broadcast.
    found = usable.join(staged(picked, "lang-sample"), ["lang", "key"])
    found = found.select("lang", "key", F.substring("text", F.col("key.k3") * stretch + 1, F.lit(stretch)).alias("text"))
    return staged(found.groupBy("lang", "key").agg(F.first("text").alias("text")), "lang-texts")


def sample_texts(docs: DataFrame, learn: Column, rows: int = ROWS) -> dict[str, list[str]]:
    """`sampled` texts by language, in order."""
    out: dict[str, list] = {}
    for r in sampled(docs, learn, rows).toLocalIterator():
        out.setdefault(r.lang, []).append((r["key"], r.text))
    return {k: [t for _, t in sorted(v)] for k, v in out.items()}


def predict(docs: DataFrame, model: Model | None, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, lang_pred, score, bits`` (a character, in the best language) of each row; reads the text only.

    ``row`` is a struct of the columns to carry.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    names = ["doc_id", "lang_pred", "score", "bits", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            lang, score, bits = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            at = 0
            while m is not None and at < len(texts):
                upto, n = at, 0
                while upto < len(texts) and (n < CHARS or upto == at):
                    n += len(texts[upto])
                    upto += 1
                total, letters = bits_by_language(m, texts[at:upto])
                best = np.argmin(total, 1)
                two = np.sort(total, 1)[:, :2]
                for i in np.flatnonzero(letters).tolist():
                    lang[at + i] = m.langs[best[i]]
                    score[at + i] = float((two[i, 1] - two[i, 0]) / two[i, 1]) if two.shape[1] > 1 else 1.0
                    bits[at + i] = float(two[i, 0] / max(1, len(texts[at + i])))
                at = upto
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64()), b.column(2)], names)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), carried(carry))
    return out.mapInArrow(tidied(run), f"doc_id long, lang_pred string, score double, bits double, row {out.schema['row'].dataType.simpleString()}")


def identify(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """Learns from the rows outside fold ``held`` and predicts all rows; adds ``held_out``."""
    fold = crc_of(F.col("doc_id")) % folds
    model = learned(sampled(docs, fold != held))
    return predict(docs, model).withColumn("held_out", fold == held)
