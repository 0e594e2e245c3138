"""Operators against plain versions: on the smallest tables, and on rows made to break them."""

from __future__ import annotations

import base64
import hashlib
import math
import os
import random
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from marquetry.llm import bytespans, ctw, decontaminate, langid, linededup, mixing, pii, quality, simhash, warc
from marquetry.llm.common import crc_of
from marquetry.llm.queries import QUERIES

from . import brute

SF = "/root/testdata/sf0.001"
LONG = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf again "
SHARED = "A line that many documents share, word for word."

#: Null and empty texts, ties, repeats, marks, very long words and texts, lines that repeat; names that clash with the operators' own.
ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, "   \n\t \x0b", "en", "a"),
    (4, LONG * 3, "en", "a"),
    (5, LONG * 3, "en", None),
    (6, f"{SHARED}\nown words here\n{SHARED}", "en", "b"),
    (7, f"  {SHARED.upper()}\t\nanother", "en", "b"),
    (8, f"{SHARED}\n\n\nÀÉÎ ünïcödé 漢字 текст", None, "b"),
    (9, "x" * 5000, "de", "c"),
    (10, "word " * 3000, "de", "c"),
    (11, "a@b.co, +1 (555) 010-9999; 10.0.0.256 10.0.0.25 4111 1111 1111 1111", "de", "c"),
    (12, "12345 67890 !!! ###", "fr", "c"),
    (13, " ".join(f"w{i}" for i in range(400)), "fr", ""),
    (14, " ".join(f"w{i}" for i in range(400)) + " tail", "fr", ""),
    (15, " a b\r\nc\x85", "es", ""),
    (10**15, LONG * 3 + "z", "es", "d"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    clash = {"h": "1", "fp": "2", "size": "3", "bits": "4", "row": "5", "items": "6", "spans": "7", "n_words": "8", "drops": "9", "fold": "10", "unit": "11", "token": "12", "keeper": "13"}
    return df.select("*", *[F.lit(v).alias(k) for k, v in clash.items()]).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="module")
def docs(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return spark.read.parquet(f"{SF}/documents.parquet").repartition(5)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


BOTH = pytest.mark.parametrize("which", ["odd", "docs"])


@BOTH
def test_quality(request, which):
    df = request.getfixturevalue(which)
    want = brute.quality(rows_of(df))
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert {k: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for k, r in got.items()} == want
    for k, r in got.items():
        assert r["base_failed"] == (want[k][0] < 20 or 100 * want[k][4] > 30 * want[k][0])
        assert not (r["kept"] and r["base_failed"])


@BOTH
def test_line_dedup(request, which):
    df = request.getfixturevalue(which)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in linededup.dedup_lines(df).collect()}
    assert got == brute.line_dedup(rows_of(df))


@BOTH
def test_simhash(request, which):
    df = request.getfixturevalue(which)
    got = {r["doc_id"]: (f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert got == brute.simhash(rows_of(df))


def test_simhash_links_through_chains(spark):
    """Fingerprints a bit or two apart connect, three apart don't; a long chain is one component."""
    fps = [0]
    for i in range(20):
        fps.append(fps[-1] | 3 << (2 * i))
    lone = 0b111 << 60
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in [*fps, lone]], "fp long")
    from marquetry.llm.components import connected_components

    got = {r["node"]: r["root"] for r in connected_components(simhash.links(df)).collect()}
    assert len(set(got.values())) == 1 and len(got) == 20 and lone - (1 << 64) not in got


@pytest.mark.parametrize("hot", [0, 100])
@pytest.mark.parametrize("segments", [1, 2, 3, 8])
def test_simhash_segments(spark, segments, hot):
    """Segments change what is asked for, not what is found; some that meet are too far apart."""
    r = random.Random(9)
    fps = {0}
    for base in [r.getrandbits(64) for _ in range(6)]:
        fps |= {base ^ sum(1 << b for b in r.sample(range(64), r.randrange(6))) for _ in range(25)}
    signed = {x - (1 << 64) if x >> 63 else x for x in fps}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")

    def least(edges):
        parent = {x: x for x in signed}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        return {x: find(x) for x in signed}

    close = {(a, b) for a in signed for b in signed if a > b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert least(tuple(x) for x in simhash.links(df, segments, hot).collect()) == least(close)
    asked = {(x["segment"], x["key"], x["flipped"], x["fp"]) for x in simhash.probes(df, segments).collect()}
    sizes = Counter(x[:2] for x in asked if not x[2])
    met = spark.createDataFrame([(f, s, k, z, sizes[s, k]) for s, k, z, f in asked if sizes[s, k]], "fp long, segment byte, key long, flipped boolean, n long")
    pairs = {(max(x), min(x)) for x in simhash.candidates(met, 10**6).collect()}
    assert close <= pairs and (segments == 1) == (close == pairs)


@BOTH
def test_byte_spans(request, which):
    df = request.getfixturevalue(which)
    out = bytespans.dedup_bytes(df).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in out}
    assert got == brute.byte_dedup(rows_of(df))


@pytest.mark.parametrize("seed", range(4))
def test_byte_spans_of_edited_copies(spark, monkeypatch, seed):
    """Copies with edits, over pieces and blocks that are far smaller than texts."""
    r = random.Random(seed)
    monkeypatch.setattr(bytespans, "PIECE", 300)
    monkeypatch.setattr(bytespans, "BLOCK", 20)
    base = ["".join(r.choice("abcdé ") for _ in range(r.randrange(50, 900))) for _ in range(4)]
    rows = []
    for i in range(14):
        t = r.choice(base)
        a, z = sorted((r.randrange(len(t)), r.randrange(len(t))))
        rows.append((i, t[:a] + "#" * r.randrange(3) + t[a:z] * r.randrange(1, 3) + t[z:]))
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"]) for x in bytespans.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {k: v[:3] for k, v in brute.byte_dedup(rows).items()}


def test_suffix_classes():
    """The order that dictionary and parse combine into is that of the suffixes, and its classes are equal strings."""
    import numpy as np

    r = random.Random(3)
    words = [bytes(r.choice(b"ab\0\xff") for _ in range(r.randrange(1, 90))) for _ in range(6)]
    stretches = [b"".join(r.choice(words) for _ in range(12)) + b"x" * r.randrange(120) for _ in range(8)]
    size = np.array([len(x) for x in stretches])
    base = np.cumsum(size) - size
    data = b"".join(stretches)
    at = np.concatenate([np.arange(b, b + n - 99) for b, n in zip(base, size, strict=True)])
    flat = np.frombuffer(data, np.uint8)
    parse = bytespans.PrefixFreeParse(flat, base, size, 100)
    assert len(parse.dictionary) < len(parse.parse)
    order, new = bytespans.suffix_classes(flat, base, size, at)
    strings = [data[p : p + 100] for p in at[order]]
    assert strings == sorted(strings)
    assert new.tolist() == [i == 0 or strings[i] != strings[i - 1] for i in range(len(strings))]


@pytest.mark.parametrize("seed", range(3))
def test_byte_spans_of_repeated_and_null_ids(spark, seed):
    """Rows that share an id, or have none, are documents of their own: one order of them gives the result."""
    import itertools

    r = random.Random(seed)
    t, u = ("".join(r.choice("abc ") for _ in range(300)) for _ in range(2))
    rows = [(1, t), (1, t), (1, u[:150] + t[:140]), (None, t + t), (None, u), (-1, u), (7, t), ((1 << 63) - 1, u + "z"), (2, "short"), (2, "short"), (None, None), (None, t + t)]
    got = Counter((x["doc_id"], bytes(x["kept"]), x["n_bytes"], x["n_removed"], x["n_spans"]) for x in bytespans.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())

    def plain(ordered):
        seen, out = set(), Counter()
        for doc, text in ordered:
            data = (text or "").encode()
            gone = bytearray(len(data))
            for s in range(len(data) - 99):
                if data[s : s + 100] in seen:
                    gone[s : s + 100] = b"\1" * 100
                seen.add(data[s : s + 100])
            out[doc, bytes(x for x, g in zip(data, gone, strict=True) if not g), len(data), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))] += 1
        return out

    groups = [list(g) for _, g in itertools.groupby(sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)), key=lambda x: x[0])]
    assert any(got == plain(itertools.chain(*o)) for o in itertools.product(*[list(itertools.permutations(g)) for g in groups]))


@pytest.mark.parametrize(("block", "shard"), [(decontaminate.BLOCK, decontaminate.SHARD), (7, 50)])
def test_decontamination(spark, odd, block, shard):
    items = [("i1", LONG), ("i2", "own WORDS, here!"), ("i3", None), ("i4", "..."), ("i5", " ".join(f"w{i}" for i in range(90, 130))), ("i2b", "own words here"), ("i6", "漢字 текст")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    odd = odd.unionByName(odd)
    out = decontaminate.contamination(odd, bench, block=block, shard=shard).collect()
    assert len(out) == 2 * len(ODD)
    got = {r["doc_id"]: (r["n_words"], sum(s["last"] - s["first"] for s in r["spans"]), len(r["items"]), hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest()) for r in out}
    assert got == brute.contamination(rows_of(odd), items)
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(odd, bench).collect()}
    assert "w100" not in cut[13] and "w89" in cut[13] and cut[9] == "x" * 5000
    assert all(v[1] == 0 for v in brute.contamination(list(cut.items()), items).values())
    none = decontaminate.contamination(odd, bench.where("false")).collect()
    assert all(not r["items"] and not r["spans"] for r in none) and {r["doc_id"]: r["n_words"] for r in none} == {k: v[0] for k, v in got.items()}


def test_decontamination_of_documents(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    out = decontaminate.contamination(docs, bench).collect()
    got = {r["doc_id"]: (r["n_words"], sum(s["last"] - s["first"] for s in r["spans"]), len(r["items"])) for r in out}
    want = brute.contamination(rows_of(docs), [(r["item_id"], r["text"]) for r in bench.collect()])
    assert got == {k: v[:3] for k, v in want.items()}


def test_fm_index():
    import numpy as np

    r = random.Random(5)
    s = np.array([r.randrange(1, 6) for _ in range(500)] * 2 + [0])
    index = decontaminate.FMIndex(s, 6)
    text = s.tolist()
    for n in (1, 2, 5, 9):
        codes = np.array([text[i : i + n] for i in range(0, 60, 7)])
        low, high = index.search(codes, np.full(len(codes), n))
        for c, a, z in zip(codes.tolist(), low, high, strict=True):
            want = [i for i in range(len(text) - n + 1) if text[i : i + n] == c]
            assert sorted(index.locate(np.arange(a, z)).tolist()) == want


@BOTH
def test_pii(request, which):
    df = request.getfixturevalue(which)
    out = {r["doc_id"]: r for r in pii.personal_data(df).collect()}
    for doc, text in rows_of(df):
        want = brute.pii(text)
        base = ",".join(f"{k}:{a}:{z}" for k in pii.BASE for a, z in want[k])
        r = out[doc]
        assert [r[f"n_{k}"] for k in pii.BASE] == [len(want[k]) for k in pii.BASE]
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert r["spans"].startswith(base)


def test_pii_on_random_texts():
    automaton, r = pii.anchors(), random.Random(1)
    for _ in range(20_000):
        s = "".join(r.choice("a1.@+-( )23 9b:=é") for _ in range(r.randrange(40)))
        found = pii.find_spans(s, automaton)
        assert {k: found[k] for k in pii.BASE} == brute.pii(s)


def test_pii_extra_kinds():
    found = pii.find_spans('IBAN: DE89 3704 0044 0532 0130 00 and token = "f33e61083db5dbdf4bd2369d" at https://user:pw@host.example/x', pii.anchors())
    assert (len(found["account"]), len(found["secret"]), len(found["userinfo"])) == (1, 1, 1)
    text = "write to a.b@c.org or +49 30 1234567"
    assert pii.mask(text, pii.find_spans(text, pii.anchors())) == "write to <email> or <phone>"


def test_language_held_out_accuracy(docs):
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in out) >= 0.95 * len(out)
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in out)


def test_language_of_odd_texts(odd):
    got = {r["doc_id"]: r for r in langid.identify(odd).collect()}
    assert len(got) == len(ODD)
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (1, 2, 3, 12))
    assert all(got[k]["lang_pred"] in {"en", "de", "fr", "es"} for k in (4, 8, 9, 13))


def greedy_phrases(sample: str, text: str) -> int:
    """Phrases of greedy longest matches, by looking them up in the sample."""
    count = at = 0
    while at < len(text):
        size = 1
        while at + size <= len(text) and text[at : at + size] in sample:
            size += 1
        at += max(1, size - 1)
        count += 1
    return count


def langid_text(text: str) -> str:
    return "".join(" " if not c.isalpha() else c.lower() if len(c.lower()) == 1 else c for c in text)


def squeezed(text: str) -> str:
    import re

    return re.sub(" +", " ", langid_text(text))


@pytest.mark.parametrize("segment", [5, 64, langid.SEGMENT])
def test_suffix_automaton_and_phrases(monkeypatch, segment):
    """Greedy longest matches whatever the stretches, also where guesses of a stretch's first state fail."""
    monkeypatch.setattr(langid, "SEGMENT", segment)
    monkeypatch.setattr(langid, "RUN_IN", 3)
    r = random.Random(2)
    samples = {"x": ["".join(r.choice("abc ") for _ in range(300)), "ab" * 40], "y": ["".join(r.choice("abé") for _ in range(200))]}
    model = langid.build(samples)
    trained = ["".join(" " + squeezed(t) for t in v) for v in samples.values()]
    texts = ["".join(r.choice("abcdé ") for _ in range(n)) for n in (1, 7, 40, 200, 900)] + ["ab" * 500, "aab" * 333, "z" * 30, "c"]
    got = langid.counts_by_language(model, [langid.blanks_once(model.symbol[langid.code_points(t)]) for t in texts])
    assert got.tolist() == [[greedy_phrases(s, squeezed(t)) for s in trained] for t in texts]


def plain_language(samples: dict, text: str):
    """The language and score of a text, by greedy parses in the samples themselves."""
    trained = {k: "".join(" " + squeezed(t) for t in v) for k, v in sorted(samples.items()) if any(c.isalpha() for t in v for c in t)}
    if not trained or not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    bits = sorted((greedy_phrases(s, squeezed(text)) * math.log2(max(4, len(s))), i, k) for i, (k, s) in enumerate(trained.items()))
    return bits[0][2], (bits[1][0] - bits[0][0]) / bits[1][0] if len(bits) > 1 else 1.0


@BOTH
def test_language_of_every_row(request, which):
    """Predictions and scores against plain parses, on odd rows and on texts of the smallest table."""
    df = request.getfixturevalue(which)
    if which == "docs":
        df = df.where("doc_id < 40 AND length(text) < 3000 OR lang <> 'en'").limit(60)
    rows = df.select("doc_id", "text", "lang").collect()
    df = df.sparkSession.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = langid.sample_texts(df, crc_of(F.col("doc_id")) % 3 != 1)
    learned = {}
    for doc, text, lang in rows:
        if text is not None and lang is not None and crc32(str(doc).encode()) % 3 != 1:
            learned.setdefault(lang, []).append(text)
    assert {k: len(v) for k, v in samples.items()} == {k: min(langid.ROWS, len(v)) for k, v in learned.items()}
    assert all(set(v) <= set(learned[k]) for k, v in samples.items())
    got = {x["doc_id"]: x for x in langid.identify(df).collect()}
    for doc, text, _ in rows:
        lang, score = plain_language(samples, text)
        assert (got[doc]["lang_pred"], got[doc]["score"]) == (lang, pytest.approx(score))


def test_long_rows_and_the_empty_label_are_learned(spark):
    """A language of one very long row among short ones of others, and one whose name is empty."""
    rows = [(i, "der die das und nicht " * 3, "de", "a") for i in range(0, 60, 3)] + [(600, "kalo mano tiro peku " * 3000, "xx", "a"), (603, "zug zag zog " * 9, "", "a")]
    rows += [(601, "mano tiro kalo peku", "de", "a"), (604, "zog zag zug", "de", "a")]
    df = spark.createDataFrame([r for r in rows if crc32(str(r[0]).encode()) % 3 != 1 or r[0] in (601, 604)], "doc_id long, text string, lang string, source string")
    assert {600, 603} <= {r["doc_id"] for r in df.collect()}
    df = df.withColumn("lang", F.when(~F.col("doc_id").isin(601, 604), F.col("lang")))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df).collect()}
    assert got[601] == "xx" and got[604] == ""


def test_large_alphabets(spark):
    """Four languages of thousands of letters each: the model stays small."""
    r = random.Random(6)
    samples = {k: ["".join(chr(0x3400 + 4000 * i + int(4000 * r.random() ** 2)) for _ in range(2500)) for _ in range(8)] for i, k in enumerate("abcd")}
    model = langid.build(samples)
    assert model.table.nbytes + model.first.nbytes + model.symbol.nbytes < 32 << 20
    total, _ = langid.bits_by_language(model, [samples["c"][0][100:400]])
    assert total.argmin() == 2


def test_lm_base_score(docs):
    rows = rows_of(docs)
    out = ctw.score(docs).collect()
    counts = Counter()
    for doc, text in rows:
        if crc32(str(doc).encode()) % 7 != 2:
            counts.update((text or "").encode().lower().split())
            counts[b" "] += 1
    total, distinct = sum(counts.values()), len(counts)
    texts = dict(rows)
    for r in out:
        words = [*(texts[r["doc_id"]] or "").encode().lower().split(), b" "]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(words), sum(counts[w] > 0 for w in words), total, crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words))
    held = [-r["score"] / math.log10(2) / (len((texts[r["doc_id"]] or "").encode()) + 1) for r in out if r["held_out"]]
    assert sorted(held)[len(held) // 2] < 3  # bits a byte; text of letters alone has more than four


@pytest.mark.parametrize(("unit", "piece"), [(ctw.UNIT, ctw.PIECE), (12, 5)])
def test_ctw_equals_the_recursion(spark, monkeypatch, unit, piece):
    """Scores of all texts, against the textbook recursion over a tree of counts, whatever the units."""
    monkeypatch.setattr(ctw, "UNIT", unit)
    monkeypatch.setattr(ctw, "PIECE", piece)
    texts = ["abab abba", "baab", "", "aé", "abba", "zz", "éa", "abab abab abab", "b\0b", "abba"]
    rows = list(enumerate(texts))
    held = {i for i, _ in rows if crc32(str(i).encode()) % 7 == 2}
    assert held and len(held) < len(rows)
    counts: dict = {}
    symbols = lambda t: [((b"\0" * ctw.DEPTH + t.encode() + b"\xff")[: i + ctw.DEPTH], b) for i, b in enumerate(t.encode() + b"\xff")]
    context = lambda before, d: before[len(before) - d :]

    def nodes(byte):
        node = 1
        for k in range(7, -1, -1):
            bit = byte >> k & 1
            yield node, bit
            node = 2 * node + bit

    for i, t in rows:
        for before, byte in symbols(t) if i not in held else ():
            for node, bit in nodes(byte):
                for d in range(ctw.DEPTH + 1):
                    counts.setdefault((node, context(before, d)), [0, 0])[bit] += 1

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def log_pw(node, ctx):
        own = log_kt(*counts.get((node, ctx), (0, 0)))
        if len(ctx) == ctw.DEPTH:
            return own
        rest = sum(log_pw(node, c) for n, c in list(counts) if n == node and len(c) == len(ctx) + 1 and c.endswith(ctx))
        return max(own, rest) + math.log1p(math.exp(-abs(own - rest))) - math.log(2)

    def mixed(node, before, d):
        a, b = counts.get((node, context(before, d)), (0, 0))
        p = (b + 0.5) / (a + b + 1)
        if d == ctw.DEPTH:
            return p
        w = math.exp(log_kt(a, b) - math.log(2) - log_pw(node, context(before, d)))
        return w * p + (1 - w) * mixed(node, before, d + 1)

    got = {r["doc_id"]: r["score"] for r in ctw.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    for i, t in rows:
        want = sum(math.log10(p if bit else 1 - p) for before, byte in symbols(t) for node, bit in nodes(byte) for p in [mixed(node, before, 0)])
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_lm_of_odd_texts(odd, none):
    got = {r["doc_id"]: r for r in ctw.score(odd).collect()}
    assert len(got) == len(ODD) and got[1]["n_tokens"] == 1 and got[10]["n_tokens"] == 3001
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got.values())


def targets_by_rounds(sizes: dict):
    """Shares by weight; what is over a cap goes round again."""
    names = sorted((k for k in sizes if k is not None), key=lambda k: [ord(c) for c in k]) + ([None] if None in sizes else [])
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    out, rest, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        share = rest / sum(weight[k] for k in open_)
        full = {k for k in open_ if share * weight[k] >= 2 * sizes[k]}
        if not full:
            return out | {k: share * weight[k] for k in open_}
        for k in full:
            out[k] = 2.0 * sizes[k]
            rest -= out[k]
        open_ -= full
    return out


@BOTH
def test_mixing(request, which):
    df = request.getfixturevalue(which)
    out = mixing.mix(df).collect()
    sizes = Counter()
    for r in out:
        sizes[r["source"]] += r["size"]
    want = targets_by_rounds(dict(sizes))
    taken, largest = Counter(), Counter()
    for r in out:
        assert r["target"] == pytest.approx(want[r["source"]], abs=1e-6) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for k in sizes:
        assert abs(taken[k] - want[k]) <= largest[k]
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in out}


def test_many_sources_are_put_in_order_over_ranges(odd, monkeypatch):
    """The same rows whether one task sums the sources or ranges of them do."""
    rows = sorted((tuple(r) for r in mixing.mix(odd).collect()), key=str)
    monkeypatch.setattr(mixing, "FEW", 0)
    assert sorted((tuple(r) for r in mixing.mix(odd).collect()), key=str) == rows


PAGES = [
    (1, "http://www.b.example.com:8080/x?q=1#f", "<p>a</p>"),
    (2, "http://a.example.com/", "<p>a</p>"),
    (3, None, None),
    (4, "not a url\nat all", ""),
    (5, "http://a.example.com/", "é\r\n\r\nmore"),
    (6, "http://[bad", "<p>a</p>"),
]


def test_warc_round_trip(spark):
    rows = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("key", F.lit("x")).withColumn("d", F.lit("y")).repartition(3)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive(rows).collect()}
    payloads = {p: (h or "").encode() for p, _, h in PAGES}
    last = {v: max(k for k in payloads if payloads[k] == v) for v in payloads.values()}
    for p, data in payloads.items():
        top = last[data]
        assert got[p] == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if p == top else "revisit", None if p == top else top)


def test_warc_lookup_finds_only_what_is_asked(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 3)
    rows = spark.createDataFrame([(i, f"http://h{i % 7}.example.org/p{i}", f"<b>{i}</b>") for i in range(50)], "page_id long, url string, html string").repartition(4)
    folder = str(tmp_path / "warc")
    index = warc.build_index(warc.write_archives(rows, folder))
    assert index.count() >= 17
    keys = spark.createDataFrame([(f"{warc.surt('http://h3.example.org/p10')} 10",), ("nothing",)], "key string")
    found = warc.read_back(index, keys, folder, payloads=True).collect()
    assert [(r["page_id"], r["payload"]) for r in found] == [(10, b"<b>10</b>")]


def test_surt():
    assert warc.surt("https://www.Example.com:443/a?b") == "com,example)/a?b"
    assert warc.surt("http://x.org:81") == "org,x:81)/"
    assert warc.surt(None) == ")/"


def test_warc_of_no_pages(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_empty_tables(spark, none):
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (
        quality.judge(none), linededup.dedup_lines(none), simhash.near_duplicates(none), bytespans.dedup_bytes(none), decontaminate.contamination(none, items),
        pii.personal_data(none), langid.identify(none), ctw.score(none), mixing.mix(none),
    ):
        assert out.count() == 0


#: Operators and the columns that tell a row's result, of rows ``doc_id, text, lang, source``.
BY_ROW = {
    "quality": lambda d: quality.judge(d).select("doc_id", "n_words", "n_dup_lines", "n_repeat_words", "kept"),
    "lines": lambda d: linededup.dedup_lines(d).select("doc_id", "text", "n_dropped"),
    "simhash": lambda d: simhash.near_duplicates(d).select("doc_id", "fp", "component_id"),
    "pii": lambda d: pii.personal_data(d).select("doc_id", "spans"),
    "language": lambda d: langid.identify(d).select("doc_id", "lang_pred", "score"),
    "words": lambda d: ctw.score(d).select("doc_id", "held_out", "n_tokens", "n_known"),
    "sizes": lambda d: mixing.mix(d).select("doc_id", "source", "size"),
}


@pytest.mark.parametrize("name", BY_ROW)
def test_repeated_rows(odd, name):
    """Each of two equal rows gets the result that one alone gets."""
    once = Counter(map(tuple, BY_ROW[name](odd).collect()))
    assert Counter(map(tuple, BY_ROW[name](odd.unionByName(odd)).collect())) == {k: 2 * n for k, n in once.items()}


@pytest.mark.parametrize("name", BY_ROW)
def test_rows_without_an_id(spark, name):
    """Rows without an id are judged as others are; a component has the least id there is."""
    rows = [(None, LONG * 3, "en", "a"), (None, LONG * 3, "en", "a"), (4, LONG * 3, "en", "a"), (None, "Something else, alone.", "de", None), (None, None, None, None), (5, "vierte Zeile", "de", "b")]
    got = [tuple(r) for r in BY_ROW[name](spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()]
    assert len(got) == len(rows) and sum(r[0] is None for r in got) == 4
    if name not in ("words", "lines"):  # folds go by id, and so do kept lines
        assert len({r[1:] for r in got if r[1:] == next(x[1:] for x in got if x[0] == 4)}) == 1
        assert sum(r[1:] == next(x[1:] for x in got if x[0] == 4) for r in got) >= 3


def test_repeated_pages(spark):
    """Of equal payloads each row with the largest id is a response, and every row comes back once."""
    rows = spark.createDataFrame([*PAGES, *PAGES, (None, "http://x", "<p>a</p>"), (None, "http://x", "alone"), (None, "http://x", "alone")], "page_id long, url string, html string").repartition(3)
    got = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archive(rows).collect())
    want = {p: (None if h != "<p>a</p>" or p == 6 else 6) for p, _, h in PAGES} | {3: 4}
    assert got == {(p, "response" if to is None else "revisit", to): 2 for p, to in want.items()} | {(None, "revisit", 6): 1, (None, "response", None): 2}


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_large_groups_are_weighted_in_pieces(monkeypatch):
    """The same mixtures and evidence whatever the pieces, which part no context of three bytes."""
    import numpy as np

    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 14, 3000)) * 37 % (1 << 24) | (0x6162 << 24)
    keys = rng.permutation(np.unique(keys))
    n = rng.integers(0, 4, len(keys))
    whole = ctw._mixture(keys, n, 2)
    for size in (1, 500, 1 << 16):
        monkeypatch.setattr(ctw, "SLICE", size)
        ordered = np.sort(keys)
        pieces = [ordered[s] for s in ctw._whole_contexts(ordered)]
        assert np.array_equal(np.concatenate(pieces), ordered)
        assert all(a[-1] >> 16 != b[0] >> 16 for a, b in zip(pieces, pieces[1:]))
        got = ctw.group_mixture(keys, n)
        assert all(np.allclose(a, b, rtol=1e-12) for a, b in zip(whole, got, strict=True))
