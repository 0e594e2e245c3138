"""The near-duplicate stage against components of exact Jaccard similarities."""

from __future__ import annotations

import random

from marquetry.llm import simhash_wide


def exact(rows, shingle=5, similarity=0.8):
    sets = {}
    for k, text in rows:
        words = (text or "").encode().lower().split()  # of bytes: A-Z and the six blanks only
        sets[k] = {tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common >= similarity * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


def found(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in simhash_wide.near_duplicates(docs, **more).collect()}


def test_pairs_below_the_similarity_stay_apart(spark):
    """Edits that leave similarities of 0.69 and 0.82, of which the bits tell little."""
    r, rows = random.Random(1), []
    for i in range(30):
        words = [f"w{r.randrange(3000)}" for _ in range(300)]
        rows.append((2 * i, " ".join(words)))
        for at in range(10, 300, 26 if i % 2 else 50):
            words[at] = "edited"
        rows.append((2 * i + 1, " ".join(words)))
    want = exact(rows)
    assert len(set(want.values())) == 45
    assert found(spark, rows) == want


def test_appended_and_truncated_copies(spark):
    """Copies with new text behind and copies cut short change the set of words, and stay similar."""
    r, rows = random.Random(2), []
    for i in range(40):
        size = r.choice([30, 100, 400])
        words = [f"w{int(3000 ** r.random())}" for _ in range(size)]
        more = [f"new{i}_{j}" for j in range(int(size * 0.18))]
        rows.append((2 * i, " ".join(words)))
        rows.append((2 * i + 1, " ".join(words + more if i % 2 else words[: int(size * 0.84)])))
    want = exact(rows)
    assert len(set(want.values())) == 40
    assert found(spark, rows) == want
    assert found(spark, rows, hot=1, sample=1, parts=3) == want


def test_interleaved_texts_of_the_same_shingles(spark):
    """Copies that meet only texts that are less similar, as their neighbours in every bucket."""
    r, rows, near = random.Random(3), [], (9, 14, 19)
    base = [f"w{r.randrange(3000)}" for _ in range(300)]
    for i in range(20):
        words = list(base)
        for at in r.sample(range(10, 290), 3 if i in near else 9):
            words[at] = f"edit{i}_{at}"
        rows.append((i, " ".join(words)))
    want = exact(rows)
    assert want == {i: 9 if i in near else i for i in range(20)}
    assert found(spark, rows) == want
    assert found(spark, rows, hot=1, sample=1, parts=3, small=2) == want


def test_rows_of_repeated_and_null_ids(spark):
    """Each group keeps one row; texts that only share an id, or have none, are no copies."""
    long, other = " ".join(f"a{i}" for i in range(100)), " ".join(f"b{i}" for i in range(100))
    near = long + " end"
    rows = [(1, long), (5, long), (5, other), (5, other), (None, near), (None, "alone here"), (None, "alone here"), (7, other.upper()), (8, None), (9, "  "), (None, None), (3, near)]
    docs = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, node string").repartition(3)
    kept = simhash_wide.representatives(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"], r["node"]) for r in kept.collect()), key=str)
    assert got == sorted([(1, long, "z"), (5, other, "z"), (None, "alone here", "z"), (8, None, "z")], key=str)
    again = simhash_wide.representatives(docs.where("doc_id = 5 OR doc_id IS NULL")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in again if r["text"]) == [(0, "alone here"), (5, long), (5, other)]
    assert simhash_wide.representatives(docs.where("false")).count() == 0


def test_large_sketches_promise_no_more_than_sets():
    """They differ in no more bits than the sets in members, also when they are of different lengths, and in few fewer."""
    import numpy as np

    r = np.random.default_rng(5)
    for n, m in ((3, 2), (300, 330), (4000, 5000), (500, 4000)):
        a = r.integers(0, 1 << 63, n, np.uint64)
        b = np.concatenate((a[: n // 2], r.integers(0, 1 << 63, m - min(n // 2, m), np.uint64)))
        apart = len(set(a.tolist()) ^ set(b.tolist()))
        got = simhash_wide.differing(simhash_wide.large_sketch(a), simhash_wide.large_sketch(b))
        assert got <= apart and (n < m / 2 or got > apart / 4)


def test_fingerprints_find_the_first_pairs(spark, monkeypatch):
    """Sets at two bits or fewer of SimHash are compared first, and what these connect is not looked for by prefixes."""
    import numpy as np

    r, rows = random.Random(7), []
    for i in range(12):
        words = [f"w{r.randrange(3000)}" for _ in range(400)]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(words + ["end"])), (3 * i + 2, " ".join(words[5:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    each = simhash_wide.signatures(docs).select("id.doc_id", "fp").collect()
    for x in each:
        bits = np.unpackbits(simhash_wide.shingle_hashes(dict(rows)[x["doc_id"]].encode()).astype(">u8").view(np.uint8)).reshape(-1, 64)
        assert x["fp"] & (1 << 64) - 1 == int("".join(map(str, (2 * bits.sum(0) > len(bits)).astype(int))), 2)
    of = {x["doc_id"]: x["fp"] & (1 << 64) - 1 for x in each}
    near = {(a, b) for a in of for b in of if b < a and (of[a] ^ of[b]).bit_count() <= 2}
    classes = spark.createDataFrame([(k, v - (1 << 64) if v >> 63 else v) for k, v in of.items()], "node long, fp long")
    firsts = {v: min(k for k in of if of[k] == v) for v in of.values()}
    got = {(x["node"], x["other"]) for x in simhash_wide.alike(classes).collect()}
    assert got and got <= near and {(max(p), min(p)) for a, b in near if (p := (firsts[of[a]], firsts[of[b]]))[0] != p[1]} <= got
    looked: list[set] = []
    whole = simhash_wide.still_apart
    monkeypatch.setattr(simhash_wide, "still_apart", lambda pairs, roots: looked.append((pairs.count(), whole(pairs, roots).count())) or whole(pairs, roots))
    assert found(spark, rows) == exact(rows)
    assert looked[0][1] < looked[0][0]
