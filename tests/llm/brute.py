"""Plain single-machine versions of the operators, written from their contracts."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import xxhash


def line_dedup(rows):
    keys = defaultdict(set)
    norm = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    for doc, text in rows:
        for x in (text or "").split("\n"):
            if len(norm(x)) >= 20:
                keys[norm(x)].add(doc)
    out = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(keys.get(norm(x), ())) >= 3 and max(keys[norm(x)]) != doc)]
        out[doc] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def simhash(rows):
    fps = {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([b" ".join(words)] if words else [])
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps[doc] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    parent = {d: d for d in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    docs = sorted(fps)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: (f"{fps[d]:016x}", find(d)) for d in docs}


def byte_dedup(rows, length=100):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            k = data[s : s + length]
            if k in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(k)
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def quality(rows):
    out = {}
    for doc, text in rows:
        words = (text or "").encode().split()
        wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        count = Counter(wins)
        hit = set()
        for i, w in enumerate(wins):
            if count[w] > 1:
                hit |= set(range(i, i + 8))
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        out[doc] = (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))
    return out


def contamination(docs, items, window=10):
    import re

    low = {i: i + 32 for i in range(65, 91)}
    toks = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    wins = defaultdict(set)
    for item, t in items:
        w = toks(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[i : i + window])].add(str(item))
    sizes = {len(k) for k in wins}
    out = {}
    for doc, t in docs:
        w = toks(t)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                k = tuple(w[i : i + n])
                if k in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[k]
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


def pii(text):
    import re

    def luhn(ds):
        return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(ds))) % 10 == 0

    digits = lambda m: re.sub(r"[^0-9]", "", m)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return {k: [m.span() for m in re.finditer(p, text or "") if ok(m.group())] for k, p, ok in kinds}
