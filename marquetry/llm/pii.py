"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, schemes and identifier cues. From
each anchor a deterministic parser expands to the bounds of a candidate and validates it. Base kinds are
email, ip, card and phone; their spans are those of the leftmost non-overlapping matches of

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)        parts at most 255
    card   [0-9]([\\x20-]?[0-9])+                        13 to 19 digits that pass Luhn
    phone  \\+[0-9][\\x20().0-9-]+[0-9]                   9 to 15 digits

where a match that fails its check is dropped and not tried again. Beyond them come account (an IBAN that
passes its check digits), secret (a quoted or bare value of 16 characters or more, with a digit, after a
cue and = or :) and userinfo (a URL with a name before its host). Spans of a kind never overlap: each kind goes on
behind its last match, so a text takes time in proportion to its length.

Defined results: a null text is empty; spans are in code points, end exclusive; a null doc_id is kept as it is; repeated
rows are judged one by one; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidied

BASE = ("email", "ip", "card", "phone")
EXTRA = ("account", "secret", "userinfo")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "sftp://")
CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key")
ACCOUNT_CUES = ("iban",)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]+")
_VALUE = re.compile(r"[\"']?\x20?[=:]\x20?[\"']?([A-Za-z0-9+/_.=-]{16,})")
_IBAN = re.compile(r"[\x20:]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_USERINFO = re.compile(r"[A-Za-z0-9._%+-]+(?::[^\s@/]*)?@[A-Za-z0-9.-]+")


def anchors() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for x in "@+0123456789":
        out.add_word(x, (x if x in "@+" else "0", 1))
    for kind, words in (("s", SCHEMES), ("c", CUES), ("a", ACCOUNT_CUES)):
        for w in words:
            for form in {w, w.upper(), w.capitalize()}:
                out.add_word(form, (kind, len(form)))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def iban(text: str) -> bool:
    code = text.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def find_spans(text: str, automaton: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in order of their starts."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE + EXTRA}
    email = ip = card = digits = phone = secret = account = userinfo = 0  # where the last match of each kind ended
    for last, (kind, n) in automaton.iter(text):
        if kind == "0":
            if last < digits:
                continue
            digits = _DIGIT.match(text, last).end()
            if last >= ip and (m := _IP.match(text, last)):
                ip = m.end()
                if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
                    out["ip"].append(m.span())
            if last >= card and (m := _CARD.match(text, last)):
                card = m.end()
                if card - last >= 13:
                    bare = m.group().replace(" ", "").replace("-", "")
                    if 13 <= len(bare) <= 19 and luhn(bare):
                        out["card"].append(m.span())
        elif kind == "@":
            start = last
            while start > email and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                email = m.end()
                out["email"].append((start, email))
        elif kind == "+":
            if last >= phone and (m := _PHONE.match(text, last)):
                phone = m.end()
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out["phone"].append(m.span())
        elif kind == "c":
            if last >= secret and (m := _VALUE.match(text, last + 1)):
                secret = m.end()  # a part of a value without digits has none either
                if _DIGIT.search(text, *m.span(1)):
                    out["secret"].append(m.span(1))
        elif kind == "a":
            if last >= account and (m := _IBAN.match(text, last + 1)):
                parts = m.group(1)
                for size in range(len(parts), 14, -1):  # the account ends where its check digits hold
                    if parts[size - 1] != " " and iban(parts[:size]):
                        account = m.start(1) + size
                        out["account"].append((m.start(1), account))
                        break
        elif last >= userinfo and (m := _USERINFO.match(text, last + 1)):
            userinfo = m.end()
            out["userinfo"].append((last + 1 - n, userinfo))
    return out


def spans_text(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k in kinds for a, z in sorted(set(found[k])))


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of each row, counts of the other kinds, and ``n_spans`` of all."""
    small_batches(docs.sparkSession)
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", *(f"n_{k}" for k in EXTRA), "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for b in batches:
            found = [find_spans(t or "", automaton) for t in b.column(1).to_pylist()]
            base, extra = ([pa.array([len(f[k]) for f in found], pa.int64()) for k in kinds] for kinds in (BASE, EXTRA))
            total = pa.array([sum(map(len, f.values())) for f in found], pa.int64())
            sha = pa.array([hashlib.sha256(spans_text(f, BASE).encode()).hexdigest() for f in found], pa.string())
            spans = pa.array([spans_text(f, BASE + EXTRA) for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *base, sha, spans, *extra, total], names)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = dict.fromkeys(names, "long") | {"base_sha256": "string", "spans": "string"}
    return out.mapInArrow(tidied(run), ", ".join(f"{k} {v}" for k, v in kinds.items()))


def mask(text: str, found: dict[str, list[tuple[int, int]]]) -> str:
    """A text with each span replaced by its kind in angle brackets; of spans that overlap the first stands."""
    out, at = [], 0
    for a, z, k in sorted((a, z, k) for k, v in found.items() for a, z in v):
        if a >= at:
            out += [text[at:a], f"<{k}>"]
            at = z
    return "".join((*out, text[at:]))
