"""Scalar functions of the catalog as column expressions; all run inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquetry.schemas import MEDIA_KINDS, SOURCES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"\p{IsWhite_Space}"
# The characters with Unicode's White_Space property.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _ascii(c: Column, plain: Column, other: Column) -> Column:
    """``translate`` looks at every character; texts of ASCII only, which are most, go without it."""
    return F.when(F.octet_length(c) == F.char_length(c), plain).otherwise(other)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(c: Column) -> Column:
    return _ascii(c, F.lower(c), F.translate(c, UPPER, LOWER))


def upper_ascii(c: Column) -> Column:
    return _ascii(c, F.upper(c), F.translate(c, LOWER, UPPER))


def equal_ignoring_case(a: Column, b: Column) -> Column:
    return lower_ascii(a) == lower_ascii(b)


def trim_space(c: Column) -> Column:
    """Without Unicode white space at both ends. ``btrim`` lists all characters of a text, so one without any at its ends, as most are, goes without it."""
    at = lambda place: F.lit(SPACES).contains(F.substring(c, place, 1))
    return F.when(at(1) | at(-1), F.btrim(c, F.lit(SPACES))).otherwise(c)


def normalize_for_lookup(c: Column) -> Column:
    """Letters and digits with ASCII lower-cased; all else is a blank, and blanks are single."""
    words = F.split(F.regexp_replace(lower_ascii(c), rf"[^\p{{IsAlphabetic}}\p{{N}}{SPACE}]", " "), rf"{SPACE}+")
    return F.array_join(F.array_remove(words, ""), " ")


def distinct_ignoring_case(values: Column) -> Column:
    """Distinct values in order, ASCII case ignored; the first spelling stays."""
    keyed = F.transform(values, lambda x, i: F.struct(lower_ascii(x).alias("k"), i.alias("i"), x.alias("v")))
    first = F.array_distinct(F.transform(keyed, lambda x: x["k"]))
    return F.transform(first, lambda k: F.get(F.filter(keyed, lambda x: x["k"] == k), F.lit(0))["v"])


def normalize_aliases(values: Column) -> Column:
    """Trimmed values that aren't empty, distinct in order ignoring ASCII case."""
    return distinct_ignoring_case(F.filter(F.transform(values, trim_space), lambda x: x != ""))


def strip_html(c: Column) -> Column:
    """Without paragraph, bold and italic tags; breaks become line feeds; case-sensitive, entities stay."""
    for tag, to in (("<p>", ""), ("</p>", ""), ("<br>", "\n"), ("<br/>", "\n"), ("<b>", ""), ("</b>", ""), ("<i>", ""), ("</i>", "")):
        c = F.replace(c, F.lit(tag), F.lit(to))
    return trim_space(c)


def marked_null(c: Column) -> Column:
    r"""Null for ``\N`` and the empty text."""
    return F.when((c != "\\N") & (c != ""), c)


def marked_int(c: Column) -> Column:
    return marked_null(c).try_cast("int")


def year_of(c: Column) -> Column:
    """The first four characters as a year, or null."""
    return F.when(F.char_length(c) >= 4, F.substring(c, 1, 4)).try_cast("int")


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def clamp(c: Column, low: float, high: float) -> Column:
    """Within the bounds; null stays null, which least and greatest would pass over."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def rating(c: Column, scale: float) -> Column:
    """A rating on ``scale`` as a share of 1."""
    return clamp(c.cast("double") / F.lit(float(scale)), 0.0, 1.0)


def payload_hash(c: Column) -> Column:
    """The length of the JSON text in bytes, as text."""
    return F.octet_length(c).cast("string")


def first_search_token(title: Column) -> Column:
    """The first word of three characters or more, else the whole title."""
    words = F.filter(F.split(title, rf"{SPACE}+"), lambda x: F.char_length(x) >= 3)
    return F.coalesce(F.get(words, F.lit(0)), title)


def is_json(c: Column) -> Column:
    """Whether a text is one JSON value. Parsing alone forgives what stands behind it; as the one element of a list it can't."""
    one = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), "$", "array<variant>")
    return F.coalesce(F.size(one) == 1, F.lit(False))


def json_or_null(c: Column) -> Column:
    """The text if it is JSON."""
    return F.when(is_json(c), c)


def epoch_text() -> Column:
    return F.unix_timestamp().cast("string")


def _domain(c: Column, values: tuple[str, ...], what: str) -> Column:
    return F.when(c.isin(*values), c).when(c.isNotNull(), F.raise_error(F.concat(F.lit(f"unknown {what}: "), c)).cast("string"))


def parse_kind(c: Column) -> Column:
    """A media kind, written all lower or all upper; anything else is an error."""
    known = F.when(c.isin(*[k.upper() for k in MEDIA_KINDS]), F.lower(c)).otherwise(c)
    return _domain(known, MEDIA_KINDS, "media kind")


def parse_source(c: Column) -> Column:
    return _domain(c, SOURCES, "source")


def title_type_kind(c: Column) -> Column:
    """The media kind of a delimited dump's title type; null for types that are dropped."""
    return F.when(c.isin("movie", "tvMovie", "video"), "movie").when(c.isin("tvSeries", "tvMiniSeries", "tvSpecial"), "show")


def adult_rating(c: Column) -> Column:
    """Whether an age rating's text marks adult content; null is no."""
    found = F.lit(False)
    for mark in ("Rx", "Hentai", "R+", "Mild Nudity"):
        found = found | c.contains(mark)
    return F.coalesce(found, F.lit(False))


@cache
def folding() -> tuple[dict[str, str], str]:
    """What letters in lower case fold to, and the marks that are dropped.

    A letter is folded as in comparisons that ignore case (final sigma is sigma); Latin ones that are a basic letter with marks become that
    letter, those of other scripts stay as they are. Marks that such letters are made of are dropped wherever they stand on their own.
    """
    table, marks = {}, set()
    for code in range(0x80, 0x10000):
        c = chr(code)
        if not c.isalpha() or len(c.lower()) > 1 or c.lower() != c:
            continue
        to = c.casefold() if len(c.casefold()) == 1 else c
        if to != c:
            table[c] = to
        whole = unicodedata.normalize("NFD", to)
        if len(whole) > 1 and whole[0].isascii() and code not in _KEPT:
            table[c] = whole[0]
            marks |= set(whole[1:])
    return table, "".join(sorted(marks))


#: A Latin letter with two marks that the tokenising this follows leaves alone (small; the capital one is lower-cased first).
_KEPT = (0x1E1,)


def fold(c: Column) -> Column:
    """Lower case without marks on Latin letters."""
    low = F.lower(c)
    table, marks = folding()
    bare = F.regexp_replace(F.translate(low, "".join(table), "".join(table.values())), f"[{marks}]+", "")
    return _ascii(low, low, bare)


def fold_text(text: str) -> str:
    """`fold` of a text on the driver, as a query."""
    table, marks = folding()
    return text.lower().translate(str.maketrans(table | dict.fromkeys(marks, "")))


def tokens(c: Column) -> Column:
    """Folded runs of letters and digits."""
    return F.array_remove(F.split(fold(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def word_text(c: Column) -> Column:
    """A text that `words_of` of `operators.search` cuts into what `tokens` gives: in lower case, and where it has other scripts folded already, with blanks between words."""
    low = F.lower(F.coalesce(c, F.lit("")))
    words = F.regexp_replace(fold(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.when(low.rlike(r"[^\x00-\u024f\u2000-\u206f]"), words).otherwise(low)
