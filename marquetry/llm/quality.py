"""Quality rules: a threshold table compiled into one projection.

Rows are judged by built-in expressions alone. Defined results: a null text counts as the empty one;
an empty text has no words, fails the base rules and every ratio of it is null, which breaks no rule;
repeated rows are judged one by one, and rows without an id too; columns other than the id and the text are left out, so
names may clash. Stop words are those of four languages: prose of another one breaks the rule on their ratio, so give rules of
your own (``judge(rules=...)``) for a corpus that has such.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, WORD, let

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Frequent words of the languages in the corpus.
STOP_WORDS = tuple(
    """the of and to in is it that for was on with as be at by this an are or not from have but which
    der die das und ist nicht ein eine zu den von mit sich auf für dem des im auch
    le la les de des et un une est en que qui dans pour du par au il elle
    el los las y es un una que en por con para del se su al lo""".split()
)


@dataclass(frozen=True)
class Rule:
    """A ratio of two measures must lie within [low, high]; a bound of None is open."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


#: Fixed thresholds of the verdict, over the measures of `measures`.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 1.5, 20.0),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 0.3),
    Rule("shout_ratio", "n_exclamations", "n_words", None, 0.8),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.02, None),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside ``window``-word windows that occur twice or more.

    Windows are compared by chained 64-bit hashes of their words. Only a text with a repeated window
    pays for the sort that finds where they are.
    """
    at = lambda h, i, k: F.get(h, i + F.lit(k))

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
            hit = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
            return F.sort_array(F.transform(hit, lambda x: x["i"]))

        def total(p: Column) -> Column:
            own = F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window))))
            return F.aggregate(own, F.lit(0).cast("long"), lambda acc, x: acc + x)

        return let(let(ordered, places), total)

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered(hashes)).otherwise(F.lit(0).cast("long"))

    def windows(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - F.lit(window))
        return F.transform(starts, lambda i: F.xxhash64(*[at(h, i, k) for k in range(window)]))

    whole = let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), counted)
    return F.when(F.size(words) >= window, whole).otherwise(F.lit(0).cast("long"))


def measures(text: Column, words: Column) -> dict[str, Column]:
    """The measures that rules may name, of a text and its words."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    stops = list(dict.fromkeys(STOP_WORDS))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_exclamations": F.char_length(F.regexp_replace(body, r"[^!]+", "")).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(stops))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where no rule is broken; a ratio over zero is null and breaks none."""
    ok = F.lit(True)
    for r in rules:
        ratio = F.try_divide(F.col(r.numerator).cast("double"), F.col(r.denominator).cast("double"))
        if r.low is not None:
            ok = ok & F.coalesce(ratio >= F.lit(r.low), F.lit(True))
        if r.high is not None:
            ok = ok & F.coalesce(ratio <= F.lit(r.high), F.lit(True))
    return ok


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The id, all measures, ``base_failed`` and ``kept`` of each row."""
    words = F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), BLANKS), "")
    split = docs.select(F.col(id_col), F.col(text_col), words.alias("_words"))
    measured = split.select(F.col(id_col), *[c.alias(n) for n, c in measures(F.col(text_col), F.col("_words")).items()])
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
