"""Scores of candidate values: how much a source, a value and its record are trusted.

Terms are added in a fixed order so that equal inputs give equal doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import clamp, let, lower_ascii, trim_space

# Trust in each source, and its rank for episodes.
WEIGHTS = {"anilist": 0.90, "jikan": 0.76, "myanimelist": 0.80, "kitsu": 0.78, "tvmaze": 0.82, "imdb": 0.85}
EPISODE_RANKS = {"anilist": 5, "imdb": 5, "myanimelist": 4, "tvmaze": 4, "jikan": 3, "kitsu": 2}
UNSCORED = 0.60


def _lookup(source: Column, values: dict) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.create_map(*pairs)[source]


def source_weight(source: Column) -> Column:
    return _lookup(source, WEIGHTS)


def episode_rank(source: Column) -> Column:
    return _lookup(source, EPISODE_RANKS)


def text_completeness(value: Column) -> Column:
    return let(F.char_length(trim_space(value)) / F.lit(240.0), lambda share: clamp(share, 0.05, 1.0))


def text_quality(value: Column, synopsis: bool) -> Column:
    def seen(trimmed: Column) -> Column:
        tags = trimmed.contains("<") | trimmed.contains(">")
        return F.struct(F.char_length(trimmed).alias("size"), trimmed.contains("\n").alias("lines"), tags.alias("tags"))

    def judged(text: Column) -> Column:  # of what is seen, as each part is named several times
        size = text["size"]
        base = clamp(size / F.lit(600.0), 0.15, 1.0) if synopsis else clamp(size / F.lit(80.0), 0.20, 1.0)
        bonus = F.when(text["lines"], 0.10).otherwise(0.0)
        penalty = F.when(text["tags"], 0.15).otherwise(0.0)
        return F.when(size == 0, 0.0).otherwise(clamp(base + bonus - penalty, 0.0, 1.0))

    return let(let(trim_space(value), seen), judged)


def cover_quality(url: Column) -> Column:
    def judged(low: Column) -> Column:
        large = low.contains("large") | low.contains("extra") | low.contains("original")
        total = F.lit(0.35) + F.when(large, 0.35).otherwise(0.0) + F.when(low.endswith(".webp"), 0.15).otherwise(0.0) + F.when(low.startswith("https://"), 0.15).otherwise(0.0)
        return clamp(total, 0.0, 1.0)

    return let(lower_ascii(url), judged)


def consistency(english: Column, romaji: Column, synopsis: Column, cover: Column, has_ids: Column) -> Column:
    """A fifth for each of five parts that a record has."""
    total = F.lit(0.0)
    for present in (english.isNotNull(), romaji.isNotNull(), synopsis.isNotNull(), cover.isNotNull(), has_ids):
        total = total + F.when(present, 0.20).otherwise(0.0)
    return clamp(total, 0.0, 1.0)


def consistency_of_record() -> Column:
    return consistency(F.col("title_english"), F.col("title_romaji"), F.col("synopsis"), F.col("cover_image"), F.size("external_ids") > 0)


class Scored:
    """Named parts of a score; ``total`` adds them in order and ``reason`` prints them."""

    def __init__(self, **parts: Column) -> None:
        self.parts = parts

    @property
    def total(self) -> Column:
        first, *rest = self.parts.values()
        for p in rest:
            first = first + p
        return first

    @property
    def reason(self) -> Column:
        return F.format_string(", ".join(f"{name}=%.3f" for name in self.parts), *self.parts.values())


def score_text(source: Column, value: Column, bonus: Column, synopsis: bool = False) -> Scored:
    return Scored(provider=source_weight(source) * 0.25, completeness=text_completeness(value) * 0.20, quality=text_quality(value, synopsis) * 0.35, consistency=bonus * 0.20)


def score_int(source: Column, value: Column, bonus: Column) -> Scored:
    return Scored(
        provider=source_weight(source) * 0.25,
        completeness=F.when(value > 0, 0.20).otherwise(0.0),
        numeric_quality=F.when(value > 1, 0.30).otherwise(0.10),
        consistency=bonus * 0.25,
    )


def score_cover(source: Column, url: Column, bonus: Column, rating: Column) -> Scored:
    return Scored(
        provider=source_weight(source) * 0.20,
        completeness=text_completeness(url) * 0.10,
        cover_quality=cover_quality(url) * 0.45,
        consistency=bonus * 0.15,
        freshness=clamp(F.coalesce(rating, F.lit(0.0)), 0.0, 1.0) * 0.10,
    )


def score_bool(source: Column, value: Column, bonus: Column) -> Scored:
    return Scored(provider=source_weight(source) * 0.30, value_score=F.when(value, 0.35).otherwise(0.20), consistency=bonus * 0.35)
