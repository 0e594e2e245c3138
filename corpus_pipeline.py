"""The corpus pipeline: documents go through five operators; each stage is written and read again as the next one's input.

Language ID drops what has no language and labels the rest; line dedup takes out lines that many documents share; near dedup
keeps one document of each group of near copies; decontamination cuts out benchmark passages; mixing takes documents by source.
All but the last return the columns of documents; the last adds ``copies``, how often the mix takes a row.

Defined results: a null text has no language and goes in the first stage, so later ones get none but theirs. Rows with a null
or a repeated doc_id are documents as others are: lines count once for an id and none for rows without one, near dedup tells rows apart by
id and text and keeps exactly one row of a group, mixing takes rows of one id alike. Empty tables give empty
stages, an empty benchmark cuts nothing. Columns beyond those of documents are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.llm import decontaminate, langid, linededup, mixing, simhash_wide
from marquetry.llm.common import WORD, crc_of, drop, staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CARRY = ("lang", "source", "n_chars")
#: Words of a shingle, and the least similarity of copies, in the near-duplicate stage.
SHINGLE, SIMILARITY = 5, 0.8


def _again(out: DataFrame) -> DataFrame:
    """The columns of documents, with the new text's length."""
    return out.select("doc_id", "text", "row.lang", "row.source", F.char_length("text").cast("long").alias("n_chars"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts, and those without a letter. The language found becomes the label."""
    model = langid.learned(langid.sampled(docs, crc_of(F.col("doc_id")) % 3 != 1))
    out = langid.predict(docs, model, carry=COLUMNS)
    return out.where(F.col("lang_pred") != langid.UNKNOWN).select(*[F.col("lang_pred" if c == "lang" else f"row.{c}").alias(c) for c in COLUMNS])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out common lines; documents of which only blanks are left go."""
    out = linededup.dedup_lines(docs, carry=CARRY)
    return _again(out.where((F.col("n_dropped") == 0) | F.col("text").rlike(WORD)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group the document with the least id."""
    return simhash_wide.representatives(docs.select(*COLUMNS), SHINGLE, SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out benchmark passages; documents of which only blanks are left go."""
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=CARRY)
    return _again(out.where((F.col("n_hit") == 0) | F.col("text").rlike(WORD)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes whole documents so that sources meet their targets; ``copies`` says how often."""
    return mixing.take(docs.select(*COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
]

#: Language ID and SimHash can't be told in SQL; tests hold the pipeline against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        drop(before)  # the next stages read what this one wrote
    return docs
