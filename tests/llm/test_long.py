"""Every operator on texts of five million characters that are made to be hard, with results that are known, in bounded time."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from marquetry.llm import bytespans, ctw, decontaminate, langid, linededup, mixing, pii, quality, simhash, simhash_wide, warc

SECONDS = 150
LINE = "this line stands in two of the long texts, and thrice in a short one"


def _texts():
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(5000)]
    prose = "\n".join(" ".join(r.choice(vocabulary) for _ in range(12)) for _ in range(70_000))
    return {1: "token=1" * 700_000, 2: "ab " * 1_700_000, 3: prose, 4: prose, 5: "a@" * 2_500_000, 6: f"{LINE}\n{LINE}", 7: LINE, 8: LINE.upper()}


TEXTS = _texts()


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long") / "docs")
    rows = [(k, t, "en", f"s{k % 2}", f"http://h.example/{k}") for k, t in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, url string").repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def rows(df, *columns):
    began = time.monotonic()
    out = {r[0]: r for r in df.select(*columns).collect()}
    assert time.monotonic() - began < SECONDS and len(out) == len(TEXTS)
    return out


def test_quality(docs):
    got = rows(quality.judge(docs), "doc_id", "n_words", "n_repeat_words", "kept")
    assert got[1][1:] == (1, 0, False) and got[2][1:] == (1_700_000, 1_700_000, False)
    assert got[3][1] == 840_000 and got[3][2:] == got[4][2:]


def test_decontamination(spark, docs):
    item = " ".join(TEXTS[3].split()[500_000:500_030])
    bench = spark.createDataFrame([("i", item), ("j", "ab " * 30)], "item_id string, text string")
    out = decontaminate.contamination(docs, bench).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"]))
    got = rows(out, "doc_id", "n_words", "n_hit", "items")
    assert got[2][1:] == (1_700_000, 1_700_000, ["j"]) and got[3][1:] == got[4][1:] == (840_000, 30, ["i"]) and got[7][2] == 0


def test_pii(docs):
    got = rows(pii.personal_data(docs), "doc_id", "n_email", "n_secret", "n_spans")
    assert got[1][1:] == (0, 1, 1) and got[5][1:] == (0, 0, 0) and got[3][3] == 0


def test_language(docs):
    got = rows(langid.identify(docs), "doc_id", "lang_pred", "score")
    assert {r["lang_pred"] for r in got.values()} == {"en"}


def test_warc(docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), "url", F.col("text").alias("html"))
    got = rows(warc.archive(pages), "page_id", "payload_bytes", "record_type", "refers_to")
    assert got[3][1:] == (len(TEXTS[3]), "revisit", 4) and got[1][1:] == (4_900_000, "response", None)


def test_lm(docs):
    got = rows(ctw.score(docs), "doc_id", "n_tokens", "score")
    assert got[2][1] == 1_700_001 and got[3]["score"] == pytest.approx(got[4]["score"]) and -got[2]["score"] < 0.001 * 5_100_000


def test_mixing(docs):
    got = rows(mixing.mix(docs), "doc_id", "size", "taken")
    assert got[2]["size"] == 1_700_000 and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got.values())


def test_simhash(docs):
    got = rows(simhash.near_duplicates(docs), "doc_id", "fp", "component_id")
    assert got[3][1:] == got[4][1:] and got[4]["component_id"] == 3 and got[8]["component_id"] == 7
    wide = rows(simhash_wide.near_duplicates(docs), "doc_id", "component_id")
    assert {k: r["component_id"] for k, r in wide.items() if k not in (6, 7, 8)} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5}


def test_line_dedup(docs):
    got = rows(linededup.dedup_lines(docs), "doc_id", "n_lines", "n_dropped")
    assert got[3][1:] == (70_000, 0) and [got[k]["n_dropped"] for k in (6, 7, 8)] == [2, 1, 0]


def test_byte_spans(docs):
    got = rows(bytespans.dedup_bytes(docs), "doc_id", "n_bytes", "n_removed", "n_spans")
    assert got[1][1:] == (4_900_000, 4_900_000 - 7, 1) and got[2][1:] == (5_100_000, 5_100_000 - 3, 1) and got[5][1:] == (5_000_000, 5_000_000 - 2, 1)
    assert got[3]["n_removed"] == 0 and got[4][1:] == (len(TEXTS[4]), len(TEXTS[4]), 1)
