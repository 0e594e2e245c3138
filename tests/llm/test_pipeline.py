"""The pipeline's stages against plain versions, each on what the one before it kept."""

from __future__ import annotations

import os
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marquetry.llm import simhash_wide

from . import brute
from .test_ops import SF, targets_by_rounds
from .test_simhash_wide import exact

BLANK = re.compile(r"^[\x20\x09-\x0D]*$")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.collect())
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        f(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def texts(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "mixing"]


def test_columns(stages):
    for rows in stages[1:-1]:
        assert list(rows[0].asDict()) == list(corpus_pipeline.COLUMNS)
        assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_language(stages):
    assert texts(stages[1]) == {k: v for k, v in texts(stages[0]).items() if v and any(c.isalpha() for c in v)}
    label = {r["doc_id"]: r["lang"] for r in stages[0]}
    assert sum(r["lang"] == label[r["doc_id"]] for r in stages[1]) >= 0.95 * len(stages[1])


def test_lines(stages):
    before = list(texts(stages[1]).items())
    kept = {}
    keys = defaultdict(set)
    norm = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    for doc, text in before:
        for x in text.split("\n"):
            if len(norm(x)) >= 20:
                keys[norm(x)].add(doc)
    for doc, text in before:
        new = "\n".join(x for x in text.split("\n") if not (len(keys.get(norm(x), ())) >= 3 and max(keys[norm(x)]) != doc))
        if new == text or not BLANK.match(new):
            kept[doc] = new
    assert texts(stages[2]) == kept


def test_near_duplicates(stages):
    """Of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more the least id stays."""
    before = texts(stages[2])
    root = exact(list(before.items()))
    assert texts(stages[3]) == {k: v for k, v in before.items() if root[k] == k}
    assert len(stages[3]) < len(before)


def test_decontamination(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = texts(stages[3]), texts(stages[4])
    hit = {k: v[1] > 0 for k, v in brute.contamination(list(before.items()), items).items()}
    assert {k: v for k, v in after.items() if not hit[k]} == {k: v for k, v in before.items() if not hit[k]}
    assert any(hit.values())
    assert all(v[1] == 0 for v in brute.contamination(list(after.items()), items).values())
    words = lambda t: Counter(t.split())
    assert all(not words(after[k]) - words(before[k]) or hit[k] for k in after)


def test_mixing(stages):
    before = stages[4]
    size = {r["doc_id"]: len(r["text"].encode().split()) for r in before}
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in before:
        sizes[r["source"]] += size[r["doc_id"]]
        largest[r["source"]] = max(largest[r["source"]], size[r["doc_id"]])
    for r in stages[5]:
        assert r["copies"] in (1, 2)
        taken[r["source"]] += r["copies"] * size[r["doc_id"]]
    for k, want in targets_by_rounds(dict(sizes)).items():
        assert abs(taken[k] - want) <= largest[k]


def test_hot_buckets_lose_no_link(spark):
    """With every bucket hot, and cut up, components stay."""
    r = __import__("random").Random(4)
    base = [[f"w{r.randrange(3000)}" for _ in range(300)] for _ in range(5)]
    rows = []
    for i in range(60):
        words = list(base[i % 5])
        for _ in range(2):
            words[r.randrange(300)] = "edited"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cold = {x["doc_id"]: x["component_id"] for x in simhash_wide.near_duplicates(df).collect()}
    hot = {x["doc_id"]: x["component_id"] for x in simhash_wide.near_duplicates(df, hot=2, sample=1, parts=3).collect()}
    assert cold == hot == {i: i % 5 for i in range(60)}


def tables(spark, folder, docs, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, row string, key string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_odd_documents(spark, tmp_path):
    """Null and repeated ids, equal rows, empty and very long texts, and columns that clash with the operators' own."""
    own = lambda w, n=60: " ".join(f"{w}{i} of the" for i in range(n))
    item = " ".join(f"bench{i}" for i in range(30))
    line = "This very line stands in many of the documents"
    odd = [(1, own("a")), (5, own("a")), (5, own("b")), (None, own("c")), (None, own("d")), (None, None), (2, ""), (3, "12 34"), (4, own("e") + " " + item), (6, f"{line}\n" + own("f")), (7, f"{line}\n" + own("g")), (8, f"{line}\n" + own("h")), (9, own("i", 40_000)), (10, own("j")), (10, own("j"))]
    sf = tables(spark, tmp_path, [(k, t, "en" if i % 2 else None, "s" if i % 3 else None, None, "x", "y") for i, (k, t) in enumerate(odd)], [("i", item), ("none", None)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "line_dedup":
            assert docs.where(F.col("text").contains(line)).count() == 1
    kept = [(r["doc_id"], r["text"][:4]) for r in docs.collect()]
    assert sorted(kept, key=str) == sorted([(1, "a0 o"), (5, "b0 o"), (None, "c0 o"), (None, "d0 o"), (4, "e0 o"), (6, "f0 o"), (7, "g0 o"), (8, "This"), (9, "i0 o"), (10, "j0 o")], key=str)
    assert docs.where(F.col("text").contains("bench3")).count() == 0
    assert set(corpus_pipeline.mix(spark, docs, sf).columns) == {*corpus_pipeline.COLUMNS, "copies"}


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "none", [], [])).count() == 0
    one = tables(spark, tmp_path / "one", [(1, "some words in a text", "en", "s", 20, "x", "y")], [])
    assert [r["text"] for r in corpus_pipeline.run(spark, one).collect()] == ["some words in a text"]
