"""The scored merge as a stream against one merge of all records."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marquetry.operators import merge
from marquetry.plans.views import as_records
from marquetry.streaming import winners

DOCS = [(i, f"word {i % 9} " * (i % 13 + 1), ("en", "de")[i % 2], f"src{i % 3}", i % 50) for i in range(120)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int")


def provenance(rows):
    return sorted(tuple(r) for r in rows.select("entity", "field_name", "source", "source_id", "score", "reason").collect())


def put(spark, rows, folder, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_batches(spark, labels, tmp_path, seed):
    """Shuffled batches, a restart between them, and rows that come again end with the winners of one merge."""
    rows, rng = list(DOCS), random.Random(seed)
    rng.shuffle(rows)
    source = tmp_path / "docs"
    stream = lambda: as_records(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{source}/*"), labels)
    run = lambda: winners.follow(stream(), str(tmp_path / "changes"), str(tmp_path / "checkpoint")).awaitTermination()
    put(spark, rows[:40], source, "a")
    put(spark, rows[40:50], source, "b")
    run()
    half = provenance(winners.current(spark, str(tmp_path / "changes")))
    assert half == provenance(merge.provenance_rows(merge.merge_fields(as_records(spark.createDataFrame(rows[:50], SCHEMA), labels))))
    put(spark, rows[50:], source, "c")
    put(spark, rows[:20], source, "d")  # again
    run()
    want = provenance(merge.provenance_rows(merge.merge_fields(as_records(spark.createDataFrame(DOCS, SCHEMA), labels))))
    assert provenance(winners.current(spark, str(tmp_path / "changes"))) == want
    changes = spark.read.parquet(str(tmp_path / "changes"))
    assert changes.groupBy("entity", "field_name", "seq").count().where("count > 1").isEmpty()  # what came again changed nothing


def test_tasks_send_only_their_best(spark, labels):
    """One hot entity: what is shuffled is a row a field and batch, not a row a record."""
    rows = spark.createDataFrame(DOCS, SCHEMA).coalesce(1)
    each = winners.candidates(as_records(rows, labels).withColumn("entity", F.lit(1).cast("long")))
    best = each.mapInArrow(winners._best_of_batches, each.schema)
    assert each.count() > 500 and best.count() == each.select("field_name").distinct().count()


def test_settings_are_given_back(spark, labels, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    put(spark, DOCS[:5], tmp_path / "docs", "a")
    winners.winners_of(as_records(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/docs/*"), labels)).count()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
