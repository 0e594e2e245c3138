"""The scored merge as a stream: the winner of each field and entity so far, kept as state.

A record's values become candidates with their scores; a task keeps the best of each entity and field of a batch before rows are
shuffled, so a hot entity sends a row a field and task. State is what provenance has of an entity's winners. A candidate
replaces the winner if it is higher by (score, arrival), so any order of batches ends with the winners of one merge of
all records, and a batch that is run again changes nothing. What comes out are the provenance rows that changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marquetry.functions.scoring import consistency_of_record
from marquetry.operators.merge import FIELDS, origin, scored
from marquetry.store import scratch_path

_WINNER = "field_name string, source string, source_id string, score double, reason string, seq long"
_NAMES = [x.split()[0] for x in _WINNER.split(", ")]
_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def candidates(records: DataFrame, entity: str = "entity", seq: str = "seq") -> DataFrame:
    """A row for each value that isn't null: ``entity``, then a winner's columns."""
    rows = records.withColumn("_origin", origin()).withColumn("_bonus", consistency_of_record())
    each = []
    for f in FIELDS:
        parts = scored(f, F.col("_origin.source"), F.col("_bonus"))
        one = F.struct(F.lit(f).alias("field_name"), F.col("_origin.source"), F.col("_origin.source_id"), parts.total.alias("score"), parts.reason.alias("reason"))
        each.append(F.when(F.col(f).isNotNull(), one))
    out = rows.select(F.col(entity).cast("long").alias("entity"), F.col(seq).cast("long").alias("seq"), F.explode(F.array_compact(F.array(*each))).alias("c"))
    return out.select("entity", *[f"c.{c}" for c in _NAMES[:-1]], "seq")


def _best_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each Arrow batch the best candidate of an entity and field."""
    for b in batches:
        rows = b.to_pandas().sort_values(["score", "seq"], kind="stable").drop_duplicates(["entity", "field_name"], keep="last")
        yield from pa.Table.from_pandas(rows, schema=b.schema, preserve_index=False).to_batches()


class Winners(StatefulProcessor):
    """State of an entity: the winner of each field that has one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._held = handle.getMapState("winners", "field_name string", _WINNER.split(", ", 1)[1])

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:  # noqa: N802  Spark's name
        held = {field[0]: tuple(w) for field, w in self._held.iterator()}
        changed = {}
        for r in rows:
            field, *new = (r[c] for c in _NAMES)
            old = held.get(field)
            if old is None or (new[2], new[4]) > (old[2], old[4]):
                held[field] = changed[field] = tuple(new)
        for field, w in changed.items():
            self._held.updateValue((field,), w)
            yield Row(entity=key[0], **dict(zip(_NAMES, (field, *w), strict=True)))

    def close(self) -> None:
        pass


def running_winners(records: DataFrame, entity: str = "entity", seq: str = "seq") -> DataFrame:
    """A stream of ``entity`` and a winner's columns, for winners that change, of a stream of canonical records."""
    best = candidates(records, entity, seq).mapInArrow(_best_of_batches, f"entity long, {_WINNER}")
    return best.groupBy("entity").transformWithState(Winners(), f"entity long, {_WINNER}", "Update", "None")


def follow(records: DataFrame, folder: str, checkpoint: str, entity: str = "entity", seq: str = "seq"):
    """Starts a query that takes what is there now and writes changed winners; each batch has a folder, which a rerun replaces."""
    spark = records.sparkSession
    before = {k: spark.conf.get(k, None) for k in _ROCKS}
    for k, v in _ROCKS.items():  # a query keeps the settings it has been started with
        spark.conf.set(k, v)
    try:
        stream = running_winners(records, entity, seq).writeStream.outputMode("update")
        stream = stream.foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{folder}/batch={number}"))
        return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def current(spark: SparkSession, folder: str) -> DataFrame:
    """Provenance as it stands: the last change of each entity and field."""
    rows = spark.read.schema(f"entity long, {_WINNER}, batch long").parquet(folder)
    rest = [c for c in _NAMES if c != "field_name"]
    last = rows.groupBy("entity", "field_name").agg(F.max_by(F.struct(*rest), F.struct("score", "seq")).alias("w"))
    return last.select("entity", "field_name", *[f"w.{c}" for c in rest])


def winners_of(records: DataFrame) -> DataFrame:
    """Runs a stream of records up to what is there now; its provenance."""
    folder = scratch_path(records.sparkSession, "winners")
    follow(records, f"{folder}/changes", f"{folder}/checkpoint").awaitTermination()
    return current(records.sparkSession, f"{folder}/changes")
