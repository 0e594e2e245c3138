"""Events replayed as a stream of files into a keyed sink: the same rows as the batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.operators.merge import last_wins
from marquetry.store import scratch_folder

KEYS = ("user_id", "event_type")


def running_last(events: DataFrame) -> DataFrame:
    """The last event of each key so far; state is a row for each key."""
    return events.groupBy(*KEYS).agg(F.max(F.struct("event_id", "props")).alias("w")).select(*KEYS, "w.event_id", "w.props")


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream of the files of a table that is one file or a folder of them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    read = spark.readStream.schema(spark.read.parquet(f"{folder}/{name}").schema).option("maxFilesPerTrigger", 4)
    return read.parquet(f"{folder}/{name}") if whole else read.option("pathGlobFilter", name).parquet(folder)


def replay_events(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Reads files as a stream up to what is there now, and the sink's last row of each key.

    Batches append to the sink under their numbers, so a batch that is run again replaces its own rows.
    """
    base = f"{scratch_folder(spark)}/replay-{uuid.uuid4().hex}"
    events = file_stream(spark, folder, name)

    def upsert(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/sink/batch={number}")

    run = running_last(events.select(*KEYS, "event_id", "props")).writeStream.outputMode("update").foreachBatch(upsert)
    run.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return last_wins(spark.read.parquet(f"{base}/sink").select(*KEYS, "event_id", "props"), list(KEYS), "event_id")
