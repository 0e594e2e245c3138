"""What the training-data operators share: table access, scratch tables and small column helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blanks are space and U+0009 to U+000D everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"

#: Rows in an Arrow batch sent to Python; long texts make batches large, so few.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see.

    It is what ``spark.checkpoint.dir`` names, with its scheme, so that Arrow opens what Spark has written. Where that is unset a
    local master gets a temporary folder; on a cluster no folder is known to be shared, so that is an error.
    """
    named = _named(spark)
    if named:
        return qualified(spark, named.rstrip("/"))
    if _is_local(spark):
        made = tempfile.mkdtemp(prefix="marquetry-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", f"file:{made}")
        return f"file:{made}"
    raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that the driver and all executors share")


def _named(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None)


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"


def qualified(spark: SparkSession, path: str) -> str:
    """A path with scheme and host, as Hadoop's default file system adds them."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(own).toString()


#: What this driver has written to the shared folder.
_SCRATCH: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    if not _SCRATCH:
        atexit.register(drop_scratch)
    _SCRATCH.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def drop_scratch() -> None:
    """Deletes this driver's tables in the shared folder; results that still read them are lost. Runs when the driver ends."""
    spark = SparkSession.getActiveSession()
    while spark is not None and _SCRATCH:
        _delete(spark, _SCRATCH.pop())


def drop(*tables: DataFrame) -> None:
    """Deletes tables that `staged` wrote and nothing will read again."""
    for df in tables:
        path = getattr(df, "scratch_path", None)
        if path in _SCRATCH:
            _SCRATCH.remove(path)
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_parquet(df: DataFrame, path: str) -> None:
    """Writes a table; the shuffle files behind it are dropped at once, as nothing reads them again."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Any store that Arrow knows, under Hadoop's names for it too; the driver and the executors see the same folder there."""
    path = re.sub(r"^s3[an]://", "s3://", path)
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    return pafs.FileSystem.from_uri(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage is cut, and a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, name)
    write_parquet(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch, which Python workers hold whole; Spark bounds its bytes.

    The session's setting stays, as an operator's plan reads it when it runs, which is after the operator returns.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for `mapInArrow`, with memory given back at its end: Python workers live on, and would keep it."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def carried(names: Sequence[str]) -> Column:
    """Columns that an operator hands on untouched, as one struct ``row``, so that no name clashes with its own."""
    return F.struct(*[F.col(n) for n in names] or [F.lit(None).cast("boolean").alias("none")]).alias("row")


def crc_of(doc_id: Column) -> Column:
    """crc32 of the id as text; null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
