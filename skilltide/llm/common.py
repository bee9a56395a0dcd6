"""What the operators of this subpackage share: tables, shared folders, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on.
STEP_BYTES = 1 << 20


#: Rows and bytes of an Arrow batch: texts can be long, and batches of the default 10,000 rows take much memory.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to the sizes above, unless they are smaller."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        held = spark.conf.get(key)
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(key, most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the session's spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a local master gets a new folder of this machine; on a cluster that is an error.
    """
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Paths of stored copies, by scratch() that is open.
_scratch: list[list[str]] = []


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the copies that staged() makes inside; what was made of them has to be written by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            delete(spark, path)


def staged(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: later jobs neither recompute it nor depend on the executors that made it."""
    path = fresh(df.sparkSession, name)
    if _scratch:
        _scratch[-1].append(path)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Frees what the process no longer uses."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """run for mapInArrow, with the memory that it took given back when a task ends: workers wait for more tasks as they are.

    Called on the driver, it also bounds the batches that run will get.
    """
    if spark := SparkSession.getActiveSession():
        bound_batches(spark)

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def keyed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with _key: the doc_id, but null in rows whose text is not the least of their doc_id.

    So rows that repeat a document all have its key, and texts that share a doc_id with another do not.
    Null texts count as empty.
    """
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return docs.withColumn("_key", F.col("doc_id"))
    said = F.coalesce("text", F.lit(""))
    least = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(said).alias("_least"))
    return docs.join(least, "doc_id", "left").withColumn("_key", F.when(F.col("_least").isNull() | (said == F.col("_least")), F.col("doc_id"))).drop("_least")


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about limit bytes of text; a row is never cut."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def blobs(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def added(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """batch with columns put in place of those of the same name, or behind the others."""
    own = dict(zip(batch.schema.names, batch.columns, strict=True)) | columns
    return pa.RecordBatch.from_arrays(list(own.values()), names=list(own))
