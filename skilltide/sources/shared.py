"""The folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths that were given out in the scope that is open here.
_given: ContextVar[list[str] | None] = ContextVar("given", default=None)


def shared_folder(spark: SparkSession, name: str = "") -> str:
    """A new path in the folder that spark.checkpoint.dir or the context's checkpoint folder names.

    Where neither is set, a local master gets a new folder of this machine; on a cluster that is an error.
    """
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/{name or 'table'}-{uuid.uuid4().hex}"
    if (given := _given.get()) is not None:
        given.append(path)
    return path


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, what was stored inside it; results that were made of that have to be written by then.

    A table that a function returns may read what the function stored, so only who writes the
    result knows when that can go. Scopes of other threads are left alone.
    """
    token = _given.set([])
    try:
        yield
    finally:
        given = _given.get() or []
        _given.reset(token)
        for path in given:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, for results that several jobs use; see scope()."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
