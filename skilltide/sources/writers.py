"""Writing tables: overwrite, append, reports and a review queue; tables.py has keyed upserts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from .readers import read_cache, read_optional_csv
from .tables import VersionedTable


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_text_ratios(df: DataFrame, path: str, columns: list[str], places: int = 4) -> None:
    """A CSV with ratios as text of fixed places."""
    write_csv(df.withColumns({c: F.format_string(f"%.{places}f", F.col(c)) for c in columns}), path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Overwrites; with by, files are laid out in folders by its values, and rows of a folder meet in few tasks, large folders in several."""
    writer = (df.hint("rebalance", *by) if by else df).write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def report(df: DataFrame) -> str:
    """A table of one row as JSON text."""
    row = df.limit(1).toJSON().first()
    return json.dumps(json.loads(row), ensure_ascii=False, indent=2) if row else "{}"


def write_manifest(spark: SparkSession, folder: str, payload: dict, name: str = "run_manifest.json") -> str:
    """A small JSON file with what is known of a run; its path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(bytearray((json.dumps(payload, ensure_ascii=False, indent=2) + "\n").encode()))
    finally:
        stream.close()
    return at.toString()


#: Columns by which tables are sorted where they leave the library; nulls last.
SORTS = {
    "events": ["month", "job_id"],
    "frequency": ["standard_job", "skill", "month"],
    "lifecycle": ["standard_job", "lifecycle_status", "skill"],
    "migration": ["skill"],
    "spread": ["skill", "standard_job", "month"],
    "snapshots": ["standard_job", "month", "rank_in_month", "skill"],
    "diff": ["standard_job", "from_month", "to_month", "change_type", "skill"],
    "current_profile": ["standard_job", "rank_in_month", "skill"],
    "skill_pool": ["normalized_skill"],
    "assignment_review": ["assignment_margin", "assignment_score", "assigned_standard_job", "job_id"],
}


def in_order(df: DataFrame, name: str) -> DataFrame:
    """A table in its canonical order; only sinks need one."""
    return df.orderBy(*(F.col(c).asc_nulls_last() for c in SORTS[name]))


def import_tables(spark: SparkSession, paths: dict[str, str], tables: dict[str, T.StructType], folder: str) -> None:
    """CSV files, those that are there, as Parquet tables of a folder, by name."""
    for name, schema in tables.items():
        write_parquet(read_optional_csv(spark, paths[name], schema) if name in paths else schemas.empty(spark, schema), f"{folder}/{name}")


def export_tables(spark: SparkSession, folder: str, names: list[str], target: str) -> None:
    """Parquet tables of a folder as CSV, in canonical order where one is known."""
    for name in names:
        df = spark.read.parquet(f"{folder}/{name}")
        write_csv(in_order(df, name) if name in SORTS and set(SORTS[name]) <= set(df.columns) else df, f"{target}/{name}")


def compact_cache(spark: SparkSession, path: str, schema: T.StructType, key: str, order: str | list[str | Column], target: str) -> None:
    """An append-only JSON cache written anew, sorted by key, with the last entry of each, by order as in read_cache()."""
    write_json_lines(read_cache(spark, path, schema, key, order).orderBy(key), target)


def review_queue(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, schemas.REVIEW_QUEUE, ["review_id"])


def find_reviews(queue: DataFrame, status: str | None = None, route_status: str | None = None, job_id: str | None = None, limit: int = 50) -> DataFrame:
    """Entries by any of the conditions that are given, newest first."""
    for column, value in (("status", status), ("route_status", route_status), ("job_id", job_id)):
        if value:
            queue = queue.where(F.col(column) == value)
    return queue.orderBy(F.desc("created_at"), "review_id").limit(max(1, min(limit, 500)))
