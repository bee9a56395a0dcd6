"""Postings as a stream: each micro-batch adds its new events and what they change in the frequencies.

State are increments: how many postings a batch has in each month of a job, in all and by skill. A
month can be late without bound, and then all later cumulative values of its job change; so from
the earliest month on that a batch touches, a job's frequencies are made anew, from increments and the
cumulative values of the month before. Earlier months and other jobs are left alone, and events are
never read again. Batches are stored by number, so that a batch that runs twice changes nothing.

Which events are new is told by their job_ids. Each batch leaves a Bloom filter for the ids of each of
its folders, and a later batch reads the ids of those folders alone that may hold one of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import schemas
from ..functions.text import ratio
from ..operators.frequency import COLUMNS, valid_events
from ..sources.readers import exists
from ..sources.shared import scope, stored
from ..sources.tables import VersionedTable

ACCEPTED = "existing_job"
#: Bits for each id of a filter and places that an id sets; about one id in a hundred is taken for known by mistake, and looked up.
BITS, PLACES = 10, 7
#: Ids in one filter at most, about.
FILTERED = 1_000_000
_INCREMENT = "standard_job string, month string, skill string, n long, batch int, bucket int"


def places(h1: np.ndarray, h2: np.ndarray, size: int) -> np.ndarray:
    """A row of PLACES bits below size for each id, from two hashes."""
    steps = np.arange(PLACES, dtype=np.uint64)
    return ((h1.astype(np.uint64)[:, None] + steps * (h2.astype(np.uint64) | np.uint64(1))[:, None]) % np.uint64(size)).astype(np.int64)


def _filter(rows: pa.Table) -> pa.Table:
    """The filter of a group of ids as bytes of bits."""
    size = max(64, BITS * rows.num_rows // 8 * 8)
    bits = np.zeros(size, np.uint8)
    bits[places(rows["h1"].to_numpy(), rows["h2"].to_numpy(), size).ravel()] = 1
    return pa.table({"bucket": rows["bucket"].slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by bucket, filters before ids: batch and bucket of each filter that may hold one of the ids."""
    at, filters, hit = None, [], set()
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, kind = batch.column("bucket").to_numpy(), batch.column("batch").is_null().to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(kind) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
            part = batch.slice(a, b - a)
            if bucket[a] != at:
                at, filters = bucket[a], []
            if not kind[a]:
                filters += [(n, np.unpackbits(np.frombuffer(x, np.uint8))) for n, x in zip(part.column("batch").to_pylist(), part.column("bits").to_pylist(), strict=True)]
                continue
            for n, bits in filters:
                if (n, at) not in hit and bits[places(part.column("h1").to_numpy(), part.column("h2").to_numpy(), len(bits))].all(1).any():
                    hit.add((n, at))
    yield pa.RecordBatch.from_arrays([pa.array([int(x[i]) for x in sorted(hit)], pa.int32()) for i in (0, 1)], names=["batch", "bucket"])


def bucket_of(column: str, buckets: int):
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


class EventStore:
    """Events by batch and a hash of their job_id, increments by batch and a hash of their job, and the frequencies made of them, in one folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.table = VersionedTable(spark, f"{self.folder}/frequency", schemas.FREQUENCY, ["standard_job", "skill", "month"], buckets, ["standard_job"], ["month"])

    def _read(self, name: str, schema: T.StructType | str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _stored(self) -> DataFrame:
        return self._read("events", T.StructType([*schemas.EVENTS.fields, T.StructField("batch", T.IntegerType()), T.StructField("bucket", T.IntegerType())]))

    def events(self, before: int | None = None) -> DataFrame:
        """All stored events, or those of batches before a number."""
        rows = self._stored() if before is None else self._stored().where(F.col("batch") < before)
        return rows.drop("batch", "bucket")

    def frequency(self) -> DataFrame:
        return self.table.read()

    def queue(self) -> DataFrame:
        path = f"{self.folder}/queue"
        return self.spark.read.parquet(path).drop("batch") if exists(self.spark, path) else schemas.empty(self.spark, schemas.EVENTS)

    def _hashed(self, rows: DataFrame) -> DataFrame:
        return rows.select(bucket_of("job_id", self.buckets).alias("bucket"), F.xxhash64("job_id", F.lit(1)).alias("h1"), F.xxhash64("job_id", F.lit(2)).alias("h2"))

    def folders_to_read(self, ids: DataFrame, number: int) -> list[tuple[int, int]]:
        """Batch and bucket of the folders of earlier batches that may hold one of ids (job_id); those of a bucket's filters are in memory at a time."""
        filters = self._read("filters", "bucket int, bits binary, batch int").where(F.col("batch") < number)
        null = lambda kind: F.lit(None).cast(kind)
        asked = self._hashed(ids).select("bucket", null("int").alias("batch"), null("binary").alias("bits"), "h1", "h2")
        both = filters.select("bucket", "batch", "bits", null("long").alias("h1"), null("long").alias("h2")).unionByName(asked)
        hits = both.repartition("bucket").sortWithinPartitions("bucket", F.col("batch").asc_nulls_last()).mapInArrow(_probe, "batch int, bucket int").distinct()
        return sorted((r["batch"], r["bucket"]) for r in hits.collect())

    def accept(self, batch: DataFrame, number: int, write: bool = True) -> DataFrame:
        """The new events of a batch: first of each job_id, not stored before; written unless it is a dry run.

        Rows with a route_status other than existing_job go to the queue and change nothing else. A
        batch that is written is worked off once: it is laid down, and then looked up and taken in from there.
        """
        routed = batch if "route_status" in batch.columns else batch.withColumn("route_status", F.lit(ACCEPTED))
        kept = schemas.conform(routed.where(F.col("route_status") == ACCEPTED), schemas.EVENTS)
        once = valid_events(kept).dropDuplicates(["job_id"])
        if write:
            with scope(self.spark):
                return self._written(routed, stored(once, "batch"), number)
        return self._new(once, number)

    def _new(self, once: DataFrame, number: int) -> DataFrame:
        """The events of a batch that no earlier one has."""
        if not exists(self.spark, f"{self.folder}/filters"):
            return once.select(*schemas.EVENTS.fieldNames())
        folders = self.folders_to_read(once.select("job_id"), number)
        known = self._stored().where(F.concat_ws("/", "batch", "bucket").isin([f"{n}/{b}" for n, b in folders])).select("job_id") if folders else schemas.empty(self.spark, schemas.EVENTS).select("job_id")
        return once.join(known, "job_id", "left_anti").select(*schemas.EVENTS.fieldNames())

    def _written(self, routed: DataFrame, once: DataFrame, number: int) -> DataFrame:
        laid = self._new(once, number).withColumn("bucket", bucket_of("job_id", self.buckets))
        laid.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/events/batch={number}")
        written = self._batch(number)
        groups = -(-written.count() // (self.buckets * FILTERED)) or 1
        filters = self._hashed(written).withColumn("g", F.pmod("h1", F.lit(groups))).groupBy("bucket", "g").applyInArrow(_filter, "bucket int, bits binary")
        filters.write.mode("overwrite").parquet(f"{self.folder}/filters/batch={number}")
        waiting = routed.where(F.coalesce(F.col("route_status") != ACCEPTED, F.lit(True)))
        if not waiting.isEmpty():
            waiting.write.mode("overwrite").parquet(f"{self.folder}/queue/batch={number}")
        return written

    def _batch(self, number: int) -> DataFrame:
        return self.spark.read.schema(schemas.EVENTS).parquet(f"{self.folder}/events/batch={number}")

    def refresh(self, number: int) -> None:
        """Takes a batch's events into the frequencies: for each job that it touches, those from its earliest month on."""
        skills = F.concat(F.array(F.lit(None).cast("string")), F.filter(F.array_distinct("skills"), lambda x: x.isNotNull()))
        told = self._batch(number).select("standard_job", "month", F.explode(skills).alias("skill"))
        # job_ids are unique by now, so that rows count postings
        counted = told.groupBy("standard_job", "month", "skill").agg(F.count("*").alias("n")).withColumn("bucket", bucket_of("standard_job", self.buckets))
        counted.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/increments/batch={number}")
        every = self._read("increments", _INCREMENT)
        own = every.where(F.col("batch") == number)
        starts = {r["bucket"]: r["start"] for r in own.groupBy("bucket").agg(F.min("month").alias("start")).collect()}  # as many as buckets
        if not starts:
            return
        since = own.groupBy("standard_job").agg(F.min("month").alias("since"))
        state = every.where(F.col("bucket").isin(list(starts))).join(since, "standard_job")
        sums = state.where("skill IS NULL OR month >= since").groupBy("standard_job", "month", "skill", "since").agg(F.sum("n").alias("n"))

        def make(parts: dict) -> dict:
            touched = lambda k: k[0].isdigit() and int(k[0]) in starts
            late = {k: v for k, v in parts.items() if touched(k) and k[1] >= starts[int(k[0])]}
            known = self.table.read_parts({k: v for k, v in parts.items() if touched(k)})
            # what the latest month before a job's first changed one has come to
            before = known.join(since, "standard_job").where("month < since")
            latest = before.groupBy("standard_job").agg(F.max("month").alias("month"))
            carried = before.join(latest, ["standard_job", "month"]).select("standard_job", "skill", F.col("cumulative_skill_count").alias("carried"))
            kept = self.table.read_parts(late).join(since, "standard_job", "left").where("since IS NULL OR month < since").drop("since")
            rows = self._suffix(sums, carried)
            return {k: v for k, v in parts.items() if k not in late} | self.table.write_parts(kept.unionByName(schemas.conform(rows, schemas.FREQUENCY)))

        self.table.change(make)

    @staticmethod
    def _suffix(sums: DataFrame, carried: DataFrame) -> DataFrame:
        """Frequencies from since on; sums: all months' postings of jobs and, from since on, those of their skills; carried: sums by skill before."""
        job, pair = ["standard_job"], ["standard_job", "skill"]
        running = lambda keys: Window.partitionBy(*keys).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
        cells = sums.where("skill IS NULL").select(*job, "month", "since", F.col("n").alias("monthly_jd_count"), F.sum("n").over(running(job)).alias("cumulative_jd_count")).where("month >= since").drop("since")
        counts = sums.where("skill IS NOT NULL").select(*pair, "month", "n")
        first = counts.groupBy(*pair).agg(F.min("month").alias("first")).join(carried, pair, "full").select(F.col("standard_job").alias("_job"), "skill", F.when(F.col("carried").isNull(), F.col("first")).alias("first"), F.coalesce("carried", F.lit(0)).alias("carried"))
        grid = cells.join(first, (F.col("standard_job") == F.col("_job")) & (F.col("first").isNull() | (F.col("month") >= F.col("first")))).drop("_job", "first")
        grid = grid.join(counts, [*pair, "month"], "left").withColumn("monthly_skill_count", F.coalesce("n", F.lit(0)))
        grid = grid.withColumn("cumulative_skill_count", F.col("carried") + F.sum("monthly_skill_count").over(running(pair)))
        ratios = {f"{k}_skill_frequency": ratio(F.col(f"{k}_skill_count"), F.col(f"{k}_jd_count"), 1_000_000) for k in ("monthly", "cumulative")}
        return grid.withColumns(ratios).select(*COLUMNS)

    def update(self, batch: DataFrame, number: int) -> None:
        self.accept(batch, number)
        self.refresh(number)


def run_stream(stream: DataFrame, store: EventStore, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None):
    """Works off what a stream has and ends; each replaces the store's update."""
    query = stream.writeStream.foreachBatch(each or store.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def capture_effects(store: EventStore, current: Callable[[DataFrame], DataFrame], folder: str) -> Callable[[DataFrame, int], None]:
    """An update that also stores what it changed in current profiles; current: from frequencies to a profile."""
    from ..operators.profile import live_effect

    def each(batch: DataFrame, number: int) -> None:
        before_path = f"{folder}/before/batch={number}"
        current(store.frequency()).write.mode("overwrite").parquet(before_path)
        store.update(batch, number)
        live_effect(store.spark.read.parquet(before_path), current(store.frequency())).write.mode("overwrite").parquet(f"{folder}/effects/batch={number}")

    return each


def windowed_counts(stream: DataFrame, time: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "2 hours", event_id: str = "event_id") -> DataFrame:
    """Distinct events by tumbling window and key; state is dropped once the watermark has passed."""
    once = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([event_id])
    return once.groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def monthly_counts(stream: DataFrame, time: str, key: str) -> DataFrame:
    """Counts by calendar month for complete mode; windows have no months, so the month is a column."""
    return stream.groupBy(F.date_format(time, "yyyy-MM").alias("month"), key).agg(F.count("*").alias("n"))
