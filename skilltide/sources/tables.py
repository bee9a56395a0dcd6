"""Tables in versions: a change writes the parts that it touches, and a new version names them beside the unchanged ones.

A part holds the rows of one hash of some columns and, where asked for, of one value of others. A
version is a small file that tells the folder of each part. It is made only if there is none of its
number yet, so of two writers that start from the same version one comes too late, reads the new
version and does its change again. Readers keep the version that they have read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import schemas

#: How often a change is done again because another writer was first.
TRIES = 8
Parts = dict[tuple[str, ...], str]


class ConcurrentWriteError(RuntimeError):
    """Other writers made new versions each time."""


class VersionedTable:
    """keys: columns that name a row; bucket_by: those of the hash, by default keys; by: columns of which each value has a part."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = 16, bucket_by: list[str] | None = None, by: list[str] | None = None) -> None:
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys
        self.buckets, self.bucket_by, self.by = buckets, bucket_by or keys, by or []

    # versions

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _listed(self, path: str) -> list:
        fs, at = self._at(path)
        return [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _numbers(self) -> list[int]:
        return sorted(int(p.getName().removesuffix(".json")) for p in self._listed(f"{self.path}/versions") if p.getName().endswith(".json"))

    def _version(self, number: int) -> Parts:
        fs, at = self._at(f"{self.path}/versions/{number:012d}.json")
        stream = fs.open(at)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return {tuple(k): where for k, where in json.loads(text)}

    def current(self) -> tuple[int, Parts]:
        """The newest version's number and its parts: folders by the values of the hash and of by."""
        numbers = self._numbers()
        return (numbers[-1], self._version(numbers[-1])) if numbers else (0, {})

    def _commit(self, number: int, parts: Parts) -> bool:
        """Makes a version; False if there is one of that number.

        The file is whole before it gets its name, and a file system like HDFS renames to a free name only.
        """
        fs, at = self._at(f"{self.path}/versions/{number:012d}.json")
        _, own = self._at(f"{self.path}/writing/{uuid.uuid4().hex}")
        stream = fs.create(own, False)
        try:
            stream.write(bytearray(json.dumps(sorted(parts.items())).encode()))
        finally:
            stream.close()
        fs.mkdirs(at.getParent())
        done = not fs.exists(at) and bool(fs.rename(own, at))
        if not done:
            fs.delete(own, False)
        return done

    def change(self, make: Callable[[Parts], Parts | None]) -> None:
        """Replaces parts by what make gives for the current ones; again if another writer was first. None leaves all as it is."""
        for _ in range(TRIES):
            number, parts = self.current()
            new = make(parts)
            if new is None or self._commit(number + 1, new):
                return
        raise ConcurrentWriteError(f"{self.path}: {TRIES} other versions came first")

    # parts

    def _columns(self) -> dict:
        return {"_bucket": F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int"), **{f"_{c}": F.col(c) for c in self.by}}

    def touched(self, df: DataFrame) -> set[tuple[str, ...]]:
        """The parts in which rows of df have their place."""
        named = [c.cast("string").alias(n) for n, c in self._columns().items()]
        return {tuple(r) for r in df.select(*named).distinct().collect()}

    def write_parts(self, df: DataFrame) -> Parts:
        """Writes rows as new parts, which count once a version names them."""
        name, columns = uuid.uuid4().hex, self._columns()
        laid = schemas.conform(df, self.schema).withColumns(columns)
        laid.hint("rebalance", *columns).write.partitionBy(*columns).parquet(f"{self.path}/data/{name}")
        found: list[tuple[tuple[str, ...], str]] = [((), name)]
        for _ in columns:
            found = [((*k, unquote(p.getName().split("=", 1)[1])), f"{where}/{p.getName()}") for k, where in found for p in self._listed(f"{self.path}/data/{where}") if "=" in p.getName()]
        return dict(found)

    def read_parts(self, parts: Parts) -> DataFrame:
        if not parts:
            return schemas.empty(self.spark, self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{p}" for p in sorted(parts.values())))

    def read(self) -> DataFrame:
        return self.read_parts(self.current()[1])

    # changes

    def overwrite(self, df: DataFrame) -> None:
        self.change(lambda _: self.write_parts(df))

    def _merge(self, new: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame], touched: set | None = None) -> None:
        """Replaces the touched parts, by default those of new, by what merged makes of their rows and new."""
        new = schemas.conform(new, self.schema)

        def make(parts: Parts) -> Parts | None:
            own = touched if touched is not None else self.touched(new)
            if not own:
                return None
            old = {k: v for k, v in parts.items() if k in own}
            return {k: v for k, v in parts.items() if k not in own} | self.write_parts(merged(self.read_parts(old), new))

        self.change(make)

    def upsert(self, new: DataFrame, order: str) -> None:
        """Rows of new take the place of those with their keys; of rows with equal keys the largest in order stays."""

        def merged(old: DataFrame, new: DataFrame) -> DataFrame:
            both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
            rank = F.row_number().over(Window.partitionBy(*self.keys).orderBy(F.desc("_new"), F.desc(order)))
            return both.withColumn("_n", rank).where("_n = 1")

        self._merge(new, merged)

    def insert(self, new: DataFrame) -> None:
        """Rows of new whose keys are not there yet."""
        self._merge(new, lambda old, new: old.unionByName(new.dropDuplicates(self.keys).join(old.select(*self.keys), self.keys, "left_anti")))

    def replace(self, new: DataFrame, by: list[str]) -> None:
        """All rows of the values of by that occur in new are replaced by those of new; only parts that by decides are read if it covers their columns."""

        def merged(old: DataFrame, new: DataFrame) -> DataFrame:
            return old.join(new.select(*by).distinct(), by, "left_anti").unionByName(new)

        if set(self.bucket_by) | set(self.by) <= set(by):
            self._merge(new, merged)
        else:
            self.change(lambda parts: self.write_parts(merged(self.read_parts(parts), schemas.conform(new, self.schema))))

    def next_value(self, column: str) -> int:
        top = self.read().agg(F.max(F.col(column).cast("long"))).first()[0]
        return 0 if top is None else top + 1

    def prune(self, keep: int = 2) -> None:
        """Forgets all but the newest versions, and deletes the parts that only those named."""
        numbers = self._numbers()
        kept = {p for n in numbers[-keep:] for p in self._version(n).values()}
        for n in numbers[:-keep]:
            gone = [f"data/{p}" for p in set(self._version(n).values()) - kept]
            for path in [*gone, f"versions/{n:012d}.json"]:
                fs, at = self._at(f"{self.path}/{path}")
                fs.delete(at, True)
