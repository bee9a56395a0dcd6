"""Reading tables: text files with fixed schemas, dictionaries, JSON lines, catalog tables, aliased uploads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import schemas
from ..functions.text import clean_text, split_list

#: Header names of uploads, in either language; fixed values.
ALIASES = {
    "job_id": ("job_id", "岗位ID", "id"),
    "month": ("month", "月份"),
    "job_title": ("job_title", "岗位名称", "title", "岗位"),
    "job_responsibility": ("job_responsibility", "岗位职责", "responsibility", "职责"),
    "job_requirement": ("job_requirement", "任职要求", "requirement", "要求"),
}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, line_breaks: bool = True) -> DataFrame:
    """A CSV file as text, in its own columns: quotes and line breaks in fields, no nulls.

    Files whose fields have no line breaks can be read in splits: line_breaks=False.
    """
    df = spark.read.csv(path, header=True, multiLine=line_breaks, escape='"', encoding="UTF-8").na.fill("")
    return schemas.conform(df, schema) if schema is not None else df


def read_optional_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """As read_csv(), without rows if there is no file."""
    return read_csv(spark, path, schema) if exists(spark, path) else schemas.empty(spark, schema)


def events_from_text(df: DataFrame, schema: T.StructType = schemas.EVENTS_TEXT) -> DataFrame:
    """Events with their skills as an array, clean."""
    df = schemas.conform(df, schema)
    return df.select(*(clean_text(F.col(c)).alias(c) for c in df.columns if c != "skills"), split_list(F.col("skills")).alias("skills"))


def read_events(spark: SparkSession, path: str, government: bool = False) -> DataFrame:
    schema = schemas.GOVERNMENT_EVENTS_TEXT if government else schemas.EVENTS_TEXT
    return events_from_text(read_optional_csv(spark, path, schema), schema)


def read_taxonomy(spark: SparkSession, path: str, keyword_separator: str = r"\|") -> DataFrame:
    """standard_job, standard_category and keywords (array); the first two columns are needed."""
    df = schemas.require(read_csv(spark, path), ["standard_job_title", "standard_category"], "taxonomy")
    df = schemas.conform(df, schemas.TAXONOMY)
    words = F.filter(F.transform(F.split("match_keywords", keyword_separator), clean_text), lambda x: x != "")
    return df.select(clean_text(F.col("standard_job_title")).alias("standard_job"), clean_text(F.col("standard_category")).alias("standard_category"), words.alias("keywords")).where("standard_job <> '' AND standard_category <> ''")


def read_skill_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """The dictionary with row_order, its place in the file; dictionaries are small files of one split."""
    df = schemas.require(read_csv(spark, path), ["skill_keyword", "normalized_skill", "kg_display_skill"], "skill dictionary")
    return df.withColumn("row_order", F.monotonically_increasing_id())


def dictionary_digest(dictionary: DataFrame) -> DataFrame:
    """One row: sha256 over the sorted rows of a dictionary."""
    line = F.concat_ws("\x1f", *(F.coalesce(c, F.lit("")) for c in ("skill_keyword", "normalized_skill", "kg_display_skill")))
    return dictionary.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"), F.count("*").alias("n_keywords"))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; a broken line is an error."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def broken_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """file, line (from 1) and text of lines that are no JSON of the schema; empty lines are passed over.

    Files are read in splits. A line knows its split and its place in it; the counts of the splits
    before, of which there are few, make it the place in the file.
    """
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    marked = T.StructType([*kind.fields, T.StructField("_broken", T.StringType())])
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    splits = rows.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parsed = F.from_json("value", marked, {"columnNameOfCorruptRecord": "_broken"})
    broken = rows.where("trim(value) <> ''").where(parsed.isNull() | parsed["_broken"].isNotNull())
    found = broken.join(splits.withColumn("before", before), ["file", "start"])
    return found.select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), F.col("value").alias("text"))


def checked_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """As read_json_lines(), but all lines are looked at first, and an error names the first broken one."""
    first = broken_lines(spark, path, schema).orderBy("file", "line").limit(1).collect()
    if first:
        raise ValueError(f"{first[0]['file']}, line {first[0]['line']}: no JSON of the schema: {first[0]['text'][:200]}")
    return read_json_lines(spark, path, schema)


def read_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines, Parquet or CSV, by the end of the name."""
    if path.endswith((".jsonl", ".json")):
        return read_json_lines(spark, path, schema)
    return schemas.conform(spark.read.parquet(path), schema) if path.endswith(".parquet") else read_csv(spark, path, schema)


def read_cache(spark: SparkSession, path: str, schema: T.StructType, key: str | list[str], order: str | list[str | Column]) -> DataFrame:
    """An append-only JSON cache: the last entry of each key, a column or several, by order: columns by which the entry that counts is the largest, or sort orders by which it comes first.

    Where entries can be equal in a column, more columns have to tell which counts: lines of JSON have no order that all readers see.
    """
    if not exists(spark, path):
        return schemas.empty(spark, schema)
    turn = [F.desc(c) if isinstance(c, str) else c for c in ([order] if isinstance(order, str) else order)]
    rank = F.row_number().over(Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*turn))
    return read_json_lines(spark, path, schema).withColumn("_n", rank).where("_n = 1").drop("_n")


def parse_json(c: Column, schema: str) -> Column:
    """An embedded JSON column; a broken value is an error, empty is an empty object."""
    return F.from_json(F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("{}")), schema, {"mode": "FAILFAST"})


def object_in_text(c: Column, schema: str) -> Column:
    """The JSON object of a text: the whole text, or else what lies from its first brace to its last; a text without one is an error."""
    whole, inner = F.trim(c), F.regexp_extract(c, r"(?s)\{.*\}", 0)
    parsed = lambda x: F.from_json(x, f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    fine = lambda x: parsed(x).isNotNull() & parsed(x)["_broken"].isNull()
    found = F.when(c.isNull(), None).when(fine(whole), whole).when(fine(inner), inner).otherwise(F.raise_error(F.concat(F.lit("no JSON object in: "), F.substring(c, 1, 200))).cast("string"))
    return F.from_json(found, schema)


def aliased(df: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """Columns under their own names, from the first filled one of their aliases; absent ones are empty."""
    have = set(df.columns)

    def pick(names: tuple[str, ...]) -> Column:
        there = [F.nullif(clean_text(F.col(f"`{n}`")), F.lit("")) for n in names if n in have]
        return F.coalesce(*there, F.lit(""))

    return df.select(*(pick(names).alias(name) for name, names in aliases.items()))


def read_table(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    """A catalog table, without rows if there is none."""
    return schemas.conform(spark.table(name), schema) if spark.catalog.tableExists(name) else schemas.empty(spark, schema)


def single_file(spark: SparkSession, folder: str, suffix: str = ".csv") -> str:
    """The path of the only file with the suffix in a folder; none or several are an error."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    listed = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    found = [str(s.getPath()) for s in listed if s.isFile() and s.getPath().getName().endswith(suffix)]
    if len(found) != 1:
        raise ValueError(f"{folder} has {len(found)} files that end with {suffix}")
    return found[0]


def _listed(spark: SparkSession, folder: str):
    """The status of what is in a folder; nothing if it is not there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return list(fs.listStatus(at)) if fs.exists(at) else []


def list_versions(spark: SparkSession, root: str) -> list[str]:
    """The folders of data versions, by name."""
    return sorted(s.getPath().getName() for s in _listed(spark, root) if s.isDirectory())


#: The setting that names the data version of a session.
VERSION_SETTING = "skilltide.data.version"


def version_paths(spark: SparkSession, root: str, tables: tuple[str, ...], version: str | None = None, default: str = "base") -> dict[str, str]:
    """The paths of tables in a version's folder: the given one, else that of the session's setting, else the default."""
    name = (version or spark.conf.get(VERSION_SETTING, None) or default).strip()
    if not name or any(part in ("", ".", "..") for part in name.split("/")):
        raise ValueError(f"{name!r} is no name of a version")
    if not exists(spark, f"{root}/{name}"):
        raise FileNotFoundError(f"there is no version {name!r} in {root}")
    return {t: f"{root}/{name}/{t}" for t in tables}


def list_runs(spark: SparkSession, root: str, holding: str) -> list[str]:
    """The folders that hold a file or folder of a name, newest name first."""
    return [n for n in reversed(list_versions(spark, root)) if exists(spark, f"{root}/{n}/{holding}")]


def run_inputs(spark: SparkSession, folder: str, needed: tuple[str, ...], optional: tuple[str, ...] = ()) -> dict[str, str | None]:
    """The paths of a run's inputs; a needed one that is not there is an error, an optional one None."""
    if missing := [n for n in needed if not exists(spark, f"{folder}/{n}")]:
        raise FileNotFoundError(f"{folder} lacks {', '.join(missing)}")
    return {n: f"{folder}/{n}" for n in needed} | {n: f"{folder}/{n}" if exists(spark, f"{folder}/{n}") else None for n in optional}


def signature(spark: SparkSession, paths: list[str]) -> tuple:
    """Names, sizes and times of the files at paths, which change if any of them does."""
    jvm = spark.sparkContext._jvm
    out = []
    for path in sorted(paths):
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(at):
            files = [fs.getFileStatus(at)] if fs.getFileStatus(at).isFile() else fs.listStatus(at)
            out += sorted((str(s.getPath()), s.getLen(), s.getModificationTime()) for s in files)
    return tuple(out)


#: Tables by application, name and paths, each with the signature of its files.
_cached: dict[tuple, tuple[tuple, DataFrame]] = {}


def cached(spark: SparkSession, paths: list[str], build, name: str | None = None) -> DataFrame:
    """build()'s table, kept by Spark for as long as the files at paths stay the same.

    The name tells tables of the same files apart; without one, the place of build in its source
    does, so builds of one place that differ in what they capture need names. Tables of sessions
    that have ended are forgotten.
    """
    own = spark.sparkContext.applicationId
    for key in [k for k in _cached if k[0] != own]:
        del _cached[key]
    key = (own, name or (build.__module__, build.__qualname__, getattr(getattr(build, "__code__", None), "co_firstlineno", 0)), tuple(sorted(paths)))
    files = signature(spark, paths)
    if key in _cached and _cached[key][0] != files:
        _cached.pop(key)[1].unpersist()
    if key not in _cached:
        _cached[key] = files, build().persist()
    return _cached[key][1]


def derived(spark: SparkSession, path: str, schema: T.StructType, derive) -> DataFrame:
    """A derived Parquet table, or what derive() makes of its sources where it was not written yet."""
    return schemas.conform(spark.read.parquet(path), schema) if exists(spark, path) else schemas.conform(derive(), schema)


def preview(df: DataFrame, rows: int = 20) -> DataFrame:
    return df.limit(max(1, min(rows, 500)))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table and n_rows of each table, in one job."""
    parts = [t.agg(F.lit(name).alias("table"), F.count("*").alias("n_rows")) for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


