"""Event filters, demand and skill frequencies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import clean_items, clean_text, number, ratio, whole_number
from ..schemas import FREQUENCY, conform
from ..sources.shared import stored

JOB = ["standard_job"]
PAIR = ["standard_job", "skill"]
CELL = ["standard_job", "month"]


def normalize_frequency(frequency: DataFrame) -> DataFrame:
    """The frequency columns of a table of text: clean keys, counts and ratios as numbers, 0 where they are none; rows without a key are left out."""
    text = conform(frequency, T.StructType([T.StructField(f.name, T.StringType()) for f in FREQUENCY]))
    kinds = {f.name: clean_text(F.col(f.name)) if isinstance(f.dataType, T.StringType) else whole_number(F.col(f.name)) if isinstance(f.dataType, T.LongType) else number(F.col(f.name)) for f in FREQUENCY}
    return text.select(*(c.alias(name) for name, c in kinds.items())).where("month <> '' AND standard_job <> '' AND skill <> ''")


def normalize_events(events: DataFrame) -> DataFrame:
    """Clean text in every column; skills may be an array or a list with semicolons."""
    skills = F.col("skills") if dict(events.dtypes)["skills"].startswith("array") else F.split(F.coalesce("skills", F.lit("")), ";")
    return events.select(*(clean_text(F.col(c)).alias(c) for c in events.columns if c != "skills"), clean_items(skills).alias("skills"))


def valid_events(events: DataFrame) -> DataFrame:
    return events.where("job_id <> '' AND month <> '' AND standard_job <> ''")


def explode_skills(events: DataFrame) -> DataFrame:
    """job_id, month, standard_job and skill, each skill of an event once."""
    return events.select("job_id", "month", "standard_job", F.explode(F.array_distinct("skills")).alias("skill"))


def monthly_jd_count(events: DataFrame) -> DataFrame:
    return events.groupBy(*CELL).agg(F.countDistinct("job_id").alias("monthly_jd_count"))


def monthly_skill_count(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy(*CELL, "skill").agg(F.countDistinct("job_id").alias("monthly_skill_count"))


def posting_counts(events: DataFrame, unique: bool = False) -> tuple[DataFrame, DataFrame]:
    """monthly_jd_count() and monthly_skill_count() of events in one pass: an event counts for its cell and for each of its skills.

    unique: each job_id has one event, as an EventStore's have; then rows are counted where they are
    read, else every mention is shuffled to tell job_ids apart. The counts are stored: what follows
    reads them several times, and they are small against the events. Events that are dealt by job_id
    already, as those of testdata.events() are, stay where they are.
    """
    rows = events.select("job_id", *CELL, F.explode(F.concat(F.array(F.lit(None).cast("string")), F.filter(F.array_distinct("skills"), lambda x: x.isNotNull()))).alias("skill"))
    counted = stored(rows.groupBy(*CELL, "skill").agg((F.count("*") if unique else F.countDistinct("job_id")).alias("n")), "posting-counts")
    cells = counted.where("skill IS NULL").select(*CELL, F.col("n").alias("monthly_jd_count"))
    return cells, counted.where("skill IS NOT NULL").select(*CELL, "skill", F.col("n").alias("monthly_skill_count"))


def first_months(counts: DataFrame) -> DataFrame:
    return counts.groupBy(*PAIR).agg(F.min("month").alias("first_month"))


def _running(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)


def with_cumulative_jd(cells: DataFrame) -> DataFrame:
    return cells.withColumn("cumulative_jd_count", F.sum("monthly_jd_count").over(_running(JOB)))


def with_frequencies(grid: DataFrame, scale: int = 1_000_000) -> DataFrame:
    """Running skill counts and both ratios of a grid with JD counts."""
    grid = grid.withColumn("cumulative_skill_count", F.sum("monthly_skill_count").over(_running(PAIR)))
    return grid.withColumns(
        {
            "monthly_skill_frequency": ratio(F.col("monthly_skill_count"), F.col("monthly_jd_count"), scale),
            "cumulative_skill_frequency": ratio(F.col("cumulative_skill_count"), F.col("cumulative_jd_count"), scale),
        }
    )


COLUMNS = ["month", "standard_job", "skill", "monthly_jd_count", "monthly_skill_count", "monthly_skill_frequency", "cumulative_jd_count", "cumulative_skill_count", "cumulative_skill_frequency"]


def active_frequency(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows of monthly_frequency() with mentions in their month, of posting_counts(): no grid is made for them."""
    return with_frequencies(counts.join(with_cumulative_jd(cells), CELL)).select(*COLUMNS)


def latest_frequency(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows of monthly_frequency() of each job's last month, of posting_counts(): sums, without a grid."""
    last = cells.groupBy("standard_job").agg(F.max("month").alias("last"), F.max_by("monthly_jd_count", "month").alias("monthly_jd_count"), F.sum("monthly_jd_count").alias("cumulative_jd_count"))
    n = F.col("monthly_skill_count")
    sums = counts.groupBy(*PAIR).agg(F.max_by(n, "month").alias("n"), F.max("month").alias("m"), F.sum(n).alias("cumulative_skill_count"))
    rows = sums.join(last, "standard_job").withColumn("monthly_skill_count", F.when(F.col("m") == F.col("last"), F.col("n")).otherwise(F.lit(0).cast("long")))
    ratios = {f"{k}_skill_frequency": ratio(F.col(f"{k}_skill_count"), F.col(f"{k}_jd_count"), 1_000_000) for k in ("monthly", "cumulative")}
    return rows.withColumn("month", F.col("last")).withColumns(ratios).select(*COLUMNS)


def job_totals(cells: DataFrame, as_of: str | None = None) -> DataFrame:
    """standard_job, as_of and total_jd_count: postings up to a given month, or up to each job's last."""
    rows = cells.where(F.col("month") <= as_of) if as_of else cells
    return rows.groupBy("standard_job").agg((F.lit(as_of) if as_of else F.max("month")).alias("as_of"), F.sum("monthly_jd_count").alias("total_jd_count"))


def monthly_frequency(events: DataFrame, unique: bool = False) -> DataFrame:
    """A row for each month of a job with postings and each skill that it has had up to then.

    Jobs without any skill have no rows. The grid is an equi join on the job with a range on the
    month, so that its size is that of the result; nothing is made dense. unique: see posting_counts().
    """
    return frequency_grid(*posting_counts(valid_events(events), unique))


def frequency_grid(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """monthly_frequency() of posting_counts()."""
    cells = with_cumulative_jd(cells)
    first = first_months(counts).withColumnRenamed("standard_job", "_job")
    grid = cells.join(first, (F.col("standard_job") == F.col("_job")) & (F.col("month") >= F.col("first_month"))).drop("_job", "first_month")
    grid = grid.join(counts, [*PAIR, "month"], "left").withColumn("monthly_skill_count", F.coalesce("monthly_skill_count", F.lit(0).cast("long")))
    return with_frequencies(grid).select(*COLUMNS)


def calendar(events: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """month and month_index (from 1) of all calendar months in the range, by default that of the events."""
    bounds = events.where("month <> ''").agg(F.coalesce(F.lit(start), F.min("month")).alias("a"), F.coalesce(F.lit(end), F.max("month")).alias("b"))
    months = bounds.where("a <= b").select(F.posexplode(F.sequence(F.to_date(F.concat("a", F.lit("-01"))), F.to_date(F.concat("b", F.lit("-01"))), F.expr("interval 1 month"))).alias("at", "day"))
    return months.select(F.date_format("day", "yyyy-MM").alias("month"), (F.col("at") + 1).alias("month_index"))


def demand_grid(events: DataFrame, taxonomy: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """All jobs of the taxonomy by all calendar months; taxonomy: standard_job, standard_category.

    The calendar is a few hundred rows at most, and the grid is as large as the result.
    """
    return _demand(monthly_jd_count(valid_events(events)), taxonomy, calendar(events, start, end))


def _demand(postings: DataFrame, taxonomy: DataFrame, months: DataFrame) -> DataFrame:
    grid = taxonomy.select("standard_job", "standard_category").distinct().join(F.broadcast(months))
    grid = grid.join(postings, CELL, "left").withColumn("monthly_jd_count", F.coalesce("monthly_jd_count", F.lit(0).cast("long")))
    return with_cumulative_jd(grid).select("standard_job", "standard_category", "month", "month_index", "monthly_jd_count", "cumulative_jd_count", F.when(F.col("monthly_jd_count") > 0, "yes").otherwise("no").alias("is_active_month"))


def dense_frequency(events: DataFrame, taxonomy: DataFrame, start: str | None = None, end: str | None = None, universe: DataFrame | None = None, unique: bool = False) -> DataFrame:
    """All observed skills of each job, with those of universe (standard_job, skill), by all calendar months.

    Ratios have four places. Jobs outside the taxonomy stay, with an empty category.
    """
    postings, counts = posting_counts(valid_events(events), unique)
    return _dense(postings, counts, _pairs(counts, universe), taxonomy, calendar(events, start, end))


def _pairs(counts: DataFrame, universe: DataFrame | None) -> DataFrame:
    pairs = counts.select(*PAIR)
    if universe is not None:
        pairs = pairs.union(universe.select(clean_text(F.col("standard_job")).alias("standard_job"), clean_text(F.col("skill")).alias("skill")).where("standard_job <> '' AND skill <> ''"))
    return pairs.distinct()


def _dense(postings: DataFrame, counts: DataFrame, pairs: DataFrame, taxonomy: DataFrame, months: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    cells = pairs.select("standard_job").distinct().join(F.broadcast(months)).join(postings, CELL, "left").withColumn("monthly_jd_count", F.coalesce("monthly_jd_count", zero))
    grid = with_cumulative_jd(cells).join(pairs, "standard_job").join(counts, [*PAIR, "month"], "left")
    grid = grid.withColumn("monthly_skill_count", F.coalesce("monthly_skill_count", zero))
    named = with_frequencies(grid, 10_000).join(taxonomy.select("standard_job", "standard_category").distinct(), "standard_job", "left")
    return named.select("month", "month_index", "standard_job", F.coalesce("standard_category", F.lit("")).alias("standard_category"), *COLUMNS[2:])


@dataclass(frozen=True)
class Analysis:
    """What one pass over the events gives: demand_grid(), dense_frequency() and a row of quality figures."""

    job_demand: DataFrame
    skill_frequency: DataFrame
    quality: DataFrame


def analysis(events: DataFrame, taxonomy: DataFrame, start: str | None = None, end: str | None = None, universe: DataFrame | None = None) -> Analysis:
    """The tables of an event stream and its quality figures.

    The events are read once: they are counted by job and month, valid or not, and by skill, and
    the counts are stored; the three tables are made of these. quality has, beside quality_report()'s
    columns, the number of months and the rows of both tables; its skills are those of the frequencies.
    """
    fine = F.coalesce(F.expr("job_id <> '' AND month <> '' AND standard_job <> ''"), F.lit(False))
    skills = F.when(fine, F.filter(F.array_distinct("skills"), lambda x: x.isNotNull()))
    said = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(skills, F.array().cast("array<string>")))
    rows = events.select("job_id", *CELL, fine.alias("fine"), F.explode(said).alias("skill"))
    # job_ids are told apart by themselves, unchanged: events that are dealt by them need no shuffle for it
    by_id = rows.groupBy("job_id", *CELL, "skill").agg(F.count("*").alias("n_rows"), F.count_if("fine").alias("n_valid"))
    counted = stored(by_id.groupBy(*CELL, "skill").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_valid").alias("n_valid"), F.count_if(F.col("n_valid") > 0).alias("n")), "analysis")
    cells = counted.where("skill IS NULL")
    postings = cells.where("n_valid > 0").select(*CELL, F.col("n").alias("monthly_jd_count"))
    counts = counted.where("skill IS NOT NULL").select(*CELL, "skill", F.col("n").alias("monthly_skill_count"))
    pairs, months = _pairs(counts, universe), calendar(cells, start, end)
    return Analysis(_demand(postings, taxonomy, months), _dense(postings, counts, pairs, taxonomy, months), _quality(cells, pairs, taxonomy, months))


def _quality(cells: DataFrame, pairs: DataFrame, taxonomy: DataFrame, months: DataFrame) -> DataFrame:
    """One row, from counts: cells, a row for each job and month, and pairs of job and skill."""
    jobs = taxonomy.select(F.col("standard_job").alias("job")).distinct()
    by_job = cells.groupBy("standard_job").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_valid").alias("n_valid"))
    # a row for each job of either side
    both = by_job.where("standard_job IS NOT NULL").join(jobs, F.col("standard_job") == F.col("job"), "full")
    listed = lambda holds, name: F.array_join(F.array_sort(F.collect_set(F.when(holds, F.coalesce("standard_job", "job")))), "; ").alias(name)
    silent, unknown = F.col("standard_job").isNull(), F.col("job").isNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    figures = both.agg(
        F.count("standard_job").alias("unique_event_jobs"), total(F.when(~unknown, F.col("n_rows"))).alias("event_jobs_in_dictionary"), F.count_if(~unknown).alias("standard_job_count"),
        F.count_if(silent).alias("n_jobs_without_events"), listed(silent, "jobs_without_events"), listed(unknown, "unknown_standard_jobs"),
    )
    whole = cells.agg(total("n_rows").alias("event_stream_rows"), total("n_valid").alias("valid_event_rows"))
    span = months.agg(F.coalesce(F.min("month"), F.lit("")).alias("month_start"), F.coalesce(F.max("month"), F.lit("")).alias("month_end"), F.count("*").alias("month_count"))
    known = pairs.agg(F.countDistinct("skill").alias("unique_event_skills"), F.count("*").alias("_pairs"))
    out = figures
    for row in (whole, span, known):  # single rows
        out = out.join(F.broadcast(row))
    return out.withColumns({"job_demand_rows": F.col("standard_job_count") * F.col("month_count"), "skill_frequency_rows": F.col("_pairs") * F.col("month_count")}).drop("_pairs")


def quality_report(events: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """One row: row counts, range of months, jobs without events and events of unknown jobs."""
    return analysis(events, taxonomy).quality.drop("month_count", "job_demand_rows", "skill_frequency_rows")
