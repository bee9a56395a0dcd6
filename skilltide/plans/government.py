"""Government postings: normalisation of the source, event stream, audit and the whole initial state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean_text, first_filled, stable_id, strip_rank_suffix, year_of
from ..operators import frequency, lifecycle, migration, pool, profile
from ..operators.pool import first_alias
from ..operators.keywords import contained
from ..operators.routing import seed_assignment
from ..schemas import require
from ..sources.readers import parse_json

#: Labels in the source; fixed values.
REQUIRED = ("source_name", "job_title", "job_description", "source_url", "publish_time", "raw")
RAW = "job_uid string, dataset_year string, source_sheet string, original map<string,string>"
REQUIREMENT_FIELDS = ("专业", "学历", "学位", "备注")
REQUIREMENT_LINES = ("专业要求", "学历要求", "学位要求", "备注")


def _lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), clean_text)


def _section(text: Column, label: str) -> Column:
    """What follows the label on the first line that starts with it."""
    found = F.filter(_lines(text), lambda x: x.startswith(f"{label}："))
    return F.coalesce(clean_text(F.substr(F.try_element_at(found, F.lit(1)), F.lit(len(label) + 2))), F.lit(""))


def normalize_postings(source: DataFrame) -> DataFrame:
    """Source rows as postings; a publish_time that is no date, broken JSON or a repeated id is an error."""
    require(source, REQUIRED, "government source")
    have = set(source.columns)
    col = lambda c: clean_text(F.col(c)) if c in have else F.lit("")
    rows = source.withColumn("_raw", parse_json(F.col("raw"), RAW))
    of = lambda name: clean_text(F.try_element_at(F.col("_raw.original"), F.lit(name)))
    day = F.coalesce(F.try_to_date(F.substring(clean_text(F.col("publish_time")), 1, 10)), F.raise_error(F.concat(F.lit("invalid publish_time: "), F.coalesce(F.col("publish_time"), F.lit("")))).cast("date"))
    rows = rows.withColumns({"_day": F.date_format(day, "yyyy-MM-dd"), "_title": col("job_title"), "_url": col("source_url"), "_tags": col("tags")})
    responsibility = first_filled(of("职位简介"), _section(F.col("job_description"), "职位简介"))
    from_fields = F.concat_ws("\n", *(F.when(of(f) != "", F.concat(F.lit(f"{f}："), of(f))) for f in REQUIREMENT_FIELDS))
    from_lines = F.array_join(F.filter(_lines(F.col("job_description")), lambda x: F.exists(F.array(*map(F.lit, REQUIREMENT_LINES)), lambda m: x.startswith(m))), "\n")
    major = first_filled(of("专业"), _section(F.col("job_description"), "专业要求"))
    labelled = lambda label, c: F.when(c != "", F.concat(F.lit(f"{label}："), c))
    out = rows.select(
        F.coalesce(F.nullif(clean_text(F.col("_raw.job_uid")), F.lit("")), F.concat(F.lit("GOV_"), stable_id(F.col("_url"), F.col("_title"), F.col("_day")))).alias("job_id"),
        F.col("_day").alias("publish_time"),
        F.substring("_day", 1, 7).alias("month"),
        first_filled(F.col("_raw.dataset_year"), year_of(col("source_name"))).alias("recruitment_year"),
        F.lit("government").alias("source"),
        col("source_name").alias("source_name"),
        F.col("_url").alias("source_url"),
        first_filled(col("company_name"), of("部门名称")).alias("government_agency"),
        of("用人司局").alias("government_department"),
        first_filled(col("location"), col("city")).alias("location"),
        F.col("_title").alias("job_title"),
        strip_rank_suffix(F.col("_title")).alias("rule_cleaned_job_title"),
        responsibility.alias("job_responsibility"),
        F.coalesce(F.nullif(from_fields, F.lit("")), from_lines).alias("job_requirement"),
        F.concat_ws("\n", F.concat(F.lit("岗位名称："), "_title"), labelled("职位简介", responsibility), labelled("专业要求", major), labelled("技术标签", F.col("_tags"))).alias("routing_text"),
        F.col("_tags").alias("tags"),
        of("招考人数").alias("planned_headcount"),
        first_filled(F.col("_raw.source_sheet"), of("来源Sheet")).alias("source_sheet"),
        col("job_description").alias("raw_description"),
    )
    return _no_repeats(out)


def _no_repeats(postings: DataFrame) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("job_id"))
    return postings.withColumn("_n", F.when(n > 1, F.raise_error(F.concat(F.lit("repeated job_id: "), "job_id")).cast("long")).otherwise(n)).where("_n = 1").drop("_n")


def raw_events(postings: DataFrame) -> DataFrame:
    """Events without job and skills yet, with what is known of their origin."""
    constant = {"standard_job": "", "cleaned_job_title": "", "route_status": "unprocessed", "event_time_type": "published", "source_time_granularity": "annual_recruitment_cycle"}
    return postings.withColumns({k: F.lit(v) for k, v in constant.items()} | {"skills": F.array().cast("array<string>")})


def audit(postings: DataFrame) -> DataFrame:
    """Rows by month and year, and how many lack a responsibility or requirement."""
    blank = lambda c: F.count_if(F.col(c) == "").alias(f"blank_{c}_rows")
    return postings.groupBy("month", "recruitment_year").agg(F.count("*").alias("n_rows"), blank("job_responsibility"), blank("job_requirement"))


def join_metadata(events: DataFrame, metadata: DataFrame, routes: DataFrame) -> DataFrame:
    """Events with their metadata and latest route; several routes of an event give one row."""
    latest = routes.groupBy("job_id").agg(F.max(F.struct("routed_at", "route_status", "cleaned_job_title")).alias("r"))
    out = events.join(metadata, "job_id", "left").join(latest, "job_id", "left")
    return out.withColumns({"route_status": F.coalesce("r.route_status", F.lit("")), "cleaned_job_title": F.coalesce("r.cleaned_job_title", F.lit(""))}).drop("r")


def clean_titles(postings: DataFrame, cleaner, column: str = "job_title") -> DataFrame:
    """postings with cleaned_job_title: cleaner (a DataFrame with title and cleaned, from distinct titles) runs once for each title."""
    titles = postings.select(F.col(column).alias("title")).distinct()
    return postings.join(cleaner(titles).select("title", F.col("cleaned").alias("cleaned_job_title")), F.col(column) == F.col("title"), "left").drop("title")


def title_audit(postings: DataFrame) -> DataFrame:
    """One row: titles, distinct titles and how many changed."""
    return postings.agg(F.count("*").alias("n_rows"), F.countDistinct("job_title").alias("n_titles"), F.countDistinct(F.when(F.col("job_title") != F.col("cleaned_job_title"), F.col("job_title"))).alias("n_changed"))


def seed_skills(postings: DataFrame, dictionary: DataFrame) -> DataFrame:
    """job_id and normalized_skill of the dictionary's keywords that a posting's texts contain, as plain substrings, case aside."""
    texts = postings.select("job_id", F.lower(clean_text(F.concat_ws(" ", "job_title", "job_responsibility", "job_requirement"))).alias("text"))
    words = first_alias(dictionary).select(F.lower(clean_text(F.col("skill_keyword"))).alias("keyword"), clean_text(F.col("normalized_skill")).alias("normalized_skill")).where("normalized_skill <> ''")
    return contained(texts, words).select("job_id", "normalized_skill").distinct()


def ingest_history(postings: DataFrame, assignments: DataFrame, stored_ids: DataFrame) -> DataFrame:
    """Postings that are not stored yet (job_id), with the job and category that they were assigned, as events without skills.

    Each posting has one assignment or none; one without a job, and a repeated job_id on either
    side, is an error. The order in which postings are taken changes nothing but ties of the pool.
    """
    one = assignments.groupBy("job_id").agg(F.count("*").alias("_n"), F.first("assigned_standard_job").alias("standard_job"), F.first("assigned_standard_category").alias("standard_category"))
    rows = _no_repeats(postings.drop("standard_job", "standard_category")).join(one, "job_id", "left")
    fail = lambda said: F.raise_error(F.concat(F.lit(said), "job_id")).cast("boolean")
    error = F.when(F.col("_n") > 1, fail("several assignments of ")).when(F.coalesce(clean_text(F.col("standard_job")), F.lit("")) == "", fail("no assignment of "))
    return rows.withColumn("_e", error).where("_e IS NULL").drop("_e", "_n").join(stored_ids.select("job_id").distinct(), "job_id", "left_anti")


def initial_state(source: DataFrame, keywords: DataFrame, priorities: DataFrame, categories: DataFrame, dictionary: DataFrame) -> dict[str, DataFrame]:
    """All tables of the domain from its source: postings, assignments, events, frequency, pool, life cycle, migration, spread and profiles."""
    postings = normalize_postings(source)
    assignments = seed_assignment(postings, keywords, priorities)
    skills = seed_skills(postings, dictionary).groupBy("job_id").agg(F.array_sort(F.collect_set("normalized_skill")).alias("skills"))  # as many as the dictionary has
    events = postings.join(assignments.select("job_id", F.col("assigned_standard_job").alias("standard_job")), "job_id").join(skills, "job_id", "left")
    events = events.withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))
    counted = frequency.monthly_frequency(events)
    families = dictionary.select(F.col("normalized_skill").alias("skill"), "kg_display_skill").distinct()
    universe = categories.select("standard_job").distinct().join(families).withColumn("skill_stage", F.lit(""))  # two dictionaries
    known = pool.alphabetical(pool.skill_pool(events, categories, universe, "government", strict=False))
    profiles = profile.snapshots(counted, known)
    return {
        "postings": postings,
        "assignments": assignments,
        "events": events,
        "frequency": counted,
        "skill_pool": known,
        "lifecycle": lifecycle.annual_lifecycle(counted),
        "migration": migration.migration(counted, known),
        "spread": migration.spread(counted, known),
        "snapshots": profiles,
        "diff": profile.profile_diff(profiles),
        "current_profile": profile.current_profile(profiles),
    }
