"""The skill pool: one row for each skill, case aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean_text, distinct_by_case, join_list
from .frequency import explode_skills, valid_events


def with_family(mentions: DataFrame, universe: DataFrame, strict: bool = True) -> DataFrame:
    """mentions with kg_display_skill and skill_type of (job, skill) in universe, case aside; missing ones are an error if strict."""
    key = F.lower(clean_text(F.col("skill")))
    rows = universe.where(clean_text(F.col("kg_display_skill")) != "").groupBy(clean_text(F.col("standard_job")).alias("standard_job"), key.alias("_key")).agg(F.max(F.struct("kg_display_skill", "skill_stage")).alias("f"))
    out = mentions.withColumn("_key", F.lower("skill")).join(rows, ["standard_job", "_key"], "left").drop("_key")
    family = F.col("f.kg_display_skill")
    if strict:
        family = F.coalesce(family, F.raise_error(F.concat(F.lit("no kg_display_skill for standard_job="), "standard_job", F.lit(", skill="), "skill")).cast("string"))
    return out.select("*", F.coalesce(family, F.lit("")).alias("kg_display_skill"), F.coalesce("f.skill_stage", F.lit("")).alias("skill_type")).drop("f")


def mentions_by_job(mentions: DataFrame) -> DataFrame:
    """Mentions (skill, standard_job, row_order, at) by skill as it is spelt and job: the first of all, those of the first and last month, and counts.

    at: a mention's month, place and job_id; once: whether it is its event's first of the skill, case aside.
    """
    return mentions.groupBy("skill", "standard_job").agg(F.min("row_order").alias("o"), F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"), F.count_if("once").alias("n_once"))


def fold(rows: DataFrame) -> DataFrame:
    """Pool rows from mentions_by_job() with standard_category, source and family.

    Of the last month the last mention counts, of the first the first. Lists keep the order of
    first mention, jobs and categories being few; lists of all job ids are left to mention_jobs(),
    since a skill's can be of any length.
    """
    key = F.lower("skill").alias("skill_key")
    listed = lambda c: F.array_sort(F.collect_list(F.struct("o", F.col(c).alias("x"))))
    names = {"standard_category": "standard_categories", "standard_job": "standard_jobs", "source": "sources"}
    base = rows.groupBy(key).agg(
        F.min_by("skill", "o").alias("normalized_skill"),
        F.min_by("kg_display_skill", "o").alias("kg_display_skill"),
        F.min_by("skill_type", "o").alias("skill_type"),
        F.min("first").alias("_first"),
        F.max("last").alias("_last"),
        F.sum("n").alias("mention_count"),
        F.sum("n_once").alias("source_count"),
        *(listed(c).alias(name) for c, name in names.items()),
    )
    lists = {name: join_list(distinct_by_case(F.transform(name, lambda x: x["x"]))) for name in names.values()}
    ends = {f"{end}_seen_{name}": F.col(f"_{end}")[c] for end in ("first", "last") for name, c in (("month", "month"), ("job_id", "job_id"))}
    return base.withColumns(lists | ends).drop("_first", "_last")


def skill_pool(events: DataFrame, categories: DataFrame, universe: DataFrame, source: str = "base_event_stream", strict: bool = True, unique: bool = False) -> DataFrame:
    """The pool of an event stream; categories: standard_job, standard_category. Events may have row_order, else they go by month and job_id.

    Mentions are aggregated by skill and job where they are read, and families are looked up for
    what is left. Only the number of sources needs to tell job_ids apart; unique: each has one event.
    """
    in_turn = F.struct("month", "job_id")
    order, at = (F.col("row_order"), F.struct("month", "row_order", "job_id")) if "row_order" in events.columns else (in_turn, in_turn)
    skills = F.filter(F.array_distinct("skills"), lambda x: x != "")
    keys = F.transform(skills, lambda x: F.lower(x))
    told = F.transform(skills, lambda x, i: F.struct(x.alias("skill"), (F.array_position(keys, F.lower(x)) == i + 1).alias("once")))
    mentions = valid_events(events).select("job_id", "standard_job", order.alias("row_order"), at.alias("at"), F.explode(told).alias("s")).select("*", "s.*").drop("s")
    named = with_family(mentions_by_job(mentions), universe, strict).join(categories.select("standard_job", "standard_category").distinct(), "standard_job", "left")
    pool = fold(named.withColumns({"standard_category": F.coalesce("standard_category", F.lit("")), "source": F.lit(source)}))
    if unique:
        return pool
    sources = mentions.groupBy(F.lower("skill").alias("skill_key")).agg(F.countDistinct("job_id").alias("source_count"))
    return pool.drop("source_count").join(sources, "skill_key")


def alphabetical(pool: DataFrame) -> DataFrame:
    """A pool with its lists of categories, jobs and sources in alphabetical order."""
    return pool.withColumns({c: join_list(F.array_sort(F.filter(F.split(c, "; "), lambda x: x != ""))) for c in ("standard_categories", "standard_jobs", "sources")})


def mention_jobs(events: DataFrame) -> DataFrame:
    """skill_key and job_id of all mentions, the pool's source_job_ids as rows."""
    return explode_skills(valid_events(events)).select(F.lower("skill").alias("skill_key"), "job_id").distinct()


def _items(lists: Column) -> Column:
    """The items of lists in text, one behind the other."""
    return F.flatten(F.transform(lists, lambda x: F.split(x["text"], "; ")))


def merge_pool(pool: DataFrame, new: DataFrame) -> DataFrame:
    """A pool with the rows of another that came later, without reading old events again.

    Months and counts are merged; of equal last months the later pool's job counts, of equal
    first months the earlier's. Lists are joined in order, case aside; source counts are of
    disjoint streams and add up.
    """
    both = pool.withColumn("_at", F.lit(0)).unionByName(new.withColumn("_at", F.lit(1)))
    lists = {c: join_list(distinct_by_case(_items(F.array_sort(F.collect_list(F.struct("_at", F.col(c).alias("text"))))))).alias(c) for c in ("standard_categories", "standard_jobs", "sources")}
    return both.groupBy("skill_key").agg(
        F.min_by("normalized_skill", "_at").alias("normalized_skill"),
        F.min_by("kg_display_skill", F.struct(F.col("kg_display_skill") == "", "_at")).alias("kg_display_skill"),
        F.min_by("skill_type", F.struct(F.col("skill_type") == "", "_at")).alias("skill_type"),
        F.min("first_seen_month").alias("first_seen_month"),
        F.max("last_seen_month").alias("last_seen_month"),
        F.min_by("first_seen_job_id", F.struct("first_seen_month", "_at")).alias("first_seen_job_id"),
        F.max_by("last_seen_job_id", F.struct("last_seen_month", "_at")).alias("last_seen_job_id"),
        F.sum("mention_count").alias("mention_count"),
        F.sum("source_count").alias("source_count"),
        *lists.values(),
    )


def first_alias(dictionary: DataFrame) -> DataFrame:
    """A skill dictionary with each keyword once, case aside: the first in the file, by row_order; by its columns in tables without that."""
    order = ["row_order"] if "row_order" in dictionary.columns else ["skill_keyword", "normalized_skill", "kg_display_skill"]
    rank = F.row_number().over(Window.partitionBy(F.lower(clean_text(F.col("skill_keyword")))).orderBy(*order))
    return dictionary.where(clean_text(F.col("skill_keyword")) != "").withColumn("_n", rank).where("_n = 1").drop("_n")
