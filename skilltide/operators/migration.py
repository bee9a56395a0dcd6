"""How skills spread between jobs: first months, coverage, paths and monthly spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import month_number
from .lifecycle import pool_lookup


def active(frequency: DataFrame) -> DataFrame:
    return frequency.where("monthly_skill_count > 0")


def skill_first_month(frequency: DataFrame) -> DataFrame:
    return active(frequency).groupBy("skill").agg(F.min("month").alias("skill_first_seen_month"))


def skill_job_first_month(frequency: DataFrame) -> DataFrame:
    return active(frequency).groupBy("skill", "standard_job").agg(F.min("month").alias("job_first_seen_month"))


def monthly_coverage(frequency: DataFrame) -> DataFrame:
    return active(frequency).groupBy("skill", "month").agg(F.countDistinct("standard_job").alias("covered_job_count_this_month"))


def cumulative_coverage(frequency: DataFrame) -> DataFrame:
    """Jobs that had the skill up to each month in which it is active."""
    new = skill_job_first_month(frequency).groupBy("skill", F.col("job_first_seen_month").alias("month")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("skill").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    rows = active(frequency).select("skill", "month").distinct().join(new, ["skill", "month"], "left")
    return rows.select("skill", "month", F.sum(F.coalesce("n", F.lit(0))).over(upto).alias("cumulative_covered_job_count"))


def confirmed_first_month(frequency: DataFrame, mentions: int = 2) -> DataFrame:
    """The first month in which a pair has had so many mentions in all."""
    upto = Window.partitionBy("skill", "standard_job").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    run = frequency.withColumn("run", F.sum("monthly_skill_count").over(upto))
    return run.where(F.col("run") >= max(1, mentions)).groupBy("skill", "standard_job").agg(F.min("month").alias("confirmed_month"))


def peak_month(frequency: DataFrame) -> DataFrame:
    """The month of widest coverage, the latest of equals."""
    best = F.max(F.struct("covered_job_count_this_month", "month"))
    return monthly_coverage(frequency).groupBy("skill").agg(best.alias("p")).select("skill", F.col("p.covered_job_count_this_month").alias("peak_monthly_covered_job_count"), F.col("p.month").alias("peak_monthly_covered_job_month"))


def _paths(pairs: DataFrame, month: str, prefix: str) -> DataFrame:
    """Of pairs (skill, standard_job, month): ordered job lists, counts and the path by month. As many jobs meet as there are standard jobs."""
    by_month = pairs.groupBy("skill", F.col(month).alias("m")).agg(F.array_sort(F.collect_list("standard_job")).alias("jobs"))
    p = by_month.groupBy("skill").agg(F.array_sort(F.collect_list(F.struct("m", "jobs"))).alias("p"))
    first, later = F.col("p")[0], F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0)))
    jobs = lambda c: F.flatten(F.transform(c, lambda x: x["jobs"]))
    text = lambda c: F.array_join(c, "; ")
    return p.select(
        "skill",
        first["m"].alias(f"{prefix}first_seen_month"),
        text(first["jobs"]).alias(f"{prefix}first_seen_standard_jobs"),
        F.size(first["jobs"]).cast("long").alias(f"{prefix}first_seen_job_count"),
        F.size(jobs(F.col("p"))).cast("long").alias(f"{prefix}cumulative_covered_job_count"),
        F.size(jobs(later)).cast("long").alias(f"{prefix}spread_job_count"),
        text(jobs(later)).alias(f"{prefix}spread_standard_jobs"),
        text(jobs(F.col("p"))).alias(f"{prefix}all_standard_jobs"),
        F.array_join(F.transform("p", lambda x: F.concat(x["m"], F.lit(": "), F.array_join(x["jobs"], "; "))), " -> ").alias(f"{prefix}migration_path"),
    )


def migration_path(frequency: DataFrame) -> DataFrame:
    return _paths(skill_job_first_month(frequency), "job_first_seen_month", "")


def _interpretation(kind: Column) -> tuple[Column, Column]:
    """Confidence and its text; fixed wording."""
    cases = [
        ((F.col("is_left_censored") == "1") & (F.col("first_seen_job_count") >= 5), "low", "观测起点已覆盖多个岗位，只能说明观测期内的覆盖和扩散，不能推断真实起源岗位"),
        (F.col("is_left_censored") == "1", "medium", "技能在观测起点已出现，首现岗位是观测窗口内首批岗位，不等同于真实起源岗位"),
        (F.lower(kind) == "traditional", "medium", "传统技能在观测期内首次出现，可分析样本内扩散，但不代表行业真实首次出现"),
        (F.col("spread_job_count") == 0, "high", "技能在观测期内首次出现，但目前尚未扩散到其他标准岗位"),
    ]
    confidence, text = F.lit("high"), F.lit("技能在观测期内首次出现，后续扩散路径可用于分析样本内技能迁移")
    for holds, name, said in reversed(cases):
        confidence, text = F.when(holds, name).otherwise(confidence), F.when(holds, said).otherwise(text)
    return confidence, text


def migration(frequency: DataFrame, pool: DataFrame | None = None, mentions: int = 2) -> DataFrame:
    """One row for each skill: first and spread jobs, plain and confirmed, peak, totals and confidence. Rows with mentions are enough."""
    start = frequency.agg(F.min("month").alias("data_start_month"))  # one row
    seen = active(frequency).select("skill", "standard_job", "month", "monthly_skill_count", "cumulative_skill_count")
    sure = F.min(F.when(F.col("cumulative_skill_count") >= max(1, mentions), F.col("month")))  # mentions in all, as the table has them
    pairs = seen.groupBy("skill", "standard_job").agg(F.min("month").alias("first"), sure.alias("sure"), F.sum("monthly_skill_count").alias("n"))
    months = seen.groupBy("skill", "month").agg(F.count("*").alias("covered"))  # a pair has a row for each of its months
    wide = months.groupBy("skill").agg(F.max("month").alias("latest_seen_month"), F.max_by("covered", "month").alias("latest_covered_job_count"), F.max(F.struct("covered", "month")).alias("peak"))
    wide = wide.select("*", F.col("peak.covered").alias("peak_monthly_covered_job_count"), F.col("peak.month").alias("peak_monthly_covered_job_month")).drop("peak")
    wide = wide.join(pairs.groupBy("skill").agg(F.sum("n").alias("total_skill_mentions")), "skill")
    confirmed = _paths(pairs.where("sure IS NOT NULL"), "sure", "confirmed_").drop("confirmed_all_standard_jobs")
    out = _paths(pairs, "first", "").join(wide, "skill").join(confirmed, "skill", "left").join(F.broadcast(start))
    texts = {c: F.coalesce(c, F.lit("")) for c in ("confirmed_first_seen_month", "confirmed_first_seen_standard_jobs", "confirmed_spread_standard_jobs", "confirmed_migration_path")}
    counts = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("confirmed_first_seen_job_count", "confirmed_cumulative_covered_job_count", "confirmed_spread_job_count")}
    out = out.withColumns(texts | counts | {"confirmation_min_job_mentions": F.lit(mentions), "is_left_censored": F.when(F.col("first_seen_month") == F.col("data_start_month"), "1").otherwise("0")}).drop("data_start_month")
    out = out.withColumns({"kg_display_skill": F.lit(""), "skill_type": F.lit("")}) if pool is None else pool_lookup(out, pool, ["kg_display_skill", "skill_type"])
    confidence, text = _interpretation(F.col("skill_type"))
    return out.withColumns({"migration_confidence": confidence, "migration_interpretation": text})


def spread(frequency: DataFrame, pool: DataFrame | None = None, mentioned: DataFrame | None = None) -> DataFrame:
    """One row for each skill, job and month: changes against the row before, coverage and first flags.

    A pair's first month comes from the window that changes need anyway; of what is counted over jobs
    there is a row for each skill and month, and one for each skill. These are made of mentioned, the
    rows of frequency with mentions, for callers who have them (skill, standard_job, month,
    monthly_skill_count) without the rest; then frequency is read once.
    """
    said = active(frequency if mentioned is None else mentioned)
    pair = Window.partitionBy("skill", "standard_job")
    order = pair.orderBy("month")
    change = lambda c: F.col(c) - F.lag(c, 1, 0.0).over(order)
    has = F.col("monthly_skill_count") > 0
    rows = frequency.withColumns({"monthly_frequency_change": change("monthly_skill_frequency"), "cumulative_frequency_change": change("cumulative_skill_frequency"), "job_first_seen_month": F.min(F.when(has, F.col("month"))).over(pair)})
    firsts = said.groupBy("skill", "standard_job").agg(F.min("month").alias("month")).groupBy("skill", "month").agg(F.count("*").alias("new"))
    months = said.groupBy("skill", "month").agg(F.count("*").alias("covered_job_count_this_month")).join(firsts, ["skill", "month"], "left")
    upto = Window.partitionBy("skill").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    months = months.select("skill", "month", "covered_job_count_this_month", F.sum(F.coalesce("new", F.lit(0))).over(upto).alias("cumulative_covered_job_count"))
    start = said.agg(F.min("month").alias("data_start_month"))  # a job's rows begin with a mention
    rows = rows.join(months, ["skill", "month"], "left").join(skill_first_month(said), "skill", "left").join(F.broadcast(start))
    flag = lambda c: F.when(c, "1").otherwise("0")
    zero = F.lit(0).cast("long")
    out = rows.withColumns(
        {
            "months_since_skill_first_seen": month_number(F.col("month")) - month_number(F.col("skill_first_seen_month")),
            "is_first_seen_job": flag(F.col("job_first_seen_month") == F.col("skill_first_seen_month")),
            "is_new_job_for_skill": flag(F.col("month") == F.col("job_first_seen_month")),
            "covered_job_count_this_month": F.coalesce("covered_job_count_this_month", zero),
            "cumulative_covered_job_count": F.coalesce("cumulative_covered_job_count", zero),
            "is_left_censored": flag(F.col("skill_first_seen_month") == F.col("data_start_month")),
        }
    ).drop("data_start_month")
    return out.withColumn("kg_display_skill", F.lit("")) if pool is None else pool_lookup(out, pool, ["kg_display_skill"])
