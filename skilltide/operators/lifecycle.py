"""Life cycle of skills by job: months or annual cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import rules as R
from ..functions.text import clean_text, month_number, month_text, ratio, ratio_change

PAIR = ["standard_job", "skill"]


def job_as_of_months(frequency: DataFrame, as_of: str | None = None) -> DataFrame:
    """standard_job and as_of: a given month for all jobs, or each job's last month with postings."""
    jobs = frequency.where("standard_job <> ''")
    if as_of:
        return jobs.select("standard_job").distinct().withColumn("as_of", F.lit(as_of))
    return jobs.where("monthly_jd_count > 0").groupBy("standard_job").agg(F.max("month").alias("as_of"))


def pool_lookup(skills: DataFrame, pool: DataFrame, columns: list[str]) -> DataFrame:
    """skills with columns of pool by skill, case aside: of each the first filled by (normalized_skill), empty if none."""
    key = F.lower(clean_text(F.col("normalized_skill")))
    firsts = pool.where(key != "").groupBy(key.alias("_key")).agg(*(F.min_by(clean_text(F.col(c)), F.struct(F.col(c) == "", F.col("normalized_skill"))).alias(c) for c in columns))
    joined = skills.withColumn("_key", F.lower("skill")).join(firsts, "_key", "left").drop("_key")
    return joined.withColumns({c: F.coalesce(c, F.lit("")) for c in columns})


def coverage(frequency: DataFrame, as_of: str | None = None, jobs: DataFrame | None = None) -> DataFrame:
    """By skill, case aside: jobs with it up to the overall as-of month, in its last three months and the three before.

    The overall month is the given one, else the last of jobs (standard_job, as_of) with any skill, else that of frequency.
    """
    if as_of:
        seen = frequency.where("monthly_skill_count > 0").withColumn("top", month_number(F.lit(as_of)))
    else:
        top = frequency.agg(month_number(F.max("month")).alias("top")) if jobs is None else jobs.join(frequency.select("standard_job").distinct(), "standard_job", "left_semi").agg(month_number(F.max("as_of")).alias("top"))
        seen = frequency.where("monthly_skill_count > 0").join(F.broadcast(top))  # one row
    away = F.col("top") - month_number(F.col("month"))
    # a row for each skill and job first, so that rows are put together where they are read
    within = lambda low, high, name: F.max(away.between(low, high).cast("int")).alias(name)
    by_job = seen.where(away >= 0).groupBy(F.lower("skill").alias("skill_key"), "standard_job").agg(within(0, 2, "recent"), within(3, 5, "before"))
    out = by_job.groupBy("skill_key").agg(F.count("*").alias("covered_job_count"), F.sum("recent").alias("recent_3m_covered_job_count"), F.sum("before").alias("prev_3m_covered_job_count"))
    return out.withColumn("recent_3m_covered_job_count_change", F.col("recent_3m_covered_job_count") - F.col("prev_3m_covered_job_count"))


def pair_windows(frequency: DataFrame, as_of: DataFrame) -> DataFrame:
    """One row for each job and skill with counts in the windows before the as-of month.

    Months without a row count 0, and cumulative values carry on, so no timeline is filled in:
    windows are sums by distance to the as-of month. The deviation over the last six months
    counts the months since the pair's first row, in millionths and integers, so that it is exact.
    With total_jd_count in as_of, a job's postings up to then, rows with mentions are enough:
    months without one add nothing but postings.
    """
    whole = "total_jd_count" not in as_of.columns
    rows = frequency.join(as_of, "standard_job").withColumn("away", month_number(F.col("as_of")) - month_number(F.col("month"))).where("away >= 0")
    n, away = F.col("monthly_skill_count"), F.col("away")
    within = lambda low, high, value: F.coalesce(F.sum(F.when(away.between(low, high), value)), F.lit(0)).cast("long")
    seen = F.when(n > 0, away)
    millionths = F.round(F.col("monthly_skill_frequency") * 1_000_000).cast("long")
    last = lambda c: F.min_by(c, "away")
    at = lambda distance, c: F.coalesce(F.max(F.when(away == distance, F.col(c))), F.lit(0).cast(frequency.schema[c].dataType))
    # months count as numbers, which an aggregate can hold in place
    out = rows.groupBy(*PAIR, "as_of").agg(
        F.max(seen).alias("_first"),
        F.min(seen).alias("_last"),
        F.least(F.lit(6), F.max("away") + 1).alias("_months"),
        at(0, "monthly_skill_count").alias("current_monthly_skill_count"),
        at(0, "monthly_skill_frequency").alias("current_monthly_skill_frequency"),
        at(1, "monthly_skill_frequency").alias("previous_monthly_skill_frequency"),
        last("cumulative_skill_count").alias("cumulative_skill_count"),
        (last("cumulative_skill_frequency") if whole else ratio(F.sum(n), F.max("total_jd_count"))).alias("cumulative_skill_frequency"),
        within(0, 2, n).alias("recent_3m_skill_count"),
        within(0, 5, n).alias("recent_6m_skill_count"),
        within(0, 2, (n > 0).cast("int")).alias("recent_3m_active_months"),
        within(0, 5, (n > 0).cast("int")).alias("recent_6m_active_months"),
        within(3, 5, n).alias("prev_3m_skill_count"),
        within(6, 11, n).alias("prev_6m_skill_count"),
        within(0, 5, millionths).alias("_s1"),
        within(0, 5, millionths * millionths).alias("_s2"),
    ).where("_first IS NOT NULL")
    out = out.withColumns({f"{end}_seen_month": month_text(month_number(F.col("as_of")) - F.col(f"_{end}")) for end in ("first", "last")})
    deviation = F.when(F.col("_months") > 1, F.sqrt((F.col("_months") * F.col("_s2") - F.col("_s1") * F.col("_s1")).cast("double")) / F.col("_months") / 1_000_000).otherwise(0.0)
    return out.withColumns(
        {
            "age_months": F.col("_first") + 1,
            "months_since_last_seen": F.col("_last"),
            "mom_frequency_change": ratio_change(F.col("current_monthly_skill_frequency"), F.col("previous_monthly_skill_frequency")),
            "recent_3m_vs_prev_3m_change": ratio_change(F.col("recent_3m_skill_count").cast("double"), F.col("prev_3m_skill_count").cast("double")),
            "recent_6m_frequency_stddev": deviation,
        }
    ).drop("_months", "_s1", "_s2", "_first", "_last", "previous_monthly_skill_frequency")


def monthly_status(rules: R.LifecycleRules) -> tuple[Column, Column]:
    """Status and reason of a row of pair_windows(); the first rule that holds counts."""
    c = F.col
    cases = [
        ((c("months_since_last_seen") >= rules.abandoned.silent_months) & (c("recent_3m_skill_count") == 0) & (c("cumulative_skill_count") >= rules.abandoned.mentions), R.ABANDONED, F.format_string("最近3个月未出现，距最后出现已%d个月，历史累计出现%d次", "months_since_last_seen", "cumulative_skill_count")),
        ((c("prev_3m_skill_count") >= rules.declining.before) & (c("recent_3m_skill_count") < c("prev_3m_skill_count") * rules.declining.share_left) & (c("current_monthly_skill_frequency") <= rules.declining.frequency), R.DECLINING, F.format_string("最近3个月出现%d次，低于前3个月%d次的一半", "recent_3m_skill_count", "prev_3m_skill_count")),
        ((c("age_months") <= rules.emerging.age) & (c("recent_3m_skill_count") >= rules.emerging.recent), R.EMERGING, F.format_string("首次出现距今%d个月，最近3个月出现%d次", "age_months", "recent_3m_skill_count")),
        ((c("age_months") <= rules.growing.age) & (c("recent_3m_skill_count") >= rules.growing.recent) & (c("recent_3m_vs_prev_3m_change") >= rules.growing.rise), R.EMERGING, F.format_string("最近3个月相对前3个月增长%.2f", "recent_3m_vs_prev_3m_change")),
        ((c("age_months") >= rules.stable.age) & (c("recent_6m_active_months") >= rules.stable.active_months) & (c("cumulative_skill_frequency") >= rules.stable.cumulative) & (c("current_monthly_skill_frequency") >= rules.stable.frequency) & (c("recent_6m_frequency_stddev") <= rules.stable.deviation), R.STABLE, F.format_string("已持续%d个月，近6个月活跃%d个月，累计频率%.2f", "age_months", "recent_6m_active_months", "cumulative_skill_frequency")),
        ((c("age_months") >= rules.stable.age) & (c("cumulative_skill_count") >= rules.sparse.mentions) & (c("cumulative_skill_frequency") >= rules.sparse.cumulative) & (c("current_monthly_skill_frequency") >= rules.sparse.frequency) & (c("recent_3m_skill_count") >= rules.sparse.recent), R.STABLE, F.format_string("岗位样本较稀疏，但该技能长期累计高频，且观察月频率%.2f", "current_monthly_skill_frequency")),
        (((c("recent_3m_active_months") >= rules.active.months) & (c("current_monthly_skill_frequency") >= rules.active.frequency)) | (c("recent_3m_skill_count") >= rules.active.recent), R.ACTIVE, F.format_string("最近3个月活跃%d个月，最近3个月出现%d次", "recent_3m_active_months", "recent_3m_skill_count")),
    ]
    status, reason = F.lit(R.WATCHED), F.format_string("当前证据不足，最近3个月出现%d次，累计出现%d次", "recent_3m_skill_count", "cumulative_skill_count")
    for holds, name, text in reversed(cases):
        status, reason = F.when(holds, name).otherwise(status), F.when(holds, text).otherwise(reason)
    return status, reason


def monthly_lifecycle(frequency: DataFrame, pool: DataFrame | None = None, as_of: str | None = None, rules: R.LifecycleRules = R.LifecycleRules(), jobs: DataFrame | None = None) -> DataFrame:
    """The life-cycle table: pairs seen by the as-of month, with windows, coverage, status and reason.

    With jobs, which are frequency.job_totals() for the same as_of, frequency needs only its rows with mentions.
    """
    windows = pair_windows(frequency, job_as_of_months(frequency, as_of) if jobs is None else jobs)
    covered = coverage(frequency, as_of, jobs)
    joined = windows.join(covered, F.lower("skill") == F.col("skill_key"), "left").drop("skill_key").na.fill(0, [c for c in covered.columns if c != "skill_key"])
    status, reason = monthly_status(rules)
    named = joined.withColumns({"lifecycle_status": status, "lifecycle_reason": reason}).withColumnRenamed("as_of", "month")
    return named.withColumn("kg_display_skill", F.lit("")) if pool is None else pool_lookup(named, pool, ["kg_display_skill"])


def annual_lifecycle(frequency: DataFrame, as_of: str | None = None, rules: R.AnnualRules = R.AnnualRules()) -> DataFrame:
    """Life cycle by a job's own recruitment cycles, the months in which it has postings.

    Windows are the last three and six cycles and the three before; cumulative values are those
    of the last cycle up to the as-of month.
    """
    rows = frequency.where("monthly_jd_count > 0")
    rows = rows.where(F.col("month") <= as_of) if as_of else rows
    order = Window.partitionBy("standard_job").orderBy("month")
    cycles = rows.select("standard_job", "month").distinct().withColumn("cycle", F.row_number().over(order))
    last = cycles.groupBy("standard_job").agg(F.max("cycle").alias("last_cycle"), F.max("month").alias("as_of"))
    at = rows.join(cycles, ["standard_job", "month"]).join(last, "standard_job").withColumn("back", F.col("last_cycle") - F.col("cycle"))
    n, back = F.col("monthly_skill_count"), F.col("back")
    within = lambda low, high, value: F.coalesce(F.sum(F.when(back.between(low, high), value)), F.lit(0)).cast("long")
    seen = F.when(n > 0, F.col("month"))
    out = at.groupBy(*PAIR, "as_of").agg(
        F.min(seen).alias("first_seen_month"),
        F.max(seen).alias("last_seen_month"),
        F.count_if(n > 0).alias("active_cycles"),
        F.min(F.when(n > 0, back)).alias("cycles_since_last_seen"),
        F.coalesce(F.max(F.when(back == 0, n)), F.lit(0).cast("long")).alias("current_skill_count"),
        F.coalesce(F.max(F.when(back == 0, F.col("monthly_skill_frequency"))), F.lit(0.0)).alias("current_skill_frequency"),
        F.coalesce(F.max(F.when(back > 0, F.col("monthly_skill_frequency"))), F.lit(0.0)).alias("prior_max_frequency"),
        F.max_by("cumulative_skill_count", "month").alias("cumulative_skill_count"),
        F.max_by("cumulative_skill_frequency", "month").alias("cumulative_skill_frequency"),
        within(0, 2, n).alias("recent_3_cycles_skill_count"),
        within(0, 5, n).alias("recent_6_cycles_skill_count"),
        within(3, 5, n).alias("prev_3_cycles_skill_count"),
    ).where("first_seen_month IS NOT NULL")
    c = F.col
    status = (
        F.when((c("active_cycles") >= rules.stable_cycles) & (c("current_skill_count") > 0) & (c("cumulative_skill_frequency") >= rules.stable_cumulative), R.STABLE)
        .when((c("first_seen_month") == c("as_of")) & (c("current_skill_count") > 0), R.EMERGING)
        .when(c("current_skill_count") > 0, R.ACTIVE)
        .when((c("cycles_since_last_seen") >= rules.silent_cycles) & (c("cumulative_skill_count") >= rules.abandoned_mentions), R.ABANDONED)
        .when((c("cycles_since_last_seen") >= 1) & (c("prior_max_frequency") > 0), R.DECLINING)
        .otherwise(R.WATCHED)
    )
    return out.withColumn("lifecycle_status", status)


def lifecycle_summary(lifecycle: DataFrame) -> DataFrame:
    return lifecycle.groupBy("standard_job", "lifecycle_status").agg(F.count("*").alias("n"))
