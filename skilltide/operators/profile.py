"""Monthly job profiles, their differences, current profiles and manual overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import rules as R
from ..functions.text import ratio_change, stable_id
from ..schemas import OVERRIDES, conform
from .lifecycle import pool_lookup


def rank_in_month(frequency: DataFrame) -> DataFrame:
    """Rank of the skills that a job has in a month, by count, frequency and name."""
    order = Window.partitionBy("standard_job", "month").orderBy(F.desc("monthly_skill_count"), F.desc("monthly_skill_frequency"), "skill")
    return frequency.where("monthly_skill_count > 0").withColumn("rank_in_month", F.row_number().over(order))


def snapshots(frequency: DataFrame, pool: DataFrame | None = None, rules: R.ProfileRules = R.ProfileRules()) -> DataFrame:
    """The frequency table with core flags, status and rank; skills without mentions in a month have no rank.

    Ranks come from one window in which active skills sort first, so nothing is joined back.
    """
    n = F.col("monthly_skill_count")
    order = Window.partitionBy("standard_job", "month").orderBy((n > 0).desc(), n.desc(), F.desc("monthly_skill_frequency"), "skill")
    core = (n >= rules.core_min_monthly_count) & (F.col("monthly_skill_frequency") >= rules.core_frequency) & (F.col("cumulative_skill_frequency") >= rules.core_frequency)
    out = frequency.withColumns(
        {
            "is_core_skill": F.when(core, "1").otherwise("0"),
            "snapshot_skill_status": F.when(core, R.STABLE).when(n > 0, R.ACTIVE_NOW).otherwise(R.ABSENT),
            "rank_in_month": F.when(n > 0, F.row_number().over(order)),
        }
    )
    return out.withColumn("kg_display_skill", F.lit("")) if pool is None else pool_lookup(out, pool, ["kg_display_skill"])


def _diff_type(rules: R.ProfileRules) -> Column:
    a, b = F.col("from_monthly_skill_count"), F.col("to_monthly_skill_count")
    delta = F.col("to_monthly_skill_frequency") - F.col("from_monthly_skill_frequency")
    stable = (F.col("from_core") == "1") & (F.col("to_core") == "1") & (F.abs(delta) <= rules.stable_core_delta)
    return (
        F.when((F.col("from_cumulative_skill_count") == 0) & (a == 0) & (b > 0), R.ADDED)
        .when((a > 0) & (b == 0), R.REMOVED)
        .when(stable, R.STABLE)
        .when(delta >= rules.change_delta, R.UP)
        .when(delta <= -rules.change_delta, R.DOWN)
    )


SIDE = ["monthly_skill_count", "monthly_skill_frequency", "cumulative_skill_count", "cumulative_skill_frequency"]


def month_pairs(profile: DataFrame) -> DataFrame:
    """All pairs of months of each job, with their postings."""
    cells = profile.groupBy("standard_job", "month").agg(F.max("monthly_jd_count").alias("n"))
    earlier = cells.select(F.col("standard_job"), F.col("month").alias("from_month"), F.col("n").alias("from_monthly_jd_count"))
    later = cells.select(F.col("standard_job"), F.col("month").alias("to_month"), F.col("n").alias("to_monthly_jd_count"))
    return earlier.join(later, "standard_job").where("from_month < to_month")


def profile_diff(profile: DataFrame, months: DataFrame | None = None, rules: R.ProfileRules = R.ProfileRules()) -> DataFrame:
    """Changes between all pairs of months of each job.

    A skill has rows from its first month on, so the later month of a pair has a row whenever the
    earlier one does: rows of the later month are paired with the earlier months of the job and
    then find their earlier row, and only pairs that changed leave the join. Pairs can be limited
    by months (standard_job, from_month, to_month).
    """
    pairs = month_pairs(profile)
    if months is not None:
        pairs = pairs.join(months, ["standard_job", "from_month", "to_month"], "left_semi")
    side = lambda name: profile.select("standard_job", "skill", F.col("month").alias(f"{name}_month"), *(F.col(c).alias(f"{name}_{c}") for c in SIDE), F.col("is_core_skill").alias(f"{name}_core"), *([] if name == "from" else ["kg_display_skill"]))
    both = pairs.join(side("to"), ["standard_job", "to_month"]).join(side("from"), ["standard_job", "skill", "from_month"], "left")
    zeros = {f"from_{c}": F.coalesce(f"from_{c}", F.lit(0).cast(profile.schema[c].dataType)) for c in SIDE}
    both = both.withColumns(zeros).withColumn("change_type", _diff_type(rules)).where("change_type IS NOT NULL")
    a, b = F.col("from_monthly_skill_frequency"), F.col("to_monthly_skill_frequency")
    return both.withColumns({"frequency_delta": b - a, "frequency_delta_ratio": ratio_change(b, a), "is_stable_core": F.when(F.col("change_type") == R.STABLE, "1").otherwise("0")}).drop("from_core", "to_core")


def with_change(both: DataFrame) -> DataFrame:
    """Rows of both months of a full join with change_type by presence and frequency, and frequency_delta; absent frequencies are 0."""
    a, b = "from_monthly_skill_frequency", "to_monthly_skill_frequency"
    kind = F.when(F.col(a).isNull(), R.ADDED).when(F.col(b).isNull(), R.REMOVED).when(F.col(b) > F.col(a), R.UP).when(F.col(b) < F.col(a), R.DOWN).otherwise(R.STABLE)
    return both.withColumn("change_type", kind).na.fill(0.0, [a, b]).withColumn("frequency_delta", F.col(b) - F.col(a))


def save_overrides(stored: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """stored overrides with changes (standard_job, skill, action, kg_display_skill and more) behind them, as of now.

    Changes without a skill or with another action are left out; adding or updating a skill
    without a family is an error. Older overrides of the same skill stay, and the newest counts.
    """
    have = set(changes.columns)
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in have else F.lit("")
    action, skill, family = F.lower(text("action")), text("skill"), text("kg_display_skill")
    error = F.when((action != "delete") & (family == ""), F.raise_error(F.concat(F.lit("kg_display_skill is required for "), skill)).cast("boolean"))
    rows = changes.where(action.isin("add", "update", "delete") & (skill != "")).withColumn("_e", error).where("_e IS NULL")
    new = rows.select(stable_id(text("standard_job"), skill, action, F.lit(now)).alias("override_id"), text("standard_job").alias("standard_job"), skill.alias("skill"), action.alias("action"), text("new_skill").alias("new_skill"), family.alias("kg_display_skill"), text("note").alias("note"), F.lit(now).alias("updated_at"))
    return conform(stored, OVERRIDES).unionByName(conform(new, OVERRIDES))


def fallback_diff(profile: DataFrame, job: str, from_month: str, to_month: str) -> DataFrame:
    """Differences of two months by presence and frequency alone, for pairs that are not stored."""
    rows = profile.where((F.col("standard_job") == job) & (F.col("monthly_skill_count") > 0))
    side = lambda month, name: rows.where(F.col("month") == month).select("skill", F.col("monthly_skill_frequency").alias(f"{name}_monthly_skill_frequency"), F.col("monthly_skill_count").alias(f"{name}_monthly_skill_count"))
    both = side(from_month, "from").join(side(to_month, "to"), "skill", "full")
    out = with_change(both).na.fill(0, ["from_monthly_skill_count", "to_monthly_skill_count"])
    return out.withColumns({"standard_job": F.lit(job), "from_month": F.lit(from_month), "to_month": F.lit(to_month)})


def latest_months(frequency: DataFrame) -> DataFrame:
    """standard_job and month of each job's last month."""
    return frequency.groupBy("standard_job").agg(F.max("month").alias("month"))


def current_profile(profile: DataFrame) -> DataFrame:
    """The skills that each job has in its latest month; a job is one row of the aggregate, so no history meets in one task."""
    return profile.join(latest_months(profile), ["standard_job", "month"], "left_semi").where("monthly_skill_count > 0")


def profile_columns(current: DataFrame, generated_at: str | Column) -> DataFrame:
    """current_profile() as it is kept: with the month and kind of its source and the time at which it was made."""
    names = ["standard_job", "skill", "kg_display_skill", "monthly_jd_count", "monthly_skill_count", "monthly_skill_frequency", "cumulative_jd_count", "cumulative_skill_count", "cumulative_skill_frequency", "snapshot_skill_status", "is_core_skill", "rank_in_month"]
    at = F.lit(generated_at) if isinstance(generated_at, str) else generated_at
    return current.select(*names, F.col("month").alias("source_month"), F.lit("system").alias("source_type"), at.alias("profile_generated_at"))


def current_snapshots(frequency: DataFrame, pool: DataFrame | None = None, rules: R.ProfileRules = R.ProfileRules()) -> DataFrame:
    """current_profile() of the snapshots of a frequency table: only the last months are ranked."""
    return current_profile(snapshots(frequency.join(latest_months(frequency), ["standard_job", "month"], "left_semi"), pool, rules))


def apply_overrides(current: DataFrame, overrides: DataFrame) -> DataFrame:
    """current with the latest override of each job and skill: delete, update (new_skill, kg_display_skill) or add.

    Of overrides at the same time, the one with the larger override_id counts.
    """
    newest = Window.partitionBy("standard_job", F.lower("skill")).orderBy(F.desc("updated_at"), F.desc("override_id"))
    last = overrides.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select(F.col("standard_job").alias("_job"), F.lower("skill").alias("_skill"), "action", F.col("skill").alias("_name"), "new_skill", F.col("kg_display_skill").alias("_family"))
    matched = current.join(last.where("action <> 'add'"), (F.col("standard_job") == F.col("_job")) & (F.lower("skill") == F.col("_skill")), "left").where("action IS NULL OR action <> 'delete'")
    update = F.col("action") == "update"
    kept = matched.withColumns(
        {
            "skill": F.when(update & (F.coalesce("new_skill", F.lit("")) != ""), F.col("new_skill")).otherwise(F.col("skill")),
            "kg_display_skill": F.when(update & (F.coalesce("_family", F.lit("")) != ""), F.col("_family")).otherwise(F.col("kg_display_skill")),
            "is_override": F.when(update, "1").otherwise("0"),
        }
    ).drop("_job", "_skill", "_name", "_family", "action", "new_skill")
    have = current.select(F.col("standard_job").alias("_j"), F.lower("skill").alias("_s"))
    new = last.where("action = 'add'").join(have, (F.col("_job") == F.col("_j")) & (F.col("_skill") == F.col("_s")), "left_anti")
    added = new.select(F.col("_job").alias("standard_job"), F.coalesce(F.nullif("new_skill", F.lit("")), F.col("_name")).alias("skill"), F.col("_family").alias("kg_display_skill"), F.lit("1").alias("is_override"))
    return kept.unionByName(added, allowMissingColumns=True)


def live_effect(before: DataFrame, after: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """What an update changed in current profiles; unchanged rows that are not core are left out."""
    side = lambda df, name: df.select("standard_job", "skill", F.col("monthly_skill_frequency").alias(f"{name}_frequency"), F.col("is_core_skill").alias(f"{name}_core"))
    both = side(before, "before").join(side(after, "after"), ["standard_job", "skill"], "full")
    a, b = F.col("before_frequency"), F.col("after_frequency")
    kind = (
        F.when(a.isNull(), "added").when(b.isNull(), "removed").when(b - a > tolerance, "increased").when(b - a < -tolerance, "decreased")
        .when((F.col("before_core") == "1") & (F.col("after_core") == "1"), "stable_core")
    )
    out = both.withColumn("effect", kind).where("effect IS NOT NULL")
    return out.withColumn("frequency_delta", F.coalesce(b, F.lit(0.0)) - F.coalesce(a, F.lit(0.0)))
