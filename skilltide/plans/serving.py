"""Read-side queries over the derived tables; each gives rows, assembly into series is left to the caller."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import rules as R
from ..operators.extract import normalize_with
from ..operators.profile import with_change


def clamp(limit: int, low: int, high: int) -> int:
    return max(low, min(int(limit), high))


def first_job(df: DataFrame, job: str | None) -> DataFrame:
    """Rows of a job, by default of the first by name; the name comes by a join with one row, not over the driver."""
    if job:
        return df.where(F.col("standard_job") == job)
    return df.join(F.broadcast(df.agg(F.min("standard_job").alias("standard_job"))), "standard_job", "left_semi")


def month_range(df: DataFrame, column: str, start: str | None = None, end: str | None = None) -> DataFrame:
    df = df.where(F.col(column) >= start) if start else df
    return df.where(F.col(column) <= end) if end else df


def keyword_search(df: DataFrame, keyword: str, columns: list[str] | None = None) -> DataFrame:
    """Rows in which any column contains the keyword, case aside."""
    low = keyword.strip().lower()
    if not low:
        return df
    hit = F.lit(False)
    for c in columns or df.columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(low), F.lit(False))
    return df.where(hit)


def resolve_value(df: DataFrame, column: str, wanted: str) -> DataFrame:
    """One row with value: wanted if it occurs, else the first value by name that contains it, else wanted."""
    c = F.col(column)
    found = df.agg(F.max(F.when(c == wanted, c)).alias("exact"), F.min(F.when(F.lower(c).contains(wanted.lower()), c)).alias("part"))
    return found.select(F.coalesce("exact", "part", F.lit(wanted)).alias("value"))


def list_values(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column) != "").select(column).distinct().orderBy(column)


def overview(frequency: DataFrame, lifecycle: DataFrame, migration: DataFrame, diff: DataFrame) -> DataFrame:
    """One row of key figures; of the diffs those to the latest month, as pairs of months."""
    f = frequency.agg(F.max("month").alias("latest_month"), F.countDistinct("standard_job").alias("job_count"), F.countDistinct("skill").alias("skill_count"), F.count("*").alias("frequency_rows"))
    latest = diff.join(F.broadcast(f.select(F.col("latest_month").alias("to_month"))), "to_month", "left_semi")
    d = latest.agg(F.count_if(F.col("change_type") == R.ADDED).alias("latest_new_skill_count"), F.count_if(F.col("change_type") == R.DOWN).alias("latest_declining_skill_count"))
    for part in (lifecycle.agg(F.count("*").alias("lifecycle_rows")), migration.agg(F.count("*").alias("migration_skill_count")), d):  # single rows
        f = f.join(F.broadcast(part))
    return f


def top_skills(frequency: DataFrame, n: int = 8) -> DataFrame:
    """The skills of most mentions in frequency rows of one job."""
    sums = frequency.groupBy("skill").agg(F.sum("monthly_skill_count").alias("mentions"), F.max("cumulative_skill_count").alias("cumulative"))
    return sums.orderBy(F.desc("mentions"), F.desc("cumulative"), "skill").limit(clamp(n, 1, 20))


def job_trend(frequency: DataFrame, job: str | None = None, top_n: int = 8, start: str | None = None, end: str | None = None) -> DataFrame:
    """month, skill, frequency and count of a job's top skills in all its months, zeros included."""
    rows = month_range(first_job(frequency, job), "month", start, end)
    grid = rows.select("month").distinct().join(F.broadcast(top_skills(rows, top_n).select("skill")))
    out = grid.join(rows.select("month", "skill", "monthly_skill_frequency", "monthly_skill_count"), ["month", "skill"], "left")
    return out.select("month", "skill", F.coalesce("monthly_skill_frequency", F.lit(0.0)).alias("frequency"), F.coalesce("monthly_skill_count", F.lit(0).cast("long")).alias("count"))


def lifecycle_rows(lifecycle: DataFrame, job: str | None = None, status: str | None = None, limit: int = 120) -> DataFrame:
    rows = first_job(lifecycle, job)
    rows = rows.where(F.col("lifecycle_status") == status) if status else rows
    return rows.orderBy("lifecycle_status", F.desc("current_monthly_skill_frequency"), F.desc("recent_3m_skill_count"), "skill").limit(clamp(limit, 1, 500))


def migration_leaders(migration: DataFrame, limit: int = 20) -> DataFrame:
    return migration.orderBy(F.desc("spread_job_count"), F.desc("total_skill_mentions"), "skill").limit(clamp(limit, 1, 100))


def skill_spread_tail(spread: DataFrame, skill: str, rows: int = 120) -> DataFrame:
    """The last rows of a skill's spread by month and job."""
    return spread.where(F.col("skill") == skill).orderBy(F.desc("month"), F.desc("standard_job")).limit(rows).orderBy("month", "standard_job")


def monthly_rank(diff: DataFrame, month: str | None = None, kind: str = "emerging", job: str | None = None, limit: int = 20) -> DataFrame:
    """Emerging or declining skills of a month, the latest by default.

    Each skill has one direction: its change from the latest earlier month, settled before types
    are told apart, so that no skill is in both rankings.
    """
    if month:
        rows = diff.where(F.col("to_month") == month)
    else:
        rows = diff.join(F.broadcast(diff.agg(F.max("to_month").alias("to_month"))), "to_month", "left_semi")
    rows = rows.where(F.col("standard_job") == job) if job else rows
    one = Window.partitionBy("skill").orderBy(F.desc("from_month"), "standard_job", "change_type")
    rows = rows.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    if kind == "declining":
        return rows.where(F.col("change_type").isin(*R.DECLINING_TYPES)).orderBy("frequency_delta", F.desc("to_monthly_skill_frequency"), "skill").limit(clamp(limit, 1, 100))
    return rows.where(F.col("change_type").isin(*R.EMERGING_TYPES)).orderBy(F.desc("frequency_delta"), F.desc("to_monthly_skill_frequency"), "skill").limit(clamp(limit, 1, 100))


def profile_rows(snapshots: DataFrame, job: str, month: str, limit: int = 30) -> DataFrame:
    """The active skills of a month's profile: core first, then by frequency, count and rank."""
    rows = snapshots.where((F.col("standard_job") == job) & (F.col("month") == month) & (F.col("monthly_skill_count") > 0))
    return rows.orderBy(F.desc("is_core_skill"), F.desc("monthly_skill_frequency"), F.desc("monthly_skill_count"), "rank_in_month", "skill").limit(limit)


def profile_changes(diff: DataFrame, limit: int = 80) -> DataFrame:
    """The rows of largest change of each type."""
    order = Window.partitionBy("change_type").orderBy(F.desc(F.abs("frequency_delta")), F.desc("to_monthly_skill_frequency"), F.desc("from_monthly_skill_frequency"), "standard_job", "skill")
    return diff.withColumn("place", F.row_number().over(order)).where(F.col("place") <= clamp(limit, 1, 300))


def optimization_profile(current: DataFrame, job: str | None = None, limit: int = 500) -> DataFrame:
    """A job's current profile, with overrides where they were applied, as maintainers see it."""
    rank = F.coalesce(F.col("rank_in_month"), F.lit(999_999))
    return first_job(current, job).orderBy(F.desc("is_core_skill"), F.desc("monthly_skill_frequency"), F.desc("monthly_skill_count"), rank, "skill").limit(clamp(limit, 1, 1000))


#: Fixed texts: what a maintainer is told of a skill's name.
ASK, BY_DICTIONARY, BY_FALLBACK, CANDIDATE, UNKNOWN = (
    "请输入技能名称。",
    "已通过项目归一化词典映射到标准技能，请确认是否加入当前岗位画像。",
    "已通过归一化 API 映射到标准技能，请确认是否加入当前岗位画像。",
    "归一化 API 判断为可新增技能，请确认是否加入当前岗位画像。",
    "本地词典和归一化 API 均未给出可用标准技能，请先维护词典或人工复核。",
)


def normalize_names(names: DataFrame, dictionary: DataFrame, fallback=None) -> DataFrame:
    """What maintainers see of typed skill names (input): the skill, its family, whether and how it was found, and a message."""
    said = F.trim(F.coalesce("input", F.lit("")))
    rows = names.select(said.alias("input"), F.lit("").alias("normalized_skill_candidate"), F.lit("").alias("dictionary_skill_keyword"), said.alias("skill_keyword"), said.alias("span_text"))
    out = normalize_with(rows, dictionary, fallback)
    c = F.col
    matched = (c("normalized_skill") != "") & (c("kg_display_skill") != "") & c("normalization_status").isin("normalized", "new_skill_candidate")
    message = (
        F.when(c("input") == "", ASK).when(~matched, UNKNOWN).when(c("normalization_status") == "new_skill_candidate", CANDIDATE)
        .when(c("normalization_method").startswith("llm_"), BY_FALLBACK).otherwise(BY_DICTIONARY)
    )
    return out.select("input", "normalized_skill", "kg_display_skill", matched.alias("matched"), F.col("normalization_method").alias("match_source"), "normalization_status", "normalization_confidence", message.alias("message"))


def compare_months(snapshots: DataFrame, diff: DataFrame, job: str | None = None, from_month: str | None = None, to_month: str | None = None, limit: int = 80, compared: DataFrame | None = None) -> DataFrame:
    """The largest changes of each type between two months of a job, with their place.

    A month that the job does not have is its first or its last one, and months in the wrong order
    are swapped. Pairs without stored differences are compared by presence and frequency alone.
    compared (standard_job, from_month, to_month) names the pairs whose differences are stored: one
    of them without rows has none. If it is not given, pairs are taken for stored if they have rows.
    """
    rows = first_job(snapshots, job)
    known = lambda m, other: F.coalesce(F.max(F.when(F.col("month") == F.lit(m), F.col("month"))), other)
    ends = rows.agg(known(from_month, F.min("month")).alias("a"), known(to_month, F.max("month")).alias("b"))
    chosen = ends.select(F.least("a", "b").alias("from_month"), F.greatest("a", "b").alias("to_month"))  # one row
    names = ["standard_job", "skill", "from_month", "to_month", "change_type", "frequency_delta", "from_monthly_skill_frequency", "to_monthly_skill_frequency"]
    held = first_job(diff, job).join(F.broadcast(chosen), ["from_month", "to_month"]).select(*names)
    stored = held if compared is None else first_job(compared, job).join(F.broadcast(chosen), ["from_month", "to_month"], "left_semi")
    none = stored.agg((F.count("*") == 0).alias("none"))  # one row
    side = lambda name: rows.where("monthly_skill_count > 0").join(F.broadcast(chosen.select(F.col(f"{name}_month").alias("month"))), "month").select("standard_job", "skill", F.col("monthly_skill_frequency").alias(f"{name}_monthly_skill_frequency"))
    plain = with_change(side("from").join(side("to"), ["standard_job", "skill"], "full")).join(F.broadcast(chosen)).join(F.broadcast(none)).where("none").select(*names)
    return profile_changes(held.unionByName(plain), limit)


def search_profiles(profiles: DataFrame, category: str | None = None, text: str = "") -> DataFrame:
    """Profiles (standard_job, standard_category, skill) of a category in which job, category or skill contains a text."""
    rows = profiles.where(F.col("standard_category") == category) if category else profiles
    return keyword_search(rows, text, ["standard_job", "standard_category", "skill"])


def captured_profile(current: DataFrame, job: str) -> DataFrame:
    """A job's current profile by rank, unranked skills last, then by name, with its place."""
    order = Window.orderBy(F.coalesce("rank_in_month", F.lit(999_999)), "skill")
    return current.where(F.col("standard_job") == job).withColumn("place", F.row_number().over(order))  # one job's skills


def chart(df: DataFrame, label: str, value: str, top: int = 10) -> DataFrame:
    """label and total of the largest sums."""
    return df.groupBy(F.col(label).alias("label")).agg(F.sum(value).alias("total")).orderBy(F.desc("total"), "label").limit(top)


def trend_view(lifecycle: DataFrame, migration: DataFrame) -> DataFrame:
    """Life-cycle rows with their skill's migration, case aside."""
    m = migration.select(
        F.lower("skill").alias("_k"),
        F.col("first_seen_standard_jobs").alias("migration_origin_jobs"),
        F.col("spread_standard_jobs").alias("migration_spread_jobs"),
        F.col("latest_covered_job_count").alias("migration_latest_covered_job_count"),
        F.col("cumulative_covered_job_count").alias("migration_cumulative_covered_job_count"),
        "migration_path",
        "total_skill_mentions",
    )
    return lifecycle.withColumnRenamed("month", "as_of_month").join(m, F.lower("skill") == F.col("_k"), "left").drop("_k")


def emerging_alerts(trend: DataFrame) -> DataFrame:
    return trend.where(F.col("lifecycle_status").isin(*ALERTS["emerging_skill_alerts"]))


def deprecated_alerts(trend: DataFrame) -> DataFrame:
    return trend.where(F.col("lifecycle_status").isin(*ALERTS["deprecated_skill_alerts"]))


#: The alerts of the read model, by the states that they take from the trend view.
ALERTS = {"emerging_skill_alerts": (R.EMERGING,), "deprecated_skill_alerts": (R.DECLINING, R.ABANDONED)}


def publish(spark: SparkSession, database: str, tables: dict[str, DataFrame]) -> None:
    """Tables in the catalog under their names, each as a view on a table of its own that is whole.

    A view is switched in one step, so that a reader sees the old rows or the new ones. The table
    that it showed before stays for those who read it, until the next publication.
    """
    for name, rows in tables.items():
        own = f"{name}__{time.time_ns():020d}"
        rows.write.format("parquet").saveAsTable(f"{database}.`{own}`")
        spark.sql(f"CREATE OR REPLACE VIEW {database}.`{name}` AS SELECT * FROM {database}.`{own}`")
        held = sorted(t.name for t in spark.catalog.listTables(database) if t.name.startswith(f"{name}__") and t.tableType != "VIEW")
        for old in held[:-2]:
            spark.sql(f"DROP TABLE {database}.`{old}`")


def publish_views(spark: SparkSession, database: str, lifecycle: DataFrame, migration: DataFrame) -> None:
    """The read model in the catalog: job_skill_trend as a table, the alerts as views on it."""
    publish(spark, database, {"job_skill_trend": trend_view(lifecycle, migration)})
    for name, states in ALERTS.items():
        listed = ", ".join(f"'{x}'" for x in states)
        spark.sql(f"CREATE OR REPLACE VIEW {database}.{name} AS SELECT * FROM {database}.job_skill_trend WHERE lifecycle_status IN ({listed})")


def profile_feed(snapshots: DataFrame, pool: DataFrame | None = None, top: int = 18) -> DataFrame:
    """The top skills of each job by their latest rows, for résumé generation; mentions come from the pool."""
    latest = snapshots.where("cumulative_skill_count > 0").groupBy("standard_job", "skill").agg(F.max_by(F.struct("cumulative_skill_frequency", "cumulative_skill_count", "month"), "month").alias("l")).select("standard_job", "skill", "l.*")
    if pool is None:
        latest = latest.withColumn("mention_count", F.lit(0).cast("long"))
    else:
        mentions = pool.groupBy(F.lower("normalized_skill").alias("_k")).agg(F.max("mention_count").alias("mention_count"))
        latest = latest.join(mentions, F.lower("skill") == F.col("_k"), "left").drop("_k").na.fill(0, ["mention_count"])
    order = Window.partitionBy("standard_job").orderBy(F.desc("cumulative_skill_frequency"), F.desc("cumulative_skill_count"), F.desc("mention_count"), "skill")
    return latest.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def evolution_nodes(diff: DataFrame, current: DataFrame, changed: int = 4, existing: int = 8) -> DataFrame:
    """Nodes of the evolution map of each job: its largest changes and its leading skills that did not change."""
    by_change = Window.partitionBy("standard_job").orderBy(F.desc(F.abs("frequency_delta")), "skill")
    moved = diff.withColumn("place", F.row_number().over(by_change)).where(F.col("place") <= changed).select("standard_job", "skill", F.lit("changed").alias("band"), "place")
    by_rank = Window.partitionBy("standard_job").orderBy("rank_in_month", "skill")
    rest = current.join(moved.select("standard_job", "skill"), ["standard_job", "skill"], "left_anti")
    rest = rest.withColumn("place", F.row_number().over(by_rank)).where(F.col("place") <= existing).select("standard_job", "skill", F.lit("existing").alias("band"), "place")
    return moved.unionByName(rest)


def dictionary_previews(sources: dict[str, tuple[DataFrame, list[str]]], keyword: str = "", scope: str | None = None, limit: int = 80) -> tuple[DataFrame, DataFrame]:
    """Of dictionaries by key, each with the columns that it needs: a row of counts, and the first rows that contain the keyword as JSON.

    The counts are key, row_count, matched_count and missing_columns; rows are key, place and row, at
    most limit (1 to 300) of each, in the order of their columns. scope: only the dictionary of that key.
    """
    counts, rows = [], []
    for key, (df, needed) in sources.items():
        if scope and key != scope:
            continue
        columns = [F.col(f"`{c}`") for c in df.columns]
        matched = keyword_search(df, keyword)
        missing = "; ".join(c for c in needed if c not in df.columns)
        hit = matched.agg(F.count("*").alias("matched_count"))
        counts.append(df.agg(F.count("*").alias("row_count")).join(F.broadcast(hit)).select(F.lit(key).alias("key"), "row_count", "matched_count", F.lit(missing).alias("missing_columns")))
        rows.append(preview_rows(matched.orderBy(*columns), key, clamp(limit, 1, 300)))
    return reduce(DataFrame.unionByName, counts), reduce(DataFrame.unionByName, rows)


def preview_rows(df: DataFrame, key: str, limit: int) -> DataFrame:
    """The first limit rows of a sorted table, as key, place and JSON."""
    first = df.limit(limit).select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}).alias("row"), F.monotonically_increasing_id().alias("id"))
    return first.select(F.lit(key).alias("key"), F.row_number().over(Window.orderBy("id")).alias("place"), "row")  # of a few rows


#: What the checks of dictionaries against each other are called, and what they say.
SYNC_CHECKS = {
    "jobs": ("当前岗位词典与数据流岗位词典", "需同步", "当前 %d 条，数据流 %d 条，差异 %d 条"),
    "normalized": ("泛抽取技能是否都在归一化词典中", "需补齐", "泛抽取标准技能 %d 个，缺失 %d 个"),
    "display": ("展示词典是否覆盖归一化技能", "需补齐", "归一化技能 %d 个，展示映射缺失 %d 个"),
    "stream": ("数据流技能词典是否覆盖当前技能体系", "需同步", "当前标准技能 %d 个，数据流缺失 %d 个"),
}


def sync_checks(jobs: DataFrame, stream_jobs: DataFrame, alias: DataFrame, normalized: DataFrame, display: DataFrame, stream_alias: DataFrame) -> DataFrame:
    """name, status and detail of four checks: equal job dictionaries, and skills (alias: normalized_skill; others: skill) that the next one has to have."""

    def rows(df: DataFrame, columns: list[str]) -> DataFrame:
        text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]
        return df.select(*text).where(F.concat(*columns) != "").distinct()

    def check(of: str, a: DataFrame, b: DataFrame, both_ways: bool) -> DataFrame:
        name, failing, said = SYNC_CHECKS[of]
        both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), a.columns, "full")
        lost = F.count_if(F.col("_b").isNull())
        n = both.agg(F.count("_a").alias("a"), F.count("_b").alias("b"), (lost + F.count_if(F.col("_a").isNull()) if both_ways else lost).alias("off"))
        detail = F.format_string(said, "a", "b", "off") if both_ways else F.format_string(said, "a", "off")
        return n.select(F.lit(name).alias("name"), F.when(F.col("off") == 0, "通过").otherwise(failing).alias("status"), detail.alias("detail"))

    skills = lambda df, c: rows(df.select(F.col(c).alias("skill")), ["skill"])
    job = ["standard_job_title", "standard_category", "match_keywords"]
    known, listed = skills(alias, "normalized_skill"), skills(normalized, "skill")
    parts = [check("jobs", rows(jobs, job), rows(stream_jobs, job), True), check("normalized", known, listed, False), check("display", listed, skills(display, "skill"), False), check("stream", known, skills(stream_alias, "normalized_skill"), False)]
    return reduce(DataFrame.unionByName, parts)


def run_result(statistics: dict[str, DataFrame], diffs: dict[str, DataFrame], keys: list[str], limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """What a run's comparison found: statistics by table with the number of rows that differ, and the first limit of these as JSON, by their keys."""
    report = [statistics[name].join(F.broadcast(diff.agg(F.count("*").alias("diff_rows")))).select(F.lit(name).alias("key"), "*") for name, diff in diffs.items()]
    rows = [preview_rows(diff.orderBy(*keys), name, limit) for name, diff in diffs.items()]
    return reduce(DataFrame.unionByName, report), reduce(DataFrame.unionByName, rows)
