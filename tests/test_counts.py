"""What is made of counts against what the whole grid gives; copies that go when their scope ends."""

import os
import random

from pyspark.sql import functions as F

from skilltide.operators import frequency, lifecycle, migration, pool, profile
from skilltide.plans import serving
from skilltide.sources import readers, writers
from skilltide.sources.shared import scope, stored


def events(spark, seed=1, n=150, repeats=True):
    random.seed(seed)
    ids = [str(i if not repeats else random.randint(0, n)) for i in range(n)]
    rows = [(i, f"{random.choice((2024, 2025))}-{random.randint(1, 12):02d}", random.choice("ABC"), random.sample(["x", "X", "y", "z", "w"], random.randint(0, 3))) for i in ids]
    return spark.createDataFrame(rows, "job_id string, month string, standard_job string, skills array<string>")


def rows(df):
    return sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in df.select(*sorted(df.columns)).collect())


def test_counts_stand_in_for_the_grid(spark):
    ev = events(spark)
    grid = stored(frequency.monthly_frequency(ev), "grid")
    cells, said = frequency.posting_counts(ev)
    active = frequency.active_frequency(cells, said)
    assert rows(active) == rows(grid.where("monthly_skill_count > 0"))
    assert rows(profile.current_snapshots(frequency.latest_frequency(cells, said))) == rows(profile.current_snapshots(grid))
    for as_of in (None, "2024-09"):
        assert rows(lifecycle.monthly_lifecycle(active, None, as_of, jobs=frequency.job_totals(cells, as_of))) == rows(lifecycle.monthly_lifecycle(grid, None, as_of))
    assert rows(migration.migration(active)) == rows(migration.migration(grid))
    assert rows(migration.spread(grid, None, said)) == rows(migration.spread(grid))


def test_unique_ids_change_no_count(spark):
    ev = events(spark, 2, repeats=False)
    for f in (frequency.monthly_frequency, lambda e, unique: frequency.dense_frequency(e, spark.createDataFrame([("A", "f")], "standard_job string, standard_category string"), unique=unique)):
        assert rows(f(ev, unique=True)) == rows(f(ev, unique=False))
    families = [spark.createDataFrame([(j, c) for j in "ABC"], "standard_job string, standard_category string") for c in "f"]
    universe = spark.createDataFrame([(j, s, f"fam {s}", "") for j in "ABC" for s in "xyzw"], "standard_job string, skill string, kg_display_skill string, skill_stage string")
    drop = "normalized_skill"  # of skills that differ in case and come in one event either is the first
    assert rows(pool.skill_pool(ev, families[0], universe, unique=True).drop(drop)) == rows(pool.skill_pool(ev, families[0], universe).drop(drop))


def test_a_pool_counts_each_source_once(spark):
    ev = spark.createDataFrame([("1", "2026-02", "A", ["x", "X"]), ("1", "2026-01", "B", ["x"]), ("2", "2026-03", "A", ["x"])], "job_id string, month string, standard_job string, skills array<string>")
    cats = spark.createDataFrame([("A", "c1"), ("B", "c2")], "standard_job string, standard_category string")
    universe = spark.createDataFrame([(j, "x", "f", "s") for j in "AB"], "standard_job string, skill string, kg_display_skill string, skill_stage string")
    r = pool.skill_pool(ev, cats, universe).first()
    assert (r.mention_count, r.source_count, r.first_seen_month, r.first_seen_job_id, r.last_seen_month, r.last_seen_job_id, r.standard_jobs, r.standard_categories) == (4, 2, "2026-01", "1", "2026-03", "2", "B; A", "c2; c1")


def test_files_are_in_canonical_order(spark, tmp_path):
    grid = frequency.monthly_frequency(events(spark, 3)).repartition(5)
    writers.write_csv(writers.in_order(grid, "frequency"), str(tmp_path / "f"))
    read = [tuple(r) for p in sorted(os.listdir(tmp_path / "f")) if p.endswith(".csv") for r in readers.read_csv(spark, str(tmp_path / "f" / p)).select("standard_job", "skill", "month").collect()]
    assert read == sorted(read) and len(read) == grid.count()
    current = profile.current_snapshots(grid).withColumn("rank_in_month", F.when(F.col("skill") == "y", None).otherwise(F.col("rank_in_month")))
    got = [(r.standard_job, r.rank_in_month if r.rank_in_month is not None else 99, r.skill) for r in writers.in_order(current, "current_profile").collect()]
    assert got == sorted(got)


def test_copies_go_with_their_scope(spark, tmp_path):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    with scope(spark):
        frequency.monthly_frequency(events(spark, 4)).write.parquet(f"file://{tmp_path}/result")
        assert len(set(os.listdir(folder)) - before) == 1
        with scope(spark):
            stored(spark.range(2), "inner")
        assert len(set(os.listdir(folder)) - before) == 1
    assert set(os.listdir(folder)) == before and spark.read.parquet(f"file://{tmp_path}/result").count() > 0
    stored(spark.range(3), "kept")
    assert len(set(os.listdir(folder)) - before) == 1


def test_dictionary_checks(spark):
    jobs = spark.createDataFrame([("A", "f", "a|b"), ("A", "f", "a|b")], "standard_job_title string, standard_category string, match_keywords string")
    words = spark.createDataFrame([("js", "JavaScript"), ("JS", "JavaScript"), ("", ""), (None, None)], "skill_keyword string, normalized_skill string")
    skill = lambda *x: spark.createDataFrame([(v,) for v in x], "skill string")
    got = [(r.status, r.detail) for r in serving.sync_checks(jobs, jobs, words, skill("JavaScript", "SQL"), skill("SQL"), words).collect()]
    assert got == [("通过", "当前 1 条，数据流 1 条，差异 0 条"), ("通过", "泛抽取标准技能 1 个，缺失 0 个"), ("需补齐", "归一化技能 2 个，展示映射缺失 1 个"), ("通过", "当前标准技能 1 个，数据流缺失 0 个")]
    counts, shown = serving.dictionary_previews({"jobs": (jobs.drop("match_keywords"), ["standard_job_title", "match_keywords"]), "words": (words, ["skill_keyword"])}, " jS ", limit=0)
    assert sorted(map(tuple, counts.collect())) == [("jobs", 2, 0, "match_keywords"), ("words", 4, 2, "")] and [(r.key, r.place) for r in shown.collect()] == [("words", 1)]
    assert [r.key for r in serving.dictionary_previews({"a": (words, []), "b": (words, [])}, scope="b")[0].collect()] == ["b"]
