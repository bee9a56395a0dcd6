"""One pass over the events, answers in batches, numbered lines, the catalog, drawn résumés."""

import json

import pytest
from pyspark.sql import functions as F

from skilltide import rules as R
from skilltide.operators import extract, frequency
from skilltide.plans import resumes, serving
from skilltide.sources import readers


def events(spark, rows):
    return spark.createDataFrame(rows, "job_id string, month string, standard_job string, skills array<string>")


def test_an_analysis_reads_the_events_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [("1", "2026-01", "A", ["x", "x", None]), ("1", "2026-01", "A", ["x"]), ("2", "2026-03", "A", []), ("3", "2026-02", "Z", ["y"]), ("", "2025-11", "A", ["lost"]), ("4", "", "A", ["lost"]), ("5", "2026-01", "", ["lost"])]
    held = events(spark, rows)
    tax = spark.createDataFrame([("A", "f"), ("B", "f")], "standard_job string, standard_category string")
    more = spark.createDataFrame([("B", "z")], "standard_job string, skill string")
    found = frequency.analysis(held.mapInArrow(counted, held.schema), tax, universe=more)
    demand, freq, quality = (sorted(map(tuple, d.collect())) for d in (found.job_demand, found.skill_frequency, found.quality))
    assert seen.value == len(rows)
    assert demand == sorted(map(tuple, frequency.demand_grid(held, tax).collect())) and freq == sorted(map(tuple, frequency.dense_frequency(held, tax, universe=more).collect()))
    q = found.quality.first().asDict()
    assert q == {
        "event_stream_rows": 7, "valid_event_rows": 4, "month_start": "2025-11", "month_end": "2026-03", "month_count": 5, "standard_job_count": 2, "event_jobs_in_dictionary": 5, "unknown_standard_jobs": "; Z", "jobs_without_events": "B",
        "n_jobs_without_events": 1, "unique_event_jobs": 3, "unique_event_skills": 3, "job_demand_rows": len(demand), "skill_frequency_rows": len(freq),
    }
    empty = frequency.analysis(held.limit(0), tax)
    assert empty.job_demand.count() == 0 and empty.skill_frequency.count() == 0 and empty.quality.first().event_stream_rows == 0


def test_a_fallback_asks_in_groups_and_only_once(spark, tmp_path):
    cache, log = str(tmp_path / "cache"), tmp_path / "log"

    def ask(words):
        with log.open("a") as f:
            f.write(json.dumps(words) + "\n")
        return [{"skill_keyword": w, "normalized_skill": w.upper(), "kg_display_skill": "f", "normalization_status": "normalized", "normalization_method": "asked", "normalization_confidence": 0.9} for w in words if w != "odd"] + [{"skill_keyword": "not asked"}]

    words = [f"w{i}" for i in range(23)] + ["odd"]
    asked = spark.createDataFrame([(w,) for w in words * 2] + [(None,)], "skill_keyword string").repartition(3)
    told = extract.batched_fallback(ask, cache, 5, 2)(asked)
    assert sorted(r.skill_keyword for r in told.collect()) == sorted(words[:-1])
    groups = [json.loads(x) for x in log.read_text().splitlines()]
    assert sorted(w for g in groups for w in g) == sorted(words) and max(map(len, groups)) == 5 and len(groups) <= 6
    extract.batched_fallback(ask, cache, 5, 2)(asked).count()
    assert [json.loads(x) for x in log.read_text().splitlines()][len(groups) :] == [["odd"]]  # what was not answered
    assert extract.batched_fallback(ask, cache, 5, 1, "another dictionary")(asked).count() == 23
    assert extract.batched_fallback(ask, cache, 5)(asked.limit(0)).count() == 0


def test_a_failing_call_leaves_no_answers(spark, tmp_path):
    def ask(words):
        if "b" in words:
            raise ValueError("down")
        return [{"skill_keyword": w, "normalized_skill": w} for w in words]

    asked = spark.createDataFrame([("a",), ("b",)], "skill_keyword string")
    with pytest.raises(Exception, match="down"):
        extract.batched_fallback(ask, str(tmp_path / "c"), 1, 1)(asked).count()
    assert extract.batched_fallback(lambda w: [{"skill_keyword": x, "normalized_skill": x} for x in w], str(tmp_path / "c"), 1, 1)(asked).count() == 2


def test_a_broken_line_is_named_by_file_and_number(spark, tmp_path):
    for name, n, broken in (("a.json", 90_000, {70_001: "{", 5: "", 6: "  "}), ("b.json", 30_000, {1: '{"k": "x"}', 29_999: "null and void"})):
        (tmp_path / name).write_text("".join(broken.get(i, f'{{"k": {i}, "pad": "{"x" * 60}"}}') + "\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
    try:
        found = readers.broken_lines(spark, str(tmp_path), "k bigint, pad string")
        assert sorted((r.file.rsplit("/", 1)[1], r.line, r.text) for r in found.collect()) == [("a.json", 70_001, "{"), ("b.json", 1, '{"k": "x"}'), ("b.json", 29_999, "null and void")]
        with pytest.raises(ValueError, match=r"a.json, line 70001: .*\{"):
            readers.checked_json_lines(spark, str(tmp_path), "k bigint, pad string")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "x.json").write_text('{"k": 1}\n\n{"k": 2}\n')
    assert readers.checked_json_lines(spark, str(tmp_path / "good"), "k bigint").count() == 2


def test_published_tables_switch_whole(spark, tmp_path):
    spark.sql(f"CREATE DATABASE published LOCATION '{tmp_path}/db'")
    try:
        for n in (1, 2, 3):
            serving.publish(spark, "published", {"t": spark.range(n), "t_more": spark.range(5)})
            reader = spark.sql("SELECT * FROM published.t")
        assert reader.count() == 3 and spark.sql("SELECT count(*) AS n FROM published.t_more").first().n == 5
        held = [t.name for t in spark.catalog.listTables("published") if t.tableType != "VIEW"]
        assert sum(t.startswith("t__") for t in held) == 2 and sum(t.startswith("t_more__") for t in held) == 2
        with pytest.raises(Exception, match="boom"):  # a publication that fails changes nothing
            serving.publish(spark, "published", {"t": spark.range(9).select(F.when(F.col("id") >= 0, F.raise_error(F.lit("boom"))).alias("id"))})
        assert spark.sql("SELECT * FROM published.t").count() == 3
    finally:
        spark.sql("DROP DATABASE published CASCADE")


def test_alert_views_take_their_states(spark, tmp_path):
    life = spark.createDataFrame([("A", s, "2026-01", s) for s in (R.EMERGING, R.DECLINING, R.ABANDONED, "other")], "standard_job string, skill string, month string, lifecycle_status string")
    moved = spark.createDataFrame([], "skill string, first_seen_standard_jobs string, spread_standard_jobs string, latest_covered_job_count long, cumulative_covered_job_count long, migration_path string, total_skill_mentions long")
    spark.sql(f"CREATE DATABASE alerts LOCATION '{tmp_path}/alerts'")
    try:
        serving.publish_views(spark, "alerts", life, moved)
        count = lambda t: spark.sql(f"SELECT count(*) AS n FROM alerts.{t}").first().n
        assert (count("job_skill_trend"), count("emerging_skill_alerts"), count("deprecated_skill_alerts")) == (4, 1, 2)
    finally:
        spark.sql("DROP DATABASE alerts CASCADE")


def test_resumes_are_a_weighted_draw(spark):
    feed = spark.createDataFrame([("A", f"s{i:02d}", i + 1) for i in range(10)] + [("B", f"t{i}", i + 1) for i in range(3)], "standard_job string, skill string, place int")
    made = resumes.synthetic_resumes(feed, 300)
    rows = made.collect()
    assert sorted(map(str, rows)) == sorted(map(str, resumes.synthetic_resumes(feed.repartition(7), 300).collect()))
    own = {"A": {f"s{i:02d}" for i in range(10)}, "B": {f"t{i}" for i in range(3)}}
    assert len(rows) == 600 and all(r.n_own == {"A": 7, "B": 3}[r.standard_job] and len(set(r.skills)) == len(r.skills) == r.n_own + r.n_other and len(set(r.skills) & own[r.standard_job]) == r.n_own for r in rows)
    times = [sum(f"s{i:02d}" in r.skills for r in rows if r.standard_job == "A") for i in range(10)]
    assert times[0] > times[9] + 60 and all(r.n_other <= 2 for r in rows) and any(r.n_other for r in rows)
