"""Small cases with results worked out by hand."""

import json

import pytest

from skilltide import rules as R
from skilltide.functions import text as T
from skilltide.operators import compare, extract, frequency, keywords, lifecycle, migration, pool, profile, routing
from skilltide.plans import government, reviews, serving
from pyspark.sql import functions as F


def events(spark, rows):
    return spark.createDataFrame([(f"j{i}", m, job, s) for i, (m, job, s) in enumerate(rows)], "job_id string, month string, standard_job string, skills array<string>")


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_frequency_carries_months_without_the_skill(spark):
    f = by(frequency.monthly_frequency(events(spark, [("2026-01", "A", ["x", "y"]), ("2026-02", "A", ["x"]), ("2026-02", "A", ["x", "x"]), ("2026-03", "B", [])])), "standard_job", "skill", "month")
    assert set(f) == {("A", "x", "2026-01"), ("A", "y", "2026-01"), ("A", "x", "2026-02"), ("A", "y", "2026-02")}
    late = f["A", "y", "2026-02"]
    assert (late.monthly_skill_count, late.cumulative_skill_count, late.cumulative_skill_frequency) == (0, 1, 0.333333)
    assert f["A", "x", "2026-02"].monthly_skill_frequency == 1.0


def test_grids_keep_silent_jobs_and_unseen_skills(spark):
    ev = events(spark, [("2026-01", "A", ["x"]), ("2026-03", "A", []), ("2026-02", "", ["x"])])
    tax = spark.createDataFrame([("A", "c"), ("B", "c")], "standard_job string, standard_category string")
    d = by(frequency.demand_grid(ev, tax), "standard_job", "month")
    assert len(d) == 6 and d["B", "2026-03"].cumulative_jd_count == 0 and d["A", "2026-02"].is_active_month == "no" and d["A", "2026-03"].cumulative_jd_count == 2
    universe = spark.createDataFrame([("B", "z")], "standard_job string, skill string")
    f = by(frequency.dense_frequency(ev, tax, None, None, universe), "standard_job", "skill", "month")
    assert f["B", "z", "2026-02"].monthly_skill_frequency == 0.0 and f["A", "x", "2026-03"].cumulative_skill_frequency == 0.5
    report = frequency.quality_report(ev, tax).first()
    assert (report.event_stream_rows, report.valid_event_rows, report.jobs_without_events, report.unknown_standard_jobs) == (3, 2, "B", "")


def test_ratio_is_half_up_in_integers(spark):
    df = spark.createDataFrame([(1, 128), (1, 3), (5, 0), (2, 3)], "n long, d long")
    assert [r[0] for r in df.select(T.ratio(F.col("n"), F.col("d"))).collect()] == [0.007813, 0.333333, 0.0, 0.666667]


def test_lifecycle_states(spark):
    rows = [(f"2026-0{m}", "A", ["core"] + (["old"] if m <= 2 else []) + (["new"] if m >= 5 else [])) for m in range(1, 7)] + [("2026-02", "A", ["old", "core"])]
    life = by(lifecycle.monthly_lifecycle(frequency.monthly_frequency(events(spark, rows))), "skill")
    assert life["core",].lifecycle_status == R.STABLE and life["new",].lifecycle_status == R.EMERGING and life["old",].lifecycle_status == R.ABANDONED
    assert (life["old",].months_since_last_seen, life["core",].age_months, life["core",].recent_6m_frequency_stddev) == (4, 6, 0.0)
    assert life["new",].lifecycle_reason.startswith("首次出现距今2个月")


def test_month_gaps_count_in_windows(spark):
    life = by(lifecycle.monthly_lifecycle(frequency.monthly_frequency(events(spark, [("2025-01", "A", ["x"]), ("2025-06", "A", ["x"]), ("2025-12", "A", [])]))), "skill")["x",]
    assert (life.recent_3m_skill_count, life.prev_6m_skill_count, life.cumulative_skill_count, life.current_monthly_skill_count) == (0, 2, 2, 0)


def test_annual_cycles(spark):
    rows = [("2023-10", "A", ["s", "gone"]), ("2024-10", "A", ["s"]), ("2025-10", "A", ["s", "fresh"])]
    life = by(lifecycle.annual_lifecycle(frequency.monthly_frequency(events(spark, rows))), "skill")
    assert [life[k,].lifecycle_status for k in ("s", "fresh", "gone")] == [R.STABLE, R.EMERGING, R.DECLINING]


def test_migration(spark):
    f = frequency.monthly_frequency(events(spark, [("2026-01", "A", ["x"]), ("2026-02", "B", ["x"]), ("2026-03", "C", ["x"]), ("2026-03", "C", ["x"])]))
    row = migration.migration(f).first()
    assert (row.first_seen_standard_jobs, row.spread_job_count, row.cumulative_covered_job_count, row.migration_path) == ("A", 2, 3, "2026-01: A -> 2026-02: B -> 2026-03: C")
    assert (row.confirmed_first_seen_month, row.confirmed_cumulative_covered_job_count, row.peak_monthly_covered_job_month, row.migration_confidence) == ("2026-03", 1, "2026-03", "medium")
    s = by(migration.spread(f), "standard_job", "month")
    assert s["B", "2026-02"].cumulative_covered_job_count == 2 and s["B", "2026-02"].is_first_seen_job == "0"


def test_profile_diff_types(spark):
    first = [("2026-01", "A", s) for s in (["stay", "up", "gone"], ["stay", "gone"], ["stay", "down"], ["stay", "down"])]
    later = [("2026-07", "A", s) for s in (["stay", "up", "new"], ["stay", "up"], ["stay", "up"], ["stay", "down"])]
    snaps = profile.snapshots(frequency.monthly_frequency(events(spark, first + later)))
    kinds = {r.skill: r.change_type for r in profile.profile_diff(snaps).collect()}
    assert kinds == {"stay": R.STABLE, "up": R.UP, "gone": R.REMOVED, "down": R.DOWN, "new": R.ADDED}
    current = profile.current_profile(snaps)
    assert {r.skill for r in current.collect()} == {"stay", "up", "down", "new"}
    over = spark.createDataFrame([("1", "A", "UP", "delete", "", "", "", "1"), ("2", "A", "down", "update", "down2", "", "", "1"), ("3", "A", "down", "update", "down3", "", "", "1"), ("4", "A", "made", "add", "", "f", "", "1")], "override_id string, standard_job string, skill string, action string, new_skill string, kg_display_skill string, note string, updated_at string")
    assert {r.skill for r in profile.apply_overrides(current, over).collect()} == {"stay", "down3", "new", "made"}


def test_pool_folds_case_and_needs_a_family(spark):
    ev = events(spark, [("2026-02", "A", ["React"]), ("2026-01", "B", ["react"])])
    cat = spark.createDataFrame([("A", "c1"), ("B", "c2")], "standard_job string, standard_category string")
    uni = spark.createDataFrame([("A", "REACT", "web", "modern"), ("B", "react", "web", "modern")], "standard_job string, skill string, kg_display_skill string, skill_stage string")
    row = pool.skill_pool(ev, cat, uni).first()
    assert (row.mention_count, row.first_seen_month, row.last_seen_month, row.kg_display_skill, row.standard_jobs) == (2, "2026-01", "2026-02", "web", "B; A")
    with pytest.raises(Exception, match="no kg_display_skill"):
        pool.skill_pool(ev, cat, uni.where("standard_job = 'A'")).collect()


def test_comparison(spark):
    a = spark.createDataFrame([("k1", 1, 0.5), ("k2", 2, 0.1), ("k4", 4, 0.2)], "k string, n int, f double")
    b = spark.createDataFrame([("k1", 1, 0.50005), ("k2", 3, 0.9), ("k3", 3, 0.1)], "k string, n int, f double")
    diff = by(compare.compare_tables(a, b, ["k"], ["n", "f"], {"f": 1e-4}), "k")
    assert {k[0]: (r.status, r.column) for k, r in diff.items()} == {"k2": ("value_mismatch", "n"), "k3": ("missing_actual", ""), "k4": ("extra_actual", "")}
    with pytest.raises(Exception, match="same key"):
        compare.compare_tables(a.union(a), b, ["k"], ["n"]).collect()
    at = lambda rate: spark.createDataFrame([(rate,)], "match_rate double")
    assert not compare.passes([at(0.9), at(1.0)]).first().passed and compare.passes([at(0.91)]).first().passed


def test_route_ladder_and_judge(spark):
    c = spark.createDataFrame([("1", "a", "c", 0.9), ("1", "b", "c", 0.8), ("2", "a", "c", 0.76), ("2", "b", "c", 0.75), ("3", "a", "c", 0.4), ("4", "a", "c", 0.83), ("4", "b", "d", 0.82)], "job_id string, name string, category string, score double")
    plain = {r.job_id: r.route_status for r in routing.route(c).collect()}
    assert plain == {"1": "existing_job", "2": "potential_new_job", "3": "new_family", "4": "potential_new_job"}
    d = spark.createDataFrame([("2", "existing_job", "a", 0.9), ("4", "new_family", "", 0.2)], "job_id string, decision_status string, decision_job string, decision_confidence double")
    judged = {r.job_id: (r.route_status, r.standard_job) for r in routing.route(c, d).collect()}
    assert judged["2"] == ("existing_job", "a") and judged["4"] == ("existing_job", "a")


def test_many_keywords_give_the_same_matches(spark, monkeypatch):
    posts = spark.createDataFrame([("1", "Data engineer", "", "sql"), ("2", "", "ai", None)], "job_id string, job_title string, job_responsibility string, job_requirement string")
    words = spark.createDataFrame([("D", "data"), ("D", "SQL"), ("A", "ai"), ("A", "x")], "standard_job string, keyword string")
    fields = {"job_title": 6, "job_responsibility": 5, "job_requirement": 1}
    few = sorted(map(tuple, routing.keyword_matches(posts, words, fields).collect()))
    monkeypatch.setattr(keywords, "BLOCK", 1)
    assert few == sorted(map(tuple, routing.keyword_matches(posts, words, fields).collect())) and len(few) == 3


def test_matcher_is_greedy_and_keeps_word_edges(spark, monkeypatch):
    units = spark.createDataFrame([("1", "S001", "Java, JavaScript and Spring Boot; node.js"), ("2", "S001", ""), ("3", "S001", None)], "job_id string, sentence_id string, text string")
    dic = spark.createDataFrame([("java", "Java", "lang"), ("Spring", "Spring", "fw"), ("spring boot", "Spring Boot", "fw"), ("js", "JS", "lang")], "skill_keyword string, normalized_skill string, kg_display_skill string")
    found = sorted(map(tuple, extract.dictionary_mentions(units, dic).select("job_id", "span_text", "span_start", "normalized_skill_candidate").collect()))
    assert found == [("1", "Java", 0, "Java"), ("1", "Spring Boot", 21, "Spring Boot")]
    monkeypatch.setattr(keywords, "BLOCK", 1)  # blocks of one keyword
    assert found == sorted(map(tuple, extract.dictionary_mentions(units, dic).select("job_id", "span_text", "span_start", "normalized_skill_candidate").collect()))
    assert extract.dictionary_mentions(units.where("false"), dic).count() == 0 and extract.dictionary_mentions(units, dic.where("false")).count() == 0


def test_broad_phrases_need_a_technical_context(spark):
    units = spark.createDataFrame([("1", "负责产品运营"), ("2", "产品运营系统开发")], "job_id string, text string")
    dic = spark.createDataFrame([("产品运营", "s", "f")], "skill_keyword string, normalized_skill string, kg_display_skill string")
    assert [r.job_id for r in extract.dictionary_mentions(units, dic).collect()] == ["2"]


def test_first_entry_of_the_file_counts(spark):
    dic = spark.createDataFrame([("SQL", "second", "f", 2), ("sql", "first", "f", 1)], "skill_keyword string, normalized_skill string, kg_display_skill string, row_order long")
    units = spark.createDataFrame([("1", "SQL")], "job_id string, text string")
    assert extract.dictionary_mentions(units, dic).first().normalized_skill_candidate == "first"


def test_sentences_and_units(spark):
    said = "Node.js 3.5；要求：\r\n - 熟悉 a,b。\n\n、c)"
    got = spark.createDataFrame([(said,)], "t string").select(T.split_sentences(F.col("t"))).first()[0]
    assert got == ["Node.js 3.5", "要求：", "熟悉 a,b", "c"]
    jobs = spark.createDataFrame([("j", "T；t", "a；b"), (None, None, "c")], "job_id string, job_title string, requirements string")
    rows = extract.sentence_units(jobs).orderBy("job_id", "place").collect()
    assert [(r.sentence_id, r.text) for r in rows] == [("job::requirements::0001", "c"), ("j::job_title::0001", "T；t"), ("j::requirements::0001", "a"), ("j::requirements::0002", "b")]
    assert extract.sentence_units(jobs, 1).count() == 2


def test_mentions_are_validated_and_linked(spark):
    units = spark.createDataFrame([("j", "s1", "job_title", 0, "Python development")], "job_id string, sentence_id string, evidence_field string, place int, text string")
    rows = [("j", "s1", "Python development", "", "odd", "2"), ("j", "s1", "Python", "py", "preferred", ""), ("j", "s9", "x", "", "", ""), ("j", "s1", " ", "", "", ""), ("j", "s1", "Java", "", "", "")]
    got = extract.validate_mentions(spark.createDataFrame(rows, "job_id string, sentence_id string, span_text string, skill_keyword string, skill_type string, confidence string"), units)
    assert sorted(r.error for r in got.where("error IS NOT NULL").collect()) == ["empty span_text", "span not found: Java", "unknown sentence_id: s9"]
    valid = got.where("error IS NULL").orderBy("span_text").collect()
    assert [(r.skill_keyword, r.skill_type, r.confidence, r.span_start, r.span_end) for r in valid] == [("py", "preferred", 0.8, 0, 6), ("Python development", "required", 1.0, 0, 18)]
    dic = spark.createDataFrame([("Python", "Python", "lang"), ("development", "Dev", "work"), ("Java", "Java", "lang")], "skill_keyword string, normalized_skill string, kg_display_skill string")
    only = dic.where("skill_keyword <> 'development'")
    mentions = spark.createDataFrame([("x", "Python development")], "skill_keyword string, span_text string")
    assert extract.alias_link(mentions, only).first().dictionary_skill_keyword == "Python" and extract.alias_link(mentions, dic).first().dictionary_skill_keyword == ""


def test_unresolved_skills_go_to_the_fallback(spark):
    dic = spark.createDataFrame([("js", "JavaScript", "lang")], "skill_keyword string, normalized_skill string, kg_display_skill string")
    asked = []

    def fallback(unknown):
        asked.append(sorted(r.skill_keyword for r in unknown.collect()))
        return unknown.selectExpr("skill_keyword", "'New' AS normalized_skill", "'lang' AS kg_display_skill", "'new_skill_candidate' AS normalization_status", "'llm_api' AS normalization_method", "0.7 AS normalization_confidence")

    rows = serving.normalize_names(spark.createDataFrame([("JS",), ("zig",)], "input string"), dic, fallback).orderBy("input").collect()
    assert asked == [["zig"]] and [(r.normalized_skill, r.message) for r in rows] == [("JavaScript", serving.BY_DICTIONARY), ("New", serving.CANDIDATE)]


def test_confirmed_skills_need_one_that_is_valid(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "review_id string, normalized_skill string, kg_display_skill string, decision string")
    assert extract.confirmed_skills(make(("1", "a", "f", None), ("1", "", "", "invalid"))).count() == 1
    with pytest.raises(Exception, match="lacks its name"):
        extract.confirmed_skills(make(("1", "a", "", "confirmed"))).collect()
    with pytest.raises(Exception, match="at least one"):
        extract.confirmed_skills(make(("1", "a", "f", "invalid"))).collect()


def test_government_route_review(spark):
    posts = spark.createDataFrame([("1", "网管", "网络 维护"), ("2", "网管", "none"), ("3", "网管", "网络")], "job_id string, cleaned_job_title string, routing_text string")
    scores = [("1", "a", "x", 0.9), ("1", "b", "x", 0.9), ("1", "c", "y", 1.2), ("2", "a", "x", 0.9), ("3", "a", "x", 0.4), ("3", "b", "x", -1.0)]
    words = spark.createDataFrame([("b", "网络"), ("c", "维护"), ("a", "zz")], "standard_job string, keyword string")
    got = by(routing.route_review(posts, spark.createDataFrame(scores, "job_id string, name string, category string, score double"), words, 2), "job_id")
    one = got["1",]
    assert (one.top1_standard_job, one.top2_standard_job, one.top1_margin, one.top1_keyword_evidence, one.route_status) == ("c", "b", 0.1, "维护", "needs_llm_adjudication")
    assert json.loads(one.top_jobs_json)[1] == {"standard_job": "b", "category": "x", "score": 0.9, "keyword_evidence": ["网络"]} and [c["standard_category"] for c in json.loads(one.top_categories_json)] == ["y", "x"]
    assert "no exact" in got["2",].route_reason and (got["2",].top2_standard_job, got["2",].top1_margin) == ("", 1.0) and got["3",].route_status == "needs_human_review"
    with pytest.raises(Exception, match="cleaned"):
        routing.route_review(posts.withColumn("cleaned_job_title", F.lit(" ")), spark.createDataFrame(scores, "job_id string, name string, category string, score double"), words).collect()


def test_history_and_reviews(spark):
    posts = spark.createDataFrame([("1", "2026-01"), ("2", "2026-01")], "job_id string, month string")
    given = spark.createDataFrame([("1", "a", "c"), ("2", "b", "c")], "job_id string, assigned_standard_job string, assigned_standard_category string")
    assert [r.standard_job for r in government.ingest_history(posts, given, posts.where("job_id = '1'")).collect()] == ["b"]
    for wrong, said in ((given.where("job_id = '1'"), "no assignment of 2"), (given.union(given), "several assignments")):
        with pytest.raises(Exception, match=said):
            government.ingest_history(posts, wrong, posts.where("false")).collect()
    previews = spark.createDataFrame([("1", "existing_job", "t"), ("2", "new_family", "t")], "job_id string, route_status string, title string")
    assert {r.job_id: r.status for r in reviews.submissions(previews, "now").collect()} == {"1": reviews.MERGED, "2": reviews.PENDING}
    queue = reviews.submissions(previews, "now", "manual")
    assert queue.where("status = 'pending'").count() == 2 and reviews.accepted(queue).count() == 0
    ids = {r.job_id: r.review_id for r in queue.collect()}
    decide = lambda i, d: spark.createDataFrame([(i, d)], "review_id string, decision string")
    assert reviews.decided(queue, decide(ids["1"], "confirmed"), "later").first().status == "confirmed"
    for wrong, said in ((decide("x", "confirmed"), "no review"), (decide(ids["1"], "maybe"), "unknown decision")):
        with pytest.raises(Exception, match=said):
            reviews.decided(queue, wrong, "later").collect()
    with pytest.raises(ValueError, match="mode"):
        reviews.submissions(previews, "now", "other")


def test_pools_in_alphabetical_order(spark):
    row = spark.createDataFrame([("b; a", "", "x")], "standard_categories string, standard_jobs string, sources string")
    assert pool.alphabetical(row).first().standard_categories == "a; b"


def test_normalize_admit_and_level(spark):
    dic = spark.createDataFrame([("js", "JavaScript", "lang")], "skill_keyword string, normalized_skill string, kg_display_skill string")
    rows = spark.createDataFrame([("javascript", "", "", ""), ("", "", "JS", ""), ("", "", "new", "")], "normalized_skill_candidate string, dictionary_skill_keyword string, skill_keyword string, span_text string")
    assert [(r.normalized_skill, r.normalization_method) for r in extract.normalize_skills(rows, dic).orderBy("normalization_confidence", "normalization_method").collect()] == [("", "unresolved_local"), ("JavaScript", "extractor_candidate"), ("JavaScript", "skill_keyword_dictionary_exact")]
    new = spark.createDataFrame([("Rust", "lang"), ("沟通能力", "lang"), ("向量", "lang"), ("Rust", "none")], "skill string, kg_display_skill string")
    assert sorted(r.reason for r in extract.admit_new_skills(new, dic).collect()) == ["broad phrase", "technical anchor", "technology name", "unknown family"]
    titles = spark.createDataFrame([("高级Java开发专家",), ("高级产品经理",), ("算法负责人",)], "t string")
    assert [r[0] for r in titles.select(T.normalize_level(F.col("t"))).collect()] == ["Java开发工程师", "高级产品经理", "算法工程师"]


def test_clean_text_and_lists(spark):
    row = spark.createDataFrame([("　a  b\n", "y; x;;x ; NA")], "t string, l string").select(T.clean_text(F.col("t")), T.split_list(F.col("l"))).first()
    assert row[0] == "a b" and row[1] == ["NA", "x", "y"]


def test_government_postings(spark):
    raw = '{"job_uid":"u1","dataset_year":"2024","original":{"职位简介":"运维","专业":"计算机","部门名称":"局"}}'
    rows = [("人社局2024", "网络管理一级主任科员", "学历要求：本科\n备注：无", "http://x", "2024-10-15", raw, "tag"), ("年2023", "科员", "职位简介：录入", "http://y", "2023-10-01", "{}", "")]
    cols = "source_name string, job_title string, job_description string, source_url string, publish_time string, raw string, tags string"
    got = by(government.normalize_postings(spark.createDataFrame(rows, cols)), "source_url")
    a, b = got["http://x",], got["http://y",]
    assert (a.job_id, a.month, a.rule_cleaned_job_title, a.job_responsibility, a.job_requirement, a.government_agency) == ("u1", "2024-10", "网络管理", "运维", "专业：计算机", "局")
    assert a.routing_text == "岗位名称：网络管理一级主任科员\n职位简介：运维\n专业要求：计算机\n技术标签：tag"
    assert b.job_id.startswith("GOV_") and (b.recruitment_year, b.job_responsibility, b.rule_cleaned_job_title) == ("2023", "录入", "科员")
    with pytest.raises(Exception, match="publish_time"):
        government.normalize_postings(spark.createDataFrame([("a", "b", "", "u", "soon", "{}", "")], cols)).collect()
    with pytest.raises(Exception, match="repeated job_id"):
        government.normalize_postings(spark.createDataFrame(rows[:1] * 2, cols)).collect()


def test_government_initial_state(spark):
    raw = lambda n: f'{{"job_uid":"{n}"}}'
    rows = [("2024", "网络运维", "", f"u{n}", f"202{n}-10-01", raw(n)) for n in (3, 4, 5)]
    source = spark.createDataFrame(rows, "source_name string, job_title string, job_description string, source_url string, publish_time string, raw string")
    words = spark.createDataFrame([("运维岗", "运维")], "standard_job string, keyword string")
    dic = spark.createDataFrame([("网络", "网络", "网络技术")], "skill_keyword string, normalized_skill string, kg_display_skill string")
    state = government.initial_state(source, words, words.selectExpr("standard_job", "10 AS priority"), words.selectExpr("standard_job", "'c' AS standard_category"), dic)
    assert state["lifecycle"].first().lifecycle_status == R.STABLE and state["skill_pool"].first().mention_count == 3 and state["current_profile"].first().month == "2025-10"


def test_rank_gives_a_skill_one_direction(spark):
    rows = [("A", "x", "2026-01", "2026-03", R.UP, 0.2, 0.5), ("A", "x", "2026-02", "2026-03", R.DOWN, -0.1, 0.5), ("A", "y", "2026-02", "2026-03", R.ADDED, 0.3, 0.3)]
    d = spark.createDataFrame(rows, "standard_job string, skill string, from_month string, to_month string, change_type string, frequency_delta double, to_monthly_skill_frequency double")
    assert [r.skill for r in serving.monthly_rank(d).collect()] == ["y"] and [r.skill for r in serving.monthly_rank(d, kind="declining").collect()] == ["x"]
