"""DuckDB SQL for queries_flow.py and for the text queries of queries.py that need more than one step."""

from __future__ import annotations

import re

from . import oracles as O
from .operators.routing import NEW_FAMILY_RULES, POTENTIAL_JOB_RULES

BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
MARKS = r"[ \t:\-—，,、)]+"
#: Words of p_name with their places, and those that the dictionary has.
SAID = "w AS (SELECT p_partkey, p_name, i, l[i] AS x, length(array_to_string(l[1:i - 1], ' ')) + (i > 1)::INT AS start FROM (SELECT p_partkey, p_name, string_split(p_name, ' ') AS l, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part))"
MENTIONED = f"{O.DICTIONARY}, {SAID}, m AS (SELECT w.*, s, d FROM w JOIN dic ON k = lower(x))"


def _any(terms: tuple[str, ...], text: str = "lower(title)") -> str:
    return "(" + " OR ".join(f"contains({text}, lower('{t}'))" for t in terms) + ")"


def _gap(known_jobs: tuple[str, ...] = ()) -> str:
    cases = [(_any(terms), "new_family", name) for name, terms, _ in NEW_FAMILY_RULES]
    for name, groups, excluded, cover in POTENTIAL_JOB_RULES:
        if not set(cover) & set(known_jobs):
            cases.append((" AND ".join(_any(g) for g in groups) + (f" AND NOT {_any(excluded)}" if excluded else ""), "potential_new_job", name))
    pick = lambda i: "CASE " + " ".join(f"WHEN {c[0]} THEN '{c[i]}'" for c in cases) + " END"
    return f"{pick(1)} AS guard_status, {pick(2)} AS guard_rule"


GOVERNMENT = """src AS (SELECT p_partkey, 'G' || p_partkey AS job_id, p_name, p_brand, p_type, p_size, strftime(DATE '2024-01-01' + p_size, '%Y-%m-%d') AS day FROM part)"""
NAMES = f"""{O.DICTIONARY}, n AS (SELECT upper(keyword) AS input FROM words UNION ALL SELECT unnest(['', '', 'nothing known']))"""
REVIEWED = """q AS (SELECT o_orderpriority AS p, CASE WHEN o_orderstatus = 'F' THEN 'existing_job' ELSE 'new_family' END AS route_status FROM orders),
r AS (SELECT route_status, CASE WHEN route_status = 'existing_job' THEN 'auto_merged' WHEN p = '1-URGENT' THEN 'confirmed' WHEN p = '2-HIGH' THEN 'rejected' ELSE 'pending' END AS status FROM q)"""

#: The reasons of the life-cycle states, in the order of O.STATUS; numbers with two places are written as x.
_WORDS = [
    "'最近3个月未出现，距最后出现已' || months_since_last_seen || '个月，历史累计出现' || cumulative_skill_count || '次'", "'最近3个月出现' || recent_3m_skill_count || '次，低于前3个月' || prev_3m_skill_count || '次的一半'",
    "'首次出现距今' || age_months || '个月，最近3个月出现' || recent_3m_skill_count || '次'", "'最近3个月相对前3个月增长x'", "'已持续' || age_months || '个月，近6个月活跃' || recent_6m_active_months || '个月，累计频率x'",
    "'岗位样本较稀疏，但该技能长期累计高频，且观察月频率x'", "'最近3个月活跃' || recent_3m_active_months || '个月，最近3个月出现' || recent_3m_skill_count || '次'",
]
_parts = re.split(r"THEN '[^']*'", O.STATUS.rsplit(" ELSE ", 1)[0])
_REASON = "".join(f"{p}{f'THEN {w}' if w else ''}" for p, w in zip(_parts, [*_WORDS, ""], strict=True)) + " ELSE '当前证据不足，最近3个月出现' || recent_3m_skill_count || '次，累计出现' || cumulative_skill_count || '次' END"


def _drawn(*of: str) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', {', '.join(of)})), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


_head, _tail = O._dense(True).rsplit("\nSELECT month, month_index", 1)
_DENSE_CTE = f"{_head},\ndense AS (SELECT month, month_index{_tail})"

FLOW_SQL = {
    "truncated_texts": "SELECT doc_id, CASE WHEN length(text) > 30 THEN substr(text, 1, 30) || '...' ELSE text END AS text FROM documents",
    "sentence_units": rf"""WITH c AS (SELECT doc_id::VARCHAR AS job_id, trim(regexp_replace(coalesce(source, ''), '{BLANK}', ' ', 'g')) AS title, trim(regexp_replace(coalesce(text, ''), '{BLANK}', ' ', 'g')) AS t FROM documents),
l AS (SELECT job_id, title, list_filter(regexp_split_to_array(t, '[\n。！？；;]+'), lambda x: trim(x) <> '') AS l FROM c),
u AS (SELECT job_id, title, unnest(l) AS x, generate_subscripts(l, 1) AS n FROM l)
SELECT job_id, job_id || '::job_title::0001' AS sentence_id, 'job_title' AS evidence_field, 0 AS place, title AS text FROM l WHERE title <> ''
UNION ALL SELECT job_id, job_id || '::job_description::' || lpad(n::VARCHAR, 4, '0'), 'job_description', (n - 1 + (title <> '')::INT)::INT, regexp_replace(regexp_replace(x, '^{MARKS}', ''), '{MARKS}$', '') FROM u""",
    "dictionary_mentions": f"""WITH {MENTIONED} SELECT p_partkey, p_name AS text, x AS span_text, start::INT AS span_start, (start + length(x))::INT AS span_end, x AS skill_keyword, s AS normalized_skill_candidate, d AS kg_display_skill_candidate,
'required' AS skill_type, 1.0::DOUBLE AS confidence, 'dictionary_literal_match' AS reason, 'dictionary_literal' AS match_method, x AS dictionary_skill_keyword FROM m""",
    "job_skills": f"""WITH {MENTIONED}, {O.PARTS}, a AS (SELECT p_partkey, x, 'required' AS t, 1.0::DOUBLE AS c, s, d FROM m UNION ALL SELECT p_partkey, z, 'preferred', 0.5::DOUBLE, NULL, NULL FROM parts WHERE lower(z) NOT IN (SELECT k FROM dic))
SELECT p_partkey::VARCHAR AS job_id, x AS skill_keyword, t AS skill_type, count(*) AS mention_count, c AS max_confidence, coalesce(s, '') AS normalized_skill, coalesce(d, '') AS kg_display_skill, CASE WHEN s IS NULL THEN 'unresolved' ELSE 'normalized' END AS normalization_status FROM a GROUP BY ALL""",
    "dictionary_hints": f"WITH {MENTIONED} SELECT p_partkey::VARCHAR AS job_id, 1 AS place, x AS skill_keyword, d AS kg_display_skill FROM m QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(x) DESC, x DESC, start) = 1",
    "alias_link": f"""WITH {MENTIONED}, c AS (SELECT p_partkey, count(DISTINCT x) AS n, min(x) AS x, min(s) AS s FROM m GROUP BY ALL), whole AS (SELECT p_partkey, dic.k, dic.s FROM part JOIN dic ON k = lower(p_name)), word AS (SELECT p_partkey, dic.k, dic.s FROM part JOIN dic ON k = lower(p_type))
SELECT part.p_partkey, coalesce(word.k, whole.k, CASE WHEN n = 1 THEN x END, '') AS dictionary_skill_keyword, coalesce(word.s, whole.s, CASE WHEN n = 1 THEN c.s END, '') AS normalized_skill_candidate FROM part LEFT JOIN c ON c.p_partkey = part.p_partkey LEFT JOIN whole ON whole.p_partkey = part.p_partkey LEFT JOIN word ON word.p_partkey = part.p_partkey""",
    "dictionary_summary": f"WITH {O.DICTIONARY} SELECT d AS kg_display_skill, count(*) AS keyword_count, array_to_string(list_sort(list(k))[1:3], '; ') AS example_skill_keywords FROM dic GROUP BY d ORDER BY keyword_count DESC, d LIMIT 5",
    "commonest_category": "WITH c AS (SELECT p_brand, CASE WHEN p_size > 5 THEN p_type ELSE '未分类' END AS category, count(*) AS n FROM part GROUP BY ALL) SELECT p_brand AS normalized_skill, category, (SELECT count(*) FROM part WHERE p_brand = c.p_brand) AS gold_count FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, category) = 1",
    "confirmed_skills": "SELECT p_brand AS review_id, p_type AS kg_display_skill, count(*) AS n FROM part WHERE p_size <= 25 GROUP BY ALL",
    "merged_mentions": "WITH a AS (SELECT DISTINCT p_brand, p_name AS skill FROM part WHERE p_size > 25), b AS (SELECT DISTINCT p_brand, p_name AS skill FROM part) SELECT *, 'first' AS of FROM a UNION ALL SELECT p_brand, upper(skill), 'second' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
    "admitted_skills": "SELECT p_partkey, reason = 'technology name' AS admitted, reason FROM (SELECT p_partkey, CASE WHEN p_size > 40 THEN 'empty skill' WHEN p_type = 'PROMO' THEN 'unknown family' WHEN p_size > 30 THEN 'broad phrase' ELSE 'technology name' END AS reason FROM part)",
    "normalized_names": f"""WITH {NAMES} SELECT n.input, coalesce(s, '') AS normalized_skill, coalesce(d, '') AS kg_display_skill, s IS NOT NULL AS matched, CASE WHEN s IS NULL THEN 'unresolved_local' ELSE 'skill_keyword_dictionary_exact' END AS match_source, CASE WHEN s IS NULL THEN 'unresolved' ELSE 'normalized' END AS normalization_status,
CASE WHEN s IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS normalization_confidence, CASE WHEN n.input = '' THEN '请输入技能名称。' WHEN s IS NULL THEN '本地词典和归一化 API 均未给出可用标准技能，请先维护词典或人工复核。' ELSE '已通过项目归一化词典映射到标准技能，请确认是否加入当前岗位画像。' END AS message FROM n LEFT JOIN dic ON k = lower(n.input)""",
    "category_texts": O.base(True) + "\nSELECT standard_category, standard_category || ' ' || string_agg(standard_job || CASE WHEN standard_job LIKE '%1' THEN ' one|two' ELSE '' END, ' ' ORDER BY standard_job) AS profile FROM tax GROUP BY standard_category",
    "gap_rules": f"""WITH t AS (SELECT p_partkey, p_name || CASE WHEN p_size % 9 > 0 THEN ' ' || ['音视频工程师', 'Python开发', '大模型测试', 'RAG开发 Agent', 'RAG开发', '芯片 DFT', '热设计', '用户体验'][p_size % 9] ELSE '' END AS title FROM part) SELECT p_partkey, title, {_gap(("热设计工程师",))} FROM t""",
    "government_route_review": f"""WITH {O.COSINE}, s AS (SELECT cos.job_id, name, category, greatest(0.0::DOUBLE, least(1.0::DOUBLE, round(score, 4))) AS score, contains('near job-' || label, name) AS e FROM cos JOIN embeddings ON vec_id = cos.job_id),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, e DESC, name) AS n FROM s), p AS (SELECT a.job_id, a.category, a.name, a.score, a.e, coalesce(b.name, '') AS name2, b.score AS score2, coalesce(a.score - b.score, 1.0) AS margin FROM r a LEFT JOIN r b ON b.job_id = a.job_id AND b.n = 2 WHERE a.n = 1)
SELECT job_id, category AS top1_standard_category, name AS top1_standard_job, round(score, 6) AS top1_score, name2 AS top2_standard_job, coalesce(round(score2, 6), 0.0) AS top2_score, round(margin, 6) AS top1_margin, CASE WHEN e THEN name ELSE '' END AS top1_keyword_evidence,
CASE WHEN score < 0.45::DOUBLE THEN 'needs_human_review' ELSE 'needs_llm_adjudication' END AS route_status, CASE WHEN score < 0.45::DOUBLE THEN 'top1 text2vec score below candidate floor 0.45' WHEN NOT e THEN 'semantic candidate has no exact government dictionary keyword evidence'
WHEN margin < 0.05::DOUBLE THEN 'top1/top2 semantic margin is below 0.05' ELSE 'government routes require LLM adjudication before formal event assignment' END AS route_reason, '' AS selected_standard_category, '' AS selected_standard_job FROM p""",
    "title_similarity": O.base(True)
    + """, t AS (SELECT DISTINCT p_brand AS k, '' AS c, replace(lower(p_brand), '#', '_') AS t FROM part), j AS (SELECT standard_job AS k, standard_category AS c, lower(standard_job) AS t FROM tax),
g1 AS (SELECT k, c, substr(t, i, 2) AS g, count(*) AS n FROM (SELECT k, c, t, unnest(generate_series(1, length(t) - 1)) AS i FROM t) GROUP BY ALL), g2 AS (SELECT k, c, substr(t, i, 2) AS g, count(*) AS n FROM (SELECT k, c, t, unnest(generate_series(1, length(t) - 1)) AS i FROM j) GROUP BY ALL),
s1 AS (SELECT k, sum(n * n)::BIGINT AS s FROM g1 GROUP BY k), s2 AS (SELECT k, sum(n * n)::BIGINT AS s FROM g2 GROUP BY k)
SELECT g1.k AS job_id, g2.k AS name, g2.c AS category, round(sum(g1.n * g2.n)::DOUBLE / sqrt((any_value(s1.s) * any_value(s2.s))::DOUBLE), 6) AS score FROM g1 JOIN g2 ON g1.g = g2.g JOIN s1 ON s1.k = g1.k JOIN s2 ON s2.k = g2.k GROUP BY g1.k, g2.k, g2.c""",
    "title_topk": """WITH t AS (SELECT p_partkey AS k, lower(p_name || ' ' || p_type) AS t FROM part), j AS (SELECT DISTINCT p_type || ' ' || split_part(p_name, ' ', 1) AS k, p_type AS c, lower(p_type || ' ' || split_part(p_name, ' ', 1)) AS t FROM part),
g1 AS (SELECT k, substr(t, i, 2) AS g, count(*) AS n FROM (SELECT k, t, unnest(generate_series(1, length(t) - 1)) AS i FROM t) GROUP BY ALL), g2 AS (SELECT k, c, substr(t, i, 2) AS g, count(*) AS n FROM (SELECT k, c, t, unnest(generate_series(1, length(t) - 1)) AS i FROM j) GROUP BY ALL),
s1 AS (SELECT k, sum(n * n)::BIGINT AS s FROM g1 GROUP BY k), s2 AS (SELECT k, c, sum(n * n)::BIGINT AS s FROM g2 GROUP BY ALL),
m AS (SELECT g1.k AS job_id, g2.k AS name, g2.c AS category, sum(g1.n * g2.n)::DOUBLE / sqrt((any_value(s1.s) * any_value(s2.s))::DOUBLE) AS x FROM g1 JOIN g2 ON g1.g = g2.g JOIN s1 ON s1.k = g1.k JOIN s2 ON s2.k = g2.k AND s2.c = g2.c GROUP BY g1.k, g2.k, g2.c)
SELECT job_id, name, category, (row_number() OVER (PARTITION BY job_id ORDER BY x DESC, name, category))::INT AS rank, round(x, 6) AS score FROM m WHERE x >= 0.3 - 1e-9 QUALIFY rank <= 3""",
    "judged_routes": f"""WITH {O.COSINE}, c AS (SELECT job_id, name, score, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, name) AS n FROM cos)
SELECT job_id, CASE WHEN round(score, 4) > 0.2::DOUBLE THEN 'existing_job' ELSE 'potential_new_job' END AS decision_status, CASE WHEN round(score, 4) > 0.2::DOUBLE THEN name ELSE '' END AS decision_job, 1.0::DOUBLE AS decision_confidence FROM c WHERE n = 2""",
    "compared_months": O.profiles(f"SELECT {O.RANK_COLUMNS}, (row_number() OVER (PARTITION BY change_type ORDER BY abs(frequency_delta) DESC, to_monthly_skill_frequency DESC, from_monthly_skill_frequency DESC, standard_job, skill))::INT AS place FROM diffs WHERE standard_job = 'BUILDING' AND from_month = '1996-01' AND to_month = '1997-01'"),
    "compared_months_fallback": O.profiles(
        """, e AS (SELECT min(month) AS a, max(month) AS b FROM snaps WHERE standard_job = 'BUILDING'), x AS (SELECT * FROM snaps WHERE standard_job = 'BUILDING' AND month = (SELECT a FROM e) AND monthly_skill_count > 0), y AS (SELECT * FROM snaps WHERE standard_job = 'BUILDING' AND month = (SELECT b FROM e) AND monthly_skill_count > 0)
SELECT 'BUILDING' AS standard_job, coalesce(x.skill, y.skill) AS skill, (SELECT a FROM e) AS from_month, (SELECT b FROM e) AS to_month,
  CASE WHEN x.skill IS NULL THEN '新增技能' WHEN y.skill IS NULL THEN '消失技能' WHEN y.monthly_skill_frequency > x.monthly_skill_frequency THEN '频率上升技能' WHEN y.monthly_skill_frequency < x.monthly_skill_frequency THEN '频率下降技能' ELSE '稳定核心技能' END AS change_type,
  coalesce(y.monthly_skill_frequency, 0) - coalesce(x.monthly_skill_frequency, 0) AS frequency_delta, coalesce(x.monthly_skill_frequency, 0) AS from_monthly_skill_frequency, coalesce(y.monthly_skill_frequency, 0) AS to_monthly_skill_frequency FROM x FULL JOIN y ON x.skill = y.skill"""
    ),
    "profile_of_month": O.profiles("SELECT skill, rank_in_month, is_core_skill FROM snaps WHERE standard_job = 'BUILDING' AND month = '1996-06' AND monthly_skill_count > 0 ORDER BY is_core_skill DESC, monthly_skill_frequency DESC, monthly_skill_count DESC, rank_in_month, skill LIMIT 30"),
    "captured_profile": O.profiles(", c AS (SELECT skill, rank_in_month FROM curp WHERE standard_job = 'NATION_7' UNION ALL SELECT 'Handmade', 999999) SELECT skill, (row_number() OVER (ORDER BY rank_in_month, skill))::INT AS place FROM c", True),
    "searched_profiles": O.profiles("SELECT standard_job, standard_category, skill FROM curp JOIN tax USING (standard_job) WHERE standard_category = 'ASIA' AND contains(lower(skill), 'brand#1')", True),
    "saved_overrides": """SELECT n_name AS standard_job, n_name AS skill, CASE WHEN n_regionkey = 0 THEN 'delete' ELSE 'add' END AS action, '' AS new_skill, CASE WHEN n_regionkey > 1 THEN 'Family' ELSE '' END AS kg_display_skill, '' AS note, '2026-02-01' AS updated_at FROM nation WHERE n_regionkey <> 1
UNION ALL SELECT * FROM (VALUES ('NATION_3', 'Brand#11 ECONOMY', 'delete', '', '', '', '2026-01-01'), ('NATION_3', 'Brand#12 STANDARD', 'update', 'Renamed', 'Family', '', '2026-01-01'), ('NATION_3', 'Brand#12 STANDARD', 'delete', '', '', '', '2025-12-31'), ('NATION_7', 'Handmade', 'add', '', 'Family', '', '2026-01-02'))""",
    "government_postings": f"""WITH {GOVERNMENT} SELECT job_id, day AS publish_time, substr(day, 1, 7) AS month, CASE WHEN p_size > 25 THEN '2023' ELSE '2024' END AS recruitment_year, p_brand AS government_agency, p_name || '一级主任科员' AS job_title, p_name AS rule_cleaned_job_title, p_name AS job_responsibility, '专业：' || p_type AS job_requirement FROM src""",
    "government_initial_frequency": f"""WITH {O.ASSIGNED.replace("lower(p_name)", "lower(p_name || '一级主任科员')").replace("lower(p_type)", "lower(p_name)").replace("lower(p_brand)", "lower('专业：' || p_type)")}, dic AS (SELECT keyword AS k, upper(keyword) AS s FROM words WHERE length(keyword) > 4), {GOVERNMENT},
e AS (SELECT src.job_id, substr(day, 1, 7) AS month, assigned_standard_job AS standard_job, p_name || ' ' || p_type AS t FROM src JOIN asg ON asg.job_id = src.p_partkey::VARCHAR WHERE assigned_standard_job <> ''),
c AS (SELECT standard_job, s AS skill, count(*) AS n FROM e JOIN dic ON contains(lower(t), k) GROUP BY ALL) SELECT standard_job, skill, n, n AS last FROM c""",
    "government_history": "SELECT o_orderkey AS job_id, strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS standard_job, 'all' AS standard_category FROM orders WHERE o_orderstatus <> 'F'",
    "government_raw_events": f"WITH {GOVERNMENT} SELECT 'unprocessed' AS route_status, 'published' AS event_time_type, 'annual_recruitment_cycle' AS source_time_granularity, substr(day, 1, 7) AS month, count(*) AS n FROM src GROUP BY ALL",
    "title_audit": "SELECT count(*) AS n_rows, count(DISTINCT p_name) AS n_titles, count(DISTINCT p_name) FILTER (regexp_matches(p_name, '^(red|blue) ')) AS n_changed FROM part",
    "csv_round_trip": O.freq(False) + "\nSELECT * FROM freq",
    "text_ratios": O.freq(False) + "\nSELECT standard_job, skill, month, round(monthly_skill_frequency::DECIMAL(18, 6), 4)::DECIMAL(18, 4)::VARCHAR AS monthly_skill_frequency FROM freq",
    "json_lines_round_trip": O.base(True, O.COUNTS, O._calendar(), O.DEMAND) + "\nSELECT standard_job, standard_category, month, month_index, monthly_jd_count, cumulative_jd_count, is_active_month FROM demand",
    "events_from_csv": O.base(False) + "\nSELECT * FROM said",
    "cache_of_last_entries": "SELECT l_orderkey AS key, l_linenumber AS n, l_returnflag AS said FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) = 1",
    "keyed_upsert": "SELECT n_nationkey, CASE WHEN n_regionkey > 2 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation",
    "replaced_by_key": "SELECT n_nationkey, n_name, n_regionkey, 101::BIGINT AS next FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 100, 'only', 2, 101",
    "review_flow": f"""WITH {REVIEWED} SELECT status, route_status, CASE WHEN status IN ('confirmed', 'rejected') THEN '2026-01-02' ELSE '2026-01-01' END AS updated_at, count(*) AS n, count(*) FILTER (status IN ('auto_merged', 'confirmed')) AS n_accepted FROM r GROUP BY ALL""",
    "found_reviews": "SELECT o_orderkey::VARCHAR AS review_id, strftime(o_orderdate, '%Y-%m-%d') AS created_at FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY created_at DESC, review_id LIMIT 50",
    "table_counts": "SELECT 'nation' AS \"table\", count(*) AS n_rows FROM nation UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events",
    "aliased_upload": "SELECT p_partkey::VARCHAR AS job_id, '' AS month, p_name AS job_title, '' AS job_responsibility, p_type AS job_requirement FROM part",
    "dictionary_digest": f"WITH {O.DICTIONARY} SELECT sha256(string_agg(k || chr(31) || s || chr(31) || d, chr(10) ORDER BY k)) AS digest, count(*) AS n_keywords FROM dic",
    "stream_gate": O.base(False) + "\nSELECT standard_job, count(*) AS n, CASE WHEN standard_job IN ('MACHINERY', 'BUILDING') THEN 'queue' ELSE 'events' END AS of FROM post GROUP BY ALL",
    "stream_dry_run": O.base(False) + "\nSELECT standard_job, count(*) FILTER (month >= '1997-01') AS n_new, count(*) FILTER (month < '1997-01') AS n_stored FROM post GROUP BY ALL",
    "stream_numeric_names": O.freq(False) + "\nSELECT * REPLACE (lpad(ascii(standard_job)::VARCHAR, 3, '0') AS standard_job) FROM freq",
    "stream_folders_read": O.base(False) + "\nSELECT standard_job, count(*) AS n_new, true AS most_left_alone FROM post WHERE length(job_id) = 1 GROUP BY ALL",
    "stream_effects": O.ORACLE_EFFECTS,
    "stream_monthly_counts": "SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n FROM events GROUP BY ALL",
    "broken_json_lines": """SELECT CASE WHEN p_partkey % 97 = 0 THEN '{"p_partkey":' ELSE 'no JSON ' END || p_partkey AS text, true AS numbered FROM part WHERE p_partkey % 97 = 0 OR p_partkey % 89 = 0""",
    "catalog_trend": O.trend("TRUE"),
    "catalog_emerging_alerts": O.ORACLE_SQL["emerging_alerts"],
    "catalog_deprecated_alerts": O.ORACLE_SQL["deprecated_alerts"],
    "analysis_bundle": O.base(True, O.COUNTS, O._calendar(), O.DEMAND, _DENSE_CTE)
    + """\nSELECT 'job_demand' AS "table", standard_job, month, '' AS skill, monthly_jd_count AS n, cumulative_jd_count AS total FROM demand UNION ALL SELECT 'skill_frequency', standard_job, month, skill, monthly_skill_count, cumulative_skill_count FROM dense
UNION ALL SELECT 'rows', (SELECT min(month) FROM cal), (SELECT max(month) FROM cal), '', (SELECT count(*) FROM demand), (SELECT count(*) FROM dense) UNION ALL SELECT 'events', '', '', '', (SELECT count(*) FROM post), (SELECT count(DISTINCT skill) FROM dense)""",
    "fallback_in_batches": """WITH p AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS w FROM part), d AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part)
SELECT p_partkey, w AS skill_keyword, upper(w) AS normalized_skill, CASE WHEN length(w) > 4 THEN substr(w, 1, 1) ELSE 'fits' END AS kg_display_skill, CASE WHEN length(w) > 4 THEN 'skill_keyword_dictionary_exact' ELSE 'asked' END AS normalization_method FROM p""",
    "current_profile_kept": O.profiles("SELECT standard_job, skill, month AS source_month, 'system' AS source_type, '2026-01-01T00:00:00+00:00' AS profile_generated_at FROM curp", True),
    "synthetic_resumes": O.profiles(
        f""", l AS (SELECT standard_job, skill, arg_max(cumulative_skill_frequency, month) AS f, arg_max(cumulative_skill_count, month) AS c FROM snaps WHERE cumulative_skill_count > 0 GROUP BY ALL),
feed AS (SELECT standard_job, skill, row_number() OVER (PARTITION BY standard_job ORDER BY f DESC, c DESC, skill) AS place FROM l QUALIFY place <= 18),
res AS (SELECT standard_job, standard_job || '-' || lpad(n::VARCHAR, 6, '0') AS resume_id FROM (SELECT DISTINCT standard_job FROM feed), range(20) r(n)),
own AS (SELECT res.*, skill, row_number() OVER (PARTITION BY resume_id ORDER BY -ln({_drawn("42", "resume_id", "skill")}) / (1.0::DOUBLE / place), skill) AS n, count(*) OVER (PARTITION BY resume_id) AS size FROM res JOIN feed USING (standard_job)),
kept AS (SELECT * FROM own WHERE n <= ceil(size * 0.7::DOUBLE)),
placed AS (SELECT skill, row_number() OVER (ORDER BY floor({_drawn("skill")} * 64)::INT, skill) - 1 AS spot FROM (SELECT DISTINCT skill FROM feed)),
need AS (SELECT resume_id, standard_job, ceil(count(*) * 0.2::DOUBLE)::INT AS need FROM kept GROUP BY ALL),
picks AS (SELECT resume_id, standard_job, floor({_drawn("43", "resume_id", "i")} * (SELECT count(*) FROM placed))::BIGINT AS spot FROM (SELECT *, unnest(generate_series(1, need)) AS i FROM need)),
other AS (SELECT DISTINCT resume_id, standard_job, skill FROM picks JOIN placed USING (spot) WHERE (standard_job, skill) NOT IN (SELECT (standard_job, skill) FROM feed)),
both_ AS (SELECT resume_id, standard_job, skill, 1 AS own FROM kept UNION ALL SELECT resume_id, standard_job, skill, 0 FROM other)
SELECT resume_id, standard_job, array_to_string(list(skill ORDER BY skill), '; ') AS skills, sum(own)::BIGINT AS n_own, sum(1 - own)::BIGINT AS n_other FROM both_ GROUP BY ALL""",
        True,
    ),
    "json_objects_in_texts": "SELECT p_partkey, p_name AS name, p_size AS size FROM part",
    "government_events_from_csv": O.base(False) + "\nSELECT post.job_id, substr(any_value(post.month), 1, 4) AS recruitment_year, 'office' AS government_agency, '' AS route_status, count(DISTINCT skill)::INT AS n_skills FROM post LEFT JOIN said ON said.job_id = post.job_id GROUP BY post.job_id",
    "taxonomy_from_csv": "SELECT n_name AS standard_job, r_name AS standard_category, unnest([lower(n_name), 'any']) AS keyword FROM nation JOIN region ON n_regionkey = r_regionkey",
    "catalog_table": "SELECT * FROM nation",
    "versioned_run": "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY ALL",
    "tables_through_csv": "SELECT n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation",
    "pool_in_alphabetical_order": O.base(True) + "\nSELECT lower(skill) AS skill_key, string_agg(DISTINCT standard_job, '; ' ORDER BY standard_job) AS standard_jobs, string_agg(DISTINCT standard_category, '; ' ORDER BY standard_category) AS standard_categories, 'base_event_stream' AS sources FROM said JOIN tax USING (standard_job) GROUP BY ALL",
    "government_routing_text": f"WITH {GOVERNMENT} SELECT job_id, '岗位名称：' || p_name || '一级主任科员' || chr(10) || '职位简介：' || p_name || chr(10) || '专业要求：' || p_type AS routing_text FROM src",
    "broad_phrases": "SELECT p_partkey, length(w) + 3 AS span_start, length(w) + 7 AS span_end, '产品运营' AS span_text FROM (SELECT p_partkey, p_size, split_part(p_name, ' ', 1) AS w FROM part) WHERE p_size > 25",
    "mention_offsets": "SELECT p_partkey::VARCHAR AS job_id, w AS span_text, (strpos(p_name, w) - 1)::INT AS span_start, (strpos(p_name, w) - 1 + length(w))::INT AS span_end, 'required' AS skill_type, 0.8::DOUBLE AS confidence, NULL::VARCHAR AS error FROM (SELECT p_partkey, p_name, split_part(p_name, ' ', -1) AS w FROM part)",
    "lifecycle_reasons": O.life("1998-06", f"SELECT standard_job, skill, {_REASON} AS reason FROM life"),
    "migration_interpretations": O.freq(True, O.ACTIVE, O.PATHS, O.MIGRATION)
    + """\nSELECT skill, migration_confidence, CASE WHEN is_left_censored = '1' AND first_seen_job_count >= 5 THEN '观测起点已覆盖多个岗位，只能说明观测期内的覆盖和扩散，不能推断真实起源岗位' WHEN is_left_censored = '1' THEN '技能在观测起点已出现，首现岗位是观测窗口内首批岗位，不等同于真实起源岗位'
WHEN skill_type = 'traditional' THEN '传统技能在观测期内首次出现，可分析样本内扩散，但不代表行业真实首次出现' WHEN spread_job_count = 0 THEN '技能在观测期内首次出现，但目前尚未扩散到其他标准岗位' ELSE '技能在观测期内首次出现，后续扩散路径可用于分析样本内技能迁移' END AS migration_interpretation FROM migration""",
    "dictionary_preview": f"""WITH {O.DICTIONARY}, n AS (SELECT n_name AS a, n_regionkey::VARCHAR AS b FROM nation), r AS (SELECT 'skills' AS key, k AS a, '{{"skill_keyword":"' || k || '","normalized_skill":"' || s || '","kg_display_skill":"' || d || '"}}' AS row FROM dic WHERE contains(lower(k), 'e')
UNION ALL SELECT 'jobs', a, '{{"standard_job_title":"' || a || '","standard_category":"' || b || '"}}' FROM n WHERE contains(lower(a), 'e')) SELECT key, (row_number() OVER (PARTITION BY key ORDER BY a))::INT AS place, row FROM r QUALIFY place <= 5""",
    "dictionary_counts": f"""WITH {O.DICTIONARY} SELECT 'skills' AS key, count(*) AS row_count, count(*) FILTER (contains(k, '1')) AS matched_count, '' AS missing_columns FROM dic
UNION ALL SELECT 'jobs', count(*), count(*) FILTER (contains(n_name, '1') OR contains(n_regionkey::VARCHAR, '1')), 'match_keywords' FROM nation""",
    "dictionary_sync": f"""WITH {O.DICTIONARY}, j AS (SELECT count(*) AS n, count(*) FILTER (r_name = 'ASIA') AS asia, count(*) FILTER (r_name = 'EUROPE') AS europe FROM nation JOIN region ON n_regionkey = r_regionkey), d AS (SELECT count(DISTINCT s) AS n, count(DISTINCT s) FILTER (s >= 'P') AS lost FROM dic)
SELECT '当前岗位词典与数据流岗位词典' AS name, '需同步' AS status, '当前 ' || n || ' 条，数据流 ' || (n - asia) || ' 条，差异 ' || (asia + 2 * europe) || ' 条' AS detail FROM j UNION ALL SELECT '泛抽取技能是否都在归一化词典中', '通过', '泛抽取标准技能 ' || n || ' 个，缺失 0 个' FROM d
UNION ALL SELECT '展示词典是否覆盖归一化技能', CASE WHEN lost = 0 THEN '通过' ELSE '需补齐' END, '归一化技能 ' || n || ' 个，展示映射缺失 ' || lost || ' 个' FROM d UNION ALL SELECT '数据流技能词典是否覆盖当前技能体系', '通过', '当前标准技能 ' || n || ' 个，数据流缺失 0 个' FROM d""",
    "run_report": O.compared(
        """SELECT 'job_demand' AS key, t AS total_rows, m AS missing_actual_rows, e AS extra_actual_rows, v AS value_mismatch_rows, t - m - e - v AS matched_rows, m + e + v AS diff_rows FROM (SELECT (SELECT count(*) FROM (SELECT standard_job, month FROM a UNION SELECT standard_job, month FROM b)) AS t,
  count(*) FILTER (status = 'missing_actual') AS m, count(*) FILTER (status = 'extra_actual') AS e, count(*) FILTER (status = 'value_mismatch') AS v FROM cmp)"""
    ),
    "run_diff_preview": O.compared("SELECT 'job_demand' AS key, (row_number() OVER (ORDER BY standard_job, month))::INT AS place, standard_job, month, status, \"column\" FROM cmp QUALIFY place <= 20"),
}
