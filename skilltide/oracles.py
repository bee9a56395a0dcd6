"""DuckDB SQL for queries.py, put together from common table expressions."""

from __future__ import annotations


def _ratio(n: str, d: str, scale: int = 1_000_000) -> str:
    return f"CASE WHEN {d} > 0 THEN ((2 * ({n})::BIGINT * {scale} + {d}) // (2 * {d}))::DOUBLE / {scale}.0::DOUBLE ELSE 0.0::DOUBLE END"


def _month(m: str) -> str:
    return f"(substr({m}, 1, 4)::INT * 12 + substr({m}, 6, 2)::INT - 1)"


def _change(now: str, before: str) -> str:
    return f"CASE WHEN {before} = 0 THEN CASE WHEN {now} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE ({now} - {before}) / {before} END"


DENSE = """
post AS (SELECT o_orderkey::VARCHAR AS job_id, strftime(o_orderdate, '%Y-%m') AS month, c_mktsegment AS standard_job FROM orders JOIN customer ON o_custkey = c_custkey),
said AS (SELECT DISTINCT job_id, month, standard_job, p_brand AS skill FROM post JOIN lineitem ON l_orderkey::VARCHAR = job_id JOIN part ON l_partkey = p_partkey),
tax AS (SELECT DISTINCT c_mktsegment AS standard_job, 'ALL' AS standard_category FROM customer),
fam AS (SELECT DISTINCT p_brand AS skill, 'BRAND' AS kg_display_skill, 'modern' AS skill_type FROM part)"""
SPARSE = """
post AS (SELECT o_orderkey::VARCHAR AS job_id, strftime(o_orderdate, '%Y-%m') AS month, n_name AS standard_job FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
said AS (SELECT DISTINCT job_id, month, standard_job, p_brand || ' ' || p_type AS skill FROM post JOIN lineitem ON l_orderkey::VARCHAR = job_id JOIN part ON l_partkey = p_partkey),
tax AS (SELECT n_name AS standard_job, r_name AS standard_category FROM nation JOIN region ON n_regionkey = r_regionkey),
fam AS (SELECT DISTINCT p_brand || ' ' || p_type AS skill, p_type AS kg_display_skill, CASE WHEN p_type LIKE 'ECONOMY%' THEN 'traditional' ELSE 'modern' END AS skill_type FROM part)"""
COUNTS = """
jd AS (SELECT standard_job, month, count(DISTINCT job_id) AS monthly_jd_count FROM post GROUP BY ALL),
ms AS (SELECT standard_job, month, skill, count(DISTINCT job_id) AS monthly_skill_count FROM said GROUP BY ALL)"""
GRID = f"""
cj AS (SELECT *, (sum(monthly_jd_count) OVER (PARTITION BY standard_job ORDER BY month))::BIGINT AS cumulative_jd_count FROM jd),
fm AS (SELECT standard_job, skill, min(month) AS first_month FROM ms GROUP BY ALL),
g0 AS (SELECT cj.*, fm.skill, coalesce(ms.monthly_skill_count, 0) AS monthly_skill_count FROM cj JOIN fm ON cj.standard_job = fm.standard_job AND cj.month >= fm.first_month
  LEFT JOIN ms ON ms.standard_job = cj.standard_job AND ms.month = cj.month AND ms.skill = fm.skill),
g1 AS (SELECT *, (sum(monthly_skill_count) OVER (PARTITION BY standard_job, skill ORDER BY month))::BIGINT AS cumulative_skill_count FROM g0),
freq AS (SELECT month, standard_job, skill, monthly_jd_count, monthly_skill_count, {_ratio("monthly_skill_count", "monthly_jd_count")} AS monthly_skill_frequency,
  cumulative_jd_count, cumulative_skill_count, {_ratio("cumulative_skill_count", "cumulative_jd_count")} AS cumulative_skill_frequency FROM g1)"""


def base(sparse: bool, *more: str) -> str:
    return "WITH " + ",".join([SPARSE if sparse else DENSE, *more])


def freq(sparse: bool, *more: str) -> str:
    return base(sparse, COUNTS, GRID, *more)


def _calendar(start: str | None = None, end: str | None = None) -> str:
    a = f"'{start}'" if start else "(SELECT min(month) FROM post)"
    b = f"'{end}'" if end else "(SELECT max(month) FROM post)"
    return f"cal AS (SELECT strftime(d, '%Y-%m') AS month, (row_number() OVER (ORDER BY d))::INT AS month_index FROM (SELECT unnest(generate_series(({a} || '-01')::DATE, ({b} || '-01')::DATE, INTERVAL 1 MONTH)) AS d))"


DEMAND = """dem0 AS (SELECT tax.*, cal.*, coalesce(jd.monthly_jd_count, 0) AS monthly_jd_count FROM tax CROSS JOIN cal LEFT JOIN jd ON jd.standard_job = tax.standard_job AND jd.month = cal.month),
demand AS (SELECT *, (sum(monthly_jd_count) OVER (PARTITION BY standard_job ORDER BY month))::BIGINT AS cumulative_jd_count, CASE WHEN monthly_jd_count > 0 THEN 'yes' ELSE 'no' END AS is_active_month FROM dem0)"""


def _dense(universe: bool) -> str:
    more = " UNION SELECT standard_job, skill FROM tax CROSS JOIN fam" if universe else ""
    return f"""pairs AS (SELECT standard_job, skill FROM said{more}),
cells AS (SELECT j.standard_job, cal.month, month_index, coalesce(jd.monthly_jd_count, 0) AS monthly_jd_count FROM (SELECT DISTINCT standard_job FROM pairs) j CROSS JOIN cal LEFT JOIN jd ON jd.standard_job = j.standard_job AND jd.month = cal.month),
cells1 AS (SELECT *, (sum(monthly_jd_count) OVER (PARTITION BY standard_job ORDER BY month))::BIGINT AS cumulative_jd_count FROM cells),
full0 AS (SELECT c.*, p.skill, coalesce(ms.monthly_skill_count, 0) AS monthly_skill_count FROM cells1 c JOIN (SELECT DISTINCT * FROM pairs) p ON p.standard_job = c.standard_job LEFT JOIN ms ON ms.standard_job = c.standard_job AND ms.month = c.month AND ms.skill = p.skill),
full1 AS (SELECT *, (sum(monthly_skill_count) OVER (PARTITION BY standard_job, skill ORDER BY month))::BIGINT AS cumulative_skill_count FROM full0)
SELECT month, month_index, full1.standard_job, coalesce(standard_category, '') AS standard_category, skill, monthly_jd_count, monthly_skill_count, {_ratio("monthly_skill_count", "monthly_jd_count", 10_000)} AS monthly_skill_frequency,
cumulative_jd_count, cumulative_skill_count, {_ratio("cumulative_skill_count", "cumulative_jd_count", 10_000)} AS cumulative_skill_frequency FROM full1 LEFT JOIN tax ON tax.standard_job = full1.standard_job"""


def _as_of(month: str | None) -> str:
    return f"aom AS (SELECT DISTINCT standard_job, '{month}' AS as_of FROM freq)" if month else "aom AS (SELECT standard_job, max(month) AS as_of FROM freq WHERE monthly_jd_count > 0 GROUP BY ALL)"


def _sum(low: int, high: int, value: str) -> str:
    return f"coalesce(sum({value}) FILTER (away BETWEEN {low} AND {high}), 0)::BIGINT"


WINDOWS = f"""rows0 AS (SELECT freq.*, as_of, {_month("as_of")} - {_month("month")} AS away FROM freq JOIN aom USING (standard_job) WHERE {_month("as_of")} >= {_month("month")}),
win0 AS (SELECT standard_job, skill, as_of, min(month) FILTER (monthly_skill_count > 0) AS first_seen_month, max(month) FILTER (monthly_skill_count > 0) AS last_seen_month,
  least(6, max(away) + 1) AS n_months,
  coalesce(max(monthly_skill_count) FILTER (away = 0), 0) AS current_monthly_skill_count,
  coalesce(max(monthly_skill_frequency) FILTER (away = 0), 0) AS current_monthly_skill_frequency,
  coalesce(max(monthly_skill_frequency) FILTER (away = 1), 0) AS pf,
  arg_max(cumulative_skill_count, month) AS cumulative_skill_count, arg_max(cumulative_skill_frequency, month) AS cumulative_skill_frequency,
  {_sum(0, 2, "monthly_skill_count")} AS recent_3m_skill_count, {_sum(0, 5, "monthly_skill_count")} AS recent_6m_skill_count,
  {_sum(0, 2, "(monthly_skill_count > 0)::INT")} AS recent_3m_active_months, {_sum(0, 5, "(monthly_skill_count > 0)::INT")} AS recent_6m_active_months,
  {_sum(3, 5, "monthly_skill_count")} AS prev_3m_skill_count, {_sum(6, 11, "monthly_skill_count")} AS prev_6m_skill_count,
  {_sum(0, 5, "round(monthly_skill_frequency * 1000000)::BIGINT")} AS s1, {_sum(0, 5, "(round(monthly_skill_frequency * 1000000)::BIGINT) * (round(monthly_skill_frequency * 1000000)::BIGINT)")} AS s2
  FROM rows0 GROUP BY ALL),
win AS (SELECT standard_job, skill, as_of, first_seen_month, last_seen_month, current_monthly_skill_count, current_monthly_skill_frequency, cumulative_skill_count, cumulative_skill_frequency,
  recent_3m_skill_count, recent_6m_skill_count, recent_3m_active_months, recent_6m_active_months, prev_3m_skill_count, prev_6m_skill_count,
  {_month("as_of")} - {_month("first_seen_month")} + 1 AS age_months, {_month("as_of")} - {_month("last_seen_month")} AS months_since_last_seen,
  {_change("current_monthly_skill_frequency", "pf")} AS mom_frequency_change,
  {_change("recent_3m_skill_count::DOUBLE", "prev_3m_skill_count::DOUBLE")} AS recent_3m_vs_prev_3m_change,
  CASE WHEN n_months > 1 THEN sqrt((n_months * s2 - s1 * s1)::DOUBLE) / n_months / 1000000 ELSE 0.0 END AS recent_6m_frequency_stddev
  FROM win0 WHERE first_seen_month IS NOT NULL)"""


def _coverage(month: str | None) -> str:
    top = _month(f"'{month}'") if month else f"(SELECT max({_month('month')}) FROM freq)"
    away = f"({top} - {_month('month')})"
    return f"""cov AS (SELECT lower(skill) AS skill_key, count(DISTINCT standard_job) AS covered_job_count, count(DISTINCT standard_job) FILTER ({away} BETWEEN 0 AND 2) AS recent_3m_covered_job_count,
  count(DISTINCT standard_job) FILTER ({away} BETWEEN 3 AND 5) AS prev_3m_covered_job_count,
  count(DISTINCT standard_job) FILTER ({away} BETWEEN 0 AND 2) - count(DISTINCT standard_job) FILTER ({away} BETWEEN 3 AND 5) AS recent_3m_covered_job_count_change
  FROM freq WHERE monthly_skill_count > 0 AND {away} >= 0 GROUP BY ALL)"""


STATUS = """CASE WHEN months_since_last_seen >= 4 AND recent_3m_skill_count = 0 AND cumulative_skill_count >= 3 THEN '废弃技能'
  WHEN prev_3m_skill_count >= 3 AND recent_3m_skill_count < prev_3m_skill_count * 0.5::DOUBLE AND current_monthly_skill_frequency <= 0.05::DOUBLE THEN '衰退技能'
  WHEN age_months <= 3 AND recent_3m_skill_count >= 2 THEN '新兴技能'
  WHEN age_months <= 6 AND recent_3m_skill_count >= 3 AND recent_3m_vs_prev_3m_change >= 0.5::DOUBLE THEN '新兴技能'
  WHEN age_months >= 6 AND recent_6m_active_months >= 4 AND cumulative_skill_frequency >= 0.25::DOUBLE AND current_monthly_skill_frequency >= 0.15::DOUBLE AND recent_6m_frequency_stddev <= 0.25::DOUBLE THEN '稳定核心技能'
  WHEN age_months >= 6 AND cumulative_skill_count >= 5 AND cumulative_skill_frequency >= 0.5::DOUBLE AND current_monthly_skill_frequency >= 0.5::DOUBLE AND recent_3m_skill_count >= 1 THEN '稳定核心技能'
  WHEN recent_3m_active_months >= 2 AND current_monthly_skill_frequency >= 0.08::DOUBLE OR recent_3m_skill_count >= 3 THEN '活跃技能' ELSE '观察中' END"""
LIFE = f"""life AS (SELECT win.* EXCLUDE (as_of), as_of AS month, coalesce(covered_job_count, 0) AS covered_job_count, coalesce(recent_3m_covered_job_count, 0) AS recent_3m_covered_job_count,
  coalesce(prev_3m_covered_job_count, 0) AS prev_3m_covered_job_count, coalesce(recent_3m_covered_job_count_change, 0) AS recent_3m_covered_job_count_change, {STATUS} AS lifecycle_status,
  coalesce(fam.kg_display_skill, '') AS kg_display_skill FROM win LEFT JOIN cov ON cov.skill_key = lower(win.skill) LEFT JOIN fam ON fam.skill = win.skill)"""


def life(month: str | None, body: str, sparse: bool = True) -> str:
    return freq(sparse, _as_of(month), WINDOWS, _coverage(month), LIFE) + "\n" + body


ACTIVE = """act AS (SELECT * FROM freq WHERE monthly_skill_count > 0),
sf AS (SELECT skill, min(month) AS skill_first_seen_month FROM act GROUP BY ALL),
sj AS (SELECT skill, standard_job, min(month) AS job_first_seen_month FROM act GROUP BY ALL),
mc AS (SELECT skill, month, count(DISTINCT standard_job) AS covered_job_count_this_month FROM act GROUP BY ALL),
cc AS (SELECT skill, month, (SELECT count(*) FROM sj WHERE sj.skill = m.skill AND sj.job_first_seen_month <= m.month) AS cumulative_covered_job_count FROM (SELECT DISTINCT skill, month FROM act) m),
cf AS (SELECT skill, standard_job, min(month) AS confirmed_month FROM (SELECT *, sum(monthly_skill_count) OVER (PARTITION BY skill, standard_job ORDER BY month) AS run FROM freq) WHERE run >= 2 GROUP BY ALL),
pk AS (SELECT skill, covered_job_count_this_month AS peak_monthly_covered_job_count, month AS peak_monthly_covered_job_month FROM mc QUALIFY row_number() OVER (PARTITION BY skill ORDER BY covered_job_count_this_month DESC, month DESC) = 1)"""


def _path(name: str, source: str, month: str, prefix: str) -> str:
    return f"""{name}m AS (SELECT skill, {month} AS m, string_agg(standard_job, '; ' ORDER BY standard_job) AS jobs, count(*) AS n FROM {source} GROUP BY ALL),
{name} AS (SELECT skill, min(m) AS {prefix}first_seen_month, arg_min(jobs, m) AS {prefix}first_seen_standard_jobs, arg_min(n, m) AS {prefix}first_seen_job_count, sum(n)::BIGINT AS {prefix}cumulative_covered_job_count,
  (sum(n) - arg_min(n, m))::BIGINT AS {prefix}spread_job_count, coalesce(string_agg(jobs, '; ' ORDER BY m) FILTER (m > m0), '') AS {prefix}spread_standard_jobs, string_agg(jobs, '; ' ORDER BY m) AS {prefix}all_standard_jobs,
  string_agg(m || ': ' || jobs, ' -> ' ORDER BY m) AS {prefix}migration_path FROM (SELECT *, min(m) OVER (PARTITION BY skill) AS m0 FROM {name}m) GROUP BY skill)"""


PATHS = ",".join([_path("pth", "sj", "job_first_seen_month", ""), _path("cpth", "cf", "confirmed_month", "confirmed_")])
MIGRATION = """tot AS (SELECT skill, sum(monthly_skill_count)::BIGINT AS total_skill_mentions, max(month) AS latest_seen_month FROM act GROUP BY ALL),
mig AS (SELECT pth.*, tot.* EXCLUDE (skill), mc.covered_job_count_this_month AS latest_covered_job_count, pk.* EXCLUDE (skill), 2 AS confirmation_min_job_mentions,
  coalesce(confirmed_first_seen_month, '') AS confirmed_first_seen_month, coalesce(confirmed_first_seen_standard_jobs, '') AS confirmed_first_seen_standard_jobs, coalesce(confirmed_first_seen_job_count, 0) AS confirmed_first_seen_job_count,
  coalesce(confirmed_cumulative_covered_job_count, 0) AS confirmed_cumulative_covered_job_count, coalesce(confirmed_spread_job_count, 0) AS confirmed_spread_job_count, coalesce(confirmed_spread_standard_jobs, '') AS confirmed_spread_standard_jobs,
  coalesce(confirmed_migration_path, '') AS confirmed_migration_path, CASE WHEN first_seen_month = (SELECT min(month) FROM freq) THEN '1' ELSE '0' END AS is_left_censored, fam.kg_display_skill, fam.skill_type
  FROM pth JOIN tot USING (skill) JOIN mc ON mc.skill = pth.skill AND mc.month = tot.latest_seen_month JOIN pk ON pk.skill = pth.skill LEFT JOIN cpth ON cpth.skill = pth.skill LEFT JOIN fam ON fam.skill = pth.skill),
migration AS (SELECT *, CASE WHEN is_left_censored = '1' AND first_seen_job_count >= 5 THEN 'low' WHEN is_left_censored = '1' OR skill_type = 'traditional' THEN 'medium' ELSE 'high' END AS migration_confidence FROM mig)"""
SPREAD = """spread AS (SELECT freq.*, monthly_skill_frequency - lag(monthly_skill_frequency, 1, 0.0) OVER w AS monthly_frequency_change, cumulative_skill_frequency - lag(cumulative_skill_frequency, 1, 0.0) OVER w AS cumulative_frequency_change,
  job_first_seen_month, skill_first_seen_month, coalesce(covered_job_count_this_month, 0) AS covered_job_count_this_month, coalesce(cumulative_covered_job_count, 0) AS cumulative_covered_job_count,
  {away} AS months_since_skill_first_seen, CASE WHEN job_first_seen_month = skill_first_seen_month THEN '1' ELSE '0' END AS is_first_seen_job, CASE WHEN freq.month = job_first_seen_month THEN '1' ELSE '0' END AS is_new_job_for_skill,
  CASE WHEN skill_first_seen_month = (SELECT min(month) FROM freq) THEN '1' ELSE '0' END AS is_left_censored, fam.kg_display_skill
  FROM freq LEFT JOIN sj USING (skill, standard_job) LEFT JOIN sf USING (skill) LEFT JOIN mc USING (skill, month) LEFT JOIN cc USING (skill, month) LEFT JOIN fam USING (skill)
  WINDOW w AS (PARTITION BY skill, standard_job ORDER BY freq.month))""".format(away=f"{_month('freq.month')} - {_month('skill_first_seen_month')}")


def moved(body: str, sparse: bool = True) -> str:
    return freq(sparse, ACTIVE, PATHS, MIGRATION, SPREAD) + "\n" + body


SNAPS = """snaps AS (SELECT freq.*, CASE WHEN monthly_skill_count >= 1 AND monthly_skill_frequency >= 0.25::DOUBLE AND cumulative_skill_frequency >= 0.25::DOUBLE THEN '1' ELSE '0' END AS is_core_skill,
  CASE WHEN monthly_skill_count >= 1 AND monthly_skill_frequency >= 0.25::DOUBLE AND cumulative_skill_frequency >= 0.25::DOUBLE THEN '稳定核心技能' WHEN monthly_skill_count > 0 THEN '当月活跃技能' ELSE '当月未出现' END AS snapshot_skill_status,
  CASE WHEN monthly_skill_count > 0 THEN (row_number() OVER (PARTITION BY standard_job, month ORDER BY monthly_skill_count DESC, monthly_skill_frequency DESC, freq.skill))::INT END AS rank_in_month, fam.kg_display_skill
  FROM freq LEFT JOIN fam ON fam.skill = freq.skill)"""
DIFF = f"""mjd AS (SELECT standard_job, month, max(monthly_jd_count) AS n FROM snaps GROUP BY ALL),
both0 AS (SELECT a.standard_job, a.month AS from_month, b.month AS to_month, a.n AS from_monthly_jd_count, b.n AS to_monthly_jd_count, t.skill, t.kg_display_skill,
  coalesce(f.monthly_skill_count, 0) AS from_monthly_skill_count, t.monthly_skill_count AS to_monthly_skill_count, coalesce(f.monthly_skill_frequency, 0) AS from_monthly_skill_frequency, t.monthly_skill_frequency AS to_monthly_skill_frequency,
  coalesce(f.cumulative_skill_count, 0) AS from_cumulative_skill_count, t.cumulative_skill_count AS to_cumulative_skill_count, coalesce(f.cumulative_skill_frequency, 0) AS from_cumulative_skill_frequency, t.cumulative_skill_frequency AS to_cumulative_skill_frequency,
  coalesce(f.is_core_skill, '0') AS fc, t.is_core_skill AS tc
  FROM mjd a JOIN mjd b ON a.standard_job = b.standard_job AND a.month < b.month JOIN snaps t ON t.standard_job = b.standard_job AND t.month = b.month LEFT JOIN snaps f ON f.standard_job = a.standard_job AND f.month = a.month AND f.skill = t.skill),
diff AS (SELECT * EXCLUDE (fc, tc), to_monthly_skill_frequency - from_monthly_skill_frequency AS frequency_delta, {_change("to_monthly_skill_frequency", "from_monthly_skill_frequency")} AS frequency_delta_ratio,
  CASE WHEN from_cumulative_skill_count = 0 AND from_monthly_skill_count = 0 AND to_monthly_skill_count > 0 THEN '新增技能' WHEN from_monthly_skill_count > 0 AND to_monthly_skill_count = 0 THEN '消失技能'
  WHEN fc = '1' AND tc = '1' AND abs(to_monthly_skill_frequency - from_monthly_skill_frequency) <= 0.05::DOUBLE THEN '稳定核心技能' WHEN to_monthly_skill_frequency - from_monthly_skill_frequency >= 0.08::DOUBLE THEN '频率上升技能'
  WHEN to_monthly_skill_frequency - from_monthly_skill_frequency <= -0.08::DOUBLE THEN '频率下降技能' END AS change_type FROM both0),
diffs AS (SELECT *, CASE WHEN change_type = '稳定核心技能' THEN '1' ELSE '0' END AS is_stable_core FROM diff WHERE change_type IS NOT NULL)"""
CURRENT = "cur AS (SELECT * FROM snaps QUALIFY month = max(month) OVER (PARTITION BY standard_job)), curp AS (SELECT * FROM cur WHERE monthly_skill_count > 0)"


def profiles(body: str, sparse: bool = False) -> str:
    return freq(sparse, SNAPS, DIFF, CURRENT) + "\n" + body


RANK_COLUMNS = "standard_job, skill, from_month, to_month, change_type, frequency_delta"
ONE = "one AS (SELECT * FROM diffs WHERE to_month = '2000-06' QUALIFY row_number() OVER (PARTITION BY skill ORDER BY from_month DESC, standard_job, change_type) = 1)"


def _pool_fold(where: str = "TRUE") -> str:
    firsts = lambda c, name: f"(SELECT string_agg({c}, '; ' ORDER BY o) FROM (SELECT {c}, min(month || job_id) AS o FROM m2 WHERE lower(m2.skill) = p.skill_key GROUP BY ALL)) AS {name}"
    return f"""m2 AS (SELECT said.*, fam.kg_display_skill, fam.skill_type, tax.standard_category FROM said JOIN fam USING (skill) JOIN tax USING (standard_job) WHERE {where}),
p AS (SELECT lower(skill) AS skill_key, min(skill) AS normalized_skill, min(kg_display_skill) AS kg_display_skill, min(skill_type) AS skill_type, min(month) AS first_seen_month, max(month) AS last_seen_month,
  arg_min(job_id, month || job_id) AS first_seen_job_id, arg_max(job_id, month || job_id) AS last_seen_job_id, count(*) AS mention_count, count(DISTINCT job_id) AS source_count FROM m2 GROUP BY ALL)
SELECT p.*, {firsts("standard_category", "standard_categories")}, {firsts("standard_job", "standard_jobs")}, 'base_event_stream' AS sources FROM p"""


WORDS = "words AS (SELECT DISTINCT upper(substr(w, 1, 1)) AS standard_job, w AS keyword FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part))"
HITS = f"""{WORDS},
fields AS (SELECT p_partkey::VARCHAR AS job_id, unnest([{{'f': 'job_title', 't': lower(p_name), 'w': 6}}, {{'f': 'job_responsibility', 't': lower(p_type), 'w': 5}}, {{'f': 'job_requirement', 't': lower(p_brand), 'w': 1}}]) AS s FROM part),
hits AS (SELECT DISTINCT job_id, standard_job, s.f AS field, lower(keyword) AS keyword, s.w AS w FROM fields JOIN words ON contains(s.t, lower(keyword)))"""
ASSIGNED = f"""{HITS},
sc AS (SELECT job_id, standard_job, sum(w)::BIGINT AS score, CASE WHEN standard_job = 'R' THEN 0 ELSE ascii(standard_job) END AS priority FROM hits GROUP BY ALL),
rk AS (SELECT *, row_number() OVER w AS n, lead(score, 1, 0) OVER w AS second FROM sc WINDOW w AS (PARTITION BY job_id ORDER BY score DESC, priority DESC, standard_job)),
bst AS (SELECT p_partkey::VARCHAR AS job_id, coalesce(rk.standard_job, '') AS assigned_standard_job, coalesce(score, 0) AS assignment_score, coalesce(second, 0) AS second, coalesce(priority, 0) AS priority FROM part LEFT JOIN rk ON rk.job_id = p_partkey::VARCHAR AND n = 1),
asg0 AS (SELECT *, assignment_score - second AS assignment_margin, CASE WHEN assignment_score <= 0 THEN 'no seed-keyword evidence' WHEN priority > 0 AND assignment_score <= 1 THEN 'specialty assignment relies on weak evidence only'
  WHEN assignment_score = second AND second > 0 THEN 'top seed-rule candidates are tied' WHEN assignment_score - second <= 1 AND second > 0 THEN 'top seed-rule candidates are close' ELSE 'seed taxonomy keyword rule' END AS assignment_reason FROM bst),
asg AS (SELECT job_id, assigned_standard_job, assignment_score, assignment_margin, assignment_reason, CASE WHEN assignment_reason = 'seed taxonomy keyword rule' THEN 'assigned' ELSE 'needs_review' END AS assignment_status FROM asg0)"""
COSINE = """el AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
cen AS (SELECT 'job-' || label AS name, 'family-' || (label % 3) AS category, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS x FROM el GROUP BY ALL) GROUP BY ALL),
cos AS (SELECT vec_id AS job_id, name, category, list_cosine_similarity(embedding::DOUBLE[], v) AS score FROM embeddings CROSS JOIN cen)"""
DICTIONARY = f"{WORDS}, dic AS (SELECT keyword AS k, upper(keyword) AS s, substr(keyword, 1, 1) AS d FROM words WHERE length(keyword) > 4)"
PARTS = "parts AS (SELECT p_partkey, p_brand, p_size, p_name, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[-1] AS z FROM part)"
TREND = "standard_job, life.skill, lifecycle_status, first_seen_standard_jobs AS migration_origin_jobs, migration_path, total_skill_mentions"


def trend(where: str) -> str:
    return freq(True, _as_of("1998-06"), WINDOWS, _coverage("1998-06"), LIFE, ACTIVE, PATHS, MIGRATION) + f"\nSELECT {TREND} FROM life LEFT JOIN migration ON lower(migration.skill) = lower(life.skill) WHERE {where}"


def compared(body: str) -> str:
    cells = "coalesce(CASE WHEN a.monthly_jd_count <> b.monthly_jd_count THEN 'monthly_jd_count' END, CASE WHEN a.cumulative_jd_count <> b.cumulative_jd_count THEN 'cumulative_jd_count' END, CASE WHEN a.is_active_month <> b.is_active_month THEN 'is_active_month' END)"
    return base(
        True,
        COUNTS,
        _calendar(),
        DEMAND,
        "a AS (SELECT * REPLACE (CASE WHEN month = '1996-02' THEN monthly_jd_count + 1 ELSE monthly_jd_count END AS monthly_jd_count) FROM demand WHERE month <> '1995-03'), b AS (SELECT * FROM demand WHERE month <> '1997-05')",
        f"""cmp AS (SELECT coalesce(a.standard_job, b.standard_job) AS standard_job, coalesce(a.month, b.month) AS month, CASE WHEN a.month IS NULL THEN 'missing_actual' WHEN b.month IS NULL THEN 'extra_actual' ELSE 'value_mismatch' END AS status,
  CASE WHEN a.month IS NULL OR b.month IS NULL THEN '' ELSE {cells} END AS "column", CASE WHEN a.month IS NOT NULL AND b.month IS NOT NULL THEN a.monthly_jd_count::VARCHAR END AS actual, CASE WHEN a.month IS NOT NULL AND b.month IS NOT NULL THEN b.monthly_jd_count::VARCHAR END AS expected
  FROM a FULL JOIN b ON a.standard_job = b.standard_job AND a.month = b.month WHERE a.month IS NULL OR b.month IS NULL OR {cells} IS NOT NULL)""",
    ) + "\n" + body


def effects(before: str, after: str) -> str:
    """What changed in current profiles between those of the rows that two conditions select."""
    return profiles(
        f""", b AS (SELECT * FROM snaps WHERE {before} QUALIFY month = max(month) OVER (PARTITION BY standard_job)), a AS (SELECT * FROM snaps WHERE {after} QUALIFY month = max(month) OVER (PARTITION BY standard_job)),
x AS (SELECT * FROM b WHERE monthly_skill_count > 0), y AS (SELECT * FROM a WHERE monthly_skill_count > 0),
z AS (SELECT coalesce(x.standard_job, y.standard_job) AS standard_job, coalesce(x.skill, y.skill) AS skill, CASE WHEN x.skill IS NULL THEN 'added' WHEN y.skill IS NULL THEN 'removed' WHEN y.monthly_skill_frequency - x.monthly_skill_frequency > 1e-9 THEN 'increased'
  WHEN y.monthly_skill_frequency - x.monthly_skill_frequency < -1e-9 THEN 'decreased' WHEN x.is_core_skill = '1' AND y.is_core_skill = '1' THEN 'stable_core' END AS effect, coalesce(y.monthly_skill_frequency, 0) - coalesce(x.monthly_skill_frequency, 0) AS frequency_delta
  FROM x FULL JOIN y ON x.standard_job = y.standard_job AND x.skill = y.skill) SELECT * FROM z WHERE effect IS NOT NULL"""
    )


ORACLE_EFFECTS = effects("month < '1997-01'", "TRUE")

ORACLE_SQL = {
    "explode_skills": base(True) + "\nSELECT * FROM said",
    "event_filter_valid": base(False) + "\nSELECT month, count(*) AS n FROM post GROUP BY ALL",
    "monthly_jd_count": base(True, COUNTS) + "\nSELECT * FROM jd",
    "monthly_skill_count": base(True, COUNTS) + "\nSELECT * FROM ms",
    "monthly_frequency": freq(True) + "\nSELECT * FROM freq",
    "monthly_frequency_dense": freq(False) + "\nSELECT * FROM freq",
    "demand_grid": base(True, COUNTS, _calendar(), DEMAND) + "\nSELECT standard_job, standard_category, month, month_index, monthly_jd_count, cumulative_jd_count, is_active_month FROM demand",
    "frequency_dense": base(False, COUNTS, _calendar(), _dense(False)),
    "frequency_dense_universe": base(True, COUNTS, _calendar(), _dense(True)),
    "quality_report": base(True, "t AS (SELECT * FROM tax WHERE standard_category <> 'ASIA')")
    + """\nSELECT (SELECT count(*) FROM post) AS event_stream_rows, (SELECT count(*) FROM post) AS valid_event_rows, (SELECT min(month) FROM post) AS month_start, (SELECT max(month) FROM post) AS month_end,
  (SELECT count(DISTINCT standard_job) FROM post) AS unique_event_jobs, (SELECT count(*) FROM post WHERE standard_job IN (SELECT standard_job FROM t)) AS event_jobs_in_dictionary, (SELECT count(DISTINCT skill) FROM said) AS unique_event_skills,
  (SELECT count(*) FROM t WHERE standard_job NOT IN (SELECT standard_job FROM post)) AS n_jobs_without_events, coalesce((SELECT string_agg(standard_job, '; ' ORDER BY standard_job) FROM t WHERE standard_job NOT IN (SELECT standard_job FROM post)), '') AS jobs_without_events,
  coalesce((SELECT string_agg(standard_job, '; ' ORDER BY standard_job) FROM (SELECT DISTINCT standard_job FROM post WHERE standard_job NOT IN (SELECT standard_job FROM t))), '') AS unknown_standard_jobs, (SELECT count(*) FROM t) AS standard_job_count""",
    "job_as_of_month": freq(True, _as_of(None)) + "\nSELECT * FROM aom",
    "pair_windows": freq(True, _as_of(None), WINDOWS) + "\nSELECT * EXCLUDE (recent_6m_frequency_stddev) FROM win",
    "frequency_stddev6": freq(True, _as_of(None), WINDOWS) + "\nSELECT standard_job, skill, recent_6m_frequency_stddev FROM win",
    "coverage_metrics": freq(True, _coverage(None)) + "\nSELECT * FROM cov",
    "lifecycle_monthly": life(None, "SELECT * FROM life"),
    "lifecycle_as_of": life("1998-06", "SELECT * FROM life"),
    "lifecycle_annual": freq(True).replace("'%Y-%m'", "'%Y-10'")
    + """, cyc AS (SELECT *, row_number() OVER (PARTITION BY standard_job ORDER BY month) AS cycle FROM (SELECT DISTINCT standard_job, month FROM freq)),
lst AS (SELECT standard_job, max(cycle) AS l, max(month) AS as_of FROM cyc GROUP BY ALL),
r AS (SELECT freq.*, as_of, l - cycle AS away FROM freq JOIN cyc USING (standard_job, month) JOIN lst USING (standard_job)),
o AS (SELECT standard_job, skill, as_of, min(month) FILTER (monthly_skill_count > 0) AS first_seen_month, max(month) FILTER (monthly_skill_count > 0) AS last_seen_month, count(*) FILTER (monthly_skill_count > 0) AS active_cycles,
  min(away) FILTER (monthly_skill_count > 0) AS cycles_since_last_seen, coalesce(max(monthly_skill_count) FILTER (away = 0), 0) AS current_skill_count, coalesce(max(monthly_skill_frequency) FILTER (away = 0), 0) AS current_skill_frequency,
  coalesce(max(monthly_skill_frequency) FILTER (away > 0), 0) AS prior_max_frequency, arg_max(cumulative_skill_count, month) AS cumulative_skill_count, arg_max(cumulative_skill_frequency, month) AS cumulative_skill_frequency, """
    + f"{_sum(0, 2, 'monthly_skill_count')} AS recent_3_cycles_skill_count, {_sum(0, 5, 'monthly_skill_count')} AS recent_6_cycles_skill_count, {_sum(3, 5, 'monthly_skill_count')} AS prev_3_cycles_skill_count FROM r GROUP BY ALL)"
    + """\nSELECT *, CASE WHEN active_cycles >= 2 AND current_skill_count > 0 AND cumulative_skill_frequency >= 0.25::DOUBLE THEN '稳定核心技能' WHEN first_seen_month = as_of AND current_skill_count > 0 THEN '新兴技能' WHEN current_skill_count > 0 THEN '活跃技能'
  WHEN cycles_since_last_seen >= 2 AND cumulative_skill_count >= 3 THEN '废弃技能' WHEN cycles_since_last_seen >= 1 AND prior_max_frequency > 0 THEN '衰退技能' ELSE '观察中' END AS lifecycle_status FROM o""",
    "lifecycle_summary": life("1998-06", "SELECT standard_job, lifecycle_status, count(*) AS n FROM life GROUP BY ALL"),
    "skill_first_month": moved("SELECT * FROM sf"),
    "skill_job_first_month": moved("SELECT * FROM sj"),
    "monthly_coverage": moved("SELECT * FROM mc"),
    "cumulative_coverage": moved("SELECT * FROM cc"),
    "confirmed_first_month": moved("SELECT * FROM cf"),
    "peak_month": moved("SELECT * FROM pk"),
    "migration_path": moved("SELECT skill, first_seen_standard_jobs, spread_standard_jobs, all_standard_jobs, migration_path FROM pth"),
    "skill_migration": moved("SELECT * FROM migration"),
    "skill_spread": moved("SELECT * FROM spread"),
    "spread_lag_delta": moved("SELECT skill, standard_job, month, monthly_frequency_change, cumulative_frequency_change FROM spread", False),
    "rank_in_month": profiles("SELECT standard_job, month, skill, rank_in_month FROM snaps WHERE monthly_skill_count > 0"),
    "profile_snapshots": profiles("SELECT * FROM snaps"),
    "profile_diff": profiles("SELECT * FROM diffs"),
    "current_profile": profiles("SELECT * FROM curp", True),
    "profile_fallback_diff": profiles(
        """, x AS (SELECT * FROM snaps WHERE standard_job = 'NATION_3' AND month = '1996-01' AND monthly_skill_count > 0), y AS (SELECT * FROM snaps WHERE standard_job = 'NATION_3' AND month = '1996-06' AND monthly_skill_count > 0)
SELECT coalesce(x.skill, y.skill) AS skill, coalesce(x.monthly_skill_frequency, 0) AS from_monthly_skill_frequency, coalesce(x.monthly_skill_count, 0) AS from_monthly_skill_count, coalesce(y.monthly_skill_frequency, 0) AS to_monthly_skill_frequency, coalesce(y.monthly_skill_count, 0) AS to_monthly_skill_count,
  CASE WHEN x.skill IS NULL THEN '新增技能' WHEN y.skill IS NULL THEN '消失技能' WHEN y.monthly_skill_frequency > x.monthly_skill_frequency THEN '频率上升技能' WHEN y.monthly_skill_frequency < x.monthly_skill_frequency THEN '频率下降技能' ELSE '稳定核心技能' END AS change_type,
  'NATION_3' AS standard_job, '1996-01' AS from_month, '1996-06' AS to_month, coalesce(y.monthly_skill_frequency, 0) - coalesce(x.monthly_skill_frequency, 0) AS frequency_delta FROM x FULL JOIN y ON x.skill = y.skill""",
        True,
    ),
    "profile_overlay": profiles(
        """, c2 AS (SELECT * FROM snaps WHERE month <= '1996-06' QUALIFY month = max(month) OVER (PARTITION BY standard_job)), c3 AS (SELECT * FROM c2 WHERE monthly_skill_count > 0)
SELECT standard_job, CASE WHEN standard_job = 'NATION_3' AND skill = 'Brand#12 STANDARD' THEN 'Renamed' ELSE skill END AS skill, CASE WHEN standard_job = 'NATION_3' AND skill = 'Brand#12 STANDARD' THEN 'Family' ELSE kg_display_skill END AS kg_display_skill, monthly_skill_count,
  CASE WHEN standard_job = 'NATION_3' AND skill = 'Brand#12 STANDARD' THEN '1' ELSE '0' END AS is_override FROM c3 WHERE NOT (standard_job = 'NATION_3' AND skill = 'Brand#11 ECONOMY') UNION ALL SELECT 'NATION_7', 'Handmade', 'Family', 0, '1'""",
        True,
    ),
    "live_effect": effects("month <= '1996-05'", "month <= '1996-06'"),
    "skill_pool": base(True, _pool_fold()),
    "skill_pool_incremental": base(True, _pool_fold()).replace("SELECT p.*, ", "SELECT skill_key, normalized_skill, kg_display_skill, first_seen_month, last_seen_month, first_seen_job_id, last_seen_job_id, mention_count, source_count, sources FROM (SELECT p.*, ") + ")",
    "pool_lookup_join": base(True) + "\nSELECT skill, count(*) AS n, any_value(kg_display_skill) AS kg_display_skill, any_value(skill_type) AS skill_type FROM said JOIN fam USING (skill) GROUP BY skill",
    "mention_jobs": base(False) + "\nSELECT lower(skill) AS skill_key, count(*) AS n FROM said GROUP BY ALL",
    "compare_tables": compared("SELECT * FROM cmp"),
    "match_stats": compared(
        f"""SELECT t AS total_rows, m AS missing_actual_rows, e AS extra_actual_rows, v AS value_mismatch_rows, t - m - e - v AS matched_rows, {_ratio("(t - m - e - v)", "t")} AS match_rate FROM (SELECT (SELECT count(*) FROM (SELECT standard_job, month FROM a UNION SELECT standard_job, month FROM b)) AS t,
  count(*) FILTER (status = 'missing_actual') AS m, count(*) FILTER (status = 'extra_actual') AS e, count(*) FILTER (status = 'value_mismatch') AS v FROM cmp)"""
    ),
    "set_prf1": "WITH g AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), f AS (SELECT DISTINCT doc_id FROM documents WHERE length(text) > 600), n AS (SELECT count(*) FILTER (g.doc_id IS NOT NULL AND f.doc_id IS NOT NULL) AS tp, count(*) FILTER (g.doc_id IS NULL) AS fp, count(*) FILTER (f.doc_id IS NULL) AS fn FROM g FULL JOIN f ON g.doc_id = f.doc_id)\n"
    + f'SELECT tp, fp, fn, {_ratio("tp", "(tp + fp)")} AS "precision", {_ratio("tp", "(tp + fn)")} AS recall, {_ratio("2 * tp", "(2 * tp + fp + fn)")} AS f1 FROM n',
    "hash_split_counts": "SELECT CASE WHEN b < 8 THEN 'train' WHEN b < 9 THEN 'dev' ELSE 'test' END AS split, count(*) AS n FROM (SELECT ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 10 AS b FROM orders) GROUP BY ALL",
    "sync_check_symdiff": "WITH a AS (SELECT DISTINCT p_name FROM part WHERE p_size < 30), b AS (SELECT DISTINCT p_name FROM part WHERE p_retailprice > 1500) SELECT p_name, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT p_name, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
    "overview": freq(False, _as_of(None), WINDOWS, SNAPS, DIFF)
    + """\nSELECT (SELECT max(month) FROM freq) AS latest_month, (SELECT count(DISTINCT standard_job) FROM freq) AS job_count, (SELECT count(DISTINCT skill) FROM freq) AS skill_count, (SELECT count(*) FROM freq) AS frequency_rows, (SELECT count(*) FROM win) AS lifecycle_rows,
  (SELECT count(DISTINCT skill) FROM freq WHERE monthly_skill_count > 0) AS migration_skill_count, (SELECT count(*) FROM diffs WHERE to_month = (SELECT max(month) FROM freq) AND change_type = '新增技能') AS latest_new_skill_count,
  (SELECT count(*) FROM diffs WHERE to_month = (SELECT max(month) FROM freq) AND change_type = '频率下降技能') AS latest_declining_skill_count""",
    "list_months": freq(True) + "\nSELECT DISTINCT month FROM freq",
    "job_trend": freq(True, "r AS (SELECT * FROM freq WHERE standard_job = 'NATION_3' AND month BETWEEN '1996-01' AND '1997-12')", "t AS (SELECT skill FROM r GROUP BY skill ORDER BY sum(monthly_skill_count) DESC, max(cumulative_skill_count) DESC, skill LIMIT 8)")
    + "\nSELECT m.month, t.skill, coalesce(r.monthly_skill_frequency, 0.0) AS frequency, coalesce(r.monthly_skill_count, 0) AS count FROM (SELECT DISTINCT month FROM r) m CROSS JOIN t LEFT JOIN r ON r.month = m.month AND r.skill = t.skill",
    "lifecycle_top": life("1998-06", "SELECT standard_job, skill, lifecycle_status, current_monthly_skill_frequency, recent_3m_skill_count FROM life WHERE standard_job = (SELECT min(standard_job) FROM life) ORDER BY lifecycle_status, current_monthly_skill_frequency DESC, recent_3m_skill_count DESC, skill LIMIT 50"),
    "migration_leaders": moved("SELECT skill, spread_job_count, total_skill_mentions FROM migration ORDER BY spread_job_count DESC, total_skill_mentions DESC, skill LIMIT 20"),
    "skill_spread_tail": moved("SELECT month, standard_job, monthly_skill_count, cumulative_covered_job_count FROM spread WHERE skill = 'Brand#11 ECONOMY' ORDER BY month DESC, standard_job DESC LIMIT 120"),
    "monthly_rank_emerging": profiles(f", {ONE} SELECT {RANK_COLUMNS} FROM one WHERE change_type IN ('新增技能', '频率上升技能') ORDER BY frequency_delta DESC, to_monthly_skill_frequency DESC, skill LIMIT 20"),
    "monthly_rank_declining": profiles(f", {ONE} SELECT {RANK_COLUMNS} FROM one WHERE change_type IN ('消失技能', '频率下降技能') ORDER BY frequency_delta, to_monthly_skill_frequency DESC, skill LIMIT 20"),
    "profile_compare": profiles(f"SELECT {RANK_COLUMNS}, (row_number() OVER (PARTITION BY change_type ORDER BY abs(frequency_delta) DESC, to_monthly_skill_frequency DESC, from_monthly_skill_frequency DESC, standard_job, skill))::INT AS place FROM diffs WHERE standard_job = 'BUILDING' AND from_month = '1996-01' AND to_month = '1997-01'"),
    "optimization_profile": profiles("SELECT standard_job, skill, rank_in_month, is_core_skill FROM curp WHERE standard_job = 'BUILDING'"),
    "chart_category": base(True) + "\nSELECT standard_category AS label, count(*) AS total FROM post JOIN tax USING (standard_job) GROUP BY ALL ORDER BY total DESC, label LIMIT 10",
    "chart_top_skills": freq(True) + "\nSELECT skill AS label, sum(monthly_skill_count)::BIGINT AS total FROM freq GROUP BY ALL ORDER BY total DESC, label LIMIT 10",
    "chart_monthly": freq(False) + "\nSELECT month AS label, sum(monthly_jd_count)::BIGINT AS total FROM (SELECT DISTINCT month, standard_job, monthly_jd_count FROM freq) GROUP BY ALL ORDER BY total DESC, label LIMIT 24",
    "trend_view": trend("TRUE"),
    "emerging_alerts": trend("lifecycle_status = '新兴技能'"),
    "deprecated_alerts": trend("lifecycle_status IN ('衰退技能', '废弃技能')"),
    "keyword_search": "SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red')",
    "resolve_value": "SELECT coalesce(max(n_name) FILTER (n_name = 'nation_1'), min(n_name) FILTER (contains(lower(n_name), 'nation_1')), 'nation_1') AS value FROM nation",
    "profile_feed_top18": profiles(
        """, l AS (SELECT standard_job, skill, arg_max(cumulative_skill_frequency, month) AS f, arg_max(cumulative_skill_count, month) AS c FROM snaps WHERE cumulative_skill_count > 0 GROUP BY ALL)
SELECT standard_job, skill, (row_number() OVER (PARTITION BY standard_job ORDER BY f DESC, c DESC, skill))::INT AS place FROM l QUALIFY place <= 18""",
        True,
    ),
    "evolution_nodes": profiles(
        """, d AS (SELECT standard_job, skill, (row_number() OVER (PARTITION BY standard_job ORDER BY abs(frequency_delta) DESC, skill))::INT AS place FROM diffs WHERE from_month = '1996-01' AND to_month = '1997-01' QUALIFY place <= 4),
c AS (SELECT standard_job, skill, rank_in_month FROM snaps WHERE month <= '1997-01' AND monthly_skill_count > 0 QUALIFY month = max(month) OVER (PARTITION BY standard_job)),
e AS (SELECT c.standard_job, c.skill, (row_number() OVER (PARTITION BY c.standard_job ORDER BY rank_in_month, c.skill))::INT AS place FROM c ANTI JOIN d ON d.standard_job = c.standard_job AND d.skill = c.skill QUALIFY place <= 8)
SELECT standard_job, skill, 'changed' AS band, place FROM d UNION ALL SELECT standard_job, skill, 'existing', place FROM e"""
    ),
    "clean_text": r"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS text FROM documents",
    "url_and_year_regex": r"SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '(20\d{2})', 1) AS year FROM pages",
    "title_level_normalize": "SELECT p_partkey, p_name || '开发工程师' AS title, p_name AS plain FROM part",
    "keyword_matches": f"WITH {HITS} SELECT job_id, standard_job, field, keyword FROM hits",
    "seed_assignment": f"WITH {ASSIGNED} SELECT * FROM asg",
    "assignment_review": f"WITH {ASSIGNED} SELECT job_id, assigned_standard_job, assignment_score, assignment_margin FROM asg WHERE assignment_status = 'needs_review'",
    "cosine_topk": f'WITH {COSINE} SELECT job_id, (row_number() OVER (PARTITION BY job_id ORDER BY score DESC, name))::INT AS "rank", name, round(score, 6) AS score FROM cos QUALIFY "rank" <= 3',
    "category_scores": f"WITH {COSINE} SELECT job_id, category, round(max(score), 6) AS score, array_to_string(list(name ORDER BY score DESC, name)[1:3], '; ') AS top_jobs FROM cos GROUP BY ALL",
    "route_ladder": f"""WITH {COSINE}, c AS (SELECT job_id, name, category, round(score, 4) AS score FROM cos), k AS (SELECT *, max(score) OVER (PARTITION BY job_id, category) AS cs, max(score) OVER (PARTITION BY job_id) AS bs FROM c),
k2 AS (SELECT *, dense_rank() OVER (PARTITION BY job_id ORDER BY cs DESC, category) AS cr FROM k), n AS (SELECT *, lead(score) OVER w AS second, row_number() OVER w AS rn FROM k2 WHERE cs >= 0.58::DOUBLE AND bs - cs <= 0.03::DOUBLE AND cr <= 3 WINDOW w AS (PARTITION BY job_id ORDER BY score DESC, name)),
t AS (SELECT j.job_id, n.name, n.score, coalesce(n.score - n.second, 1.0) AS margin FROM (SELECT DISTINCT job_id FROM c) j LEFT JOIN n ON n.job_id = j.job_id AND n.rn = 1)
SELECT job_id, CASE WHEN name IS NULL THEN 'new_family' WHEN score < 0.58::DOUBLE THEN 'potential_new_job' WHEN score >= 0.82::DOUBLE AND margin >= 0.03::DOUBLE THEN 'existing_job' ELSE 'potential_new_job' END AS route_status,
  CASE WHEN score >= 0.82::DOUBLE AND margin >= 0.03::DOUBLE THEN name ELSE '' END AS standard_job, CASE WHEN name IS NULL THEN 'category below floor' WHEN score < 0.58::DOUBLE THEN 'job below floor' WHEN score >= 0.82::DOUBLE AND margin >= 0.03::DOUBLE THEN 'direct' ELSE 'middle zone without a judge' END AS route_reason FROM t""",
    "gap_guard": """WITH t AS (SELECT p_partkey, p_name || CASE WHEN p_size % 7 = 0 THEN ' Robotaxi' ELSE '' END AS title FROM part), g AS (SELECT p_partkey, CASE WHEN contains(lower(title), 'robotaxi') THEN 'new_family'
  WHEN contains(lower(title), 'red') AND (contains(lower(title), 'a') OR contains(lower(title), 'i')) AND NOT contains(lower(title), 'bolt') THEN 'potential_new_job' END AS guard_status FROM t)
SELECT p_partkey, guard_status, CASE WHEN guard_status = 'new_family' THEN 'new_family_robotics' ELSE 'red_things' END AS guard_rule FROM g WHERE guard_status IS NOT NULL""",
    "mention_rollup": f"""WITH {PARTS}, o AS (SELECT p_brand AS job_id, lower(a) AS skill_key, p_name AS sentence, p_type AS field, z AS span_text, min(a) AS k, max(p_size / 50.0::DOUBLE) AS c, max((p_size > 25)::INT) AS r FROM parts JOIN (SELECT p_partkey, p_type FROM part) USING (p_partkey) GROUP BY ALL),
f AS (SELECT job_id, skill_key, field, min({{'s': sentence, 'z': span_text}}) AS o1 FROM o GROUP BY ALL), g AS (SELECT job_id, skill_key, string_agg(field, '; ' ORDER BY o1, field) AS fields FROM f GROUP BY ALL),
t AS (SELECT job_id, skill_key, span_text, min(sentence) AS o1 FROM o GROUP BY ALL), u AS (SELECT job_id, skill_key, string_agg(span_text, '; ' ORDER BY o1, span_text) AS spans FROM t GROUP BY ALL)
SELECT o.job_id, o.skill_key, min(k) AS skill_keyword, CASE WHEN max(r) = 1 THEN 'required' ELSE 'preferred' END AS skill_type, count(*) AS mention_count, max(c) AS max_confidence, count(DISTINCT sentence) AS evidence_count, array_to_string(list_sort(list(DISTINCT sentence)), '; ') AS evidence_sentences,
any_value(fields) AS evidence_fields, any_value(spans) AS span_texts, 'own' AS match_methods, CASE WHEN length(min(k)) > 4 THEN min(k) ELSE '' END AS dictionary_skill_keyword FROM o JOIN g ON g.job_id = o.job_id AND g.skill_key = o.skill_key JOIN u ON u.job_id = o.job_id AND u.skill_key = o.skill_key GROUP BY o.job_id, o.skill_key""",
    "normalize_cascade": f"""WITH {DICTIONARY}, {PARTS}, r AS (SELECT p_partkey, x.s AS xs, x.d AS xd, y.s AS ys, y.d AS yd FROM parts LEFT JOIN dic x ON x.k = lower(a) LEFT JOIN dic y ON y.k = lower(z))
SELECT p_partkey, coalesce(xs, ys, '') AS normalized_skill, coalesce(xd, yd, '') AS kg_display_skill, CASE WHEN coalesce(xs, ys) IS NULL THEN 'unresolved' ELSE 'normalized' END AS normalization_status, CASE WHEN coalesce(xs, ys) IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS normalization_confidence FROM r""",
    "review_flags": f"""WITH {DICTIONARY}, {PARTS} SELECT a AS normalized_skill, (p_size / 50.0::DOUBLE < 0.8::DOUBLE OR lower(a) NOT IN (SELECT k FROM dic)) AS needs_review, count(*) AS n FROM parts GROUP BY ALL""",
    "raw_json_normalize": "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events",
    "publish_month_audit": "SELECT strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y') AS recruitment_year, count(*) AS n_rows, count(*) FILTER (value < 10) AS blank_rows FROM events GROUP BY ALL",
    "gov_join_metadata": """WITH r0 AS (SELECT l_orderkey, max({'o': l_linenumber * 10000000::BIGINT + l_partkey, 'f': l_returnflag, 's': l_linestatus}) AS m FROM lineitem GROUP BY ALL), r AS (SELECT l_orderkey, m.f AS f, m.s AS s FROM r0)
SELECT o_orderkey AS job_id, o_custkey, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderpriority END AS agency, coalesce(f, '') AS route_status, coalesce(s, '') AS cleaned_job_title FROM orders LEFT JOIN r ON l_orderkey = o_orderkey""",
    "distinct_clean_join_back": "SELECT p_partkey, upper(p_name) AS cleaned_job_title FROM part",
    "stream_equals_batch": freq(False) + "\nSELECT * FROM freq",
    "stream_dedup": base(False) + "\nSELECT standard_job, count(*) AS n, count(DISTINCT job_id) AS n_jobs FROM post GROUP BY ALL",
    "stream_late_month": freq(False) + "\nSELECT standard_job, max(cumulative_jd_count) AS jds, sum(cumulative_skill_count)::BIGINT AS skills FROM freq GROUP BY ALL",
}

