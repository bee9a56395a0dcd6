"""The library's queries over the test tables, by name; oracles.py has their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import compare, extract, frequency, lifecycle, migration, pool, profile, routing
from .plans import government, resumes, serving
from .sources import testdata
from .sources.shared import shared_folder, stored
from .streaming.incremental import EventStore, run_stream

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def freq(spark: SparkSession, sf: str, sparse: bool = True) -> DataFrame:
    return frequency.monthly_frequency(testdata.events(spark, sf, sparse), unique=True)


def counts(spark: SparkSession, sf: str, sparse: bool = True) -> tuple[DataFrame, DataFrame]:
    """Postings by job and month, and by skill; an order is one event."""
    return frequency.posting_counts(frequency.valid_events(testdata.events(spark, sf, sparse)), unique=True)




# frequency


@query
def explode_skills(spark, sf):
    return frequency.explode_skills(testdata.events(spark, sf, True))


@query
def event_filter_valid(spark, sf):
    return frequency.valid_events(testdata.events(spark, sf)).groupBy("month").agg(F.count("*").alias("n"))


@query
def monthly_jd_count(spark, sf):
    return frequency.monthly_jd_count(testdata.events(spark, sf, True))


@query
def monthly_skill_count(spark, sf):
    return frequency.monthly_skill_count(frequency.explode_skills(testdata.events(spark, sf, True)))


@query
def monthly_frequency(spark, sf):
    return freq(spark, sf)


@query
def monthly_frequency_dense(spark, sf):
    return freq(spark, sf, False)


@query
def demand_grid(spark, sf):
    return frequency.demand_grid(testdata.events(spark, sf, True), testdata.taxonomy(spark, sf, True))


@query
def frequency_dense(spark, sf):
    return frequency.dense_frequency(testdata.events(spark, sf), testdata.taxonomy(spark, sf), unique=True)


@query
def frequency_dense_universe(spark, sf):
    return frequency.dense_frequency(testdata.events(spark, sf, True), testdata.taxonomy(spark, sf, True), universe=testdata.universe(spark, sf, True))


@query
def quality_report(spark, sf):
    return frequency.quality_report(testdata.events(spark, sf, True), testdata.taxonomy(spark, sf, True).where("standard_category <> 'ASIA'"))


# life cycle


@query
def job_as_of_month(spark, sf):
    return lifecycle.job_as_of_months(freq(spark, sf))


@query
def pair_windows(spark, sf):
    f = freq(spark, sf)
    return lifecycle.pair_windows(f, lifecycle.job_as_of_months(f)).drop("recent_6m_frequency_stddev")


@query
def frequency_stddev6(spark, sf):
    f = freq(spark, sf)
    return lifecycle.pair_windows(f, lifecycle.job_as_of_months(f)).select("standard_job", "skill", "recent_6m_frequency_stddev")


@query
def coverage_metrics(spark, sf):
    return lifecycle.coverage(freq(spark, sf))


def _lifecycle(spark, sf, as_of=None):
    cells, said = counts(spark, sf)
    return lifecycle.monthly_lifecycle(frequency.active_frequency(cells, said), testdata.families(spark, sf, True), as_of, jobs=frequency.job_totals(cells, as_of)).drop("lifecycle_reason")


@query
def lifecycle_monthly(spark, sf):
    return _lifecycle(spark, sf)


@query
def lifecycle_as_of(spark, sf):
    return _lifecycle(spark, sf, "1998-06")


@query
def lifecycle_annual(spark, sf):
    yearly = testdata.events(spark, sf, True).withColumn("month", F.concat(F.substring("month", 1, 4), F.lit("-10")))
    return lifecycle.annual_lifecycle(frequency.monthly_frequency(yearly))


@query
def lifecycle_summary(spark, sf):
    return lifecycle.lifecycle_summary(_lifecycle(spark, sf, "1998-06"))


# migration


@query
def skill_first_month(spark, sf):
    return migration.skill_first_month(freq(spark, sf))


@query
def skill_job_first_month(spark, sf):
    return migration.skill_job_first_month(freq(spark, sf))


@query
def monthly_coverage(spark, sf):
    return migration.monthly_coverage(freq(spark, sf))


@query
def cumulative_coverage(spark, sf):
    return migration.cumulative_coverage(freq(spark, sf))


@query
def confirmed_first_month(spark, sf):
    return migration.confirmed_first_month(freq(spark, sf), 2)


@query
def peak_month(spark, sf):
    return migration.peak_month(freq(spark, sf))


@query
def migration_path(spark, sf):
    return migration.migration_path(freq(spark, sf)).select("skill", "first_seen_standard_jobs", "spread_standard_jobs", "all_standard_jobs", "migration_path")


@query
def skill_migration(spark, sf):
    return migration.migration(frequency.active_frequency(*counts(spark, sf)), testdata.families(spark, sf, True)).drop("migration_interpretation")


@query
def skill_spread(spark, sf):
    cells, said = counts(spark, sf)
    return migration.spread(frequency.frequency_grid(cells, said), testdata.families(spark, sf, True), said)


@query
def spread_lag_delta(spark, sf):
    return migration.spread(freq(spark, sf, False)).select("skill", "standard_job", "month", "monthly_frequency_change", "cumulative_frequency_change")


# profiles


def _snapshots(spark, sf, sparse=False):
    return profile.snapshots(freq(spark, sf, sparse), testdata.families(spark, sf, sparse))


@query
def rank_in_month(spark, sf):
    return profile.rank_in_month(freq(spark, sf, False)).select("standard_job", "month", "skill", "rank_in_month")


@query
def profile_snapshots(spark, sf):
    return _snapshots(spark, sf)


def _diff(spark, sf):
    return profile.profile_diff(stored(_snapshots(spark, sf), "snapshots"))


@query
def profile_diff(spark, sf):
    return _diff(spark, sf)


@query
def current_profile(spark, sf):
    return profile.current_snapshots(frequency.latest_frequency(*counts(spark, sf)), testdata.families(spark, sf, True))


@query
def profile_fallback_diff(spark, sf):
    return profile.fallback_diff(_snapshots(spark, sf, True), "NATION_3", "1996-01", "1996-06")


def _overrides(spark):
    rows = [
        ("1", "NATION_3", "Brand#11 ECONOMY", "delete", "", "", "", "2026-01-01"),
        ("2", "NATION_3", "Brand#12 STANDARD", "update", "Renamed", "Family", "", "2026-01-01"),
        ("3", "NATION_3", "Brand#12 STANDARD", "delete", "", "", "", "2025-12-31"),
        ("4", "NATION_7", "Handmade", "add", "", "Family", "", "2026-01-02"),
    ]
    return spark.createDataFrame(rows, "override_id string, standard_job string, skill string, action string, new_skill string, kg_display_skill string, note string, updated_at string")


@query
def profile_overlay(spark, sf):
    latest = _snapshots(spark, sf, True).where("month <= '1996-06'")
    out = profile.apply_overrides(profile.current_profile(latest), _overrides(spark))
    return out.select("standard_job", "skill", "kg_display_skill", F.coalesce("monthly_skill_count", F.lit(0).cast("long")).alias("monthly_skill_count"), "is_override")


@query
def live_effect(spark, sf):
    snaps = stored(_snapshots(spark, sf), "snapshots")
    at = lambda month: profile.current_profile(snaps.where(F.col("month") <= month))
    return profile.live_effect(at("1996-05"), at("1996-06")).select("standard_job", "skill", "effect", "frequency_delta")


# pool


@query
def skill_pool(spark, sf):
    return _pool(testdata.events(spark, sf, True), spark, sf)


def _pool(events, spark, sf):
    return pool.skill_pool(events, testdata.taxonomy(spark, sf, True), testdata.universe(spark, sf, True), unique=True)


@query
def skill_pool_incremental(spark, sf):
    ev = testdata.events(spark, sf, True)
    merged = pool.merge_pool(_pool(ev.where("month < '1998-01'"), spark, sf), _pool(ev.where("month >= '1998-01'"), spark, sf))
    return merged.select("skill_key", "normalized_skill", "kg_display_skill", "first_seen_month", "last_seen_month", "first_seen_job_id", "last_seen_job_id", "mention_count", "source_count", "sources")


@query
def pool_lookup_join(spark, sf):
    mentions = frequency.explode_skills(testdata.events(spark, sf, True)).groupBy("skill").agg(F.count("*").alias("n"))
    return lifecycle.pool_lookup(mentions, testdata.families(spark, sf, True), ["kg_display_skill", "skill_type"])


@query
def mention_jobs(spark, sf):
    return pool.mention_jobs(testdata.events(spark, sf)).groupBy("skill_key").agg(F.count("*").alias("n"))


# comparison


def _changed(df: DataFrame) -> DataFrame:
    """A copy with rows left out, added and changed by rule."""
    n = F.col("monthly_jd_count")
    return df.where("month <> '1995-03'").withColumns({"monthly_jd_count": F.when(F.col("month") == "1996-02", n + 1).otherwise(n)})


def _two(spark, sf):
    a = stored(frequency.demand_grid(testdata.events(spark, sf, True), testdata.taxonomy(spark, sf, True)), "demand")
    return _changed(a), a.where("month <> '1997-05'")


KEYS, VALUES = ["standard_job", "month"], ["monthly_jd_count", "cumulative_jd_count", "is_active_month"]


@query
def compare_tables(spark, sf):
    return compare.compare_tables(*_two(spark, sf), KEYS, VALUES)


@query
def match_stats(spark, sf):
    a, b = _two(spark, sf)
    return compare.match_statistics(a, b, KEYS, compare.compare_tables(a, b, KEYS, VALUES))


@query
def set_prf1(spark, sf):
    found = testdata.table(spark, sf, "documents").where("length(text) > 600").select("doc_id")
    return compare.set_scores(testdata.table(spark, sf, "labels").where("quality = 1").select("doc_id"), found, ["doc_id"])


@query
def hash_split_counts(spark, sf):
    return testdata.table(spark, sf, "orders").select(T.split_bucket(F.col("o_orderkey")).alias("split")).groupBy("split").agg(F.count("*").alias("n"))


@query
def sync_check_symdiff(spark, sf):
    part = testdata.table(spark, sf, "part")
    return compare.symmetric_difference(part.where("p_size < 30").select("p_name"), part.where("p_retailprice > 1500").select("p_name"))


# serving


@query
def overview(spark, sf):
    f = stored(freq(spark, sf, False), "frequency")
    snaps = profile.snapshots(f)
    return serving.overview(f, lifecycle.monthly_lifecycle(f), migration.migration(f), profile.profile_diff(snaps))


@query
def list_months(spark, sf):
    return serving.list_values(freq(spark, sf), "month")


@query
def job_trend(spark, sf):
    return serving.job_trend(freq(spark, sf), "NATION_3", 8, "1996-01", "1997-12")


@query
def lifecycle_top(spark, sf):
    return serving.lifecycle_rows(_lifecycle(spark, sf, "1998-06"), None, None, 50).select("standard_job", "skill", "lifecycle_status", "current_monthly_skill_frequency", "recent_3m_skill_count")


@query
def migration_leaders(spark, sf):
    return serving.migration_leaders(migration.migration(stored(freq(spark, sf), "frequency"))).select("skill", "spread_job_count", "total_skill_mentions")


@query
def skill_spread_tail(spark, sf):
    return serving.skill_spread_tail(migration.spread(freq(spark, sf)), "Brand#11 ECONOMY").select("month", "standard_job", "monthly_skill_count", "cumulative_covered_job_count")


RANKED = ["standard_job", "skill", "from_month", "to_month", "change_type", "frequency_delta"]


@query
def monthly_rank_emerging(spark, sf):
    return serving.monthly_rank(_diff(spark, sf), "2000-06").select(*RANKED)


@query
def monthly_rank_declining(spark, sf):
    return serving.monthly_rank(_diff(spark, sf), "2000-06", "declining").select(*RANKED)


@query
def profile_compare(spark, sf):
    d = _diff(spark, sf).where("standard_job = 'BUILDING' AND from_month = '1996-01' AND to_month = '1997-01'")
    return serving.profile_changes(d).select(*RANKED, "place")


@query
def optimization_profile(spark, sf):
    return serving.optimization_profile(profile.current_profile(_snapshots(spark, sf)), "BUILDING").select("standard_job", "skill", "rank_in_month", "is_core_skill")


@query
def chart_category(spark, sf):
    ev = testdata.events(spark, sf, True).join(testdata.taxonomy(spark, sf, True), "standard_job").withColumn("n", F.lit(1).cast("long"))
    return serving.chart(ev, "standard_category", "n")


@query
def chart_top_skills(spark, sf):
    return serving.chart(freq(spark, sf), "skill", "monthly_skill_count")


@query
def chart_monthly(spark, sf):
    return serving.chart(freq(spark, sf, False).select("month", "standard_job", "monthly_jd_count").distinct(), "month", "monthly_jd_count", 24)


def _trend(spark, sf):
    f = stored(freq(spark, sf), "frequency")
    return serving.trend_view(lifecycle.monthly_lifecycle(f, None, "1998-06").drop("lifecycle_reason"), migration.migration(f))


TREND = ["standard_job", "skill", "lifecycle_status", "migration_origin_jobs", "migration_path", "total_skill_mentions"]


@query
def trend_view(spark, sf):
    return _trend(spark, sf).select(*TREND)


@query
def emerging_alerts(spark, sf):
    return serving.emerging_alerts(_trend(spark, sf)).select(*TREND)


@query
def deprecated_alerts(spark, sf):
    return serving.deprecated_alerts(_trend(spark, sf)).select(*TREND)


@query
def keyword_search(spark, sf):
    return serving.keyword_search(testdata.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand"), "RED")


@query
def resolve_value(spark, sf):
    return serving.resolve_value(testdata.table(spark, sf, "nation"), "n_name", "nation_1")


@query
def profile_feed_top18(spark, sf):
    return serving.profile_feed(_snapshots(spark, sf, True)).select("standard_job", "skill", "place")


@query
def evolution_nodes(spark, sf):
    snaps = stored(_snapshots(spark, sf), "snapshots")
    pair = profile.profile_diff(snaps).where("from_month = '1996-01' AND to_month = '1997-01'")
    return serving.evolution_nodes(pair, profile.current_profile(snaps.where("month <= '1997-01'")))


# texts and routing


@query
def clean_text(spark, sf):
    return testdata.table(spark, sf, "documents").select("doc_id", T.clean_text(F.col("text")).alias("text"))


@query
def sentence_units(spark, sf):
    return extract.sentence_units(testdata.table(spark, sf, "documents").select(F.col("doc_id").alias("job_id"), F.col("source").alias("job_title"), F.col("text").alias("job_description")))


@query
def url_and_year_regex(spark, sf):
    return testdata.table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), T.year_of(F.col("url")).alias("year"))


@query
def title_level_normalize(spark, sf):
    levels = F.when(F.col("p_size") % 3 == 0, "高级").when(F.col("p_size") % 3 == 1, "资深").otherwise("")
    title = F.concat(levels, "p_name", F.lit("开发专家"))
    return testdata.table(spark, sf, "part").select("p_partkey", T.normalize_level(title).alias("title"), T.strip_rank_suffix(F.concat("p_name", F.lit("一级主任科员"))).alias("plain"))


def _keywords(spark, sf):
    words = testdata.table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("keyword")).distinct()
    return words.select(F.upper(F.substring("keyword", 1, 1)).alias("standard_job"), "keyword")


def _priorities(spark, sf):
    return _keywords(spark, sf).select("standard_job").distinct().withColumn("priority", F.when(F.col("standard_job") == "R", 0).otherwise(F.ascii("standard_job")))


def _assignments(spark, sf):
    return routing.seed_assignment(testdata.postings_text(spark, sf), _keywords(spark, sf), _priorities(spark, sf))


@query
def keyword_matches(spark, sf):
    fields = {"job_title": 6, "job_responsibility": 5, "job_requirement": 1}
    return routing.keyword_matches(testdata.postings_text(spark, sf), _keywords(spark, sf), fields)


@query
def seed_assignment(spark, sf):
    return _assignments(spark, sf)


@query
def assignment_review(spark, sf):
    return routing.assignment_review(testdata.postings_text(spark, sf), _assignments(spark, sf)).select("job_id", "assigned_standard_job", "assignment_score", "assignment_margin")


def _centres(spark, sf):
    return testdata.table(spark, sf, "embeddings").groupBy(F.concat(F.lit("job-"), "label").alias("name"), F.concat(F.lit("family-"), F.col("label") % 3).alias("category")).agg(F.array(*(F.avg(F.col("embedding")[i].cast("double")) for i in range(64))).alias("v"))


def _vectors(spark, sf):
    return testdata.table(spark, sf, "embeddings").select(F.col("vec_id").alias("job_id"), F.col("embedding").alias("v"))


def _ladder(spark, sf, slack=0.0, top=3):
    """The candidates that decide; slack for scores that are rounded afterwards."""
    return routing.ladder_candidates(_vectors(spark, sf), _centres(spark, sf), top=top, slack=slack)


@query
def cosine_topk(spark, sf):
    return routing.cosine_candidates(_vectors(spark, sf), _centres(spark, sf), 3).select("job_id", "rank", "name", F.round("score", 6).alias("score"))


@query
def category_scores(spark, sf):
    return routing.category_scores(_ladder(spark, sf)).select("job_id", "category", F.round("score", 6).alias("score"), "top_jobs")


@query
def route_ladder(spark, sf):
    found = _ladder(spark, sf, 1e-4).withColumn("score", F.round("score", 4))
    return routing.route(found).select("job_id", "route_status", "standard_job", "route_reason")


@query
def gap_guard(spark, sf):
    titles = testdata.table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.when(F.col("p_size") % 7 == 0, " Robotaxi").otherwise("")).alias("title"))
    rules = (("red_things", (("red",), ("a", "i")), ("bolt",), ("Red Engineer",)),)
    return routing.gap_guard(titles, (), (), potential=rules).where("guard_status IS NOT NULL").select("p_partkey", "guard_status", "guard_rule")


def _mentions(spark, sf):
    part = testdata.table(spark, sf, "part")
    word = F.element_at(F.split("p_name", " "), 1)
    return part.select(
        F.col("p_brand").alias("job_id"), word.alias("skill_keyword"), F.col("p_name").alias("evidence_sentence"), F.col("p_type").alias("evidence_field"), F.element_at(F.split("p_name", " "), -1).alias("span_text"), F.lit(0).alias("span_start"), F.length("p_name").alias("span_end"),
        F.when(F.col("p_size") > 25, "required").otherwise("preferred").alias("skill_type"), (F.col("p_size") / 50).alias("confidence"), F.when(F.length(word) > 4, word).otherwise("").alias("dictionary_skill_keyword"),
        F.lit("").alias("normalized_skill_candidate"), F.lit("").alias("kg_display_skill_candidate"), F.lit("own").alias("match_method"),
    )


@query
def mention_rollup(spark, sf):
    out = extract.mention_rollup(_mentions(spark, sf)).drop("normalized_skill_candidate", "kg_display_skill_candidate")
    return out.withColumns({c: F.array_join(c, "; ") for c in ("evidence_sentences", "evidence_fields", "span_texts", "match_methods")})


def _dictionary(spark, sf):
    """The words of parts' names as a dictionary, but for those of four letters or less, so that some words stay unresolved."""
    words = _keywords(spark, sf).select(F.col("keyword").alias("skill_keyword")).where("length(skill_keyword) > 4")
    return words.select("skill_keyword", F.upper("skill_keyword").alias("normalized_skill"), F.substring("skill_keyword", 1, 1).alias("kg_display_skill"))


@query
def dictionary_mentions(spark, sf):
    units = testdata.table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("text"))
    return extract.dictionary_mentions(units, _dictionary(spark, sf))


@query
def normalize_cascade(spark, sf):
    part = testdata.table(spark, sf, "part")
    rows = part.select("p_partkey", F.lit("").alias("normalized_skill_candidate"), F.lit("").alias("dictionary_skill_keyword"), F.element_at(F.split("p_name", " "), 1).alias("skill_keyword"), F.element_at(F.split("p_name", " "), -1).alias("span_text"))
    return extract.normalize_skills(rows, _dictionary(spark, sf)).select("p_partkey", "normalized_skill", "kg_display_skill", "normalization_status", "normalization_confidence")


@query
def review_flags(spark, sf):
    skills = _mentions(spark, sf).select(F.col("skill_keyword").alias("normalized_skill"), "confidence", F.lit("normalized").alias("normalization_status"))
    return extract.review_flags(skills, _dictionary(spark, sf)).groupBy("normalized_skill", "needs_review").agg(F.count("*").alias("n"))


# government, streaming, generator


@query
def raw_json_normalize(spark, sf):
    from .sources.readers import parse_json

    return testdata.table(spark, sf, "events").select("event_id", parse_json(F.col("props"), "k long")["k"].alias("k"))


@query
def publish_month_audit(spark, sf):
    return testdata.table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month"), F.date_format("ts", "yyyy").alias("recruitment_year")).agg(F.count("*").alias("n_rows"), F.count_if(F.col("value") < 10).alias("blank_rows"))


@query
def gov_join_metadata(spark, sf):
    events = testdata.table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), "o_custkey")
    metadata = testdata.table(spark, sf, "orders").where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("agency"))
    routes = testdata.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_returnflag").alias("route_status"), F.col("l_linestatus").alias("cleaned_job_title"), (F.col("l_linenumber") * F.lit(10_000_000).cast("long") + F.col("l_partkey")).alias("routed_at"))
    return government.join_metadata(events, metadata, routes)


@query
def distinct_clean_join_back(spark, sf):
    cleaner = lambda titles: titles.withColumn("cleaned", F.upper("title"))
    out = government.clean_titles(testdata.table(spark, sf, "part").select("p_partkey", "p_name"), cleaner, "p_name")
    return out.select("p_partkey", "cleaned_job_title")


def whole_events(spark: SparkSession, sf: str) -> DataFrame:
    return testdata.events(spark, sf).withColumns({c: F.lit("") for c in ("job_title", "job_responsibility", "job_requirement")})


def _streamed(spark, sf, order) -> EventStore:
    """The dense events as a stream of three parts, in an order as given, with repeated rows; a batch takes some files of them."""
    ev = stored(whole_events(spark, sf), "events")
    folder = shared_folder(spark, "stream")
    third = lambda n: ev.where(F.pmod(F.crc32(F.col("job_id").cast("binary")), F.lit(3)) == n)
    files = [third(0), third(1).union(third(0)), third(2)]
    for n in order:
        files[n].select("job_id", "month", "standard_job", "job_title", "job_responsibility", "job_requirement", "skills").write.mode("append").parquet(f"{folder}/in")
    store = EventStore(spark, f"{folder}/store")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).option("maxFilesPerTrigger", spark.sparkContext.defaultParallelism).parquet(f"{folder}/in")
    run_stream(stream, store, f"{folder}/checkpoint")
    return store


@query
def stream_equals_batch(spark, sf):
    return _streamed(spark, sf, (0, 1, 2)).frequency()


@query
def stream_dedup(spark, sf):
    return _streamed(spark, sf, (1, 0, 2)).events().groupBy("standard_job").agg(F.count("*").alias("n"), F.countDistinct("job_id").alias("n_jobs"))


@query
def stream_late_month(spark, sf):
    ev = stored(whole_events(spark, sf), "events")
    store = EventStore(spark, shared_folder(spark, "late"))
    store.update(ev.where("month >= '1997-01'"), 0)
    store.update(ev.where("month < '1997-01'"), 1)
    return store.frequency().groupBy("standard_job").agg(F.max("cumulative_jd_count").alias("jds"), F.sum("cumulative_skill_count").alias("skills"))


@query
def synthetic_resumes(spark, sf):
    made = resumes.synthetic_resumes(stored(serving.profile_feed(_snapshots(spark, sf, True)), "feed"), 20)
    return made.withColumn("skills", F.array_join("skills", "; "))

