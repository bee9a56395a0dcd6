"""Queries over small tables of their own, against their SQL."""

import re

import pytest
from pyspark.sql import functions as F

from skilltide import oracles, oracles_flow, queries_flow
from skilltide.operators import frequency, routing
from skilltide.queries import QUERIES
from skilltide.sources import testdata
from skilltide.streaming import incremental

from .conftest import rows_by_name

ORACLE_SQL = oracles.ORACLE_SQL | oracles_flow.FLOW_SQL
assert queries_flow.query


@pytest.fixture
def equals_sql(spark, duck, tmp_path):
    """Whether a query gives what its SQL does over tables given as SELECTs; other tables are those of the smallest scale."""
    import duckdb

    def run(name, rows_in_group=100_000, **tables):
        held = duckdb.connect()
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            held.execute(f"COPY ({tables.get(t, f'''FROM '/root/testdata/sf0.001/{t}.parquet' ''')}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet, ROW_GROUP_SIZE {rows_in_group})")
        found = QUERIES[name](spark, str(tmp_path))
        got, expected = rows_by_name(found.columns, found.collect()), duck(str(tmp_path), ORACLE_SQL[name])
        return got == expected, len(expected[1])

    return run


def test_of_equal_cache_entries_the_first_of_the_table_counts(spark, equals_sql):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        lines = "SELECT * REPLACE (((i * 7919) % 500)::BIGINT AS l_orderkey, 7::INT AS l_linenumber, chr((65 + i % 26)::INT) AS l_returnflag) FROM (FROM '/root/testdata/sf0.001/lineitem.parquet' LIMIT 1), range(20000) r(i) ORDER BY i"
        same, n = equals_sql("cache_of_last_entries", 2048, lineitem=lines.replace("* REPLACE", "* EXCLUDE (i) REPLACE"))
        assert same and n == 500
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_months_that_were_compared_without_a_change_have_none(equals_sql):
    orders = "SELECT i::BIGINT AS o_orderkey, 0::BIGINT AS o_custkey, 'F' AS o_orderstatus, 1.0::DOUBLE AS o_totalprice, CASE WHEN i < 10 THEN TIMESTAMP '1996-01-02' ELSE TIMESTAMP '1997-01-02' END AS o_orderdate, '5-LOW' AS o_orderpriority FROM range({}) r(i)"
    lines = "SELECT * REPLACE (i::BIGINT AS l_orderkey, (i % 10)::BIGINT AS l_partkey) FROM (SELECT l.*, i FROM (FROM '/root/testdata/sf0.001/lineitem.parquet' LIMIT 1) l, range({}) r(i))"
    parts = "SELECT * REPLACE ('Brand#' || p_partkey AS p_brand) FROM '/root/testdata/sf0.001/part.parquet' WHERE p_partkey < 10"
    customers = "SELECT * REPLACE (0::BIGINT AS c_custkey, 'BUILDING' AS c_mktsegment) FROM (FROM '/root/testdata/sf0.001/customer.parquet' LIMIT 1)"
    tables = lambda n: {"orders": orders.format(n), "lineitem": lines.format(n).replace("* REPLACE", "* EXCLUDE (i) REPLACE"), "part": parts, "customer": customers}
    assert equals_sql("compared_months", **tables(20)) == (True, 0)
    assert equals_sql("compared_months", **tables(19)) == (True, 1)


def test_events_are_dealt_by_order_in_parts_of_bounded_size(spark, monkeypatch):
    whole = testdata.events(spark, "/root/testdata/sf0.001").collect()
    monkeypatch.setattr(testdata, "LINES", 500)
    dealt = testdata.events(spark, "/root/testdata/sf0.001")
    assert dealt.rdd.getNumPartitions() >= testdata.table(spark, "/root/testdata/sf0.001", "lineitem").count() // 500
    assert sorted(dealt.collect()) == sorted(whole)


def test_joins_of_the_events_sort_in_parts_of_bounded_size(spark, monkeypatch):
    """Where the session's partitions are too few, lines meet parts and orders customers in as many as the tables ask for."""
    sf = "/root/testdata/sf0.001"
    whole = sorted(testdata.events(spark, sf, True).collect())
    rows = sum(testdata.table(spark, sf, name).count() for name in ("lineitem", "orders"))
    monkeypatch.setattr(testdata, "LINES", 500)
    dealt = testdata.events(spark, sf, True)
    parts = dict(re.findall(r"hashpartitioning\((\w+)#\d+L?, (\d+)\), REPARTITION_BY_NUM", dealt._jdf.queryExecution().executedPlan().toString()))
    assert {key for key, n in parts.items() if int(n) >= rows // 500} == {"l_partkey", "p_partkey", "o_custkey", "c_custkey", "key"}
    assert sorted(dealt.collect()) == whole


def test_dealt_joins_of_the_events_keep_every_posting(spark, tmp_path, monkeypatch):
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    save("customer", [(1, "A"), (2, None), (4, "B"), (4, "C"), (None, "D")], "c_custkey long, c_mktsegment string")
    save("part", [(1, "b"), (2, "a"), (3, None), (None, "n"), (5, "c"), (5, "d")], "p_partkey long, p_brand string")
    save("orders", [(1, 1, "2024-01-05"), (1, 1, "2024-02-05"), (2, 2, "2024-01-05"), (3, 9, "2024-01-05"), (None, 1, "2024-03-05"), (5, 4, "2024-01-05"), (6, None, "2024-01-05")], "o_orderkey long, o_custkey long, o_orderdate string")
    save("lineitem", [(1, 1), (1, 2), (1, 2), (2, 3), (3, 1), (4, 1), (None, 1), (5, 5), (5, None), (6, 1)], "l_orderkey long, l_partkey long")
    monkeypatch.setattr(testdata, "LINES", 1)
    dealt = testdata.events(spark, str(tmp_path))
    assert "SortMergeJoin" in dealt._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in dealt.orderBy(F.asc_nulls_last("job_id"), "month", "standard_job").collect()]
    assert got == [("1", "2024-01", "A", ["a", "b"]), ("1", "2024-02", "A", ["a", "b"]), ("2", "2024-01", None, []), ("5", "2024-01", "B", ["c", "d"]), ("5", "2024-01", "C", ["c", "d"]), (None, "2024-03", "A", [])]


def test_ids_are_told_apart_in_the_parts_of_the_events(spark, monkeypatch):
    """The number of parts grows with the lines, so that a task does not; no shuffle of mentions follows."""
    told = []
    monkeypatch.setattr(frequency, "stored", lambda df, name: told.append(df) or df)
    events = testdata.events(spark, "/root/testdata/sf0.001", True)
    frequency.analysis(events, testdata.taxonomy(spark, "/root/testdata/sf0.001", True))
    frequency.posting_counts(frequency.valid_events(events))
    yearly = events.withColumn("month", F.concat(F.substring("month", 1, 4), F.lit("-10")))
    frequency.posting_counts(frequency.valid_events(yearly))
    for df in told:
        dealt = [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line and ("job_id" in line or "key#" in line)]
        assert len(dealt) == 1 and "REPARTITION_BY_NUM" in dealt[0]


def test_analysis_counts_ids_of_valid_events_once(spark):
    rows = [("1", "2024-01", "A", ["x", "x"]), ("1", "2024-01", "A", ["x", None]), ("2", "2024-01", "A", ["x"]), (None, "2024-01", "A", ["x"]), ("", "2024-01", "A", ["y"]), ("3", None, "A", ["x"]), ("3", "2024-01", None, None), ("4", "2024-02", "A", None)]
    events = spark.createDataFrame(rows, "job_id string, month string, standard_job string, skills array<string>")
    found = frequency.analysis(events, spark.createDataFrame([("A", "a"), ("B", "b")], "standard_job string, standard_category string"))
    q = found.quality.first()
    assert (q.event_stream_rows, q.valid_event_rows, q.unique_event_skills, q.jobs_without_events) == (8, 4, 1, "B")
    assert sorted((r.month, r.skill, r.monthly_jd_count, r.monthly_skill_count) for r in found.skill_frequency.collect()) == [("2024-01", "x", 2, 2), ("2024-02", "x", 1, 0)]


def test_events_keep_every_posting(spark, tmp_path):
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    save("customer", [(1, "A"), (2, None)], "c_custkey long, c_mktsegment string")
    save("part", [(1, "b"), (2, "a"), (3, None)], "p_partkey long, p_brand string")
    save("orders", [(1, 1, "2024-01-05"), (1, 1, "2024-02-05"), (2, 2, "2024-01-05"), (3, 9, "2024-01-05"), (None, 1, "2024-03-05")], "o_orderkey long, o_custkey long, o_orderdate string")
    save("lineitem", [(1, 1), (1, 2), (1, 2), (2, 3), (3, 1), (4, 1), (None, 1)], "l_orderkey long, l_partkey long")
    got = [tuple(r) for r in testdata.events(spark, str(tmp_path)).orderBy(F.asc_nulls_last("job_id"), "month").collect()]
    assert got == [("1", "2024-01", "A", ["a", "b"]), ("1", "2024-02", "A", ["a", "b"]), ("2", "2024-01", None, []), (None, "2024-03", "A", [])]


def test_titles_that_are_the_same_are_ranked_once(spark, monkeypatch):
    jobs = spark.createDataFrame([("red bolt", "x"), ("blue ring", "y"), ("red ring", "x")], "name string, category string")
    titles = spark.createDataFrame([(i, ("Red bolt", "red  BOLT ", "blue ring")[i % 3]) for i in range(90)] + [(100, "red"), (100, "ring"), (101, "ring"), (101, "red"), (None, "red bolt"), (102, None)], "job_id int, title string")
    told, inner = [], routing.stored
    monkeypatch.setattr(routing, "stored", lambda df, name: told.append((name, inner(df, name))) or told[-1][1])
    monkeypatch.setattr(routing, "TITLES", 10)
    got = sorted((r.job_id, r["rank"], r.name, round(r.score, 9)) for r in routing.gram_topk(titles, jobs, 3).collect())
    assert [(name, df.count()) for name, df in told] == [("titles", 92), ("texts", 3)]
    scores = {}
    for r in routing.gram_scores(titles, jobs).where("score >= 0.3 AND job_id IS NOT NULL").collect():
        scores.setdefault(r.job_id, []).append((-round(r.score, 9), r.name))
    assert got == sorted((i, n + 1, name, -s) for i, found in scores.items() for n, (s, name) in enumerate(sorted(found)[:3]))


def test_a_batch_is_worked_off_once(spark, tmp_path):
    store, seen = incremental.EventStore(spark, str(tmp_path / "store"), 2), spark.sparkContext.accumulator(0)
    mark = F.udf(lambda x: (seen.add(1), x)[1], "string").asNondeterministic()
    rows = lambda *ids: spark.createDataFrame([(str(i), "2025-01", "A", ["x"]) for i in ids], "job_id string, month string, standard_job string, skills array<string>").withColumns({c: F.lit("") for c in ("job_title", "job_responsibility", "job_requirement")})
    for number, ids in enumerate((range(6), range(4, 10))):
        store.update(rows(*ids).withColumn("job_id", mark("job_id")), number)
    assert store.events().count() == 10 and store.frequency().first().monthly_skill_count == 10 and seen.value == 12
