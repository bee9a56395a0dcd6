"""Readers, writers and the stream."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skilltide import schemas
from skilltide.operators.frequency import monthly_frequency
from skilltide.sources import readers, writers
from skilltide.sources.tables import ConcurrentWriteError, VersionedTable
from skilltide.streaming.incremental import EventStore, run_stream, windowed_counts


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "2026-01", "A", 'a "b"\nc', "y; x")], "job_id string, month string, standard_job string, job_title string, skills string")
    writers.write_csv(df, str(tmp_path / "e.csv"))
    row = readers.read_events(spark, str(tmp_path / "e.csv")).first()
    assert row.skills == ["x", "y"] and row.job_title == 'a "b" c' and row.job_requirement == ""
    assert readers.read_events(spark, str(tmp_path / "none.csv")).count() == 0
    with pytest.raises(ValueError, match="standard_category"):
        readers.read_taxonomy(spark, str(tmp_path / "e.csv"))


def test_dictionary_json_and_aliases(spark, tmp_path):
    spark.createDataFrame([("岗位A", "m")], "`岗位名称` string, month string").write.json(str(tmp_path / "u"))
    up = readers.aliased(spark.read.json(str(tmp_path / "u"))).first()
    assert (up.job_title, up.month, up.job_id) == ("岗位A", "m", "")
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{broken\n')
    with pytest.raises(Exception):
        readers.read_json_lines(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    with pytest.raises(ValueError, match="0 files"):
        readers.single_file(spark, str(tmp_path), ".csv")


def test_versioned_table(spark, tmp_path):
    queue = writers.review_queue(spark, str(tmp_path / "q"))
    entry = lambda i, status, at: (i, "j", status, "r", "{}", at, at)
    make = lambda *rows: spark.createDataFrame(list(rows), schemas.REVIEW_QUEUE)
    queue.upsert(make(entry("1", "open", "1"), entry("2", "open", "1")), "updated_at")
    queue.upsert(make(entry("2", "done", "2"), entry("2", "later", "3")), "updated_at")
    queue.insert(make(entry("2", "ignored", "9"), entry("3", "open", "2")))
    assert {r.review_id: r.status for r in queue.read().collect()} == {"1": "open", "2": "later", "3": "open"}
    queue.replace(make(entry("9", "new", "1")), ["job_id"])
    assert [r.review_id for r in writers.find_reviews(queue.read(), status="new").collect()] == ["9"]
    queue.prune(1)
    assert queue.next_value("review_id") == 10


def _events(spark, rows):
    df = spark.createDataFrame(rows, "job_id string, month string, standard_job string, skills array<string>")
    return schemas.conform(df, schemas.EVENTS)


def test_stream_equals_batch_with_late_and_repeated_events(spark, tmp_path):
    rows = [("1", "2026-03", "A", ["x"]), ("2", "2026-01", "A", ["x", "y"]), ("1", "2026-03", "A", ["x"]), ("3", "2026-02", "B", ["y"])]
    for row in rows:
        _events(spark, [row]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = EventStore(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_stream(stream, store, str(tmp_path / "check"))
    whole = monthly_frequency(_events(spark, [rows[0], rows[1], rows[3]]))
    assert sorted(map(tuple, store.frequency().collect())) == sorted(map(tuple, whole.collect()))
    store.update(_events(spark, [("4", "2026-05", "B", ["y"])]), 99)
    again = sorted(map(tuple, store.frequency().collect()))
    store.update(_events(spark, [("4", "2026-05", "B", ["y"])]), 99)  # the same batch after a failure
    assert again == sorted(map(tuple, store.frequency().collect()))


def test_gate_and_dry_run(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"))
    batch = _events(spark, [("1", "2026-01", "A", ["x"]), ("2", "2026-01", "A", ["x"])]).withColumn("route_status", F.when(F.col("job_id") == "1", "existing_job").otherwise("new_family"))
    assert store.accept(batch, 0, write=False).count() == 1 and store.events().count() == 0
    store.update(batch, 0)
    assert store.events().count() == 1 and store.queue().count() == 1


def test_windowed_counts(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", "a"), (2, "2024-01-01 00:50:00", "a"), (2, "2024-01-01 00:50:00", "a"), (3, "2024-01-01 01:00:00", "a")]
    df = spark.createDataFrame(rows, "event_id int, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("counts").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.n for r in spark.table("counts").collect()) == [1, 2]


def test_versions_runs_and_manifests(spark, tmp_path):
    root = str(tmp_path / "versions")
    for name in ("base", "large"):
        spark.range(3).write.parquet(f"{root}/{name}/events")
    path = writers.write_manifest(spark, f"{root}/large", {"rows": 3, "名": "值"})
    assert '"名": "值"' in (tmp_path / "versions" / "large" / "run_manifest.json").read_text() and path.endswith("run_manifest.json")
    assert readers.list_versions(spark, root) == ["base", "large"] and readers.list_runs(spark, root, "run_manifest.json") == ["large"]
    assert readers.version_paths(spark, root, ("events",), "large") == {"events": f"{root}/large/events"} and readers.version_paths(spark, root, ("events",))["events"].endswith("base/events")
    spark.conf.set(readers.VERSION_SETTING, "none")
    with pytest.raises(FileNotFoundError, match="none"):
        readers.version_paths(spark, root, ("events",))
    spark.conf.unset(readers.VERSION_SETTING)
    with pytest.raises(ValueError, match="no name"):
        readers.version_paths(spark, root, (), "../x")
    assert readers.run_inputs(spark, f"{root}/large", ("events",), ("answers",)) == {"events": f"{root}/large/events", "answers": None}
    with pytest.raises(FileNotFoundError, match="answers"):
        readers.run_inputs(spark, f"{root}/large", ("answers",))


def test_tables_kept_for_unchanged_files(spark, tmp_path):
    path, built = str(tmp_path / "t"), []

    def build():
        built.append(1)
        return spark.read.parquet(path)

    spark.range(3).write.parquet(path)
    assert readers.cached(spark, [path], build).count() == 3 and readers.cached(spark, [path], build).count() == 3 and len(built) == 1
    spark.range(5).write.mode("append").parquet(path)
    assert readers.cached(spark, [path], build).count() == 8 and len(built) == 2
    # other tables of the same files
    assert readers.cached(spark, [path], lambda: spark.range(7)).count() == 7 and readers.cached(spark, [path], lambda: spark.range(9), "nine").count() == 9
    assert readers.cached(spark, [path], lambda: spark.range(11), "eleven").count() == 11 and readers.cached(spark, [path], build).count() == 8 and len(built) == 2
    readers._cached[("ended", "x", ())] = ((), None)
    assert readers.cached(spark, [path], None, "nine").count() == 9 and all(k[0] != "ended" for k in readers._cached)
    schema = spark.range(1).schema
    assert readers.derived(spark, path, schema, None).count() == 8 and readers.derived(spark, path + "x", schema, lambda: spark.range(2)).count() == 2


def test_tables_in_and_out(spark, tmp_path):
    pool = spark.createDataFrame([("b", "f"), ("a", "f")], "normalized_skill string, kg_display_skill string")
    writers.write_csv(pool, str(tmp_path / "pool.csv"))
    writers.import_tables(spark, {"skill_pool": str(tmp_path / "pool.csv")}, {"skill_pool": pool.schema, "events": schemas.EVENTS_TEXT}, str(tmp_path / "db"))
    assert spark.read.parquet(str(tmp_path / "db" / "events")).count() == 0
    writers.export_tables(spark, str(tmp_path / "db"), ["skill_pool", "events"], str(tmp_path / "out"))
    assert [r.normalized_skill for r in readers.read_csv(spark, str(tmp_path / "out" / "skill_pool")).collect()] == ["a", "b"]
    assert readers.preview(pool, 1).count() == 1 and '"n": 2' in writers.report(pool.selectExpr("count(*) AS n"))
    dic = spark.createDataFrame([("k", "n", "f"), ("j", "n", "f")], schemas.SKILL_DICTIONARY)
    writers.write_csv(dic.coalesce(1), str(tmp_path / "dic"))
    assert [r.skill_keyword for r in readers.read_skill_dictionary(spark, str(tmp_path / "dic")).orderBy("row_order").collect()] == ["k", "j"]
    pool.write.saveAsTable("kept_pool")
    assert readers.read_table(spark, "kept_pool", pool.schema).count() == 2 and readers.read_table(spark, "no_pool", pool.schema).count() == 0
    spark.sql("DROP TABLE kept_pool")


def _table(spark, path, buckets=4):
    return VersionedTable(spark, str(path), T.StructType().add("k", "long").add("g", "string").add("v", "long"), ["k"], buckets)


def test_an_upsert_writes_only_the_parts_it_touches(spark, tmp_path):
    table = _table(spark, tmp_path / "t")
    table.overwrite(spark.range(100).selectExpr("id AS k", "'a' AS g", "0L AS v"))
    before = table.current()[1]
    table.upsert(spark.createDataFrame([(7, "b", 1), (7, "c", 2)], "k long, g string, v long"), "v")
    after = table.current()[1]
    assert len(before) == 4 and sum(before[k] != after[k] for k in before) == 1
    assert table.read().count() == 100 and [tuple(r) for r in table.read().where("v > 0").collect()] == [(7, "c", 2)]
    table.upsert(spark.createDataFrame([], "k long, g string, v long"), "v")
    table.insert(spark.createDataFrame([(7, "x", 9), (200, "x", 9), (200, "x", 9)], "k long, g string, v long"))
    assert table.read().where("v = 9").count() == 1 and table.current()[0] == 3
    old = table.read()
    table.overwrite(table.read().where("k < 10"))
    assert old.count() == 101 and table.read().count() == 10  # readers keep their version
    table.prune(1)
    assert table.read().count() == 10 and table._numbers() == [4]


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    one, two = _table(spark, tmp_path / "t"), _table(spark, tmp_path / "t")
    row = lambda k, v: spark.createDataFrame([(k, "a", v)], "k long, g string, v long")
    one.overwrite(row(1, 1))
    write, met = one.write_parts, []

    def late(df):
        parts = write(df)
        if not met:
            met.append(two.upsert(row(2, 2), "v"))  # another writer is done while this one has yet to commit
        return parts

    monkeypatch.setattr(one, "write_parts", late)
    one.upsert(row(3, 3), "v")
    assert sorted(r.k for r in two.read().collect()) == [1, 2, 3] and one.current()[0] == 3
    monkeypatch.setattr(one, "_commit", lambda *_: False)
    with pytest.raises(ConcurrentWriteError):
        one.upsert(row(4, 4), "v")


def test_parts_by_value_are_replaced_alone(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), T.StructType().add("k", "string").add("day", "string"), ["k"], 2, ["k"], ["day"])
    table.overwrite(spark.createDataFrame([("a", "d/1"), ("b", "d/1"), ("a", None), ("007", "2=%")], "k string, day string"))
    before = table.current()[1]
    table.replace(spark.createDataFrame([("a", "d/1")], "k string, day string"), ["k", "day"])
    assert sorted(map(str, table.read().collect())) == sorted(map(str, spark.createDataFrame([("a", "d/1"), ("b", "d/1"), ("a", None), ("007", "2=%")], "k string, day string").collect()))
    assert sum(before[k] != v for k, v in table.current()[1].items()) == 1


def test_increments_equal_a_batch_over_everything(spark, tmp_path):
    import random

    random.seed(3)
    store, seen = EventStore(spark, str(tmp_path / "s"), 3), {}
    for number in range(4):
        rows = [(str(random.randint(0, 60)), f"2026-{random.randint(1 if number else 5, 9):02d}", random.choice(["007", "7", "a/b", "机"]), random.sample(["x", "y", "z"], random.randint(0, 2))) for _ in range(25)]
        once = {r[0]: r for r in reversed(rows)}  # a batch's own repeats are the same event here
        batch = [once[r[0]] for r in rows]
        before = {k: v for k, v in store.table.current()[1].items()}
        store.update(_events(spark, batch), number)
        new = {k: r for k, r in once.items() if k not in seen}
        seen.update(new)
        want = sorted(map(tuple, monthly_frequency(_events(spark, list(seen.values()))).collect()))
        assert sorted(map(tuple, store.frequency().collect())) == want
        # earlier months of a bucket keep their files
        starts = {}
        for _, month, job, _s in new.values():
            b = spark.createDataFrame([(job,)], "j string").select(F.pmod(F.xxhash64("j"), F.lit(3))).first()[0]
            starts[str(b)] = min(month, starts.get(str(b), "9999"))
        after = store.table.current()[1]
        assert all(after[k] == v for k, v in before.items() if k[1] < starts.get(k[0], "9999"))
    store.update(_events(spark, batch), 3)  # once more, after a failure
    assert sorted(map(tuple, store.frequency().collect())) == want
    store.update(_events(spark, []), 4)
    assert sorted(map(tuple, store.frequency().collect())) == want and store.events().count() == len(seen)


def test_a_batch_reads_only_folders_that_may_hold_its_ids(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"), 8)
    rows = lambda a, b: _events(spark, [(f"id{i}", "2026-01", "A", ["x"]) for i in range(a, b)])
    store.accept(rows(0, 400), 0)
    store.accept(rows(400, 800), 1)
    assert len(store.folders_to_read(rows(800, 805).select("job_id"), 2)) <= 2  # by mistake, at most
    known = store.folders_to_read(rows(10, 11).select("job_id"), 2)
    assert 1 <= len(known) <= 2 and known[0][0] == 0
    assert store.accept(rows(795, 803), 2, write=False).count() == 3
    assert len(store.folders_to_read(rows(0, 800).select("job_id"), 2)) == 16 and store.folders_to_read(rows(0, 5).select("job_id"), 0) == []
