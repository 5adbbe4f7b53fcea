"""Batch tables, client entries and fingerprints over many batches, retries and compaction."""

import pytest
from conftest import plan_text
from pyspark.sql import functions as F
from pyspark.sql import types as T

from requestsieve.plans import analytics
from requestsieve.schemas import FINGERPRINT
from requestsieve.session import shared_folder
from requestsieve.settings import Settings
from requestsieve.sources.batches import BatchTable, Part
from requestsieve.sources.clients import ENTRY, ClientStore
from requestsieve.sources.log import append_log, read_log, read_rejected
from requestsieve.sources.stores import FingerprintStore

HOUR = 3_600_000
SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("c", T.StringType())])


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


@pytest.fixture
def table(spark):
    return BatchTable(spark, shared_folder(spark, "test-table"), SCHEMA, ("c",))


def test_a_retry_replaces_the_whole_batch(spark, table):
    assert table.read().collect() == [] and table.next_batch() == 0
    table.write(rows(spark, (1, "x"), (2, "y")), 0)
    table.write(rows(spark, (3, "x")), 1)
    # Other partitions than the first attempt had.
    table.write(rows(spark, (1, "z")), 0)
    assert sorted(map(tuple, table.read().collect())) == [(1, "z"), (3, "x")]
    table.write(rows(spark), 1)
    assert [tuple(r) for r in table.read().collect()] == [(1, "z")]
    assert table.next_batch() == 2 and table.has(1) and not table.has(2)
    assert table.read(since=1).count() == 0


def test_an_unfinished_write_does_not_count(spark, table):
    table.write(rows(spark, (1, "x")), 0)
    table.write(rows(spark, (2, "x")), 0)
    table._files.remove("batch=0-0-2/_SUCCESS")
    assert [r.k for r in table.read().collect()] == [1]


def test_compaction_bounds_the_folders_and_loses_nothing(spark, table):
    for n in range(27):
        table.compact(n, fan_in=3)
        table.write(rows(spark, (n, "xy"[n % 2])), n)
        assert sorted(r.k for r in table.read().collect()) == list(range(n + 1))
    table.compact(27, fan_in=3)
    assert len(table.parts()) <= 6 and len(table._all_parts()) <= 12
    assert "PartitionFilters: [isnotnull(c" in plan_text(table.read().filter("c = 'x'"))


def test_a_reader_may_finish_after_a_compaction(spark, table):
    for n in range(4):
        table.write(rows(spark, (n, "x")), n)
    reading = table.read()
    table.compact(4, fan_in=4)
    assert table.parts() == [Part(0, 3, 1)]
    assert sorted(r.k for r in reading.collect()) == [0, 1, 2, 3]
    table.compact(4, fan_in=4)
    assert len(table._all_parts()) == 1 and table.read().count() == 4


def entry(ip, last_seen, hits=1, windows=()):
    return (ip, 0.5, "SUSPICIOUS", hits, last_seen, 0, list(windows))


def entries(spark, *found):
    return spark.createDataFrame(list(found), ENTRY)


def test_entries_as_of_a_batch(spark):
    store = ClientStore(spark, shared_folder(spark, "test-clients"))
    store.put(entries(spark, entry("a", 10), entry("b", 10)), 0)
    store.put(entries(spark, entry("a", 20, 2, [(0, 3, 120_000)])), 1)
    store.take_snapshot(1)
    store.put(entries(spark, entry("a", 30, 3), entry("c", 30)), 2)
    asked = spark.createDataFrame([("a",), ("b",), ("zz",)], "ip string")
    at = lambda n: {r.ip: r.hits for r in store.lookup(asked, n).collect()}
    assert at(0) == {} and at(1) == {"a": 1, "b": 1}
    assert at(2) == {"a": 2, "b": 1} and at(3) == {"a": 3, "b": 1}
    (kept,) = store.lookup(asked, 2).filter("ip = 'a'").collect()
    assert [tuple(w) for w in kept.windows] == [(0, 3, 120_000)]
    assert sorted(r.ip for r in store.entries().collect()) == ["a", "b", "c"]
    # A batch that runs again replaces its entries.
    store.put(entries(spark, entry("a", 31, 9)), 2)
    assert at(3) == {"a": 9, "b": 1}
    assert sorted(r.ip for r in store.entries().collect()) == ["a", "b"]


def test_snapshots_forget_the_silent_and_are_not_shuffled(spark):
    store = ClientStore(spark, shared_folder(spark, "test-clients"), Settings(most_late_ms=0))
    store.put(entries(spark, entry("old", 0), entry("edge", HOUR + 1), entry("new", 2 * HOUR)), 0)
    store.take_snapshot(0)
    store.take_snapshot(0)
    assert sorted(r.ip for r in store.entries().collect()) == ["edge", "new"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        asked = spark.createDataFrame([("new",), ("other",)], "ip string").distinct()
        found = store.lookup(asked, 1)
        assert [r.ip for r in found.collect()] == ["new"]
        plan = plan_text(found).split("== Initial Plan ==")[0].split("== Physical Plan ==")[1]
        scan = next(line for line in plan.splitlines() if "Scan parquet spark_catalog" in line)
        above = plan.splitlines()[: plan.splitlines().index(scan)]
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        level, shuffles = depth(scan), 0
        for line in reversed(above):
            if depth(line) < level:
                level = depth(line)
                if "Join" in line:
                    break
                shuffles += "Exchange" in line
        assert shuffles == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def fingerprint(spark, *found):
    return spark.createDataFrame(
        [(i, [float(v)], "1.1.1.1", c, 0.5, 0, "US") for i, v, c in found], FINGERPRINT
    )


def test_one_fingerprint_per_id_after_retries_and_upserts(spark):
    store = FingerprintStore(spark, shared_folder(spark, "test-prints"))
    assert store.is_empty() and store.read().count() == 0
    store.put(fingerprint(spark, ("a", 1, "BOT"), ("b", 1, "BOT")), 0)
    store.put(fingerprint(spark, ("a", 2, "LEGITIMATE"), ("c", 2, "BOT")), 1)
    # The batch runs again, with another class and without one of its ids.
    store.put(fingerprint(spark, ("a", 3, "SUSPICIOUS")), 1)
    found = lambda: sorted((r.id, r["values"][0], r["class"]) for r in store.read().collect())
    assert found() == [("a", 3.0, "SUSPICIOUS"), ("b", 1.0, "BOT")]
    # A search of one class does not see the version that was replaced.
    assert [r.id for r in store.read().filter(F.col("class") == "BOT").collect()] == ["b"]
    assert sorted(r["values"][0] for r in store.read(before=1).collect()) == [1.0, 1.0]
    for n in range(2, 14):
        store.put(fingerprint(spark, ("b", n, "BOT"), (f"x{n}", n, "BOT")), n)
        store.compact(n)
    assert len(found()) == 14 and ("b", 13.0, "BOT") in found()
    stored = store._table._of(store._table.parts()).filter("id = 'b'").count()
    assert stored < 13


def test_every_writer_divides_good_rows_from_rejected_ones(spark):
    from test_log_and_analytics import NOW, log_df

    path = shared_folder(spark, "test-log")
    good = log_df(spark, [(NOW - k, "BOT", {"request_id": k}) for k in range(5)])
    bad = good.withColumn("request_id", F.col("request_id") + 100).withColumns(
        {
            "class": F.when(F.col("request_id") == 100, "bot").otherwise(F.col("class")),
            "ts_ms": F.when(F.col("request_id") != 101, F.col("ts_ms")),
            "ip": F.when(F.col("request_id") != 102, F.col("ip")),
        }
    )
    append_log(good.unionByName(bad), path)
    append_log(log_df(spark, [(NOW, "nonsense", {"request_id": 200})]), path)
    assert sorted(r.request_id for r in read_log(spark, path).collect()) == [0, 1, 2, 3, 4, 103, 104]
    rejected = {r.request_id: r.errors for r in read_rejected(spark, path).collect()}
    assert rejected == {100: ["class"], 101: ["timestamp"], 102: ["ip"], 200: ["class"]}


def test_recent_reads_the_newest_days_only(spark):
    from test_log_and_analytics import NOW, log_df

    path = shared_folder(spark, "test-recent")
    day = 24 * HOUR
    for d in range(6):
        found = [(NOW - d * day - k, "BOT", {"request_id": 100 * d + k}) for k in range(20)]
        append_log(log_df(spark, found), path)
    log = read_log(spark, path)
    recent = analytics.recent(log)
    wanted = read_log(spark, path, keep_day=False).orderBy(F.desc("ts_ms"), F.desc("request_id")).limit(50)
    assert recent.collect() == wanted.collect()
    plan = plan_text(recent)
    first_day = (NOW - 2 * day) // day
    assert "PartitionFilters: [isnotnull(kind" in plan and "dt" in plan.split("PartitionFilters: [")[1].split("]")[0]
    days = {r.dt for r in analytics.newest_days(log, 50).select("dt").distinct().collect()}
    assert len(days) <= 4 and min(days).toordinal() >= first_day + 719_163 - 1
    assert analytics.recent(log.limit(0)).count() == 0
