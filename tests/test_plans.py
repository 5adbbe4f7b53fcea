"""Plan shapes that matter at scale."""

import pytest
from conftest import DATA, plan_text
from test_log_and_analytics import NOW, log_df

from requestsieve.functions.signals import extract_signals
from requestsieve.operators.activity import request_rate, window_counts
from requestsieve.plans import analytics as an
from requestsieve.session import shared_folder
from requestsieve.sources import samples
from requestsieve.sources.log import append_log, read_log


@pytest.fixture(scope="module")
def log_path(spark):
    path = shared_folder(spark, "test-plans")
    kinds = ("BOT", "SUSPICIOUS", "LEGITIMATE")
    append_log(log_df(spark, [(NOW - k * 60_000, kinds[k % 3]) for k in range(300)]), path)
    return path


def executed(df):
    df.collect()
    return plan_text(df).split("== Initial Plan ==")[0].split("== Physical Plan ==")[1]


def test_lists_are_top_k_and_filters_reach_the_scan(spark, log_path):
    log = read_log(spark, log_path, an.since_ms(1, NOW))
    plan = executed(an.top_bot_ips(log, 1, NOW))
    assert "TakeOrderedAndProject" in plan
    assert "EqualTo(class,BOT)" in plan and "GreaterThan(ts_ms," in plan
    assert "dt" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "user_agent" not in plan.split("ReadSchema")[1]
    assert "TakeOrderedAndProject" in executed(an.recent(read_log(spark, log_path)))


def test_bundle_aggregates_the_log_once(spark, log_path):
    log = read_log(spark, log_path)
    plan = executed(an.bundle_rows(an.analytics_bundle(log, 72, NOW)))
    # One tally for five views; the other scans are the reused ones and that of the top list.
    assert plan.count("ReusedExchange") >= 4


def test_counts_are_partially_aggregated(spark):
    plan = executed(window_counts(samples.requests_in(spark, f"{DATA}/sf0.001")))
    assert plan.count("HashAggregate") == 2


def test_ranking_stays_on_the_jvm_with_one_shuffle(spark, signals):
    path = shared_folder(spark, "test-plans")
    signals([(k, k * 500, f"ip{k % 5}") for k in range(50)]).write.parquet(path)
    plan = executed(request_rate(spark.read.parquet(path)).select("request_id", "rate"))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "user_agent" not in plan


def test_signals_are_narrow_and_python_free(spark):
    plan = executed(extract_signals(samples.raw_requests(spark, f"{DATA}/sf0.001")))
    assert "Python" not in plan and "Pandas" not in plan
    assert "Exchange hashpartitioning" not in plan


def test_a_big_day_is_written_by_many_tasks(spark):
    path = shared_folder(spark, "test-plans")
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "50KB")
    try:
        kinds = spark.range(0, 20_000, 1, 8).selectExpr(
            "id AS request_id",
            "concat('ip', id % 97) AS ip",
            "'US' AS country",
            "concat('/', uuid()) AS path",
            "'ua' AS user_agent",
            "0.5D AS score",
            "'BOT' AS class",
            "'AI' AS source",
            f"CAST({NOW} + IF(id % 20 = 0, -86400000 * (id % 7), id % 1000) AS BIGINT) AS ts_ms",
        )
        append_log(kinds, path)
    finally:
        spark.conf.unset(size)
    files = spark.read.parquet(path).select("dt", "_metadata.file_path").distinct()
    per_day = {r.dt: r["count"] for r in files.groupBy("dt").count().collect()}
    assert len(per_day) > 1 and max(per_day.values()) > 1
    assert read_log(spark, path).count() == 20_000
