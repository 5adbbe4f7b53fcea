import pytest
from conftest import plan_text

from requestsieve.plans import analytics as an
from requestsieve.schemas import LOG
from requestsieve.session import shared_folder
from requestsieve.sources.log import append_log, append_log_batch, read_log, split_valid

HOUR = 3_600_000
NOW = 100 * 24 * HOUR


def log_df(spark, rows):
    """Rows of (ts_ms, class) with optional overrides."""
    data = []
    for i, (ts, cls, *own) in enumerate(rows):
        values = {
            "request_id": i,
            "ip": "1.1.1.1",
            "country": "US",
            "path": "/",
            "user_agent": "ua",
            "score": 0.5,
            "class": cls,
            "source": "AI",
            "ts_ms": ts,
        } | (own[0] if own else {})
        data.append(tuple(values[c] for c in LOG.fieldNames()))
    return spark.createDataFrame(data, LOG)


@pytest.mark.parametrize(
    "text, hours",
    [
        ("1h", 1),
        ("72h", 72),
        ("0h", 24),
        ("7d", 7),
        ("abc", 24),
        ("-5h", -5),
        ("+3h", 3),
        ("h6", 6),
        ("6hh", 6),
        (" 12h", 12),
        ("1.5h", 1),
        ("", 24),
        (None, 24),
        ("24", 24),
    ],
)
def test_ranges(text, hours):
    assert an.parse_range(text) == hours


def test_range_is_strict_and_open_ended(spark):
    log = log_df(spark, [(NOW - HOUR, "BOT"), (NOW - HOUR + 1, "BOT"), (NOW + HOUR, "BOT")])
    assert an.total(log, 1, NOW).head()[0] == 2
    assert an.total(log, -5, NOW).head()[0] == 0


def test_empty_log(spark):
    bundle = an.analytics_bundle(log_df(spark, []), 24, NOW)
    found = {name: [tuple(r) for r in df.collect()] for name, df in bundle.items()}
    assert found["total"] == [(0,)]
    assert sorted(found["breakdown"]) == [("BOT", 0), ("LEGITIMATE", 0), ("SUSPICIOUS", 0)]
    assert sorted(found["source_breakdown"]) == [
        ("AI", 0),
        ("CACHE", 0),
        ("HEURISTIC", 0),
        ("VECTOR", 0),
    ]
    for name in ("top_bot_ips", "by_country", "timeline", "recent"):
        assert found[name] == []
    assert an.top_bot_share(bundle["top_bot_ips"]).collect() == []


def test_unknown_classes_are_kept(spark):
    log = log_df(spark, [(NOW, "WEIRD"), (NOW, "BOT")])
    found = dict(map(tuple, an.class_breakdown(log, 1, NOW).collect()))
    assert found == {"BOT": 1, "LEGITIMATE": 0, "SUSPICIOUS": 0, "WEIRD": 1}
    assert [r["style"] for r in an.recent_display(an.recent(log)).collect()] == [
        "BOT",
        "SUSPICIOUS",
    ]


def test_countries(spark):
    log = log_df(
        spark,
        [
            (NOW, "BOT", {"country": "DE"}),
            (NOW, "BOT", {"country": None}),
            (NOW, "LEGITIMATE", {"country": None}),
            (NOW, "SUSPICIOUS", {"country": "FR"}),
            (NOW, "LEGITIMATE", {"country": "AT"}),
        ],
    )
    expected = [("DE", 1, 0), (None, 1, 1), ("AT", 0, 1), ("FR", 0, 0)]
    assert [tuple(r) for r in an.by_country(log, 1, NOW).collect()] == expected
    bundled = an.analytics_bundle(log, 1, NOW)["by_country"]
    assert [tuple(r) for r in bundled.collect()] == expected


def test_long_ranges_fold_days(spark):
    day = 24 * HOUR
    rows = [(NOW - day + 5 * HOUR, "BOT"), (NOW - 2 * day + 5 * HOUR, "BOT")]
    rows += [(NOW - 2 * day + 6 * HOUR, "SUSPICIOUS"), (NOW - 3 * day, "BOT")]
    found = an.timeline(log_df(spark, rows), 72, NOW)
    assert [tuple(r) for r in found.collect()] == [(5, 2, 0), (6, 0, 0)]
    labels = an.timeline_labels(found).collect()
    assert [tuple(r) for r in labels] == [("5:00", 2, 0), ("6:00", 0, 0)]


def test_top_ips_break_ties_by_ip(spark):
    rows = [(NOW, "BOT", {"ip": f"10.0.0.{k:02d}"}) for k in range(15)]
    rows += [(NOW, "BOT", {"ip": "10.0.0.14"}), (NOW, "LEGITIMATE", {"ip": "10.0.0.13"})]
    found = an.top_bot_ips(log_df(spark, rows), 1, NOW)
    assert [r.ip for r in found.collect()] == ["10.0.0.14"] + [f"10.0.0.{k:02d}" for k in range(9)]
    assert [r.share for r in an.top_bot_share(found).collect()][:2] == [100.0, 50.0]


def test_recent_ignores_the_range(spark):
    log = log_df(spark, [(k, "BOT") for k in range(60)] + [(NOW, "BOT", {"source": "VECTOR"})])
    rows = an.recent(log).collect()
    assert len(rows) == 50 and rows[0].ts_ms == NOW and rows[-1].ts_ms == 11
    shown = an.recent_display(an.recent(log)).collect()
    assert shown[0].badge == "VECTOR" and shown[0]["style"] == "BOT"
    assert shown[0].score_percent == "50%"


def test_counts_agree(spark):
    kinds = ("BOT", "SUSPICIOUS", "LEGITIMATE")
    log = log_df(spark, [(NOW - k, kinds[k % 3]) for k in range(100)])
    bundle = an.analytics_bundle(log, 24, NOW)
    total = bundle["total"].head()[0]
    assert total == 100
    assert sum(r.n for r in bundle["breakdown"].collect()) == total
    assert sum(r.n for r in bundle["source_breakdown"].collect()) == total


def test_constraints(spark):
    broken = [
        ({"ip": None}, ["ip"]),
        ({"score": None}, ["score"]),
        ({"class": None}, ["class"]),
        ({"class": "bot"}, ["class"]),
        ({"source": None}, ["source"]),
        ({"source": "KV"}, ["source"]),
        ({"ts_ms": None}, ["timestamp"]),
        ({"ip": None, "source": "x"}, ["ip", "source"]),
    ]
    fine = [{"country": None}, {"path": None}, {"user_agent": None}]
    log = log_df(spark, [(1, "BOT", own) for own, _ in broken] + [(1, "BOT", own) for own in fine])
    valid, rejected = split_valid(log)
    assert valid.columns == LOG.fieldNames() and valid.count() == len(fine)
    errors = {r.request_id: r.errors for r in rejected.collect()}
    assert errors == {i: names for i, (_, names) in enumerate(broken)}


def test_log_round_trip_and_pruning(spark):
    path = shared_folder(spark, "test-log")
    day = 24 * HOUR
    log = log_df(spark, [(NOW - k * day, "BOT") for k in range(5)])
    append_log(log, path)
    append_log(log_df(spark, [(NOW + 1, "LEGITIMATE", {"request_id": 99})]), path)
    assert sorted(read_log(spark, path, keep_day=False).collect()) == sorted(
        log.collect() + log_df(spark, [(NOW + 1, "LEGITIMATE", {"request_id": 99})]).collect()
    )
    recent = read_log(spark, path, NOW - 1)
    assert sorted(r.request_id for r in recent.collect()) == [0, 99]
    plan = plan_text(recent)
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "dt#" in filters and "kind#" in filters and "GreaterThan(ts_ms" in plan


def test_batches_are_replaced(spark):
    path = shared_folder(spark, "test-log")
    append_log_batch(log_df(spark, [(NOW, "BOT")]), path, 0)
    append_log_batch(log_df(spark, [(NOW, "BOT", {"request_id": 7})]), path, 1)
    append_log_batch(log_df(spark, [(NOW, "BOT")]), path, 0)
    assert sorted(r.request_id for r in read_log(spark, path).collect()) == [0, 7]
