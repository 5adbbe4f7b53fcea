import random
from collections import Counter

import pytest
from conftest import plan_text

from requestsieve.operators.activity import (
    live_windows,
    lookup_counts,
    rank_rows,
    request_rate,
    spread_for_ranking,
    window_counts,
)
from requestsieve.operators.reputation import (
    active_reputation,
    cache_sessions,
    entries_after,
    reputation_sessions,
    upsert_reputation,
)
from requestsieve.plans.cascade import track
from requestsieve.schemas import REPUTATION
from requestsieve.session import durable
from requestsieve.settings import Settings
from requestsieve.sources.clients import ENTRY

HOUR = 3_600_000
# Small enough that the hot paths run on tests' data.
HOT = Settings(hot_rows=20)
HOT_UNHINTED = Settings(hot_rows=20, broadcast_keys=0)


def expected_tracking(rows):
    """Sequential reference over (request_id, ts_ms, ip)."""
    counts, last, start, hits, out = Counter(), {}, {}, {}, {}
    for i, ts, ip in sorted(rows, key=lambda r: (r[1], r[0])):
        counts[ip, ts // 60_000] += 1
        miss = ip not in last or ts - last[ip] >= HOUR
        if miss:
            start[ip], hits[ip] = ts, 0
        hits[ip] += 1
        last[ip] = ts
        out[i] = (counts[ip, ts // 60_000], start[ip], hits[ip], miss)
    return out


def tracked(df, settings=None):
    rows = cache_sessions(df, settings or Settings()).collect()
    return {r.request_id: (r.rate, r.session_start, r.hits, r.is_miss) for r in rows}


def skewed_rows(seed):
    """A third of the rows in one minute of one client, a third of those in one instant."""
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        kind = i % 9
        if kind < 1:
            rows.append((i, 5 * HOUR + 777, "hot"))
        elif kind < 3:
            rows.append((i, 5 * HOUR + rng.randrange(60_000), "hot"))
        elif kind < 5:
            rows.append((i, rng.randrange(12 * HOUR), "hot"))
        else:
            rows.append((i, rng.randrange(12 * HOUR), f"c{rng.randrange(40)}"))
    return rows


@pytest.mark.parametrize("settings", [None, HOT, HOT_UNHINTED], ids=["plain", "hot", "unhinted"])
@pytest.mark.parametrize("seed", [1, 2])
def test_tracking_equals_sequential(signals, settings, seed):
    rows = skewed_rows(seed)
    assert tracked(signals(rows), settings) == expected_tracking(rows)


def test_hot_minutes_rank_like_ordinary_ones(signals):
    df = signals(skewed_rows(3))
    columns = ["request_id", "minute", "rate"]
    plain = request_rate(df).select(*columns)
    hot = request_rate(df, HOT).select(*columns)
    assert sorted(plain.collect()) == sorted(hot.collect())
    assert "block_id" in plan_text(hot) and "block_id" not in plan_text(plain)


def test_wide_id_ranges_split_too(signals):
    ids = [k * 10**12 for k in range(-50, 50)]
    rows = [(i, 60_000, "a") for i in ids]
    found = {r.request_id: r.rate for r in request_rate(signals(rows), HOT).collect()}
    assert found == {i: n + 1 for n, i in enumerate(sorted(ids))}


def test_equal_times_count_in_id_order(signals):
    rows = request_rate(signals([(9, 100, "a"), (3, 100, "a"), (5, 50, "a")])).collect()
    assert {r.request_id: r.rate for r in rows} == {5: 1, 3: 2, 9: 3}


def test_minutes_are_fixed(signals):
    rows = request_rate(signals([(1, 59_999, "a"), (2, 60_000, "a"), (3, 60_001, "b")])).collect()
    assert [r.rate for r in rows] == [1, 1, 1]


@pytest.mark.parametrize("gap, is_miss", [(HOUR - 1, False), (HOUR, True)])
def test_expiry_boundary(signals, gap, is_miss):
    found = tracked(signals([(1, 1000, "a"), (2, 1000 + gap, "a")]))
    assert found[2][3] is is_miss
    assert found[2][2] == (1 if is_miss else 2)


def test_expiry_slides(signals):
    step = HOUR - 1
    found = tracked(signals([(k, k * step, "a") for k in range(5)]))
    assert [found[k][3] for k in range(5)] == [True, False, False, False, False]
    assert [found[k][2] for k in range(5)] == [1, 2, 3, 4, 5]
    sessions = reputation_sessions(signals([(k, k * step, "a") for k in range(5)])).collect()
    assert [(s.session_start, s.last_seen, s.hits) for s in sessions] == [(0, 4 * step, 5)]


def test_result_does_not_depend_on_partitioning(signals):
    df = signals(skewed_rows(4))
    assert tracked(df.repartition(7), HOT) == tracked(df.coalesce(1), HOT)


def test_no_rows(signals):
    assert tracked(signals([])) == {}


def test_counts_lookup_and_expiry(signals):
    df = signals([(1, 10, "a"), (2, 20, "a"), (3, 70_000, "a"), (4, 30, "b")])
    counts = window_counts(df)
    assert sorted(counts.collect()) == [("a", 0, 2), ("a", 1, 1), ("b", 0, 1)]
    wanted = counts.selectExpr("ip", "minute + 1 AS minute")
    assert sorted(lookup_counts(counts, wanted).select("ip", "minute", "n").collect()) == [
        ("a", 1, 1),
        ("a", 2, 0),
        ("b", 1, 0),
    ]
    # The window of the first minute lives until 120010, that instant included.
    assert ("a", 0, 2, 120_010) in live_windows(df, 120_010).collect()
    assert ("a", 0, 2, 120_010) not in live_windows(df, 120_011).collect()


def test_active_entries(spark, signals):
    df = signals([(1, 0, "a"), (2, 500, "a"), (3, 0, "b"), (4, 9 * HOUR, "a")])
    verdicts = spark.createDataFrame(
        [("a", 0, 0.9, "BOT"), ("a", 9 * HOUR, 0.1, "LEGITIMATE"), ("b", 0, 0.5, "SUSPICIOUS")],
        "ip string, session_start long, score double, class string",
    )
    at = lambda ms: sorted(active_reputation(df, verdicts, ms).collect())
    assert at(500) == [("a", 0.9, "BOT", 2, 500), ("b", 0.5, "SUSPICIOUS", 1, 0)]
    assert at(HOUR) == [("a", 0.9, "BOT", 2, 500)]
    assert at(HOUR + 499) == [("a", 0.9, "BOT", 2, 500)]
    assert at(HOUR + 500) == []


def test_upsert_keeps_the_latest_whole_value(spark):
    def entries(rows):
        return spark.createDataFrame(rows, REPUTATION)

    current = entries([("a", 0.9, "BOT", 5, 100), ("b", 0.1, "LEGITIMATE", 1, 100)])
    touches = entries([("a", 0.2, "LEGITIMATE", 1, 200), ("c", 0.5, "SUSPICIOUS", 1, 150)])
    assert sorted(upsert_reputation(current, touches).collect()) == [
        ("a", 0.2, "LEGITIMATE", 1, 200),
        ("b", 0.1, "LEGITIMATE", 1, 100),
        ("c", 0.5, "SUSPICIOUS", 1, 150),
    ]


def test_hot_instant_with_ids_over_the_whole_range(spark):
    """Ids far apart neither overflow nor share one block."""
    ids = [-(2**63), *range(2**62, 2**62 + 200), 2**63 - 1]
    rows = spark.createDataFrame([(i, 1000, "a") for i in ids], "request_id long, ts_ms long, ip string")
    ranked = request_rate(rows, HOT).orderBy("request_id").collect()
    assert [r.rate for r in ranked] == list(range(1, len(ids) + 1))


@pytest.mark.parametrize(
    "ids",
    [range(1000), [k**3 for k in range(1000)], [0] * 999 + [2**62], [k // 250 for k in range(1000)]],
    ids=["even", "steep", "one id", "few ids"],
)
def test_no_block_is_above_the_limit(spark, ids):
    """Also where most requests share an instant and an id; they differ in something else."""
    settings = Settings(hot_rows=100)
    rows = [(int(i), 1000 + (k % 2), "a", f"agent {k}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "request_id long, ts_ms long, ip string, user_agent string")
    counts = durable(window_counts(df))
    ranking = spread_for_ranking(df, counts, settings)
    sizes = [r["count"] for r in ranking.requests.groupBy(*ranking.keys).count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 100
    ranked = rank_rows(ranking).select("rate", "ts_ms", "request_id").collect()
    assert sorted(r.rate for r in ranked) == list(range(1, 1001))
    in_order = [(r.ts_ms, r.request_id) for r in sorted(ranked)]
    assert in_order == sorted(in_order)


def remembered(spark, rows):
    return spark.createDataFrame(rows, ENTRY)


def test_sessions_and_rates_go_on_from_what_is_remembered(spark, signals):
    known = [
        ("a", 0.9, "BOT", 7, 100_000, 50_000, [(1, 3, 200_000)]),
        ("b", 0.1, "LEGITIMATE", 2, 100_000, 90_000, [(1, 5, 101_000)]),
    ]
    rows = [(1, 110_000, "a"), (2, 119_999, "a"), (3, 120_000, "a"), (4, 110_000, "b")]
    rows += [(5, 110_000 + HOUR, "b"), (6, 5, "c")]
    found = track(signals(rows), Settings(), lambda ips: remembered(spark, known))
    got = {r.request_id: (r.rate, r.session_start, r.hits, r.is_miss) for r in found.rows.collect()}
    assert got == {
        1: (4, 50_000, 8, False),
        2: (5, 50_000, 9, False),
        3: (1, 50_000, 10, False),
        # The window of b is over, though the session is not; then that is, too.
        4: (1, 90_000, 3, False),
        5: (1, 110_000 + HOUR, 1, True),
        6: (1, 5, 1, True),
    }
    verdicts = spark.createDataFrame(
        [("a", 50_000, 0.9, "BOT"), ("b", 110_000 + HOUR, 0.2, "BOT"), ("c", 5, 0.3, "SUSPICIOUS")],
        "ip string, session_start long, score double, class string",
    )
    left = entries_after(found.slots, found.entries, verdicts).collect()
    assert {r.ip: tuple(r)[1:6] for r in left} == {
        "a": (0.9, "BOT", 10, 120_000, 50_000),
        "b": (0.2, "BOT", 1, 110_000 + HOUR, 110_000 + HOUR),
        "c": (0.3, "SUSPICIOUS", 1, 5, 5),
    }
    windows = {r.ip: [tuple(w) for w in r.windows] for r in left}
    assert windows["a"] == [(1, 5, 200_000), (2, 1, 240_000)]
    assert windows["b"] == [((110_000 + HOUR) // 60_000, 1, 110_000 + HOUR + 120_000)]


def test_late_requests_neither_miss_nor_turn_time_back(spark, signals):
    known = [("a", 0.9, "BOT", 1, 10 * HOUR, 10 * HOUR, [])]
    rows = [(1, HOUR, "a"), (2, 2 * HOUR, "a")]
    found = track(signals(rows), Settings(), lambda ips: remembered(spark, known))
    assert [(r.is_miss, r.hits) for r in found.rows.orderBy("request_id").collect()] == [(False, 2), (False, 3)]
    none = spark.createDataFrame([], "ip string, session_start long, score double, class string")
    (left,) = entries_after(found.slots, found.entries, none).collect()
    assert (left.last_seen, left.session_start, left.hits) == (10 * HOUR, 10 * HOUR, 3)
