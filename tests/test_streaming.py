import random

from requestsieve.plans import analytics, cascade, outputs
from requestsieve.session import shared_folder
from requestsieve.settings import Settings
from requestsieve.sources.log import append_log_batch, read_log, read_rejected
from requestsieve.sources.stores import read_fingerprints, read_reputation
from requestsieve.sources.tallies import Tallies
from requestsieve.streaming import jobs

HOUR = 3_600_000
SURE = '{"class":"LEGITIMATE","score":0.1}'
BOT = '{"class":"BOT","score":0.95}'
LOGGED = ["request_id", "ip", "score", "class", "source"]


def random_rows(seed, count=400):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        ts = rng.randrange(20 * HOUR) if i % 2 else 7 * HOUR + rng.randrange(90_000)
        agent = "curl/8" if rng.random() < 0.3 else "Mozilla/5.0"
        rows.append(
            (i, ts, f"ip{rng.randrange(6)}", {"user_agent": agent, "has_accept_lang": False})
        )
    return sorted(rows, key=lambda r: r[1])


def feed(spark, rows, signals, start, parts=3):
    """Append slices of the rows, and run the stream after each."""
    path = shared_folder(spark, "test-stream")
    size = -(-len(rows) // parts)
    for k in range(0, len(rows), size):
        frame = signals(rows[k : k + size])
        frame.write.mode("append").parquet(path)
        jobs.drain(start(spark.readStream.schema(frame.schema).parquet(path)))


def answers_for(spark, rows):
    return spark.createDataFrame(
        [(r[0], BOT if r[0] % 3 else SURE) for r in rows], "request_id long, response string"
    )


def logged(spark, folder, columns=LOGGED):
    return sorted(read_log(spark, f"{folder}/log").select(*columns).collect())


def test_tracking_equals_batch(spark, signals):
    rows = random_rows(1)
    folder = shared_folder(spark, "test-track")
    quick = Settings(snapshot_every=2)

    def start(source):
        return jobs.track_stream(source, f"{folder}/out", f"{folder}/checkpoint", quick)

    feed(spark, rows, signals, start, parts=5)
    columns = ["request_id", "rate", "session_start", "hits", "is_miss"]
    streamed = jobs.tracked_table(spark, f"{folder}/out").read().select(*columns)
    batch = cascade.track(signals(rows)).rows.select(*columns)
    assert sorted(streamed.collect()) == sorted(batch.collect())


def test_classification_equals_batch_and_replays(spark, signals):
    rows = random_rows(2)
    folder = shared_folder(spark, "test-classify")
    model = answers_for(spark, rows)
    no_index = cascade.NO_FINGERPRINTS

    def start(source):
        return jobs.classify_stream(
            source, f"{folder}/out", f"{folder}/checkpoint", model, None, no_index
        )

    feed(spark, rows, signals, start)
    batch = sorted(cascade.classify(signals(rows), model).select(*LOGGED).collect())
    assert logged(spark, f"{folder}/out") == batch
    entries = lambda: sorted(read_reputation(spark, f"{folder}/out/reputation").collect())
    prints = lambda: sorted(p.id for p in read_fingerprints(spark, f"{folder}/out/fingerprints").collect())
    before = entries(), prints()

    # The last batch runs again, as after a failure, and the model has changed its mind: the
    # verdicts that were committed stand, and nothing is doubled or lost in any sink.
    third = -(-len(rows) // 3)
    other = spark.createDataFrame(
        [(r[0], SURE if r[0] % 3 else BOT) for r in rows], "request_id long, response string"
    )
    sinks = outputs.Sinks.at(spark, f"{folder}/out")
    outputs.run_batch(signals(rows[2 * third :]), 2, sinks, other, None, no_index)
    assert logged(spark, f"{folder}/out") == batch
    assert (entries(), prints()) == before
    assert [r.batch_id for r in sinks.batches.read().orderBy("batch_id").collect()] == [0, 1, 2]


def test_a_batch_without_committed_verdicts_leaves_nothing_behind(spark, signals):
    """It stopped before its verdicts were there; the retry has other answers."""
    folder = shared_folder(spark, "test-retry")
    sinks = outputs.Sinks.at(spark, folder)
    rows = signals([(1, 1, "a"), (2, 5, "b")])
    first = spark.createDataFrame([(1, BOT), (2, BOT)], "request_id long, response string")
    second = spark.createDataFrame([(1, SURE), (2, BOT)], "request_id long, response string")
    outputs.run_batch(rows, 0, sinks, first)
    for part in sinks.verdicts.parts():
        sinks.verdicts._files.remove(f"{part.folder}/_SUCCESS")
    outputs.run_batch(rows, 0, sinks, second)
    found = {p.id: p["class"] for p in read_fingerprints(spark, f"{folder}/fingerprints").collect()}
    assert found == {"ip_a_1": "LEGITIMATE", "ip_b_5": "BOT"}
    assert [(r.request_id, r["class"]) for r in logged(spark, folder, ["request_id", "class"])] == [
        (1, "LEGITIMATE"),
        (2, "BOT"),
    ]


def test_requests_without_client_or_time_leave_a_live_client_alone(spark, signals):
    folder = shared_folder(spark, "test-dirty")
    rows = [(k, 10_000_000 + k, "a") for k in range(5)]
    bad = [(10, None, "a"), (11, 10_000_010, None), (12, None, None)]
    later = [(20, 10_000_500, "a"), (21, None, "a"), (22, 10_000_600, "a")]
    model = answers_for(spark, [*rows, *bad, *later])

    def start(source):
        return jobs.classify_stream(source, f"{folder}/out", f"{folder}/checkpoint", model)

    path = shared_folder(spark, "test-stream")
    for part in ([*rows, *bad], later):
        frame = signals(part)
        frame.write.mode("append").parquet(path)
        jobs.drain(start(spark.readStream.schema(frame.schema).parquet(path)))
    (entry,) = read_reputation(spark, f"{folder}/out/reputation").collect()
    assert (entry.hits, entry.last_seen) == (7, 10_000_600)
    sources = {r.request_id: r.source for r in read_log(spark, f"{folder}/out/log").collect()}
    assert sources == {0: "AI"} | {k: "CACHE" for k in (1, 2, 3, 4, 20, 22)}
    rejected = read_rejected(spark, f"{folder}/out/log").collect()
    assert sorted(r.request_id for r in rejected) == [10, 11, 12, 21]


def test_lag_outage_and_late_requests(spark, signals):
    """Nothing depends on when a batch runs; late requests are counted and treated as hits."""
    folder = shared_folder(spark, "test-late")
    sinks = outputs.Sinks.at(spark, folder)
    model = answers_for(spark, [(k,) for k in range(10)])
    outputs.run_batch(signals([(1, 9 * HOUR, "a"), (2, HOUR, "b")]), 0, sinks, model)
    outputs.run_batch(signals([]), 1, sinks, model)
    outputs.run_batch(signals([(3, 8 * HOUR, "a"), (4, HOUR + 1, "b"), (5, 9 * HOUR + 5, "a")]), 2, sinks, model)
    rows = {r.request_id: r.source for r in read_log(spark, f"{folder}/log").collect()}
    assert rows == {1: "AI", 2: "AI", 3: "CACHE", 4: "CACHE", 5: "CACHE"}
    counts = sinks.batches.read().orderBy("batch_id").select("requests", "misses", "late").collect()
    assert [tuple(r) for r in counts] == [(2, 2, 0), (0, 0, 0), (3, 0, 1)]
    entries = {r.ip: (r.hits, r.last_seen) for r in sinks.clients.entries().collect()}
    assert entries == {"a": (3, 9 * HOUR + 5), "b": (2, HOUR + 1)}
    assert [r.ip for r in sinks.clients.active_at(9 * HOUR + 6).collect()] == ["a"]


def test_a_month_in_daily_batches_equals_one_run(spark, signals):
    rng = random.Random(4)
    day = 24 * HOUR
    rows = sorted(
        ((i, rng.randrange(12 * day), f"ip{rng.randrange(5)}") for i in range(500)), key=lambda r: r[1]
    )
    # Sessions and minutes that cross midnight.
    rows += [(1000 + d * 10 + k, d * day - 30_000 + k * 7_000, "night") for d in range(1, 12) for k in range(9)]
    folder = shared_folder(spark, "test-daily")
    quick = Settings(snapshot_every=4, most_late_ms=0)
    sinks = outputs.Sinks.at(spark, folder, quick)
    model = answers_for(spark, rows)
    for d in range(12):
        part = [r for r in rows if d * day <= r[1] < (d + 1) * day]
        outputs.run_batch(signals(part), d, sinks, model, settings=quick, fingerprints=cascade.NO_FINGERPRINTS)
    single = cascade.classify(signals(rows), model)
    assert logged(spark, folder) == sorted(single.select(*LOGGED).collect())
    # Snapshots forget clients that are silent for long; the others are as in one run.
    last = {r.ip: r for r in single.orderBy("ts_ms", "request_id").collect()}
    entries = {r.ip: (r.hits, r.last_seen) for r in sinks.clients.entries().collect()}
    assert entries == {ip: (last[ip].hits, last[ip].ts_ms) for ip in entries}
    newest = max(r[1] for r in rows)
    assert {ip for ip, r in last.items() if newest - r.ts_ms < HOUR} <= set(entries)
    assert len(sinks.clients._snapshots()) <= 3


def test_own_index_is_as_of_batch_start(spark, signals):
    """A behaviour the model calls a bot is recognised by fingerprint from the next batch on."""
    folder = shared_folder(spark, "test-index")
    odd = {"user_agent": "OddBrowser", "path": "/odd"}
    rows = [(1, 0, "a", odd), (2, 1, "b", odd), (3, 2, "c", odd), (4, 3, "d", odd)]
    model = spark.createDataFrame(
        [(k, BOT) for k in range(1, 5)], "request_id long, response string"
    )

    def start(source):
        return jobs.classify_stream(source, f"{folder}/out", f"{folder}/checkpoint", model)

    feed(spark, rows, signals, start, parts=2)
    found = read_log(spark, f"{folder}/out/log").collect()
    assert {r.request_id: r.source for r in found} == {1: "AI", 2: "AI", 3: "VECTOR", 4: "VECTOR"}


def same_views(live, batch):
    assert live.keys() == batch.keys()
    for name, view in live.items():
        assert sorted(view.collect(), key=repr) == sorted(batch[name].collect(), key=repr), name


def test_live_views_equal_batch_views(spark):
    from test_log_and_analytics import NOW, log_df

    folder = shared_folder(spark, "test-tally")
    kinds = ("BOT", "SUSPICIOUS", "LEGITIMATE")
    rows = [
        (NOW - k * 1_700_001, kinds[k % 3], {"ip": f"ip{k % 5}", "request_id": k})
        for k in range(120)
    ]
    for n in range(3):
        append_log_batch(log_df(spark, rows[n * 40 : n * 40 + 40]), f"{folder}/log", n)
        source = jobs.stream_log(spark, f"{folder}/log")
        jobs.drain(jobs.tally_stream(source, f"{folder}/tallies", f"{folder}/checkpoint"))
    log = log_df(spark, rows)
    for now in (NOW, NOW - 30_500):
        live = jobs.live_bundle(spark, f"{folder}/tallies", log, 24, now)
        same_views(live, analytics.analytics_bundle(log, 24, now))


def test_a_five_second_trigger_keeps_views_fresh(spark):
    from test_log_and_analytics import NOW, log_df

    folder = shared_folder(spark, "test-trigger")
    rows = [(NOW - k * 90_000, "BOT", {"ip": f"ip{k % 3}", "request_id": k}) for k in range(60)]
    append_log_batch(log_df(spark, rows[:30]), f"{folder}/log", 0)
    source = jobs.stream_log(spark, f"{folder}/log")
    writer = jobs.tally_stream(source, f"{folder}/tallies", f"{folder}/checkpoint")
    query = writer.trigger(processingTime="5 seconds").start()
    try:
        query.processAllAvailable()
        append_log_batch(log_df(spark, rows[30:]), f"{folder}/log", 1)
        query.processAllAvailable()
    finally:
        query.stop()
    log = read_log(spark, f"{folder}/log")
    live = jobs.live_bundle(spark, f"{folder}/tallies", log, 1, NOW)
    same_views(live, analytics.analytics_bundle(log, 1, NOW))


def test_rolled_up_tallies_stay_exact_and_few(spark):
    from test_log_and_analytics import NOW, log_df

    folder = shared_folder(spark, "test-roll-up")
    tallies = Tallies(spark, folder)
    kinds = ("BOT", "SUSPICIOUS", "LEGITIMATE", "BOT")
    every = []
    for n in range(30):
        # Batches six hours apart, the oldest first, with a late row each.
        at = NOW - (30 - n) * 6 * HOUR
        rows = [(at + k * 60_001, kinds[k % 4], {"ip": f"ip{k % 3}", "request_id": 10 * n + k}) for k in range(6)]
        rows.append((at - 30 * HOUR, "BOT", {"ip": "late", "request_id": 10 * n + 9}))
        every += rows
        tallies.compact(n, fan_in=3)
        tallies.add(log_df(spark, rows), n)
    for tally in (tallies.counts, tallies.bots):
        assert len(tally.table.parts()) <= 9 and len(tally.table._all_parts()) <= 20
    spans = {r.span for r in tallies.bots.table.read().select("span").distinct().collect()}
    assert spans == {1, 60, 1440}
    log = log_df(spark, every)
    for hours, now in ((72, NOW), (24, NOW - 30_500), (180, NOW - 61_234), (150, NOW - 13 * HOUR - 17)):
        counted, bots = tallies.read(log, analytics.since_ms(hours, now))
        views = analytics.counting_views(counted, bots)
        batch = analytics.analytics_bundle(log, hours, now)
        same_views(views, {k: batch[k] for k in views})


def test_tallies_of_the_cascade(spark, signals):
    """Each classified batch keeps its own tallies, which a dashboard reads."""
    folder = shared_folder(spark, "test-cascade-tallies")
    rows = random_rows(6, 120)
    model = answers_for(spark, rows)
    sinks = outputs.Sinks.at(spark, folder)
    for n in range(3):
        outputs.run_batch(signals(rows[n * 40 : n * 40 + 40]), n, sinks, model)
    log = read_log(spark, f"{folder}/log")
    live = jobs.live_bundle(spark, f"{folder}/tallies", log, 12, 20 * HOUR)
    same_views(live, analytics.analytics_bundle(log, 12, 20 * HOUR))
