import pandas as pd
import pytest
from conftest import plan_text
from pyspark.sql import functions as F

from requestsieve.functions.verdicts import PRIMARY_UNAVAILABLE
from requestsieve.operators.distinct import per_distinct
from requestsieve.operators.fingerprints import embed_hashing, vector_verdicts, with_signal_text
from requestsieve.plans import cascade, outputs
from requestsieve.schemas import FINGERPRINT
from requestsieve.session import shared_folder
from requestsieve.settings import Settings
from requestsieve.sources.log import read_log, read_rejected
from requestsieve.sources.stores import read_fingerprints, read_reputation

HOUR = 3_600_000
SURE = '{"class":"LEGITIMATE","score":0.1,"reason":"person"}'
UNSURE = '{"class":"SUSPICIOUS","score":0.5,"reason":"hm"}'
BOT = '{"class":"BOT","score":0.95,"reason":"robot"}'


def answers(spark, pairs):
    return spark.createDataFrame(list(pairs), "request_id long, response string")


def always(response):
    """A scorer that gives one answer and fails on a repeated prompt."""

    def score(batches):
        for batch in batches:
            yield batch.assign(response=response)

    return lambda prompts: prompts.mapInPandas(score, "prompt string, response string")


def by_id(df):
    return {r.request_id: r for r in df.collect()}


def bot_index(spark, signals, row):
    """An index that holds the fingerprint of one request."""
    text = with_signal_text(signals([row]).withColumn("rate", F.lit(1)))
    vector = embed_hashing(text).head()["vector"]
    data = [("v1", vector, "9.9.9.9", "BOT", 0.9, 0, "US")]
    return spark.createDataFrame(data, FINGERPRINT)


def test_priorities(spark, signals):
    odd = {"user_agent": "OddBrowser", "path": "/very/odd/path"}
    rows = signals(
        [
            (1, 0, "a", odd | {"user_agent": "OddBrowser curl", "has_accept_lang": False}),
            (2, 10, "a"),
            (3, 0, "b", {"user_agent": "curl/8", "has_accept_lang": False}),
            (4, 0, "c"),
            (5, 30, "c", {"user_agent": "curl/8", "has_accept_lang": False}),
            (6, 2 * HOUR, "b"),
        ]
    )
    known = (0, 0, "x", odd | {"user_agent": "OddBrowser curl", "has_accept_lang": False})
    prints = cascade.Fingerprints(bot_index(spark, signals, known))
    found = by_id(cascade.classify(rows, answers(spark, [(4, SURE), (6, BOT)]), None, prints))

    assert (found[1].source, found[1]["class"]) == ("VECTOR", "BOT")
    assert found[1].score == pytest.approx(1.0) and "1.000" in found[1].reason
    assert (found[2].source, found[2]["class"], found[2].reason) == ("CACHE", "BOT", None)
    assert (found[3].source, found[3].score, found[3].reason) == ("HEURISTIC", 0.7, None)
    assert (found[4].source, found[4].score, found[4].reason) == ("AI", 0.1, "person")
    # A hit reuses the session's verdict whatever it looks like itself.
    assert (found[5].source, found[5]["class"], found[5].score) == ("CACHE", "LEGITIMATE", 0.1)
    # The entry of b has expired.
    assert (found[6].source, found[6]["class"], found[6].hits) == ("AI", "BOT", 1)


def test_second_model(spark, signals):
    rows = signals([(k, 0, f"ip{k}") for k in range(1, 6)])
    first = answers(spark, [(1, SURE), (2, UNSURE), (3, UNSURE), (4, "oops")])
    second = answers(spark, [(1, BOT), (2, BOT), (3, UNSURE), (5, BOT)])
    found = by_id(cascade.classify(rows, first, second))
    assert (found[1].score, found[2].score, found[3].score) == (0.1, 0.95, 0.5)
    assert (found[4].score, found[4].reason) == (0.5, PRIMARY_UNAVAILABLE)
    # No answer is a low-confidence verdict as well, so the second model decides.
    assert (found[5].score, found[5]["class"], found[5].source) == (0.95, "BOT", "AI")
    only_first = by_id(cascade.classify(rows, first))
    assert only_first[2].score == 0.5 and only_first[5].reason == PRIMARY_UNAVAILABLE


def test_models_see_only_open_rows(spark, signals):
    seen = spark.sparkContext.accumulator(0)
    second_seen = spark.sparkContext.accumulator(0)

    def model(response, counter):
        def score(batches):
            for batch in batches:
                counter.add(len(batch))
                yield batch.assign(response=response)

        return lambda prompts: prompts.mapInPandas(score, "prompt string, response string")

    curl = {"user_agent": "curl/8", "has_accept_lang": False}
    rows = signals(
        [(1, 0, "a", curl), (2, 0, "b"), (3, 1, "b"), (4, 0, "c"), (5, 2 * HOUR, "c")]
    )
    found = by_id(cascade.classify(rows, model(UNSURE, seen), model(BOT, second_seen)))
    assert [found[k].source for k in (1, 2, 3, 4, 5)] == ["HEURISTIC", "AI", "CACHE", "AI", "AI"]
    # Two distinct prompts: c asks the same twice.
    assert seen.value == 2 and second_seen.value == 2
    by_id(cascade.classify(rows, model(SURE, seen), model(BOT, second_seen)))
    assert seen.value == 4 and second_seen.value == 2


@pytest.mark.parametrize("settings", [Settings(), Settings(hot_rows=15)], ids=["plain", "hot"])
def test_hot_session_carries_one_verdict(spark, signals, settings):
    rows = [(k, 1000 + (k % 50) * 100, "hot") for k in range(200)] + [(500, 0, "cold")]
    found = cascade.classify(signals(rows), always(BOT), settings=settings)
    assert "block_id" not in found.columns
    counts = {(r.ip, r.source): r["count"] for r in found.groupBy("ip", "source").count().collect()}
    assert counts == {("hot", "AI"): 1, ("hot", "CACHE"): 199, ("cold", "AI"): 1}
    ranks = sorted(r.rate for r in found.filter("ip = 'hot'").collect())
    assert ranks == list(range(1, 201))


def test_rows_are_shuffled_once(spark, signals):
    path = shared_folder(spark, "test-requests")
    signals([(k, k * 1000, f"ip{k % 7}") for k in range(100)]).write.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = cascade.classify(spark.read.parquet(path), answers(spark, [(1, SURE)]))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    scan = next(n for n, line in enumerate(lines) if "FileScan parquet" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above, level = 0, depth(lines[scan])
    for line in reversed(lines[:scan]):
        if depth(line) < level:
            level = depth(line)
            above += "Exchange" in line
    assert above == 1
    assert "MapInPandas" not in plan and "BatchEvalPython" not in plan


def test_skewed_keys_are_split(spark):
    """The one row per key side is small, the other has a hot key: Spark splits it."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        rows = (
            spark.range(0, 60_000, 1, 8)
            .withColumnRenamed("id", "request_id")
            .withColumn(
                "prompt",
                F.when(F.col("request_id") % 3 == 0, "hot").otherwise(
                    F.concat(F.lit("p"), F.col("request_id").cast("string"))
                ),
            )
        )
        joined = per_distinct(
            rows, "prompt", lambda keys: keys.withColumn("size", F.length("prompt"))
        )
        joined.write.format("noop").mode("overwrite").save()
        checked = joined.groupBy().agg(F.count("size"), F.count_if(F.col("prompt") == "hot"))
        assert tuple(checked.head()) == (60_000, 20_000)
        joined.collect()
        assert "skew=true" in plan_text(joined)
    finally:
        for key in wanted:
            spark.conf.unset(key)


def test_null_keys_get_no_result(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "request_id long, k string")
    joined = per_distinct(rows, "k", lambda keys: keys.withColumn("v", F.lit(1)))
    assert {r.request_id: r.v for r in joined.collect()} == {1: 1, 2: None, 3: 1}


def test_outputs(spark, signals):
    folder = shared_folder(spark, "test-outputs")
    curl = {"user_agent": "curl/8", "has_accept_lang": False}
    rows = signals([(1, 5, "a", curl), (2, 9, "a"), (3, 0, "b"), (4, 4 * HOUR, "b")])
    outputs.write_outputs(rows, folder, answers(spark, [(3, SURE), (4, BOT)]))
    logged = read_log(spark, f"{folder}/log").collect()
    assert sorted((r.request_id, r.source, r["class"]) for r in logged) == [
        (1, "HEURISTIC", "BOT"),
        (2, "CACHE", "BOT"),
        (3, "AI", "LEGITIMATE"),
        (4, "AI", "BOT"),
    ]
    entries = read_reputation(spark, f"{folder}/reputation").collect()
    assert sorted(map(tuple, entries)) == [
        ("a", 0.7, "BOT", 2, 9),
        ("b", 0.95, "BOT", 1, 4 * HOUR),
    ]
    prints = read_fingerprints(spark, f"{folder}/fingerprints").collect()
    assert sorted((p.id, p["class"], len(p["values"])) for p in prints) == [
        ("ip_b_0", "LEGITIMATE", 384),
        (f"ip_b_{4 * HOUR}", "BOT", 384),
    ]


def test_rows_without_client_or_time_are_rejected(spark, signals):
    folder = shared_folder(spark, "test-rejected")
    rows = signals([(1, 5, "a"), (2, None, "a"), (3, 7, None), (4, None, None), (5, 9, "a")])
    outputs.write_outputs(rows, folder, answers(spark, [(1, SURE), (1, BOT)]))
    logged = read_log(spark, f"{folder}/log").collect()
    rejected = {r.request_id: r.errors for r in read_rejected(spark, f"{folder}/log").collect()}
    assert sorted(r.request_id for r in logged) == [1, 5]
    unknown = ["score", "class", "source"]
    assert rejected == {
        2: [*unknown, "timestamp"],
        3: ["ip", *unknown],
        4: ["ip", *unknown, "timestamp"],
    }
    counts = outputs.Sinks.at(spark, folder).batches.read().collect()
    assert [tuple(r) for r in counts] == [(0, 5, 3, 1, 0)]
    assert sorted(by_id(cascade.classify(rows, answers(spark, [])))) == [1, 5]


def test_properties(spark, signals):
    rows = [(k, (k * 7919) % (6 * HOUR), f"ip{k % 11}") for k in range(300)]
    found = cascade.classify(signals(rows), always(UNSURE)).toPandas()
    assert len(found) == 300 and found["request_id"].is_unique
    assert found["score"].between(0, 1).all()
    sessions = found.groupby(["ip", "session_start"])
    assert (sessions["is_miss"].sum() == 1).all()
    for _, part in found.groupby(["ip", "minute"]):
        assert sorted(part["rate"]) == list(range(1, len(part) + 1))
    for _, part in sessions:
        assert sorted(part["hits"]) == list(range(1, len(part) + 1))
    assert isinstance(found, pd.DataFrame)


def test_models_meet_open_rows_only(spark, signals):
    """Answers to decided requests are not grouped, and the second model's join has no others."""
    curl = {"user_agent": "curl/8", "has_accept_lang": False}
    rows = signals([(k, 0, f"ip{k}", curl if k % 4 else {}) for k in range(400)])
    staged = cascade.misses_of(cascade.track(rows))
    resolved = cascade.resolve(staged, answers(spark, [(k, SURE) for k in range(4000)]))
    plan = resolved._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan
    resolved.collect()
    counted = plan_text(resolved)
    assert "LeftSemi" in counted
    sources = {r["source"]: r["count"] for r in resolved.groupBy("verdict.source").count().collect()}
    assert sources == {"HEURISTIC": 300, "AI": 100}


def test_equal_vectors_are_searched_once_and_kept_for_model_verdicts_only(spark, signals, monkeypatch):
    rows = [(k, k * 10, f"ip{k}", {"path": f"/{k}"}) for k in range(12)] + [(99, 0, "z", {"user_agent": "curl/8"})]
    asked = []

    def watch(queries, index, settings):
        asked.append(queries.count())
        return vector_verdicts(queries, index, settings)

    monkeypatch.setattr(cascade, "vector_verdicts", watch)
    index = spark.createDataFrame([("f", [0.0, 1.0], "BOT")], "id string, values array<float>, class string")
    prints = cascade.Fingerprints(
        index,
        embed=lambda keys: keys.withColumn("vector", F.array(F.lit(1.0), F.when(F.col("signal_text").contains("curl"), 9.0).otherwise(0.0))),
        keep_vectors=True,
    )
    misses = cascade.misses_of(cascade.track(signals(rows)))
    resolved = cascade.resolve(misses, answers(spark, [(k, SURE) for k in range(12)]), None, prints).collect()
    assert asked == [2]
    assert {r.request_id: (r.verdict["source"], r.vector) for r in resolved} == {
        k: ("AI", [1.0, 0.0]) for k in range(12)
    } | {99: ("VECTOR", None)}


def test_batches_read_their_requests_from_one_table(spark, tmp_path, monkeypatch):
    from requestsieve import catalog

    plans = []
    monkeypatch.setattr(catalog.outputs, "run_batch", lambda rows, *rest: plans.append(plan_text(rows)))
    monkeypatch.setattr(catalog, "sample_fingerprints", lambda *_: None)
    monkeypatch.setattr(catalog.samples, "responses", lambda *_, **__: None)
    left = spark.createDataFrame([(k, k * 10) for k in range(9)], "request_id long, ts_ms long")
    rows = left.join(left.withColumnRenamed("ts_ms", "other").hint("merge"), "request_id")
    catalog._in_batches(spark, "", rows, [30], str(tmp_path))
    assert len(plans) == 2 and not any("Join" in p for p in plans)


def test_a_key_with_several_vectors_has_its_best_match(spark, signals):
    misses = cascade.misses_of(cascade.track(signals([(1, 0, "a")])))
    index = spark.createDataFrame(
        [("f", [0.0, 1.0], "BOT"), ("g", [0.2, 1.0], "BOT")], "id string, values array<float>, class string"
    )
    two = F.explode(F.array(F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(0.1), F.lit(1.0))))
    prints = cascade.Fingerprints(index, embed=lambda keys: keys.withColumn("vector", two))
    resolved = cascade.resolve(misses, answers(spark, []), None, prints).collect()
    assert [(r.request_id, r.verdict["score"]) for r in resolved] == [(1, 1.0)]
