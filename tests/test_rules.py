import pytest
from pyspark.sql import functions as F

from requestsieve.functions.heuristics import (
    heuristic_score,
    heuristic_verdict,
    path_is_suspicious,
    rate_band,
    rule_hits,
    ua_is_bot,
)
from requestsieve.functions.text import to_fixed
from requestsieve.functions.verdicts import (
    PRIMARY_UNAVAILABLE,
    build_prompt,
    decide,
    is_low_confidence,
)
from requestsieve.operators.models import escalate, normalize_responses

QUIET = {"user_agent": "Mozilla/5.0"}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


@pytest.mark.parametrize("rate, points", [(1, 0), (30, 0), (31, 20), (60, 20), (61, 40)])
def test_rate_band(spark, rate, points):
    assert one(spark, rate_band(F.lit(rate))) == points


@pytest.mark.parametrize(
    "agent, is_bot",
    [
        ("Googlebot/2.1", True),
        ("CURL/8", True),
        ("Go-http-client/1.1", True),
        ("Java/17", True),
        ("javascript", False),
        ("php", False),
        ("Mozilla/5.0", False),
        ("", False),
    ],
)
def test_agents(spark, agent, is_bot):
    assert one(spark, ua_is_bot(F.lit(agent))) is is_bot


@pytest.mark.parametrize(
    "path, probed",
    [
        ("/WP-LOGIN.php", True),
        ("/a/.env", True),
        ("/xenv", False),
        ("/?next=/admin", True),
        ("/administrator", True),
        ("/madmin", False),
        ("/.awsx", True),
        ("/index", False),
    ],
)
def test_paths(spark, path, probed):
    assert one(spark, path_is_suspicious(F.lit(path))) is probed


@pytest.mark.parametrize(
    "own, rate, score",
    [
        ({}, 1, 0),
        ({"user_agent": "curl/8"}, 1, 50),
        ({"user_agent": ""}, 1, 40),
        ({"has_accept_lang": False}, 1, 20),
        ({"has_referer": False}, 1, 0),
        ({"has_accept_lang": False, "has_referer": False}, 1, 30),
        ({"user_agent": "", "has_accept_lang": False, "has_referer": False}, 1, 70),
        ({"user_agent": "curl/8", "path": "/.env", "has_accept_lang": False}, 61, 100),
        ({}, 61, 40),
    ],
)
def test_score(signals, own, rate, score):
    row = signals([(1, 0, "a", own)]).withColumn("rate", F.lit(rate))
    assert row.select(heuristic_score()).head()[0] == score


@pytest.mark.parametrize("score, bot", [(69, False), (70, True), (100, True)])
def test_verdict_boundary(spark, score, bot):
    found = one(spark, heuristic_verdict(F.lit(score)))
    if bot:
        assert tuple(found) == (score / 100, "BOT", "HEURISTIC", None)
    else:
        assert found is None


def test_rule_hits_without_rows(signals):
    hits = rule_hits(signals([]).withColumn("rate", F.lit(1))).collect()
    assert len(hits) == 7 and all(r.hits == 0 and r.points == 0 for r in hits)


FALLBACK = (0.5, "SUSPICIOUS", "AI", PRIMARY_UNAVAILABLE)


@pytest.mark.parametrize(
    "response, expected",
    [
        ('{"class":"BOT","score":0.97,"reason":"a"}', (0.97, "BOT", "AI", "a")),
        ('so: {"class":"LEGITIMATE",\n"score":0} {"class":"BOT"}', (0.0, "LEGITIMATE", "AI", "")),
        ('{"class":"BOT","score":1.7}', (1.0, "BOT", "AI", "")),
        ('{"class":"BOT","score":-3}', (0.0, "BOT", "AI", "")),
        ('{"class":"BOT","score":1e400}', (1.0, "BOT", "AI", "")),
        ('{"class":"BOT","score":"0.9"}', (0.5, "BOT", "AI", "")),
        ('{"class":"BOT","score":null}', (0.5, "BOT", "AI", "")),
        ('{"class":"BOT","score":true}', (0.5, "BOT", "AI", "")),
        ('{"class":"bot","score":0.2}', (0.2, "SUSPICIOUS", "AI", "")),
        ('{"class":5}', (0.5, "SUSPICIOUS", "AI", "")),
        ("{}", (0.5, "SUSPICIOUS", "AI", "")),
        ('{"class":"BOT","class":"LEGITIMATE"}', (0.5, "LEGITIMATE", "AI", "")),
        ('{"reason":5}', (0.5, "SUSPICIOUS", "AI", "5")),
        ('{"reason":0}', (0.5, "SUSPICIOUS", "AI", "")),
        ('{"reason":false}', (0.5, "SUSPICIOUS", "AI", "")),
        ('{"reason":null}', (0.5, "SUSPICIOUS", "AI", "")),
        ('{"reason":"false"}', (0.5, "SUSPICIOUS", "AI", "false")),
        ('{"reason":"0"}', (0.5, "SUSPICIOUS", "AI", "0")),
        ("{'class':'BOT'}", FALLBACK),
        ('{"score":NaN}', FALLBACK),
        ('{"class":"BOT",}', FALLBACK),
        ('{"class":"BOT","x":{"y":1}}', FALLBACK),
        ("no json", FALLBACK),
        ('{"class":"BOT"', FALLBACK),
        ("", FALLBACK),
        (None, FALLBACK),
    ],
)
def test_answers(spark, response, expected):
    df = spark.createDataFrame([(1, response)], "request_id long, response string")
    row = normalize_responses(df).head()
    assert (row.score, row["class"], row.source, row.reason) == expected


@pytest.mark.parametrize("score, low", [(0.39, False), (0.4, True), (0.6, True), (0.61, False)])
def test_confidence(spark, score, low):
    assert one(spark, is_low_confidence(F.lit(score))) is low


@pytest.mark.parametrize(
    "first, second, taken",
    [(0.5, 0.9, 0.9), (0.5, 0.5, 0.5), (0.7, 0.9, 0.7), (0.4, 0.61, 0.61), (0.5, None, 0.5)],
)
def test_escalation(spark, first, second, taken):
    def verdicts(score):
        rows = [] if score is None else [(1, score, "BOT", "AI", "r")]
        return spark.createDataFrame(
            rows, "request_id long, score double, class string, source string, reason string"
        )

    assert escalate(verdicts(first), verdicts(second)).head()["score"] == taken
    assert escalate(verdicts(first), None).head()["score"] == first


@pytest.mark.parametrize(
    "x, digits, text",
    [
        (0.125, 2, "0.13"),
        (0.375, 2, "0.38"),
        (0.625, 2, "0.63"),
        (0.875, 2, "0.88"),
        (1.005, 2, "1.00"),
        (0.995, 2, "0.99"),
        (0.5, 2, "0.50"),
        (1.0, 2, "1.00"),
        (0.0625, 3, "0.063"),
        (0.9245, 3, "0.924"),
        (14.499999999999998, 0, "14"),
        (0.5, 0, "1"),
        (1.5, 0, "2"),
        (2.5, 0, "3"),
        (1234.5, 1, "1234.5"),
    ],
)
def test_fixed_decimals(spark, x, digits, text):
    assert one(spark, to_fixed(F.lit(x), digits)) == text


def test_decisions(spark):
    df = spark.createDataFrame(
        [(0.9, "BOT", "AI"), (0.5, "SUSPICIOUS", "AI"), (0.125, "LEGITIMATE", "CACHE")],
        "score double, class string, source string",
    )
    columns = decide(F.col("score"), F.col("class"), F.col("source"))
    rows = df.select(*[c.alias(n) for n, c in columns.items()]).collect()
    assert [(r.action, r.status, r.score_text) for r in rows] == [
        ("BLOCK", 403, "0.90"),
        ("PASS", 200, "0.50"),
        ("PASS", 200, "0.13"),
    ]
    assert [r.warning is not None for r in rows] == [False, True, False]
    assert [r.error is not None for r in rows] == [True, False, False]


def test_prompt_has_all_facts(signals):
    row = signals([(1, 0, "9.8.7.6", {"path": "/p?q", "country": "SE"})])
    prompt = row.withColumn("rate", F.lit(12)).select(build_prompt()).head()[0]
    for fact in ("9.8.7.6", "SE", "'Mozilla/5.0'", "'/p?q'", ": 12", "JSON"):
        assert fact in prompt
