import pytest
from pyspark.sql import functions as F

from requestsieve.functions.signals import (
    extract_signals,
    normalize_headers,
    request_path,
    signal_text,
)
from requestsieve.schemas import RAW_REQUEST
from requestsieve.sources.requests import classifiable


def raw(spark, headers=None, url="https://h/", method="GET", country=None, tls=None):
    row = (1, 120_000, method, url, headers, country, tls)
    return spark.createDataFrame([row], RAW_REQUEST)


@pytest.mark.parametrize(
    "url, path",
    [
        ("https://h", "/"),
        ("https://h?x=1", "/?x=1"),
        ("https://h/?", "/"),
        ("https://h/a?", "/a"),
        ("https://h/a?b=1#c", "/a?b=1"),
        ("https://h/a#c?d", "/a"),
        ("https://user@h:8080/a/b", "/a/b"),
        ("https://h/a??", "/a??"),
        ("https://h/a?b=http://c/d", "/a?b=http://c/d"),
    ],
)
def test_path(spark, url, path):
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(request_path(F.col("url"))).head()[0] == path


@pytest.mark.parametrize(
    "headers, expected",
    [
        ({"a": "1", "b": "2"}, {"a": "1", "b": "2"}),
        ({"A": "1", "b": "2"}, {"a": "1", "b": "2"}),
        ({"A": "1", "b": "2", "a": "3"}, {"a": "1, 3", "b": "2"}),
        ({}, {}),
    ],
)
def test_header_names(spark, headers, expected):
    # Built on the JVM side, as the order of a Python dict does not survive the way there.
    pairs = [F.lit(x) for pair in headers.items() for x in pair]
    df = spark.range(1).select(F.create_map(*pairs).cast("map<string,string>").alias("h"))
    assert df.select(normalize_headers(F.col("h"))).head()[0] == expected


@pytest.mark.parametrize(
    "headers, ip",
    [
        ({"CF-Connecting-IP": "1.1.1.1", "x-forwarded-for": "2.2.2.2"}, "1.1.1.1"),
        ({"cf-connecting-ip": "", "x-forwarded-for": "2.2.2.2, 3.3.3.3"}, "2.2.2.2, 3.3.3.3"),
        ({"cf-connecting-ip": "", "x-forwarded-for": ""}, "0.0.0.0"),
        ({}, "0.0.0.0"),
        (None, "0.0.0.0"),
    ],
)
def test_client_ip(spark, headers, ip):
    assert extract_signals(raw(spark, headers)).head()["ip"] == ip


@pytest.mark.parametrize(
    "cf, header, country",
    [("DE", "FR", "DE"), ("", "FR", "FR"), (None, "", "XX"), (None, None, "XX")],
)
def test_country(spark, cf, header, country):
    headers = {} if header is None else {"CF-IPCountry": header}
    assert extract_signals(raw(spark, headers, country=cf)).head()["country"] == country


def test_empty_headers_count_as_missing(spark):
    empty = {"Accept-Language": "", "Referer": "", "User-Agent": ""}
    row = extract_signals(raw(spark, empty, tls="")).head()
    assert (row.has_accept_lang, row.has_referer, row.has_tls, row.user_agent) == (
        False,
        False,
        False,
        "",
    )
    assert row.header_keys == "accept-language,referer,user-agent"
    full = {"ACCEPT-LANGUAGE": "en", "referer": "x", "User-Agent": "ua"}
    row = extract_signals(raw(spark, full, tls="TLSv1.3")).head()
    assert (row.has_accept_lang, row.has_referer, row.has_tls, row.user_agent) == (
        True,
        True,
        True,
        "ua",
    )


@pytest.mark.parametrize(
    "method, url, kept",
    [
        ("GET", "https://h/", True),
        ("OPTIONS", "https://h/", False),
        ("GET", "https://h/analytics", False),
        ("GET", "https://h/analytics?range=1h", False),
        ("GET", "https://h/health", False),
        ("POST", "https://h/health?", False),
        ("GET", "https://h/health/", True),
        ("GET", "https://h/?p=/health", True),
        ("GET", "https://h/Analytics", True),
        (None, "https://h/", True),
    ],
)
def test_classifiable(spark, method, url, kept):
    assert classifiable(raw(spark, {}, url, method)).count() == int(kept)


def test_signal_text(spark, signals):
    rows = signals([(1, 0, "1.1.1.1", {"has_tls": False, "path": "/a?b"})])
    text = rows.withColumn("rate", F.lit(7)).select(signal_text()).head()[0]
    assert text == (
        "ua:Mozilla/5.0 | path:/a?b | lang:true | ref:true | tls:false | rate:7 | "
        "headers:accept-language,referer,user-agent"
    )
