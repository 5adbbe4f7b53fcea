"""Request, log, answer and fingerprint tables derived from the sample data.

Every row of `events`, `pages` and `embeddings` takes part, so the work grows with them.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from requestsieve.session import configure

# 2024-01-31 00:00 UTC, just after the last event.
NOW_MS = 1_706_659_200_000
START_MS = 1_704_067_200_000
# The dense timeline is this many times faster.
SPEED_UP = 4320

COUNTRIES = ("US", "DE", "FR", "IN", "BR", "CN")
ANSWERS = (
    '{"class":"BOT","score":0.97,"reason":"a"}',
    'Sure: {"class":"LEGITIMATE","score":0.05,"reason":"b"} ok',
    '{"class":"SUSPICIOUS","score":0.5,"reason":"c"}',
    '{"class":"bot","score":1.7}',
    '{"class":"BOT","score":"0.9"}',
    "no json here",
    '{"class":"BOT","score":0.6,"x":{"y":1}}',
    "",
    '{"class":"LEGITIMATE","score":0.4}',
    "{}",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _choose(selector: Column, values: tuple[str, ...], default: str | None = None) -> Column:
    """The value at a zero-based position; the default beyond the last."""
    found = F.get(F.array(*[F.lit(v) for v in values]), selector.cast("int"))
    return found if default is None else F.coalesce(found, F.lit(default))


def _event_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def events_with_pages(events: DataFrame, pages: DataFrame) -> DataFrame:
    """Each event with the URL of one page; page ids run from 0, so they are dealt round.

    The page count comes from the file footers. Where an id is missing, the event stays without
    a URL.
    """
    page_count = pages.count()
    dealt = events.withColumn("page_id", F.col("event_id") % page_count)
    return dealt.join(pages.select("page_id", "url"), "page_id", "left")


def _agent(event_id: Column) -> Column:
    named = ("", "curl/8.5.0", "python-requests/2.31", "Googlebot/2.1")
    return _choose(event_id % 8, named, "Mozilla/5.0 (X11; Linux x86_64)")


def _user_ip(user_id: Column) -> Column:
    return F.concat(
        F.lit("10.0."),
        F.floor(user_id / 256).cast("string"),
        F.lit("."),
        (user_id % 256).cast("string"),
    )


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw requests with headers in all the shapes that matter: missing, empty, mixed case."""
    return raw_requests_from(
        table(spark, sf_dir, "events"), table(spark, sf_dir, "pages")
    )


def raw_requests_from(events: DataFrame, pages: DataFrame) -> DataFrame:
    i, user = F.col("event_id"), F.col("user_id")
    agent = _agent(i)
    forwarded = F.concat(
        F.lit("203.0.113."), (user % 200).cast("string"), F.lit(", 10.1.1.1")
    )
    headers = {
        "CF-Connecting-IP": F.when(i % 4 == 0, None)
        .when(i % 9 == 0, "")
        .otherwise(_user_ip(user)),
        "x-forwarded-for": F.when(i % 5 < 3, forwarded),
        "CF-IPCountry": F.when(i % 3 == 0, "GB"),
        "User-Agent": F.when(agent != "", agent),
        "user-agent": F.when(i % 11 == 0, "second/1.0"),
        "Accept-Language": F.when(i % 3 == 1, "en").when(i % 3 == 2, ""),
        "Referer": F.when(i % 5 != 0, F.col("url")),
    }
    entries = F.filter(
        F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in headers.items()]),
        lambda e: e["value"].isNotNull(),
    )
    origin = F.regexp_extract(F.col("url"), "^[a-z]+://[^/]+", 0)
    url = (
        F.when(i % 13 == 0, F.concat(origin, F.lit("/health")))
        .when(i % 17 == 0, F.concat(origin, F.lit("/analytics?range=6h")))
        .when(i % 19 == 0, origin)
        .when(i % 23 == 0, F.concat(origin, F.lit("?x=1")))
        .when(i % 29 == 0, F.concat(F.col("url"), F.lit("?")))
        .otherwise(F.col("url"))
    )
    return events_with_pages(events, pages).select(
        i.alias("request_id"),
        _event_ms(F.col("ts")).alias("ts_ms"),
        F.when(i % 31 == 0, "OPTIONS").otherwise("GET").alias("method"),
        url.alias("url"),
        F.map_from_entries(entries).alias("headers"),
        F.when(i % 2 == 0, _choose(user % 7, COUNTRIES)).alias("cf_country"),
        F.when(user % 4 == 0, "").when(user % 4 == 1, "TLSv1.3").alias("cf_tls_version"),
    )


def requests_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals on the events' own timeline: mostly cache misses."""
    return requests_from(table(spark, sf_dir, "events"), table(spark, sf_dir, "pages"))


def requests_from(events: DataFrame, pages: DataFrame) -> DataFrame:
    i, user = F.col("event_id"), F.col("user_id")
    page_path = F.regexp_replace("url", "^[a-z]+://[^/]+", "")
    return events_with_pages(events, pages).select(
        i.alias("request_id"),
        _event_ms(F.col("ts")).alias("ts_ms"),
        _user_ip(user).alias("ip"),
        _choose(user % 7, COUNTRIES, "XX").alias("country"),
        _agent(i).alias("user_agent"),
        F.when(F.col("event_type") == "error", "/wp-login.php")
        .when(F.col("event_type") == "signup", "/.env?x=1")
        .otherwise(page_path)
        .alias("path"),
        (i % 3 != 0).alias("has_accept_lang"),
        (i % 5 != 0).alias("has_referer"),
        (user % 4 != 0).alias("has_tls"),
        F.concat_ws(
            ",",
            F.when(i % 3 != 0, "accept-language"),
            F.when(i % 5 != 0, "referer"),
            F.lit("user-agent"),
        ).alias("header_keys"),
    )


def dense(requests: DataFrame) -> DataFrame:
    """The same requests in ten minutes, three tenths of them from three clients."""
    i = F.col("request_id")
    return requests.withColumn(
        "ts_ms", F.lit(START_MS) + F.floor((F.col("ts_ms") - START_MS) / SPEED_UP)
    ).withColumn(
        "ip",
        F.when(i % 10 < 3, F.concat(F.lit("192.0.2."), (i % 10).cast("string"))).otherwise(
            F.col("ip")
        ),
    )


def requests_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(requests_in(spark, sf_dir))


def requests_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense requests, some without a client, some without a time, in live sessions."""
    i = F.col("request_id")
    return requests_dense(spark, sf_dir).withColumns(
        {
            "ip": F.when(i % 37 != 0, F.col("ip")),
            "ts_ms": F.when(i % 41 != 0, F.col("ts_ms")),
        }
    )


def responses(spark: SparkSession, sf_dir: str, secondary: bool = False) -> DataFrame:
    """Stored model answers, valid and malformed."""
    i = F.col("event_id")
    selector = F.floor(i / 10) % 10 if secondary else i % 10
    return table(spark, sf_dir, "events").select(
        i.alias("request_id"), _choose(selector, ANSWERS).alias("response")
    )


def log_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classification log. No VECTOR row on purpose: the views must zero-fill it."""
    i = F.col("request_id")
    classes = ("BOT", "BOT", "SUSPICIOUS")
    return requests_in(spark, sf_dir).select(
        "request_id",
        "ip",
        "country",
        "path",
        "user_agent",
        ((i % 101).cast("double") / 100).alias("score"),
        _choose(i % 5, classes, "LEGITIMATE").alias("class"),
        _choose(i % 3, ("CACHE", "HEURISTIC", "AI")).alias("source"),
        "ts_ms",
    )


def log_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with every constraint broken in some rows."""
    i = F.col("request_id")
    return log_in(spark, sf_dir).withColumns(
        {
            "ip": F.when(i % 7 != 0, F.col("ip")),
            "score": F.when(i % 11 != 0, F.col("score")),
            "class": F.when(i % 13 == 0, "bot").when(i % 17 != 0, F.col("class")),
            "source": F.when(i % 19 == 0, "KV").when(i % 23 != 0, F.col("source")),
            "ts_ms": F.when(i % 29 != 0, F.col("ts_ms")),
        }
    )


def fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as stored fingerprints; even labels are bots. Ids sort as their numbers."""
    return table(spark, sf_dir, "embeddings").select(
        F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("id"),
        F.col("embedding").alias("values"),
        F.when(F.col("label") % 2 == 0, "BOT").otherwise("LEGITIMATE").alias("class"),
    )


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per embedding: a blend of it with the next one, by four weights in turn."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("own"))
    count = vectors.count()
    following = vectors.select(
        F.pmod(F.col("vec_id") - 1, F.lit(count)).alias("vec_id"), F.col("own").alias("next")
    )
    weight = F.get(F.lit([0.9, 0.72, 0.65, 0.5]), (F.col("vec_id") % 4).cast("int"))
    # Doubles only after the join, so half as much is shuffled.
    own, following_or_own = (
        c.cast("array<double>") for c in (F.col("own"), F.coalesce("next", "own"))
    )
    return (
        vectors.join(following, "vec_id", "left")
        .withColumn("w", weight)
        .select(
            F.col("vec_id").alias("query_id"),
            F.zip_with(
                own, following_or_own, lambda a, b: F.col("w") * a + (1 - F.col("w")) * b
            ).alias("vector"),
        )
    )


def vector_keys(requests: DataFrame, queries: DataFrame) -> DataFrame:
    """Give each request the id of one query vector, dealt round."""
    return requests.withColumn("vector_key", F.col("request_id") % queries.count())
