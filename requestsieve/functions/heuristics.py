"""Weighted request rules."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from requestsieve.settings import DEFAULTS, Settings

# Substrings of automated user agents, in any letter case.
BOT_AGENTS = (
    "bot", "crawl", "spider", "scrape", "curl", "wget", "python-requests", "httpie",
    "postman", "go-http", "java/", "php/", "ruby", "axios", "node-fetch",
)

# Parts of paths that only scanners ask for, in any letter case.
PROBED_PATHS = (
    "/wp-admin", "/wp-login", "/xmlrpc", "/.env", "/.git", "/phpmyadmin", "/admin",
    "/backup", "/config", "/.aws", "/actuator",
)

# Points per rule.
POINTS = {
    "bot_agent": 50,
    "empty_agent": 40,
    "no_language": 20,
    "probed_path": 30,
    "rate_over_limit": 40,
    "rate_over_half": 20,
    "no_referer_no_language": 10,
}
MAX_SCORE = 100


def _contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    return text.rlike("(?i)" + "|".join(re.escape(p) for p in parts))


def ua_is_bot(user_agent: Column) -> Column:
    return _contains_any(user_agent, BOT_AGENTS)


def path_is_suspicious(path: Column) -> Column:
    return _contains_any(path, PROBED_PATHS)


def rate_band(rate: Column, settings: Settings = DEFAULTS) -> Column:
    return (
        F.when(rate > settings.rate_limit, POINTS["rate_over_limit"])
        .when(rate > settings.rate_limit / 2, POINTS["rate_over_half"])
        .otherwise(0)
    )


def rules(settings: Settings = DEFAULTS) -> dict[str, Column]:
    """One boolean per rule, over the signal columns and `rate`."""
    rate = F.col("rate")
    over_limit = rate > settings.rate_limit
    return {
        "bot_agent": ua_is_bot(F.col("user_agent")),
        "empty_agent": F.col("user_agent") == "",
        "no_language": ~F.col("has_accept_lang"),
        "probed_path": path_is_suspicious(F.col("path")),
        "rate_over_limit": over_limit,
        "rate_over_half": ~over_limit & (rate > settings.rate_limit / 2),
        "no_referer_no_language": ~F.col("has_referer") & ~F.col("has_accept_lang"),
    }


def heuristic_score(settings: Settings = DEFAULTS) -> Column:
    total = F.lit(0)
    for name, fires in rules(settings).items():
        total = total + F.when(fires, POINTS[name]).otherwise(0)
    return F.least(total, F.lit(MAX_SCORE))


def heuristic_verdict(score: Column, settings: Settings = DEFAULTS) -> Column:
    """A BOT verdict from `bot_score` points on; NULL below."""
    return F.when(
        score >= settings.bot_score,
        F.struct(
            (score / F.lit(100.0)).alias("score"),
            F.lit("BOT").alias("class"),
            F.lit("HEURISTIC").alias("source"),
            F.lit(None).cast("string").alias("reason"),
        ),
    )


def rule_hits(requests: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """How often each rule fires, and the points it hands out before the cap."""
    fired = {name: F.when(fires, 1).otherwise(0) for name, fires in rules(settings).items()}
    totals = requests.select(*[c.alias(n) for n, c in fired.items()]).agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in fired]
    )
    return totals.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("rule"),
                        F.col(n).alias("hits"),
                        (F.col(n) * POINTS[n]).alias("points"),
                    )
                    for n in fired
                ]
            )
        ).alias("r")
    ).select("r.*")
