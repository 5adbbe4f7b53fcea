"""Request signals, read from the URL, the headers and the connection metadata."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from requestsieve.functions.text import first_filled, is_filled, true_false

# Scheme and authority, then everything up to the fragment.
_AFTER_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)"

MINUTE_MS = 60_000


def normalize_headers(headers: Column) -> Column:
    """Lower-case names; values of names that differ only in case are joined with ', '.

    Most header maps are lower-case already, and nearly all others have no such names, so the
    pairwise work is left to the rest.
    """
    names_text = F.array_join(F.map_keys(headers), ",")
    lowered = F.transform(F.map_keys(headers), F.lower)
    return (
        F.when(names_text == F.lower(names_text), headers)
        .when(
            F.size(F.array_distinct(lowered)) == F.size(headers),
            F.transform_keys(headers, lambda name, _: F.lower(name)),
        )
        .otherwise(_merge_headers(headers))
    )


def _merge_headers(headers: Column) -> Column:
    entries = F.map_entries(headers)
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))

    def joined(name: Column) -> Column:
        same = F.filter(entries, lambda e: F.lower(e["key"]) == name)
        values = F.array_join(F.transform(same, lambda e: e["value"]), ", ")
        return F.struct(name.alias("key"), values.alias("value"))

    return F.map_from_entries(F.transform(names, joined))


def header_key_list(headers: Column) -> Column:
    return F.array_join(F.sort_array(F.map_keys(headers)), ",")


def client_ip(headers: Column) -> Column:
    return first_filled(
        headers["cf-connecting-ip"], headers["x-forwarded-for"], default="0.0.0.0"
    )


def country(headers: Column, cf_country: Column) -> Column:
    return first_filled(cf_country, headers["cf-ipcountry"], default="XX")


def request_path(url: Column) -> Column:
    """Path and query without the fragment; an empty path is '/', a lone '?' is dropped."""
    rest = F.regexp_extract(url, _AFTER_AUTHORITY, 1)
    rooted = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.regexp_replace(rooted, r"^([^?]*)\?$", "$1")


def path_name(url: Column) -> Column:
    return F.substring_index(request_path(url), "?", 1)


def minute_bucket(ts_ms: Column) -> Column:
    return F.floor(ts_ms / F.lit(MINUTE_MS)).cast("long")


def extract_signals(requests: DataFrame) -> DataFrame:
    """One row of signals per raw request; narrow, so it stays in the scan stage."""
    with_headers = requests.withColumn(
        "headers",
        normalize_headers(F.coalesce("headers", F.create_map().cast("map<string,string>"))),
    )
    headers = F.col("headers")
    return with_headers.select(
        "request_id",
        "ts_ms",
        client_ip(headers).alias("ip"),
        country(headers, F.col("cf_country")).alias("country"),
        F.coalesce(headers["user-agent"], F.lit("")).alias("user_agent"),
        request_path(F.col("url")).alias("path"),
        is_filled(headers["accept-language"]).alias("has_accept_lang"),
        is_filled(headers["referer"]).alias("has_referer"),
        is_filled(F.col("cf_tls_version")).alias("has_tls"),
        header_key_list(headers).alias("header_keys"),
    )


def signal_text() -> Column:
    """The text that stands for a request's behaviour; needs the signals and `rate`."""
    fields = {
        "ua": F.col("user_agent"),
        "path": F.col("path"),
        "lang": true_false(F.col("has_accept_lang")),
        "ref": true_false(F.col("has_referer")),
        "tls": true_false(F.col("has_tls")),
        "rate": F.col("rate").cast("string"),
        "headers": F.col("header_keys"),
    }
    return F.concat_ws(
        " | ", *[F.concat(F.lit(f"{name}:"), value) for name, value in fields.items()]
    )
