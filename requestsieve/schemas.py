"""Schemas of the tables the engine reads and writes."""

from pyspark.sql import types as T


_TYPES = {
    "STRING": T.StringType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "ARRAY<FLOAT>": T.ArrayType(T.FloatType()),
    "MAP<STRING,STRING>": T.MapType(T.StringType(), T.StringType()),
}


def _struct(columns: str) -> T.StructType:
    """A schema from "name TYPE, ..."; unlike DDL parsing it needs no running session."""
    pairs = [column.split() for column in columns.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


RAW_REQUEST = _struct(
    "request_id BIGINT, ts_ms BIGINT, method STRING, url STRING, "
    "headers MAP<STRING,STRING>, cf_country STRING, cf_tls_version STRING"
)

SIGNALS = _struct(
    "request_id BIGINT, ts_ms BIGINT, ip STRING, country STRING, user_agent STRING, "
    "path STRING, has_accept_lang BOOLEAN, has_referer BOOLEAN, has_tls BOOLEAN, "
    "header_keys STRING"
)

FINGERPRINT = _struct(
    "id STRING, values ARRAY<FLOAT>, ip STRING, class STRING, score DOUBLE, "
    "ts_ms BIGINT, country STRING"
)

REPUTATION = _struct(
    "ip STRING, score DOUBLE, class STRING, hits BIGINT, last_seen BIGINT"
)

LOG = _struct(
    "request_id BIGINT, ip STRING, country STRING, path STRING, user_agent STRING, "
    "score DOUBLE, class STRING, source STRING, ts_ms BIGINT"
)
LOG_COLUMNS = LOG.fieldNames()
