import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from requestsieve.session import configure  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("requestsieve-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def signals(spark):
    """Build signal rows from (request_id, ts_ms, ip) and overrides of quiet defaults."""
    from requestsieve.schemas import SIGNALS

    def build(rows, **overrides):
        defaults = {
            "country": "US",
            "user_agent": "Mozilla/5.0",
            "path": "/",
            "has_accept_lang": True,
            "has_referer": True,
            "has_tls": True,
            "header_keys": "accept-language,referer,user-agent",
        }
        filled = []
        for row in rows:
            i, ts, ip, *own = row
            values = defaults | overrides | (own[0] if own else {})
            filled.append({"request_id": i, "ts_ms": ts, "ip": ip} | values)
        data = [tuple(r[c] for c in SIGNALS.fieldNames()) for r in filled]
        return spark.createDataFrame(data, SIGNALS)

    return build


def plan_text(df):
    return df._jdf.queryExecution().toString()
