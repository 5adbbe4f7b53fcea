"""Every query against its SQL equivalent in DuckDB."""

import hashlib

import duckdb
import pytest
from conftest import DATA

from requestsieve.catalog import QUERIES
from requestsieve.operators.fingerprints import embed_hashing
from requestsieve.oracles import ORACLES

SF_DIR = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in ("events", "pages", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def _comparable(rows):
    def value(v):
        return round(v, 9) if isinstance(v, float) else v

    return sorted((tuple(value(v) for v in row) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    cursor = duck.execute(ORACLES[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    order = [found.index(c) for c in columns]
    expected = [[row[i] for i in order] for row in cursor.fetchall()]
    assert _comparable(expected) == _comparable(df.select(*columns).collect())


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


def test_embedding_is_unit_length_and_empty_texts_match_nothing(spark):
    texts = [("ua:curl/8 | path:/A?b=1 | a a a",), ("",), (None,), ("- | é",)]
    found = embed_hashing(spark.createDataFrame(texts, "signal_text string")).collect()
    assert all(len(r.vector) == 384 for r in found)
    norms = [sum(x * x for x in r.vector) for r in found]
    assert norms == [pytest.approx(1.0, abs=1e-5), 0, 0, 0]
    place = int(hashlib.md5(b"a").hexdigest()[:8], 16) % 384
    # Four of the tokens are "a"; upper case does not matter.
    counts = sorted(round(x / min(y for y in found[0].vector if y), 3) for x in found[0].vector if x)
    assert found[0].vector[place] == max(found[0].vector) and counts[-1] == 4
