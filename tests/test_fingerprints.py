import math
import random

import numpy as np
import pyarrow as pa
import pytest

from requestsieve.operators import fingerprints
from requestsieve.operators.fingerprints import (
    _Found,
    _bits,
    _routed,
    _shards,
    embed_hashing,
    fingerprint_topk,
    new_fingerprints,
    upsert_fingerprints,
    vector_verdicts,
)
from requestsieve.settings import Settings

# Everything is beyond the broadcast size, and cells are cut into several shards.
CELLS = Settings(broadcast_elements=1, pivots=8, vectors_per_shard=10, queries_per_shard=15)

INDEX = "id string, values array<float>, class string"
QUERY = "query_id long, vector array<double>"


def clustered(count, size, seed, copies=0):
    """Vectors round a few centres; the last `copies` are all the same."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(6)]
    out = []
    for k in range(count):
        centre = centres[k % 6]
        out.append([float(np.float32(c + rng.gauss(0, 0.15))) for c in centre])
    for k in range(count - copies, count):
        out[k] = out[count - 1]
    return out


def brute_force(queries, index, k, floor=None):
    out = {}
    for qid, q in queries:
        q = np.asarray(q, dtype=float)
        scored = []
        for vid, v, cls in index:
            v = np.asarray(v, dtype=np.float32).astype(float)
            if cls == "BOT" and np.linalg.norm(v) > 0 and np.linalg.norm(q) > 0:
                s = round(float(q @ v / (np.linalg.norm(q) * np.linalg.norm(v))), 9)
                if floor is None or s >= floor:
                    scored.append((-s, vid))
        for rank, (s, vid) in enumerate(sorted(scored)[:k], 1):
            out[qid, rank] = (vid, -s)
    return out


def searched(spark, queries, index, k, floor=None, settings=Settings()):
    found = fingerprint_topk(
        spark.createDataFrame(queries, QUERY),
        spark.createDataFrame(index, INDEX),
        k=k,
        min_similarity=floor,
        settings=settings,
    ).collect()
    return {(r.query_id, r["rank"]): (r.id, round(r.similarity, 9)) for r in found}


@pytest.mark.parametrize("settings", [Settings(), CELLS], ids=["broadcast", "cells"])
@pytest.mark.parametrize("k, floor", [(1, 0.92), (3, None), (3, 0.8)])
@pytest.mark.parametrize("copies", [0, 40])
def test_search_equals_brute_force(spark, settings, k, floor, copies):
    vectors = clustered(120, 12, seed=5, copies=copies)
    index = [(f"{n:04d}", v, "BOT" if n % 3 else "LEGITIMATE") for n, v in enumerate(vectors)]
    queries = list(enumerate(clustered(60, 12, seed=6) + vectors[:10] + vectors[-10:]))
    assert searched(spark, queries, index, k, floor, settings) == brute_force(
        queries, index, k, floor
    )


@pytest.mark.parametrize("settings", [Settings(), CELLS], ids=["broadcast", "cells"])
def test_unstructured_vectors(spark, settings):
    rng = random.Random(7)
    make = lambda n: [[rng.gauss(0, 1) for _ in range(16)] for _ in range(n)]
    index = [(f"{n:04d}", v, "BOT") for n, v in enumerate(make(80))]
    queries = list(enumerate(make(50)))
    assert searched(spark, queries, index, 3, None, settings) == brute_force(queries, index, 3)


@pytest.mark.parametrize("settings", [Settings(), CELLS], ids=["broadcast", "cells"])
def test_zero_and_missing_vectors_match_nothing(spark, settings):
    index = [("a", [0.0, 0.0], "BOT"), ("b", None, "BOT"), ("c", [1.0, 0.0], "BOT")]
    queries = [(1, [0.0, 0.0]), (2, None), (3, [2.0, 0.0])]
    assert searched(spark, queries, index, 3, None, settings) == {(3, 1): ("c", 1.0)}


@pytest.mark.parametrize("settings", [Settings(), CELLS], ids=["broadcast", "cells"])
def test_empty_index(spark, settings):
    index = [("a", [1.0, 0.0], "LEGITIMATE")]
    assert searched(spark, [(1, [1.0, 0.0])], index, 3, None, settings) == {}


@pytest.mark.parametrize("settings", [Settings(), CELLS], ids=["broadcast", "cells"])
def test_threshold_is_inclusive(spark, settings):
    index = spark.createDataFrame([("a", [1.0, 0.0], "BOT")], INDEX)
    exact, below = 0.92, 0.919999
    queries = spark.createDataFrame(
        [(n, [c, math.sqrt(1 - c * c)]) for n, c in enumerate((exact, below))], QUERY
    )
    rows = vector_verdicts(queries, index, settings).collect()
    assert [r.query_id for r in rows] == [0]
    found = rows[0].vector
    assert (found["score"], found["class"], found["source"]) == (0.92, "BOT", "VECTOR")
    assert found["reason"].endswith("(similarity: 0.920)")


def test_queries_go_once_to_each_shard_of_their_cells():
    first, parts = _shards(np.array([4, 0, 5, 25, 3, 3, 9]), 10)
    assert list(zip(first.tolist(), parts.tolist(), strict=True)) == [
        (0, 1), (0, 1), (0, 1), (1, 3), (4, 1), (4, 1), (5, 1)
    ]
    needed = np.array([[1, 1, 1, 0, 0, 0, 0], [0, 0, 1, 1, 1, 1, 0], [0, 0, 0, 0, 0, 0, 1]], dtype=bool)
    routed = _routed(pa.array([7, 8, 9]), np.eye(3), needed, first, parts)
    assert routed.column("shards").to_pylist() == [[0], [0, 1, 2, 3, 4], [5]]
    assert (_bits(routed.column("cells"), 7) == needed).all()


def test_search_by_cells_stores_no_pairs(spark, monkeypatch):
    """Neither queries nor vectors of the index are copied for each other, and matches are few."""
    stored, plans, durable = [], [], fingerprints.durable

    def watch(rows):
        kept = durable(rows)
        stored.append(kept.count())
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return kept

    monkeypatch.setattr(fingerprints, "durable", watch)
    vectors = clustered(240, 12, seed=8)
    index = [(f"{n:04d}", v, "BOT") for n, v in enumerate(vectors)]
    queries = list(enumerate(clustered(90, 12, seed=9)))
    assert searched(spark, queries, index, 3, None, CELLS) == brute_force(queries, index, 3)
    assert max(stored) <= max(len(index), 3 * len(queries))
    search = plans[-1]
    assert "CartesianProduct" in search
    assert not any(word in search for word in ("Exchange", "Generate", "CoGroup"))


@pytest.mark.parametrize("settings", [Settings(), CELLS], ids=["broadcast", "cells"])
def test_similarities_closer_than_single_precision(spark, settings):
    index = [(f"{500 - n:04d}", [1.0, n * 1e-5, 0.0], "BOT") for n in range(1, 400)]
    index += [(f"{n:04d}", [0.0, 1.0, n * 1e-3], "BOT") for n in range(600, 640)]
    queries = [(n, [1.0, n * 1e-5 + 2e-6, 1e-7]) for n in range(0, 400, 7)]
    expected = {(q, r): i for q, r, i in exact_order(queries, index, 3)}
    found = searched(spark, queries, index, 3, None, settings)
    assert {key: row[0] for key, row in found.items()} == expected


def exact_order(queries, index, k):
    """As the search ranks: by similarity of 12 decimals, then id."""
    unit = lambda v: np.asarray(v) / np.linalg.norm(v)
    rows = [(i, unit(np.asarray(v, dtype=np.float32).astype(float))) for i, v, _ in index]
    for query_id, q in queries:
        scored = sorted((-round(float(unit(q) @ v), 12), i) for i, v in rows)
        yield from ((query_id, rank, i) for rank, (_, i) in enumerate(scored[:k], 1))


@pytest.mark.parametrize("settings", [Settings(), CELLS], ids=["broadcast", "cells"])
def test_equal_vectors_in_many_shards_rank_by_id(spark, settings):
    """A dense cell is cut into shards; ties between them go to the lowest ids."""
    rng = random.Random(3)
    index = [(f"{n:04d}", [1.0 * s, 2.0 * s, 3.0 * s], "BOT") for n, s in enumerate(rng.sample(range(1, 900), 80))]
    index += [(f"{n:04d}", [-1.0, 0.0, float(n)], "BOT") for n in range(80, 90)]
    found = searched(spark, [(n, [1.0, 2.0, 3.0]) for n in range(40)], index, 3, 0.9, settings)
    assert found == {(n, r): (f"{r - 1:04d}", 1.0) for n in range(40) for r in (1, 2, 3)}


def test_a_block_keeps_its_best_in_any_order():
    rng = np.random.default_rng(4)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    units, index = unit(rng.normal(size=(30, 6))), unit(rng.normal(size=(50, 6)))
    ids = pa.array([f"{n:02d}" for n in range(50)])
    expected = [sorted((-round(s, 12), f"{n:02d}") for n, s in enumerate(row))[:4] for row in units @ index.T]
    for order in (range(0, 50, 10), range(40, -10, -10)):
        block = pa.RecordBatch.from_pylist(
            [
                {
                    "query_ids": list(range(30)),
                    "home": [0] * 30,
                    "reached": [-1.0] * 30,
                    "units": units.tobytes(),
                    "needed": b"\xff" * 30,
                }
            ]
        )
        found = _Found(block, 4, 6)
        for start in order:
            of = slice(start, start + 10)
            found.improve(np.arange(30), index[of], index[of].astype(np.float32), ids[of])
        assert [
            [(-s, i) for s, i in zip(*row, strict=True)]
            for row in zip(found.similarity.tolist(), found.ids.tolist(), strict=True)
        ] == expected


def test_texts_are_embedded_in_batches_of_arrays(spark):
    texts = [("b", "Curl curl\u00e9 x"), (None, None), ("", "\u212a, K k")]
    found = embed_hashing(spark.createDataFrame(texts, "other string, id string"), "id")
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    rows = [(r.other, sorted(w for w in r.vector if w)) for r in found.collect()]
    one, two = (float(np.float32(n / math.sqrt(5))) for n in (1, 2))
    assert rows == [("b", [one, two]), (None, []), ("", [1.0])]
    assert all(len(r.vector) == 384 for r in found.collect())


def test_only_model_verdicts_become_fingerprints(spark):
    rows = spark.createDataFrame(
        [
            (1, "1.1.1.1", 50, "US", 0.9, "BOT", "AI", [1.0]),
            (2, "1.1.1.1", 50, "US", 0.8, "SUSPICIOUS", "AI", [2.0]),
            (3, "1.1.1.1", 60, "US", 0.1, "LEGITIMATE", "AI", [3.0]),
            (4, "2.2.2.2", 50, "US", 0.9, "BOT", "HEURISTIC", [4.0]),
            (5, "2.2.2.2", 50, "US", 0.9, "BOT", "CACHE", [5.0]),
        ],
        "request_id long, ip string, ts_ms long, country string, score double, class string, "
        "source string, vector array<float>",
    )
    fresh = new_fingerprints(rows)
    assert sorted((r.id, r["class"], r["values"]) for r in fresh.collect()) == [
        ("ip_1.1.1.1_50", "SUSPICIOUS", [2.0]),
        ("ip_1.1.1.1_60", "LEGITIMATE", [3.0]),
    ]
    stored = fresh.withColumn("score", fresh.score + 1)
    merged = upsert_fingerprints(stored, fresh.filter("ts_ms = 50")).collect()
    assert sorted((r.id, r.score) for r in merged) == [
        ("ip_1.1.1.1_50", 0.8),
        ("ip_1.1.1.1_60", 1.1),
    ]
