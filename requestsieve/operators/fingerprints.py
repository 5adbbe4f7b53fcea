"""Fingerprint vectors: embedding, exact filtered top-k cosine search, verdict, upsert.

A search never forms query x index pairs as rows. Each task multiplies a batch of queries
with a block of the index and keeps k matches per query.

* A small index (checked) is broadcast, and queries are not shuffled at all.
* Beyond that, the unit vectors are divided among pivots (Voronoi cells). A query is compared
  with its own cell first; what it finds there bounds its search radius. By the triangle
  inequality it then needs only the cells whose lower distance bound is within that, so far-off
  cells are skipped without losing a match. A similarity floor bounds the radius from the start
  (0.92 means distance 0.4). Neighbouring cells form shards of bounded size by counted numbers,
  dense ones are cut, and each is stored once as a block. Queries are packed where they are, and
  the blocks of the index go through every task, so neither side is copied to pairs on disk.
"""

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from requestsieve.functions.signals import signal_text
from requestsieve.functions.verdicts import vector_reason, verdict
from requestsieve.session import durable
from requestsieve.settings import DEFAULTS, Settings

EMBEDDING_SIZE = 384
# Similarities are compared after rounding, so equal directions are equal in any sum order.
SIMILARITY_DIGITS = 12
# Added to every distance bound, far above rounding error and far below any real distance.
SLACK = 1e-6
# Between closer pivots rounding makes the plane bound worthless.
MIN_PIVOT_GAP = 1e-3
# Elements of one query x index product held in memory.
PRODUCT_ELEMENTS = 1_000_000
# Vector elements of one block of queries or of the index (2 MB).
BLOCK_ELEMENTS = 250_000
# Vector elements of queries that are sorted by cell before they are cut into blocks (32 MB).
SORTED_ELEMENTS = 4_000_000
# Similarities that differ by less may be equal once they are rounded.
TOLERANCE = 1e-11
# Twice the rounding error of single precision, of which a product has one for each element.
SINGLE_ERROR = 2.0**-23
# Rows that are embedded or routed at once (4 MB for each matrix of 512 columns).
ROWS_AT_ONCE = 1_000
_TOKEN = re.compile("[a-z0-9]+")

_MATCHES = "query_id {query_type}, id string, similarity double"


def embed_hashing(texts: DataFrame, column: str = "signal_text") -> DataFrame:
    """Add `vector`: hashed token counts of a text column, scaled to unit length.

    A token's place is given by the first 32 bits of its MD5, so other systems can repeat it. A
    text without tokens has the zero vector, which matches nothing. Batches are counted in arrays.
    """
    kept = [c for c in texts.columns if c != "vector"]

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            vectors = pa.array(_token_counts(batch.column("_lower").to_pylist()).ravel())
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * EMBEDDING_SIZE)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.ListArray.from_arrays(ends, vectors)],
                names=[*kept, "vector"],
            )

    schema = T.StructType(
        [*(texts.schema[c] for c in kept), T.StructField("vector", T.ArrayType(T.FloatType()))]
    )
    lower = F.lower(F.coalesce(F.col(column), F.lit("")))
    return texts.select(*kept, lower.alias("_lower")).mapInArrow(embed, schema)


@lru_cache(maxsize=50_000)
def _place(token: str) -> int:
    digest = hashlib.md5(token.encode(), usedforsecurity=False).digest()
    return int.from_bytes(digest[:4], "big") % EMBEDDING_SIZE


def _token_counts(texts: list[str]) -> np.ndarray:
    """One row for each lower-case text: counts of its tokens by place, of unit length."""
    found = [_TOKEN.findall(text) for text in texts]
    row = np.repeat(np.arange(len(found)), [len(tokens) for tokens in found])
    places = np.fromiter((_place(t) for tokens in found for t in tokens), np.int64, len(row))
    counts = np.bincount(row * EMBEDDING_SIZE + places, minlength=len(found) * EMBEDDING_SIZE)
    counts = counts.reshape(len(found), EMBEDDING_SIZE)
    norms = np.sqrt((counts * counts).sum(axis=1))
    return (counts / np.maximum(norms, 1.0)[:, None]).astype(np.float32)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that matrices made of them stay small."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


def with_signal_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("signal_text", signal_text())


def vector_digest(vector: Column) -> Column:
    """128 bits of a vector, as text; NULL for none."""
    halves = [F.hex(F.xxhash64(F.lit(seed), F.size(vector), vector)) for seed in (1, 2)]
    return F.when(vector.isNotNull(), F.concat_ws("-", *halves))


# --- exact search -----------------------------------------------------------------------


def _unit_rows(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the usable entries of a list column, and which entries those are."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    usable = lengths > 0
    if not usable.any():
        return np.empty((0, 0)), usable
    if len(set(lengths[usable])) > 1:
        raise ValueError("vectors of different lengths cannot be compared")
    values = vectors.filter(pa.array(usable)).flatten().to_numpy(zero_copy_only=False)
    matrix, norms = _scaled(values.reshape(int(usable.sum()), -1))
    good = np.isfinite(norms) & (norms > 0)
    usable[np.flatnonzero(usable)[~good]] = False
    return matrix[good], usable


def _scaled(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows at unit length, and the lengths they had."""
    matrix = matrix.astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    with np.errstate(divide="ignore", invalid="ignore"):
        return matrix / norms[:, None], norms


def _largest(block: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest similarities of each row, rounded, and their places, lowest first among
    equals. The block is overwritten."""
    np.round(block, SIMILARITY_DIGITS, out=block)
    similarity, places = np.empty((len(block), k)), np.empty((len(block), k), dtype=np.int64)
    each = np.arange(len(block))
    for j in range(k):
        top = block.argmax(axis=1)
        similarity[:, j], places[:, j] = block[each, top], top
        block[each, top] = -np.inf
    return similarity, places


def _best(queries: np.ndarray, index: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Similarity and place of the k index rows most similar to each query, lowest place first
    among equals."""
    k = min(k, len(index))
    step = max(1, PRODUCT_ELEMENTS // max(1, len(index)))
    found = [_largest(queries[n : n + step] @ index.T, k) for n in range(0, len(queries), step)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _matches(query_ids: pa.Array, ids: pa.Array, similarity: np.ndarray) -> pa.RecordBatch:
    """A row for each query and match. `ids` has them query by query; a similarity of -inf is none."""
    found = np.flatnonzero(similarity.ravel() > -np.inf)
    return pa.RecordBatch.from_arrays(
        [
            query_ids.take(pa.array(found // similarity.shape[1])),
            ids.take(pa.array(found)),
            pa.array(similarity.ravel()[found]),
        ],
        names=["query_id", "id", "similarity"],
    )


def _packed(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def _unpacked(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """The matrix whose rows a column, not empty, has as binary values."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    found = []
    for part in parts:
        if len(part):
            ends = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1]
            data = np.frombuffer(part.buffers()[2], np.uint8)[ends[0] : ends[-1]]
            found.append(data.view(kind).reshape(len(part), -1))
    return found[0] if len(found) == 1 else np.concatenate(found)


def searchable(index: DataFrame, k: int, cls: str) -> DataFrame:
    """Index rows of one class; of identical vectors only the k lowest ids can ever rank."""
    copies = Window.partitionBy("values").orderBy("id")
    return (
        index.filter(F.col("class") == cls)
        .filter(F.exists("values", lambda x: x != 0))
        .select(F.col("id").cast("string").alias("id"), "values")
        .withColumn("_copy", F.row_number().over(copies))
        .filter(F.col("_copy") <= k)
        .drop("_copy")
    )


def fingerprint_topk(
    queries: DataFrame,
    index: DataFrame,
    k: int = 3,
    cls: str = "BOT",
    min_similarity: float | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """The k most similar `cls` fingerprints of each query, exact.

    `queries` has (query_id, vector), `index` has (id, values, class). Returns
    (query_id, id, similarity, rank), rank 1 first, ties by id. Zero and NULL vectors match
    nothing. `min_similarity` drops weaker matches and narrows the search.
    """
    candidates = durable(searchable(index, k, cls))
    small = _collect_small(candidates, settings)
    if small is not None:
        matches = _search_broadcast(queries, small, k)
    else:
        matches = Cells(candidates, k, min_similarity, settings).search(queries)
    if min_similarity is not None:
        matches = matches.filter(F.col("similarity") >= min_similarity)
    best_first = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return matches.withColumn("rank", F.row_number().over(best_first)).filter(
        F.col("rank") <= k
    )


def _matches_schema(queries: DataFrame) -> str:
    return _MATCHES.format(query_type=queries.schema["query_id"].dataType.simpleString())


def _collect_small(candidates: DataFrame, settings: Settings) -> pa.Table | None:
    """The index if it is within the broadcast size, else None.

    The dimension of one row fixes how many rows may be fetched, one more is asked for, and
    getting that one means the index is too big.
    """
    first = candidates.select(F.size("values").alias("d")).head()
    if first is None:
        return candidates.limit(0).toArrow()
    most = max(1, settings.broadcast_elements // first["d"])
    if candidates.limit(most + 1).count() > most:
        return None
    return candidates.limit(most).toArrow()


def _search_broadcast(queries: DataFrame, index: pa.Table, k: int) -> DataFrame:
    batch = index.sort_by("id").combine_chunks().to_batches() or [pa.RecordBatch.from_pylist([], index.schema)]
    matrix, usable = _unit_rows(batch[0].column("values"))
    ids = batch[0].column("id").filter(pa.array(usable))
    shared = queries.sparkSession.sparkContext.broadcast((ids, matrix))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, block = shared.value
        for batch in batches:
            vectors, good = _unit_rows(batch.column("vector"))
            if len(ids) and len(vectors):
                similarity, places = _best(vectors, block, k)
                near = ids.take(pa.array(places.ravel()))
                yield _matches(batch.column("query_id").filter(pa.array(good)), near, similarity)

    return queries.select("query_id", "vector").mapInArrow(search, _matches_schema(queries))


# --- search by cells --------------------------------------------------------------------


def _pick_pivots(candidates: DataFrame, count: int) -> np.ndarray:
    """`count` vectors spread over the index by the hash of their ids. A fixed-size list."""
    spread = candidates.orderBy(F.xxhash64("id"), "id").limit(count).select("values")
    vectors = [_unit_rows(b.column("values"))[0] for b in spread.toArrow().to_batches()]
    return np.unique(np.concatenate([v for v in vectors if len(v)]), axis=0)


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (vectors @ pivots.T)))


def _needed_cells(
    distances: np.ndarray,
    pivot_gaps: np.ndarray,
    sizes: np.ndarray,
    radii: np.ndarray,
    reach: np.ndarray,
) -> np.ndarray:
    """Which cells may hold a vector within `reach` of each query (a boolean matrix).

    Lower bounds: the ball round the pivot, and the plane between the query's own cell and
    another.
    """
    rows = np.arange(len(distances))
    home = distances.argmin(axis=1)
    gaps = pivot_gaps[home]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (distances**2 - distances[rows, home][:, None] ** 2) / (2.0 * gaps)
    plane = np.where(gaps > MIN_PIVOT_GAP, plane, 0.0)
    nearest = np.maximum(distances - radii, plane)
    return (nearest <= reach[:, None] + SLACK) & (sizes > 0)


class Cells:
    """An index divided among pivots, and the search in it in two passes.

    First each query is compared with the cell it is nearest to. The k-th best similarity found
    there bounds how far better ones can be, and with it, or the floor if that is higher, the
    second pass visits only the other cells that reach so near. Both are exact.

    The index is stored once, in blocks: a shard of neighbouring cells up to a bounded size, or a
    part of one cell that is larger. A task holds the queries of one partition, in blocks, and
    the blocks of the index that they need pass through it, one at a time. So disk grows with the
    queries and with the index but not with their product, and a query leaves k matches.
    """

    def __init__(self, candidates: DataFrame, k: int, min_similarity: float | None, settings: Settings):
        self.k = k
        context = candidates.sparkSession.sparkContext
        pivots = _pick_pivots(candidates, settings.pivots)
        # Pivots in the order of their main direction, so a shard's cells are near each other.
        pivots = pivots[np.argsort(pivots @ np.linalg.svd(pivots, full_matrices=False)[2][0], kind="stable")]
        pivot_gaps = _distances(pivots, pivots)
        np.fill_diagonal(pivot_gaps, 0.0)
        self.pivots = context.broadcast((pivots, pivot_gaps))
        self.floor = -1.0 if min_similarity is None else min_similarity
        most = max(1, BLOCK_ELEMENTS // pivots.shape[1])
        self.block_rows = min(most, settings.queries_per_shard)
        element = candidates.schema["values"].dataType.elementType
        self.kind = np.float32 if isinstance(element, T.FloatType) else np.float64
        placed = self._placed(candidates)
        # One row per pivot at most.
        counts = placed.groupBy("cell").count().toPandas()
        sizes = np.zeros(len(pivots), dtype=np.int64)
        sizes[counts["cell"]] = counts["count"]
        first, parts = _shards(sizes, min(most, settings.vectors_per_shard))
        self.blocks = durable(self._blocks(placed, first, parts))
        # Of the blocks as they are stored; one row per pivot at most.
        held = self.blocks.select(F.explode(F.arrays_zip("cells", "radii")).alias("held"))
        radius = held.groupBy("held.cells").agg(F.max("held.radii").alias("radius")).toPandas()
        radii, sizes = np.zeros(len(pivots)), np.zeros(len(pivots), dtype=np.int64)
        radii[radius["cells"]], sizes[radius["cells"]] = radius["radius"], 1
        self.cells = context.broadcast((sizes, radii, first, parts))

    def _placed(self, candidates: DataFrame) -> DataFrame:
        shared, kind = self.pivots, self.kind

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, _ = shared.value
            for batch in _slices(batches):
                vectors, good = _unit_rows(batch.column("values"))
                if len(vectors):
                    distances = _distances(vectors, centres)
                    cells = distances.argmin(axis=1)
                    kept = batch.filter(pa.array(good))
                    values = kept.column("values").flatten().to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(cells.astype(np.int32)),
                            pa.array(distances[np.arange(len(cells)), cells]),
                            kept.column("id"),
                            _packed(values.astype(kind).reshape(vectors.shape)),
                        ],
                        names=["cell", "distance", "id", "vector"],
                    )

        return candidates.mapInArrow(place, "cell int, distance double, id string, vector binary")

    def _blocks(self, placed: DataFrame, first: np.ndarray, parts: np.ndarray) -> DataFrame:
        """A row for each shard: its cells, how many vectors each has and how far they reach, and
        the vectors by cell and id, as they came."""
        kind = self.kind

        def pack(shard: pa.Table) -> pa.Table:
            order = [("cell", "ascending"), ("id", "ascending")]
            shard = shard.take(pc.sort_indices(shard, order, null_placement="at_start"))
            cells, begins, counts = np.unique(
                shard.column("cell").to_numpy(), return_index=True, return_counts=True
            )
            radii = np.maximum.reduceat(shard.column("distance").to_numpy(), begins)
            vectors = _packed(_unpacked(shard.column("vector"), kind).reshape(1, -1))
            row = [cells, counts.astype(np.int32), radii, shard.column("id").combine_chunks()]
            return pa.Table.from_arrays(
                [shard.column("shard").slice(0, 1), *map(_one_list, row), vectors],
                names=["shard", "cells", "counts", "radii", "ids", "vectors"],
            )

        def of(counts: np.ndarray) -> Column:
            return F.element_at(F.lit(counts.tolist()), F.col("cell") + 1).cast("long")

        own = of(first) + F.pmod(F.xxhash64("id", "vector"), of(parts))
        return placed.withColumn("shard", own.cast("int")).groupBy("shard").applyInArrow(
            pack,
            "shard int, cells array<int>, counts array<int>, radii array<double>, "
            "ids array<string>, vectors binary",
        )

    def _query_blocks(self, queries: DataFrame) -> DataFrame:
        """The queries of each partition in blocks, by their nearest cell that is not empty.

        Beside ids and vectors a block has its queries' own cells, similarities that their k-th
        best surely reaches, and the cells they may need, as bits. Two rows more for each partition
        name the shards of its queries' own cells, and of all that they may need.
        """
        pivots, cells, k, floor, size = self.pivots, self.cells, self.k, self.floor, self.block_rows

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, gaps = pivots.value
            sizes, radii, first, parts = cells.value
            visited = np.zeros((2, len(centres)), dtype=bool)

            def prepared(batch: pa.RecordBatch) -> tuple[pa.Array | np.ndarray, ...]:
                vectors, good = _unit_rows(batch.column("vector"))
                if not len(vectors):
                    return ()
                distances = _distances(vectors, centres)
                home = np.where(sizes > 0, distances, np.inf).argmin(axis=1)
                reached = np.full(len(vectors), floor)
                if len(centres) >= k:
                    # Pivots are vectors of the index too.
                    nearest = np.partition(distances, k - 1, axis=1)[:, k - 1]
                    reached = np.maximum(reached, 1.0 - nearest**2 / 2.0)
                reached -= TOLERANCE
                needed = _needed_cells(distances, gaps, sizes, radii, _reach(reached))
                visited[0, home] = True
                visited[1] |= needed.any(axis=0)
                ids = batch.column("query_id").filter(pa.array(good))
                return ids, vectors, home.astype(np.int32), reached, np.packbits(needed, axis=1)

            def blocks(held: list[tuple]) -> Iterator[pa.RecordBatch]:
                ids = pa.concat_arrays([h[0] for h in held])
                vectors, home, reached, needed = (np.concatenate([h[n] for h in held]) for n in range(1, 5))
                order = home.argsort(kind="stable")
                for start in range(0, len(order), size):
                    rows = order[start : start + size]
                    lists = map(_one_list, (ids.take(pa.array(rows)), home[rows], reached[rows]))
                    matrices = (_packed(m[rows].reshape(1, -1)) for m in (vectors, needed))
                    yield pa.RecordBatch.from_arrays(
                        [*lists, *matrices, pa.nulls(1, pa.bool_()), pa.nulls(1, pa.list_(pa.int32()))],
                        names=names,
                    )

            held, count = [], 0
            for batch in _slices(batches):
                if some := prepared(batch):
                    held.append(some)
                    count += len(some[0])
                    if count * centres.shape[1] >= SORTED_ELEMENTS:
                        yield from blocks(held)
                        held, count = [], 0
            if held:
                yield from blocks(held)
            if visited.any():
                shards = _routed(pa.array([0, 1]), np.empty((2, 0)), visited, first, parts).column("shards")
                none = [pa.nulls(2, kind) for kind in kinds]
                yield pa.RecordBatch.from_arrays([*none, pa.array([True, False]), shards], names=names)

        id_type = queries.schema["query_id"].dataType
        schema = T.StructType(
            [
                T.StructField("query_ids", T.ArrayType(id_type)),
                T.StructField("home", T.ArrayType(T.IntegerType())),
                T.StructField("reached", T.ArrayType(T.DoubleType())),
                T.StructField("units", T.BinaryType()),
                T.StructField("needed", T.BinaryType()),
                T.StructField("at_home", T.BooleanType()),
                T.StructField("shards", T.ArrayType(T.IntegerType())),
            ]
        )
        names, kinds = schema.fieldNames(), [f.type for f in to_arrow_schema(schema)][:5]
        return queries.select("query_id", "vector").mapInArrow(pack, schema)

    def search(self, queries: DataFrame) -> DataFrame:
        """The k best of each query.

        Tasks are the partitions of the queries. Each is sent its own blocks and then those of the
        index, first the ones with its queries' own cells and then all that they may need.
        """
        pivots, cells, k, kind = self.pivots, self.cells, self.k, self.kind
        own, other = (self.blocks.withColumn("pass", F.lit(home)) for home in (True, False))
        # One row without a pass, which meets the queries.
        start = self.blocks.sparkSession.range(1, numPartitions=1).select(
            *(F.lit(None).cast(f.dataType).alias(f.name) for f in own.schema)
        )
        needed = F.col("shard").isNull() | F.array_contains("shards", F.col("shard"))
        pairs = (
            start.unionByName(own).unionByName(other).coalesce(1)
            .hint("shuffle_replicate_nl")
            .crossJoin(self._query_blocks(queries))
            .filter(F.col("pass").eqNullSafe(F.col("at_home")) & needed)
            .select("pass", "cells", "counts", "ids", "vectors", "query_ids", "home", "reached", "units", "needed")
        )

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, gaps = pivots.value
            sizes, radii, _, _ = cells.value
            found: list[_Found] = []
            early: list[pa.RecordBatch] = []
            rows = (batch.slice(n, 1) for batch in batches for n in range(batch.num_rows))
            for row in chain(rows, early):
                at_home = row.column("pass")[0].as_py()
                if at_home is None:
                    found.append(_Found(row, k, centres.shape[1]))
                    continue
                if not found:
                    # Spark keeps the order of a union, but nothing depends on it.
                    early.append(row)
                    continue
                vectors, _ = _scaled(_unpacked(row.column("vectors"), kind).reshape(-1, centres.shape[1]))
                ids, singles, begin = row.column("ids").flatten(), vectors.astype(np.float32), 0
                counts = row.column("counts").flatten().to_pylist()
                for cell, count in zip(row.column("cells").flatten().to_pylist(), counts, strict=True):
                    of = slice(begin, begin + count)
                    begin += count
                    for each in found:
                        if not at_home:
                            each.narrow(centres, gaps, sizes, radii)
                        each.improve(each.rows(cell, at_home), vectors[of], singles[of], ids[of])
            for each in found:
                yield _matches(each.query_ids, pa.array(each.ids.ravel(), pa.string()), each.similarity)

        return durable(pairs.mapInArrow(compare, _matches_schema(queries)))


class _Found:
    """What a block of queries has found so far, and the cells that it may still need."""

    def __init__(self, row: pa.RecordBatch, k: int, size: int):
        # Copies, as what Arrow returns here would keep the whole batch.
        self.home = np.array(row.column("home").flatten())
        self.query_ids = row.column("query_ids").flatten().take(pa.array(np.arange(len(self.home))))
        self.reached = np.array(row.column("reached").flatten())
        self.units = _unpacked(row.column("units"), np.float64).reshape(-1, size).copy()
        self.needed = _unpacked(row.column("needed"), np.uint8).reshape(len(self.home), -1).copy()
        self.similarity = np.full((len(self.home), k), -np.inf)
        self.ids = np.full((len(self.home), k), None, dtype=object)
        self.narrowed = False

    def narrow(self, centres: np.ndarray, gaps: np.ndarray, sizes: np.ndarray, radii: np.ndarray) -> None:
        """Keep only cells that may hold something as good as what was found at home."""
        if not self.narrowed:
            distances = _distances(self.units, centres)
            needed = _needed_cells(distances, gaps, sizes, radii, _reach(self.reached))
            self.needed &= np.packbits(needed, axis=1)
            self.narrowed = True

    def rows(self, cell: int, at_home: bool) -> np.ndarray:
        """The queries to be compared with a cell in the first pass, or in the second."""
        if at_home:
            return np.flatnonzero(self.home == cell)
        needed = (self.needed[:, cell >> 3] >> (7 - (cell & 7))) & 1
        return np.flatnonzero(needed.astype(bool) & (self.home != cell))

    def improve(self, rows: np.ndarray, index: np.ndarray, singles: np.ndarray, ids: pa.Array) -> None:
        """Compare some queries with vectors of the index, sorted by id, and keep the k best.

        Products of single precision tell which queries may have a similarity as high as their
        k-th best so far; only for those it is computed, rounded and ranked.
        """
        k, error = self.similarity.shape[1], SINGLE_ERROR * (index.shape[1] + 8)
        step = max(1, PRODUCT_ELEMENTS // len(index))
        for start in range(0, len(rows), step):
            some = rows[start : start + step]
            near = (self.units[some].astype(np.float32) @ singles.T).max(axis=1)
            some = some[near >= self.reached[some] - error]
            if len(some):
                similarity, places = _largest(self.units[some] @ index.T, min(k, len(index)))
                self._keep(some, similarity, ids.take(pa.array(places.ravel())))

    def _keep(self, some: np.ndarray, similarity: np.ndarray, ids: pa.Array) -> None:
        """The k best of what some queries had and of what is new, ties by id as Spark sorts them."""
        k = self.similarity.shape[1]
        ids = ids.to_numpy(zero_copy_only=False).reshape(similarity.shape)
        similarity = np.concatenate([self.similarity[some], similarity], axis=1)
        ids = np.concatenate([self.ids[some], ids], axis=1)
        rank = pc.rank(pa.array(ids.ravel(), pa.string()), null_placement="at_start", tiebreaker="dense")
        order = np.lexsort((rank.to_numpy().reshape(ids.shape), -similarity), axis=1)[:, :k]
        self.similarity[some] = np.take_along_axis(similarity, order, axis=1)
        self.ids[some] = np.take_along_axis(ids, order, axis=1)
        self.reached[some] = np.maximum(self.reached[some], self.similarity[some, k - 1] - TOLERANCE)


def _reach(similarity: np.ndarray) -> np.ndarray:
    """The distance of unit vectors that are so similar."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * similarity))


def _one_list(values: pa.Array | np.ndarray) -> pa.Array:
    """A list column of one row."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _shards(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first shard of each cell and the number of its shards: runs of cells that hold `most`
    vectors together share one, larger cells have their own."""
    first, parts = np.zeros(len(sizes), dtype=np.int64), np.maximum(1, -(-sizes // most))
    shard, held = 0, 0
    for cell, n in enumerate(sizes):
        if held and held + n > most:
            shard, held = shard + 1, 0
        first[cell] = shard
        if n > most:
            shard += int(parts[cell])
        else:
            held += int(n)
    return first, parts


def _routed(
    ids: pa.Array, vectors: np.ndarray, needed: np.ndarray, first: np.ndarray, parts: np.ndarray
) -> pa.RecordBatch:
    """Queries, or blocks of them, with the cells they need as bits and the shards of those."""
    row, cell = np.nonzero(needed)
    count = parts[cell]
    ahead = np.repeat(np.cumsum(count) - count, count)
    shard = np.repeat(first[cell], count) + np.arange(int(count.sum())) - ahead
    total = int((first + parts).max())
    pairs = np.unique(np.repeat(row, count) * total + shard)
    ends = np.concatenate([[0], np.cumsum(np.bincount(pairs // total, minlength=len(vectors)))])
    shards = pa.ListArray.from_arrays(
        pa.array(ends.astype(np.int32)), pa.array((pairs % total).astype(np.int32))
    )
    return pa.RecordBatch.from_arrays(
        [ids, _packed(vectors), _packed(np.packbits(needed, axis=1)), shards],
        names=["query_id", "unit", "cells", "shards"],
    )


def _bits(column: pa.Array | pa.ChunkedArray, count: int) -> np.ndarray:
    return np.unpackbits(_unpacked(column, np.uint8), axis=1, count=count).astype(bool)


# --- verdict and upsert -----------------------------------------------------------------


def vector_verdict(similarity: Column, settings: Settings = DEFAULTS) -> Column:
    """A BOT verdict if the best similarity reaches the threshold; NULL otherwise."""
    return F.when(
        similarity >= settings.similarity,
        verdict(similarity, F.lit("BOT"), "VECTOR", vector_reason(similarity)),
    )


def vector_verdicts(
    queries: DataFrame, index: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """(query_id, match_id, verdict) for queries whose best BOT match reaches the threshold."""
    best = fingerprint_topk(
        queries, index, k=1, min_similarity=settings.similarity, settings=settings
    )
    return best.select(
        "query_id",
        F.col("id").alias("match_id"),
        vector_verdict(F.col("similarity"), settings).alias("vector"),
    )


def fingerprint_id(ip: Column, ts_ms: Column) -> Column:
    return F.concat(F.lit("ip_"), ip, F.lit("_"), ts_ms.cast("string"))


def new_fingerprints(classified: DataFrame) -> DataFrame:
    """Fingerprints to store: model verdicts of any class; the last row of an id wins.

    `classified` needs `vector` besides the classified columns.
    """
    row = F.struct(
        F.col("vector").alias("values"), "ip", "class", "score", "ts_ms", "country"
    )
    return (
        classified.filter(F.col("source") == "AI")
        .filter(F.col("vector").isNotNull())
        .groupBy(fingerprint_id(F.col("ip"), F.col("ts_ms")).alias("id"))
        .agg(F.max_by(row, "request_id").alias("f"))
        .select("id", "f.*")
    )


def upsert_fingerprints(index: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """The index after an upsert: a fresh row replaces a stored one with its id."""
    if index is None:
        return fresh
    columns = fresh.columns
    kept = index.join(fresh.select("id"), "id", "left_anti").select(*columns)
    return kept.unionByName(fresh)
