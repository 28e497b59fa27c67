"""Vector top-k: exact, by namespace, under metadata filters, and by cells.

Vectors and queries are packed into matrix blocks inside their own partitions.
Blocks meet in a join on the namespace, one matrix product scores a block pair,
and only the k best candidates per query and block leave the task. Scored pairs
never become rows, and a hot namespace is simply more blocks.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.scale import BROADCAST_ROWS, top_k

# Task functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_BYTES = 4 * 1024 * 1024
SCORE_DIGITS = 9
SCORES_AT_ONCE = 1_000_000  # products of a block pair that a task holds


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(column.offsets.to_numpy())
    if lengths.size and (lengths != lengths[0]).any():
        raise ValueError("vectors of different dimensions in one column")
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def _group_starts(batch: pa.RecordBatch, scope: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row order that brings equal scopes together, and where each run starts."""
    codes = np.zeros(batch.num_rows, dtype=np.int64)
    for name in scope:
        encoded = batch.column(name).dictionary_encode()
        ids = encoded.indices.fill_null(len(encoded.dictionary)).to_numpy(zero_copy_only=False)
        codes = np.unique(codes * (len(encoded.dictionary) + 1) + ids, return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
    return order, np.r_[starts, batch.num_rows]


def pack_blocks(df: DataFrame, ids: str, vector: str, scope: Sequence[str], dtype: str, extra: Sequence[str] = (),
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows to blocks of one scope each: ids, a row-major matrix and carried arrays."""
    df = df.filter(F.col(vector).isNotNull()).select(*scope, F.col(ids).cast("string").alias("ids"), vector, *extra)
    scalar = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(
        [f"{c} {scalar[c]}" for c in scope] + ["ids array<string>", "matrix binary", "dim int"]
        + [f"{c} array<{scalar[c]}>" for c in extra])
    scope, extra = list(scope), list(extra)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = _matrix(batch.column(vector)).astype(dtype, copy=False)
            step = max(1, block_bytes // max(1, rows.shape[1] * rows.itemsize))
            order, starts = _group_starts(batch, scope)
            for lo, hi in zip(starts[:-1], starts[1:]):
                for at in range(lo, hi, step):
                    take = order[at:min(at + step, hi)]
                    picked = batch.take(pa.array(take))
                    columns = [picked.column(c).slice(0, 1) for c in scope]
                    columns += [_as_list(picked.column("ids")), pa.array([rows[take].tobytes()], pa.binary()),
                                pa.array([rows.shape[1]], pa.int32())]
                    columns += [_as_list(picked.column(c)) for c in extra]
                    yield pa.RecordBatch.from_arrays(columns, names=scope + ["ids", "matrix", "dim"] + extra)

    return df.mapInArrow(pack, schema)


def _as_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Scalar]]:
    """Rows of blocks, one at a time and without a copy: a batch of them can be large."""
    for batch in batches:
        columns = {name: batch.column(name) for name in batch.schema.names}
        for i in range(batch.num_rows):
            yield {name: column[i] for name, column in columns.items()}


def _block(row: dict[str, pa.Scalar], matrix: str, dim: str, dtype: str) -> np.ndarray:
    return np.frombuffer(row[matrix].as_buffer(), dtype).reshape(-1, row[dim].as_py())


class BestOf:
    """Running k best (score, id) per list key over all blocks of a task.

    Once a key has k entries only candidates at or above its k-th score are kept,
    so the buffer stays near keys * k however many blocks pass."""

    COMPACT_AT = 500_000

    def __init__(self) -> None:
        self.codes: dict[tuple, int] = {}
        self.limits = np.zeros(0, "int64")
        self.floor = np.zeros(0)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0

    def code(self, keys: list[tuple], limits: list[int]) -> np.ndarray:
        out = np.array([self.codes.setdefault(key, len(self.codes)) for key in keys], "int64")
        grown = len(self.codes) - len(self.floor)
        if grown > 0:
            self.floor = np.r_[self.floor, np.full(grown, -np.inf)]
            self.limits = np.r_[self.limits, np.zeros(grown, "int64")]
        self.limits[out] = limits
        return out

    def add(self, codes: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
        floor = self.floor[codes]
        if scores.shape[1] > k:
            floor = np.maximum(floor, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
        row, column = np.nonzero(scores >= floor[:, None])
        self.parts.append((codes[row], scores[row, column], ids[column]))
        self.pending += len(row)
        if self.pending > self.COMPACT_AT:
            self.compact()

    def compact(self) -> None:
        if not self.parts:
            return
        codes, scores, ids = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, -scores, codes))
        codes, scores, ids = codes[order], scores[order], ids[order]
        first = np.r_[True, np.diff(codes) != 0] if len(codes) else np.zeros(0, bool)
        place = np.arange(len(codes)) - np.maximum.accumulate(np.where(first, np.arange(len(codes)), 0))
        kept = place < self.limits[codes]
        full = place == self.limits[codes] - 1
        self.floor[codes[full]] = scores[full]
        self.parts = [(codes[kept], scores[kept], ids[kept])]
        self.pending = int(kept.sum())


def score_blocks(pairs: DataFrame, k: int, keep_scope: Sequence[str] = ()) -> DataFrame:
    """Block pairs (q_ids, q_matrix, q_k, ids, matrix) to candidate rows, k per query and task."""
    keep_scope = list(keep_scope)
    scope_schema = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    schema = "query_id string, chunk_id string, score double" + "".join(f", {c} {scope_schema[c]}" for c in keep_scope)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, seen = BestOf(), {}
        for row in _rows(batches):
            if row["dim"] != row["q_dim"]:
                raise ValueError("query and vector dimensions differ")
            scope = tuple(row[c].as_py() for c in keep_scope)
            block = (hash(row["q_matrix"].as_py()), row["q_ids"][0].as_py(), scope)
            if block not in seen:
                limits = [min(k, n) for n in row["q_k"].as_py()]
                seen[block] = _unit(_block(row, "q_matrix", "q_dim", "float64")), best.code([(q, *scope) for q in row["q_ids"].as_py()], limits)
            q, codes = seen[block]
            matrix, ids = _block(row, "matrix", "dim", "float32"), row["ids"].values
            step = max(1, SCORES_AT_ONCE // len(q))
            for at in range(0, len(matrix), step):
                v = _unit(matrix[at:at + step].astype("float64"))
                best.add(codes, np.round(q @ v.T, SCORE_DIGITS) + 0.0, np.array(ids.slice(at, step).to_pylist()), k)
        best.compact()
        names = list(best.codes)
        for codes, scores, ids in best.parts:
            for at in range(0, len(codes), 50_000):
                part = slice(at, at + 50_000)
                owners = [names[c] for c in codes[part]]
                out = [pa.array([o[0] for o in owners], pa.string()), pa.array(ids[part].tolist(), pa.string()), pa.array(scores[part], pa.float64())]
                out += [pa.array([o[1 + i] for o in owners], pa.string()) for i in range(len(keep_scope))]
                yield pa.RecordBatch.from_arrays(out, names=["query_id", "chunk_id", "score"] + keep_scope)

    return pairs.mapInArrow(score, schema)


def vector_top_k(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 20,
    *,
    per_query_k: str | None = None,
    match: Callable[[DataFrame, DataFrame], Column] | None = None,
    query_scope: Sequence[str] = ("namespace",),
    vector_scope: Sequence[str] = ("namespace",),
    by_namespace: bool = False,
    salts: int = 1,
    broadcast_rows: int = BROADCAST_ROWS,
    few_queries: bool | None = None,
) -> DataFrame:
    """Exact cosine top-k per query: query_id, chunk_id, score, rank_position.

    ``queries`` has query_id, namespace, vector (and scope columns); ``vectors``
    has chunk_id, namespace, embedding. ``match`` restricts block pairs further,
    so a metadata filter is applied before any product. ``by_namespace`` keeps
    one list per (query, namespace).
    """
    # The block schemas are made of strings, so one spelling of ids is kept throughout.
    q = queries.withColumn("_k", F.least(F.col(per_query_k), F.lit(k)).cast("int") if per_query_k else F.lit(k))
    q_blocks = pack_blocks(q, "query_id", "vector", query_scope, "float64", ["_k"])
    q_blocks = q_blocks.select(*[F.col(c).alias(f"q_{c}") for c in q_blocks.columns]).withColumnRenamed("q__k", "q_k")
    v_blocks = pack_blocks(vectors, "chunk_id", "embedding", vector_scope, "float32")
    if few_queries is None:
        few_queries = queries.select("query_id").limit(broadcast_rows + 1).count() <= broadcast_rows
    side = F.broadcast(q_blocks) if few_queries else q_blocks
    condition = v_blocks["namespace"] == side["q_namespace"]
    if match is not None:
        condition = condition & match(side, v_blocks)
    pairs = v_blocks.join(side, condition)
    scored = score_blocks(pairs, k, ["namespace"] if by_namespace else [])
    keys = ["query_id", "namespace"] if by_namespace else ["query_id"]
    ranked = top_k(scored, keys, [F.col("score").desc(), F.col("chunk_id")], k, salt=F.col("chunk_id"), salts=salts)
    if per_query_k is None:
        return ranked
    limits = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col(per_query_k).alias("_k"))
    limits = F.broadcast(limits) if few_queries else limits
    return ranked.join(limits, "query_id").filter(F.col("rank_position") <= F.col("_k")).drop("_k")


def assign_cells(points: DataFrame, centroids: DataFrame, ids: str, vector: str, probes: int = 1, max_cells: int = 65_536) -> DataFrame:
    """Points with their nearest ``probes`` cells: namespace, id, vector, cell, cell_rank.

    ``centroids`` has cell and centroid; they travel as one broadcast row, so points are
    neither shuffled nor joined back. ``max_cells`` is the number of them that executors have
    the memory for; more are refused and never dropped.
    """
    if centroids.limit(max_cells + 1).count() > max_cells:
        raise ValueError(f"more than max_cells={max_cells} cells")
    table = F.sort_array(F.collect_list(F.struct(F.col("cell").cast("string").alias("cell"), F.col("centroid").cast("array<double>").alias("c"))))
    cells = centroids.agg(table.alias("t")).select(F.transform("t", lambda x: x["cell"]).alias("cells"), F.flatten(F.transform("t", lambda x: x["c"])).alias("centers"))
    blocks = pack_blocks(points.withColumn(vector, F.col(vector).cast("array<double>")), ids, vector, ["namespace"], "float64")
    joined = blocks.withColumn("_one", F.lit(1)).join(F.broadcast(cells.withColumn("_one", F.lit(1))), "_one").drop("_one")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            points_here = _block(row, "matrix", "dim", "float64")
            names = np.array(row["cells"].as_py(), dtype=object)
            centers = _unit(row["centers"].values.to_numpy(zero_copy_only=False).astype("float64", copy=False).reshape(len(names), -1))
            step = max(1, SCORES_AT_ONCE // max(len(names), probes * points_here.shape[1]))
            for at in range(0, len(points_here), step):
                here, ids_here = points_here[at:at + step], row["ids"].values.slice(at, step).to_pylist()
                similarity = np.round(_unit(here) @ centers.T, SCORE_DIGITS) + 0.0
                # A stable sort keeps the cell order (by name) among equal scores.
                best = np.argsort(-similarity, axis=1, kind="stable")[:, :probes]
                n, p = best.shape
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["namespace"].as_py()] * (n * p), pa.string()),
                    pa.array(list(np.repeat(np.array(ids_here, dtype=object), p)), pa.string()),
                    pa.ListArray.from_arrays(pa.array(np.arange(n * p + 1) * here.shape[1], pa.int32()), pa.array(np.repeat(here, p, axis=0).ravel(), pa.float64())),
                    pa.array(list(names[best.ravel()]), pa.string()),
                    pa.array(np.tile(np.arange(1, p + 1), n), pa.int32()),
                ], names=["namespace", ids, vector, "cell", "cell_rank"])

    return joined.mapInArrow(nearest, f"namespace string, {ids} string, {vector} array<double>, cell string, cell_rank int")


def cell_top_k(queries: DataFrame, vectors: DataFrame, centroids: DataFrame, k: int = 20, probes: int = 3, salts: int = 1) -> DataFrame:
    """Approximate top-k: each query is compared with the vectors of its nearest cells only.

    Cells replace the search of all vectors by probes/cells of it; with as many
    probes as cells the result is exact. Store the assigned vectors to reuse them."""
    v = assign_cells(vectors, centroids, "chunk_id", "embedding").withColumn("embedding", F.col("embedding").cast("array<float>"))
    q = assign_cells(queries, centroids, "query_id", "vector", probes)
    few = queries.select("query_id").limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return vector_top_k(
        q, v, k, query_scope=["namespace", "cell"], vector_scope=["namespace", "cell"],
        match=lambda qb, vb: vb["cell"] == qb["q_cell"], salts=salts, few_queries=few)


def fit_centroids(vectors: DataFrame, cells: int, *, vector: str = "embedding", iterations: int = 10, seed: int = 7) -> DataFrame:
    """Cell centres by distributed k-means: cell, centroid."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = vectors.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=cells, maxIter=iterations, seed=seed).fit(points)
    rows = [(str(i), [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "cell STRING, centroid ARRAY<DOUBLE>")


def pair_chunks_with_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with their vector, matched by key and not by position."""
    return chunks.join(vectors.select("namespace", "chunk_id", "embedding"), ["namespace", "chunk_id"])
