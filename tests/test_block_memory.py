"""Vector tasks hold one block at a time and few products of it."""

import random

import numpy as np
import pyarrow as pa

from docquarry.operators import vectors as vec


def data(spark):
    rng = random.Random(8)
    make = lambda n: [(f"v{i:03d}", "n", [rng.uniform(-1, 1) for _ in range(6)]) for i in range(n)]
    rows, asked = make(120), make(9)
    return rows, asked, spark.createDataFrame(rows, "chunk_id string, namespace string, embedding array<float>").coalesce(1), \
        spark.createDataFrame(asked, "query_id string, namespace string, vector array<double>").coalesce(1)


def test_products_are_taken_in_parts(spark, monkeypatch):
    rows, asked, v, q = data(spark)
    monkeypatch.setattr(vec, "SCORES_AT_ONCE", 100)  # task functions carry it by value
    whole = vec.BestOf.add

    def add(self, codes, scores, ids, k):
        if scores.size > 100:
            raise ValueError("too many products at once")
        whole(self, codes, scores, ids, k)

    monkeypatch.setattr(vec.BestOf, "add", add)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(np.array([r[2] for r in asked])) @ unit(np.array([r[2] for r in rows], "float32").astype("float64")).T, 9)
    want = sorted((a[0], rows[i][0]) for a, s in zip(asked, scores) for i in np.argsort(-s)[:4])
    assert sorted((r.query_id, r.chunk_id) for r in vec.vector_top_k(q, v, 4).collect()) == want
    cells = spark.createDataFrame([(str(i), r[2]) for i, r in enumerate(rows[:5])], "cell string, centroid array<double>")
    assert sorted((r.query_id, r.chunk_id) for r in vec.cell_top_k(q, v, cells, 4, probes=5).collect()) == want


def test_blocks_are_read_without_a_copy():
    batch = pa.RecordBatch.from_arrays([pa.array([np.ones(1000).tobytes(), b""], pa.binary()), pa.array([10, 10], pa.int32())], names=["matrix", "dim"])
    before = pa.total_allocated_bytes()
    blocks = [vec._block(row, "matrix", "dim", "float64") for row in vec._rows(iter([batch]))]
    assert [b.shape for b in blocks] == [(100, 10), (0, 10)] and pa.total_allocated_bytes() - before < 8000
