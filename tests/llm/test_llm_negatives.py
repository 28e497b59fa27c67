"""Hard negatives against a loop over all rows; the curve, the bounds and the blocks left out."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import negatives
from docquarry.llm.negatives import hard_negatives, hilbert_keys, interval_bounds, product

ROWS = "chunk_id bigint, category int, embedding array<float>"


def looped(rows, asked, k=5):
    def usable(row):
        return row[0] is not None and row[1] is not None and row[2] is not None and all(x is not None and math.isfinite(x) for x in row[2])

    def scored(a):
        q = [math.floor(256 * float(np.float32(x))) for x in a[2]]
        return [(-sum(x * math.floor(256 * float(np.float32(y))) for x, y in zip(q, r[2])), r[0], r[1]) for r in rows if usable(r) and r[0] != a[0]]

    out = []
    for a in filter(usable, asked):
        all_rows = sorted(scored(a))
        for s, i, _ in [x for x in all_rows if x[2] == a[1]][:k]:
            near = [x for x in all_rows if x[2] != a[1] and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(a[0], i, n + 1, x[1], -s, -x[0]) for n, x in enumerate(near)]
    return sorted(out)


def clustered(rng, n, dimensions=6, groups=8):
    centres = [[rng.gauss(0, 1) for _ in range(dimensions)] for _ in range(groups)]
    return [(i, rng.randrange(3), [c + rng.gauss(0, 0.1) for c in centres[rng.randrange(groups)]]) for i in range(n)]


@pytest.mark.parametrize("dimensions,bits", [(2, 4), (3, 2), (4, 2)])
def test_the_curve_visits_every_cell_in_single_steps(dimensions, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions), -1).reshape(-1, dimensions)
    keys = hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_bounds_hold_and_products_are_exact():
    rng = np.random.default_rng(2)
    x, q = rng.integers(-300, 300, (50, 7)), rng.integers(-300, 300, (9, 7))
    low, high = interval_bounds(q, x.min(0)[None], x.max(0)[None])
    assert (low <= (q @ x.T).min(1)[:, None]).all() and (high >= (q @ x.T).max(1)[:, None]).all()
    big = np.array([[1 << 30, 3]]), np.array([[(1 << 30) + 1, 5]])
    assert product(*big).tolist() == [[(1 << 60) + (1 << 30) + 15]]


def test_against_a_loop_over_small_blocks_and_odd_rows(spark, monkeypatch):
    rng = random.Random(4)
    rows = clustered(rng, 400) + [(1000 + i, 1, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0]) for i in range(90)]
    rows += [(7, 2, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (7, 2, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (None, 1, [1.0] * 6), (2000, None, [1.0] * 6), (2001, 1, None), (2002, 1, [1.0, None]), (2003, 1, [float("nan")] * 6), (2004, 1, [float("inf")] * 6)]
    rows += [(2005, 1, []), (2006, 2, [0.5]), (2007, 9, [0.1] * 6), (2008, 1, [3e4] * 6)]
    asked = [r for r in rows if r[0] is not None and (r[0] % 20 == 0 or r[0] in (7, 1003, 2005, 2006, 2007, 2008))]
    frame = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit("x") for c in ("tile", "part", "score", "vector", "place")}).repartition(4)
    expected = looped(rows, [r for i, r in enumerate(asked) if r not in asked[:i]])
    for name, value in (("TILE_ROWS", 8), ("ZONES", 2), ("TILES_HELD", 1)):
        monkeypatch.setattr(negatives, name, value)
    found = hard_negatives(frame, spark.createDataFrame(asked, ROWS), block_rows=16)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in found.collect()) == expected and len(expected) > 100


def test_blocks_out_of_reach_are_not_read(spark, monkeypatch):
    rows = [(i, c, (np.array(v) / np.linalg.norm(v)).tolist()) for i, c, v in clustered(random.Random(5), 1500, groups=30)]
    frame = spark.createDataFrame(rows, ROWS)
    asked, pairs = [r for r in rows if r[0] % 300 == 0], []
    monkeypatch.setattr(negatives, "TILE_ROWS", 1)
    scan = negatives.scan
    monkeypatch.setattr(negatives, "scan", lambda w, t, b, p, same, k: pairs.append((p.count(), b.count() * t.count())) or scan(w, t, b, p, same, k))
    found = hard_negatives(frame, spark.createDataFrame(asked, ROWS), block_rows=25)
    assert sorted(tuple(r) for r in found.collect()) == looped(rows, asked)
    (nearest, every), (near, _), (far, _) = pairs
    assert nearest <= len(asked) and near < every / 2 and far < every


def test_empty_tables(spark):
    rows = spark.createDataFrame([(1, 1, [1.0]), (2, 2, [1.0])], ROWS)
    assert hard_negatives(rows.limit(0), rows).count() == 0
    assert hard_negatives(rows, rows.limit(0)).count() == 0
    assert hard_negatives(rows.limit(0), rows.limit(0)).count() == 0
