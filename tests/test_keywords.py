"""Keyword blocks against a scan, and how their cost grows with the number of terms."""

import random
import time

import pyarrow as pa

from docquarry.catalog import retrieval
from docquarry.operators import keywords
from docquarry.operators.keywords import TermList
from docquarry.operators.search import keyword_top_k

CHUNKS = "namespace string, chunk_id string, confidence_score double, chunk_index int, text string"


def best_of(terms, blocks, k):
    found = TermList(terms)
    for block in blocks:
        rows = sorted(block)
        found.add([r[:3] for r in rows], pa.array([r[3] for r in rows]), k)
    return found.best


def test_terms_of_all_lengths_equal_a_scan(monkeypatch):
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("abñ€ ") for _ in range(n))
    blocks = [[(-rng.choice([0.1, 0.5, 1.0]), rng.randint(0, 3), f"c{b}_{i}", letters(rng.choice([0, 3, 30, 200]))) for i in range(40)] for b in range(4)]
    whole = "x".join(r[3] for b in blocks for r in b)
    terms = sorted({whole[at:at + n] for n in (1, 2, 3, 5, 7, 8, 9, 15, 17, 40) for at in (rng.randrange(len(whole) - 50) for _ in range(12))} | {"absent", "a" * 300})
    want = [sorted(r[:3] for b in blocks for r in b if t in r[3])[:5] for t in terms]
    assert best_of(terms, blocks, 5) == want
    monkeypatch.setattr(keywords, "SLICE", 64)  # terms and chunks that lie across slices
    assert best_of(terms, blocks, 5) == want


def test_a_term_does_not_span_two_chunks(spark):
    c = spark.createDataFrame([("n", "c1", 1.0, 0, "one"), ("n", "c2", 1.0, 1, "two")], CHUNKS).coalesce(1)
    q = spark.createDataFrame([("q1", "n", ["e\u0000t"]), ("q2", "n", ["ne"])], "query_id string, namespace string, terms array<string>")
    assert [(r.query_id, r.chunk_id) for r in keyword_top_k(q, c, 3).collect()] == [("q2", "c1")]


def test_time_does_not_follow_the_number_of_terms():
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    block = [(-1.0, i, f"c{i}", " ".join(letters(6) for _ in range(40))) for i in range(2000)]
    spent = {}
    for n in (200, 8000):
        terms = [letters(12) for _ in range(n)]
        best_of(terms, [block], 10)
        start = time.perf_counter()
        best_of(terms, [block], 10)
        spent[n] = time.perf_counter() - start
    assert spent[8000] < 10 * spent[200]


def test_the_first_search_of_a_fallback_runs_once(spark):
    plan = retrieval.fallback_search(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInArrow match") == 1
