"""Mixing of sources against water-filling in a loop, and the rounding against its expectation."""

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm.mixing import mix_sources, rounded_block, source_targets
from docquarry.llm.queries import QUERIES

DOCS = "doc_id bigint, source string, text string"


def looped_targets(sizes, weights=(3, 1, 2), budget=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), budget * sum(sizes.values()), set(names)
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not above:
            target.update({s: left * weight[s] / total for s in free})
            break
        for s in above:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= above
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_whole_table_against_a_loop(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: (r.source, words(r.text)) for r in docs.select("doc_id", "source", "text").collect()}
    sizes = defaultdict(int)
    for source, n in texts.values():
        sizes[source] += n
    target = looped_targets(sizes)
    found = QUERIES["op11_mixing"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    taken = defaultdict(int)
    for r in found:
        source, n = texts[r.doc_id]
        assert (r.size, r.source_size) == (n, sizes[source]) and r.target == pytest.approx(target[source])
        assert 0 <= r.taken <= 2 * n and (n == 0 or r.taken % n == 0)
        taken[source] += r.taken
    for source, words_taken in taken.items():
        assert abs(words_taken - target[source]) <= 0.02 * target[source], source


def test_reruns_and_partitions_agree_and_the_tree_meets_the_target(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 5}", "w " * (1 + i * 7919 % 97)) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS)
    deep = [{(r.doc_id, r.copies) for r in mix_sources(d, block_rows=16, fan=3).collect()} for d in (docs, docs.repartition(13))]
    assert deep[0] == deep[1]
    by_source = mix_sources(docs, block_rows=16, fan=3).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max(F.expr("taken / size")).alias("m")).collect()
    assert all(abs(r.t - r.g) <= 97 and r.m <= 2 for r in by_source)
    assert {(r.doc_id, r.copies) for r in mix_sources(docs, block_rows=16, fan=3, seed=5).collect()} != deep[0]


def test_expectation_of_a_rounding():
    rows = [(i, s, 1, 0.3) for i, s in enumerate((40, 17, 17, 9, 5, 3, 1, 1))]
    chosen, sums = np.zeros(len(rows)), []
    for k in range(4000):
        decided, rest = rounded_block(rows, np.random.default_rng(k), True, True)
        assert rest is None and sorted(d[0] for d in decided) == list(range(len(rows)))
        for doc, size, n, more in decided:
            chosen[doc] += more
        sums.append(sum(s * m for _, s, _, m in decided))
    assert np.abs(chosen / 4000 - 0.3).max() < 0.03
    independent = np.sqrt(0.3 * 0.7 * sum(s * s for _, s, _, _ in rows))
    assert np.std(sums) < 0.75 * independent and np.mean(sums) == pytest.approx(0.3 * 93, abs=1)


def test_odd_rows(spark):
    rows = [(1, "a", "one two"), (1, "a", "one two"), (None, "a", "x y z"), (2, None, "w " * 50), (3, "b", None), (4, "b", " \t\n"), (5, "c", "w" * 100_000 + " v"), (6, "", "a b c")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("size", "target", "n", "source_no", "name", "more", "share", "_row")})
    out = mix_sources(docs)
    assert out.columns == ["doc_id", "source", "size", "source_size", "target", "copies", "taken"]
    found = out.collect()
    assert sorted(((r.doc_id, r.source, r.size) for r in found), key=str) == sorted(((d, s, words(t)) for d, s, t in rows), key=str)
    target = looped_targets({"a": 7, None: 50, "b": 0, "c": 2, "": 2})
    assert all(r.target == pytest.approx(target[r.source]) and r.taken <= 2 * r.size for r in found)
    assert mix_sources(docs.limit(0)).count() == 0
    assert source_targets(spark.createDataFrame([], "source string, source_size bigint, documents bigint")).count() == 0


def test_equal_rows_beyond_a_leaf(spark):
    docs = spark.range(5000).select(F.when(F.col("id") < 2500, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("s").alias("source"), F.lit("a b c").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(9999, "t", "a b " * 1500)], DOCS))
    out = mix_sources(docs, weights=(1, 1), block_rows=100)
    taken, target, n = out.filter("source = 's'").agg(F.sum("taken"), F.first("target"), F.count("*")).first()
    assert n == 5000 and abs(taken - target) <= 3
