"""Registered queries against their SQL, and the pipeline stage by stage."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docquarry.llm.queries import QUERIES, SQL
from docquarry.llm.store import stored

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, engine, name):
    df = QUERIES[name](spark, FOLDER)
    result = engine.execute(SQL[name])
    names = sorted(d[0] for d in result.description)
    assert names == sorted(df.columns)
    at = [[d[0] for d in result.description].index(c) for c in names]
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=repr)


def test_the_operators_and_the_pipeline_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline") == list(range(1, len(QUERIES)))
    assert "pipeline" in QUERIES


def test_native_operator_has_no_python_in_its_plan(spark):
    plan = QUERIES["op8_exact_dedup"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Pandas" not in plan and "Python" not in plan


def test_stages_keep_their_contract(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(9000, None, None, None, None), (9001, "", "en", "s", 0), (9001, "", "en", "s", 0), (None, "Some words of a text without an id.", "en", "s", 35)], docs.schema)
    extra = docs.unionByName(odd).withColumns({c: F.lit("x") for c in ("keep_id", "kept", "score", "label", "start", "item", "__id", "__spans", "__row", "__own")})
    counts, rows = [extra.count()], extra
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, rows, FOLDER))
        assert out.columns == extra.columns, name
        before = Counter(tuple(r) for r in rows.select("doc_id", "text").collect())
        after = Counter(tuple(r) for r in out.select("doc_id", "text").collect())
        assert {i for i, _ in after} <= {i for i, _ in before} and None in {i for i, _ in after}
        if name != "passages":
            assert not after - before
        counts.append(out.count())
        rows = out
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, FOLDER)
    assert packed.select("doc_id").distinct().count() == rows.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").isEmpty()


def test_rows_that_share_an_id_are_told_apart(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.createDataFrame(
        [(1, "same text here", 1), (2, "same text here", 2), (2, "a unique good text", 3), (None, "same text here", 4), (2, "same text here", 5)], "doc_id bigint, text string, __row int")
    out = stages["exact_dedup"](spark, docs, FOLDER)
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect()) == [(1, "same text here", 1), (2, "a unique good text", 3)]
    base = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(5, base, "a"), (5, base + " more", "b"), (None, base + " and", "c"), (5, "all other words in this text", "d"), (None, None, "e")], "doc_id bigint, text string, __spans string")
    kept = sorted(r[2] for r in stages["near_dedup"](spark, docs, FOLDER).collect())
    assert kept in (["a", "d", "e"], ["b", "d", "e"])  # one of the two rows of the smallest id
    cut = stages["passages"](spark, docs, FOLDER)
    assert cut.columns == docs.columns and {"d", "e"} <= {r[2] for r in cut.collect()}


def test_stages_take_an_empty_table(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows, FOLDER).count() == 0
