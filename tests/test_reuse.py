"""Results used again by key and age, and failures that stay in their row."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from docquarry.plans import reuse
from docquarry.plans.answer import answer
from docquarry.slots import answer_prompts, hashed_embedding, isolated
from docquarry.sources import index

NOW = dt.datetime(2024, 1, 1, 12)


def test_results_are_served_by_key_and_age(spark, tmp_path):
    path = str(tmp_path / "memo")
    asked = lambda *rows: spark.createDataFrame(rows, "query_id string, namespace string, question string, k int, section string")
    seen = []

    def search(tag):
        def run(rows):
            seen.extend(sorted(r.query_id for r in rows.collect()))
            found = rows.filter("question <> 'nothing'").select("query_id", F.lit(tag).alias("chunk_id"), F.lit(0.1).alias("score"), F.explode(F.sequence(F.lit(1), "k")).alias("rank_position"))
            return found
        return run

    ask = lambda tag, minutes, *rows: sorted((r.query_id, r.chunk_id, r.rank_position, r.score) for r in reuse.search_with_memo(
        asked(*rows), path, F.lit(NOW + dt.timedelta(minutes=minutes)), search(tag), ["question", "k", "section"]).collect())
    first = ask("one", 0, ("a", "n", "x", 2, None), ("b", "n", "x", 2, None), ("c", "n", "nothing", 1, None))
    assert first == [(q, "one", r, 0.1) for q in "ab" for r in (1, 2)] and len(seen) == 2  # equal keys are computed once
    seen.clear()
    assert ask("two", 29, ("d", "n", "x", 2, None), ("e", "n", "nothing", 1, None)) == [("d", "one", 1, 0.1), ("d", "one", 2, 0.1)] and not seen
    changed = [("f", "n", "x", 1, None), ("g", "m", "x", 2, None), ("h", "n", "x", 2, "exclusions"), ("i", "n", "X", 2, None)]
    assert {r[1] for r in ask("three", 29, *changed)} == {"three"} and seen == ["f", "g", "h", "i"]
    assert {r[1] for r in ask("four", 31, ("j", "n", "x", 2, None), ("k", "n", "x", 1, None))} == {"four", "three"}
    before = reuse.read_memo(spark, path).count()
    reuse.forget_expired(spark, path, F.lit(NOW + dt.timedelta(minutes=31)))
    assert reuse.read_memo(spark, path).count() == before - 1  # "nothing" had expired, the others were made anew
    index.delete_namespaces(spark, path, F.col("namespace") == "m", key="key")
    assert reuse.read_memo(spark, path).filter("namespace = 'm'").count() == 0


def test_a_failing_row_stands_alone():
    def model(values):
        if any(v in ("bad", "worse") for v in values):
            raise ValueError("no")
        return [v.upper() for v in values][: None if len(values) < 9 else 3]

    got, errors = isolated(model, pd.Series(["a", "bad", "b", "c", "worse", "d", "e", "f", "g", "h"]))
    assert got == ["A", None, "B", "C", None, "D", "E", "F", "G", "H"] and [e for e in errors if e] == ["ValueError: no"] * 2
    assert isolated(model, pd.Series([], dtype=object)) == ([], [])


def test_answers_with_errors_and_memo(spark, tmp_path):
    chunks = spark.createDataFrame(
        [("n", f"c{i}", i, f"policy clause {i} covers hospital beds", 0.5) for i in range(4)], "namespace string, chunk_id string, chunk_index int, text string, confidence_score double")
    chunks = chunks.withColumns({c: F.lit(None).cast("string") for c in ("file_name", "policy_uin", "company_name", "policy_type", "section_type", "section_header", "chunk_type")})
    embed = lambda df, text, out: hashed_embedding(df, text, out, 16)
    vectors = embed(chunks, "text", "embedding")
    q = spark.createDataFrame([("1", "n", "policy beds"), ("2", "n", "clause broken"), ("3", "n", "policy beds")], "query_id string, namespace string, question string")

    def model(tag):
        def run(prompts):
            if any("broken" in p for p in prompts):
                raise RuntimeError("model down")
            return [f'{{"answer": "{tag}", "confidence": 0.7, "reasoning": "r", "sources": ["s"]}}' for _ in prompts]
        return run

    path = str(tmp_path / "memo")
    rows = {}
    for tag, minutes in (("first", 0), ("second", 59), ("third", 61)):
        got = answer(q, chunks, vectors, embedder=embed, answerer=model(tag), memo=path, now=F.lit(NOW + dt.timedelta(minutes=minutes)))
        rows[tag] = {r.query_id: r for r in got.collect()}
    assert [rows[t]["1"].answer for t in rows] == ["first", "first", "third"] == [rows[t]["3"].answer for t in rows]
    for t in rows:
        bad = rows[t]["2"]
        assert bad.error and bad.confidence == 0.0 and bad.answer.startswith("Error processing query: ") and "model down" in bad.reasoning and bad.sources == [] and not rows[t]["1"].error
    plain = {r.query_id: r.answer for r in answer(q, chunks, vectors, embedder=embed, answerer=model("plain")).collect()}
    assert plain["1"] == "plain" and plain["2"].startswith("Error")
    assert answer_prompts(spark.createDataFrame([], "prompt string"), model("x")).count() == 0
