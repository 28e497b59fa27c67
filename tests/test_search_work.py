"""Work that searches over whole tables do once instead of once per token, text or term."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docquarry.catalog.views import chunk_view
from docquarry.functions.text import has_words, occurrences, pattern_count, word_count
from docquarry.operators.keywords import TermList
from docquarry.slots import hashed_embedding, token_buckets


def test_tokens_are_hashed_together_as_md5():
    tokens = ["", "a", "é", "abc", "abcd", "a" * 15, "b" * 16, "é" * 27, "x" * 55, "y" * 56, "z" * 64, "q" * 1000, "naïve\u0000word"] + [f"w{i}" for i in range(40_000)]
    for dim in (64, 7):
        want = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim if t else dim for t in tokens]
        assert token_buckets(pa.array(tokens), dim).tolist() == want
        assert token_buckets(pa.array(tokens).slice(5, 20), dim).tolist() == want[5:25]
    assert token_buckets(pa.array([], pa.string()), 64).tolist() == []


def test_embedding_counts_tokens_between_ascii_blanks(spark):
    texts = ["  Ab ab\x0bÉ\t", None, "", " \n", "a b c", "İx ΣΑΣ end\x1cword"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    got = dict(hashed_embedding(df.withColumn("low", F.lower("text"))).select("id", F.struct("low", "embedding")).collect())
    for i, text in enumerate(texts):
        low, vector = got[i]
        if text is None or not text.strip(" \t\n\r\x0b\x0c"):
            assert vector is None
            continue
        counts = np.zeros(64)
        for token in low.encode().split():
            counts[int(hashlib.md5(token).hexdigest()[:8], 16) % 64] += 1
        assert np.allclose(vector, counts / np.linalg.norm(counts), atol=1e-7)


def test_frequent_terms_leave_a_block_after_k_chunks(monkeypatch):
    n, k = 4000, 5
    texts = [f"the line {i} is here" + (" zebra" if i == n - 1 else "") + (" the" if i % 2 else "") + " some more words of a line" * 3 for i in range(n)]
    looked = np.zeros(3, "int64")
    plain = TermList._matches

    def matches(self, asked, windows, data, lo, hi):
        looked[asked] += hi - lo
        return plain(self, asked, windows, data, lo, hi)

    monkeypatch.setattr(TermList, "_matches", matches)
    keys = [(-1.0, i, str(i)) for i in range(n)]
    found = TermList(["the", "zebra", "line 39"])
    found.add(keys, pa.array(texts), k)
    size = sum(len(t.encode()) for t in texts)
    assert found.best == [keys[:k], [keys[-1]], sorted([keys[39], *keys[390:394]])]
    assert looked[1] == size
    assert looked[0] < size / 4 and looked[2] < size


@pytest.mark.parametrize("step", [1, 300, 1 << 16])
def test_terms_that_leave_early_miss_nothing(monkeypatch, step):
    monkeypatch.setattr("docquarry.operators.keywords.STEP", step)
    rng = np.random.default_rng(3)
    vocabulary = ["a", "ab", "aba", "über", "longer-than-eight", "longer-than-nine", "x", "b a"]
    terms, k, kept = ["a", "ab", "ü", "longer-than-", "longer-than-nine", "b a", "none"], 3, []
    found = TermList(terms)
    for block in range(6):
        texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 6))) for _ in range(40)]
        keys = sorted((-float(rng.integers(0, 3)), int(rng.integers(0, 9)), f"{block}_{i}") for i in range(40))
        kept += list(zip(keys, texts))
        found.add(keys, pa.array(texts, pa.string()), k)
    assert found.best == [sorted(key for key, text in kept if t in text)[:k] for t in terms]


def test_counts_without_patterns(spark):
    texts = ["the thé THE thethe", "", None, "éé é", " a  b\tc ", "\n x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    row = df.select("id", occurrences(F.col("t"), "the").alias("the"), occurrences(F.col("t"), "éé").alias("e"), F.regexp_count("t", F.lit("the")).alias("rx"),
                    pattern_count(F.col("t"), "the").alias("p"), pattern_count(F.col("t"), "th[eé]").alias("q"),
                    *[(has_words(F.col("t"), n) == (word_count(F.col("t")) >= n)).alias(f"n{n}") for n in (1, 2, 3, 4)]).orderBy("id").collect()
    assert [r["the"] for r in row] == [r["rx"] for r in row] == [r["p"] for r in row] == [3, 0, None, 0, 0, 0]
    assert [r["e"] for r in row] == [0, 0, None, 1, 0, 0] and row[0]["q"] == 4
    assert all(r[f"n{n}"] for r in row for n in (1, 2, 3, 4))


def test_chunk_view_lowers_a_text_once(spark, tmp_path):
    spark.createDataFrame([(1, "en", "s", "the one\nof THE two")], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = chunk_view(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lower(text") == 1 and "regexp_extract_all" not in plan
    assert [(r["company_name"], r["confidence_score"], r["policy_type"]) for r in df.collect()] == [("English", 0.2, "Article")] * 2
