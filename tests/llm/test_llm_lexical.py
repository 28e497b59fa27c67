"""Ranked search against a loop over all questions and chunks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docquarry.llm import lexical
from docquarry.llm.lexical import question_tiles, ranked_search, text_terms

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def looped(questions, chunks, k=50):
    rows = [(c, Counter(terms(t))) for c, t in chunks]
    rows = [(c, t) for c, t in rows if t]
    total, words = len(rows), sum(sum(t.values()) for _, t in rows)
    df, asked, out = Counter(w for _, t in rows for w in t), {}, []
    for q, text in questions:
        asked.setdefault(q, set()).update(terms(text))
    for q, wanted in asked.items():
        scored = []
        for c, t in rows:
            m = 50 + 50 * sum(t.values()) * total // words
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (10**9 * t[w] // (1000 * t[w] + 20 * m)) for w in wanted if w in t)
            if score > 0 and c is not None:
                scored.append((-score, c))
        out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(sorted(scored)[:k])] if q is not None else []
    return sorted(out)


def words_of(rng, n):
    return " ".join(rng.choice(["Alpha", "beta", "ÄÖ", "naïve", "x1", "x2", "the", "über-all", "z_z", "日本", "é"]) + str(rng.choice(["", "", 1, 7])) for _ in range(n))


def test_terms_are_those_of_the_pattern():
    rng = random.Random(3)
    texts = [None, "", "A.b", "-", "Straße\x00İ!\x7f9", "\n\t", *("".join(chr(rng.choice([rng.randrange(128), rng.randrange(1, 0xD7FF), 0x1F600])) for _ in range(60)) for _ in range(50))]
    found, first = text_terms(pa.array(texts))
    found = [bytes(t).decode() for t in found.to_pylist()]
    assert [found[a:b] for a, b in zip(first, first[1:])] == [terms(t) for t in texts]


def test_against_a_loop_in_several_passes_and_tiles(spark, monkeypatch):
    rng = random.Random(1)
    chunks = [(i, words_of(rng, rng.randrange(40))) for i in range(300)] + [(1000 + i, "beta the beta") for i in range(80)] + [(5, "alpha x1"), (None, "alpha beta"), (900, None), (901, ""), (902, "!"), (903, "x1 " * 60_000)]
    questions = [(i, words_of(rng, rng.randrange(1, 9))) for i in range(30)] + [(3, "beta unseen"), (40, None), (41, ""), (42, "unseen"), (None, "beta"), (43, "beta")]
    c = spark.createDataFrame(chunks, "chunk_id bigint, text string").withColumns({x: F.lit("x") for x in ("n", "terms", "counts", "score", "query_id")}).repartition(5)
    q = spark.createDataFrame(questions, "query_id bigint, question string").withColumns({x: F.lit("x") for x in ("term", "text")})
    expected = looped(questions, chunks)
    assert sorted(tuple(r) for r in ranked_search(q, c).collect()) == expected
    for name, value in (("TERMS_PER_PASS", 40), ("TILE_QUESTIONS", 4), ("TILE_TERMS", 3), ("TILE_CHUNKS", 16)):
        monkeypatch.setattr(lexical, name, value)
    assert sorted(tuple(r) for r in ranked_search(q, c, k=7, salts=3).collect()) == looped(questions, chunks, 7)


def test_text_ids_and_empty_tables(spark):
    chunks, questions = [("b", "one two"), ("a", "one two"), ("ä", "one"), ("B", "two two")], [("q", "ONE two")]
    c, q = spark.createDataFrame(chunks, "chunk_id string, text string"), spark.createDataFrame(questions, "query_id string, question string")
    out = ranked_search(q, c)
    assert sorted(tuple(r) for r in out.collect()) == looped(questions, chunks)
    assert ranked_search(q.limit(0), c).count() == 0 and ranked_search(q, c.limit(0)).count() == 0


def test_slabs_keep_sums_exact():
    weights = np.full(9, (1 << 53) // 10**6 // 4)
    ((members, slabs),) = question_tiles([(0, i) for i in range(9)], weights)
    assert [len(places) for places, _ in slabs] == [4, 4, 1]
    assert all(10**6 * int(matrix.sum(1).max()) < 1 << 53 for _, matrix in slabs)


def test_lengths_beyond_64_bits():
    n = np.array([1 << 20, 3])
    got = lexical.impacts(np.array([2, 1]), n, 1 << 45, 1 << 60, 2, 50)
    assert got.tolist() == [10**9 * t // (1000 * t + 20 * (50 + 50 * x * (1 << 45) // (1 << 60))) for t, x in ((2, 1 << 20), (1, 3))]
