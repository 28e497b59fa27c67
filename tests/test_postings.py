"""Postings against a scan of all chunks."""

import random

from pyspark.sql import functions as F

from docquarry.operators.postings import OVERLAP, best_by_postings, index_words, is_one_word, postings, words_with
from docquarry.operators.search import keyword_top_k

CHUNKS = "namespace string, chunk_id string, confidence_score double, chunk_index int, text string, keywords array<string>"


def scanned(questions, chunks, k):
    out = []
    for query, namespace, terms in questions:
        hits = [(-(c or 0.0), i or 0, cid) for ns, cid, c, i, text, kw in chunks if ns == namespace and any(
            t and (t.lower() in (text or "").lower() or t.lower() in " ".join(kw or []).lower()) for t in terms)]
        out += [(query, cid, r + 1) for r, (_, _, cid) in enumerate(sorted(hits)[:k])]
    return sorted(out)


def test_keyword_search_equals_a_scan(spark):
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    words = [letters(rng.randint(1, 7)) for _ in range(60)]
    chunks = [(f"n{i % 2}", f"c{i}", rng.choice([0.1, 0.5, 0.9, None]), rng.choice([i % 5, None]), " ".join(rng.choice(words) for _ in range(12)), [rng.choice(words)] if i % 3 else None) for i in range(200)]
    long = letters(2000)
    chunks += [("n0", "long", 1.0, 0, f"x {long} y", None), ("n0", "none", 1.0, 0, None, None), ("n1", "empty", 1.0, 0, " ", [])]
    questions = [(f"q{i}", f"n{i % 2}", [rng.choice(words)[:rng.randint(1, 5)] for _ in range(3)]) for i in range(30)]
    questions += [("span", "n0", [" ".join(chunks[0][4].split()[2:4]), "zzz"]), ("in_long", "n0", [long[700:900]]), ("very_long", "n0", [long[300:300 + OVERLAP + 50]]), ("blank", "n1", [""]), ("none", "n0", []), ("upper", "n1", ["A", "%"])]
    c = spark.createDataFrame(chunks, CHUNKS).repartition(3)
    q = spark.createDataFrame(questions, "query_id string, namespace string, terms array<string>")
    got = keyword_top_k(q, c, 7, indexed=True)
    assert sorted((r.query_id, r.chunk_id, r.rank_position) for r in got.collect()) == scanned(questions, chunks, 7)


def test_frequent_terms_are_found_among_the_best_chunks(spark):
    rng = random.Random(10)
    chunks = [("s", f"c{i}", rng.random(), i, " ".join(rng.choice(["often", "rare%d" % (i % 90), "the"]) for _ in range(6))) for i in range(400)]
    rows = spark.createDataFrame(chunks, "_scope string, chunk_id string, confidence_score double, chunk_index int, haystack string")
    wanted = spark.createDataFrame([("s", t) for t in ("often", "e", "rare7", "rare", "89", "none")], "_scope string, term string")
    index = postings(rows, ["_scope"], 5)
    for head in (1, 20, 1000):
        got = sorted((r.term, r.chunk_id) for r in best_by_postings(index, wanted, 5, head=head).collect())
        want = sorted((t, c) for t in ("often", "e", "rare7", "rare", "89") for _, c in sorted((-s, c) for _, c, s, _, text in chunks if t in text)[:5])
        assert got == want


def test_words_and_terms(spark):
    text = "One two\x00twoé\n" + "x" * 1100
    words = spark.createDataFrame([(text,)], "t string").select(index_words(F.lower("t")).alias("w")).first().w
    assert words[:3] == ["one", "two", "twoé"] and {len(w) for w in words[3:]} <= set(range(1, 513)) and "x" * 512 in words
    flags = spark.createDataFrame([("a b",), ("a\tb",), ("ab",), ("y" * (OVERLAP + 2),)], "t string").select(is_one_word(F.col("t"))).collect()
    assert [r[0] for r in flags] == [False, False, True, False]
    vocabulary = ["a", "ab", "abc", "xabcx", "bca", "éa"]
    terms = ["a", "ab", "abc", "bc", "zz", "é"]
    got = words_with(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(w,) for w in vocabulary], "word string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((t, w) for t in terms for w in vocabulary if t in w)


def test_plan_of_keyword_search_has_no_python(spark):
    c = spark.createDataFrame([("n", "c1", 0.5, 0, "some text here", None)], CHUNKS)
    q = spark.createDataFrame([("q", "n", ["text"])], "query_id string, namespace string, terms array<string>")
    plan = keyword_top_k(q, c, 3, indexed=True)._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan
