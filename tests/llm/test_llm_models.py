"""Classifiers on small labelled sets, and their defined results on odd input."""

import random

import numpy as np
import pytest

from docquarry.llm.quality import fit_network, fit_quality, fold, score_quality
from docquarry.llm.toxicity import Landmarks, _letters, fit_toxicity, score_toxicity, subsequence_kernel, text_words
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, score double, label int, vector string, kernel string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, 1, "x", "x") for i, t in rows], SCHEMA).repartition(3)


def word(rng):
    return "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 9)))


@pytest.fixture(scope="module")
def quality_rows():
    rng = random.Random(1)
    good = [" ".join(word(rng) for _ in range(rng.randint(40, 120))) + "." for _ in range(240)]
    bad = ["\n".join(f"{w} " * 40 for w in (word(rng), word(rng))) if i % 2 else " ".join(word(rng) + "%%%" for _ in range(60)) for i in range(120)]
    texts = good + bad
    return list(enumerate(texts)), [(i, int(i < len(good)), 0) for i in range(len(texts))]


def test_quality_learns_and_is_deterministic(spark, quality_rows):
    rows, labels = quality_rows
    docs = frame(spark, [*rows, (None, rows[0][1]), (900, None), (901, ""), (902, "word " * 50_000)])
    known = spark.createDataFrame([*labels, (3, None, None), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    first, second = ({r.doc_id: r.score for r in score_quality(docs, fit_quality(docs, known)).collect()} for _ in range(2))
    assert first == second and len(first) == len(rows) + 4
    assert all(0 <= s <= 1 for s in first.values()) and first[900] == first[901]
    held = {r.doc_id for r in known.filter(fold(F.col("doc_id"), 3, 1)).collect()}
    right = [(first[i] >= 0.5) == bool(q) for i, q, _ in labels if i in held]
    assert held and np.mean(right) > 0.9


def test_quality_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    docs = frame(spark, [(1, "a b"), (1, "a b"), (2, None)])
    assert [r.score for r in score_quality(docs, fit_quality(docs, none)).collect()] == [0.5] * 3
    empty = frame(spark, [])
    assert score_quality(empty, fit_quality(empty, none)).count() == 0


def test_temperature_calibrates_on_held_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = (rng.random(2000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = fit_network(x, y)
    p = net.probability(x)
    assert abs(p.mean() - y.mean()) < 0.05 and abs(y[p > 0.8].mean() - p[p > 0.8].mean()) < 0.08
    assert np.allclose(fit_network(x[:10], np.ones(10)).probability(x[:2]), 11 / 12)


def brute_kernel(a, b, order, decay):
    from itertools import combinations

    total = 0.0
    for i in combinations(range(len(a)), order):
        for j in combinations(range(len(b)), order):
            if all(a[x] == b[y] for x, y in zip(i, j)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_subsequence_kernel_equals_its_definition():
    rng = random.Random(2)
    for _ in range(30):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randint(0, 8))) for _ in range(2))
        got = subsequence_kernel(_letters([a], 8), _letters([b], 8), 3, 0.6)[0]
        assert got == pytest.approx(brute_kernel(a, b, 3, 0.6), rel=1e-4, abs=1e-7)


def test_landmarks_tolerate_gaps_and_insertions():
    marks = Landmarks(["^numbrak"])
    found = marks.kernel(["numbrak", "num-brak", "n.u.m.b.r.a.k", "numxbrak", "brakes", "plain"])[:, 0]
    assert found[0] >= 1 and found[1] == found[0] == found[2] and found[3] > 0.1 and found[4] == found[5] == 0
    assert text_words("a n u m b r a k b") == ["anumbrakb"] and text_words(None) == []


def test_toxicity_learns_from_documents(spark):
    rng = random.Random(3)
    insults = ["numbrak", "flosten", "grubwitz"]
    rows, labels = [], []
    for i in range(300):
        words = [word(rng) for _ in range(rng.randint(20, 60))]
        toxic = i % 4 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(insults) + rng.choice(["", "en", ".", "ish"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    extra = [(900, None), (901, ""), (902, "So ein numxbrak hier"), (903, "n u m b r a k"), (None, "plain words"), (904, "lorem " * 40_000)]
    docs = frame(spark, rows + extra)
    known = spark.createDataFrame([*labels, (5, 1, None)], "doc_id bigint, quality int, toxic int")
    model = fit_toxicity(docs, known)
    got = {r.doc_id: r.score for r in score_toxicity(docs, model).collect()}
    held = {r.doc_id for r in known.filter(fold(F.col("doc_id"), 4, 2)).collect()}
    assert np.mean([(got[i] >= 0.3) == bool(t) for i, _, t in labels if i in held]) > 0.95
    assert got[900] == got[901] < 0.3 and got[903] >= 0.3 and got[904] < 0.3 and got[902] > got[901]
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.score for r in score_toxicity(docs, fit_toxicity(docs, none)).collect()} == {0.5}
    assert score_toxicity(frame(spark, []), fit_toxicity(frame(spark, []), none)).count() == 0


def test_inserted_letters_stay_toxic_and_clean_documents_do_not(spark):
    rng = random.Random(5)
    insults = ["numbrak", "flosten", "grubwitz"]
    rows, labels = [], []
    for i in range(300):
        words = [word(rng) for _ in range(rng.randint(20, 60))]
        if i % 4 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(insults))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    forms = [w[:k] + "e" + w[k:] for w in insults for k in (2, 3, 4)] + ["e".join(w) for w in insults] + ["nuxmbraxk", "floxxsten"]
    new = [(1000 + k, "so ein " + form + " ist das") for k, form in enumerate(forms)]
    clean = [(2000 + k, " ".join(word(rng) for _ in range(3000 if k < 3 else 60))) for k in range(60)]
    docs = frame(spark, rows + new + clean)
    got = {r.doc_id: r.score for r in score_toxicity(docs, fit_toxicity(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))).collect()}
    assert all(got[i] >= 0.3 for i, _ in new), {t: got[i] for i, t in new if got[i] < 0.3}
    assert sum(got[i] >= 0.3 for i, _ in clean) <= 1
