"""Winnowing against a direct computation."""

import random

import pytest

from docquarry.llm.fingerprints import GRAM, SPAN, as_text, code_points, fingerprint_documents, gram_hashes, likeness, winnow


def direct(text, size, span):
    points, out = code_points(text), []
    if not len(points):
        return out
    size = min(size, len(points))
    hashes = [int(gram_hashes(points[i:i + size], size)[0]) for i in range(len(points) - size + 1)]
    for i in range(max(1, len(hashes) - span + 1)):
        window = hashes[i:i + span]
        at = i + max(k for k, h in enumerate(window) if h == min(window))
        if not out or out[-1][1] != at:
            out.append((hashes[at], at))
    return out


@pytest.mark.parametrize("size,span", [(GRAM, SPAN), (3, 4), (1, 1)])
def test_winnow_equals_the_definition(size, span):
    rng = random.Random(1)
    for n in (0, 1, 2, 5, GRAM, GRAM + 1, 40, 120, 400):
        text = "".join(rng.choice("ab é😀") for _ in range(n))
        assert list(zip(*(a.tolist() for a in winnow(code_points(text), size, span)))) == direct(text, size, span)


def test_a_shared_passage_shares_a_hash():
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for _ in range(50):
        passage = text(GRAM + SPAN - 1)
        a, b = (set(winnow(code_points(text(200) + passage + text(200)))[0].tolist()) for _ in range(2))
        assert a & b


def test_documents_meet_their_successor(spark):
    rng = random.Random(3)
    rows = [(i * 7, "".join(rng.choice("abcdefé😀 ") for _ in range(rng.choice([0, 1, 9, 60, 500])))) for i in range(60)]
    rows[5] = (35, None)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, range string, ahead int").repartition(5)
    got = {r.doc_id: r for r in fingerprint_documents(docs, ranges=7).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        own, new, other = (winnow(code_points(x)) for x in (t, edited, following))
        r = got[i]
        assert (r.n_chars, r.edited_text, r.fingerprint, list(r.positions)) == (len(t), edited, as_text(own[0]), own[1].tolist())
        assert (r.edited_fingerprint, r.near_edited, r.near_next) == (as_text(new[0]), likeness(own[0], new[0]), likeness(own[0], other[0]))


def test_few_rows_null_ids_and_an_empty_table(spark):
    schema = "doc_id bigint, text string"
    assert fingerprint_documents(spark.createDataFrame([], schema)).count() == 0
    one = fingerprint_documents(spark.createDataFrame([(4, "abcdef")], schema)).collect()
    assert [(r.doc_id, r.edited_text, r.near_next) for r in one] == [(4, "abcabc", 1.0)]
    rows = fingerprint_documents(spark.createDataFrame([(None, "zzzz"), (1, "aaaa"), (1, "bbbb")], schema), ranges=3).collect()
    assert sorted((str(r.doc_id), r.edited_text) for r in rows) == [("1", "aabb"), ("1", "bbzz"), ("None", "zzaa")]
