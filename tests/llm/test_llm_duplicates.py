"""Exact, near and passage duplicates against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm.components import components
from docquarry.llm.exact import exact_duplicates
from docquarry.llm.near import MinHash, may_be_similar, near_duplicates, signatures
from docquarry.llm.paragraphs import lines, repeated_paragraphs, tuned, without_paragraphs
from docquarry.llm.passages import repeated_passages

SCHEMA = "doc_id bigint, text string, keep_id string, item string, key int, digest string, component string, start string, label int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", 1, "x", "x", "x", 1) for i, t in rows], SCHEMA).repartition(4)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


ODD = [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (903, "One"), (904, "one two three four"), (905, "ONE  two three\nfour"), (None, "one two three four"), (906, "one two three four five")]


def test_exact_duplicates_equal_grouping_by_text(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a  b", "a b", "a\tb", "c", "c ", "", None, "long " * 30_000])) for i in range(60)] + ODD
    want = {}
    for i, t in rows:
        want.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    expected = []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        ids = [x for x in want[norm] if x is not None]
        keep = min(ids) if ids else None
        expected.append((i, keep, len(want[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    for digest in ({}, {"digest": lambda c: F.length(c)}):  # the second makes different texts share a digest
        got = [tuple(r) for r in exact_duplicates(frame(spark, rows), salts=3, **digest).collect()]
        assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert exact_duplicates(frame(spark, [])).count() == 0


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                a_, b_ = find(a), find(b)
                parent[max(a_, b_)] = min(a_, b_)
    return {i: find(i) for i in parent}


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(2)
    rows = list(ODD)
    for group in range(12):
        base = words(rng, rng.choice([6, 20, 60, 200])).split()
        for _ in range(rng.choice([1, 2, 6, 25])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 20])):
                copy[rng.randrange(len(copy))] = words(rng, 1)
            rows.append((len(rows), " ".join(copy)))
    want = brute_components(rows)
    got = near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = [t for i, t in rows if i == r.doc_id]
        assert r.n_shingles in {len(shingles(t)) for t in text}
        assert (r.component_id, r.kept) == ((want[r.doc_id], want[r.doc_id] == r.doc_id) if r.doc_id is not None else (None, True))
    assert near_duplicates(frame(spark, [])).count() == 0


def test_odd_sketches_separate_high_similarities(spark):
    scheme, rng = MinHash(), np.random.default_rng(1)
    for size in (20, 150, 1000, 8000):
        allowed = spark.range(1).select(scheme.most_different(F.lit(size), F.lit(size), 0.75)).first()[0]
        for similarity, passes in ((0.76, True), (0.9, True), (1.0, True), (0.35, False)):
            a = rng.integers(0, 2**63, size, dtype=np.uint64)
            b = a.copy()
            change = int(size * (1 - similarity) / (1 + similarity))
            b[:change] = rng.integers(0, 2**63, change, dtype=np.uint64)
            x, y = (scheme.sketch(np.sort(s)).view(np.uint64) for s in (a, b))
            assert (int(np.bitwise_count(x ^ y).sum()) <= allowed) == passes, (size, similarity)


@pytest.mark.parametrize("bits", [256, 1024])
def test_no_pair_at_the_threshold_is_lost_to_its_sketch(spark, bits):
    scheme, rng = MinHash(bits=bits), np.random.default_rng(8)
    for union in (12, 20, 40, 100):
        common, lost = union * 3 // 4, 0
        size = [(common + (union - common) // 2, union - (union - common) // 2)]
        allowed = spark.range(1).select(scheme.most_different(F.lit(size[0][0]), F.lit(size[0][1]), 0.75)).first()[0]
        for _ in range(4000):
            items = rng.integers(0, 2**63, union, dtype=np.uint64)
            a, b = items[:size[0][0]], np.concatenate([items[:common], items[size[0][0]:]])
            x, y = (scheme.sketch(np.sort(s)).view(np.uint64) for s in (a, b))
            lost += int(np.bitwise_count(x ^ y).sum()) > allowed
        assert lost == 0, union


def test_near_lines_are_found_in_large_groups(spark):
    """Edited copies of one line that are similar to the original, and often not to each other."""
    rng = random.Random(12)
    base = words(rng, 40).split()
    lines = [" ".join(base)]
    for _ in range(300):
        copy = list(base)
        copy[rng.randrange(1, 39)] = words(rng, 1)
        lines.append(" ".join(copy))
    found = repeated_paragraphs(frame(spark, list(enumerate(lines))))
    assert {r.doc_id for r in found.filter("whole_line").collect()} == set(range(1, 301))


def test_components_reach_the_smallest_node(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (300, 300)] + [(500, i) for i in range(501, 560)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in [*range(41), 100]} | {200: 200, 201: 200} | {i: 500 for i in range(500, 560)}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_bands_are_tuned_to_the_recall():
    scheme = tuned(0.75, 0.998)
    assert 1 - (1 - 0.75**scheme.rows) ** scheme.bands >= 0.998 > 1 - (1 - 0.75**scheme.rows) ** (scheme.bands - 1)


@pytest.fixture(scope="module")
def passages(spark):
    rng = random.Random(3)

    def sentences(n):
        return " ".join(words(rng, rng.randint(9, 14)).capitalize() + "." for _ in range(n))

    passage, line, short = sentences(6), sentences(5), words(rng, 12) + "."
    edited = line.split()
    edited[30] = "other"
    rows = {i: "\n".join([sentences(4), sentences(3)]) for i in range(30)}
    for i in (3, 7, 11):
        rows[i] += "\n" + passage
    mixed = rows[15].split(" ")
    rows[15] = " ".join(mixed[:17]) + " " + passage + " " + " ".join(mixed[17:])  # within a sentence
    rows[20] += "\n" + line
    rows[21] += "\n" + " ".join(edited)
    for i in (25, 26):
        rows[i] += "\n" + short
    rows[28] = passage
    return rows, passage


def test_repeated_passages_are_found_and_clean_documents_left(spark, passages):
    rows, passage = passages
    docs = frame(spark, [*rows.items(), (None, passage), (900, None), (901, ""), (902, " \n ")])
    found = repeated_paragraphs(docs)
    got = found.collect()
    assert {r.doc_id for r in got} == {7, 11, 15, 21, 28}
    assert all(r.keep_doc_id == 3 for r in got if r.doc_id in (7, 11, 15, 28)) and {r.keep_doc_id for r in got if r.doc_id == 21} == {20}
    for r in got:
        assert len(rows[r.doc_id][r.start:r.start + r.length].split()) == r.n_words
    out = {r.doc_id: r.text for r in without_paragraphs(docs, found).collect()}
    for i in (7, 11, 15):
        assert sum(len(s) for s in passage.split(". ")[1:-1] if s in out[i]) == 0
    assert all(out[i] == t for i, t in rows.items() if i not in {7, 11, 15, 21, 28})
    assert out[28].strip() == "" and out[900] is None
    kept = without_paragraphs(docs, found, drop_emptied=True)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert repeated_paragraphs(frame(spark, [])).count() == 0


def removed_words(rows, found):
    """Numbers of the removed words of each document."""
    out = {i: set() for i, _ in rows}
    for r in found:
        text = dict(rows)[r.doc_id]
        before = len(text[:r.start].split())
        out[r.doc_id] |= set(range(before, before + len(text[r.start:r.start + r.length].split())))
    return out


def brute_passages(rows, least):
    """Numbers of the words in runs of ``least`` words that a document before has, by comparing all runs."""
    out, seen = {}, set()
    for i, text in sorted(rows):
        w = text.lower().split()
        own = [(k, tuple(w[k:k + least])) for k in range(len(w) - least + 1)]
        out[i] = {x for k, run in own if run in seen for x in range(k, k + least)}
        seen |= {run for _, run in own}
    return out


def test_embedded_passages_are_removed_to_their_last_word(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randint(150, 300))) for i in range(60)]
    for i in range(1, 60):  # 24 to 80 words of an earlier text, which may hold words of others, at any place
        for _ in range(rng.choice([0, 1, 1, 2])):
            own, other = rows[i][1].split(), rows[rng.randrange(i)][1].split()
            n, at = rng.choice([24, 25, *range(51, 81)]), rng.randrange(len(own))
            start = rng.randrange(len(other) - n)
            rows[i] = i, " ".join(own[:at] + other[start:start + n] + own[at:])
    for limit in (2_000_000, 5):  # the second joins by shuffles and takes several passes
        found = repeated_passages(frame(spark, rows), 25, limit).collect()
        assert removed_words(rows, found) == brute_passages(rows, 25)
        for r in found:
            part = " ".join(dict(rows)[r.doc_id][r.start:r.start + r.length].split())
            assert part in dict(rows)[r.keep_doc_id] and r.n_words == len(part.split())


def test_passages_of_short_lines_and_other_line_ends_are_removed(spark):
    rng = random.Random(5)
    w = words(rng, 60).split()
    verse = "\n".join(" ".join(w[k:k + 6]) for k in range(0, 60, 6))
    wrapped = "\n".join(" ".join(w[k:k + 11]) for k in range(0, 60, 11))
    rows = [(i, "\n".join([words(rng, 40), part, words(rng, 5), words(rng, 30)])) for i, part in enumerate([verse, verse, wrapped, " ".join(w), words(rng, 60)])]
    removed = removed_words(rows, repeated_paragraphs(frame(spark, rows)).collect())
    assert removed == {i: set(range(40, 100)) if i in (1, 2, 3) else set() for i in range(5)}


def test_near_lines_in_a_row_are_added_up(spark):
    rng = random.Random(6)
    lines = [words(rng, 23) for _ in range(10)]
    near = [" ".join([*x.split()[:-1], words(rng, 1)]) for x in lines]  # 18 of 20 shingles are common
    rows = [(1, "\n".join(lines)), (2, "\n".join([words(rng, 30), *near, words(rng, 30)])), (3, "\n".join([words(rng, 30), near[4], words(rng, 30)]))]
    removed = removed_words(rows, repeated_paragraphs(frame(spark, rows)).filter("whole_line").collect())
    assert removed == {1: set(), 2: set(range(30, 260)), 3: set()}


@pytest.mark.parametrize("bits, size", [(1024, 150), (256, 60), (256, 230), (64, 60)])
def test_sketches_part_edited_copies_of_one_text(spark, bits, size):
    """Copies below the threshold, edited from one text, are no candidates; all pairs at or above it are."""
    rng, scheme = random.Random(bits + size), MinHash(bits=bits)
    base = words(rng, size + 4).split()
    texts = []
    for share in (0, 0.02, 0.05, 0.3, 0.35):
        for _ in range(3):
            copy = list(base)
            copy[:int(share * size)] = words(rng, int(share * size)).split()
            texts.append(" ".join(copy))
    signed = signatures(frame(spark, list(enumerate(texts))).select(F.col("doc_id").alias("item"), "text"), scheme)
    sides = [signed.select(*(F.col(c).alias(n + s) for c, n in (("item", "item"), ("n_shingles", "n"), ("whole", "whole"), ("sketch", "sketch")))) for s in ("1", "2")]
    got = {tuple(r) for r in sides[0].join(sides[1], F.col("item1") < F.col("item2")).filter(may_be_similar("1", "2", scheme, 0.75)).select("item1", "item2").collect()}
    sets = [shingles(t) for t in texts]
    alike = {(i, k): len(sets[i] & sets[k]) / len(sets[i] | sets[k]) for i in range(len(texts)) for k in range(i + 1, len(texts))}
    assert {p for p, s in alike.items() if s >= 0.75} <= got
    if bits > 64:
        assert not [p for p in got if alike[p] < 0.62]


def test_line_sketches_equal_those_of_texts(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, n)) for i, n in enumerate([8, 30, 70, 90, 140, 300])] + [(6, "a b c d e " * 9)]
    scheme = MinHash(5, 3, 64)
    want = {r.n_shingles: (r["keys"], r.whole, r.sketch) for r in signatures(frame(spark, rows).select(F.col("doc_id").alias("item"), "text"), scheme).collect()}
    got = {r.n_shingles: (r["keys"], r.whole, r.sketch) for r in lines(frame(spark, rows), scheme).collect()}
    assert got == want and len(got) == 7
    assert all((w is None, s is None) == (n > 64, n <= 32) for n, (_, w, s) in got.items())


def test_further_hubs_and_all_pairs_join_chains_of_components(spark, monkeypatch):
    """Bands of more items than LARGE, whose links one hub does not find, equal brute force."""
    monkeypatch.setattr("docquarry.llm.near.LARGE", 3)
    rng = random.Random(12)
    base, rows = words(rng, 60).split(), []
    for i in range(40):  # each text is like its neighbours only
        base[(7 * i) % 60] = words(rng, 1)
        rows.append((100 - i, " ".join(base)))
    want = brute_components(rows)
    assert {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows)).collect()} == want
