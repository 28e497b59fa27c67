"""Streaming encoder, decoder and packing against the tokenizers library and brute force."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docquarry.llm import bpe
from docquarry.llm.packing import best_fill, pack_documents, packing_plan
from docquarry.llm.tokens import tokenize

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
MACHINE = bpe.transducer(PATH)
PARTS = ["a", "th", "in", "é", "É", "'s", "'", "<|endoftext|>", " ", "\n", "1", "½", "!", "__", "ñ", "Σ", "İ", "中", "é", "\x1c", "　", "😀", "<|", "x" * 70, "Ⅷ"]
SCHEMA = "doc_id bigint, text string, token_ids string, item int, block string, length string"


def expected(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40))
def test_ids_equal_the_library(parts):
    text = "".join(parts)
    assert MACHINE.encode(text) == expected(text)
    assert MACHINE.decode(expected(text)) == LIBRARY.decode(expected(text), skip_special_tokens=False)
    assert [x.tolist() for x in MACHINE.encode_batch([text, None, text])] == [expected(text), [], expected(text)]


def test_pieces_of_a_long_text_do_not_change_ids(monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 64)
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(50, 200)))
        assert MACHINE.encode(text) == expected(text)


@pytest.mark.parametrize("letters", ["ab", "aeinotrshlxz", "the"])
def test_a_long_word_is_encoded_with_bounded_memory(letters):
    rng = random.Random(2)
    for size in (70, 300, 3000):
        word = "".join(rng.choice(letters) for _ in range(size))
        stream = bpe.WordStream(MACHINE.merges)
        ids = [i for s in MACHINE.merges.symbols(word) for i in stream.push(s)] + list(stream.close())
        assert ids == expected(word)
        assert stream.most <= MACHINE.merges.lookahead + MACHINE.merges.longest


def test_text_from_ids_waits_for_whole_characters():
    pieces = list(MACHINE.decode_text(MACHINE.encode("Wörld 中<|endoftext|>😀")))
    assert "".join(pieces) == "wörld 中 <|endoftext|>😀 "
    assert all("�" not in p for p in pieces)
    assert "".join(MACHINE.decode_text([MACHINE.merges.inner[0xE4]])) == "�"


def test_tokenize_handles_every_row(spark):
    long = "word é " * 60_000
    rows = [(1, "Hello", "x", 1, "b", "l"), (1, "Hello", "x", 1, "b", "l"), (2, None, None, None, None, None), (None, "", "x", 1, "b", "l"), (3, long, "x", 1, "b", "l")]
    got = sorted(((r.doc_id, list(r.token_ids), r.decoded) for r in tokenize(spark.createDataFrame(rows, SCHEMA), PATH).collect()), key=repr)
    want = sorted(((r[0], expected(r[1] or ""), LIBRARY.decode(expected(r[1] or ""), skip_special_tokens=False)) for r in rows), key=repr)
    assert got == want
    assert tokenize(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_best_fill_equals_trying_all_multisets():
    rng = random.Random(3)
    for _ in range(60):
        counts = {n: rng.randint(1, 3) for n in rng.sample(range(1, 20), 4)}
        capacity = rng.randint(0, 40)
        chosen = best_fill(counts, capacity)
        assert all(chosen[n] <= counts[n] for n in chosen)
        sums = (sum(n * k for n, k in zip(counts, ks)) for ks in itertools.product(*(range(c + 1) for c in counts.values())))
        assert sum(n * k for n, k in chosen.items()) == max(s for s in sums if s <= capacity)


def test_plan_places_every_piece_once():
    counts = {5: 7, 3: 1000, 2: 11, 8: 4}
    plan = packing_plan(counts, 8)
    fill = {}
    for n, slot, sequence, per, offset in zip(*(plan[k] for k in ("length", "slot", "sequence", "per", "offset"))):
        following = [s for m, s in zip(plan["length"], plan["slot"]) if m == n and s > slot]
        for i in range((min(following) if following else counts[n]) - slot):
            fill.setdefault(sequence + i // per, []).append((offset + i % per * n, n))
    assert sum(len(f) for f in fill.values()) == sum(counts.values())
    for pieces in fill.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= 8


def test_packing_keeps_every_token_and_pads_little(spark):
    rng = random.Random(4)
    texts = {i: " ".join(rng.choice(["thorn", "é", "abcxyz", "of"]) for _ in range(rng.choice([0, 1, 5, 30, 200]))) for i in range(150)}
    rows = [(i, t or None, "x", 1, "b", "l") for i, t in texts.items()]
    got = pack_documents(spark.createDataFrame(rows, SCHEMA), PATH, window=64, block_rows=10).collect()
    pieces, sequences = {}, {}
    for r in got:
        ids = expected(texts[r.doc_id]) + [2]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in texts.items():
        assert sum(n for _, n in pieces[i]) == len(expected(t)) + 1
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(pieces[i]), sorted(pieces[i])[1:]))
    for parts in sequences.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:])) and min(parts)[0] == 0 and sum(n for _, n in parts) <= 64
    total = sum(n for parts in sequences.values() for _, n in parts)
    assert total >= 0.95 * 64 * (len(sequences) - 1)
    assert pack_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    twice = pack_documents(spark.createDataFrame(rows[:3] * 2 + [(None, None, "x", 1, "b", "l")], SCHEMA), PATH).collect()
    assert len({(r.sequence_id, r.offset) for r in twice}) == len(twice) == 7


def test_words_are_remembered_within_bounds_and_ids_stay_equal(monkeypatch):
    table = bpe.WordTable(MACHINE.merges, limit=2000)
    monkeypatch.setattr(MACHINE, "words", table)
    rng = random.Random(5)
    often = ["harbour", "étude", "x9"]
    for _ in range(60):
        text = " ".join(rng.choice(often) if rng.random() < 0.5 else "".join(rng.choice("abcdeé'1") for _ in range(rng.randint(1, 40))) for _ in range(80))
        assert MACHINE.encode_batch([text])[0].tolist() == expected(text)
        assert table.old.nbytes < 2000 + 40_000 and table.young.nbytes <= 2000


def test_one_first_hash_for_different_words(monkeypatch):
    real = bpe.word_hashes
    monkeypatch.setattr(MACHINE, "words", bpe.WordTable(MACHINE.merges))
    monkeypatch.setattr(bpe, "word_hashes", lambda *a: (real(*a)[0] % np.uint64(3), real(*a)[1]))
    for text in ("one two three four one", "two five one six", "six one two"):
        assert MACHINE.encode(text) == expected(text)


def test_text_without_white_space(monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 100)
    rng = random.Random(6)
    for size in (90, 150, 1000):
        text = "".join(rng.choice(["abc", "é", "é", "12", "'s", "!?", "中", "X" * 30]) for _ in range(size))
        assert MACHINE.encode(text) == expected(text)


def test_the_decoder_continues_where_it_stopped():
    ids = MACHINE.encode("One two, three <|endoftext|> four's 中 é")
    decoder = bpe.Decoder(MACHINE.names)
    pushed = b"".join(decoder.push(np.array(ids[a:a + 3], np.int64)) for a in range(0, len(ids), 3))
    assert pushed.decode() == LIBRARY.decode(ids, skip_special_tokens=False) == MACHINE.decode(ids)
