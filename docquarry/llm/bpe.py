"""Byte-pair encoding and decoding as a streaming transducer.

A tokenizer file of the ``tokenizers`` library names the vocabulary and the merge
list; words end with a suffix mark. Nothing is trained here.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

from docquarry.llm.words import STEP, mixed

# Fixed values of the tokenizer's pattern: white space, contractions, letter runs, single digits, other runs.
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
ANY_TEXT = regex.compile(f"{SHORT}|[\\p{{L}}]+|[\\p{{N}}]|[^{WHITE}\\p{{L}}\\p{{N}}]+")
WHITE_RUN = re.compile(f"[{WHITE}]+")
WHITE_SIGN, LETTER, NUMBER, OTHER = range(4)

PIECE = 1 << 19  # characters of texts that are split and encoded together
GENERATION_BYTES = 12 << 20  # of encoded words; a worker keeps two such generations
KEPT_SIGNS = 32  # characters of a word that is remembered
PAIRS_KEPT = 100_000  # pairs of tokens that one stream remembers


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merges:
    """Vocabulary and merge list, with what follows from them.

    ``lookahead`` is the number of bytes after which a token can no longer change. A
    later byte acts to the left only through a chain of merges of rising rank, each of
    which takes, or frees, the right part of the next: the pair (a, b) is decided by
    how b was formed and by earlier pairs (b, x). Walking the merges in rank order gives
    the longest such chain in bytes; the longest token is added for the token at its end.
    """

    def __init__(self, vocabulary: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str = "</w>"):
        self.vocabulary, self.suffix = vocabulary, suffix
        self.ranks: dict[int, int] = {}  # of two tokens, as one number
        self.made: list[int] = []
        signs = byte_signs()
        self.inner = [vocabulary[s] for s in signs]
        self.final = [vocabulary[s + suffix] for s in signs]
        length = dict.fromkeys([*self.inner, *self.final], 1)
        reach, formed = {}, {}
        for rank, (a, b) in enumerate(merges):
            left, right, made = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.ranks.setdefault(left << 20 | right, rank)
            self.made.append(made)
            length[made] = length[left] + length[right]
            run = length[left] + max(length[right], reach.get(right, 0), formed.get(right, 0))
            reach[left] = max(reach.get(left, 0), run)
            formed[made] = max(formed.get(made, 0), run)
        self.length = length
        self.longest = max(length.values())
        self.lookahead = max(formed.values(), default=1) + self.longest
        self.widths = sorted({4, 8, 12, 16, 24, 64, self.lookahead})
        self._spans: dict[int, tuple[int, ...]] = {}
        self._by_bytes: dict[tuple[int, ...], int] | None = None
        self.table: tuple[np.ndarray, np.ndarray] | None = None

    def join(self, symbols: list[int]) -> list[int]:
        """Apply the merges, lowest rank first and leftmost of equals."""
        out, rank_of, made = list(symbols), self.ranks.get, self.made
        none = len(made)
        ranks = [rank_of(a << 20 | b, none) for a, b in zip(out, out[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at, token = ranks.index(best), made[best]
            out[at:at + 2] = [token]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of(out[at - 1] << 20 | token, none)
            if at < len(ranks):
                ranks[at] = rank_of(token << 20 | out[at + 1], none)
        return out

    def join_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``join`` for the symbols of many words of at most ``lookahead`` bytes at once: all ids, and
        where each word's ids begin and how many they are.

        One row per word; every round merges the best pair of each row and looks up its two
        new neighbours."""
        if self.table is None:
            keys = np.fromiter(self.ranks, np.int64, len(self.ranks))
            order = np.argsort(keys)
            self.table = keys[order], np.fromiter(self.ranks.values(), np.int64, len(keys))[order]
        lengths = np.array([len(d) for d in words], np.int64)
        flat, none = np.frombuffer(b"".join(words), np.uint8), len(self.made)
        made, inner, final = np.array(self.made), np.array(self.inner), np.array(self.final)
        begins = np.cumsum(lengths) - lengths
        first, count, ids, total, low = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [np.empty(0, np.uint32)], 0, 0
        for high in self.widths:
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            step = max(1, (1 << 16) // high)
            for start in range(0, len(rows), step):
                part = rows[start:start + step]
                done = self._join_rows(part, flat, begins, lengths, high, made, inner, final, none)
                filled = done >= 0
                count[part] = filled.sum(1)
                first[part] = total + np.cumsum(count[part]) - count[part]
                ids.append(done[filled].astype(np.uint32))
                total += len(ids[-1])
            low = high
        return np.concatenate(ids), first, count

    def _ranks_of(self, left: np.ndarray, right: np.ndarray, none: int) -> np.ndarray:
        keys, ranks = self.table
        wanted = left << 20 | right
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where((keys[at] == wanted) & (left >= 0) & (right >= 0), ranks[at], none)

    def _join_rows(self, part, flat, begins, lengths, width, made, inner, final, none) -> np.ndarray:
        size = lengths[part]
        column = np.arange(width)
        inside = column < size[:, None]
        table = np.full((len(part), width + 1), -1, np.int64)
        bytes_ = flat[np.minimum(begins[part][:, None] + column, len(flat) - 1)]
        table[:, :-1] = np.where(inside, np.where(column == size[:, None] - 1, final[bytes_], inner[bytes_]), -1)
        ranks = self._ranks_of(table[:, :-1], table[:, 1:], none)
        live = np.arange(len(part))
        done = np.empty_like(table)
        while len(live):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(live)), at]
            more = best < none
            if not more.all():
                done[live[~more]] = table[~more]
                live, table, ranks, at, best = live[more], table[more], ranks[more], at[more], best[more]
                if not len(live):
                    break
            row = np.arange(len(live))
            table[row, at] = made[best]
            shift = column >= at[:, None] + 1
            table[:, :-1] = np.where(shift, table[:, 1:], table[:, :-1])
            ranks[:, :-1] = np.where(shift[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = none
            ranks[row, at] = self._ranks_of(table[row, at], table[row, at + 1], none)
            before = np.maximum(at - 1, 0)
            ranks[row, before] = np.where(at > 0, self._ranks_of(table[row, before], table[row, at], none), ranks[row, before])
        return done

    def symbols(self, word: str) -> list[int]:
        data = word.encode("utf-8")
        return [*(self.inner[b] for b in data[:-1]), self.final[data[-1]]]

    def parts(self, token: int) -> tuple[int, ...]:
        """The byte symbols of a token."""
        if not self._spans:
            self._spans.update({s: (s,) for s in [*self.inner, *self.final]})
            for pair, rank in self.ranks.items():
                self._spans.setdefault(self.made[rank], self._spans[pair >> 20] + self._spans[pair & 0xFFFFF])
        return self._spans[token]

    def by_parts(self) -> dict[tuple[int, ...], int]:
        if self._by_bytes is None:
            self._by_bytes = {self.parts(t): t for t in self.length if self.join(list(self.parts(t))) == [t]}
        return self._by_bytes


class WordStream:
    """Encodes one word of any length, symbol by symbol.

    The encoding of every prefix ends in exactly one token, and two tokens may follow
    each other exactly if together they encode to themselves. So the last token of
    each prefix follows from those of shorter prefixes, and a token is final once the
    encodings of all prefixes that a later token could start from agree on it. That is
    looked at whenever more than ``Merges.lookahead`` bytes are held, so the lookahead bounds
    what is held back, and not the word.
    """

    def __init__(self, merges: Merges):
        self.merges, self.known = merges, merges.by_parts()
        self.held: list[int] = []  # symbols after the last emitted token
        self.last: list[int] = [0]  # token that ends each held prefix; 0 for the empty one
        self.fits: dict[tuple[int, int], bool] = {}
        self.before = -1  # last emitted token
        self.most = 0

    def _follows(self, a: int, b: int) -> bool:
        if a < 0:
            return True
        if (a, b) not in self.fits:
            if len(self.fits) > PAIRS_KEPT:
                self.fits.clear()
            self.fits[a, b] = self.merges.join([*self.merges.parts(a), *self.merges.parts(b)]) == [a, b]
        return self.fits[a, b]

    def push(self, symbol: int) -> Iterator[int]:
        held, last, longest = self.held, self.last, self.merges.longest
        held.append(symbol)
        n = len(held)
        for size in range(min(n, longest), 0, -1):
            token = self.known.get(tuple(held[n - size:]))
            if token is not None and self._follows(last[n - size] if n > size else self.before, token):
                last.append(token)
                break
        self.most = max(self.most, n)
        if n > self.merges.lookahead:
            yield from self._settled()

    def _starts(self, end: int) -> list[int]:
        out = []
        while end:
            out.append(end)
            end -= self.merges.length[self.last[end]]
        return out[::-1]

    def _settled(self) -> Iterator[int]:
        """Tokens on which all open prefixes agree."""
        n = len(self.held)
        common: list[int] | None = None
        for end in range(max(0, n - self.merges.longest + 1), n + 1):
            ends = self._starts(end)
            if common is None:
                common = ends
            else:
                k = 0
                while k < min(len(common), len(ends)) and common[k] == ends[k]:
                    k += 1
                common = common[:k]
            if not common:
                return
        for end in common:
            self.before = self.last[end]
            yield self.before
        cut = common[-1]
        del self.held[:cut]
        del self.last[1:cut + 1]

    def close(self) -> Iterator[int]:
        for end in self._starts(len(self.held)):
            yield self.last[end]
        self.held, self.last, self.before = [], [0], -1


def sign_kinds() -> np.ndarray:
    """Kind of every code point: white space, letter, number or other."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    patterns = [(kind, regex.compile(p)) for kind, p in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE_SIGN, f"[{WHITE}]+"))]
    for start in range(0, 0x110000, 0x800):
        if 0xD800 <= start < 0xE000:  # no characters
            continue
        text = "".join(map(chr, range(start, start + 0x800)))
        for kind, pattern in patterns:
            for run in pattern.finditer(text):
                kinds[start + run.start():start + run.end()] = kind
    return kinds


def split_words(signs: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the tokenizer's pattern start and end in an array of code points.

    Letter runs, single numbers and runs of other signs; an apostrophe that begins such a run
    and the contraction behind it are one word."""
    kind = kinds[signs]
    before = np.append(np.uint8(WHITE_SIGN), kind[:-1])
    start = (kind != WHITE_SIGN) & ((kind != before) | (kind == NUMBER))
    at = np.flatnonzero(start & (signs == ord("'")))
    if len(at):
        padded = np.append(signs, np.full(2, ord(" "), signs.dtype))
        one, two = padded[at + 1], padded[at + 2]
        pair = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        single = np.isin(one, [ord(c) for c in "stmd"])
        start[at[single | pair] + 1] = False
        behind = np.append(at[single] + 2, at[pair] + 3)
        behind = behind[behind < len(signs)]
        start[behind[kind[behind] == LETTER]] = True
    end = (kind != WHITE_SIGN) & np.append(start[1:] | (kind[1:] == WHITE_SIGN), True)
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_hashes(signs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word."""
    lengths = ends - starts
    begins = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(begins, lengths)
    inside = signs[place + np.repeat(starts, lengths)].astype(np.uint64)
    out = []
    for step in (STEP, np.uint64(0xD6E8FEB86659FD93)):
        powers = np.multiply.accumulate(np.full(int(lengths.max(initial=0)) + 1, step))
        out.append(mixed(np.add.reduceat(mixed(inside + step) * powers[place], begins) + lengths.astype(np.uint64)))
    return out[0], out[1]


def spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices ``first .. first + count`` of each row, one row behind the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class Generation:
    """Token ids of words by their hashes, in flat arrays sorted by the first hash."""

    def __init__(self, key=None, check=None, first=None, count=None, ids=None):
        self.key, self.check = (np.empty(0, np.uint64) if x is None else x for x in (key, check))
        self.first, self.count = (np.empty(0, np.int32) if x is None else x for x in (first, count))
        self.ids = np.empty(0, np.uint32) if ids is None else ids

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.key, self.check, self.first, self.count, self.ids))

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Row of each word, -1 where it is not known."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (self.check[at] == check), at, -1)

    def with_words(self, key, check, count, ids) -> Generation:
        """These words added; equal first hashes keep the word that was there."""
        first = (len(self.ids) + np.cumsum(count) - count).astype(np.int32)
        columns = [np.concatenate(x) for x in ((self.key, key), (self.check, check), (self.first, first), (self.count, count.astype(np.int32)))]
        order = np.argsort(columns[0], kind="stable")
        order = order[np.append(True, columns[0][order][1:] != columns[0][order][:-1])]
        return Generation(*(c[order] for c in columns), np.concatenate([self.ids, ids]))


class WordTable:
    """Encodes the words of a batch; remembers short ones in two generations of bounded bytes.

    Words of the older generation that are met again move to the younger one. When that is full
    it becomes the older one, so what is in use stays and memory is bounded however many
    different words come."""

    def __init__(self, merges: Merges, limit: int = GENERATION_BYTES):
        self.merges, self.limit = merges, limit
        self.young, self.old = Generation(), Generation()

    def encode(self, text: str, signs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and how many each word has."""
        if not len(starts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        key, check = word_hashes(signs, starts, ends)
        unique, sample, which = np.unique(key, return_index=True, return_inverse=True)
        if (check != check[sample][which]).any():  # different words with one first hash
            _, sample, which = np.unique(np.stack([key, check], 1), axis=0, return_index=True, return_inverse=True)
        key, check = key[sample], check[sample]
        young, old = self.young.find(key, check), self.old.find(key, check)
        old[young >= 0] = -1
        new = np.flatnonzero((young < 0) & (old < 0))
        words = [text[a:b].encode() for a, b in zip(starts[sample[new]].tolist(), ends[sample[new]].tolist())]
        fresh = self._joined(words)
        count = np.zeros(len(key), np.int64)
        parts, at = [], np.zeros(len(key), np.int64)
        total = 0
        for rows, (ids, first, n) in (
                (new, fresh), *((np.flatnonzero(found >= 0), (g.ids, g.first[found[found >= 0]], g.count[found[found >= 0]])) for g, found in ((self.young, young), (self.old, old)))):
            count[rows] = n
            at[rows] = total + np.cumsum(n) - n
            parts.append(ids[spans(first.astype(np.int64), n.astype(np.int64))])
            total += len(parts[-1])
        table = np.concatenate(parts)
        keep = np.flatnonzero((young < 0) & (ends[sample] - starts[sample] <= KEPT_SIGNS))
        if len(keep):
            self.young = self.young.with_words(key[keep], check[keep], count[keep], table[spans(at[keep], count[keep])])
            if self.young.nbytes > self.limit:
                self.young, self.old = Generation(), self.young
        return table[spans(at[which], count[which])], count[which]

    def _joined(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words within the lookahead are joined together: of such a word nothing could be emitted before
        its end. Longer ones are streams."""
        ids, first, count = self.merges.join_many(words)
        long = [i for i, w in enumerate(words) if len(w) > self.merges.lookahead]
        extra = [ids]
        for i in long:
            stream, data = WordStream(self.merges), words[i]
            symbols = chain((self.merges.inner[b] for b in data[:-1]), (self.merges.final[data[-1]],))
            out = np.fromiter(chain(chain.from_iterable(map(stream.push, symbols)), stream.close()), np.uint32)
            first[i], count[i] = sum(map(len, extra)), len(out)
            extra.append(out)
        return np.concatenate(extra), first, count


class Decoder:
    """Incremental state machine from token ids to text as the tokenizers library decodes a file without
    a decoder: the names of the tokens, parted by spaces. The state is whether a token came
    before; each id is a jump to its bytes in one table."""

    def __init__(self, names: Sequence[str]):
        data = [b" " + n.encode() for n in names]
        self.bytes = np.frombuffer(b"".join(data), np.uint8)
        self.count = np.array([len(d) for d in data])
        self.first = np.cumsum(self.count) - self.count
        self.begun = False

    def push(self, ids: np.ndarray) -> bytes:
        """The bytes of these ids, which continue those before."""
        return self.texts(ids, np.array([0, len(ids)]), self.begun)[0].tobytes()

    def texts(self, ids: np.ndarray, bounds: np.ndarray, begun: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of several texts, each from the first state on, and their bounds."""
        first, count = self.first[ids], self.count[ids]
        if not begun:
            starts = bounds[:-1][np.diff(bounds) > 0]
            first[starts] += 1
            count[starts] -= 1
        self.begun = begun or len(ids) > 0
        ends = np.append(0, np.cumsum(count))
        return self.bytes[spans(first, count)], ends[bounds]


class Transducer:
    """Text to token ids and back, for a tokenizer file with byte symbols and a word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            setup = json.load(file)
        model = setup["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {a["content"]: a["id"] for a in setup["added_tokens"]}
        self.merges = Merges(model["vocab"], merges, model["end_of_word_suffix"])
        self.words = WordTable(self.merges)
        self.kinds = sign_kinds()
        self._split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.decoder = Decoder(self.names)

    # --- encoding ---

    def _pieces(self, text: str | None) -> Iterator[str | int]:
        """A text as ids of special tokens and pieces of about PIECE characters that end behind white
        space or, in a longer run without any, behind a word."""
        if not text:
            return
        for part in self._split.split(text) if self._split is not None and "<" in text else [text]:
            if part in self.special:
                yield self.special[part]
                continue
            start, n = 0, len(part)
            while n - start > PIECE:
                space = WHITE_RUN.search(part, start + PIECE // 2, start + PIECE)
                if space is None:
                    yield from self._unspaced(part[start:])
                    break
                yield part[start:space.end()]
                start = space.end()
            else:
                if start < n:
                    yield part[start:]

    def _unspaced(self, text: str) -> Iterator[str]:
        """A text whose white space is rare, cut behind words of the pattern."""
        text, start, end = _normalised(text), 0, 0
        for word in ANY_TEXT.finditer(text):
            if word.end() - start > PIECE and end > start:
                yield text[start:end]
                start = end
            end = word.end()
        yield text[start:]

    def stream(self, text: str | None) -> Iterator[np.ndarray]:
        """Token ids of a text, piece by piece."""
        for piece in self._pieces(text):
            yield np.array([piece], np.uint32) if isinstance(piece, int) else self._encoded([piece])[0]

    def _encoded(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of each of several pieces, which are encoded together."""
        pieces = [_normalised(p) for p in pieces]
        text = "\n".join(pieces)
        if text.isascii():
            signs = np.frombuffer(text.encode(), np.uint8)
        else:
            signs = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts, ends = split_words(signs, self.kinds)
        ids, counts = self.words.encode(text, signs, starts, ends)
        behind = np.cumsum([len(p) + 1 for p in pieces])[:-1]
        before = np.append(0, np.cumsum(counts))
        return np.split(ids, before[np.searchsorted(starts, behind)])

    def encode(self, text: str | None) -> list[int]:
        """All ids of a text."""
        return self.encode_batch([text])[0].tolist()

    def encode_batch(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids of several texts; their pieces are encoded together up to PIECE characters."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held, owners, size = [], [], 0

        def flush():
            nonlocal held, owners, size
            if held:
                for owner, ids in zip(owners, self._encoded(held)):
                    out[owner].append(ids)
            held, owners, size = [], [], 0

        for i, text in enumerate(texts):
            for piece in self._pieces(text):
                if isinstance(piece, int):
                    flush()
                    out[i].append(np.array([piece], np.uint32))
                    continue
                if size + len(piece) > PIECE:
                    flush()
                held.append(piece)
                owners.append(i)
                size += len(piece)
        flush()
        none = np.empty(0, np.uint32)
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else none for x in out]

    # --- decoding ---

    def decode(self, ids: Iterable[int]) -> str:
        """The token names joined by spaces, see ``Decoder``."""
        self.decoder.begun = False
        return self.decoder.push(np.fromiter(ids, np.int64)).decode()

    def decode_text(self, ids: Iterable[int]) -> Iterator[str]:
        """Readable text, piece by piece: bytes pass through an incremental UTF-8 state machine,
        so a character whose bytes lie in several tokens appears with its last byte. A word
        end is a space; bytes that are no UTF-8 become U+FFFD."""
        value = {s: bytes([b]) for b, s in enumerate(byte_signs())}
        machine, suffix = codecs.getincrementaldecoder("utf-8")("replace"), self.merges.suffix
        special = set(self.special.values())
        for i in ids:
            name = self.names[i]
            if i in special:
                yield machine.decode(b"", True) + name
                machine.reset()
                continue
            end = name.endswith(suffix)
            text = machine.decode(b"".join(value[c] for c in (name[:-len(suffix)] if end else name)), end)
            if end:
                machine.reset()
            yield text + " " * end
        yield machine.decode(b"", True)


def _normalised(text: str) -> str:
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    # Final sigma depends on its neighbours in str.lower(), which the tokenizer's rule does not.
    return text.lower() if "Σ" not in text else "".join(map(str.lower, text))


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One transducer per Python worker and file."""
    return Transducer(path)
