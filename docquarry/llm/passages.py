"""Equal passages anywhere in texts: winnowed word runs as seeds, extended word by word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.store import BROADCAST_IDS, stored
from docquarry.llm.tokens import text_batches
from docquarry.llm.words import STEP, Words, mixed

INVERSE = np.uint64(pow(int(STEP), -1, 2**64))
NONE = np.iinfo(np.int64).max  # no document
RUNS = "doc_id bigint, first_word bigint, last_word bigint, words array<bigint>, chars array<bigint>, keeps array<bigint>, items array<bigint>, left_item bigint, right_item bigint, left_keys array<bigint>, left_chars array<bigint>, right_keys array<bigint>, right_chars array<bigint>"


def signs_before(words: Words) -> np.ndarray:
    """Characters before each byte."""
    return np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])


class Grams:
    """Hashes of any runs of words of a batch; equal words give equal hashes wherever they stand."""

    def __init__(self, words: Words):
        n = len(words.hashes)
        powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, STEP)))
        self.back = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, INVERSE)))
        self.sums = np.append(np.uint64(0), np.cumsum(words.hashes * powers[:n], dtype=np.uint64))

    def of(self, first: np.ndarray, count) -> np.ndarray:
        return mixed((self.sums[first + count] - self.sums[first]) * self.back[first] + np.asarray(count, np.uint64)).view(np.int64)


def places(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all runs of ``size`` words within one text, and their texts."""
    count = np.maximum(np.diff(words.first) - size + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    return np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + words.first[text], text


def seeds(words: Words, grams: Grams, size: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, text and hash of the winnowed runs of ``size`` words: of each ``window`` runs in a row
    the one of the smallest hash, the last of equal ones. It follows from the words in the window only."""
    at, text = places(words, size)
    items = grams.of(at, size)
    if len(at) < window:
        return at[:0], text[:0], items[:0]
    least, where = items[:len(at) - window + 1].copy(), np.arange(len(at) - window + 1)
    for k in range(1, window):
        other = items[k:len(at) - window + 1 + k]
        smaller = other <= least
        least[smaller] = other[smaller]
        where[smaller] = np.flatnonzero(smaller) + k
    where = np.unique(where[text[:len(where)] == text[window - 1:]])
    return at[where], text[where], items[where]


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of the wanted keys in sorted ``keys``, or NONE."""
    if not len(keys):
        return np.full(len(wanted), NONE)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], NONE)


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(flat.astype(np.int64)))


def _ranks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of each element of lists of ``counts`` elements."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _batch_runs(words: Words, ids: np.ndarray, first: np.ndarray, found: tuple, grams: Grams, size: int, least: int) -> list[pa.Array]:
    """Arrays of RUNS: stretches covered by seeds that an earlier document has, and the runs of words
    that reach up to ``least - size`` words beyond their first and last seed."""
    at, text, items = found
    hit = np.flatnonzero(first < ids[text])
    at, text, items, first = at[hit], text[hit], items[hit], first[hit]
    new = np.ones(len(at), bool)
    new[1:] = (text[1:] != text[:-1]) | (at[1:] - at[:-1] > size)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at))[:len(begin)] - 1
    low, high, reach = words.first[text[begin]], words.first[text[begin] + 1], least - size
    left, right = np.minimum(at[begin] - low, reach), np.minimum(high - at[end] - size, reach)
    long = at[end] + size - at[begin] + left + right >= least
    begin, end, low, left, right = begin[long], end[long], low[long], left[long], right[long]
    signs = signs_before(words)
    starts = np.append(words.starts, len(words.data))

    def chars(word, row):  # where a word starts in its text, or where the text ends
        owner = text[row]
        return signs[np.minimum(starts[word], words.bounds[owner + 1])] - signs[words.bounds[owner]]

    # Seeds in a row that the same document keeps are one stretch; the first and the last stand alone.
    apart = new.copy()
    apart[1:] |= (first[1:] != first[:-1]) | new[:-1] | np.append(new[2:], True)
    within = np.flatnonzero(apart)
    smallest = np.minimum.reduceat(items, within) if len(within) else items
    run_of = np.cumsum(new)[within]
    kept = np.isin(run_of, np.cumsum(new)[begin])
    stretch, smallest = within[kept], smallest[kept]
    counts = np.unique(run_of[kept], return_counts=True)[1]
    row, k = _ranks(left)
    row_end, k_end = _ranks(right)
    row_at, k_at = _ranks(left + 1)
    row_to, k_to = _ranks(right + 1)
    origin = words.first[text[stretch]]
    return [
        pa.array(ids[text[begin]]), pa.array(at[begin] - low), pa.array(at[end] + size - low),
        _lists(at[stretch] - origin, counts), _lists(chars(at[stretch], stretch), counts), _lists(first[stretch], counts), _lists(smallest, counts),
        pa.array(items[begin]), pa.array(items[end]),
        _lists(grams.of(at[begin][row] - k - 1, size + k + 1), left), _lists(chars(at[begin][row_at] - k_at, begin[row_at]), left + 1),
        _lists(grams.of(at[end][row_end], size + k_end + 1), right), _lists(chars(at[end][row_to] + size + k_to, end[row_to]), right + 1)]


def _runs(documents: DataFrame, shared: DataFrame, size: int, window: int, least: int, limit: int) -> DataFrame:
    """RUNS of documents(doc_id, text) by shared(item, first).

    At most ``limit`` items go to all tasks; more are joined by a shuffle with the seeds of each text."""
    small = shared.limit(limit + 1).count() <= limit
    if small:
        table = shared.toArrow().sort_by("item")
        sent = documents.sparkSession.sparkContext.broadcast([table.column(c).to_numpy() for c in ("item", "first")])
    else:
        def numbered(batches):
            for part, _ in text_batches(batches, values=False):
                words = Words(part.column(1))
                _, text, items = seeds(words, Grams(words), size, window)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), part.column(2).take(pa.array(text)), pa.array(np.arange(len(text)) - np.searchsorted(text, text)), pa.array(items)], ["doc_id", "mark", "n", "item"])

        documents = documents.withColumn("mark", F.xxhash64("text"))
        rows = documents.distinct().mapInArrow(numbered, "doc_id bigint, mark bigint, n bigint, item bigint").join(shared, "item").filter("first < doc_id")
        matched = rows.groupBy("doc_id", "mark").agg(F.collect_list("n").alias("ns"), F.collect_list("first").alias("firsts"))
        documents = documents.join(matched, ["doc_id", "mark"]).select("doc_id", "text", "ns", "firsts")

    def run(batches):
        for part, _ in text_batches(batches, values=False):
            words = Words(part.column(1))
            grams = Grams(words)
            found = seeds(words, grams, size, window)
            if small:
                first = _looked_up(*sent.value, found[2])
            else:
                first = np.full(len(found[0]), NONE)
                for i, (ns, firsts) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                    first[np.searchsorted(found[1], i) + np.array(ns, np.int64)] = firsts
            yield pa.RecordBatch.from_arrays(_batch_runs(words, part.column(0).to_numpy(), first, found, grams, size, least), [c.split()[0] for c in RUNS.split(", ")])

    return documents.mapInArrow(run, RUNS)


def _edge_keys(documents: DataFrame, items: np.ndarray, sides: np.ndarray, size: int, reach: int) -> DataFrame:
    """Every place of the sorted ``items`` with 1 to ``reach`` words before it (``sides`` & 1) or behind it (& 2)
    -> key, doc_id: hash of all these words."""
    sent = documents.sparkSession.sparkContext.broadcast((items, sides))

    def run(batches):
        known, sides = sent.value
        maybe = np.zeros(1 << 22, bool)
        maybe[known.view(np.uint64) >> np.uint64(42)] = True
        for part, _ in text_batches(batches, values=False):
            words = Words(part.column(1))
            grams, ids = Grams(words), part.column(0).to_numpy()
            at, text = places(words, size)
            hashes = grams.of(at, size)
            some = np.flatnonzero(maybe[hashes.view(np.uint64) >> np.uint64(42)])
            side = _looked_up(known, sides, hashes[some])
            keys, owners = [], []
            for bit in (1, 2):
                chosen = some[(side != NONE) & (side & bit > 0)]
                begin, owner = at[chosen], text[chosen]
                room = begin - words.first[owner] if bit == 1 else words.first[owner + 1] - begin - size
                row, k = _ranks(np.minimum(room, reach))
                keys.append(grams.of(begin[row] - k - 1 if bit == 1 else begin[row], size + k + 1))
                owners.append(ids[owner[row]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, owners)], ["key", "doc_id"])

    return documents.mapInArrow(run, "key bigint, doc_id bigint")


def _removed(least: int):
    """Rows of runs with the words that their ends are extended by -> one row per stretch."""

    def run(batches):
        for part in batches:
            out = []
            for r in part.to_pylist():
                left, left_keep = (r["left"]["n"], r["left"]["first"]) if r["left"] else (0, None)
                right, right_keep = (r["right"]["n"], r["right"]["first"]) if r["right"] else (0, None)
                if r["last_word"] - r["first_word"] + left + right < least:
                    continue
                cuts = [list(x) for x in zip(r["words"], r["chars"], r["keeps"], r["items"])]
                # The words beyond an end, with its seed, are in the document that has them all.
                if right:
                    cuts[-1][2] = right_keep
                if left and right and len(cuts) == 1 and left_keep != right_keep:
                    cuts.insert(0, list(cuts[0]))
                if left:
                    cuts[0][2] = left_keep
                cuts[0][:2] = r["first_word"] - left, r["left_chars"][left]
                joined = cuts[:1]
                for cut in cuts[1:]:
                    if cut[2] != joined[-1][2]:
                        joined.append(cut)
                    joined[-1][3] = min(joined[-1][3], cut[3])
                cuts = joined
                ends = [*((w, c) for w, c, _, _ in cuts[1:]), (r["last_word"] + right, r["right_chars"][right])]
                out += [(r["doc_id"], k, i, w, c, e - c, n - w) for (w, c, k, i), (n, e) in zip(cuts, ends)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(7)], ["doc_id", "keep_doc_id", "component_id", "paragraph", "start", "length", "n_words"])

    return run


def repeated_passages(documents: DataFrame, passage_words: int, limit: int = BROADCAST_IDS) -> DataFrame:
    """Stretches of at least ``passage_words`` words in a row that earlier documents have.

    ``documents(doc_id, text)``, no NULL ids -> ``doc_id``, ``keep_doc_id``, ``component_id``, ``whole_line``
    (false), ``paragraph`` (number of the first word), ``start``, ``length`` (characters up to the next
    word), ``n_words``. Line ends are white space like any other.

    Seeds are runs of just over half of the words, chosen by their hashes alone in windows that a
    passage cannot avoid, so every equal passage has its first and last seed near its ends and no gap
    between. Seeds of an earlier document join to a run; its ends then take the longest runs of words
    around its first and last seed that any earlier document has. So no repeat of ``passage_words``
    words is missed, whichever documents share parts of it. A run whose parts different documents
    keep has a row for each part. ``limit``: items that are sent to every task."""
    size = passage_words // 2 + 1
    window = passage_words - size + 1
    documents = documents.select("doc_id", "text")

    def seeded(batches):
        for part, _ in text_batches(batches, values=False):
            words = Words(part.column(1))
            _, text, items = seeds(words, Grams(words), size, window)
            yield pa.RecordBatch.from_arrays([pa.array(items), part.column(0).take(pa.array(text))], ["item", "doc_id"])

    found = documents.mapInArrow(seeded, "item bigint, doc_id bigint")
    shared = stored(found.groupBy("item").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("item", "first"))
    runs = _runs(documents, shared, size, window, passage_words, limit)
    runs = stored(runs.distinct().withColumn("run", F.xxhash64(*runs.columns)))

    edges = runs.select(F.col("left_item").alias("item"), F.lit(1).alias("side")).unionAll(runs.select(F.col("right_item"), F.lit(2)))
    edges = stored(edges.groupBy("item").agg(F.bit_or(F.col("side").cast("bigint")).alias("side")))
    parts = max(1, -(-edges.count() // limit))  # each part goes to all tasks, in a pass of its own
    keys = None
    for part in range(parts):
        table = edges.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).toArrow().sort_by("item")
        some = _edge_keys(documents, table.column("item").to_numpy(), table.column("side").to_numpy(), size, passage_words - size)
        keys = some if keys is None else keys.unionAll(some)
    keys = stored(keys.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("key", "first"))
    sides = [runs.select("run", "doc_id", F.lit(side).alias("side"), F.posexplode(f"{side}_keys").alias("n", "key")) for side in ("left", "right")]
    longer = sides[0].unionAll(sides[1]).join(keys, "key").filter("first < doc_id").groupBy("run")
    best = [F.max(F.when(F.col("side") == side, F.struct((F.col("n") + 1).alias("n"), "first"))).alias(side) for side in ("left", "right")]
    rows = runs.join(longer.agg(*best), "run", "left")
    out = rows.mapInArrow(_removed(passage_words), "doc_id bigint, keep_doc_id bigint, component_id bigint, paragraph bigint, start bigint, length bigint, n_words bigint")
    return out.withColumn("whole_line", F.lit(False))
