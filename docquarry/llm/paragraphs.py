"""Passages that repeat across documents: paragraph MinHash banding, components, removal."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.near import MinHash, near_components
from docquarry.llm.passages import repeated_passages, signs_before
from docquarry.llm.store import rows_of, stored
from docquarry.llm.tokens import text_batches
from docquarry.llm.words import PLACES, SHINGLE, Words, mixed

LEAST_WORDS = 8  # of a line that is compared as a whole
PASSAGE_WORDS = 25  # repeated in a row, before anything is removed
NEWLINE = ord("\n")


def tuned(similarity: float, recall: float, rows: int = 3) -> MinHash:
    """The fewest bands of ``rows`` minima that find a pair of ``similarity`` with ``recall``."""
    return MinHash(math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)), rows, 256)


def _lines(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start and end of each line in bytes."""
    breaks = np.flatnonzero(data == NEWLINE)
    starts = np.union1d(bounds[:-1], breaks + 1)
    starts = starts[starts < len(data)]
    text = np.searchsorted(bounds, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], len(data)), bounds[text + 1])
    return text, starts, ends


LINES = "doc_id bigint, paragraph bigint, start bigint, length bigint, n_words bigint, item bigint, n_shingles bigint, keys array<bigint>, whole array<bigint>, sketch array<bigint>, text string"


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of runs from ``first`` on, the place of each within its run, and where the runs begin."""
    begins = np.cumsum(count) - count
    place = np.arange(int(count.sum())) - np.repeat(begins, count)
    return np.repeat(first, count) + place, place, begins


def span_hashes(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of each run of words; no run is empty."""
    if not len(first):
        return np.empty(0, np.uint64)
    at, place, begins = _spread(first, last - first)
    powers = np.multiply.accumulate(np.full(int(place.max()) + 1, PLACES[0]))
    return mixed(np.add.reduceat(hashes[at] * powers[place], begins) + (last - first).astype(np.uint64))


def _line_signatures(words: Words, first: np.ndarray, last: np.ndarray, scheme: MinHash) -> tuple[np.ndarray, list[pa.ListArray]]:
    """Number of shingles, band keys and odd sketches of lines of SHINGLE or more words, for all of them at once."""
    n = len(first)
    flat = sum(words.hashes[k:len(words.hashes) - SHINGLE + 1 + k] * PLACES[k] for k in range(SHINGLE))
    at, _, begins = _spread(first, last - first - SHINGLE + 1)
    shingles, line = mixed(flat[at]), np.repeat(np.arange(n), last - first - SHINGLE + 1)
    minima = np.stack([np.minimum.reduceat(shingles * f + s, begins) for f, s in zip(scheme.factors, scheme.shifts)], 1)
    keys = scheme.keys(minima).view(np.int64)
    order = np.lexsort((shingles, line))
    line, shingles = line[order], shingles[order]
    once = np.append(True, (shingles[1:] != shingles[:-1]) | (line[1:] != line[:-1]))
    line, shingles = line[once], shingles[once]  # the different ones of each line, sorted
    count = np.bincount(line, minlength=n)

    def odd(line, samples, kept):
        """Parities of samples of the lines that are kept, NULL for others."""
        seat = np.cumsum(kept) - 1
        bits = np.bincount(seat[line] * scheme.bits + scheme.places(samples), minlength=int(kept.sum()) * scheme.bits) & 1
        offsets = np.append(0, np.cumsum(kept) * (scheme.bits // 64)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.packbits(bits.astype(np.uint8)).view(np.int64)), mask=pa.array(~kept))

    small, long = count <= scheme.bits, count > scheme.bits // 2
    some = small[line]
    whole = odd(line[some], shingles[some], small)
    # Of long lines the smallest shingle of each bin.
    some = long[line]
    owner, samples = line[some], shingles[some]
    first_of = np.unique(owner * scheme.bits + scheme.bins(samples), return_index=True)[1]
    sketch = odd(owner[first_of], samples[first_of], long)
    keys = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(scheme.bands)), pa.array(keys.ravel()))
    return count, [keys, whole, sketch]


def lines(documents: DataFrame, scheme: MinHash, least_words: int = LEAST_WORDS) -> DataFrame:
    """``documents(doc_id, text)`` -> its lines of at least ``least_words`` (five or more) words, numbered
    from 0, with ``start`` and ``length`` in characters up to the next line, and ``item``: a hash of
    the words. The first line of an item in a batch also has its signature and its text; in the others they are NULL."""

    def run(batches):
        for part, _ in text_batches(batches, values=False):
            words = Words(part.column(1))
            signs = signs_before(words)
            text, starts, ends = _lines(words.data, words.bounds)
            first, last = np.searchsorted(words.starts, [starts, ends])
            text, starts, ends, first, last = (x[last - first >= least_words] for x in (text, starts, ends, first, last))
            if not len(text):
                continue
            number = np.arange(len(text)) - np.searchsorted(text, text)
            items = span_hashes(words.hashes, first, last)
            once = np.sort(np.unique(items, return_index=True)[1])
            count, lists = _line_signatures(words, first[once], last[once], scheme)
            raw = [words.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[once].tolist(), ends[once].tolist())]
            seat = np.zeros(len(items), np.int64)
            seat[once] = np.arange(len(once))
            seat = pa.array(seat, mask=~np.isin(np.arange(len(items)), once))
            columns = [number, signs[starts] - signs[words.bounds[text]], signs[ends] - signs[starts], last - first]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(text)), *(pa.array(c.astype(np.int64)) for c in columns), pa.array(items.view(np.int64)),
                 *(c.take(seat) for c in (pa.array(count), *lists, pa.array(raw, pa.string())))],
                [c.split()[0] for c in LINES.split(", ")])

    rows = documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return rows.mapInArrow(run, LINES)


def repeated_paragraphs(documents: DataFrame, percent: int = 75, recall: float = 0.998, least_words: int = LEAST_WORDS, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """Paragraphs to remove because an earlier document has them.

    ``documents(doc_id, text)`` -> ``doc_id``, ``keep_doc_id``, ``component_id``, ``whole_line``,
    ``paragraph``, ``start``, ``length`` (characters), ``n_words``: one row per removed paragraph.

    Lines are paragraphs: bands tuned to ``recall`` join colliding lines, full shingle sets
    confirm a Jaccard similarity of ``percent``, components are clusters. The smallest doc_id of a
    cluster keeps its lines; in other documents lines in a row, of at least ``passage_words`` words
    together, go. Lines of fewer than ``least_words`` words between them are not counted.
    Equal passages are found wherever they lie and however their lines are broken, see
    ``repeated_passages``. Shorter repeats stay, as do repeats within one document.

    Equal paragraphs are combined before any pair is formed, so a passage of any number of
    documents is one item. NULL, empty and blank texts have no paragraphs; rows with a NULL
    doc_id are ignored; repeated rows count as one document. Other columns are ignored.
    """
    documents = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    scheme = tuned(percent / 100, recall)
    found = stored(lines(documents, scheme, least_words))
    signed = found.filter("n_shingles IS NOT NULL").select("item", "n_shingles", "keys", "whole", "sketch")
    near = near_components(signed, found.filter("text IS NOT NULL").select("item", "text"), scheme, percent, repeated=True)
    found = found.select("doc_id", F.lit(True).alias("whole_line"), "paragraph", "start", "length", "n_words", "item")
    named = near.withColumnsRenamed({"node": "item", "component": "component_id"})
    # Documents of each item, then of each cluster; items of one document and no similar line drop out here.
    items = found.groupBy("item").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).join(named, "item", "left")
    items = stored(items.filter("first < last OR component_id IS NOT NULL").withColumn("component_id", F.coalesce("component_id", "item")))
    clusters = items.groupBy("component_id").agg(F.min("first").alias("keep_doc_id"), F.max("last").alias("last")).filter("keep_doc_id < last").drop("last")
    shared = stored(items.select("item", "component_id").join(clusters, "component_id"))
    hits = rows_of(found, shared.select("item").distinct(), "item").distinct().join(shared, "item").filter("doc_id > keep_doc_id")
    run = F.col("paragraph") - F.dense_rank().over(Window.partitionBy("doc_id").orderBy("paragraph"))
    total = F.sum("n_words").over(Window.partitionBy("doc_id", "run"))
    hits = hits.withColumn("run", run).withColumn("total", total).filter(F.col("total") >= passage_words)
    columns = ["doc_id", "keep_doc_id", "component_id", "whole_line", "paragraph", "start", "length", "n_words"]
    return hits.select(columns).unionAll(repeated_passages(documents, passage_words).select(columns))


def without_paragraphs(documents: DataFrame, removed: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """``documents`` with the spans of ``removed(doc_id, start, length)`` cut out of ``text``.

    All columns stay; ``n_chars`` is counted anew where there is one. With ``drop_emptied`` documents
    go of which only white space is left. Only documents with a span are shuffled."""
    id_, cuts = "__id", "__spans"
    while {id_, cuts} & set(documents.columns):
        id_, cuts = id_ + "_", cuts + "_"
    spans = removed.groupBy(F.col("doc_id").cast("bigint").alias(id_)).agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias(cuts))
    spans = stored(spans)
    texts = documents.withColumn(id_, F.col("doc_id").cast("bigint"))
    ids = spans.select(id_)
    touched = rows_of(texts, ids, id_).join(spans, id_)
    zero = F.struct(F.lit("").alias("text"), F.lit(0).cast("bigint").alias("at"))
    text = F.col("text").cast("string")

    def cut(state, span):
        gap = F.when(span["start"] > state["at"], F.substr(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))).otherwise(F.lit(""))
        return F.struct(F.concat(state["text"], gap).alias("text"), F.greatest(state["at"], span["start"] + span["length"]).alias("at"))

    folded = F.aggregate(cuts, zero, cut, lambda s: F.concat(s["text"], F.substr(text, (s["at"] + 1).cast("int"))))
    cleaned = touched.withColumn("text", folded)
    if "n_chars" in documents.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    if drop_emptied:
        cleaned = cleaned.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    rest = rows_of(texts, ids, id_, how="left_anti")
    return rest.select(documents.columns).unionAll(cleaned.select(documents.columns))
