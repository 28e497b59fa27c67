"""Ranked lexical search: dense products of question tiles and chunk impact tiles."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docquarry.llm.store import stored
from docquarry.llm.tokens import text_batches
from docquarry.llm.words import text_bytes
from docquarry.scale import top_k

TERMS_PER_PASS = 200_000  # distinct (question, term) of the questions that one pass answers
BYTES_PER_PASS = 32 * 1024 * 1024  # bytes of their terms
TILE_QUESTIONS = 64
TILE_TERMS = 4096
TILE_CHUNKS = 512
EXACT = 1 << 53  # integers below are exact in float64

#: Lower-cased letters and digits and all bytes of other alphabets; 0 separates terms.
LETTERS = np.zeros(256, np.uint8)
LETTERS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)


def text_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms of all texts in order, as bytes, and the number of terms before each text (and behind the last)."""
    data, bounds = text_bytes(texts)
    data = LETTERS[data]
    inside = data != 0
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    before[bounds[(bounds > 0) & (bounds < len(inside))]] = False
    starts = np.flatnonzero(inside & ~before)
    letters = np.concatenate([[0], np.cumsum(inside)])
    offsets = np.append(letters[starts], letters[-1]).astype(np.int64)
    terms = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside].tobytes())])
    return terms, np.searchsorted(starts, bounds)


def question_terms(questions: DataFrame) -> DataFrame:
    """``questions(query_id, question)`` -> distinct ``query_id``, ``term`` (bytes)."""
    kind = questions.schema["query_id"].dataType.simpleString()

    def run(batches):
        for part, _ in text_batches(batches, "question", values=False):
            terms, first = text_terms(part.column(1))
            owner = pa.array(np.repeat(np.arange(part.num_rows), np.diff(first)))
            yield pa.RecordBatch.from_arrays([part.column(0).take(owner), terms.cast(pa.binary())], ["query_id", "term"])

    rows = questions.select("query_id", F.col("question").cast("string").alias("question")).filter("query_id IS NOT NULL")
    return rows.mapInArrow(run, f"query_id {kind}, term binary").distinct()


def counted_terms(chunks: DataFrame, vocabulary) -> DataFrame:
    """``chunks(chunk_id, text)`` -> ``chunk_id``, ``n`` (terms of the text), and ``terms``, ``counts``: places in the vocabulary and occurrences."""
    kind = chunks.schema["chunk_id"].dataType.simpleString()

    def run(batches):
        known = pa.array(vocabulary.value, pa.large_binary())
        size = max(1, len(known))
        for part, _ in text_batches(batches, values=False):
            terms, first = text_terms(part.column(1))
            place = pc.index_in(terms, known)
            found = pc.is_valid(place).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(part.num_rows), np.diff(first))[found]
            keys, counts = np.unique(owner * size + place.drop_null().to_numpy().astype(np.int64), return_counts=True)
            offsets = np.searchsorted(keys, np.arange(part.num_rows + 1) * size).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(t))) for x, t in ((keys % size, np.int32), (counts, np.int64))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first).astype(np.int64)), *lists], ["chunk_id", "n", "terms", "counts"])

    return chunks.select("chunk_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"chunk_id {kind}, n bigint, terms array<int>, counts array<bigint>")


def frequencies(counted: DataFrame, size: int) -> DataFrame:
    """``place``, ``df``: chunks that hold the term; each task adds up its own chunks first."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(total[place])], ["place", "df"])

    return counted.select("terms").mapInArrow(run, "place int, df bigint").groupBy("place").agg(F.sum("df").alias("df"))


def question_tiles(asked: list[tuple[int, int]], weights: np.ndarray) -> list[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """Tiles of TILE_QUESTIONS questions from sorted pairs (question, place in the vocabulary).

    A tile has its questions and slabs of its compact vocabulary: the places of up to
    TILE_TERMS terms and the matrix of their weights. An impact is at most 10^6, so a slab
    also ends before 10^6 times the sum of its weights reaches 2^53: every partial sum is exact.
    """
    by_question = defaultdict(list)
    for question, place in asked:
        if weights[place]:
            by_question[question].append(place)
    numbers, tiles = sorted(by_question), []
    for start in range(0, len(numbers), TILE_QUESTIONS):
        members = numbers[start:start + TILE_QUESTIONS]
        places = np.unique(np.concatenate([by_question[q] for q in members]))
        limit = min(TILE_TERMS, max(1, (EXACT - 1) // (10**6 * int(weights.max()))))
        slabs = []
        for at in range(0, len(places), limit):
            part = places[at:at + limit]
            matrix = np.zeros((len(members), len(part)))
            for row, q in enumerate(members):
                mine = np.intersect1d(by_question[q], part)
                matrix[row, np.searchsorted(part, mine)] = weights[mine]
            slabs.append((part, matrix))
        tiles.append((np.array(members), slabs))
    return tiles


def impacts(counts: np.ndarray, n: np.ndarray, chunks: int, terms: int, saturation: int, length_percent: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 10 saturation m) with m = 100 - length_percent + (length_percent n chunks) div terms."""
    if len(n) and length_percent * int(n.max()) * chunks >= 1 << 63:
        share = np.array([length_percent * int(x) * chunks // terms for x in n])
    else:
        share = length_percent * n * chunks // max(1, terms)
    return 10**9 * counts // (1000 * counts + 10 * saturation * (100 - length_percent + share))


def best_of(kept: list[tuple], scores: np.ndarray, ids: pa.Array, k: int) -> list[tuple]:
    """The k best (-score, chunk_id) of those kept and of a tile's row of scores; ties at the bound are all looked at."""
    least = -kept[-1][0] if len(kept) == k else 1
    if len(scores) > k:
        least = max(least, int(np.partition(scores, -k)[-k]))
    at = np.flatnonzero(scores >= max(least, 1))
    if not len(at):
        return kept
    return sorted(kept + list(zip((-scores[at]).tolist(), ids.take(pa.array(at)).to_pylist())))[:k]


def tile_scores(counted: DataFrame, tiles, names: list, kind, chunks: int, terms: int, size: int, k: int, saturation: int, length_percent: int) -> DataFrame:
    """The k best chunks of every question among the chunks of each task."""
    schema = counted.schema
    out_type = to_arrow_type(kind)

    def blocks(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TILE_CHUNKS):
                yield batch.slice(start, TILE_CHUNKS)

    def run(batches):
        best = [[] for _ in names]
        id_type = None
        compact = np.full(size, -1, np.int64)
        for block in blocks(batches):
            id_type = block.schema.field(0).type
            lists, values = block.column(2), block.column(3).flatten().to_numpy()
            owner = np.repeat(np.arange(block.num_rows), pc.list_value_length(lists).to_numpy())
            place = lists.flatten().to_numpy()
            n = block.column(1).to_numpy()
            impact = impacts(values, n[owner], chunks, terms, saturation, length_percent)
            for members, slabs in tiles.value:
                scores = np.zeros((len(members), block.num_rows), np.int64)
                for part, matrix in slabs:
                    compact[part] = np.arange(len(part))
                    row = compact[place]
                    here = row >= 0
                    tile = np.zeros((len(part), block.num_rows))
                    tile[row[here], owner[here]] = impact[here]
                    scores += (matrix @ tile).astype(np.int64)
                    compact[part] = -1
                for i, question in enumerate(members):
                    best[question] = best_of(best[question], scores[i], block.column(0), k)
        if id_type is None:
            return
        rows = [(names[q], doc, -score) for q, kept in enumerate(best) for score, doc in kept]
        for start in range(0, len(rows), 10_000):
            query, doc, score = zip(*rows[start:start + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(query, out_type), pa.array(doc, id_type), pa.array(score, pa.int64())], ["query_id", "chunk_id", "score"])

    rows = counted.filter("chunk_id IS NOT NULL AND size(terms) > 0").select("chunk_id", "n", "terms", "counts")
    return rows.mapInArrow(run, f"query_id {kind.simpleString()}, chunk_id {schema['chunk_id'].dataType.simpleString()}, score bigint")


def ranked_search(questions: DataFrame, chunks: DataFrame, k: int = 50, saturation: int = 2, length_percent: int = 50, salts: int = 8) -> DataFrame:
    """The ``k`` chunks of the highest lexical score for each question.

    ``questions(query_id, question)``, ``chunks(chunk_id, text)`` -> ``query_id``,
    ``rank_position``, ``chunk_id``, ``score``. Terms are runs of ASCII letters and digits and
    of all characters beyond ASCII; A-Z are lower-cased. A term weighs floor(1000 ln((2N + 2) /
    (2 df + 1))) and its impact in a chunk is integral, see ``impacts``; a score is the sum of
    weight times impact over the question's distinct terms. Equal scores go by chunk_id.

    Texts are read once per pass: each chunk keeps its counts of the questions' terms. Tasks turn
    blocks of chunks into dense impact tiles and multiply them with tiles of questions over
    their compact vocabulary, in float64 whose partial sums stay below 2^53, and keep a running
    k best per question, so no pair with a low score leaves a task. A pass answers the questions
    whose terms meet two documented bounds (TERMS_PER_PASS, BYTES_PER_PASS; a hash deals them
    out); further questions take further passes, so what the driver and tasks hold does not grow.

    A NULL or empty text has no terms and is not found; its row counts nowhere. Chunks
    without an id count in N, L and df and are not ranked. Repeated chunk rows are ranked each;
    rows that repeat a query_id are one question with all their terms; questions without an id
    or without terms have no rows. Other columns are ignored; empty tables give no rows.
    """
    spark = chunks.sparkSession
    kind = questions.schema["query_id"].dataType
    asked = stored(question_terms(questions))
    pairs, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    passes = max(-(-pairs // TERMS_PER_PASS), -(-size // BYTES_PER_PASS))
    found = None
    for number in range(passes):
        mine = [tuple(r) for r in asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == number).collect()]  # bounded, see above
        words = sorted({bytes(term) for _, term in mine})
        if not words:
            continue
        names = sorted({query for query, _ in mine})
        at, place = {q: i for i, q in enumerate(names)}, {w: i for i, w in enumerate(words)}
        counted = stored(counted_terms(chunks, spark.sparkContext.broadcast(words)))
        total, terms = counted.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(words), np.int64)
        for r in frequencies(counted, len(words)).collect():  # a row per word of this pass
            df[r[0]] = r[1]
        weights = np.floor(1000 * np.log((2.0 * total + 2) / (2.0 * df + 1))).astype(np.int64)
        tiles = spark.sparkContext.broadcast(question_tiles(sorted((at[q], place[bytes(t)]) for q, t in mine), weights))
        part = tile_scores(counted, tiles, names, kind, total, terms, len(words), k, saturation, length_percent)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"query_id {kind.simpleString()}, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, score bigint")
    best = top_k(found, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k, salt=F.col("chunk_id"), salts=salts)
    return best.select("query_id", "rank_position", "chunk_id", "score")
