"""Document quality: random-indexing word vectors, pooled, and a small calibrated network."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.store import rows_of, stored
from docquarry.llm.tokens import text_batches
from docquarry.llm.words import BYTE_VALUES, SPACE, STEP, mixed, text_bytes

#: Word buckets, dimensions and non-zero signs of an index vector: the table is 2 MB whatever the corpus.
BUCKETS, DIM, SIGNS = 8192, 64, 4
REACH = 2  # neighbours on either side
FEATURES = 2 * DIM + 5
#: Labelled documents that the network is fitted on, at most.
LABELLED_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 256, 0.003, 1e-4

_KIND = np.full(256, 1, np.int8)  # letters and bytes of letters beyond ASCII
_KIND[[b for b in range(128) if not chr(b).isalnum()]] = 2
_KIND[ord("0"):ord("9") + 1] = 3
_KIND[SPACE] = 0
_random = np.random.default_rng(11)
PLACES = np.stack([_random.permutation(DIM)[:SIGNS] for _ in range(BUCKETS)], 1)
VALUES = _random.choice([-1.0, 1.0], (SIGNS, BUCKETS))


def word_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word of all texts, and the number of words before each text. Words are runs of
    letters, of digits or of other signs, with their case."""
    data, bounds = text_bytes(texts)
    kind = _KIND[data]
    change = np.ones(len(kind), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[bounds[bounds < len(data)]] = True
    runs = np.flatnonzero(change)
    lengths = np.diff(np.append(runs, len(data)))
    if not len(runs):
        return np.empty(0, np.int64), np.zeros(len(bounds), np.int64)
    place = np.arange(len(data)) - np.repeat(runs, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max()) + 1, STEP))
    hashes = mixed(np.add.reduceat(BYTE_VALUES[data] * powers[place], runs) + lengths.astype(np.uint64))
    words = kind[runs] > 0
    return (hashes[words] % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(runs[words], bounds)


def word_vectors(documents: DataFrame) -> np.ndarray:
    """Random-indexing vectors of all word buckets, from every document.

    Each word adds the sparse index vectors of its neighbours to its own vector. A task sums
    its documents, and sums of tasks meet by bucket; only the fixed table reaches the driver.
    Vectors are scaled to unit length."""

    def gather(batches):
        total = np.zeros(BUCKETS * DIM)
        for part, _ in text_batches(batches, values=False):
            words, first = word_buckets(part.column(0))
            text = np.repeat(np.arange(part.num_rows), np.diff(first))
            cells, weights = [], []
            for away in range(1, REACH + 1):
                same = np.flatnonzero(text[away:] == text[:-away])
                for a, b in ((words[same], words[same + away]), (words[same + away], words[same])):
                    for places, values in zip(PLACES, VALUES):
                        cells.append(a * DIM + places[b])
                        weights.append(values[b])
            if cells:
                total += np.bincount(np.concatenate(cells), np.concatenate(weights), BUCKETS * DIM)
        rows = total.reshape(BUCKETS, DIM)
        yield _vector_batch(np.flatnonzero(rows.any(1)), rows)

    def add(batches):
        total = np.zeros((BUCKETS, DIM))
        for batch in batches:
            if batch.num_rows:
                np.add.at(total, batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, DIM))
        yield _vector_batch(np.flatnonzero(total.any(1)), total)

    parts = documents.selectExpr("cast(text as string) text").mapInArrow(gather, "bucket bigint, vector array<float>")
    sums = parts.repartition(16, "bucket").mapInArrow(add, "bucket bigint, vector array<float>").toArrow()
    out = np.zeros((BUCKETS, DIM))
    if sums.num_rows:
        out[sums.column(0).to_numpy()] = sums.column(1).combine_chunks().flatten().to_numpy().reshape(-1, DIM)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _vector_batch(buckets: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    values = pa.array(rows[buckets].astype(np.float32).ravel())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(buckets) + 1, dtype=np.int32) * np.int32(rows.shape[1])), values)
    return pa.RecordBatch.from_arrays([pa.array(buckets), lists], ["bucket", "vector"])


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean and deviation of the word vectors of each text, how alike its neighbouring vectors are, how
    often they are the same one or two words on, and the length."""
    words, first = word_buckets(texts)
    n = len(texts)
    count = np.diff(first)
    out = np.zeros((n, FEATURES))
    full = np.flatnonzero(count)
    if len(full):
        at, some = first[:-1][full], np.maximum(count[full], 1)[:, None]
        found = vectors[words]
        mean = np.add.reduceat(found, at) / some
        out[full, :DIM] = mean
        out[full, DIM:2 * DIM] = np.sqrt(np.maximum(np.add.reduceat(found * found, at) / some - mean * mean, 0))
        alike = np.zeros(len(words))
        alike[1:] = np.einsum("ij,ij->i", found[1:], found[:-1])
        alike[at] = 0
        out[full, -5] = np.add.reduceat(alike, at) / some[:, 0]
        out[full, -4] = np.linalg.norm(mean, axis=1)
        text = np.repeat(np.arange(n), count)
        for away in (1, 2):
            same = np.zeros(len(words))
            same[away:] = (words[away:] == words[:-away]) & (text[away:] == text[:-away])
            out[full, -1 - away] = np.add.reduceat(same, at) / some[:, 0]
    out[:, -1] = np.log1p(count)
    return out


@dataclass
class Network:
    """Two layers and a temperature; ``prior`` where there was nothing to learn."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.shift) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Network:
    """Fit on four fifths of the rows; the temperature minimises the loss on the rest."""
    random = np.random.default_rng(seed)
    size = x.shape[1]
    prior = (y.sum() + 1) / (len(y) + 2)
    net = Network(np.zeros(size), np.ones(size), np.zeros((size, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(prior / (1 - prior))), 1.0)
    if len(set(y.tolist())) < 2:
        return net
    order = random.permutation(len(y))
    held, used = order[:len(y) // 5], order[len(y) // 5:]
    net.shift, net.scale = x[used].mean(0), x[used].std(0) + 1e-3
    z = (x - net.shift) / net.scale
    net.w1, net.w2 = random.normal(0, np.sqrt(2 / size), (size, HIDDEN)), random.normal(0, np.sqrt(1 / HIDDEN), HIDDEN)
    values = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for _ in range(EPOCHS):
        used = random.permutation(used)
        for start in range(0, len(used), BATCH):
            rows = used[start:start + BATCH]
            hidden = np.maximum(z[rows] @ values[0] + values[1], 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ values[2] + values[3], -500, 500))) - y[rows]) / len(rows)
            back = np.outer(error, values[2]) * (hidden > 0)
            slopes = [z[rows].T @ back + DECAY * values[0], back.sum(0), hidden.T @ error + DECAY * values[2], np.array([error.sum()])]
            step += 1
            for v, g, a, b in zip(values, slopes, first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                v -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = *values[:3], float(values[3][0])
    if len(held) >= 10:
        logits = net.logits(x[held])
        grid = np.geomspace(0.25, 16, 97)
        losses = [np.mean(np.logaddexp(0, logits / t) - y[held] * logits / t) for t in grid]
        net.temperature = float(grid[int(np.argmin(losses))])
    return net


def fold(doc_id: Column, folds: int, held_out: int) -> Column:
    """Whether crc32 of the id as text leaves ``held_out`` modulo ``folds``; false for NULL."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == held_out, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, held_out: Column, rows: int) -> DataFrame:
    """doc_id and label of at most ``rows`` labelled documents that are not held out, spread evenly by a hash."""
    found = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)")
    found = found.filter(~held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    return stored(found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network


def fit_quality(documents: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, folds: int = 3, held_out: int = 1) -> QualityModel:
    """Word vectors of all ``documents(doc_id, text)`` and a network for ``labels(doc_id, quality)``.

    The network is fitted on at most ``labelled_rows`` documents outside the held-out fold.
    NULL labels are ignored; a document with several labels counts with the larger one.
    Without documents of both labels the score is the share of label 1."""
    vectors = word_vectors(documents)
    shared = documents.sparkSession.sparkContext.broadcast(vectors)
    chosen = labelled_sample(labels, "quality", fold(F.col("doc_id"), folds, held_out), labelled_rows)
    rows = documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")

    def features(batches):
        for part, _ in text_batches(batches, values=False):
            found = pooled(part.column(1), shared.value)
            _, lists = _vector_batch(np.arange(len(found)), found).columns
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "vector"])

    points = rows_of(rows, chosen.select("doc_id"), "doc_id").mapInArrow(features, "doc_id bigint, vector array<float>")
    points = points.join(F.broadcast(chosen), "doc_id").limit(2 * labelled_rows).select("doc_id", "label", "vector").toArrow().sort_by("doc_id")
    x = points.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES).astype(float) if points.num_rows else np.zeros((0, FEATURES))
    return QualityModel(vectors, fit_network(x, points.column("label").to_numpy().astype(float)))


def score_quality(documents: DataFrame, model: QualityModel) -> DataFrame:
    """``documents(doc_id, text)`` -> doc_id, score: probability of label 1 for every row, from the whole
    text. NULL and empty texts have no words and get the score of that. Other columns are ignored."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part, _ in text_batches(batches, values=False):
            score = shared.value.network.probability(pooled(part.column(1), shared.value.vectors))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], ["doc_id", "score"])

    return documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id bigint, score double")
