"""Winnowed document fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.tokens import text_batches
from docquarry.llm.words import STEP, mixed

GRAM = 12  # code points hashed together
SPAN = 32  # hashes of which the smallest is kept
BLOCK = 1 << 18  # windows computed together
LAST = 2**63 - 1
_BACK = pow(int(STEP), -1, 2**64)
_POWERS = np.multiply.accumulate(np.full(BLOCK + SPAN + GRAM, STEP))
_INVERSES = np.multiply.accumulate(np.full(BLOCK + SPAN + GRAM, np.uint64(_BACK)))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(points: np.ndarray, size: int = GRAM) -> np.ndarray:
    """32-bit hashes of all runs of ``size`` code points; of the whole text if it is shorter."""
    size = min(size, len(points))
    if not size:
        return np.empty(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(points.astype(np.uint64) + np.uint64(1)) * _POWERS[:len(points)])])
    return mixed((total[size:] - total[:-size]) * _INVERSES[:len(total) - size] + np.uint64(size)) >> np.uint64(32)


def winnow(points: np.ndarray, size: int = GRAM, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions that winnowing keeps, in order of position.

    Of every ``span`` hashes in a row the smallest is kept, the rightmost of equals; so two
    texts that share ``size + span - 1`` code points share a kept hash. A text with fewer
    hashes is one window; an empty text keeps none."""
    found = []
    windows = max(1, len(points) - size - span + 2)
    for start in range(0, windows, BLOCK):
        hashes = gram_hashes(points[start:start + BLOCK + span + size - 2], size)
        if not len(hashes):
            break
        # Smaller hashes first, then larger positions: one number each, whose minimum is unique.
        key = hashes << np.uint64(32) | (np.uint64(2**32 - 1) - np.arange(len(hashes), dtype=np.uint64))
        width = 1
        while width < min(span, len(hashes)):
            step = min(width, min(span, len(hashes)) - width)
            key = np.minimum(key[:-step], key[step:])
            width += step
        kept = key[np.flatnonzero(np.diff(key, prepend=key[:1] + np.uint64(1)))]
        found.append(np.stack([kept >> np.uint64(32), np.uint64(2**32 - 1) - (kept & np.uint64(2**32 - 1)) + np.uint64(start)]))
    if not found:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    hashes, positions = np.concatenate(found, axis=1)
    once = np.flatnonzero(np.diff(positions.astype(np.int64), prepend=-1))
    return hashes[once].astype(np.uint32), positions[once].astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of kept hashes that two texts have in common: twice the common ones by all, 1 for two empty sets."""
    a, b = np.unique(a), np.unique(b)
    return 2.0 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b)) if len(a) + len(b) else 1.0


def as_text(hashes: np.ndarray) -> str:
    """A fingerprint as a string: eight hexadecimal digits per kept hash, in order of position."""
    return hashes.astype(">u4").tobytes().hex()


RESULT = "doc_id bigint, n_chars bigint, edited_text string, fingerprint string, positions array<bigint>, edited_fingerprint string, edited_positions array<bigint>, near_edited double, near_next double"


def _next_in_order(documents: DataFrame, ranges: int) -> DataFrame:
    """Rows (range, ahead, at, doc_id, text), so that within each range sorted by these each row is
    followed by the next document. A row that opens a range stands, as ``ahead``, also behind
    the range before; the very first behind the last one."""
    from pyspark.ml.feature import Bucketizer  # on the driver only: tasks need no part of that package

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("at", F.coalesce("doc_id", F.lit(LAST))).withColumn("at_double", F.col("at").cast("double"))
    cuts = rows.approxQuantile("at_double", [i / ranges for i in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    rows = Bucketizer(splits=splits, inputCol="at_double", outputCol="range").transform(rows) if len(splits) > 2 else rows.withColumn("range", F.lit(0.0))
    firsts = sorted((r[0], r[1]) for r in rows.groupBy("range").agg(F.min("at")).collect())  # one row per range
    if not firsts:
        return rows.select("range", F.lit(0).alias("ahead"), "at", "doc_id", "text")
    moved = [(firsts[i - 1][0], at) for i, (_, at) in enumerate(firsts)]
    opening = documents.sparkSession.createDataFrame(moved, "before double, at bigint")
    ahead = rows.join(F.broadcast(opening), "at").select(F.col("before").alias("range"), F.lit(1).alias("ahead"), "at", "doc_id", "text")
    return rows.select("range", F.lit(0).alias("ahead"), "at", "doc_id", "text").unionAll(ahead)


def fingerprint_documents(documents: DataFrame, size: int = GRAM, span: int = SPAN, ranges: int | None = None) -> DataFrame:
    """Winnowed fingerprints of every text and of the text edited with its successor.

    ``documents(doc_id, text)`` -> ``doc_id``, ``n_chars``, ``edited_text`` (the last half replaced by as
    many code points of the next document in order of doc_id, after the last the first),
    ``fingerprint`` and ``edited_fingerprint`` with the ``positions`` of their hashes, and the
    likenesses ``near_edited`` and ``near_next`` to the edited text and to the next document.

    Documents are sorted in ``ranges`` of ids (by default one per shuffle partition) and each
    task walks its own: the one shuffle moves every text once. Hashes cover whole texts.

    A NULL text is empty, with an empty fingerprint. NULL ids come last; documents of one id
    are ordered by text. A single document is its own successor. Other columns are ignored.
    """
    spark = documents.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _next_in_order(documents, ranges).repartition(ranges, "range").sortWithinPartitions("range", "ahead", "at", "text")

    def run(batches):
        held = None  # (range, ahead, doc_id, code points, hashes, positions)
        for part, texts in text_batches(batches):
            out = []
            for group, ahead, doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist(), texts):
                points = code_points(text)
                now = (group, ahead, doc, points, *winnow(points, size, span))
                if held is not None and held[0] == group and not held[1]:
                    out.append(_edited(held, now, size, span))
                held = now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], NAMES)

    return rows.mapInArrow(run, RESULT)


NAMES = [c.split(" ")[0] for c in RESULT.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.string(), pa.list_(pa.int64()), pa.float64(), pa.float64()]


def _edited(row: tuple, following: tuple, size: int, span: int) -> tuple:
    _, _, doc, points, hashes, positions = row
    half = len(points) // 2
    edited = np.concatenate([points[:len(points) - half], following[3][:half]])
    new, places = winnow(edited, size, span)
    text = edited.tobytes().decode("utf-32-le", "surrogatepass")
    return doc, len(points), text, as_text(hashes), positions, as_text(new), places, likeness(hashes, new), likeness(hashes, following[4])
