"""Packing documents into training sequences with minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.bpe import transducer
from docquarry.llm.store import stored
from docquarry.llm.tokens import text_batches

WINDOW = 4096
END = 2  # id behind each document
BLOCK_ROWS = 4_000  # pieces that are numbered together


def document_pieces(documents: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END) -> DataFrame:
    """Each document's ids and ``end_id``, cut after every full window: doc_id, start, length, ids_crc32, doc_tokens.

    A NULL text is empty; its one piece is the end id."""

    def run(batches):
        machine = transducer(tokenizer)
        for part, texts in text_batches(batches):
            docs = part.column(0).to_pylist()
            out = []
            for doc, ids in zip(docs, machine.encode_batch(texts)):
                ids = ids.astype("<u4").tobytes() + end_id.to_bytes(4, "little")
                n = len(ids) // 4
                out += [(doc, s, min(window, n - s), zlib.crc32(ids[4 * s:4 * (s + window)]), n) for s in range(0, n, window)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    rows = documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return rows.mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def best_fill(counts: Mapping[int, int], capacity: int) -> dict[int, int]:
    """Multiset of the lengths in ``counts`` whose sum is closest to ``capacity`` from below.

    Subset sums are the set bits of one integer. A length enters in doubling multiples up to
    its count, longest first; the integers before each step allow to walk back from the best
    sum to the multiplicities."""
    sums, mask, steps = 1, (1 << capacity + 1) - 1, []
    for length in sorted((n for n in counts if n <= capacity and counts[n]), reverse=True):
        left, some = min(counts[length], capacity // length), 1
        while left:
            some = min(some, left)
            steps.append((length, some, sums))
            sums |= sums << length * some & mask
            left, some = left - some, some * 2
            if sums >> capacity:
                left = 0
        if sums >> capacity:
            break
    total, out = sums.bit_length() - 1, {}
    for length, some, before in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + some
            total -= length * some
    return out


def packing_plan(counts: Mapping[int, int], window: int = WINDOW) -> dict[str, np.ndarray]:
    """Sequences for a histogram of piece lengths, as ranges of equally long pieces.

    The longest piece left opens a sequence and ``best_fill`` completes it; the same multiset
    is used as often as the counts allow. The plan's size depends on the number of distinct
    lengths (at most ``window``), not on the number of pieces. Entry: pieces ``slot ..`` of
    ``length`` go ``per`` to a sequence from ``sequence`` on, the first at ``offset``."""
    left = {n: c for n, c in counts.items() if c}
    entries, taken, sequence = [], dict.fromkeys(left, 0), 0
    while left:
        seed = max(left)
        left[seed] -= 1
        chosen = best_fill(left, window - seed)
        left[seed] += 1
        chosen[seed] = chosen.get(seed, 0) + 1
        times, offset = min(left[n] // m for n, m in chosen.items()), 0
        for n, m in sorted(chosen.items(), reverse=True):
            entries.append((n, taken[n], sequence, m, offset))
            taken[n] += m * times
            offset += n * m
            left[n] -= m * times
            if not left[n]:
                del left[n]
        sequence += times
    entries.sort()
    columns = np.array(entries, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "slot", "sequence", "per", "offset"), columns))


def pack_documents(documents: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Place every token of every document in a sequence of at most ``window`` tokens.

    ``documents(doc_id, text)`` -> per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset``. Documents longer than a window are cut into
    full windows and a rest. Texts are encoded once, without a shuffle; the driver sees the
    counts of at most ``window`` lengths and returns the plan, and pieces of equal length are
    numbered in blocks, so that a frequent length spreads over many tasks.

    A NULL or empty text is a piece of one token. Repeated rows are packed each. NULL ids
    stay; other columns are ignored; an empty table gives no pieces.
    """
    spark = documents.sparkSession
    pieces = stored(document_pieces(documents, tokenizer, window, end_id))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `window` rows
    plan = spark.sparkContext.broadcast(packing_plan(counts, window))
    blocks = max(1, sum(counts.values()) // block_rows)
    rows = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "start"), F.lit(blocks)))
    sizes = rows.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "block", F.coalesce(before, F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "start")
    rows = rows.withColumn("slot", F.row_number().over(inside) - 1).join(sizes, ["length", "block"])
    rows = rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("slot") + F.col("before")).alias("slot"))

    def place(batches):
        p = plan.value
        keys = (p["length"] << 48) + p["slot"] if len(p) else np.empty(0, np.int64)
        for batch in batches:
            length, slot = (batch.column(i).to_numpy() for i in (2, 5))
            at = np.searchsorted(keys, (length << 48) + slot, "right") - 1
            nth = slot - p["slot"][at]
            sequence = p["sequence"][at] + nth // p["per"][at]
            offset = p["offset"][at] + nth % p["per"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return rows.mapInArrow(place, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
