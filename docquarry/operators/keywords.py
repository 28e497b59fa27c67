"""Keyword top-k over blocks of chunks.

The order of keyword hits does not depend on the question, so the k best chunks
of each distinct (scope, term) are enough for every question that uses the term.
Chunks are packed per task in that order, and all terms of a scope look through a
block at once; a term that has k hits looks at the chunks only that can beat them.
No more than k rows per term leave a task.
"""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.operators.vectors import _as_list, _group_starts
from docquarry.scale import BROADCAST_ROWS, top_k

# Task functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TERMS_PER_LIST = 20_000
BLOCK_CHARS = 1_000_000
WINDOW = 8  # bytes that are compared as one number
SLICE = 1 << 20  # places of a block that are looked at together
STEP = 1 << 16  # bytes of the texts of a block after which terms that need no more leave for the first time
TABLE_BITS, SPREAD = 16, np.uint64(0x9E3779B97F4A7C15)


def pack_chunks(chunks: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Rows (scope, chunk_id, confidence_score, chunk_index, haystack) to lists of one scope each."""
    scope = list(scope)
    carried = ["chunk_id", "confidence_score", "chunk_index", "haystack"]
    df = chunks.select(*scope, F.col("chunk_id").cast("string").alias("chunk_id"), F.coalesce(F.col("confidence_score").cast("double"), F.lit(0.0)).alias("confidence_score"),
                       F.coalesce(F.col("chunk_index").cast("bigint"), F.lit(0)).alias("chunk_index"), F.coalesce("haystack", F.lit("")).alias("haystack"))
    schema = ", ".join([f"{c} string" for c in scope] + ["chunk_id array<string>", "confidence_score array<double>", "chunk_index array<bigint>", "haystack array<string>"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            step = max(1, int(batch.num_rows * BLOCK_CHARS / max(1, batch.column("haystack").nbytes)))
            order, starts = _group_starts(batch, scope)
            for lo, hi in zip(starts[:-1], starts[1:]):
                for at in range(lo, hi, step):
                    picked = batch.take(pa.array(order[at:min(at + step, hi)]))
                    yield pa.RecordBatch.from_arrays(
                        [picked.column(c).slice(0, 1) for c in scope] + [_as_list(picked.column(c)) for c in carried], names=scope + carried)

    return df.mapInArrow(pack, schema)


def _masked(windows: np.ndarray, n: int) -> np.ndarray:
    return windows if n == WINDOW else windows & np.uint64((1 << (8 * n)) - 1)


class TermList:
    """Running k best (key, chunk) of each term of one list, over all blocks of a task.

    Terms and texts are compared as bytes: the next eight bytes at every place of a text are one number,
    and the terms of one length a sorted array of numbers. Longer terms meet on their first
    and last eight bytes and are then compared whole."""

    def __init__(self, terms: Sequence[str]) -> None:
        self.terms = terms
        self.best: list[list[tuple[float, int, str]]] = [[] for _ in terms]
        self.raw = [t.encode() for t in terms]
        self.length = np.array([len(t) for t in self.raw], "int64")
        self.head = np.array([int.from_bytes(t[:WINDOW], "little") for t in self.raw], "uint64")
        self.tail = np.array([int.from_bytes(t[-WINDOW:], "little") for t in self.raw], "uint64")

    def limits(self, keys: list[tuple[float, int, str]], k: int) -> np.ndarray:
        """Per term, how many of the sorted ``keys`` can be among its k best."""
        places: dict[tuple[float, int, str], int] = {}
        out = np.full(len(self.terms), len(keys), "int64")
        for i, kept in enumerate(self.best):
            if len(kept) >= k:
                worst = kept[-1]
                if worst not in places:
                    places[worst] = bisect_right(keys, worst)
                out[i] = places[worst]
        return out

    def add(self, keys: list[tuple[float, int, str]], texts: pa.Array, k: int) -> None:
        """A block of ``texts`` in the order of their ``keys``."""
        offsets = np.frombuffer(texts.buffers()[1], "int32")[texts.offset:texts.offset + len(texts) + 1].astype("int64")
        data = texts.buffers()[2].to_pybytes()[offsets[0]:offsets[-1]] if offsets[-1] > offsets[0] else b""
        offsets, limits = offsets - offsets[0], self.limits(keys, k)
        windows = np.ndarray(len(data), "<u8", data + bytes(WINDOW), strides=(1,))
        # Chunks come best first: a term leaves at its limit, or once it has k chunks of this block.
        parts, held, asked = [np.zeros(0, "int64")], np.zeros(len(self.terms), "int64"), np.arange(len(self.terms))
        for first, last in self._groups(offsets):
            asked = asked[(limits[asked] > first) & (held[asked] < k)]
            if not len(asked):
                break
            pairs = np.zeros(0, "int64")
            for lo in range(int(offsets[first]), int(offsets[last]), SLICE):
                term, at = self._matches(asked, windows, data, lo, min(lo + SLICE, int(offsets[last])))
                chunk = np.searchsorted(offsets, at, side="right") - 1
                good = (at + self.length[term] <= offsets[chunk + 1]) & (chunk < limits[term])
                pairs = self._first(np.concatenate([pairs, term[good] * len(keys) + chunk[good]]), len(keys), k)
            held += np.bincount(pairs // len(keys), minlength=len(held))
            parts.append(pairs)
        pairs = self._first(np.concatenate(parts), len(keys), k)
        term, chunk = np.divmod(pairs, len(keys))
        ends = [*(np.flatnonzero(np.diff(term)) + 1).tolist(), len(term)] if len(term) else []
        for lo, hi in zip([0, *ends], ends):
            i = int(term[lo])
            self.best[i] = sorted(self.best[i] + [keys[c] for c in chunk[lo:hi].tolist()])[:k]

    @staticmethod
    def _groups(offsets: np.ndarray) -> list[tuple[int, int]]:
        """Runs of whole texts, each of about twice the bytes of the one before, as first text and the text after the last."""
        group = np.log2(offsets[:-1] / STEP + 1).astype("int64")
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][:len(group)]).tolist()
        return list(zip(starts, [*starts[1:], len(group)]))

    @staticmethod
    def _first(pairs: np.ndarray, n: int, k: int) -> np.ndarray:
        """Distinct pairs term * n + chunk, the k first chunks of each term."""
        pairs = np.unique(pairs)
        term = pairs // n
        fresh = np.r_[True, term[1:] != term[:-1]][:len(term)]
        return pairs[np.arange(len(term)) - np.maximum.accumulate(np.where(fresh, np.arange(len(term)), 0)) < k]

    def _matches(self, asked: np.ndarray, windows: np.ndarray, data: bytes, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Terms of ``asked`` and the places between lo and hi at which they begin."""
        here = windows[lo:hi].copy()
        terms, places = [np.zeros(0, "int64")], [np.zeros(0, "int64")]
        lengths = self.length[asked]
        for n in range(1, WINDOW + 1):
            group = asked[lengths == n] if n < WINDOW else asked[lengths >= n]
            if not len(group):
                continue
            values, first = np.unique(self.head[group], return_inverse=True)
            marked = np.zeros(1 << TABLE_BITS, bool)
            marked[(values * SPREAD) >> np.uint64(64 - TABLE_BITS)] = True
            masked = _masked(here, n)
            at = np.flatnonzero(marked[(masked * SPREAD) >> np.uint64(64 - TABLE_BITS)])
            seen = masked[at]
            hit = np.minimum(np.searchsorted(values, seen), len(values) - 1)
            at, hit = at[values[hit] == seen], hit[values[hit] == seen]
            short = self.length[group] <= WINDOW
            owner = np.full(len(values), -1, "int64")
            owner[first[short]] = group[short]  # distinct terms of one length have distinct numbers
            exact = owner[hit] >= 0
            terms.append(owner[hit[exact]])
            places.append(at[exact] + lo)
            for m in np.unique(self.length[group[~short]]).tolist():
                found = self._long(group[self.length[group] == m], at + lo, windows, data, m)
                terms.append(found[0])
                places.append(found[1])
        return np.concatenate(terms), np.concatenate(places)

    def _long(self, group: np.ndarray, at: np.ndarray, windows: np.ndarray, data: bytes, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Terms of m bytes, more than a window, among the places ``at``."""
        at = at[at + m <= len(data)]
        ends = (self.head[group] * SPREAD) ^ self.tail[group]
        seen = (windows[at] * SPREAD) ^ windows[at + m - WINDOW]
        maybe = np.isin(seen, ends)
        same: dict[int, list[int]] = {}
        for value, i in zip(ends.tolist(), group.tolist()):
            same.setdefault(value, []).append(i)
        found = [(i, p) for p, value in zip(at[maybe].tolist(), seen[maybe].tolist()) for i in same[value] if data[p:p + m] == self.raw[i]]
        both = np.array(found, "int64").reshape(-1, 2)
        return both[:, 0], both[:, 1]


def match_blocks(pairs: DataFrame, k: int) -> DataFrame:
    """Block and term list pairs to the k best (scope, term, chunk) rows of the task."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[tuple[str, int], TermList] = {}
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):  # one block at a time, without copies of the others
                row = {name: column[i] for name, column in columns.items()}
                key = row["_scope"].as_py(), row["_list"].as_py()
                if key not in lists:
                    lists[key] = TermList(row["terms"].as_py())
                confidence, index, ids = (row[c].as_py() for c in ("confidence_score", "chunk_index", "chunk_id"))
                order = np.lexsort((np.array(ids), index, -np.array(confidence)))
                keys = [(-confidence[i], index[i], ids[i]) for i in order.tolist()]
                lists[key].add(keys, row["haystack"].values.take(pa.array(order)), k)
        hits = ((scope, one.terms[t], c, -n, i) for (scope, _), one in lists.items() for t, kept in enumerate(one.best) for n, i, c in kept)
        while part := list(zip(*islice(hits, 50_000))):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[0], pa.string()), pa.array(part[1], pa.string()), pa.array(part[2], pa.string()), pa.array(part[3], pa.float64()), pa.array(part[4], pa.int64())],
                names=["_scope", "term", "chunk_id", "confidence_score", "chunk_index"])

    return pairs.mapInArrow(match, "_scope string, term string, chunk_id string, confidence_score double, chunk_index bigint")


def best_per_term(chunks: DataFrame, wanted: DataFrame, k: int, names: Sequence[str], match: Column, columns: Sequence[str], salts: int = 1) -> DataFrame:
    """The k best chunks of each distinct (scope, term): _scope, term, chunk_id, confidence_score, chunk_index.

    ``wanted`` has _ns, the filter columns ``names``, _scope and term. Terms of a scope
    travel as lists; lists are cut by hash, so none grows with the number of questions."""
    total = wanted.count()
    lists = max(1, -(-total // TERMS_PER_LIST))
    grouped = wanted.groupBy("_ns", *names, "_scope", F.pmod(F.xxhash64("term"), F.lit(lists)).alias("_list")).agg(F.collect_list("term").alias("terms"))
    side = F.broadcast(grouped) if total <= BROADCAST_ROWS else grouped
    pairs = pack_chunks(chunks, ["namespace", *columns]).join(side, (F.col("namespace") == F.col("_ns")) & match)
    found = match_blocks(pairs.select("_scope", "_list", "terms", "chunk_id", "confidence_score", "chunk_index", "haystack"), k)
    order = [F.col("confidence_score").desc(), F.col("chunk_index"), F.col("chunk_id")]
    return top_k(found, ["_scope", "term"], order, k, rank="_r", salt=F.col("chunk_id"), salts=salts).drop("_r")
