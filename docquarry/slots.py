"""Slots for user models: embedder, pair scorer, answerer, token counter.

Each slot takes a plain Python callable that works on a batch and runs it in
Arrow batches next to the data. The defaults need no model.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.text import lit_array, words


# Task functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def embed(df: DataFrame, embedder: Callable[[pd.Series], list], text: str = "text", out: str = "embedding") -> DataFrame:
    """Vector column by a user callable ``texts -> vectors``; blank text has no vector."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            filled = (texts.notna() & (texts.str.strip() != "")).to_numpy(dtype=bool)
            vectors = [None] * len(texts)
            if filled.any():
                for at, v in zip(np.flatnonzero(filled), embedder(texts[filled])):
                    vectors[at] = None if v is None else [float(x) for x in v]
            yield pd.Series(vectors, dtype=object)

    return df.withColumn(out, run(F.col(text)))


TEXT_AT_ONCE = 4 << 20  # bytes of text whose tokens a task holds
TOKENS_AT_ONCE = 1 << 14  # tokens that are hashed together
MD5_SHIFTS = [n for turn in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for n in turn * 4]
MD5_SINES = (np.abs(np.sin(np.arange(1, 65))) * 2**32).astype("uint32")
MD5_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], "uint32")
MD5_BLOCK = 55  # bytes of a token that fit in one block
KEPT = np.array([0, 0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], "uint32")  # by bytes left in a number: none, 0 to 4
ENDED = np.array([0, 0x80, 0x8000, 0x800000, 0x80000000, 0], "uint32")


def md5_heads(windows: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """First four bytes of the MD5 of many tokens of up to 55 bytes, as numbers.

    ``windows`` has the four bytes at every place of the text as one number."""
    message: list[np.ndarray | None] = [None] * 16
    for j in range(int(lengths.max()) // 4 + 1):
        left = np.clip(lengths - 4 * j, -1, 4) + 1
        message[j] = (windows[starts + 4 * j] & KEPT[left]) | ENDED[left]
    message[14] = (lengths * 8).astype("uint32")
    a, b, c, d = (np.full(len(starts), x) for x in MD5_START)
    for i, (shift, sine) in enumerate(zip(MD5_SHIFTS, MD5_SINES)):
        mixed, part = _md5_mix(i, b, c, d)
        mixed = mixed + a + sine
        if message[part] is not None:
            mixed += message[part]
        a, d, c, b = d, c, b, b + ((mixed << np.uint32(shift)) | (mixed >> np.uint32(32 - shift)))
    return (a + MD5_START[0]).byteswap()


def _md5_mix(i: int, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, int]:
    """Mixed state of a round and the number of the message that it takes."""
    if i < 16:
        return d ^ (b & (c ^ d)), i
    if i < 32:
        return c ^ (d & (b ^ c)), (5 * i + 1) % 16
    if i < 48:
        return b ^ c ^ d, (3 * i + 5) % 16
    return c ^ (b | ~d), 7 * i % 16


def token_buckets(tokens: pa.Array, dim: int) -> np.ndarray:
    """Bucket of every token by the first eight hex digits of its MD5; ``dim`` for empty ones."""
    offsets = np.frombuffer(tokens.buffers()[1], "int32")[tokens.offset:tokens.offset + len(tokens) + 1].astype("int64") if len(tokens) else np.zeros(1, "int64")
    lengths, out = np.diff(offsets), np.full(len(tokens), dim, "int64")
    if not lengths.any():
        return out
    data = tokens.buffers()[2].to_pybytes() + bytes(MD5_BLOCK + 9)
    windows = np.ndarray(len(data) - 3, "<u4", data, strides=(1,))
    for low, high in ((1, 15), (16, MD5_BLOCK)):  # short tokens have few numbers to take
        of = np.flatnonzero((lengths >= low) & (lengths <= high))
        for at in range(0, len(of), TOKENS_AT_ONCE):
            part = of[at:at + TOKENS_AT_ONCE]
            out[part] = md5_heads(windows, offsets[part], lengths[part]) % np.uint32(dim)
    for i in np.flatnonzero(lengths > MD5_BLOCK).tolist():
        out[i] = int.from_bytes(hashlib.md5(data[offsets[i]:offsets[i + 1]], usedforsecurity=False).digest()[:4]) % dim
    return out


def token_counts(texts: pa.Array, dim: int) -> np.ndarray:
    """Tokens per text and bucket. Blanks before or after a text leave empty tokens, which do not count."""
    tokens = pc.ascii_split_whitespace(texts.fill_null(""))
    places = np.repeat(np.arange(len(texts)) * (dim + 1), np.diff(tokens.offsets.to_numpy())) + token_buckets(tokens.flatten(), dim)
    return np.bincount(places, minlength=len(texts) * (dim + 1)).reshape(len(texts), dim + 1)[:, :dim].astype("float64")


def hashed_embedding(df: DataFrame, text: str = "text", out: str = "embedding", dim: int = 64) -> DataFrame:
    """Default embedder: token counts per hash bucket, scaled to unit length.

    A task splits the lower-cased texts of an Arrow batch and hashes many tokens at once.
    Blank text has no vector."""
    names = df.columns
    prepared = df.withColumn("_t", F.lower(F.col(text)))

    @F.arrow_udf("array<float>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            step = max(1, len(texts) * TEXT_AT_ONCE // max(TEXT_AT_ONCE, texts.nbytes))
            parts = [token_counts(texts.slice(at, step), dim) for at in range(0, len(texts), step)]
            counts = np.concatenate(parts) if parts else np.zeros((0, dim))
            length = np.linalg.norm(counts, axis=1, keepdims=True)
            unit = np.divide(counts, length, out=counts, where=length > 0).astype("float32")
            blank = length[:, 0] == 0
            offsets = np.r_[0, np.cumsum(np.where(blank, 0, dim))].astype("int32")
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit[~blank].ravel()), mask=pa.array(blank))

    return prepared.withColumn(out, count(F.col("_t"))).select(*[c for c in names if c != out], out)


def overlap_score(query: Column, text: Column) -> Column:
    """Default pair scorer: share of distinct query tokens that occur in the text."""
    q = F.array_distinct(words(F.lower(query)))
    common = F.size(F.array_intersect(q, words(F.lower(text))))
    return F.when(F.size(q) > 0, common / F.size(q)).otherwise(F.lit(0.0))


def score_pairs(df: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series] | None = None,
                query: str = "question", text: str = "text", out: str = "model_score") -> DataFrame:
    """Score column of (query, text) pairs by a user callable or by token overlap."""
    if scorer is None:
        return df.withColumn(out, overlap_score(F.col(query), F.col(text)))

    @F.pandas_udf("double")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(scorer(q, t), dtype="float64"))

    return df.withColumn(out, run(F.col(query), F.col(text)))


def isolated(call: Callable[[pd.Series], list], values: pd.Series) -> tuple[list, list[str | None]]:
    """Results of a batch callable and the error of each row that has none.

    A batch that fails, or returns another number of results, is tried again in halves until
    the rows that fail stand alone."""
    try:
        got = list(call(values))
        if len(got) != len(values):
            raise ValueError(f"{len(got)} results for {len(values)} rows")
        return got, [None] * len(got)
    except Exception as error:  # a user model may raise anything; its row reports it
        if len(values) <= 1:
            return [None] * len(values), [f"{type(error).__name__}: {error}"] * len(values)
    half = len(values) // 2
    (left, one), (right, two) = (isolated(call, part.reset_index(drop=True)) for part in (values.iloc[:half], values.iloc[half:]))
    return left + right, one + two


def answer_prompts(df: DataFrame, answerer: Callable[[pd.Series], list] | None = None, prompt: str = "prompt",
                   fallback: str = "best_text", out: str = "reply", sources: str | None = None, score: str | None = None) -> DataFrame:
    """Reply column by a user callable ``prompts -> replies``; without one the reply
    is extractive: a JSON object that quotes the best text, with the chunk ids in column
    ``sources`` and the score in column ``score``, limited to 0 to 1, as its confidence.

    A prompt for which the callable fails has no reply and its error in ``{out}_error``; the
    other prompts of its batch are answered."""
    if answerer is None:
        confidence = F.greatest(F.least(F.coalesce(F.col(score), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)) if score else F.lit(1.0)
        quoted = F.to_json(F.struct(
            F.col(fallback).alias("answer"), confidence.alias("confidence"), F.lit("Best matching passage").alias("reasoning"),
            (F.col(sources) if sources else lit_array([])).alias("sources")))
        return df.withColumn(out, quoted).withColumn(f"{out}_error", F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, errors = isolated(answerer, batch.column(prompt).to_pandas())
            replies = pa.array([None if r is None else str(r) for r in got], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, replies, pa.array(errors, pa.string())], names=[*batch.schema.names, out, f"{out}_error"])

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField(f"{out}_error", T.StringType())]))


def count_tokens(df: DataFrame, counter: Callable[[pd.Series], list], text: str = "text", out: str = "tokens") -> DataFrame:
    """Token counts by a user tokenizer instead of whitespace words."""

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(list(counter(texts.fillna(""))), dtype="int32"))

    return df.withColumn(out, run(F.col(text)))
